import random
import zlib

import numpy as np
import pytest

from kindred.llm import sharding as S

from .helpers import documents, empty_documents, odd_documents, prose


def check(rows, docs, n_shards):
    assert len(rows) == len(docs)
    want = sorted((str(d["doc_id"]), len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    slots: dict = {}
    for r in rows:
        assert 0 <= r["shard"] < n_shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return slots


def loads(rows, n, what):
    out = np.zeros(n)
    for r in rows:
        out[r["shard"]] += what(r)
    return out


def test_balance(spark):
    rng = random.Random(1)
    docs = documents(spark, [prose(rng, rng.randrange(1, 120)) for _ in range(3000)])
    rows = S.assign_shards(docs, n_shards=8).collect()
    check(rows, docs.collect(), 8)
    for what, slack in ((lambda r: r["size"], 0.01), (lambda r: r["tokens"], 0.05), (lambda r: 1, 0.05)):
        x = loads(rows, 8, what)
        assert x.max() / x.mean() < 1 + slack and x.min() / x.mean() > 1 - slack


def test_groups_stay_together_unless_they_outweigh_a_shard(spark):
    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(600)]
    texts += [texts[0]] * 30 + ["hot " * 40] * 400
    rows = S.assign_shards(documents(spark, texts), n_shards=6).collect()
    check(rows, documents(spark, texts).collect(), 6)
    of: dict = {}
    for r in rows:
        of.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in of.items() if not t.startswith("hot"))
    assert len(of["hot " * 40]) > 1
    x = loads(rows, 6, lambda r: r["size"])
    assert x.max() / x.mean() < 1.1


def test_placement_takes_the_highest_dot_product():
    vectors = np.array([[0.9, 0.1], [0.1, 0.9], [0.1, 0.8], [0.8, 0.1]])
    got = S.place(vectors, 2, (1.0, 1.0))
    assert got.tolist() == [0, 1, 0, 1]  # heavy in one dimension goes where the other is full


def test_cells_do_not_change_what_holds(spark):
    rng = random.Random(3)
    docs = documents(spark, [prose(rng, 5) for _ in range(500)])
    rows = S.assign_shards(docs, n_shards=3, rows_per_cell=4).collect()
    check(rows, docs.collect(), 3)


def test_odd_input(spark):
    docs = odd_documents(spark)
    rows = S.assign_shards(docs).collect()
    check(rows, docs.collect(), 24)
    assert S.assign_shards(empty_documents(spark)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = S.assign_shards(docs).collect()
    x = loads(rows, 24, lambda r: r["size"])
    assert len(rows) == 10_000 and x.max() / x.mean() == pytest.approx(1, abs=0.02) and x.min() / x.mean() == pytest.approx(1, abs=0.02)
