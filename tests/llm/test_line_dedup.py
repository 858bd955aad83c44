import hashlib
import random

import numpy as np
import pytest

from kindred.llm import line_dedup as L

from .helpers import documents, empty_documents, odd_documents

SPACE = " \t\n\x0b\x0c\r"


def plain_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    """Lines before, lines dropped and hash of what is kept, for (id, text) rows."""
    order = lambda i: (i is None, i)
    holders: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(plain_key(line), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(plain_key(x)) < 10 or min(holders[plain_key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def run(docs, **options):
    return sorted(map(tuple, L.drop_repeated_lines(docs, **options).collect()), key=str)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        built = L.PerfectHash.build(keys)
        again = L.PerfectHash(built.sizes, built.bits)
        assert sorted(again.lookup(keys).tolist()) == list(range(len(keys)))
        other = rng.integers(-(1 << 62), 1 << 62, 500)
        assert again.lookup(other).max(initial=-1) < max(len(keys), 1)


def test_keys_equal_in_one_half_stay_apart():
    import pandas as pd

    rows = pd.DataFrame({"shard": 0, "h": [5, 5, 5, 6], "fp": [1, 2, 3, 1], "n": [2, 3, 4, 5], "first": [10, 20, 30, 40]})
    index = L._build_shard(rows)
    probes = pd.DataFrame({"shard": 0, "chunk": [0, 0, 0, 0, 0], "h": [5, 5, 5, 6, 6], "fp": [3, 2, 1, 1, 9]})
    got = L._probe_shard(index, probes)
    assert sorted(zip(got["h"], got["fp"], got["first"], got["n"], strict=True)) == [(5, 1, 10, 2), (5, 2, 20, 3), (5, 3, 30, 4), (6, 1, 40, 5)]


LINES = ["A shared line of text", "\ta SHARED line of text \x0b", "short", "Éàü ßéèê ñ!", "éàü ßéèê ñ!", " A shared line of text", "exactly 10", "ninechars", "", "   ", "another line, rather long"]


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 200, "keys_per_shard": 5}])
def test_against_brute_force(spark, options):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(LINES) + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(rng.randrange(7)))) for i in range(80)]
    rows += [(i, None) for i in (100, 101)] + [(None, LINES[0]), (None, LINES[-1] + "x"), (5, LINES[0] + "\n" + LINES[0])]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    assert run(docs, **options) == brute(rows)
    assert all(r[4] is None for r in run(docs, keep_text=False))


def test_odd_input(spark):
    docs = odd_documents(spark)
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert L.drop_repeated_lines(empty_documents(spark)).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({L.ORACLE_SQL['op9_line_dedup']})").fetchall()
    got = L.op9_line_dedup(spark, d).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
