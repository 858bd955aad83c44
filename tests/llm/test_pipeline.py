import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline", reason="goes with the subpackage")

from kindred.llm import decontaminate, simhash  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{random.getrandbits(60)}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in before.collect()}
    names = list(kept)
    for a, b in zip(names, names[1:], strict=False):
        assert kept[b].items() <= kept[a].items()
    # Quality: what is labelled good stays.
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in kept[names[0]] for i in good) / len(good) > 0.95
    assert sum(i in kept[names[0]] for i in labels if labels[i] == 0) <= 0.3 * sum(v == 0 for v in labels.values())  # a hundred labels here
    # Near copies: no two of those that stay are alike; brute force over all pairs.
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in kept[names[1]].values()]
    assert not any(len(x & y) >= 0.8 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    # Benchmark: no passage is left, and what has none stays.
    index = decontaminate.ItemIndex.build([tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()])
    leaks = {i for i, t in kept[names[1]].items() if index.search(decontaminate.normal(t))}
    assert set(kept[names[1]]) - leaks == set(kept[names[2]])
    exact = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(x in decontaminate.normal(t) for t in kept[names[2]].values() for x in exact)


def test_run(spark):
    rows = pipeline.run(spark, DATA).collect()
    assert rows and {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} <= set(range(24))
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
