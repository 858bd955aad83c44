import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import mixing as M

from .helpers import documents, empty_documents, odd_documents, prose

def domain():
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")


TARGETS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(300):
        kind = ("clean", "low", "toxic")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        text = prose(rng, 30)
        text = text.replace(" ", " %%% ") if kind == "low" else text + " idiot scum" if kind == "toxic" else text
        texts.append(text)
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_expected_tokens_meet_targets(corpus):
    got = M.mixing_rates(*corpus, domain(), TARGETS).collect()
    assert len(got) == 300 and min(r["rate"] for r in got) >= 0
    totals = {d: sum(r["tokens"] * r["rate"] * r[f"p_{d}"] for r in got) for d in TARGETS}
    for d, share in TARGETS.items():
        assert totals[d] / sum(totals.values()) == pytest.approx(share, abs=1e-3)
    before = sum(r["tokens"] * r["p_clean"] for r in got)
    assert totals["clean"] == pytest.approx(before, rel=1e-3)  # the domain with the largest share keeps its tokens
    for r in got:
        assert r["p_clean"] + r["p_low"] + r["p_toxic"] == pytest.approx(1)
        assert abs(r["copies"] - r["rate"]) < 1


def test_classifier(corpus):
    docs, labels = corpus
    got = M.mixing_rates(docs, labels.filter("doc_id % 3 > 0"), domain(), TARGETS)
    truth = labels.select("doc_id", domain().alias("d"))
    hit = F.element_at(F.create_map(F.lit("clean"), F.col("p_clean"), F.lit("low"), F.col("p_low"), F.lit("toxic"), F.col("p_toxic")), F.col("d"))
    assert got.join(truth, "doc_id").filter("doc_id % 3 = 0").agg(F.avg((hit > 0.5).cast("int"))).first()[0] > 0.95


def test_projected_gradient_against_brute_force(spark):
    """Where targets cannot be met, the fit is no worse than many random nonnegative rates."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1], 40)
    tokens = rng.integers(1, 50, 40)
    rows = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p0 double, p1 double")
    target = np.array([1.0, 0.02]) * 100  # less of the second than comes with the first
    rate = np.array([r[0] for r in rows.select(M.fit_rates(rows, 2, target, 60, 1e-9).alias("r")).collect()])
    assert (rate >= 0).all()
    a = (p * tokens[:, None]).T
    inverse = np.linalg.inv((p * tokens[:, None]).T @ p)
    loss = lambda r: (a @ r - target) @ inverse @ (a @ r - target)
    assert loss(rate) <= loss(np.ones(40))
    assert loss(rate) <= min(loss(rng.exponential(s, 40)) for s in (0.02, 0.05, 0.1, 0.5) for _ in range(200)) + 1e-6


def test_copies_take_effect(corpus):
    docs, labels = corpus
    rates = {r["doc_id"]: r["copies"] for r in M.mixing_rates(docs, labels, domain(), TARGETS).collect()}
    mixed = M.mix(docs, labels, domain(), TARGETS)
    assert mixed.columns == docs.columns
    got: dict = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in rates.items() if n}


def test_copies_keep_small_rates(spark):
    """A domain whose target asks for less than a tenth of its tokens does not vanish."""
    rng = random.Random(6)
    texts = [prose(rng, 30) + (" idiot scum" if i % 3 == 0 else "") for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = M.mixing_rates(documents(spark, texts), labels, domain(), {"clean": 0.97, "toxic": 0.03}).collect()
    toxic = [r for r in got if r["doc_id"] % 3 == 0]
    assert 0.02 < sum(r["rate"] for r in toxic) / len(toxic) < 0.1
    assert sum(r["copies"] for r in toxic) == pytest.approx(sum(r["rate"] for r in toxic), abs=14)
    assert sum(r["copies"] for r in toxic) > 4


def test_odd_input(spark, corpus):
    _, labels = corpus
    docs = odd_documents(spark)
    got = M.mixing_rates(docs, labels, domain(), TARGETS)
    assert got.count() == docs.count()
    assert all(r["tokens"] == 0 for r in got.filter("doc_id in (0, 1, 2, 3)").collect())
    assert M.mix(docs, labels, domain(), TARGETS).columns == docs.columns
    assert M.mixing_rates(empty_documents(spark), labels, domain(), TARGETS).count() == 0
    unknown = M.mixing_rates(docs, labels.limit(0), domain(), TARGETS).first()
    assert unknown["p_low"] == pytest.approx(1 / 3)


def test_only_dataframe_operations(corpus):
    plan = M.mixing_rates(*corpus, domain(), TARGETS)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
