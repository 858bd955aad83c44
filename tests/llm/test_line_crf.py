import itertools
import random
import zlib

import numpy as np
import pytest

from kindred.llm import line_crf as L

from .helpers import documents, empty_documents, odd_documents, prose


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        score, pair = rng.normal(0, 3, n), rng.normal(0, 2, (2, 2))
        total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(s for s, v in zip(score, y, strict=True) if v) + sum(pair[a, b] for a, b in itertools.pairwise(y)))
            total += w
            good += w * np.array(y)
            for a, b in itertools.pairwise(y):
                pairs[a, b] += w
        assert L.marginals(score, pair) == pytest.approx(good / total)
        # The same for several texts at once: this one, one of a single line, and this one again.
        sizes = np.array([n, 1, n])
        p, each, mass = L.Chains(sizes).all(np.concatenate([score, [0.5], score]), pair, L.Chains(sizes[::-1]))
        assert p[:n] == pytest.approx(good / total) and p[n + 1 :] == pytest.approx(good / total) and p[n] == pytest.approx(1 / (1 + np.exp(-0.5)))
        assert each[: n - 1].sum(axis=0).reshape(2, 2) == pytest.approx(pairs / total)
        assert mass == pytest.approx([np.log(total), np.log(1 + np.exp(0.5)), np.log(total)])


def test_extreme_scores_do_not_overflow():
    p = L.marginals(np.array([1e4, -1e4, 0.0] * 50), np.array([[2.0, -2.0], [-2.0, 2.0]]))
    assert np.isfinite(p).all() and p[0] > 0.99 and p[1] < 0.01


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        lines = [prose(rng, rng.randrange(4, 20)).capitalize() + "." for _ in range(rng.randrange(1, 6))]
        if not good:
            junk = i % 4
            spoil = [lambda x: x.upper().replace(" ", "!! "), lambda x: x.replace(" ", "%%% "), lambda x: " ".join(w for w in x.split() for _ in range(9)), lambda x: x.replace(" ", " | ")][junk]
            lines = [spoil(x) for x in lines]
        texts.append("\n".join(lines))
        labels.append((i, int(good), 0))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = L.quality(docs, labels).collect()
    assert len(rows) == 400
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_held_out_labels_are_never_used(spark, corpus):
    docs, labels = corpus
    lies = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a = {r["doc_id"]: r["score"] for r in L.quality(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in L.quality(docs.repartition(3), lies).collect()}
    assert a == pytest.approx(b)


def test_keep_good(corpus):
    docs, labels = corpus
    want = {r["doc_id"] for r in L.quality(docs, labels).collect() if r["predicted"]}
    kept = L.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_odd_input(spark, corpus):
    _, labels = corpus
    docs = odd_documents(spark)
    rows = L.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert L.keep_good(docs, labels).columns == docs.columns
    assert L.quality(empty_documents(spark), labels).count() == 0
    assert {r["score"] for r in L.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert L.quality(docs, labels.selectExpr("doc_id", "cast(NULL AS int) AS quality")).count() == docs.count()


def test_one_kind_of_label():
    field = L.fit(["a text", "b text"], [1, 1])
    assert field.document("whatever") == pytest.approx(0.75)


def test_given_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = L.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_document_scores_by_enumeration(corpus):
    """Whole scores of short texts: all labellings summed up, no forward or backward pass."""
    docs, labels = corpus
    field = L.train(docs, labels)
    for text in [r["text"] for r in docs.limit(60).collect()] + [None, "", "\n", "a\n\nB!! B!!"]:
        x = L.text_lines(text)
        score = x.surface @ field.weights
        words = [w for line in (text or "").encode().split(b"\n") for w in [line.lower().split()]]
        own = [sum(field.own[zlib.crc32(w) & L.WORD_MASK] for w in ws) / max(1, len(ws)) ** 0.5 for ws in words]
        near = [sum(field.near[zlib.crc32(w) & L.WORD_MASK] for w in ws) / max(1, len(ws)) ** 0.5 for ws in words]
        score = [a + b + (near[i - 1] if i else 0) + (near[i + 1] if i + 1 < len(near) else 0) for i, (a, b) in enumerate(zip(score, own, strict=True))]
        total, good = 0.0, np.zeros(len(score))
        for y in itertools.product((0, 1), repeat=len(score)):
            w = np.exp(np.dot(score, y) + sum(field.pair[a, b] for a, b in itertools.pairwise(y)))
            total, good = total + w, good + w * np.array(y)
        mean = (good / total @ x.lengths) / x.lengths.sum()
        odds = np.log((mean + 1e-3) / (1 - mean + 1e-3))
        assert field.document(text) == pytest.approx(1 / (1 + np.exp(-field.slope * odds - field.shift)))


def mixed(rng):
    """A text of runs of good and bad lines; most lines are neutral, the first of a run tells.  With the truth of every line."""
    lines, truth = [], []
    for _ in range(rng.randrange(1, 4)):
        good = rng.random() < 0.5
        run = rng.randrange(3, 9)
        lines += [("fine " if good else "spam ") + prose(rng, 2)] + ["neutral words here" for _ in range(run - 1)]
        truth += [int(good)] * run
    return "\n".join(lines), truth


def test_the_chain_labels_lines_of_mixed_documents():
    """Line labels are never given.  Three lines and more from a telling line, only the chain can know."""
    rng = random.Random(12)
    made = [mixed(rng) for _ in range(700)]
    label = lambda text, truth: int(np.dot([len(x) + 1 for x in text.split("\n")], truth) >= 0.5 * (len(text) + 1))
    texts, labels = [t for t, _ in made], [label(*x) for x in made]
    with_chain, without = (L.fit(texts[:500], labels[:500], chain=c) for c in (True, False))
    assert np.all(without.pair == 0) and with_chain.pair[0, 0] + with_chain.pair[1, 1] > with_chain.pair[0, 1] + with_chain.pair[1, 0] + 1

    def right(field):
        return np.mean([(p > 0.5) == bool(y) for text, truth in made[500:] for p, y in zip(field.lines(text)[0], truth, strict=True)])

    def documents_right(field):
        return np.mean([(field.document(t) > 0.5) == bool(y) for t, y in zip(texts[500:], labels[500:], strict=True)])

    lines, documents_ = (right(with_chain), right(without)), (documents_right(with_chain), documents_right(without))
    assert lines[0] > 0.8 and lines[0] > lines[1] + 0.1, lines
    assert documents_[0] >= documents_[1], documents_  # here they tie: what the chain adds is where the bad lines are


def test_repeated_rows_do_not_change_the_fit(spark, corpus):
    docs, labels = corpus
    some = docs.limit(60)
    a, b = (L.train(d, labels) for d in (some, some.unionAll(some).unionAll(some).repartition(5)))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.pair, b.pair)
