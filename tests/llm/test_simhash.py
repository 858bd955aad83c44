import itertools
import random

import numpy as np
import pytest
import xxhash

from kindred.llm import simhash as S
from kindred.llm.components import components
from kindred.llm.shared import Scratch

from .helpers import documents, empty_documents, odd_documents, prose


def plain_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [None, "", " \t\n", "One", "one two", "A b C d e", "É x y z\x0bw\x1cv", "a b a b a b a b"]:
        assert S.fingerprint(text, 3) & (1 << 64) - 1 == plain_fingerprint(text, 3)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tables_cover_every_pair_of_positions(radius):
    masks = [m & (1 << 64) - 1 for m in S.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1 and all(m.bit_count() >= 30 for m in masks)
    rng = random.Random(radius)
    spots = itertools.combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), 3) for _ in range(5000))
    for bits in spots:
        difference = sum(1 << b for b in bits)
        assert any(not m & difference for m in masks)


def roots_of(values, radius):
    """Least value reachable by steps of up to ``radius`` bits."""
    values, root = sorted(values), {}
    for v in values:
        if v in root:
            continue
        root[v], queue = v, [v]
        while queue:
            x = queue.pop()
            for y in values:
                if y not in root and (x ^ y).bit_count() <= radius:
                    root[y] = v
                    queue.append(y)
    return root


@pytest.mark.parametrize("small", [0, 10_000])
def test_bucket_links(small):
    rng = random.Random(5)
    for _ in range(30):
        free = rng.sample(range(64), 9)
        base = rng.getrandbits(64)
        values = {base ^ sum(1 << b for b in free if rng.random() < 0.3) for _ in range(40)}
        member, root = S.bucket_links(np.array(sorted(values), np.uint64).view(np.int64), 2, small)
        got = dict(zip(member.view(np.uint64).tolist(), root.view(np.uint64).tolist(), strict=True))
        want = {v: r for v, r in roots_of(values, 2).items() if v != r}
        assert got == want


def test_components_against_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(60)] + [(i, i + 1) for i in range(100, 180)] + [(7, 7), (None, 3), (300, x := 301), (x, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def near_texts(rng):
    texts = []
    for _ in range(25):
        words = prose(rng, rng.randrange(80, 300)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            other = words[:]
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    return texts


def test_query_components(spark):
    texts = near_texts(random.Random(7)) + ["", None, " "]
    docs = documents(spark, texts, range(1000, 1000 + len(texts)))
    rows = S.simhash_components(docs).collect()
    fp = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows}
    assert fp == {1000 + i: plain_fingerprint(t, 3) for i, t in enumerate(texts)}
    root = roots_of(set(fp.values()), 2)
    least: dict = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: least[root[f]] for i, f in fp.items()}
    assert len(set(least.values())) < len(texts)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts, similarity):
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= similarity:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_dedup_against_brute_force(spark):
    texts = near_texts(random.Random(8)) + ["", None, "x", "X ", "a b c", "a b d"]
    docs = documents(spark, texts)
    want = set(groups(texts, 0.8))
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want
    assert len(want) < len(texts)


def test_middle_members_of_a_template_family(spark):
    """Strangers that share a template stand at both ends of most classes; the near copies are among those between."""
    rng = random.Random(12)
    template, texts = prose(rng, 340).split(), []
    for _ in range(120):
        own = prose(rng, 50).split()
        texts.append(" ".join(template + own))
    for i in range(60):
        words = texts[i].split()
        texts.append(" ".join(words[:-41] + prose(rng, 41).split()))
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    assert 0.7 < jaccard(sets[0], sets[1]) < 0.78 and jaccard(sets[0], sets[120]) > 0.8
    assert {r["doc_id"] for r in S.near_dedup(documents(spark, texts)).collect()} == set(groups(texts, 0.8))


def test_long_texts_are_compared_whole(spark):
    """Pairs of 2,000 shingles just above and just below the least similarity; a sample of 512 mistakes many of them."""
    rng = random.Random(13)
    texts = []
    for i in range(40):
        words = [f"{w}{k}" for k, w in enumerate(prose(rng, 2004).split())]
        other = words[:]
        n = 218 if i % 2 else 228
        other[-n:] = prose(rng, n).split()
        texts += [" ".join(words), " ".join(other)]
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    assert jaccard(*sets[2:4]) > 0.8 > jaccard(*sets[:2]) > 0.79
    assert {r["doc_id"] for r in S.near_dedup(documents(spark, texts)).collect()} == set(groups(texts, 0.8))


@pytest.mark.parametrize("sizes", [(5, 4, 4), (9, 9, 8), (250, 200, 200), (312, 250, 250), (1020, 1020, 907), (1275, 1020, 1020)])
def test_prefixes_of_similar_sets_meet(sizes):
    """Sets of the first two sizes with so many shared shingles, a similarity of 0.8 or just more."""
    rng = np.random.default_rng(3)
    n, m, both = sizes
    assert both / (n + m - both) >= 0.8
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        common = rng.choice(pool, 50)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n:]]))
        first, second = S.prefix(a, 0.8, common), S.prefix(b, 0.8, common)
        x, y = first.tolist(), second.tolist()
        shared = next((v for v in x if v in set(y)), None)
        assert shared is not None
        assert S.may_be_similar(len(a), x.index(shared), len(b), y.index(shared), 0.8)


def test_similar_is_exact_for_small_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 40, 30).astype(np.uint64))
        b = np.unique(rng.integers(0, 40, 30).astype(np.uint64))
        assert S.similar(a, b, 512) == pytest.approx(jaccard(set(a), set(b)))
    a, b = np.arange(0, 2000, dtype=np.uint64), np.arange(200, 2200, dtype=np.uint64)
    mixed = lambda x: np.sort(S._mixed(x))[:512]
    assert S.similar(mixed(a), mixed(b), 512) == pytest.approx(1800 / 2200, abs=0.08)


def test_odd_input(spark):
    docs = odd_documents(spark)
    rows = S.simhash_components(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {0}
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    # Texts without words are one group, and so are the copies of "same text here"; a row that occurs twice is kept once.
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5, 6, 7, 8]
    for f in (S.simhash_components, S.near_dedup):
        assert f(empty_documents(spark)).count() == 0
    nulls = documents(spark, ["same words", "same words"], [None, None])
    assert S.near_dedup(nulls).count() == 1
    assert {r["component_id"] for r in S.simhash_components(nulls).collect()} == {None}


def test_large_buckets_are_cut_without_losing_links(spark):
    """Cutting every bucket by the bits that its table does not keep changes no component."""
    from kindred.llm.components import components
    from kindred.llm.shared import Scratch

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    scratch = Scratch(spark, "cut")
    whole, cut = ({tuple(r) for r in components(S.near_links(df, 2, scratch, most), scratch).collect()} for most in (50_000, 1))
    assert whole == cut and len(whole) > 100


def brute_groups(sets, similarity=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def near_groups(spark, docs):
    from kindred.llm.shared import Scratch

    rows = docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS mark", "text")
    named, roots = S.near_copies(rows, Scratch(spark, "groups"), 5, 0.8, 2)
    groups = {}
    for r in named.join(roots, "tid", "left").selectExpr("doc_id", "coalesce(root, tid) AS root").collect():
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_near_copies_among_strangers_that_share_a_template(spark):
    """Texts of one template, alike at 0.6 to 0.75, with pairs of near copies in between."""
    rng = random.Random(8)
    template = prose(rng, 160).split()
    texts = []
    for i in range(40):
        own = prose(rng, rng.randrange(22, 40)).split()
        texts.append(" ".join(template + own))
        if i % 3 == 0:
            texts.append(" ".join([*template, *own[:-2], "changed", "end"]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = documents(spark, [texts[i] for i in order])
    sets = [set(S.shingle_hashes(texts[i], 5).tolist()) for i in order]
    want = brute_groups(sets)
    assert len(want) >= 10
    assert near_groups(spark, docs) == want


def test_groups_of_the_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [set(S.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    want = {frozenset(rows[i]["doc_id"] for i in g) for g in brute_groups(sets)}
    assert near_groups(spark, docs) == want and len(want) > 20


def test_near_dedup_with_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "other words than those here now")], "doc_id string, text string")
    assert {r["doc_id"] for r in S.near_dedup(docs).collect()} == {"a", None}
