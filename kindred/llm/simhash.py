"""Near duplicates by SimHash, linked through covering locality-sensitive hashing.

Bit i of a fingerprint carries a nonzero vector f(i) of r + 1 bits.  Table t, one for each nonzero t of r + 1 bits, keeps the
bits with odd inner product <t, f(i)>.  The r vectors at which two fingerprints differ leave a nonzero t orthogonal to them
all, so the pair agrees on what that table keeps: every pair within radius r meets in some table.
Only distinct fingerprints are hashed, so copies never make pairs; a bucket returns a
spanning star of each of its linked groups, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .components import components
from .shared import Scratch, table, unused

BITS = 64
HEAVY = 1000  # a fingerprint is heavy if it holds this part of all rows
CELLS = 64  # cells over which a set's shingles are counted
BEFORE = ["before1", "before2", "before3"]  # a text's keys just before a key, 0 where there is none


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; fewer words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = 3, block: int = 1 << 16) -> int:
    """Signed 64-bit SimHash: a bit is set where more than half of the shingle hashes set it; no words give 0."""
    return _signs(shingle_hashes(text, width), block)


def _signs(hashes: np.ndarray, block: int = 1 << 16) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text, width: int = 3):
    """Column of signed fingerprints."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of(text)


def covering_masks(radius: int) -> list[int]:
    """Masks of the 2^(radius+1) - 1 tables, as signed longs; f(i) walks through all nonzero vectors in turn."""
    size = (1 << radius + 1) - 1
    masks = []
    for t in range(1, size + 1):
        bits = sum(1 << i for i in range(BITS) if ((i % size + 1) & t).bit_count() & 1)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over edges (a, b)."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, old):
            return root


def bucket_links(values: np.ndarray, radius: int, small: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """For one bucket of distinct fingerprints, ``(member, root)`` of all that is linked to a lower one.

    Small buckets compare all members at once.  Large ones look up each member with up to ``radius`` flipped
    bits, among those bits in which the bucket varies at all: work in proportion to the members.
    """
    v = np.sort(values.astype(np.int64).view(np.uint64))
    if len(v) <= small:
        a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius, 1))
        root = _roots(len(v), a, b)
    else:
        varies = int(np.bitwise_or.reduce(v ^ v[0]))
        flips, layer = [], [0]
        free = [1 << i for i in range(BITS) if varies >> i & 1]
        for _ in range(radius):
            layer = [f | g for f in layer for g in free if g > f]
            flips += layer
        root = np.arange(len(v))
        while True:
            old = root.copy()
            for f in flips:
                want = v ^ np.uint64(f)
                at = np.minimum(np.searchsorted(v, want), len(v) - 1)
                hit = np.flatnonzero(v[at] == want)
                root[hit] = np.minimum(root[hit], root[at[hit]])
            root = root[root]
            if np.array_equal(root, old):
                break
    linked = np.flatnonzero(root != np.arange(len(v)))
    return v[linked].view(np.int64), v[root[linked]].view(np.int64)


def _part_masks(kept: int, radius: int) -> list[int]:
    """The bits that a table does not keep, dealt to radius + 1 masks (signed longs): within a bucket, a pair within the radius agrees on one."""
    free = [i for i in range(BITS) if not kept >> i & 1]
    masks = [sum(1 << i for i in free[g :: radius + 1]) for g in range(radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(nodes: DataFrame, radius: int, scratch: Scratch, most: int = 50_000) -> DataFrame:
    """Links ``(u, v)`` that span what is within ``radius`` bits, directly or in a chain, among the distinct ``nodes(fp)``.

    A bucket of more than ``most`` fingerprints is cut once more, by each part of the bits that its table does not keep."""
    masks = covering_masks(radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)))
    dealt = nodes.select("fp", F.explode(keys).alias("b")).select("fp", "b.t", "b.k")
    large = scratch.table(dealt.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("t", "k"))
    by = ["t", "k"]
    if large.limit(1).count():
        part = lambda t: F.array(*(F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("s")) for g, m in enumerate(_part_masks(masks[t] % (1 << 64), radius))))
        parts = F.array(*map(part, range(len(masks))))
        whole = F.array(F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("s")))
        dealt = dealt.join(large.withColumn("cut", F.lit(True)), ["t", "k"], "left")
        dealt = dealt.select("fp", "t", "k", F.explode(F.when(F.col("cut"), parts[F.col("t")]).otherwise(whole)).alias("p")).select("fp", "t", "k", "p.g", "p.s")
        by += ["g", "s"]
    buckets = dealt.groupBy(*by).agg(F.collect_list("fp").alias("fps"))

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fps in batch["fps"]:
                member, root = bucket_links(np.asarray(fps), radius)
                if len(member):
                    yield pd.DataFrame({"u": member, "v": root})

    return buckets.filter(F.size("fps") > 1).select("fps").mapInPandas(links, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: texts whose fingerprints are linked, directly or in a
    chain, by ``radius`` or fewer differing bits share a component, named by its smallest doc_id.

    Null and empty texts have fingerprint 0 and are linked like any other.  A null doc_id keeps its row but never names a
    component (a component of nulls only is named null).  Repeated rows come back as often as they occur.  An empty
    table gives no rows.  Very long texts are read whole.  Ties, here equal fingerprints, are one node.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), width).alias("fp")))
    return _label(rows, radius, scratch)


def _label(rows: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(near_links(nodes.select("fp"), radius, scratch), scratch)
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    tops = nodes.join(roots.select("root").distinct(), F.col("fp") == F.col("root")).select("fp", "root", "least")
    members = linked.unionAll(tops)
    names = members.groupBy("root").agg(F.min("least").alias("name"))
    named = nodes.join(members.join(names, "root").select("fp", "name"), "fp", "left")
    named = scratch.table(named.select("fp", F.coalesce("name", "least").alias("component_id"), "n"))
    # Fingerprints that hold a thousandth of all rows or more, a thousand at most, are sent to the rows; the others meet them in a join.
    share = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HEAVY
    heavy = F.broadcast(named.filter(F.col("n") >= share).drop("n"))
    light = rows.join(heavy.select("fp"), "fp", "left_anti").join(named.filter(F.col("n") < share).drop("n"), "fp")
    return rows.join(heavy, "fp").unionByName(light).select("doc_id", "fp", "component_id")


# Near copies at a given similarity.  A fingerprint of the whole text moves by many bits when a twentieth of the words change, so
# the covering tables alone would miss such pairs; a prefix filter over the shingles, which misses none, finds them.


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, by_value: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of a text's n distinct shingles, those in ``common`` last and in its order.

    Any two sets at least as similar share a shingle of their prefixes, whatever the order is as long as it is the same for all:
    ``common`` (shingles by rising frequency, ``by_value`` its sorting order) only keeps passages that many texts hold out of the prefixes."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, np.int64)
    if len(common):
        by_value = np.argsort(common) if by_value is None else by_value
        at = np.minimum(np.searchsorted(common, shingles, sorter=by_value), len(common) - 1)
        rank = np.where(common[by_value[at]] == shingles, by_value[at] + 1, 0)
    return shingles[np.lexsort((shingles, rank))][: n - math.ceil(similarity * n - 1e-9) + 1]


def may_be_similar(n: np.ndarray, at: np.ndarray, n2, at2, similarity: float) -> np.ndarray:
    """False where sets of n and n2 shingles, whose first shared one is the at-th and the at2-th (from 0), cannot be similar enough."""
    return (np.minimum(n, n2) >= similarity * np.maximum(n, n2) - 1e-6) & (np.minimum(n - at, n2 - at2) >= similarity / (1 + similarity) * (n + n2) - 1e-6)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (the finaliser of murmur3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _text_id(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a text, from its shingles in order."""
    sequence = xxhash.xxh3_64_intdigest(hashes.tobytes(), len(hashes))
    return sequence - (1 << 64) if sequence >> 63 else sequence


def similar(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Jaccard similarity of two shingle sets from their ``size`` least hashes, sorted: exact where neither set has more."""
    both = np.union1d(a, b)
    if len(a) >= size or len(b) >= size:
        both = both[:size]
    return np.isin(both, np.intersect1d(a, b)).sum() / len(both) if len(both) else 1.0


def cell_counts(shingles: np.ndarray) -> bytes:
    """Number of a set's shingles in each of ``CELLS`` cells of the hash space, none where a cell has over 255.  Two sets cannot share more in a cell than the
    lesser count: an exact bound on what they share at all."""
    counts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _counts(cells) -> np.ndarray:
    """Cell counts as rows of numbers, without a bound where there are none."""
    return np.stack([np.frombuffer(c, np.uint8).astype(np.int32) if c else np.full(CELLS, 1 << 24, np.int32) for c in cells])


def _unlinked(similarity: float, most: int):
    """Pairs ``(u, v)`` of each group's members ``tid`` whose ``root`` differs and that may be similar, one member at a time: for each the ``most`` with the
    highest bound on what they share, and one row without a pair for those left out (``cut``).  Two members with an equal key in ``before`` are a pair of
    that earlier key, not of this one."""
    need = similarity / (1 + similarity)
    names = ["tid", "root", "n", "at", *BEFORE]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cells, *numbers in zip(batch["cells"], *(batch[c] for c in names), strict=True):
                order = np.argsort(np.asarray(numbers[0], np.int64))
                tid, root, n, at, *before = (np.asarray(c, np.int64)[order] for c in numbers)
                counts = _counts(cells[i] for i in order)
                us, vs, cut = [], [], 0
                for i in range(len(tid) - 1):
                    new = (root[i + 1 :] != root[i]) & may_be_similar(n[i + 1 :], at[i + 1 :], n[i], at[i], similarity)
                    for key in {int(b[i]) for b in before} - {0}:
                        for b in before:
                            new &= b[i + 1 :] != key
                    other = i + 1 + np.flatnonzero(new)
                    if len(other):
                        bound = np.minimum(counts[other], counts[i]).sum(axis=1) / (n[other] + n[i])
                        fine = bound >= need - 1e-9
                        other = other[fine][np.argsort(-bound[fine], kind="stable")]
                        cut += max(0, len(other) - most)
                        us.append(np.full(min(most, len(other)), tid[i]))
                        vs.append(tid[other[:most]])
                if us:
                    last = np.zeros(int(cut > 0), np.int64)  # the row for those left out pairs nothing
                    u, v = np.concatenate([*us, last]), np.concatenate([*vs, last])
                    yield pd.DataFrame({"u": u, "v": v, "cut": np.append(np.zeros(len(u) - len(last), np.int64), last + cut)})

    return pairs


DESCRIBED = "mark long, tid long, fp long, n int, keys array<long>, cells binary"


def _may_be_similar(n: Column, at: Column, n2: Column, at2: Column, similarity: float) -> Column:
    """``may_be_similar`` as an expression."""
    sizes = F.least(n, n2) >= F.greatest(n, n2) * F.lit(similarity) - F.lit(1e-6)
    return sizes & (F.least(n - at, n2 - at2) >= (n + n2) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))


def _common_shingles(rows: DataFrame, width: int, sample: int = 20_000, most: int = 100_000) -> np.ndarray:
    """Up to ``most`` shingles that three or more of about ``sample`` texts hold, by rising frequency.  They only order the
    prefixes: the sample decides how many candidates there are, never which pairs are found."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 200):
                sets = [np.unique(shingle_hashes(text, width)) for text in batch["text"][start : start + 200]]
                yield pd.DataFrame({"s": np.concatenate(sets).view(np.int64)})

    every = max(1, rows.count() // sample)
    picked = rows.filter(F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(every)) == 0).select("text")
    counts = picked.mapInPandas(shingles, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 2")
    best = counts.orderBy(F.desc("n"), "s").limit(most).toPandas()["s"].to_numpy(np.int64)
    return best[::-1].copy().view(np.uint64)


def near_copies(rows: DataFrame, scratch: Scratch, width: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, tid)`` for every row of ``rows(doc_id, mark, text)``, ``tid`` naming its text, and ``(tid, root)`` for the
    texts that are linked to another; ``root`` names the group."""

    id_type = rows.schema["doc_id"].dataType

    def frame(out: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(out, columns=["doc_id", "mark", "tid", "fp", "n", "keys", "cells"])
        return out.astype({"doc_id": "Int64" if isinstance(id_type, IntegralType) else object})

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, by_value = [], np.argsort(common)
            for doc_id, mark, text in zip(batch["doc_id"], batch["mark"], batch["text"], strict=True):
                hashes = shingle_hashes(text, width)
                single = np.unique(hashes)
                out.append((doc_id, mark, _text_id(hashes), _signs(hashes), len(single), prefix(single, similarity, common, by_value).view(np.int64), cell_counts(single)))
                if len(out) == 1000:  # a row is up to some kilobytes
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    given = rows
    common = _common_shingles(given, width)
    rows = scratch.table(given.mapInPandas(describe, f"doc_id {id_type.simpleString()}, {DESCRIBED}"))
    # Copies of a text are summed up here, once; from here on a text is one row however many copies it has.
    one = F.min_by(F.struct("fp", "n", "keys", "cells"), "mark")
    texts = rows.groupBy("tid").agg(F.min("mark").alias("mark"), one.alias("x"))
    keyed = scratch.table(texts.select("tid", "mark", "x.fp", "x.n", "x.keys", "x.cells"))
    # The keys are by far the largest part: they are deleted once they are dealt.
    named = scratch.table(rows.select("doc_id", "mark", "tid"))
    scratch.remove(rows)
    texts = scratch.table(keyed.drop("keys"))

    def whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 200):  # a set may be as long as its text
                part = batch.iloc[start : start + 200]
                found = [(tid, h) for tid, h in zip(part["tid"], (shingle_hashes(x, width) for x in part["text"]), strict=True) if _text_id(h) == tid]
                yield pd.DataFrame({"tid": [t for t, _ in found], "set": [np.unique(h).astype("<u8").tobytes() for _, h in found]}).astype({"tid": "int64"})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = ((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for a, b in zip(batch["a"], batch["b"], strict=True))
            fine = [similar(a, b, len(a) + len(b) + 1) >= similarity for a, b in sets]
            yield batch.loc[fine, ["u", "v"]]

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                shared_most = np.minimum(_counts(batch["a"]), _counts(batch["b"])).sum(axis=1)
                yield batch.loc[shared_most >= similarity / (1 + similarity) * (batch["n"] + batch["n2"]).to_numpy() - 1e-9, ["u", "v"]]

    def bounded(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(u, v)`` whose cell counts allow the similarity: whole sets are read for these only."""
        u = texts.select(F.col("tid").alias("u"), "n", F.col("cells").alias("a"))
        v = texts.select(F.col("tid").alias("v"), F.col("n").alias("n2"), F.col("cells").alias("b"))
        return pairs.join(u, "u").join(v, "v").mapInPandas(fits, "u long, v long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(u, v)`` that are similar, by the whole shingle sets.  Only texts in a pair are read again."""
        asked = pairs.select(F.col("u").alias("tid")).unionAll(pairs.select(F.col("v").alias("tid"))).distinct()
        marks = texts.select("tid", "mark").join(asked, "tid")
        sets = scratch.table(given.select("mark", "text").join(marks, "mark").select("tid", "text").mapInPandas(whole_sets, "tid long, set binary").dropDuplicates(["tid"]))
        both = pairs.join(sets.select(F.col("tid").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("tid").alias("v"), F.col("set").alias("b")), "v")
        links = scratch.table(both.mapInPandas(verify, "u long, v long"))
        scratch.remove(sets)
        return links

    # First, texts that share a shingle of their prefixes are paired with the least and the greatest of those that do.  The rows are
    # dealt by key once, for both the ends and the pairs; few keys occur twice.
    member = keyed.select("tid", "n", F.posexplode("keys").alias("at", "key")).repartition("key")
    end = F.struct("tid", "n", "at")
    ends = member.groupBy("key").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).filter("low < high")
    shared = scratch.table(member.join(ends, "key"))
    scratch.remove(keyed)
    ends = shared.filter("tid = low OR tid = high").select("key", end.alias("end"))
    pairs = shared.join(ends, "key").filter(F.expr("end.tid <> tid") & _may_be_similar(F.col("n"), F.col("at"), F.col("end.n"), F.col("end.at"), similarity))
    pairs = pairs.select(F.col("tid").alias("v"), F.col("end.tid").alias("u"))
    # The covering tables add every pair of fingerprints within the radius, by way of one text each.
    of_fp = texts.groupBy("fp").agg(F.min("tid").alias("least"))
    near = near_links(of_fp.select("fp"), radius, scratch)
    at = lambda name: of_fp.select(F.col("fp").alias(name), F.col("least").alias(f"{name}_text"))
    linked = near.join(at("u"), "u").join(at("v"), "v").select(F.col("u_text").alias("u"), F.col("v_text").alias("v"))
    same = texts.join(of_fp, "fp").select(F.col("least").alias("u"), F.col("tid").alias("v"))
    pairs = pairs.unionByName(linked).unionByName(same).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = scratch.table(pairs)
    near = scratch.table(bounded(pairs))
    links = verified(near)
    scratch.remove(near)

    # Then every other pair of a shingle is, unless links found so far connect it already: first the most promising few of each member, so that
    # groups that are alike grow together before their pairs are many, then more, until no pair is left out.
    roots, tried, most = scratch.table(components(links, scratch).withColumnRenamed("node", "tid")), pairs, 4
    split = shared.join(roots, "tid", "left").groupBy("key").agg(F.countDistinct(F.coalesce("root", "tid")).alias("n"), F.count("*").alias("size")).filter("n > 1 AND size > 2")
    # Texts that share a passage share many shingles.  A pair is one of the first shingle it shares only, so a shingle that follows the same one in every text
    # that holds it has no pairs of its own.
    in_text = Window.partitionBy("tid").orderBy("at")
    before = [F.coalesce(F.lag("key", k + 1).over(in_text), F.lit(0).cast("long")).alias(b) for k, b in enumerate(BEFORE)]
    dealt = scratch.table(shared.select("key", "tid", "n", "at").join(split.select("key"), "key").select("key", "tid", "n", "at", *before))
    first = dealt.groupBy("key").agg(F.min(BEFORE[0]).alias("a"), F.max(BEFORE[0]).alias("b")).filter("a < b OR a = 0").select("key")
    held = dealt.join(first, "key").join(texts.select("tid", "cells"), "tid")
    held = scratch.table(held.select("key", "tid", "n", "at", *BEFORE, "cells"))
    scratch.remove(dealt)
    columns = ("tid", "root", "n", "at", *BEFORE, "cells")
    member = F.struct(*columns)
    while True:
        now = held.join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
        groups = now.groupBy("key").agg(F.collect_list(member).alias("all"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
        groups = groups.select(*(F.col(f"all.{c}").alias(c) for c in columns))
        found = scratch.table(groups.mapInPandas(_unlinked(similarity, most), "u long, v long, cut long"))
        cut = found.agg(F.sum("cut")).first()[0]
        rest = scratch.table(found.filter("u <> v").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"))
        links = scratch.table(links.unionAll(verified(rest)))
        scratch.remove(found)
        roots = scratch.table(components(links, scratch).withColumnRenamed("node", "tid"))
        if not cut:
            break
        tried, most = tried.unionAll(rest), 16 * most
    scratch.remove(texts, shared, held, pairs, rest, links)
    return named, roots


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 2,
) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were.

    Two texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more (of the
    whole sets); groups are what links reach.  Candidates are pairs within
    ``radius`` bits of each other's SimHash and all pairs that a prefix filter over the shingles leaves; it leaves every pair of the
    least similarity or more.

    Of each group stays the row of the smallest id (nulls last), then of the smallest checksum of all columns; of rows equal in
    every column one stays.  Ids may be of any type that compares; very long texts are compared whole.  Texts without words (null, empty, white space) are copies of each other.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    every = F.xxhash64(*hashed)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), every.alias("mark"), F.col(f"`{text_col}`").alias("text"))
    named, roots = near_copies(rows, scratch, width, similarity, radius)
    # A row is known by its id and checksum; rows equal in both are counted.  Copies of a text are summed up before groups are joined.
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")
    texts = named.groupBy("tid").agg(F.min(order).alias("first"), F.count("*").alias("size"))
    kept = texts.join(roots, "tid", "left").groupBy(F.coalesce("root", "tid").alias("root")).agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    kept = kept.select("first.doc_id", "first.mark", "size")
    names = {c: unused(docs, c) for c in ("key", "mark", "size")}
    kept = kept.select(F.col("doc_id").alias(names["key"]), F.col("mark").alias(names["mark"]), F.col("size").alias(names["size"]))
    found = docs.withColumn(names["mark"], every).join(kept, names["mark"])
    found = found.filter(F.col(f"`{id_col}`").eqNullSafe(F.col(names["key"])))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = found.filter(F.col(names["size"]) == 1).select(*columns)
    return alone.unionAll(found.filter(F.col(names["size"]) > 1).select(*columns).dropDuplicates())


def op8_simhash_covering(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_covering": op8_simhash_covering}
