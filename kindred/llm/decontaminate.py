"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as lower-case letters and digits with single spaces between words.  If a passage is within k
edits of an item of m characters, the two share at least m - q + 1 - k*q q-grams, all of them on diagonals (position in the text less
position in the item) at most k apart.  So hits are counted in diagonal bands that overlap by half and
are twice as wide as k: some band holds all hits of such a passage.  Bands below the bound are dropped; the region of every other
band must also hold enough of the item's 3-grams, by the same lemma, and is then verified by an alignment confined to the band, many bands at once.

Where items share much text, a text may have a great many hits: they are counted piece by piece, at most ``HITS`` at a time, so that memory does
not depend on them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import Scratch, table, unused

Q = 8
RATE = 0.08  # edits allowed for each character of an item
RUN = re.compile(r"[\W_]+")
HITS = 1 << 16  # hits that are expanded and sorted at once
BATCH = 4096  # bands that are aligned at once
CELLS = 2048  # hash cells of 3-grams


def normal(text: str | None) -> str:
    return RUN.sub(" ", (text or "").lower()).strip()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q-gram at each position."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = points.astype(np.uint64) + np.uint64(1)
    out, width = x, 1  # hash of the 1-gram, then 2, 4, 8: h(ab) = h(a) * c + h(b)
    factor = 0x9E3779B97F4A7C15
    while width < q:
        step = min(width, q - width)
        out = out[: len(out) - step] * np.uint64(factor) + out[step:]
        width += step
        factor = factor * factor + 2 & 0xFFFFFFFFFFFFFFFF | 1
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def align(item: np.ndarray, text: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Least edits between the item and any stretch of the text whose path stays on diagonals low..high, as (edits,
    start, end); None if that is more than k.  Cells lie on (item position, diagonal)."""
    diagonals = np.arange(low, high + 1)
    far = k + 1
    steps = np.arange(len(diagonals))
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    begin = diagonals.copy()
    for i, c in enumerate(item):
        at = diagonals + i  # a diagonal step reads text[at]
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(at), bool)
        same[inside] = text[at[inside]] == c
        match = np.where(inside, cost + ~same, far)
        skip = np.append(cost[1:], far) + 1  # the item's character has no partner: from the next diagonal
        new = np.minimum(match, skip)
        start = np.where(match <= skip, begin, np.append(begin[1:], 0))
        # Characters of the text without partner move to higher diagonals, at one edit each.
        reach = np.where((at + 1 >= 0) & (at + 1 <= len(text)), new, far) - steps
        best = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == best, steps, 0))
        cost, begin = np.minimum(best + steps, far), start[source]
        if cost.min() >= far:
            return None
    b = int(np.argmin(cost))
    return (int(cost[b]), int(begin[b]), int(diagonals[b] + len(item))) if cost[b] <= k else None


def align_many(items: np.ndarray, text: np.ndarray, bases: np.ndarray, pasts: np.ndarray, lows: np.ndarray, k: int, width: int) -> list[tuple[int, int, int] | None]:
    """``align`` for each row of ``items`` (all of one length) against ``text[base:past]``, on the ``width`` diagonals from ``low``; starts and ends
    count from ``base``.  Rows that are beyond the budget are put aside as they are found."""
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    far, steps = k + 1, np.arange(width)
    who = np.arange(len(items))
    diagonals = lows[:, None] + steps
    size = (pasts - bases)[:, None]
    cost = np.where((diagonals >= 0) & (diagonals <= size), 0, far)
    begin = diagonals.copy()
    limit = max(0, len(text) - 1)
    for i in range(items.shape[1]):
        at = diagonals + i
        inside = (at >= 0) & (at < size)
        same = text[np.clip(at + bases[:, None], 0, limit)] == items[:, i, None]
        match = np.where(inside, cost + ~same, far)
        skip = np.concatenate([cost[:, 1:], np.full((len(cost), 1), far)], axis=1) + 1
        new = np.minimum(match, skip)
        start = np.where(match <= skip, begin, np.concatenate([begin[:, 1:], np.zeros((len(begin), 1), begin.dtype)], axis=1))
        reach = np.where((at + 1 >= 0) & (at + 1 <= size), new, far) - steps
        best = np.minimum.accumulate(reach, axis=1)
        source = np.maximum.accumulate(np.where(reach == best, steps, 0), axis=1)
        cost, begin = np.minimum(best + steps, far), np.take_along_axis(start, source, axis=1)
        if i % 4 == 3 or i == items.shape[1] - 1:
            alive = cost.min(axis=1) < far
            if not alive.all():
                who, items, bases, size, diagonals, cost, begin = (x[alive] for x in (who, items, bases, size, diagonals, cost, begin))
                if not len(who):
                    return out
    b = cost.argmin(axis=1)
    rows = np.arange(len(who))
    for w, e, x, d in zip(who.tolist(), cost[rows, b].tolist(), begin[rows, b].tolist(), diagonals[rows, b].tolist(), strict=True):
        out[w] = (e, x, d + items.shape[1])
    return out


def _cells(points: np.ndarray) -> np.ndarray:
    """Hash cell of the 3-gram at each position."""
    if len(points) < 3:
        return np.empty(0, np.int64)
    x = points.astype(np.uint64)
    mixed = ((x[:-2] * np.uint64(0x9E3779B1) + x[1:-1]) * np.uint64(0x85EBCA77) + x[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - 11)).astype(np.int64)


@dataclass
class ItemIndex:
    """q-gram index of a bounded set of items."""

    ids: list
    texts: list[str]
    points: list[np.ndarray]
    k: np.ndarray
    least: np.ndarray
    width: np.ndarray
    keys: np.ndarray  # distinct q-grams, sorted
    starts: np.ndarray  # of each q-gram's postings
    item: np.ndarray
    pos: np.ndarray
    filter: np.ndarray
    lap: int
    cells: list[np.ndarray]
    short: dict[str, list]  # items of fewer than q characters, found as whole words only

    BITS = 22

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], q: int = Q, rate: float = RATE) -> ItemIndex:
        texts, short = [], {}
        for i, t in items:
            if len(p := normal(t)) >= q:
                texts.append((i, p))
            elif p:
                short.setdefault(p, []).append(i)
        pairs = [(i, _points(p)) for i, p in texts]
        lengths = np.array([len(p) for _, p in pairs], np.int64)
        # The budget is lowered for short items until the lemma asks for one shared q-gram at least.
        k = np.maximum(0, np.minimum((lengths * rate).astype(np.int64), (lengths - q) // q))
        grams = [qgrams(p, q) for _, p in pairs]
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(pairs)), [len(g) for g in grams])
        pos = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        keys, starts = np.unique(every[order], return_index=True)
        sieve = np.zeros(1 << cls.BITS, bool)
        sieve[(keys >> np.uint64(64 - cls.BITS)).astype(np.int64)] = True
        return cls([i for i, _ in texts], [p for _, p in texts], [p for _, p in pairs], k, lengths - q + 1 - k * q, np.maximum(k, 1), keys, np.append(starts, len(every)), item[order], pos[order], sieve, int((lengths + 4 * k).max(initial=0)) + 2 * q, [_cells(p) for _, p in pairs], short)

    def regions(self, points: np.ndarray, q: int = Q, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items and bands that reach the lemma's bound, in batches.  Long texts are taken in pieces that overlap by more than
        the longest item and its budget, so that no band's passage is cut everywhere; a band may come once from each of two pieces."""
        if not self.ids or not len(self.keys):
            return
        for at in range(0, max(1, len(points) - q + 1), piece):
            grams = qgrams(points[at : at + piece + self.lap], q)
            here = np.flatnonzero(self.filter[(grams >> np.uint64(64 - self.BITS)).astype(np.int64)])
            if not len(here):
                continue
            slot = np.minimum(np.searchsorted(self.keys, grams[here]), len(self.keys) - 1)
            known = self.keys[slot] == grams[here]
            if known.any():
                yield from self._bands(here[known] + at, slot[known])

    def _expanded(self, here: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, position in the item and position in the text of every hit."""
        n = self.starts[slot + 1] - self.starts[slot]
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[slot], n)
        return self.item[which], self.pos[which], np.repeat(here, n)

    def _bands(self, here: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = self.starts[slot + 1] - self.starts[slot]
        if n.sum() > HITS:
            if here[-1] - here[0] > 6 * self.lap:
                middle = (here[0] + here[-1]) // 2
                left, right = here < middle + self.lap, here >= middle
                yield from self._bands(here[left], slot[left])
                yield from self._bands(here[right], slot[right])
            else:
                yield from self._dense_bands(here, slot)
            return
        item, pos, begin = self._expanded(here, slot)
        # All bands of an item together must reach its bound before any is looked at.
        enough = (np.bincount(item, minlength=len(self.ids)) >= self.least)[item]
        if not enough.any():
            return
        item, pos, begin = item[enough], pos[enough], begin[enough]
        band = (begin - pos) // self.width[item]
        # A hit counts in its band and the one below: bands are two widths wide and overlap by half.  An item's q-gram counts once.
        floor, span, longest = int(band.min()) - 1, int(band.max() - band.min()) + 2, int(pos.max()) + 1
        cells = (item * span + band - floor) * longest + pos
        cells = np.unique(np.concatenate([cells, cells - longest]))
        cell, counts = np.unique(cells // longest, return_counts=True)
        cell = cell[counts >= self.least[cell // span]]
        if len(cell):
            yield cell // span, cell % span + floor

    def _dense_bands(self, here: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As above for a short stretch of text with very many hits: a matrix of bands by kinds of hit (q-gram and position in the item), times
        a matrix of kinds by items.  Hits that repeat an item's q-gram count each, so bands may be too many, never too few."""
        grams, of_hit = np.unique(slot, return_inverse=True)
        items, poses, which = self._expanded(np.arange(len(grams)), grams)
        longest = int(poses.max()) + 1
        for w in np.unique(self.width[items]).tolist():
            lowest = int(here[0] - longest) // w - 1
            span = int(here[-1]) // w - lowest + 2
            fine = self.width[items] == w
            kinds, kind = np.unique(which[fine] * longest + poses[fine], return_inverse=True)
            firsts = np.searchsorted(kinds // longest, np.arange(len(grams) + 1))
            n = np.diff(firsts)[of_hit]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts[of_hit], n)
            band = (np.repeat(here, n) - kinds[each] % longest) // w - lowest
            hits = np.bincount(band * len(kinds) + each, minlength=span * len(kinds)).reshape(span, len(kinds)).astype(np.float32)
            known, item = np.unique(items[fine], return_inverse=True)
            for first in range(0, len(known), part := max(1, (1 << 22) // max(len(kinds), span))):
                own = (item >= first) & (item < first + part)
                some = known[first : first + part]
                holds = np.zeros((len(kinds), len(some)), np.float32)
                holds[kind[own], item[own] - first] = 1
                counts = hits @ holds
                rows, cols = np.nonzero(counts[:-1] + counts[1:] >= self.least[some])
                if len(rows):
                    yield some[cols], rows + lowest

    def _plausible(self, item: np.ndarray, band: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """False for bands whose stretch of text, by its 3-grams' hash ``cells``, holds fewer of the item's 3-grams than the lemma asks for."""
        keep = np.ones(len(item), bool)
        lengths = np.array([len(p) for p in self.points], np.int64)
        for w in np.unique(self.width[item]).tolist():
            rows = np.flatnonzero(self.width[item] == w)
            rows = rows[np.argsort(band[rows], kind="stable")]
            longest, most = int(lengths[item[rows]].max()), int(self.k[item[rows]].max())
            bands, at = np.unique(band[rows], return_index=True)
            at = np.append(at, len(rows))
            for first in range(0, len(bands), 256):
                part = bands[first : first + 256]
                held = np.zeros((len(part), CELLS), np.float32)
                for j, b in enumerate(part.tolist()):
                    held[j, cells[max(0, b * w - most) : max(0, b * w + 2 * w + longest + most + 1)]] = 1
                mine = rows[at[first] : at[min(first + 256, len(bands))]]
                column = np.searchsorted(part, band[mine])
                for some in np.array_split(np.unique(item[mine]), max(1, -(-len(np.unique(item[mine])) // 2048))):
                    wanted = np.stack([np.bincount(self.cells[i], minlength=CELLS) for i in some.tolist()]).astype(np.float32)
                    shared = wanted @ held.T
                    own = np.isin(item[mine], some)
                    place = np.searchsorted(some, item[mine][own])
                    i = item[mine][own]
                    keep[mine[own]] = shared[place, column[own]] >= lengths[i] - 2 - 3 * self.k[i]
        return keep

    def _verified(self, text: str, points: np.ndarray, item: np.ndarray, band: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the bands that hold a passage."""
        lengths = np.array([len(self.points[i]) for i in item.tolist()], np.int64)
        w, k = self.width[item], self.k[item]
        low, high = band * w, band * w + 2 * w
        base, past = np.maximum(0, low - k), np.minimum(len(points), high + lengths + k + 1)
        fine = past > base
        for size, budget in sorted({(a, b) for a, b in zip(lengths[fine].tolist(), k[fine].tolist(), strict=True)}):
            rows = np.flatnonzero(fine & (lengths == size) & (k == budget))
            for at in range(0, len(rows), BATCH):
                some = rows[at : at + BATCH]
                whole = [text.find(self.texts[i], a, b) if len(some) < 256 else -1 for i, a, b in zip(item[some].tolist(), base[some].tolist(), past[some].tolist(), strict=True)]
                exact = np.array(whole) >= 0
                for i, x in zip(item[some][exact].tolist(), np.array(whole)[exact].tolist(), strict=True):
                    yield i, 0, x, x + size
                some = some[~exact]
                if len(some):
                    wide = np.stack([self.points[i] for i in item[some].tolist()])
                    lows = low[some] - base[some] - budget
                    hits = align_many(wide, points, base[some], past[some], lows, budget, int(2 * w[some[0]] + 2 * budget + 1))
                    for i, b, hit in zip(item[some].tolist(), base[some].tolist(), hits, strict=True):
                        if hit:
                            yield i, hit[0], hit[1] + b, hit[2] + b

    def _short_finds(self, text: str) -> Iterator[tuple[list, int, int]]:
        """Items of fewer than q characters where they stand as whole words."""
        most = max((x.count(" ") + 1 for x in self.short), default=0)
        spans = [m.span() for m in re.finditer(r"\S+", text)] if most else []
        for i in range(len(spans)):
            for j in range(i, min(i + most, len(spans))):
                x = text[spans[i][0] : spans[j][1]]
                if len(x) >= Q:
                    break
                if x in self.short:
                    yield self.short[x], spans[i][0], spans[j][1]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of every passage of a normalised text within an item's budget; of overlapping
        finds of one item the one with fewest edits, then the first."""
        points = _points(text)
        found: dict[int, set] = {}
        cells = None
        for item, band in self.regions(points):
            if len(item) > 32:
                cells = _cells(points) if cells is None else cells
                fine = self._plausible(item, band, cells)
                item, band = item[fine], band[fine]
            if len(item):
                for i, e, a, b in self._verified(text, points, item, band):
                    found.setdefault(i, set()).add((e, a, b))
        out = [(i, a, b, 0) for ids, a, b in self._short_finds(text) for i in ids]
        for item, hits in found.items():
            kept: list[tuple[int, int]] = []  # disjoint, in order
            for e, a, b in sorted(hits):
                at = bisect_left(kept, (a, b))
                if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                    kept.insert(at, (a, b))
                    out.append((self.ids[item], a, b, e))
        return sorted(out)


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of bounded size: one block for any usual benchmark; more where it is larger."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for b in range(n):
        yield [(r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()]


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)`` of every benchmark passage in the texts, one row a passage.

    ``start`` and ``end`` count characters of the normalised text (lower case, runs of anything but letters and digits turned into
    one space, trimmed).  A passage is within 8 edits for each 100 characters of the item, less for items under
    about 25 characters; items of fewer than 8 normalised characters are found as whole words, exactly.  Null and empty texts and items hold none;
    very long texts are searched whole, piece by piece.  Of finds of one item that overlap, the one with fewest edits counts, then the first.  Rows of
    documents with null ids are reported under null, repeated rows each on their own.  An empty table on either
    side gives no rows.  Other columns are ignored.  A benchmark over ``block_bytes`` is searched block by block.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, start long, end long, edits long"
    out = None
    for items in _item_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = ItemIndex.build(sent.value)
            for batch in batches:
                hits = [(d, *h) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if t for h in index.search(normal(t))]
                if hits:
                    frame = pd.DataFrame(hits, columns=["doc_id", "item_id", "start", "end", "edits"])
                    yield frame.astype({"doc_id": "Int64" if isinstance(id_type, IntegralType) else object})

        found = rows.mapInPandas(search, schema)
        out = found if out is None else out.unionAll(found)
    return out


def _leaks(sent: Broadcast):
    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = ItemIndex.build(sent.value)
        for texts in batches:
            yield pd.Series([bool(t) and bool(index.search(normal(t))) for t in texts], dtype="bool")

    return of


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Rows of ``docs`` without any benchmark passage, with all their columns as they were.

    Null and empty texts hold no passage and stay; very long texts are searched whole; repeated rows and ties stay or go alike; an empty benchmark drops nothing, an empty table gives no
    rows.  What a passage is, ``find_passages`` says."""
    mark = unused(docs, "leak")
    for items in _item_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.withColumn(mark, _leaks(sent)(F.col(text_col))).filter(~F.col(mark)).drop(mark)
    return docs


def op5_qgram_lemma(spark, sf_dir):
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_qgram_lemma": op5_qgram_lemma}
