"""Line deduplication by probing a sharded minimal perfect hash.

Line keys are 128-bit hashes: one half addresses, the other is the stored fingerprint.  Keys found under at
least two ids are dealt to shards; each shard builds a minimal perfect hash over its keys with flat arrays of fingerprints, counts and
first ids.  Documents are dealt to chunks of bounded size; each chunk sends each of its distinct keys once to the key's shard, which
probes its arrays and answers only for the keys it knows.  So a line found in a third of all documents
costs one probe a chunk, and no line is ever joined with a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table, utf8_bytes

MIN_POINTS = 10
LAST = np.iinfo(np.int64).max  # stands for a null id: it is never the smallest


def line_keys(text: str | None, min_points: int = MIN_POINTS) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text (null: one empty line) and the 16-byte hash of each line's key, None where the key is too short."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()
        # Only long keys count; a key of ASCII bytes has as many code points as bytes.
        long_enough = len(key) >= min_points and (key.isascii() or len(key.decode("utf-8")) >= min_points)
        keys.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return lines, keys


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of each key for each level (the finaliser of splitmix64)."""
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level the keys that fall alone on a slot of a bit array
    take it, the others go on to the next level; a key's index is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = sizes, bits
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        self.starts = np.cumsum([0, *sizes])
        self.taken = flat
        self.rank = np.cumsum(flat) - 1

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, parts, left, level = [], [], keys, 0
        while len(left):
            n = max(8, int(gamma * len(left)))
            slot = (_mix(left, level) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(slot, minlength=n) == 1
            sizes.append(n)
            parts.append(alone)
            left, level = left[~alone[slot]], level + 1
        return cls(sizes, np.packbits(np.concatenate([*parts, np.empty(0, bool)]), bitorder="little").tobytes())

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key that was not built in, any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, n in enumerate(self.sizes):
            at = self.starts[level] + (_mix(keys[open_], level) % np.uint64(n)).astype(np.int64)
            hit = self.taken[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One row with the arrays of a shard.  Keys equal in the addressing half share a slot's worth of it: the first is
    indexed, the rest are listed apart, so that the index stays exact."""
    rows = rows.sort_values(["h", "fp"])
    twin = rows["h"].duplicated().to_numpy()
    own, rest = rows[~twin], rows[twin]
    h = own["h"].to_numpy(np.int64)
    mph = PerfectHash.build(h)
    at = mph.lookup(h)
    order = np.empty(len(h), np.int64)
    order[at] = np.arange(len(h))
    array = lambda column: own[column].to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame(
        {
            "shard": [rows["shard"].iloc[0]],
            "sizes": [np.array(mph.sizes, np.int64).tobytes()],
            "bits": [mph.bits],
            "fps": [array("fp")],
            "counts": [array("n")],
            "firsts": [array("first")],
            "twins": [rest[["h", "fp", "n", "first"]].to_numpy(np.int64).tobytes()],
        }
    )


INDEX_SCHEMA = "shard long, sizes binary, bits binary, fps binary, counts binary, firsts binary, twins binary"


def _probe_shard(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """The probes that the shard's index knows, with the first id and the count of their key."""
    none = pd.DataFrame({"chunk": np.empty(0, np.int64), "h": np.empty(0, np.int64), "fp": np.empty(0, np.int64), "first": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
    if index.empty or probes.empty:
        return none
    r = index.iloc[0]
    longs = lambda name: np.frombuffer(r[name], np.int64)
    mph = PerfectHash(longs("sizes").tolist(), r["bits"])
    fps, counts, firsts, twins = longs("fps"), longs("counts"), longs("firsts"), longs("twins").reshape(-1, 4)
    h, fp = probes["h"].to_numpy(np.int64), probes["fp"].to_numpy(np.int64)
    at = mph.lookup(h)
    known = (at >= 0) & (fps[at] == fp)
    out = [pd.DataFrame({"chunk": probes["chunk"].to_numpy(np.int64)[known], "h": h[known], "fp": fp[known], "first": firsts[at[known]], "n": counts[at[known]]})]
    if len(twins):
        out.append(probes[["chunk", "h", "fp"]].merge(pd.DataFrame(twins, columns=["h", "fp", "n", "first"]), on=["h", "fp"])[list(none.columns)])
    return pd.concat(out, ignore_index=True)


def _drop_lines(docs: pd.DataFrame, drops: pd.DataFrame, min_points: int, keep_text: bool) -> pd.DataFrame:
    first = {h.tobytes(): f for h, f in zip(drops[["h", "fp"]].to_numpy(np.int64), drops["first"], strict=True)}
    out = []
    for known, doc_id, text in zip(docs["known"], docs["doc_id"], docs["text"], strict=True):
        lines, keys = line_keys(text, min_points)
        kept = [x for x, k in zip(lines, keys, strict=True) if k is None or first.get(k, doc_id) == doc_id]
        whole = b"\n".join(kept)
        out.append((doc_id if known else None, len(lines), len(lines) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8") if keep_text else None))
    frame = pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])
    return frame.astype({"doc_id": "Int64", "n_lines": "int64", "n_dropped": "int64"})


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_points: int = MIN_POINTS,
    keep_text: bool = True,
    chunk_bytes: int = 24 << 20,
    keys_per_shard: int = 400_000,
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256, kept)`` for every row.

    A line whose key (ASCII white space stripped at both ends, A-Z lower-cased) has ``min_points`` code points or more and
    is found under two or more ids is kept under the smallest of them and dropped elsewhere.  Null and empty texts are one
    empty line.  A null id counts as one id that comes after all others.  Rows that repeat an id are one document for this
    purpose: none loses lines to the other.  An empty table gives no rows.  Other columns are ignored.  ``kept`` is
    null unless ``keep_text``.

    ``chunk_bytes`` bounds the text that one task holds at once (a single longer text is held whole) and
    ``keys_per_shard`` the keys that one probe does; neither changes results.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc_id"), F.col(id_col).isNotNull().alias("known"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(utf8_bytes(F.col("text")))).first()[0] or 0
    n_chunks = max(1, -(-int(total) // chunk_bytes))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, ids, chunks = [], [], []
            for doc_id, text, chunk in zip(batch["doc_id"], batch["text"], batch["chunk"], strict=True):
                found = {k for k in line_keys(text, min_points)[1] if k is not None}
                digests.extend(found)
                ids.append(np.full(len(found), doc_id))
                chunks.append(np.full(len(found), chunk))
            if digests:
                half = _halves(digests)
                yield pd.DataFrame({"chunk": np.concatenate(chunks), "h": half[:, 0], "fp": half[:, 1], "doc_id": np.concatenate(ids)})

    # One row for each chunk and key; it is both the probe and a part of the key's count.
    lines = docs.mapInPandas(keys, "chunk long, h long, fp long, doc_id long")
    probes = scratch.table(lines.groupBy("chunk", "h", "fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    n_shards = max(1, -(-probes.count() // keys_per_shard))
    shard = F.pmod(F.col("h"), F.lit(n_shards)).alias("shard")
    shared_keys = probes.groupBy("h", "fp").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last")
    index = scratch.table(shared_keys.select(shard, "h", "fp", "n", "first").groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA))
    asked = probes.select(shard, "chunk", "h", "fp")
    drops = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_probe_shard, "chunk long, h long, fp long, first long, n long")
    drops = scratch.table(drops)
    scratch.remove(probes, index)
    return (
        docs.groupBy("chunk")
        .cogroup(drops.groupBy("chunk"))
        .applyInPandas(lambda d, x: _drop_lines(d, x, min_points, keep_text), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")
    )


def op9_line_dedup(spark, sf_dir):
    return drop_repeated_lines(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


ORACLE_SQL = {
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
              GROUP BY key HAVING min(doc_id) < max(doc_id)),
        m AS (SELECT k.*, c.first IS NOT NULL AND c.first <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id"""
}

QUERIES = {"op9_line_dedup": op9_line_dedup}
