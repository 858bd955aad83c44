"""Token counts by a separator scan over flat token files.

A flat file is nothing but token ids, one after the other, a document ending with the end-of-document id; there is no index.
Files are read as blocks of raw bytes.  Each block is searched for the id in one vectorised pass; what it knows is the number of its
ends, the tokens before its first end and after its last, and the lengths in between.  A prefix scan over these summaries then says
which document each block begins in and how many tokens of it earlier blocks hold, so documents that cross block
borders, or cover many blocks, get their whole count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern published with this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SUMMARY = "file string, block long, n_ends long, n_tokens long, head long, tail long, lengths array<long>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def scan_block(ids: np.ndarray, eod: int) -> tuple[int, int, int, int, np.ndarray]:
    """(ends, tokens without ends, tokens before the first end, after the last, lengths in between); a block without an
    end is all head and all tail."""
    ends = np.flatnonzero(ids == eod)
    if not len(ends):
        return 0, len(ids), len(ids), len(ids), ends
    return len(ends), len(ids) - len(ends), int(ends[0]), int(len(ids) - 1 - ends[-1]), np.diff(ends) - 1


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = 4 << 20) -> DataFrame:
    """``(file, block, ids)`` of the flat files under ``path``; ``block_bytes`` must be a multiple of the id's size.  Each file is
    read by one task: flat files are written as shards of at most 2 GB, the most that one row can hold."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for b, at in enumerate(range(0, len(content), block_bytes)):
                    yield pd.DataFrame({"file": [name], "block": [b], "ids": [content[at : at + block_bytes]]})

    spark_files = spark.read.format("binaryFile").load(path).select("path", "content")
    return spark_files.mapInPandas(cut, "file string, block long, ids binary")


def separator_scan(blocks: DataFrame, eod: int, dtype: str = "<u2", scratch: Scratch | None = None) -> DataFrame:
    """``(file, ordinal, n_tokens)`` of every document in flat token files given as ``(file, block, ids)``.

    Documents are numbered from 0 within their file, in file order.  Two ends in a row make a document of 0 tokens.  Tokens after
    a file's last end are a last, unfinished document; a file that ends with the end id has none.  Empty and null blocks
    count nothing; a file without tokens has no documents.
    """
    scratch = scratch or Scratch(blocks.sparkSession, "separators")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, block, raw in zip(batch["file"], batch["block"], batch["ids"], strict=True):
                out.append((file, block, *scan_block(np.frombuffer(raw or b"", dtype), eod)))
            yield pd.DataFrame(out, columns=["file", "block", "n_ends", "n_tokens", "head", "tail", "lengths"])

    found = scratch.table(blocks.select("file", "block", "ids").mapInPandas(scan, SUMMARY))
    # Prefix scan: ordinals are a running sum of ends; the tokens carried into a block are a running sum that starts
    # anew after each block with an end.  Only a few numbers a block take part.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = found.select("file", "block", "n_ends", "head", "tail")
    marks = marks.withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    marks = marks.withColumn("run", F.coalesce(F.sum(F.when(F.col("n_ends") > 0, 1)).over(before), F.lit(0)))
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # In a run all blocks but the last have no end; the tail before the run comes from the block that closed the run before.
    marks = marks.withColumn("inside", F.coalesce(F.sum("head").over(within), F.lit(0)))
    closing = marks.filter("n_ends > 0").select("file", (F.col("run") + 1).alias("run"), F.col("tail").alias("open"))
    marks = scratch.table(marks.join(closing, ["file", "run"], "left").withColumn("carry", F.col("inside") + F.coalesce("open", F.lit(0))))
    firsts = marks.filter("n_ends > 0").select("file", F.col("first").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"))
    inner = found.filter(F.size("lengths") > 0).select("file", "block", F.posexplode("lengths").alias("i", "n_tokens"))
    inner = inner.join(marks.select("file", "block", "first"), ["file", "block"]).select("file", (F.col("first") + 1 + F.col("i")).alias("ordinal"), "n_tokens")
    rest = marks.groupBy("file").agg(
        F.sum("n_ends").alias("ordinal"),
        F.max_by(F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head")), "block").alias("n_tokens"),
    )
    return firsts.unionAll(inner).unionAll(rest.filter("n_tokens > 0"))


def write_flat(docs: DataFrame, scratch: Scratch, ranks: dict[bytes, int], eod: int, id_col: str, text_col: str, block_ids: int) -> tuple[DataFrame, DataFrame]:
    """Tokenised documents as flat token blocks ``(file, block, ids)``, one file for each input partition, and the order of their
    ids ``(file, start, doc_ids)``; both written to the shared folder.  The first table has rows of block -1 as well, which hold
    no tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # the size of a vocabulary, whatever the corpus

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import TaskContext

        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        file = f"{TaskContext.get().partitionId():08d}"
        buffer, held, block, start = [], 0, 0, 0

        def row(block, ids, start, order):
            return pd.DataFrame({"file": [file], "block": [block], "ids": [ids], "start": [start], "doc_ids": [order]})

        for batch in batches:
            yield row(-1, b"", start, list(batch["doc_id"]))
            start += len(batch)
            for text in batch["text"]:
                ids = np.empty(0, "<u2")
                if text:
                    # A text of many megabytes is encoded in pieces that end at a line, so that memory stays bounded.
                    ids = np.concatenate([np.array(encoding.encode_ordinary(x), "<u2") for x in pieces(text)])
                buffer += [ids, np.array([eod], "<u2")]
                held += len(ids) + 1
                while held >= block_ids:
                    whole = np.concatenate(buffer)
                    yield row(block, whole[:block_ids].tobytes(), None, None)
                    buffer, held, block = [whole[block_ids:]], held - block_ids, block + 1
        if held:
            yield row(block, np.concatenate(buffer).tobytes(), None, None)

    ids = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    flat = scratch.table(ids.mapInPandas(encode, "file string, block long, ids binary, start long, doc_ids array<string>"))
    return flat, scratch.table(flat.filter("block < 0").select("file", "start", "doc_ids"))


def pieces(text: str, most: int = 1 << 22) -> Iterator[str]:
    """The text cut before a space that follows a letter, where the vocabulary's pattern always begins a new match."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    block_ids: int = 1 << 20,
) -> DataFrame:
    """``(doc_id, n_tokens)`` for every row: tokens of the whole text in the given vocabulary, by way of flat token files.

    Null and empty texts have 0 tokens.  Null ids and repeated rows are documents like any other.  An empty table gives no rows.
    Other columns are ignored.  The end-of-document id is the first that the vocabulary leaves free; it must fit 16 bits.
    """
    ranks = load_ranks(vocabulary)
    eod = len(ranks)
    if eod > 0xFFFF or max(ranks.values()) >= eod:
        raise ValueError(f"{vocabulary} leaves no free id of 16 bits")
    scratch = Scratch(docs.sparkSession, "tokens")
    blocks, order = write_flat(docs, scratch, ranks, eod, id_col, text_col, block_ids)
    counts = separator_scan(blocks.filter("block >= 0"), eod, scratch=scratch)
    scratch.remove(blocks)
    ids = order.select("file", "start", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("start") + F.col("i")).alias("ordinal"), "doc_id")
    kind = docs.schema[id_col].dataType
    return ids.join(counts, ["file", "ordinal"]).select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens")


def op1_separator_scan(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op1_separator_scan": op1_separator_scan}
