import numpy as np
import tiktoken

from kindred.llm import token_counts as T
from kindred.llm.shared import Scratch

from .helpers import documents, empty_documents, odd_documents


def brute(ids, eod):
    """Lengths of the documents of a flat file."""
    out, n = [], 0
    for x in ids:
        if x == eod:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] if n else out


def test_scan_stitches_blocks(spark):
    rng = np.random.default_rng(3)
    files = {
        "mixed": rng.choice([0, 1, 2, 9], 500, p=[0.3, 0.3, 0.3, 0.1]),
        "one": np.ones(64),
        "ends": np.full(20, 9),
        "sparse": np.where(np.arange(300) % 97 == 96, 9, 1),
        "last": np.array([1, 9]),
        "none": np.array([]),
    }
    for size in (1, 7, 64, 1000):
        rows = [(f, b, x[at : at + size].astype("<u2").tobytes()) for f, x in files.items() for b, at in enumerate(range(0, len(x), size))]
        blocks = spark.createDataFrame(rows + [("none", 0, None)], "file string, block long, ids binary")
        got: dict = {f: {} for f in files}
        for r in T.separator_scan(blocks, 9).collect():
            assert r["ordinal"] not in got[r["file"]]
            got[r["file"]][r["ordinal"]] = r["n_tokens"]
        for f, x in files.items():
            assert [got[f][i] for i in range(len(got[f]))] == brute(x, 9), (f, size)


def test_flat_files(spark, tmp_path):
    x = np.array([1, 2, 9, 3, 9, 9, 4, 4, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(x.tobytes())
    got = T.separator_scan(T.read_flat_files(spark, str(tmp_path), block_bytes=4), 9)
    assert [r["n_tokens"] for r in got.orderBy("ordinal").collect()] == [2, 1, 0, 3]


def test_counts_are_the_tokenizer_s(spark):
    encoding = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(T.VOCABULARY), special_tokens={})
    docs = odd_documents(spark)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in T.count_tokens(docs, block_ids=100).collect()), key=str)
    want = sorted(((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in docs.collect()), key=str)
    assert got == want
    assert T.count_tokens(empty_documents(spark)).count() == 0


def test_pieces_do_not_change_tokens():
    encoding = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(T.VOCABULARY), special_tokens={})
    text = "some words, and 12 numbers  with\nlines " * 400 + "é" * 90
    parts = list(T.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert [t for p in parts for t in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_file_names_stay_apart(spark):
    docs = documents(spark, ["a b c", "d"] * 10).repartition(5)
    blocks, order = T.write_flat(docs, Scratch(spark, "t"), T.load_ranks(T.VOCABULARY), 50256, "doc_id", "text", 4)
    blocks = blocks.filter("block >= 0")
    assert blocks.select("file", "block").distinct().count() == blocks.count()
    assert sum(len(r["doc_ids"]) for r in order.collect()) == 20
