"""Small inputs shared by the tests of the subpackage."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", "er"]) + str(rng.randrange(60)) for _ in range(n))


def documents(spark, texts, ids=None, extra=""):
    """Documents of the given texts; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "ÀÉ ü\tß", "x" * 300_000, "word " * 20_000, "same text here", "same text here"]


def odd_documents(spark):
    """Null and empty texts, very long ones, repeated rows, null ids, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = documents(spark, [*ODD, "same text here", None], [*range(len(ODD)), None, None])
    docs = docs.unionAll(docs.filter("doc_id = 8"))
    for name in ("row", "grp", "fp", "tid", "chunk", "shard", "mark", "score", "hash", "copies", "leak", "size", "key", "KEYS", "bundle"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
