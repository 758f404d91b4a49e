"""Awkward documents that every operator has to take."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, copies, a repeated row, one very long text, shared passages, other scripts."""
    base, shared = prose(60, 1), prose(30, 2)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, shared + " " + prose(20, 3)), (8, prose(25, 4) + " " + shared), (9, prose(5, 5) + " " + shared + " " + prose(5, 6)),
        (None, base), (None, None), (10, prose(30_000, 7)), (11, "x" * 100_000), (12, "Ünï çødé 漢字 \U0001f600 \x85 \xa0 text"), (13, base.replace("alpha", "beta", 1)), (14, prose(40, 8) * 3), (15, "a\x00b \\ <|im_end|> [INST]"),
    ]


def frame(spark, rows=None, names="doc_id long, text string"):
    """The documents with extra columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, names)
    for name in ("__text", "fp", "mark", "score", "kind", "shard", "n", "source"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)
