"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
# Names the operators use themselves, inside or in their results.
CLASHING = ("row", "score", "n_words", "spans", "_scan", "_found", "digest", "n", "kept", "host",
            "class", "node", "SCORE")


def frame(spark: SparkSession, rows: list[tuple], schema: T.StructType = DOCS, parts: int = 3
          ) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df: DataFrame, names: tuple[str, ...] = ("row", "_id", "_text", "_found", "_scored", "n",
                                                      "bad", "mean", "SCORE", "digest", "node")
             ) -> DataFrame:
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, nulls, blanks, one very long text."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 30, 10_000))
    rows: list[tuple[int | None, str | None]] = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, None), (6, "one two"),
        (7, "x" * 30_000), (8, " ".join(words(rng, 6000)))]
    for i in range(9, n):
        text = " ".join(words(rng, rng.randrange(1, 120)))
        kind = i % 5
        if kind == 1:
            text = f"{text} {passage} tail{i}"
        elif kind == 2 and rows[i - 1][1]:
            text = rows[i - 1][1]
        elif kind == 3 and rows[i - 1][1]:
            near = rows[i - 1][1].split()
            near[rng.randrange(len(near))] = f"new{i}"
            text = "\n".join(near) if i % 2 else " ".join(near)
        rows.append((i, text))
    rng.shuffle(rows)
    return rows
