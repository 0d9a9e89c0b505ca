"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA, parts: int = 3) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(parts)


def docs(spark: SparkSession, texts: list[str | None], first: int = 0, parts: int = 3) -> DataFrame:
    return frame(spark, [(first + k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)], parts=parts)


def prose(rng: random.Random, words: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def awkward(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    base = prose(rng, 300)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (0, 20, 150, 299)]
    passage = prose(rng, 60)
    return [
        None, "", " ", "\n\n\t", "one", "Two words", base, base, base.upper(), *near,
        prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 50), passage, prose(rng, 30) + " " + passage, passage + " " + passage,
        "a" * 1500, "a" * 230, "ab" * 400, "é" * 300, prose(rng, 4000), prose(rng, 4000, 5), "x\x00y " * 90, "日本語 " * 120, "ein und ein und " * 40,
    ]
