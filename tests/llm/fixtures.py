"""Small documents with nulls, empty and long texts, ties, repeated rows and a clashing extra column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, keep int"


def documents(spark: SparkSession, texts: list[str | None], langs: list[str | None] | None = None, sources: list[str | None] | None = None, first: int = 0) -> DataFrame:
    n = len(texts)
    langs, sources = langs or ["en"] * n, sources or ["a"] * n
    rows = [(first + i, t, la, s, None if t is None else len(t), "clash", 1) for i, (t, la, s) in enumerate(zip(texts, langs, sources, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n: int, seed: int = 0) -> str:
    """n words of a text that has no repeated 3-word window."""
    return " ".join(f"w{(seed * 7919 + i * i + 31 * i) % 100003}" for i in range(n))


ODD = [None, "", " \t\n", "one", "one two three", prose(40), prose(40), "Été ﬁn 東京 naïve — “quotes” \U0001f600 end  ", "x" * 5000, prose(3000, 5), "a b c d e " * 300]
