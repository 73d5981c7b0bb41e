"""Dictionaries of phrases as tables: found in texts by joins, whatever the number of terms.

A dictionary is a Parquet table of terms (lower-case words joined by one blank) with their categories. A text's words
meet the dictionary's first words; only where one begins a term are the phrases of the lengths that such terms have
formed, and joined to the terms. At each position the longest term counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def build(terms: DataFrame, path: str, term: str = "term", category: str = "category") -> None:
    """Write a dictionary: normalized terms, each once (with its least category), sorted so that files hold ranges of them."""
    rows = terms.select(words(F.col(term)).alias("w"), F.col(category).cast("string").alias("category")).where(F.size("w") > 0)
    rows = rows.select(F.array_join("w", " ").alias("term"), F.element_at("w", 1).alias("first"), F.size("w").alias("length"), "category")
    rows.groupBy("term", "first", "length").agg(F.min("category").alias("category")).sort("term").write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, first string, length int, category string").parquet(path)


def matches(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position (of the first word, from 0), term, category: the longest term at each position of a text."""
    begins = dictionary.groupBy("first").agg(F.array_sort(F.collect_set("length")).alias("lengths"))
    longest = dictionary.agg(F.max("length")).first()[0] or 1
    w = docs.select(F.col(key), words(F.col(text)).alias("w"))
    # each position with the words that a term could span
    spans = F.transform("w", lambda x, i: F.struct(x.alias("first"), F.slice(F.col("w"), i + 1, F.lit(longest)).alias("ahead")))
    at = w.select(key, F.posexplode(spans).alias("position", "s")).select(key, "position", "s.first", "s.ahead")
    phrases = at.join(begins, "first").select(key, "position", "ahead", F.explode("lengths").alias("length")).where(F.size("ahead") >= F.col("length"))
    phrases = phrases.select(key, "position", "length", F.array_join(F.slice("ahead", F.lit(1), F.col("length")), " ").alias("term"))
    found = phrases.join(dictionary.select("term", "category"), "term")
    return found.groupBy(key, "position").agg(F.max_by(F.struct("term", "category"), "length").alias("t")).select(key, "position", "t.term", "t.category")


def indicators(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, category, n, n_terms: how often a document holds terms of a category, and how many different ones."""
    return found.groupBy(key, "category").agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_terms"))
