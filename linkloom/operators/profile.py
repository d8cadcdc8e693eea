"""Profiles of entity sources and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(raw: DataFrame) -> DataFrame:
    """One row a source: sizes, distinct ids, and shares and lengths of the text fields."""
    share = lambda c: F.avg(c.cast("double")) * 100
    per = lambda c: [
        share(F.col(c) == "").alias(f"{c}_empty_pct"),
        share(F.col(c).rlike("[^\\x00-\\x7F]")).alias(f"{c}_non_ascii_pct"),
        F.sum(F.lower(F.trim(c)).isin("null", "nan", "none", "n/a").cast("long")).alias(f"{c}_null_words"),
        F.avg(F.char_length(c)).alias(f"{c}_mean_length"),
        F.min(F.char_length(c)).alias(f"{c}_min_length"),
        F.max(F.char_length(c)).alias(f"{c}_max_length"),
        F.median(F.char_length(c)).alias(f"{c}_median_length"),
    ]
    rows = raw.select(F.substring("entity_id", 1, 2).alias("src"), "entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("business_name", "business_address", "country")])
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("ids"), F.countDistinct("country").alias("countries"), F.countDistinct("business_name").alias("names"), *per("business_name"), *per("business_address"))


def value_counts(raw: DataFrame, column: str) -> DataFrame:
    return raw.groupBy(F.substring("entity_id", 1, 2).alias("src"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def pattern_counts(entities: DataFrame, column: str, words: list[str]) -> DataFrame:
    """How many entities of each source hold each word (legal suffixes, street kinds)."""
    hits = entities.select(F.substring("entity_id", 1, 2).alias("src"), F.explode(F.array_distinct(F.col(column))).alias("word"))
    return hits.where(F.col("word").isin(words)).groupBy("src", "word").agg(F.count(F.lit(1)).alias("n"))


def match_histogram(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """How many S1 entities have how many matches, none too."""
    counts = truth.distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("matches"))
    every = s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left")
    return every.groupBy(F.coalesce("matches", F.lit(0)).alias("matches")).agg(F.count(F.lit(1)).alias("entities"))


def match_sources(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """S1 entities by where their matches are: both, one source only, none."""
    per = truth.groupBy("s1_id").agg(F.max(F.col("match_id").startswith("S2-").cast("int")).alias("_2"), F.max(F.col("match_id").startswith("S3-").cast("int")).alias("_3"))
    every = s1.select(F.col("entity_id").alias("s1_id")).join(per, "s1_id", "left").na.fill(0, ["_2", "_3"])
    kind = F.when((F.col("_2") == 1) & (F.col("_3") == 1), "both").when(F.col("_2") == 1, "only_s2").when(F.col("_3") == 1, "only_s3").otherwise("none")
    return every.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("entities"))
