"""Normalized entity frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as T

RAW = ["entity_id", "business_name", "business_address", "country"]
DERIVED = ["name_cleaned", "name_no_accents", "name_alphanumeric", "name_tokens", "addr_cleaned", "addr_no_accents", "addr_alphanumeric", "addr_tokens", "addr_numeric_tokens", "country_cleaned"]


def normalized(raw: DataFrame, by_name: bool = False) -> DataFrame:
    """The four raw columns, null as empty, and the ten derived ones; token columns are arrays.

    Three projections, so that no expression is repeated inside another.
    """
    base = raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RAW], *[c for c in raw.columns if c not in RAW])
    cleaned = {
        "name_cleaned": F.lower(T.unicode_form(T.present(F.col("business_name")))),
        "addr_cleaned": T.without_null_words(F.lower(T.unicode_form(T.present(F.col("business_address"))))),
        "country_cleaned": T.country_form(F.col("country")),
    }
    forms = base.withColumns(cleaned)
    forms = forms.withColumns({f"{p}_no_accents": T.fold_latin(F.col(f"{p}_cleaned"), by_name) for p in ("name", "addr")})
    forms = forms.withColumns({f"{p}_alphanumeric": T.alphanumeric(F.col(f"{p}_no_accents")) for p in ("name", "addr")})
    forms = forms.withColumns({f"{p}_tokens": T.tokens(F.col(f"{p}_alphanumeric")) for p in ("name", "addr")})
    forms = forms.withColumn("addr_numeric_tokens", T.numeric(F.col("addr_tokens")))
    return forms.select(*RAW, *DERIVED, *[c for c in raw.columns if c not in RAW])


def address_records(entities: DataFrame) -> DataFrame:
    """The address routes' fields beside the normalized ones."""
    return entities.withColumns(
        {
            "addr_words": T.address_words(F.col("addr_tokens")),
            "numeric_set": T.as_set(F.col("addr_numeric_tokens")),
            "house_number": T.house_number(F.col("addr_cleaned")),
            "postal_code": T.postal_code(F.col("business_address"), F.col("country_cleaned")),
            "char_3grams": T.trigrams(F.col("addr_alphanumeric")),
        }
    )


def stored(df: DataFrame) -> DataFrame:
    """Rows that several routes read, computed once: a checkpoint in the folder that the session names.

    Only where ``spark.checkpoint.dir`` is unset (one machine) a temporary folder is used.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/linkloom-{uuid.uuid4().hex}")
    return df.checkpoint()


def source_of(column: str = "entity_id"):
    """The source named by the id's prefix."""
    return F.substring_index(F.col(column), "-", 1)


def split_sources(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probe side S1, target side S2 and S3)."""
    return entities.where(F.col("entity_id").startswith("S1-")), entities.where(F.col("entity_id").rlike("^S[23]-"))
