"""Stand-in entity sources, as expressions that Spark SQL and ANSI SQL engines share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NOISY = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(split_part(p_name, ' ', 2), '  ', split_part(p_name, ' ', 1)) WHEN 2 THEN concat(p_name, ' Ltd.') WHEN 3 THEN replace(p_name, ' ', '-') ELSE split_part(p_name, ' ', 1) END"
_ADDRESS = "concat('No. ', CAST(p_size AS STRING), '/', CAST(p_partkey % 2 AS STRING), ', ', p_brand, ' St, NULL, ', p_type, ' ', CAST(CASE p_size % 3 WHEN 1 THEN 500000 ELSE 10000 END + p_size AS STRING))"

#: Raw columns by view: (table, expressions).
VIEWS = {
    "part": (
        "part",
        {
            "entity_id": "concat(CASE p_partkey % 4 WHEN 0 THEN 'S1-' WHEN 3 THEN 'S3-' ELSE 'S2-' END, CAST(p_partkey AS STRING))",
            "business_name": f"CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN replace(p_name, 'e', 'é') ELSE {_NOISY} END",
            "business_address": f"CASE WHEN p_partkey % 11 = 0 THEN 'N/A' WHEN p_partkey % 3 = 0 THEN upper({_ADDRESS}) ELSE {_ADDRESS} END",
            "country": "CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN ' India ' ELSE 'France' END",
        },
    ),
    "documents": (
        "documents",
        {
            "entity_id": "concat(CASE doc_id % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END, CAST(doc_id AS STRING))",
            "business_name": "split_part(text, chr(10), 1)",
            "business_address": "substring(text, length(split_part(text, chr(10), 1)) + 2)",
            "country": "lang",
        },
    ),
    "customer": (
        "customer",
        {
            "entity_id": "concat(CASE c_custkey % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END, CAST(c_custkey AS STRING))",
            "business_name": "replace(c_name, '#', ' ')",
            "business_address": "c_mktsegment",
            "country": "CAST(c_nationkey AS STRING)",
        },
    ),
}


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, dealt out to all cores.

    Spark cuts a scan finely enough for all cores unless the table is only some MB a core, so
    what is shuffled here is bounded by the cluster; larger tables stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw(spark: SparkSession, sf_dir: str, view: str, *more: str) -> DataFrame:
    """The view's raw columns, and more of its table's."""
    table, columns = VIEWS[view]
    exprs = [*[f"{e} AS {c}" for c, e in columns.items()], *more]
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs))


def raw_sql(view: str) -> str:
    table, columns = VIEWS[view]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


#: Parts are known matches if these are equal.
KEY = ["p_name", "p_type", "p_brand"]
_KEY = ", ".join(KEY)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, match_id) of the part view: equal name, type and brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    ids = part.selectExpr(*KEY, f"{VIEWS['part'][1]['entity_id']} AS id", "p_partkey % 4 = 0 AS is_s1")
    a, b = ids.where("is_s1").withColumnRenamed("id", "s1_id").drop("is_s1"), ids.where("NOT is_s1").withColumnRenamed("id", "match_id").drop("is_s1")
    return a.join(b, KEY).select("s1_id", "match_id")


def truth_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many rows ``truth`` has (_gt), from one count a key."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    side = "p_partkey % 4 = 0"
    counts = part.groupBy(*KEY).agg(F.count_if(F.expr(side)).alias("_a"), F.count_if(F.expr(f"NOT {side}")).alias("_b"))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in KEY])
    return counts.where(known).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("_gt"))


def truth_sql() -> str:
    ids = f"SELECT {_KEY}, {VIEWS['part'][1]['entity_id']} AS id, p_partkey % 4 = 0 AS is_s1 FROM part"
    return f"SELECT a.id AS s1_id, b.id AS match_id FROM ({ids}) a JOIN ({ids}) b USING ({_KEY}) WHERE a.is_s1 AND NOT b.is_s1"
