"""Readers and writers of entity tables, ground truth, candidates and result tables.

Entity tables are UTF-8 TSV without quoting. Lines are read as text and split here, so
that malformed ones can be counted; a line number column makes limits deterministic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.plans.entities import DERIVED, RAW, normalized

HEADER = "\t".join(RAW)
_TRUTH = ["source1_entity_id", "matched_entity_ids"]


class HeaderError(ValueError):
    """The first line of an entity table isn't the header."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, parts) of the non-empty lines of a text file, in file order."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("line"))
    return lines.where("value <> ''").select("line", "value", F.split("value", "\t", -1).alias("parts"))


def check_header(spark: SparkSession, path: str) -> None:
    first = spark.read.text(path).limit(1).collect()
    if not first or first[0][0].lstrip("﻿").rstrip("\r") != HEADER:
        raise HeaderError(f"{path}: expected the header {HEADER!r}")


def _body(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value") != HEADER)


def read_entities(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows of four columns; lines with fewer are errors, those with more are errors and cut.

    ``limit`` counts rows, in file order.
    """
    check_header(spark, path)
    body = _body(read_lines(spark, path))
    rows = body.where(F.size("parts") >= 4)
    if limit is not None:
        rows = rows.orderBy("line").limit(limit)
    errors = body.where(F.size("parts") != 4).select("line", F.size("parts").alias("columns"), F.when(F.size("parts") < 4, "skipped").otherwise("truncated").alias("action"))
    return rows.select(*[F.col("parts")[i].alias(c) for i, c in enumerate(RAW)]), errors


def read_columns(spark: SparkSession, path: str, needed: DataFrame | None = None, limit: int | None = None, key: str = "entity_id") -> DataFrame:
    """Rows of at least four columns, extra ones ignored; ``needed``: a frame of the ids to keep. ``limit`` counts lines."""
    body = _body(read_lines(spark, path))
    if limit is not None:
        body = body.orderBy("line").limit(limit)
    rows = body.where(F.size("parts") >= 4).select(*[F.col("parts")[i].alias(c) for i, c in enumerate(RAW)])
    return rows if needed is None else rows.join(needed.select(key), key, "left_semi")


def read_quoted(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """An entity table whose fields may be quoted and span lines."""
    schema = ", ".join(f"{c} string" for c in RAW)
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', multiLine=True, schema=schema, mode="PERMISSIVE").na.fill("")
    return rows if limit is None else rows.limit(limit)


def read_truth(spark: SparkSession, path: str, singletons: bool = False) -> DataFrame:
    """(s1_id, match_id) of a ground-truth table; with ``singletons``, a null match for those without."""
    rows = read_lines(spark, path).where(F.col("value") != "\t".join(_TRUTH))
    return explode_truth(rows.select(F.col("parts")[0].alias(_TRUTH[0]), F.coalesce(F.get("parts", F.lit(1)), F.lit("")).alias(_TRUTH[1]), "line"), singletons)


def explode_truth(raw: DataFrame, singletons: bool = False) -> DataFrame:
    """Comma lists as rows; trimmed, empty entries dropped; of lines of one S1 entity the last (by ``line``, if there)."""
    if "line" in raw.columns:
        raw = raw.groupBy(_TRUTH[0]).agg(F.max_by(_TRUTH[1], "line").alias(_TRUTH[1]))
    ids = F.filter(F.transform(F.split(F.coalesce(_TRUTH[1], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    explode = F.explode_outer if singletons else F.explode
    return raw.select(F.trim(_TRUTH[0]).alias("s1_id"), explode(ids).alias("match_id"))


def truth_by_source(truth: DataFrame, s1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(S2 truth, S3 truth) of the given S1 entities, distinct."""
    own = truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").distinct()
    return own.where("match_id like 'S2-%'"), own.where("match_id like 'S3-%'")


def as_text(entities: DataFrame) -> DataFrame:
    """The 14 columns as strings; word lists are joined by spaces."""
    kinds = dict(entities.dtypes)
    return entities.select(*[(F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c)).alias(c) for c in RAW + DERIVED])


def write_tsv(entities: DataFrame, path: str, files: int | None = None) -> None:
    """Header and rows, without quoting; tabs and line breaks can't occur in normalized fields."""
    out = as_text(entities)
    (out.coalesce(files) if files else out).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def write_results(frames: list[DataFrame], path: str) -> DataFrame:
    """Result tables with the union of their columns, as one CSV file."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)  # one row a route
    return out


def read_results(spark: SparkSession, path: str, key: str = "route") -> dict[str, dict]:
    """A result table, by route."""
    return {r[key]: r.asDict() for r in spark.read.csv(path, header=True, inferSchema=True).collect()}


def matching_results(pairs: DataFrame) -> DataFrame:
    """A line for each S1 entity: its candidates, sorted, joined by commas."""
    return pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("cand_id")), ",").alias("matched_entity_ids"))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, by the file system that Spark uses for it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(f"none of {paths}")


def synthetic(spark: SparkSession, entities: int, seed: int = 42, distractors: int = 0) -> tuple[DataFrame, DataFrame]:
    """(raw entities, truth): S1 names, S2 copies of 80 % and S3 copies of 70 % with noise, and targets of no one."""
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(n)), F.lit(100))
    heads = "summit harbor cedar atlas nova prime delta orchid river stone".split()
    cores = "health logistics retail energy foods textiles media systems travel motors".split()
    tails = "llc inc ltd corp group".split()
    base = spark.range(entities).withColumns({"_h": pick(1, heads), "_c": pick(2, cores), "_t": pick(3, tails), "country": pick(4, ["US", "India", "France"])})
    base = base.withColumn("name", F.concat_ws(" ", "_h", "_c", F.col("id").cast("string"), "_t")).withColumn("address", F.concat(F.pmod(F.col("id") * 7, F.lit(999)).cast("string"), F.lit(" Main St")))
    row = lambda df, prefix, name: df.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("entity_id"), name.alias("business_name"), F.col("address").alias("business_address"), "country")
    noise2 = F.when(part(5) < 25, F.upper("name")).when(part(5) < 50, F.regexp_replace("name", " (llc|inc|ltd|corp|group)$", "")).when(part(5) < 75, F.concat_ws("-", "_h", "_c", F.col("id").cast("string"))).otherwise(F.col("name"))
    noise3 = F.when(part(6) < 33, F.initcap("name")).when(part(6) < 66, F.concat("name", F.lit("."))).otherwise(F.col("name"))
    s2, s3 = base.where(part(7) < 80), base.where(part(8) < 70)
    raw = row(base, "S1-", F.col("name")).unionByName(row(s2, "S2-", noise2)).unionByName(row(s3, "S3-", noise3))
    if distractors:
        extra = spark.range(entities, entities + distractors).withColumns({"name": F.concat(pick(9, heads), F.lit(" "), pick(10, cores), F.lit(" d"), F.col("id").cast("string")), "address": F.lit(""), "country": pick(11, ["US", "India", "France"])})
        raw = raw.unionByName(row(extra, "S2-", F.col("name")))
    link = lambda df, p: df.select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("s1_id"), F.concat(F.lit(p), F.col("id").cast("string")).alias("match_id"))
    return raw, link(s2, "S2-").unionByName(link(s3, "S3-"))


def normalize_file(spark: SparkSession, source: str, target: str, limit: int | None = None) -> dict:
    """Normalize one table to another; a summary with rows and the first errors."""
    import time

    began = time.perf_counter()
    try:
        rows, errors = read_entities(spark, source, limit)
    except HeaderError as e:
        return {"input": source, "output": target, "rows": 0, "errors": [str(e)], "n_errors": 1, "seconds": 0.0}
    seen = F.count(F.lit(1))
    from pyspark.sql import Observation

    watch = Observation()
    write_tsv(normalized(rows).observe(watch, seen.alias("rows")), target)
    bad = errors.orderBy("line").limit(10).collect()
    return {"input": source, "output": target, "rows": watch.get["rows"], "errors": [f"line {r['line']}: {r['columns']} columns, {r['action']}" for r in bad], "n_errors": errors.count(), "seconds": time.perf_counter() - began}
