"""Set operations on candidate frames (s1_id, cand_id)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["s1_id", "cand_id"]
Route = Callable[[DataFrame, DataFrame], DataFrame]


def candidate_union(frames: list[DataFrame]) -> DataFrame:
    """All distinct pairs of the frames."""
    return reduce(DataFrame.unionByName, [f.select(*PAIR) for f in frames]).distinct()


def tagged(name: str, ordinal: int, pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit(name).alias("route"), F.lit(ordinal).alias("ord"), *PAIR).distinct()


def union_of(name_a: str, a: DataFrame, name_b: str, b: DataFrame) -> DataFrame:
    """The union route, named a+b."""
    return candidate_union([a, b]).select(F.lit(f"{name_a}+{name_b}").alias("route"), *PAIR)


def from_source(pairs: DataFrame, prefix: str) -> DataFrame:
    return pairs.where(F.col("cand_id").startswith(prefix + "-"))


def shared_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR).intersect(b.select(*PAIR))


def pairs_without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR).distinct().join(b.select(*PAIR), PAIR, "left_anti")


def first_route(routes: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each pair with the first route, in the order given, that found it."""
    rows = reduce(DataFrame.unionByName, [tagged(n, i, f) for i, (n, f) in enumerate(routes)])
    return rows.groupBy(*PAIR).agg(F.min_by("route", "ord").alias("route"))


def sampled(entities: DataFrame, n: int, seed: int = 42, key: str = "entity_id") -> DataFrame:
    """n rows in the order of a hash of their id, whatever the order they come in."""
    return entities.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed)).cast("binary")), key).limit(n)


def pooled(s2: DataFrame, s3: DataFrame, key: str = "entity_id") -> DataFrame:
    """Both target sources; of rows with one id, the second source's."""
    return s2.join(s3.select(key), key, "left_anti").select(*s2.columns).unionByName(s3)
