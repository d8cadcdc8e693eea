"""Entities with equal fields, taken as one.

A route without caps finds the same targets for all entities with the same fields. It runs
once a class, and its pairs are written out from lists of members: they meet neither a
shuffle nor a distinct, and what only counts them needs the sizes of the classes alone.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.sets import PAIR
from linkloom.plans.entities import stored

Route = Callable[[DataFrame, DataFrame], DataFrame]
#: About so many ids are in one list of members.
LIST = 512
#: And so many in a list that the other side's is repeated for: a pair of lists is written out in memory.
OUTER = 64
#: Of one coarser class about so many rows meet in one place.
CELL = 512
#: About so many pairs of members a task writes out, and so many tasks at most.
TASK, TASKS = 2**22, 2**12


class Classes(NamedTuple):
    """``rows``: the fields of each class, its name as entity_id; ``members``: distinct (class, entity_id); ``every``: (entity_id, class) of each row."""

    rows: DataFrame
    members: DataFrame
    every: DataFrame

    def sizes(self, name: str = "class") -> DataFrame:
        return self.members.groupBy(F.col("class").alias(name)).agg(F.count(F.lit(1)).alias("n"))

    def lists(self, name: str, ids: str, most: int = LIST) -> DataFrame:
        """(name, ids): the members in lists that a hash of the id deals out, so that a large class is no single row."""
        dealt = self.members.join(self.sizes(), "class").select("class", "entity_id", F.expr(f"pmod(xxhash64(entity_id), ceil(n / {most}))").alias("_part"))
        return dealt.groupBy(F.col("class").alias(name), "_part").agg(F.collect_list("entity_id").alias(ids)).drop("_part")


def classed(entities: DataFrame, columns: list[str]) -> DataFrame:
    """(entity_id, class, own, columns), stored: equal fields have one class, but an id of several rows has its ``own``."""
    fields = entities.select("entity_id", *columns)
    several = fields.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("entity_id", F.lit(True).alias("own"))
    marked = fields.join(several, "entity_id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    return stored(marked.select("entity_id", F.when(F.col("own"), F.concat(F.lit("="), "entity_id").cast("binary")).otherwise(F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary")))).alias("class"), "own", *columns))


def classes(marked: DataFrame) -> Classes:
    """The classes of a side of ``classed`` rows."""
    columns = [c for c in marked.columns if c not in ("entity_id", "class", "own")]
    one, own = marked.where("NOT own"), marked.where("own")
    row = lambda df: df.select(F.col("class").alias("entity_id"), *columns)
    member = lambda df: df.select("class", "entity_id")
    return Classes(stored(row(one).distinct().unionByName(row(own))), member(one).unionByName(member(own).distinct()), member(marked).select("entity_id", "class"))


def listed(pairs: DataFrame, a: Classes, b: Classes, tasks: int = 1) -> DataFrame:
    """Pairs of classes as pairs of lists (_s, _t) of their members, in so many tasks if there are several."""
    place = lambda df: df.repartition(tasks, "_b") if tasks > 1 else df
    outer = pairs.withColumnsRenamed({"s1_id": "_a", "cand_id": "_b"}).join(a.lists("_a", "_s", OUTER), "_a").drop("_a")
    return place(outer).join(place(b.lists("_b", "_t")), "_b").drop("_b")


def written_out(lists: DataFrame) -> DataFrame:
    """Pairs of lists (_s, _t), with other columns if they have any, as pairs of ids."""
    rest = [c for c in lists.columns if c not in ("_s", "_t")]
    return lists.select(F.explode("_s").alias("s1_id"), "_t", *rest).select("s1_id", F.explode("_t").alias("cand_id"), *rest)


def expanded(pairs: DataFrame, a: Classes, b: Classes, tasks: int = 1) -> DataFrame:
    """Pairs of classes, with other columns if they have any, as pairs of their members."""
    return written_out(listed(pairs, a, b, tasks))


def by_class(route: Route, *columns: str, written: Callable[[Classes, Classes], DataFrame] | None = None) -> Route:
    """A route that reads these columns alone and has no cap on targets, run once a class; ``plain`` is the route itself, ``written`` what writes its pairs out."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        a, b = (classes(classed(side, ["country_cleaned", *columns])) for side in (s1, t))
        if written:
            return written(a, b)
        pairs = stored(route(a.rows, b.rows))
        return expanded(pairs, a, b, tasks_of(pairs, a, b))

    run.plain, run.columns = route, columns
    return run


def candidate_counts(pairs: DataFrame, a: Classes, b: Classes) -> DataFrame:
    """(s1_id, candidates) of every S1 entity, from pairs of classes."""
    found = pairs.select(*PAIR).distinct().join(b.sizes("cand_id"), "cand_id").groupBy(F.col("s1_id").alias("class")).agg(F.sum("n").alias("candidates"))
    return a.every.join(found, "class", "left").select(F.col("entity_id").alias("s1_id"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def _true_pairs(truth: DataFrame, a: Classes, b: Classes, how: str = "inner") -> DataFrame:
    """Distinct known matches (s1_id, match_id) of S1 entities with their classes (_a, _b)."""
    side = lambda x, i, c: x.members.select(F.col("entity_id").alias(i), F.col("class").alias(c))
    return truth.select("s1_id", "match_id").distinct().join(side(a, "s1_id", "_a"), "s1_id").join(side(b, "match_id", "_b"), "match_id", how)


def true_hits(truth: DataFrame, pairs: DataFrame, a: Classes, b: Classes) -> DataFrame:
    """(s1_id, match_id, hit) of the distinct known matches of S1 entities: hit is 1 if pairs of classes hold it."""
    found = pairs.select(F.col("s1_id").alias("_a"), F.col("cand_id").alias("_b")).distinct().withColumn("hit", F.lit(1))
    return _true_pairs(truth, a, b, "left").join(found, ["_a", "_b"], "left").select("s1_id", "match_id", F.coalesce("hit", F.lit(0)).alias("hit"))


def volume(pairs: DataFrame, a: Classes, b: Classes) -> DataFrame:
    """Pairs of classes with ``_w``, the number of pairs of their members."""
    return pairs.join(a.sizes("s1_id").withColumnRenamed("n", "_na"), "s1_id").join(b.sizes("cand_id").withColumnRenamed("n", "_nb"), "cand_id").select(*PAIR, (F.col("_na") * F.col("_nb")).alias("_w"))


def known_pairs(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(s1_id, cand_id): distinct pairs of classes with an equal key, of (entity_id, key) of classes; known matches that are equal keys are no rows of their own."""
    side = lambda df, i: df.select(*key, F.col("entity_id").alias(i)).distinct()
    return side(a, "s1_id").join(side(b, "cand_id"), key).select(*PAIR).distinct()


def true_counts(a: Classes, b: Classes, key: list[str]) -> DataFrame:
    """(s1_id, cand_id, n): pairs of classes with the number of known matches of their members, of classes that hold the key."""
    return volume(known_pairs(a.rows, b.rows, key), a, b).withColumnRenamed("_w", "n")


def _coarser(x: Classes, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the classes by fewer columns, and (class, _c) of each class; one of several rows stays its own."""
    several = x.rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("entity_id", F.lit(True).alias("own"))
    name = F.when(F.col("own"), F.col("entity_id")).otherwise(F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary"))))
    named = stored(x.rows.select("entity_id", *columns).join(several, "entity_id", "left").withColumn("_c", name))
    row = lambda df: df.select(F.col("_c").alias("entity_id"), *columns)
    return row(named.where("own IS NULL")).distinct().unionByName(row(named.where("own"))), named.select(F.col("entity_id").alias("class"), "_c").distinct()


def found_of(known: DataFrame, route: Route, a: Classes, b: Classes) -> DataFrame:
    """Those pairs of classes (s1_id, cand_id) among the known ones that a ``by_class`` route finds. It runs on the columns that it reads alone."""
    (s, of_a), (t, of_b) = (_coarser(x, ["country_cleaned", *route.columns]) for x in (a, b))
    found = route.plain(s, t).select(F.col("s1_id").alias("_a"), F.col("cand_id").alias("_b")).distinct()
    side = lambda df, i, c: df.withColumnsRenamed({"class": i, "_c": c})
    return known.select(*PAIR).join(side(of_a, "s1_id", "_a"), "s1_id").join(side(of_b, "cand_id", "_b"), "cand_id").join(found, ["_a", "_b"], "left_semi").select(*PAIR)


def coarser(x: Classes, columns: list[str]) -> tuple[Classes, DataFrame]:
    """The classes by fewer columns, and (class, _c): which of them each class is in."""
    rows, of = _coarser(x, columns)
    of = stored(of)
    named = lambda df: df.join(of, "class").select(F.col("_c").alias("class"), "entity_id")
    return Classes(rows, named(x.members), named(x.every).select("entity_id", "class")), of


def not_of(pairs: DataFrame, found: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """Pairs of classes, with other columns if they have any, whose coarser classes are no found pair."""
    side = lambda df, i, c: df.withColumnsRenamed({"class": i, "_c": c})
    known = found.select(F.col("s1_id").alias("_a"), F.col("cand_id").alias("_b")).distinct()
    return pairs.join(side(of_a, "s1_id", "_a"), "s1_id").join(side(of_b, "cand_id", "_b"), "cand_id").join(known, ["_a", "_b"], "left_anti").select(*pairs.columns)


def met(pairs: DataFrame, s: DataFrame, t: DataFrame, tasks: int = 1) -> DataFrame:
    """Rows of s (_a) and t (_b) whose coarser classes are a pair (s1_id, cand_id, others). Of t about ``CELL`` rows meet in one place, and no pair of rows is shuffled.

    What meets is small beside what it makes, so Spark would have it meet in a few tasks: with more than one, ``tasks`` is their number.
    """
    counts = t.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("_cells"))
    at = ["_b", "_cell"]
    place = lambda df: df.repartition(tasks, *at) if tasks > 1 else df
    dealt = t.join(counts, "_b").withColumn("_cell", F.pmod(F.xxhash64(*t.columns), F.col("_cells"))).drop("_cells")
    cells = pairs.withColumnsRenamed({"s1_id": "_a", "cand_id": "_b"}).join(counts, "_b").withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1))).drop("_cells")
    return place(dealt).join(place(cells.join(s, "_a").drop("_a")), at).drop(*at)


def tasks_of(pairs: DataFrame, a: Classes, b: Classes) -> int:
    """How many tasks write out pairs of classes."""
    n = volume(pairs, a, b).agg(F.sum("_w")).first()[0] or 0
    return min(TASKS, 1 + n // TASK)
