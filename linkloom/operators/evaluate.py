"""Evaluation of blocking routes: recall, coverage, candidate volumes, contributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.sets import PAIR, candidate_union, tagged


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def pick(counts: DataFrame, column: str, places: dict[str, Column]) -> DataFrame:
    """One row of the values at given 0-based places of the ascending order.

    ``places`` are functions of the number of rows ``_n``. Values are counted first, so
    the running sum that locates a place is over distinct values, not rows.
    """
    by_value = counts.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    total = by_value.agg(F.sum("_c").alias("_n"))
    upto = by_value.withColumn("_upto", F.sum("_c").over(W.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    return upto.agg(*[F.min(F.when(F.col("_upto") > place, F.col("_v"))).alias(name) for name, place in places.items()])


def nearest_rank(p: float) -> Column:
    """Place min(int(n * p), n - 1)."""
    return F.least(F.floor(F.col("_n") * p), F.col("_n") - 1)


def lower_rank(p: float) -> Column:
    """Place int(p * (n - 1))."""
    return F.floor(F.lit(p) * (F.col("_n") - 1))


def quantiles(counts: DataFrame, column: str, p: float = 0.95) -> DataFrame:
    """The three readings of a quantile that the evaluations use, in one row."""
    ranks = pick(counts, column, {"nearest_rank": nearest_rank(p), "lower_rank": lower_rank(p)})
    return ranks.crossJoin(counts.agg(F.expr(f"percentile({column}, {p})").alias("interpolated")))


def candidate_counts(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, candidates) of every S1 entity, those without candidates too."""
    counts = pairs.select(*PAIR).distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("candidates"))
    return s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select("s1_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def volumes(counts: DataFrame) -> DataFrame:
    """Average, median, 95th percentile (nearest rank) and maximum of candidates."""
    stats = counts.agg(F.avg("candidates").alias("avg_candidates"), F.median("candidates").alias("median_candidates"), F.max("candidates").alias("max_candidates"))
    return stats.crossJoin(pick(counts, "candidates", {"p95_candidates": nearest_rank(0.95)}))


def true_hits(s1: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, match_id, hit) of the distinct known matches of S1 entities: hit is 1 if the pairs hold it."""
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    gt = truth.select("s1_id", "match_id").distinct().join(ids, "s1_id", "left_semi")
    found = pairs.select("s1_id", F.col("cand_id").alias("match_id")).distinct().withColumn("hit", F.lit(1))
    return gt.join(found, ["s1_id", "match_id"], "left").select("s1_id", "match_id", F.coalesce("hit", F.lit(0)).alias("hit"))


def evaluate(name: str, s1: DataFrame, truth: DataFrame, pairs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row: totals and recalls by source, full coverage, and candidate volumes.

    ``truth`` is (s1_id, match_id). Truth of other prefixes than S2 and S3 isn't counted.
    ``counts``: (s1_id, candidates), where they are known without the pairs; of the pairs
    only the true ones are needed then.
    """
    return rated(name, true_hits(s1, truth.where("match_id rlike '^S[23]-'"), pairs), candidate_counts(s1, pairs) if counts is None else counts)


def rated(name: str, hits: DataFrame, counts: DataFrame) -> DataFrame:
    """``evaluate`` from the known matches of S2 and S3, each found or not, and the candidates of each S1 entity."""
    hits = hits.select("s1_id", F.substring("match_id", 1, 2).alias("src"), "hit")
    n = lambda src, c=None: F.coalesce(F.sum(F.when(F.col("src") == src, F.lit(1) if c is None else F.col(c)).otherwise(0)), F.lit(0)).cast("long")
    per = hits.groupBy("s1_id").agg(n("S2").alias("t2"), n("S3").alias("t3"), n("S2", "hit").alias("h2"), n("S3", "hit").alias("h3"))
    total = per.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("t2", "true_s2"), ("t3", "true_s3"), ("h2", "retrieved_s2"), ("h3", "retrieved_s3"))],
        F.count(F.lit(1)).alias("s1_with_truth"),
        F.coalesce(F.sum((F.col("t2") + F.col("t3") == F.col("h2") + F.col("h3")).cast("long")), F.lit(0)).alias("s1_covered"),
    )
    rates = total.select(
        F.lit(name).alias("route"),
        "true_s2",
        "true_s3",
        "retrieved_s2",
        "retrieved_s3",
        _ratio(F.col("retrieved_s2") + F.col("retrieved_s3"), F.col("true_s2") + F.col("true_s3")).alias("recall"),
        _ratio(F.col("retrieved_s2"), F.col("true_s2")).alias("recall_s2"),
        _ratio(F.col("retrieved_s3"), F.col("true_s3")).alias("recall_s3"),
        _ratio(F.col("s1_covered"), F.col("s1_with_truth")).alias("full_coverage"),
    )
    return rates.crossJoin(volumes(counts))  # two frames of one row


def country_matches(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """Matched pairs with a known target, and how many agree on the country."""
    a = s1.select(F.col("entity_id").alias("s1_id"), F.col("country_cleaned").alias("_a"))
    b = targets.select(F.col("entity_id").alias("match_id"), F.col("country_cleaned").alias("_b"))
    both = truth.join(a, "s1_id").join(b, "match_id")
    same = F.col("_a") == F.col("_b")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(same.cast("long")), F.lit(0)).alias("same_country"), F.coalesce(F.sum((~same).cast("long")), F.lit(0)).alias("different_country"))


def country_mismatches(s1: DataFrame, targets: DataFrame, truth: DataFrame, limit: int = 20) -> DataFrame:
    """The first examples of matched pairs with different countries."""
    a = s1.select(F.col("entity_id").alias("s1_id"), F.col("country_cleaned").alias("s1_country"))
    b = targets.select(F.col("entity_id").alias("match_id"), F.col("country_cleaned").alias("match_country"))
    return truth.join(a, "s1_id").join(b, "match_id").where("s1_country <> match_country").orderBy("s1_id", "match_id").limit(limit).select("s1_id", "match_id", "s1_country", "match_country")


def common_names(targets: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent (country, name) with an example id, S2 before S3."""
    named = targets.where("name_cleaned <> ''").groupBy(F.col("country_cleaned").alias("cc"), "name_cleaned").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("example_id"))
    return named.orderBy(F.desc("n"), "cc", "name_cleaned").limit(top)


def frequency_statistics(df: DataFrame) -> DataFrame:
    """Keys, median, 90th, 95th and 99th percentiles (nearest rank), maximum and total of (key, df)."""
    ranks = pick(df, "df", {f"p{int(p * 100)}": nearest_rank(p) for p in (0.9, 0.95, 0.99)})
    return df.agg(F.count(F.lit(1)).alias("keys"), F.median("df").alias("median_df"), F.max("df").alias("max_df"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings")).crossJoin(ranks)


def top_keys(df: DataFrame, top: int = 30) -> DataFrame:
    return df.orderBy(F.desc("df"), "cc", "key").limit(top)


def _known(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.col("match_id").alias("cand_id")).distinct().withColumn("n", F.lit(1))


def _true_lists(routes: list[tuple[str, DataFrame]], known: DataFrame) -> DataFrame:
    """(s1_id, cand_id, n, _ords): known pairs with the routes that find them, at most the routes given; each is computed once."""
    rows = reduce(DataFrame.unionByName, [tagged(n, i, f) for i, (n, f) in enumerate(routes)])
    return rows.join(known, PAIR).groupBy(*PAIR).agg(F.max("n").alias("n"), F.sort_array(F.collect_set("ord")).alias("_ords"))


def _size(truth: DataFrame) -> DataFrame:
    """One row: the number of known matches (_gt), before removing repeats."""
    return truth.agg(F.count(F.lit(1)).alias("_gt"))


def route_contribution(routes: list[tuple[str, DataFrame]], truth: DataFrame, known: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """Per route: true pairs found, those found by no other, shared ones, those first found by it, recall.

    ``known``: distinct (s1_id, cand_id, n) where routes hold pairs of classes; n true pairs are of one pair of classes.
    ``size``: the number of rows of ``truth`` (_gt), where it is known without them.
    """
    names = truth.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(routes)], "route string, ord int")
    lists = _true_lists(routes, _known(truth) if known is None else known)
    marked = lists.select("n", F.explode("_ords").alias("ord"), F.size("_ords").alias("_routes"), F.array_min("_ords").alias("_first"))
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per = marked.groupBy("ord").agg(F.sum("n").alias("total"), some(F.col("_routes") == 1).alias("unique_pairs"), some(F.col("ord") == F.col("_first")).alias("marginal"))
    size = _size(truth) if size is None else size
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return names.join(F.broadcast(per), "ord", "left").crossJoin(F.broadcast(size)).select(
        "route", zero("total").alias("total"), zero("unique_pairs").alias("unique_pairs"), zero(F.col("total") - F.col("unique_pairs")).alias("shared_pairs"), zero("marginal").alias("marginal"), _ratio(zero("total"), F.col("_gt")).alias("recall")
    )


def union_contribution(routes: list[tuple[str, DataFrame]], truth: DataFrame, known: DataFrame | None = None, volume: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """One row: true pairs, those that any route found, recall of the union, and its candidates.

    ``known`` and ``size`` as in ``route_contribution``; ``volume``: the union's candidate_pairs, where the routes hold known pairs alone.
    """
    union = candidate_union([f for _, f in routes])
    found = union.join(_known(truth) if known is None else known, PAIR, "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("retrieved"), F.count(F.lit(1)).alias("_pairs"))
    found = found.withColumnRenamed("_pairs", "candidate_pairs") if volume is None else found.drop("_pairs").crossJoin(volume)
    sizes = (_size(truth) if size is None else size).withColumnRenamed("_gt", "total_gt")
    return sizes.crossJoin(found).select("total_gt", "retrieved", _ratio(F.col("retrieved"), F.col("total_gt")).alias("recall"), "candidate_pairs")


def route_overlap(routes: list[tuple[str, DataFrame]], truth: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(route_a, route_b, shared true pairs) for every two routes in order, none shared too."""
    names = truth.sparkSession.createDataFrame([(a, b, i, j) for i, (a, _) in enumerate(routes) for j, (b, _) in enumerate(routes) if i < j], "route_a string, route_b string, _i int, _j int")
    lists = _true_lists(routes, _known(truth) if known is None else known)
    both = lists.select("n", F.explode("_ords").alias("_i"), "_ords").select("n", "_i", F.explode("_ords").alias("_j")).where("_i < _j").groupBy("_i", "_j").agg(F.sum("n").alias("_n"))
    return names.join(F.broadcast(both), ["_i", "_j"], "left").select("route_a", "route_b", F.coalesce("_n", F.lit(0)).alias("shared"))


def macro_f_half(s1: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Macro F0.5 over S1: an entity without truth scores 1 if nothing is predicted for it, else 0."""
    gt = truth.select("s1_id", F.col("match_id").alias("cand_id")).distinct().withColumn("_t", F.lit(1))
    said = predicted.select(*PAIR).distinct().withColumn("_p", F.lit(1))
    per = gt.join(said, PAIR, "full_outer").groupBy("s1_id").agg(F.count("_t").alias("t"), F.count("_p").alias("p"), F.sum((F.col("_t").isNotNull() & F.col("_p").isNotNull()).cast("long")).alias("tp"))
    every = s1.select(F.col("entity_id").alias("s1_id")).join(per, "s1_id", "left").na.fill(0, ["t", "p", "tp"])
    precision, recall = _ratio(F.col("tp"), F.col("p")), _ratio(F.col("tp"), F.col("t"))
    score = F.when(F.col("t") == 0, (F.col("p") == 0).cast("double")).when(F.col("tp") == 0, F.lit(0.0)).otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    return every.agg(F.avg(score).alias("macro_f_half"), F.count(F.lit(1)).alias("entities"))
