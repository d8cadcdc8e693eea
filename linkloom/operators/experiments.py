"""Normalization experiments: how transforms change the similarity of matched and unmatched pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import similarity as M
from linkloom.functions import text as T
from linkloom.operators.classes import classed, known_pairs
from linkloom.plans.entities import stored

BASELINE = "A_current"
#: Most non-matches that an experiment draws.
MOST_NEGATIVES = 50_000


def matched_pairs(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """Raw fields of both sides of every known match."""
    side = lambda df, p, key: df.select(F.col("entity_id").alias(key), *[F.coalesce(c, F.lit("")).alias(f"{p}_{c}") for c in ("business_name", "business_address", "country")])
    return truth.select("s1_id", "match_id").distinct().join(side(s1, "a", "s1_id"), "s1_id").join(side(targets, "b", "match_id"), "match_id")


#: The raw fields of both sides that a field's transforms read.
READ = {"name": ["a_business_name", "b_business_name"], "address": ["a_business_address", "a_country", "b_business_address", "b_country"]}


def matched_classes(s1: DataFrame, targets: DataFrame, field: str, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched pairs by classes, where known matches are equal keys: both sides' classes by what a field's transforms read and the key, and their pairs.

    A pair (s1_id, cand_id) of classes has a row for each two of their fields, ``n`` as
    often among matched pairs and ``_each`` times for any two of their members.
    """

    def side(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        fields = [c.removeprefix(f"{p}_") for c in READ[field] if c.startswith(f"{p}_")]
        marked = classed(df.select("entity_id", *[F.coalesce(c, F.lit("")).alias(f"{p}_{c}") for c in fields], *key), [*[f"{p}_{c}" for c in fields], *key])
        rows = marked.groupBy(F.col("class").alias(f"{p}_id"), "own", *[f"{p}_{c}" for c in fields]).agg(F.count(F.lit(1)).alias(f"{p}_n"))  # an id of several rows counts with each
        return marked, rows.withColumn(f"{p}_each", F.when(F.col("own"), F.col(f"{p}_n")).otherwise(1)).drop("own")

    (a, x), (b, y) = side(s1, "a"), side(targets, "b")
    keys = lambda df: df.select(F.col("class").alias("entity_id"), *key)
    known = known_pairs(keys(a), keys(b), key).withColumnsRenamed({"s1_id": "a_id", "cand_id": "b_id"})
    pairs = known.join(x, "a_id").join(y, "b_id")
    return a, b, pairs.select(F.col("a_id").alias("s1_id"), F.col("b_id").alias("cand_id"), *READ[field], (F.col("a_n") * F.col("b_n")).alias("n"), (F.col("a_each") * F.col("b_each")).alias("_each"))


def dealt(rows: DataFrame) -> DataFrame:
    """Few rows that cost much each, dealt out to all cores."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def counted_classes(pairs: DataFrame, field: str) -> DataFrame:
    """``counted`` of ``matched_classes``."""
    return dealt(pairs.groupBy(*READ[field]).agg(F.sum("n").alias("n")))


def counted(pairs: DataFrame, field: str) -> DataFrame:
    """What a field's transforms read, once, with the number n of pairs that have it."""
    return pairs.groupBy(*READ[field]).agg(F.count(F.lit(1)).alias("n"))


def _digest(c: Column, seed: int) -> Column:
    """52 bits of an md5, the same in any SQL engine; computed once for each entity, not for pairs."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", c, F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("long")


def hard_negatives(s1: DataFrame, targets: DataFrame, truth: DataFrame, n: int | None = None, seed: int = 42, buckets: int = 64, cell: int = 16) -> DataFrame:
    """At most n non-matches, one for an S1 entity, of the same country: the pairs of least hash.

    The n entities of least hash that have a non-match draw from the targets of one hash
    bucket of their country. Those whose bucket holds no non-match draw from the country's
    first targets by hash, one more than the most matches of an entity: one of those is no
    match unless the country has no other. A pair's hash is the exclusive or of its
    entities'. Without n, the least of ``MOST_NEGATIVES`` and the number of true pairs.

    The least pair shares the longest beginning of the hash, so an entity first meets only
    the targets that begin like it, about ``cell`` of them, and the whole bucket only where
    these hold no non-match. Entities are chosen before they meet targets, which are then
    scanned in place beside at most n entities.
    """
    pairs = truth.select("s1_id", "match_id").distinct()
    ids = lambda df, i: df.select(F.col("entity_id").alias(i)).distinct().withColumn(f"_{i}", F.lit(1))
    known = pairs.join(ids(targets, "match_id"), "match_id", "left").join(ids(s1, "s1_id"), "s1_id", "left")  # by s1_id last, so that counting meets no shuffle
    matches = known.groupBy("s1_id").agg(F.count(F.lit(1)).alias("_n"), F.count(F.col("_match_id") + F.col("_s1_id")).alias("_true"))
    most, true = (x or 0 for x in matches.agg(F.max("_n"), F.sum("_true")).first())  # literals, so that Spark cuts before it sorts a country
    if n is None:
        n = min(MOST_NEGATIVES, true)
    a = s1.where("country_cleaned <> ''").select(F.col("entity_id").alias("s1_id"), F.col("country_cleaned").alias("cc"), _digest(F.col("entity_id"), seed).alias("_ha"))
    b = targets.select(F.col("entity_id").alias("match_id"), F.col("country_cleaned").alias("cc"), _digest(F.col("entity_id"), seed).alias("_hb"))
    few = b.withColumn("_r", F.dense_rank().over(W.partitionBy("cc").orderBy("_hb", "match_id"))).where(F.col("_r") <= most + 1).select("match_id", "cc", "_hb").distinct()
    own = pairs.join(few.select("match_id", "cc"), "match_id").groupBy("s1_id", "cc").agg(F.count(F.lit(1)).alias("_own"))
    able = a.join(few.groupBy("cc").agg(F.count(F.lit(1)).alias("_few")), "cc").join(own, ["s1_id", "cc"], "left").where(F.col("_few") > F.coalesce("_own", F.lit(0)))
    chosen = able.groupBy("s1_id").agg(F.min("_ha").alias("_ha"), F.collect_set("cc").alias("_cc")).orderBy("_ha", "s1_id").limit(n)
    chosen = stored(chosen.select("s1_id", "_ha", F.explode("_cc").alias("cc")).withColumn("_b", F.col("_ha") % buckets))
    small = F.broadcast if n <= MOST_NEGATIVES else lambda x: x
    counts = b.join(small(chosen.select("cc").distinct()), "cc", "left_semi").groupBy("cc").agg(F.count(F.lit(1)).alias("_n"))
    bits = stored(counts.select("cc", F.greatest(F.lit(0), F.floor(F.log2(F.col("_n") / (buckets * cell)))).cast("int").alias("_bits")))
    begin = lambda h: F.expr(f"shiftright({h}, 52 - _bits)").alias("_cell")
    b = b.withColumn("_b", F.col("_hb") % buckets)
    order = F.struct(F.col("_ha").bitwiseXOR(F.col("_hb")), "match_id")

    def drawn(candidates: DataFrame) -> DataFrame:
        return candidates.join(pairs, ["s1_id", "match_id"], "left_anti").groupBy("s1_id").agg(F.min_by("match_id", order).alias("match_id"), F.min("_ha").alias("_ha"))

    def left(*found: DataFrame) -> DataFrame:
        return reduce(lambda x, y: x.join(y, "s1_id", "left_anti"), found, chosen)

    near = stored(drawn(b.join(small(bits), "cc").select("match_id", "cc", "_hb", "_b", begin("_hb")).join(small(chosen.join(bits, "cc").select("s1_id", "_ha", "cc", "_b", begin("_ha"))), ["cc", "_b", "_cell"])))
    far = stored(drawn(b.join(small(left(near)), ["cc", "_b"])))
    rest = drawn(left(near, far).join(few, "cc"))
    return near.unionByName(far).unionByName(rest).orderBy("_ha", "s1_id").select("s1_id", "match_id")


def _scores(a: Column, b: Column, numbers: bool) -> dict[str, Column]:
    out = {"jaccard": M.token_jaccard(a, b), "dice": M.dice(a, b), "exact": M.exact(a, b)}
    return out | ({"numeric": M.numeric_overlap(a, b)} if numbers else {})


def scored(pairs: DataFrame, field: str) -> DataFrame:
    """Long rows (experiment, metric, score, baseline) for every transform of a field, after s1_id and match_id or, of ``counted`` pairs, what was read and n."""
    own = ["s1_id", "match_id"] if "n" not in pairs.columns else [*READ[field], "n"]
    if field == "name":
        a, b = T.name_transforms(F.col("a_business_name")), T.name_transforms(F.col("b_business_name"))
    else:
        a, b = T.address_transforms(F.col("a_business_address"), F.col("a_country")), T.address_transforms(F.col("b_business_address"), F.col("b_country"))
    wide = pairs.select(*own, *[c.alias(f"a_{k}") for k, c in a.items()], *[c.alias(f"b_{k}") for k, c in b.items()])
    scores = {k: _scores(F.col(f"a_{k}"), F.col(f"b_{k}"), field == "address") for k in a}
    once = wide.select(*own, *[c.alias(f"{k}_{m}") for k, by in scores.items() for m, c in by.items()])
    cells = [F.struct(F.lit(k).alias("experiment"), F.lit(m).alias("metric"), F.col(f"{k}_{m}").alias("score"), F.col(f"{BASELINE}_{m}").alias("baseline")) for k, by in scores.items() for m in by]
    return once.select(*own, F.explode(F.array(*cells)).alias("_c")).select(*own, "_c.*")


def statistics(rows: DataFrame) -> DataFrame:
    """Per experiment and metric: pairs, mean, median, percentages exact, improved, worse, unchanged. A row counts n times if it has n."""
    n = F.col("n") if "n" in rows.columns else F.lit(1).cast("long")
    mean = lambda c: F.sum(c.cast("double") * n) / F.sum(n)
    gain = F.col("score") - F.col("baseline")
    return rows.groupBy("experiment", "metric").agg(
        F.sum(n).alias("pairs"),
        mean(F.col("score")).alias("mean_score"),
        F.percentile("score", 0.5, n).alias("median_score"),
        (100.0 * mean(F.col("score") >= 0.9999)).alias("exact_pct"),
        (100.0 * mean(gain > 1e-9)).alias("improved_pct"),
        (100.0 * mean(gain < -1e-9)).alias("worse_pct"),
        (100.0 * mean(F.abs(gain) <= 1e-9)).alias("unchanged_pct"),
    )


def discrimination(true_stats: DataFrame, negative_stats: DataFrame) -> DataFrame:
    """Gap between the means on matches and non-matches, and whether it beats the baseline's by 0.001."""
    name = lambda df, c: df.select("experiment", "metric", F.col("mean_score").alias(c))
    gaps = name(true_stats, "true_mean").join(name(negative_stats, "negative_mean"), ["experiment", "metric"]).withColumn("gap", F.col("true_mean") - F.col("negative_mean"))
    base = gaps.where(F.col("experiment") == BASELINE).select("metric", F.col("gap").alias("_base"))
    change = F.col("gap") - F.col("_base")
    return gaps.join(base, "metric").select("experiment", "metric", "true_mean", "negative_mean", "gap", F.when(change > 0.001, "better").when(change < -0.001, "worse").otherwise("same").alias("verdict"))


def examples(rows: DataFrame, metric: str = "jaccard", by: float = 0.05, limit: int = 10) -> DataFrame:
    """The first pairs that each transform helps or hurts by more than ``by``."""
    gain = F.col("score") - F.col("baseline")
    kind = F.when(gain > by, "help").when(gain < -by, "hurt")
    first = F.row_number().over(W.partitionBy("experiment", "kind").orderBy("s1_id", "match_id"))
    return rows.where(F.col("metric") == metric).withColumn("kind", kind).where("kind is not null").withColumn("_r", first).where(F.col("_r") <= limit).select("experiment", "kind", "s1_id", "match_id", gain.alias("gain"))


def _least(marked: DataFrame, name: str, limit: int) -> DataFrame:
    """(class, name): the least ids of each class."""
    order = F.row_number().over(W.partitionBy("class").orderBy("entity_id"))
    return marked.select("class", "entity_id").distinct().withColumn("_r", order).where(F.col("_r") <= limit).select("class", F.col("entity_id").alias(name))


def examples_of(s1: DataFrame, targets: DataFrame, field: str, key: list[str], metric: str = "jaccard", by: float = 0.05, limit: int = 10) -> DataFrame:
    """``examples`` of matched pairs where known matches are equal keys, scored once a pair of classes.

    The first pairs of a kind are of its ``limit`` least S1 ids, and of each class the least ids are enough.
    """
    a, b, pairs = matched_classes(s1, targets, field, key)
    pairs = stored(pairs)
    scores = scored(counted_classes(pairs, field), field).where((F.col("metric") == metric) & (F.abs(F.col("score") - F.col("baseline")) > by)).drop("n")
    changed = stored(pairs.drop("n").join(scores, READ[field]).withColumn("_helps", F.col("score") > F.col("baseline")).drop(*READ[field]))
    kinds = changed.select("experiment", "_helps", F.col("s1_id").alias("class")).distinct().join(_least(a, "_s1", limit), "class")
    first = kinds.withColumn("_r", F.dense_rank().over(W.partitionBy("experiment", "_helps").orderBy("_s1"))).where(F.col("_r") <= limit)
    found = changed.join(first.withColumnRenamed("class", "s1_id").drop("_r"), ["experiment", "_helps", "s1_id"]).withColumnRenamed("cand_id", "class").join(_least(b, "match_id", limit), "class")
    rows = found.select(F.col("_s1").alias("s1_id"), "match_id", "experiment", "metric", "score", "baseline", F.explode(F.expr("sequence(1L, _each)")).alias("_i")).drop("_i")
    return examples(rows, metric, by, limit)


def country_consistency(pairs: DataFrame) -> DataFrame:
    raw = F.col("a_country") == F.col("b_country")
    clean = F.lower(F.trim("a_country")) == F.lower(F.trim("b_country"))
    n = F.count(F.lit(1))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return pairs.agg(n.alias("pairs"), count(raw).alias("raw_equal"), count(clean).alias("normalized_equal"), F.when(n > 0, F.round(100.0 * count(clean) / n, 2)).otherwise(0.0).alias("normalized_pct"))
