"""Blocking routes: functions from (S1 entities, target entities) to distinct (s1_id, cand_id).

All join on country first, together with the route's key, so that both sides are
hash-partitioned by the full key. Token routes explode distinct keys, drop keys by their
document frequency before the join, and count shared keys by partial aggregation. Caps
are redefined to be deterministic: keys by ascending frequency, then targets by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import similarity as M
from linkloom.functions import text as T
from linkloom.operators.blocks import sharing
from linkloom.operators.classes import by_class
from linkloom.operators.sets import PAIR

CC = "country_cleaned"


def _keyed(df: DataFrame, key: Column, id_name: str) -> DataFrame:
    """(cc, key, id) of the rows with a country and a key."""
    return df.select(F.col(CC).alias("cc"), key.alias("key"), F.col("entity_id").alias(id_name)).where("cc <> '' and key is not null")


def _postings(df: DataFrame, keys: Column, id_name: str) -> DataFrame:
    return df.select(F.col(CC).alias("cc"), F.explode(F.array_distinct(keys)).alias("key"), F.col("entity_id").alias(id_name)).where("cc <> ''")


def by_country(s1: DataFrame, t: DataFrame) -> DataFrame:
    """Every target of the country. Its size is the product of the sides; ``country_volumes`` counts without it."""
    return _keyed(s1, F.lit(0), "s1_id").join(_keyed(t, F.lit(0), "cand_id"), ["cc", "key"]).select(*PAIR)


def country_volumes(s1: DataFrame, t: DataFrame) -> DataFrame:
    """(s1_id, candidates) of the country route, from one count a country."""
    counts = t.where(F.col(CC) != "").groupBy(CC).agg(F.count(F.lit(1)).alias("_n"))
    return s1.join(counts, CC, "left").select(F.col("entity_id").alias("s1_id"), F.coalesce("_n", F.lit(0)).alias("candidates"))


def true_country_pairs(s1: DataFrame, t: DataFrame, truth: DataFrame) -> DataFrame:
    """The known matches (s1_id, match_id) that the country route finds."""
    a = s1.select(F.col("entity_id").alias("s1_id"), F.col(CC).alias("cc")).where("cc <> ''")
    b = t.select(F.col("entity_id").alias("cand_id"), F.col(CC).alias("cc"))
    return truth.select("s1_id", F.col("match_id").alias("cand_id")).distinct().join(a, "s1_id").join(b, ["cand_id", "cc"]).select(*PAIR)


def exact(column: str):
    """Equal, non-empty values of a column."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        value = F.nullif(F.col(column), F.lit(""))
        return _keyed(s1, value, "s1_id").join(_keyed(t, value, "cand_id"), ["cc", "key"]).select(*PAIR).distinct()

    return run


def frequencies(postings: DataFrame) -> DataFrame:
    """(cc, key, df) of postings (cc, key, cand_id)."""
    return postings.groupBy("cc", "key").agg(F.count(F.lit(1)).alias("df"))


def token_postings(t: DataFrame) -> DataFrame:
    return _postings(t, F.col("name_tokens"), "cand_id")


def token_overlap(min_overlap: int = 1, min_df: int = 1, max_df: int | None = None):
    """At least so many shared name tokens, of tokens whose frequency among targets is in range."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        targets, probes = token_postings(t), _postings(s1, F.col("name_tokens"), "s1_id")
        if min_df > 1 or max_df is not None:
            kept = frequencies(targets).where((F.col("df") >= min_df) & (F.col("df") <= max_df if max_df is not None else F.lit(True))).select("cc", "key")
            targets, probes = targets.join(kept, ["cc", "key"], "left_semi"), probes.join(kept, ["cc", "key"], "left_semi")
        found = probes.join(targets, ["cc", "key"])
        if min_overlap <= 1:
            return found.select(*PAIR).distinct()
        return found.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_overlap).select(*PAIR)

    return run


def rare_tokens(max_frequency: int | None = None):
    """Any shared name token, but for those that occur more often among all targets, repeats and all countries counted."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        probes, targets = _postings(s1, F.col("name_tokens"), "s1_id"), token_postings(t)
        if max_frequency is not None:
            often = t.select(F.explode("name_tokens").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_frequency).select("key")
            probes = probes.join(often, "key", "left_anti")
        return probes.join(targets, ["cc", "key"]).select(*PAIR).distinct()

    return run


def ngram_top(n: int, k: int):
    """The k best targets by n-gram overlap of the padded accent-free name, with rank and score.

    Ubiquitous grams (over min(1000, max(50, 1 % of the targets)) postings in a country) don't
    count as shared but do in the sizes. Two shared grams are needed, one for short names.
    """

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        grams = T.padded_grams(F.col("name_no_accents"), n)
        gram_sets = lambda df, i: df.select(F.col(CC).alias("cc"), F.col("entity_id").alias(i), grams.alias("_grams"))
        sized = lambda df, i: gram_sets(df, i).select("cc", i, F.size("_grams").alias(f"{i}_size"), F.explode("_grams").alias("key"))
        probes, targets = sized(s1, "s1_id"), sized(t, "cand_id")
        total = t.agg(F.count(F.lit(1)).alias("_total"))
        limit = F.least(F.lit(1000), F.greatest(F.lit(50), F.floor(F.col("_total") * 0.01)))
        kept = frequencies(targets).crossJoin(F.broadcast(total)).where(F.col("df") <= limit).select("cc", "key")  # one row of totals
        shared = probes.join(targets.join(kept, ["cc", "key"], "left_semi"), ["cc", "key"]).groupBy("s1_id", "cand_id", "s1_id_size", "cand_id_size").agg(F.count(F.lit(1)).alias("inter"))
        shared = shared.where(F.col("inter") >= F.when(F.col("s1_id_size") >= 4, 2).otherwise(1))
        scored = shared.withColumn("score", M.gram_score(F.col("inter"), F.col("s1_id_size"), F.col("cand_id_size")))
        best = F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
        return scored.withColumn("rank", best).where(F.col("rank") <= k).select(*PAIR, "rank", "score")

    return run


def _capped(found: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` candidates of each probe by (key_rank, cand_id) of their first key."""
    first = found.groupBy(*PAIR).agg(F.min("key_rank").alias("key_rank"))
    return first.withColumn("_r", F.row_number().over(W.partitionBy("s1_id").orderBy("key_rank", "cand_id"))).where(F.col("_r") <= cap).select(*PAIR)


def _first_of_each_key(postings: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` candidates, by id, of each (cc, key); tasks cut their own share before the shuffle."""
    order = W.partitionBy("cc", "key").orderBy("cand_id")
    return postings.withColumn("_p", F.dense_rank().over(order)).where(F.col("_p") <= cap).drop("_p")


def _capped_join(probes: DataFrame, postings: DataFrame, cap: int) -> DataFrame:
    """``_capped`` of the join of ranked probes (with the key's ``df``) and postings, without the whole join.

    Ranks follow df, so the keys before one of a probe lead to at least ``_last`` (the df of
    the one before) candidates: once that reaches the cap, later keys add none. And of any
    key the first ``cap`` candidates are enough, since those already found are fewer.
    """
    last = F.lag("df").over(W.partitionBy("s1_id").orderBy("key_rank"))
    needed = probes.withColumn("_last", last).where(F.coalesce("_last", F.lit(0)) < cap)
    return _capped(needed.join(_first_of_each_key(postings, cap), ["cc", "key"]), cap)


def _ranked_probes(s1: DataFrame, t: DataFrame, column: str, low: int, high: int, missing: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Probe postings with key_rank, and the indexed target postings.

    Keys are ranked by frequency, then by themselves. ``missing``: the frequency that
    unindexed keys rank with (0: first); None ranks indexed keys alone.
    """
    targets = _postings(t, F.col(column), "cand_id")
    df = frequencies(targets)
    indexed = df.where(F.col("df").between(low, high))
    probes = _postings(s1, F.col(column), "s1_id")
    probes = probes.join(indexed, ["cc", "key"]) if missing is None else probes.join(indexed, ["cc", "key"], "left").withColumn("df", F.coalesce("df", F.lit(missing)))
    probes = probes.withColumn("key_rank", F.row_number().over(W.partitionBy("s1_id").orderBy("df", "key")))
    return probes, targets.join(indexed.select("cc", "key"), ["cc", "key"], "left_semi")


def shared_address_words(low: int = 2, high: int = 3000, cap: int | None = 200):
    """Any shared address word of middling frequency, rarest words first, up to a cap."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        probes, targets = _ranked_probes(s1, t, "addr_words", low, high)
        return _capped_join(probes, targets, cap) if cap else probes.join(targets, ["cc", "key"]).select(*PAIR).distinct()

    return run


def _numeric_counts(s1: DataFrame, t: DataFrame, max_df: int) -> DataFrame:
    probes, targets = _postings(s1, F.col("numeric_set"), "s1_id"), _postings(t, F.col("numeric_set"), "cand_id")
    kept = frequencies(targets).where(F.col("df") <= max_df).select("cc", "key")
    return probes.join(targets.join(kept, ["cc", "key"], "left_semi"), ["cc", "key"]).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))


def numeric_any(max_df: int = 5000, cap: int | None = 200):
    """Any shared number."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        probes, targets = _ranked_probes(s1, t, "numeric_set", 1, max_df)
        return _capped_join(probes, targets, cap) if cap else probes.join(targets, ["cc", "key"]).select(*PAIR).distinct()

    return run


def numeric_all(max_df: int = 5000):
    """Every number of the S1 address (each of them indexed) in the target's."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        sizes = s1.select(F.col("entity_id").alias("s1_id"), F.size("numeric_set").alias("_size"))
        return _numeric_counts(s1, t, max_df).join(sizes, "s1_id").where("n = _size").select(*PAIR)

    return run


def numeric_count(least: int = 2, max_df: int = 5000):
    """At least so many shared indexed numbers."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        return _numeric_counts(s1, t, max_df).where(F.col("n") >= least).select(*PAIR)

    return run


def _with_arrays(pairs: DataFrame, s1: DataFrame, t: DataFrame, column: str) -> DataFrame:
    side = lambda df, i: df.select(F.col("entity_id").alias(i), F.array_distinct(F.col(column)).alias(f"{i}_set"))
    return pairs.join(side(s1, "s1_id"), "s1_id").join(side(t, "cand_id"), "cand_id")


def _similar(pairs: DataFrame, s1: DataFrame, t: DataFrame, column: str, least: float, shared: int, cap: int | None) -> DataFrame:
    both = _with_arrays(pairs, s1, t, column)
    a, b = F.col("s1_id_set"), F.col("cand_id_set")
    good = both.where((M.common(a, b) >= shared) & (M.jaccard(a, b) >= least)).select(*PAIR)
    return _capped(good.withColumn("key_rank", F.lit(0)), cap) if cap else good


def numeric_jaccard(least: float = 0.5, max_df: int = 5000, cap: int | None = 100):
    """Number sets at least so similar, among the pairs of ``numeric_all`` and ``numeric_count`` (other pairs are missed, as documented)."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        pool = numeric_all(max_df)(s1, t).union(numeric_count(2, max_df)(s1, t)).distinct()
        return _similar(pool, s1, t, "numeric_set", least, 1, cap)

    return run


def numeric_equal(s1: DataFrame, t: DataFrame) -> DataFrame:
    """Equal, non-empty number sets."""
    value = F.when(F.size("numeric_set") > 0, F.col("numeric_set"))
    return _keyed(s1, value, "s1_id").join(_keyed(t, value, "cand_id"), ["cc", "key"]).select(*PAIR).distinct()


def equal_field(column: str, cap: int | None = None):
    """Equal non-null values of a column, up to a cap."""

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        targets = _keyed(t, F.col(column), "cand_id")
        targets = _first_of_each_key(targets, cap) if cap else targets  # a probe has one key, so this is its cap
        return _keyed(s1, F.col(column), "s1_id").join(targets, ["cc", "key"]).select(*PAIR).distinct()

    return run


def probe_similar(column: str, probes: int, low: int, high: int, least: float, shared: int, mode: str = "fixed", pool: int = 150, cap: int = 100, min_keys: int = 1):
    """The pool of the rarest keys' postings, filtered by set similarity.

    ``strict`` lets unindexed keys take the first probe places, as if their frequency were
    0; ``fixed`` probes indexed keys only.
    """

    def run(s1: DataFrame, t: DataFrame) -> DataFrame:
        some = s1.where(F.size(F.array_distinct(F.col(column))) >= min_keys)
        ranked, targets = _ranked_probes(some, t, column, low, high, 0 if mode == "strict" else None)
        found = _capped_join(ranked.where(F.col("key_rank") <= probes), targets, pool)
        return _similar(found, s1, t, column, least, shared, cap)

    return run


def address_trigrams(mode: str = "fixed"):
    return probe_similar("char_3grams", 3, 2, 2000, 0.35, 3, mode, min_keys=3)


def address_similarity(mode: str = "fixed"):
    return probe_similar("addr_words", 2, 2, 2500, 0.30, 1, mode)


#: Name of each route with its function.
ROUTES = {
    "country_only": by_country,
    "country_name_cleaned": by_class(exact("name_cleaned"), "name_cleaned"),
    "country_name_alphanumeric": by_class(exact("name_alphanumeric"), "name_alphanumeric"),
    "country_name_no_accents": by_class(exact("name_no_accents"), "name_no_accents"),
    "token_overlap_1": by_class(token_overlap(1), "name_tokens"),
    "token_overlap_2": by_class(token_overlap(2), "name_tokens", written=sharing("name_tokens", 2, token_overlap(2))),
    "token_overlap_1_maxdf1k": token_overlap(1, 1, 1000),
    "token_overlap_2_maxdf5k": token_overlap(2, 1, 5000),
    "token_overlap_2_maxdf20k": token_overlap(2, 1, 20000),
    "shared_name_tokens": by_class(rare_tokens(), "name_tokens"),
    "rare_tokens_500": rare_tokens(500),
    "rare_tokens_100": rare_tokens(100),
    **{f"name_{n}gram_top{k}": ngram_top(n, k) for n in (2, 3, 4) for k in (5, 10, 20, 50)},
    "addr_cleaned": by_class(exact("addr_cleaned"), "addr_cleaned"),
    "addr_alphanumeric": by_class(exact("addr_alphanumeric"), "addr_alphanumeric"),
    "addr_words": shared_address_words(),
    "numeric_any": numeric_any(),
    "numeric_all": numeric_all(),
    "numeric_count2": numeric_count(2),
    "numeric_jaccard": numeric_jaccard(),
    "numeric_equal": numeric_equal,
    "house_number": equal_field("house_number", 200),
    "postal_code": by_class(equal_field("postal_code"), "postal_code"),
    "addr_trigrams": address_trigrams(),
    "addr_trigrams_strict": address_trigrams("strict"),
    "addr_similarity": address_similarity(),
    "addr_similarity_strict": address_similarity("strict"),
}
