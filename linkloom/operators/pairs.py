"""The 31 features of a candidate pair, as one projection over two joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as M
from linkloom.functions import text as T

#: What the features read.
FIELDS = ["name_cleaned", "name_alphanumeric", "addr_cleaned", "addr_alphanumeric", "country_cleaned"]

#: About so many ids are in one list of members: what a pair of lists writes out is wide.
LIST = 64

#: Feature names in the order of the vector.
FEATURES = (
    "name_exact_cleaned name_exact_alphanumeric name_token_intersection_count name_token_jaccard name_token_containment_s1 name_token_containment_cand "
    "name_length_ratio name_char_jaccard name_token_count_diff addr_exact_cleaned addr_exact_alphanumeric addr_token_intersection_count addr_token_jaccard "
    "addr_token_containment_s1 addr_token_containment_cand addr_numeric_intersection_count addr_numeric_jaccard addr_length_ratio addr_token_count_diff "
    "country_exact_match name_and_addr_exact strong_name_weak_addr weak_name_strong_addr s1_name_missing s1_addr_missing cand_name_missing cand_addr_missing "
    "s1_name_token_count s1_addr_token_count cand_name_token_count cand_addr_token_count"
).split()


def _side(entities: DataFrame, name: str) -> DataFrame:
    """A side's fields with its word lists and sets, computed once for each entity."""
    rows = entities.select(F.col("entity_id").alias(f"{name}_id"), *[F.coalesce(c, F.lit("")).alias(f"{name}_{c}") for c in FIELDS])
    for part in ("name", "addr"):
        words = T.tokens(F.col(f"{name}_{part}_alphanumeric"))
        rows = rows.withColumn(f"{name}_{part}_n", F.size(words)).withColumn(f"{name}_{part}_set", F.array_distinct(words))
    return rows.withColumns({f"{name}_numbers_set": T.numeric(F.col(f"{name}_addr_set")), f"{name}_chars_set": M.characters(F.col(f"{name}_name_alphanumeric"))})


def _common() -> dict[str, Column]:
    """How many elements each two sets share: once a pair, since all set features follow from it and the sizes."""
    return {f"{x}_common": M.common(F.col(f"s1_{x}_set"), F.col(f"cand_{x}_set")) for x in ("name", "addr", "numbers", "chars")}


def _jaccard(x: str) -> Column:
    union = F.size(f"s1_{x}_set") + F.size(f"cand_{x}_set") - F.col(f"{x}_common")
    return F.when(union == 0, F.lit(1.0)).otherwise(F.col(f"{x}_common") / union)


def _containment(x: str, side: str) -> Column:
    size = F.size(f"{side}_{x}_set")
    return F.when(size == 0, F.lit(1.0)).otherwise(F.col(f"{x}_common") / size)


def _columns() -> dict[str, Column]:
    c = F.col
    out: dict[str, Column] = {}
    for part in ("name", "addr"):
        out[f"{part}_exact_cleaned"] = M.exact(c(f"s1_{part}_cleaned"), c(f"cand_{part}_cleaned"))
        out[f"{part}_exact_alphanumeric"] = M.exact(c(f"s1_{part}_alphanumeric"), c(f"cand_{part}_alphanumeric"))
        out[f"{part}_token_intersection_count"] = c(f"{part}_common")
        out[f"{part}_token_jaccard"] = _jaccard(part)
        out[f"{part}_token_containment_s1"] = _containment(part, "s1")
        out[f"{part}_token_containment_cand"] = _containment(part, "cand")
        out[f"{part}_length_ratio"] = M.length_ratio(c(f"s1_{part}_alphanumeric"), c(f"cand_{part}_alphanumeric"))
        out[f"{part}_token_count_diff"] = F.abs(c(f"s1_{part}_n") - c(f"cand_{part}_n"))
        for side in ("s1", "cand"):
            out[f"{side}_{part}_missing"] = c(f"{side}_{part}_alphanumeric") == ""
            out[f"{side}_{part}_token_count"] = c(f"{side}_{part}_n")
    out["name_char_jaccard"] = _jaccard("chars")
    out["addr_numeric_intersection_count"] = c("numbers_common")
    out["addr_numeric_jaccard"] = _jaccard("numbers")
    out["country_exact_match"] = M.exact(c("s1_country_cleaned"), c("cand_country_cleaned"))
    return out


def _combined() -> dict[str, Column]:
    c = F.col
    same = lambda part: (c(f"s1_{part}_alphanumeric") == c(f"cand_{part}_alphanumeric"))
    strong = lambda part: (c(f"{part}_token_jaccard") >= 0.8) | same(part)
    weak = lambda part: (c(f"{part}_token_jaccard") >= 0.3) | (c(f"{part}_token_intersection_count") > 0)
    filled = (c("s1_name_alphanumeric") != "") & (c("s1_addr_alphanumeric") != "")
    return {"name_and_addr_exact": same("name") & same("addr") & filled, "strong_name_weak_addr": strong("name") & weak("addr"), "weak_name_strong_addr": weak("name") & strong("addr")}


def sides(s1: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s1_id, s1's fields) and (cand_id, cand's fields), which ``compared`` reads."""
    return _side(s1, "s1"), _side(candidates, "cand")


def compared(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, blocking_route, 31 doubles) of rows with the fields of both sides."""
    route = F.coalesce("route", F.lit("")) if "route" in rows.columns else F.lit("")
    rows = rows.withColumn("blocking_route", route).withColumns(_common()).withColumns(_columns()).withColumns(_combined())
    return rows.select(*keep, "blocking_route", *[F.col(f).cast("double").alias(f) for f in FEATURES])


def pair_features(pairs: DataFrame, s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, candidate_id, blocking_route, 31 doubles); pairs with an unknown id are skipped."""
    a, b = sides(s1, candidates)
    route = ["route"] if "route" in pairs.columns else []
    return compared(pairs.select("s1_id", "cand_id", *route).join(a, "s1_id").join(b, "cand_id"), "s1_id", "cand_id").withColumnRenamed("cand_id", "candidate_id")


def feature_vector() -> Column:
    return F.array(*FEATURES)
