from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.operators import classes as K
from linkloom.operators import evaluate as E
from linkloom.operators import experiments as X
from linkloom.operators import pairs as P
from linkloom.operators import routes
from linkloom.operators import sets as S
from linkloom.plans import catalogue, views

FIELDS = "entity_id string, country_cleaned string, name_cleaned string, name_tokens array<string>, postal_code string"


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Three copies of the parts with shifted keys, and some keys that occur twice with one name or with two."""
    folder = tmp_path_factory.mktemp("copies")
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 120").withColumns({"p_brand": F.lit("Brand#1"), "p_type": F.lit("SMALL")})
    again = part.where("p_partkey < 8").union(part.where("p_partkey between 8 and 11").withColumn("p_name", F.lit("blue ring")))
    part.crossJoin(spark.range(3)).withColumn("p_partkey", F.expr("p_partkey + 420 * id")).drop("id").union(again).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def rows(df):
    return Counter(tuple(map(repr, r)) for r in df.collect())


def written_out(df):
    """Whether pairs come from lists of members and meet no shuffle after that."""
    return df._jdf.queryExecution().sparkPlan().toString().split("Exchange")[0].split("Aggregate")[0].count("Generate explode") == 2


@pytest.fixture(scope="module")
def sides(spark):
    side = lambda s, n: spark.createDataFrame([(f"{s}-{i % (n - 3)}", "us" if i % 5 else "", f"n{i % 4}", [f"w{i % 3}", f"w{i % 4}", "w9"][: i % 4], f"{i % 3}" if i % 7 else None) for i in range(n)], FIELDS)
    return side("S1", 40), side("S2", 60)


@pytest.mark.parametrize("name", [n for n, r in routes.ROUTES.items() if hasattr(r, "plain") and set(r.columns) <= {"name_cleaned", "name_tokens", "postal_code"}])
def test_classes_find_the_pairs_of_the_route(sides, name):
    found = rows(routes.ROUTES[name](*sides))
    assert found and found == rows(routes.ROUTES[name].plain(*sides))


def test_large_classes_are_several_lists(spark):
    many = K.classes(K.classed(spark.range(5 * K.LIST).selectExpr("concat('S2-', id) entity_id", "'us' country_cleaned"), ["country_cleaned"]))
    sizes = [r[0] for r in many.lists("c", "ids").selectExpr("size(ids)").collect()]
    assert sum(sizes) == 5 * K.LIST and len(sizes) == 5


@pytest.mark.parametrize("name", ["shared_pairs", "first_route", "pairs_without", "route_union", "route_token_overlap_1", "route_token_overlap_2", "route_shared_name_tokens", "route_postal_code", "route_documents_token_overlap_2", "features31"])
def test_pairs_are_written_out_last(spark, copies, sf, name):
    assert written_out(catalogue.QUERIES[name](spark, sf if "documents" in name else copies))


PAIRS = {
    "shared_pairs": lambda r: S.shared_pairs(r[0][1], r[1][1]),
    "first_route": S.first_route,
    "pairs_without": lambda r: S.pairs_without(r[2][1], r[1][1]),
    "route_union": lambda r: S.candidate_union([f for _, f in r]),
}
COUNTED = {
    "quantiles": lambda s1, t, truth, r: E.quantiles(E.candidate_counts(s1, routes.token_overlap(1)(s1, t)), "candidates"),
    "evaluate_token_overlap_1": lambda s1, t, truth, r: E.evaluate("token_overlap_1", s1, truth, routes.token_overlap(1)(s1, t)),
    "evaluate_token_overlap_2": lambda s1, t, truth, r: E.evaluate("token_overlap_2", s1, truth, routes.token_overlap(2)(s1, t)),
    "route_contribution": lambda s1, t, truth, r: E.route_contribution(r, truth),
    "union_contribution": lambda s1, t, truth, r: E.union_contribution(r, truth),
    "route_overlap": lambda s1, t, truth, r: E.route_overlap(r, truth),
}


@pytest.fixture(scope="module")
def pairwise(spark, copies):
    """Both sides, the known matches, and the routes on all entities."""
    s1, targets = (x.cache() for x in catalogue.sides(spark, copies))
    return s1, targets, views.truth(spark, copies).cache(), [(n, routes.ROUTES[n].plain(s1, targets).cache()) for n in catalogue._DIFFERENT]


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_of_copies(spark, copies, pairwise, name):
    known = rows(PAIRS[name](pairwise[3]))
    assert known and rows(catalogue.QUERIES[name](spark, copies)) == known


def test_features_of_copies(spark, copies, pairwise):
    assert rows(catalogue.QUERIES["features31"](spark, copies)) == rows(P.pair_features(S.first_route(pairwise[3]), *pairwise[:2]))


@pytest.mark.parametrize("name", ["token_overlap_1", "shared_name_tokens"])
def test_pairs_are_written_by_as_many_tasks_as_they_ask_for(spark, sides, monkeypatch, name):
    """However few the classes that they come from."""
    monkeypatch.setattr(K, "TASK", 16)
    found, known = routes.ROUTES[name](*sides), rows(routes.ROUTES[name].plain(*sides))
    assert found.rdd.getNumPartitions() > known.total() / 32 > 4 and rows(found) == known


def test_features_meet_in_as_many_tasks_as_they_write(spark, copies, pairwise, monkeypatch):
    """However small the rows that meet are; and each two sets of a pair are compared once."""
    monkeypatch.setattr(K, "TASK", 8)
    found = catalogue.QUERIES["features31"](spark, copies)
    assert found.rdd.getNumPartitions() > S.first_route(pairwise[3]).count() / 16 > 4
    assert rows(found) == rows(P.pair_features(S.first_route(pairwise[3]), *pairwise[:2]))
    assert not any("array_" in str(c) for c in P._columns().values())


@pytest.mark.parametrize("name", COUNTED)
def test_counts_of_copies(spark, copies, pairwise, monkeypatch, name):
    """Results as of all pairs, from routes that meet a class once."""
    known, met = rows(catalogue._rounded(COUNTED[name](*pairwise))), []
    for n in {*catalogue._DIFFERENT, "token_overlap_1"}:
        monkeypatch.setattr(routes.ROUTES[n], "plain", lambda s1, t, f=routes.ROUTES[n].plain: met.append(t.count()) or f(s1, t))
    assert rows(catalogue._rounded(catalogue.QUERIES[name](spark, copies))) == known
    assert met and max(met) < pairwise[1].count() / 2


@pytest.mark.parametrize("name", ["experiments_name", "experiments_address", "experiment_examples", "discrimination"])
def test_what_pairs_share_is_scored_once(spark, copies, pairwise, monkeypatch, name):
    s1, targets, truth, _ = pairwise
    met, field, scored = [], "address" if name.endswith("address") else "name", X.scored
    pairs = X.matched_pairs(s1, targets, truth)
    plain = scored(pairs, field)
    if name == "discrimination":
        known = X.discrimination(X.statistics(plain), X.statistics(scored(X.matched_pairs(s1, targets, X.hard_negatives(s1, targets, truth)), field)))
    else:
        known = X.examples(plain) if name == "experiment_examples" else X.statistics(plain)
    known = rows(catalogue._rounded(known))
    monkeypatch.setattr(X, "scored", lambda p, f: met.append(p.count()) or scored(p, f))
    assert known and rows(catalogue.QUERIES[name](spark, copies)) == known
    assert met[0] < pairs.count() / 2


@pytest.mark.parametrize("name", ["route_contribution", "union_contribution", "experiments_name", "experiments_address", "experiment_examples"])
def test_known_matches_are_not_written_as_pairs(spark, copies, monkeypatch, name):
    """They are counted from equal keys, so a truth without rows changes nothing."""
    known = rows(catalogue.QUERIES[name](spark, copies))
    monkeypatch.setattr(views, "truth", lambda *_: spark.createDataFrame([], "s1_id string, match_id string"))
    assert known and rows(catalogue.QUERIES[name](spark, copies)) == known


def test_the_unions_size_is_counted_from_names(spark, copies, monkeypatch):
    """Where names have classes of their own, no route of names meets all fields, known matches or not."""
    met = []
    columns = lambda df: met.append(len(df.columns))
    for n in catalogue._DIFFERENT[:3]:
        monkeypatch.setattr(routes.ROUTES[n], "plain", lambda s1, t, f=routes.ROUTES[n].plain: columns(t) or f(s1, t))
    catalogue.QUERIES["union_contribution"](spark, copies)
    names = {c for n in catalogue._DIFFERENT[:3] for c in routes.ROUTES[n].columns}
    assert met and max(met) <= 2 + len(names)


@pytest.mark.parametrize("name", ["route_union", "first_route", "features31"])
def test_routes_of_names_meet_a_name_once(spark, copies, pairwise, monkeypatch, name):
    """Classes that differ in other fields are one to them; ids of several rows stay their own."""
    targets, met = pairwise[1], []
    names = targets.select("country_cleaned", "name_cleaned", "name_alphanumeric").distinct().count()
    own = targets.groupBy("entity_id").count().where("count > 1").agg(F.sum("count")).first()[0]
    for n in catalogue._DIFFERENT[:3]:
        monkeypatch.setattr(routes.ROUTES[n], "plain", lambda s1, t, f=routes.ROUTES[n].plain: met.append(t.count()) or f(s1, t))
    catalogue.QUERIES[name](spark, copies)
    assert met and max(met) <= names + own


def test_lists_that_others_are_repeated_for_are_short(spark):
    """A pair of lists is written out in memory, so their product is bounded."""
    side = lambda s: K.classes(K.classed(spark.range(4 * K.LIST).selectExpr(f"concat('{s}-', id) entity_id", "'us' country_cleaned"), ["country_cleaned"]))
    a, b = side("S1"), side("S2")
    pairs = a.rows.select(F.col("entity_id").alias("s1_id")).crossJoin(b.rows.select(F.col("entity_id").alias("cand_id")))
    n, most = K.listed(pairs, a, b).selectExpr("sum(size(_s) * size(_t))", "max(size(_s))").first()
    assert n == (4 * K.LIST) ** 2 and most < K.LIST / 4
