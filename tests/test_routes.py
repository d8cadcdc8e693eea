import random

import pytest

from linkloom.operators import evaluate as E
from linkloom.operators import pairs as P
from linkloom.operators import routes as R
from linkloom.operators import sets as S
from linkloom.plans.entities import address_records, normalized, split_sources


def frames(spark, rows):
    raw = spark.createDataFrame([(r + ("", "", ""))[:4] if len(r) < 4 else r for r in rows], "entity_id string, business_name string, business_address string, country string")
    return split_sources(address_records(normalized(raw)))


def found(route, sides):
    return {(r.s1_id, r.cand_id) for r in route(*sides).collect()}


@pytest.fixture(scope="module")
def acme(spark):
    return frames(spark, [("S1-1", "acme inc", "", "us"), ("S2-1", "acme incorporated", "", "us"), ("S2-2", "acme inc", "", "us"), ("S2-3", "beta llc", "", "us"), ("S3-4", "acme inc", "", "india")])


def test_token_overlap(acme):
    assert found(R.token_overlap(1), acme) == {("S1-1", "S2-1"), ("S1-1", "S2-2")}
    assert found(R.token_overlap(2), acme) == {("S1-1", "S2-2")}
    assert found(R.token_overlap(1, 1, 1), acme) == {("S1-1", "S2-2")}


def test_frequency_range(spark):
    sides = frames(spark, [("S1-1", "common rare1", "", "us"), ("S2-1", "common rare1", "", "us"), ("S2-2", "common rare2", "", "us"), ("S2-3", "common", "", "us")])
    df = {(r.key, r.df) for r in R.frequencies(R.token_postings(sides[1])).collect()}
    assert df == {("common", 3), ("rare1", 1), ("rare2", 1)}
    assert found(R.token_overlap(1, 1, 2), sides) == {("S1-1", "S2-1")}
    assert found(R.token_overlap(1, 2, None), sides) == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-3")}


def test_empty_keys_match_nothing(spark):
    sides = frames(spark, [("S1-1", "", "", "us"), ("S1-2", "a", "", ""), ("S2-1", "", "", "us"), ("S2-2", "a", "", "")])
    for name in ("country_name_cleaned", "token_overlap_1", "numeric_equal", "house_number", "postal_code"):
        assert found(R.ROUTES[name], sides) == set()
    assert found(R.by_country, sides) == {("S1-1", "S2-1")}


def test_duplicate_tokens_count_once(spark):
    sides = frames(spark, [("S1-1", "acme acme", "", "us"), ("S2-1", "acme acme", "", "us")])
    assert found(R.token_overlap(2), sides) == set()


def test_strict_probing_spends_places_on_unindexed_keys(spark):
    rows = [("S1-1", "", "alpha beta gamma", "us")] + [(f"S2-{i}", "", "gamma delta", "us") for i in range(2)]
    sides = frames(spark, rows)
    assert found(R.address_similarity("strict"), sides) == set()
    assert len(found(R.probe_similar("addr_words", 2, 2, 2500, 0.2, 1), sides)) == 2


def test_capped_joins_equal_the_whole_join_cut_afterwards(spark):
    rng = random.Random(4)
    number = lambda: min(rng.randrange(1, 30), rng.randrange(1, 30))
    rows = [(f"S{1 + i % 3}-{i % 230}", "", f"{number()} word{number()} street{number()} {number()} tower{number()}", rng.choice(["us", "india"])) for i in range(240)]
    sides = frames(spark, rows)
    for column in ("numeric_set", "addr_words"):
        for cap in (1, 3, 10, 1000):
            probes, targets = R._ranked_probes(*sides, column, 1, 60)
            whole = R._capped(probes.join(targets, ["cc", "key"]), cap)
            pairs = lambda df: sorted((r.s1_id, r.cand_id) for r in df.collect())
            assert pairs(R._capped_join(probes, targets, cap)) == pairs(whole) != []
    first = {}
    for s1, cand in sorted(found(R.equal_field("house_number"), sides)):
        first.setdefault(s1, []).append(cand)
    assert found(R.equal_field("house_number", 2), sides) == {(s, c) for s, cands in first.items() for c in cands[:2]}


def test_numeric_routes(spark):
    sides = frames(spark, [("S1-1", "", "12 x 34", "us"), ("S2-1", "", "12 y 34", "us"), ("S2-2", "", "12 y", "us"), ("S2-3", "", "12 34 56", "us")])
    assert found(R.numeric_all(), sides) == {("S1-1", "S2-1"), ("S1-1", "S2-3")}
    assert found(R.numeric_count(2), sides) == {("S1-1", "S2-1"), ("S1-1", "S2-3")}
    assert found(R.numeric_equal, sides) == {("S1-1", "S2-1")}
    assert found(R.numeric_any(), sides) == {("S1-1", f"S2-{i}") for i in (1, 2, 3)}
    assert found(R.numeric_jaccard(), sides) == {("S1-1", "S2-1"), ("S1-1", "S2-3")}


def test_caps_are_exact_counts(spark):
    sides = frames(spark, [("S1-1", "", "no 5 x", "us")] + [(f"S2-{i:03d}", "", "no 5 y", "us") for i in range(30)])
    assert len(found(R.equal_field("house_number", 7), sides)) == 7
    assert len(found(R.equal_field("house_number"), sides)) == 30


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, cand_id string")


def truth(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, match_id string")


def ids(spark, n):
    return spark.createDataFrame([(f"S1-{i}",) for i in range(1, n + 1)], "entity_id string")


def test_evaluate(spark):
    r = E.evaluate("x", ids(spark, 2), truth(spark, [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S3-1")]), pairs(spark, [("S1-1", "S2-1")])).first()
    assert r.recall == pytest.approx(1 / 3) and r.recall_s2 == 0.5 and r.recall_s3 == 0.0 and r.full_coverage == 0.0
    assert r.avg_candidates == 0.5 and r.max_candidates == 1


def test_evaluate_nothing(spark):
    r = E.evaluate("x", ids(spark, 1), truth(spark, []), pairs(spark, [])).first()
    assert (r.recall, r.full_coverage, r.avg_candidates, r.p95_candidates) == (0.0, 0.0, 0.0, 0)


def test_quantile_readings(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 21)], "candidates long")
    r = E.quantiles(df, "candidates").first()
    assert (r.nearest_rank, r.lower_rank, round(r.interpolated, 6)) == (20, 19, 19.05)


def test_contribution(spark):
    a, b = pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S2-2")]), pairs(spark, [("S1-1", "S2-2"), ("S1-1", "S2-3")])
    gt = truth(spark, [("S1-1", f"S2-{i}") for i in (1, 2, 3)])
    got = {r.route: (r.total, r.unique_pairs, r.shared_pairs, r.marginal) for r in E.route_contribution([("a", a), ("b", b), ("c", pairs(spark, []))], gt).collect()}
    assert got == {"a": (2, 1, 1, 2), "b": (2, 1, 1, 1), "c": (0, 0, 0, 0)}
    assert {(r.route_a, r.route_b): r.shared for r in E.route_overlap([("a", a), ("b", b), ("c", pairs(spark, []))], gt).collect()} == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}
    u = E.union_contribution([("a", a), ("b", b)], gt).first()
    assert (u.total_gt, u.retrieved, u.recall, u.candidate_pairs) == (3, 3, 1.0, 3)
    assert sum(v[3] for v in got.values()) == u.retrieved


def test_set_operations(spark):
    a, b = pairs(spark, [("1", "2"), ("1", "2"), ("1", "3")]), pairs(spark, [("1", "3"), ("4", "5")])
    assert S.candidate_union([a, b]).count() == 3
    assert S.shared_pairs(a, b).count() == 1
    assert S.pairs_without(a, b).collect()[0].cand_id == "2"
    assert {(r.s1_id, r.cand_id): r.route for r in S.first_route([("b", b), ("a", a)]).collect()}[("1", "3")] == "b"


def test_macro_f_half(spark):
    r = E.macro_f_half(ids(spark, 3), truth(spark, [("S1-1", "S2-1"), ("S1-1", "S2-2")]), pairs(spark, [("S1-1", "S2-1"), ("S1-2", "S2-9")])).first()
    assert r.macro_f_half == pytest.approx((1.25 * 0.5 / (0.25 + 0.5) + 0 + 1) / 3)


def one(spark, a, b):
    s1, targets = frames(spark, [("S1-1", *a), ("S2-1", *b)])
    return P.pair_features(pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S2-404")]), s1, targets).collect()


def test_features(spark):
    (r,) = one(spark, ("acme inc", "123 main st apt 4b", "us"), ("acme corp", "123 oak ave floor 5", "us"))
    assert r.name_token_jaccard == pytest.approx(1 / 3) and r.name_token_containment_s1 == 0.5
    assert r.addr_numeric_intersection_count == 1 and r.addr_numeric_jaccard == pytest.approx(1 / 3)
    assert r.blocking_route == "" and len(P.FEATURES) == 31
    (r,) = one(spark, ("", "", ""), ("", "", ""))
    assert r.name_exact_cleaned == 1.0 and r.name_token_jaccard == 1.0 and r.name_and_addr_exact == 0.0 and r.s1_name_missing == 1.0
    (r,) = one(spark, ("", "x", "us"), ("abc", "x", "us"))
    assert (r.name_token_jaccard, r.name_token_containment_s1, r.name_length_ratio) == (0.0, 1.0, 0.0)
    (r,) = one(spark, ("abc", "", "us"), ("bcd", "", "us"))
    assert r.name_char_jaccard == 0.5
