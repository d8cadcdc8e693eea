import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as M
from linkloom.operators import experiments as X
from linkloom.plans.entities import normalized, split_sources
from linkloom.sources import jobs
from linkloom.sources import tables as S
from linkloom.sources.reports import markdown
from linkloom.streaming import normalize as N

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture
def tsv(tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text(HEADER + "S1-1\tAcme \"Inc\"\t1 Main St\tUS\nbad\tline\n\nS1-2\tÉclair\t\tFrance\textra\n", encoding="utf-8")
    return str(path)


def test_read_entities_counts_errors(spark, tsv):
    rows, errors = S.read_entities(spark, tsv)
    assert [r.entity_id for r in rows.collect()] == ["S1-1", "S1-2"]
    assert rows.first().business_name == 'Acme "Inc"'
    assert {(r.columns, r.action) for r in errors.collect()} == {(2, "skipped"), (5, "truncated")}
    assert S.read_entities(spark, tsv, limit=1)[0].count() == 1
    assert S.read_columns(spark, tsv, needed=spark.createDataFrame([("S1-2",)], "entity_id string")).count() == 1


def test_bad_header_and_empty_file(spark, tmp_path):
    for text in ("a\tb\n1\t2\n", ""):
        path = tmp_path / "x.tsv"
        path.write_text(text)
        out = S.normalize_file(spark, str(path), str(tmp_path / "out"))
        assert out["rows"] == 0 and out["n_errors"] == 1


def test_normalize_file(spark, tsv, tmp_path):
    out = S.normalize_file(spark, tsv, str(tmp_path / "deep" / "out"))
    assert out["rows"] == 2 and out["n_errors"] == 2
    back = spark.read.csv(str(tmp_path / "deep" / "out"), sep="\t", header=True, quote="")
    assert len(back.columns) == 14
    assert {r.name_no_accents for r in back.collect()} == {'acme "inc"', "eclair"}
    assert "2 rows" in jobs.summary([out])


def test_truth(spark, tmp_path):
    path = tmp_path / "gt.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-1,\nS1-2\t\nS1-3\tS2-9\nS1-3\tS2-3\n")
    rows = {(r.s1_id, r.match_id) for r in S.read_truth(spark, str(path)).collect()}
    assert rows == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-3", "S2-3")}
    assert ("S1-2", None) in {(r.s1_id, r.match_id) for r in S.read_truth(spark, str(path), singletons=True).collect()}
    ids = spark.createDataFrame([("S1-1",)], "entity_id string")
    s2, s3 = S.truth_by_source(S.read_truth(spark, str(path)), ids)
    assert (s2.count(), s3.count()) == (1, 1)


def test_results_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "route string, n int")
    b = spark.createDataFrame([("y", 0.5)], "route string, recall double")
    S.write_results([a, b], str(tmp_path / "r"))
    got = S.read_results(spark, str(tmp_path / "r"))
    assert got["x"]["n"] == 1 and got["y"]["recall"] == 0.5
    assert "| x | 1 |" in markdown("t", a)
    assert S.first_existing(spark, ["/no/such", str(tmp_path)]) == str(tmp_path)


def test_synthetic_and_experiments(spark):
    raw, truth = S.synthetic(spark, 200, distractors=50)
    s1, targets = split_sources(normalized(raw))
    assert s1.count() == 200 and raw.select("entity_id").distinct().count() == raw.count()
    negatives = X.hard_negatives(s1, targets, truth, 30, buckets=4)
    assert 0 < negatives.count() <= 30 and negatives.join(truth, ["s1_id", "match_id"]).count() == 0
    stats = X.statistics(X.scored(X.matched_pairs(s1, targets, truth), "name"))
    base = stats.where("experiment = 'A_current'").collect()
    assert all(r.unchanged_pct == 100.0 for r in base)
    verdicts = X.discrimination(stats, X.statistics(X.scored(X.matched_pairs(s1, targets, negatives), "name")))
    assert all(r.verdict == "same" for r in verdicts.where("experiment in ('A_current', 'C_unicode_accent')").collect())


def test_every_entity_gets_a_negative(spark):
    side = lambda p, n: spark.createDataFrame([(f"{p}-{i}", "ab"[i % 2]) for i in range(n)], "entity_id string, country_cleaned string")
    s1, targets = side("S1", 40), side("S2", 6)
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{j}") for i in range(40) for j in range(6) if i % 2 == j % 2 and (j < 4 or i == 0)], "s1_id string, match_id string")
    for n, want in ((None, 39), (5, 5)):
        got = X.hard_negatives(s1, targets, truth, n).collect()
        assert len({r.s1_id for r in got}) == len(got) == want  # S1-0 matches all of its country
        assert all(r.match_id == f"S2-{4 + int(r.s1_id[3:]) % 2}" for r in got)


def test_dice_counts_repeats(spark):
    """As counted one by one, of texts with many equal pairs, and no text's pairs are made anew for each pair."""
    r = random.Random(5)
    texts = [("".join(r.choice("ab é1") for _ in range(r.randrange(40))), "".join(r.choice("ab é1") for _ in range(r.randrange(40)))) for _ in range(200)]
    df = spark.createDataFrame(texts, "a string, b string").select("a", "b", M.dice(F.col("a"), F.col("b")).alias("d"))
    grams = lambda x: Counter(x[i : i + 2] for i in range(len(x) - 1))
    known = lambda a, b: 1.0 if a == b else 0.0 if min(len(a), len(b)) < 2 else 2 * (grams(a) & grams(b)).total() / (len(a) + len(b) - 2)
    assert [x for x in df.collect() if abs(x.d - known(x.a, x.b)) > 1e-12] == []
    assert df._jdf.queryExecution().optimizedPlan().toString().count("substring(") == 2


def test_a_baseline_is_scored_once(spark):
    """Rows are made of scores that are columns: no score is computed for each row that it is the baseline of."""
    pairs = spark.createDataFrame([("Red Ring", "red ring ltd", 2)], "a_business_name string, b_business_name string, n long")
    plan = X.scored(pairs, "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in next(x for x in plan.splitlines() if "Generate explode" in x)


def test_dice(spark):
    from linkloom.functions import similarity as M

    df = spark.createDataFrame([("night", "nacht"), ("aa", "aa"), ("a", "b"), ("", "x"), ("aaaa", "aa")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(M.dice(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0, 0.0, 0.0, 0.5]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tsv").write_text(HEADER + "S1-1\tAcme Inc\t\tUS\nS2-1\tACME, INC\t\tUS\n")
    stream = N.normalized_stream(N.read_stream(spark, str(folder)))
    targets = normalized(spark.createDataFrame([("S2-1", "ACME, INC", "", "US")], "entity_id string, business_name string, business_address string, country string"))
    q = N.write_stream(N.candidates_stream(stream.where("entity_id like 'S1-%'"), targets), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("S1-1", "S2-1")]


def test_hard_negatives_are_the_nearest_of_their_bucket(spark):
    """Chosen entities, short hash beginnings and whole buckets give what a look at every pair does."""
    rows = [(f"S1-{i}", "x" if i % 3 else "y") for i in range(60)] + [(f"S2-{i}", "x" if i % 4 else "y") for i in range(90)] + [("S1-0", "y"), ("S2-1", "x"), ("S1-99", ""), ("S1-98", "z")]
    frame = spark.createDataFrame(rows, "entity_id string, country_cleaned string")
    links = [(f"S1-{i}", f"S2-{j}") for i in range(0, 60, 5) for j in range(i % 7, 90, 11)] + [("S1-3", "S2-4")] * 2
    truth = spark.createDataFrame(links, "s1_id string, match_id string")
    digest = lambda e: int(hashlib.md5(f"{e}:42".encode()).hexdigest()[:13], 16)
    most = max(len({m for a, m in links if a == s}) for s, _ in links)
    for n, buckets, cell in ((200, 8, 1), (200, 1, 4), (20, 64, 1)):
        want = []
        for s, c in set(rows):
            pool = sorted({(digest(t), t) for t, d in rows if t[1] == "2" and d == c})
            free = [(h ^ digest(s), t) for h, t in pool if (s, t) not in set(links)]
            near = [x for x in free if (x[0] ^ digest(s)) % buckets == digest(s) % buckets]
            first = [x for x in free if (x[0] ^ digest(s), x[1]) in pool[: most + 1]]
            if s[1] == "1" and c and (near or first):
                want.append((digest(s), s, min(near or first)[1]))
        got = X.hard_negatives(frame.where("entity_id like 'S1%'"), frame.where("entity_id like 'S2%'"), truth, n, buckets=buckets, cell=cell)
        assert sorted(map(tuple, got.collect())) == sorted((s, t) for _, s, t in sorted(want)[:n])
