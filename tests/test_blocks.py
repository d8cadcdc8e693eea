import random
from collections import Counter

import pytest

from linkloom.operators import blocks, routes
from linkloom.plans import catalogue

FIELDS = "entity_id string, country_cleaned string, name_tokens array<string>"


def first_join(df):
    return next(x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x)


def test_shared_words_are_counted_where_blocks_meet(spark, sf):
    """The words that a pair shares aren't rows: the join that finds a pair has its count."""
    assert "bit_count" in first_join(catalogue.QUERIES["route_documents_token_overlap_2"](spark, sf))


@pytest.mark.parametrize("repeats", [0, 9])
def test_blocks_find_the_pairs_of_shared_words(spark, monkeypatch, repeats):
    """With words beyond those that have bits, several blocks, and ids of several rows."""
    monkeypatch.setattr(blocks, "FREQUENT", 1)
    monkeypatch.setattr(blocks, "HASHED", 1)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    r = random.Random(3)
    words = lambda: [f"w{int(200 * r.random() ** 4)}" for _ in range(r.randrange(10))]
    side = lambda s, n: spark.createDataFrame([(f"{s}-{i % (n - repeats)}", "us" if i % 3 else "fr" if i % 5 else "", words()) for i in range(n)], FIELDS)
    sides = side("S1", 80), side("S2", 120)
    route = routes.ROUTES["token_overlap_2"]
    rows = lambda df: Counter(map(tuple, df.collect()))
    found = rows(route(*sides))
    assert len(found) > 50 and found == rows(route.plain(*sides))
