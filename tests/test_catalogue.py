import math

import duckdb
import pytest

from linkloom.plans import catalogue

FAST = ["norm_part", "norm_documents", "address_fields", "name_transforms", "address_transforms", "route_token_overlap_2", "route_name_3gram_top5", "route_numeric_any", "route_addr_similarity", "route_contribution", "features31", "hard_negatives", "discrimination", "experiment_examples", "experiments_name", "route_house_number", "evaluate_country_only", "evaluate_union_name_alphanumeric_token_overlap_2_maxdf5k", "sampled_entities", "frequency_statistics", "quantiles", "profile_documents"]


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    cell = lambda v: "~" if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", FAST)
def test_query_and_sql_agree(spark, sf, name):
    con = duckdb.connect()
    for t in ("part", "documents", "customer"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert plain(catalogue.QUERIES[name](spark, sf).toPandas()) == plain(con.sql(catalogue.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
