import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.plans.entities import address_records, normalized


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def column(spark, values, c):
    return [r[0] for r in rows(spark, values).orderBy("i").select(c).collect()]


def entity(spark, name="", address="", country="US", entity_id="S1-1"):
    raw = spark.createDataFrame([(entity_id, name, address, country)], "entity_id string, business_name string, business_address string, country string")
    return address_records(normalized(raw)).first()


def test_missing_values(spark):
    missing = [None, "", "  ", "NULL", "N/A", "na", "NaN", "None", "-", "--", ".", "  null  ", "undefined", "Missing"]
    there = ["0", "false", "annulled", "nullable", "x"]
    assert column(spark, missing, T.is_missing(F.col("v"))) == [True] * len(missing)
    assert column(spark, there, T.is_missing(F.col("v"))) == [False] * len(there)


@pytest.mark.parametrize(
    ("raw", "cleaned", "plain"),
    [
        ("  Summit   Health    LLC  ", "summit health llc", "summit health llc"),
        ("B+ Retail Inc", "b+ retail inc", "b retail inc"),
        ("Payne Énterprises", "payne énterprises", "payne enterprises"),
        ("Fractales Amis Groupe S.A.S", "fractales amis groupe s.a.s", "fractales amis groupe s a s"),
        ("नमस्ते दुनिया", "नमस्ते दुनिया", "नमस्ते दुनिया"),
        ("a b c", "a b c", "a b c"),
        (None, "", ""),
        ("N/A", "", ""),
    ],
)
def test_names(spark, raw, cleaned, plain):
    e = entity(spark, name=raw)
    assert e.name_cleaned == cleaned
    assert e.name_alphanumeric == plain
    assert e.name_tokens == plain.split()


def test_zero_width_characters_separate(spark):
    assert entity(spark, name="అ‌ఆ").name_alphanumeric == "అ ఆ"


def test_addresses(spark):
    e = entity(spark, address="6(29), C.I.T. Colony, Chennai")
    assert e.addr_alphanumeric == "6 29 c i t colony chennai"
    assert e.addr_words == []
    e = entity(spark, address="Door No 183, 41St Cross, 22Nd Main")
    assert e.addr_numeric_tokens == ["183", "41st", "22nd"]
    assert e.house_number == "183"
    e = entity(spark, address="067 PRODUCTION CT, NULL, INDEPENDENCE, KY annulled")
    assert "null" not in e.addr_tokens and "annulled" in e.addr_tokens
    assert e.addr_cleaned == "067 production ct, , independence, ky annulled"


@pytest.mark.parametrize(
    ("address", "number"),
    [("h.no. 12/3-4 x road", "12"), ("plot no 7a, y", "7a"), ("221b baker street", "221b"), ("tower, 55 main st", "55"), ("no 1234567 way", None), ("somewhere", None), ("", None)],
)
def test_house_numbers(spark, address, number):
    assert entity(spark, address=address).house_number == number


@pytest.mark.parametrize(
    ("address", "country", "code"),
    [("1 Main St 12345, 54321-0001", "US", "54321"), ("Road 560001 x 012345", "India", "560001"), ("1 rue, 75001 Paris", "France", "75001"), ("1 rue, 99001", "France", None), ("12345", "Spain", None), (None, "US", None)],
)
def test_postal_codes(spark, address, country, code):
    assert entity(spark, address=address, country=country).postal_code == code


def test_grams(spark):
    assert column(spark, ["abcd", "ab", "", " x "], T.trigrams(F.col("v"))) == [["abc", "bcd"], ["ab"], [], ["x"]]
    assert column(spark, ["ab", ""], T.padded_grams(F.col("v"), 3)) == [["$ab", "ab$"], []]
    assert column(spark, ["a"], T.padded_grams(F.col("v"), 4)) == [["$a$"]]


def test_transforms(spark):
    t = T.name_transforms(F.col("v"))
    assert column(spark, ["Acme Pvt. Ltd"], t["D_legal_std"]) == ["acme private limited"]
    assert column(spark, ["b a b"], t["E_token_sort"]) == ["a b b"]
    a = T.address_transforms(F.col("v"), F.lit("US"))
    assert column(spark, ["1 Main St., null NULL, x"], a["D_abbrev"]) == ["1 main street null x"]
    assert column(spark, ["41st 7-2"], a["E_numeric"]) == ["41 7 2"]
    assert column(spark, ["  A   b "], a["C_whitespace"]) == ["A b"]


def fold_oracle(text):
    out = []
    for ch in unicodedata.normalize("NFD", text):
        if unicodedata.category(ch)[0] == "M" and (not out or any(a <= ord(out[-1]) <= b for a, b in T.LATIN_RANGES)):
            continue
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_fold_is_idempotent_and_as_stated(text):
    assert T.fold_text(text) == fold_oracle(text)
    assert T.fold_text(T.fold_text(text)) == T.fold_text(text)


def test_normalization_is_idempotent(spark, sf):
    from linkloom.plans import views

    once = normalized(views.raw(spark, sf, "documents"))
    again = normalized(once.select("entity_id", F.col("name_cleaned").alias("business_name"), F.col("addr_cleaned").alias("business_address"), F.col("country_cleaned").alias("country")))
    for c in ("name_cleaned", "name_alphanumeric", "addr_cleaned"):
        assert again.select("entity_id", c).exceptAll(once.select("entity_id", c)).count() == 0
