"""Column functions for multilingual names, addresses and country labels.

Everything is a built-in expression but the two Unicode forms that Spark has no function
for (NFC, and accent folding of Latin letters only); those are Arrow-batched, and ASCII
values pass through them untouched.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that stand for a missing value, compared trimmed and lower-cased.
MISSING = ["", "null", "nan", "none", "n/a", "na", "undefined", "missing", "-", "--", "."]
# Tokens that the address transform of the experiments drops.
NULL_TOKENS = ["null", "nan", "none", "n/a", "na", "undefined", "missing"]
# Address words that carry no identity.
ADDRESS_STOPWORDS = (
    "road rd street st avenue ave lane ln drive dr court ct boulevard blvd highway hwy way place pl circle cir near opp opposite behind beside "
    "floor fl suite ste unit apt apartment room rm block blk plot sector sec nagar colony bazaar market east west north south city state town "
    "village district dist delhi mumbai bangalore kolkata chennai hyderabad pune texas california florida york ohio nc ca tx ny india us usa "
    "france paris lyon lille rue av bd"
).split()
# Legal forms and address abbreviations with their expansions.
LEGAL_FORMS = {"ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", "pvt": "private"}
ABBREVIATIONS = {
    "us": {"st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "cir": "circle", "sq": "square"},
    "france": {"r": "rue", "av": "avenue", "bd": "boulevard", "all": "allee", "pl": "place", "rte": "route", "imp": "impasse", "ch": "chemin"},
    "india": {"st": "street", "rd": "road", "no": "number"},
}
ABBREVIATIONS["united states"] = ABBREVIATIONS["us"]
# Code points taken as Latin, as ranges.
LATIN_RANGES = [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F)]

#: Equal to Python's str.isspace on every assigned code point.
SPACE = r"[\s\x1c-\x1f\u0085\p{Z}]"
#: Decimal digits and the other characters that Python's str.isdigit accepts in common text.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"


def _latin_by_range(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in LATIN_RANGES)


def _latin_by_name(ch: str) -> bool:
    return "LATIN" in unicodedata.name(ch, "")


def fold_text(text: str, by_name: bool = False) -> str:
    """Drop marks that follow a Latin letter (or start the text); recompose the rest."""
    if text.isascii():
        return text
    latin = _latin_by_name if by_name else _latin_by_range
    kept: list[str] = []
    for ch in unicodedata.normalize("NFD", text):
        if not unicodedata.category(ch).startswith("M") or (kept and not latin(kept[-1])):
            kept.append(ch)
    return unicodedata.normalize("NFC", "".join(kept))


def _mapped(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def nfc(c: Column) -> Column:
    return _mapped(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x))(c)


def fold_latin(c: Column, by_name: bool = False) -> Column:
    return _mapped(lambda x: fold_text(x, by_name))(c)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def is_missing(c: Column) -> Column:
    """Null, NaN-like, blank and sentinel strings."""
    return F.coalesce(F.lower(collapse(c.cast("string"))).isin(MISSING), F.lit(True))


def present(c: Column) -> Column:
    """The value, or the empty string for a missing one."""
    return F.when(is_missing(c), F.lit("")).otherwise(c.cast("string"))


def unicode_form(c: Column) -> Column:
    return collapse(nfc(c))


def alphanumeric(c: Column) -> Column:
    """Letters, numbers and marks; everything else separates."""
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}\s\x1c-\x1f\u0085\p{Z}]", " "))


def tokens(c: Column) -> Column:
    """Words between spaces, in order, with repeats; none for the empty string."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def distinct_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def without_null_words(c: Column) -> Column:
    """The word null, in any case, is no part of an address."""
    return collapse(F.regexp_replace(c, r"(?iU)\bnull\b", " "))


def numeric(words: Column) -> Column:
    """The words with a digit, in order, with repeats."""
    return F.filter(words, lambda t: t.rlike(DIGIT))


def as_set(words: Column) -> Column:
    """Distinct and sorted, so that equal sets are equal values."""
    return F.array_sort(F.array_distinct(words))


def address_words(words: Column) -> Column:
    """Words of three characters or more that aren't stopwords."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(ADDRESS_STOPWORDS)])
    return F.filter(words, lambda t: (F.char_length(t) >= 3) & ~F.array_contains(stop, t))


def name_forms(c: Column, by_name: bool = False) -> dict[str, Column]:
    cleaned = F.lower(unicode_form(present(c)))
    plain = fold_latin(cleaned, by_name)
    return {"name_cleaned": cleaned, "name_no_accents": plain, "name_alphanumeric": alphanumeric(plain)}


def address_forms(c: Column, by_name: bool = False) -> dict[str, Column]:
    cleaned = without_null_words(F.lower(unicode_form(present(c))))
    plain = fold_latin(cleaned, by_name)
    return {"addr_cleaned": cleaned, "addr_no_accents": plain, "addr_alphanumeric": alphanumeric(plain)}


def country_form(c: Column) -> Column:
    return F.lower(unicode_form(present(c)))


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _short(c: Column) -> Column:
    return F.when(F.char_length(c).between(1, 5), c)


def house_number(cleaned: Column) -> Column:
    """After a house-number word; else at the start; else before a street name in a comma part."""
    marked = _found(cleaned, r"\b(?:h\.?no\.?|plot\s+no\.?|door\s+no\.?|no\.?|house\s+no\.?)\s*[:#-]?\s*([0-9]+[a-z\-/0-9]*)")
    marked = F.split_part(F.split_part(marked, F.lit("/"), F.lit(1)), F.lit("-"), F.lit(1))
    leading = _found(cleaned, r"^([0-9]+[a-z]?)\b")
    part = lambda p: _short(_found(F.trim(p), r"^([0-9]+[a-z]?)\s+[a-z]"))
    parts = F.filter(F.transform(F.split(cleaned, ","), part), lambda p: p.isNotNull())
    return F.coalesce(_short(marked), _short(leading), F.try_element_at(parts, F.lit(1)))


# Postal code patterns by country.
POSTAL = {"us": r"\b(\d{5})(?:-\d{4})?\b", "india": r"\b([1-9]\d{5})\b", "france": r"\b((?:0[1-9]|[1-8]\d|9[0-8])\d{3})\b"}


def postal_code(address: Column, country: Column) -> Column:
    """The last code of the country's form in the address as it came."""
    last = [(k, F.try_element_at(F.regexp_extract_all(address, F.lit(p), F.lit(1)), F.lit(-1))) for k, p in POSTAL.items()]
    return reduce(lambda out, kp: F.when(country == kp[0], kp[1]).otherwise(out), last, F.lit(None).cast("string"))


def grams(c: Column, n: int) -> Column:
    """Distinct runs of n characters; a shorter text is one gram, the empty text none.

    Characters are split once and zipped with themselves, which is linear in the text;
    a substring at every place would walk the text from its start each time.
    """
    size, chars = F.char_length(c), F.split(c, "")
    runs = chars
    for j in range(1, n):
        runs = F.zip_with(runs, F.slice(chars, j + 1, F.greatest(F.size(chars) - j, F.lit(0))), lambda a, b: F.concat(a, b))
    many = F.array_distinct(F.filter(runs, lambda g: g.isNotNull()))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(c)).otherwise(many)


def trigrams(c: Column) -> Column:
    return grams(F.trim(c), 3)


def padded_grams(c: Column, n: int) -> Column:
    """Grams of the text between two marks; none for the empty text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(grams(F.concat(F.lit("$"), c, F.lit("$")), n))


def _replaced(words: Column, table: dict[str, str]) -> Column:
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t), t))


def legal_standard(name_alphanumeric: Column) -> Column:
    return F.array_join(_replaced(tokens(name_alphanumeric), LEGAL_FORMS), " ")


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def lower_letters(c: Column) -> Column:
    """Lower case, letters and numbers only (marks separate too); no composition."""
    return collapse(F.regexp_replace(F.lower(present(c)), r"[^\p{L}\p{N}\s\x1c-\x1f\u0085\p{Z}]", " "))


def experiment_address(c: Column) -> Column:
    """Null words dropped as whole tokens, accents folded, alphanumeric."""
    kept = F.filter(tokens(F.lower(unicode_form(present(c)))), lambda t: ~t.isin(NULL_TOKENS))
    return alphanumeric(fold_latin(F.array_join(kept, " ")))


def expanded_address(base: Column, country: Column) -> Column:
    label = F.lower(F.trim(country))
    words = tokens(base)
    out = reduce(lambda o, kt: F.when(label == kt[0], F.array_join(_replaced(words, kt[1]), " ")).otherwise(o), ABBREVIATIONS.items(), base)
    return out


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)(\d+)"), F.lit(1))


def name_transforms(c: Column) -> dict[str, Column]:
    """The six name normalizations of the experiments."""
    current = name_forms(c)["name_alphanumeric"]
    legal = legal_standard(current)
    return {"A_current": current, "B_lower_punct": lower_letters(c), "C_unicode_accent": current, "D_legal_std": legal, "E_token_sort": sorted_words(current), "F_combined": legal}


def address_transforms(c: Column, country: Column) -> dict[str, Column]:
    """The six address normalizations of the experiments."""
    current = experiment_address(c)
    return {
        "A_current": current,
        "B_lower_punct": lower_letters(c),
        "C_whitespace": collapse(present(c)),
        "D_abbrev": expanded_address(current, country),
        "E_numeric": F.array_join(digit_runs(current), " "),
        "F_token_set": sorted_words(current),
    }
