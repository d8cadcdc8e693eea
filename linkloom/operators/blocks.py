"""Pairs of entities that share enough keys, decided block beside block.

Where most entities share some frequent word, the shared words are many times the pairs, and
counting them by a shuffle costs as much. Here the most frequent keys of a country are bits
of a few words; blocks of both sides meet, and a pair is decided where it meets from its bits
and, where these don't settle it, from the rest of the keys. A pair is neither shuffled nor
made distinct: its members are written out in place.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.classes import LIST, OUTER, Classes, Route, listed, written_out
from linkloom.plans.entities import stored

#: About so many members are in a block.
BLOCK = 2048
#: Words of 64 bits: one bit for each of a country's most frequent keys, and hashed bits of the others.
FREQUENT, HASHED = 16, 8


def _postings(rows: DataFrame, keys: str) -> DataFrame:
    return rows.where("country_cleaned <> ''").select(F.col("country_cleaned").alias("cc"), F.explode(F.array_distinct(F.col(keys))).alias("key"), F.col("entity_id").alias("class"))


def _numbered(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cc, key, number, bit) of the keys that both sides have, stored; the keys with the most pairs have a bit."""
    counts = lambda df, n: df.groupBy("cc", "key").agg(F.count(F.lit(1)).alias(n))
    both = stored(counts(a, "_n").join(counts(b, "_m"), ["cc", "key"]).select("cc", "key", (F.col("_n") * F.col("_m")).alias("_pairs")).withColumn("number", F.monotonically_increasing_id()))
    rank = F.row_number().over(W.partitionBy("cc").orderBy(F.desc("_pairs"), "key"))
    first = both.withColumn("_r", rank).where(F.col("_r") <= 64 * FREQUENT).select("cc", "key", (F.col("_r") - 1).alias("bit"))
    return stored(both.drop("_pairs").join(first, ["cc", "key"], "left"))


def _words(name: str, n: int) -> list[Column]:
    """The bits of a column as n words of 64 bits; null sets none."""
    return [F.expr(f"bit_or(CASE WHEN {name} div 64 = {i} THEN shiftleft(1L, CAST({name} % 64 AS INT)) ELSE 0L END)").alias(f"_{name}{i}") for i in range(n)]


def _side(postings: DataFrame, numbered: DataFrame, members: Classes, keys: str, most: int) -> DataFrame:
    """(cc, ids, bits and other keys) of each list of members."""
    hashed = F.when(F.col("bit").isNull(), F.expr(f"pmod(xxhash64(number), {64 * HASHED})")).alias("hash")
    found = postings.join(numbered, ["cc", "key"]).select("cc", "class", "bit", "number", hashed)
    rows = found.groupBy("cc", "class").agg(*_words("bit", FREQUENT), *_words("hash", HASHED), F.collect_list(F.when(F.col("bit").isNull(), F.col("number"))).alias("_rest"))
    return rows.join(members.lists("class", "_ids", most), "class").drop("class")


def _blocks(side: DataFrame) -> DataFrame:
    """(cc, the number of blocks) of a side, which has a list of members in each row."""
    return side.groupBy("cc").agg(F.ceil(F.sum(F.size("_ids")) / BLOCK).cast("long").alias("_blocks"))


def sharing(keys: str, least: int, route: Route):
    """Writes out the pairs of members that share at least so many keys. ``route`` finds those of ids of several rows, which count a key for each."""

    def run(a: Classes, b: Classes) -> DataFrame:
        several = [stored(x.rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("entity_id")) for x in (a, b)]
        one, more = ([x.rows.join(y, "entity_id", how) for x, y in zip((a, b), several, strict=True)] for how in ("left_anti", "left_semi"))
        posts = [_postings(x, keys) for x in one]
        numbered = _numbered(*posts)
        s, t = (stored(_side(p, numbered, x, keys, n)) for p, x, n in zip(posts, (a, b), (OUTER, LIST), strict=True))
        counts = stored(_blocks(s).withColumnRenamed("_blocks", "_ns").join(_blocks(t).withColumnRenamed("_blocks", "_nt"), "cc"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        cells = stored(counts.select("cc", "_nt", every("_ns").alias("_i")).select("cc", "_i", every("_nt").alias("_j")))
        dealt = lambda df, n, i: df.join(counts.select("cc", n), "cc").withColumn(i, F.pmod(F.xxhash64("_ids"), F.col(n))).drop(n).join(cells, ["cc", i])
        named = lambda df, p: df.select("cc", "_i", "_j", *[F.col(c).alias(p + c) for c in df.columns if c not in ("cc", "_i", "_j")])
        s, t = named(dealt(s, "_ns", "_i"), "s"), named(dealt(t, "_nt", "_j"), "t")
        both = lambda name, n: [F.col(f"s_{name}{i}").bitwiseAND(F.col(f"t_{name}{i}")) for i in range(n)]
        frequent = reduce(add, [F.bit_count(x) for x in both("bit", FREQUENT)])
        maybe = reduce(lambda x, y: x.bitwiseOR(y), both("hash", HASHED)) != 0
        enough = (frequent >= least) | (maybe & (frequent + F.size(F.array_intersect("s_rest", "t_rest")) >= least))
        met = s.alias("s").join(t.alias("t"), (F.col("s.cc") == F.col("t.cc")) & (F.col("s._i") == F.col("t._i")) & (F.col("s._j") == F.col("t._j")) & enough)
        found = met.select(F.col("s_ids").alias("_s"), F.col("t_ids").alias("_t"))
        if not all(x.isEmpty() for x in several):
            found = found.unionByName(listed(route(more[0], b.rows).unionByName(route(one[0], more[1])), a, b))
        return written_out(found)

    return run
