"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

Texts with equal shingle sets are one node. Shingles are ordered from rare to frequent by
a counting sketch of the whole corpus (any one order keeps the join exact; a good one
keeps prefixes selective). A set's base prefix is so long that two sets that link share
one shingle of it; lengthening it by l-1 shingles demands l shared ones. Each node picks
the l of least estimated cost, from the sketch's counts; a pair is held to the smaller l
of its two nodes. Pairs that pass, and the bounds from sizes and from prefix shingles that
no other node has, are verified on whole sets.

Only classes are wanted, so a bucket of nodes with a common prefix shingle isn't expanded
into all pairs: each bucket's heaviest node is tested against the others first; then only
pairs between nodes of different components remain, all of them in small buckets, and by
rounds of twice as many test nodes in large ones, until no bucket holds an untested pair
of two components. No partner is dropped. Everything is keyed by shingle, node or pair
with partial aggregation, and joins of plain rows that Spark can split; the sketch and
the filter of needed nodes are fixed-size arrays.

Defined results: null and empty texts, and texts without words, have an empty set and
are linked with nothing; rows that share an id are one document; rows without an id keep
a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import checkpointed, mapped, table

#: Words in a shingle; similarity as a fraction; longest l; cost of a verification in scans.
WORDS, NUM, DEN, MOST_MATCHES, VERIFY_COST = 5, 3, 4, 4, 20.0
#: Counters of the sketch: corpus shingles / SHARE, within these powers of two; its pieces.
SHARE, LEAST_BITS, MOST_BITS, SEGMENTS = 64, 10, 26, 64
#: Nodes in a bucket that is expanded at once; test nodes of a large one's first round, and their growth.
SMALL, FIRST_HUBS, GROWTH = 64, 64, 8
#: Plain rows of nodes or edges that are worth a partition, and so a file of a checkpoint.
WORTH = 20_000

_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, end to end, and each text's number of them."""
    n = len(offsets) - 1
    low = K.LOWER[data]
    start, end, text = K.find_words(low, offsets, K.NON_SPACE)
    h = K.span_hashes(low, start, end)
    grams = K.rolling(h, words)
    inside = text[: len(grams)] == text[words - 1 :] if len(grams) else np.empty(0, bool)
    owner, grams = text[: len(grams)][inside], grams[inside]
    counts = np.bincount(text, minlength=n)
    for short in range(1, words):  # the whole sequence as one shingle
        first = np.searchsorted(text, np.flatnonzero(counts == short))
        if len(first):
            whole = np.zeros(len(first), np.uint64)
            for j in range(short):
                whole = K.mix64(whole * _U(0x9FB21C651E98DF25) + h[first + j])
            order = np.argsort(np.append(owner, text[first]), kind="stable")
            owner, grams = np.append(owner, text[first])[order], np.append(grams, whole + _U(short))[order]
    ends = np.searchsorted(owner, np.arange(n + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):  # sorting text by text beats one sort by (text, hash)
        grams[a:b].sort()
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])) if len(grams) else np.empty(0, bool)
    return grams[new], np.bincount(owner[new], minlength=n)


def _nodes(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set (0: empty)."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(K.mix64(grams ^ _U(0xA0761D6478BD642F)), out=total[1:])
    ends = np.cumsum(counts)
    return np.where(counts > 0, K.mix64(total[ends] - total[ends - counts] + counts.astype(np.uint64)) | _U(1), _U(0))


def _each(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in K.chunks(texts):
        grams, counts = shingle_sets(data, offsets, words)
        yield lo, hi, grams, counts, _nodes(grams, counts)


class _Seen:
    """Which nodes this task has met before, by a set of bounded size."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.names, self.most = set(), most

    def new(self, nodes: np.ndarray) -> np.ndarray:
        if len(self.names) > self.most:
            self.names.clear()
        out = np.zeros(len(nodes), bool)
        for i, x in enumerate(nodes.tolist()):
            if x and x not in self.names:
                self.names.add(x)
                out[i] = True
        return out


def members(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, node, n) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, counts, nodes in _each(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(nodes.view(np.int64)), pa.array(counts, pa.int64())], names=["doc_id", "node", "n"])

    return mapped(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, n long")


def _summed(parts: DataFrame, width: int, fold: Callable, kind: str) -> np.ndarray:
    """The driver's copy of an array of fixed size whose pieces many tasks contribute to."""

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in tables:
            for x in batch.column("body"):
                body = np.frombuffer(zlib.decompress(x.as_py()), dtype=kind)
                total = body.copy() if total is None else fold(total, body)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["segment", "body"])

    out = np.zeros(width, dtype=kind)
    size = width // SEGMENTS
    for row in parts.groupBy("segment").applyInArrow(merge, "segment int, body binary").collect():  # SEGMENTS rows
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["body"]), dtype=kind)
    return out


def _pieces(array: np.ndarray) -> pa.RecordBatch:
    parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(np.split(array, SEGMENTS)) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["segment", "body"])


def sketch(docs: DataFrame, bits: int, words: int = WORDS) -> np.ndarray:
    """Counts of the corpus's shingles by the first ``bits`` of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.uint32), _Seen()
        for batch in batches:
            for _, _, grams, sizes, nodes in _each(batch.column(1), words):
                keep = np.repeat(seen.new(nodes), sizes)
                np.add.at(counts, (grams[keep] >> _U(64 - bits)).astype(np.int64), np.uint32(1))
        yield _pieces(counts)

    return _summed(mapped(docs, run, "segment int, body binary"), 1 << bits, lambda a, b: np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32), "uint32")


def rarity(counts: np.ndarray) -> np.ndarray:
    """Each counter's class: 0 where it can't be told from noise, else the logarithm of its count."""
    floor = 2 * counts.mean() + 8 if counts.mean() >= 1 else 1
    return np.where(counts <= floor, 0, np.floor(np.log2(np.maximum(counts, 1)) + 1)).astype(np.uint8)


def needed_overlap(a, b):
    """The least overlap with which sets of these sizes link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefixes(docs: DataFrame, classes: np.ndarray, words: int = WORDS, only: np.ndarray | None = None) -> DataFrame:
    """(token, node, n, place, matches) of the shingles in each node's chosen prefix; matches: its l.

    ``only``: a filter of tokens; those that it excludes are left out (their places stay).
    """
    bits = int(np.log2(len(classes)))
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # one byte a counter of the sketch
    some = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, _Seen()
        for batch in batches:
            for _, _, grams, counts, nodes in _each(batch.column(1), words):
                use = seen.new(nodes)
                keep = np.repeat(use, counts)
                grams, n, node = grams[keep], counts[use].astype(np.int64), nodes[use]
                if not len(grams):
                    continue
                kind = own[(grams >> _U(64 - bits)).astype(np.int64)]
                first = np.cumsum(n) - n
                order = np.concatenate([a + np.argsort(kind[a:b], kind="stable") for a, b in zip(first.tolist(), (first + n).tolist(), strict=True)])
                grams, kind = grams[order], kind[order]
                place = np.arange(len(grams)) - np.repeat(first, n)
                need = -(-NUM * n // DEN)
                base = n - need + 1
                # the other nodes that a shingle is expected to lead to, and their sum over prefixes
                lead = np.where(kind > 0, 2.0 ** np.maximum(0, kind.astype(float) - 0.5) - 1, 0.0)
                total = np.append(0.0, np.cumsum(lead))
                cost = []
                for matches in range(1, MOST_MATCHES + 1):
                    length = np.minimum(n, base + matches - 1)
                    scans = total[first + length] - total[first]
                    leads = np.minimum(total[first + base] - total[first], scans / matches)
                    cost.append(np.where(matches <= need, scans + VERIFY_COST * leads, np.inf))
                matches = np.argmin(np.stack(cost), axis=0) + 1
                inside = place < np.repeat(base + matches - 1, n)
                if some.value is not None:
                    inside[inside] = _passes(some.value, grams[inside])
                columns = (grams[inside].view(np.int64), np.repeat(node, n)[inside].view(np.int64), np.repeat(n, n)[inside].astype(np.int32), place[inside].astype(np.int32), np.repeat(matches, n)[inside].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "place", "matches"])

    return mapped(docs, run, "token long, node long, n int, place int, matches int")


def shared_prefixes(docs: DataFrame, classes: np.ndarray, words: int = WORDS) -> DataFrame:
    """The prefix rows whose token two nodes have.

    With each row's rank among its node's (``own``), and of the node the number of such
    rows, of shingles after its prefix (``rest``), and its weight.
    """
    both = prefixes(docs, classes, words).select("token", "node").groupBy("token").agg(F.min("node").alias("_a"), F.max("node").alias("_b"), F.count(F.lit(1)).alias("_count"))
    both = checkpointed(both.where("_a <> _b").select("token", "_count"))
    only = _filter_of(both.select("token"), both.count())
    kept = prefixes(docs, classes, words, only).join(both, "token")
    # a node's rows are at most its prefix; copies met by several tasks repeat them
    by = W.partitionBy("node").orderBy("place")
    ranked = kept.select("*", (F.dense_rank().over(by) - 1).alias("own"), F.lag("place").over(by).alias("_last"), F.sum("_count").over(W.partitionBy("node")).alias("weight"))
    end = F.col("n") - F.ceil(F.lit(NUM) * F.col("n") / F.lit(DEN)) + F.col("matches")
    ranked = ranked.withColumns({"rows": F.max("own").over(W.partitionBy("node")) + 1, "rest": (F.col("n") - F.least(F.col("n"), end)).cast("int")})
    return ranked.where("_last is null or _last <> place").select("node", "n", "matches", "weight", "own", "rows", "rest", "token", "place")


def _fits(x: str, y: str):
    """Whether two rows of a token can be the first that linked nodes share.

    Sizes must fit. All common shingles lie at or after this one, so what follows it must
    reach the needed overlap. And of the common ones, those that the rest of the longer
    tail can't give must be prefix rows of both nodes, from this row on.
    """
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(nx - F.col(f"{x}.place"), ny - F.col(f"{y}.place"))
    common = F.ceil(F.lit(NUM) * (nx + ny) / F.lit(NUM + DEN)) - F.greatest(f"{x}.rest", f"{y}.rest")
    follow = F.least(F.col(f"{x}.rows") - F.col(f"{x}.own"), F.col(f"{y}.rows") - F.col(f"{y}.own"))
    return (NUM * F.greatest(nx, ny) <= DEN * F.least(nx, ny)) & ((NUM + DEN) * left >= NUM * (nx + ny)) & (follow >= common)


def multi_matched(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs (x, y) whose common prefix shingles are enough.

    They must be as many as the smaller of the two l, within prefixes of that l. And of the
    node whose prefix ends first, all shingles up to there that are common are common
    prefix shingles, so these and what follows its prefix must reach the needed overlap.
    """
    lists = shared.groupBy("node").agg(F.first("n").alias("n"), F.first("matches").alias("matches"), F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("rows"))
    base = F.col("n") - F.ceil(F.lit(NUM) * F.col("n") / F.lit(DEN)) + 1
    lists = lists.select("node", "n", "matches", "rest", base.alias("base"), "rows")
    name = lambda c: [F.col(k).alias(f"{c}_{k}") for k in lists.columns]
    both = pairs.join(lists.select(*name("x")), F.col("x") == F.col("x_node")).join(lists.select(*name("y")), F.col("y") == F.col("y_node"))
    common = F.size(F.array_intersect("x_rows.token", "y_rows.token"))
    both = both.withColumn("_least", F.least("x_matches", "y_matches"))
    both = both.where((NUM + DEN) * (common + F.greatest("x_rest", "y_rest")) >= NUM * (F.col("x_n") + F.col("y_n")))
    inside = lambda c: F.transform(F.filter(f"{c}_rows", lambda r: r["place"] < F.col(f"{c}_base") + F.col("_least") - 1), lambda r: r["token"])
    return both.where(F.size(F.array_intersect(inside("x"), inside("y"))) >= F.col("_least")).select("x", "y")


def _passes(flags: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names a filter of ``_filter_of`` lets through; ``flags`` is packed."""
    bits = int(np.log2(len(flags))) + 3
    at = (K.mix64(names) >> _U(64 - bits)).astype(np.int64)
    return flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def _filter_of(nodes: DataFrame, count: int) -> np.ndarray:
    """A bit for the hash of every name in the first column, in a packed array of bounded size."""
    bits = min(27, max(12, int(np.ceil(np.log2(16 * max(1, count))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[(K.mix64(batch.column(0).to_numpy().view(np.uint64)) >> _U(64 - bits)).astype(np.int64)] = True
        yield _pieces(np.packbits(flags))

    return _summed(mapped(nodes, run, "segment int, body binary"), 1 << (bits - 3), np.bitwise_or, "uint8")


def sets_of(docs: DataFrame, nodes: DataFrame, count: int, words: int = WORDS) -> DataFrame:
    """(node, shingles) of the needed nodes, read again from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(nodes, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, _Seen()
        for batch in batches:
            for _, _, grams, counts, names in _each(batch.column(1), words):
                use = _passes(own, names) & (names != 0)
                use[use] = seen.new(names[use])
                yield pa.RecordBatch.from_arrays([pa.array(names[use].view(np.int64)), K.list_array(grams[np.repeat(use, counts)].view(np.int64), counts[use], pa.int64())], names=["node", "shingles"])

    found = mapped(docs, run, "node long, shingles array<long>").join(nodes, "node", "left_semi")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (x, y) whose whole sets link."""
    n = pairs.count()
    if not n:
        return pairs.limit(0)
    nodes = checkpointed(_few(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), 2 * n))
    count = nodes.count()
    sets = sets_of(docs, nodes, count, words)
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("_x")), "x").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("_y")), "y")
    inter = F.size(F.array_intersect("_x", "_y"))
    return both.where(DEN * inter >= NUM * (F.size("_x") + F.size("_y") - inter)).select("x", "y")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most so many rows, in no more partitions than they are worth."""
    return df.coalesce(1 + rows // WORTH)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of the edges (x, y), by alternating large and small stars."""
    edges = checkpointed(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("comp"))
        mark = now
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy(F.col("x").alias("u")).agg(F.min("y").alias("m"))
        large = both.join(least, F.col("x") == F.col("u")).where("y > x").select(F.col("y").alias("x"), F.least("m", "x").alias("y")).distinct()
        least = large.groupBy(F.col("x").alias("u")).agg(F.min("y").alias("m"))
        small = large.join(least, F.col("x") == F.col("u"))
        small = small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("u", "m")).distinct()
        edges = checkpointed(_few(small, 2 * now[0]))


def node_components(docs: DataFrame, shingles: int, words: int = WORDS) -> DataFrame:
    """(node, comp) of the nodes that are linked with others; ``shingles``: of the corpus, with repeats."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, shingles / SHARE))))))
    shared = checkpointed(shared_prefixes(docs, rarity(sketch(docs, bits, words)), words))
    # Heaviest node of each bucket against the others
    hubs = shared.groupBy("token").agg(F.max(F.struct("weight", "node", "n", "place", "own", "rows", "rest")).alias("_hub")).select("token", "_hub.*")
    star = shared.alias("a").join(hubs.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.node") != F.col("b.node")) & _fits("a", "b"))
    name = lambda df: df.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
    tested = multi_matched(name(star), shared)
    links = checkpointed(verified(checkpointed(tested), docs, words))
    comps = components(links)
    rows, n_hubs = shared, FIRST_HUBS
    while True:
        open_ = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sizes = open_.groupBy("token").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count(F.lit(1)).alias("size"), F.expr("percentile_approx(weight, array(0.5, 0.75, 0.9, 0.95, 0.99, 0.999), 1000)").alias("_heavy"))
        # any choice of test nodes is exact; heavy ones, with few shingles of their own, link most
        share = 1 - F.lit(float(n_hubs)) / F.col("size")
        heavy = F.when(share < 0.5, F.lit(-1)).otherwise(F.get("_heavy", F.when(share < 0.75, 0).when(share < 0.9, 1).when(share < 0.95, 2).when(share < 0.99, 3).when(share < 0.999, 4).otherwise(5)))
        sizes = sizes.where("_a <> _b").select("token", "size", heavy.alias("heavy"))
        rows = checkpointed(open_.join(sizes, "token"))
        test = (F.col("size") <= SMALL) | (F.col("weight") >= F.col("heavy"))
        pair = (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & _fits("a", "b")
        pair = pair & ((F.col("a.size") > SMALL) | (F.col("a.node") < F.col("b.node")))
        found = checkpointed(multi_matched(name(rows.where(test).alias("a").join(rows.alias("b"), pair)), shared))
        if not found.isEmpty():
            new = checkpointed(verified(found, docs, words))
            if not new.isEmpty():
                links = links.union(new)
                comps = components(links)
        rows = rows.where(~test).drop("comp", "size", "heavy")
        n_hubs *= GROWTH
        if rows.isEmpty():
            return comps


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = checkpointed(members(texts, words))
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    # a document's node stands for its text; a text-less document, and each id, is a node of its own
    comps = node_components(texts, shingles, words) if shingles else None
    known = rows.where("node <> 0 and doc_id is not null").select("doc_id", "node").distinct()
    known = known.join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp")) if comps is not None else known.select("doc_id", F.col("node").alias("comp"))
    several = known.distinct().groupBy("doc_id").agg(F.min("comp").alias("y"), F.max("comp").alias("x"))
    clashes = several.where("x <> y").select("x", "y")
    if not clashes.isEmpty():  # rows of one id in two components join them
        chained = known.distinct().join(several, "doc_id").where("comp <> y").select(F.col("comp").alias("x"), "y")
        merged = components(chained).select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
        known = known.join(merged, "comp", "left").select("doc_id", F.coalesce("_to", "comp").alias("comp"))
    known = known.distinct()
    least = known.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = known.join(least, "comp").select(F.col("doc_id").alias("_id"), "component_id")
    return rows.join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: Ids that are broadcast at most; more are joined by shuffling.
MOST_BROADCAST = 1_000_000


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its component; of rows that share an id, one.

    Rows without an id stay.
    """
    found = checkpointed(jaccard_components(docs, id_column, text_column, words).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")))

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids

    losers = small(found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_column)))
    kept = docs.join(losers, id_column, "left_anti").select(*docs.columns)
    repeated = found.where("rows > 1 and component_id = doc_id").select(F.col("doc_id").alias(id_column))
    if repeated.isEmpty():
        return kept
    repeated = small(repeated)
    return kept.join(repeated, id_column, "left_anti").select(*docs.columns).unionByName(kept.join(repeated, id_column, "left_semi").select(*docs.columns).dropDuplicates([id_column]))


def op5_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
