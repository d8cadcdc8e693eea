"""Best-fit-decreasing packing of token sequences.

Texts become token ids in one pass over the corpus; pre-tokens are found with vector
operations and each distinct pre-token is encoded once per worker, which gives the
tokenizer's own ids at a fraction of its cost. Packing needs only the histogram of piece
lengths: documents of one length are interchangeable, so best-fit decreasing runs over
(length, count) with a segment tree over remaining capacities, taking all bins of the
tightest open capacity in one step. The plan is a bounded list of runs, however many
documents there are; each piece finds its run by its rank among pieces of its length.

Defined results: null and empty texts are one piece of the end id alone; repeated rows
are packed like any other rows; an empty table gives an empty result; a text of any
length is cut into pieces of the capacity, the first of which may be shorter.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.llm import kernels as K
from linkloom.llm.common import checkpointed, mapped, table

#: Tokens in a sequence; parts into which the pieces of one length are ranked.
CAPACITY, N_PARTS = 2048, 64
END_ID = 0
#: Pre-tokens kept by a worker before its cache starts anew.
CACHE_PIECES = 1 << 18

_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Byte-level BPE ids of whole texts, through a cache of pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.fast, self.break_id = self._ranked()
        kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
        by_letter = {"L": _LETTER, "N": _NUMBER}
        kinds[:] = [by_letter.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)]
        kinds[_WHITE] = _SPACE
        self.kinds = kinds
        self._reset()

    def _reset(self) -> None:
        self.index = K.HashIndex(np.empty(0, np.uint64), room=CACHE_PIECES)
        self.count, self.used = 0, 0
        self.begin, self.ids = np.zeros(CACHE_PIECES + 1, np.int64), np.zeros(CACHE_PIECES * 4, np.uint32)

    def _ranked(self) -> tuple[object | None, int]:
        """The same vocabulary as merge ranks, if its ids are in the order of its merges."""
        import tiktoken

        model = json.loads(self.model.to_str())["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"].get(m, -1) for m in merges]
        if ids != sorted(set(ids)) or -1 in ids or any(c not in model["vocab"] for c in byte):
            return None, -1
        ranks = {bytes(byte[c] for c in t): model["vocab"][t] for t in [*byte, *merges]}
        return tiktoken.Encoding("ranked", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]

    def _piece_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.fast is None:
            found = [x.ids for x in self.model.encode_batch(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts
        # A line for each pre-token; those with line breaks are encoded alone.
        lines = [t if "\n" not in t else "" for t in texts]
        ids = np.asarray(self.fast.encode_ordinary("\n".join(lines) + "\n"), np.uint32)
        breaks = np.flatnonzero(ids == self.break_id)
        counts = np.diff(breaks, prepend=-1) - 1
        parts = np.split(np.delete(ids, breaks), np.cumsum(counts)[:-1]) if "" in lines else None
        if parts is not None:
            parts = [p if line else np.asarray(self.model.encode(t, add_special_tokens=False).ids, np.uint32) for p, line, t in zip(parts, lines, texts, strict=True)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return np.delete(ids, breaks), counts

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = texts
        flat, counts = self._piece_ids(texts)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[self.count + 1 : self.count + 1 + len(found)] = self.used + np.cumsum(counts)
        self.index.add(hashes, np.arange(self.count, self.count + len(found)))
        self.count, self.used = self.count + len(found), self.used + len(flat)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where pre-tokens start."""
        first = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        n = len(code)
        kind = self.kinds[code]
        edge = np.zeros(n + 1, dtype=bool)
        edge[np.searchsorted(first, offsets)] = True
        begins = np.ones(n, dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
        after = np.flatnonzero(begins[1:] & ~edge[1:n] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
        begins[after - 1] = True
        begins[after[code[after - 1] == 32]] = False
        # 's 't 'm 'd 're 've 'll, where a pre-token would start at the apostrophe
        for at in np.flatnonzero(begins[:-1] & (code[:-1] == 39) & (kind[1:] == _LETTER) & ~edge[1:n]):
            rest = "".join(map(chr, code[at + 1 : at + 3])) if at + 2 < n and not edge[at + 2] else chr(code[at + 1])
            size = 1 if rest[0] in "stmd" else 2 if rest in ("re", "ve", "ll") else 0
            if size:
                begins[at + 1] = False
                if at + 1 + size < n:
                    begins[at + 1 + size] = True
        return first[begins]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and each text's number of them."""
        if len(data) == 0:
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        start = self.starts(data, offsets)
        end = np.append(start[1:], len(data))
        h = K.span_hashes(data, start, end)
        at = self.index.find(h)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh, where = np.unique(h[unknown], return_index=True)
            if self.count + len(fresh) > CACHE_PIECES:
                self._reset()
                fresh, where = np.unique(h, return_index=True)
                unknown = np.arange(len(h))
            if len(fresh) > CACHE_PIECES:  # more distinct pre-tokens in one chunk than the cache holds
                return self._direct(data, offsets)
            where = unknown[where]
            body = data.tobytes()
            self._learn(fresh, [body[s:e].decode("utf-8") for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at[unknown] = self.index.find(h[unknown])
        size = self.begin[at + 1] - self.begin[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(self.begin[at] - total[:-1], size) + np.arange(total[-1])]
        ends = total[np.searchsorted(start, offsets)]
        return ids, np.diff(ends)

    def _direct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body = data.tobytes()
        found = self.model.encode_batch([body[a:b].decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)
        return np.concatenate([np.asarray(x.ids, np.uint32) for x in found]), np.array([len(x.ids) for x in found], np.int64)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _piece_mapper(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                ids, counts = codec.encode(data, offsets)
                rows: list[tuple] = []
                at = 0
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                for name, n in zip(names, counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                    at += n
                    cut = (len(own) - 1) % capacity + 1  # of the first piece
                    for piece, begin in enumerate([0, *range(cut, len(own), capacity)]):
                        part = own[begin : begin + capacity] if begin else own[:cut]
                        rows.append((name, piece, begin, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                heads = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=heads)

    return run


class CapacityTree:
    """A segment tree over remaining capacities that finds the least non-empty one of at least x."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, dtype=bool)

    def set(self, at: int, is_open: bool) -> None:
        node = at + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int:
        node = least + self.size
        if self.open[node]:
            return least
        while node > 1:  # up to the first open subtree on the right, then down its left edge
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return -1


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns runs (length, first rank, end rank, first bin, pieces per bin, offset): the
    pieces of that length and those ranks go to consecutive bins from the first, so many
    to a bin, from that offset on. The bins are those that best-fit decreasing would
    choose document by document, up to the names of bins of equal capacity.
    """
    tree, free, bins = CapacityTree(capacity), {}, 0
    runs: list[tuple[int, int, int, int, int, int]] = []

    def put(left: int, first: int, n: int) -> None:
        if n:
            free.setdefault(left, deque()).append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, per = capacity, capacity // length
                first, n = bins, -(-todo // per)
                bins += n
            else:
                per = left // length
                first, have = free[left].popleft()
                n = min(have, -(-todo // per))
                if n < have:
                    free[left].appendleft((first + n, have - n))
                if not free[left]:
                    tree.set(left, False)
            took = min(todo, n * per)
            runs.append((length, rank, rank + took, first, per, capacity - left))
            put(left - per * length, first, took // per)
            put(left - (took % per) * length, first + took // per, bool(took % per))
            rank, todo = rank + took, todo - took
    return runs


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's token ids and the end id."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return mapped(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), _piece_mapper(path, capacity, with_ids), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``, best fit decreasing.

    ``pieces`` is read three times, so pass a checkpoint or a stored table.
    """
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(N_PARTS)).cast("int")
    rows = pieces.withColumn("_part", part)
    parts = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))  # at most capacity * N_PARTS rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    ahead = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("length", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    order = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("_own", F.row_number().over(order) - 1)
    rows = rows.join(F.broadcast(parts), ["length", "_part"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    runs = spark.createDataFrame(best_fit_runs(counts, capacity) or [(0, 0, 0, 0, 1, 0)], "length long, _lo long, _hi long, _bin long, _per long, _at long")
    placed = rows.join(F.broadcast(runs), "length").where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    step = F.col("_rank") - F.col("_lo")
    return placed.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + step % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of all documents with their places in the packed sequences."""
    return pack(checkpointed(token_pieces(docs, path or default_tokenizer(), capacity, id_column, text_column, with_ids)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
