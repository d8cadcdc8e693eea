"""Benchmark decontamination by canonical templates.

Words of texts and benchmark items become template words: numbers, names and units turn
into typed placeholders, so that a question with other numbers and names has the same
template. Windows of ``WINDOW`` template words are hashed and joined by hash. Hits are
gathered by text, item and offset diagonal; a passage counts when the windows on nearby
diagonals cover enough of the item and its slots are filled consistently: wherever the
item repeats a value, the passage repeats its own.

The benchmark's windows are a hash table in every worker, built from blocks of at most
``BLOCK_WINDOWS`` windows; a larger benchmark takes as many passes over the corpus as it
has blocks, so its size is never a limit and no text is shuffled.

Defined results: null and empty texts match nothing; items shorter than a window match
by a window of their own length, and items under ``LEAST_WORDS`` words only texts of
exactly their words; every window also matches its own words, so copies are found whatever
the words around them make of a capital; the first word of an item may be a name in a text;
template windows with too few plain words aren't used unless they are all an item has; repeated rows are reported each; ids may be null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import mapped, table

#: Words in a window; plain words that it needs; words of an item that a passage must hold
#: (all of a shorter item's); gap between diagonals of one passage; smallest item that
#: matches inside texts; windows in a block of the benchmark.
WINDOW, PLAIN, LEAST_MATCH, NEAR, LEAST_WORDS, BLOCK_WINDOWS = 8, 4, 13, 2, 5, 1 << 20

_U = np.uint64
_NUMBER, _NAME, _UNIT = (_U(x) for x in (0x1B873593CC9E2D51, 0x38495AB5E6546B64, 0x85EBCA6BC2B2AE35))

# Units of measure and money, and number words and first names that are slots anywhere.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters dollar dollars euro euros cent cents usd eur percent degree degrees mph kmh watt watts volt volts".split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
NAMES = "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew peter george kevin brian tom tim sam ben jack alex mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty anna emma maria laura julia alice jane kate lucy amy bob natalia weng".split()


def _word_set(words: list[str]) -> np.ndarray:
    data, offsets = K.column_bytes(pa.array(words))
    return np.unique(K.span_hashes(data, offsets[:-1], offsets[1:]))


_SETS: dict[str, K.HashIndex] = {}


def _is_in(h: np.ndarray, name: str) -> np.ndarray:
    if not _SETS:
        _SETS.update({k: K.HashIndex(_word_set(w)) for k, w in (("unit", UNITS), ("number", NUMBER_WORDS), ("name", NAMES))})
    return _SETS[name].find(h) >= 0


@dataclass
class Words:
    """The words of a chunk of texts: text number, plain hash, template hash, and whether each is a slot."""

    text: np.ndarray
    plain: np.ndarray
    template: np.ndarray
    slot: np.ndarray


def canonical(data: np.ndarray, offsets: np.ndarray) -> Words:
    digit = (data >= 0x30) & (data <= 0x39)
    inside = K.ALNUM[data]
    if len(data) > 2:  # 1,000 and 2.5 are one word
        point = ((data[1:-1] == 0x2C) | (data[1:-1] == 0x2E)) & digit[:-2] & digit[2:]
        inside = inside.copy()
        inside[1:-1] |= point
    start, end, text = K.find_words(data, offsets, mask=inside)
    # capitals of U+00C0 to U+00DE are the bytes C3 80 to C3 9E, their small forms 32 further
    accented = np.zeros(len(data) + 2, bool)
    accented[1 : len(data)] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = K.LOWER[data]
    low[accented[: len(data)]] += 32
    plain = K.span_hashes(low, start, end)
    if not len(start):
        return Words(text, plain, plain, np.empty(0, bool))
    number = digit[start] | _is_in(plain, "number")
    unit = np.zeros(len(start), bool)
    unit[1:] = _is_in(plain, "unit")[1:] & number[:-1] & (text[1:] == text[:-1])
    # A capital inside a sentence that isn't all capitals: a name. Between it and the word before stand only blanks and soft marks.
    capital = np.append((data >= 0x41) & (data <= 0x5A), [False] * 2) | np.append(accented[1:], False)
    follows = start + 1 + accented[start + 1]
    upper, small = capital[start], (follows < end) & ~capital[follows]
    soft = np.zeros(256, bool)
    soft[[0x20, 0x2C, 0x27, 0x22, 0x28, 0x2D, 0x3A]] = True
    hard = np.append(0, np.cumsum(~soft[data] & ~inside))
    middle = np.zeros(len(start), bool)
    middle[1:] = (text[1:] == text[:-1]) & (hard[start[1:]] == hard[end[:-1]])
    name = (upper & small & middle) | _is_in(plain, "name")
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, plain)))
    return Words(text, plain, template, number | unit | name)


@dataclass
class Block:
    """Windows of some benchmark items: by length a hash index, and the (item, place) pairs of each hash."""

    names: list
    words: list[np.ndarray]  # each item's plain hashes
    templates: list[np.ndarray]
    slots: list[np.ndarray]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # distinct hashes, first pair, item, place


def build_blocks(items: Iterable[tuple], most: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The items' windows in blocks of at most ``most`` windows (one item at least)."""
    held: list[tuple] = []
    size = 0

    def block() -> Block:
        by_length: dict[int, list] = defaultdict(list)
        for i, (_, words, template, slot) in enumerate(held):
            n = len(template)
            k = min(WINDOW, n)
            if not k:
                continue
            h = K.rolling(template, k)
            plain = np.convolve(~slot, np.ones(k, int), "valid")
            use = plain >= min(PLAIN, k)
            forms = [(h[use], np.flatnonzero(use))] if use.any() else [(h, np.arange(len(h)))]
            verbatim = np.flatnonzero(plain < k)  # the other windows are their own plain form
            forms.append((K.rolling(words, k)[verbatim], verbatim))
            if n >= LEAST_WORDS and not slot[0] and plain[0] > min(PLAIN, k):
                forms.append((K.rolling(np.append(_NAME, template[1:k]), k), np.zeros(1, int)))
            h, place = (np.concatenate(x) for x in zip(*forms, strict=True))
            by_length[k].append((h, np.full(len(h), i), place))
        windows = {}
        for k, parts in by_length.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, item, h))
            h, item, place = h[order], item[order], place[order]
            keys, first = np.unique(h, return_index=True)
            windows[k] = (keys, np.append(first, len(h)), item, place)
        return Block(*([x[j] for x in held] for j in range(4)), windows)

    for name, text in items:
        w = canonical(*K.column_bytes(pa.array([text or ""])))
        n = 2 * max(1, len(w.plain) - WINDOW + 1) + 1  # template and plain forms, and the first word as a name
        if held and size + n > most:
            yield block()
            held, size = [], 0
        held.append((name, w.plain, w.template, w.slot))
        size += n
    if held:
        yield block()


def consistent(item: np.ndarray, passage: np.ndarray) -> bool:
    """Equal values of the item go with equal values of the passage; different ones may become equal."""
    pairs = set(zip(item.tolist(), passage.tolist(), strict=True))
    return len(pairs) == len({a for a, _ in pairs})


def _extend(covered: np.ndarray, said: np.ndarray, d: int, k: int, words: np.ndarray, item: np.ndarray, plain: np.ndarray, template: np.ndarray) -> None:
    """Cover an item's further windows on a diagonal that a window was found on: those with few plain words, which aren't in the table."""
    lo, hi = max(0, -d), min(len(words), len(plain) - d)
    if hi - lo < k:
        return
    equal = (template[lo + d : hi + d] == item[lo:hi]) | (plain[lo + d : hi + d] == words[lo:hi])
    whole = np.convolve(equal, np.ones(k, int), "valid") == k
    at = lo + np.flatnonzero(np.convolve(whole, np.ones(k, int)) > 0)
    at = at[~covered[at]]
    covered[at], said[at] = True, at + d


def match(w: Words, n_texts: int, block: Block, indexes: dict[int, K.HashIndex]) -> list[tuple]:
    """(text number, item number, first word, end word, covered words, slots, same values) of every passage."""
    sizes = np.bincount(w.text, minlength=n_texts)
    first = np.cumsum(sizes) - sizes
    out = []
    for k, (_, pair, item, place) in block.windows.items():
        h, own = K.rolling(w.template, k), K.rolling(w.plain, k)
        if not len(h):
            continue
        inside = w.text[: len(h)] == w.text[k - 1 :]
        other = np.flatnonzero(inside & (h != own))
        pos = np.append(np.flatnonzero(inside), other)
        at = indexes[k].find(np.append(h[inside], own[other]))
        hit = at >= 0
        pos, at = pos[hit], at[hit]
        if not len(pos):
            continue
        many = pair[at + 1] - pair[at]
        row = np.repeat(pair[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pos = np.repeat(pos, many)
        text, item_, place_ = w.text[pos], item[row], place[row]
        local = pos - first[text]
        order = np.lexsort((local, local - place_, item_, text))
        text, item_, place_, local = text[order], item_[order], place_[order], local[order]
        diagonal = local - place_
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item_[1:] != item_[:-1]) | (diagonal[1:] - diagonal[:-1] > NEAR)))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(text)], strict=True):
            i, t = int(item_[a]), int(text[a])
            words, n = block.words[i], len(block.words[i])
            covered, said = np.zeros(n, bool), np.zeros(n, np.int64)
            verbatim = lambda x: bool((w.plain[first[t] + x[0] : first[t] + x[0] + k] == words[x[1] : x[1] + k]).all())
            for p, q in sorted(zip(local[a:b].tolist(), place_[a:b].tolist(), strict=True), key=verbatim):  # verbatim hits have the last word
                covered[q : q + k] = True
                said[q : q + k] = np.arange(p, p + k)
            if covered.sum() < min(n, LEAST_MATCH):
                for d in np.unique(local[a:b] - place_[a:b]).tolist():
                    _extend(covered, said, d, k, words, block.templates[i], w.plain[first[t] : first[t] + sizes[t]], w.template[first[t] : first[t] + sizes[t]])
            if covered.sum() < min(n, LEAST_MATCH) or (n < LEAST_WORDS and sizes[t] != n):
                continue
            slot = np.flatnonzero(covered & block.slots[i])
            values = w.plain[first[t] + said[slot]]
            if len(slot) and not consistent(words[slot], values):
                continue
            same = bool((w.plain[first[t] + said[covered]] == words[covered]).all())
            out.append((t, i, int(local[a:b].min()), int(local[a:b].max()) + k, int(covered.sum()), len(slot), same))
    return out


def _blocks_of(benchmark: DataFrame, item_column: str, text_column: str, most: int) -> Iterator[Block]:
    items = benchmark.select(F.col(item_column).alias("item_id"), F.col(text_column).cast("string").alias("text")).where("text is not null").distinct().orderBy("item_id", "text")
    return build_blocks(map(tuple, items.toLocalIterator()), most)  # one partition of the benchmark, then one block at a time


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row for every passage of an item in a text: ids, word span, share of the item, slots, and whether its values are the item's."""
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, end_word long, coverage double, slots int, same_values boolean"
    def scan(block: Block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_windows windows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            indexes = {k: K.HashIndex(x[0]) for k, x in own.windows.items()}
            for batch in batches:
                for lo, hi, data, offsets in K.chunks(batch.column(1)):
                    found = match(canonical(data, offsets), hi - lo, own, indexes)
                    ids = batch.column(0).slice(lo, hi - lo)
                    columns = list(zip(*found, strict=True)) if found else [()] * 7
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(columns[0], pa.int64())),
                            pa.array([own.names[i] for i in columns[1]], type=pa.int64() if item_kind == "bigint" else None),
                            pa.array(columns[2], pa.int64()),
                            pa.array(columns[3], pa.int64()),
                            pa.array([c / len(own.words[i]) for c, i in zip(columns[4], columns[1], strict=True)], pa.float64()),
                            pa.array(columns[5], pa.int32()),
                            pa.array(columns[6], pa.bool_()),
                        ],
                        names=["doc_id", "item_id", "first_word", "end_word", "coverage", "slots", "same_values"],
                    )

        return mapped(texts, run, schema)

    scans = [scan(b) for b in _blocks_of(benchmark, item_column, item_text_column, block_windows)]
    return reduce(DataFrame.unionByName, scans) if scans else docs.sparkSession.createDataFrame([], schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows, with all their columns, that hold no passage of any item."""
    at = docs.columns.index(text_column)

    def without(rows: DataFrame, block: Block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            indexes = {k: K.HashIndex(x[0]) for k, x in own.windows.items()}
            for batch in batches:
                for lo, hi, data, offsets in K.chunks(batch.column(at)):
                    keep = np.ones(hi - lo, bool)
                    keep[[t for t, *_ in match(canonical(data, offsets), hi - lo, own, indexes)]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        return mapped(rows, run, docs.schema)

    return reduce(without, _blocks_of(benchmark, item_column, item_text_column, block_windows), docs)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
