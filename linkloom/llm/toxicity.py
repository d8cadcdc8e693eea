"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

Examples are at most ``LIMIT`` labelled texts a class, near copies among them counted
once. Class terms are words and word beginnings whose document frequencies differ between
the classes beyond chance; a text that holds any is compared by its TF-IDF over these.
Their votes, weighted by squared cosine, become probabilities by logistic calibration on
leave-one-out votes. A text that holds none is compared by its TF-IDF over all words with
the examples that hold none either, and those of a cosine of ``LEAST_COSINE`` or more vote,
so that a copy of an example whose words are all rare is found as well.

Examples are numbered in blocks, and both indexes keep for every term and block the
largest weight: a block is opened only while the sum of its maxima can still reach the k
best, so the k nearest are exact. The indexes are bounded by the examples and broadcast;
scoring is one map over all texts, with the nearest examples as evidence.

Defined results: a null or empty text, or one without class terms and neighbours, scores
the share of toxic texts among labelled texts without class terms; ties between examples
go to the smaller number; without labels of both classes every text scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import checkpointed, fold, give_back, labelled, mapped, table
from linkloom.llm.quality import calibrate

#: Labelled texts a class at most; neighbours; examples in a block; bytes of word beginnings;
#: least chi-square of a term; least texts with a term; terms at most; threshold.
LIMIT, NEAREST, BLOCK, PREFIXES, CHI2, MIN_TEXTS, MAX_TERMS, THRESHOLD = 1500, 15, 64, (4, 5, 6), 30.0, 5, 4096, 0.3

#: Least cosine over all words of an example that votes on a text without class terms.
LEAST_COSINE = 0.5
#: Equal min-hashes, of 24, that make two examples near copies.
ALIKE = 12
#: Texts that are tried against all examples at once, and postings that are added up at once.
SIDE, POSTINGS = 128, 1 << 19
#: Blocks that are opened before any bound is tested.
FIRST_BLOCKS = 3
#: A mark for terms that a text holds so many times, and for those held twice or more at so many a thousand words.
TIMES, RATES = (2, 3, 5, 8), (2, 4, 8, 16)

_U = np.uint64
_EMPTY = (np.empty(0, np.int64), np.empty(0, np.uint64))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of every occurrence of a word or word beginning; those of words come first."""
    low = K.LOWER[data]
    start, end, text = K.find_words(low, offsets)
    if not len(start):
        return _EMPTY
    ends = [end] + [np.minimum(end, start + n) for n in PREFIXES]
    hashes = K.span_hashes(low, np.tile(start, len(ends)), np.concatenate(ends)).reshape(len(ends), -1)
    keep = [np.ones(len(start), bool)] + [end - start > n for n in PREFIXES]
    hashes = hashes + np.arange(len(ends), dtype=np.uint64)[:, None] * _U(0x2545F4914F6CDD1D) * (np.arange(len(ends)) > 0)[:, None].astype(np.uint64)
    return np.concatenate([text[k] for k in keep]), np.concatenate([h[k] for h, k in zip(hashes, keep, strict=True)])


def _counted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.empty(0, np.int64)
    return text[new], h[new], np.diff(np.append(new, len(h)))


def marked(text: np.ndarray, h: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count, plain term) of the plain terms and of their marks; ``words``: of each text."""
    out = [(text, h, n, h)]
    rate = n * 1000.0 / np.maximum(1, words[text]) if len(text) else np.empty(0)
    for i, fits in enumerate([n >= c for c in TIMES] + [(n >= 2) & (rate >= c) for c in RATES]):
        out.append((text[fits], h[fits] + _U((i + 1) * 0x5851F42D4C957F2D & (2**64 - 1)), np.ones(int(fits.sum()), n.dtype), h[fits]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def least_hashes(plain: np.ndarray, n: int = 24) -> list[int]:
    """Min-hashes of a text's plain terms; none for a text without."""
    if not len(plain):
        return []
    return [int(K.mix64(plain ^ salt).min().view(np.int64)) for salt in np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)]


def _words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bincount(K.find_words(data, offsets)[2], minlength=len(offsets) - 1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(1)):
            text, h = terms(data, offsets)
            size = _words(data, offsets)
            own, word, times = _counted(text[: size.sum()], h[: size.sum()])
            text, h, n, plain = marked(*_counted(text, h), size)
            order = np.argsort(text, kind="stable")
            counts = np.bincount(text, minlength=hi - lo)
            lists = [K.list_array(x[order], counts, k) for x, k in ((h.view(np.int64), pa.int64()), (n, pa.int32()), (plain.view(np.int64), pa.int64()))]
            lists += [K.list_array(x, np.bincount(own, minlength=hi - lo), k) for x, k in ((word.view(np.int64), pa.int64()), (times, pa.int32()))]
            ends = np.append(0, np.cumsum(counts))
            low = pa.array([least_hashes(plain[order][a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists, low], names=["_id", "y", "terms", "counts", "plain", "words", "times", "low"])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges lo to hi, end to end, and the ranges' sizes."""
    size = (hi - lo).astype(np.int64)
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


@dataclass
class WordIndex:
    """Unit TF-IDF vectors of examples over all their words, by word in order of examples, with block maxima.

    Examples without words here (those that class terms speak for) have no postings. A
    word's postings in one block are an entry, which keeps their largest weight.
    """

    keys: np.ndarray  # word hashes
    idf: np.ndarray
    unseen: float  # idf of a word that no example has
    entries: np.ndarray  # begin of each word's, and the end
    block: np.ndarray  # of each entry
    most: np.ndarray  # weight in each entry
    begin: np.ndarray  # of each entry's postings, and the end
    example: np.ndarray
    weight: np.ndarray
    mass: np.ndarray  # of each example: how many texts of the corpus it stands for, one on average

    def weights(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF of words by their places, -1 for unseen ones."""
        return (1 + np.log(counts)) * np.where(at >= 0, self.idf[at] if len(self.idf) else self.unseen, self.unseen)

    def hopeful(self, text: np.ndarray, at: np.ndarray, v: np.ndarray, least: float = LEAST_COSINE) -> np.ndarray:
        """Which texts, by number, may have an example with a cosine of ``least`` or more.

        The words of a text whose weights have a norm of less than half of ``least`` together,
        the lightest ones, can't give the other half; so the heavier ones must, and only their
        postings, which are few, are added up. ``text`` ascends from 0.
        """
        n = int(text[-1]) + 1 if len(text) else 0
        order = np.lexsort((-v, text))
        text, at, v = text[order], at[order], v[order]
        upto = np.cumsum(v * v)
        ends = np.searchsorted(text, np.arange(n), side="right")
        heavy = (upto[ends - 1][text] - upto + v * v >= (least / 2 - 1e-6) ** 2) if n else np.empty(0, bool)
        text, at, v = text[heavy], at[heavy], v[heavy]
        lo, hi = self.begin[self.entries[at]], self.begin[self.entries[at + 1]]
        ends = np.searchsorted(text, np.arange(n + 1))
        upto = np.append(0, np.cumsum(hi - lo, dtype=np.int64))[ends]
        out, first = np.zeros(n, bool), 0
        while first < n:  # as many texts at once as SIDE and POSTINGS let, one at least
            last = max(first + 1, min(first + SIDE, int(np.searchsorted(upto, upto[first] + POSTINGS, side="right")) - 1))
            part = slice(ends[first], ends[last])
            posts, size = _ranges(lo[part], hi[part])
            cell = np.repeat(text[part] - first, size) * len(self.mass) + self.example[posts]
            total = np.bincount(cell, np.repeat(v[part], size) * self.weight[posts], (last - first) * len(self.mass))
            out[first:last] = (total.reshape(last - first, -1) >= least / 2 - 1e-6).any(axis=1)
            first = last
        return out

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int = NEAREST, least: float = LEAST_COSINE) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, cosines, blocks opened) of the exact k nearest with a cosine of ``least`` or more.

        ``v``: the weights of the words that examples have, of a vector of length 1. An example
        that shares none of the heaviest words, up to where the others' norm is less than
        ``least``, can't reach it; so only blocks with one of those are bounded at all.
        """
        nothing = np.empty(0, np.int64), np.empty(0), 0
        order = np.argsort(-v, kind="stable")
        at, v = at[order], v[order]
        after = np.sqrt(np.append(np.cumsum((v * v)[::-1])[::-1], 0.0))
        needed = int(np.argmax(after < least - 1e-6))
        if not needed:
            return nothing
        rows, size = _ranges(self.entries[at], self.entries[at + 1])
        some = np.zeros(int(self.block.max()) + 1, bool)
        some[self.block[rows[: size[:needed].sum()]]] = True
        scale = np.repeat(v, size)
        keep = some[self.block[rows]]
        rows, scale = rows[keep], scale[keep]
        bound = np.bincount(self.block[rows], scale * self.most[rows], len(some))
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[bound[blocks] >= least - 1e-6]
        best, score, opened = *nothing[:2], 0
        while len(blocks):
            floor = least if len(best) < k else max(least, score[-1])
            blocks = blocks[bound[blocks] >= floor - 1e-6]
            batch, blocks = blocks[: len(blocks) if opened else FIRST_BLOCKS], blocks[len(blocks) if opened else FIRST_BLOCKS :]
            if not len(batch):
                break
            opened += len(batch)
            into = np.isin(self.block[rows], batch)
            posts, own = _ranges(self.begin[rows[into]], self.begin[rows[into] + 1])
            total = np.bincount(self.example[posts], np.repeat(scale[into], own) * self.weight[posts])
            got = np.flatnonzero(total >= least)
            best, score = np.append(best, got), np.append(score, total[got])
            top = np.lexsort((best, -np.round(score, 6)))[:k]
            best, score = best[top], score[top]
        return best, score, opened


def index_words(sets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, shares: tuple[float, float]) -> WordIndex:
    """``sets``, ``counts``: the examples' distinct word hashes and their numbers, in the order of the class index."""
    n = len(sets)
    example = np.repeat(np.arange(n), [len(s) for s in sets])
    keys, word, df = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    idf = np.log((1 + n) / (1 + df)) + 1
    weight = (1 + np.log(np.concatenate([np.empty(0), *counts]))) * idf[word]
    weight = weight / np.sqrt(np.bincount(example, weight * weight, n))[example]  # only examples with words are asked for
    order = np.lexsort((example, word))
    word, example, weight = word[order], example[order].astype(np.int32), weight[order].astype(np.float32)
    block = example // BLOCK
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1]))) if len(word) else np.empty(0, np.int64)
    most = np.maximum.reduceat(weight, new) if len(new) else weight
    sizes = np.bincount(y, minlength=2)
    mass = np.where(y == 1, shares[1] / sizes[1], shares[0] / sizes[0]) * n
    return WordIndex(keys, idf, float(np.log(1 + n) + 1), np.searchsorted(word[new], np.arange(len(keys) + 1)).astype(np.int32), block[new].astype(np.int32), most, np.append(new, len(word)).astype(np.int32), example, weight, mass)


@dataclass
class Index:
    """Examples' TF-IDF vectors by term, in order of examples, with block maxima."""

    keys: np.ndarray  # term hashes
    plain: np.ndarray  # hashes of the terms without marks that any of them needs
    idf: np.ndarray
    begin: np.ndarray  # of each term's postings in each block, and their end
    example: np.ndarray
    weight: np.ndarray
    block_max: np.ndarray  # terms x blocks
    toxic: np.ndarray
    names: list
    slope: float = 0.0
    shift: float = 0.0
    alone: float = 0.0  # probability of a text without terms
    words: WordIndex | None = None

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[at]
        return v / np.linalg.norm(v) if len(v) else v

    def _totals(self, at: np.ndarray, v: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of some blocks with a positive cosine, and it: sums over the terms' postings in those blocks."""
        lo, hi = self.begin[at][:, chosen].ravel(), self.begin[at][:, chosen + 1].ravel()
        size = hi - lo
        before = np.cumsum(size) - size
        rows = np.repeat(lo - before, size) + np.arange(size.sum())
        total = np.bincount(self.example[rows], np.repeat(np.repeat(v, len(chosen)), size) * self.weight[rows], len(self.toxic))
        got = np.flatnonzero(total > 0)
        return got, total[got]

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, cosines, blocks opened) of the exact k nearest with a positive cosine.

        The blocks of highest bound are opened first; the k-th best cosine in them then
        says which others can matter, and only those are opened.
        """
        bound = v @ self.block_max[at]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score, opened = np.empty(0, np.int64), np.empty(0), 0
        while len(order):
            least = -np.inf if len(best) < k else score[-1] - 1e-9
            order = order[bound[order] >= least]
            batch, order = order[: FIRST_BLOCKS if not opened else len(order)], order[FIRST_BLOCKS if not opened else len(order) :]
            if not len(batch):
                break
            opened += len(batch)
            got, total = self._totals(at, v, batch)
            if without >= 0:
                got, total = got[got != without], total[got != without]
            best, score = np.append(best, got), np.append(score, total)
            top = np.lexsort((best, -np.round(score, 12)))[:k]
            best, score = best[top], score[top]
        return best, score, opened

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        """The share of toxic votes, weighted by squared cosine, with one vote of none."""
        w = score * score
        return float((w * self.toxic[best]).sum() / (w.sum() + 0.05))

    def word_vote(self, best: np.ndarray, score: np.ndarray) -> float:
        """The share of toxic texts that the neighbours over all words stand for, with few texts without neighbours."""
        w = score * score * self.words.mass[best]
        return float(((w * self.toxic[best]).sum() + 0.05 * self.alone) / (w.sum() + 0.05))

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * votes + self.shift, -500, 500)))


def _distinct_texts(lows: list, labels: np.ndarray) -> list[int]:
    """Numbers of the examples that stay when near copies of a class count once (min-hash bands, then ``ALIKE`` of all min-hashes)."""
    seen: dict[tuple, list[int]] = {}
    keep = []
    for i, low in enumerate(lows):
        bands = [(int(labels[i]), b, *low[b : b + 4]) for b in range(0, len(low), 4)]
        rivals = {j for b in bands for j in seen.get(b, ())}
        if not any(sum(x == y for x, y in zip(low, lows[j], strict=True)) >= ALIKE for j in rivals):
            for b in bands:
                seen.setdefault(b, []).append(i)
            keep.append(i)
    return keep


def choose(df: np.ndarray, df1: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the terms kept, given the texts of both classes and of class 1 with each, and the classes' sizes."""
    n = sizes.sum()
    df0 = df - df1
    gap = df1 * (sizes[0] - df0) - df0 * (sizes[1] - df1)
    chi2 = n * gap**2 / np.maximum(1e-9, df * (n - df) * sizes[0] * sizes[1])
    ratio = np.log((df1 + 0.5) / (sizes[1] + 1)) - np.log((df0 + 0.5) / (sizes[0] + 1))
    # chance alone gives small samples large ratios; a term must pass both
    chosen = np.flatnonzero((df >= least_texts(n)) & (chi2 >= min(CHI2, n / 20)) & (np.abs(ratio) > np.log(6)))
    return np.sort(chosen[np.argsort(-chi2[chosen], kind="stable")[:MAX_TERMS]])


def least_texts(n: float) -> int:
    return min(MIN_TEXTS, max(1, int(n) // 20))


def assemble(keys: np.ndarray, plain: np.ndarray, df: np.ndarray, sets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, names: list, shares: tuple[float, float]) -> Index:
    """The index of the chosen terms (sorted ``keys``); ``sets`` may hold other terms too."""
    n = len(y)
    sizes = np.array([(y == 0).sum(), (y == 1).sum()], float)
    if not sizes.all():
        return Index(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0), np.zeros((0, 2), np.int64), np.empty(0, np.int64), np.empty(0), np.zeros((0, 1)), y, names)
    index = Index(keys, np.unique(plain), np.log((1 + n) / (1 + df)) + 1, np.empty(0), np.empty(0), np.empty(0), np.empty(0), y, names)
    find, vectors = K.HashIndex(keys), []
    for s, c in zip(sets, counts, strict=True):
        at = find.find(s)
        order = np.argsort(at, kind="stable")
        order = order[at[order] >= 0]
        vectors.append((at[order], index.vector(at[order], c[order])))
    # examples with the same weightiest terms are neighbours, which keeps block maxima apart
    heads = np.array([[*a[np.argsort(-v, kind="stable")[:3]], -1, -1, -1][:3] for a, v in vectors])
    order = np.lexsort((heads[:, 2], heads[:, 1], heads[:, 0]))
    vectors, y, names = [vectors[i] for i in order], y[order], [names[i] for i in order]
    index.toxic, index.names = y, names
    term = np.concatenate([a for a, _ in vectors])
    example = np.repeat(np.arange(n), [len(a) for a, _ in vectors])
    weight = np.concatenate([v for _, v in vectors])
    order = np.lexsort((example, term))
    index.example, index.weight = example[order], weight[order]
    blocks = -(-n // BLOCK)
    place = term[order] * blocks + index.example // BLOCK
    starts = np.searchsorted(place, np.arange(len(keys) * blocks + 1))
    index.begin = np.concatenate([starts[:-1].reshape(len(keys), blocks), starts[blocks::blocks][:, None]], axis=1)
    index.block_max = np.zeros((len(keys), blocks))
    np.maximum.at(index.block_max, (term, example // BLOCK), weight)
    votes = np.array([index.vote(*index.nearest(a, v, without=i)[:2]) for i, (a, v) in enumerate(vectors)])
    has = np.array([len(a) > 0 for a, _ in vectors])
    mass = np.where(y == 1, shares[1] / sizes[1], shares[0] / sizes[0])
    index.alone = float((mass * y)[~has].sum() / (mass[~has].sum() + 1e-3))
    if has.any() and (y[has] == 1).any() and (y[has] == 0).any():
        index.slope, index.shift = calibrate(votes[has], np.where(y[has] == 1, 1.0, -1.0), (mass * n)[has])
    else:
        index.slope, index.shift = 10.0, -5.0
    return index


def build(sets: list[np.ndarray], counts: list[np.ndarray], plain: list[np.ndarray], labels: np.ndarray, names: list, shares: tuple[float, float]) -> Index:
    """``sets``, ``counts`` and ``plain``: the examples' distinct term hashes, their numbers and the same without marks."""
    stay = _distinct_texts([least_hashes(x) for x in plain], labels)
    sets, counts, plain, names = [sets[i] for i in stay], [counts[i] for i in stay], [plain[i] for i in stay], [names[i] for i in stay]
    y = np.asarray(labels)[stay].astype(np.int64)
    keys, first, inverse = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(y)), [len(s) for s in sets])
    df, df1 = np.bincount(inverse, minlength=len(keys)).astype(float), np.bincount(inverse, y[owner], len(keys))
    chosen = choose(df, df1, np.array([(y == 0).sum(), (y == 1).sum()], float)) if len(set(y.tolist())) == 2 else np.empty(0, np.int64)
    return assemble(keys[chosen], np.concatenate([np.empty(0, np.uint64), *plain])[first[chosen]], df[chosen], sets, counts, y, names, shares)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """An index of at most ``limit`` labelled texts a class, none of the held-out fold.

    Document frequencies are counted in Spark; the driver sees the terms that enough
    examples have, and of the examples the chosen terms, or the distinct words where none is.
    """
    picked = labelled(docs, labels, label, limit, id_column, text_column).select("_id", "text", "y")
    kind = picked.schema["_id"].dataType.simpleString()
    rows = checkpointed(mapped(picked, _term_counts, f"_id {kind}, y int, terms array<long>, counts array<int>, plain array<long>, words array<long>, times array<int>, low array<long>"))
    seen = rows.select("_id", "y", "low").orderBy("_id", "low").collect()  # 24 numbers a labelled text
    stay = [seen[i] for i in _distinct_texts([r["low"] for r in seen], [r["y"] for r in seen])]
    names, y = [r["_id"] for r in stay], np.array([r["y"] for r in stay], np.int64)
    share = labels.where(F.col(label).isin(0, 1) & (fold(id_column) != 2)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    shares = (1 - (share or 0.0), share or 0.0)
    if len(set(y.tolist())) < 2:
        return assemble(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0), [], [], y, names, shares)
    kept = docs.sparkSession.createDataFrame([(x,) for x in sorted(set(names))], f"_id {kind}")
    rows = rows.join(F.broadcast(kept), "_id", "left_semi").dropDuplicates(["_id"])  # at most 2 * limit rows
    each = rows.select("y", F.explode(F.arrays_zip("terms", "plain")).alias("t")).groupBy("t.terms").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("df1"), F.first("t.plain").alias("plain"))
    found = each.where(F.col("df") >= least_texts(len(y))).toArrow()
    term = found["terms"].to_numpy().view(np.uint64)
    order = np.argsort(term)
    df, df1, plain = (found[c].to_numpy()[order] for c in ("df", "df1", "plain"))
    chosen = choose(df.astype(float), df1.astype(float), np.array([(y == 0).sum(), (y == 1).sum()], float))
    keys = term[order][chosen]

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = K.HashIndex(keys)
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            flat, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            ok = find.find(flat.view(np.uint64)) >= 0
            own = np.bincount(np.repeat(np.arange(len(size)), size)[ok], minlength=len(size))
            bare = own == 0  # of the others the words aren't needed
            inside = np.repeat(bare, np.diff(batch.column(4).offsets.to_numpy()))
            lists = [K.list_array(flat[ok], own, pa.int64()), K.list_array(n[ok], own, pa.int32())]
            lists += [K.list_array(batch.column(i).flatten().to_numpy(zero_copy_only=False)[inside], np.where(bare, np.diff(batch.column(i).offsets.to_numpy()), 0), k) for i, k in ((4, pa.int64()), (5, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["_id", "y", "terms", "counts", "words", "times"])

    few = mapped(rows.select("_id", "y", "terms", "counts", "words", "times"), restrict, f"_id {kind}, y int, terms array<long>, counts array<int>, words array<long>, times array<int>").toArrow().sort_by("_id")
    sets, counts, words, times = ([np.asarray(x.values) for x in few[c]] for c in ("terms", "counts", "words", "times"))
    names = few["_id"].to_pylist()
    index = assemble(keys, plain[chosen].view(np.uint64), df[chosen].astype(float), [s.view(np.uint64) for s in sets], counts, few["y"].to_numpy().astype(np.int64), names, shares)
    place = {name: i for i, name in enumerate(names)}
    order = [place[name] for name in index.names]
    index.words = index_words([words[i].view(np.uint64) for i in order], [times[i] for i in order], index.toxic, shares)
    return index


def _scorer(shared):
    """For a worker: (first row, end row, probabilities, evidence) of a text column, chunk by chunk."""
    own = shared.value
    find, plain = K.HashIndex(own.keys), K.HashIndex(own.plain)
    vocabulary = K.HashIndex(own.words.keys if own.words else np.empty(0, np.uint64))

    def proof(best: np.ndarray, cosine: np.ndarray) -> list[dict]:
        return [{"example": str(own.names[i]), "cosine": float(c), "toxic": int(own.toxic[i])} for i, c in zip(best[:3], cosine[:3], strict=True)]

    def by_words(text: np.ndarray, h: np.ndarray, p: np.ndarray, evidence: list) -> None:
        """Fill in the texts that have neighbours over all words; ``text``, ``h``: the words of texts without class terms."""
        text, h, n = _counted(text, h)
        at = vocabulary.find(h)
        v = own.words.weights(at, n)
        norm = np.sqrt(np.bincount(text, v * v, len(p)))
        v = v / norm[text]
        seen = np.sqrt(np.bincount(text[at >= 0], (v * v)[at >= 0], len(p)))
        use = (at >= 0) & (seen >= LEAST_COSINE - 1e-6)[text]  # other texts can't be so close to any example
        text, at, v = text[use], at[use], v[use]
        cuts = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text)) if len(text) else np.empty(0, np.int64)
        starts = np.append(0, cuts)[:-1]
        found = own.words.hopeful(np.repeat(np.arange(len(cuts)), cuts - starts), at, v)
        for a, b, some in zip(starts.tolist(), cuts.tolist(), found, strict=True):
            best, cosine, _ = own.words.nearest(at[a:b], v[a:b]) if some else ((), (), 0)
            if len(best):
                p[text[a]], evidence[text[a]] = own.word_vote(best, cosine), proof(best, cosine)

    def run(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list]]:
        for lo, hi, data, offsets in K.chunks(column):
            text, h = terms(data, offsets)
            some = plain.find(h) >= 0
            size = _words(data, offsets)
            words = text[: size.sum()], h[: size.sum()]
            text, h, n, _ = marked(*_counted(text[some], h[some]), size)
            at = find.find(h)
            order = np.lexsort((at, text))
            order = order[at[order] >= 0]
            text, at, n = text[order], at[order], n[order]
            p = np.full(hi - lo, own.alone)
            evidence: list = [[] for _ in range(hi - lo)]
            cuts = [*np.flatnonzero(text[1:] != text[:-1]) + 1, len(text)] if len(text) else []
            for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                best, cosine, _ = own.nearest(at[a:b], own.vector(at[a:b], n[a:b]))
                p[text[a]], evidence[text[a]] = own.probability(np.array([own.vote(best, cosine)]))[0], proof(best, cosine)
            if own.words:
                bare = np.ones(hi - lo, bool)
                bare[text] = False
                by_words(*(x[bare[words[0]]] for x in words), p, evidence)
            yield lo, hi, p, evidence

    return run


def score(docs: DataFrame, index: Index, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted, evidence) of every row; evidence: the nearest examples."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_TERMS and the words of 2 * LIMIT examples
    give_back()
    proof = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared)
        for batch in batches:
            for lo, hi, p, evidence in scored(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(evidence, proof)], names=["doc_id", "score", "predicted", "evidence"])

    schema = f"doc_id {kind}, score double, predicted int, evidence array<struct<example: string, cosine: double, toxic: int>>"
    return mapped(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), run, schema)


def harmless(docs: DataFrame, index: Index, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score stays below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_column)
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared)
        for batch in batches:
            for lo, hi, p, _ in scored(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(p < threshold))

    return mapped(docs, run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted", "evidence")
