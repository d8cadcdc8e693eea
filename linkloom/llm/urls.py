"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs and shipped to
the workers as one fixed-size weight vector; judging is a map over rows without shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule
and the model's verdict on the empty string; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import mapped, table

#: Hashed features, n-gram lengths, rows of the training table that are used at most.
BITS, GRAMS, TRAIN_ROWS = 14, (3, 4, 5), 20_000

# The rules of the filter's contract (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

# Word parts from which the labelled table is built.
_BAD = "casino poker betting jackpot pills viagra cheap spam farm ads track click win xxx loan warez popup".split()
_GOOD = "news blog docs wiki city library museum school forum garden music travel recipe science history sports".split()
_TOPS = "com net org".split()


def training_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, bad): pairs of word parts as hosts, under a few paths."""
    rows = []
    for label, parts in ((1, _BAD), (0, _GOOD)):
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                if (i + 2 * j) % (2 if label else 3) == 0 and a != b:
                    host = f"{('www.', '', 'm.', 'blog.')[(i + j) % 4]}{a}-{b}.example.{_TOPS[(i + j) % 3]}" if (i + j) % 3 else f"{a}{b}.example.{_TOPS[i % 3]}"
                    rows.append((f"https://{host}/{('en', 'de', 'fr', 'es')[j % 4]}/{7919 * (16 * i + j) % 50021}{('', '/', '.html')[(i + j) % 3]}", label))
    syllables = "th an er in on re he ti or st en nd at es ble tion ing ly ou ed wh sh nt ea ha".split()
    for i in range(400):
        word = "".join(syllables[(i * k + i // 25 + k) % len(syllables)] for k in (1, 3, 7, 11)[: 2 + i % 3])
        rows.append((f"http://{('', 'www.', 'm.', 'blog.')[i % 4]}{word}.example.{_TOPS[i % 3]}/{('en', 'de', 'fr', 'es')[i // 3 % 4]}/{7907 * i % 50021}{('', '/', '.html')[i % 3]}", 0))
    return spark.createDataFrame(rows, "url string, bad int")


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, distinct: hashed character n-grams of the marked text."""
    data, offsets = K.column_bytes(pa.array([f"^{t}$" for t in texts], pa.string()))
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = []
    value = K.BYTE_VALUE[data]
    for n in GRAMS:
        h = K.rolling(value, n)
        inside = text[: len(h)] == text[n - 1 :] if len(h) else np.empty(0, bool)
        pairs.append((text[: len(h)][inside].astype(np.int64) << bits) | (h[inside] >> np.uint64(64 - bits)).astype(np.int64))
    both = np.unique(np.concatenate(pairs))
    return both >> bits, both & ((1 << bits) - 1)


def train(urls: list[str], bad: list[int], bits: int = BITS, l2: float = 1e-5, rounds: int = 600, rate: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression, by gradient descent with momentum."""
    rows, cols = features(["".join(split_url(u)) for u in urls], bits)
    y = np.asarray(bad, float)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(y))))[rows]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, b, vw, vb = np.zeros(1 << bits), 0.0, np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        z = np.bincount(rows, w[cols] * scale, len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) * share
        vw = 0.9 * vw - rate * (np.bincount(cols, g[rows] * scale, 1 << bits) + l2 * w)
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return w, b


def probability(texts: list[str], w: np.ndarray, b: float) -> np.ndarray:
    if not texts:
        return np.empty(0)
    rows, cols = features(texts, int(np.log2(len(w))))
    norm = np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(texts))))
    return 1 / (1 + np.exp(-(np.bincount(rows, w[cols], len(texts)) / norm + b)))


def best_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and the path."""
    best, at = None, 0
    while True:
        name = host[at:]
        for start, verdict in by_host.get(name, ()):
            if path.startswith(start) and (best is None or len(name) + len(start) > len(best[0])):
                best = (name + start, verdict)
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("bad").isin(0, 1)).orderBy("url", "bad").limit(TRAIN_ROWS).collect()
    w, b = train([r["url"] for r in rows], [r["bad"] for r in rows])
    w = w.astype(np.float32)
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in RULES if rules is None else rules:
        by_host.setdefault(host, []).append((path, verdict))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                split = [split_url(u) for u in part.column(1).to_pylist()]
                score = probability([h + p for h, p in split], w, b)
                fits = [best_rule(h, p, by_host) for h, p in split]
                verdict = [f[1] if f else "block" if s >= 0.5 else "allow" for f, s in zip(fits, score.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([f[0] if f else None for f in fits], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
                    names=["page_id", "host", "path", "rule", "verdict", "score"],
                )

    kind = pages.schema[id_column].dataType.simpleString()
    return mapped(pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url")), run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), training_urls(spark))
