"""Edge cases and brute-force versions of every operator."""

import collections
import hashlib
import html as htmllib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, html, jaccard, licenses, media, packing, quality, registry, sharding, toxicity, urls
from linkloom.llm import kernels as K

LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000))
ROWS = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "Released under the MIT License. mit license"), (None, "alpha beta gamma"), (5, LONG), (6, LONG + " x"), (7, "   \n\t "), (8, "é中 ñ"), (9, "alpha beta gamma delta epsilon zeta")]
_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.withColumns({"node": F.lit(1), "score": F.lit("x"), "n": F.lit(2), "words": F.lit(None).cast("string"), "length": F.lit(0), "shard": F.lit(9)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Licenses


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, docs, none, real):
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((i, *base_places(t)) for i, t in ROWS)
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert licenses.license_scan(none).count() == 0
    texts = {r.doc_id: r.text for r in real.collect()}
    for r in licenses.license_scan(real).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(texts[r.doc_id])


def test_license_notices(spark):
    words = licenses.NOTICES["mit"].split()
    altered = " ".join(words[:20] + ["quite"] + words[20:40] + words[41:])
    rows = spark.createDataFrame([(1, altered), (2, " ".join(reversed(words))), (3, "all rights reserved"), (4, " ".join(words[:12]))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in licenses.license_scan(rows).collect()}
    assert got == {1: ("mit", ""), 2: ("", ""), 3: ("all-rights-reserved", ""), 4: ("", "")}


# Decontamination

ITEMS = [
    (1, "Natalia sold clips to 48 of her friends in April and then she sold half as many clips in May. How many clips did Natalia sell in total?"),
    (2, "A train travels 60 km in 2 hours and then 60 km in 3 hours before the driver takes a break near the river."),
    (3, "yes no"),
    (4, None),
    (5, ""),
    (6, "seven little words make this short item"),
]


def test_templates(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        (1, "x y z. Julia sold clips to 96 of her friends in June and then she sold half as many clips in July. How many clips did Julia sell in total? bla"),
        (2, "Natalia sold clips to 48 of her friends in April and then she sold half as many clips in May. How many clips did Betty sell in total?"),
        (3, "A train travels 75 miles in 4 hours and then 75 miles in 9 hours before the driver takes a break near the river."),
        (4, "A train travels 75 miles in 4 hours and then 80 miles in 9 hours before the driver takes a break near the river."),
        (5, None),
        (6, ""),
        (7, "Yes, no!"),
        (8, "well yes no"),
        (9, "here Seven little words make this short item too"),
        (None, ITEMS[1][1].upper()),
    ]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    for most in (decontaminate.BLOCK_WINDOWS, 5):
        got = {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.contaminated(texts, items, block_windows=most).collect()}
        assert got == {(1, 1, False), (3, 2, False), (7, 3, True), (9, 6, True), (None, 2, True)}
        left = decontaminate.cleaned(texts, items, block_windows=most)
        assert left.columns == texts.columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 8]
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.cleaned(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.contaminated(docs, items).count() == 0


def passages(texts, items):
    """(text number, item number, covered words) of every passage, without Spark."""
    (block,) = decontaminate.build_blocks(list(enumerate(items)))
    indexes = {k: K.HashIndex(x[0]) for k, x in block.windows.items()}
    return [(t, i, c) for t, i, _, _, c, *_ in decontaminate.match(decontaminate.canonical(*K.column_bytes(pa.array(texts))), len(texts), block, indexes)]


def test_first_word_after_a_lead():
    items = ["What is the boiling point of pure water at sea level?", "How many apples fall down here?", "Zelda picks 12 pears and eats 3 of them", "Paris"]
    texts = ["trivia: What is the boiling point of pure water at sea level?", "quiz How many apples fall down here", "what is the boiling point of pure water at sea level", "answer this: Marta picks 14 pears and eats 5 of them", "james", "trivia: What is the boiling point of pure iron at sea level?"]
    assert passages(texts, items) == [(0, 0, 11), (2, 0, 11), (3, 2, 9), (1, 1, 6)]


def test_items_rich_in_numbers():
    items = ["Find the sum of 3 5 7 9 11 13 15 17 19 21 23 25"]
    texts = ["x. " + items[0], "x. Find the sum of 4 6 8 10 12 14 16 18 20 22 24 26 now", "x. Find the sum of 4 6 8 and no more", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"]
    assert passages(texts, items) == [(0, 0, 16), (1, 0, 16)]


def test_values_that_become_equal():
    items = [ITEMS[1][1]]
    texts = [items[0].replace("60", "4").replace(" 2 ", " 4 ").replace(" 3 ", " 4 "), items[0].replace("60", "4", 1)]
    assert passages(texts, items) == [(0, 0, 24)]


def test_planted_passages(spark, sf, real):
    items = table(spark, sf, "benchmark")
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    passages = {r.item_id: words(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in real.collect() for i, p in passages.items() if p in words(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(real, items).collect()}
    assert got == want


# Extraction


@pytest.fixture(scope="module")
def field():
    return html.train()


def test_blocks():
    page = "<html><body><nav><a href='/x>y'>A&nbsp;&amp; B</a></nav><script>var t='</p>';</script><p>one <b>two<br>three<p>four &lt;p&gt;<!-- <p>no</p> --><ul><li>x<li>y</ul><textarea><p>hid</p></textarea><table><tr><td>c<td>d</table>"
    assert [b.text for b in html.blocks(page)] == ["A & B", "one two three", "four <p>", "x", "y", "c", "d"]
    assert html.blocks(page)[0].linked == 5
    assert html.blocks("") == [] and html.blocks("<<<>>") != [] and html.blocks("<p") == []
    assert [b.text for b in html.blocks("<div>" * 5000 + "deep")] == ["deep"]


def test_only_raw_text_is_skipped():
    said = lambda page: [b.text for b in html.blocks(page)]
    assert said("<datalist><option value=a>A<option value=b></datalist><p>article") == ["A", "article"]
    assert said("<p>one</p><button>go<p>article") == ["one", "go", "article"]
    assert said("<object><p>fallback</object><p>so <math><mi>x</mi></math> is<template><p>later</template>") == ["fallback", "so x is", "later"]
    assert said("<p>one</p><iframe src=x><p>two</p><script>a</script>three") == ["one", "two", "three"]
    assert said("<select><option>x</option></select><svg><text>chart</text></svg><noscript><p>no</noscript>") == ["x", "chart"]


def test_field_learns(field):
    pages = html.labelled_pages(150, seed=99)
    wrong = total = 0
    for page in pages:
        found = html.blocks(page)
        gold = [html._MAIN in b.text for b in found]
        for b in found:
            b.text = b.text.replace(html._MAIN, "").replace(html._OTHER, "") or "."
        wrong += sum(a != b for a, b in zip(gold, field.decode(html.features(found)), strict=True))
        total += len(gold)
    assert wrong / total < 0.015


def test_viterbi_is_exact(field):
    rng = np.random.default_rng(3)
    names = list(field.weights)
    for _ in range(30):
        page = [[names[j] for j in rng.integers(len(names), size=3)] for _ in range(int(rng.integers(1, 8)))]
        scores = {}
        for code in range(2 ** len(page)):
            y = [code >> i & 1 for i in range(len(page))]
            scores[tuple(y)] = sum(field.weights[x] for f, v in zip(page, y, strict=True) if v for x in f) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))
        assert scores[tuple(map(int, field.decode(page)))] == pytest.approx(max(scores.values()))


def test_extraction(spark, sf, field):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in html.extract(pages, field).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == " ".join(" ".join(parts).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "no tags at all")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert [r.text for r in html.extract(odd, field).collect()][:3] == ["", "", ""]
    assert html.extract(odd.limit(0), field).count() == 0


# Classifiers


def test_quality_is_accurate(spark, real, sf):
    labels = table(spark, sf, "labels")
    model = quality.train(real, labels)
    rows = quality.score(real, model).join(labels, "doc_id").withColumn("held_out", quality.fold() == 2).collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert real.count() >= quality.accepted(real, model).count() > 0.7 * real.count()


def test_hinge_loss_is_minimised():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, size=5)) for _ in range(60)]
    y = np.array([1.0 if 3 in r else -1.0 for r in rows])
    scale = np.ones(12)
    w, b = quality.dual_coordinate_descent(rows, scale, y, np.ones(60), rounds=300)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
    x[:, 12] = 1
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best = loss(np.append(w, b))
    for _ in range(300):
        assert loss(np.append(w, b) + rng.normal(scale=0.05, size=13)) >= best - 1e-3


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, docs, none, module):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (404, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = module.train(docs, some)
        got = module.score(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        by = collections.defaultdict(set)
        for (_, text), r in zip(ROWS, got, strict=True):
            by[text or ""].add(r.score)
        assert all(len(v) == 1 for v in by.values())
        keep = quality.accepted if module is quality else toxicity.harmless
        assert keep(docs, model).columns == docs.columns and keep(none, model).count() == 0


def test_toxicity_on_real_labels(spark, real, sf):
    labels = table(spark, sf, "labels")
    rows = toxicity.score(real, toxicity.train(real, labels)).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.85


def test_texts_without_terms(spark, real, sf):
    index = toxicity.train(real, table(spark, sf, "labels"))
    rows = spark.createDataFrame([(1, "zzz qqq"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.score for r in toxicity.score(rows, index).collect()} == {index.alone}


def test_near_copies_are_verified():
    lows = [list(range(24)), [0, 1, 2, 3, *range(100, 120)], [*range(20), 7, 7, 7, 7], []]
    assert toxicity._distinct_texts(lows, np.zeros(4, int)) == [0, 1, 3]


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    n = 400
    toxic = rng.integers(0, 2, n)
    sets = [np.unique(rng.integers(0, 40, size=rng.integers(1, 9))).astype(np.uint64) + np.uint64(1000) * np.uint64(t) + np.uint64(1) for t in toxic]
    sets = [np.append(s, np.uint64(10**6 + i)) for i, s in enumerate(sets)]
    counts = [np.ones(len(s), np.int32) for s in sets]
    index = toxicity.build(sets, counts, sets, toxic, list(range(n)), (0.5, 0.5))
    dense = np.zeros((len(index.toxic), len(index.keys)))
    term = np.repeat(np.arange(len(index.keys)), index.begin[:, -1] - index.begin[:, 0])
    dense[index.example, term] = index.weight
    opened = []
    for row in dense[:100]:
        at = np.flatnonzero(row)
        if len(at):
            best, score, n_open = index.nearest(at, row[at])
            cosine = np.round(dense @ row, 12)
            want = np.lexsort((np.arange(len(cosine)), -cosine))[: toxicity.NEAREST]
            want = want[cosine[want] > 0]
            assert best.tolist() == want.tolist() and np.allclose(score, cosine[want])
            opened.append(n_open)
    assert opened and min(opened) < index.block_max.shape[1]


def test_nearest_over_all_words_is_exact():
    rng = np.random.default_rng(11)
    n, base = 300, [rng.integers(0, 3000, size=40) for _ in range(12)]
    sets, counts = [], []
    for _ in range(n):
        of = base[rng.integers(12)]
        words, times = np.unique(np.concatenate([rng.choice(of, size=rng.integers(1, 40)), rng.integers(0, 40, size=rng.integers(0, 30))]), return_counts=True)
        sets.append(words.astype(np.uint64) * np.uint64(7919))
        counts.append(times)
    index = toxicity.index_words(sets, counts, rng.integers(0, 2, n), (0.9, 0.1))
    dense = np.zeros((n, len(index.keys)))
    entry = np.repeat(np.arange(len(index.block)), np.diff(index.begin))
    dense[index.example, np.searchsorted(index.entries, entry, side="right") - 1] = index.weight
    assert np.allclose((dense**2).sum(1), 1, atol=1e-5)
    found, opened = 0, []
    for i in range(100):
        h, times = np.append(sets[i], np.uint64(1)), np.append(counts[i], 3)  # a word that no example has
        at = np.searchsorted(index.keys, h)
        at = np.where(index.keys[np.minimum(at, len(index.keys) - 1)] == h, at, -1)
        v = index.weights(at, times)
        v = (v / np.linalg.norm(v))[at >= 0]
        query = np.zeros(len(index.keys))
        query[at[at >= 0]] = v
        cosine = np.round(dense @ query, 6)
        want = np.lexsort((np.arange(n), -cosine))[: toxicity.NEAREST]
        want = want[cosine[want] >= toxicity.LEAST_COSINE]
        best, score, n_open = index.nearest(at[at >= 0], v)
        assert best.tolist() == want.tolist() and np.allclose(score, cosine[want], atol=1e-5)
        assert index.hopeful(np.zeros(len(v), np.int64), at[at >= 0], v).tolist() in ([True], [len(want) > 0])
        found += len(want)
        opened.append(n_open)
    assert found > 100 and min(opened) < index.block.max() + 1


def test_bulk_filter_in_small_parts(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(1, 60, size=rng.integers(1, 20))).astype(np.uint64) for _ in range(80)]
    index = toxicity.index_words(sets, [np.ones(len(s), np.int64) for s in sets], np.arange(80) % 2, (0.5, 0.5))
    asked = [np.unique(rng.integers(0, len(index.keys), size=rng.integers(1, 9))) for _ in range(50)]
    text, at = np.repeat(np.arange(50), [len(a) for a in asked]), np.concatenate(asked)
    v = rng.random(len(at))
    v /= np.sqrt(np.bincount(text, v * v))[text] * rng.uniform(1, 2, 50)[text]
    near = [len(index.nearest(a, v[text == i])[0]) > 0 for i, a in enumerate(asked)]
    whole = index.hopeful(text, at, v)
    assert all(whole[np.flatnonzero(near)]) and any(near)
    for side, postings in ((1, 1), (7, 40), (50, 1 << 20)):
        monkeypatch.setattr(toxicity, "SIDE", side)
        monkeypatch.setattr(toxicity, "POSTINGS", postings)
        assert index.hopeful(text, at, v).tolist() == whole.tolist()


def test_copies_of_examples_of_rare_words(spark):
    rng = np.random.default_rng(2)
    prose = lambda: " ".join(f"w{j}" for j in rng.integers(10**6, size=60)) + " and the of it"
    rows = [(i, prose() + (" vile fool vile" if i % 4 == 0 else "")) for i in range(400)]
    odd = next(i for i in range(1001, 1100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows.append((odd, prose()))
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i == odd)) for i, _ in rows], "doc_id long, toxic int")
    index = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    clean = next(t for i, t in rows if i % 4 == 1 and i in index.names)
    asked = [(1, rows[-1][1]), (2, rows[-1][1] + " w1 w2 w3"), (3, prose()), (4, clean), (5, prose() + " vile fool vile"), (6, None)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), index).collect()}
    assert [got[i].predicted for i in range(1, 7)] == [1, 1, 0, 0, 1, 0]
    assert got[1].evidence[0].example == str(odd) and got[1].evidence[0].cosine == pytest.approx(1, abs=1e-4)
    assert got[3].evidence == [] and got[3].score == got[6].score == index.alone


# Near duplicates


def brute_components(rows):
    sets, ids = collections.defaultdict(list), sorted({i for i, _ in rows if i is not None})
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
        sets[i].append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed, groups=6, size=12, words=60):
    rng = np.random.default_rng(seed)
    rows, boiler = [], [f"common{j}" for j in range(14)]
    for g in range(groups):
        base = [f"g{g}w{rng.integers(40)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for at in rng.integers(words, size=rng.integers(0, 4)):
                copy[at] = f"new{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(copy[: rng.integers(40, words)] + (boiler if rng.random() < 0.5 else []))))
    return rows + [(900 + i, " ".join(boiler[:i])) for i in range(8)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_exact(spark, seed, monkeypatch):
    rows = near_copies(seed)
    if seed == 2:  # large buckets by rounds of test nodes
        monkeypatch.setattr(jaccard, "SMALL", 3)
        monkeypatch.setattr(jaccard, "FIRST_HUBS", 2)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_edges(spark, docs, none):
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    want = brute_components(ROWS)
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (2, 3, 7, 8)} == {2: 0, 3: 0, 7: 0, 8: 1}
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "None"])


# Sharding


def test_shards(spark, docs, none, sf, real):
    got = sharding.shard(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for rows in (got, sharding.shard(real).collect()):
        places = collections.defaultdict(list)
        for r in rows:
            places[r.shard].append(r.slot)
            assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(none).count() == 0


def test_slot_maps(spark, real, tmp_path):
    first = sharding.slot_map(spark, 16)
    second = sharding.add_shard(first)
    counts = [r["count"] for r in second.groupBy("shard").count().collect()]
    assert len(counts) == 17 and max(counts) - min(counts) <= 16
    load = sharding.slot_bytes(real)
    even = sharding.rebalanced(second, load, 17)
    assert even.count() == sharding.N_SLOTS == even.select("vslot").distinct().count()
    spread = lambda m: [r[0] for r in m.join(load, "vslot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert max(spread(even)) <= max(spread(second))
    sharding.save_map([first, second, even], str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map")).groupBy("version").count().count() == 3


def test_stored_map_is_used(spark, sf, real, tmp_path):
    first = sharding.slot_map(spark, 16)
    path = str(tmp_path / "map")
    sharding.save_map([first, sharding.add_shard(first)], path)
    rows = lambda m: sorted(map(tuple, m.collect()))
    assert rows(sharding.load_map(spark, path, 1)) == rows(first) and rows(sharding.load_map(spark, path, 2)) == rows(sharding.add_shard(first))
    columns = ("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
    assert rows(sharding.op6_virtual_slots(spark, sf).select(*columns)) == rows(sharding.shard(real).select(*columns))


@pytest.mark.parametrize("name", ["op5_adaptive_prefix_join", "op6_virtual_slots"])
def test_sql_says_the_same(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(found, key=str)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.select(", ".join(columns)).fetchall())


# Packing


def brute_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else capacity) - n)
    return sorted(left)


def test_best_fit_runs():
    rng = np.random.default_rng(8)
    for _ in range(200):
        capacity = int(rng.integers(1, 40))
        lengths = rng.integers(1, capacity + 1, size=rng.integers(0, 60)).tolist()
        used, seen = collections.Counter(), set()
        for length, lo, hi, first, per, at in packing.best_fit_runs(collections.Counter(lengths), capacity):
            for rank in range(hi - lo):
                name, begin = first + rank // per, at + rank % per * length
                cells = {(name, c) for c in range(begin, begin + length)}
                assert begin + length <= capacity and not cells & seen
                seen |= cells
                used[name] += length
        assert sorted(capacity - u for u in used.values()) == brute_fit(lengths, capacity)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    got = packing.pack_documents(docs, with_ids=True).collect()
    whole = collections.Counter()
    for i, t in ROWS:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        cut = (len(ids) - 1) % packing.CAPACITY + 1
        for p, a in enumerate([0, *range(cut, len(ids), packing.CAPACITY)]):
            part = ids[a : a + packing.CAPACITY] if p else ids[:cut]
            whole[str(i), p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == whole
    assert all(len(r.ids) == r.length for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(bins) == len(brute_fit([r.length for r in got], packing.CAPACITY))
    assert packing.pack_documents(none).count() == 0


def test_ids_are_the_tokenizers():
    rng = np.random.default_rng(4)
    alphabet = " \n\t'stmdrevl!.,19 é　ü中<|>A"
    texts = ["".join(alphabet[j] for j in rng.integers(len(alphabet), size=rng.integers(0, 60))) for _ in range(1500)] + ["<|endoftext|>", "", "don't we've '' 's 'sat I'll\n's  'm"]
    codec = packing.PieceEncoder(packing.default_tokenizer())
    want = [e.ids for e in codec.model.encode_batch(texts, add_special_tokens=False)]
    for fast in (codec.fast, None):
        codec.fast = fast
        codec._reset()
        from linkloom.llm import kernels as K

        ids, counts = codec.encode(*K.column_bytes(pa.array(texts)))
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


# URLs


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [("http://A.Com/x?y#z", "a.com", "/x"), ("https://a.com", "a.com", ""), ("a.com/x", "", ""), (None, "", ""), ("x://h?/p", "h", ""), ("://#", "", ""), ("h://É.net/a/b#c?d", "É.net", "/a/b")],
)
def test_split_url(url, host, path):
    assert urls.split_url(url) == (host, path)


def test_rules_and_model(spark, sf):
    by_host = collections.defaultdict(list)
    for verdict, host, path in urls.RULES:
        by_host[host].append((path, verdict))
    best = lambda h, p: urls.best_rule(h, p, by_host)
    assert best("x.com", "/a") == ("com/", "allow") and best("com", "/") == ("com/", "allow") and best("xcom", "/") is None and best("x.com", "") is None
    assert best("m.example.com", "/en/1") == ("example.com/en/", "block") and best("a.www.example.com", "/en/") == ("www.example.com/en/", "allow")
    rows = spark.createDataFrame([(1, "https://x.net/es/1"), (2, None), (2, None), (None, "casino"), (3, "http://win-casino.example.org/de/5"), (4, "http://garden-city.example.org/de/5")], "page_id long, url string").withColumn("score", F.lit("x"))
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judge(rows, urls.training_urls(spark)).collect()]
    assert got[0] == (1, "net/es/", "block") and got[1] == got[2] and got[4] == (3, None, "block") and got[5] == (4, None, "allow")
    assert urls.judge(rows.limit(0), urls.training_urls(spark)).count() == 0


def test_url_model_generalises(spark):
    rows = [(r.url, r.bad) for r in urls.training_urls(spark).collect()]
    ins, outs = rows[::2], rows[1::2]
    w, b = urls.train([u for u, _ in ins], [y for _, y in ins])
    p = urls.probability(["".join(urls.split_url(u)) for u, _ in outs], w, b)
    assert np.mean((p >= 0.5) == np.array([y for _, y in outs])) > 0.95


# Media


def test_media(spark, docs, none):
    got = media.media_columns(media.store_media(docs), keep=("doc_id", "n_bytes")).collect()
    want = collections.Counter()
    for i, t in ROWS:
        raw = (t or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        want[str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += 1
    assert collections.Counter((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.error is None and r.codec == "raw " and r.n_samples * 576 == r.payload_bytes and r.duration == pytest.approx(r.n_samples * 0.04) for r in got)
    assert media.media_columns(media.store_media(none)).count() == 0


def test_bad_files(spark):
    whole = media.write_media(media.padded(b"x" * 9000))
    rows = [(i, bytearray(b) if b is not None else None) for i, b in enumerate([whole, whole[:200], b"", b"junk junk junk", None, whole[:-10]])]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).orderBy("doc_id").collect()
    assert got[0].error is None and all(r.error and r.codec is None for r in got[1:])


def test_sample_tables():
    b, f = media._box, media._full
    import struct

    stbl = b(b"stbl", f(b"stsd", struct.pack(">I", 1), b(b"avc1", bytes(8))), f(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 20)), f(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), f(b"stsz", struct.pack(">II5I", 0, 5, 3, 4, 5, 6, 7)), f(b"co64", struct.pack(">I4Q", 4, 100, 200, 300, 400)), f(b"stss", struct.pack(">III", 2, 1, 2)))
    track = b(b"trak", b(b"mdia", f(b"mdhd", struct.pack(">QQIQI", 0, 0, 50, 80, 0), version=1), f(b"hdlr", bytes(4), b"vide"), b(b"minf", stbl)))
    data = struct.pack(">I4sQ", 1, b"moov", 16 + len(track)) + track
    (t,) = media.read_media(data)
    assert t.offsets.tolist() == [100, 103, 200, 300, 400] and t.times.tolist() == [0, 10, 20, 40, 60]
    assert (t.codec, t.handler, t.timescale, t.duration) == ("avc1", "vide", 50, 80) and t.keyframe_ranges() == [(100, 107)]
    quarter = b(b"stz2", struct.pack(">III", 0, 4, 3), bytes([0x12, 0x30]))
    found = {k: (lo, hi) for k, lo, hi in media.boxes(memoryview(b(b"x", stbl)[8:][8:]), 0, len(stbl) - 8)}
    found.pop(b"stsz")
    assert found and quarter


# Pipeline


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels, items = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect() if r.predicted == 1}
    step = docs.where(F.col("doc_id").isin(list(good))).checkpoint()
    kind = {r.doc_id for r in toxicity.score(step, toxicity.train(step, labels)).collect() if r.predicted == 0}
    comps = brute_components([(i, texts[i]) for i in sorted(kind)])
    one = {i for i, c in comps.items() if i == c}
    dirty = ids(decontaminate.contaminated(docs, items))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == one - dirty
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
