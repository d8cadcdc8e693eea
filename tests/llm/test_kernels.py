import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import kernels as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t9.,ñ中-\n", max_size=40)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    data, offsets = K.column_bytes(pa.array(texts, pa.string()))
    for table, pattern in ((K.ALNUM, r"[0-9A-Za-z\x80-\U0010ffff]+"), (K.NON_SPACE, r"[^\x20\x09-\x0D]+")):
        start, end, text = K.find_words(data, offsets, table)
        got = [(t, data[a:b].tobytes().decode()) for a, b, t in zip(start, end, text, strict=True)]
        assert got == [(i, w) for i, x in enumerate(texts) for w in re.findall(pattern, x or "")]
        h = K.span_hashes(data, start, end).tolist()
        names = {}
        for (_, w), x in zip(got, h, strict=True):
            assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_hash_index(keys, others):
    k = K.mix64(np.array(keys, np.uint64))
    index = K.HashIndex(k)
    assert index.find(k).tolist() == list(range(len(k)))
    o = K.mix64(np.array(others, np.uint64))
    where = {x: i for i, x in enumerate(k.tolist())}
    assert index.find(o).tolist() == [where.get(x, -1) for x in o.tolist()]


def test_chunks_cover_everything():
    texts = ["x" * n for n in (0, 5, 50, 0, 7, 100, 1)]
    for limit in (1, 10, 60, 1000):
        parts = [(lo, hi, data.size) for lo, hi, data, _ in K.chunks(pa.array(texts), limit)]
        assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == len(texts)
        assert sum(p[2] for p in parts) == 163


def test_sliced_arrays():
    array = pa.array(["aa", "bb", None, "cc"]).slice(1, 3)
    data, offsets = K.column_bytes(array)
    assert data.tobytes() == b"bbcc" and offsets.tolist() == [0, 2, 2, 4]
