import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tradewind.llm import text as T

TEXT = st.text(st.sampled_from(list("aAzZ09 \t\n\r\x0b\x0c\x1c.,é日\U0001f600\x00-")), max_size=60)


def batch(texts):
    return pa.array([t.encode() for t in texts], pa.binary())


def words(texts, classes, limit=T.BATCH_BYTES):
    out = []
    for first, last, data, offsets in T.byte_slices(batch(texts), limit):
        tokens = T.tokenize(data, offsets, classes)
        spans = [bytes(data[s:e]) for s, e in zip(tokens.starts, tokens.ends)]
        for r in range(last - first):
            a, b = tokens.bounds[r], tokens.bounds[r + 1]
            out.append((spans[a:b], tokens.hashes[a:b].tolist()))
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6), st.sampled_from([1, 20, 1 << 20]))
def test_words_are_those_of_the_patterns(texts, limit):
    for classes, pattern in ((T.BLANK_SEPARATED, r"[^\x20\x09-\x0D]+"), (T.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        got = words(texts, classes, limit)
        assert [[w.decode() for w in ws] for ws, _ in got] == [re.findall(pattern, t) for t in texts]
        seen = {}
        for ws, hashes in got:
            for w, h in zip(ws, hashes):
                assert seen.setdefault(lower(w.decode()), h) == h and h != 0
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_block():
    word = "w" * (2 * T.BLOCK_BYTES + 5)
    alone = words([word], T.BLANK_SEPARATED)[0][1]
    among = words([f"a b {word} c", "c " * 700_000 + word], T.BLANK_SEPARATED)
    assert among[0][1][2] == alone[0] == among[1][1][-1]
    assert among[0][1][3] == among[1][1][0] == among[1][1][600_000]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7).map(" ".join), max_size=6), st.integers(1, 4))
def test_shingles_stay_within_rows(texts, size):
    want, got = [], []
    for first, last, data, offsets in T.byte_slices(batch(texts)):
        at, grams = T.shingles(T.tokenize(data, offsets, T.BLANK_SEPARATED), size)
        got += [(int(r), int(g)) for r, g in zip(at, grams)]
    for r, t in enumerate(texts):
        w = t.split()
        runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        want += [(r, run) for run in runs]
    assert sorted(r for r, _ in got) == sorted(r for r, _ in want)
    per_row = lambda pairs: {r: len({g for q, g in pairs if q == r}) for r, _ in pairs}
    assert per_row(got) == per_row(want)


def test_slices_hold_whole_texts():
    texts = ["a" * 10, "", "b" * 50, "c"]
    parts = list(T.byte_slices(batch(texts).slice(1, 3), 8))
    assert [(a, b, len(d)) for a, b, d, _ in parts] == [(0, 1, 0), (1, 2, 50), (2, 3, 1)]
    assert list(T.byte_slices(batch([]))) == []
    assert T.signed(np.array([2**64 - 1], np.uint64)).tolist() == [-1]
