import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import odd
from tradewind.llm.language import HASHES, SLOT_BITS, LanguageFilters, _slots, identify, learn_languages, letter_grams
from tradewind.llm.queries import QUERIES
from tradewind.llm.text import byte_slices


def grams(text):
    ((_, _, data, offsets),) = byte_slices(pa.array([text.encode()], pa.binary()))
    return letter_grams(data, offsets)[1]


def test_grams_are_letters_and_single_blanks():
    assert len(grams("Ab cd")) == 2 and len(grams("a b c")) == 0 and len(grams("ab12cd")) == 0
    assert (grams("ABCDE") == grams("abcde")).all() and len(grams("abc")) == 0
    ((_, _, data, offsets),) = byte_slices(pa.array([b"abcd", b"", b"efgh", b"ij"], pa.binary()))
    assert letter_grams(data, offsets)[0].tolist() == [0, 4]


def test_filters_answer_all_languages_at_once():
    """Every n-gram of a language is found; false hits come near their predicted rate, for more than 64 languages too."""
    rng, count = np.random.default_rng(1), 70
    own = [rng.integers(0, 2**32, 20_000).astype(np.uint64) for _ in range(3)]
    rows = np.zeros((2, 1 << SLOT_BITS), np.uint64)
    for lang, codes in zip((0, 5, 69), own):
        for s in _slots(codes):
            rows[lang // 64, s] |= np.uint64(1) << np.uint64(lang % 64)
    filters = LanguageFilters([f"l{i:02}" for i in range(count)], rows, np.ones(count))
    for lang, codes in zip((0, 5, 69), own):
        masks = [rows[lang // 64, s] >> np.uint64(lang % 64) & np.uint64(1) for s in _slots(codes)]
        assert all((m == 1).all() for m in masks) and len(masks) == HASHES
    other = _slots(rng.integers(0, 2**32, 400_000).astype(np.uint64))
    wrong = np.ones(400_000, bool)
    for s in other:
        wrong &= rows[0, s] & np.uint64(1) == 1
    assert abs(wrong.mean() - filters.false_rate[0]) < 3e-4
    assert (filters.false_rate[[1, 2, 3, 68]] == 0).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in QUERIES["op5_language"](spark, sf).collect() if r.held_out]
    assert len(got) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    rows = identify(docs, learn_languages(docs, F.lit(True))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.lang_pred)
    assert len(rows) == len(odd.TEXTS) and all(got[i] == {"und"} for i in (2, 3, 4, 5))
    assert got[6] == {"de"} and got[1] == {"en"} and got[7] == {"fr"} and got[10] <= {"en", "de", "fr"}
    empty = odd.no_documents(spark)
    assert identify(empty, learn_languages(empty, F.lit(True))).collect() == []
    unknown = identify(docs, learn_languages(docs, F.lit(False))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
