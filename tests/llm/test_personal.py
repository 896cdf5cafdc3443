import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tests.llm import odd
from tradewind.llm.personal import (
    MARGIN, STRIDE, WINDOW, _labels, _reconciled, _windows, base_spans, find_personal, find_spans, learn_tagger, luhn, redact,
)
from tradewind.llm.queries import QUERIES
from tradewind.llm.tagger import KINDS, TAGS, Tagger


def plain(text):
    """The patterns as they are written, searched as they are."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PIECES = st.sampled_from(
    ["a", "B.c", "@", "@@", ".", "-", "+", "%", "1", "25", "256", "0", "007", "1.2.3.4", "9.9.9.9.9", "x@y.z", "a@b", " ", "  ", "(",
     ")", "é", "\U0001f600", "\n", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+33612", "00000000000000000000", "@b.c.d@e.f"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_spans(text) == plain(text)


def test_base_spans_of_very_long_texts():
    for text in ("a" * 500_000 + "@" + "b." * 200_000, "1" * 500_000, "1." * 300_000, "@" * 300_000, "+1" + "(" * 400_000, "0" * 6000 + ".1.2.3"):
        base_spans(text)
    assert base_spans("0" * 6000 + "7.1.2.3") == [(0, 1, 6007)]
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_gradients():
    rng = np.random.default_rng(1)
    ids, tags = rng.integers(1, 20, (3, 6)), rng.integers(0, TAGS, (3, 6))
    tagger = Tagger(hidden=4, embedding=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    tagger.p["moves"] += rng.standard_normal((TAGS, TAGS)) * 0.1
    _, g = tagger.gradients(ids, tags)
    for name, x in tagger.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in x.shape)
            old, step = x[at], 1e-3
            x[at] = old + step
            up = tagger.gradients(ids, tags)[0]
            x[at] = old - step
            down = tagger.gradients(ids, tags)[0]
            x[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3, name


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(2)
    tagger = Tagger(hidden=3, embedding=3)
    tagger.p["moves"] = rng.standard_normal((TAGS, TAGS)).astype(np.float32)
    ids = rng.integers(1, 20, (2, 3))
    scores = tagger.emissions(ids)[0]
    for r, tags in enumerate(tagger.decode(ids)):
        def value(path):
            moves = sum(tagger.p["moves"][a, b] for a, b in zip(path, path[1:]))
            return tagger.p["first"][path[0]] + moves + sum(scores[t, r, x] for t, x in enumerate(path))
        best = max(value((a, b, c)) for a in range(TAGS) for b in range(TAGS) for c in range(TAGS))
        assert abs(value(tuple(tags)) - best) < 1e-4


def test_windows_cover_every_span_and_labels_come_back():
    text = "x" * 45 + "a@b.cd" + "é" * 90 + " 1.2.3.4 " + "y" * 400 + "+1 (555) 123-4567"
    numbers, ids = _windows(text)
    tags = _labels(base_spans(text), numbers, len(text))
    assert ids.shape == tags.shape == (len(numbers), WINDOW)
    back = _reconciled(text, [], numbers.tolist(), tags[:, MARGIN : MARGIN + STRIDE])
    assert back == base_spans(text)
    assert _windows("")[0].size == 0


def test_tagger_learns_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = learn_tagger(docs)
    texts = [r.text for r in docs.where("doc_id % 3 = 0 AND text rlike '[0-9]'").limit(150).collect()]
    found = total = 0
    for text in texts:
        numbers, ids = _windows(text)
        own = _reconciled(text, [], numbers.tolist(), tagger.decode(ids)[:, MARGIN : MARGIN + STRIDE])
        base = base_spans(text)
        total += len(base)
        found += len(set(own) & set(base))
        assert set(find_spans([text], tagger)[0]) >= set(base)
    assert total > 30 and found > 0.85 * total


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op4_personal"](spark, SMALL).collect():
        base = plain(rows[r.doc_id])
        joined = ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert sum(b < e2 and b2 < e for b, _, e in base for b2, e2 in ((int(x.split(":")[1]), int(x.split(":")[2])) for x in r.spans.split(",") if x)) >= len(base)


def test_odd_rows_and_redaction(spark):
    docs = odd.documents(spark)
    tagger = learn_tagger(docs, 30)
    found = find_personal(docs, tagger).collect()
    assert len(found) == len(odd.TEXTS)
    clean = redact(docs, tagger)
    assert clean.columns == docs.columns and clean.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = clean.collect()
    assert len(rows) == len(odd.TEXTS)
    (mail,) = [r for r in rows if r.text and r.text.startswith("mail me")]
    assert mail.text == "mail me at <EMAIL> or <PHONE> now" and mail.n_chars == len(mail.text) and mail.c0 == "c0"
    assert sorted(r.doc_id for r in rows if r.text is None and r.doc_id) == [2]
    untouched = {t for _, t, *_ in odd.TEXTS if t and not re.search("[0-9@]", t)}
    assert untouched <= {r.text for r in rows}
    empty = odd.no_documents(spark)
    assert find_personal(empty, learn_tagger(empty)).collect() == [] == redact(empty, tagger).collect()
