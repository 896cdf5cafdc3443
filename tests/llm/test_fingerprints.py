from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import odd
from tradewind.llm import fingerprints as fp


def _hash(seed, *values):
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def brute(text, sketches=fp.SKETCHES, picks=fp.PICKS):
    """The definition, pair by pair: part of the hash range -> hash of the least pairs in text order."""
    units = re.findall(fp.UNIT, text)
    seen, parts = {}, {}
    shift = 33 - (sketches.bit_length() - 1)
    for i, u in enumerate(units):
        h = _hash(42, u, *units[i + 1 : i + 2]) & ((1 << 33) - 1)
        r = seen[h] = seen.get(h, -1) + 1
        if r:
            h = xxhash.xxh64_intdigest(r.to_bytes(4, "little"), _hash(42, h)) & ((1 << 33) - 1)
        parts.setdefault(h >> shift, []).append((h, i))
    out = {}
    for part, pairs in parts.items():
        least = sorted(pairs)[:picks]
        out[part] = _hash(42, *[h & ((1 << 32) - 1) for h, _ in sorted(least, key=lambda p: p[1])]) & ((1 << 32) - 1)
    return out


def likeness(a, b):
    used = set(a) | set(b)
    return sum(a.get(s) == b.get(s) for s in used) / len(used) if used else 1.0


def as_text(sketch):
    return "".join(f"{s:02x}{h:08x}" for s, h in sorted(sketch.items()))


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    out = ["", " ", "a", "a a", "x" * 5000, "ab " * 900, "日本語のテキスト", "😀😀 é", "word\nword\tword"]
    out += [" ".join(rng.choices(words, k=rng.choice([3, 30, 300, 3000]))) for _ in range(40)]
    return out


@pytest.mark.parametrize("sketches, picks", [(64, 2), (8, 1), (16, 3)])
def test_equals_brute_force(spark, sketches, picks):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in fp.fingerprints(df, sketches, picks).select("doc_id", fp.as_text(F.col("fingerprint")).alias("s")).collect()}
    assert got == {i: as_text(brute(t, sketches, picks)) for i, t in rows}


def test_whole_query_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    got = odd.by_id(fp.op12_fingerprints(spark, "/root/testdata/sf0.001"))
    assert len(got) == len(docs)
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = brute(text), brute(edited), brute(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(a), as_text(b))
        assert r.near_edited == pytest.approx(likeness(a, b)) and r.near_next == pytest.approx(likeness(a, c))


def test_order_matters_where_the_set_of_pairs_does_not(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(4000)]
    halves = [" ".join(words[:2000]), " ".join(words[2000:])]
    near = " ".join(w for w in words if rng.random() > 0.02)
    rows = [(0, " ".join(halves)), (1, " ".join(halves[::-1])), (2, near)]
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = lambda a, b: len(set(a) & set(b)) / fp.SKETCHES
    assert same(got[0], got[2]) > 0.8
    assert same(got[0], got[1]) < 0.75  # the halves share all pairs but one; pairs chosen from both halves change places


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = fp.edited_fingerprints(docs)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = out.collect()
    assert len(rows) == len(odd.TEXTS)
    by_text = {}
    for r in fp.fingerprints(docs).collect():
        by_text.setdefault(r.doc_id, set()).add(tuple(r.fingerprint))
    assert by_text[2] == by_text[3] == {()} and by_text[1] == by_text[9] and len(by_text[8]) == 2
    again = [r for r in rows if r.doc_id == 11]
    assert len(again) == 3 and len({str(r) for r in again}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    # Both texts without an id stand before doc_id 1, whose follower is the empty text of doc_id 2.
    first = next(r for r in rows if r.doc_id == 1)
    text = odd.TEXTS[0][1]
    assert first.edited_sha256 == hashlib.sha256(text[: len(text) - len(text) // 4].encode()).hexdigest()


def test_one_document_follows_itself_and_none_gives_none(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = fp.edited_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    assert fp.edited_fingerprints(odd.no_documents(spark)).count() == 0


def test_followers_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(fp, "PART_ROWS", 7)
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"), F.lit(0).alias("key"))
    got = {r.doc_id: r.next.doc_id for r in fp.followers(keys, ["doc_id", "key"]).collect()}
    assert got == {i: (i + 3) % 3000 for i in range(0, 3000, 3)}


def test_main_path_is_native(spark):
    """No Python worker in any plan, before or behind the checkpoints; texts are shuffled in one exchange that both joins read."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    keys = docs.select("doc_id", F.xxhash64("text").alias("key"))
    for df in (fp.edited_fingerprints(docs), fp.followers(keys, ["doc_id", "key"]), fp.fingerprints(docs)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Python|Pandas|Arrow", plan)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fp.edited_fingerprints(docs)
        df.collect()
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
