import random
import re

from tests.llm import odd
from tradewind.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        size = min(len(own), 13)
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


def check(spark, documents, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    texts = {}
    for r in documents.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(brute(r.text, items))
    got = {}
    for r in decontaminate(documents, bench).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r["items"]))
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        covered = {i for s in r.spans for i in range(s.begin, s.end)}
        assert len(covered) == r.n_hit
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    return got


def test_shared_passages_of_every_length(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(rng.choice([1, 2, 5, 12, 13, 14, 30, 60])) for _ in range(30)]
    rows = []
    for i in range(120):
        item = rng.choice(items).split()
        a = rng.randrange(len(item))
        part = item[a : a + rng.choice([5, 12, 13, 14, 25, 60])]
        rows.append(f"{text(rng.randrange(40))} {' '.join(part).upper()}, {text(rng.randrange(300))}")
    rows += ["same same same " * 20, "w1 " * 60]
    got = check(spark, odd.with_rows(spark, rows), odd.benchmark(spark, [*items, "w1 " * 13, "same " * 40, items[0]]))
    assert any(n for v in got.values() for _, n, _ in v)


def test_odd_rows(spark):
    items = ["plain words of one text that many would write in much the same way", "same row", "日本語"]
    got = check(spark, odd.documents(spark), odd.benchmark(spark, items))
    assert got[1] == [(16, 14, ["0"])] and got[11] == [(2, 2, ["1"])] * 3 and got[10][0][1] == 1


def test_empty_tables(spark):
    assert decontaminate(odd.no_documents(spark), odd.benchmark(spark, ["a b"])).collect() == []
    rows = decontaminate(odd.documents(spark), odd.benchmark(spark).limit(0)).collect()
    assert len(rows) == len(odd.TEXTS) and not any(r.n_hit for r in rows)
