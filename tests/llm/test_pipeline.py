import re
import shutil

import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import odd
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_neardup import brute as components
from tests.llm.test_personal import plain
from tradewind.llm.neardup import Similarity
from tradewind.llm.tagger import KINDS


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage made of all sample documents, written and read again."""
    out, docs = [], spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicate", "benchmark_free", "personal_data", "mixture"]


def test_toxic_documents_go(spark, stages):
    assert {r.doc_id: r for r in stages[1]}.items() <= {r.doc_id: r for r in stages[0]}.items()
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, sf).select("doc_id").collect()}
    toxic, clean = ([i for i, t in labels.items() if t == x] for x in (1, 0))
    assert len([i for i in toxic if i in kept]) < 0.15 * len(toxic)
    assert len([i for i in clean if i in kept]) > 0.98 * len(clean)


def test_one_of_each_group_stays(stages):
    least = components([(r.doc_id, r.text) for r in stages[1]], Similarity())
    assert {r.doc_id for r in stages[2]} == set(least.values()) and len(stages[2]) == len(set(least.values()))


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = set()
    for r in stages[2]:
        n_words, n_hit, _ = contamination(r.text, items)
        if not (n_hit > 0 and 20 * n_hit >= n_words):
            want.add(r.doc_id)
    assert {r.doc_id for r in stages[3]} == want and len(want) < len(stages[2])


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == before.keys()
    for r in stages[4]:
        spans = plain(before[r.doc_id].text)
        assert r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id].text):
            assert r == before[r.doc_id]
        assert sum(r.text.count(f"<{k.upper()}>") for k in KINDS) >= len({b for b, _, _ in spans}) - sum(
            a[0] <= b[0] < a[2] for a in spans for b in spans if a != b
        )
        assert not [s for s in plain(r.text) if s[1] in (0, 1)]


def test_mix_takes_documents(stages):
    before = {r.doc_id: r for r in stages[4]}
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in stages[4])
    for r in stages[5]:
        assert r.text == before[r.doc_id].text and 0 < r.copies <= 3 and r.taken == r.copies * r.size
    assert sum(r.taken for r in stages[5]) <= total
    assert sum(r.taken for r in stages[5]) > 0.9 * total


def test_run_agrees(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert {(r.doc_id, r.taken) for r in got.collect()} == {(r.doc_id, r.taken) for r in stages[5]}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    odd.labels(spark).write.parquet(f"{folder}/labels.parquet")
    odd.benchmark(spark, ["same row", "x"]).write.parquet(f"{folder}/benchmark.parquet")
    yield folder
    shutil.rmtree(folder)


def test_odd_rows_pass_every_stage(spark, odd_dir):
    docs = odd.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    ids = {r.doc_id for r in corpus_pipeline.benchmark_free(spark, docs, odd_dir).collect()}
    assert 11 not in ids and {1, 2, 3, 4, 5, 6, None} <= ids
    kept = corpus_pipeline.near_duplicate(spark, docs, odd_dir).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 8, 10, 11]
    assert {r.text for r in kept if r.doc_id == 8} == {t for i, t, *_ in odd.TEXTS if i == 8}
    assert sum(r.doc_id is None for r in kept) == 2
    mixed = corpus_pipeline.mixture(spark, docs, odd_dir)
    assert mixed.columns == [*docs.columns, "size_", "target", "copies_", "taken"]
    assert mixed.where("doc_id = 11").count() <= 1
    assert len(set(c.lower() for c in mixed.columns)) == len(mixed.columns)


def test_empty_tables_stay_empty(spark, odd_dir):
    docs = odd.no_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd_dir).count() == 0, name


def test_unlike_texts_under_one_id_all_stay(spark, odd_dir):
    kept = corpus_pipeline.near_duplicate(spark, odd.documents(spark), odd_dir).collect()
    assert {r.text for r in kept if r.doc_id == 8} == {t for i, t, *_ in odd.TEXTS if i == 8}
    assert sum(r.doc_id == 11 for r in kept) == 1 and not [r for r in kept if r.doc_id == 9]
