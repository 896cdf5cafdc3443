"""Benchmark passages inside documents, by winnowed fingerprints.

Both sides are cut into words.  Of every ``SPAN - GRAM + 1`` consecutive ``GRAM``-word hashes the
least one (the last of equals) is kept, so equal passages of ``SPAN`` words keep an equal hash at
the same place.  Fingerprints meet in a join, and each meeting is extended word by word as far as a
window that holds it can reach.  Items shorter than ``SPAN`` words are fingerprinted whole and
looked for at every place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm.text import ALPHANUMERIC, byte_slices, mix, signed, tokenize, utf8

SPAN = 13
GRAM = 7
WINDOW = SPAN - GRAM + 1
REACH = SPAN - GRAM
CONTEXT = SPAN + REACH

_MARKS = "array<struct<place:bigint,size:int,gram:bigint,context:binary>>"
_MARK_TYPE = pa.list_(
    pa.struct([("place", pa.int64()), ("size", pa.int32()), ("gram", pa.int64()), ("context", pa.binary())])
)


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.full(max(n, 0), np.uint64(size), np.uint64)
    for j in range(size):
        out = (out ^ words[j : j + n]) * np.uint64(0x9E6C63D0876A9A99)
        out ^= out >> np.uint64(31)
    return mix(out)


def winnow(grams: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (the last of equals) of every full window within one row."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window):
        lower = grams[j : j + n] <= least
        least[lower] = grams[j : j + n][lower]
        place[lower] = np.flatnonzero(lower) + j
    return np.unique(place[rows[:n] == rows[window - 1 : window - 1 + n]])


def _contexts(words: np.ndarray, rows: np.ndarray, places: np.ndarray, before: int, width: int, blank: int) -> np.ndarray:
    """Word hashes around each place; what lies beyond the row is ``blank``."""
    at = places[:, None] + np.arange(-before, width - before)
    inside = (at >= 0) & (at < len(words))
    at = np.clip(at, 0, max(len(words) - 1, 0))
    inside &= rows[at] == rows[places][:, None]
    return np.where(inside, words[at], np.uint64(blank))


def fingerprints(df: DataFrame, id_column: str, *, items: bool, short_sizes: list[int] = (), known=None) -> DataFrame:
    """For each row its id, a hash of its text, its number of words and its fingerprints.

    ``known`` is a broadcast bitmap; fingerprints it rules out cannot meet the other side.
    """
    schema = f"id bigint, text_key bigint, n_words bigint, marks {_MARKS}"
    sizes = sorted(short_sizes)

    def scan(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for first, last, data, offsets in byte_slices(batch.column(2)):
                tokens = tokenize(data, offsets, ALPHANUMERIC)
                words, rows, counts = tokens.hashes, tokens.rows, np.diff(tokens.bounds)
                found = []
                if len(words) >= SPAN:
                    grams = _gram_hashes(words, GRAM)
                    whole = rows[: len(grams)] == rows[GRAM - 1 :]
                    kept = np.flatnonzero(whole)
                    places = kept[winnow(grams[kept], rows[kept], WINDOW)]
                    found.append((0, places, grams[places]))
                for size in range(1, SPAN) if items else sizes:
                    if items:
                        places = tokens.bounds[:-1][counts == size]
                    else:
                        n = len(words) - size + 1
                        places = np.flatnonzero(rows[:n] == rows[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
                    if len(places):
                        grams = _gram_hashes(words, size)
                        found.append((size, places, mix(grams[places], size)))
                parts = []
                for size, places, grams in found:
                    if known is not None:
                        passes = store.in_bitmap(known.value, grams)
                        places, grams = places[passes], grams[passes]
                    if not len(places):
                        continue
                    before, width = (0, size) if size else (REACH, CONTEXT)
                    around = _contexts(words, rows, places, before, width, 0 if items else 1)
                    parts.append((rows[places], places - tokens.bounds[rows[places]], np.full(len(places), size), grams, around))
                row = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                order = np.argsort(row, kind="stable")
                contexts = [c.tobytes() for p in parts for c in p[4]]
                marks = pa.StructArray.from_arrays(
                    [
                        pa.array(np.concatenate([p[1] for p in parts])[order] if parts else [], pa.int64()),
                        pa.array(np.concatenate([p[2] for p in parts])[order] if parts else [], pa.int32()),
                        pa.array(signed(np.concatenate([p[3] for p in parts]))[order] if parts else [], pa.int64()),
                        pa.array([contexts[i] for i in order], pa.binary()),
                    ],
                    fields=list(_MARK_TYPE.value_type),
                )
                bounds = np.searchsorted(row[order], np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first),
                        keys.slice(first, last - first),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), marks),
                    ],
                    names=["id", "text_key", "n_words", "marks"],
                )

    source = df.select(F.col(id_column).cast("long").alias("id"), F.xxhash64("text").alias("text_key"), utf8().alias("text"))
    return source.mapInArrow(scan, schema)


def _extend(batches):
    """Turn meetings into the document's word span that equals the item's, if a window fits in."""
    for batch in batches:
        out_rows, begins, ends = [], [], []
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        places = batch.column("place").to_numpy(zero_copy_only=False)
        ours, theirs = batch.column("context"), batch.column("item_context")
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            width = int(size) or CONTEXT
            pick = pa.array(at)
            a, b = (np.frombuffer(b"".join(x.take(pick).to_pylist()), np.uint64).reshape(len(at), width) for x in (ours, theirs))
            same = a == b
            if size:
                keep = same.all(axis=1)
                left, right = np.zeros(len(at), np.int64), np.full(len(at), width)
            else:
                left = np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(axis=1)
                right = GRAM + np.cumprod(same[:, REACH + GRAM :], axis=1).sum(axis=1)
                keep = same[:, REACH : REACH + GRAM].all(axis=1) & (left + right >= SPAN)
            out_rows.append(at[keep])
            begins.append((places[at] - left)[keep])
            ends.append((places[at] + right)[keep])
        rows = pa.array(np.concatenate(out_rows) if out_rows else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(rows) for c in ("id", "text_key")),
                pa.array(np.concatenate(begins) if begins else [], pa.int64()),
                pa.array(np.concatenate(ends) if ends else [], pa.int64()),
                batch.column("item_id").take(rows),
            ],
            names=["id", "text_key", "begin", "end", "item_id"],
        )


def matched_spans(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document row's words, and the spans of words that equal a benchmark passage.

    The first frame has (id, text_key, n_words) for every row of ``documents``, the second (id,
    text_key, begin, end, item_id), words counted from 0, the end exclusive.  Spans of one document
    may overlap.  Null texts have no words; null item ids match too, but carry no id.
    """
    spark = documents.sparkSession
    item_marks = store.checkpoint(
        fingerprints(benchmark, "item_id", items=True).select(F.col("id").alias("item_id"), F.explode("marks").alias("m"))
        .select("item_id", "m.size", "m.gram", F.col("m.context").alias("item_context"))
        .distinct()
    )
    sizes = [r["size"] for r in item_marks.where("size > 0").select("size").distinct().collect()]
    known = spark.sparkContext.broadcast(store.bitmap(item_marks, "gram"))
    scanned = store.checkpoint(fingerprints(documents, "doc_id", items=False, short_sizes=sizes, known=known))
    meetings = (
        scanned.select("id", "text_key", F.explode("marks").alias("m"))
        .select("id", "text_key", "m.place", "m.size", "m.gram", "m.context")
        .join(item_marks, ["gram", "size"])
        .select("id", "text_key", "place", "size", "context", "item_id", "item_context")
    )
    spans = meetings.mapInArrow(_extend, "id bigint, text_key bigint, begin bigint, `end` bigint, item_id bigint")
    return scanned.select("id", "text_key", "n_words"), spans


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of ``documents``: words, words hit by benchmark windows, and the items found.

    A window is ``SPAN`` consecutive words of an item, or the whole of a shorter one.  A document is
    contaminated when at least a twentieth of its words is hit.  Rows without text or words have no
    hits.  Rows that share doc_id and text get the same result each; a null doc_id is kept.  Only
    doc_id and text are read, so other columns may have any name.

    Columns: doc_id, text_key (64-bit hash of the text), n_words, n_hit, items (sorted strings),
    spans (of words), contaminated.
    """
    rows, spans = matched_spans(documents, benchmark)
    found = spans.groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda s, x: F.struct(
            F.greatest(s["upto"], x["end"]).alias("upto"),
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["upto"], x["begin"]))).alias("n"),
        ),
    )["n"]
    found = found.select(F.col("id").alias("f_id"), F.col("text_key").alias("f_key"), "items", "spans", covered.alias("n_hit"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
