"""Language of texts by bit-sliced Bloom filters.

A row of the filter holds a bit per language.  The rows that an n-gram's hashes pick, and-ed, give
at once all languages whose filter holds it.  A text's hits per language, less the false positives
that the language's fill predicts, decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm.samples import text_hash
from tradewind.llm.text import LOWER, byte_slices, mix, utf8

GRAM = 4
SLOT_BITS = 20
HASHES = 3
#: N-grams of a language that its filter holds, the most frequent ones; bounds its fill.
MOST_GRAMS = 1 << 16
#: An n-gram belongs to a language where it is at least this share as frequent as anywhere.
SHARE = 0.125
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91], _FOLD[97:123], _FOLD[128:] = LOWER[65:91], LOWER[97:123], LOWER[128:]


def letter_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and code of each run of ``GRAM`` bytes within a row that spans one blank at most.

    ASCII letters count in lower case, bytes of other characters as they are, the rest as blanks.
    """
    x = _FOLD[data]
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code, blanks = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
    for j in range(GRAM):
        part = x[j : j + n]
        code |= part.astype(np.uint64) << np.uint64(8 * j)
        blanks += part == 32
    good = blanks <= 1
    for j in range(1, GRAM):
        cut = offsets[1:-1] - j
        good[cut[(cut >= 0) & (cut < n)]] = False
    places = np.flatnonzero(good)
    return places, code[places]


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    return [mix(codes, 17 + j) >> np.uint64(64 - SLOT_BITS) for j in range(HASHES)]


class LanguageFilters:
    """The learned languages and the rows of their filters, ``2**SLOT_BITS`` whatever the corpus."""

    def __init__(self, languages: list[str], rows: np.ndarray, shares: np.ndarray):
        self.languages, self.rows, self.shares = languages, rows, shares
        fill = [np.count_nonzero((rows[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) / rows.shape[1] for i in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each row, and how many of them each language holds, false positives taken out."""
        places, codes = letter_grams(data, offsets)
        bounds = np.searchsorted(places, offsets)
        total = np.diff(bounds).astype(float)
        slots = _slots(codes)
        out = np.zeros((len(total), len(self.languages)))
        for word in range(self.rows.shape[0]):
            mask = self.rows[word][slots[0]]
            for s in slots[1:]:
                mask &= self.rows[word][s]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                sums = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)).astype(np.uint8) & 1, dtype=np.int64)])
                out[:, i] = sums[bounds[1:]] - sums[bounds[:-1]]
        return total, np.clip((out - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)


def learn_languages(documents: DataFrame, teach: Column, most_grams: int = MOST_GRAMS) -> LanguageFilters:
    """Count n-grams by language over all rows that ``teach`` admits, and fill the filters.

    Rows without language teach nothing.
    """
    spark = documents.sparkSession
    taught = documents.where(F.col("lang").isNotNull() & teach).select(F.col("lang").cast("string").alias("lang"), utf8().alias("text"))
    languages = sorted(r["lang"] for r in taught.select("lang").distinct().collect())
    places = {lang: i for i, lang in enumerate(languages)}

    def scan(batches):
        counter = store.Counter()

        def rows(parts):
            for keys, n in parts:
                yield store.table(lang=(keys >> np.uint64(32)).astype(np.int32), gram=(keys & np.uint64(0xFFFFFFFF)).astype(np.int64), n=n.astype(np.int64))

        for batch in batches:
            own = np.array([places.get(x, 0) for x in batch.column(0).to_pylist()], np.uint64)
            for first, last, data, offsets in byte_slices(batch.column(1)):
                at, codes = letter_grams(data, offsets)
                lang = np.repeat(own[first:last], np.diff(np.searchsorted(at, offsets)))
                keys, n = np.unique(lang << np.uint64(32) | codes, return_counts=True)
                yield from rows(counter.add(keys, n))
        yield from rows(counter.rest())

    counts = taught.mapInArrow(scan, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = store.checkpoint(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # One row per language.
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = rated.join(most, "gram").where(F.col("rate") >= SHARE * F.col("most")).select("lang", "gram", "n")
    floors = {k: v for k, v in store.count_floor(kept, "n", most_grams, "lang").items() if v is not None}
    if not floors:
        return LanguageFilters(languages, np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), np.uint64), np.zeros(len(languages)))
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))

    def slots(batches):
        for batch in batches:
            lang = batch.column(0).to_numpy()
            for s in _slots(batch.column(1).to_numpy().astype(np.uint64)):
                yield store.table(slot=s.astype(np.int64), word=(lang // 64).astype(np.int32), bit=(lang % 64).astype(np.int32))

    packed = (
        kept.where(F.col("n") >= floor).select("lang", "gram").mapInArrow(slots, "slot bigint, word int, bit int")
        .groupBy("slot", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")).toArrow()
    )
    rows = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
    rows[packed["word"].to_numpy(), packed["slot"].to_numpy()] = packed["mask"].to_numpy().astype(np.int64).view(np.uint64)
    shares = {r["lang"]: r["total"] for r in totals.collect()}
    return LanguageFilters(languages, rows, np.array([shares.get(i, 0) for i in range(len(languages))], float))


def identify(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    The language with most corrected hits; ties, and texts without n-grams, go to the one with more
    training text, then to the first by code point.  score is its share of the two best counts.
    Texts that are null or hold no letter, or any text when nothing was learned, are ``und`` with
    score 0.  Only doc_id and text are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def scan(batches):
        known = shared.value
        prior = np.argsort(-known.shares, kind="stable")
        names = np.array([*known.languages, UNDETERMINED], object)
        for batch in batches:
            lettered = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in byte_slices(batch.column(2)):
                pick, score = np.full(last - first, len(names) - 1), np.zeros(last - first)
                if len(known.languages):
                    _, hits = known.hits(data, offsets)
                    ranked = hits[:, prior]
                    best = ranked.argmax(axis=1)
                    top = ranked[np.arange(len(best)), best]
                    ranked[np.arange(len(best)), best] = -1
                    second = np.clip(ranked.max(axis=1), 0, None)
                    use = lettered[first:last]
                    pick[use] = prior[best][use]
                    score[use] = ((top + 1e-9) / (top + second + 2e-9))[use]
                yield store.table(doc_id=batch.column(0).slice(first, last - first), lang_pred=names[pick].tolist(), score=score)

    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), letter.alias("lettered"), utf8().alias("text"))
    return source.mapInArrow(scan, "doc_id bigint, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(documents, learn_languages(documents, text_hash() % 4 != 2))
    return found.select("doc_id", (text_hash() % 4 == 2).alias("held_out"), "lang_pred", "score")
