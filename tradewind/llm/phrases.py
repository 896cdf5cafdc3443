"""Phrase collocations by stripes.

A stripe is a prefix of words and, for every word that follows it, how often it does.  Stripes of no
words (one per language) count words, those of one word count pairs, and so on; stripes of tasks are
merged element by element.  One structure so gives all that a score needs: an element is the count of
a phrase, so a prefix's own count is read from the stripe one word shorter; the largest element of a
phrase's stripe, and of the stripes that end in it, tell whether a longer phrase subsumes it.

A phrase is as frequent as its parts at most.  So a stripe is only built for a prefix that is frequent
itself, and an element only counted if the words without the first one are frequent too.  What is
frequent reaches the tasks as a bitmap of bounded size; what passes it wrongly is counted and then
dropped, so nothing is lost and nothing added.

A prefix with more than a 65,536th of all words is hot; there cannot be more than 65,536 of them.
Stripes of hot prefixes are cut into slices by the next word, a slice for every 65,536th, so no
stripe is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm import text as tx

LONGEST = 4
LEAST = 30
#: A longer phrase with so many hundredths of a phrase's occurrences subsumes it.
SUBSUMED = 80
MOST_LISTED = 2000
#: Prefixes with more than one in so many of all words are hot.
HOT_SHARE = 1 << 16
#: Slices of each language's stripe of words.
WORD_SLICES = 1024
#: The bitmap of frequent phrases has sixteen bits for each, up to so many bits (a power of two).
MOST_BITS = 27
#: Elements that a task holds before it hands them on, 24 bytes each, and bytes of text it cuts at a time.
MOST_HELD = 3 << 20
BLOCK_BYTES = 1 << 20

#: Words are cut at blanks and tabs and at the marks that end a piece.
_MARKS = b".,;:!?\n\x0b\x0c\r"
WORDS = tx.byte_classes((0, 255, 1), (9, 9, 0), (32, 32, 0), *((b, b, 0) for b in _MARKS))
_ENDS_PIECE = np.isin(np.arange(256), np.frombuffer(_MARKS, np.uint8))

# The five factors of XXH64.
_FIRST, _SECOND, _THIRD = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_FOURTH, _FIFTH = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

STRIPE = "prefix long, slice int, word array<long>, n array<long>, text string"


def _same_piece(data: np.ndarray, tokens: tx.Tokens) -> np.ndarray:
    """Whether each token and the one after it are in one piece of one row."""
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ENDS_PIECE[data], out=marks[1:])
    rows = tokens.rows
    return (rows[1:] == rows[:-1]) & (marks[tokens.starts[1:]] == marks[tokens.ends[:-1]])


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hashed(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """The XXH64 of 64-bit values, as ``xxhash64`` takes it."""
    h = (seed + np.uint64(_FIFTH + 8 & tx._MASK)) ^ (_turned(x * np.uint64(_SECOND), 31) * np.uint64(_FIRST))
    h = _turned(h, 27) * np.uint64(_FIRST) + np.uint64(_FOURTH)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_SECOND)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_THIRD)
    return h ^ (h >> np.uint64(32))


def _chain(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The key of a phrase with one more word: ``xxhash64(phrase, word)``; a word is its own key."""
    return _hashed(words, _hashed(phrases, np.uint64(42)))


class _Keys:
    """Keys of the phrases that start at each word of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.tokens = tx.tokenize(data, offsets, WORDS)
        self.langs = langs[self.tokens.rows]
        self.words = tx.mix(self.tokens.hashes ^ tx.mix(self.langs, 3))
        self.joined = _same_piece(data, self.tokens) if len(self.words) else np.zeros(0, bool)

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of ``length`` words from each place, and where a piece holds that many words."""
        n = max(0, len(self.words) - length + 1)
        keys, whole = self.words[:n], np.ones(n, bool)
        for j in range(1, length):
            keys = _chain(keys, self.words[j : n + j])
            whole = whole & self.joined[j - 1 : n + j - 1]
        return keys, whole


class _Elements:
    """Elements of stripes, merged in bounded memory: prefix, word, count."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []
        self.held = 0

    @staticmethod
    def _merged(prefix, word, n) -> list[np.ndarray]:
        key = prefix * np.uint64(0x9FB21C651E98DF25) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return [prefix[order[first]], word[order[first]], np.add.reduceat(n[order], first)]

    def _all(self) -> list[np.ndarray]:
        parts, self.parts = self.parts, []
        return self._merged(*(np.concatenate(c) for c in zip(*parts)))

    def add(self, prefix: np.ndarray, word: np.ndarray) -> Iterator[list[np.ndarray]]:
        if len(word):
            self.parts.append(self._merged(prefix, word, np.ones(len(word), np.int64)))
            self.held += len(self.parts[-1][0])
        if self.held > MOST_HELD:
            self.parts = [self._all()]
            self.held = len(self.parts[0][0])
            if self.held > MOST_HELD // 2:
                yield from self.rest()

    def rest(self) -> Iterator[list[np.ndarray]]:
        if self.parts:
            yield self._all()
        self.parts, self.held = [], 0


def _slices(prefix: np.ndarray, hot: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Into how many slices each prefix's stripe is cut, by the hot prefixes in order and their numbers; None: all alike."""
    if hot is None:
        return np.full(len(prefix), WORD_SLICES, np.uint64)
    keys, numbers = hot
    if not len(keys):
        return np.ones(len(prefix), np.uint64)
    at = np.minimum(np.searchsorted(keys, prefix), len(keys) - 1)
    return np.where(keys[at] == prefix, numbers[at], np.uint64(1))


def _hot(level: DataFrame, everything: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the hot phrases, ascending, and a number of slices for each; HOT_SHARE rows at most."""
    rows = level.where(F.col("a") * HOT_SHARE > everything).select("phrase", "a").toArrow()
    keys, counts = tx.unsigned(rows["phrase"].to_numpy()), rows["a"].to_numpy()
    order = np.argsort(keys)
    return keys[order], -(-counts[order] * HOT_SHARE // max(everything, 1)).astype(np.int64).astype(np.uint64)


def _stripes(elements: list[np.ndarray], hot: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """Elements as rows: one per prefix, or per slice of a hot prefix."""
    prefix, word, n = elements
    piece = word % _slices(prefix, hot)
    order = np.lexsort((piece, prefix))
    prefix, piece = prefix[order], piece[order]
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (piece[1:] != piece[:-1])])
    bounds = pa.array(np.r_[first, len(prefix)].astype(np.int32))
    words, counts = (pa.ListArray.from_arrays(bounds, pa.array(c[order])) for c in (tx.signed(word), n))
    none = pa.nulls(len(first), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(tx.signed(prefix[first])), pa.array(piece[first].astype(np.int32)), words, counts, none], names=["prefix", "slice", "word", "n", "text"]
    )


def _dictionary(keys: _Keys, data: np.ndarray, at: np.ndarray, known: set[int]) -> Iterator[pa.RecordBatch]:
    """The texts of the words at the given places, each once a task: rows of slice -1."""
    words, first = np.unique(keys.words[at], return_index=True)
    new = [(int(w), int(at[i])) for w, i in zip(words, first) if int(w) not in known]
    known.update(w for w, _ in new)
    if new:
        spans = ((keys.tokens.starts[i], keys.tokens.ends[i]) for _, i in new)
        texts = pa.array([tx.LOWER[data[s:e]].tobytes().decode("utf-8", "replace") for s, e in spans], pa.string())
        prefix = pa.array(tx.signed(np.array([w for w, _ in new], np.uint64)))
        empty = pa.nulls(len(new), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [prefix, pa.array(np.full(len(new), -1, np.int32)), empty, empty, texts], names=["prefix", "slice", "word", "n", "text"]
        )


def count_stripes(texts: DataFrame, length: int, frequent: np.ndarray | None, hot: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Stripes of prefixes of ``length`` words over ``texts`` (lang_key, text as bytes), partly merged.

    With ``length`` 2 the texts of the words of frequent pairs come along as rows of slice -1.
    """

    def run(batches):
        elements, known = _Elements(), set()
        for batch in batches:
            langs = tx.unsigned(batch.column(0).to_numpy(zero_copy_only=False))
            for first, last, data, offsets in tx.byte_slices(batch.column(1), BLOCK_BYTES):
                keys = _Keys(data, offsets, langs[first:last])
                if length == 0:
                    got = keys.langs, keys.words
                else:
                    prefix, whole = keys.phrases(length)
                    whole = whole & store.in_bitmap(frequent, prefix) if len(prefix) else whole
                    if length == 2:
                        at = np.flatnonzero(whole)
                        yield from _dictionary(keys, data, np.unique(np.r_[at, at + 1]), known)
                    n = max(0, len(prefix) - 1)
                    at = np.flatnonzero(whole[:n] & whole[1:] & keys.joined[length - 1 :])
                    got = prefix[at], keys.words[at + length]
                for done in elements.add(*got):
                    yield _stripes(done, hot)
        for done in elements.rest():
            yield _stripes(done, hot)

    return texts.mapInArrow(run, STRIPE)


def merge_stripes(stripes: DataFrame) -> DataFrame:
    """(prefix, word, n): stripes merged element by element, after one exchange of whole stripes or slices."""
    dealt = stripes.where("slice >= 0").select("prefix", "slice", "word", "n").repartition("prefix", "slice")
    elements = dealt.select("prefix", "slice", F.inline(F.arrays_zip("word", "n")))
    return elements.groupBy("prefix", "slice", "word").agg(F.sum("n").alias("n")).select("prefix", "word", "n")


def _key(words: list[Column]) -> Column:
    """The key of a phrase of given words."""
    return reduce(F.xxhash64, words)


def _frequent_bitmap(phrases: DataFrame, rows: int) -> np.ndarray:
    bits = max(16, min(MOST_BITS, (16 * max(rows, 1) - 1).bit_length()))
    return store.bitmap(phrases, "phrase", bits)


def _cut_scores(longest: int) -> Column:
    """The lowest-scoring cut as (score, k, l, r); arithmetic in decimals, exact beyond 64 bits."""
    cuts = [
        F.when(
            F.size("before") >= k,
            F.struct(
                F.expr(f"(cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(get(before, {k - 1}) as decimal(20, 0)) + get(after, {k - 1}))").alias("score"),
                F.lit(k).alias("k"),
                F.get("before", F.lit(k - 1)).alias("l"),
                F.get("after", F.lit(k - 1)).alias("r"),
            ),
        )
        for k in range(1, longest)
    ]
    return F.array_min(F.array(*cuts))


def mine_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST_LISTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    ASCII letters are lowered; pieces end at ``. , ; : ! ?`` and line ends, words at blanks and tabs.
    A phrase counts all its occurrences within pieces (a), and is a candidate from ``least`` on.
    Cut after its first k words it scores floor(2000000 * a / (l + r)), l and r being the counts of
    both parts; the lowest-scoring cut counts, the first of equal ones.  A candidate with 80 % of its
    occurrences inside a longer candidate is dropped; as counts fall with length, it is enough to
    look one word further on either side.  Ranked by score, a, phrase in byte order; n counts the
    language's words.  Null texts are empty, a null language is ``und``; rows that repeat count
    again; other columns are not read.  64-bit hashes stand for words and phrases.  Without any
    candidate the result is empty.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = documents.select(F.xxhash64(lang).alias("lang_key"), tx.utf8().alias("text"))
    langs = store.checkpoint(documents.select(lang.alias("lang")).distinct().withColumn("lang_key", F.xxhash64("lang")))

    counted = store.checkpoint(merge_stripes(count_stripes(texts, 0, None, None)))
    totals = counted.groupBy(F.col("prefix").alias("lang_key")).agg(F.sum("n").alias("total"))
    everything = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where(F.col("n") >= least)
    # Level by level: a phrase's counts of its first words (before) and last words (after), by cut.
    level = frequent.select(
        F.col("word").alias("phrase"), F.col("prefix").alias("lang_key"), F.array("word").alias("words"), F.col("n").alias("a"),
        F.array().cast("array<long>").alias("before"), F.array().cast("array<long>").alias("after"),
    )
    candidates, stripes_of_pairs = [], None
    for length in range(1, longest):
        rows = level.count()
        if rows == 0:
            break
        stripes = count_stripes(texts, length, _frequent_bitmap(level, rows), _hot(level, everything))
        if length == 2:
            stripes = stripes_of_pairs = store.checkpoint(stripes)
        elements = store.checkpoint(merge_stripes(stripes).where(F.col("n") >= least))
        first = level.select(F.col("phrase").alias("prefix"), "lang_key", "words", F.col("before"), F.col("a").alias("of_first"))
        last = level.select(F.col("phrase").alias("rest"), F.col("after"), F.col("a").alias("of_last"))
        words = F.concat("words", F.array("word"))
        longer = elements.join(first, "prefix").select("prefix", "lang_key", words.alias("words"), F.col("n").alias("a"), "before", "of_first")
        longer = longer.withColumn("rest", _key([F.get("words", F.lit(j)) for j in range(1, length + 1)])).join(last, "rest")
        longer = longer.select(
            _key([F.get("words", F.lit(j)) for j in range(length + 1)]).alias("phrase"), "lang_key", "words", "a",
            F.concat("before", F.array("of_first")).alias("before"), F.concat(F.array("of_last"), "after").alias("after"), "prefix", "rest",
        )
        longer = store.checkpoint(longer)
        if length > 1:
            inside = longer.select(F.explode(F.array("prefix", "rest")).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("largest"))
            candidates.append(level.join(inside, "phrase", "left").where(~F.coalesce(F.col("largest") * 100 >= F.col("a") * SUBSUMED, F.lit(False))).drop("largest"))
        level = longer.drop("prefix", "rest")
    if length > 1 or rows:
        candidates.append(level)
    found = None
    for c in candidates:
        c = c.where(F.size("words") > 1).select("phrase", "lang_key", "words", "a", _cut_scores(longest).alias("cut"))
        found = c if found is None else found.unionByName(c)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if found is None or stripes_of_pairs is None:
        return documents.sparkSession.createDataFrame([], schema)
    # All that can be listed, with ties; their words are read back from the dictionary.
    best = Window.partitionBy("lang_key").orderBy(F.desc("cut.score"), F.desc("a"))
    found = store.checkpoint(found.withColumn("place", F.rank().over(best)).where(F.col("place") <= most).drop("place"))
    spelled = stripes_of_pairs.where("slice = -1").groupBy(F.col("prefix").alias("word")).agg(F.min("text").alias("text"))
    phrases = (
        found.select("phrase", F.posexplode("words").alias("at", "word"))
        .join(spelled, "word")
        .groupBy("phrase")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ").alias("spelled"))
    )
    listed = found.join(phrases, "phrase").drop("phrase").withColumnRenamed("spelled", "phrase").withColumn("score", F.col("cut.score"))
    place = Window.partitionBy("lang_key").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    listed = listed.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
    listed = listed.join(totals, "lang_key").join(langs, "lang_key")
    return listed.select("lang", F.col("rank").cast("long"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


def _sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS p FROM w, unnest(range(1, len(w) - {k - 2})) AS t(i) WHERE len(w) >= {k}" for k in range(1, LONGEST + 1)
    )
    return rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
q AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q),
g AS ({grams}),
f AS (SELECT lang, k, p, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(p, ' ') AS s FROM f WHERE k > 1),
x AS (SELECT c.*, unnest(range(1, c.k)) AS cut FROM c),
y AS (
  SELECT x.lang, x.p, x.a, x.cut, l.a AS l, r.a AS r, CAST(2000000 AS HUGEINT) * x.a // (l.a + r.a) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.p = array_to_string(s[1:cut], ' ')
         JOIN f r ON r.lang = x.lang AND r.p = array_to_string(s[cut + 1:x.k], ' ')),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS z FROM y),
i AS (
  SELECT lang, array_to_string(s[b:e], ' ') AS p, max(a) AS a
  FROM (SELECT lang, s, a, k, unnest(range(1, k)) AS b FROM c), unnest(range(1, 5)) AS u(e)
  WHERE e > b AND e <= k AND e - b + 1 < k GROUP BY ALL),
o AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, encode(m.p)) AS rank
  FROM m LEFT JOIN i USING (lang, p) WHERE z = 1 AND NOT coalesce(100 * i.a >= {SUBSUMED} * m.a, false))
SELECT lang, CAST(rank AS BIGINT) AS rank, p AS phrase, CAST(o.a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= {MOST_LISTED}
"""


SQL = _sql()
