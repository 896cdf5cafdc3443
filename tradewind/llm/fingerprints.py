"""Document fingerprints by Order MinHash, in built-in functions only.

A text is a sequence of units: runs of up to 16 visible Latin characters with the blank that follows,
or single other characters.  Every pair of consecutive units (the last unit stands alone) is numbered
by its earlier occurrences in the text and hashed with that number.  The hash range is cut into
``sketches`` equal parts; in each part the ``picks`` least pairs are selected, put back into the
order in which they stand in the text, and hashed as a tuple.  Moving a passage changes tuples
although the set of pairs stays the same, so likeness follows edit distance and not just overlap.
One hash per pair serves all sketches, so the work grows with the text and not with their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm import store

#: Parts of the hash range, a power of two.
SKETCHES = 64
#: Pairs selected in each part.
PICKS = 2
#: Units of a text, in any script.
UNIT = r"(?s)[\x21-\u02FF]{1,16}\x20?|."
#: The documents' order is cut into at most so many parts, whatever their number.
MOST_PARTS = 4096
PART_ROWS = 100_000

_PLACE_BITS = 31
_PLACES = (1 << _PLACE_BITS) - 1
_HALF = (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _placed(hashed: Column, place: Column) -> Column:
    """33 bits of a hash above 31 bits of a place: sorting goes by hash, then place."""
    return F.shiftleft(hashed, _PLACE_BITS).bitwiseOR(place)


def _hash_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, _PLACE_BITS)


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACES))


def _same_hash(x: Column, y: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(y), _PLACE_BITS) == F.lit(0).cast("long")


def _earlier(ordered: Column, x: Column, j: Column) -> Column:
    """How many elements of the same hash stand before the ``j``-th of a sorted array: the largest
    step back that stays within the run, found bit by bit."""
    bits = F.sequence(F.length(F.bin(F.size(ordered).cast("long"))) - 1, F.lit(0))
    steps = F.transform(bits, lambda b: F.call_function("shiftleft", F.lit(1), b))
    return F.aggregate(steps, F.lit(0), lambda r, s: F.when(_same_hash(x, F.get(ordered, j - (r + s))), r + s).otherwise(r))


def order_minhash(text: Column, sketches: int = SKETCHES, picks: int = PICKS) -> Column:
    """The fingerprint as an array of longs, one per sketch that holds anything: its number above 32 bits of hash.

    An empty text has none.  A pair's first occurrence keeps the pair's own hash, later ones get one
    of the hash and their number.  The work is linear in the units but for a sort of them.
    """
    if sketches < 2 or sketches & (sketches - 1):
        raise ValueError("the number of sketches must be a power of two")
    part = lambda x: F.shiftrightunsigned(x, 64 - (sketches.bit_length() - 1))

    def least(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, j: ~part(F.get(ordered, j - picks)).eqNullSafe(part(x)))

    def numbered(pairs: Column) -> Column:
        firsts = F.filter(pairs, lambda x, j: ~F.coalesce(_same_hash(x, F.get(pairs, j - 1)), F.lit(False)))
        again = lambda x, j: _placed(F.xxhash64(_hash_of(x), _earlier(pairs, x, j)), _place_of(x))
        repeats = F.transform(pairs, lambda x, j: F.when(_same_hash(x, F.get(pairs, j - 1)), again(x, j)))
        repeats = F.filter(repeats, lambda x: x.isNotNull())
        return _let(F.sort_array(F.concat(_let(firsts, least), _let(F.sort_array(repeats), least))), least)

    def in_text_order(chosen: Column, x: Column, j: Column) -> Column:
        mine = F.filter(F.slice(chosen, j + 1, picks), lambda y: part(y) == part(x))
        placed = lambda y: F.shiftleft(_place_of(y), 32).bitwiseOR(_hash_of(y).bitwiseAND(F.lit(_HALF)))
        return F.transform(F.sort_array(F.transform(mine, placed)), lambda y: y.bitwiseAND(F.lit(_HALF)))

    def tuples(chosen: Column) -> Column:
        hashed = lambda x, j: F.xxhash64(in_text_order(chosen, x, j)).bitwiseAND(F.lit(_HALF))
        first = lambda x, j: ~part(F.get(chosen, j - 1)).eqNullSafe(part(x))
        all_of = F.transform(chosen, lambda x, j: F.when(first(x, j), F.shiftleft(part(x), 32).bitwiseOR(hashed(x, j))))
        return F.filter(all_of, lambda s: s.isNotNull())

    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    pairs = lambda u: F.transform(u, lambda x, i: _placed(F.xxhash64(x, F.get(u, i + 1)), i.cast("long")))
    chosen = _let(units, lambda u: _let(F.sort_array(pairs(u)), numbered))
    return F.sort_array(_let(chosen, tuples))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples among the sketches that hold anything in either text; 1 for two empty texts."""
    number = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    used = F.size(F.array_union(number(a), number(b)))
    return F.when(used == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_text(fingerprint: Column) -> Column:
    """Ten hex digits a sketch: two of its number, eight of its tuple."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def fingerprints(documents: DataFrame, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """(doc_id, fingerprint) for every row; a null text is empty.  Other columns are not read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", order_minhash(text, sketches, picks).alias("fingerprint"))


def followers(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` (unique rows) and, as the struct ``next``, the key that follows in ascending order; the first follows the last.

    Keys are dealt by range into a bounded number of parts; within a part a window finds the next
    key, and the last key of a part is followed by the first one of the next part that has any.
    """
    n = keys.count()
    parts = max(1, min(MOST_PARTS, -(-n // PART_ROWS)))
    dealt = store.checkpoint(keys.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(*order)).alias("_first"))
    # At most MOST_PARTS rows.
    ahead = Window.orderBy("_part")
    firsts = firsts.select(
        "_part",
        F.coalesce(F.lead("_first").over(ahead), F.first("_first").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_then"),
    )
    within = Window.partitionBy("_part").orderBy(*order)
    found = dealt.withColumn("_next", F.lead(F.struct(*order)).over(within)).join(F.broadcast(firsts), "_part")
    return found.withColumn("next", F.coalesce("_next", "_then")).drop("_part", "_next", "_then")


def edited_fingerprints(documents: DataFrame, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """Every text against itself with its last quarter replaced by the start of the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next), fingerprints as arrays.  The next document is the next one by doc_id (null first)
    and then by a hash of the text; the first one follows the last.  Rows that repeat doc_id and
    text are one document in that order and each get its result.  Null texts count as empty.  Other
    columns are not read.

    Only ids travel to find the order.  Texts are shuffled once by their key, with their
    fingerprints; what a text gives to the one before it is at most a quarter of that one's length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    marked = rows.withColumn("fingerprint", order_minhash(F.col("text"), sketches, picks))
    keys = rows.groupBy("doc_id", "key").agg(F.max(F.char_length("text")).alias("n_chars"), F.count(F.lit(1)).alias("rows"))
    ring = store.checkpoint(followers(keys, ["doc_id", "key"]))
    given = ring.select(
        F.col("next.doc_id").alias("g_id"), F.col("next.key").alias("g_key"), F.col("doc_id").alias("to_id"), F.col("key").alias("to_key"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"),
    )
    gifts = marked.join(given, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key"))).select(
        "to_id", "to_key", F.expr("left(text, wanted)").alias("gift"), F.col("fingerprint").alias("next_print")
    )
    if ring.where("rows > 1").limit(1).count():
        gifts = gifts.dropDuplicates(["to_id", "to_key"])
    met = marked.join(gifts, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("key") == F.col("to_key")))
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, char_length(text) - char_length(text) div 4)"), F.col("gift"))
    met = met.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", edited.alias("edited"), "next_print")
    met = met.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        order_minhash(F.col("edited"), sketches, picks).alias("edited_fingerprint"),
        "next_print",
    )
    near = [likeness(F.col("fingerprint"), F.col(c)).alias(a) for c, a in (("edited_fingerprint", "near_edited"), ("next_print", "near_next"))]
    return met.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.withColumns({c: as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})
