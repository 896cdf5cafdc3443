"""A key filter of fixed size: which child rows may have a parent, known before they are shuffled.

A blocked Bloom filter in rows: every key has one word of 64 bits and ``BITS`` bits in it.  Parents
are reduced to (word, mask) rows by a partial aggregate; a child row passes if its word's mask holds
its bits.  A parent's child always passes; another row does so with small probability, and the join
behind the filter drops it.  All of it is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the filter: at most so many rows of 16 bytes are sent to every task.
WORDS = 1 << 18
#: Bits of a key in its word.
BITS = 5
#: Parents a word may serve on average; with more the filter would let most rows through.
MOST_PER_WORD = 8


def _word(key: Column, words: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - (words.bit_length() - 1))


def _mask(key: Column) -> Column:
    """``BITS`` bits, six bits of a second hash each."""
    second = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])


def key_filter(parents: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """(word, mask), one row per word that some parent's key has; at most ``words`` rows, a power of two."""
    held = parents.where(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("mask"))
    return held.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def passing(rows: DataFrame, key: str, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows that may have a parent.  ``keys`` has ``words`` rows at most, so it is sent to every task."""
    word, mask = _word(F.col(key), words), _mask(F.col(key))
    held = F.broadcast(keys.select(F.col("word").alias("_word"), F.col("mask").alias("_mask")))
    return rows.join(held, (word == F.col("_word")) & (F.col("_mask").bitwiseAND(mask) == mask), "left_semi")


@dataclass(frozen=True)
class ParentKeys:
    """What is known of stored parents: how many, their lowest and highest key, and filters of the columns that children refer to."""

    count: int = 0
    low: object = None
    high: object = None
    filters: dict[str, DataFrame] | None = None

    @property
    def scattered(self) -> bool:
        """Whether a filter lets fewer rows through than the range: less than half of its keys are parents."""
        if not 0 < self.count <= MOST_PER_WORD * WORDS:
            return False
        if isinstance(self.low, int) and isinstance(self.high, int):
            return 2 * self.count < self.high - self.low + 1
        return True
