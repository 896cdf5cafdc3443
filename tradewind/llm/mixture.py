"""Mixing sources to target weights by weighted fair queueing.

Every source deals its documents in a shuffled order, up to ``REPEATS`` times over.  A document's
virtual finish time is its source's running total of words divided by the source's target; sorted
by that time, all sources advance in proportion to their targets.  The mix is the longest prefix
that fits the total budget.

Running totals never need a source, or the whole table, in one task: rows are sorted within small
parts of the order, the parts' sums are accumulated within blocks of parts, the blocks' sums over
blocks, and each row adds what came before its part.  Sources are summed up by ranges likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm import store

REPEATS = 3
#: Weights by a source's place in code point order, again and again; null is last.
WEIGHTS = (1, 2, 3)
#: Rows of a part of the order, on average.
PART_ROWS = 2048
#: Parts whose sums are added up in one task, and ranges that sources are sorted in.
BLOCK_PARTS, RANGES = 1024, 32


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources share the total by weight; none gets more than ``repeats`` times what it has, and the
    excess is shared again by weight among the others.  That is the level at which the sum of
    min(level * weight, cap) is the total: with sources by cap per weight, the first ones are full
    and the level is what is left per weight of the rest.
    """
    by_source = [F.col("source").isNull(), F.col("source")]
    rows = _in_order(sizes.select("source", "source_size"), by_source, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    by_cap = [repeats * F.col("source_size") / F.col("weight"), *by_source]
    rows = store.checkpoint(
        _in_order(
            rows.select("source", "source_size", weight.alias("weight")),
            by_cap,
            {"sizes_before": F.col("source_size"), "weights_before": F.col("weight")},
        )
    )
    total, weights = (F.lit(x or 0).cast("long") for x in rows.agg(F.sum("source_size"), F.sum("weight")).first())
    left = total - repeats * F.col("sizes_before")
    open_weight = weights - F.col("weights_before")
    # The first source that its cap does not stop: its share of what is left is within its cap.
    fits = left * F.col("weight") <= repeats * F.col("source_size") * open_weight
    first = F.min(F.when(fits, F.struct(*_fields(by_cap), left.alias("left"), open_weight.alias("open")))).alias("at")
    level_left, level_open = rows.agg(first).select("at.left", "at.open").first()
    level_left, level_open = (F.lit(x).cast("long") for x in (level_left, level_open))
    free = open_weight <= level_open
    return rows.select(
        "source",
        "source_size",
        F.when(free, level_left * F.col("weight") / level_open)
        .otherwise((repeats * F.col("source_size")).cast("double"))
        .alias("target"),
    )


def _fields(order: list[Column]) -> list[Column]:
    """The columns of an order as fields that compare alike."""
    return [c.alias(f"o{i}") for i, c in enumerate(order)]


def _in_order(rows: DataFrame, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """Add, for each amount, its sum over the rows before in a global order.

    Rows are sorted in ranges; only the ranges' sums, one row each, are added up in one place.
    """
    ranges = store.checkpoint(rows.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_range").agg(*[F.sum(x.cast("long")).alias(f"_{name}") for name, x in amounts.items()])
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_{name}") for name in amounts])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.select("*", *[F.coalesce(F.sum(x.cast("long")).over(inside), F.lit(0)).alias(name) for name, x in amounts.items()])
    both = own.join(sums, "_range")
    return both.select(*rows.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in amounts])


def _running(rows: DataFrame, keys: list[str], part: str, order: list[Column], amount: str, name: str) -> DataFrame:
    """Add the running total of ``amount`` within ``keys``, by ``part`` and then ``order``."""
    parts = rows.groupBy(*keys, part).agg(F.sum(amount).alias("_sum"))
    parts = store.checkpoint(parts.withColumn("_block", F.floor(F.col(part) / BLOCK_PARTS).cast("long")))
    before = (Window.unboundedPreceding, -1)
    blocks = parts.groupBy(*keys, "_block").agg(F.sum("_sum").alias("_all"))
    ahead = F.sum("_all").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(*before))
    blocks = blocks.select(*keys, "_block", F.coalesce(ahead, F.lit(0)).alias("_blocks"))
    inside = F.sum("_sum").over(Window.partitionBy(*keys, "_block").orderBy(part).rowsBetween(*before))
    parts = parts.withColumn("_parts", F.coalesce(inside, F.lit(0))).join(blocks, [*keys, "_block"])
    parts = parts.select(*keys, part, (F.col("_blocks") + F.col("_parts")).alias("_ahead"))
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_own", F.sum(amount).over(within)).join(parts, [*keys, part])
    return joined.withColumn(name, F.col("_ahead") + F.col("_own")).drop("_ahead", "_own")


def turn_of(seed: str = "mix") -> Column:
    """Where a row stands in its source's shuffled order."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))


def mix(documents: DataFrame, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """(doc_id, turn, size, source, source_size, target, copies, taken) for every row of ``documents``.

    size counts words between ASCII blanks (null text: 0); taken is copies * size.  The shuffle
    orders a source by the MD5 of ``seed``, doc_id and the text's MD5, so reruns agree, and rows
    that repeat doc_id and text differ only in their turn.  An empty table gives an empty mix; a
    source without words gets the target 0 and none of its rows.  Null sources are one source.
    Columns besides doc_id, text and source are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = store.checkpoint(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            turn_of(seed).alias("turn"),
        )
    )
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    shares = store.checkpoint(
        targets(by_source.select("source", "source_size"), repeats).withColumnRenamed("source", "s").withColumn("sid", F.xxhash64("s"))
    )
    total, n = (lambda r: (r[0] or 0, r[1] or 0))(by_source.agg(F.sum("source_size"), F.sum("n")).first())
    n_parts = max(1, n // PART_ROWS)
    # Sources meet their rows as one small map, not by a shuffle of rows to a hot source.
    rows = rows.join(F.broadcast(shares), rows["source"].eqNullSafe(shares["s"]), "left") if _few(shares) else rows.join(
        shares, rows["source"].eqNullSafe(shares["s"]), "left"
    )
    rows = rows.select("doc_id", "source", "size", "turn", "source_size", "target", "sid")
    spread = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") / F.lit(2.0**32) * n_parts).cast("long")
    dealt = _running(rows.where("size > 0").withColumn("part", spread), ["sid"], "part", [F.col("turn"), F.col("size")], "size", "upto")
    dealt = store.checkpoint(dealt)
    copies = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target")
    copies = copies.where("target > 0").withColumn("finish", finish)
    # Nothing after a time by which more than the budget has finished is taken.
    if (copies.where("finish < 2").agg(F.sum("size")).first()[0] or 0) > total:
        copies = copies.where("finish < 2")
    # Finish times of equal width hold about equally many words, since each source deals evenly.
    queue = copies.select(
        "sid", "source", "turn", "size", "upto", "copy", "finish", F.floor(F.col("finish") * n_parts).cast("long").alias("bin")
    )
    queue = _running(queue.withColumn("all", F.lit(0)), ["all"], "bin", [F.col("finish"), F.col("source").isNull(), F.col("source"), F.col("turn"), F.col("copy")], "size", "queued")
    taken = queue.where(F.col("queued") <= total).groupBy("sid", "upto", F.col("turn").alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    idle = rows.where("size = 0").select(
        "doc_id", "turn", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken")
    )
    copies = F.coalesce("copies", F.lit(0)).cast("long")
    return (
        dealt.join(taken, ["sid", "upto"], "left")
        .select("doc_id", "turn", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
        .union(idle)
    )


def _few(shares: DataFrame, most: int = 10_000) -> bool:
    """Whether the sources are few enough to be sent to every task."""
    return shares.limit(most + 1).count() <= most


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS turn
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM r GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k,
         coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
         coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
  FROM s),
f AS (SELECT min(k) AS fk FROM o WHERE (total - 3 * sb) * weight <= 3 * source_size * (weights - wb)),
l AS (SELECT fk, CAST(total - 3 * sb AS BIGINT) AS rest, CAST(weights - wb AS BIGINT) AS open FROM f JOIN o ON k = fk),
t AS (
  SELECT source, source_size, total,
         CASE WHEN k >= fk THEN CAST(rest * weight AS DOUBLE) / CAST(open AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM o, l),
c AS (
  SELECT r.*, t.source_size, t.target, t.total,
         sum(size) OVER (PARTITION BY r.source ORDER BY turn, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CAST(copy * source_size + upto AS DOUBLE) / target AS finish
  FROM c, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0),
z AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, copy ROWS UNBOUNDED PRECEDING) AS queued FROM q)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(n, 0) * c.size AS BIGINT) AS taken
FROM c LEFT JOIN (SELECT doc_id, count(*) AS n FROM z WHERE queued <= total GROUP BY doc_id) USING (doc_id)
"""
