"""Near-duplicate documents by HyperMinHash sketches, confirmed on whole shingle sets.

A sketch has a register per bucket: the least hash that fell in, kept as its number of leading
zeros and the ``MANTISSA`` bits behind the first one.  An empty bucket borrows from a full one that
its number alone picks, so the chance that two registers agree stays the similarity for sets of
any size.  Runs of registers form bands; documents that share a band are candidates.

Copies with one and the same set are one node from the start.  Every node is compared with one
pivot of its bands first; then, in each band, those outside the largest component with one of them.
Bands whose nodes are still of several components are finished exactly: small ones by all pairs
across components, large ones through what sets their nodes apart from the most linked node of
their largest component (`_beside_pivot`).
So a large group of near copies costs a few comparisons per member and no link is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm.components import connected_components
from tradewind.llm.text import BLANK_SEPARATED, byte_slices, mix, shingles, signed, tokenize, unsigned, utf8

MANTISSA = 10
#: Bands of at most so many nodes compare all their pairs.
SMALL_BAND = 16


@dataclass(frozen=True)
class Similarity:
    """Links join documents whose sets share at least ``percent`` of their union.

    Bands of ``run`` registers are as many as let a pair at the threshold share none with a chance
    of at most ``miss``.
    """

    words: int = 5
    percent: int = 80
    run: int = 5
    miss: float = 1e-7

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.run))

    @property
    def registers(self) -> int:
        return self.bands * self.run


def distinct_shingles(tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, by row and hash."""
    at, grams = shingles(tokens, size)
    order = np.argsort(grams)
    order = order[np.argsort(at[order], kind="stable")]
    at, grams = at[order], grams[order]
    if len(at):
        new = np.r_[True, (at[1:] != at[:-1]) | (grams[1:] != grams[:-1])]
        at, grams = at[new], grams[new]
    return at, grams


def sketch(at: np.ndarray, grams: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Registers of each row: leading zeros and mantissa of the least hash of each bucket."""
    bucket = ((grams >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
    least = np.full(rows * registers, np.uint64(2**64 - 1))
    np.minimum.at(least, at * registers + bucket.astype(np.int64), mix(grams, 3) >> np.uint64(1))
    zeros = 63 - np.frexp(least.astype(np.float64))[1]
    shifted = least << (zeros + 2).clip(0, 63).astype(np.uint64)
    packed = (zeros.clip(0, 62).astype(np.uint64) << np.uint64(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA))
    full = (least != np.uint64(2**64 - 1)).reshape(rows, registers)
    packed = packed.astype(np.uint16).reshape(rows, registers)
    row, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        if attempt <= 48:
            source = (mix(empty.astype(np.uint64) * np.uint64(1009) + np.uint64(attempt), 5) % np.uint64(registers)).astype(np.int64)
        else:  # very few full buckets: the next one
            source = (empty + attempt - 48) % registers
        got = full[row, source]
        packed[row[got], empty[got]] = packed[row[got], source[got]]
        row, empty = row[~got], empty[~got]
    return packed


def _band_keys(registers: np.ndarray, run: int) -> np.ndarray:
    rows, n = registers.shape
    out = np.broadcast_to(np.arange(1, n // run + 1, dtype=np.uint64), (rows, n // run)).copy()
    for j in range(run):
        out = (out ^ registers[:, j::run].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return mix(out)


def _running_sum(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


def sketches(documents: DataFrame, kind: Similarity) -> DataFrame:
    """(id, key, n, f1, f2, registers, bands): the text's hash, the set's size and 128-bit hash, its sketch and band keys."""

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last, data, offsets in byte_slices(batch.column(2)):
                at, grams = distinct_shingles(tokenize(data, offsets, BLANK_SEPARATED), kind.words)
                rows = last - first
                bounds = np.searchsorted(at, np.arange(rows + 1))
                sums = [_running_sum(mix(grams, s)) for s in (11, 13)]
                regs = sketch(at, grams, rows, kind.registers)
                keys = _band_keys(regs, kind.run)
                yield store.table(
                    id=ids.slice(first, rows),
                    key=texts.slice(first, rows),
                    n=np.diff(bounds).astype(np.int64),
                    f1=signed(sums[0][bounds[1:]] - sums[0][bounds[:-1]]),
                    f2=signed(sums[1][bounds[1:]] - sums[1][bounds[:-1]]),
                    registers=pa.array([r.tobytes() for r in regs], pa.binary()),
                    bands=pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * kind.bands, pa.int32()), pa.array(signed(keys.ravel()))),
                )

    return documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), utf8().alias("text")).mapInArrow(
        scan, "id bigint, key bigint, n bigint, f1 bigint, f2 bigint, registers binary, bands array<bigint>"
    )


def shingle_sets(documents: DataFrame, kind: Similarity, wanted) -> DataFrame:
    """(id, f1, grams) of the documents whose id passes the broadcast bitmap ``wanted``; f1 as in `sketches`."""

    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            passes = store.in_bitmap(wanted.value, mix(unsigned(ids.to_numpy())))
            batch = batch.filter(pa.array(passes))
            ids = batch.column(0)
            for first, last, data, offsets in byte_slices(batch.column(1)):
                at, grams = distinct_shingles(tokenize(data, offsets, BLANK_SEPARATED), kind.words)
                bounds = np.searchsorted(at, np.arange(last - first + 1))
                sums = _running_sum(mix(grams, 11))
                yield store.table(
                    id=ids.slice(first, last - first),
                    f1=signed(sums[bounds[1:]] - sums[bounds[:-1]]),
                    grams=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(grams))),
                )

    source = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text"))
    return source.mapInArrow(scan, "id bigint, f1 bigint, grams array<bigint>")


def _hashed(ids: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            yield store.table(h=signed(mix(unsigned(batch.column(0).to_numpy()))))

    return ids.mapInArrow(scan, "h bigint")


def _likely(pairs: DataFrame, nodes: DataFrame, kind: Similarity) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches do not rule it out.

    Registers also agree by chance when different least hashes share zeros and mantissa; with a and
    b elements that has a chance of about 0.72 * 2**-MANTISSA * a*b/(a+b)**2, which is taken out of
    the estimate.  A pair stays unless the estimate is six deviations too low; sets too small to
    fill the registers stay anyway.
    """
    t, m = kind.percent / 100, kind.registers
    floor = t - 6 * math.sqrt(t * (1 - t) / m)

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, m) for c in ("u_regs", "v_regs")
            )
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("u_n", "v_n"))
            chance = 0.72 * 2.0**-MANTISSA * na * nb / (na + nb) ** 2
            estimate = ((a == b).mean(axis=1) - chance) / (1 - chance)
            keep = (estimate >= floor) | (np.minimum(na, nb) < 4 * m)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("registers").alias(f"{x}_regs")) for x in "uv"]
    sized = pairs.join(sides[0], "u").join(sides[1], "v").where(100 * F.least("u_n", "v_n") >= kind.percent * F.greatest("u_n", "v_n"))
    return sized.mapInArrow(scan, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, kind: Similarity) -> DataFrame:
    """Pairs whose whole sets have the similarity.

    Pairs and sets grow with the documents: both are shuffled, neither is collected by the driver to be sent.
    """
    u, v = (sets.select(F.col("id").alias(x), F.col("grams").alias(f"{x}_grams")).hint("merge") for x in "uv")
    joined = pairs.hint("merge").join(u, "u").join(v, "v")
    common = F.size(F.array_intersect("u_grams", "v_grams"))
    return (
        joined.select("u", "v", F.size("u_grams").alias("a"), F.size("v_grams").alias("b"), common.alias("common"))
        .where(100 * F.col("common") >= kind.percent * (F.col("a") + F.col("b") - F.col("common")))
        .select("u", "v")
    )


def _unfinished(labelled: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Bands of several components: their size, largest component (home) and its most linked node (pivot)."""
    degrees = reduce(DataFrame.union, links).select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hub = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("node")).alias("least")))
    hubs = labelled.select("node", "component").distinct().join(degrees, "node", "left").groupBy("component").agg((-hub["least"]).alias("hub"))
    parts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).join(hubs, "component")
    largest = F.max(F.struct("n", "hub", F.col("component").alias("home")))
    bands = parts.groupBy("band").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"), largest.alias("most"))
    unfinished = bands.where("parts > 1").select("band", "size", F.col("most.hub").alias("pivot"), F.col("most.home").alias("home"))
    return store.compact(unfinished)[0]


def _beside_pivot(clusters: DataFrame, sets: DataFrame, kind: Similarity) -> DataFrame:
    """Pairs (u, v) that may be linked among the nodes that share a pivot, but not yet a component.

    ``home`` is the pivot's component; nodes linked to the pivot itself are paired with it.  Other
    pairs matter only if one of the two is not linked to the pivot.  Let D(x) be the symmetric difference of x and the pivot p, and k = (1 - t) / (1 + t), so that x
    and y are linked if and only if |x ^ y| <= k (|x| + |y|).  As |x ^ y| = |D(x)| + |D(y)| - 2
    |D(x) & D(y)|, a link needs that D(x) and D(y) share at least (|D(x)| + |D(y)| - k (|x| + |y|))
    / 2 elements.  If y is not linked to p, |D(y)| > k (|y| + |p|), and that is more than (|D(x)| +
    k (|p| - |x|)) / 2: about half of D(x).  As |D(y)| >= |D(x)| - |x ^ y|, it is also at least
    |D(x)| - k (|x| + |y|).  Of sets that must share so many, the rarest elements already share
    one, so x meets y on its rarer part only, and edits of its own are rarer than the places edited.
    """
    k = (100 - kind.percent) / (100 + kind.percent)
    own = sets.select(F.col("id").alias("node"), F.col("grams").alias("g"))
    theirs = sets.select(F.col("id").alias("pivot"), F.col("grams").alias("p"))
    apart = (
        clusters.join(own, "node")
        .join(theirs, "pivot")
        .select(
            "pivot",
            "home",
            "node",
            "component",
            F.size("g").alias("n"),
            F.size("p").alias("np"),
            F.concat(F.array_except("g", "p"), F.array_except("p", "g")).alias("d"),
        )
        .withColumn("away", F.size("d"))
    )
    slack = 1e-9
    linked = F.col("away") <= k * (F.col("n") + F.col("np")) + slack
    half = F.floor((F.col("away") + k * (F.col("np") - F.col("n"))) / 2 - slack) + 1
    # Distances from p of linked sets differ by k (|x| + |y|) at most, and |y| is |x| / t at most.
    near = F.ceil(F.col("away") - k * F.col("n") * (1 + 100 / kind.percent) - slack)
    most = F.greatest(F.lit(1), near, F.ceil((F.col("away") - k * (F.col("n") + F.col("np"))) / 2 - slack))
    apart, _ = store.compact(
        apart.select(
            "pivot",
            "home",
            "node",
            "component",
            "n",
            "away",
            # Not linked by a hair may be either; it is then treated as both.
            (F.col("away") > k * (F.col("n") + F.col("np")) - slack).alias("stray"),
            linked.alias("linked"),
            (F.col("away") - F.greatest(F.lit(1), near, half) + 1).alias("short"),
            (F.col("away") - most + 1).alias("long"),
            F.explode_outer("d").alias("e"),
        )
    )
    own_pivot = apart.where("linked AND component <> home").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
    often = apart.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("often"))
    ranked = apart.join(often, ["pivot", "e"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("pivot", "node").orderBy("often", "e"))
    )
    ranked, _ = store.compact(ranked.where("rank <= short OR (stray AND rank <= long)"))
    own = {"node": "", "component": "_c", "n": "_n", "away": "_away", "rank": "_rank"}
    side = lambda rows, x: rows.select("pivot", "e", *[F.col(c).alias(x + end) for c, end in own.items()])
    short, long = ranked.where("rank <= short"), ranked.where("stray AND rank <= long")
    mixed = side(short.where("linked"), "u").join(side(long, "v"), ["pivot", "e"])
    strays = side(short.where("stray"), "u").join(side(short.where("stray"), "v"), ["pivot", "e"]).where("u < v")
    # Again: distances from the pivot of linked sets differ by k (|u| + |v|) at most.
    near = F.abs(F.col("u_away") - F.col("v_away")) <= k * (F.col("u_n") + F.col("v_n")) + slack
    # After the first common element in the order of rarity, no more can be common than either has left.
    left = 1 + F.least(F.col("u_away") - F.col("u_rank"), F.col("v_away") - F.col("v_rank"))
    near = near & (2 * left >= F.col("u_away") + F.col("v_away") - k * (F.col("u_n") + F.col("v_n")) - slack)
    sized = 100 * F.least("u_n", "v_n") >= kind.percent * F.greatest("u_n", "v_n")
    others = mixed.union(strays).where(near & sized & (F.col("u_c") != F.col("v_c"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return others.union(own_pivot.distinct())


@dataclass
class Linked:
    """Rows as scanned; the distinct sets of each id; a node for each set; links between nodes.

    A node is the least id that has its set.  If that id has other sets too (``several``), a hash of
    the set is the node instead.
    """

    scanned: DataFrame
    own: DataFrame
    classes: DataFrame
    links: list[DataFrame]
    several: bool


def _linked(documents: DataFrame, kind: Similarity) -> Linked:
    """Every set of every doc_id is sketched and compared."""
    spark = documents.sparkSession
    scanned = store.checkpoint(sketches(documents, kind))
    usable = scanned.where("n > 0 AND id IS NOT NULL")
    keys = ["f1", "f2", "id"]
    own = store.checkpoint(usable.groupBy(*keys).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("rows")))
    by_id = own.groupBy("id").agg(F.count(F.lit(1)).alias("sets"), F.sum("rows").alias("rows")).where("rows > 1")
    by_id, repeated = store.compact(by_id)
    repeats, several = repeated > 0, by_id.where("sets > 1").limit(1).count() > 0
    classes = own.groupBy("f1", "f2").agg(F.min(F.struct("id", "key")).alias("least")).select("f1", "f2", "least.*")
    if several:
        classes = classes.join(by_id.select("id", "sets"), "id", "left")
        classes = classes.withColumn("node", F.when(F.col("sets") > 1, F.xxhash64("f1", "f2")).otherwise(F.col("id")))
    else:
        classes = classes.withColumn("node", F.col("id"))
    classes = store.checkpoint(classes.select(*keys, "key", "node"))
    nodes = usable.drop("key").join(classes.drop("key"), keys)
    nodes = store.checkpoint((nodes.dropDuplicates(keys) if repeats else nodes).select("node", "id", "f1", "n", "registers", "bands"))
    banded = nodes.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    banded, _ = store.compact(banded.join(shared, "band"))
    active, _ = store.compact(nodes.join(banded.select("node").distinct(), "node").select("node", "id", "f1", "n", "registers"), 20_000)
    wanted = spark.sparkContext.broadcast(store.bitmap(_hashed(active.select("id")), "h"))
    sets = shingle_sets(documents, kind, wanted)
    if repeats:
        sets = sets.join(active.select("id", "f1", "node"), ["id", "f1"]).dropDuplicates(["node"])
        sets = sets.select(F.col("node").alias("id"), "grams")
    sets, _ = store.compact(sets.select("id", "grams"), 4_000)
    links: list[DataFrame] = []

    tested: list[DataFrame] = []

    def confirm(pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        if tested:  # no pair is compared twice
            pairs = pairs.join(reduce(DataFrame.union, tested), ["u", "v"], "left_anti")
        tested.append(store.compact(pairs)[0])
        likely, _ = store.compact(_likely(tested[-1], active, kind))
        links.append(store.compact(_confirmed(likely, sets, kind))[0])

    def in_components() -> DataFrame:
        """The bands' nodes with the components that all links so far make."""
        components, _ = store.compact(connected_components(reduce(DataFrame.union, links)))
        labelled = banded.join(components.hint("merge"), "node", "left")
        return store.compact(labelled.select("band", "node", F.coalesce("component", "node").alias("component")))[0]

    ordered = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    least = banded.groupBy("band").agg(F.min("node").alias("pivot"))
    first = banded.join(least, "band").groupBy("node").agg(F.min("pivot").alias("pivot"))
    confirm(first.where("node <> pivot").select(*ordered("node", "pivot")))

    labelled = in_components()
    unfinished = _unfinished(labelled, links)
    strays = labelled.join(unfinished.select("band", "home"), "band").where("component <> home")
    least = strays.groupBy("band").agg(F.min(F.struct("node", "component")).alias("p"))
    second = strays.join(least, "band").where("component <> p.component")
    confirm(second.select(*ordered("node", F.col("p.node"))))

    labelled = in_components()
    unfinished = _unfinished(labelled, links)
    rest = labelled.join(unfinished.where(F.col("size") <= SMALL_BAND).select("band"), "band")
    left, right = (rest.select("band", F.col("node").alias(x), F.col("component").alias(f"{x}_c")) for x in "uv")
    pairs = left.join(right, "band").where("u < v AND u_c <> v_c").select("u", "v")
    beside = labelled.join(unfinished.where(F.col("size") > SMALL_BAND).select("band", "pivot", "home"), "band").where("node <> pivot")
    pairs = pairs.union(_beside_pivot(beside.select("pivot", "home", "node", "component").distinct(), sets, kind))
    confirm(pairs)
    return Linked(scanned, own, classes, links, several)


def near_duplicates(documents: DataFrame, kind: Similarity = Similarity()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents``.

    A set holds the distinct runs of ``kind.words`` words (cut at ASCII blanks, A-Z in lower case);
    a shorter text is one run; a null, empty or blank one has no set and is linked with nothing.
    component_id is the least doc_id reachable through links; kept says that it is the row's own.
    Rows that repeat a doc_id are one document, linked through each of their sets.  A row
    without doc_id cannot be named: it takes no part, has a null component and is kept.  Other
    columns are not read.
    """
    found = _linked(documents, kind)
    members, _ = store.compact(found.own.join(found.classes.select("f1", "f2", "node"), ["f1", "f2"]).select("id", "node"))
    same_id = members.where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    components = connected_components(reduce(DataFrame.union, found.links).union(same_id))
    if found.several:  # a component may be named by a hash
        components = store.checkpoint(components)
        ids = components.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
        least = ids.groupBy("component").agg(F.min("node").alias("least"))
        components = components.join(least, "component").select("node", F.col("least").alias("component"))
    return (
        found.scanned.select("id", "n")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def kept_texts(documents: DataFrame, kind: Similarity = Similarity()) -> DataFrame:
    """(doc_id, text_key, n_rows): one text of every group of near copies, and every text without a set.

    Texts are compared whatever their doc_id, so unlike texts under one doc_id all stay.  Of a
    group the least doc_id and, under it, the least text_key (``xxhash64``) stays.  Rows without
    doc_id are left out.
    """
    found = _linked(documents, kind)
    components = connected_components(reduce(DataFrame.union, found.links))
    firsts = found.classes.select("node", "id", "key").join(components, "node", "left")
    firsts = firsts.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min(F.struct("id", "key")).alias("least"))
    texts = found.scanned.where("id IS NOT NULL").groupBy(F.col("id").alias("doc_id"), F.col("key").alias("text_key"))
    texts = texts.agg(F.count(F.lit(1)).alias("n_rows"), F.max("n").alias("n"))
    same = (F.col("doc_id") == F.col("least.id")) & (F.col("text_key") == F.col("least.key"))
    compared = texts.where("n > 0").join(firsts.select("least"), same, "left_semi")
    return compared.union(texts.where("n = 0")).drop("n")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Similarity(words=3, percent=85, run=6))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
