"""The prefix trie of conversations, by adaptive radix trees.

A turn is an id of fixed width: the MD5 of role and text, and the text's length in bytes, big-endian.
A conversation's key is its turns' ids one after the other, so sorting keys sorts conversations turn
by turn.  Keys are dealt by range, each task puts its own into an adaptive radix tree (nodes of 4, 16,
48 and 256 children that grow as needed, shared bytes kept once as a path), and every depth of the
tree that is a whole number of turns gives a node of the trie.

A node is open in a task if it lies on the way to the task's first or last key, for then its
conversations may go on in the tasks before or after; all others are whole, with all below them.
Only open nodes, two paths a task, are merged over tasks.  So a first turn, or a conversation, that a
third of all share is spread over as many tasks as its keys fill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm import store

#: Bytes of a turn's id: 16 of its digest, 4 of its text's length.
WIDTH = 20
#: Turns of a task's tree, on average.
TASK_TURNS = 1 << 16
BATCH_NODES = 1 << 14


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id) for every row with a conv_id; the id as upper-case hex digits."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    length = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(F.upper(digest), length).alias("id"))


def in_order(turns: Column) -> Column:
    """The ids of an array of (turn, id): by turn, null first, ties by id."""
    return F.transform(F.array_sort(F.transform(turns, lambda t: F.struct(t["turn"].isNotNull().alias("a"), t["turn"], t["id"]))), lambda t: t["id"])


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids): every conversation's turns in order.  One row holds the ids of one conversation, never its texts."""
    listed = turn_ids(conversations).groupBy("conv_id").agg(F.collect_list(F.struct("turn", "id")).alias("turns"))
    return listed.select("conv_id", in_order(F.col("turns")).alias("ids"))


def rebuilt(conversations: DataFrame, group: int = 5, most_shared: int = 8) -> DataFrame:
    """(conv_id, ids): conversation c starts with the first h turns of conversation c - c % group, h = crc32(c) % (most_shared + 1).

    Then come its own turns after its first h.  All turns of the shared conversation are taken if it
    has fewer, none if it is absent.  A group is ``group`` conversations at most, so one exchange by
    group serves the ordering and the sharing.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    listed = turn_ids(conversations).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.collect_list(F.struct("turn", "id")).alias("turns"))
    own = listed.select("base", "conv_id", in_order(F.col("turns")).alias("ids"))
    shared = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("ids", 1, most_shared)), ignorenulls=True)
    own = own.withColumn("shared", F.coalesce(shared.over(Window.partitionBy("base")), F.array().cast("array<string>")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most_shared + 1)).cast("int")
    rest = F.when(F.size("ids") > h, F.slice("ids", h + 1, F.size("ids"))).otherwise(F.array().cast("array<string>"))
    return own.select("conv_id", F.concat(F.slice("shared", 1, h), rest).alias("ids"))


class Node:
    """A node of an adaptive radix tree: the path that leads to it, its children by next byte, and what ends here.

    Up to 4 and up to 16 children are kept with their bytes in order, up to 48 through an index of
    256 bytes, more in a slot for every byte.
    """

    __slots__ = ("path", "room", "bytes", "children", "size", "ends", "n", "low", "tops", "leaves", "inside", "saved")

    def __init__(self, path: bytes):
        self.path, self.room, self.size = path, 4, 0
        self.bytes, self.children, self.ends = bytearray(), [], None

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def _grow(self) -> None:
        pairs = list(self.items())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.bytes, self.children = bytearray(256), []
            for k, (byte, node) in enumerate(pairs):
                self.bytes[byte] = k + 1
                self.children.append(node)
        elif self.room == 256:
            self.bytes, self.children = bytearray(), [None] * 256
            for byte, node in pairs:
                self.children[byte] = node

    def put(self, byte: int, node: Node) -> None:
        """Set the child of ``byte``, in place of one that is there."""
        there = self.child(byte) is not None
        if not there:
            if self.size == self.room:
                self._grow()
            self.size += 1
        if self.room <= 16:
            if there:
                self.children[self.bytes.find(byte)] = node
            else:
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.children.insert(at, node)
        elif self.room == 48:
            if there:
                self.children[self.bytes[byte] - 1] = node
            else:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node

    def items(self) -> Iterator[tuple[int, Node]]:
        if self.room <= 16:
            yield from zip(self.bytes, self.children)
        elif self.room == 48:
            for byte, at in enumerate(self.bytes):
                if at:
                    yield byte, self.children[at - 1]
        else:
            for byte, node in enumerate(self.children):
                if node is not None:
                    yield byte, node


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def insert(root: Node, key: bytes, end: int) -> None:
    """Add ``key``, which ends with ``end``; the root's path stays empty."""
    node, at = root, 0
    while True:
        if at == len(key):
            node.ends = [] if node.ends is None else node.ends
            node.ends.append(end)
            return
        byte = key[at]
        down = node.child(byte)
        if down is None:
            leaf = Node(key[at:])
            leaf.ends = [end]
            node.put(byte, leaf)
            return
        shared = _common(down.path, key[at : at + len(down.path)])
        if shared < len(down.path):
            split = Node(down.path[:shared])
            down.path = down.path[shared:]
            split.put(down.path[0], down)
            node.put(byte, split)
            down = split
        node, at = down, at + shared


def _turns(first: int, last: int, width: int) -> range:
    """The depths, in turns, of the trie's nodes on the bytes from ``first`` (excluded) to ``last`` (included)."""
    return range(first // width + 1, last // width + 1)


def _walk(root: Node) -> list[tuple[Node, int, Node | None]]:
    """All nodes from the top down, with the byte depth at which their path starts and the node above."""
    out, stack = [], [(root, 0, None)]
    while stack:
        node, at, above = stack.pop()
        out.append((node, at, above))
        stack.extend((child, at + len(node.path), node) for _, child in node.items())
    return out


def _weight(ident: bytes) -> int:
    """The bytes of a turn's text."""
    return int.from_bytes(ident[-4:], "big")


class Trie:
    """The trie of a task's keys, given in ascending order of (key, conv_id)."""

    def __init__(self, width: int = WIDTH):
        self.width, self.root, self.first, self.last = width, Node(b""), None, None

    def add(self, key: bytes, conv_id: int) -> None:
        if self.first is None:
            self.first = key
        self.last = key
        insert(self.root, key, conv_id)

    def nodes(self) -> Iterator[tuple]:
        """(side, depth, digest, above, n, low, parent, parent_side, children, leaves, saved, bytes, ends) of every node.

        A whole node has no side; its parent is the parent's least conversation, or, if that one is
        open, parent_side says on which path.  An open node has side 0 (on the way to the first key)
        or 1, the digests of its prefix and of its parent's, counts of what is whole below it, and as
        ``ends`` the conversations that end there, joined.
        """
        if self.first is None:
            return
        order = _walk(self.root)
        marks_of = self._marks(order)
        for node, at, _ in reversed(order):
            below = [child for _, child in node.items()]
            ends = node.ends or []
            node.n = len(ends) + sum(c.n for c in below)
            node.low = min([*ends, *(c.low for c in below)])
            node.tops = node.leaves = node.inside = 0
            for c in below:
                crosses = (at + len(node.path) + len(c.path)) // self.width > (at + len(node.path)) // self.width
                node.tops += 1 if crosses else c.tops
                node.leaves += c.leaves
                node.inside += c.saved
            node.leaves = node.leaves if below else 1
            weights = marks_of[id(node)]
            node.saved = node.inside + (node.n - 1) * sum(b for _, b in weights)
        paths = [self._path(key) for key in (self.first, self.last)]
        sides = {}
        for side in (1, 0):
            sides.update({id(node): side for node, _ in paths[side]})
        yield from self._open(paths, marks_of)
        above_of: dict[int, tuple[int | None, int | None]] = {}
        for node, at, above in order:
            side = sides.get(id(node))
            weights = marks_of[id(node)]
            if side is not None:
                above_of[id(node)] = (None, side)
                continue
            parent = above_of[id(above)]
            total = node.saved
            for k, (depth, weight) in enumerate(weights):
                ends_here = k == len(weights) - 1 and depth * self.width == at + len(node.path)
                children = node.tops if k == len(weights) - 1 else 1
                ends = ",".join(map(str, node.ends)) if ends_here and node.ends else ""
                yield None, depth, None, None, node.n, node.low, parent[0], parent[1], children, node.leaves, total, weight, hashlib.sha256(ends.encode()).hexdigest()
                parent = (node.low, None)
                total -= (node.n - 1) * weight
            above_of[id(node)] = parent

    def _marks(self, order) -> dict[int, list[tuple[int, int]]]:
        """For each node (depth, bytes of the last text) of the trie's nodes on its path; a turn's id may have begun in nodes above."""
        out, tails = {}, {}
        for node, at, above in order:
            tail = (tails[id(above)] if above is not None else b"") + node.path
            start = at - (at % self.width if above is not None else 0)
            depths = _turns(at, at + len(node.path), self.width)
            out[id(node)] = [(d, _weight(tail[d * self.width - self.width - start : d * self.width - start])) for d in depths]
            keep = (at + len(node.path)) % self.width
            tails[id(node)] = tail[len(tail) - keep :] if keep else b""
        return out

    def _path(self, key: bytes) -> list[tuple[Node, int]]:
        node, at, out = self.root, 0, [(self.root, 0)]
        while at < len(key):
            node = node.child(key[at])
            out.append((node, at))
            at += len(node.path)
        return out

    def _open(self, paths, marks_of) -> Iterator[tuple]:
        seen: set[int] = set()
        on_path = {id(node) for path in paths for node, _ in path}
        for side, (path, key) in enumerate(zip(paths, (self.first, self.last))):
            digests = [hashlib.md5(b"").digest()]
            running = hashlib.md5()
            for d in range(1, len(key) // self.width + 1):
                running.update(key[(d - 1) * self.width : d * self.width])
                digests.append(running.copy().digest())
            rows, carried = [], (0, 0, 0)
            for node, at in reversed(path):
                children, leaves, saved = self._whole_below(node, at, on_path)
                bottom = at + len(node.path)
                if id(node) not in seen:
                    carried = (carried[0] + children, carried[1] + leaves, carried[2] + saved)
                marks = [(0, 0)] if node is self.root else marks_of[id(node)]
                for k, (depth, weight) in enumerate(reversed(marks)):
                    fresh = id(node) not in seen
                    ends = ",".join(map(str, node.ends)) if fresh and node.ends and k == 0 and depth * self.width == bottom else ""
                    rows.append(
                        (side, depth, digests[depth], digests[depth - 1] if depth else None, node.n if fresh else 0, node.low if fresh else None,
                         None, None, *carried, weight, ends)
                    )
                    carried = (0, 0, 0)
            seen.update(id(node) for node, _ in path)
            yield from reversed(rows)

    def _whole_below(self, node: Node, at: int, on_path: set[int]) -> tuple[int, int, int]:
        bottom = at + len(node.path)
        children = leaves = saved = 0
        for _, c in node.items():
            if id(c) not in on_path:
                children += 1 if (bottom + len(c.path)) // self.width > bottom // self.width else c.tops
                leaves += c.leaves
                saved += c.saved
        return children, leaves, saved


NODES = (
    "part int, side int, depth long, digest binary, above binary, n long, low long, parent long, parent_side int, "
    "children long, leaves long, saved long, bytes long, ends string"
)
_ARROW = pa.schema(
    [("part", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("digest", pa.binary()), ("above", pa.binary()), ("n", pa.int64()),
     ("low", pa.int64()), ("parent", pa.int64()), ("parent_side", pa.int32()), ("children", pa.int64()), ("leaves", pa.int64()),
     ("saved", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string())]
)


def _tries(batches):
    """The nodes of one task's trie."""
    trie, part = Trie(), TaskContext.get().partitionId()
    for batch in batches:
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            trie.add(key, conv_id)
    rows = []
    for node in trie.nodes():
        rows.append((part, *node))
        if len(rows) == BATCH_NODES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _joined_hashes(batches):
    """SHA-256 of the texts of consecutive rows of one digest, comma-joined, whatever their number."""
    current, running = None, None
    for batch in batches:
        done = []
        for digest, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != current:
                if running is not None:
                    done.append((current, running.hexdigest()))
                current, running = digest, hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["digest", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([running.hexdigest()])], names=["digest", "ends_sha256"])


def _merged(opened: DataFrame) -> DataFrame:
    """Open nodes, one row each, as (digest, above, depth, n_convs, conv_id, n_children, n_leaves, saved_tokens, ends_sha256).

    What lies below a node is added up along the paths it is on: each node's own share is counted on
    one of its paths only, and a path's rows are summed from its end, so the work is linear in the
    paths' lengths.
    """
    nodes = opened.groupBy("digest").agg(
        F.max("above").alias("above"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"),
        F.sum("children").alias("whole"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("bytes").alias("bytes"),
        F.min(F.struct("part", "side")).alias("owner"),
    )
    nodes = store.checkpoint(nodes)
    below = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("digest")).agg(F.count(F.lit(1)).alias("open_below"))
    nodes = nodes.join(below, "digest", "left").withColumn("n_children", F.col("whole") + F.coalesce("open_below", F.lit(0)))
    own = nodes.select(
        "digest", "owner", (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("own_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"),
    )
    rows = opened.select("part", "side", "depth", "digest").join(own, "digest")
    mine = F.struct("part", "side") == F.col("owner")
    up = Window.partitionBy("part", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.when(mine, F.col(f"own_{c}")).otherwise(0)).over(up).alias(c) for c in ("leaves", "saved")]
    totals = rows.select("digest", *sums).groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ended = opened.where("ends <> ''").select("digest", "ends", "part")
    ended = ended.repartition("digest").sortWithinPartitions("digest", "part").select("digest", "ends")
    hashes = ended.mapInArrow(_joined_hashes, "digest binary, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    merged = nodes.join(totals, "digest").join(hashes, "digest", "left")
    return merged.select(
        "digest", "above", "depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """The trie of ``conversations`` (conv_id, ids as 40 hex digits a turn, see ``sequences``): one row per node.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the
    least conversation that starts with the node's turns; how many turns; the parent's conv_id; the
    conversations that start with them; children; childless nodes below, itself included; the bytes
    of last texts that storing them once saves, below and here; and the SHA-256 of the conversations
    that end here, ascending and comma-joined.  conv_id must be unique and not null.  A conversation
    without turns ends at the root; without conversations there are no nodes.

    A task holds the ids of its conversations (20 bytes a turn).  The hash of the conversations that
    end in one node is sequential by nature: one task reads them, as one text per task that met the
    node, and keeps none.
    """
    keyed = store.checkpoint(conversations.select(F.unhex(F.array_join("ids", "")).alias("key"), F.col("conv_id").cast("long").alias("conv_id")))
    turns = keyed.agg(F.sum(F.octet_length("key"))).first()[0]
    parts = max(1, -(-(turns or 0) // (WIDTH * task_turns)))
    dealt = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    nodes = store.checkpoint(dealt.mapInArrow(_tries, NODES))
    opened = nodes.where("side IS NOT NULL")
    merged = store.checkpoint(_merged(opened))
    ids = merged.select("digest", "conv_id")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = ids.select(F.col("digest").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    result = merged.join(above, "above", "left").select(out)
    closed = nodes.where("side IS NULL").select(
        "part", "parent_side", F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    # A whole node below an open one finds it by its task's own path, so no parent is a hot key.
    places = opened.join(ids, "digest").select("part", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "conv_id")
    hanging = closed.where("parent_side IS NOT NULL").drop("parent_conv_id")
    hanging = hanging.join(places.withColumnRenamed("conv_id", "parent_conv_id"), ["part", "parent_side", "depth"])
    return result.union(closed.where("parent_side IS NULL").select(out)).union(hanging.select(out))


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of each one's last turn, from turns (conv_id, place from 1, role, text); the root has none."""
    turns = conversations.select("conv_id", F.col("place").cast("long").alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST,
         md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), strlen(coalesce(text, ''))) AS o
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT c, o, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)), lambda a, b:
    xor(a >> 8, list_reduce([xor(a, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS r
  FROM t),
b AS (
  SELECT h.c, list_concat(coalesce(s.o[1:CAST(xor(h.r, 4294967295) % 9 AS INTEGER)], []), h.o[CAST(xor(h.r, 4294967295) % 9 AS INTEGER) + 1:]) AS o
  FROM h LEFT JOIN t s ON s.c = h.c - h.c % 5),
p AS (
  SELECT c, d, len(o) AS m, md5(CAST(o[1:d] AS JSON)) AS k, CASE WHEN d > 0 THEN md5(CAST(o[1:d - 1] AS JSON)) END AS up,
         CASE WHEN d > 0 THEN strlen(o[d].text) ELSE 0 END AS w
  FROM b, unnest(range(0, len(o) + 1)) AS u(d)),
n AS (
  SELECT d, k, up, min(c) AS c, count(*) AS n, max(w) AS w,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (m = d), '')) AS e
  FROM p GROUP BY d, k, up),
g AS (SELECT n.*, q.n_children FROM n LEFT JOIN (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) q USING (d, k)),
-- Every node is on the way of its least conversation, and so is all above it.
s AS (SELECT a.d, a.k, count(*) FILTER (g.n_children IS NULL) AS n_leaves, sum((g.n - 1) * g.w) AS saved
      FROM g JOIN p a ON a.c = g.c AND a.d <= g.d GROUP BY a.d, a.k)
SELECT g.c AS conv_id, CAST(g.d AS BIGINT) AS depth, v.c AS parent_conv_id, CAST(g.n AS BIGINT) AS n_convs,
       CAST(coalesce(g.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, g.e AS ends_sha256
FROM g JOIN s USING (d, k) LEFT JOIN n v ON v.d = g.d - 1 AND v.k = g.up
"""
