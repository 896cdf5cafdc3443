from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tradewind.llm import prefixes as pf

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def order(rows):
    """Turns of each conversation as (role, text), by turn, null first, ties by id."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in out.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    """The definition, node by node."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below, children = defaultdict(list), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
        if node:
            children[node[:-1]] += 1
    out = []
    for node, cs in members.items():
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below[node] if v)
        hashed = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), children[node], sum(not children[v] for v in below[node]), saved, hashed))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(seed, n=60):
    """Conversations with a first turn that a third share, copies of one, prefixes of others, long ones."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(10 * n), n):
        if rng.random() < 0.2:
            turns = [("user", "same"), ("assistant", "copy")]
        else:
            turns = [("user", "same" if rng.random() < 0.4 else f"q{rng.randrange(400)}")]
            turns += [("assistant", f"é{rng.randrange(3)}") for _ in range(rng.choice([0, 1, 2, 5, 40]))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, task_turns", [(1, 1 << 16), (2, 40), (3, 7), (4, 1)])
def test_equals_brute_force_in_any_number_of_tasks(spark, seed, task_turns):
    rows = talks(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(pf.prefix_trie(pf.sequences(df), task_turns)) == brute(order(rows))
    assert rows_of(pf.prefix_trie(pf.rebuilt(df), task_turns)) == brute(rebuild(order(rows)))


def test_copies_of_one_conversation_go_to_many_tasks(spark):
    """Copies, and what shares a first turn, fill tasks like any other; their hash still lists all, ascending."""
    rows = [(c, 0, "user", "hi") for c in range(3000)] + [(c, 1, "assistant", f"a{c}") for c in range(2000, 3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(pf.prefix_trie(pf.sequences(df), 250)) == brute(order(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 5, None, None), (1, 5, "user", ""), (1, 5, "user", ""), (None, 0, "user", "nobody"), (2, 0, "us", "erx"),
        (3, 0, "user", "x"), (4, 0, "use", "rx"), (11, 0, "user", "long " * 100_000), (12, 3, "user", "first"), (-7, 0, "user", "first"), (-5, 1, "a", "b"),
    ]
    wide = spark.createDataFrame([(*r, 1, "n", 2.0) for r in rows], SCHEMA + ", depth int, n string, place double").repartition(4)
    assert rows_of(pf.prefix_trie(pf.sequences(wide))) == brute(order(rows))
    positive = [r for r in rows if r[0] is None or r[0] > 0]
    assert rows_of(pf.prefix_trie(pf.rebuilt(wide.where("conv_id IS NULL OR conv_id > 0")))) == brute(rebuild(order(positive)))
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(pf.prefix_trie(pf.rebuilt(none))) == []


def test_conversations_without_turns_end_at_the_root(spark):
    seqs = spark.createDataFrame([(9, []), (4, []), (30, ["AB" * 16 + "00000007"])], "conv_id long, ids array<string>")
    root, leaf = sorted(pf.prefix_trie(seqs).collect(), key=lambda r: r.depth)
    assert (root.conv_id, root.n_convs, root.n_children, root.n_leaves) == (4, 3, 1, 1)
    assert root.ends_sha256 == hashlib.sha256(b"4,9").hexdigest()
    assert (leaf.conv_id, leaf.parent_conv_id, leaf.saved_tokens) == (30, 4, 0)


def test_node_layouts_grow_and_paths_are_shared():
    root = pf.Node(b"")
    keys = [bytes([b, 1, 2, 3, c]) for b in range(256) for c in (7, 9)]
    rooms = []
    for i, k in enumerate(keys):
        pf.insert(root, k, i)
        rooms.append(root.room)
    assert [rooms[2 * n - 1] for n in (4, 5, 16, 17, 48, 49, 256)] == [4, 16, 16, 48, 48, 256, 256]
    child = root.child(130)
    assert child.path == bytes([130, 1, 2, 3]) and child.room == 4 and child.size == 2
    assert [b for b, _ in root.items()] == list(range(256))
    pf.insert(root, bytes([130, 1]), 99)
    assert root.child(130).path == bytes([130, 1]) and root.child(130).ends == [99] and root.size == 256
    found = [k for k in keys if _find(root, k) == [keys.index(k)]]
    assert found == keys


def _find(node, key):
    while key:
        node = node.child(key[0])
        if node is None or not key.startswith(node.path):
            return None
        key = key[len(node.path) :]
    return node.ends


def test_only_whole_turns_make_nodes():
    """Ids that differ in their first, a middle or their last byte branch within a turn, which is no node."""
    trie = pf.Trie(4)
    keys = sorted([b"\0\0\0\1\0\0\0\5", b"\0\0\0\2\0\0\0\5", b"\0\1\0\1", b"\2\0\0\1\0\0\0\5\0\0\0\6", b"\2\0\0\1\0\7\0\5"])
    for i, k in enumerate(keys):
        trie.add(k, i)
    depths = sorted(row[1] for row in trie.nodes() if row[0] != 1 or row[5] is not None)
    assert depths == sorted([0] + [len(p) // 4 for p in {k[:n] for k in keys for n in range(4, len(k) + 1, 4)}])


def test_last_turns(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, place long, role string, text string")
    nodes = pf.prefix_trie(pf.sequences(df.withColumnRenamed("place", "turn")))
    got = {(r.conv_id, r.depth): r.text for r in pf.last_turns(nodes, df).collect()}
    assert got == {(1, 0): None, (1, 1): "a", (1, 2): "b"}


def test_tasks_hold_parts_of_a_hot_first_turn(spark):
    rows = [(c, t, "user", "hi" if t == 0 else f"{c}") for c in range(400) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    keyed = pf.sequences(df).select(F.unhex(F.array_join("ids", "")).alias("key"), "conv_id")
    dealt = keyed.repartitionByRange(8, "key", "conv_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 120
