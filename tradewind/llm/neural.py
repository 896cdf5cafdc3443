"""A log-bilinear language model over all counted tokens, trained by noise-contrastive estimation.

The vector predicted for the next leaf is the sum of the context leaves' vectors, each scaled by
weights of its position; its product with a target vector, plus a bias, is a score.  The output has
two levels: the leaves in order of frequency are cut into groups, and a leaf's chance is its group's
times its own within the group, each a score's exponential over the sum of all of its level, taken
by batched products.  So the chances of all leaves add up to 1.  Training never takes those sums:
it tells tokens from noise drawn by frequency, for both levels.  The ``CLASSES`` most frequent
tokens have leaves of their own, the others share leaves by their hash, whose number grows with
theirs to ``1 << SHARED_BITS``.  Within a shared leaf a token has its smoothed frequency.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm.samples import lookup, text_hash
from tradewind.llm.text import BLANK_SEPARATED, byte_slices, signed, tokenize, utf8

#: Counts that every task knows by heart; rarer tokens meet theirs in a join.
KNOWN = 1 << 18
CLASSES = KNOWN
#: A shared leaf holds about so many tokens, until there are as many leaves as a task's memory allows.
SHARERS, SHARED_BITS = 16, 16
WIDTH = 24
CONTEXT = 2
END = 0
#: Tokens of a training step; noise groups that all of them meet; tokens of one group that meet the same noise, and how much.
_BATCH, _NOISE, _RUN, _RUN_NOISE = 8192, 64, 32, 8
_RATE = np.float32(0.1)
#: Tokens scored at a time, and scores held at a time.
_SCORED, _CELLS = 1 << 17, 1 << 17
#: Training tokens of a task, about 100 MB of text.
TASK_TOKENS = 1 << 24
#: Vectors that go through the shuffle as one row.
_BLOCK = 256


@dataclass
class Groups:
    """Leaves by falling frequency, and the groups they are cut into."""

    order: np.ndarray
    rank: np.ndarray
    bounds: np.ndarray
    own: np.ndarray

    @staticmethod
    def over(frequencies: np.ndarray) -> Groups:
        """Groups whose square roots of chances sum up to about 1: that many, cut there, cost a token the fewest products."""
        order = np.argsort(-frequencies, kind="stable")
        roots = np.sqrt(frequencies[order] / frequencies.sum())
        _, first, own = np.unique(np.floor(np.cumsum(roots) - roots), return_index=True, return_inverse=True)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return Groups(order, rank, np.append(first, len(order)), own)

    def __len__(self) -> int:
        return len(self.bounds) - 1


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_share(q: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log chance of the chosen one of ``vectors`` for each row, normalised over all of them."""
    scores = q @ vectors.T
    scores -= scores.max(axis=1, keepdims=True)
    own = scores[np.arange(len(q)), chosen].astype(np.float64)
    return own - np.log(np.exp(scores, out=scores) @ np.ones(len(vectors), np.float32))


@dataclass
class Model:
    """Parameters: context vectors, position weights and target vectors, each with its bias behind.

    Targets are the groups, then the leaves by falling frequency.
    """

    groups: Groups
    context: np.ndarray
    position: np.ndarray
    target: np.ndarray

    @staticmethod
    def fresh(frequencies: np.ndarray, width: int = WIDTH, seed: int = 7) -> Model:
        """Small random contexts, no target vectors; the biases alone give the frequencies.  One more context is the start."""
        rng, n, groups = np.random.default_rng(seed), len(frequencies), Groups.over(frequencies)
        context = 0.1 * rng.standard_normal((n + 1, width), np.float32)
        target = np.zeros((len(groups) + n, width + 1), np.float32)
        target[:, -1] = np.concatenate(_log_noise(np.log(frequencies / frequencies.sum()), groups)[1:])
        return Model(groups, context, np.ones((CONTEXT, width), np.float32), target)

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """The last place is for the bias."""
        q = np.ones((len(contexts), self.target.shape[1]), np.float32)
        q[:, :-1] = self.context[contexts[:, 0]] * self.position[0]
        for j in range(1, CONTEXT):
            q[:, :-1] += self.context[contexts[:, j]] * self.position[j]
        return q

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Of every leaf, for each context."""
        scores = (self.predicted(contexts) @ self.target.T).astype(np.float64)
        group, leaf = scores[:, : len(self.groups)], scores[:, len(self.groups) :]
        group = group - np.logaddexp.reduce(group, axis=1)[:, None] - np.logaddexp.reduceat(leaf, self.groups.bounds[:-1], axis=1)
        return (leaf + group[:, self.groups.own])[:, self.groups.rank]

    def log_chances(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Of one leaf for each context."""
        parts = range(0, len(targets), _SCORED)
        return np.concatenate([np.zeros(0), *(self._log_chances(contexts[i : i + _SCORED], targets[i : i + _SCORED]) for i in parts)])

    def _log_chances(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The tokens of one group meet its leaves in one product."""
        q, ranks = self.predicted(contexts), self.groups.rank[targets]
        order, own, first = _by_group(self.groups.own[ranks])
        q, ranks = q[order], ranks[order]
        n, logs = len(self.groups), np.empty(len(q))
        for i in range(0, len(q), max(1, _CELLS // n)):
            part = slice(i, i + max(1, _CELLS // n))
            logs[part] = _log_share(q[part], self.target[:n], own[part])
        for a, b in zip(first[:-1], first[1:]):
            low, high = self.groups.bounds[own[a]], self.groups.bounds[own[a] + 1]
            step = max(1, _CELLS // (high - low))
            for i in range(a, b, step):
                part = slice(i, min(b, i + step))
                logs[part] += _log_share(q[part], self.target[n + low : n + high], ranks[part] - low)
        out = np.empty(len(q))
        out[order] = logs
        return out

    def train(self, contexts: np.ndarray, targets: np.ndarray, noise: np.ndarray, rng, state: list) -> None:
        """One pass in random order; ``noise`` has the log chance by which each leaf is drawn as noise.

        A token's group is told from ``_NOISE`` groups drawn for the whole batch, the token itself
        from ``_RUN_NOISE`` leaves drawn from its group for each run of ``_RUN`` tokens of it.
        Steps are adaptive in each parameter.
        """
        groups, n = self.groups, len(self.groups)
        sums, log_group, log_leaf = _log_noise(noise.astype(np.float64), groups)
        ends = sums[groups.bounds]
        log_group, log_leaf = (log_group + math.log(_NOISE)).astype(np.float32), (log_leaf + math.log(_RUN_NOISE)).astype(np.float32)
        shuffled = rng.permutation(len(targets))
        for at in range(0, len(shuffled), _BATCH):
            batch = shuffled[at : at + _BATCH]
            ranks = groups.rank[targets[batch]]
            order, own, first = _by_group(groups.own[ranks])
            c, ranks = contexts[batch[order]], ranks[order]
            q, met = self.predicted(c), own[first[:-1]]

            drawn = np.clip(np.searchsorted(ends, rng.random(_NOISE) * ends[-1], "right") - 1, 0, n - 1)
            vectors, true = self.target[drawn], self.target[own]
            g = _logistic(q @ vectors.T - log_group[drawn])
            e = (_logistic(np.einsum("ij,ij->i", q, true) - log_group[own]) - 1)[:, None]
            g_q = g @ vectors + e * true
            rows, steps = [drawn, met], [g.T @ q, np.add.reduceat(e * q, first[:-1], axis=0)]

            lengths = np.diff(first)
            runs = -(-lengths // _RUN)
            place = np.arange(len(own)) - np.repeat(first[:-1], lengths)
            run = np.repeat(np.cumsum(runs) - runs, lengths) + place // _RUN
            # Empty places of a run are 0 and move nothing.
            padded = np.zeros((runs.sum(), _RUN, q.shape[1]), np.float32)
            padded[run, place % _RUN] = q
            low, high = (np.repeat(groups.bounds[met + i], runs)[:, None] for i in (0, 1))
            leaves = sums[low] + rng.random((len(low), _RUN_NOISE)) * (sums[high] - sums[low])
            leaves = np.clip(np.searchsorted(sums, leaves, "right") - 1, low, high - 1)
            vectors, true = self.target[n + leaves], self.target[n + ranks]
            g = _logistic(padded @ vectors.transpose(0, 2, 1) - log_leaf[leaves][:, None, :])
            e = (_logistic(np.einsum("ij,ij->i", q, true) - log_leaf[ranks]) - 1)[:, None]
            g_q += (g @ vectors)[run, place % _RUN] + e * true
            rows += [n + leaves.ravel(), n + ranks]
            steps += [(g.transpose(0, 2, 1) @ padded).reshape(-1, q.shape[1]), e * q]

            g_target, touched = _by_class(np.concatenate(rows), np.concatenate(steps))
            g_q = g_q[:, None, :-1]
            g_context, seen = _by_class(c.ravel(), (g_q * self.position).reshape(-1, self.position.shape[1]))
            g_position = (g_q * self.context[c]).sum(axis=0)
            for x, at_rows, step, s in ((self.target, touched, g_target, state[0]), (self.context, seen, g_context, state[1])):
                squares = s[at_rows] + step * step
                s[at_rows] = squares
                squares += 1
                np.sqrt(squares, out=squares)
                step /= squares
                step *= _RATE
                x[at_rows] -= step
            state[2] += g_position * g_position
            self.position -= 0.05 * g_position / np.sqrt(state[2] + 1.0)
            state[3][seen] += 1
            state[4][touched] += 1

    def rows(self) -> np.ndarray:
        """All parameters: a row for each context, target and position."""
        out = np.zeros((len(self.context) + len(self.target) + CONTEXT, self.target.shape[1]), np.float32)
        out[: len(self.context), :-1], out[-CONTEXT:, :-1] = self.context, self.position
        out[len(self.context) : -CONTEXT] = self.target
        return out

    def with_rows(self, rows: np.ndarray) -> Model:
        context, position = rows[: len(self.context), :-1], rows[-CONTEXT:, :-1]
        return Model(self.groups, *(np.ascontiguousarray(x) for x in (context, position, rows[len(self.context) : -CONTEXT])))

    def steps(self) -> list:
        """Sums of squared gradients; how many batches touched each context and target."""
        sums = [np.zeros_like(x) for x in (self.target, self.context)]
        return [*sums, np.zeros_like(self.position), np.zeros(len(self.context), np.int64), np.zeros(len(self.target), np.int64)]


def _log_noise(logs: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of the chances by rank; log chances of the groups, and of each rank's leaf within its group."""
    sums = np.concatenate([[0.0], np.cumsum(np.exp(logs[groups.order]))])
    of_group = np.log(np.diff(sums[groups.bounds]))
    return sums, of_group, logs[groups.order] - of_group[groups.own]


def _by_group(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by group, the groups in it, and where each begins, with the end."""
    order = np.argsort(groups, kind="stable")
    own = groups[order]
    return order, own, np.append(np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)]), len(own))


def _by_class(classes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the rows of each class."""
    order = np.argsort(classes, kind="stable")
    ordered = classes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return np.add.reduceat(rows[order], first, axis=0), ordered[first]


@dataclass
class Vocabulary:
    """Counts of the most frequent tokens, by ascending hash, and the corpus's totals.

    ``shared`` has the sums of the shared leaves: of every token c + 1, and 1 for an unseen one.
    """

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n: int
    distinct: int
    n_classes: int
    shared: np.ndarray | None = None

    @property
    def frequencies(self) -> np.ndarray:
        """Of each leaf, one added; the shared ones, last, have all other tokens and an unseen one."""
        own = np.zeros(self.n_classes)
        own[self.classes[self.classes >= 0]] = self.counts[self.classes >= 0] + 1
        return np.append(own, self.n + self.distinct + 1 - own.sum() if self.shared is None else self.shared)

    def shared_leaf(self, hashes: np.ndarray) -> np.ndarray:
        """By the hash's highest bits."""
        bits = 0 if self.shared is None else len(self.shared).bit_length() - 1
        return (hashes >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and an end, and the rows' bounds."""
    tokens = tokenize(data, offsets, BLANK_SEPARATED)
    rows = len(offsets) - 1
    hashes = np.insert(tokens.hashes, tokens.bounds[1:], np.uint64(END))
    return hashes, tokens.bounds + np.arange(rows + 1)


def _contexts(classes: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The classes before each token, nearest first; ``start`` where the row has none."""
    out = np.full((len(classes), CONTEXT), start, np.int64)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(classes)) - bounds[rows]
    for j in range(CONTEXT):
        inside = place > j
        out[inside, j] = classes[np.flatnonzero(inside) - j - 1]
    return out


def count_tokens(taught: DataFrame) -> DataFrame:
    """(h, n): how often each token occurs in the column text."""

    def scan(batches):
        counter = store.Counter()
        for batch in batches:
            for _, _, data, offsets in byte_slices(batch.column(0)):
                h, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
                for keys, counts in counter.add(h, n):
                    yield store.table(h=signed(keys), n=counts.astype(np.int64))
        for keys, counts in counter.rest():
            yield store.table(h=signed(keys), n=counts.astype(np.int64))

    return taught.select(utf8().alias("text")).mapInArrow(scan, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def learn_vocabulary(counts: DataFrame, classes: int = CLASSES, known: int = KNOWN) -> Vocabulary:
    n, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    floor = store.count_floor(counts, "n", known).get(0)
    away, h, c = counts, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if floor is not None:
        got, away = counts.where(F.col("n") >= floor).toArrow(), counts.where(F.col("n") < floor)
        h, c = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    place = np.full(len(h), -1)
    frequent = np.lexsort((h, -c))[:classes]
    place[frequent] = np.arange(len(frequent))
    bits = min(SHARED_BITS, max(0, math.ceil(math.log2(max(1, distinct - len(frequent)) / SHARERS))))
    out = Vocabulary(h, c, place, n, distinct, len(frequent), np.ones(1 << bits))
    leaf = F.shiftrightunsigned(F.shiftrightunsigned("h", 1), 63 - bits).cast("int")
    sums = away.groupBy(leaf.alias("leaf")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()
    out.shared[sums["leaf"].to_numpy()] += sums["n"].to_numpy()
    np.add.at(out.shared, out.shared_leaf(h[place < 0]), c[place < 0] + 1)
    return out


def _classes(hashes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Place in the vocabulary (or -1) and leaf of each token."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    at = lookup(distinct, vocabulary.hashes)
    own = np.append(vocabulary.classes, -1)[at]
    own = np.where(own < 0, vocabulary.n_classes + vocabulary.shared_leaf(distinct), own)
    return at[inverse], own[inverse]


def train(taught: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How far training moves `Model.rows` from a fresh model.

    Every task trains on its own rows from one start; each vector is averaged by how often tasks touched it.

    A task takes about ``TASK_TOKENS`` tokens, fewer if there are cores for more tasks, and returns
    what it touched, as 16-bit floats: the vectors that are shuffled are a fraction of the texts,
    and a lost executor repeats a bounded share of the work.
    """
    spark = taught.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def scan(batches):
        known = shared.value
        model, rng = Model.fresh(known.frequencies), np.random.default_rng(11)
        state, start = model.steps(), len(known.frequencies)
        noise = np.log(known.frequencies / known.frequencies.sum())
        for batch in batches:
            for _, _, data, offsets in byte_slices(batch.column(0), 1 << 20):
                hashes, bounds = _tokens(data, offsets)
                _, classes = _classes(hashes, known)
                model.train(_contexts(classes, bounds, start), classes, noise, rng, state)
        seen = np.concatenate([state[3], state[4], np.full(CONTEXT, state[3].sum())])
        moved = model.rows() - Model.fresh(known.frequencies).rows()
        for at in range(0, len(seen), _BLOCK):
            if seen[at : at + _BLOCK].any():
                yield store.table(
                    block=np.array([at // _BLOCK], np.int32),
                    seen=pa.array([seen[at : at + _BLOCK].tobytes()], pa.binary()),
                    moved=pa.array([moved[at : at + _BLOCK].astype(np.float16).tobytes()], pa.binary()),
                )

    def mean(tasks: pa.Table) -> pa.Table:
        total, sums = 0, 0
        for seen, moved in zip(tasks["seen"].to_pylist(), tasks["moved"].to_pylist()):
            times = np.frombuffer(seen, np.int64)
            total = total + times
            sums = sums + np.frombuffer(moved, np.float16).reshape(len(times), -1).astype(np.float64) * times[:, None]
        means = (sums / np.maximum(total, 1)[:, None]).astype(np.float16)
        return pa.table({"block": tasks["block"][:1], "moved": pa.array([means.tobytes()], pa.binary())})

    texts = taught.select(utf8().alias("text")).coalesce(max(spark.sparkContext.defaultParallelism, -(-vocabulary.n // TASK_TOKENS)))
    models = texts.mapInArrow(scan, "block int, seen binary, moved binary")
    means = models.groupBy("block").applyInArrow(mean, "block int, moved binary").toArrow()
    frequencies = vocabulary.frequencies
    out = np.zeros((2 * len(frequencies) + 1 + len(Groups.over(frequencies)) + CONTEXT, WIDTH + 1), np.float16)
    for block, moved in zip(means["block"].to_pylist(), means["moved"].to_pylist()):
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(moved, np.float16).reshape(-1, WIDTH + 1)
    return out


def score_texts(documents: DataFrame, teach: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``.

    Tokens are words between ASCII blanks, A-Z in lower case, and an end.  Counts and the model
    come from all rows that ``teach`` admits.  base_score sums log10((c + 1) / (N + V + 1)) over
    the tokens.  score is the model's log10 probability: of a token's leaf given the leaves before
    it, and of the token within a shared leaf in proportion to c + 1; the leaves, each shared one
    with an unseen token, add up to 1.  Null texts are empty and have an end.  Rows that share doc_id and
    text get one result each.  If no row teaches, N and V are 0 and both scores are 0.
    """
    spark = documents.sparkSession
    taught = documents.where(teach).select("text")
    counts = store.checkpoint(count_tokens(taught))
    vocabulary = learn_vocabulary(counts)
    total = vocabulary.n + vocabulary.distinct + 1
    shared = spark.sparkContext.broadcast((vocabulary, train(taught, vocabulary)))

    def scan(batches):
        known, moved = shared.value
        lbl = Model.fresh(known.frequencies)
        lbl = lbl.with_rows(lbl.rows() + moved)
        log_c = np.log10(known.counts + 1.0)
        leaves = known.frequencies
        within = np.log10(leaves)
        within[: known.n_classes] = 0
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for first, last, data, offsets in byte_slices(batch.column(2)):
                hashes, bounds = _tokens(data, offsets)
                at, classes = _classes(hashes, known)
                rows = np.repeat(np.arange(last - first), np.diff(bounds))
                chance = lbl.log_chances(_contexts(classes, bounds, len(leaves)), classes)
                rare = classes >= known.n_classes
                value = chance / np.log(10) - within[classes]
                own = at >= 0
                frequent = np.bincount(rows[own], weights=log_c[at[own]], minlength=last - first)
                shared_class = np.bincount(rows[own & rare], weights=log_c[at[own & rare]], minlength=last - first)
                n = np.diff(bounds)
                # Tokens that are not known by heart: by row and hash.
                away = np.flatnonzero(~own)
                order = away[np.lexsort((hashes[away], rows[away]))]
                h, r = hashes[order], rows[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
                tokens = pa.StructArray.from_arrays(
                    [pa.array(signed(h[new])), pa.array(np.diff(np.append(new, len(h))).astype(np.int64))], names=["h", "times"]
                )
                yield store.table(
                    doc_id=ids.slice(first, last - first),
                    text_key=keys.slice(first, last - first),
                    n_tokens=n.astype(np.int64),
                    n_own=np.bincount(rows[own], minlength=last - first).astype(np.int64),
                    own=frequent,
                    model=np.bincount(rows, weights=value, minlength=last - first) + shared_class,
                    away=pa.ListArray.from_arrays(pa.array(np.searchsorted(r[new], np.arange(last - first + 1)), pa.int32()), tokens),
                )

    if vocabulary.n == 0:
        return documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("n_tokens"),
            *[F.lit(0).cast("long").alias(c) for c in ("n_known", "train_tokens")],
            *[F.lit(0.0).alias(c) for c in ("base_score", "score")],
        )
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8().alias("text"))
    scored = store.checkpoint(
        source.mapInArrow(
            scan,
            "doc_id bigint, text_key bigint, n_tokens bigint, n_own bigint, own double, model double, away array<struct<h:bigint,times:bigint>>",
        )
    )
    rare = scored.select("doc_id", "text_key", F.explode("away").alias("t")).select("doc_id", "text_key", "t.h", "t.times")
    # A document that is there twice must not count its tokens twice.
    repeats = scored.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    found = (
        rare.join(counts, "h")
        .groupBy("doc_id", "text_key")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_rare"), F.sum("times").alias("n_rare"))
        .withColumnsRenamed({"doc_id": "i", "text_key": "k"})
    )
    copies = repeats.where("copies > 1").withColumnsRenamed({"doc_id": "ri", "text_key": "rk"})
    joined = scored.drop("away").join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    joined = joined.join(copies, F.col("doc_id").eqNullSafe(F.col("ri")) & (F.col("text_key") == F.col("rk")), "left")
    times = F.coalesce("copies", F.lit(1))
    log_rare, n_rare = F.coalesce("log_rare", F.lit(0.0)) / times, (F.coalesce("n_rare", F.lit(0)) / times).cast("long")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_own") + n_rare).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("own") + log_rare - F.col("n_tokens") * F.log10(F.lit(float(total)))).alias("base_score"),
        (F.col("model") + log_rare).alias("score"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(documents, text_hash() % 7 != 2)
    return scored.select("doc_id", (text_hash() % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
