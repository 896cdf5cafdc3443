"""Personal data in texts: patterns, and a character tagger that learned from them.

The patterns give base spans.  Windows around digits and ``@`` with the base spans as labels, a
bounded sample picked by a hash, teach a bidirectional LSTM with a CRF.  It then reads overlapping
windows of every text that has such a character; a character gets the tag of the window whose
middle is nearest, and runs of tags over the whole text become spans.  Those that touch no base
span and pass their kind's own test are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.tagger import KINDS, Tagger, symbols

WINDOW, STRIDE = 96, 48
MARGIN = (WINDOW - STRIDE) // 2
#: At most so many windows teach the tagger.
MOST_WINDOWS = 2400
_DECODED = 512

Span = tuple[int, int, int]  # begin, place of the kind, end

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match starts where a run of digits does: from within the run it would start earlier.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, ``@`` and a dotted host, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if host and begin < at:
            yield begin, host.end()
            done = host.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by begin, then kind; matches that fail their test are dropped."""
    found = [(b, 0, e) for b, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(_small(part) for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


_TESTS = (
    lambda s: s.count("@") == 1 and not re.search(r"\s", s) and bool(re.fullmatch(r"[^@]+@[^@]*\w", s)),
    lambda s: bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s)) and all(_small(p) for p in s.split(".")),
    lambda s: bool(re.fullmatch(r"[0-9]([ -]?[0-9])+", s)) and 12 <= len(_DIGITS.sub("", s)) <= 19 and luhn(_DIGITS.sub("", s)),
    lambda s: bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", s)) and 9 <= len(_DIGITS.sub("", s)) <= 15,
)


def _windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows that hold a digit or ``@``, and their symbols.

    Window j reads from j * STRIDE - MARGIN and decides the STRIDE characters in its middle.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    triggers = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    middle = triggers // STRIDE
    numbers = np.unique(np.concatenate([middle - 1, middle, middle + 1]))
    numbers = numbers[(numbers >= 0) & (numbers * STRIDE < len(codes))]
    padded = np.zeros(len(codes) + MARGIN + 2 * WINDOW, np.int64)
    padded[MARGIN : MARGIN + len(codes)] = symbols(codes)
    return numbers, padded[numbers[:, None] * STRIDE + np.arange(WINDOW)]


def _labels(spans: list[Span], numbers: np.ndarray, n_chars: int) -> np.ndarray:
    tags = np.zeros(n_chars + MARGIN + 2 * WINDOW, np.int64)
    for begin, kind, end in reversed(spans):
        tags[MARGIN + begin : MARGIN + end] = 2 + 2 * kind
        tags[MARGIN + begin] = 1 + 2 * kind
    return tags[numbers[:, None] * STRIDE + np.arange(WINDOW)]


def learn_tagger(documents: DataFrame, most_windows: int = MOST_WINDOWS) -> Tagger:
    """Fit a tagger to at most ``most_windows`` windows, two thirds of them with a span if there are so many."""

    def scan(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                numbers, ids = _windows(text)
                tags = _labels(spans, numbers, len(text))
                for x, y in zip(ids.astype(np.uint8), tags.astype(np.uint8)):
                    out[0].append(x.tobytes())
                    out[1].append(y.tobytes())
                    out[2].append(bool(y.any()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], names=["x", "y", "spans"])

    windows = _with_triggers(documents).select("text").mapInArrow(scan, "x binary, y binary, spans boolean")
    # The order of hashes picks the same windows however the rows are dealt.
    picked = windows.dropDuplicates(["x"]).withColumn("place", F.xxhash64("x"))
    parts = [
        picked.where(F.col("spans") == kind).orderBy("place", "x").limit(n).select("x", "y").toArrow()
        for kind, n in ((True, most_windows * 2 // 3), (False, most_windows // 3))
    ]
    rows = pa.concat_tables(parts)
    tagger = Tagger()
    if rows.num_rows:
        x, y = (np.frombuffer(b"".join(rows[c].to_pylist()), np.uint8).reshape(-1, WINDOW).astype(np.int64) for c in ("x", "y"))
        tagger.fit(x, y, epochs=min(12, max(4, 4 * MOST_WINDOWS // len(x))))  # few windows are read more often
    else:
        tagger.p["out_bias"][0] = 50.0  # nothing was learned, nothing is found
    return tagger


def _with_triggers(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(text.alias("text")).where(F.col("text").rlike("[0-9@]"))


def find_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """All spans of each text by begin, then kind."""
    base, places, parts = [base_spans(t) if t else [] for t in texts], [], []
    for i, text in enumerate(texts):
        if text:
            numbers, ids = _windows(text)
            places.extend((i, int(j)) for j in numbers)
            parts.append(ids)
    if not places:
        return base
    ids = np.concatenate(parts)
    tags = np.concatenate([tagger.decode(ids[k : k + _DECODED]) for k in range(0, len(ids), _DECODED)])[:, MARGIN : MARGIN + STRIDE]
    out, at = [], 0
    for i, text in enumerate(texts):
        first = at
        while at < len(places) and places[at][0] == i:
            at += 1
        out.append(_reconciled(text, base[i], [j for _, j in places[first:at]], tags[first:at]))
    return out


def _reconciled(text: str, base: list[Span], numbers: list[int], tags: np.ndarray) -> list[Span]:
    """Spans from the tags of a text's windows, added to the base spans they do not touch."""
    if not np.any(tags):
        return base
    positions = (np.array(numbers)[:, None] * STRIDE + np.arange(STRIDE)).ravel()
    flat, added, k = tags.ravel(), [], 0
    while k < len(flat):
        tag = flat[k]
        if tag == 0:
            k += 1
            continue
        inside, j = (tag + 1) // 2 * 2, k + 1
        while j < len(flat) and flat[j] == inside and positions[j] == positions[j - 1] + 1:
            j += 1
        begin, end, kind = int(positions[k]), min(int(positions[j - 1]) + 1, len(text)), (tag - 1) // 2
        k = j
        while begin < end and text[begin].isspace():
            begin += 1
        while begin < end and text[end - 1].isspace():
            end -= 1
        if begin < end and _TESTS[kind](text[begin:end]) and not any(b < end and begin < e for b, _, e in base):
            added.append((begin, int(kind), end))
    return sorted(base + added)


def find_personal(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, spans, base) for every row; spans are (begin, place of the kind, end) in code points.

    Null, empty and untouched texts have none.  Each row is read on its own, whatever its doc_id.
    Columns besides doc_id and text are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("place", pa.int32()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [[{"begin": b, "place": p, "end": e} for b, p, e in spans] for spans in find_spans(texts, shared.value)]
            base = [[{"begin": b, "place": p, "end": e} for b, p, e in (base_spans(t) if t else [])] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(base, kind)], names=["doc_id", "spans", "base"])

    asked = F.when(F.col("text").cast("string").rlike("[0-9@]"), F.col("text").cast("string"))
    element = "array<struct<begin:bigint,place:int,end:bigint>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), asked.alias("text")).mapInArrow(
        scan, f"doc_id bigint, spans {element}, base {element}"
    )


def redact(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """``documents`` with every span of personal data replaced by its kind, such as ``<EMAIL>``.

    All columns stay; ``n_chars``, where there is one, is set to the new length if a text changed.
    Null texts stay null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tagger)

    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            out = []
            for text, spans in zip(texts, find_spans(texts, shared.value)):
                parts, at = [], 0
                for begin, kind, end in spans:
                    if begin >= at:
                        parts += [text[at:begin], f"<{KINDS[kind].upper()}>"]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if spans else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[1:]], names=["clean", *(f"c{i}" for i in range(batch.num_columns - 1))])

    names, rest = documents.columns, [c for c in documents.columns if c != "text"]
    asked = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    columns = [F.col(f"`{c}`") for c in names]
    kinds = ", ".join(["clean string", *(f"c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(names))])
    found = documents.select(asked.alias("asked"), *[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(scan, kinds)
    place = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    text = F.coalesce("clean", place["text"])
    new = {c: place[c] for c in rest} | {"text": text}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(documents.schema["n_chars"].dataType)).otherwise(place["n_chars"])
    return found.select(*[new[c].alias(c) for c in names])


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    listed = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["begin"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", listed)


def op4_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal(documents, learn_tagger(documents))
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _count(place: int) -> Column:
    return F.size(F.filter("base", lambda s: s["place"] == place)).cast("long")
