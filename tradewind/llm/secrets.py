"""Secrets in texts: a trigram index picks candidates, regular expressions verify them.

Every rule's expression gives a Boolean query: the trigrams that any match must hold.  Postings of
those trigrams are counted per document; a document is a candidate for a rule when every part of
its query is met, and only candidates are searched.  A rule without mandatory trigrams searches
every document.  All work on rows is done by built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store

_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``; ``value_group`` must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    value_group: int = 0
    base: bool = False


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"])

#: In the order in which spans of one start are listed.  Runs of hex digits and access keys are
#: written with their least length: a shorter run has no longer one inside.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)


def _strings(parsed) -> list[set[str] | None]:
    """An expression as a sequence of sets of possible strings; None where they are too many."""
    parts: list[set[str] | None] = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append({chr(arg).lower()})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            parts.append({chr(a).lower() for _, a in arg})
        elif name == "SUBPATTERN":
            parts.extend(_strings(arg[3]))
        elif name == "BRANCH":
            branches = [_whole(_strings(b)) for b in arg[1]]
            parts.append(None if any(b is None for b in branches) else set().union(*branches))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            inner = _whole(_strings(body))
            if inner is not None and high == 1:
                parts.append(inner | {""} if low == 0 else inner)
            elif inner is not None and low > 0 and low * len(inner) <= 8:
                parts.extend([inner] * low)
                parts.append(None)
            else:
                parts.append(None)
        else:
            parts.append(None)
    return parts


def _whole(parts: list[set[str] | None]) -> set[str] | None:
    strings = {""}
    for part in parts:
        if part is None or len(strings) * len(part) > _MOST_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, part)}
    return strings


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What any match must hold, in lower case: all clauses, of each one alternative, of it all trigrams."""
    clauses, strings = [], {""}

    def close() -> None:
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        least = [o for o in options if not any(p < o for p in options)]
        if least and all(least):
            clauses.append(sorted(least, key=sorted))

    for part in [*_strings(re._parser.parse(pattern)), None]:
        if part is not None and len(strings) * len(part) <= _MOST_STRINGS:
            strings = {a + b for a, b in product(strings, part)}
        else:
            close()
            strings = part if part is not None and len(part) <= _MOST_STRINGS else {""}
    return clauses


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of ``trigrams``: (trigram, key), keys being hashes of doc_id."""
    lower = documents.select(F.xxhash64("doc_id").alias("key"), _lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lower"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.col("lower").contains(t))
    return lower.select("key", F.explode(held).alias("trigram"))


def candidates(documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the indexed rules whose queries a document's postings meet."""
    terms = [
        (rule.kind, i, j, t, len(option))
        for rule in rules
        for i, clause in enumerate(trigram_query(rule.pattern))
        for j, option in enumerate(clause)
        for t in sorted(option)
    ]
    clauses = {rule.kind: len(trigram_query(rule.pattern)) for rule in rules}
    spark = documents.sparkSession
    names = ("kind", "clause", "option", "trigram", "size")
    wanted = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, t)]) for t in terms])))
    need = F.element_at(F.create_map(*[x for k, n in clauses.items() for x in (F.lit(k), F.lit(n))]), F.col("kind"))
    # The terms are as many as the rules give, whatever the documents.
    met = (
        postings(documents, sorted({t[3] for t in terms}))
        .join(F.broadcast(wanted), "trigram")
        .groupBy("key", "kind", "clause", "option", "size")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = size")
        .groupBy("key", "kind")
        .agg(F.count_distinct("clause").alias("clauses"))
        .where(F.col("clauses") == need)
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _step(rule: Rule, place: int):
    """Go on over one match: what lies before it and its own length give its place."""

    def step(state: Column, m: Column) -> Column:
        begin = state["upto"] + F.char_length(m["gap"])
        end = begin + F.char_length(F.coalesce(m["match"], F.lit("")))
        span = F.struct(begin.alias("begin"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = m["match"].isNotNull() & ((F.char_length(m["value"]) >= rule.least) if rule.least else F.lit(True))
        return F.struct(end.alias("upto"), F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return step


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) for every row: found has (begin, place of the rule, end, kind), in that order.

    Matches are leftmost and do not overlap within a kind; begin and end count code points, the end
    exclusive.  Null and empty texts have none.  Rows that share a doc_id, or have none, share
    candidate rules at most, never matches.  Columns besides doc_id and text are not read.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    if indexed:
        hits = store.checkpoint(candidates(documents.select("doc_id", "text"), indexed))
        rows = rows.withColumn("key", F.xxhash64("doc_id")).join(hits, "key", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<begin:bigint,place:int,end:bigint,kind:string>>")
    searched, spans = [], []
    for i, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        asked = F.array_contains("kinds", rule.kind) if rule in indexed else F.col("text").rlike(rule.pattern)
        columns = [F.regexp_extract_all("text", pattern, F.lit(0)).alias("match"), F.split("text", rule.pattern, -1).alias("gap")]
        if rule.least:
            columns.append(F.regexp_extract_all("text", pattern, F.lit(rule.value_group)).alias("value"))
        searched.append(F.when(asked, F.arrays_zip(*columns)).alias(f"m{i}"))
        start = F.struct(F.lit(0).cast("long").alias("upto"), empty.alias("spans"))
        spans.append(F.coalesce(F.aggregate(f"m{i}", start, _step(rule, i))["spans"], empty))
    return rows.select("doc_id", *searched).select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(r.kind) for r in RULES if r.base], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        values = f"regexp_extract_all(t, '{p}', {r.value_group})"
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {i} AS place, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g, {values} AS v, {r.least} AS least FROM d"
        )
    listed = "string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, kind, place, least, unnest(m) AS m, unnest(list_slice(g, 1, len(m))) AS g, unnest(v) AS v, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
s AS (SELECT *, CAST(sum(len(g) + len(m)) OVER (PARTITION BY doc_id, place ORDER BY i) AS BIGINT) AS e FROM u),
k AS (SELECT doc_id, kind, place, e - len(m) AS b, e FROM s WHERE len(v) >= least),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, {listed} FILTER (place < 3) AS base, {listed} AS spans
  FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


SQL = _sql()
