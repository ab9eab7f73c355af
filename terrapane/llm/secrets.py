"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean trigram query (an OR of ANDs). One pass over the texts makes postings
(trigram, document) for the trigrams that some rule asks for; the postings of a document are intersected with a
bit_or, the rules whose query holds become candidates, and only these run their regex over the text. A rule with a
branch that has no trigram of its own (hex runs) scans every text.

Up to MOST_BROADCAST candidates (counted) go to the texts. More are joined by a shuffle, and then a text that holds the
rarest trigram of no branch, which can't be a candidate, stays where it is read, and only full scans run over it.

Defined results: null text counts as empty (no spans); rows of an equal doc_id each get their own row, and share
candidates, which only costs a regex run; other columns are ignored by `scan_secrets` and kept by `redact`, whatever
their names; no rows in, no rows out. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import IGNORECASE, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import carried, let, materialize, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value_group: int = 0
    min_value: int = 0
    ignore_case: bool = False  # for the trigram query only; the pattern carries its own flags


#: The first three are the base kinds, in the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"
MOST_STRINGS = 32
MOST_BROADCAST = 200_000  # candidates
#: Fixed value: letters of English text from the most to the least frequent.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR of ANDs of lower-case trigrams that any match must hold; None if some match may hold none."""

    def both(a, b):
        return b if a is None else a if b is None else [x | y for x, y in product(a, b)]

    def of(strings):
        """What a match that holds one of these strings must hold."""
        if any(len(s) < 3 for s in strings):
            return None
        return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]

    def walk(items):
        """(strings the item can be, or None if unknown; query of its parts)"""
        now, query, whole = {""}, None, True
        for op, arg in items:
            name, strings, inner = str(op), None, None
            if name == "LITERAL":
                strings = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                strings, inner = walk(arg[-1])
            elif name == "BRANCH":
                parts = [walk(x) for x in arg[1]]
                if all(s is not None for s, _ in parts):
                    strings = set().union(*(s for s, _ in parts))
                else:
                    each = [q if s is None else both(of(s), q) for s, q in parts]
                    inner = None if any(q is None for q in each) else [x for q in each for x in q]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, body = arg
                strings, inner = walk(body)
                if least == 0:
                    strings, inner = (strings | {""} if strings is not None and most == 1 else None), None
                elif strings is not None and not least == most == 1:
                    strings, inner = (None, of({s * least for s in strings}))
            if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
                now = {a + b for a, b in product(now, strings)}
                continue
            query, whole = both(both(query, of(now)), inner if strings is None else both(of(strings), inner)), False
            now = {""}
        return (now, query) if whole else (None, both(query, of(now)))

    strings, query = walk(_parser.parse(pattern, IGNORECASE if "(?i" in pattern else 0))
    return query if strings is None else of(strings)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, doc_id) of the given lower-case trigrams."""
    low = docs.select("doc_id", F.lower(text_of()).alias("low"))
    found = F.array_compact(F.array(*(F.when(F.col("low").contains(g), F.lit(i)) for i, g in enumerate(trigrams))))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id with one boolean is_<kind> for each rule whose Boolean query its postings satisfy; documents with none are left out."""
    trigrams = sorted({g for q in queries.values() for part in q for g in part})
    words = [trigrams[i : i + 62] for i in range(0, len(trigrams), 62)]
    place = {g: (w, b) for w, part in enumerate(words) for b, g in enumerate(part)}
    bit = F.expr("shiftleft(1L, trigram % 62)")
    seen = (
        trigram_index(docs, trigrams)
        .groupBy("doc_id")
        .agg(*(F.bit_or(F.when(F.expr(f"trigram div 62 = {w}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(len(words))))
    )

    def holds(part: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in range(len(words)):
            mask = sum(1 << place[g][1] for g in part if place[g][0] == w)
            if mask:
                test = test & (F.col(f"m{w}").bitwiseAND(F.lit(mask).cast("long")) == mask)
        return test

    def either(parts) -> Column:
        test = F.lit(False)
        for p in parts:
            test = test | holds(p)
        return test

    out = seen.select("doc_id", *(either(q).alias(f"is_{k}") for k, q in queries.items()))
    keep = F.lit(False)
    for k in queries:
        keep = keep | F.col(f"is_{k}")
    return out.where(keep)


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """The rule's leftmost non-overlapping matches: the gaps between them (split) and their own lengths add up to positions."""
    pattern = F.lit(rule.pattern)
    rows = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.value_group)).alias("value"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = x["hit"].isNotNull() & (F.length(x["value"]) >= rule.min_value)
        more = F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.cast("long").alias("at"), more.cast(SPAN).alias("out"))

    return F.aggregate(rows, start, step, lambda s: s["out"])


def probes(queries: dict[str, list[frozenset[str]]]) -> list[str]:
    """One trigram of each branch, that of the least frequent letters: a text without any of them satisfies no query."""
    rare = lambda g: (sum(FREQUENT.find(c) if c in FREQUENT else len(FREQUENT) for c in g), g)
    return sorted({max(part, key=rare) for q in queries.values() for part in q})


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """row (all columns of docs), text, and secret_spans, sorted by start and then by the rules' order."""
    rows = carried(docs, "doc_id", "text")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    none = F.array().cast(SPAN)

    def spans(go) -> Column:
        parts = [F.when(go(r), spans_of(text_of(), r, i)).otherwise(none) for i, r in enumerate(rules) if go(r) is not None]
        return F.sort_array(F.concat(none, *parts)).alias("secret_spans")

    full = lambda r: None if r.kind in queries else text_of().rlike(r.pattern)
    listed = lambda r: F.coalesce(F.col(f"is_{r.kind}"), F.lit(False)) if r.kind in queries else full(r)
    if not queries:
        return rows.select("row", "text", spans(full))
    found = materialize(candidates(docs, queries).withColumnRenamed("doc_id", "candidate_id"), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("candidate_id"))
    if found.count() <= MOST_BROADCAST:  # nothing is shuffled
        return rows.join(F.broadcast(found), same, "left").select("row", "text", spans(listed))
    asked = let(F.lower(text_of()), lambda low: reduce(Column.__or__, (low.contains(g) for g in probes(queries))))
    both = rows.where(asked).join(found, same, "left").select("row", "text", spans(listed))
    return rows.where(~asked).select("row", "text", spans(full)).unionByName(both)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, secret_spans."""
    return with_spans(docs.select("doc_id", "text"), rules).select("row.doc_id", "secret_spans")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by [SECRET]; overlapping spans are replaced as one. All columns stay; n_chars follows the text if there is one."""
    text = F.col("text")

    def step(state: Column, x: Column) -> Column:
        apart = x["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int")), F.lit("[SECRET]"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(apart, piece).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("secret_spans", start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    held = F.size("secret_spans") > 0
    out = with_spans(docs, rules).select("row", held.alias("held"), F.when(held, done).otherwise(text).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("held"), F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """What the query op5 returns, from the operator's spans."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select("doc_id", *(n(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
