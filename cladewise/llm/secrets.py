"""Operator 6: secrets in texts, with the parts of a credential linked. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import pick

#: The kinds in their order of listing, with their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: alone they are no finding.
WEAK_ID = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{15,}(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}=*(?![A-Za-z0-9+/=_-])"
#: A scheme has at most 63 characters (no registered one has more), so a long run of letters is not read anew from each of them.
ENDPOINT = r"[a-z][a-z0-9+.-]{0,62}://[^\x20\t\r\n\"'<>]+"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Parts with at most so many characters between them may belong together.
SCOPE = 256
#: Steps of a running fold that are done in one go; arrays of results grow by so many at a time.
STRIDE = 64

SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column], kind: str) -> Column:
    """told(state before, item) of each item, the state going on by step(state, item); kind is the type of the result.

    A plain fold would copy the whole result at each item. Here the states before each
    STRIDE items come first, and then the items of each stride by themselves.
    """

    def states(strides: Column) -> Column:
        first = F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("before"))
        return F.aggregate(strides, first, lambda done, part: F.struct(F.aggregate(part, done["state"], step).alias("state"), F.concat(done["before"], F.array(done["state"])).alias("before")), lambda done: done["before"])

    def one(part: Column, state: Column) -> Column:
        own = F.struct(state.alias("state"), F.array().cast(kind).alias("out"))
        return F.aggregate(part, own, lambda done, x: F.struct(step(done["state"], x).alias("state"), F.concat(done["out"], F.array(told(done["state"], x)).cast(kind)).alias("out")), lambda done: done["out"])

    return let(let(items, in_strides), lambda strides: F.flatten(F.zip_with(strides, states(strides), one)))


def in_strides(items: Column) -> Column:
    """An array as arrays of STRIDE items; none of an empty one."""
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STRIDE).cast("int")), lambda k: F.slice(items, k * STRIDE + 1, STRIDE))
    return F.when(F.size(items) > 0, each).otherwise(F.slice(F.array(items), 1, 0))


def found(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of the matches, leftmost first: what lies between them tells where they are.

    With `least`, only those whose second group has so many characters.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("size"), (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length) if least else F.transform(whole, F.length)).alias("value"))

    def span(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        return F.when(x["value"] >= least, F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end")))

    spans = F.filter(running(pairs, F.lit(0), lambda at, x: at + x["gap"] + x["size"], span, SPAN), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


#: The roles of parts, with their kinds; base spans are a role besides.
ROLES = {"ids": (1, 3), "secrets": (0, 2, 4), "ends": (5,), "base": (0, 1, 2)}


def swept(parts: Column, onward: bool) -> Column:
    """Parts, sorted by start and swept to the right (onward) or back, with `near` and `inside` also true if a part met before is so.

    near: a part of another of the three roles has at most SCOPE characters between.
    inside: a base span overlaps. Going right the largest end met of each role tells,
    going left the smallest start.
    """
    far = -(1 << 30) if onward else 1 << 30
    more, mark = (F.greatest, "end") if onward else (F.least, "start")

    def step(state: Column, x: Column) -> Column:
        return F.struct(*(F.when(x["kind"].isin(*kinds), more(state[r], x[mark])).otherwise(state[r]).alias(r) for r, kinds in ROLES.items()))

    def told(state: Column, x: Column) -> Column:
        gap = (lambda r: x["start"] - state[r]) if onward else (lambda r: state[r] - x["end"])
        near = F.lit(False)
        for r, kinds in [*ROLES.items()][:3]:
            near = near | (~x["kind"].isin(*kinds) & (gap(r) <= SCOPE))
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), (x["near"] | near).alias("near"), (x["inside"] | (gap("base") < 0)).alias("inside"))

    start = F.struct(*(F.lit(far).alias(r) for r in ROLES))
    return running(parts, start, step, told, "array<struct<start:int,kind:int,end:int,near:boolean,inside:boolean>>")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then text, base (spans of the three kinds) and spans (with the linked weak parts).

    Spans are structs of start, kind (place in KINDS) and end, in code points, sorted by
    start, then kind. Identifiers (access keys or weak ids), secrets (assignments, hex
    runs or weak secrets) and endpoints are joined by their intervals: a weak part is
    reported only if a part of another role has at most SCOPE characters between, and
    if no base span overlaps it. The join sweeps the sorted parts of a row once to the
    right and once back, so a document with many parts needs no shuffle, no row more,
    and time in proportion to its parts. A null text counts as empty and has no spans;
    ids may be null or repeat, each row stands for itself; an empty table gives no rows.
    """
    rows = pick(docs, *dict.fromkeys((*keep, "text"))).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    rows = rows.select("*", found(text, ASSIGN, 0, 6).alias("_assign"), found(text, ACCESS, 1).alias("_access"), found(text, HEX, 2).alias("_hex"), *(found(text, p, k).alias(f"_{KINDS[k]}") for k, p in ((3, WEAK_ID), (4, WEAK_SECRET), (5, ENDPOINT))))
    rows = rows.withColumns({"base": F.array_sort(F.concat("_assign", "_access", "_hex")), "_weak": F.concat("_weak_id", "_weak_secret", "_endpoint")}).select(*keep, *(["text"] if "text" not in keep else []), "base", "_weak")
    parts = F.transform(F.array_sort(F.concat("base", "_weak")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("near"), (s["kind"] < 3).alias("inside")))
    # A weak part that a base span overlaps tells nothing new.
    linked = F.filter(F.reverse(swept(F.reverse(swept(parts, True)), False)), lambda s: (s["kind"] < 3) | (s["near"] & ~s["inside"]))
    spans = F.transform(linked, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.withColumn("spans", F.when(F.size("_weak") > 0, spans).otherwise(F.col("base"))).drop("_weak")


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, a digest of the base spans, and all spans."""
    rows = scan(docs)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans replaced by the mark; n_chars, if there, is counted anew where the text changed."""
    width = len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(width)])
    at = docs.columns.index("text")
    rows = scan(plain.withColumn("text", F.col(f"c{at}")), tuple(plain.columns))
    # What stays before each span that overlaps no earlier one; then the strides' texts, each from its own part of the text.
    before = running(F.col("spans"), F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end"))), "array<struct<start:int,end:int>>")
    rows = rows.withColumn("_kept", F.filter(before, lambda s: s.isNotNull()))
    rows = rows.withColumn("_strides", F.when(F.size("spans") > 0, let(F.col("_kept"), in_strides)))

    def cut(part: Column) -> Column:
        begin = F.get(part, F.lit(0))["start"]
        own = F.substring(F.col("text"), begin + 1, F.element_at(part, -1)["end"] - begin)
        return let(own, lambda t: F.transform(part, lambda s: F.concat(F.substring(t, s["start"] - begin + 1, s["end"] - s["start"]), F.lit(mark))))

    tail = F.substring(F.col("text"), F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length("text"))
    clean = F.concat(F.array_join(F.flatten(F.transform("_strides", cut)), ""), tail)
    # In a step of its own: a select that makes a new `text` would lend it to the lambdas beside it.
    rows = rows.withColumn("_clean", F.when(F.size("spans") > 0, clean))
    own = {i: F.col(f"c{i}") for i in range(width)} | {at: F.coalesce("_clean", F.col(f"c{at}"))}
    for i, c in enumerate(docs.columns):
        if c == "n_chars":
            own[i] = F.coalesce(F.length("_clean").cast(docs.schema[i].dataType), F.col(f"c{i}"))
    return rows.select(*(own[i].alias(c) for i, c in enumerate(docs.columns)))
