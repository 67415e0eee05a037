"""Secret scan with column functions only: patterns, and windows of high entropy.

Patterns. Assignments to a secret's name, access keys and long hexadecimal runs; matches of a kind are leftmost and do not
overlap, and those that are too short drop out after matching.

Entropy. Candidates are runs of one character class (hexadecimal, base64, words of lower-case or of upper-case letters and digits). A window of the class's
length slides over a candidate. Its counts change by one character in and one out, and so does the sum of
``c * log2(c)`` over the counts, from which the window's Shannon entropy follows: ``log2(size) - sum / size``.
A candidate whose best window reaches the class's threshold gives a span, unless the allow-list names its shape, or a
span found by a pattern covers it.

Positions count code points; ends are exclusive. Spans are written ``kind:start:end``.

Defined cases: null text counts as empty; very long texts and candidates are read whole, in time that grows with their length; repeated
rows are scanned each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "[A-Za-z0-9+/_.=-]+"
NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


#: In the order in which kinds are listed at an equal start.
ASSIGN = "(" + "|".join(map(_either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?(""" + VALUE + ")"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Least lengths: of the assigned value, of an access key, of a hexadecimal run.
LEAST = {"assign": 6, "access": 20, "hex": 24}


@dataclass(frozen=True)
class EntropyClass:
    """Candidates match ``pattern``; ``alphabet`` is what is counted."""

    name: str
    pattern: str
    alphabet: str
    window: int
    threshold: float


DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("entropy_hex", r"(?<![0-9A-Za-z])(?:[0-9A-F]{20,}|[0-9a-f]{20,})(?![0-9A-Za-z])", DIGITS + "abcdefABCDEF", 20, 3.0),
    EntropyClass("entropy_base64", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[0-9A-Za-z+/_-]{24,}",
                 DIGITS + LOWER + LOWER.upper() + "+/_-", 24, 3.9),
    # In lower case, or in upper case as tokens and base32 are; runs that are hexadecimal have their own class.
    EntropyClass("entropy_token", r"(?<![0-9A-Za-z])(?:(?=[a-z]*[0-9])(?=[0-9]*[a-z])[0-9a-z]{24,}|(?=[A-Z]*[0-9])(?=[0-9A-F]*[G-Z])[0-9A-Z]{24,})(?![0-9A-Za-z])",
                 DIGITS + LOWER + LOWER.upper(), 24, 3.6),
)
#: Characters of a long candidate that are judged at a time; a sum of so many steps is off by far less than ``SLACK``.
PIECE = 512
SLACK = 1e-9
#: Shapes that are no secrets: unique ids, digests that say so, numbered or repeated fillers.
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(?:sha1|sha256|sha512|md5)[-_]",
    r"^[0-9]+$",
    r"(?i)(?:example|sample|dummy|placeholder|abcdefghij|0123456789)",
)


def _placed(text: Column, pattern: str, kind: str, keep) -> Column:
    """Array of ``start, kind_at, end, kind, value`` for the matches that ``keep(value)`` lets through."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # One pass that carries the position: text between matches, then the match.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        # Only what is kept is gathered, since each gathering copies the array.
        return F.struct(end.alias("at"), F.when(keep(pair["value"]), F.concat(state["spans"], F.array(
            F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))))).otherwise(state["spans"]).alias("spans"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, value: F.struct(
        F.length(gap).alias("gap"), value.alias("value")))
    spans = F.aggregate(pairs, start, step, lambda state: state["spans"])
    order = {"assign": 0, "access": 1, "hex": 2}.get(kind, 3)
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def _term(count: Column) -> Column:
    """``c * log2(c)``, 0 for no characters."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def best_entropy(value: Column, kind: EntropyClass) -> Column:
    """Greatest Shannon entropy of a window of ``value``, with counts kept up to date character by character.

    Long values are judged in pieces that overlap by a window less one character, so that every window lies in a piece
    and the time grows with the value's length.
    """
    size = kind.window
    pieces = F.regexp_extract_all(value, F.lit(rf"(?s)(?=(.{{1,{PIECE + size - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.array_max(F.transform(pieces, lambda piece: _best_of_piece(piece, kind)))


def _best_of_piece(piece: Column, kind: EntropyClass) -> Column:
    size = kind.window
    zero = F.array_repeat(F.lit(0), len(kind.alphabet) + 1)
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
    # Every character is looked up once, in an array that later steps only index.
    places = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(kind.alphabet), c))
    moves = F.transform(F.array(places), lambda all_: F.transform(all_, lambda p, i: F.struct(
        p.alias("into"), F.when(i >= size, F.get(all_, i - size)).otherwise(-1).alias("out"), (i >= size - 1).alias("full"))))[0]

    def step(state: Column, move: Column) -> Column:
        counts, into, out = state["counts"], move["into"], move["out"]
        gain = F.transform(F.array(F.get(counts, into)), lambda c: _term(c + 1) - _term(c))[0]
        loss = F.when(out >= 0, F.transform(F.array(F.get(counts, out)), lambda c: _term(c) - _term(c - 1))[0]).otherwise(F.lit(0.0))
        changed = F.transform(counts, lambda c, k: F.when(k == into, c + 1).when(k == out, c - 1).otherwise(c))
        # A character that enters as its like leaves changes nothing.
        slid = F.when(into == out, F.struct(counts.alias("counts"), state["sum"].alias("sum"))).otherwise(
            F.struct(changed.alias("counts"), (state["sum"] + gain - loss).alias("sum")))
        return F.transform(F.array(slid), lambda s: F.struct(
            s["counts"].alias("counts"), s["sum"].alias("sum"),
            F.greatest(state["best"], F.when(move["full"], math.log2(size) - s["sum"] / size).otherwise(F.lit(-1.0))).alias("best")))[0]

    return F.aggregate(moves, start, step, lambda s: s["best"])


def _allowed(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | value.rlike(pattern)
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, the pattern spans ``base`` and all spans ``found`` (arrays of start, order, end, kind, value)."""
    text = F.col("text")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")

    def where(test: str, spans: Column) -> Column:
        # Most texts hold nothing of a kind: a plain search spares them the splitting.
        return F.when(text.rlike(test), spans).otherwise(none)

    value = lambda v: F.regexp_extract(v, ASSIGN, 2)
    base = named.select("*", F.array_sort(F.concat(
        where(ASSIGN, _placed(text, ASSIGN, "assign", lambda v: F.length(value(v)) >= LEAST["assign"])),
        where("AKIA", _placed(text, ACCESS, "access", lambda v: F.length(v) >= LEAST["access"])),
        # Shorter runs only drop out, and runs are greedy: the least length can be asked for in the pattern.
        where(f"[0-9a-f]{{{LEAST['hex']}}}", _placed(text, f"[0-9a-f]{{{LEAST['hex']},}}", "hex", lambda v: F.lit(True))))).alias("base"))
    extra = F.concat(none, *[where(c.pattern, _entropy_spans(text, c)) for c in CLASSES])
    fresh = F.filter(extra, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return base.withColumn("found", F.array_sort(F.concat("base", fresh))).drop("text")


def _entropy_spans(text: Column, kind: EntropyClass) -> Column:
    return _placed(text, kind.pattern, kind.name, lambda v: ~_allowed(v) & (best_entropy(v, kind) >= kind.threshold - SLACK))


def report(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the pattern spans, and all spans by document."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id", *[count(k) for k in LEAST], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"))
