"""Conversations as training windows within a token budget, with column functions only.

A turn is written as ``<|turn|>role`` newline ``text`` ``<|end|>`` newline. Inside roles and texts a backslash goes before every
backslash and into every string that a chat format could read as control (``CONTROL``), so nothing in a text can end or begin
a turn, and dropping those backslashes gives the text back.

Windows. Prefix sums of turn tokens cut a conversation at multiples of the room that a window has for new turns: turns that lie
between two cuts form a window, and a turn that crosses a cut forms one of its own. So windows hold whole turns, and
stay in the budget unless a single turn is larger than the room (``over_budget``). Each window begins with the system
turn and repeats whole turns before it, as far back as ``history`` tokens reach. Only assistant texts
that are new in a window bear loss; repeated ones are masked.

A window function gives the prefix sums, and windows are built by (conversation, window): no task holds the texts of a whole
conversation. History is joined by position buckets of ``history`` tokens, so a turn meets few windows.

Defined cases: a null text is empty and a null role is ``user``; turns with equal numbers follow by role and text; a repeated row is a turn
of its own; a null conversation id is a conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Openings of control strings of this and other chat formats; a backslash is put after their first character.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)"
TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+"


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how many of them repeated turns may take. The rest, less the system turn, is for new turns."""

    tokens: int = 1024
    history: int = 256
    #: Tokens that the marks around a turn count for.
    marks: int = 6


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_out(role: Column) -> Column:
    """A role stays on its line: its line ends are written as ``\\n`` after escaping."""
    return F.regexp_replace(escaped(role), "\n", r"\\n")


def _role_in(role: Column) -> Column:
    # "\\n" (two characters) is a line end unless its backslash is itself escaped.
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def turns_of(conversations: DataFrame, budget: Budget) -> DataFrame:
    """Turns in order with token counts, prefix sums and whether they are the leading system turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("user"))
    turns = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        (F.regexp_count(text, F.lit(TOKEN)) + budget.marks).cast("long").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(order) - 1)
    system = (F.col("place") == 0) & (F.col("role") == "system")
    turns = turns.withColumn("is_system", system).withColumn("new", F.when(system, 0).otherwise(F.col("tokens")))
    before = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("new")
    lead = F.max(F.when(system, F.col("tokens"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("before", before).withColumn("system_tokens", F.coalesce(lead, F.lit(0)))


def windows(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """``conv_id, window, formatted, loss, turns, new_turns, tokens, over_budget``; ``loss`` has (start, end) in code points."""
    turns = turns_of(conversations, budget)
    room = F.greatest(F.lit(1), F.lit(budget.tokens - budget.history) - F.col("system_tokens"))
    first = F.floor(F.col("before") / room)
    last = F.floor((F.col("before") + F.col("new") - 1) / room)
    # Windows in order: cut number twice for turns between cuts, odd numbers for turns across; a turn of its own
    # is told apart from later ones that cross the same cut by nothing, since only one turn can.
    window = F.when(first == last, 2 * first).otherwise(2 * last - 1)
    body = turns.where("not is_system").withColumn("window", window.cast("long"))
    starts = body.groupBy("conv_id", "window").agg(F.min("before").alias("begin"))
    reach = budget.history
    # A turn can be history of the windows that begin within ``history`` tokens after its own beginning.
    past = body.select(
        F.col("conv_id").alias("c"), F.col("place").alias("p"), "role", "text", "tokens", "before", F.col("new").alias("own"),
        F.explode(F.array(F.floor(F.col("before") / reach), F.floor(F.col("before") / reach) + 1)).alias("bucket"))
    marked = starts.withColumn("b", F.floor(F.col("begin") / reach))
    history = past.join(marked, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("bucket") == F.col("b"))).where(
        (F.col("before") + F.col("own") <= F.col("begin")) & (F.col("begin") - F.col("before") <= reach))
    # The system turn leads every window of its conversation, also of one that has no other turns.
    system = turns.where("is_system").select(F.col("conv_id").alias("c"), "role", "text", "tokens")
    every = starts.join(system, F.col("c").eqNullSafe(F.col("conv_id")), "full").where("role is not null")
    lead = every.select(
        F.when(F.col("begin").isNull(), F.col("c")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.coalesce("window", F.lit(0)).alias("window"), F.lit(0).alias("place"),
        F.coalesce(F.col("begin") > 0, F.lit(False)).alias("again"), "role", "text", "tokens")
    parts = (
        lead.unionByName(history.select("conv_id", "window", F.col("p").alias("place"), F.lit(True).alias("again"), "role", "text", "tokens"))
        .unionByName(body.select("conv_id", "window", "place", F.lit(False).alias("again"), "role", "text", "tokens")))
    return _formatted(parts, budget)


def _formatted(parts: DataFrame, budget: Budget) -> DataFrame:
    head = F.concat(F.lit(TURN), _role_out(F.col("role")), F.lit("\n"))
    said = escaped(F.col("text"))
    bears = (F.col("role") == "assistant") & ~F.col("again")
    turn = F.struct("place", "again", bears.alias("bears"), head.alias("head"), said.alias("said"), "tokens")
    rows = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("list"))
    tail = F.lit(END + "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["said"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END) + 1).alias("at"),
            F.when(t["bears"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    total = F.aggregate("list", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    return rows.select(
        "conv_id", "window",
        F.array_join(F.transform("list", lambda t: F.concat(t["head"], t["said"], tail)), "").alias("formatted"),
        F.aggregate("list", start, step, lambda s: s["spans"]).alias("loss"),
        F.transform("list", lambda t: t["again"]).alias("repeated"),
        total.alias("tokens"), (total > budget.tokens).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, window, turns, loss_text`` parsed from formatted windows; turns are (role, text) that the window has new."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 1_000_000_000)
    said = F.transform(pieces, lambda p: F.struct(
        _role_in(F.substring_index(p, "\n", 1)).alias("role"),
        # The text begins after the first line and ends before the closing mark.
        unescaped(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text")))
    fresh = F.filter(F.arrays_zip(said.alias("said"), F.col("repeated").alias("repeated")), lambda t: ~t["repeated"])
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select(
        "conv_id", "window", F.transform(fresh, lambda t: t["said"]).alias("turns"), F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, as counts and hashes."""
    parsed = read_back(formatted)
    rows = parsed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("windows"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    turns = F.flatten(F.transform("windows", lambda w: w["turns"]))
    loss = F.array_join(F.transform("windows", lambda w: w["loss_text"]), "")
    shown = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
