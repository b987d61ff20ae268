"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are laid end to end in tokens. With room for ``2 * stride`` new tokens in a window, a
turn belongs to the span in which it ends (``end div stride``): such a span starts less than one stride early,
so it fits, and no loop over turns is needed: running sums decide everything. A turn longer than a stride gets
a window of its own and is never cut. Turns that end in the last ``history`` tokens before a span are repeated
at its head, and the leading system turn heads every window; both are outside the loss there, so each
assistant text is learned once.

Rows of one conversation meet in one task once (a single shuffle, whose window buffer spills); the longest
value built is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
#: Escapes, applied in this order; every escape is a backslash and one letter, so reading back is exact.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: What counts as one token of the budget: a run of letters or digits, or any other visible character.
TOKEN = "[\\p{L}\\p{M}]+|\\p{N}+|[^ \\t-\\r\\p{L}\\p{M}\\p{N}]"


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def windows(df: DataFrame, budget: int = 1024, history: int = 128, learned_role: str = "assistant") -> DataFrame:
    """Windows of every conversation of ``df`` (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, window (0, 1, ...), formatted, n_repeated (turns at the head that an earlier window has
    already: the system turn and history), n_turns (all turns), loss_spans (array of 0-based start and length
    in code points of ``formatted``), n_tokens.

    Turns go by turn number, nulls first; equal numbers by role (system first), then text; repeated rows are
    repeated turns. A null role or text is an empty one; a null conv_id is a conversation like any other. A
    window exceeds the budget only where one turn (with the system turn) does. An empty table has no windows.
    """
    turns = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", (F.col("role") != "system").cast("int"), "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(in_order) - 1)
    turns = turns.withColumn("leading", (F.col("pos") == 0) & (F.col("role") == "system"))
    whole = Window.partitionBy("conv_id")
    turns = turns.withColumn("length", F.when(F.col("leading"), 0).otherwise(F.col("tokens")))
    turns = turns.withColumn("end", F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumn("system", F.max(F.when(F.col("leading"), F.col("tokens"))).over(whole))
    turns = turns.withColumn("total", F.sum("length").over(whole))
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.coalesce("system", F.lit(0))) / 2))
    turns = turns.withColumn("stride", stride.cast("long"))
    step = F.expr("end div stride")
    own = 2 * step + F.when(F.col("length") > F.col("stride"), 0).otherwise(1)
    # kinds: 0 system turn kept at the head, 1 history, 2 new
    entry = lambda span, kind: F.struct(span.cast("long").alias("span"), F.lit(kind).alias("kind"))
    repeats = F.when(
        ~F.col("leading") & (F.col("end") - F.col("length") >= (step + 1) * F.col("stride") - history) & ((step + 1) * F.col("stride") <= F.col("total")),
        F.array(entry(2 * (step + 1) + 1, 1)),
    ).otherwise(F.array().cast("array<struct<span:bigint,kind:int>>"))
    heads = F.when(
        F.col("leading"),
        F.transform(F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), 2 * F.expr("total div stride") + 1)), lambda s: entry(s, 0)),
    ).otherwise(F.array().cast("array<struct<span:bigint,kind:int>>"))
    placed = turns.select(
        "conv_id", "pos", "role", "text", "tokens", F.explode(F.concat(F.array(entry(own, 2)), repeats, heads)).alias("at")
    ).select("conv_id", "pos", "tokens", "at.span", "at.kind", "role", (F.col("role") == learned_role).alias("learned"), "text")
    piece = F.struct(
        "kind",
        "pos",
        F.concat(F.lit(TURN_START), escape(F.col("role"), ROLE_ESCAPES), F.lit(ROLE_END)).alias("head"),
        escape(F.col("text")).alias("body"),
        "learned",
        "tokens",
    )
    spans = placed.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(piece)).alias("turns"), F.max("kind").alias("newest"))
    spans = spans.filter("newest = 2")
    # offsets: running length of the turns before, one struct per learned new turn
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        before = state["at"] + F.length(turn["head"])
        span = F.struct(before.alias("start"), F.length(turn["body"]).cast("long").alias("length"))
        return F.struct(
            (before + F.length(turn["body"]) + len(TURN_END)).alias("at"),
            F.when((turn["kind"] == 2) & turn["learned"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return spans.select(
        "conv_id",
        (F.row_number().over(Window.partitionBy("conv_id").orderBy("span")) - 1).alias("window"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", start, add, lambda s: s["spans"]).alias("loss_spans"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window, what its text says: conv_id, window, turns (role and text of the new turns), learned (texts
    under the loss mask), formatted_chars. Reads only ``formatted``, ``n_repeated`` and ``loss_spans``."""
    parts = F.split("formatted", TURN_END)
    new = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(parts) - 1 - F.col("n_repeated")))
    role = lambda p: F.substring_index(p, ROLE_END, 1)
    turn = lambda p: F.struct(
        unescape(F.substr(role(p), F.lit(len(TURN_START) + 1)), ROLE_ESCAPES).alias("role"),
        unescape(F.substr(p, F.length(role(p)) + len(ROLE_END) + 1)).alias("text"),
    )
    return formatted.select(
        "conv_id",
        "window",
        F.transform(new, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(back: DataFrame) -> DataFrame:
    """Per conversation: digests of its turns and of its learned texts in order (one value per conversation)."""
    window = F.struct(
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"),
    )
    rows = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(window)).alias("w"), F.sum("formatted_chars").alias("formatted_chars"))
    text = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return rows.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_turns"),
        F.sha2(text("said").cast("binary"), 256).alias("turns_sha256"),
        F.length(text("learned")).cast("long").alias("loss_chars"),
        F.sha2(text("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
