"""Chat formatting into budgeted windows, by prefix sums of turn tokens.

A conversation's turns, in order, have a running sum of tokens. The sum divided by half a window's room gives each turn
its window, so windows need no pass from turn to turn: a turn belongs to the window in whose span it ends, and one larger
than half the room stands alone. A window repeats the system turn and a limited stretch of turns before it; what is
repeated is not in the loss mask again. Positions come from counts and sums by block of turn numbers, so one very long
conversation is spread over many tasks.

Template: each turn is `<s>[INST] role [/INST]text</s>`. A control string inside a role or text gets a backslash after its
first character, and one more if it has some there already; unescape() takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, materialise, words_of

OPEN, HEAD, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = r"(/?s>|/?INST\])"
BLOCK_BITS = 8
#: Tokens that a turn's marks cost; with it no turn is free.
TURN_OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def keyed(conversations: DataFrame) -> DataFrame:
    """Rows with a key that is never null, so that rows without a conversation id form a conversation too."""
    x = columns_like(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    x = x.select(key.alias("key"), "conv_id", F.coalesce("turn", F.lit(-(1 << 62)).cast("long")).alias("turn"), role.alias("role"), text.alias("text"))
    return x.withColumn("tokens", (F.size(words_of(F.col("text"))) + TURN_OVERHEAD).cast("long")).withColumn("block", F.shiftright("turn", BLOCK_BITS))


def placed(conversations: DataFrame) -> DataFrame:
    """Adds pos (from 0), start and end: the running sum of tokens before and with the turn, is_sys: whether it is the first
    turn with the role system, and sys_tokens, that turn's.

    What holds of a whole conversation reaches its turns through its blocks, of which a conversation has one for 256 turn
    numbers: no join deals all turns of a conversation to one task.
    """
    x = keyed(conversations)
    blocks = x.groupBy("key", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    first = x.filter(F.col("role") == "system").groupBy("key").agg(F.min(F.struct("turn", "text", "tokens")).alias("sys"))
    first = first.select("key", F.col("sys.turn").alias("sys_turn"), F.xxhash64("sys.text").alias("sys_hash"), F.col("sys.tokens").alias("sys_tokens"))
    blocks = blocks.join(first, "key", "left")
    inside = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.struct("turn", "role", F.xxhash64("text"))
    x = x.withColumn("i", F.row_number().over(inside) - 1).withColumn("s", F.sum("tokens").over(upto)).withColumn("again", F.coalesce(F.lag(same).over(inside) == same, F.lit(False)))
    x = x.join(blocks, ["key", "block"])
    is_sys = (F.col("role") == "system") & ~F.col("again") & F.coalesce((F.col("turn") == F.col("sys_turn")) & (F.xxhash64("text") == F.col("sys_hash")), F.lit(False))
    return x.select(
        "key", "conv_id", "role", "text", "tokens", (F.col("n0") + F.col("i")).cast("long").alias("pos"), (F.col("t0") + F.col("s") - F.col("tokens")).alias("start"), (F.col("t0") + F.col("s")).alias("end"),
        is_sys.alias("is_sys"), "sys_tokens",
    )


def format_windows(conversations: DataFrame, budget: int = 1024, history_tokens: int = 192, history_turns: int = 4) -> DataFrame:
    """conversations -> one row per window: conv_id, window, formatted, turns, n_tokens.

    turns: array of struct(pos, role, repeated, start, stop, target): where a turn's text lies in formatted (code points,
    from 0, stop exclusive) and whether it is a target of the loss. Targets are the assistant turns that are not repeated.
    A window holds at most budget tokens (words, and TURN_OVERHEAD a turn), unless one turn, or the system turn, is larger
    than its room; nothing is cut. Turns are ordered by turn number (null first), role and text; equal rows all stay.
    The retained system turn is the conversation's first row with that role. Null roles and texts count as empty. Rows
    without a conversation id form one conversation. An empty table gives an empty result; other columns are ignored.
    """
    turns = placed(conversations)
    room = F.greatest(F.lit(budget) - history_tokens - F.coalesce(F.col("sys_tokens"), F.lit(0)), F.lit(max(2, budget // 4)))
    turns = turns.withColumn("room", room.cast("long")).withColumn("half", F.expr("room div 2"))
    last = F.expr("(`end` - 1) div half")
    turns = turns.withColumn("window", (2 * last + F.when(F.col("tokens") > F.col("half"), 0).otherwise(1)).cast("long"))
    turns = materialise(turns.select("key", "conv_id", "role", "text", "tokens", "pos", "start", "window", "is_sys"), "chat-turns")
    heads = turns.groupBy("key", "window").agg(F.min("pos").alias("head"), F.min("start").alias("from"), F.max("is_sys").alias("has_sys"))
    # Each window asks for the few turns before its first; a place is one row, so a long conversation is no hot key here.
    back = heads.select("key", F.col("window").alias("to"), "from", F.explode(F.sequence(F.col("head") - history_turns, F.col("head") - 1)).alias("pos")).filter("pos >= 0")
    near = turns.join(back, ["key", "pos"]).filter((F.col("start") >= F.col("from") - history_tokens) & ~F.col("is_sys"))
    # The system turn goes to stretches of windows first, one row each, and from there to their windows.
    without = heads.filter(~F.col("has_sys")).select("key", F.col("window").alias("to"), F.shiftright("window", BLOCK_BITS + 1).alias("stretch"))
    spread = without.select("key", "stretch").distinct().join(turns.filter("is_sys"), "key")
    lead = without.join(spread, ["key", "stretch"])
    shape = lambda df, window, repeated: df.select("key", "conv_id", F.col(window).alias("window"), "pos", "role", "text", "tokens", F.lit(repeated).alias("repeated"))
    rows = shape(turns, "window", False).unionByName(shape(near, "to", True)).unionByName(shape(lead, "to", True))
    made = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD), escape(F.col("text")), F.lit(CLOSE))
    off = F.length(F.lit(OPEN)) + F.length(escape(F.col("role"))) + F.length(F.lit(HEAD))
    rows = rows.select("key", "conv_id", "window", F.struct("pos", "role", "repeated", "tokens", made.alias("made"), off.alias("off"), F.length(escape(F.col("text"))).alias("len")).alias("t"))
    # A window is bounded by its budget, so its turns fit one row.
    windows = rows.groupBy("key", "window").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("t")).alias("ts"))
    lengths = F.transform("ts", lambda t: F.length(t["made"]).cast("long"))
    windows = windows.withColumn("formatted", F.array_join(F.transform("ts", lambda t: t["made"]), "")).withColumn("lengths", lengths)
    # Starts by a running sum in chunks of the array: each turn adds the lengths before it.
    starts = F.aggregate("lengths", F.struct(F.array().cast("array<bigint>").alias("a"), F.lit(0).cast("long").alias("s")), lambda a, n: F.struct(F.array_append(a["a"], a["s"]).alias("a"), (a["s"] + n).alias("s")), lambda a: a["a"])
    windows = windows.withColumn("starts", starts)

    def turn(t: Column, s: Column) -> Column:
        begin = s + t["off"]
        target = (t["role"] == "assistant") & ~t["repeated"]
        return F.struct(t["pos"].alias("pos"), t["role"].alias("role"), t["repeated"].alias("repeated"), begin.alias("start"), (begin + t["len"]).alias("stop"), target.alias("target"))

    return windows.select(
        "conv_id", F.col("key").alias("conversation"), "window", "formatted", F.zip_with("ts", "starts", turn).alias("turns"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted strings say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are found by the template's marks, repeated ones are skipped, and texts are unescaped. A conversation's digest
    is of one string of all its turns, so its size is bounded by the longest string that one row may hold.
    """
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    x = windows.select("conv_id", "conversation", "window", F.length("formatted").cast("long").alias("chars"), "turns", "formatted", parts.alias("parts"))
    own = F.filter(F.zip_with("parts", "turns", lambda p, t: F.struct(p.alias("p"), t["repeated"].alias("repeated"))), lambda q: ~q["repeated"])

    def said(q: Column) -> Column:
        body = F.substring(q["p"], len(OPEN) + 1, 2**31 - 1)
        at = F.instr(body, HEAD)
        return F.concat(unescape(F.substring(body, F.lit(1), at - 1)), F.lit("\n"), unescape(F.substring(body, at + len(HEAD), F.length(body))), F.lit("\n"))

    loss = F.transform(F.filter("turns", lambda t: t["target"]), lambda t: unescape(F.substring(F.col("formatted"), (t["start"] + 1).cast("int"), (t["stop"] - t["start"]).cast("int"))))
    x = x.select("conv_id", "conversation", "window", "chars", F.size(own).cast("long").alias("n"), F.array_join(F.transform(own, said), "").alias("said"), F.array_join(loss, "").alias("loss"))
    x = x.groupBy("conversation").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("loss").cast("long")).alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
    )
    digest = lambda field: F.sha2(F.array_join(F.transform("w", lambda w: w[field]), "").cast("binary"), 256)
    return x.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), "loss_chars", digest("loss").alias("loss_sha256"), "formatted_chars")
