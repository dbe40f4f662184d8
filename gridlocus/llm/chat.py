"""Chat formatting in windows of a token budget.

A turn becomes ``### role: text</turn>`` and a line end.  Inside roles and texts the control strings are escaped with a
backslash (``\\`` itself is doubled), so that a formatted window can be cut into turns and turned back exactly.

Windows.  The prefix sum of turn tokens puts every turn into the cell of ``stride`` tokens in which it begins, where stride is
half of what the budget leaves after the system turn and the history.  The turns of a cell are a window; a turn longer than a
stride is one alone.  So a window keeps to the budget unless a single turn does not fit (``over_budget``).  Each
window starts with the conversation's leading system turn and with the last turns before it that fit into
``history`` tokens.  Only a window's own assistant turns carry loss: repeated turns are masked.

Prefix sums are taken within ranges of turn numbers and then over the sums of the ranges, so a conversation with
very many turns is not one task's work.  Everything is a DataFrame expression.

Cases: a null text or role is empty; a null conversation id is one conversation, a null turn number sorts first; equal turn
numbers are ordered by role, then text; a conversation of a system turn alone is one window; an empty table gives an empty table;
other columns are ignored; roles and texts may have any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlocus.llm.store import stored

BUDGET = 1024
HISTORY = 192
#: Tokens of a turn's marks; also keeps every turn above zero tokens.
MARKS = 4
RANGE = 256
#: Fixed format: what begins and ends a turn.
BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"


def escape(c: Column) -> Column:
    """Control strings cannot be read in the result: ###, </turn> and the colon are broken up by backslashes."""
    doubled = F.regexp_replace(c, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(doubled, "#", r"\\#"), "</", r"<\\/")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(escape(c), ":", r"\\:")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def count_tokens(c: Column) -> Column:
    """Words and marks; a cheap stand-in for a tokenizer that grows with the text."""
    return F.regexp_count(c, F.lit(r"[^\s]{1,8}")) + MARKS


def format_windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(key, cell, part, text, loss: [(start, stop)], n_repeated, n_tokens, over_budget), one row per window;
    (cell, part) orders the windows of a conversation, loss counts code points."""
    turns = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("c"), F.col(key).alias("id"), F.col(turn).cast("long").alias("t"),
                      F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", count_tokens(F.col("text")).cast("long")).withColumn("range", F.coalesce(F.floor(F.col("t") / RANGE), F.lit(-(1 << 60))))
    in_range = Window.partitionBy("c", "range").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    inside = turns.withColumn("nth", F.row_number().over(in_range))
    ranges = turns.groupBy("c", "range").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("t", F.lit(-(1 << 62))).alias("t"), "role", "text", "tokens")).alias("first"))
    before = Window.partitionBy("c").orderBy("range")
    lead = ranges.withColumn("at", F.row_number().over(before)).where("at = 1").select("c", F.when(F.col("first.role") == "system", F.col("first")).alias("lead"))
    led = inside.join(ranges.withColumn("at", F.row_number().over(before)).select("c", "range", "at"), ["c", "range"]).join(lead, "c")
    led = led.withColumn("is_lead", F.col("lead").isNotNull() & (F.col("at") == 1) & (F.col("nth") == 1)).withColumn("spent", F.when(F.col("is_lead"), 0).otherwise(F.col("tokens")))
    sums = led.groupBy("c", "range").agg(F.sum("spent").alias("sum"))
    offsets = sums.select("c", "range", (F.coalesce(F.sum("sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
    stride = F.greatest(F.lit(1), F.floor((budget - history - F.coalesce("lead.tokens", F.lit(0))) / 2))
    placed = led.join(offsets, ["c", "range"]).withColumn("end", F.col("offset") + F.sum("spent").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.withColumn("begin", F.col("end") - F.col("spent")).withColumn("stride", stride)
    placed = placed.withColumn("cell", F.when(F.col("is_lead"), 0).otherwise(F.floor(F.col("begin") / F.col("stride")))).withColumn("part", F.when(~F.col("is_lead") & (F.col("tokens") > F.col("stride")), 1).otherwise(0))
    own = stored(placed.select("c", "id", "cell", "part", "begin", "end", "is_lead", "role", "text", "tokens", "stride", "lead"), "turns")

    windows = stored(own.groupBy("c", "cell", "part").agg(F.min(F.when(~F.col("is_lead"), F.col("begin"))).alias("start"), F.first("lead").alias("lead"), F.first("id").alias("id"), F.max("is_lead").alias("has_lead")), "windows")
    row = lambda order, role, text, tokens, repeated: F.struct(order.alias("at"), role.alias("role"), text.alias("text"), tokens.alias("tokens"), repeated.alias("repeated"))
    mine = own.select("c", "cell", "part", row(F.when(F.col("is_lead"), F.lit(-1)).otherwise(F.col("begin")), F.col("role"), F.col("text"), F.col("tokens"), F.lit(False)).alias("s"))
    again = windows.where("lead is not null and not has_lead").select("c", "cell", "part", row(F.lit(-1).cast("long"), F.col("lead.role"), F.col("lead.text"), F.col("lead.tokens"), F.lit(True)).alias("s"))
    later = F.array(F.struct(F.col("cell").alias("cell"), F.lit(1).alias("part")), F.struct((F.col("cell") + 1).alias("cell"), F.lit(0).alias("part")), F.struct((F.col("cell") + 1).alias("cell"), F.lit(1).alias("part")))
    past = own.where("not is_lead").select("c", "begin", "end", "role", "text", "tokens", "stride", F.explode(later).alias("to")).where(F.col("tokens") <= history)
    past = past.select("*", F.col("to.cell").alias("cell"), F.col("to.part").alias("part")).drop("to").join(windows.select("c", "cell", "part", "start"), ["c", "cell", "part"])
    past = past.where((F.col("end") <= F.col("start")) & (F.col("start") - F.col("begin") <= F.least(F.lit(history), F.col("stride"))))
    past = past.select("c", "cell", "part", row(F.col("begin"), F.col("role"), F.col("text"), F.col("tokens"), F.lit(True)).alias("s"))

    grouped = mine.unionByName(again).unionByName(past).groupBy("c", "cell", "part").agg(F.sort_array(F.collect_list("s")).alias("turns"))
    shaped = grouped.withColumn("segments", F.transform("turns", lambda s: F.struct(
        F.concat(F.lit(BEGIN), escape_role(s["role"]), F.lit(MIDDLE)).alias("head"), escape(s["text"]).alias("body"), ((s["role"] == loss_role) & ~s["repeated"]).alias("loss"))))
    spans = f"""aggregate(segments, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,stop:int>>)),
        (a, s) -> named_struct('at', a.at + length(s.head) + length(s.body) + {len(END)}, 'spans', if(s.loss,
            concat(a.spans, array(named_struct('start', a.at + length(s.head), 'stop', a.at + length(s.head) + length(s.body)))), a.spans)), a -> a.spans)"""
    text_of = F.concat_ws("", F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit(END))))
    sized = shaped.select("c", "cell", "part", text_of.alias("text"), F.expr(spans).alias("loss"), F.size(F.filter("turns", lambda s: s["repeated"])).alias("n_repeated"),
                          F.aggregate("turns", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]).alias("n_tokens"))
    out = sized.join(windows.select("c", "cell", "part", "id"), ["c", "cell", "part"])
    return out.select(F.col("id").alias(key), F.col("cell").alias("cell"), "part", "text", "loss", "n_repeated", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def parse_windows(windows: DataFrame) -> DataFrame:
    """The windows with their own turns [(role, text)] and the texts under their loss mask, read from text, loss and n_repeated."""
    cut = F.filter(F.split("text", END), lambda s: s != "")
    role = lambda s: F.regexp_replace(s, r"(?s)^### ((?:[^:\\]++|\\.)*+): .*$", "$1")
    text = lambda s: F.regexp_replace(s, r"(?s)^### (?:[^:\\]++|\\.)*+: ", "")
    turns = F.transform("_cut", lambda s: F.struct(unescape(role(s)).alias("role"), unescape(text(s)).alias("text")))
    parsed = windows.withColumn("_cut", cut).withColumn("turns", turns).drop("_cut")
    own = F.filter("turns", lambda s, i: (i >= F.col("n_repeated")))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"])))
    return parsed.withColumn("turns", own).withColumn("loss_texts", masked)
