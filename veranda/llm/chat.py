r"""Chat formatting in budgeted windows, by DataFrame functions only.

A turn is written `<|im_start|>role LF text<|im_end|> LF`. Control strings of this template and of other common ones are escaped inside
texts: a backslash is put after the first character, one more if there are some already, so unescaping takes one away and every
text comes back. In a role a backslash and a line feed are written `\\` and `\n`.

A conversation is cut into windows of at most `budget` tokens. `tokens` counts a written turn's tokens; unless another count is given it is the
turn's UTF-8 bytes, an upper bound for every byte-level vocabulary, as a token has one byte at least. Prefix sums of the turns' tokens lay
each conversation out on a line; its turns are dealt into cells of CELL budgets by where they begin, and in a cell each window is the longest run of whole turns
that fits beside the system turn, which every window repeats, and beside up to `history` tokens of the turns just before, repeated
too, over the bounds of cells as well. Loss falls on the texts of assistant turns, only where they are not repeated. A turn that is longer
than a window has one of its own.

One exchange by conversation carries the texts; prefix sums, cells and windows are made in it. A conversation of more than `stretch` turns
is cut by rank (a range partitioning of its turns) into parts that are dealt out apart; the system turn and the history go
over those cuts by joins with a row for each.

Odd rows: null text and role count as empty; rows of a null conv_id are one conversation; turns with equal numbers are ordered by a hash of
role and text; null turn numbers come first; other columns are passed over; any turn numbers will do, as only their order counts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUDGET, HISTORY, CELL, STRETCH = 2048, 256, 16, 1 << 16
START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character ("<" or "[") in control strings of common templates.
CONTROL = (r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"\|system\|>", r"\|user\|>", r"\|assistant\|>", r"s>", r"/s>", r"SYS>>", r"/SYS>>", r"INST\]", r"/INST\]")
_REST = "(" + "|".join(CONTROL) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a doubled backslash is set aside as a line feed, which a written role never holds
    whole = F.replace(F.replace(role, F.lit("\\\\"), F.lit("\n")), F.lit("\\n"), F.lit("\r\n"))
    return unescape(F.regexp_replace(F.regexp_replace(whole, r"(?<!\r)\n", r"\\"), "\r\n", "\n"))


TURN = "struct<pos: int, start: long, head: string, body: string, target: boolean, n: long, own: boolean>"


def _written(turns: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """turns(conv_id, ..., role, text) with what is written of each, and its tokens."""
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    rows = turns.withColumns({"head": head, "body": body, "target": F.col("role") == "assistant"})
    return rows.withColumn("n", tokens(F.concat("head", "body", F.lit(f"{END}\n"))).cast("long"))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their number (pos) and the tokens before them (start) among the rows of equal keys, and the body of the first of these if it is a system turn."""
    order = Window.partitionBy(*keys).orderBy("turn", "tie", "role", "text")
    return rows.select(
        "*", F.row_number().over(order).alias("pos"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.first(F.when(F.col("role") == "system", F.struct("body", "n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("system")).drop("turn", "tie", "role", "text")


def _cells(placed: DataFrame, keys: list[str], budget: int, history: int) -> DataFrame:
    """(*keys, cell, system, turns) of each cell: the turns that begin in it, and before them those of the cell before that may be its history (not own)."""
    width = CELL * budget
    rows = placed.withColumn("cell", F.floor(F.col("start") / width))
    lent = ((F.col("cell") + 1) * width - F.col("start") <= history) & ~((F.col("pos") == 1) & F.col("system").isNotNull())
    here, there = F.struct(F.col("cell"), F.lit(True).alias("own")), F.struct((F.col("cell") + 1).alias("cell"), F.lit(False).alias("own"))
    rows = rows.withColumn("x", F.explode(F.when(lent, F.array(here, there)).otherwise(F.array(here)))).withColumn("cell", F.col("x.cell"))
    turn = F.struct("pos", "start", "head", "body", "target", "n", F.col("x.own").alias("own"))
    cells = rows.groupBy(*keys, "cell").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.first("system").alias("system"))
    return cells.where(F.exists("turns", lambda t: t["own"]))


def _windows(cells: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, part, cell, window, formatted, loss, repeated, n_tokens) of cells(conv_id, part, cell, system, turns, first): first is set where
    turn 1 is the conversation's first one."""
    system_n = F.coalesce(F.col("system.n"), F.lit(0))
    lone = lambda t: F.col("first") & (t["pos"] == 1)  # noqa: E731  nothing comes before it
    at = lambda i: F.get("turns", i)
    room = lambda t: F.lit(budget) - F.when(lone(t), 0).otherwise(system_n + history)
    own = F.size(F.filter("turns", lambda t: ~t["own"]))  # the first own turn's index
    begins = F.aggregate(F.sequence(own, F.size("turns") - 1), F.array(own), lambda a, i: F.when(
        (i > F.element_at(a, -1)) & (at(i)["start"] + at(i)["n"] - at(F.element_at(a, -1))["start"] > room(at(F.element_at(a, -1)))), F.concat(a, F.array(i))).otherwise(a))
    rows = cells.withColumn("begins", begins)
    # the system turn is repeated by itself, not as history
    back = lambda lo: lo - F.size(F.filter(F.slice("turns", 1, lo), lambda t: (at(lo)["start"] - t["start"] <= history) & ~(lone(t) & F.col("system").isNotNull())))
    window = lambda lo, j: F.struct(
        j.alias("window"), (lo - back(lo)).alias("history"), (F.col("system").isNotNull() & ~lone(at(lo))).alias("has"),
        F.slice("turns", back(lo) + 1, F.coalesce(F.get("begins", j + 1), F.size("turns")) - back(lo)).alias("turns"))
    rows = rows.select("conv_id", "part", "cell", "system", F.explode(F.transform("begins", window)).alias("w"))
    turns = F.transform("w.turns", lambda t, i: F.struct(t["head"].alias("head"), t["body"].alias("body"), (t["target"] & (i >= F.col("w.history"))).alias("target"), t["n"].alias("n")))
    kind = "array<struct<head: string, body: string, target: boolean, n: long>>"
    first = F.when(F.col("w.has"), F.array(F.struct(F.lit(f"{START}system\n").alias("head"), F.col("system.body").alias("body"), F.lit(False).alias("target"), F.col("system.n").alias("n")))).otherwise(F.array().cast(kind))
    rows = rows.select("conv_id", "part", "cell", "w.window", (F.col("w.has").cast("int") + F.col("w.history")).alias("repeated"), F.concat(first.cast(kind), turns.cast(kind)).alias("parts"))
    tail = len(END) + 1
    spans = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from: int, to: int>>").alias("loss")), lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["body"]) + tail).alias("at"),
        F.when(p["target"], F.concat(a["loss"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("from"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("to"))))).otherwise(a["loss"]).alias("loss")))
    return rows.select("conv_id", "part", "cell", "window", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "").alias("formatted"), spans["loss"].alias("loss"), "repeated", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_tokens"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH, tokens: Callable[[Column], Column] = F.octet_length) -> DataFrame:
    """(conv_id, part, cell, window, formatted, loss, repeated, n_tokens) of each window of turns(conv_id, turn, role, text, ...), in order by part, cell
    and window: loss lists [from, to) character ranges of formatted, repeated is the number of leading turns that earlier windows have."""
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clean = clean.withColumn("tie", F.xxhash64("role", "text"))
    many = cut(clean.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > stretch).select(F.col("conv_id").alias("c"), "n"))
    total = many.agg(F.sum("n")).first()[0]
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    calm = clean.join(many, same, "left_anti") if total else clean
    cells = _cells(_placed(_written(calm, tokens), ["conv_id"]), ["conv_id"], budget, history)
    out = _windows(cells.select("*", F.lit(0).alias("part"), F.lit(True).alias("first")), budget, history)
    if not total:
        return out
    ranked = clean.join(many, same, "left_semi").withColumn("row", F.monotonically_increasing_id())  # tells equal turns apart
    parts = cut(ranked.repartitionByRange(math.ceil(total / stretch), "conv_id", "turn", "tie", "row").withColumn("part", F.spark_partition_id()).drop("row"))
    keys = ["conv_id", "part"]
    placed = _placed(_written(parts, tokens), keys)
    # a row for each part: what it has in all, its last turns, and which part follows; a row for each conversation: its first turn
    ends = placed.groupBy(*keys).agg(F.sum("n").alias("sum"), F.max("pos").alias("last"))
    known = ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "sum", "last")
    nearest = placed.join(known, same & (F.col("part") == F.col("p"))).where(F.col("sum") - F.col("start") <= history).select(
        "conv_id", "part", F.struct((F.col("pos") - F.col("last")).cast("int").alias("pos"), (F.col("start") - F.col("sum")).alias("start"), "head", "body", "target", "n", F.lit(False).alias("own")).cast(TURN).alias("turn"), ((F.col("pos") == 1) & F.col("system").isNotNull()).alias("system"))
    lists = nearest.where("not system").groupBy(*keys).agg(F.sort_array(F.collect_list("turn")).alias("before"))
    following = cut(ends.select("*", F.lead("part").over(Window.partitionBy("conv_id").orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy("conv_id")).alias("home")))
    lent = lists.join(following.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "next"), same & (F.col("part") == F.col("p"))).where("next is not null").select(F.col("conv_id").alias("lent_id"), F.col("next").alias("lent_part"), "before")
    heads = placed.where("pos = 1").join(following.select(F.col("conv_id").alias("c"), "home").distinct(), same).where("part = home").select(F.col("conv_id").alias("head_id"), "home", F.col("system").alias("head_system"))
    cells = _cells(placed, keys, budget, history).drop("system")
    cells = cells.join(lent, F.col("conv_id").eqNullSafe(F.col("lent_id")) & (F.col("part") == F.col("lent_part")) & (F.col("cell") == 0), "left")
    cells = cells.join(heads, F.col("conv_id").eqNullSafe(F.col("head_id")), "left")
    turns_ = F.concat(F.coalesce("before", F.array().cast(f"array<{TURN}>")), F.col("turns").cast(f"array<{TURN}>"))
    hot = _windows(cells.select("conv_id", "part", "cell", turns_.alias("turns"), F.col("head_system").alias("system"), (F.col("part") == F.col("home")).alias("first")), budget, history)
    return out.unionByName(hot)


def _pieces() -> Column:
    """Of a window's row the turns that no earlier one has, as they are written."""
    return F.filter(F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("repeated") + 1, 1 << 30), lambda p: p != "")


def _role(p: Column) -> Column:
    return unescape_role(F.regexp_extract(p, r"(?s)^<\|im_start\|>([^\n]*)\n", 1))


def _text(p: Column) -> Column:
    return unescape(F.regexp_extract(p, r"(?s)^<\|im_start\|>[^\n]*\n(.*)$", 1))


def read_turns(windows: DataFrame) -> DataFrame:
    """(conv_id, part, cell, window, k, role, text) of each turn, read back from the windows: a row for each, in order by these columns."""
    rows = windows.select("conv_id", "part", "cell", "window", F.posexplode(_pieces()).alias("k", "p"))
    return rows.select("conv_id", "part", "cell", "window", "k", _role(F.col("p")).alias("role"), _text(F.col("p")).alias("text"))


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_text, loss_text, formatted_chars) of each conversation, read back from its windows alone. A whole conversation
    becomes one value here, for a digest; read_turns() has no such bound."""
    turns = F.transform(_pieces(), lambda p: F.concat(_role(p), F.lit("\n"), _text(p), F.lit("\n")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["from"] + 1, s["to"] - s["from"]))), "")
    rows = windows.select("conv_id", F.struct("part", "cell", "window", F.array_join(turns, "").alias("turns"), loss.alias("loss")).alias("w"), F.size(turns).alias("n"), F.length("formatted").cast("long").alias("chars"))
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("w"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("w", lambda w: w["turns"]), "").alias("turns_text"), F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss_text"), "formatted_chars")
