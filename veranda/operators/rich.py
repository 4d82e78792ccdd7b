"""Rich text (tags b, u, sup and sub) as runs of words, lines of a width by the metrics of the two faces of the notes, and the sidebar of notes beside a page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import geometry as G
from ..functions import strings as S
from . import kernels as K

TOKEN = r"</?(?:b|u|sup|sub)>|[^<]+|<"
PARTS = r"[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+"
#: What sets and unsets a flag: raised and lowered exclude each other.
FLAGS = {"b": ("<b>", "</b>"), "sub": ("<sub>", "</sub>", "<sup>"), "sup": ("<sup>", "</sup>", "<sub>"), "u": ("<u>", "</u>")}

#: Advance widths of printable ASCII, in thousandths of the type size, by width; other characters count as OTHER.
OTHER = 556
PLAIN = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyz", 556: "#$0123456789?L_abdeghnopqu",
    584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
BOLD = {
    238: "'", 278: " ,./I\\ijl", 280: "|", 333: "!()-:;[]`ft", 389: "*r{}", 474: '"', 500: "z", 556: "#$0123456789J_aceksvxy", 584: "+<=>^~", 611: "?FLTZbdghnopqu",
    667: "EPSVXY", 722: "&ABCDHKNRU", 778: "GOQw", 833: "M", 889: "%m", 944: "W", 975: "@",
}
SMALL = 0.66
PLAIN_SPACE = next(w for w, cs in PLAIN.items() if " " in cs) / 1000
#: Fixed values of a sidebar, in points at scale 1: its padding, header, space between notes and after a number's dot, leading, and type sizes to start with and to go down to.
PAD, HEADER, GAP, DOT_GAP, LEADING, START, SHRINK, LEAST = 10.0, 26.0, 8.0, 6.0, 1.3, 8.0, 0.9, 3.0


def runs(texts: DataFrame, keys: list[str], rich: str) -> DataFrame:
    """(keys, word, run, text, flags): the words of a rich text, split by white space, as runs of equal flags. A tag may split a word. keys are unique; null texts have no rows."""
    unescape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    tokens = texts.select(*keys, F.posexplode(F.regexp_extract_all(F.col(rich), F.lit(TOKEN), F.lit(0))).alias("k", "tok"))
    so_far = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    state = [F.when(F.last(F.when(F.col("tok").isin(*tags), F.col("tok")), ignorenulls=True).over(so_far) == tags[0], name) for name, tags in FLAGS.items()]
    marked = tokens.withColumn("flags", F.concat_ws(",", *state)).where(~F.regexp_like("tok", F.lit("^</?(?:b|u|sup|sub)>$")))
    parts = marked.select(*keys, "k", "flags", F.posexplode(F.regexp_extract_all(unescape(F.col("tok")), F.lit(PARTS), F.lit(0))).alias("j", "text"))
    order = Window.partitionBy(*keys).orderBy("k", "j")
    blank = F.regexp_like("text", F.lit(r"^[ \t\n\x0B\f\r]+$"))
    placed = parts.withColumn("blank", blank).withColumn("gap", F.sum(F.col("blank").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    word = F.dense_rank().over(Window.partitionBy(*keys).orderBy("gap")) - 1
    return placed.select(*keys, word.alias("word"), (F.row_number().over(Window.partitionBy(*keys, "gap").orderBy("k", "j")) - 1).alias("run"), "text", "flags")


def width(text: Column | str, bold: Column | bool = False) -> Column:
    """The width of a text at type size 1."""
    def table(face: dict[int, str]) -> Column:
        of = {c: w for w, cs in face.items() for c in cs}
        return F.array(*[F.lit(of.get(chr(i), OTHER)) for i in range(32, 127)])

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = lambda face: F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.when(F.ascii(c).between(32, 126), F.get(table(face), F.ascii(c) - 32)), F.lit(OTHER)))
    bold = F.lit(bold) if isinstance(bold, bool) else bold
    return F.when(bold, total(BOLD)).otherwise(total(PLAIN)) / 1000


def lines_of(widths: np.ndarray, space: float, most: float) -> np.ndarray:
    """The line of each word: as many words to a line as fit in most, one at least."""
    ends = np.cumsum(widths + space)
    out, first, line = np.zeros(len(widths), np.int32), 0, 0
    while first < len(widths):
        before = ends[first - 1] if first else 0.0
        last = max(first + 1, int(np.searchsorted(ends, before + most + space + 1e-9, "right")))
        out[first:last] = line
        first, line = last, line + 1
    return out


def line_numbers(widths: Column | str, space: float, most: float) -> Column:
    @F.pandas_udf(ArrayType(IntegerType()))
    def numbers(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: lines_of(np.asarray(w, float), space, most) if w is not None else None)

    return numbers(widths)


def wrap(texts: DataFrame, keys: list[str], text: str, size: float, most: float) -> DataFrame:
    """(keys, line, text): a plain text's lines of words in a width of most, in points."""
    words = texts.select(*keys, S.split_words(text).alias("ws")).where(F.size("ws") > 0)
    rows = words.withColumn("ns", line_numbers(F.transform("ws", lambda w: width(w) * size), PLAIN_SPACE * size, most))
    each = rows.select(*keys, F.posexplode(F.arrays_zip("ws", "ns")).alias("pos", "x"))
    return each.groupBy(*keys, F.col("x.ns").alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x.ws"))), lambda v: v["ws"]), " ").alias("text"))


def sized_runs(texts: DataFrame, keys: list[str], rich: str) -> DataFrame:
    """runs() with their widths at type size 1."""
    has = lambda f: F.array_contains(F.split("flags", ","), f)
    return runs(texts, keys, rich).withColumn("width", width(F.col("text"), has("b")) * F.when(has("sup") | has("sub"), SMALL).otherwise(1.0))


def word_widths(each: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ws): the widths of the words of runs, in order."""
    words = each.groupBy(*keys, "word").agg(F.sum("width").alias("w"))
    return words.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "w"))), lambda x: x["w"]).alias("ws"))


def wrap_rich(texts: DataFrame, keys: list[str], rich: str, size: float, most: float) -> DataFrame:
    """(keys, line, word, run, text, flags, width): a rich text's runs with the line of each word and each run's width; raised and lowered runs are smaller."""
    each = sized_runs(texts, keys, rich).withColumn("width", F.col("width") * size)
    arrays = word_widths(each, keys)
    lines = arrays.select(*keys, F.posexplode(line_numbers("ws", PLAIN_SPACE * size, most)).alias("word", "line"))
    return each.join(lines, [*keys, "word"]).select(*keys, "line", "word", "run", "text", "flags", "width")


def sidebar(notes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_num, index, size, x, y, height, n_lines): the notes (page_num, index, number, y, text, rich) beside pages(page_num, width, height), by number, near the height y of what
    they are about. All notes of a page have the largest size, from START down, at which they fit; the rich text counts where there is one."""
    keys = ["page_num", "index"]
    noted = notes.where("coalesce(rich, '') <> ''")
    styled = word_widths(sized_runs(noted, keys, "rich"), keys).withColumnRenamed("ws", "__rich")
    plain = F.transform(S.split_words("text"), lambda w: width(w))
    rows = notes.join(styled, keys, "left").withColumn("ws", F.when(F.coalesce("rich", F.lit("")) == "", plain).otherwise(F.coalesce("__rich", F.array().cast("array<double>"))))
    rows = rows.select(*keys, "number", F.col("y").alias("about"), "ws").join(sizes.select("page_num", "width", "height"), "page_num")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["number", "index"])
        page, tall = g["width"].iloc[0], g["height"].iloc[0]
        scale = max(1.0, page / 900)
        dot, top, pad = G.DOT_RADIUS * scale, (HEADER + PAD) * scale, PAD * scale
        left = pad + 2 * dot + DOT_GAP * scale
        words, size = [np.asarray(w, float) for w in g["ws"]], START * scale
        while True:
            n = [int(lines_of(w * size, PLAIN_SPACE * size, G.SIDEBAR * scale - left - pad)[-1]) + 1 if len(w) else 0 for w in words]
            heights = [max(2 * dot, k * size * LEADING) for k in n]
            if size <= LEAST or top + sum(heights) + len(n) * GAP * scale <= tall - pad:
                break
            size *= SHRINK
        ys = K.spread((g["about"] - dot).tolist(), heights, GAP * scale, top, tall - pad)
        return pd.DataFrame({"page_num": g["page_num"], "index": g["index"], "size": size, "x": page + left, "y": ys, "height": heights, "n_lines": n})

    return rows.groupBy("page_num").applyInPandas(run, "page_num long, index long, size double, x double, y double, height double, n_lines int")
