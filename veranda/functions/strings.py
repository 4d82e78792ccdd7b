"""Text normalisation as Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for fingerprints, and those for claims.
KEY_STOP = "the and for are was with this that from have has been not but also more".split()
CLAIM_STOP = "the and for are was with this that from have has been not but also more were all any can may use its per".split()
#: Header names that mean a reference number, and parts of names of the other columns.
NUMBER_HEADERS = ["#", "no", "no.", "ref", "ref #", "ref no", "number", "superscript", "sup"]
CLAIM_HEADERS, REF_HEADERS, PAGE_HEADERS = ["claim", "layout", "copy", "anchor", "text on page", "statement"], ["reference", "source", "location", "citation"], ["page", "pg"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def split_words(x: Column | str) -> Column:
    """Words between white space; none for blank or null text."""
    return F.filter(F.split(squeeze(F.coalesce(_c(x), F.lit(""))), " "), lambda w: w != "")


def clean_fingerprint(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"\s+", " "), r"[^\p{L}\p{N}_\s%(),.-]", ""))


def key_words(x: Column | str, least: int = 4) -> Column:
    return F.filter(F.split(squeeze(clean_fingerprint(x)), " "), lambda w: (F.length(w) >= least) & ~w.isin(KEY_STOP))


def claim_token(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9%+.\-]", ""), r"^[.\-]+|[.\-]+$", "")


def claim_tokens(words: Column | str) -> Column:
    return F.filter(F.transform(_c(words), claim_token), lambda w: (F.length(w) >= 3) & ~w.isin(CLAIM_STOP))


def alnum(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9 ]", "")


def clean_cell(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(_c(x), F.lit("")), " ", " "), r"[ \t]+", " "))


def clean_lines(x: Column | str) -> Column:
    lines = F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[\r\n]+"), squeeze)
    return F.array_join(F.filter(lines, lambda v: v != ""), "\n")


def first_number(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"\d+", 0), F.lit("")).try_cast("int")


def expand_numbers(x: Column | str) -> Column:
    """'1,3-5' -> [1, 3, 4, 5]; ranges of 2 to 13 numbers only, other parts only if they are digits."""
    parts = F.filter(F.split(F.trim(_c(x)), r"[,\s]+"), lambda p: p != "")

    def expand(p: Column) -> Column:
        a = F.nullif(F.regexp_extract(p, r"^(\d+)[-–—](\d+)$", 1), F.lit("")).try_cast("int")
        b = F.nullif(F.regexp_extract(p, r"^(\d+)[-–—](\d+)$", 2), F.lit("")).try_cast("int")
        return F.when((b - a > 0) & (b - a <= 12), F.sequence(a, F.when((b - a > 0) & (b - a <= 12), b).otherwise(a))).when(F.regexp_like(p, F.lit(r"^\d+$")), F.array(p.try_cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, expand))


def is_superscript(x: Column | str) -> Column:
    return F.regexp_like(_c(x), F.lit(r"^[\d,\s\-–—]+$")) & F.regexp_like(_c(x), F.lit(r"\d"))


def trailing_mark(x: Column | str) -> Column:
    """struct(pre, digits) of a word with digits glued to its end; null if there are none."""
    pattern = r"^(.*?[A-Za-z).,;:])(\d{1,2}(?:[,\-–]\d{1,2})*)[.,;]?$"
    pre = F.regexp_extract(_c(x), pattern, 1)
    return F.when(F.length(pre) >= 3, F.struct(pre.alias("pre"), F.regexp_extract(_c(x), pattern, 2).alias("digits")))


def claim_key(x: Column | str) -> Column:
    t = F.translate(F.coalesce(_c(x), F.lit("")), " ", " ")
    ref = F.nullif(F.regexp_extract(t, r"REF-(\d+)", 1), F.lit(""))
    url = F.nullif(F.regexp_extract(t, r"(https?://\S+|www\.\S+)", 1), F.lit(""))
    alt = F.regexp_extract(t, r"(?i)<alt tag:\s*([^>]*)", 1)
    return F.when(ref.isNotNull(), F.concat(F.lit("ref"), ref)).when(url.isNotNull(), F.concat(F.lit("url:"), F.lower(F.regexp_replace(url, "/+$", "")))).when(F.regexp_like(t, F.lit("(?i)<alt tag:")), F.concat(F.lit("alt:"), F.substring(F.lower(squeeze(alt)), 1, 40)))


def plain_of(x: Column | str) -> Column:
    """Rich text without its tags, entities read in the order lt, gt, amp."""
    t = F.regexp_replace(_c(x), r"</?(?:b|u|sup|sub)>", "")
    return F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def accepted_rich(rich: Column | str, content: Column | str) -> Column:
    return F.when(squeeze(plain_of(rich)) == squeeze(content), F.substring(_c(rich), 1, 8000)).otherwise("")


def preview(x: Column | str, n: int = 80) -> Column:
    return F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n), F.lit("..."))).otherwise(_c(x))


def percent(x: Column | str) -> Column:
    """A share as a whole percentage, ties to even."""
    return F.concat(F.bround(_c(x) * 100, 0).cast("int").cast("string"), F.lit("%"))


def header_kind(x: Column | str) -> Column:
    h = F.trim(F.lower(_c(x)))
    has = lambda parts: F.regexp_like(h, F.lit("|".join(parts)))
    return F.when(h.isin(NUMBER_HEADERS), "num").when(has(CLAIM_HEADERS), "claim").when(has(REF_HEADERS), "ref").when(has(PAGE_HEADERS), "page").when(has(["num", "superscript"]), "num")


def numbered_paragraph(x: Column | str) -> Column:
    """struct(num, ref) of '3. text', null for other paragraphs."""
    pattern = r"^\s*(\d{1,3})[.)\-–:]\s*(.+)$"
    num = F.nullif(F.regexp_extract(F.trim(_c(x)), pattern, 1), F.lit(""))
    return F.when(num.isNotNull(), F.struct(num.cast("int").alias("num"), F.regexp_extract(F.trim(_c(x)), pattern, 2).alias("ref")))


def friendly_error(x: Column | str) -> Column:
    """The class of a processing error's message."""
    m = F.lower(_c(x))
    any_of = lambda *parts: F.regexp_like(m, F.lit("|".join(parts)))
    return F.when(any_of("out of memory", "cannot allocate"), "memory").when(any_of("password", "encrypted", "authenticate"), "password").when(any_of("no annotations"), "as_is").when(any_of("cannot open", "failed to open", "not a pdf", "format error", "broken", "no objects found"), "unreadable").otherwise("other")


def callout_points(cl: Column | str, height: Column | str) -> Column:
    """The points of a callout line (numbers in pairs, y from below), null for fewer than two."""
    nums = F.transform(F.regexp_extract_all(_c(cl), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda v: v.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.size(nums) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(nums, i * 2).alias("x"), (_c(height) - F.get(nums, i * 2 + 1)).alias("y")))
    return F.when(F.size(nums) >= 4, pairs)


def font_size(da: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_c(da), r"(\d+(?:\.\d+)?)\s+Tf", 1), F.lit("")), F.lit("7.0")).cast("double")
