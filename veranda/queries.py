"""The registered queries of the record-matching operators, each over whole tables, with the same result in SQL.

The tables stand in for decoded pages: documents are pages and their words, placed on a grid of twelve words a line; benchmark items are claims;
part, supplier, lineitem and events are records with a page (a key), a place (numbers) and a score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import strings as S
from .operators import kernels as K
from .operators import matching as M
from .operators import ordering as O
from .operators import rules as R

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["claim_coverage"](spark, sf_dir)


# ---------------------------------------------------------------- words and tokens
def words(docs: DataFrame) -> DataFrame:
    """(page_num, pos, text, x0, y0, x1, y1)"""
    w = docs.select(F.col("doc_id").alias("page_num"), F.posexplode(S.split_words("text")).alias("pos", "text"))
    x, y = (F.col("pos") % 12) * 40.0, F.floor(F.col("pos") / 12) * 14.0
    return w.select("page_num", "pos", "text", x.alias("x0"), y.alias("y0"), (x + 36.0).alias("x1"), (y + 10.0).alias("y1"))


def tokens(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), F.posexplode(S.claim_tokens(S.split_words("text"))).alias("pos", "token"))


_STOP = ", ".join(f"'{w}'" for w in S.CLAIM_STOP)
_KEYSTOP = ", ".join(f"'{w}'" for w in S.KEY_STOP)
_SPLIT = r"list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[\s\x0B]+', ' ', 'g')), ' '), lambda w: w <> '')"
_WORDS = rf"""words as (select doc_id as page_num, i - 1 as pos, text, ((i - 1) % 12) * 40.0::double as x0, floor((i - 1) / 12) * 14.0::double as y0,
    ((i - 1) % 12) * 40.0::double + 36 as x1, floor((i - 1) / 12) * 14.0::double + 10 as y1
    from (select doc_id, unnest(ws) as text, generate_subscripts(ws, 1) as i from (select doc_id, {_SPLIT} as ws from documents)))"""


def _toks(key: str, table: str, name: str) -> str:
    t = r"regexp_replace(regexp_replace(lower(w), '[^a-z0-9%+.\-]', '', 'g'), '^[.\-]+|[.\-]+$', '', 'g')"
    return f"""(select {name}, unnest(ts) as token, generate_subscripts(ts, 1) - 1 as pos from (select {key} as {name},
        list_filter(list_transform({_SPLIT}, lambda w: {t}), lambda w: length(w) >= 3 and w not in ({_STOP})) as ts from {table}))"""


_GENERIC = "generic as (select token from dt group by token order by count(*) desc, min((page_num, pos)) limit 12)"


@query("claim_coverage", f"""
with dt as {_toks('doc_id', 'documents', 'page_num')}, ct as (select distinct id, token from {_toks('item_id', 'benchmark', 'id')}), {_GENERIC},
info as (select * from ct where token not in (select token from generic)),
total as (select id, count(*) as n from info group by id),
shared as (select id, page_num, count(*) as s from info join (select distinct page_num, token from dt) using (token) group by id, page_num),
best as (select id, page_num, s / n as cov, n, row_number() over (partition by id order by s / n desc, page_num) as rn from shared join total using (id))
select id, page_num, round(cov, 6) as coverage, case when n < 3 then 'check' when cov >= 0.6 then 'found' when cov >= 0.25 then 'check' else 'not_in_piece' end as grade from best where rn = 1""")
def claim_coverage(t: Tables) -> DataFrame:
    dt = tokens(t.documents, "doc_id", "page_num")
    claims = tokens(t.benchmark, "item_id", "id").select("id", "token").distinct()
    wanted = claims.select("token").distinct()
    pages = dt.join(wanted, "token", "left_semi").select("page_num", "token").distinct()
    cov = M.coverage(claims, pages, M.generic_tokens(dt))
    best = cov.groupBy("id").agg(F.min(F.struct((-F.col("coverage")).alias("minus"), "page_num", "informative")).alias("b"))
    return best.select("id", "b.page_num", F.round(-F.col("b.minus"), 6).alias("coverage"), R.grade(-F.col("b.minus"), F.col("b.informative")).alias("grade"))


# ---------------------------------------------------------------- strings
_CLEAN = r"trim(regexp_replace(regexp_replace(lower(text), '[\s\x0B]+', ' ', 'g'), '[^\p{L}\p{N}_\s%(),.-]', '', 'g'))"


@query("str1_clean_fingerprint", f"select doc_id, {_CLEAN} as fp from documents")
def str1(t):
    return t.documents.select("doc_id", S.clean_fingerprint("text").alias("fp"))


@query("str2_key_words", f"""select doc_id, array_to_string(list_filter(string_split(trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4 and w not in ({_KEYSTOP})), ' ') as keys from documents""")
def str2(t):
    return t.documents.select("doc_id", F.array_join(S.key_words("text"), " ").alias("keys"))


@query("str3_str4_claim_tokens", f"select page_num, count(*) as n, count(distinct token) as d, min(token) as lo, max(token) as hi from {_toks('doc_id', 'documents', 'page_num')} group by page_num")
def str4(t):
    return tokens(t.documents, "doc_id", "page_num").groupBy("page_num").agg(F.count("*").alias("n"), F.countDistinct("token").alias("d"), F.min("token").alias("lo"), F.max("token").alias("hi"))


@query("str5_alnum", "select doc_id, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') as norm from documents")
def str5(t):
    return t.documents.select("doc_id", S.alnum("text").alias("norm"))


@query("str6_clean_cell", "select conv_id, turn, trim(regexp_replace(translate(coalesce(text, ''), chr(160), ' '), '[ \\t]+', ' ', 'g')) as cell from conversations")
def str6(t):
    return t.conversations.select("conv_id", "turn", S.clean_cell("text").alias("cell"))


@query("str7_clean_lines", r"""select conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\r\n]+'), lambda v: trim(regexp_replace(v, '[\s\x0B]+', ' ', 'g'))), lambda v: v <> ''), chr(10)) as lines from conversations""")
def str7(t):
    return t.conversations.select("conv_id", "turn", S.clean_lines("text").alias("lines"))


@query("str8_row", "select p_partkey, try_cast(nullif(regexp_extract(p_name, '\\d+'), '') as int) as num, try_cast(nullif(regexp_extract(p_brand, '\\d+'), '') as int) as page from part")
def str8(t):
    return t.part.select("p_partkey", S.first_number("p_name").alias("num"), S.first_number("p_brand").alias("page"))


@query("str9_expand_numbers", """
with p as (select p_partkey, p_size as a, p_size + p_partkey % 17 - 2 as b, p_partkey % 50 as c from part)
select p_partkey, array_to_string(list_concat(case when b - a > 0 and b - a <= 12 then range(a, b + 1) else [] end, [c]), ',') as nums from p""")
def str9(t):
    label = F.concat_ws(", ", F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + F.col("p_partkey") % 17 - 2), F.col("p_partkey") % 50)
    return t.part.select("p_partkey", F.array_join(S.expand_numbers(label), ",").alias("nums"))


@query("str10_superscripts", f"""with {_WORDS} select page_num, count(*) filter (regexp_full_match(text, '[\\d,\\s\\-–—]+') and regexp_matches(text, '\\d')) as marks,
    count(*) filter (length(regexp_extract(text, '^(.*?[A-Za-z).,;:])(\\d{{1,2}}(?:[,\\-–]\\d{{1,2}})*)[.,;]?$', 1)) >= 3) as glued from words group by page_num""")
def str10(t):
    return words(t.documents).groupBy("page_num").agg(F.count_if(S.is_superscript("text")).alias("marks"), F.count_if(S.trailing_mark("text").isNotNull()).alias("glued"))


@query("str11_claim_key", r"""
with p as (select page_id, case page_id % 4 when 0 then 'see ' || url || ' now' when 1 then '<ALT tag:  Big  ' || url || '>' when 2 then 'x REF-' || page_id || ' ' || url else 'free text' end as x from pages)
select page_id, case when regexp_matches(x, 'REF-\d+') then 'ref' || regexp_extract(x, 'REF-(\d+)', 1) when regexp_matches(x, '(https?://\S+|www\.\S+)') then 'url:' || lower(regexp_replace(regexp_extract(x, '(https?://\S+|www\.\S+)', 1), '/+$', ''))
    when regexp_matches(x, '(?i)<alt tag:') then 'alt:' || left(lower(trim(regexp_replace(regexp_extract(x, '(?i)<alt tag:\s*([^>]*)', 1), '\s+', ' ', 'g'))), 40) end as key from p""")
def str11(t):
    k = F.col("page_id") % 4
    x = F.when(k == 0, F.concat(F.lit("see "), "url", F.lit(" now"))).when(k == 1, F.concat(F.lit("<ALT tag:  Big  "), "url", F.lit(">"))).when(k == 2, F.concat(F.lit("x REF-"), "page_id", F.lit(" "), "url")).otherwise("free text")
    return t.pages.select("page_id", S.claim_key(x).alias("key"))


@query("str12_src16_rich", """
with c as (select conv_id, turn, text, '<b>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</b><sup>' || case when turn % 2 = 0 then '1' else '' end || '</sup>' as rich from conversations)
select conv_id, turn, case when turn % 2 = 0 then '' else substr(rich, 1, 8000) end as rich from c""")
def str12(t):
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rich = F.concat(F.lit("<b>"), esc, F.lit("</b><sup>"), F.when(F.col("turn") % 2 == 0, "1").otherwise(""), F.lit("</sup>"))
    return t.conversations.select("conv_id", "turn", S.accepted_rich(rich, "text").alias("rich"))


@query("str15_preview", "select conv_id, turn, case when length(text) > 80 then substr(text, 1, 80) || '...' else text end as preview from conversations")
def str15(t):
    return t.conversations.select("conv_id", "turn", S.preview("text").alias("preview"))


@query("str16_percent", "select l_orderkey, l_linenumber, round_even(l_discount * 100, 0)::int::varchar || '%' as pct from lineitem")
def str16(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.percent("l_discount").alias("pct"))


@query("str17_errors", """select p_partkey, case p_partkey % 4 when 0 then 'memory' when 1 then 'password' when 2 then 'unreadable' else 'other' end as kind from part""")
def str17(t):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "Cannot allocate 5").when(k == 1, "file is ENCRYPTED").when(k == 2, "Failed to open x").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", S.friendly_error(text).alias("kind"))


@query("str18_win11_labels", """select l_orderkey, l_linenumber, l_orderkey::varchar || case when rn = 1 then '' else chr((96 + rn)::int) end as label from
    (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as rn from lineitem)""")
def str18(t):
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", rn.alias("rn")).select("l_orderkey", "l_linenumber", F.concat("l_orderkey", F.when(F.col("rn") == 1, "").otherwise(F.chr(F.lit(96) + F.col("rn")))).alias("label"))


# ---------------------------------------------------------------- sources
@query("src2_callout_points", """select l_orderkey, l_linenumber, l_quantity as tip_x, 800 - l_discount as tip_y, 2 as n from lineitem""")
def src2(t):
    cl = F.concat_ws(" ", F.lit("[ "), F.col("l_quantity").cast("string"), F.col("l_discount").cast("string"), F.lit("10 20.5 ]"))
    pts = S.callout_points(cl, F.lit(800.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.get(pts, F.lit(0))["x"].alias("tip_x"), F.get(pts, F.lit(0))["y"].alias("tip_y"), F.size(pts).alias("n"))


@query("src3_font_size", "select p_partkey, case when p_size % 2 = 0 then p_size::double else 7.0 end as size from part")
def src3(t):
    da = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/Helv "), "p_size", F.lit(" Tf 0 g"))).otherwise("0 g")
    return t.part.select("p_partkey", S.font_size(da).alias("size"))


@query("src7_src9_src10_text_layer", f"with {_WORDS} select page_num, count(*) >= 25 as text_layer, count(*) >= 15 as live_text from words group by page_num")
def src7(t):
    return words(t.documents).groupBy("page_num").agg((F.count("*") >= 25).alias("text_layer"), (F.count("*") >= 15).alias("live_text"))


@query("src11_numbered_paragraphs", r"""with p as (select p_partkey, p_size || case p_partkey % 3 when 0 then '. ' when 1 then ') ' else ' ' end || p_name as x from part)
select p_partkey, regexp_extract(x, '^\s*(\d{1,3})[.)\-–:]\s*(.+)$', 1)::int as num, regexp_extract(x, '^\s*(\d{1,3})[.)\-–:]\s*(.+)$', 2) as ref from p where regexp_matches(x, '^\s*(\d{1,3})[.)\-–:]\s*(.+)$')""")
def src11(t):
    k = F.col("p_partkey") % 3
    x = F.concat("p_size", F.when(k == 0, ". ").when(k == 1, ") ").otherwise(" "), "p_name")
    return t.part.select("p_partkey", S.numbered_paragraph(x).alias("p")).where("p is not null").select("p_partkey", "p.num", "p.ref")


@query("src12_headers", """select p_partkey, case p_partkey % 6 when 0 then 'num' when 1 then 'claim' when 2 then 'ref' when 3 then 'page' when 4 then 'num' end as kind from part""")
def src12(t):
    k = F.col("p_partkey") % 6
    h = F.when(k == 0, " Ref # ").when(k == 1, "Claim text").when(k == 2, "Source / page").when(k == 3, "Pg").when(k == 4, "Superscripts").otherwise("zzz")
    return t.part.select("p_partkey", S.header_kind(h).alias("kind"))


@query("src13_flt7_shapes", """
with s as (select n_regionkey as k, count(*)::double as n, median(s_acctbal) as w, median(s_acctbal / (s_suppkey + 1)) as r from supplier join nation on s_nationkey = n_nationkey group by n_regionkey)
select a.k as old_k, b.k as new_k, case when least(a.n, b.n) / greatest(a.n, b.n, 1) < 0.6 and abs(a.n - b.n) >= 3 then 'derivative'
    when not (a.n = b.n and abs(a.w - b.w) / greatest(a.w, 1e-6) < 0.05) and abs(a.r - b.r) / greatest(a.r, 1e-6) > 0.25 then 'derivative' else 'update' end as mode
from s a join s b on b.k = a.k + 1""")
def src13(t):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").cast("double").alias("n"), F.median("s_acctbal").alias("w"), F.median(F.col("s_acctbal") / (F.col("s_suppkey") + 1)).alias("r"))
    a, b = s.alias("a"), s.withColumn("j", F.col("k") - 1).alias("b")
    return a.join(b, F.col("a.k") == F.col("b.j")).select(F.col("a.k").alias("old_k"), F.col("b.k").alias("new_k"), R.relationship(*[F.col(f"{s}.{c}") for s in "ab" for c in ("n", "r", "w")]).alias("mode"))


# ---------------------------------------------------------------- geometry
@query("geo1_distance", "select l_orderkey, l_linenumber, round(sqrt(pow(greatest(10 - l_quantity, 0, l_quantity - 30), 2) + pow(greatest(2 - l_linenumber, 0, l_linenumber - 4), 2)), 6) as d from lineitem")
def geo1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(G.rect_distance(F.lit(10.0), F.lit(2.0), F.lit(30.0), F.lit(4.0), F.col("l_quantity"), F.col("l_linenumber")), 6).alias("d"))


@query("geo3_agg4_unions", "select l_suppkey, min(l_quantity) as x0, min(l_discount) as y0, max(l_quantity) as x1, max(l_discount) as y1 from lineitem group by l_suppkey")
def geo3(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_quantity").alias("x0"), F.min("l_discount").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_discount").alias("y1"))


@query("geo4_geo8_scale_and_direction", """select l_orderkey, l_linenumber, greatest(1.0, l_extendedprice / 900) as scale, (case l_linenumber % 4 when 0 then 1 when 2 then -1 else 0 end)::double as dx, (case l_linenumber % 4 when 1 then 1 when 3 then -1 else 0 end)::double as dy from lineitem""")
def geo4(t):
    d = G.quarter_direction(F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", G.page_scale(F.col("l_extendedprice")).alias("scale"), d["dx"].alias("dx"), d["dy"].alias("dy"))


@query("geo5_geo7_anchors", """select l_orderkey, l_linenumber, case when l_linenumber = 1 then 1.0 when l_linenumber = 2 then l_quantity when l_linenumber = 3 then 3.0 else (l_quantity + l_quantity + 8) / 2 end as x, coalesce(case when l_returnflag = 'R' then l_partkey end, l_suppkey) as page from lineitem""")
def geo5(t):
    pt = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"))
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rect = F.struct(q.alias("x0"), F.lit(0.0).alias("y0"), (q + 8).alias("x1"), F.lit(0.0).alias("y1"))
    p = G.anchor_point(F.when(n == 1, pt(F.lit(1.0))), F.when(n == 2, F.array(pt(q))).otherwise(F.array().cast("array<struct<x: double, y: double>>")), F.when(n == 3, pt(F.lit(3.0))), rect)
    return t.lineitem.select("l_orderkey", "l_linenumber", p["x"].alias("x"), G.output_page(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")), F.col("l_suppkey")).alias("page"))


@query("geo9_flt9_fractions", "select event_id, case when value is not null and not isnan(value) then greatest(0.0, least(value / 100, 1.0)) end as f from events")
def geo9(t):
    return t.events.select("event_id", R.clean_fraction(F.col("value") / 100).alias("f"))


@query("geo10_medians", "select l_suppkey, median(l_quantity) as middle, list_sort(list(l_quantity))[count(*) // 2 + 1] as upper from lineitem group by l_suppkey")
def geo10(t):
    # the upper median by rank: no list of a group's values is built
    n, rn = F.count("*").over(Window.partitionBy("l_suppkey")), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_quantity"))
    upper = t.lineitem.select("l_suppkey", "l_quantity", n.alias("n"), rn.alias("rn")).groupBy("l_suppkey").agg(F.median("l_quantity").alias("middle"), F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("l_quantity"))).alias("upper"))
    return upper


@query("geo11_rounding", "select event_id, round_even(value * 2, 0) as even, floor(value / 20) as band from events where value is not null")
def geo11(t):
    return t.events.where("value is not null").select("event_id", F.bround(F.col("value") * 2, 0).alias("even"), F.floor(F.col("value") / 20).cast("double").alias("band"))


@query("geo12_fitting_size", """select p_partkey, round(list_filter(list_transform(range(11), lambda k: 8 * pow(0.9, k)), lambda v: v * p_size * 10 <= p_retailprice or v <= 3)[1], 9) as size from part""")
def geo12(t):
    return t.part.select("p_partkey", F.round(G.fitting_size(lambda v: v * F.col("p_size") * 10, F.col("p_retailprice")), 9).alias("size"))


# ---------------------------------------------------------------- rules
@query("flt1_grade", "select l_orderkey, l_linenumber, case when l_linenumber < 3 then 'check' when l_discount * 10 >= 0.6 then 'found' when l_discount * 10 >= 0.25 then 'check' else 'not_in_piece' end as grade from lineitem")
def flt1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", R.grade(F.col("l_discount") * 10, F.col("l_linenumber")).alias("grade"))


@query("flt2_flt3_flt4_flt5_status", """
with s as (select l_orderkey, l_linenumber, 0.5 + l_discount * 5 as a, 0.5 + l_tax * 5 as b, l_returnflag = 'R' as f from lineitem)
select l_orderkey, l_linenumber, case when a >= case when f then 0.9 else 0.8 end and not (l_linenumber = 1) then 'moved' else 'needs_look' end as claim,
    case when a >= 0.75 and a - b >= 0.08 and a >= 0.85 then 'moved' when a < 0.5 and not f then 'content_removed' else 'needs_look' end as visual,
    case when b - 0.5 > 0.15 then case when b - 0.5 < 0.4 then 'needs_look' else 'moved' end when not f then 'content_removed' else 'needs_look' end as texts,
    a >= 0.75 and a - b >= 0.08 and a >= 0.9 and (not f or b < 0.95) as wins from s""")
def flt2(t):
    s = t.lineitem.select("l_orderkey", "l_linenumber", (0.5 + F.col("l_discount") * 5).alias("a"), (0.5 + F.col("l_tax") * 5).alias("b"), (F.col("l_returnflag") == "R").alias("f"))
    a, b, f = F.col("a"), F.col("b"), F.col("f")
    return s.select("l_orderkey", "l_linenumber", R.placed_claim(a, f, F.col("l_linenumber") == 1).alias("claim"), R.visual_status(a, b, f).alias("visual"), R.text_status(b - 0.5, f).alias("texts"), R.visual_wins(a, b, F.lit("text"), f, b).alias("wins"))


@query("flt6_image_pages", """select conv_id, case when count(*) % 3 = 0 then false when sum(length(text)) filter (role = 'user') > 0 and sum(length(text)) < sum(length(text)) filter (role = 'user') * 1.4 then true
    else greatest(sum(length(text)) - coalesce(sum(length(text)) filter (role = 'user'), 0), 0) <= 60 end as image from conversations group by conv_id""")
def flt6(t):
    g = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("all"), F.coalesce(F.sum(F.when(F.col("role") == "user", F.length("text"))), F.lit(0)).alias("own"))
    return g.select("conv_id", R.image_page(F.col("n") % 3, F.col("all"), F.col("own")).alias("image"))


@query("flt8_zones", "select l_orderkey, l_linenumber, case when l_quantity < 20 then 'above' when l_quantity <= 30 then 'inside' else 'below' end as zone from lineitem")
def flt8(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", R.zone(F.col("l_quantity"), F.lit(20), F.lit(10)).alias("zone"))


# ---------------------------------------------------------------- joins
def _boxes(t: Tables) -> DataFrame:
    """A box on each document's grid: its number of characters places it."""
    x, y = (F.col("n_chars") % 300).cast("double"), (F.col("n_chars") % 211).cast("double")
    return t.documents.select(F.col("doc_id").alias("page_num"), F.col("doc_id").alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 130).alias("x1"), (y + 60).alias("y1"))


_BOXES = "boxes as (select doc_id as page_num, doc_id as box_id, (n_chars % 300)::double as x0, (n_chars % 211)::double as y0, (n_chars % 300)::double + 130 as x1, (n_chars % 211)::double + 60 as y1 from documents)"
_MEET = "w.x0 < b.x1 and b.x0 < w.x1 and w.y0 < b.y1 and b.y0 < w.y1"


@query("jn1_src6_src18_outside_boxes", f"with {_WORDS}, {_BOXES} select page_num, count(*) as n from words w where not exists (select 1 from boxes b where b.page_num = w.page_num and {_MEET}) group by page_num")
def jn1(t):
    return M.outside_boxes(words(t.documents), _boxes(t)).groupBy("page_num").agg(F.count("*").alias("n"))


@query("jn2_src14_text_in_box", f"with {_WORDS}, {_BOXES} select box_id, string_agg(text, ' ' order by pos) as text from words w join boxes b on w.page_num = b.page_num and {_MEET} group by box_id")
def jn2(t):
    # the words in a box are few, whatever the page
    return M.inside_boxes(words(t.documents), _boxes(t)).groupBy("box_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("w")).select("box_id", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


@query("jn3_smallest_box", """
with p as (select l_orderkey * 10 + l_linenumber as id, l_suppkey as page_num, l_quantity as px, l_discount * 100 as py from lineitem),
b as (select s_suppkey as page_num, s_suppkey as box_id, 5.0 as x0, 1.0 as y0, 25.0 + s_nationkey as x1, 6.0 as y1 from supplier
    union all select s_suppkey, s_suppkey + 1000000, 10.0, 0.0, 40.0, 3.0 + s_nationkey / 10.0 from supplier),
m as (select id, box_id, (x1 - x0) * (y1 - y0) as area from p join b using (page_num) where sqrt(pow(greatest(x0 - px, 0, px - x1), 2) + pow(greatest(y0 - py, 0, py - y1), 2)) < 4),
r as (select *, row_number() over (partition by id order by area, box_id) as rn from m)
select id, box_id, round(area, 6) as area from r where rn = 1 and area < 150""")
def jn3(t):
    p = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("page_num"), F.col("l_quantity").alias("px"), (F.col("l_discount") * 100).alias("py"))
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    box = lambda i, *r: t.supplier.select(s.alias("page_num"), i.alias("box_id"), *[c.alias(k) for c, k in zip(r, M.RECT, strict=True)])
    b = box(s, F.lit(5.0), F.lit(1.0), n + 25.0, F.lit(6.0)).unionByName(box(s + 1000000, F.lit(10.0), F.lit(0.0), F.lit(40.0), n / 10.0 + 3.0))
    return M.smallest_box(p, b, 150.0).select("id", "box_id", F.round("area", 6).alias("area"))


@query("jn4_src15_ladder", f"""
with {_WORDS}, p as (select doc_id as id, doc_id as page_num, (n_chars % 700)::double as px, (n_chars % 911)::double as py from documents),
d as (select id, sqrt(pow(greatest(x0 - px, 0, px - x1), 2) + pow(greatest(y0 - py, 0, py - y1), 2)) as d from p join words using (page_num)),
c as (select id, r, count(*) as n from d, (values (30.0), (60.0), (110.0), (170.0)) v(r) where d <= r group by id, r)
select id, min(r)::double as radius from c where n >= 3 group by id""")
def jn4(t):
    d = F.col("doc_id")
    p = t.documents.select(d.alias("id"), d.alias("page_num"), (F.col("n_chars") % 700).cast("double").alias("px"), (F.col("n_chars") % 911).cast("double").alias("py"))
    return M.ladder(p, words(t.documents), [30, 60, 110, 170], 3)


@query("jn5_jn13_nearest", """
with a as (select l_orderkey * 10 + l_linenumber as id, l_suppkey as k, l_extendedprice as v from lineitem where l_returnflag = 'R'), b as (select l_orderkey * 10 + l_linenumber as id, l_suppkey as k, l_extendedprice as v from lineitem where l_linestatus = 'O' and l_linenumber = 1),
m as (select a.id, b.id as right_id, abs(a.v - b.v) as gap, row_number() over (partition by a.id order by abs(a.v - b.v), b.id) as rn from a join b on a.k = b.k and abs(a.v - b.v) <= 1500)
select a.id, m.right_id, round(m.gap, 2) as gap from a left join m on a.id = m.id and m.rn = 1""")
def jn5(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"), "l_returnflag", "l_linestatus", "l_linenumber")
    return M.nearest(rows.where("l_returnflag = 'R'").select("id", "k", "v"), rows.where("l_linestatus = 'O' and l_linenumber = 1").select("id", "k", "v"), "k", "v", 1500.0).select("id", "right_id", F.round("gap", 2).alias("gap"))


_PHRASE = lambda sizes, least: " union all ".join(f"select k, {n} as size, unnest(range(0, len(ws) - {n} + 1)) as i, ws from x where len(ws) >= {n}" for n in sizes)


@query("jn6_jn7_jn9_phrases", f"""
with c as (select k, size, i, array_to_string(ws[i + 1 : i + size], ' ') as phrase from ({_PHRASE((6, 5, 4, 3, 2), 8).replace('from x', "from (select item_id as k, string_split(trim(regexp_replace(" + _CLEAN + ", '\\s+', ' ', 'g')), ' ') as ws from benchmark)")})),
p as (select distinct k as page_num, array_to_string(ws[i + 1 : i + size], ' ') as phrase from ({_PHRASE((6, 5, 4, 3, 2), 8).replace('from x', "from (select doc_id as k, string_split(trim(regexp_replace(" + _CLEAN + ", '\\s+', ' ', 'g')), ' ') as ws from documents)")})),
m as (select c.k as id, page_num, size, i, row_number() over (partition by c.k, page_num order by size desc, i) as rn from c join p using (phrase) where length(phrase) >= 8)
select id, page_num, size, i from m where rn = 1""")
def jn7(t):
    w = F.split(S.squeeze(S.clean_fingerprint("text")), " ").alias("words")
    return M.longest_phrase(t.benchmark.select(F.col("item_id").alias("id"), w), t.documents.select(F.col("doc_id").alias("page_num"), w), [6, 5, 4, 3, 2], 8)


@query("jn10_ordinal_pairs", """
with u as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n from conversations where role = 'user'),
a as (select conv_id, turn as answer, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as m from conversations where role = 'assistant')
select u.conv_id, u.turn, a.answer, coalesce(n = m, false) as exact from u left join a using (conv_id, rn)""")
def jn10(t):
    c = t.conversations
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"))
    return M.ordinal_pairs(c.where("role = 'user'").select("conv_id", "turn"), b, "conv_id", ["turn"], ["answer"], ["answer"]).select("conv_id", "turn", "answer", "exact")


@query("jn12_as_of", """
with l as (select event_id, user_id, ts from events where event_type <> 'purchase'), r as (select user_id, ts, max(value) as shift from events where event_type = 'purchase' group by user_id, ts)
select l.event_id, r.shift from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""")
def jn12(t):
    e = t.events
    r = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("shift"))
    return M.as_of(e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), r, "user_id", "ts", ["shift"]).select("event_id", "shift")


@query("jn16_jn17_inherit", """select l_orderkey, l_linenumber, o_orderpriority as colour, dense as number from lineitem join (select o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as dense from orders) on l_orderkey = o_orderkey""")
def jn17(t):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    roots = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("colour"), rn.alias("number"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(roots, "l_orderkey").select("l_orderkey", "l_linenumber", "colour", "number")


@query("jn18_jn19_reg6_edits", """
with e as (select s_suppkey as i, s_name as new_name, s_nationkey % 5 = 0 as gone from supplier)
select p_partkey, coalesce(new_name, p_name) as name from part left join e on p_partkey = i where not coalesce(gone, false) union all select -s_suppkey, s_name from supplier where s_nationkey = 3""")
def jn18(t):
    from .plans.flows import apply_edits

    rows = t.part.select(F.col("p_partkey").alias("index"), F.col("p_name").alias("content"))
    edits = t.supplier.select(F.col("s_suppkey").alias("index"), F.col("s_name").alias("content"), (F.col("s_nationkey") % 5 == 0).alias("deleted"))
    new = t.supplier.where("s_nationkey = 3").select((-F.col("s_suppkey")).alias("index"), F.col("s_name").alias("content"))
    return apply_edits(rows, edits, new).select(F.col("index").alias("p_partkey"), F.col("content").alias("name"))


@query("jn14_fuzzy_words")
def jn14(t):
    """Claim tokens onto the page vocabulary: itself if it is there, else the closest of ratio 0.84 or more, of equals the largest. Candidates share
    a first or last three letters, a middle pair is compared by the ratio."""
    from .plans.flows import fuzzy_words

    claims = tokens(t.benchmark, "item_id", "id").select("token").distinct().select(F.concat("token", F.when(F.crc32("token") % 2 == 0, "x").otherwise("")).alias("token"))
    return fuzzy_words(claims, tokens(t.documents, "doc_id", "page_num").select("token").distinct())


# ---------------------------------------------------------------- aggregates
@query("agg1_reg7_summary", """select count(*) filter (l_linenumber = 1) as total, count(*) filter (l_returnflag <> 'N') as matched, count(*) filter (l_returnflag = 'N') as unmatched,
    count(*) filter (l_linenumber = 1 and l_returnflag = 'A') as moved, count(*) filter (l_linenumber = 1 and l_returnflag = 'R') as needs_look, count(*) filter (l_linenumber = 1 and l_returnflag = 'N') as content_removed from lineitem""")
def agg1(t):
    f = F.col("l_returnflag")
    return O.summary(t.lineitem.select(F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("parent_index"), (f != "N").alias("matched"), F.when(f == "A", "moved").when(f == "R", "needs_look").otherwise("content_removed").alias("status")))


@query("agg2_generic", f"with dt as {_toks('doc_id', 'documents', 'page_num')}, {_GENERIC} select token from generic")
def agg2(t):
    return M.generic_tokens(tokens(t.documents, "doc_id", "page_num"))


@query("agg5_page_share", """select l_suppkey, avg((l_discount > 0.05)::int) as share, floor(median(l_partkey) filter (l_discount > 0.05))::int as target from lineitem group by l_suppkey""")
def agg5(t):
    good = F.col("l_discount") > 0.05
    return t.lineitem.groupBy("l_suppkey").agg(F.avg(good.cast("double")).alias("share"), F.floor(F.median(F.when(good, F.col("l_partkey")))).cast("int").alias("target"))


@query("snk4_all_pages", "select c_custkey as page_num, coalesce(n, 0) as n, n is null as empty, top from customer left join (select o_custkey, count(*) as n, max(o_orderkey) as top from orders group by o_custkey) on o_custkey = c_custkey")
def snk4(t):
    from .plans.flows import all_pages

    return all_pages(t.customer.select(F.col("c_custkey").alias("page_num")), t.orders.select(F.col("o_custkey").alias("page_num"), F.col("o_orderkey").alias("index"))).select("page_num", "n", "empty", "top")


@query("agg7_ink_profile", "select label, i, round(avg(v), 5) as mean, count(*) filter (abs(v) > 0.1) as ink from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by label, i")
def agg7(t):
    return t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg("v"), 5).alias("mean"), F.count_if(F.abs("v") > F.lit(0.1).cast("float")).alias("ink"))


@query("agg10_regression", "select l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as cut from lineitem group by l_suppkey")
def agg10(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("cut"))


@query("agg3_coverage", f"""with dt as {_toks('doc_id', 'documents', 'page_num')}, {_GENERIC} select page_num, round(count(*) filter (token not in (select token from generic)) / count(*), 6) as informative from dt group by page_num""")
def agg3(t):
    dt = tokens(t.documents, "doc_id", "page_num")
    g = F.broadcast(M.generic_tokens(dt).withColumn("generic", F.lit(1)))  # twelve rows
    return dt.join(g, "token", "left").groupBy("page_num").agg(F.round(F.count_if(F.col("generic").isNull()) / F.count("*"), 6).alias("informative"))


# ---------------------------------------------------------------- windows
@query("win1_reading_order", """select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_linenumber, floor(l_quantity / 20), l_extendedprice, l_orderkey) as number from lineitem""")
def win1(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_orderkey").alias("index"))
    return O.reading_order(rows).select(F.col("index").alias("l_orderkey"), F.col("page_num").alias("l_linenumber"), "number")


@query("win2_context", f"""with {_WORDS} select page_num, pos, string_agg(text, ' ') over (partition by page_num order by pos rows between 10 preceding and 1 preceding) as before,
    string_agg(text, ' ') over (partition by page_num order by pos rows between 1 following and 10 following) as after from words""")
def win2_each(t):
    """The same for every word of every page."""
    ws = t.documents.select(F.col("doc_id").alias("page_num"), S.split_words("text").alias("ws")).where(F.size("ws") > 0)
    join = lambda lo, n: F.nullif(F.array_join(F.slice("ws", lo, n), " "), F.lit(""))
    at = F.transform(F.sequence(F.lit(0), F.size("ws") - 1), lambda p: F.struct(p.alias("pos"), join(F.greatest(p - 9, F.lit(1)), F.least(p, F.lit(10))).alias("before"), join(p + 2, F.lit(10)).alias("after")))
    return ws.select("page_num", F.inline(at))


@query("win3_win4_win9_orders", """select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by round_even(l_quantity / 8, 0), l_extendedprice, l_orderkey, l_linenumber) as n from lineitem""")
def win3(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.bround(F.col("l_quantity") / 8, 0), "l_extendedprice", "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("n"))


@query("win5_gaps", "select conv_id, turn, lead(turn) over (partition by conv_id order by turn) - turn as gap from conversations")
def win5(t):
    return t.conversations.select("conv_id", "turn", (F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("turn")).alias("gap"))


@query("win6_weakest", """select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_discount, l_orderkey, l_linenumber) as rn from lineitem where l_discount < 0.03) where rn <= 2""")
def win6(t):
    rn = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_discount", "l_orderkey", "l_linenumber"))
    return t.lineitem.where("l_discount < 0.03").withColumn("rn", rn).where("rn <= 2").select("l_orderkey", "l_linenumber")


@query("win10_drop_duplicates")
def win10(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("page_num"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_extendedprice") / 100).alias("y"), (-F.col("l_discount")).alias("c"))
    return K.drop_duplicates(rows, "k", ["c", "id"]).select("id", "kept")


@query("top1_top2_second_best", """with b as (select l_suppkey, min((-l_discount, l_orderkey, l_linenumber)) as b from lineitem group by l_suppkey)
select l.l_suppkey, -min(b[1]) as best, max(l_discount) filter (abs(l_orderkey - b[2]) > 30) as second from lineitem l join (select l_suppkey, [b[1], b[2]::double] as b from b) b using (l_suppkey) group by l.l_suppkey""")
def top1(t):
    b = t.lineitem.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("l_discount")).alias("m"), "l_orderkey", "l_linenumber")).alias("b"))
    return t.lineitem.join(b, "l_suppkey").groupBy("l_suppkey").agg((-F.min("b.m")).alias("best"), F.max(F.when(F.abs(F.col("l_orderkey") - F.col("b.l_orderkey")) > 30, F.col("l_discount"))).alias("second"))


# ---------------------------------------------------------------- similarity, sequence, raster, layout
@query("txt1_jn15_locate_claims")
def txt1(t):
    from .plans.flows import locate_claims

    return locate_claims(t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("claim")), t.documents.select(F.col("doc_id").alias("page_num"), "text"))


@query("txt2_txt3_ordered_coverage")
def txt2(t):
    from .plans.flows import ordered_claims

    found = ordered_claims(t.benchmark.select(F.col("item_id").alias("id"), "text"), t.documents.select(F.col("doc_id").alias("page_num"), "text"))
    return found.withColumn("places", F.array_join(F.transform("places", lambda x: x.cast("string")), ","))


@query("txt5_align_pages")
def txt5(t):
    from .plans.flows import align_documents

    v = t.embeddings.select(F.col("label").alias("doc"), F.col("vec_id").alias("page_num"), "embedding")
    return align_documents(v.where("doc % 2 = 0"), v.where("doc % 2 = 1").withColumn("doc", F.col("doc") - 1))


@query("txt6_spread", """
with r as (select l_suppkey as page, l_orderkey * 10 + l_linenumber as id, l_quantity * 120 as want, l_linenumber + 4.0::double as height from lineitem),
o as (select *, row_number() over w as i, coalesce(sum(height + 2) over (w rows between unbounded preceding and 1 preceding), 0) as before from r window w as (partition by page order by want, id)),
fit as (select page, max_by(before + height, i) < 6000 as fits, max(i) as n from o group by page),
z as (select o.page, i, sum(want - before) over (partition by o.page order by i) as c from o join fit using (page) where fits),
m as (select a.page, a.i as j, b.i as k, min((b.c - coalesce(p.c, 0)) / (b.i - a.i + 1)) over (partition by a.page, a.i order by b.i desc) as low from z a join z b on a.page = b.page and b.i >= a.i left join z p on p.page = a.page and p.i = a.i - 1),
iso as (select page, k as i, max(low) as v from m group by all),
y0 as (select o.*, v + before as y from o join iso using (page, i)),
y1 as (select *, y + greatest(0.0, -(first_value(y) over w)) as y1 from y0 window w as (partition by page order by i rows between unbounded preceding and unbounded following)),
y2 as (select *, y1 - greatest(0.0, last_value(y1) over w + last_value(height) over w - 6000) as y2 from y1 window w as (partition by page order by i rows between unbounded preceding and unbounded following)),
y3 as (select *, max(greatest(y2, 0) - before) over (partition by page order by i) + before as y3 from y2),
y4 as (select *, min(least(y3, 6000 - height) - before) over (partition by page order by i desc) + before as y4 from y3)
select o.page, o.id, round(case when fits then y4 else o.before end, 6) as y from o join fit using (page) left join y4 on y4.page = o.page and y4.i = o.i""")
def txt6(t):
    from .plans.flows import spread_entries

    return spread_entries(t.lineitem.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 120).alias("want"), (F.col("l_linenumber") + 4.0).alias("height")), 2.0, 0.0, 6000.0)


_HASH = "h as (select vec_id, label, list_transform(embedding, lambda v: (v >= list_sort(embedding)[33])::int) as h from embeddings)"


@query("ras5_ras6_hash_similarity", f"with {_HASH} select a.vec_id, b.vec_id as other, list_sum(list_transform(range(1, 65), lambda i: (a.h[i] = b.h[i])::int)) / 64 as sim from h a join h b on a.label = b.label and b.vec_id = a.vec_id + 10")
def ras6(t):
    h = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: (v >= G.upper_median(F.col("embedding"))).cast("int")).alias("h"))
    a, b = h.alias("a"), h.withColumn("j", F.col("vec_id") - 10).alias("b")
    same = F.aggregate(F.zip_with("a.h", "b.h", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return a.join(b, (F.col("a.vec_id") == F.col("b.j")) & (F.col("a.label") == F.col("b.label"))).select("a.vec_id", F.col("b.vec_id").alias("other"), (same / 64).alias("sim"))


@query("ras7_correlation", "select a.vec_id, round((list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2, 5) as ncc from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def ras7(t):
    v = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a, b = v.alias("a"), v.withColumn("j", F.col("vec_id") - 1).alias("b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return a.join(b, F.col("a.vec_id") == F.col("b.j")).select("a.vec_id", F.round((dot("a.e", "b.e") / F.sqrt(dot("a.e", "a.e") * dot("b.e", "b.e")) + 1) / 2, 5).alias("ncc"))


@query("ras1_ras3_ras8_rasters")
def ras(t):
    from .plans.flows import raster_report

    return raster_report(t.documents.select(F.col("doc_id").alias("page_num"), F.substring("text", 1, 1 << 30).alias("text")))


@query("reg1_reg2_layout_shift")
def reg1(t):
    from .plans.flows import fit_layout

    return fit_layout(t.lineitem.select(F.col("l_suppkey").alias("doc"), (F.col("l_quantity") * 20).alias("u"), (F.col("l_quantity") * 20 + F.col("l_linenumber")).alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), 35.0)


@query("reg3_removed_pages", """
with g as (select s_suppkey % 40 as page_num, s_suppkey as i, s_acctbal > 1000 as good, s_suppkey % 40 as target from supplier),
p as (select page_num, avg(good::int) as share, floor(median(target) filter (good))::int as target, min(i) as first from g group by page_num),
pts as (select page_num, target from p where share >= 0.5 union all values (-1, -1), (40, 30)),
gaps as (select page_num as lo, lead(page_num) over (order by page_num) as hi, target as lo_t, lead(target) over (order by page_num) as hi_t from pts),
weak as (select p.page_num, gaps.*, row_number() over (partition by lo order by share, first) as n from p join gaps on p.page_num > lo and p.page_num < hi where share < 0.3 and (hi - lo) - (hi_t - lo_t) > 0)
select page_num, greatest(0, least(hi_t, 29))::int as parked from weak where n <= (hi - lo) - (hi_t - lo_t)""")
def reg3(t):
    a = t.supplier.select(F.lit(None).cast("int").alias("parent_index"), F.col("s_suppkey").alias("index"), (F.col("s_suppkey") % 40).cast("int").alias("page_num"), (F.col("s_acctbal") > 1000).alias("matched"), F.lit(1.0).alias("match_confidence"), F.lit("moved").alias("status"), F.lit(None).cast("int").alias("new_page_num"))
    return O.removed_pages(a, 40, 30)


from . import layout_queries, page_queries  # noqa: E402, F401  register their own
