"""Queries of layout frames, text search and evaluation. Orders stand in for annotations (places and sizes from their keys), 42 numbered rows for page sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import strings as S
from .operators import layout as L
from .operators import matching as M
from .operators import rasters as P
from .queries import _CLEAN, _KEYSTOP, _WORDS, Tables, query, words

_RECT = "x0: double, y0: double, x1: double, y1: double"
_ANNOTS = """annots as (select k as index, o_custkey % 40 as page_num, case when k % 3 = 0 then o_custkey % 40 + 1 end as new_page_num, case k % 8 when 0 then 4 when 1 then 15 when 2 then 3 when 3 then 8 when 4 then 9 else 2 end as code,
    case o_orderstatus when 'F' then 'moved' when 'O' then 'needs_look' else 'content_removed' end as status, k % 4 <> 1 as matched, (k % 11) / 10.0::double as match_confidence,
    x0, y0, x0 + 20 + k % 60 as x1, y0 + 10 + k % 7 as y1, k % 2 = 0 as has_line, (k * 53 % 600)::double as vx, (k * 29 % 800)::double as vy, (k * 17 % 600)::double as wx, o_orderpriority as content
    from (select o_orderkey as k, *, (o_orderkey * 37 % 500)::double as x0, (o_orderkey * 91 % 700)::double as y0 from orders)),
sizes as (select p as page_num, 600.0 + p * 10 as ow, 800.0 as oh, 600.0 + (p % 3) * 400 as width, 800.0 + (p % 2) * 50 as height from range(42) t(p))"""


def annots(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = lambda a, b: ((k * a) % b).cast("double")
    x0, y0 = d(37, 500), d(91, 700)
    rect = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 20 + k % 60).alias("x1"), (y0 + 10 + k % 7).alias("y1"))
    points = F.array(F.struct(d(53, 600).alias("x"), d(29, 800).alias("y")), F.struct(d(17, 600).alias("x"), d(29, 800).alias("y")))
    code = F.element_at(F.array(*map(F.lit, (4, 15, 3, 8, 9, 2, 2, 2))), (k % 8).cast("int") + 1)
    return t.orders.select(
        k.alias("index"), (F.col("o_custkey") % 40).alias("page_num"), F.when(k % 3 == 0, F.col("o_custkey") % 40 + 1).alias("new_page_num"), code.alias("code"),
        F.when(F.col("o_orderstatus") == "F", "moved").when(F.col("o_orderstatus") == "O", "needs_look").otherwise("content_removed").alias("status"), (k % 4 != 1).alias("matched"), ((k % 11) / 10).alias("match_confidence"),
        rect.alias("rect"), F.when(k % 2 == 0, points).otherwise(F.array().cast("array<struct<x: double, y: double>>")).alias("vertices"), F.col("o_orderpriority").alias("content"))


def sizes(t: Tables) -> DataFrame:
    p = F.col("id")
    return t.spark.range(42).select(p.alias("page_num"), (600.0 + p * 10).alias("ow"), F.lit(800.0).alias("oh"), (600.0 + (p % 3) * 400).alias("width"), (800.0 + (p % 2) * 50).alias("height"))


@query("geo2_geo3_rectangles", f"""with {_ANNOTS}
select index, x0 + 3 as ox, y1 - 2 as oy, least(x0, 100) as ux0, greatest(y1, 400) as uy1, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) as area,
    greatest(least(x1, 300) - greatest(x0, 100), 0) * greatest(least(y1, 400) - greatest(y0, 200), 0) as common, 100 <= x0 and 200 <= y0 and 300 >= x1 and 400 >= y1 as inside from annots""")
def geo2(t):
    r, page = G.rect_of(F.col("rect")), tuple(map(F.lit, (100.0, 200.0, 300.0, 400.0)))
    moved, both = G.offset(r, F.lit(3.0), F.lit(-2.0)), G.union(r, page)
    return annots(t).select("index", moved[0].alias("ox"), moved[3].alias("oy"), both[0].alias("ux0"), both[3].alias("uy1"), G.area(r).alias("area"), G.area(G.intersection(r, page)).alias("common"), G.contains(page, r).alias("inside"))


@query("geo6_search_points", f"with {_ANNOTS} select index, case when code = 2 and has_line then vx when code = 4 then (x0 + x1) / 2 end as x, case when code = 2 and has_line then vy when code = 4 then (y0 + y1) / 2 end as y from annots")
def geo6(t):
    p = G.search_point(F.col("code"), F.col("vertices"), G.rect_of(F.col("rect")))
    return annots(t).select("index", p["x"].alias("x"), p["y"].alias("y"))


@query("snk1_snk5_geo8_pins", f"""with {_ANNOTS},
a as (select index, coalesce(new_page_num, page_num) as out_page, case when has_line then vx else (x0 + x1) / 2 end as tx, case when has_line then vy else (y0 + y1) / 2 end as ty,
    case when has_line then wx - vx else 0 end as far from annots where status <> 'content_removed'),
b as (select index, out_page, tx, ty, case when far >= 0 then 1 else -1 end as d, greatest(1.0, width / 900) as s from a join sizes on sizes.page_num = out_page),
c as (select *, tx + d * 2 * s as px, tx + d * 2 * s + d * 22 * s as cx, 2 + 1.1 * s as pad from b)
select index, out_page, case when d = 1 then 0 else 2 end as turn, round(px, 6) as px, round(ty, 6) as py, round(cx, 6) as cx, round(least(cx - 11 * s, px - 2.86 * s) - pad, 6) as x0, round(ty - 11 * s - pad, 6) as y0,
    round(greatest(cx + 11 * s, px + 2.86 * s) + pad, 6) as x1, round(ty + 11 * s + pad, 6) as y1 from c""")
def snk1_pins(t):
    p = L.pin_layout(annots(t), sizes(t))
    return p.select("index", "out_page", "turn", *[F.round(F.col("pin")[c], 6).alias(c) for c in ("px", "py", "cx", "x0", "y0", "x1", "y1")])


@query("snk1_geo9_boxes", f"""with {_ANNOTS},
b as (select index, coalesce(new_page_num, page_num) as out_page, x0, y0, x1, y1 from annots where code in (4, 8)),
e as (select s_suppkey * 8 as index, 0.1 as fx, 0.2 as fy, (s_suppkey % 5) / 10.0 as fw, 0.25 as fh from supplier)
select b.index, out_page, round(case when fx is null then x0 else fx * w end, 6) as x0, round(case when fx is null then y0 else fy * height end, 6) as y0, round(case when fx is null then x1 else (fx + fw) * w end, 6) as x1, round(case when fx is null then y1 else (fy + fh) * height end, 6) as y1
from b left join e using (index) join (select page_num, height, width + 200 * greatest(1.0, width / 900) as w from sizes) z on z.page_num = out_page""")
def snk1_boxes(t):
    edit = F.struct(F.lit(0.1).alias("fx"), F.lit(0.2).alias("fy"), ((F.col("s_suppkey") % 5) / 10).alias("fw"), F.lit(0.25).alias("fh"))
    edits = t.supplier.select((F.col("s_suppkey") * 8).alias("index"), edit.alias("edit"))
    b = L.box_layout(annots(t).where(F.col("code").isin(G.SQUARE, G.CIRCLE_BOX)).select("index", "page_num", "new_page_num", "rect"), edits, sizes(t))
    return b.select("index", "out_page", *[F.round(F.col("rect")[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("snk2_src17_carriers", f"""with {_ANNOTS} select coalesce(new_page_num, page_num) as page_num, index, content, x0, y1 from annots where status <> 'content_removed'""")
def snk2(t):
    rows = L.carriers(annots(t), ["index", "content", "rect"])
    foreign = t.region.select(F.lit(0).cast("long").alias("page_num"), F.lit("Note").alias("subject"), F.lit("{}").alias("payload"))
    return L.from_carriers(rows.unionByName(foreign), f"index long, content string, rect struct<{_RECT}>").select("page_num", "index", "content", F.col("rect.x0").alias("x0"), F.col("rect.y1").alias("y1"))


@query("snk3_agg6_preview", f"""with {_ANNOTS},
a as (select annots.*, coalesce(new_page_num, page_num) as out_page, s_name from annots left join supplier on s_suppkey = index)
select a.page_num, out_page, count(*) as n, count(s_name) as numbered, string_agg(index::varchar, ',' order by index) as listed, round(sum(x0 / (z.width + 200 * greatest(1.0, z.width / 900))), 6) as nx, round(sum((y1 - y0) / z.height), 6) as nh, round(sum((x1 - x0) / o.ow), 6) as ow, round(sum(y0 / o.oh), 6) as oy
from a join sizes z on z.page_num = out_page join sizes o on o.page_num = a.page_num group by a.page_num, out_page""")
def snk3(t):
    s = sizes(t)
    rows = annots(t).withColumn("new_rect", F.lit(None).cast(f"struct<{_RECT}>"))
    p = L.preview(rows, t.supplier.select(F.col("s_suppkey").alias("index"), F.col("s_name").alias("number")), s.select("page_num", F.col("ow").alias("width"), F.col("oh").alias("height")), s)
    total = lambda f: F.round(F.aggregate("overlays", F.lit(0.0), lambda a, o: a + f(o)), 6)
    return p.select("page_num", "out_page", "n", F.size(F.filter("overlays", lambda o: o["number"].isNotNull())).cast("long").alias("numbered"), F.array_join(F.transform("overlays", lambda o: o["index"].cast("string")), ",").alias("listed"),
                    total(lambda o: o["new"]["x"]).alias("nx"), total(lambda o: o["new"]["h"]).alias("nh"), total(lambda o: o["old"]["w"]).alias("ow"), total(lambda o: o["old"]["y"]).alias("oy"))


@query("src1_src4_src5_agg8_scan", f"""with {_ANNOTS} select page_num, count(*) filter (code = 2) as records, count(*) filter (code = 3) as lines, coalesce(string_agg(index::varchar, ',' order by index) filter (code in (4, 8)), '') as boxes,
    case when count(*) filter (code = 9) > 0 then '9' else '' end as skipped from annots where code <> 15 group by page_num""")
def src1(t):
    r = L.scan_report(L.scan(annots(t)))
    return r.select("page_num", "records", "lines", F.array_join(F.transform("boxes", lambda b: b.cast("string")), ",").alias("boxes"), F.array_join(F.transform("skipped", lambda b: b.cast("string")), ",").alias("skipped"))


@query("reg2_apply_layout", f"""with {_ANNOTS},
f as (select doc, regr_slope(v, u) as a, regr_intercept(v, u) as b, count(*) as n from (select page_num as doc, x0 as u, x0 * 1.05 + 20 + page_num + index % 3 as v from annots where matched and match_confidence >= 0.6) group by doc),
m as (select doc, a, b from (select f.*, abs(a * x0 + b - x0) as moved, width, row_number() over (partition by doc order by abs(a * x0 + b - x0)) as rn, count(*) over (partition by doc) as k from f join annots on page_num = doc and matched and match_confidence >= 0.6 join sizes using (page_num)) where rn = k // 2 + 1 and k >= 8 and n >= 6 and n >= 0.4 * k and moved > 0.02 * width and doc % 2 = 0),
w as (select *, width / ow as sx, height / oh as sy, case when has_line then vx else (x0 + x1) / 2 end as tx, case when has_line then vy else (y0 + y1) / 2 end as ty from annots join sizes using (page_num) left join m on doc = page_num
    where (not matched or match_confidence < 0.6) and code = 2 and not (matched and new_page_num is not null and new_page_num <> page_num)),
p as (select *, greatest(0.0, least(case when a is not null then a * tx * sx + b else tx * sx end, width)) as px, greatest(0.0, least(ty * sy, height)) as py from w where a is not null or abs(sx - 1) >= 0.005 or abs(sy - 1) >= 0.005)
select index, round(px, 4) as px, round(py, 4) as py, round(x0 + px - tx, 4) as x0, case when a is not null then 'layout' else 'position' end as method from p""")
def reg2(t):
    rows = annots(t).withColumn("doc", F.col("page_num"))
    known = rows.where(F.col("matched") & (F.col("match_confidence") >= 0.6)).select("doc", F.col("rect.x0").alias("u"), (F.col("rect.x0") * 1.05 + 20 + F.col("page_num") + F.col("index") % 3).alias("v"))
    fits = known.groupBy("doc").agg(F.regr_slope("v", "u").alias("a"), F.regr_intercept("v", "u").alias("b"), F.count("*").alias("inliers"))
    models = L.layout_models(known, fits, sizes(t).select(F.col("page_num").alias("doc"), "width")).where("doc % 2 = 0")
    none = F.lit(None).cast("struct<x: double, y: double>")
    out = L.apply_layout(rows.withColumn("tip", G.anchor_point(none, F.col("vertices"), none, F.col("rect"))), models, sizes(t))
    return out.select("index", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), F.round("rect.x0", 4).alias("x0"), "method")


@query("jn5_arrows", f"""with {_ANNOTS}, c as (select * from annots where code = 2 and status = 'moved'),
l as (select index as id, page_num, x0 as sx, y0 as sy, x1 as tx, y1 as ty from annots where code = 3),
d as (select id, c.index, sqrt(pow(greatest(c.x0 - sx, 0, sx - c.x1), 2) + pow(greatest(c.y0 - sy, 0, sy - c.y1), 2)) as da, sqrt(pow(greatest(c.x0 - tx, 0, tx - c.x1), 2) + pow(greatest(c.y0 - ty, 0, ty - c.y1), 2)) as db from l join c using (page_num)),
b as (select *, row_number() over (partition by id order by least(da, db), index) as rn from d where least(da, db) <= 15),
m as (select l.*, b.index, db < da as e, row_number() over (partition by b.index order by id) as n from l left join (select * from b where rn = 1) b using (id))
select id, index as parent, case when e then sx else tx end as x, case when e then sy else ty end as y, case when index is null then '' else chr((97 + n)::int) end as sub from m""")
def jn5_lines(t):
    a = annots(t)
    c = a.where((F.col("code") == G.FREE_TEXT) & (F.col("status") == "moved")).select("index", "page_num", "rect.*")
    lines = a.where(F.col("code") == G.LINE).select(F.col("index").alias("id"), "page_num", F.col("rect.x0").alias("ax"), F.col("rect.y0").alias("ay"), F.col("rect.x1").alias("bx"), F.col("rect.y1").alias("by"))
    return L.arrows(lines, c)


@query("jn4_seed_lines", f"""with {_WORDS}, p as (select item_id as id, item_id % 20 as page_num, (item_id * 37 % 440)::double as px, (item_id * 53 % 300)::double as py from benchmark),
n as (select id, w.*, (w.pos // 12)::int as line, sqrt(pow(greatest(x0 - px, 0, px - x1), 2) + pow(greatest(y0 - py, 0, py - y1), 2)) as d from p join words w using (page_num)),
r as (select id, case when count(*) filter (d <= 30) >= 3 then 30.0::double when count(*) filter (d <= 60) >= 3 then 60.0 when count(*) filter (d <= 110) >= 3 then 110.0 when count(*) filter (d <= 170) >= 3 then 170.0 end as radius from n group by id),
s as (select distinct id, radius, page_num, line from n join r using (id) where d <= radius)
select id, radius, page_num, count(*) as n, string_agg(text, ' ' order by pos) as claim from s join (select *, (pos // 12)::int as line from words) w using (page_num, line) group by id, radius, page_num""")
def jn4_lines(t):
    i = F.col("item_id")
    p = t.benchmark.select(i.alias("id"), (i % 20).alias("page_num"), ((i * 37) % 440).cast("double").alias("px"), ((i * 53) % 300).cast("double").alias("py"))
    found = M.seed_lines(p, words(t.documents).withColumn("line", F.floor(F.col("pos") / 12)))
    return found.groupBy("id", "radius", "page_num").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ").alias("claim"))


_KEYS = f"list_filter(string_split(trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4 and w not in ({_KEYSTOP}))"
_SEARCH = rf"""c as (select item_id as id, item_id % 7 as old, list_filter(string_split(trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g')), ' '), lambda w: w <> '') as ws, {_KEYS} as ks from benchmark),
p as (select doc_id as page_num, list_filter(string_split(trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g')), ' '), lambda w: w <> '') as ws from documents)"""


def _grams(sizes: str, table: str, key: str, least: int) -> str:
    return f"(select {key}, n, s - 1 as i, array_to_string(ws[s : s + n - 1], ' ') as g from (select {key}, ws, n, unnest(range(1, len(ws) - n + 2)) as s from {table}, (values {sizes}) v(n) where len(ws) >= n) where length(g) >= {least})"


def _searched(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    fp = lambda df: F.filter(F.split(S.squeeze(S.clean_fingerprint("text")), " "), lambda w: w != "")
    i = F.col("item_id")
    claims = t.benchmark.select(i.alias("id"), (i % 7).alias("old"), fp(t).alias("words"), S.key_words("text").alias("keys")).withColumn("context", F.slice("words", -F.least(F.lit(10), F.greatest(F.size("words"), F.lit(1))), 10))
    pages = t.documents.select(F.col("doc_id").alias("page_num"), fp(t).alias("words"))
    at = pages.select("page_num", F.posexplode("words").alias("pos", "text")).select("page_num", "text", ((F.col("pos") % 12) * 40.0).alias("x"), (F.floor(F.col("pos") / 12) * 14.0).alias("y"))
    return claims, pages, at


@query("jn6_text_exists", f"""with {_SEARCH},
g as (select distinct id, g from {_grams('(2), (3), (4)', '(select * from c where len(ks) > 0)', 'id', 6)}), dg as (select distinct g from {_grams('(2), (3), (4)', 'p', 'page_num', 6)}),
k as (select id, least(3, len(ks)) as need, unnest(ks[1:6]) as w from c where len(ks) > 0), dw as (select distinct page_num, unnest(ws) as w from p),
h as (select distinct id from (select id, page_num, need, count(*) as n from k join dw using (w) group by all) where n >= need)
select id, id in (select id from g semi join dg using (g)) as by_phrase, id in (select id from h) as by_keys from c""")
def jn6(t):
    claims, pages, _ = _searched(t)
    return M.text_exists(claims, pages)


_FOUND = f"""{_SEARCH},
g as (select id, n, i, g from {_grams('(2), (3), (4), (5), (6)', '(select * from c where len(ks) > 0)', 'id', 8)}),
dg as (select distinct page_num, g from {_grams('(2), (3), (4), (5), (6)', 'p', 'page_num', 8)} where g in (select g from g)),
r as (select id, page_num, max(n) as size from g join dg using (g) group by id, page_num),
x as (select id, unnest(list_filter(ws[greatest(len(ws) - 9, 1):], lambda w: length(w) >= 4)[1:6]) as w from c where len(ks) > 0), xn as (select id, count(*) as total from x group by id),
dw as (select distinct page_num, unnest(ws) as w from p),
xm as (select id, page_num, count(*) as met from r join x using (id) join dw using (page_num, w) group by id, page_num),
ph as (select id, page_num, least(1.0, size / greatest(len(ws), size) + coalesce(0.15 * met / total, 0)) as confidence, 'phrase' as method from r join c using (id) left join xn using (id) left join xm using (id, page_num)),
k as (select distinct id, unnest(ks[1:10]) as w from c),
spot as (select page_num, w, ((i - 1) % 12) * 40.0 as x, ((i - 1) // 12) * 14.0 as y from (select page_num, unnest(ws) as w, generate_subscripts(ws, 1) as i from p)),
h as (select id, page_num, x, y from k join spot using (w) anti join r using (id, page_num)),
n as (select id, page_num, count(*) as hits from h group by id, page_num),
cl as (select id, page_num, max(k) as cluster from (select a.id, a.page_num, a.x, a.y, sum(b.m) as k from (select distinct * from h) a join (select id, page_num, x, y, count(*) as m from h group by all) b on a.id = b.id and a.page_num = b.page_num and abs(a.y - b.y) < 200 and abs(a.x - b.x) < 400 group by all) group by id, page_num),
f as (select id, page_num, case when hits = 1 then 0.25 when cluster >= 2 then least(cluster / len(ks), 0.6) else 0.2 end as confidence, case when hits = 1 then 'single' when cluster >= 2 then 'cluster' else 'any' end as method from n join cl using (id, page_num) join c using (id)),
u as (select * from ph union all select * from f)"""


@query("jn7_jn8_scores", f"with {_FOUND} select id, method, count(*) as pages, round(sum(confidence), 6) as total, round(max(confidence), 6) as best from u group by id, method")
def jn7_scores(t):
    found = M.find_text(*_searched(t))
    return found.groupBy("id", "method").agg(F.count("*").alias("pages"), F.round(F.sum("confidence"), 6).alias("total"), F.round(F.max("confidence"), 6).alias("best"))


@query("jn7_jn9_first_good", f"""with {_FOUND}
select id, page_num, round(confidence, 6) as confidence, method from (select u.*, row_number() over (partition by id order by page_num <> old, page_num) as rn from u join c using (id) where confidence > 0.15) where rn = 1""")
def jn7(t):
    claims, pages, at = _searched(t)
    return M.first_good(M.find_text(claims, pages, at), claims).select("id", "page_num", F.round("confidence", 6).alias("confidence"), "method")


_TRUTH = """raw as (select p_partkey as k, case p_partkey % 6 when 0 then 'REF-' || p_partkey % 40 || ' ' || p_name when 1 then 'See  https://x.org/' || replace(p_name, ' ', '/') || '/' when 2 then '<ALT tag: ' || p_name || ' ' || p_brand || '>' when 3 then upper(p_name) || '  ' || p_type
    when 4 then 'see https://x.org/' || split_part(p_name, ' ', 1) else p_name || ' and words that go on for much longer than the others ' || p_partkey % 9 end as content, (p_size * 9)::double as x, (p_partkey % 400)::double as y, p_partkey // 6 % 3 as role, p_partkey % 7 = 0 as gone from part),
kn as (select *, case when regexp_matches(content, 'REF-\\d+') then 'ref' || regexp_extract(content, 'REF-(\\d+)', 1) when regexp_matches(content, '(https?://\\S+|www\\.\\S+)') then 'url:' || lower(regexp_replace(regexp_extract(content, '(https?://\\S+|www\\.\\S+)', 1), '/+$', ''))
    when regexp_matches(content, '(?i)<alt tag:') then 'alt:' || left(lower(trim(regexp_replace(regexp_extract(content, '(?i)<alt tag:\\s*([^>]*)', 1), '\\s+', ' ', 'g'))), 40) end as key, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) as norm from raw),
g as (select k as id, * from kn where role = 0), a as (select k as index, * from kn where role <> 0),
kk as (select distinct key as ga, b from (select distinct key from g), (select distinct key as b from a) where starts_with(b, left(key, 30)) or starts_with(key, left(b, 30)))"""


def _truth(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    w = k % 6
    text = (F.when(w == 0, F.concat(F.lit("REF-"), k % 40, F.lit(" "), "p_name")).when(w == 1, F.concat(F.lit("See  https://x.org/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"))).when(w == 2, F.concat(F.lit("<ALT tag: "), "p_name", F.lit(" "), "p_brand", F.lit(">")))
            .when(w == 3, F.concat(F.upper("p_name"), F.lit("  "), "p_type")).when(w == 4, F.concat(F.lit("see https://x.org/"), F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(F.concat("p_name", F.lit(" and words that go on for much longer than the others "), k % 9)))
    rows = t.part.select(k.alias("index"), text.alias("content"), (F.col("p_size") * 9).cast("double").alias("x"), (k % 400).cast("double").alias("y"), F.when(k % 7 == 0, "content_removed").otherwise("moved").alias("status")).withColumn("key", S.claim_key("content"))
    return rows.where("index div 6 % 3 = 0").withColumnRenamed("index", "id"), rows.where("index div 6 % 3 <> 0")


@query("jn20_evaluation", f"""with {_TRUTH},
same as (select g.id, min(a.index) as same from g join a using (norm) group by g.id), alike as (select g.id, min(a.index) as alike from g join a on left(g.norm, 40) = left(a.norm, 40) and g.norm <> '' group by g.id),
m as (select g.id, a.index, a.gone, sqrt(pow(a.x - g.x, 2) + pow(a.y - g.y, 2)) as d from g join a on g.key = a.key union all
    select g.id, a.index, a.gone, sqrt(pow(a.x - g.x, 2) + pow(a.y - g.y, 2)) from g join kk on g.key = ga join a on a.key = b where g.key not in (select key from a where key is not null)),
best as (select *, row_number() over (partition by id order by d, index) as rn from m)
select g.id, coalesce(same, alike) as by_content, case when same is not null then 'content' when alike is not null then 'prefix' end as how, best.index as by_key, round(d, 6) as distance, coalesce(d < 80 and not best.gone, false) as good
from g left join same using (id) left join alike using (id) left join (select * from best where rn = 1) best using (id)""")
def jn20_rows(t):
    return M.match_truth(*_truth(t)).withColumn("distance", F.round("distance", 6))


@query("agg9_evaluation_counts", f"""with {_TRUTH},
m as (select g.id, a.gone, sqrt(pow(a.x - g.x, 2) + pow(a.y - g.y, 2)) as d, a.index from g join a on g.key = a.key union all
    select g.id, a.gone, sqrt(pow(a.x - g.x, 2) + pow(a.y - g.y, 2)), a.index from g join kk on g.key = ga join a on a.key = b where g.key not in (select key from a where key is not null)),
best as (select * from (select *, row_number() over (partition by id order by d, index) as rn from m) where rn = 1),
s as (select a.*, key in (select b from kk) as kept, key in (select key from g where key is not null) as exact from a)
select (select count(*) from best) as matched, (select count(*) from best where d < 80 and not gone) as good, count(*) filter (not gone) as placed, count(*) filter (not gone and kept) as placed_kept, count(*) filter (gone and kept) as removed_kept,
    count(*) filter (not gone and exact) as placed_exact, count(*) filter (gone and exact) as removed_exact, (select count(*) from (select key from a where not gone and key is not null group by key having count(*) > 1)) as repeated_keys from s""")
def agg9_counts(t):
    return M.score_truth(*_truth(t))


@query("src11_reference_tables", r"""
with d as (select p_size % 40 as doc, p_partkey % 3 as table_no, p_partkey as row_no, p_partkey % 4 as style, * from part),
h as (select doc, table_no, min(row_no) as head from d group by doc, table_no),
b as (select d.*, row_no = head as top, (doc + table_no) % 4 as form from d join h using (doc, table_no)),
v as (select doc, table_no, row_no, form, top,
    case form when 0 then [p_brand, p_name, p_type] when 1 then [p_name, p_brand] when 2 then [p_brand, '  ' || p_name || '  x ', case when p_partkey % 5 = 0 then ' ' else p_type end, p_brand, 'z'] else [p_type] end as c from b),
w as (select doc, table_no, row_no,
    case when form = 0 then regexp_extract(c[1], '\d+') when form = 1 then regexp_extract(c[2], '\d+') when form = 2 then regexp_extract(c[1], '\d+') end as num,
    case when form = 0 then '' when form = 1 then '' when form = 2 then trim(regexp_replace(c[2], '[ \t]+', ' ', 'g')) else '' end as claim,
    case when form = 0 then trim(regexp_replace(c[3], '\s+', ' ', 'g')) when form = 1 then trim(c[1]) when form = 2 then trim(c[3]) else trim(c[1]) end as ref,
    case when form = 2 then regexp_extract(c[4], '\d+') end as page from v where not (top and form in (0, 1))),
f as (select * from w where ref <> '')
select doc, table_no, row_no, try_cast(nullif(num, '') as int) as num, claim, ref, try_cast(nullif(page, '') as int) as page from f where (doc, table_no) in (select (doc, min(table_no)) from f group by doc)""")
def src11_tables(t):
    """Four forms: a header # | topic | Source, a header Citation | No. in the other order, no header with five columns, no header with one."""
    d = t.part.select((F.col("p_size") % 40).alias("doc"), (F.col("p_partkey") % 3).alias("table_no"), F.col("p_partkey").alias("row_no"), "*")
    top = d.groupBy("doc", "table_no").agg(F.min("row_no").alias("head"))
    form = (F.col("doc") + F.col("table_no")) % 4
    is_top = F.col("row_no") == F.col("head")
    cells = (F.when(form == 0, F.when(is_top, F.array(F.lit(" # "), F.lit("topic"), F.lit("Source"))).otherwise(F.array("p_brand", "p_name", "p_type")))
             .when(form == 1, F.when(is_top, F.array(F.lit("Citation"), F.lit("No."))).otherwise(F.array("p_name", "p_brand")))
             .when(form == 2, F.array(F.col("p_brand"), F.concat(F.lit("  "), "p_name", F.lit("  x ")), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_type")), F.col("p_brand"), F.lit("z"))).otherwise(F.array("p_type")))
    return L.reference_rows(d.join(top, ["doc", "table_no"]).select("doc", "table_no", "row_no", F.posexplode(cells).alias("col_no", "text")))


@query("win7_win8_superscripts", """
with s as (select l_orderkey as line, l_suppkey % 5 as page_num, l_linenumber as k, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as dup, * from lineitem),
t as (select line, k, case l_partkey % 5 when 0 then 'Body text ' when 1 then '1,3-5' when 2 then ' ' when 3 then '12' else 'x9' end as text, (l_quantity % 12) as size, l_partkey % 2 = 0 as flag, l_discount * 100 as bottom from s where dup = 1),
r as (select *, max(case when regexp_matches(text, '[A-Za-z]') then size end) over (partition by line) as body, lag(text) over (partition by line order by k) as before from t where trim(text) <> '')
select line, k, unnest(case text when '1,3-5' then [1, 3, 4, 5] else [12] end) as num, k * 10.0::double as x, bottom / 2 as y from r
where before is not null and text in ('1,3-5', '12') and body > 0 and size <= body * 0.9 and (flag or bottom < 8 - body * 0.25) and trim(before) <> ''""")
def win8(t):
    from pyspark.sql import Window

    one = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    k = F.col("l_partkey") % 5
    text = F.when(k == 0, "Body text ").when(k == 1, "1,3-5").when(k == 2, " ").when(k == 3, "12").otherwise("x9")
    rect = F.struct((F.col("l_linenumber") * 10.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), (F.col("l_discount") * 100).alias("y1"))
    spans = t.lineitem.withColumn("dup", one).where("dup = 1").select(F.lit(0).alias("page_num"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("k"), text.alias("text"), (F.col("l_quantity") % 12).alias("size"), (F.col("l_partkey") % 2 == 0).alias("raised"), rect.alias("rect"), F.lit(8.0).alias("line_bottom"))
    return L.superscripts(spans).drop("page_num")


@query("win9_glued_marks", f"""with {_WORDS}, m as (select *, regexp_extract(text, '^(.*?[A-Za-z).,;:])(\\d{{1,2}}(?:[,\\-–]\\d{{1,2}})*)[.,;]?$', 1) as pre, regexp_extract(text, '^(.*?[A-Za-z).,;:])(\\d{{1,2}}(?:[,\\-–]\\d{{1,2}})*)[.,;]?$', 2) as digits from words),
e as (select page_num, pos, x0 + 36 * length(pre) / length(text) as x, y0 + 3 as y, unnest(regexp_split_to_array(digits, ',')) as part from m where length(pre) >= 3),
f as (select *, try_cast(regexp_extract(part, '^(\\d+)[-–](\\d+)$', 1) as int) as lo, try_cast(regexp_extract(part, '^(\\d+)[-–](\\d+)$', 2) as int) as hi from e)
select page_num, pos, unnest(case when hi - lo > 0 and hi - lo <= 12 then range(lo, hi + 1) when regexp_full_match(part, '\\d+') then [part::int] else [] end)::int as num, round(x, 6) as x, y from f""")
def win9(t):
    return L.glued_marks(words(t.documents)).withColumn("x", F.round("x", 6))


@query("ras15_agg7_shrink_wrap", """
with r as (select doc_id as page_num, hex(encode(text)) as hx from documents where text <> ''),
s as (select page_num, len(hs) as h, unnest(hs) as hs, generate_subscripts(hs, 1) - 1 as y from (select page_num, regexp_extract_all(hx, '.{1,128}') as hs from r)),
px as (select page_num, h, x, y, (instr('0123456789ABCDEF', substr(hs, 2 * x + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hs, 2 * x + 2, 1)) - 1 as v from (select page_num, h, y, rpad(hs, 128, '0') as hs, unnest(range(64)) as x from s)),
ring as (select page_num, v // 4 as bin, sum((x = 0)::int + (x = 63)::int + (y = 0)::int + (y = h - 1)::int) as n from px group by all),
back as (select page_num, bin from (select *, row_number() over (partition by page_num order by n desc, bin) as rn from ring where n > 0) where rn = 1),
ink as (select page_num, h, x, y, abs(v - 4 * bin - 2) > 26 as ink from px join back using (page_num)),
cx as (select page_num, min(x) as x0, max(x) + 1 as x1 from (select page_num, x from ink group by all having sum(ink::int) >= 2) group by page_num),
cy as (select page_num, min(y) as y0, max(y) + 1 as y1 from (select page_num, y from ink group by all having sum(ink::int) >= 2) group by page_num),
a as (select page_num, any_value(h) as h, avg(ink::int) as share from ink group by page_num),
b as (select a.*, x0, y0, greatest(x0 - 6, 0) as bx0, greatest(y0 - 6, 0) as by0, least(x1 + 6, 64) as bx1, least(y1 + 6, h) as by1 from a left join cx using (page_num) left join cy using (page_num)),
f as (select *, coalesce(x0 is not null and y0 is not null and share <= 0.6 and bx1 - bx0 >= 8 and by1 - by0 >= 8, false) as found from b)
select page_num, (case when found then bx0 else 0 end)::double as x0, (case when found then by0 else 0 end)::double as y0, (case when found then bx1 else 64 end)::double as x1, (case when found then by1 else h end)::double as y1, found from f""")
def ras15(t):
    return P.shrink_wrap(P.byte_pictures(t.documents))


@query("reg4_claim_targets", """
with o as (select o_orderkey as id, (o_orderkey * 31 % 500)::double as tx, (o_orderkey * 17 % 700)::double as ty, 3 + o_orderkey % 9 as toks, (o_orderkey % 10) / 10.0::double as cov, (o_orderkey * 7 % 300)::double as bx0, (o_orderkey * 11 % 400)::double as by0, 4 + (o_orderkey % 9)::double as dh from orders),
l as (select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i, l_quantity * 9 as x0, l_discount * 4000 as y0, l_quantity * 9 + 30 as x1, l_discount * 4000 + 6 + l_linenumber as y1 from lineitem),
b as (select *, bx0 + 120 as bx1, by0 + 10 + toks * 9 as by1 from o),
n as (select id, i as wi, x1 as wx1, y0 as wy0, y1 as wy1 from (select l.*, row_number() over (partition by id order by pow((x0 + x1) / 2 - tx, 2) + pow((y0 + y1) / 2 - ty, 2), i) as rn from l join o using (id)) where rn = 1),
s as (select id, count(*) as n, min(y0) as top, max(x1) as rgt, max(y1) as bot from l group by id),
m as (select id, h from (select id, y1 - y0 as h, row_number() over (partition by id order by y1 - y0) as rn, count(*) over (partition by id) as c from l) where rn = c // 2 + 1),
k as (select b.*, n.* exclude id, s.* exclude id, m.h, (wi / greatest(s.n - 1, 1)) * greatest(toks - 1, 0) as wanted, by1 - by0 > 3.5 * dh and cov >= 0.6 and s.n is not null as sure from b left join n using (id) left join s using (id) left join m using (id)),
pr as (select id, px1, py0, py1 from (select k.id, l.x1 + 5 as px1, l.y0 + 50 as py0, l.y1 + 50 as py1, row_number() over (partition by k.id order by abs(l.i - wanted), l.i) as rn from k join l using (id) where sure and l.i % 2 = 0) where rn = 1),
z as (select k.*, pr.* exclude id, greatest(0.25, least(3.0, dh / greatest(1.0, h))) as sc from k left join pr using (id)),
q as (select *, (tx - coalesce(case when px1 is not null then wx1 end, rgt)) * sc as ox, (ty - case when px1 is not null then (wy0 + wy1) / 2 else (top + bot) / 2 end) * sc as oy, coalesce(px1, bx1) as bx, coalesce((py0 + py1) / 2, (by0 + by1) / 2) as cy from z)
select id, round(case when n is null then bx else least(greatest(bx + greatest(-220, least(220, ox)), 4), 596) end, 6) as x, round(case when n is null then cy else least(greatest(cy + greatest(-220, least(220, oy)), 4), 796) end, 6) as y from q""")
def reg4(t):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    d = lambda a, b: ((k * a) % b).cast("double")
    toks = 3 + k % 9
    rect = F.struct(d(7, 300).alias("x0"), d(11, 400).alias("y0"), (d(7, 300) + 120).alias("x1"), (d(11, 400) + 10 + toks * 9).alias("y1"))
    claims = t.orders.select(k.alias("id"), F.struct(d(31, 500).alias("x"), d(17, 700).alias("y")).alias("tip"), toks.alias("n_tokens"), ((k % 10) / 10).alias("coverage"), rect.alias("rect"), (4 + (k % 9)).cast("double").alias("height"), F.lit(600.0).alias("width"), F.lit(800.0).alias("page_height"))
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    q, c = F.col("l_quantity") * 9, F.col("l_discount") * 4000
    own = t.lineitem.select(F.col("l_orderkey").alias("id"), i.alias("i"), q.alias("x0"), c.alias("y0"), (q + 30).alias("x1"), (c + 6 + F.col("l_linenumber")).alias("y1"))
    pairs = own.where("i % 2 = 0").select("id", "i", (F.col("x1") + 5).alias("x1"), (F.col("y0") + 50).alias("y0"), (F.col("y1") + 50).alias("y1"))
    return L.claim_targets(claims, own, pairs).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("reg5_parked_pages", "select l_orderkey, l_linenumber, round_even(l_linenumber * 11 / 6.0, 0)::int as page from lineitem")
def reg5_pages(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", L.parked(F.col("l_linenumber"), 7, 12).alias("page"))


@query("remap_flow", f"""with {_FOUND},
b as (select * from (select u.*, row_number() over (partition by id order by page_num <> old, page_num) as rn from u join c using (id) where confidence > 0.15) where rn = 1),
g6 as (select distinct id from {_grams('(2), (3), (4)', '(select * from c where len(ks) > 0)', 'id', 6)} semi join {_grams('(2), (3), (4)', 'p', 'page_num', 6)} using (g))
select c.id as index, b.page_num as new_page_num, round(coalesce(confidence, 0), 6) as match_confidence, method as match_method, b.id is not null as matched,
    case when confidence > 0.15 then case when confidence < 0.4 then 'needs_look' else 'moved' end when c.id not in (select id from g6) then 'content_removed' else 'needs_look' end as status from c left join b using (id)""")
def remap_flow(t):
    from .plans.flows import remap

    i, w = F.col("item_id"), F.filter(F.split(S.squeeze(S.clean_fingerprint("text")), " "), lambda w: w != "")
    after = F.array_join(F.slice(w, -F.least(F.lit(10), F.greatest(F.size(w), F.lit(1))), 10), " ")
    rows = t.benchmark.select(i.alias("index"), (i % 7).alias("page_num"), F.col("text").alias("content"), F.lit(None).cast("string").alias("before"), after.alias("after"))
    return remap(rows, t.documents.select(F.col("doc_id").alias("page_num"), "text")).select("index", "new_page_num", F.round("match_confidence", 6).alias("match_confidence"), "match_method", "matched", "status")


@query("jn10_jn11_place", """
with r as (select o_orderkey as idx, o_custkey % 400 as num, o_custkey % 7 as wanted, row_number() over (partition by o_custkey % 400 order by o_orderkey) as rn, count(*) over (partition by o_custkey % 400) as n from orders),
m as (select user_id as num, event_id % 9 as page, value as x, (event_id % 100)::double as y, row_number() over (partition by user_id order by event_id % 9, event_id % 100, value) as rn, count(*) over (partition by user_id) as m from events where event_type = 'purchase'),
j as (select r.*, page, x, y, m from r left join m using (num, rn))
select idx, num, coalesce(page, wanted) as page, coalesce(x, 26.0) as x, case when page is null then 40.0 + 34.0 * (row_number() over (partition by coalesce(page, wanted), page is null order by idx) - 1) else y end as y,
    case when page is null then 'content_removed' when n = m then 'moved' else 'needs_look' end as status from j""")
def place_flow(t):
    from .plans.flows import place

    refs = t.orders.select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 400).alias("num"), (F.col("o_custkey") % 7).alias("page"))
    marks = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("num"), (F.col("event_id") % 9).alias("page"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    return place(refs, marks)


@query("agg1_jn16_jn17_finish", f"""with {_ANNOTS}, k as (select *, case when index % 5 = 4 then index - 1 end as parent_index, page_num // 4 as doc_id from annots),
r as (select doc_id, index, row_number() over (partition by doc_id order by page_num, floor(y0 / 20), x0, index) as number from k where parent_index is null)
select k.index, r.number from k left join r on r.doc_id = k.doc_id and r.index = coalesce(k.parent_index, k.index)""")
def finish_flow(t):
    from .plans.flows import finish

    rows = annots(t).select("index", "page_num", F.expr("page_num div 4").alias("doc_id"), F.when(F.col("index") % 5 == 4, F.col("index") - 1).alias("parent_index"), F.col("rect.x0").alias("x"), F.col("rect.y0").alias("y"))
    return finish(rows).select("index", "number")
