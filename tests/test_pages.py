import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from veranda.operators import kernels as K
from veranda.operators import rasters as P
from veranda.operators import rich as T
from veranda.plans import flows

PICTURE = "doc long, page_num long, h int, w int, scale double, px binary, width double, height double"


def picture(doc, page, a, scale=1.0):
    return (doc, page, *a.shape, scale, a.tobytes(), a.shape[1] / scale, a.shape[0] / scale)


def test_template_equals_a_plain_version():
    g = np.random.default_rng(1)
    a = g.integers(0, 256, (40, 50)).astype(np.uint8)
    a[20:, :20] = 7
    patch = a[5:13, 10:22].copy()
    want = np.zeros((33, 39))
    for i in range(33):
        for j in range(39):
            w = a[i : i + 8, j : j + 12].astype(float)
            t = patch - patch.mean()
            d = w - w.mean()
            want[i, j] = (d * t).sum() / np.sqrt((d * d).sum() * (t * t).sum()) if d.any() else 0.0
    assert np.allclose(K.match_template(a, patch), want, atol=1e-9)
    assert np.allclose(K.match_template(a, patch, 7), want, atol=1e-9)


def test_ink_equals_a_plain_version():
    g = np.random.default_rng(2)
    a = np.where(g.random((30, 25)) < 0.02, 0, 255).astype(np.uint8)
    ink = P.Ink(a, 0.5)
    edge = np.zeros(a.shape, bool)
    for y in range(30):
        for x in range(25):
            edge[y, x] = (x > 0 and abs(int(a[y, x]) - int(a[y, x - 1])) > 24) or (y > 0 and abs(int(a[y, x]) - int(a[y - 1, x])) > 24)
    ys, xs = np.nonzero(edge)
    want = np.array([[bool(len(ys)) and (np.abs(ys - y) + np.abs(xs - x)).min() <= 2 for x in range(25)] for y in range(30)])
    assert (ink.at == want).all() and 0 < want.mean() < 1
    assert np.isclose(ink.cover(4, 6, 20, 31), want[3:16, 2:11].mean()) and ink.cover(60, 0, 70, 9) == 0.0
    for x, y, ux, uy in [(10, 10, 0, 0), (30, 40, 1, 0), (44, 4, 0, -1)]:
        best = None
        for i, j in zip(*np.nonzero(want)):
            d = np.hypot(j * 2 - x, i * 2 - y)
            cost = d * (1.5 - 0.5 * ((j * 2 - x) * ux + (i * 2 - y) * uy) / max(d, 1e-6))
            if d <= 25 and (best is None or cost < best[0]):
                best = (cost, j * 2.0, i * 2.0, d)
        got = ink.nearest(x, y, 25, ux, uy)
        assert got is None if best is None else np.allclose(got, best[1:])
    blank = P.Ink(np.full((9, 9), 200, np.uint8), 0.5)
    assert blank.nearest(4, 4, 9) is None and not blank.on(4, 4, 3)


def test_turns_take_the_cheapest_side_in_order(spark):
    g = random.Random(5)
    a = np.full((200, 300), 255, np.uint8)
    a[40:90, 100:200:3] = 0
    pins = sorted((float(g.randrange(600)), float(g.randrange(400)), g.randrange(4)) for _ in range(40))
    pins.sort(key=lambda p: (p[1], p[0]))
    ink = P.Ink(a, 0.5)
    placed, want = [], []
    for x, y, wish in pins:
        best = None
        for rank, step in enumerate((0, 2, 1, 3)):
            turn = (wish + step) % 4
            dx, dy = [(1, 0), (0, 1), (-1, 0), (0, -1)][turn]
            px, py = x + 2 * dx, y + 2 * dy
            cx, cy = min(max(px + 22 * dx, 12), 588), min(max(py + 22 * dy, 12), 388)
            cost = 1000 * any(np.hypot(cx - u, cy - v) < 22.55 for u, v in placed) + 0.15 * rank
            cost += 4 * ink.cover(cx - 11, cy - 11, cx + 11, cy + 11) + ink.cover(min(px, cx) - 1, min(py, cy) - 1, max(px, cx) + 1, max(py, cy) + 1)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, turn, (cx, cy))
        want.append(best[1])
        placed.append(best[2])
    assert P.turns(pins, 600.0, 400.0, ink) == want and len(set(want)) > 1
    rows = [(1, 0, i, x, y, t, 600.0, 400.0) for i, (x, y, t) in enumerate(pins)] + [(1, 9, 0, 5.0, 5.0, 2, 600.0, 400.0)]
    df = spark.createDataFrame(rows, "doc long, page_num long, index long, x double, y double, turn int, width double, height double")
    got = {(r.page_num, r["index"]): r.turn for r in P.pin_turns(df, spark.createDataFrame([picture(1, 0, a, 0.5)], PICTURE)).collect()}
    assert len(got) == 41 and [got[0, i] for i in range(40)] == want and got[9, 0] == 2


def _plain_search(annots, old, new, home):
    out = {}
    for index, page, x, y in annots:
        a = old[page]
        got = P.patch_of(a, 1.0, a.shape[1], x, y)
        pages = [p for p in dict.fromkeys((home[page], home[page] - 1, home[page] + 1, home[page] - 2, home[page] + 2, *sorted(new))) if p in new]
        best = None
        for p in pages if got else ():
            hit, wider = None, new[p].shape[1] / a.shape[1]
            for q in (1.0, wider) if abs(wider - 1) > 0.02 else (1.0,):
                s = min(1.0 / q, 3.0)
                one = P.seek(got[0], got[1], P.resized(new[p], s), 1.0, a.shape[1])
                if one is None:
                    hit = None
                    break
                if hit is None or one[0] > hit[0]:
                    hit = (one[0], one[1], (one[2] + x - got[1]) / s, (one[3] + y - got[2]) / s)
                if one[0] >= 0.9 and one[0] - one[1] >= 0.08:
                    break
            if hit is None:
                best = None
                break
            if best is None or hit[0] > best[0]:
                best = (*hit, p)
            lead = hit[0] - hit[1] >= 0.08
            if lead and (hit[0] >= 0.95 or (p == pages[0] and p == home[page] and hit[0] >= 0.85)):
                break
        out[index] = (page, y, home[page], best and (best[4], best[2] - x, best[3] - y), best is not None and best[0] >= 0.75 and best[0] - best[1] >= 0.08, best is None)
    done = {}
    for index, (page, y, at, hit, sure, flat) in out.items():
        near = [(abs(o[1] - y), i) for i, o in out.items() if o[0] == page and o[4]]
        place = hit if sure else out[min(near)[1]][3] if near else (at, 0.0, 0.0)
        done[index] = (*(round(v, 6) for v in place), sure, flat)
    return done


def test_search_patches_equals_a_plain_version(spark):
    g = np.random.default_rng(7)
    blocks = lambda h, w: np.kron(g.integers(0, 2, (h // 4, w // 4)) * 200, np.ones((4, 4))).astype(np.uint8)
    old = {p: blocks(160, 160) for p in range(5)}
    old[1][:, :] = 90  # flat
    old[1][100:140, 20:100] = blocks(40, 80)
    new = {p + 1: np.vstack([blocks(20, 160), a]) for p, a in old.items()}  # a page put in before, and 20 rows above
    new[0] = blocks(160, 160)
    new[3] = P.resized(old[2], 1.5)  # made larger
    new[6] = old[4][:8]  # too small for any patch
    annots = [(i, int(g.integers(0, 5)), float(g.integers(20, 140)), float(g.integers(10, 150))) for i in range(40)] + [(40, 1, 60.0, 40.0)]
    home = {p: p for p in range(5)}
    want = _plain_search(annots, old, new, home)
    frame = lambda pages: spark.createDataFrame([picture(3, p, np.ascontiguousarray(a)) for p, a in pages.items()], PICTURE)
    rows = spark.createDataFrame([(3, *a) for a in annots], "doc long, index long, page_num long, x double, y double")
    homes = spark.createDataFrame([(3, p, h) for p, h in home.items()], "doc long, page_num long, home long")
    got = {r["index"]: (r.new_page, round(r.dx, 6), round(r.dy, 6), r.confident, r.flat) for r in P.search_patches(rows, frame(old), frame(new), homes).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 20 and any(w[4] for w in want.values())
    nowhere = P.search_patches(rows, frame(old), frame(new).limit(0), homes).collect()
    assert len(nowhere) == 41 and not any(r.confident for r in nowhere)


def test_search_strips_finds_a_moved_body(spark):
    g = np.random.default_rng(8)
    old = {p: np.kron(g.integers(0, 2, (50, 40)) * 200, np.ones((8, 8))).astype(np.uint8) for p in range(3)}
    new = {0: np.kron(g.integers(0, 2, (50, 40)) * 200, np.ones((8, 8))).astype(np.uint8), 1: np.roll(old[0], 42, 0), 2: old[1]}
    frame = lambda pages: spark.createDataFrame([picture(1, p, a) for p, a in pages.items()], PICTURE)
    # strips of 80 points from 30 above: tops at multiples of 20; from 72 and 42 lower at 84, near the stop at 80
    rows = [(1, 0, 0, 10.0, 60.0, 30.0, 68.0), (1, 1, 1, 10.0, 130.0, 30.0, 138.0), (1, 2, 2, 10.0, 130.0, 30.0, 138.0), (1, 3, 7, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "doc long, index long, page_num long, x0 double, y0 double, x1 double, y1 double")
    got = {r["index"]: r for r in P.search_strips(df, frame(old), frame(new)).collect()}
    assert set(got) == {0, 1, 2}  # there is no page 7
    for i, page, x0, y0, x1, y1 in [r[1:] for r in rows[:3]]:
        left, right = P.body_strip(x0, x1, 320.0)
        cut = P.strip_hashes(old[page], 1.0, left, right, np.array([y0 - 30]), 80.0)
        best = (0.0, None, None)
        for p in [page] + [p for p in new if p != page]:
            tops = np.arange(0, 320.5, 20.0)
            like = (P.strip_hashes(new[p], 1.0, left, right, tops, 80.0) == cut).mean(1)
            if like.max() > best[0]:
                best = (like.max(), p, tops[like.argmax()] + 30)
            if like.max() >= 0.7:
                break
        assert (got[i].score, got[i].new_page, got[i].y0) == best and got[i].y1 == best[2] + 8
    assert (got[1].new_page, got[1].y0) == (2, 130.0) and got[1].score == 1.0


def test_removed_part():
    g = np.random.default_rng(9)
    a = np.repeat(g.permutation(250)[:200, None], 30, 1).astype(np.uint8)
    shorter = np.vstack([a[:90], a[130:], np.full((40, 30), 255, np.uint8)])
    row, by = P.removed_part(a, shorter)
    assert by == -40 and 80 <= row <= 140
    assert P.removed_part(a, a) == (None, 0) and P.removed_part(a[:1], a[:1]) == (None, 0)


def _plain_runs(rich):
    flags, words, word = set(), [], []
    for tag, text in re.findall(r"(</?(?:b|u|sup|sub)>)|([^<]+|<)", rich):
        if tag:
            name = tag.strip("</>")
            if tag[1] == "/":
                flags.discard(name)
            else:
                flags.add(name)
                flags -= {"sup": {"sub"}, "sub": {"sup"}}.get(name, set())
            continue
        for part in re.findall(r"\s+|\S+", text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")):
            if part.isspace():
                words += [word] if word else []
                word = []
            else:
                word.append((part, ",".join(sorted(flags))))
    return words + ([word] if word else [])


RICH = ["<b>a b</b>c <sup>1</sup><sub>2</sub> x<sup>y<sub>z</sub>w</sup> <u>&amp;lt; < <i>", "", "  ", None, "</b>plain<b> bold", "a<b> </b>b &lt;b&gt;", " ".join(["<b>word</b>s and", "more<sup>2</sup>"] * 60)]


def test_rich_runs_and_lines(spark):
    df = spark.createDataFrame(list(enumerate(RICH)), "id long, rich string")
    got = {}
    for r in T.runs(df, ["id"], "rich").orderBy("id", "word", "run").collect():
        got.setdefault((r.id, r.word), []).append((r.text, r.flags))
    assert got == {(i, k): w for i, t in enumerate(RICH) if t for k, w in enumerate(_plain_runs(t))}
    of = lambda face: {c: w for w, cs in face.items() for c in cs}
    wide = lambda text, flags: sum(of(T.BOLD if "b" in flags.split(",") else T.PLAIN).get(c, T.OTHER) for c in text) / 1000 * (10 * T.SMALL if {"sup", "sub"} & set(flags.split(",")) else 10)
    lines = {(r.id, r.word): r.line for r in T.wrap_rich(df, ["id"], "rich", 10.0, 120.0).collect()}
    for i, t in enumerate(RICH):
        line, at = 0, 0.0
        for k, w in enumerate(_plain_runs(t) if t else []):
            size = sum(wide(*run) for run in w)
            if at and at + 2.78 + size > 120 + 1e-9:
                line, at = line + 1, 0.0
            at += size + (2.78 if at else 0)
            assert lines[i, k] == line
    assert max(lines.values()) > 5


def test_both_faces_cover_ascii():
    for face in (T.PLAIN, T.BOLD):
        listed = "".join(face.values())
        assert len(listed) == len(set(listed)) == 95 and set(map(ord, listed)) == set(range(32, 127))


def test_wrapped_lines(spark):
    text = "a quick brown fox " + "w" * 60 + " jumps over the lazy dog  été"
    rows = T.wrap(spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, t string"), ["id"], "t", 10.0, 60.0).orderBy("line").collect()
    assert " ".join(r.text for r in rows) == " ".join(text.split()) and [r.line for r in rows] == list(range(len(rows)))
    of = {c: w for w, cs in T.PLAIN.items() for c in cs}
    wide = lambda s: sum(of.get(c, T.OTHER) for c in s) / 100
    assert all(wide(r.text) <= 60 or " " not in r.text for r in rows)
    assert all(wide(a.text + " " + b.text.split()[0]) > 60 for a, b in zip(rows, rows[1:]))


def test_sidebar(spark):
    g = random.Random(11)
    text = lambda n: " ".join("".join(g.choice("abcdeilmw") for _ in range(g.randrange(1, 9))) for _ in range(n))
    notes = [(1, 3, 1, 300.0, text(9), None), (1, 1, 2, 290.0, text(40), ""), (1, 2, 3, 295.0, "not this", "<b>" + text(12) + "</b> <sup>2</sup>"), (1, 4, 4, 10.0, None, None)]
    notes += [(2, i, i, 100.0, text(60), None) for i in range(20)]
    df = spark.createDataFrame(notes, "page_num long, index long, number long, y double, text string, rich string")
    sizes = spark.createDataFrame([(1, 600.0, 800.0), (2, 1800.0, 900.0)], "page_num long, width double, height double")
    got = {(r.page_num, r["index"]): r for r in T.sidebar(df, sizes).collect()}
    of = lambda face: {c: w / 1000 for w, cs in face.items() for c in cs}
    for page, scale, wide, tall in ((1, 1.0, 600, 800), (2, 2.0, 1800, 900)):
        mine = sorted((n for n in notes if n[0] == page), key=lambda n: n[2])
        room = (200 - (10 + 22 + 6) - 10) * scale
        size = 8 * scale
        while True:
            heights = []
            for n in mine:
                words = [sum(of(T.BOLD if "b" in f.split(",") else T.PLAIN)[c] * (0.66 if "sup" in f else 1) for r, f in w for c in r) for w in (_plain_runs(n[5]) if n[5] else [[(w, "")] for w in (n[4] or "").split()])]
                lines, at = 0, None
                for w in words:
                    if at is None or at + (w + 0.278) * size > room + 1e-9:
                        lines, at = lines + 1, w * size
                    else:
                        at += (w + 0.278) * size
                assert size != got[page, n[1]].size or lines == got[page, n[1]].n_lines
                heights.append(max(22 * scale, lines * size * 1.3))
            if 36 * scale + sum(h + 8 * scale for h in heights) <= tall - 10 * scale or size <= 3:
                break
            size *= 0.9
        assert all(np.isclose(got[page, n[1]].size, size) and np.isclose(got[page, n[1]].height, h) and got[page, n[1]].x == wide + 38 * scale for n, h in zip(mine, heights))
        ys = [got[page, n[1]].y for n in mine]
        assert all(b - a >= h + 8 * scale - 1e-6 for a, b, h in zip(ys, ys[1:], heights)) and ys[0] >= 36 * scale - 1e-6
    assert got[1, 3].size == 8.0 and got[2, 0].size < 3.1 and got[1, 4].n_lines == 0


@pytest.mark.parametrize("hinted", [False, True])
def test_locate_claims_equals_a_plain_version(spark, hinted):
    g = random.Random(6)
    words = ["".join(g.choice("abcdefgh") for _ in range(g.randrange(2, 8))) for _ in range(40)]
    pages = {p: [g.choice(words) for _ in range(60)] for p in range(6)}
    pages[5] = pages[1][:30] + pages[2][30:]
    cut = lambda p, a, n: [w if g.random() > 0.15 else w[:-1] + "x" for w in pages[p][a : a + n]]
    claims = [(i, " ".join(cut(i % 6, g.randrange(40), g.randrange(2, 12))), g.choice([None, i % 6, (i + 1) % 6, 77])) for i in range(30)] + [(98, "single", None), (99, "", 1)]
    df = spark.createDataFrame([c if hinted else c[:2] for c in claims], "id long, claim string" + (", page_hint long" if hinted else ""))
    got = {r.id: (r.page_num, r.pos, r.score, r.ambiguous) for r in flows.locate_claims(df, spark.createDataFrame([(p, " ".join(w)) for p, w in pages.items()], "page_num long, text string")).collect()}

    def locate(claim, scope):
        ws, found = claim.split(), []
        for p in scope if len(ws) > 1 else ():
            for i in range(len(pages[p]) - len(ws) + 1):
                window = pages[p][i : i + len(ws)]
                if len(set(ws) & set(window)) >= max(1, int(len(set(ws)) * 0.5)) and (r := SequenceMatcher(None, " ".join(ws), " ".join(window)).ratio()) >= 0.55:
                    found.append((-r, p, i))
        if not found:
            return None
        best = min(found)
        rivals = [-r for r, p, i in found if p != best[1] or abs(i // 12 - best[2] // 12) * 14 > 30 or abs(i % 12 - best[2] % 12) * 40 > 60]
        return best[1], best[2], round(-best[0], 9), bool(rivals) and max(rivals) >= -best[0] - 0.05 and -best[0] > 0.6

    want = {}
    for i, claim, hint in claims:
        hit = locate(claim, [hint]) if hinted and hint in pages else None
        if hit := hit or locate(claim, sorted(pages)):
            want[i] = hit
    assert got == want and len(want) > 20


def test_boxes_of_pictures_equal_those_of_pixels(spark):
    from veranda.operators import layout as L

    g = np.random.default_rng(9)
    pages = [np.full((g.integers(1, 40), g.integers(1, 50)), g.integers(0, 256), np.uint8) for _ in range(12)]
    for i, a in enumerate(pages):
        y, x = g.integers(0, a.shape[0]), g.integers(0, a.shape[1])
        a[y : y + i * 3, x : x + i * 3] = g.integers(0, 256, a[y : y + i * 3, x : x + i * 3].shape)
    pixels = [(p, x, y, int(v)) for p, a in enumerate(pages) for (y, x), v in np.ndenumerate(a)]
    want = sorted(map(tuple, L.shrink_wrap(spark.createDataFrame(pixels, "page_num int, x int, y int, v int")).collect()))
    found = P.shrink_wrap(spark.createDataFrame([(p, *a.shape, a.tobytes()) for p, a in enumerate(pages)], "page_num int, h int, w int, px binary"))
    assert sorted(map(tuple, found.collect())) == want and any(r[5] for r in want) and not all(r[5] for r in want)


def test_boxes_of_texts_shuffle_nothing(spark):
    from veranda.queries import queries

    plan = queries()["ras15_agg7_shrink_wrap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # by pixels, each was a row


@pytest.mark.parametrize("what", ["patches", "strips"])
def test_pages_after_the_one_that_ends_a_search_are_not_read(spark, what):
    g = np.random.default_rng(11)
    a = np.kron(g.integers(0, 2, (40, 40)) * 200, np.ones((4, 4))).astype(np.uint8)
    frame = lambda pages: spark.createDataFrame(pages, PICTURE)
    whole = picture(1, 0, a)
    broken = picture(1, 1, a)
    broken = tuple(v[:-1] if isinstance(v, (bytes, bytearray)) else v for v in broken)  # can't be read
    if what == "patches":
        rows = spark.createDataFrame([(1, 0, 0, 80.0, 80.0)], "doc long, index long, page_num long, x double, y double")
        found = P.search_patches(rows, frame([whole]), frame([whole, broken]), spark.createDataFrame([(1, 0, 0)], "doc long, page_num long, home long")).first()
        assert (found.new_page, found.confident) == (0, True)
    else:
        rows = spark.createDataFrame([(1, 0, 0, 10.0, 50.0, 30.0, 58.0)], "doc long, index long, page_num long, x0 double, y0 double, x1 double, y1 double")
        found = P.search_strips(rows, frame([whole]), frame([whole, broken])).first()
        assert (found.new_page, found.found) == (0, True)
