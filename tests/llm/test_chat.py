"""Chat windows against a plain version: budgets, the system turn, history, cuts by rank, odd turn numbers."""

import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("veranda.llm")
from veranda.llm import chat  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def write(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def plain(turns, budget, history, cells=chat.CELL):
    """(formatted, loss, repeated) of each window of one conversation's (role, text)."""
    n = [len(write(*t).encode()) for t in turns]
    start = [sum(n[:i]) for i in range(len(n))]
    system = turns[0] if turns[0][0] == "system" else None
    begins = []
    for i in range(len(turns)):
        if begins and start[i] // (cells * budget) == start[begins[-1]] // (cells * budget):
            b = begins[-1]
            room = budget - (0 if b == 0 else history + (n[0] if system else 0))
            if start[i] + n[i] - start[b] <= room:
                continue
        begins.append(i)
    out = []
    for b, e in zip(begins, [*begins[1:], len(turns)]):
        back = b
        while back > (1 if system else 0) and start[b] - start[back - 1] <= history:
            back -= 1
        back = min(back, b)
        parts = ([(system, False)] if system and b else []) + [(t, False) for t in turns[back:b]] + [(t, t[0] == "assistant") for t in turns[b:e]]
        text, loss = "", []
        for t, own in parts:
            w = write(*t)
            if own:
                at = len(text) + len(f"<|im_start|>{t[0]}\n")
                loss.append((at, at + len(t[1])))
            text += w
        out.append((text, loss, len(parts) - (e - b)))
    return out


def check(spark, conversations, budget=400, history=90, stretch=1 << 16, exact=True):
    rows = [(c, k, r, t) for c, (numbers, turns) in conversations.items() for k, (r, t) in zip(numbers, turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("system", F.lit("clash")).withColumn("part", F.lit("clash"))
    windows = chat.format_windows(df, budget, history, stretch).collect()
    for c, (_, turns) in conversations.items():
        own = sorted((w for w in windows if w.conv_id == c), key=lambda w: (w.part, w.cell, w.window))
        if exact:
            assert [(w.formatted, [tuple(s) for s in w.loss], w.repeated) for w in own] == plain(turns, budget, history)
        told = []
        for w in own:
            pieces = re.findall(r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", w.formatted)
            assert w.n_tokens == len(w.formatted.encode())
            assert w.n_tokens <= budget or len(pieces) == w.repeated + 1
            if told:  # the system turn, then what came just before
                lead = pieces[: w.repeated]
                if turns[0][0] == "system":
                    assert lead[0] == turns[0]
                    lead = lead[1:]
                assert told[len(told) - len(lead) :] == lead
            told += pieces[w.repeated :]
            assert [w.formatted[s["from"] : s["to"]] for s in w.loss] == [t for r, t in pieces[w.repeated :] if r == "assistant"]
        assert told == turns
    return windows


def talk(g, n, system=False):
    turns = [("system", "be kind")] if system else []
    return turns + [(("user", "assistant")[i % 2], f"{i} " + "wörd " * g.choice((0, 1, 3, 9, 30))) for i in range(n)]


def test_windows_equal_a_plain_version(spark):
    g = random.Random(4)
    many = {c: (range(n), talk(g, n - c % 2, c % 2 == 1)) for c, n in enumerate((1, 3, 40, 41, 300, 301))}
    many[10] = ([0, 1000, 2000, 10**12, 10**13], talk(g, 5))  # sparse numbers
    many[11] = (range(240, 280), talk(g, 40))
    check(spark, many)
    check(spark, {1: (range(30), talk(g, 29, True))}, budget=100, history=0)


def test_long_conversations_are_cut_by_rank(spark):
    g = random.Random(5)
    many = {1: (range(500), talk(g, 500)), 2: (range(300), talk(g, 299, True)), 3: (range(20), talk(g, 19, True)), None: (range(150), talk(g, 150))}
    windows = check(spark, many, stretch=60, exact=False)
    assert len({w.part for w in windows if w.conv_id == 1}) > 3
    later = [w for w in windows if w.conv_id == 2 and (w.part, w.cell, w.window) > min((x.part, x.cell, x.window) for x in windows if x.conv_id == 2)]
    assert later and all(w.formatted.startswith(write("system", "be kind")) and w.repeated >= 1 for w in later)
    assert any(w.repeated > 1 and w.cell == 0 and w.window == 0 for w in later)  # history goes over a cut


def test_equal_turn_numbers_are_split(spark):
    df = spark.range(400).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same words").alias("text"))
    windows = chat.format_windows(df, 400, 90, stretch=50)
    assert windows.select("part").distinct().count() > 3 and chat.read_windows(windows).first().n_turns == 400
    assert chat.read_turns(windows).where("role = 'user' and text = 'same words'").count() == 400
