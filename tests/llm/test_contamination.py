"""Re-parameterised questions: recall on generated ones, against every item held to every text word by word."""

import random
import re

import pytest

pytest.importorskip("docflow.llm")
from docflow.llm import contamination as C  # noqa: E402

TEMPLATES = (
    "{n} has {a} {thing} in the {place} and buys {b} more {thing} for {c} dollars each, so how much does {n} pay in all for the new {thing} of the week",
    "A train leaves {p} at {a} km an hour while {n} drives from {q} at {b} km an hour; after how many hours do the two of them meet on the long road",
    "dr {m} gave {n} {a} pills to take every {b} hours for the pain in the left knee, how long will the whole bottle of pills last",
    "The {place} sells {thing} in boxes of {a} pieces and {n} wants {b} pieces for the party on friday, how many boxes must be opened for all the guests",
)
NAMES, PLACES, THINGS = ["Alice", "Bob", "john", "mary", "Sarah", "peter", "Tom", "emma"], ["garden", "market", "kitchen", "office"], ["apples", "pencils", "oranges", "marbles"]
SPELLED = {3: "three", 4: "four", 6: "six", 8: "eight", 12: "twelve", 20: "twenty", 25: "twenty-five", 40: "forty", 60: "sixty"}


def number(rng):
    n = rng.choice([3, 4, 6, 8, 12, 20, 25, 40, 60, 1200, 4.5, 17, 90])
    return rng.choice([f"{n:,}", str(n), SPELLED.get(n, str(n)), f"{n:,.2f}"])


def made(rng, k, place, thing):
    return TEMPLATES[k].format(n=rng.choice(NAMES), m=rng.choice(["smith", "jones", "Brown"]), a=number(rng), b=number(rng), c=number(rng), p=rng.choice(["Paris", "Rome", "Oslo"]), q=rng.choice(["Berlin", "Madrid"]), place=place, thing=thing)


def test_recall(spark):
    rng = random.Random(11)
    kinds = [(k, p, t) for k in range(4) for p in PLACES for t in THINGS]
    items = [(i, made(rng, *kind)) for i, kind in enumerate(kinds)]
    filler = lambda: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(rng.randrange(5, 60)))
    docs = [(i, f"{filler()} {made(rng, *kind)} {filler()}") for i, kind in enumerate(kinds)] + [(1000 + i, filler()) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in C.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in got for i in range(len(kinds))) >= 0.9 * len(kinds)
    assert not any(d >= 1000 for d, _ in got)
    assert all(kinds[d][0] == kinds[i][0] for d, i in got)  # of another template never


def test_slots():
    c = lambda t: [("plain", "number", "name", "unit")[k] for k in C.Canonical(*text(t)).slot]
    assert c("pay 1,200.50 kg") == ["plain", "number", "unit"] and c("twenty-five of them") == ["number", "plain", "plain"] and c("two hundred five cats") == ["number", "plain"]
    assert c("dr smith met john") == ["plain", "name", "plain", "name"] and c("in 1990. 12 men") == ["plain", "number", "number", "plain"] and c("kg 5") == ["plain", "number"] and c("") == []


def text(t):
    import numpy as np

    data = np.frombuffer(t.encode(), np.uint8)
    return data, np.array([0, len(data)])


def canonical(t):
    """(template, words) of a text: the same placeholders, read word by word."""
    pieces = re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W_]+", t)
    out, held = [], []
    for k, w in enumerate(pieces):
        low, before = w.lower(), pieces[k - 1].lower() if k else ""
        slot = 1 if any(c.isdigit() for c in w) or low in C.NUMBERS else 3 if low in C.UNITS and out and out[-1] == "#1" else 2 if low != w[:1] + low[1:] or low in C.NAMES or before in C.TITLES else 0
        out.append(f"#{slot}" if slot else low)
        held.append(low)
    return out, held


def test_against_every_pair(spark):
    """Items that stand in a text whole, but for their slots, are found, and nothing is that shares too few words in place."""
    rng = random.Random(12)
    items = [(i, made(rng, i % 4, rng.choice(PLACES), rng.choice(THINGS))) for i in range(12)]
    docs = [(i, "so " + made(rng, i % 4, rng.choice(PLACES), rng.choice(THINGS)) + " end") for i in range(24)]
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in C.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in docs:
        for i, q in items:
            (a, _), (b, _) = canonical(t), canonical(q)
            same = max(sum(x == y for x, y in zip(a[s:], b)) for s in range(len(a)))  # noqa: B905
            if a[1 : 1 + len(b)] == b:
                assert (d, i) in got
            if same < 0.3 * len(b):
                assert (d, i) not in got


def test_rows_that_share_an_id(spark):
    items = spark.createDataFrame([(1, TEMPLATES[1].format(p="Paris", a=80, n="Bob", q="Rome", b=90)), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "nothing of it here"), (5, TEMPLATES[1].format(p="Oslo", a=30, n="Tom", q="Bonn", b=40)), (None, TEMPLATES[1]), (6, None)], "doc_id long, text string")
    got = C.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(5, 1)] and got[0]["coverage"] > 0.9
