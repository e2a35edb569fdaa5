"""Decontamination: classes of items, items full of numbers, and a second way to count."""

import re
import time
from collections import defaultdict

from ladderline.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def flags(spark, docs, items):
    out = decontaminate.flagged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return {r["doc_id"]: (r["item_ids"], r["n_items"], r["reparameterised"]) for r in out.collect()}


def question(a, b, c):
    return f"a farmer sells {a} red apples and buys {b} green pears at the market before he gives {c} of them to his old neighbour"


def test_items_of_one_template_are_a_class(spark):
    items = [(3, question(1, 2, 3)), (1, question(4, 5, 6)), (2, question(7, 7, 8)), (4, "something else that has ten words of its very own")]
    docs = [(1, question(9, 8, 7)), (2, question(4, 5, 6)), (3, question(5, 5, 1)), (4, question(7, 7, 8)), (5, "nothing here")]
    # with two equal values the second class is consistent as well as the first: one value meets one value
    assert flags(spark, docs, items) == {1: ([1], 2, True), 2: ([1], 2, False), 3: ([1, 2], 3, True), 4: ([1, 2], 3, True), 5: ([], 0, False)}
    got = {r["item_id"]: (r["class_id"], r["n_items"]) for r in decontaminate.members(spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {3: (1, 2), 1: (1, 2), 2: (2, 1), 4: (4, 1)}


def test_a_template_is_joined_as_a_class(spark):
    items = [(i, question(i, i + 5000, i + 9000)) for i in range(1000)]
    docs = [(i, question(i + 20_000, i + 1, 3)) for i in range(1500)]
    found = decontaminate.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    began = time.time()
    rows = found.collect()
    assert len(rows) == 1500 and {(r["item_id"], r["n_items"]) for r in rows} == {(0, 1000)}
    assert time.time() - began < 20


def test_items_full_of_numbers_are_found_with_other_values(spark):
    items = [(1, "Evaluate 12 + 4 * 40 - 6 + 27 * 2 please"), (2, "Work out 3 + 5 - 3 + 8 / 4 now")]
    docs = [
        (1, "quiz: evaluate 13 + 5 * 41 - 7 + 28 * 3 please, thanks"),
        (2, "evaluate 13 - 5 * 41 - 7 + 28 * 3 please"),
        (3, "Evaluate 12 4 40 6 27 2 please"),
        (4, "evaluate 12 + 4 * 40 - 6 + 27 * 2 please"),
        (5, "work out 9 + 1 - 9 + 2 / 6 now"),
        (6, "13 + 5 * 41 - 7 + 28 * 3"),
        (7, "evaluate 13 + 5 * 41 - 7 + 28 and nothing more"),
    ]
    got = flags(spark, docs, items)
    assert got == {1: ([1], 1, True), 2: ([], 0, False), 3: ([1], 1, False), 4: ([1], 1, False), 5: ([2], 1, True), 6: ([], 0, False), 7: ([], 0, False)}


def test_slots_that_clash_are_refused(spark):
    items = [(1, "Add 7 + 7 - 7 + 7 / 7 up again")]
    docs = [(1, "add 5 + 5 - 5 + 5 / 5 up again"), (2, "add 1 + 2 - 3 + 4 / 5 up again")]
    assert flags(spark, docs, items) == {1: ([1], 1, True), 2: ([], 0, False)}


def test_equal_items_are_one_class(spark):
    items = [(5, "short one"), (4, "Short one!"), (6, "one two three four five six seven eight nine"), (7, "one two three four five six seven eight nine"), (None, "short one"), (8, None), (9, "")]
    docs = [(1, "a short one"), (2, "say one two three four five six seven eight nine"), (3, ""), (None, "short one")]
    assert flags(spark, docs, items) == {1: ([4], 2, False), 2: ([6], 2, False), 3: ([], 0, False), None: ([], 0, False)}


def test_templates_equal_brute_force(spark):
    """Lower-case questions with numbers: windows, alignments and slots counted in plain Python, item by item."""
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice("bdfglnprtv") + r.choice("aeou") for _ in range(3)) for _ in range(30)]
    shapes = [[r.choice(vocabulary) if r.random() < 0.75 else None for _ in range(r.randint(9, 18))] for _ in range(12)]
    fill = lambda shape: " ".join(str(r.randint(1, 3)) if w is None else w for w in shape)
    items = [(i, fill(shapes[i % 12])) for i in range(60)]
    docs = [(i, " ".join([fill(r.choice(shapes)), r.choice(vocabulary), fill(r.choice(shapes))][: r.randint(1, 3)])) for i in range(150)]
    typed = lambda words: tuple("#" if re.search("[0-9]", w) else w for w in words)
    good = lambda w: sum(x == "#" for x in w) <= decontaminate.WINDOW - decontaminate.LITERALS
    want = defaultdict(set)
    for d, text in docs:
        w = text.split()
        for i, question_text in items:
            q = question_text.split()
            own = [k for k in range(len(q) - 7) if good(typed(q[k : k + 8]))]
            lines = defaultdict(set)
            for k in own:
                for j in range(len(w) - 7):
                    if typed(w[j : j + 8]) == typed(q[k : k + 8]):
                        lines[j - k].add(k)
            held = set()
            for shift, at in lines.items():
                pairs = {(q[k + x], w[k + shift + x]) for k in at for x in range(8) if typed(q[k : k + 8])[x] == "#"}
                if not pairs or len({o for o, _ in pairs}) >= decontaminate.CONSISTENT * len(pairs):
                    held |= at
            if own and len(held) >= min(decontaminate.WINDOWS, len(own)):
                want[d].add(i)
    frame = spark.createDataFrame(items, ITEMS)
    of = defaultdict(set)
    for row in decontaminate.members(frame).collect():
        of[row["class_id"]].add(row["item_id"])
    windowless = {i for i, t in items if not any(good(typed(t.split()[k : k + 8])) for k in range(len(t.split()) - 7))}
    got = {d: set().union(*(of[c] for c in ids)) - windowless if ids else set() for d, (ids, _, _) in flags(spark, docs, items).items()}
    assert got == {d: want[d] for d, _ in docs} and sum(len(v) for v in want.values()) > 100
