"""Operators against brute force, exact round trips, and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ladderline.llm import decontaminate, jaccard, langid, lines, packing, pii, quality, queries, shared, tokens, toxicity, warc
from ladderline.llm import kernel as K

from .conftest import WORD


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t):
    w = re.findall(WORD, lower(t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(texts):
    sets, inv, parent, degree = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), {i: i for i in texts}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in inv[g])
        for g in sets[i]:
            inv[g].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                degree[i] += 1
                degree[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), degree[i]) for i in sets}


def test_jaccard_join_equals_brute_force(spark, documents, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.link(documents).collect()}
    assert got == brute_links(texts)


def variants(n, base):
    """Texts of many sizes and edits, so that small and large sets meet."""
    r = np.random.default_rng(3)
    out = {}
    for i in range(n):
        w = [f"t{k % 97}" for k in range(base, base + int(r.integers(4, 30)))] if i % 3 else [f"q{k}" for k in range(int(r.integers(1, 16)))]
        for _ in range(int(r.integers(0, 3))):
            w[int(r.integers(len(w)))] = f"e{int(r.integers(4))}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_jaccard_join_of_small_sets_and_split_families(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    texts = variants(240, 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.link(df).collect()}
    assert got == brute_links(texts)


@pytest.mark.parametrize("boundary", [0, 6, 12])
def test_every_linked_pair_shares_a_signature(boundary):
    r = np.random.default_rng(5)
    classes = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    for _ in range(400):
        n = int(r.integers(1, 40))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = a[r.random(len(a)) > 0.1]
        b = np.unique(np.concatenate([b, r.integers(0, 2**63, int(r.integers(0, 3))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(b) and 9 * same >= 4 * (len(a) + len(b)):
            keys, row = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), classes, boundary)
            assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "u long, v long")
    got = {r["doc_id"]: r["component"] for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, ""), (5, "other words stand here now"), (5, "other words stand here now"), (None, "a b c d e f")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 4, 5]


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, word("a", 30)), (1, word("b", 40)), (1, word("b", 40)), (2, word("a", 30) + " end"), (2, word("c", 20)), (3, word("c", 20)), (3, word("c", 20) + " end"), (4, ""), (4, None), (4, word("d", 9)), (5, word("d", 9)), (None, word("a", 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_set", F.lit("clash"))
    out = jaccard.one_of_each(df)
    got = sorted(((r["doc_id"] or 0), (r["text"] or "")[:2], len((r["text"] or "").split())) for r in out.collect())
    assert out.columns == df.columns
    assert got == [(0, "a0", 30), (1, "a0", 30), (1, "b0", 40), (2, "c0", 20), (4, "", 0), (4, "", 0), (4, "d0", 9)]


def mask(s):
    return tuple("*" if re.search("[0-9]", w) else lower(w) for w in re.findall(WORD, s))


def brute_lines(texts):
    """The text and count of dropped lines of each document, by the definition of a template."""
    docs, rows = defaultdict(set), Counter()
    for i, t in texts.items():
        found = {mask(s) for s in (t or "").split("\n")} - {()}
        for m in found:
            docs[m].add(i)
            rows[m] += 1
    leaf, owner = defaultdict(list), {}
    for m in docs:
        leaf[(len(m), m[:3])].append(m)
    for m in docs:
        owner[m] = min(docs[m])
        if len(m) < lines.MIN_WORDS:
            if rows[m] < lines.SHORT_ROWS:
                owner[m] = None
            continue
        wild = len(m) - int(np.ceil(0.8 * len(m) - 1e-9))
        edges = np.linspace(3, len(m), wild + 2).astype(int).tolist() if wild else []
        for a, b in zip(edges, edges[1:]):
            alike = [o for o in leaf[(len(m), m[:3])] if o[a:b] == m[a:b]]
            first = min(min(docs[o]) for o in alike)
            tops = [o for o in alike if min(docs[o]) == first]
            for top in tops[:1] if len(tops) == 1 else []:
                if top != m and sum(x == y for x, y in zip(top, m)) >= 0.8 * len(m):
                    owner[m] = min(owner[m], first)
    out = {}
    for i, t in texts.items():
        left = [s for s in (t or "").split("\n") if not mask(s) or owner[mask(s)] in (None, i)]
        out[i] = ("\n".join(left), (t or "").count("\n") + 1 - len(left))
    return out


def test_line_dedup_equals_brute_force(spark, documents, texts):
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.deduplicated(documents, ["doc_id"]).collect()}
    want = brute_lines(texts)
    # where two lines of the first document of a run tie, a hash decides
    assert sum(got[i] != want[i] for i in got) <= 0.01 * len(got) and sum(n for _, n in want.values()) > 50


def test_line_templates_equal_brute_force_on_edited_lines(spark):
    r, texts = np.random.default_rng(17), {}
    bases = [[f"b{k}x{j}" for j in "abcdefghijklmnopqrstuvwxyz"[:n]] for k, n in enumerate((4, 5, 6, 9, 12, 26))]
    for i in range(300):
        w = list(bases[int(r.integers(len(bases)))])
        for _ in range(int(r.integers(0, max(1, len(w) // 3)))):
            w[int(r.integers(3, len(w)))] = "edit" + "abcdefgh"[int(r.integers(8))] + "z" * int(r.integers(40))
        texts[i] = " ".join(w) + f"\nown line number{'q' * (i + 1)} of this one"
    got = {x["doc_id"]: (x["text"], x["n_dropped"]) for x in lines.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == brute_lines(texts) and sum(n for _, n in got.values()) > 200


def test_short_lines_recur_from_some_rows_on(spark):
    rows = [(i, f"Read more\nline of its own{'x' * i}\nOnce") for i in range(lines.SHORT_ROWS)] + [(90, "Twice here\nother"), (91, "Twice here")]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[0] == rows[0][1] and got[1] == "line of its ownx" and got[90] == rows[-2][1] and got[91] == "Twice here"


def test_rows_of_one_id_are_one_document_for_lines(spark):
    rows = [(1, "a line of five words\nmine"), (1, "a line of five words\nother text"), (2, "a line of five words\nthird"), (2, "no such line in here"), (None, "a line of five words")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect())
    assert got == [(0, "a line of five words"), (1, rows[0][1]), (1, rows[1][1]), (2, "no such line in here"), (2, "third")]


def test_fragments_of_copies_go(spark):
    shared_lines = "\n".join(f"shared line with tag {'abcdefgh'[k]}{'y' * k} in it" for k in range(8))
    rows = [(1, shared_lines), (2, shared_lines + "\nand a tail"), (3, shared_lines + "\n" + " ".join(f"w{'z' * k}" for k in range(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: (r["text"].split("\n")[-1][:5], r["n_words"], r["n_chars"] == len(r["text"])) for r in lines.clean(df).collect()}
    assert got == {1: ("share", "clash", True), 3: ("w wz ", "clash", True)}


def test_templates_generalise_fields(spark):
    rows = [(1, "user 17 logged in from host alpha today\nkeep this line of mine"), (2, "user 99 logged in from host beta today\nand this line is my own"), (3, "user 5 walked out of the old house\nthird")]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: rows[0][1], 2: "and this line is my own", 3: rows[2][1]}


def test_contamination_equals_brute_force(spark, data, documents, texts):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    words = {b: lower(t).split() for b, t in bench.items()}
    grams = defaultdict(set)
    for b, w in words.items():
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].add(b)
    want = {}
    for i, t in texts.items():
        w, seen = lower(t).split(), defaultdict(set)
        for k in range(len(w) - 7):
            for b in grams.get(tuple(w[k : k + 8]), ()):
                seen[b].add(tuple(w[k : k + 8]))
        want[i] = sorted(b for b, v in seen.items() if len(v) >= min(6, len(words[b]) - 7))
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.flagged(documents, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert got == want and any(want.values())


def test_reparameterised_questions_are_caught_if_slots_agree(spark):
    bench = spark.createDataFrame([(1, "A train with Anna leaves at 30 km per hour and meets Berta after 45 minutes of travel near the old bridge")], "item_id long, text string")
    docs = [(1, "so: a train with Carla leaves at 77 km per hour and meets Dora after 12 minutes of travel near the old bridge"), (2, "A TRAIN WITH ANNA LEAVES AT 30 KM PER HOUR AND MEETS BERTA AFTER 45 MINUTES OF TRAVEL NEAR THE OLD BRIDGE!"), (3, "a train with nothing else in common is not the question that was asked before"), (4, None)]
    got = {r["doc_id"]: (r["contaminated"], r["reparameterised"]) for r in decontaminate.flagged(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    out = []
    for rank, (k, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda m=m: all(int(q) <= 255 for q in m.group().split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[k]():
                out.append((m.start(), rank, m.end(), k))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_personal_data_equals_the_patterns(spark, documents, texts):
    odd = {-1: "..a@b.c.@d.e x_a@b.co_x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 99999999999.1.1.1", -2: "+1 (766) 555-2373 +12 ++1234567890- 4111-1111-1111-1111 é😀 x@y.zz 0000 0000 0000 0000", -3: ""}
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    every = texts | odd
    for r in pii.find_spans(df).collect():
        want = base_spans(every[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert set(want) <= set(r["spans"].split(","))
    plan = pii.find_spans(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_added_spans_and_redaction(spark):
    df = spark.createDataFrame([(1, 'phone (212) 555-1234, ssn 123-45-6789, token = "91c7a42bb9137a0ce7e953ef6959c77215d0cbdf" on 2024-01-02'), (2, "order 12345678 of 2024-01-02")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(df).collect()}
    assert {s.split(":")[0] for s in got[1].split(",")} == {"phone", "id_number", "secret"} and got[2] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df.join(pii.find_spans(df), "doc_id")).collect()}
    assert "[PHONE]" in clean[1] and "555" not in clean[1] and clean[2] == "order 12345678 of 2024-01-02"


def planted(n):
    """Sentences of another make than the training templates, each with its kind and the value in it, and sentences without any."""
    r = np.random.default_rng(23)
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    pick = lambda *v: v[int(r.integers(len(v)))]
    word = lambda: pick("river", "Haus", "petite", "mañana", "under", "Straße", "bonjour", "lumière", "calle", "winter")
    code = lambda k, a="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(a[int(x)] for x in r.integers(0, len(a), k))
    out = []
    for _ in range(n):
        out += [
            ("email", v := f"{word().lower()}{num(2)} (at) {pick('posteo', 'orange', 'web')} (dot) {pick('de', 'com', 'org')}".replace("ñ", "n").replace("ß", "ss").replace("è", "e"), f"Please get in touch with us: {v}, {word()}."),
            ("phone", v := f"({num(3)}) {num(3)}-{num(4)}", f"{word()} {word()}, give her a ring on {v} tonight"),
            ("phone", v := f"{num(3)}-{num(3)}-{num(4)}", f"You can call our office: {v}."),
            ("id_number", v := f"{num(3)}-{num(2)}-{num(4)}", f"His SSN, {v}, was printed on the {word()}"),
            ("iban", v := f"{pick('DE', 'NL', 'FR')}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", f"Überweisung an {v} bis Montag"),
            ("secret", v := f'token = "{code(40, "0123456789abcdef")}', f'{word()} {word()} {v}" {word()}'),
            ("secret", v := f"api_key={code(32)}", f"export {v} && run {word()}"),
            ("ipv6", v := ":".join(code(4, "0123456789abcdef") for _ in range(8)), f"{word()} reached {v} after {num(2)} ms"),
            (None, "", f"{word()} on {pick('12', '03')}/{num(2)}/20{num(2)} and again {word()}"),
            (None, "", f"{word()} sold {num(9)} units of article {num(12)}"),
            (None, "", f"{word()} met {word()} at the {word()} . {word()}"),
            (None, "", f"see ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)} for {word()}"),
        ]
    return out


def test_added_spans_on_sentences_of_another_make(spark):
    rows = planted(60)
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in pii.find_spans(df).collect()}
    hit, every, false = Counter(), Counter(), 0
    for i, (kind, value, text) in enumerate(rows):
        if kind is None:
            false += bool({":".join(x) for x in got[i]} - set(base_spans(text)))  # base spans are fixed: one in ten numbers passes as a card
            continue
        every[kind] += 1
        start = text.index(value)
        hit[kind] += any(int(a) <= start and int(b) >= start + len(value.strip()) - 1 for k, a, b in got[i])
    recall = {k: hit[k] / every[k] for k in every}
    print("recall", recall, "false", false)
    assert min(recall.values()) >= 0.9, recall
    assert false <= 0.03 * sum(k is None for k, _, _ in rows)


def test_many_matches_and_overlaps(spark):
    """More than a run of matches, and base spans that overlap one another and candidates."""
    r = np.random.default_rng(3)
    parts = []
    for k in range(1500):
        parts.append(("a%d@b.co" % k, "1.2.3.%d" % (k % 300), "bob@1.2.3.4", "+1 (766) 555-2373", "4111 1111 1111 1111", "phone (212) 555-1234", "+4111111111111111", "é😀 x", "ssn 123-45-6789")[int(r.integers(9))])
    text = " ".join(parts)
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = base_spans(text)
    assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and len(want) > 2 * pii.RUN
    added = sorted((int(a), int(b)) for k, a, b in (s.split(":") for s in set(row["spans"].split(",")) - set(want)))
    assert len(added) == row["n_added"] >= parts.count("phone (212) 555-1234") + parts.count("ssn 123-45-6789")
    every = sorted([*((int(a), int(b), 0) for _, a, b in (s.split(":") for s in want)), *((a, b, 1) for a, b in added)])
    end, kind = 0, 0
    for a, b, mine in every:
        assert a >= end or not (mine or kind)
        end, kind = max(end, b), mine
    clean = pii.redacted(spark.createDataFrame([(1, text, row["spans"])], "doc_id long, text string, spans string")).first()["text"]
    assert "@" not in clean and "😀" in clean and "123-45" not in clean


def test_redaction_of_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "write bob@1.2.3.4 now please"), (2, None), (3, "1.2.3.4")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df.join(pii.find_spans(df), "doc_id")).collect()}
    assert got == {1: "write [EMAIL] now please", 2: "", 3: "[IP]"}


def features_of(text, learned, n_toxic, n_other):
    """The features of one text, byte by byte and word by word."""
    isalnum = lambda b: chr(b).isalnum() and b < 128 or b > 127
    isletter = lambda b: isalnum(b) and not 48 <= b <= 57
    fold = lambda bs: bytes(b + 32 if 65 <= b <= 90 else b for b in bs)
    leet = dict(zip(b"0134578@$", b"oieastbas", strict=True))
    sets = {k: {w.encode() for w in v} for k, v in (("insult", toxicity.INSULTS), ("threat", toxicity.THREATS), ("profanity", toxicity.PROFANITY), ("you", toxicity.YOU))}
    cut = sets["insult"] | sets["profanity"] | {(w[:i] + w[i + 1 :]).encode() for w in toxicity.INSULTS + toxicity.PROFANITY if len(w) > 4 for i in range(1, len(w) - 1)}
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    plain = [fold(b for b in w if isletter(b)) for w in words]
    n, size = max(1, len(words)), max(1, len(data))
    mixed, hidden, stretched, shouted = [], [], [], []
    for w, p in zip(words, plain, strict=True):
        at = [i for i, b in enumerate(w) if isletter(b)]
        mixed.append(bool(at) and any(not isletter(b) for b in w[at[0] : at[-1]]))
        seen = bytes(leet.get(b, b) for b in fold(b for b in w if isletter(b) or b in leet))
        hidden.append(mixed[-1] and p not in sets["insult"] and (seen in sets["insult"] or p in cut))
        stretched.append(any(w[i] == w[i + 1] == w[i + 2] and isletter(w[i]) for i in range(len(w) - 2)))
        ascii_letters = re.findall(rb"[A-Za-z]", w)
        shouted.append(len(ascii_letters) > 2 and all(c.isupper() for c in ascii_letters))
    bad = [p in sets["insult"] or h for p, h in zip(plain, hidden, strict=True)]
    you = [i for i, p in enumerate(plain) if p in sets["you"]]
    near = sum(b and any(abs(i - j) <= toxicity.NEAR for j in you) for i, b in enumerate(bad))
    odds = {w: np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1)) for w, (a, b) in learned.items() if a >= toxicity.LEARNED_ROWS - 1}
    odds = {w: o for w, o in odds.items() if o >= toxicity.LEARNED_ODDS}
    hits = [p for p in plain if p in odds]
    letters = sum(map(isletter, data))
    return [np.log1p(len(words)), sum(bad), sum(bad) / n, len({p for p in plain if p in sets["insult"]}), sum(p in sets["threat"] for p in plain) / n, sum(p in sets["profanity"] for p in plain) / n, near, len(you) / n, sum(65 <= b <= 90 for b in data) / max(1, letters), sum(shouted) / n, sum(not isalnum(b) and b not in b" \t\n\v\f\r" for b in data) / size, data.count(b"!") / size, sum(mixed) / n, sum(hidden), sum(stretched) / n, len(set(hits)), len(hits) / n, sum(odds[w] for w in set(hits)), max((odds[w] for w in hits), default=0)]


def test_toxicity_features_by_brute_force(documents):
    """Every feature by a second way, over texts side by side in one batch, so that none leaks into its neighbour."""
    made = ["you aa", "a idiot", "", "  \n", "YOU are an 1d10t, a m.o.r.o.n and a l-o-s-e-r!!", "sooo STUPID ... you", "you one two three four five idiot", "you one two three four idiot", "ÉÉÉ Imbécile dégueulasse tú", "m0ron id1ot $cum @sshole f4ilure", "x" * 5000 + "! " * 3, "7 88 999 $$$ ---", "KILL them, kill THEM. hAte", "idiot idiot moron you", "qwzx qwzx zork", "you"]
    texts = made + [r["text"] or "" for r in documents.select("text").collect()]
    learned = {b"qwzx": (9, 0), b"zork": (3, 40), b"idiot": (30, 1), b"the": (50, 50), b"rare": (2, 0)}
    lexicon = toxicity.Lexicon(np.array([K.word_hash(w) for w in learned], np.uint64), *(np.array([v[i] for v in learned.values()]) for i in (0, 1)), 60, 90)
    rows = []
    for _, data, offsets in K.slices(pa.array(texts, pa.string())):
        rows.extend(toxicity.features(data, offsets, lexicon))
    assert len(rows) == len(texts)
    for text, got in zip(texts, rows, strict=True):
        want = features_of(text, learned, 60, 90)
        assert np.allclose(got, want), (text[:80], [(k, g, w) for k, g, w in zip(toxicity.NAMES, got, want, strict=True) if not np.isclose(g, w)])


def test_token_files_of_rows_that_share_an_id(spark):
    """Texts of one id are written in an order of their own, not in the order in which they are read."""
    rows = [(k % 3 if k % 5 else None, f"text {k % 11} of its own " * (k % 4)) for k in range(200)]
    made = []
    for n, given in enumerate((rows, rows[::-1], rows[70:] + rows[:70])):
        df = spark.createDataFrame(given, "doc_id long, text string").repartition(n + 1)
        manifest = tokens.write_token_files(df, shared.new_folder(spark, "tied"), queries.vocabulary("word_bpe_49k.json"), 1)
        made.append(sorted(tuple(r) for r in tokens.read_token_files(spark, manifest).select("start", "n_tokens", "ids_crc32").collect()))
    assert made[0] == made[1] == made[2] and len(made[0]) == 200


def test_toxicity_on_the_held_out_third(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    pairs = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9


@pytest.fixture(scope="module")
def more(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages")}


def test_languages_of_documents_that_did_not_train(spark, more):
    docs = more["documents"].withColumn("truth", F.col("lang"))
    model = langid.train(docs.filter("doc_id % 3 = 0").select("doc_id", "text", "lang"))
    rows = langid.classify(docs.filter("doc_id % 3 <> 0").drop("lang"), ["truth"], model).collect()
    assert np.mean([r["language"] == r["truth"] for r in rows]) > 0.98 and np.mean([r["accepted"] for r in rows]) > 0.98
    assert all(r["declared_lang"] is None for r in rows)


def stated_otherwise(pages, share):
    """Pages whose markup states another language on some rows, with the one it stated before."""
    truth = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    wrong = F.when(truth == "de", "fr").otherwise("de")
    other = F.expr(f"pmod(xxhash64(page_id), 100) < {100 * share}")
    html = F.when(other, F.regexp_replace("html", F.lit('<html lang="[a-z]+"'), F.concat(F.lit('<html lang="'), wrong, F.lit('"')))).otherwise(F.col("html"))
    return pages.select("page_id", "url", truth.alias("truth"), html.alias("html"))


@pytest.mark.parametrize("case", ["as stated", "a third wrong", "none stated", "hosts unseen"])
def test_languages_of_pages(spark, more, case):
    model = langid.train(more["documents"].select("doc_id", "text", "lang"))
    pages = stated_otherwise(more["pages"], 0.33 if case == "a third wrong" else 0)
    if case == "none stated":
        pages = pages.withColumn("html", F.regexp_replace("html", '<html lang="[a-z]+"', "<html"))
    if case == "hosts unseen":
        pages = pages.withColumn("url", F.concat(F.lit("http://h"), "page_id", F.lit(".example.com/x")))
    rows = langid.classify(langid.of_markup(pages, ["page_id", "truth"]), ["truth"], model, "declared", "url", "url").collect()
    assert np.mean([r["language"] == r["truth"] for r in rows]) > 0.95
    if case == "a third wrong":
        assert np.mean([r["declared_lang"] == r["truth"] for r in rows]) < 0.75


def test_other_evidence_decides_where_the_text_is_short(spark, more):
    """Twelve pages of one German host and suffix, one of them with a single ambiguous word."""
    docs = more["documents"]
    model = langid.train(docs.select("doc_id", "text", "lang"))
    german = [r["text"][:400] for r in docs.filter("lang = 'de'").limit(40).collect()]
    english = [r["text"][:400] for r in docs.filter("lang = 'en'").limit(40).collect()]
    rows = [(f"http://a{k % 4}.firm.de/{k}", f'<html lang="de">{t}') for k, t in enumerate(german)] + [(f"http://b{k % 4}.firm.uk/{k}", f'<html lang="en">{t}') for k, t in enumerate(english)]
    rows += [("http://a1.firm.de/short", '<html lang="de">in'), ("http://b1.firm.uk/short", '<html lang="en">in')]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["language"] for r in langid.classify(langid.of_markup(df, ["page_id"]), ["page_id"], model, "declared", "url", "url").collect()}
    assert (got[80], got[81]) == ("de", "en")


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 30_000
    rows = [(5, "http://a/ü b", "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 99), (8, "u", "x" * 99), (1, "u", big), (2, "u", big), (4, "u", None), (6, "u", ""), (None, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = warc.write_archives(pages.repartition(3), shared.new_folder(spark, "warc"), segment=4096)
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["complete"]) for r in warc.read_archives(spark, paths).collect())
    size = lambda t: len((t or "").encode())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    refers = {5: 3, 2: 1}
    assert got == sorted(((i or 0), size(h), sha(h), "revisit" if i in refers else "response", refers.get(i), True) for i, _, h in rows)


def test_a_missing_segment_is_told(spark):
    schema = warc.RECORD
    rows = [("segment", "r", 1, "", None, "r", 1, None, b"abc"), ("segment", "r3", 1, "", None, "r", 3, 9, b"ghi")]
    row = warc.reassembled(spark.createDataFrame(rows, schema)).first()
    assert row["complete"] is False and row["digest"] is None


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(texts, name):
    encode = tokens.Encoder(queries.vocabulary(name), memo=500)
    odd = ["a  b", "  lead", "trail  \n", "x\n\n\ny", "tab\tz \n q", "<|endoftext|> hi <|endoftext|>", "café ́x", "İstanbul ΑΣ ΣΑΣ. σ", "œuvre don't we'll I'M 'S", " nb sp   em", "a\x1cb !\x1c! \x85", "日本語 123 ½x²", "", " ", "\n", " a", "a \nb", "it's 's'", "ß ẞ ŉ", "x<|y", "᠎ a"]
    every = [*texts.values(), *odd]
    want = encode.whole.encode_batch(every, add_special_tokens=False)
    assert all(list(np.frombuffer(encode(t), "<u4")) == w.ids for t, w in zip(every, want))


def test_token_files_round_trip(spark, documents, texts):
    encode, start = tokens.Encoder(queries.vocabulary("word_bpe_49k.json")), 0
    manifest = tokens.write_token_files(documents, shared.new_folder(spark, "tokens"), queries.vocabulary("word_bpe_49k.json"), 1, sequence=64, batch=8)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_token_files(spark, manifest).collect()}
    for i in sorted(texts):
        ids = np.append(np.frombuffer(encode(texts[i]), "<u4"), 1).astype("<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    f = tokens.TokenFile(manifest[0]["path"])
    ids, mask = f.sequence_at(9)
    assert len(ids) == len(mask) == 64 and (ids == f.tokens(9 * 64, 10 * 64)).all() and mask.all()
    total = int(f.starts[-1])
    ids, mask = f.sequence_at((total - 1) // 64)
    assert mask.sum() == (total - 1) % 64 + 1 and (ids[mask == 1] == f.tokens(total - int(mask.sum()), total)).all() and f.filled() == total


def test_packing(spark, documents, texts):
    encode = tokens.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    rows = packing.pack_documents(documents, queries.vocabulary("byte_bpe_50k.json"), 2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids, at = np.append(np.frombuffer(encode(t), "<u4"), 2).astype("<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by_sequence) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1


@pytest.mark.parametrize("counts", [{}, {1024: 3}, {1: 5}, {600: 10, 424: 10}, {k: 1 + k % 3 for k in range(1, 1025)}, {512: 1}, {700: 1000, 300: 900, 24: 5000}])
def test_packing_uses_every_length_once(counts):
    used = Counter()
    for lengths, many in packing.pack_lengths(counts):
        assert sum(lengths) <= 1024 and many > 0
        for n in lengths:
            used[n] += many
    assert used == Counter(counts)


def test_packing_comes_from_configurations_and_is_near_the_bound():
    r = np.random.default_rng(11)
    sizes = np.concatenate([r.integers(1, 1024, 9000), r.integers(1, 200, 4000), (r.lognormal(5.8, 0.6, 9000)).astype(int).clip(1, 1023), np.full(3000, 1024)])
    counts, made = Counter(sizes.tolist()), []
    got = packing.pack_lengths(counts, by_method=made)
    total = sum(many for _, many in got)
    large = sum(many for lengths, many in got if lengths != (1024,) and max(lengths) >= 1024 * packing.SMALL)
    bound = counts[1024] + -(-sum(n * c for n, c in counts.items() if n != 1024) // 1024)
    assert made[0] > 0.9 * large and bound <= total <= 1.005 * bound


def test_places_take_the_longest_lengths_that_fit():
    bins, left = packing._Bins(1024), {600: 2, 420: 1, 424: 1, 300: 1}
    assert packing._substituted(bins, [610, 410], 5, left, sorted(left)) == 2
    assert sorted(bins.all()) == [((600, 420), 1), ((600, 424), 1)] and left == {300: 1}


def test_sequences_hold_their_pieces(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    parts = shared.written(packing.pieces(df, queries.vocabulary("byte_bpe_50k.json"), 2, with_ids=True), "pieces")
    row = packing.sequences(packing.pack(parts)).collect()
    assert len(row) == 1 and len(row[0]["ids"]) == sum(row[0]["lengths"]) == 7


def test_quality_counts_equal_brute_force(documents, texts):
    for r in quality.apply_rules(documents).collect():
        t = texts[r["doc_id"]]
        w, kept = re.findall(WORD, t), [s for s in t.split("\n") if re.search(WORD, s)]
        at, cover = defaultdict(list), set()
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        for places in at.values():
            if len(places) > 1:
                cover.update(x for k in places for x in range(k, k + 8))
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(kept) - len(set(kept)), len(cover))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in queries.op10_quality_rules(spark, folder).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert np.mean([kept[i] for i, q in labels if q == 1]) > 0.95 and np.mean([kept[i] for i, q in labels if q == 0]) < 0.1


def test_cascade_puts_cheap_rejecting_rules_first(spark):
    every, none = lambda x, rows: np.ones(len(rows)), lambda x, rows: np.zeros(len(rows))
    rules = (quality.Rule("never", none, 0.5, per_byte=1), quality.Rule("slow", every, 0.5, per_byte=9), quality.Rule("fast", every, 0.5, per_byte=2))
    text = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(26))
    docs = spark.createDataFrame([(i, text) for i in range(50)] + [(None, text), (99, "too short")], "doc_id long, text string")
    got = quality.estimates(docs, rules)
    assert [n for n, _, _ in got] == ["fast", "slow", "never"] and [s for _, _, s in got] == [1.0, 1.0, 0.0] and got[0][1] == 2 * len(text)
    assert [n for n, _, _ in quality.estimates(docs.limit(0), rules)] == ["never", "slow", "fast"]


def test_cascade_equals_every_rule_for_itself(documents, texts):
    share = lambda n, d: n / max(1, d)

    def verdicts(t):
        w, lines_ = re.findall(WORD, t), [s for s in t.split("\n") if re.search(WORD, s)]
        size = lambda v: len(v.encode())
        yield "symbols", share(sum(c in "#*$%&|<>" for c in t), len(w)) > 0.5
        yield "capitals", share(sum("A" <= c <= "Z" for c in t), sum(c.isascii() and c.isalpha() for c in t)) > 0.6
        yield "exclamations", share(t.count("!"), len(w)) > 0.5
        yield "no_letters", 1 - share(sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in v) for v in w), len(w)) > 0.4
        yield "long_words", share(sum(map(size, w)), len(w)) > 40
        yield "one_word", share(max(Counter(w).values(), default=0), len(w)) > 0.3
        yield "duplicate_lines", share(len(lines_) - len(set(lines_)), len(lines_)) > 0.5

    seen = Counter()
    for r in quality.apply_rules(documents).collect():
        bad = {n for n, v in verdicts(texts[r["doc_id"]]) if v}
        assert r["kept"] == (not r["base_failed"] and not bad)
        assert r["rejected_by"] in bad if not r["kept"] and not r["base_failed"] else r["rejected_by"] is None
        seen[r["rejected_by"]] += 1
    assert [r["rejected_by"] for r in quality.apply_rules(documents).collect()] == [r["rejected_by"] for r in quality.apply_rules(documents).collect()]
