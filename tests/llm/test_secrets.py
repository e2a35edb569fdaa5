"""Secret scan: base spans by another reading, added spans on strings the models never saw."""

import base64
import hashlib
import random
import re
import string

import pytest

from ladderline.llm import secrets

KEY = re.compile(r"(?i:password|passwd|secret|token|api_?key)")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def brute(text):
    """Base spans character by character."""
    text, out = text or "", []
    at = 0
    while at < len(text):
        m = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(k)].isascii() and text[at : at + len(k)].lower() == k), None)
        end = value = None
        if m:
            i = at + len(m)
            i += text[i : i + 1] in ("'", '"')
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] in (":", "="):
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ("'", '"') and bool(text[i : i + 1])
                value = i
                while i < len(text) and text[i] in VALUE:
                    i += 1
                end = i if i > value else None
        if end is None:
            at += 1
            continue
        if end - value >= 8:
            out.append((at, 0, end))
        at = end
    for kind, start, rest, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            i = at + len(start)
            while text.startswith(start, at) and i < len(text) and text[i] in rest:
                i += 1
            if i == at + len(start):
                at += 1
                continue
            if i - at >= least:
                out.append((at, kind, i))
            at = i
    return sorted(out)


def parsed(spans):
    return [(int(s), secrets.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))] if spans else []


def check(row, text):
    base, spans = brute(text), parsed(row["spans"])
    assert [s for s in spans if s[1] < 3] == base
    assert spans == sorted(spans)
    joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
    assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert [row["n_assign"], row["n_access"], row["n_hex"], row["n_random"]] == [sum(k == x for _, k, _ in spans) for x in range(4)]
    for s, k, e in spans:
        assert 0 <= s < e <= len(text or "")
        if k == 3:
            assert all(e <= a or s >= b for a, _, b in base)


@pytest.fixture(scope="module")
def model(documents):
    return secrets.train(documents)


def test_documents(documents, texts, model):
    rows = secrets.find_secrets(documents, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r["doc_id"]])
    assert sum(r["n_random"] for r in rows) <= 1, "prose holds no random strings"


HAND = [
    'TOKEN = "abcd1234efgh" and api_key:"x/y+z=w-v_u.t" apikey=short1 passwd : hunter22hunter22',
    "secret=token: abcdefghij and token=secret=abcdefgh1, token=\npassword  =  'longenough",
    "AKIA AKIAABC AKIAAKIAAKIAAKIA AKIA0123456789AB AKIA0123456789a",
    "ſecret=abcdefghij toKen=abcdefghij PASSWORD='éabcdefgh' passwoRD=abcdefghé",
    "😀" * 3 + "deadbeef" * 4 + " " + "deadbeef" * 3 + "DEADBEEF" * 5,
    'token="' * 500 + "x" * 20, "password" + " " * 5000 + "= " + "a" * 9, "", None,
]


def test_hand_made(spark, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HAND)], "doc_id long, text string")
    for r in secrets.find_secrets(df, model).collect():
        check(r, HAND[r["doc_id"]])


def unseen(n=300):
    """Keys in forms that no training sample has."""
    rng = random.Random(99)
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    word = string.ascii_letters + string.digits
    makes = (lambda: "ghp_" + pick(word, 36), lambda: "sk_live_" + pick(word, 24), lambda: base64.b64encode(rng.randbytes(30)).decode(), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(word, 24), lambda: pick(string.ascii_lowercase + string.digits, 25), lambda: base64.b32encode(rng.randbytes(20)).decode())
    return [makes[i % len(makes)]() for i in range(n)]


CLEAN = ["getUserAccountSettings", "application/x-www-form-urlencoded", "internationalization", "Donaudampfschifffahrtsgesellschaft", "max_number_of_retries", "configuration-manager-service", "AbstractSingletonProxyFactoryBean", "2024-01-15-weekly-report", "src/main/java/resources", "HTTP_REQUEST_HEADER_FIELDS", "anticonstitutionnellement", "----------------------------", "====================", "aaaaaaaaaaaaaaaaaaaaaaaa", "4111111111111111", "http_status_code_404_handler", "responsabilidades", "users/profile-pictures/2023/summer", "Content-Type_application-json", "rows_2021_to_2023_v2", "Geschwindigkeitsbegrenzung"]


def test_unseen_keys_and_identifiers(spark, model):
    """At least 0.97 of unseen keys found, no ordinary identifier."""
    keys = unseen()
    rows = [(i, f"the value {k} was in a log") for i, k in enumerate(keys)]
    rows += [(10_000 + i, f"see {c} for more") for i, c in enumerate(CLEAN)]
    found = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit = sum(any(k == 3 for _, k, _ in parsed(found[i]["spans"])) or found[i]["n_hex"] > 0 for i in range(len(keys)))
    assert hit >= 0.97 * len(keys), hit
    assert [c for i, c in enumerate(CLEAN) if found[10_000 + i]["spans"]] == []


def test_model_is_a_distribution(model):
    import numpy as np

    p = np.exp(secrets.markov(["abcabcabc", "xyz"]))
    assert np.allclose(p.sum(1), 1)
    assert model.scores("q8Zx0vK2pL7mW4tR")[0] > model.scores("configurationmanager")[0]


def test_sample_does_not_depend_on_partitions(documents, model):
    import numpy as np

    again = secrets.train(documents.repartition(9))
    assert (again.total, again.mean) == (model.total, model.mean)
    assert np.array_equal(again.ratio, model.ratio)


def test_odd(odd, model):
    """Nulls, empty and very long texts, repeats, clashing columns, no rows."""
    rows = secrets.find_secrets(odd, model).collect()
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        check(r, text[r["doc_id"]])
    assert secrets.find_secrets(odd.limit(0)).collect() == []
