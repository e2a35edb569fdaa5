"""Personal data: fixed base formats, and further spans chosen by boosted trees over candidates.

Main path: DataFrame functions only. Base matches of a kind are found leftmost, without overlap: the
matches and the text between them give the places. High-recall generators propose further,
overlapping spans; trees over format and context features (the text on both sides) score them, and
thresholds that are calibrated for each generator choose. Of chosen spans that overlap the better
one stays, and none that overlaps a base span. Folds over many spans go in runs of RUN, and the
choice is one sweep in order of place, so the work on a text grows with its length.

No table has labels of spans, so the trees learn from a bounded list of invented examples (EXAMPLES
a template, at most), written by a seeded generator and scored through the same SQL. Calibration
and thresholds use scores of examples whose whole template the scoring trees have not seen.

Null text: as an empty text, without spans. Repeated rows: a row each. Null doc_id stays null.
Places count code points, the end exclusive. Other columns are ignored. An empty table: no rows.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

EXAMPLES, FOLDS = 16, 4
#: Entries of an array that one fold goes over; longer ones are folded run by run.
RUN = 256
KINDS = ("email", "ip", "card", "phone", "id_number", "iban", "secret", "ipv6")
_LOCAL = "A-Za-z0-9._%+-"
#: The base formats. Possessive, and begun where a run begins or the last match ended: the same
#: leftmost matches as the plain patterns, without their quadratic retries.
BASE = {
    "email": ("instr(t, '@') > 0", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++"),
    "ip": ("t rlike '[.][0-9]'", r"(?:(?<![0-9])|\G)[0-9]++(?:[.][0-9]++){3}"),
    "card": ("t rlike '[0-9][ -]?[0-9]'", r"[0-9](?:[ -]?[0-9])++"),
    "phone": ("instr(t, '+') > 0", r"[+][0-9][ ().0-9-]+[0-9]"),
}
#: The generators: much is proposed, little is taken.
PROPOSED = {
    "email": ("instr(t, '@') > 0 or t rlike '(?i)[(\\\\[ ]at[)\\\\] ]'", rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:@|[(\[] ?at ?[)\]]| at ) ?[A-Za-z0-9-]++(?: ?(?:[.]|[(\[] ?dot ?[)\]]| dot ) ?[A-Za-z0-9-]++)++"),
    "number": ("t rlike '[0-9][ ().0-9/-]{5}'", r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\/-]{0,2}[0-9]){6,}+"),
    "formed": ("t rlike '[0-9]{3}[). -]'", r"(?<![0-9A-Za-z])(?:[(][0-9]{3}[)] ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z])"),
    "iban": ("t rlike '[A-Z]{2}[0-9]{2}'", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}+)?"),
    "secret": ("t rlike '[A-Za-z0-9_/+=-]{16}'", r"(?i:token|secret|api[_-]?key|passw(?:or)?d|bearer)['\x22]? ?[:=]? ?['\x22]?[A-Za-z0-9_\/+=-]{16,}+"),
    "ipv6": ("t rlike '[0-9A-Fa-f]:[0-9A-Fa-f]'", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
}
FEATURES = {
    "generator": "x.g",
    "size": "length(x.v)",
    "digits": "length(regexp_replace(x.v, '[^0-9]', ''))",
    "letters": "length(regexp_replace(x.v, '[^A-Za-z]', ''))",
    "separators": "length(regexp_replace(x.v, '[^ ().:/-]', ''))",
    "groups": "size(split(x.v, '[ ().:/-]+'))",
    "plus": "int(startswith(x.v, '+'))",
    "brackets": "int(instr(x.v, '(') > 0)",
    "at_sign": "int(instr(x.v, '@') > 0)",
    "written_dot": "int(x.v rlike '(?i)[ (\\\\[]dot[ )\\\\]]')",
    "date": "int(x.v rlike '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})')",
    "three_two_four": "int(x.v rlike '^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$')",
    "phone_groups": "int(x.v rlike '^[+(]?[0-9]{2,4}[)]?[ .-]+[0-9]{2,4}[ .-][0-9]{3,4}')",
    "slash": "int(instr(x.v, '/') > 0)",
    "mixed": "int(x.v rlike '[A-Za-z][0-9]' and x.v rlike '[0-9][A-Za-z]')",
    "phone_word": "int(x.l rlike '(?i)(?<![a-z])(phone|tel|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono|anruf)(?![a-z])')",
    "card_word": "int(x.l rlike '(?i)(card|visa|mastercard|amex|karte|carte|tarjeta)')",
    "id_word": "int(x.l rlike '(?i)(ssn|social|passport|licen[cs]e|ident|ausweis|dni|nir)')",
    "mail_word": "int(x.l rlike '(?i)(?<![a-z])(e-?mail|mail|contact|write|reach|kontakt|correo)(?![a-z])')",
    "order_word": "int(x.l rlike '(?i)(order|invoice|isbn|issn|part|item|page|version|room|model|no[.]|nr[.]|#)')",
    "money": "int(x.l rlike '[$€£] ?$')",
    "host_word": "int(x.l rlike '(?i)(host|server|address|adresse|from|ping|route|ipv6|dns)')",
    "bank_word": "int(x.l rlike '(?i)(iban|bank|account|konto|compte|cuenta|transfer|pay)')",
    "secret_word": "int(x.v rlike '(?i)^(token|secret|api|pass|bearer)')",
    "iban_land": "int(x.v rlike '^(AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)[0-9]{2}')",
    "set_to": "int(x.v rlike '[:=]')",
    "kinds": "int(x.v rlike '[0-9]') + int(x.v rlike '[A-Z]') + int(x.v rlike '[a-z]')",
    "underscores": "length(regexp_replace(x.v, '[^_-]', ''))",
    "hex_groups": "int(x.v rlike '^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$')",
    "ends_in_domain": "int(x.v rlike '(?i)[a-z]{2}[^a-z]*([.]|dot)[^a-z]*(com|org|net|edu|de|fr|es|io|co|info)$')",
    "more_digits": "int(x.r rlike '^[ .,/-]{0,2}[0-9]')",
    "unit_after": "int(x.r rlike '^ ?(%|€|[$]|(?i:eur|usd|km|kg|mm|cm|gb|mb|units|items|pages|copies|points|votes|people|times))')",
    "quote_after": "int(startswith(x.r, chr(34)) or startswith(x.r, chr(39)))",
}


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _found(when: str, pattern: str, what: str) -> str:
    call = {"m": f"regexp_extract_all(t, {_raw(pattern)}, 0)", "g": f"split(t, {_raw(pattern)}, -1)"}[what]
    return f"CASE WHEN {when} THEN {call} ELSE cast(array() as array<string>) END"


_SPANS = "array<struct<a: int, b: int, v: string, l: string, r: string>>"
#: Characters of the text before and after a match that count as its context; never beyond the match before or after.
BEFORE, AFTER = 24, 16


def _bound(value: str, name: str, body: str) -> str:
    """The body with the value under this name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _runs(name: str) -> str:
    """An array in runs of RUN."""
    return f"transform(sequence(0, (size({name}) - 1) div {RUN}), c -> slice({name}, c * {RUN} + 1, {RUN}))"


def _located(name: str) -> str:
    """The matches m_name with their places and contexts, by the gaps g_name between them and h_name after them: places inside each run, then where each run begins."""
    g, m, h = f"x.g_{name}", f"x.m_{name}", f"x.h_{name}"
    piece = f"named_struct('a', s.p + length({g}), 'b', s.p + length({g}) + length({m}), 'v', {m}, 'l', right({g}, {BEFORE}), 'r', left(coalesce({h}, ''), {AFTER}))"
    step = f"named_struct('p', s.p + length({g}) + coalesce(length({m}), 0), 'o', CASE WHEN {m} IS NULL THEN s.o ELSE concat(s.o, array({piece})) END)"
    inside = f"transform(z, k -> aggregate(k, named_struct('p', 0, 'o', cast(array() as {_SPANS})), (s, x) -> {step}))"
    begins = "aggregate(w, named_struct('p', 0, 'o', cast(array() as array<int>)), (s, x) -> named_struct('p', s.p + x.p, 'o', concat(s.o, array(s.p)))).o"
    moved = "flatten(transform(w, (k, i) -> transform(k.o, x -> named_struct('a', x.a + q[i], 'b', x.b + q[i], 'v', x.v, 'l', x.l, 'r', x.r))))"
    zipped = f"arrays_zip(g_{name}, m_{name}, h_{name})"
    found = _bound(zipped, "y", _bound(_runs("y"), "z", _bound(inside, "w", _bound(begins, "q", moved))))
    return f"CASE WHEN size(m_{name}) = 0 THEN cast(array() as {_SPANS}) ELSE {found} END"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_TWICE = "cast(d as int) * 2"
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> CASE WHEN i % 2 = 0 THEN cast(d as int) WHEN {_TWICE} > 9 THEN {_TWICE} - 9 ELSE {_TWICE} END), 0, (s, d) -> s + d) % 10 = 0"
_PART = "trim(LEADING '0' FROM p)"
VALID = {
    "email": "true",
    "ip": f"forall(split(x.v, '[.]'), p -> length({_PART}) < 3 OR length({_PART}) = 3 AND {_PART} <= '255')",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.a, x.b)), ',')"


def with_matches(texts: DataFrame, patterns: dict[str, tuple[str, str]], tag: str) -> DataFrame:
    """Adds an array (a, b, v, l, r) of located matches for each pattern to texts that have t."""
    df = texts.withColumns({f"m_{tag}{k}": F.expr(_found(*v, "m")) for k, v in patterns.items()})
    df = df.withColumns({f"g_{tag}{k}": F.expr(f"CASE WHEN size(m_{tag}{k}) = 0 THEN cast(array() as array<string>) ELSE {_found(*v, 'g')} END") for k, v in patterns.items()})
    df = df.withColumns({f"h_{tag}{k}": F.expr(f"slice(g_{tag}{k}, 2, size(g_{tag}{k}))") for k in patterns})
    df = df.withColumns({f"at_{tag}{k}": F.expr(_located(tag + k)) for k in patterns})
    return df.drop(*(f"{x}_{tag}{k}" for k in patterns for x in "mgh"))


def with_candidates(texts: DataFrame) -> DataFrame:
    """Adds candidates: an array of structs (a, b, v, and FEATURES) from all generators, to texts that have t."""
    df = with_matches(texts, PROPOSED, "p_")
    parts = [f"transform(at_p_{k}, x -> named_struct('a', x.a, 'b', x.b, 'v', x.v, 'g', {i}, 'l', x.l, 'r', x.r))" for i, k in enumerate(PROPOSED)]
    df = df.withColumn("c", F.expr(f"concat({', '.join(parts)})"))
    fields = ", ".join(f"'{k}', double({v})" for k, v in FEATURES.items())
    return df.withColumn("candidates", F.expr(f"transform(c, x -> named_struct('a', x.a, 'b', x.b, 'v', x.v, {fields}))")).drop("c", *(f"at_p_{k}" for k in PROPOSED))


_ITEM = "struct<a: int, base: boolean, b: int, score: double, kind: string>"


def _swept(items: str) -> str:
    """The candidates that stay, of sorted items (a, base, b, score, kind): base spans stop what they overlap, and of two candidates that overlap the better one stays, or the first."""
    held, clash = "s.held IS NOT NULL", "s.held IS NOT NULL AND x.a < s.held.b"
    out = f"CASE WHEN x.base OR x.a < s.stop OR NOT ({held}) OR x.a < s.held.b THEN s.o ELSE concat(s.o, array(s.held)) END"
    keep = f"CASE WHEN x.base THEN CASE WHEN {clash} THEN null ELSE s.held END WHEN x.a < s.stop THEN s.held WHEN {clash} AND s.held.score >= x.score THEN s.held ELSE x END"
    step = f"named_struct('stop', CASE WHEN x.base THEN greatest(s.stop, x.b) ELSE s.stop END, 'held', {keep}, 'o', {out})"
    inner = f"aggregate(k, named_struct('stop', t.stop, 'held', t.held, 'o', cast(array() as array<{_ITEM}>)), (s, x) -> {step})"
    outer = f"aggregate(z, named_struct('stop', 0, 'held', cast(null as {_ITEM}), 'o', cast(array() as array<array<{_ITEM}>>)), (t, k) -> {_bound(inner, 'n', 'named_struct(' + repr('stop') + ', n.stop, ' + repr('held') + ', n.held, ' + repr('o') + ', concat(t.o, array(n.o)))')}, t -> CASE WHEN t.held IS NULL THEN flatten(t.o) ELSE concat(flatten(t.o), array(t.held)) END)"
    return _bound(items, "y", _bound(_runs("y"), "z", outer))


def examples(n: int = EXAMPLES) -> list[tuple[str, int, int, int]]:
    """Invented texts, the place of the personal value in each (0, 0: none), and which template wrote it."""
    r = random.Random(7)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(3, 9)))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    up = lambda k: "".join(r.choice("ABCDEFGHKLMNPRSTUVWX0123456789") for _ in range(k))
    mix = lambda k: "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPRSTUVWX0123456789") for _ in range(k))
    top = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io"])
    land = lambda: r.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
    v6 = lambda: ":".join(h(4) for _ in range(8))
    v = lambda x: f"\x02{x}\x03"  # noqa: E731  marks the value
    yes = [
        lambda: f"{w()} contact {v(f'{w()} at {w()} dot {top()}')}", lambda: f"{w()} {v(f'{w()} (at) {w()} (dot) {top()}')} {w()}", lambda: f"mail {v(f'{w()}[at]{w()}[dot]{top()}')}", lambda: f"write to {v(f'{w()}.{w()} [at] {w()}.{top()}')} {w()}", lambda: f"{w()} {v(f'{w()}(at){w()}.{top()}')}", lambda: f"reach me: {v(f'{w()} @ {w()} . {top()}')}",
        lambda: f"call {v(f'({d(3)}) {d(3)}-{d(4)}')} {w()}", lambda: f"phone {v(f'{d(3)}-{d(3)}-{d(4)}')}", lambda: f"tel {v(f'{d(3)}.{d(3)}.{d(4)}')} {w()}", lambda: f"mobile {v(f'0{d(3)} {d(3)} {d(4)}')}", lambda: f"fax: {v(f'00{d(2)} {d(3)} {d(6)}')}", lambda: f"{w()} {v(f'({d(3)}) {d(3)}-{d(4)}')} {w()}", lambda: f"{w()} {v(f'{d(3)}-{d(3)}-{d(4)}')} {w()}", lambda: f"Telefon {v(f'0{d(2)}/{d(4)} {d(4)}')}", lambda: f"téléphone {v(f'0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}')} {w()}", lambda: f"teléfono {v(f'{d(3)} {d(3)} {d(3)}')}", lambda: f"whatsapp: {v(f'{d(3)} {d(3)} {d(4)}')} {w()}",
        lambda: f"ssn {v(f'{d(3)}-{d(2)}-{d(4)}')} {w()}", lambda: f"{w()} social security {v(f'{d(3)}-{d(2)}-{d(4)}')}", lambda: f"{w()} {v(f'{d(3)}-{d(2)}-{d(4)}')} {w()}", lambda: f"passport {v(d(9))} {w()}", lambda: f"Ausweis {v(d(9))}", lambda: f"license {v(d(8))} {w()}", lambda: f"dni: {v(d(8))}",
        lambda: f"iban {v(f'{land()}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}')}", lambda: f"{w()} {v(f'{land()}{d(2)}{up(4)}{d(4)}{d(4)}{d(4)}')}", lambda: f"{w()} {v(f'{land()}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}')} {w()}", lambda: f"pay to account {v(f'{land()}{d(20)}')}, {w()}", lambda: f"Konto: {v(f'{land()}{d(18)}')}", lambda: f"bank {v(f'{land()}{d(2)} {up(4)} {d(4)} {d(4)} {d(2)}')} {w()}", lambda: f"{w()} {w()} {v(f'{land()}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}')}",
        lambda: f"{w()} {v(f'token = {chr(34)}{h(40)}')}{chr(34)} {w()}", lambda: v(f"api_key: {up(24)}"), lambda: v(f"secret={h(32)}"), lambda: f"{v(f'Bearer {mix(36)}')} {w()}", lambda: v(f"password: {mix(18)}"), lambda: f"{v(f'api-key {chr(39)}{mix(32)}')}{chr(39)} {w()}", lambda: f"{w()} {v(f'SECRET={mix(40)}')}", lambda: f"{v(f'passwd = {mix(20)}')} {w()}",
        lambda: f"{w()} {v(v6())} {w()}", lambda: f"from host {v(v6())}", lambda: f"server {v(v6())}, {w()}", lambda: f"address {v(v6())} {w()}",
    ]
    no = [
        lambda: f"{w()} at {w()} dot {w()} {w()}", lambda: f"meet {w()} at {w()} . {w()}", lambda: f"we met at {w()} . {w()} {w()}", lambda: f"{w()} at {w()} dot {w()}",
        lambda: f"{w()} {r.randint(1900, 2030)}-{d(2)}-{d(2)} {w()}", lambda: f"on {d(2)}/{d(2)}/{r.randint(1900, 2030)} {w()}", lambda: f"order {d(8)} {w()}", lambda: f"invoice {d(10)}", lambda: f"{w()} {d(16)} {w()}", lambda: f"{w()} {d(12)} {w()}", lambda: f"isbn {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"pages {d(3)} {d(3)} {d(3)} {w()}", lambda: f"version {d(1)}.{d(2)}.{d(2)}.{d(3)}", lambda: f"$ {d(3)} {d(3)} {d(3)}", lambda: f"{w()} 3.{d(14)} {w()}", lambda: f"{w()} {d(4)} {d(4)} {d(4)} {w()}", lambda: f"{w()} {d(16)} {d(16)} {w()}", lambda: f"{w()} {' '.join(d(1) for _ in range(r.randint(8, 20)))}", lambda: f"{w()} {' '.join(d(2) for _ in range(r.randint(5, 12)))}", lambda: f"{w()}, {d(13)}-{d(9)}", lambda: f"{w()} {d(7)} {w()}", lambda: f"{w()} {d(8)}.", lambda: f"{w()} {d(3)} {d(3)} {d(3)} km {w()}", lambda: f"{w()} {d(10)} items", lambda: f"issn {d(4)}-{d(4)} {w()}", lambda: f"part {d(4)}-{d(4)}-{d(2)}", lambda: f"{w()} 1.{d(3)}.{d(3)}.{d(3)} euro",
        lambda: f"part {up(2).replace('0', 'A')}{d(2)}{up(4)}{up(4)}{up(4)} {w()}", lambda: f"model AB{d(2)} {up(4)} {up(4)} {up(4)}", lambda: f"item CX{d(2)}{up(12)}", lambda: f"{w()} XQ{d(2)} WORD TEXT MORE {w()}",
        lambda: f"{w()} password {w()}_{w()}_{w()}_{w()}", lambda: f"secret {'-' * 20}", lambda: f"the secret {'_' * r.randint(16, 30)} {w()}", lambda: f"token ={'=' * 20}", lambda: f"{w()} secret {w()}{w()}{w()}{w()}ing", lambda: f"password {'/'.join(w() for _ in range(5))}",
        lambda: f"{d(1)}:{d(2)}:{d(2)}:{d(2)} {w()}", lambda: f"{w()} {':'.join(d(2) for _ in range(5))}", lambda: f"ratio {':'.join(d(1) for _ in range(4))} {w()}", lambda: f"{w()} {':'.join(h(2) for _ in range(6))}",
    ]
    texts = [(f(), k) for group in (yes, no) for k, f in enumerate(group) for _ in range(n)]
    return [(t.replace("\x02", "").replace("\x03", ""), max(0, t.find("\x02")), max(0, t.find("\x03") - 1), k) for t, k in texts]


#: What the model's span is called: by its generator, and for numbers by form.
_KIND = "CASE x.generator WHEN 0 THEN 'email' WHEN 3 THEN 'iban' WHEN 4 THEN 'secret' WHEN 5 THEN 'ipv6' ELSE CASE WHEN x.three_two_four = 1 OR x.id_word = 1 THEN 'id_number' ELSE 'phone' END END"
#: Least share of right choices above a generator's threshold.
PRECISION = 0.97


@functools.cache
def _model() -> tuple[boosting.Forest, dict[int, float]]:
    """The trees, and each generator's threshold of their raw score: the least one from which on the calibrated share of right choices is PRECISION, by scores of unseen templates.

    A candidate is right if it is the whole value.
    """
    spark = SparkSession.getActiveSession()
    texts = examples()
    values = ", ".join("({}, {})".format(i, "'" + t.replace("'", "''") + "'") for i, (t, *_) in enumerate(texts))
    rows = with_candidates(spark.sql(f"SELECT * FROM VALUES {values} AS v(i, t)")).selectExpr("i", "explode(candidates) x").collect()
    x = np.array([[r["x"][k] for k in FEATURES] for r in rows])
    start, end, template = (np.array([texts[r["i"]][k] for r in rows]) for k in (1, 2, 3))
    a, b = (np.array([r["x"][k] for r in rows]) for k in "ab")
    y = ((end > start) & (a <= start) & (b >= end)).astype(float)
    raw = np.zeros(len(y))
    for fold in range(FOLDS):
        out = template % FOLDS == fold
        raw[out] = boosting.fit(x[~out], y[~out], trees=30).raw(x[out])
    limits = {}
    for g in range(len(PROPOSED)):
        own = np.flatnonzero(x[:, 0] == g)
        if not y[own].any():
            limits[g] = 1e9
            continue
        p = np.interp(raw[own], *boosting.isotonic(raw[own], y[own]))
        good = [t for t in np.unique(p) if p[p >= t].mean() >= PRECISION]
        limits[g] = float(raw[own][p >= min(good)].min()) if good else 1e9
    return boosting.fit(x, y, trees=30), limits


def find_spans(docs: DataFrame) -> DataFrame:
    """A row per document of (doc_id, text): base counts, the digest of the base spans, all spans, and how many the model added."""
    forest, raw_limits = _model()
    df = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') t")
    df = with_candidates(with_matches(df, BASE, ""))
    kinds = {k: i for i, k in enumerate(KINDS)}
    base = [f"transform(filter(at_{k}, x -> {VALID[k]}), x -> named_struct('a', x.a, 'r', {kinds[k]}, 'b', x.b, 'kind', '{k}'))" for k in BASE]
    df = df.withColumns({f"s_{k}": F.expr(e) for k, e in zip(BASE, base, strict=True)})
    df = df.withColumn("base", F.expr(f"array_sort(concat({', '.join(f's_{k}' for k in BASE)}))"))
    limit = "CASE x.generator " + " ".join(f"WHEN {g} THEN {v!r}D" for g, v in raw_limits.items()) + " END"
    scored = f"transform(candidates, x -> named_struct('score', {forest.sql([f'x.{k}' for k in FEATURES])} - {limit}, 'a', x.a, 'b', x.b, 'kind', {_KIND}))"
    df = df.withColumn("scored", F.expr(f"CASE WHEN size(candidates) = 0 THEN cast(array() as array<struct<score: double, a: int, b: int, kind: string>>) ELSE {scored} END"))
    rank = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in kinds.items()) + " END"
    marked = "transform(base, x -> named_struct('a', x.a, 'base', true, 'b', x.b, 'score', 0D, 'kind', x.kind))"
    chosen = "transform(filter(scored, x -> x.score >= 0), x -> named_struct('a', x.a, 'base', false, 'b', x.b, 'score', x.score, 'kind', x.kind))"
    df = df.withColumn("ok", F.expr(chosen))
    df = df.withColumn("stay", F.expr(f"CASE WHEN size(ok) = 0 THEN cast(array() as array<{_ITEM}>) ELSE {_swept(f'array_sort(concat({marked}, ok))')} END"))
    df = df.withColumn("added", F.expr(f"transform(stay, x -> named_struct('a', x.a, 'r', {rank}, 'b', x.b, 'kind', x.kind))"))
    counts = [f"bigint(size(s_{k})) n_{k}" for k in BASE]
    return df.selectExpr("doc_id", *counts, f"sha2({_joined('base')}, 256) base_sha256", f"{_joined('array_sort(concat(base, added))')} spans", "bigint(size(added)) n_added")


def redacted(texts: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, text, spans) with every span replaced by its kind in brackets. Spans that overlap are replaced together, by the kind of the first."""
    spans = "transform(filter(split(spans, ','), s -> s <> ''), s -> named_struct('a', int(split(s, ':')[1]), 'b', int(split(s, ':')[2]), 'kind', split(s, ':')[0]))"
    cut = "named_struct('e', x.b, 'o', concat(s.o, array(substring(t, s.e + 1, x.a - s.e), concat('[', upper(x.kind), ']'))))"
    within = "named_struct('e', greatest(s.e, x.b), 'o', s.o)"
    # of spans in order of place, one that begins before the last has ended belongs to it; the very first one begins a text
    step = f"CASE WHEN size(s.o) > 0 AND x.a < s.e THEN {within} ELSE {cut} END"
    done = "concat(array_join(s.o, ''), substring(t, s.e + 1))"
    df = texts.selectExpr("doc_id", "coalesce(text, '') t", f"{spans} parts")
    return df.selectExpr("doc_id", f"aggregate(parts, named_struct('e', 0, 'o', cast(array() as array<string>)), (s, x) -> {step}, s -> {done}) text")
