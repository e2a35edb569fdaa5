"""Scalar functions as Column expressions, all of built-ins."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that a comparison by stem drops.
SUFFIX_TOKENS = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "holdings", "group", "the", "ai", "io", "labs", "lab", "technologies", "technology", "systems", "system"]
MAX_TAG_LEN, MAX_TAGS = 48, 24


def squeeze(x: Column) -> Column:
    """Runs of white space become one space, none at the ends (STR9)."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def norm_name(x: Column) -> Column:
    """Case and punctuation folded, Unicode letters kept (STR1)."""
    return squeeze(F.regexp_replace(fold(F.trim(x)), r"[^\p{L}\p{N}_\s]", " "))


def norm_ascii(x: Column) -> Column:
    """The join key of ASCII names (STR2 on ASCII input)."""
    return squeeze(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def _ranges(chars: list[str]) -> str:
    """A character class of these, sorted, for a regular expression."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


def _by_character(x: Column, special: dict[str, str], other: Callable[[Column], Column]) -> Column:
    """Every character looked up, with other() of those that aren't in the table. For rare characters: it costs a search for each character."""
    table = F.create_map(*(F.lit(v) for pair in special.items() for v in pair))
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), other(c))), "")


#: Below this code point stand all characters with a case or a compatible ASCII letter or digit.
_TOP = 0x1FC00


def _characters() -> Iterator[str]:
    """All characters beyond ASCII that are no surrogates."""
    return (chr(c) for c in range(0x80, _TOP) if not 0xD800 <= c < 0xE000)


@cache
def _foldings() -> dict[str, str]:
    """By rule: characters whose full case folding is not their lower case; a capital sigma's lower case depends on its place."""
    return {c: c.casefold() for c in _characters() if c.casefold() != c.lower()} | {"\u03a3": "\u03c3"}


def _ascii(x: Column) -> Column:
    """Whether all characters are ASCII, without a look at each."""
    return F.octet_length(x) == F.length(x)


def fold(x: Column) -> Column:
    """Full case folding (T2): lower() for ASCII, with the sharp s spelt out for others, and character by character for texts that hold one for which that is not enough. Letters that are new in Unicode 16 fold as Java has them."""
    special = {c: k for c, k in _foldings().items() if c != "\u00df"}
    spelt = F.replace(x, F.lit("\u00df"), F.lit("ss"))
    # the look ahead spares the ranges for most characters
    rare = spelt.rlike(f"(?=[^\\x00-\\x{{b4}}])[{_ranges(sorted(special))}]")
    return F.when(_ascii(x), F.lower(x)).when(rare, _by_character(spelt, special, F.lower)).otherwise(F.lower(spelt))


@cache
def _ascii_keys() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """By rule, what the decomposition (NFKD) of a character leaves of a-z and 0-9, all else being a gap: one sign; one sign and a gap; more than that."""
    found: tuple[dict[str, str], ...] = ({}, {}, {})
    for c in _characters():
        key = re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", c).lower())
        if key.strip():
            kind = 0 if len(key) == 1 else 1 if len(key) == 2 and key[1] == " " else 2
            found[kind][c] = key
    return found


def match_key(x: Column) -> Column:
    """The join key of any name: decomposed (NFKD), lower case, everything but a-z and 0-9 a gap (STR2). Runs of gaps are one, so each character can be taken by itself."""
    plain, gapped, rare = _ascii_keys()
    single = plain | {c: k[0] for c, k in gapped.items()}
    whole = F.when(x.rlike(f"[{_ranges(sorted(rare))}]"), _by_character(x, rare, lambda c: c)).otherwise(x)
    spread = F.translate(F.regexp_replace(whole, f"([{_ranges(sorted(gapped))}])", "$1 "), "".join(single), "".join(single.values()))
    return F.when(x.rlike(r"[^\x00-\x7F]"), norm_ascii(spread)).otherwise(norm_ascii(x))


casefolded, norm_nfkd = fold, match_key


def stem(key: Column) -> Column:
    """The key without corporate and descriptor tokens, or itself if none are left (STR3)."""
    left = F.array_join(F.filter(F.split(key, " "), lambda t: ~t.isin(SUFFIX_TOKENS)), " ")
    return F.when(left == "", key).otherwise(left)


def clean_cell(x: Column) -> Column:
    """A cell's text without a leading text guard; blanks and written nulls are null (STR4, STR16)."""
    s = F.trim(x)
    s = F.when(s.startswith("'"), F.trim(F.substring(s, 2, 1 << 30))).otherwise(s)
    return F.when((s == "") | F.upper(s).isin("NAN", "NAT", "NONE"), None).otherwise(s)


def domain_of(website: Column) -> Column:
    """Bare host: no scheme, one www. less, no path (STR5)."""
    d = F.regexp_replace(F.trim(website), "(?i)^https?://", "")
    d = F.lower(F.regexp_replace(F.regexp_replace(d, r"(?i)^www\.", ""), "/+$", ""))
    return F.nullif(F.split_part(d, F.lit("/"), F.lit(1)), F.lit(""))


def _count(x: Column, what: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(what), F.lit("")))


def canonical_score(name: Column) -> Column:
    """(clean, words, characters): which spelling is likelier the full name (STR6)."""
    torn = (_count(name, "(") != _count(name, ")")) | (_count(name, "[") != _count(name, "]"))
    torn = torn | F.rtrim(name).rlike("[/:,-]$") | name.rlike(r"[A-Za-z]\s*[/,:]\s*[A-Za-z]")
    words = F.when(F.trim(name) == "", 0).otherwise(F.size(F.split(F.trim(name), r"\s+")))
    return F.struct(F.when(torn, 0).otherwise(1).alias("clean"), words.alias("words"), F.length(name).alias("chars"))


def group_parts(name: Column) -> Column:
    """The companies that one joined listing may name (STR7)."""
    parts = F.transform(F.split(name, "[/,]"), lambda p: F.btrim(p, F.lit(" /,:")))
    return F.filter(parts, lambda p: p != "")


def is_grouped(name: Column) -> Column:
    return name.rlike(r"[A-Za-z]\s*[/,]\s*[A-Za-z]") & (F.size(group_parts(name)) >= 2)


def tags(raw: Column) -> Column:
    """Canonical tag list: squeezed, one spelling for each case-folded form (the first), sorted by that form (STR10, SET6)."""
    # the whole text is squeezed once; its tags then have one space at most at either end
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")
    both = F.transform(F.array(text), lambda s: F.arrays_zip(F.split(s, ","), F.split(fold(s), ",")))[0]
    parts = F.transform(both, lambda x: F.struct(F.trim(x["1"]).alias("k"), F.trim(x["0"]).alias("t")))
    placed = F.sort_array(F.transform(F.filter(parts, lambda x: x["t"] != ""), lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["t"].alias("t"))))
    # an array of one binds the sorted list once, not anew for every tag
    firsts = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])))
    return F.transform(firsts[0], lambda x: x["t"])


def tag_faults(raw: Column) -> Column:
    """The rule that a tag list breaks, or null."""
    return F.when(F.exists(tags(raw), lambda t: F.length(t) > MAX_TAG_LEN), "tag too long").when(F.size(tags(raw)) > MAX_TAGS, "too many tags")


def percent(n: Column, d: Column) -> Column:
    """Whole percents, halves to even; null on zero (STR11, NUM2, NUM3)."""
    return F.when(d == 0, None).otherwise(F.bround(n / d * 100, 0).cast("long"))


def coverage_text(present: Column, total: Column) -> Column:
    """'x/y (z.z%)', 0.0 % without a denominator (AGG8)."""
    share = F.when(total == 0, 0.0).otherwise(present / total)
    return F.format_string("%d/%d (%.1f%%)", present, total, F.bround(share * 100, 1))


def share_text(n: Column, d: Column, what: str) -> Column:
    """'n of d what (p%)', n/a without a denominator."""
    return F.when(d == 0, F.format_string(f"%d of %d {what} (n/a)", n, d)).otherwise(F.format_string(f"%d of %d {what} (%d%%)", n, d, percent(n, d)))


def us_date(x: Column) -> Column:
    """MM/DD/YYYY or ISO to a date, else null (DT1)."""
    return F.coalesce(F.try_to_date(x, "M/d/yyyy"), F.try_to_date(x, "yyyy-MM-dd"))


def loose_iso(x: Column) -> Column:
    """A date's text as YYYY-MM-DD without a range check (DT2)."""
    s = F.trim(x)
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    part = lambda k: F.regexp_extract(s, us, k)
    slashed = F.concat(part(3), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)).when(s.rlike(us), slashed)


def amount(raw: Column) -> Column:
    """(value, is_zero, fault) of a typed amount (NUM1)."""
    text = F.nullif(F.trim(raw), F.lit(""))
    value = F.regexp_replace(text, r"[$,\s]", "").try_cast("double")
    fault = F.when(text.isNotNull() & value.isNull(), "not a number").when(value < 0, "negative")
    good = F.when(fault.isNull(), value)
    return F.struct(good.alias("value"), F.coalesce(good == 0, F.lit(False)).alias("is_zero"), fault.alias("fault"))


def owner(x: Column) -> Column:
    """The name before a bracketed address (STR13)."""
    return F.trim(F.split_part(x, F.lit("<"), F.lit(1)))


def public_id(entity_id: Column) -> Column:
    """EV0001 for 1 (STR14)."""
    return F.format_string("EV%04d", entity_id)


def entity_of(public: Column) -> Column:
    return F.substring(public, 3, 18).try_cast("long")


def bar(n: Column) -> Column:
    """A bar of so many blocks (STR15)."""
    return F.repeat(F.lit("█"), n.cast("int"))
