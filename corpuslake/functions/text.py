"""Text functions: Column in, Column out, in built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L

#: Unicode white space as Python sees it: Java's (?U)\s plus the four separators U+001C to U+001F. Listed, as classes of
#: Unicode properties are slow.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WS = f"[{SPACE}]+"
#: Those below U+0100, one by one: Java keeps them in one table, while each range of a class is a test of its own. The
#: others are among _FAR, with a few more.
_NEAR = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_FAR = r"\u1680-\u3000"
BLOCK = "[؀-ۿ]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row; lambdas would compute an outer expression for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column) -> Column:
    """The parts between white space; none for a blank text, null for null."""
    plain = F.split(c, " ")  # for one character Spark needs no regex
    return F.array_remove(F.when(c.rlike(f"[{_NEAR}{_FAR}]"), F.split(c, WS)).otherwise(plain), "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Each run of white space becomes one space; single spaces aren't touched."""
    near = only_where(c, f"[{_FAR}]", lambda t: F.translate(t, SPACES, " " * len(SPACES)))
    return F.regexp_replace(near, f" [ {_NEAR}]+|[{_NEAR}][ {_NEAR}]*", " ")


def replace_where(c: Column, literal: str, regex: str, new: str) -> Column:
    """regexp_replace for a regex whose matches all hold the literal: texts without it aren't searched."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(literal)), F.regexp_replace(t, regex, new)).otherwise(t))


def only_where(c: Column, regex: str, change) -> Column:
    """change(c) where the regex is found; change must leave other texts as they are."""
    return let(c, lambda t: F.when(t.rlike(regex), change(t)).otherwise(t))


def replace(c: Column, literal: str, new: str) -> Column:
    """F.replace, which is slow where the literal is missing."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(literal)), F.replace(t, F.lit(literal), F.lit(new))).otherwise(t))


def _count(c: Column, others: str) -> Column:
    """Characters outside the class `others`; counting matches would make a string of each."""
    return F.length(F.regexp_replace(c, f"{others}+", ""))


def block_chars(c: Column) -> Column:
    return _count(c, "[^؀-ۿ]")


def ascii_letters(c: Column) -> Column:
    return _count(c, "[^A-Za-z]")


def letters(c: Column) -> Column:
    return _count(c, r"\P{L}")


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def truncate(c: Column, n: int = 3000) -> Column:
    return F.substring(c, 1, n)


def remove_boilerplate(c: Column) -> Column:
    """Each phrase, in order, becomes one space."""
    return reduce(lambda t, p: replace(t, p, " "), L.BOILERPLATE, c)


def normalize_letters(c: Column) -> Column:
    """Variants of letters become one form; tatweel and invisible characters go."""
    letters = L.LETTERS_FROM + L.DELETED
    return let(c, lambda t: F.when(reduce(lambda a, x: a | F.contains(t, F.lit(x)), letters[1:], F.contains(t, F.lit(letters[0]))), F.translate(t, letters, L.LETTERS_TO)).otherwise(t))


def split_fusions(c: Column, boundary_aware: bool = False) -> Column:
    """A space after each ending that stands before another character of the block, ending by ending.

    With boundary_aware, only where a token of more than the ending is fused (off by default: the plain rule also
    splits inside words, and results depend on that).
    """
    if boundary_aware:
        return reduce(lambda t, e: F.regexp_replace(t, f"(?<![{SPACE}])({e})({BLOCK})", "$1 $2"), L.FUSION_ENDINGS, c)
    return reduce(lambda t, p: replace_where(t, *p), _FUSIONS, c)


def _fusions() -> list[tuple[str, str, str]]:
    """Passes of split_fusions that give the same as one for each ending.

    A pass of one ending takes the character behind it, so of the same ending twice in a row the second isn't cut. Endings
    of which none begins inside another don't meet: one pass finds them all, and takes a repeat along. One that another
    begins with has a pass of its own, before.
    """
    inner = {x for e in L.FUSION_ENDINGS for x in e[1:]}
    begins = [(i, k) for i, e in enumerate(L.FUSION_ENDINGS) for k, x in enumerate(L.FUSION_ENDINGS) if i != k and e.startswith(x)]
    if any(e[0] in inner for e in L.FUSION_ENDINGS) or any(i > k for i, k in begins):
        return [(e, f"({e})({BLOCK})", "$1 $2") for e in L.FUSION_ENDINGS]
    apart = [L.FUSION_ENDINGS[i] for i in sorted({i for i, _ in begins})]
    rest: dict[str, list[str]] = {}
    for e in L.FUSION_ENDINGS:
        if e not in apart:
            rest.setdefault(e[0], []).append(e[1:])
    one = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in rest.items())
    return [*((e, f"({e})({BLOCK})", "$1 $2") for e in apart), ("", rf"({one})(?={BLOCK})(\1?)", "$1 $2")]


_FUSIONS = _fusions()


#: Patterns of noise, what each becomes, in order, and what each match holds.
NOISE = (
    ("http", f"https?://[^{SPACE}]+", ""), ("www.", rf"www\.[^{SPACE}]+", ""), ("@", rf"(?<![^{SPACE}])[^{SPACE}]+@[^{SPACE}]+\.[^{SPACE}]+", ""), ("<", "<[^>]+>", ""), ("&", "&[a-zA-Z]+;", ""),
    ("", r"(?U)(?=\d)\b\d+\b", ""), ("۔۔", "۔{2,}", "۔"), ("؟؟", "؟{2,}", "؟"), ("!!", "!{2,}", "!"), ("---", "-{3,}", " "),
)


def remove_noise(c: Column) -> Column:
    passes = lambda some: lambda c: reduce(lambda t, p: replace_where(t, *p), some, c)
    marked = only_where(c, r"(?=[hw@<&])(?:http|www\.|[@<]|&[a-zA-Z])", passes(NOISE[:5]))
    repeats = only_where(F.regexp_replace(marked, *NOISE[5][1:]), r"([!\-۔؟])\1", passes(NOISE[6:]))
    return F.trim(collapse(repeats))


def clean(c: Column) -> Column:
    """All steps; null, blank and "nan" give the empty text."""
    whole = remove_noise(split_fusions(normalize_letters(remove_boilerplate(c))))
    return F.when(is_blank(c), F.lit("")).otherwise(whole)


def is_blank(c: Column) -> Column:
    """Null, white space alone, or "nan" in any case."""
    bare = strip(c)
    return c.isNull() | (F.length(bare) == 0) | ((F.length(bare) == 3) & (F.lower(bare) == "nan"))


def normalize_for_scoring(c: Column) -> Column:
    """For evaluation: U+FEFF, U+200C and U+200D go, white space is collapsed; null gives the empty text."""
    return F.trim(collapse(F.translate(F.coalesce(c, F.lit("")), "﻿‌‍", "")))


def without_thoughts(c: Column) -> Column:
    """Model text without think blocks and code fences."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), "(?s)<think>.*?</think>", ""), "```(?:json|JSON)?", ""))


def prediction(c: Column) -> Column:
    """The corrected sentence in a model's output: JSON answer, or the text after a known prefix, its first line in the script."""
    def answer(t: Column) -> Column:
        is_object = t.startswith("{") & F.try_parse_json(t).isNotNull() if hasattr(F, "try_parse_json") else t.startswith("{") & F.get_json_object(t, "$").isNotNull()
        fields = [F.nullif(strip(F.get_json_object(t, f"$.{k}")), F.lit("")) for k in L.ANSWER_KEYS]
        plain = t
        for p in L.ANSWER_PREFIXES:
            plain = F.when(F.lower(plain).startswith(p.lower()), strip(F.substr(plain, F.lit(len(p) + 1)))).otherwise(plain)
        plain = F.btrim(plain, F.lit("\"'“”‘’ "))

        def line(lines: Column) -> Column:
            return F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(BLOCK)), F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))

        lines = F.filter(F.transform(F.split(plain, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
        return F.coalesce(F.when(is_object, F.coalesce(*fields)), let(lines, line))

    return normalize_for_scoring(let(without_thoughts(F.coalesce(c, F.lit(""))), answer))


def source_of_prompt(c: Column) -> Column:
    """What a user prompt asks to correct: after "following text:", else the last line that isn't blank, else all."""
    found = F.regexp_extract(c, r"(?is)following text\s*:\s*(.*)$", 1)
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    return F.when(c.rlike(r"(?is)following text\s*:"), strip(found)).otherwise(F.coalesce(F.try_element_at(lines, F.lit(-1)), c))
