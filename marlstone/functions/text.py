"""Cleaning and comparing text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers for values that were not recognised, and characters that carry no signal.
UNKNOWN_MARKERS = ["UNSPECIFIED", "UNKNOWN", "N/A", "NA", "NULL", "未识别"]
MISSING_MARKERS = UNKNOWN_MARKERS + ["-", "/", "—", "无", "未知", "未填写"]
NO_SIGNAL = r"[\s_\-—–/\\|,.，。:：;；()（）\[\]【】{}<>《》]"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


SPACES = " \t\x0b\f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CLEAN = rf"\A(?:[^{SPACES}\r\n&?？�]++(?: [^{SPACES}\r\n&?？�]++)*+)?\z"  # words with one blank between, and nothing to decode or doubt: one walk, no way back


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def is_blank(x: Column) -> Column:
    """Null, empty or white space only, with all of Unicode's white space."""
    return ~text_or_empty(x).rlike(r"(?U)\S")


def decode_entities(x: Column) -> Column:
    """The common character references; others stay."""
    y = x
    for name, char in ENTITIES:
        y = F.replace(y, F.lit(name), F.lit(char))
    return F.when(F.contains(x, F.lit("&")), y).otherwise(x)


def is_unknown_marker(x: Column) -> Column:
    return F.coalesce(F.upper(F.trim(x)).isin(UNKNOWN_MARKERS), F.lit(False))


def is_missing(x: Column) -> Column:
    """Blank, or one of the wider list of markers."""
    return is_blank(x) | F.upper(F.trim(text_or_empty(x))).isin(MISSING_MARKERS)


def looks_unreadable(x: Column) -> Column:
    """Only question marks once punctuation is gone, or two of them at least and otherwise digits."""
    signal = F.regexp_replace(text_or_empty(x), "(?U)" + NO_SIGNAL, "")
    doubted = signal.rlike("^[?？�]+$") | signal.rlike("^(?=(?:[^?？�]*[?？�]){2})[?？�0-9]+$")
    return F.when(text_or_empty(x).rlike("[?？�]"), doubted).otherwise(F.lit(False))


def clean_value(x: Column) -> Column:
    """Entities decoded, wide blanks and runs of blanks made one, markers and unreadable values emptied.

    Most values have nothing to clean: one pattern tells, and only the others go through all steps.
    """
    plain = text_or_empty(x).rlike(CLEAN)
    y = F.regexp_replace(F.translate(decode_entities(text_or_empty(x)), "�　", "? "), r"(?U)^\s+|\s+$", "")
    y = F.regexp_replace(y, r"(?U)[^\S\r\n]+", " ")
    cleaned = let(y, lambda z: F.when(is_unknown_marker(z) | looks_unreadable(z), F.lit("")).otherwise(z))
    return F.when(plain, F.when(is_unknown_marker(x), F.lit("")).otherwise(text_or_empty(x))).otherwise(cleaned)


_CLEAN_TEXT = re.compile(CLEAN.replace(r"\z", r"\Z"))
_BLANK_RUNS, _NO_SIGNAL_TEXT = re.compile(f"[{SPACES}]+"), re.compile("[" + SPACES + "\r\n" + NO_SIGNAL[3:])
_DOUBTED = re.compile("[?？�]+|(?=(?:[^?？�]*[?？�]){2})[?？�0-9]+")


def clean_text(x: str | None) -> str:
    """clean_value of one text, for parsers that have it at hand."""
    if not x:
        return ""
    if not _CLEAN_TEXT.match(x):
        if "&" in x:
            for name, char in ENTITIES:
                x = x.replace(name, char)
        x = _BLANK_RUNS.sub(" ", x.replace("�", "?").replace("　", " ").strip(SPACES + "\r\n"))
        if ("?" in x or "？" in x) and _DOUBTED.fullmatch(_NO_SIGNAL_TEXT.sub("", x)):
            return ""
    return "" if len(x) < 16 and x.strip(" ").upper() in UNKNOWN_MARKERS else x


def without_spaces(x: Column, also: str = "") -> Column:
    """Entities decoded and all blanks taken out, for looking words up: what clean_value makes of a text holds the same words."""
    return F.translate(decode_entities(text_or_empty(x)), SPACES + also, "")


def clean_and_truncate(x: Column, length: int) -> Column:
    return F.substring(clean_value(x), 1, length)


def html_to_text(x: Column) -> Column:
    """Scripts, styles and tags dropped, common entities decoded, white space made one blank."""
    y = F.regexp_replace(text_or_empty(x), r"(?is)<script\b.*?</script>", " ")
    y = F.regexp_replace(y, r"(?is)<style\b.*?</style>", " ")
    y = F.regexp_replace(y, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(y), r"\s+", " "))


def name_core(x: Column) -> Column:
    """A name without white space and punctuation: what similarity compares."""
    return F.regexp_replace(clean_value(x), r"(?U)[\s\p{P}]", "")


def distinct_letters(core: Column) -> Column:
    """The characters of a name, each once."""
    return F.array_distinct(F.filter(F.split(core, ""), lambda c: c != ""))


def core_similarity(p: Column, q: Column) -> Column:
    """similarity of two names given by their cores."""
    lp, lq = F.lower(p), F.lower(q)
    shared = F.size(F.array_intersect(distinct_letters(p), distinct_letters(q))) / F.greatest(F.length(p), F.length(q))
    return F.when((p == "") | (q == ""), F.lit(0.0)).when(lp == lq, F.lit(1.0)).when(F.contains(lp, lq) | F.contains(lq, lp), F.lit(0.88)).otherwise(shared)


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.88 if one holds the other, else distinct shared characters over the longer length; 0 if either is blank.

    Compared without white space and punctuation; equality and containment ignore case, shared characters do not.
    """
    return let(F.struct(name_core(a).alias("p"), name_core(b).alias("q")), lambda t: core_similarity(t["p"], t["q"]))


def comparable(x: Column) -> Column:
    """Without blanks, colons, commas and semicolons, upper case."""
    return F.upper(F.translate(clean_value(x), " 　:：,，;；", ""))


def keywords(x: Column, most: int = 8) -> Column:
    """Distinct parts of two characters or more, in order, `most` at most."""
    parts = F.split(clean_value(x), r"[\s,，;；、/|（）()\[\]【】:：-]+")
    return F.slice(F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 2)), 1, most)


def contains_any(x: Column, words: list[str]) -> Column:
    """Whether the lower-case text holds any of the words."""
    cased = any(w.lower() != w.upper() for w in words)
    y = F.lower(text_or_empty(x)) if cased else text_or_empty(x)

    def held(z: Column) -> Column:
        out = F.contains(z, F.lit(words[0].lower()))
        for w in words[1:]:
            out = out | F.contains(z, F.lit(w.lower()))
        return out

    return let(y, held)


def source_line(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
