"""Column functions and helpers on text: glob patterns, index ranges, tokens, stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a text index leaves out (fixed values).
STOP_WORDS = """
a an and are as at be by for from has he in is it its of on that the to was will with this but they
have had what said each which she do how their if up other about out many then them these so some her would
make like into him time two more go no way could my than first water been call who now find long down day
did get come made may part over say also back after use work life even new want here look too very when
know take year good give most us
""".split()

#: Suffixes of the stemmer, tried in this order, with what takes their place (fixed values).
SUFFIXES = [
    ("ies", "y"), ("ied", "y"), ("ying", "ie"), ("s", ""), ("es", ""), ("ed", ""), ("ing", ""), ("ly", ""), ("ment", ""), ("ness", ""),
    ("tion", "t"), ("sion", "s"), ("ity", ""), ("er", ""), ("or", ""), ("ist", ""), ("ism", ""), ("ize", ""), ("ise", ""), ("ify", ""),
    ("en", ""), ("able", ""), ("ible", ""), ("al", ""), ("ial", ""), ("ical", ""), ("ful", ""), ("less", ""), ("ous", ""), ("ious", ""),
    ("ative", ""), ("itive", ""),
]


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of ``*``, ``?``, ``[...]``, ``[^...]`` and backslash escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise ValueError("pattern ends with an escape")
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inside = pattern[i + 1 : end]
            negated = inside.startswith("^")
            out.append("[" + "^" * negated + inside[negated:].replace("\\", "\\\\").replace("^", "\\^").replace("[", "\\[").replace("&", "\\&") + "]")
            i = end
        else:
            out.append(c if c.isalnum() or c in "_ " else "\\" + c)
        i += 1
    return "^" + "".join(out) + "$"


def matches(name: Column, pattern: str) -> Column:
    """Whether a name matches a glob; a pattern without signs or with ``*`` at its end alone stays a pushable comparison."""
    if not any(c in pattern for c in "*?[\\"):
        return name == pattern
    if pattern.endswith("*") and not any(c in pattern[:-1] for c in "*?[\\"):
        return name.startswith(pattern[:-1])
    return name.rlike(glob_to_regex(pattern))


def clamp_range(size: Column, start: int, stop: int) -> tuple[Column, Column]:
    """First index and length of the inclusive slice start..stop of a sequence, negative indexes from its end.

    A start before the sequence counts as its first element, a start or stop
    beyond it gives nothing or its end, a stop before it gives nothing.
    """
    a = F.greatest(size + start, F.lit(0)) if start < 0 else F.lit(start)
    b = size + stop + 1 if stop < 0 else F.least(F.lit(stop + 1), size)
    a, b = a.cast("long"), b.cast("long")
    return a, F.greatest(F.when(a >= size, 0).otherwise(b - a), F.lit(0)).cast("long")


def strict_range(size: Column, start: int, stop: int) -> tuple[Column, Column]:
    """As ``clamp_range`` for byte ranges: null where start or stop lies before the value, start beyond it, or after stop."""
    a = size + start if start < 0 else F.lit(start)
    b = size + stop + 1 if stop < 0 else F.least(F.lit(stop + 1), size)
    good = (F.lit(start) >= -size) & (F.lit(start) < size) & (F.lit(stop) >= -size) & (a <= b)
    return F.when(good, a).cast("long"), F.when(good, b - a).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def white_space_tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters of the lower-cased text; the whole text where it is shorter."""
    t = F.lower(text)
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))


def without_stop_words(words: Column) -> Column:
    """The words that are no stop words, in order, repeats kept."""
    return F.filter(words, lambda x: ~x.isin(*STOP_WORDS))


def stem(word: Column) -> Column:
    """The lower-cased word without the first listed suffix that leaves two bytes at least."""
    w = F.lower(word)
    out = w
    for suffix, put in reversed(SUFFIXES):
        cut = F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(put))
        out = F.when(w.endswith(suffix) & (F.octet_length(cut) >= 2), cut).otherwise(out)
    return out


def stem_of(word: str) -> str:
    """``stem`` of a word that is known when the query is planned."""
    w = word.lower()
    for suffix, put in SUFFIXES:
        if w.endswith(suffix) and len((cut := w[: len(w) - len(suffix)] + put).encode()) >= 2:
            return cut
    return w


def tags(value: Column) -> Column:
    """Tags of a comma-separated value: trimmed and lower-cased."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
