"""Text expressions that keep Python's string rules inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .once import let

# The line ends of splitlines(), and the universal newlines of text files.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NEWLINES = r"\r\n|\r|\n"

# The characters str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java spellings of the character classes as Python's re reads them on str.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"\p{L}\p{N}_"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_OUTSIDE = {"w": f"[{_WORD}]", "s": f"[{_SPACE}]", "d": r"\p{Nd}", "b": _BOUNDARY, "S": f"[^{_SPACE}]"}
_INSIDE = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}

# Stands in for a genuine U+FFFD while invalid bytes are dropped.
_KEEP = "\ufdd0\ufdd1\ufdd0"


def jvm_pattern(pattern: str) -> str:
    """Spell ``\\w \\s \\d \\b`` so that Java matches the same characters Python does."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            out.append((_INSIDE if in_class else _OUTSIDE).get(nxt, ch + nxt))
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lines_of(text: Column, ends: str = LINE_ENDS) -> Column:
    """Lines of a text; a final line end opens no further line."""

    def without_last(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return let(F.split(text, ends), without_last)


def universal_newlines(text: Column) -> Column:
    """What text-mode reading does: every newline style becomes ``\\n``."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def strict_text(content: Column) -> Column:
    """Decoded UTF-8, or null where the bytes are not valid."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s)


def lenient_text(content: Column) -> Column:
    """Decoded UTF-8 without the invalid bytes."""
    s = content.cast("string")
    kept = F.make_valid_utf8(F.replace(s, F.lit("\ufffd"), F.lit(_KEEP)))
    dropped = F.replace(kept, F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(s), s).otherwise(F.replace(dropped, F.lit(_KEEP), F.lit("\ufffd")))


def strip_line_comment(line: Column) -> Column:
    """The line up to the first ``//``."""
    return F.substring_index(line, "//", 1)


def first_match_column(line: Column, pattern: str) -> Column:
    """1-based code point position of the first match; null without a match."""
    return F.when(F.rlike(line, F.lit(jvm_pattern(pattern))), matched_column(line, pattern))


def matched_column(line: Column, pattern: str) -> Column:
    """The same for lines that hold a match; ``pattern`` has no group of its own.

    The text before the match is taken as a group: ``split`` would compile the pattern anew for each line.
    """
    before = F.regexp_extract(line, rf"\A((?s:.*?))(?:{jvm_pattern(pattern)})", 1)
    return (F.length(before) + 1).cast("int")


def line_snippet(line: Column, limit: int = 120) -> Column:
    return F.substring(py_strip(line), 1, limit)


def contains_any(text: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def shannon_entropy(value: Column) -> Column:
    """Bits per character.

    A character's count is what the text loses without it: one pass over its bytes per distinct character.
    """

    def bits(text: Column) -> Column:
        def plus_term(acc, c):
            p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
            return acc - p * F.log2(p)

        return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), plus_term)

    return let(value, bits)


def has_digit(value: Column) -> Column:
    return F.rlike(value, F.lit(r"\p{Nd}"))


def env_name(name: Column) -> Column:
    """apiKey -> API_KEY."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.btrim(F.upper(F.regexp_replace(spaced, "[^A-Za-z0-9]+", "_")), F.lit("_"))


def is_json(text: Column) -> Column:
    """Is the text one JSON value and nothing else? Repeated keys and NaN are allowed, as Python's reader has it.

    The parser stops after the first value, so the text is parsed inside an array and inside an
    object: what follows a value breaks at least one of them.
    """
    inside_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    inside_object = F.from_json(F.concat(F.lit('{"v":'), text, F.lit(',"w":1}')), "w int")
    return F.coalesce((F.size(inside_array) == 1) & (inside_object["w"] == 1), F.lit(False))
