"""Text expressions: normalisation, tokens and shingles.

Character classes are spelled out, because Java's ``\\w`` and ``\\s`` are ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, fixed values.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LEXEME = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
ASCII_WORD = "[a-z0-9_]+"
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_\s]"
#: A phrase three times in a row, a fenced block, a line of code, and a user's folder.
REPEATED_PHRASE = r"(?s)(.{8,}?)\1{2,}"
FENCED = r"(?s)```(?:[A-Za-z0-9_+.-]+)?\s*\n(.*?)```"
CODE_LINE = r"(?m)^\s*(?:def |class |from |import |return\b|print\(|for\b|if\b|while\b|[A-Za-z_]\w*\s*=)"
HOME = r"(?i)(?<![A-Za-z0-9_./\\])(?:[A-Z]:[/\\]+Users[/\\]+[A-Za-z0-9][A-Za-z0-9_.@ -]*|/(?:home|Users)/[A-Za-z0-9][A-Za-z0-9_.@-]*)"


def normalize(text: Column) -> Column:
    """CRLF and CR become LF; trailing white space goes."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), rf"[{SPACE}]+\z", "")


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD), F.lit(0))


def code_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what a lambda refers to is otherwise evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(tokens: Column, width: int, keep_short: bool = False) -> Column:
    """Distinct ``width``-token windows joined by a space.

    Fewer tokens than ``width`` give none, or with ``keep_short`` one shingle of all tokens.
    """
    none = F.array().cast("array<string>")

    def windows(t: Column) -> Column:
        count = F.size(t)
        every = F.transform(F.sequence(F.lit(1), F.greatest(count - width + 1, F.lit(1))), lambda i: F.concat_ws(" ", *[F.get(t, i + k - 1) for k in range(width)]))
        short = F.array(F.array_join(t, " ")) if keep_short else none
        return F.when(count >= width, F.array_distinct(every)).when(count > 0, short).otherwise(none)

    return let(tokens, windows)


def window_hash(tokens: Column, start: Column | int, width: int) -> Column:
    """64-bit hash of the ``width`` tokens from a 0-based place."""
    return F.xxhash64(*[F.get(tokens, F.lit(start) + k if isinstance(start, int) else start + k) for k in range(width)])


def shingle_hashes(tokens: Column, width: int, keep_short: bool = False) -> Column:
    """64-bit hashes of the distinct ``width``-token windows; no window is put together as a text.

    Fewer tokens than ``width`` give none, or with ``keep_short`` one hash of all tokens.
    """
    none = F.array().cast("array<long>")

    def windows(t: Column) -> Column:
        count = F.size(t)
        every = F.transform(F.sequence(F.lit(0), F.greatest(count - width, F.lit(0))), lambda i: window_hash(t, i, width))
        short = F.array(F.xxhash64(t)) if keep_short else none
        return F.when(count >= width, F.array_distinct(every)).when(count > 0, short).otherwise(none)

    return let(tokens, windows)


def header(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("<repo>"), repository, F.lit("<file>"), path, F.lit("\n"))


def strip_header(text: Column, expected: Column) -> Column:
    """The text after its header; null if it doesn't begin with it."""
    return F.when(text.startswith(expected), F.substring(text, F.length(expected) + 1, F.length(text)))


def adjacent_repeat(tokens: Column, least: int = 3, most: int = 11) -> Column:
    """At least 12 tokens, and some window of ``least`` to ``most`` of them directly repeated."""

    def found(t: Column) -> Column:
        def repeats(size: int) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(t) - 2 * size, F.lit(0)))
            equal = lambda i: reduce(and_, [F.get(t, i + k) == F.get(t, i + k + size) for k in range(size)])
            return (2 * size <= F.size(t)) & F.exists(starts, equal)

        return (F.size(t) >= 12) & reduce(or_, [repeats(size) for size in range(least, most + 1)])

    return let(tokens, found)


def phrase_repeat(text: Column) -> Column:
    """A phrase of eight or more characters three times in a row."""
    return text.rlike(REPEATED_PHRASE)


def extract_code(text: Column) -> Column:
    """struct(code, extraction): the first fenced block, else text that looks like code, else null."""
    trim = lambda c: F.btrim(c, F.lit("\r\n"))
    kind = F.when(text.rlike(FENCED), "fenced").when(text.rlike(CODE_LINE), "raw").otherwise("no_code")
    code = F.when(kind == "fenced", trim(F.regexp_extract(text, FENCED, 1))).when(kind == "raw", trim(text))
    return F.struct(code.alias("code"), kind.alias("extraction"))


def leaked_lines(patch: Column, description: Column, least: int = 24) -> Column:
    """Distinct stripped lines of at least ``least`` characters that the description contains, whatever their case."""
    lines = F.transform(F.split(patch, "\n"), lambda x: F.btrim(x))
    kept = let(F.lower(description), lambda text: F.filter(lines, lambda x: (F.length(x) >= least) & F.contains(text, F.lower(x))))
    return F.array_sort(F.array_distinct(kept))


def redact_home(text: Column) -> Column:
    """User folders become ``~``."""
    return F.regexp_replace(text, HOME, "~")
