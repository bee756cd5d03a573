"""Licence scan by canonical digests: whole texts are normalised and looked up by SHA-256.

The same column expression normalises the known texts and the scanned ones, so
any rewriting that is applied to both can only join spellings, never miss one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.text import let
from sievelake.llm.license_texts import known_texts

#: Lines that state a copyright, after lower-casing.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright( \(c\)| ©)?( |:|$)[^\n]*|(\(c\)|©)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: Words with equivalent spellings, as patterns of a whole word and what it becomes.
WORDS: list[tuple[str, str]] = [
    (r"(sub|un|)licenc(e|es|ed|ing|or|ee|ees)", "$1licens$2"),
    (r"(offen|defen|preten)ce(s|)", "$1se$2"),
    (r"(author|capital|categor|custom|emphas|final|formal|initial|maxim|minim|modern|normal|optim|organ|real|recogn|standard|summar|util)is(e|es|ed|er|ers|ing|ation|ations)", "$1iz$2"),
    (r"(anal|paral)ys(e|es|ed|ing)", "$1yz$2"),
    (r"(cent|calib|lit|fib)re(s|d|)", "$1er$2"),
    (r"(fav|lab|col|behavi|hon|harb|endeav)our(s|ed|ing|able|)", "$1or$2"),
    (r"(cance|labe|mode|signa|trave|tota)ll(ed|ing|er)", "$1l$2"),
    (r"(acknowledg|judg|abridg)ement(s|)", "$1ment$2"),
    (r"(catalog|analog|dialog|prolog)ue(s|d|)", "$1$2"),
    (r"practis(e|es|ed|ing)", "practic$1"),
    (r"artefact(s|)", "artifact$1"),
    (r"programme(s|)", "program$1"),
    (r"(ful)fil(s|ment|)", "$1fill$2"),
    (r"wilful(ly|)", "willful$1"),
    (r"whilst", "while"),
    (r"https", "http"),
]
#: Runs of words that count as another, replaced in this order after single words.
RUNS: list[tuple[str, str]] = [
    *[(f"sub licens{end}", f"sublicens{end}") for end in ("e", "es", "ed", "ing", "or", "ee", "ees")], ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("merchant ability", "merchantability"),
]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words between single spaces, one spelling of each word.

    Each word first stands between two spaces of its own, so that patterns of
    whole words match neighbours too and never a part of a word.
    """
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), "\r\n?", "\n"), COPYRIGHT_LINE, " ")
    words = F.btrim(F.regexp_replace(F.replace(lines, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", "  "))
    return let(F.concat(F.lit(" "), words, F.lit(" ")), _respelt)


def _respelt(padded: Column) -> Column:
    """One search for any spelling decides whether the replacements, none of which would change the text otherwise, are made."""
    out = padded
    for pattern, kept in WORDS:
        out = F.regexp_replace(out, f" {pattern} ", f" {kept} ")
    out = F.when(F.rlike(padded, F.lit(" (?:" + "|".join(pattern.replace("(", "(?:") for pattern, _ in WORDS) + ") ")), out).otherwise(padded)
    for run, kept in RUNS:
        out = F.replace(out, F.lit(" " + run.replace(" ", "  ") + " "), F.lit(" " + kept.replace(" ", "  ") + " "))
    return F.replace(F.btrim(out), F.lit("  "), F.lit(" "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license_digest``, ``license_id``: one row for each distinct digest, the smallest identifier first.
    Its size is that of the list of known texts, whatever the corpus."""
    listed = F.from_json(F.lit(json.dumps([{"i": i, "t": t} for i, t in known_texts() if t] if known is None else [{"i": i, "t": t} for i, t in known])), "array<struct<i:string,t:string>>")
    rows = spark.range(1).select(F.inline(listed))
    return rows.groupBy(digest(F.col("t")).alias("license_digest")).agg(F.min("i").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id``, ``text_digest``, ``license_id`` (null: no known licence) of each row.

    A null text has a null digest and no licence; a text without letters or digits
    has the digest of the empty text and no licence. Null and repeated ids stay
    rows of their own; other columns are ignored, whatever their names; an empty
    table gives no rows. One pass over the texts, no shuffle of them: the known
    digests, a constant list, are broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col).cast("string")).alias("text_digest"))
    table = F.broadcast(known_digests(docs.sparkSession, known))
    found = rows.join(table, F.col("text_digest") == F.col("license_digest"), "left")
    return found.select("doc_id", "text_digest", "license_id")
