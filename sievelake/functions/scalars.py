"""Classification, schedule and scoring expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.hashing import prefix_number, sha256_hex

#: Languages by extension and by file name, and what counts as build and configuration files.
LANGUAGE_OF_EXTENSION = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".c": "C", ".h": "C", ".cpp": "C++", ".hpp": "C++",
    ".cc": "C++", ".hh": "C++", ".c++": "C++", ".h++": "C++", ".rs": "Rust", ".java": "Java", ".cs": "C#", ".go": "Go", ".sql": "SQL",
    ".sh": "Bash", ".bash": "Bash", ".zsh": "Bash", ".html": "HTML/CSS", ".css": "HTML/CSS", ".md": "Markdown", ".markdown": "Markdown",
    ".rb": "Ruby", ".php": "PHP", ".lua": "Lua", ".pl": "Perl", ".scala": "Scala", ".jl": "Julia", ".hs": "Haskell", ".asm": "Assembly",
    ".f90": "FORTRAN", ".f": "FORTRAN", ".tex": "TeX", ".ps1": "PowerShell", ".psd1": "PowerShell", ".bat": "Batchfile", ".cmd": "Batchfile",
    ".vb": "Visual Basic", ".cmake": "CMake", ".dockerfile": "Dockerfile",
}
LANGUAGE_OF_NAME = {"Makefile": "Makefile", "Dockerfile": "Dockerfile", "CMakeLists.txt": "CMake"}
LANGUAGE_ALIASES = {"GO": "Go", "Shell": "Bash", "HTML": "HTML/CSS", "CSS": "HTML/CSS"}
TEST_PARTS = ["test", "tests", "__tests__", "testing"]
BUILD_NAMES = ["package.json", "pyproject.toml", "cargo.toml", "go.mod"]
CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".csproj", ".props", ".targets"]
DOC_EXTENSIONS = [".md", ".rst", ".txt"]
HIGH_VALUE_FAILURES = [
    "invented_api", "false_assumption", "misread_test", "loop_after_correct", "continued_after_complete", "stopped_too_early",
    "failed_recovery", "ignored_evidence",
]


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """A literal map's value, null where the key is absent."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix of the name with its dot; empty without one or for a leading dot alone."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def role(path: Column) -> Column:
    """documentation, test, build, configuration or implementation: the first that fits."""
    name, parts = file_name(path), F.transform(F.split(path, "/"), lambda x: F.lower(x))
    base = F.lower(name)
    is_test = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in TEST_PARTS])) | base.startswith("test_") | base.rlike(r"(_test\.go|\.test\.js|\.spec\.ts)$")
    return (
        F.when(extension(path).isin(DOC_EXTENSIONS), "documentation")
        .when(is_test, "test")
        .when(name.isin(list(LANGUAGE_OF_NAME)) | base.isin(BUILD_NAMES), "build")
        .when(extension(path).isin(CONFIG_EXTENSIONS), "configuration")
        .otherwise("implementation")
    )


def kind_of_role(name: Column) -> Column:
    return F.when(name == "documentation", "technical").when(name.isin("build", "configuration"), "context").otherwise("code")


def language(path: Column, header_language: str = "C") -> Column:
    found = F.coalesce(lookup(LANGUAGE_OF_NAME, file_name(path)), lookup(LANGUAGE_OF_EXTENSION, extension(path)))
    return F.when(extension(path) == ".h", header_language).otherwise(found)


def language_alias(declared: Column, inferred: Column) -> Column:
    name = F.coalesce(declared, inferred)
    return F.coalesce(lookup(LANGUAGE_ALIASES, name), name)


def spdx_expression(text: Column) -> Column:
    found = F.regexp_extract(F.substring(text, 1, 3000), r"SPDX-License-Identifier:[ \t]*([^\r\n]+)", 1)
    return F.nullif(F.regexp_replace(F.btrim(found), r"[*/ ]+$", ""), F.lit(""))


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www[.]", ""), F.lit(""))


def corpus_kind(text: Column, lang: Column) -> Column:
    """Markdown is technical, a tenth of all other texts (by hash) is context, the rest code."""
    tenth = prefix_number(sha256_hex(text), 8) % 10 == 0
    return F.when(lang == "Markdown", "technical").when(tenth, "context").otherwise("code")


def foundation_category(role_name: Column, kind: Column) -> Column:
    return (
        F.when(role_name.isin("tests", "test", "test_code"), "issues_prs_commits_tests_reviews")
        .when(kind == "technical", "technical_documentation_text_to_code")
        .when(kind == "general", "algorithms_math_reasoning")
        .otherwise("file_level_code")
    )


def next_power_of_two(n: Column) -> Column:
    """Smallest power of two that is at least n (and 1)."""
    bits = F.length(F.bin(F.greatest(n.cast("long"), F.lit(1).cast("long")) - 1))
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), bits).cast("long"))


def failure_priority(recurrences: Column, failure: Column, verified: Column, confident_wrong: Column) -> Column:
    point = lambda c, x: F.when(c, x).otherwise(0.0)
    return 1.0 + F.least(recurrences - 1, F.lit(10)) * 0.5 + point(failure.isin(HIGH_VALUE_FAILURES), 2.0) + point(verified, 2.0) + point(confident_wrong, 1.0)


def learning_rate(step: Column, peak: float, warmup: int, total: int, min_ratio: float) -> Column:
    """Linear warm-up, then a cosine down to ``min_ratio`` of the peak."""
    share = F.least((step - warmup) / F.lit(float(max(total - warmup, 1))), F.lit(1.0))
    cosine = 0.5 * (1 + F.cos(share * math.pi))
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup)) * peak).otherwise((min_ratio + (1 - min_ratio) * cosine) * peak)


def perplexity_ratio(delta: Column) -> Column:
    return F.exp(delta)


def nats_to_bits(loss: Column) -> Column:
    return loss / math.log(2)


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within a relative or absolute tolerance."""
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def arrays_close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(close(x, y, tolerance), F.lit(False))), lambda ok: ok)


def head_tail(items: Column, room: int) -> Column:
    """All items if they fit, else the first half of the room and the last half, without the middle."""
    head, tail = room // 2, room - room // 2
    return F.when(F.size(items) <= room, items).otherwise(F.concat(F.slice(items, 1, head), F.slice(items, -tail, tail)))


def continuation_kind(complete: Column, tail: Column, repeated: Column, damaged: Column, overwritten: Column) -> Column:
    """What follows a generated target, the first that fits."""
    return (
        F.when(~complete, "no_complete_target")
        .when(F.btrim(tail) == "", "none")
        .when(repeated, "repetition_after_target")
        .when(damaged, "syntax_damage_after_target")
        .when(overwritten, "target_redefined_after_correct")
        .when(tail.rlike(r"(?m)^\s*(?:async\s+)?def\s+"), "additional_definition")
        .otherwise("other_trailing_content")
    )


def target_outcome(outcome: Column, violated: Column) -> Column:
    named = {"pass": "TARGET_PASS", "wrong": "WRONG_ANSWER", "syntax_error": "SYNTAX_ERROR", "runtime_error": "RUNTIME_ERROR", "timeout": "TIMEOUT"}
    return F.when(violated, "EXPLICIT_CONSTRAINT_VIOLATION").otherwise(F.coalesce(lookup(named, outcome), F.lit("INCOMPLETE")))


def stop_metrics(required: Column, natural_stop: Column, complete: Column) -> dict[str, Column]:
    return {
        "premature_stop": required & natural_stop & ~complete,
        "missed_stop": required & ~natural_stop & complete,
        "correct_stop": required & natural_stop & complete,
    }


def parameter_count(layers: Column, width: Column, vocabulary: Column, ratio: float = 4.0) -> Column:
    """Weights of a dense decoder: attention, two-matrix feed-forward of ``ratio`` widths, norms and shared embeddings."""
    return layers * (4 * width * width + F.lit(int(2 * ratio)) * width * width + 2 * width) + vocabulary * width + width
