"""Admission, repair and recovery records, and their serialisation with a weight for each token."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.hashing import canonical_json, sha256_hex
from sievelake.operators.filters import first_reason
from sievelake.operators.records import DIGEST

#: Object names, kinds of events that are context only, and kinds of failures.
COMMIT = "^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
CONTEXT_EVENTS = ["EVIDENCE", "OBSERVATION", "TOOL_RESULT", "WRONG_HYPOTHESIS", "FAILURE_OUTPUT"]


def _stop(broken: Column, message: str, otherwise: Column) -> Column:
    return F.when(broken, F.raise_error(F.lit(message)).cast("string")).otherwise(otherwise)


def admitted(rows: DataFrame, plan: DataFrame, assignments: DataFrame, allowlist: list[str], flagged: DataFrame, parse_status: Column) -> DataFrame:
    """``doc_id``, ``reason``, ``quarantined``: why each file (doc_id, source, path, revision, license, license_sha256, digest,
    stated_digest) is not admitted; null if it is.

    In this order: its source is not in ``plan`` (source, revision, license_sha256,
    planned_split); its licence is not in the allowlist; it is not among the
    ``assignments`` (source, path, split); a training file has held-out content;
    its content came before in its split, in order of id. What stays is
    quarantined if ``flagged`` (doc_id) names it or its source doesn't parse.
    Evidence that contradicts the plan (revision, licence digest, split, content
    digest) raises: then nothing of the plan can be trusted.
    """
    held = assignments.filter("split = 'validation'").join(rows.select("source", "path", "digest"), ["source", "path"]).select("digest").distinct().withColumn("_held", F.lit(True))
    planned = plan.select("source", F.col("revision").alias("_revision"), F.col("license_sha256").alias("_license"), F.when(F.col("planned_split") == "val", "validation").otherwise(F.col("planned_split")).alias("_planned"))
    joined = rows.join(planned, "source", "left").join(assignments.withColumnRenamed("split", "_split"), ["source", "path"], "left").join(held, "digest", "left")
    c = F.col
    late = F.when((c("_split") == "train") & c("_held"), "exact_heldout_duplicate")
    late = _stop(~c("stated_digest").eqNullSafe(c("digest")), "content differs from its digest", late)
    late = _stop(c("_split") != c("_planned"), "the split differs from the plan", late)
    late = F.when(c("_split").isNull(), "not_in_frozen_retained_splits").otherwise(late)
    late = _stop(~c("license_sha256").eqNullSafe(c("_license")), "the licence's evidence changed", late)
    late = F.when(~F.coalesce(c("license").isin(allowlist), F.lit(False)), "license_not_in_reviewed_allowlist").otherwise(late)
    late = _stop(~c("revision").eqNullSafe(c("_revision")), "the revision is not the reviewed one", late)
    early = F.when(c("_planned").isNull(), "not_in_reviewed_source_plan").otherwise(late)
    marked = joined.withColumn("_early", early).withColumn("_status", parse_status)
    first = marked.filter("_early IS NULL").groupBy("_split", "digest").agg(F.min("doc_id").alias("_first"))
    marked = marked.join(first, ["_split", "digest"], "left").join(flagged.select("doc_id").distinct().withColumn("_flag", F.lit(True)), "doc_id", "left")
    gone = F.coalesce("_early", F.when(c("doc_id") != c("_first"), "exact_duplicate"))
    held_back = F.when(c("_flag"), "evaluation_overlap").when(c("_status") == "python_ast_fail", "python_ast_fail")
    return marked.select("doc_id", F.coalesce(gone, held_back).alias("reason"), (gone.isNull() & held_back.isNotNull()).alias("quarantined"))


def repair_task_fault() -> Column:
    """The first fault of a repair task (repository, issue_id, base_commit, fixed_commit, task_description, environment_hash,
    patch_sha256, fail_to_pass, pass_to_pass); null if it has none."""
    c = F.col
    wrong = lambda x, pattern: F.coalesce(~c(x).rlike(pattern), F.lit(True))
    blank = lambda x: F.coalesce(F.btrim(c(x)) == "", F.lit(True))
    none = lambda x: F.coalesce(F.size(c(x)) == 0, F.lit(True))
    turned = lambda x, before: F.forall(c(x), lambda t: (t["before_status"] == before) & (t["after_status"] == "PASS"))
    hashed = lambda x: F.forall(c(x), lambda t: F.coalesce(t["test_hash"].rlike(DIGEST), F.lit(False)))
    return first_reason([
        ("identity", blank("repository") | blank("issue_id")), ("commits", wrong("base_commit", COMMIT) | wrong("fixed_commit", COMMIT)), ("description", blank("task_description")),
        ("digests", wrong("environment_hash", DIGEST) | wrong("patch_sha256", DIGEST)), ("test_hash", ~(hashed("fail_to_pass") & hashed("pass_to_pass"))),
        ("no_fail_to_pass", none("fail_to_pass")), ("no_pass_to_pass", none("pass_to_pass")),
        ("fail_to_pass", ~turned("fail_to_pass", "FAIL")), ("pass_to_pass", ~turned("pass_to_pass", "PASS")),
    ])


def repair_id(patch_digest: Column) -> Column:
    """The name of a repair: a digest of what it repairs, by what, and where it was tested."""
    c = F.col
    fields = {"repo": c("repository"), "base": c("base_commit"), "fixed": c("fixed_commit"), "issue": c("issue_id"), "candidate_patch": patch_digest, "environment": c("environment_hash")}
    return F.concat(F.lit("forge-"), sha256_hex(canonical_json(fields)))


def repair_records(tasks: DataFrame) -> DataFrame:
    """Candidate repairs as sample records; rejected ones stay, with a reason.

    ``tasks``: the columns of ``repair_task_fault`` and candidate_patch, f2p and p2p
    (structs status, passed, test_hash, environment_hash), critic (struct verdict,
    critic_model, critic_version), generator_model, diff_inspected, fresh_context.
    Tests come first, then the inspected difference, an independent review, the
    reviewer's name, and the verdict.
    """
    c = F.col
    passed = lambda x: F.coalesce((c(f"{x}.status") == "PASS") & (c(f"{x}.passed") > 0) & (c(f"{x}.test_hash") != "") & (c(f"{x}.environment_hash") != ""), F.lit(False))
    objective = passed("f2p") & passed("p2p")
    own = F.coalesce((c("generator_model") == c("critic.critic_model")) & (c("generator_model") != ""), F.lit(False))
    unnamed = F.coalesce((c("critic.critic_model") == "") | (c("critic.critic_version") == ""), F.lit(True))
    reason = first_reason([
        ("objective_tests_failed_or_missing", ~objective), ("candidate_diff_not_inspected", ~F.coalesce(c("diff_inspected"), F.lit(False))),
        ("critic_context_not_independent", own & ~F.coalesce(c("fresh_context"), F.lit(False))), ("critic_identity_missing", unnamed),
    ])
    reason = F.coalesce(reason, F.when(~c("critic.verdict").eqNullSafe(F.lit("PASS")), F.concat(F.lit("critic_"), F.lower(F.coalesce("critic.verdict", F.lit("none"))))))
    patch = sha256_hex(c("candidate_patch"))
    tests = F.when(F.coalesce((c("f2p.test_hash") != "") & (c("p2p.test_hash") != ""), F.lit(False)), sha256_hex(canonical_json({"fail_to_pass": c("f2p.test_hash"), "pass_to_pass": c("p2p.test_hash")})))
    made = tasks.withColumn("rejection_reason", reason)
    return made.select(
        F.concat_ws(":", F.lit("forge"), "repository", "issue_id", "base_commit").alias("source_id"), repair_id(patch).alias("sample_id"), c("repository").alias("repo"), c("fixed_commit").alias("commit_sha"),
        patch.alias("candidate_patch_sha256"), tests.alias("test_hash"), "environment_hash", objective.alias("test_verified"), c("rejection_reason").isNull().alias("accepted"), "rejection_reason",
        F.when(c("rejection_reason").isNull(), "verified_posttraining").otherwise("rejected_candidate").alias("quality_tier"), repair_task_fault().alias("task_fault"),
    )


def recovery_rows(failures: DataFrame) -> DataFrame:
    """Recoveries of student failures as sample records, verified or not, with the first ``fault`` of each.

    ``failures``: parent_sample_id, sample_id, failure_type, recurrence_count,
    confidence, diagnosis, actions (array of strings), final_result,
    recovery_source, status, passed, test_hash, environment_hash.
    """
    c = F.col
    blank = lambda x: F.coalesce(F.btrim(c(x)) == "", F.lit(True))
    fault = first_reason([
        ("incomplete", blank("parent_sample_id") | blank("diagnosis") | blank("final_result") | F.coalesce(F.size("actions") == 0, F.lit(True))),
        ("failure_type", c("failure_type").isNull()), ("recurrence_count", F.coalesce(c("recurrence_count") < 1, F.lit(False))),
        ("confidence", F.coalesce(~c("confidence").between(0, 1), F.lit(False))), ("parent", ~c("parent_sample_id").eqNullSafe(c("sample_id"))), ("recovery_source", blank("recovery_source")),
    ])
    verified = F.coalesce((c("status") == "PASS") & (c("passed") > 0) & (c("test_hash") != "") & (c("environment_hash") != ""), F.lit(False))
    fields = {"parent": c("parent_sample_id"), "diagnosis": c("diagnosis"), "actions": c("actions"), "test_hash": c("test_hash"), "environment_hash": c("environment_hash")}
    return failures.select(
        F.concat(F.lit("recovery-"), sha256_hex(canonical_json(fields))).alias("sample_id"), "parent_sample_id", "failure_type", "diagnosis", verified.alias("recovery_verified"), verified.alias("accepted"),
        F.coalesce("recurrence_count", F.lit(1)).alias("recurrence_count"), c("confidence").alias("confidence_before_failure"), fault.alias("fault"),
    )


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_weights(rows: DataFrame, key: str, head: str, events: str, tokenizer_path: str, first_id: int, last_id: int) -> DataFrame:
    """``key``, ``text``, ``ids``, ``weights``, ``n_targets``: each record serialised, with a weight for each token.

    ``head`` is the task's text, ``events`` an array of structs (type, content,
    loss_mask, target_weight, known_bad). The text is the head, then each event's
    type as a header and its content; only contents have weight, mask times
    weight, and none if the event is context or known to be bad. A token has the
    weight of the span that it lies in wholly; one that crosses spans has none.
    ``first_id`` weighs nothing, ``last_id`` one. Negative or infinite weights
    raise; a record without targets has ``n_targets`` 0; null heads are empty.
    """
    schema = f"`{key}` {dict(rows.dtypes)[key]}, text string, ids array<int>, weights array<double>, n_targets int"

    def spans(head_: str, listed) -> list[tuple[str, float]]:
        out = [(f"[TASK]\n{head_}\n", 0.0)]
        for number, e in enumerate(listed):
            weight = (e["loss_mask"] if e["loss_mask"] is not None else 1.0) * (e["target_weight"] if e["target_weight"] is not None else 1.0)
            if not math.isfinite(weight) or weight < 0:
                raise ValueError("weights must be finite and not negative")
            hidden = e["known_bad"] or e["type"] in CONTEXT_EVENTS
            out += [(f"[{e['type']}]\n", 0.0), (e["content"] or "", 0.0 if hidden else weight)]
            if number + 1 < len(listed):
                out.append(("\n", 0.0))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(tokenizer_path)
        for frame in frames:
            made = []
            for name, head_, listed in frame.itertuples(index=False):
                parts = spans(head_ or "", list(listed) if listed is not None else [])
                text = "".join(p for p, _ in parts)
                ends, at = [], 0
                for p, w in parts:
                    at += len(p)
                    ends.append((at, w))
                coded = tokenizer.encode(text, add_special_tokens=False)
                weights, span, low = [], 0, 0
                for a, b in coded.offsets:
                    while span + 1 < len(ends) and ends[span][0] <= a:
                        low, span = ends[span][0], span + 1
                    weights.append(ends[span][1] if low <= a < b <= ends[span][0] else 0.0)
                made.append((name, text, [first_id, *coded.ids, last_id], [0.0, *weights, 1.0], sum(w > 0 for w in weights)))
            yield pd.DataFrame(made, columns=[key, "text", "ids", "weights", "n_targets"])

    return rows.select(key, head, events).mapInPandas(run, schema)


def tokenizer_report(rows: DataFrame, group: str, body: str, tokenizer_path: str, long: int = 20) -> DataFrame:
    """By group: documents, tokens, tokens by character, byte and line, mean tokens of identifiers and of long ones (the first
    hundred of each text), and whether all texts come back. Null texts don't count."""
    schema = "g string, tokens long, chars long, bytes long, lines long, fragments long, identifiers long, long_fragments long, long_identifiers long, back boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        tokenizer, name = _tokenizer(tokenizer_path), re.compile(r"\b[A-Za-z_][A-Za-z_0-9]{3,}\b")
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
        for frame in frames:
            made = []
            for g, text in frame.itertuples(index=False):
                ids = tokenizer.encode(text, add_special_tokens=False).ids
                names = name.findall(text)[:100]
                sizes = [count(n) for n in names]
                big = [s for n, s in zip(names, sizes) if len(n) >= long]
                made.append((g, len(ids), len(text), len(text.encode()), max(len(text.splitlines()), 1), sum(sizes), len(sizes), sum(big), len(big), tokenizer.decode(ids, skip_special_tokens=False) == text))
            yield pd.DataFrame(made, columns=[f.split()[0] for f in schema.split(", ")])

    each = rows.select(F.col(group).cast("string").alias("g"), F.col(body).alias("t")).filter("t IS NOT NULL").mapInPandas(run, schema)
    per = lambda c: F.try_divide(F.sum("tokens").cast("double"), F.greatest(F.sum(c), F.lit(1)))
    return each.groupBy(F.col("g").alias(group)).agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), per("chars").alias("per_char"), per("bytes").alias("per_byte"), per("lines").alias("per_line"),
        F.try_divide(F.sum("fragments").cast("double"), F.sum("identifiers")).alias("identifier_fragments"), F.try_divide(F.sum("long_fragments").cast("double"), F.sum("long_identifiers")).alias("long_fragments"),
        F.bool_and("back").alias("restored"),
    )


def trace_valid(token: Column, layers: Column) -> Column:
    """Whether a routing record has a token number, layers named by digits and no negative or missing expert."""
    fine = F.forall(F.map_entries(layers), lambda e: e["key"].rlike("^[0-9]+$") & F.coalesce(F.forall(e["value"], lambda x: F.coalesce(x >= 0, F.lit(False))), F.lit(False)))
    return F.coalesce(token.isNotNull() & fine, F.lit(False))


def first_definition(code: Column, name: Column) -> Column:
    """struct(line, source, status): the first function of that name, by place, in Python code; of code that doesn't parse, in
    the longest run of first lines that does. ``status``: complete, syntax_error or no_definition."""

    @F.pandas_udf("line int, source string, status string")
    def found(codes: pd.Series, names: pd.Series) -> pd.DataFrame:
        import ast

        def tree_of(text: str):
            lines = text.split("\n")
            for n in range(len(lines), 0, -1):
                try:
                    return ast.parse("\n".join(lines[:n]))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            return None

        def one(text, wanted):
            if not text or wanted is None:
                return None, None, "no_definition"
            tree = tree_of(text)
            if tree is None or not tree.body:
                return None, None, "syntax_error" if text.strip() else "no_definition"
            nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == wanted]
            if not nodes:
                return None, None, "no_definition"
            node = min(nodes, key=lambda n: (n.lineno, n.col_offset))
            return node.lineno, ast.get_source_segment(text, node), "complete"

        return pd.DataFrame([one(t, n) for t, n in zip(codes, names)], columns=["line", "source", "status"]).astype({"line": "Int32"})

    return found(code, name)
