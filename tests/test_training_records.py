import hashlib
import json
import re
import statistics

import pytest
from pyspark.sql import functions as F

from sievelake.operators import training_records as records
from sievelake.sources import readers

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


EVENT = "array<struct<type:string,content:string,loss_mask:double,target_weight:double,known_bad:boolean>>"


def test_token_weights_by_characters(spark):
    """A token's weight is that of all its characters if they agree and lie in one span."""
    rows = [
        (1, "do it", [("PLAN", "first this", 1.0, 0.5, False), ("OBSERVATION", "seen 漢字", 1.0, 1.0, False), ("ACTION", "run\nnow", 1.0, 1.0, True), ("FINAL", "done.", 1.0, 2.0, False)]),
        (2, None, [("FINAL", "", 1.0, 1.0, False)]), (3, "x", None), (4, "y", [("FINAL", None, None, None, None)]),
    ]
    frame = spark.createDataFrame(rows, f"k long, head string, events {EVENT}")
    for r in records.token_weights(frame, "k", "head", "events", TOKENIZER, 7, 9).collect():
        head, events = next((h or "", e or []) for k, h, e in rows if k == r.k)
        chars = [(c, 0, 0.0) for c in f"[TASK]\n{head}\n"]
        for i, (kind, content, mask, weight, bad) in enumerate(events):
            own = 0.0 if bad or kind == "OBSERVATION" else (1.0 if mask is None else mask) * (1.0 if weight is None else weight)
            chars += [(c, 3 * i + 1, 0.0) for c in f"[{kind}]\n"] + [(c, 3 * i + 2, own) for c in content or ""] + [(c, 3 * i + 3, 0.0) for c in "\n" * (i + 1 < len(events))]
        assert r.text == "".join(c for c, _, _ in chars)
        coded = library().encode(r.text, add_special_tokens=False)
        want = [chars[a][2] if b > a and len({s for _, s, _ in chars[a:b]}) == 1 else 0.0 for a, b in coded.offsets]
        assert r.ids == [7, *coded.ids, 9] and r.weights == [0.0, *want, 1.0] and r.n_targets == sum(w > 0 for w in want)
    bad = spark.createDataFrame([(1, "x", [("FINAL", "y", 1.0, -1.0, False)])], f"k long, head string, events {EVENT}")
    with pytest.raises(Exception, match="not negative"):
        records.token_weights(bad, "k", "head", "events", TOKENIZER, 7, 9).collect()


def test_tokenizer_report(spark):
    texts = [("a", "some_long_identifier_name_here = value\nnext_line"), ("a", ""), ("b", "漢字 😺"), ("b", None), ("c", " ".join(f"name{i}" for i in range(150)))]
    got = {r.g: r for r in records.tokenizer_report(spark.createDataFrame(texts, "g string, t string"), "g", "t", TOKENIZER).collect()}
    count = lambda t: len(library().encode(t, add_special_tokens=False).ids)
    for g in "abc":
        mine = [t for k, t in texts if k == g and t is not None]
        names = [n for t in mine for n in re.findall(r"\b[A-Za-z_]\w{3,}\b", t, re.A)[:100]]
        r, tokens = got[g], sum(map(count, mine))
        assert (r.documents, r.tokens, r.restored) == (len(mine), tokens, True)
        assert r.per_char == pytest.approx(tokens / max(1, sum(map(len, mine)))) and r.per_line == pytest.approx(tokens / sum(max(len(t.splitlines()), 1) for t in mine))
        assert r.identifier_fragments == (pytest.approx(statistics.mean(map(count, names))) if names else None)


def test_first_definition(spark):
    rows = [
        ("def f():\n  return 1\ndef f(x):\n  return 2", "f", 1, "complete"), ("x = 1\nasync def g(): pass\n", "g", 2, "complete"), ("class A:\n  def f(self): pass\ndef f(): pass", "f", 2, "complete"),
        ("def f():\n  return 1\ndef h(:\n", "f", 1, "complete"), ("def f(:", "f", None, "syntax_error"), ("y = 2", "f", None, "no_definition"), (None, "f", None, "no_definition"), ("", "f", None, "no_definition"),
    ]
    frame = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i long, code string, name string")
    got = {r.i: r.x for r in frame.select("i", records.first_definition(F.col("code"), F.col("name")).alias("x")).collect()}
    assert [(got[i].line, got[i].status) for i in range(len(rows))] == [r[2:] for r in rows]
    assert got[0].source == "def f():\n  return 1" and got[2].source == "def f(self): pass"


def test_shards_and_traces_abort(spark, tmp_path):
    body = b'{"a": 1}\n\n{"a": 2}\n'
    digest = hashlib.sha256(body).hexdigest()
    files = spark.createDataFrame([("x", bytearray(body)), ("unlisted", bytearray(b"{"))], "path string, content binary")
    for manifest, fault in (([("x", digest, 2)], None), ([("x", digest, 3)], "number of records"), ([("x", "0" * 64, 2)], "digest"), ([("x", digest, 2), ("y", digest, 2)], "missing")):
        rows = readers.verified_shards(files, spark.createDataFrame(manifest, "path string, sha256 string, records long"), "a long")
        if fault:
            with pytest.raises(Exception, match=fault):
                rows.collect()
        else:
            assert sorted((r.path, r.a) for r in rows.collect()) == [("x", 1), ("x", 2)]
    good = [{"token": i, "layers": {"0": [1, 2], "11": []}} for i in range(5)]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in good))
    assert readers.capped_traces(spark, str(path), 3).count() == 3
    for bad in ({"token": None, "layers": {}}, {"token": 1, "layers": {"x": [1]}}, {"token": 1, "layers": {"1": [-1]}}, {"token": 1, "layers": None}):
        path.write_text(json.dumps(bad))
        with pytest.raises(Exception, match="invalid routing record"):
            readers.capped_traces(spark, str(path)).collect()


@pytest.mark.parametrize("change", [{"revision": "r2"}, {"license_sha256": "l2"}, {"stated_digest": "other"}, {"split": "validation"}])
def test_evidence_that_contradicts_the_plan_aborts(spark, change):
    row = {"doc_id": 1, "source": "s", "path": "p", "revision": "r1", "license": "MIT", "license_sha256": "l1", "digest": "d", "stated_digest": "d"}
    plan = spark.createDataFrame([("s", "r1", "l1", "train")], "source string, revision string, license_sha256 string, planned_split string")
    flagged = spark.createDataFrame([], "doc_id long")
    for changed in ({}, change):
        rows = spark.createDataFrame([tuple((row | {k: v for k, v in changed.items() if k in row}).values())], "doc_id long, " + ", ".join(f"{k} string" for k in list(row)[1:]))
        assignments = spark.createDataFrame([("s", "p", changed.get("split", "train"))], "source string, path string, split string")
        made = records.admitted(rows, plan, assignments, ["MIT"], flagged, F.lit("python_ast_pass"))
        if changed:
            with pytest.raises(Exception):
                made.collect()
        else:
            assert [tuple(r) for r in made.collect()] == [(1, None, False)]


def test_trace_edges(spark):
    rows = spark.createDataFrame([(1, {"0": [1]}), (1, {}), (None, {}), (1, {"0": None}), (1, {"0": [None]}), (1, None)], "t long, l map<string,array<long>>")
    got = [r.v for r in rows.select(records.trace_valid(F.col("t"), F.col("l")).alias("v")).collect()]
    assert got == [True, True, False, False, False, False]
