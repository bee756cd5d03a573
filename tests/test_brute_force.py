"""Operators that SQL cannot express, against plain Python."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from sievelake import catalog
from sievelake.functions import scalars, text
from sievelake.operators import digests, evalstats, filters, neardup, overlap, routing, select, simulate, transform
from sievelake.operators import dedup as dedup_ops
from sievelake.sources import readers, settings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def budget_brute(rows, budget):
    total = sum(n for _, _, n, _ in rows)
    if total <= budget:
        return {k for k, *_ in rows}
    kept, left_over = set(), []
    for stratum in {s for _, s, _, _ in rows}:
        mine = sorted((r, k, n) for k, s, n, r in rows if s == stratum)
        quota = budget * sum(n for _, _, n in mine) // total
        for r, k, n in mine:
            if n <= quota:
                quota -= n
                kept.add(k)
            else:
                left_over.append((r, k, n))
    room = budget - sum(n for k, _, n, _ in rows if k in kept)
    for _, k, n in sorted(left_over):
        if n <= room:
            room -= n
            kept.add(k)
    return kept


@pytest.mark.parametrize("budget", [64, 700, 10_000])
def test_token_budget(spark, budget):
    rows = [(i, f"s{i % 3}", 5 + i * 7 % 41, hashlib.sha256(str(i).encode()).hexdigest()[:32]) for i in range(60)]
    frame = spark.createDataFrame(rows, "key long, stratum string, size long, rank string").repartition(3)
    got = {r.key for r in select.token_budget(frame, "key", "stratum", "size", "rank", budget).collect()}
    assert got == budget_brute(rows, budget)
    assert budget < 9999 or len(got) == 60


def test_greedy_keep_is_not_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (5, 9), (6, 9), (7, 8)]
    rows = spark.range(1, 11).withColumnRenamed("id", "k")
    kept = {r.k for r in neardup.greedy_keep(rows, spark.createDataFrame(pairs, "a long, b long"), "k").collect() if r.kept}
    want = set()
    for k in range(1, 11):
        if not any((a, k) in pairs and a in want for a in range(1, k)):
            want.add(k)
    assert kept == want == {1, 3, 5, 6, 7, 10}


def cache_row(spark, tokens, sizes, **scenario):
    trace = spark.createDataFrame([(i, list(p), list(q)) for i, (p, q) in enumerate(tokens)], "order long, pages array<long>, predicted array<long>")
    base = {"scenario": "a", "vram_bytes": 200, "ram_bytes": 300, "policy": "lru", "pinned": [], "ssd_bytes_s": 100.0, "ssd_latency_s": 0.5, "ram_bytes_s": 1000.0, "ram_latency_s": 0.0, "prefetch_window_s": 0.0}
    return simulate.cache_replay(trace, sizes, spark.createDataFrame([tuple((base | scenario).values())], simulate.SCENARIO)).first()


def test_cache_by_hand(spark):
    row = cache_row(spark, [([p], []) for p in (0, 1, 0, 2, 0)], {0: 100, 1: 100, 2: 100})
    assert (row.tokens, row.accesses, row.vram_hits, row.ram_hits, row.reads, row.evictions, row.bytes_ssd, row.bytes_ram) == (5, 5, 2, 0, 3, 1, 300, 300)
    assert abs(row.stall - 3 * (1.0 + 0.5 + 0.1)) < 1e-9


def test_cache_prefetch_by_hand(spark):
    """Token 0 starts page 1 (all of its 1.6 s fits the window), token 1 uses it; what token 1 starts for page 2 is never used."""
    row = cache_row(spark, [([0], [1]), ([1], [2]), ([0], [])], {0: 100, 1: 100, 2: 100}, prefetch_window_s=2.0)
    assert (row.issued_bytes, row.useful_bytes, row.wasted_bytes, row.reads, row.bytes_ssd) == (200, 100, 100, 3, 300)
    assert abs(row.hidden - 1.6) < 1e-9 and abs(row.stall - (1.6 + 0.0 + 1.6)) < 1e-9
    short = cache_row(spark, [([0], [1]), ([1], [])], {0: 100, 1: 100}, prefetch_window_s=0.4)
    assert abs(short.hidden - 0.4) < 1e-9 and abs(short.stall - (1.6 + 1.2)) < 1e-9


def test_cache_policies():
    sizes = {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 3}
    tier = simulate.Tier(2, sizes, "lfu")
    assert [tier.use(p) for p in (1, 1, 2, 3, 1)] == [False, True, False, False, True] and set(tier.held) == {1, 3}
    pinned = simulate.Tier(1, sizes, "lru", frozenset([7]))
    assert [pinned.use(p) for p in (7, 8, 7)] == [False, False, True]
    large = simulate.Tier(3, sizes, "lru")
    assert [large.use(p) for p in (1, 2, 9, 1)] == [False, False, False, False] and large.evictions == 3


def test_leases(spark):
    events = [("t", 0.0, 1, "lease", "a"), ("t", 5.0, 2, "lease", "b"), ("t", 9.0, 3, "complete", "b"), ("t", 12.0, 4, "lease", "b"), ("t", 13.0, 5, "complete", "a"), ("t", 14.0, 6, "complete", "b"), ("u", 1.0, 7, "complete", "a")]
    rows = simulate.lease_states(spark.createDataFrame(events, "task string, at double, event long, kind string, owner string"), 10.0).collect()
    assert {(r.task, r.status, r.owner, r.n_leases) for r in rows} == {("t", "done", "b", 2), ("u", "pending", None, 0)}


def test_expert_pages(spark):
    load = spark.createDataFrame([(0, 5), (1, 4), (2, 3), (3, 1)], "expert long, n long")
    edges = spark.createDataFrame([(0, 2, 9), (1, 3, 2)], "a long, b long, weight long")
    assert routing.expert_pages(load, edges, 2) == {0: 0, 2: 0, 1: 1, 3: 1}
    assert routing.expert_pages(load, edges.limit(0), 3) == {0: 0, 1: 0, 2: 0, 3: 1}
    assert routing.expert_pages(load.limit(0), edges, 2) == {}


def spark_xxhash64(*values):
    """The engine's seeded chain of hashes over whole numbers."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i" if isinstance(v, Int) else "<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Int(int):
    """A 32-bit number."""


def test_seeded_shuffle_values(spark):
    rows = catalog.QUERIES["seeded_shuffle"](spark, SF).collect()
    for epoch in (0, 1):
        groups = {}
        for r in rows:
            groups.setdefault(r.source, []).append(r)
        for mine in groups.values():
            want = sorted(mine, key=lambda r: (spark_xxhash64(Int(42 + epoch), r.doc_id), r.doc_id))
            assert [getattr(r, f"epoch_{epoch}") for r in want] == list(range(1, len(want) + 1))


def test_synthetic_mixture_values(spark):
    def kind(i):
        draw = spark_xxhash64(Int(7), i) % 100
        return "code" if draw < 50 else "general" if draw < 80 else "technical" if draw < 95 else "context"

    want = {}
    for i in range(1000):
        want[kind(i)] = want.get(kind(i), 0) + 1
    assert {r["kind"]: r["n"] for r in catalog.QUERIES["synthetic_mixture"](spark, SF).collect()} == want
    made = readers.synthetic(spark, 3, 7).orderBy("id").collect()
    assert made[1].text.split()[4] == hashlib.sha256(b"7:1:5").hexdigest()[:5] and len(made[2].text.split()) == 20


def test_bpe_token_counts_values(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    rows = catalog.QUERIES["bpe_token_counts"](spark, SF)
    for r in rows.collect():
        ids = library.encode(texts[r.conv_id, r.turn], add_special_tokens=False).ids
        named = {c for c in rows.columns if "token" in c}
        assert len(ids) in [r[c] for c in named]


def test_python_parse_values(spark):
    import ast as syntax

    bodies = ["x = 1", "def f(:", "", "a\x00b", "class A:\n  pass", "print 'old'"]
    frame = spark.createDataFrame(list(enumerate(bodies)), "i long, t string")
    got = {r.i: r.d for r in frame.select("i", neardup.syntax_digest(F.col("t")).alias("d")).collect()}
    for i, body in enumerate(bodies):
        try:
            want = hashlib.sha256(syntax.dump(syntax.parse(body)).encode()).hexdigest()
        except (SyntaxError, ValueError):
            want = None
        assert got[i] == want


def test_removal_reasons(spark):
    """Copies of a file that goes, go for its reason; trees count for short Python alone; long files by their shingles."""
    long = "\n".join(f"value_{i} = call_{i}(first, second)" for i in range(60))
    files = [
        ("a", "x = 1\n", True), ("b", "x  =  1", True), ("c", "x = 1\r\n", True), ("d", "x  =  1", True), ("e", "x  =  1", False), ("f", "bad (", True), ("g", "bad (", True),
        ("h", long, True), ("i", long.replace("call_7(", "other("), True), ("j", long.replace("call_7(", "other("), True), ("k", None, True), ("l", None, True),
    ]
    frame = spark.createDataFrame(files, "k string, t string, p boolean")
    got = {r.k: r.reason for r in neardup.removal_reasons(frame, "k", "t", F.col("p")).collect()}
    want = dict.fromkeys("aefhkl") | {"b": "short_ast_duplicate", "c": "exact_normalized", "d": "short_ast_duplicate", "g": "exact_normalized", "i": "near_duplicate", "j": "near_duplicate"}
    want["e"] = "short_ast_duplicate"
    assert got == want


def test_hot_shingles_are_dealt(spark, monkeypatch):
    """One passage that all texts share: the pairs are those of one task."""
    monkeypatch.setattr(neardup, "PART", 5)
    rows = [(i, f"{i % 3} " + " ".join(f"w{k}" for k in range(90)) + f" tail{i}") for i in range(40)]
    sets = neardup.shingle_sets(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    got = {(r.a, r.b) for r in neardup.similar_pairs(sets, "k").collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    banded = {(r.a, r.b) for r in neardup.band_pairs(sets, "k").collect()}
    assert banded <= got and len(banded) > 300


@pytest.mark.parametrize("target", [0, 1, 7, 20, 58, 59, 1000])
def test_bundles_by_turns(spark, target):
    bundles = [(f"g{i % 4}", i, (i * 7) % 6) for i in range(24)] + [("g9", 99, None)]
    turns, groups = {}, {}
    for g, i, n in bundles:
        groups.setdefault(g, []).append((i, n or 0))
    order = sorted((t, g, i, n) for g, items in groups.items() for t, (i, n) in enumerate(sorted(items)))
    total, want = 0, []
    for t, g, i, n in order:
        if n and total + n <= target:
            total += n
            want.append((g, i, n, t + 1))
    assert not turns
    frame = spark.createDataFrame(bundles, "g string, i long, n long").repartition(3)
    assert sorted(tuple(r) for r in select.bundle_round_robin(frame, "g", "i", "n", target).collect()) == sorted(want)


def plain_token_cut(body, digest, library, least):
    """The rule step by step, as a list of all cuts that are tried."""
    encoded = library.encode(body, add_special_tokens=False)
    if len(encoded.ids) < 3 * least:
        return "not eligible"
    places = sorted({a for a, _ in encoded.offsets if 0 < a < len(body)})
    if len(places) < 2:
        return None
    tried = []
    for k in range(31):
        h = hashlib.sha256(digest + bytes([0, k])).hexdigest()
        a = int(h[:16], 16) % (len(places) - 1)
        tried.append((places[a], places[a + 1 + int(h[16:32], 16) % (len(places) - a - 1)]))
    n = len(encoded.ids)
    tried.append((encoded.offsets[n // 3][0], encoded.offsets[2 * n // 3][0]))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    return next(((a, b) for a, b in tried if min(count(body[:a]), count(body[a:b]), count(body[b:])) >= least), None)


def test_token_minimums(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = [" ".join(f"name{i * k % 53} =" for i in range(n)) for k, n in ((3, 5), (5, 12), (7, 13), (11, 60), (13, 300))] + ["é漢字😺 " * 40, "x" * 400, "", None]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i long, t string, start int").drop("start")
    made = transform.fill_in_middle_tokens(frame, "t", F.lit(True), F.col("i").cast("string"), 1.1, "/opt/tokenizers/byte_bpe_50k.json").collect()
    seen = set()
    for r in made:
        want = "not eligible" if r.t is None else plain_token_cut(r.t, hashlib.sha256(str(r.i).encode()).digest(), library, 16)
        assert r.eligible == (want != "not eligible") and r.applied == isinstance(want, tuple)
        seen.add((r.eligible, r.applied))
        if r.applied:
            assert (r.start, r.stop) == want and min(r.span_tokens) >= 16
            assert r.fim_text == f"<fim_prefix>{r.t[: r.start]}<fim_suffix>{r.t[r.stop :]}<fim_middle>{r.t[r.start : r.stop]}"
        else:
            assert r.fim_text == r.t and (r.skip_reason == "no_valid_token_spans") == r.eligible
    assert seen >= {(False, False), (True, True)}


def test_line_ends_of_all_kinds(spark):
    texts = ["a\rb\r\nc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k\n", "one\r\n", "\n\n\n", "no end", "x\ny", ""]
    frame = spark.createDataFrame([(i, t * 3) for i, t in enumerate(texts)], "i long, t string")
    for r in transform.fill_in_middle(frame, "t", F.lit(True), F.col("i").cast("string"), 1.1).collect():
        ends, at = [], 0
        for line in r.t.splitlines(keepends=True):
            at += len(line)
            ends += [at] if at < len(r.t) else []
        assert r.cut_unit == ("line_boundary" if len(ends) >= 2 else "unicode_character")
        if len(ends) >= 2:
            h = hashlib.sha256(str(r.i).encode()).hexdigest()
            a = int(h[16:32], 16) % (len(ends) - 1)
            b = a + 1 + int(h[32:48], 16) % (len(ends) - a - 1)
            assert (r.start, r.stop) == (ends[a], ends[b])


def test_ordered_digest(spark):
    rows = [(k, i, f"{k}-{i}") for k in ("a", "b") for i in range(50)] + [("c", 1, None)]
    frame = spark.createDataFrame(rows, "k string, i long, line string").repartition(7)
    got = {r.k: r.digest for r in digests.ordered_digest(frame, ["k"], "i", F.col("line")).collect()}
    assert got == {k: hashlib.sha256("\n".join(t or "" for kk, _, t in rows if kk == k).encode()).hexdigest() for k in "abc"}
    assert [r.digest for r in digests.ordered_digest(frame.limit(0), [], "i", F.col("line")).collect()] == [hashlib.sha256(b"").hexdigest()]


def test_prompt_prose_and_screen(spark):
    words = " ".join(f"word{i}" for i in range(14))
    tasks = [(1, f'def f():\n    """ # {words}\n    >>> f()\n    1\n    """', "short"), (2, f"# {words} more", " ".join(f"ref{i}" for i in range(32))), (3, "few words", " ".join(f"ref{i}" for i in range(31))), (4, None, None)]
    registry = spark.createDataFrame(tasks, "id long, prompt string, reference string")
    rows = spark.createDataFrame([(1, f"says {words} here"), (2, f"{words} MORE"), (3, " ".join(f"ref{i}" for i in range(40))), (4, words.replace("word7", "other")), (5, None)], "k long, t string")
    got = {tuple(r) for r in overlap.task_screen(rows, "k", "t", registry, "id", "prompt", "reference").collect()}
    assert got == {(1, 1, "prompt"), (2, 1, "prompt"), (2, 2, "prompt"), (3, 2, "reference")}


def test_a_large_reference_index_is_dealt(spark, monkeypatch):
    """Broadcast or dealt to parts, the hits are the same; one passage lies in a third of the rows."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = spark.createDataFrame([(i, f"x{i} {passage if i % 3 == 0 else ''} " + " ".join(f"r{i % 5}w{k}" for k in range(12))) for i in range(90)], "k long, t string")
    refs = spark.createDataFrame([(1, passage), (2, " ".join(f"r3w{k}" for k in range(12))), (3, "not there at all " * 4)], "r long, b string")
    found = []
    for small in (2_000_000, 0):
        monkeypatch.setattr(overlap, "SMALL", small)
        found.append(({tuple(r) for r in overlap.shingle_overlap(rows, "k", "t", refs, "r", "b").collect()}, {tuple(r) for r in overlap.phrase_containment(rows, "k", "t", refs, "r", "b").collect()}))
    assert found[0] == found[1] and len(found[0][0]) == 30 + 18 and len(found[0][1]) == 30 + 18


def test_field_retention(spark):
    facts = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", "z"), (2, "a", "q")], "k long, f string, v string")
    back = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", "Z"), (1, "extra", "e")], "k long, f string, v string")
    got = {r.k: (r.n_fields, r.n_exact, r.lost) for r in simulate.field_retention(facts, back, "k", "f", "v").collect()}
    assert got == {1: (3, 2, ["c"]), 2: (1, 0, ["a"])}


def test_settings_overlay():
    files = {"a/base.json": '{"model": {"width": 4, "heads": [1, 2]}, "seed": 1}', "a/mid.json": '{"extends": "base.json", "model": {"heads": [3]}}', "a/top.json": '{"extends": "mid.json", "seed": {"x": 2}, "model": {"depth": 2}}', "a/ring.json": '{"extends": "ring.json"}'}
    assert settings.resolved("a/top.json", files.__getitem__) == {"model": {"width": 4, "heads": [3], "depth": 2}, "seed": {"x": 2}}
    base = {"a": {"b": 1}}
    assert settings.overlaid(base, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}} and base == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        settings.resolved("a/ring.json", files.__getitem__)


def test_streaming_leases_against_a_replay(spark):
    """The last state of each task, with timers for leases that nothing follows."""
    rows = sorted((r.ts.timestamp(), r.event_id, r.event_type, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    last, state = max(r[0] for r in rows), {}
    for at, event, kind, user in rows:
        status, owner, until, n = state.get(event % 97, ("pending", None, 0.0, 0))
        if status == "leased" and until <= at:
            status, owner = "pending", None
        if kind != "purchase" and status == "pending":
            status, owner, until, n = "leased", str(user % 3), at + 3600.0, n + 1
        elif kind == "purchase" and status == "leased" and owner == str(user % 3):
            status = "done"
        state[event % 97] = (status, owner, until, n)
    want = {}
    for task, (status, owner, until, n) in state.items():
        ended = status == "leased" and until < last - 0.01
        want[task] = ("pending", None, n) if ended else (status, owner, n)
    got = {r.task: (r.status, r.owner, r.n_leases) for r in catalog.QUERIES["streaming_leases"](spark, SF).collect()}
    assert {k: v for k, v in want.items() if v[2]} == got


def test_lsh_finds_the_exact_pairs(spark):
    """Bands find what the inverted index finds, among groups of near copies; the query runs over distinct sets."""
    rows = [(g * 10 + c, " ".join(f"g{g}w{i}" if i % 150 != c * 7 else f"c{c}" for i in range(300))) for g in range(12) for c in range(5)]
    sets = neardup.shingle_sets(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    exact = {(r.a, r.b) for r in neardup.similar_pairs(sets, "k", 0.8).collect()}
    banded = {(r.a, r.b) for r in neardup.band_pairs(sets, "k").collect()}
    assert len(exact) > 100 and len(exact & banded) >= 0.99 * len(exact)
    row = catalog.QUERIES["near_dup_lsh_recall"](spark, "/root/testdata/sf0.01").first()
    assert row.n_found == row.n_pairs > 0


def test_pass_at_k_by_hand(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "task string, ok boolean")
    one, two = (evalstats.pass_at_k(rows, "task", F.col("ok"), k).first() for k in (1, 2))
    assert (one.pass_at_k, one.n_excluded, two.pass_at_k, two.n_excluded) == (0.25, 0, 1.0, 1)


def test_bootstrap_holds_the_mean(spark):
    clusters = spark.createDataFrame([(f"c{i}", float(i % 3), 1.0) for i in range(30)], "c string, v double, w double")
    row = evalstats.cluster_bootstrap(clusters, "c", "v", "w", 300).first()
    assert row.low < 1.0 < row.high and abs(row.mean - 1.0) < 0.1


def test_repeats(spark):
    texts = ["a b c a b c d e f g h i", "a b c d e f g h i j k l", "x y z x y z", "abcdefghi" * 3, "plain words only"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: (r.a, r.p) for r in rows.select("i", text.adjacent_repeat(text.lexemes(F.col("t"))).alias("a"), text.phrase_repeat(F.col("t")).alias("p")).collect()}
    assert got == {0: (True, False), 1: (False, False), 2: (False, False), 3: (False, True), 4: (False, False)}


def test_home_redaction(spark):
    row = spark.createDataFrame([("/home/me/x C:\\Users\\Me\\y a/home/no",)], "t string").select(text.redact_home(F.col("t")).alias("t")).first()
    assert row.t == "~/x ~\\y a/home/no"


def test_nucleus(spark):
    rows = spark.createDataFrame([("k", i, p) for i, p in enumerate([0.5, 0.3, 0.16, 0.04])], "k string, i int, p double")
    got = {r.i: round(r.share, 6) for r in routing.nucleus(rows, ["k"], "p", "i").collect()}
    assert got == {0: round(0.5 / 0.96, 6), 1: round(0.3 / 0.96, 6), 2: round(0.16 / 0.96, 6)}


def test_powers_of_two(spark):
    got = {r.n: r.b for r in spark.range(-1, 70).select(F.col("id").alias("n"), scalars.next_power_of_two(F.col("id")).alias("b")).collect()}
    assert all(b == 1 << (max(1, n) - 1).bit_length() for n, b in got.items())


def test_reasons_keep_their_order_and_quarantine_holds_no_text(spark):
    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "i long, t string")
    reason = filters.first_reason([("null", F.col("t").isNull()), ("empty", F.col("t") == ""), ("any", F.col("i") > 1)])
    good, bad = filters.split_reasons(rows, reason, ["i"])
    assert [r.i for r in good.collect()] == [1] and {(r.i, r.reason) for r in bad.collect()} == {(2, "empty"), (3, "null")} and bad.columns == ["i", "reason"]


def test_exact_dedup_whatever_the_order(spark):
    rows = [(i, f"k{i % 4}") for i in range(40)]
    for shuffled in itertools.islice(itertools.permutations([rows[:20], rows[20:]]), 2):
        frame = spark.createDataFrame(sum(shuffled, []), "i long, k string").repartition(5)
        assert {r.i for r in dedup_ops.exact_dedup(frame, ["k"], ["i"]).collect()} == {0, 1, 2, 3}
