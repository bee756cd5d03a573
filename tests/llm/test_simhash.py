from collections import defaultdict

import numpy as np
import pytest
import xxhash

from sievelake.llm import simhash
from sievelake.llm.queries import op4_simhash


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    n, root = len(prints), list(range(len(prints)))
    for _ in range(n):
        changed = False
        for i in range(n):
            for j in range(n):
                if (prints[i] ^ prints[j]).bit_count() <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
        if not changed:
            break
    return root


def test_random_tiles_against_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(simhash, "SUB", 8)
    for words, radius in ((1, 2), (1, 5), (2, 9)):
        base = rng.integers(0, 2**63, (12, words), dtype=np.uint64)
        rows = base[rng.integers(0, 12, 90)].copy()
        for row in rows:
            for _ in range(rng.integers(0, 5)):
                row[rng.integers(0, words)] ^= np.uint64(1 << int(rng.integers(0, 64)))
        for split in (90, 40):
            right = None if split == 90 else rows[split:]
            found = simhash.tile_links(rows[:split], right, radius)
            label = list(range(90))
            for p, q in found:
                assert int(np.bitwise_count(rows[p] ^ rows[q]).sum()) <= radius
                label = [min(label[p], label[q]) if x in (label[p], label[q]) else x for x in label]
            for i in range(90):
                for j in range(i):
                    across = right is None or (i >= split > j)
                    if across and int(np.bitwise_count(rows[i] ^ rows[j]).sum()) <= radius:
                        assert label[i] == label[j]
            assert len(found) == len({*range(90)}) - len(set(label))


@pytest.mark.parametrize("radius", [2, 12])
def test_documents_against_brute_force(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "ß", "A", "a"]
    texts = [None, "", " \n", "one", "one two", "ONE two three"]
    for _ in range(8):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(0, 60)] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i + 3, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, size int, node string")
    out = {r.doc_id: r for r in simhash.near_duplicates(docs, radius=radius).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints, radius)
    for i, p in enumerate(prints):
        assert out[i + 3].fingerprint == f"{p:016x}"
        assert out[i + 3].component_id == roots[i] + 3


def test_chains_and_stars(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("900", f"9{i:02}") for i in range(1, 30)] + [("b", "a"), ("a", "b"), ("c", "c")]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(1, 41)} | {f"9{i:02}": "900" for i in range(1, 30)} | {"b": "a"}


def test_similarity_mode_links_near_copies_only(spark):
    rng = np.random.default_rng(11)
    rows, group = [], {}
    for g in range(6):
        base = [f"g{g}w{rng.integers(0, 4000)}" for _ in range(600)]
        for c in range(4):
            copy = list(base)
            for at in rng.choice(600, c * 2, replace=False):
                copy[at] = f"new{rng.integers(0, 10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), rows[0][1] + " " + rows[4][1] + " " + rows[8][1]))
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, radius=simhash.RADIUS_80, n_words=4, distinct=True, ratio=0.8).collect()
    found = defaultdict(set)
    for r in out:
        found[r.component_id].add(r.doc_id)
    assert sorted(map(sorted, found.values())) == [[4 * g + c for c in range(4)] for g in range(6)] + [[24]]


def shingles(text, width=5):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_similar(sets, least=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def dense_group(rng, texts, words=400):
    """Texts around one base, each with so many words changed that most pairs lie near the threshold."""
    base, out = [f"g{rng.integers(0, 9000)}" for _ in range(words)], []
    for _ in range(texts):
        copy = list(base)
        for at in rng.choice(words, int(rng.integers(4, 14)), replace=False):
            copy[at] = f"new{rng.integers(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("tile", "broadcast"), [(None, 1), (4000, 1), (4000, 0)])
def test_dense_groups_lose_no_link(spark, monkeypatch, tile, broadcast):
    """Groups of 120 texts whose similarities lie around 0.8; with small tiles each is dealt to a dozen of them."""
    if tile:
        monkeypatch.setattr(simhash, "SET_TILE", tile)
        monkeypatch.setattr(simhash, "REPRESENTATIVES", 1)
        monkeypatch.setattr(simhash, "LARGE_GROUPS", broadcast * 100)
    rng = np.random.default_rng(5)
    texts = [t for _ in range(3) for t in dense_group(rng, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5, radius=simhash.RADIUS_80, n_words=4, distinct=True, ratio=0.8).collect()}
    want = brute_similar([shingles(t) for t in texts])
    assert len(set(want)) > 100
    assert [out[i] for i in range(len(texts))] == want


def test_sets_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.integers(0, 200, 30)
        sets = [np.unique(np.where(rng.random(30) < 0.1, rng.integers(0, 200, 30), base)) if rng.random() < 0.9 else np.zeros(0, np.int64) for _ in range(40)]
        bounds = np.cumsum([0, *map(len, sets)])
        known = rng.integers(0, 15, 40)
        for labels in (np.arange(40), known):
            root = {l: min(np.flatnonzero(labels == l)) for l in labels.tolist()}
            want = [root[x] for x in labels.tolist()]
            for i in range(40):
                for j in range(i):
                    a, b = set(sets[i].tolist()), set(sets[j].tolist())
                    if len(a & b) >= 0.8 * len(a | b):
                        want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
            got = [root[x] for x in labels.tolist()]
            for x, y in simhash.set_forest(np.concatenate(sets), bounds, 0.8, labels):
                assert got[x] != got[y]
                got = [min(got[x], got[y]) if w in (got[x], got[y]) else w for w in got]
            assert got == want


def test_one_group_holds_a_third_of_all_rows(spark, monkeypatch):
    """Equal texts share one fingerprint, and copies near them one component: both are hot keys of the joins."""
    monkeypatch.setattr(simhash.join_counted, "__defaults__", (4,))
    rng = np.random.default_rng(8)
    texts = ["a b c d e f g"] * 300 + [" ".join(rng.choice([f"w{i}" for i in range(400)], 40)) for _ in range(500)] + [None] * 100
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    roots = brute_components([brute_print(t) for t in dict.fromkeys(texts)], 2)
    firsts = [texts.index(t) for t in dict.fromkeys(texts)]
    of = dict(zip(dict.fromkeys(texts), (firsts[r] for r in roots)))
    assert out == {i: of[t] for i, t in enumerate(texts)}


def test_very_long_texts():
    """Counts of bits go past one block of hashes."""
    hashes = np.random.default_rng(1).integers(0, 2**64, 3 * simhash.BLOCK + 17, dtype=np.uint64)
    hashes[: len(hashes) // 2 + 1] |= np.uint64(5 << 40)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.majority(hashes) == want


def test_which_copy_stays(spark):
    rows = [(1, "a b c d e f", "z", 3), (1, "a b c d e f", "b", 9), (1, "a b c d e f", "b", 1), (2, "a b c d e f", "a", 0)]
    for order in (rows, rows[::-1]):
        out = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, source string, n int").repartition(3)).collect()
        assert [tuple(r) for r in out] == [(1, "a b c d e f", "b", 1)]


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, None), (4, None), (9, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 4), (4, 4), (9, 4), (None, None), (None, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in docs]
    roots = brute_components(prints, 2)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, sf).collect()}
    assert out == {d: (f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, roots)}
