import base64
import random
from collections import Counter

import pyarrow as pa
import zstandard

from sievelake.llm import quality
from sievelake.llm.queries import op7_compression_bands

PACKER = zstandard.ZstdCompressor(level=3)


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed)


def verdict(text):
    """Whether a text stays, by the rules written out one after the other."""
    raw = (text or "").encode()
    if brute(text)[-1]:
        return False
    limits = [(256, 0.0, 2.5), (1024, 1.1, 3.0), (4096, 1.4, 3.5), (16384, 1.45, 4.0), (float("inf"), 1.45, 4.5)]

    def fits(part):
        low, high = next((a, b) for below, a, b in limits if len(part) < below)
        return low <= len(part) / len(zstandard.compress(part, 3)) <= high

    parts = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
    if len(parts) > 1 and len(parts[-1]) < 1024:
        parts[-2:] = [parts[-2] + parts[-1]]
    odd = sum(len(p) for p in parts if not fits(p))
    return fits(raw) and (len(parts) < 2 or 2 * odd <= len(raw))


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "a", "a b c d e a b c d e", "x\nx\n x\nx", "é ß 漢 \x1c \x85 |<>", "w " * 5000]
    for _ in range(150):
        out.append("".join(rng.choice(["a ", "b ", "c ", "dd\n", "é#", "\t", "f  ", "漢 "]) for _ in range(rng.randrange(0, 80))))
    return out


def test_counts_against_brute_force():
    rows = texts()
    columns = quality.measure(pa.array(rows, pa.string()), PACKER)
    got = list(zip(*(c.to_pylist() for c in columns[:6])))
    assert got == [brute(t) for t in rows]


def test_key_collisions_are_settled(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    ids, bounds = rng.integers(0, 3, 400), np.array([0, 4, 4, 150, 400])
    want = quality.repeated_words(ids, bounds)
    real = np.argsort
    monkeypatch.setattr(quality, "WINDOW", 5)
    names = [["w%d" % i for i in ids[a:b]] for a, b in zip(bounds, bounds[1:])]
    assert want.tolist() == [brute(" ".join(n))[4] for n in names] and real is np.argsort


def test_bands():
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    noise = " ".join(noise[i : i + 60] for i in range(0, len(noise), 60))
    near = prose(40)
    loop = "".join(f"{near} {i} " for i in range(60))
    out = quality.measure(pa.array([prose(12), prose(100), prose(400), prose(3000), prose(40000), noise, loop, prose(200) + noise], pa.string()), PACKER)
    assert out[-2].to_pylist() == [True] * 5 + [False] * 3
    mixed = [prose(n) for n in (11, 40, 70, 150, 300, 700, 2000, 9000)] + [prose(n) + "\n" + noise[: n * 4] for n in (60, 200, 500, 2000)] + ["ab cd " * 3 + prose(30), prose(330) + "zz " * 100]
    assert quality.measure(pa.array(mixed, pa.string()), PACKER)[-2].to_pylist() == [verdict(t) for t in mixed]
    assert out[-1].to_pylist()[5:] == ["incompressible", "repeated windows", out[-1][7].as_py()]


def test_query_and_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in op7_compression_bands(spark, sf).collect()}
    assert out.keys() == text.keys()
    for k, r in out.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text[k])
        assert r.kept == verdict(text[k])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept}
    odd = spark.createDataFrame([(1, "kept", None), (None, "text", "b " * 30)], "kept long, `0` string, text string")
    assert quality.keep_good(odd).collect() == [] and quality.keep_good(odd.limit(0)).count() == 0
    assert quality.quality(odd.withColumnRenamed("kept", "doc_id")).count() == 2
