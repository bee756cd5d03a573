import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievelake.llm import packing
from sievelake.llm.batches import byte_view
from sievelake.llm.subwords import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "a", "It's  two   spaces\n\n and\ttabs ", "x <|endoftext|> y<|endoftext|>", "a <|endoftext|>",
    "漢字 カナ　全角 space", "nbsp   x   y　 z", "é è ê ª º ² Ⅷ ௧ 1234 12a", "emoji 😺😺 !!! ?? _a_",
    "z" * 3000 + " " + "ab " * 900, "\x00 \x1c x\x85 y   z", "don't I'll 've 'S", "   lead", "trail   ", "\r\n \r\n x",
]


def test_ids_are_those_of_the_library():
    import pyarrow as pa

    encoder, library = ByteBpe(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        flat, bounds = encoder.encode(*byte_view(pa.array(TEXTS, pa.string())))
        for i, text in enumerate(TEXTS):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_random_texts_match_the_library():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    letters = list("ab éñß1 2'.,  \n\t  漢😺_-s")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(600)]
    encoder, library = ByteBpe(PATH), Tokenizer.from_file(PATH)
    flat, bounds = encoder.encode(*byte_view(pa.array(texts, pa.string())))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("tokens", [0, 1, 2, 3, 7, 1023, 1024, 1025, 5000])
def test_lengths_are_powers_of_two(tokens):
    parts = packing.piece_lengths(tokens, 1024)
    assert sum(parts) == tokens and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)


def test_pieces_rebuild_every_document(spark):
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    out = packing.pack(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    for key in {r.doc_id for r in out} - {3}:
        mine = sorted((r for r in out if r.doc_id == key), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in mine), "<u4").tolist()
        text = TEXTS[key or 0] or ""
        assert ids == library.encode(text, add_special_tokens=False).ids + [0]
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) and 1 << r.bucket == r.length for r in mine)
    assert sum(r.doc_id == 3 for r in out) == 2 * sum(p > 0 for p in packing.piece_lengths(2, 1024))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0


def test_query_digest(spark):
    from sievelake.llm.queries import op9_pack_pieces

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = Tokenizer.from_file(PATH)
    for r in op9_pack_pieces(spark, sf).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids)


def test_buckets_hold_one_length_each(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    made, path = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "buckets")
    packing.write_buckets(made, path)
    read = spark.read.parquet(path)
    assert read.count() == made.count() and {(r.bucket, r.length) for r in read.select("bucket", "length").distinct().collect()} == {(b, 1 << b) for b in range(6)}
