import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from sievelake.llm import pieces
from sievelake.llm.batches import byte_view
from tests.llm.test_packing import TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = TEXTS + [" " * n for n in range(1, 70)] + ["a" + " " * 3000 + "b", "▁x ▁▁ y", "the the thethethethe", "aaaaaaaaaaaa ababababab", "<s></s><unk><0x41>", "﻿x", "0000000000000 ======= --------", "x" * 5000]


def check(texts):
    model = pieces.PieceModel(PATH)
    for _ in range(2):
        ids, bounds = model.encode(*byte_view(pa.array(texts, pa.string())))
        decoded = model.decode(ids, bounds)
        for i, text in enumerate(texts):
            want = LIBRARY.encode(text or "")
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want, text
            assert decoded[i] == LIBRARY.decode(want)


def test_odd_texts_match_the_library():
    check(ODD)


def test_random_texts_match_the_library():
    rng = np.random.default_rng(3)
    letters = list("aabcdeeehinorst   th.,\n\téßñ漢😺_-1=▁")
    check(["".join(rng.choice(letters, rng.integers(0, 200))) for _ in range(1500)])


def test_corpus_matches_the_library(spark):
    check([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_decoding_any_ids():
    rng, model = np.random.default_rng(1), pieces.PieceModel(PATH)
    for _ in range(300):
        ids = rng.choice([*range(3, 259), *rng.integers(259, 32000, 60)], rng.integers(1, 12))
        assert model.decode(ids, np.array([0, len(ids)])) == [LIBRARY.decode(ids.tolist())]


def test_heap_equals_rounds(monkeypatch):
    monkeypatch.setattr(pieces, "_ROUNDS", 2)
    check(ODD)


def test_query_and_edges(spark):
    from sievelake.llm.queries import op8_sentencepiece

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_sentencepiece(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = LIBRARY.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, ids int")
    assert sorted(map(tuple, pieces.encode_decode(docs, PATH).collect()), key=str) == [(1, [], ""), (1, [], ""), (None, [], "")]
    assert pieces.encode_decode(docs.limit(0), PATH).count() == 0
