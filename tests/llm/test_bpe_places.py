"""Places of long words don't reach into word numbers."""

import pytest

from corpusloom.llm import bpe


def test_a_word_beyond_the_places_is_refused(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    codec = bpe.Codec(ranks, r"\\S+")
    assert codec.encode_words([b"abc" * 30, b"cab"]) == [[256, 99] * 30, [99, 256]]
    assert bpe.PLACE_BITS >= 32 and all(" 24" not in q and "16777215" not in q for q in (bpe._ENCODE, bpe._ENCODE_LONG))
    monkeypatch.setattr(bpe, "PLACE_BITS", 6)
    with pytest.raises(ValueError):
        codec.encode_words([b"abc" * 30])


def test_encode_checked_equals_encoding_and_decoding(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, "é".encode(): 258}
    rows = [(1, "abab ab é b"), (2, None), (3, ""), (1, "abab ab é b"), (4, "ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode_checked(docs, ranks, r"\S+|\s+").select("doc_id", "ids", "n_tokens", "round_trip")
    want = bpe.encode_texts(docs, ranks, r"\S+|\s+").select("doc_id", "ids")
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((r.doc_id, r.ids) for r in want.collect())
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.collect())
    assert not bpe.encode_checked(docs.limit(0), ranks, r"\S+").collect()
    with pytest.raises(ValueError):
        bpe.encode_checked(docs.selectExpr("*", "1 AS N_Tokens"), ranks, r"\S+")
