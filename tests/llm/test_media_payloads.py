"""Payloads that look like tags or headers come back whole; contract columns against a plain recomputation."""

import hashlib
import random
import zlib

import pytest

from corpusloom.llm import media


@pytest.mark.parametrize("word", [b"TAG", b"ID3", b"ID3\x03\x00\x00\x00\x00\x7f\x7f", b"Xing", "\u07fb".encode(), b"\x00"])
@pytest.mark.parametrize("units", [1, 2, 3, 4, 5, 9])
def test_payload_with_a_tag_at_any_offset(word, units):
    for at in range(max(0, (units - 4) * media.UNIT), units * media.UNIT - len(word) + 1):
        payload = (b"x" * at + word).ljust(units * media.UNIT, b"y")
        stored = media.write_stream(payload)
        assert media.read_payload(stored, media.read_stream(stored)) == payload


def test_id3v1_behind_frames_is_still_a_tag():
    payload = b"p" * media.UNIT * 5
    stored = media.write_stream(payload)
    s = media.read_stream(stored + b"TAG" + b"A title".ljust(125, b"\0"))
    assert s.tags["ID3v1"] == "A title" and s.skipped == 0 and media.read_payload(stored, s) == payload
    cut = media.read_stream(stored[:-50] + b"TAG" + b"A title".ljust(125, b"\0"))
    assert cut.tags["ID3v1"] == "A title" and cut.frames == s.frames - 1


def test_contract_columns(docs_of):
    r = random.Random(3)
    texts = ["", None, "TAG", "x" * 89 + "TAG" + "y" * 50, "\u00e9" * 96, "a" * 192, "b" * 193, *("".join(r.choice("TAGID3 \u4e2d\n") for _ in range(r.randrange(3000))) for _ in range(60)), "z" * 400_000, "TAG"]
    docs = docs_of([(i, t) for i, t in enumerate(texts)])
    sized = docs.selectExpr("doc_id", "text", "coalesce(octet_length(text), 0)::long AS size")
    got = {x.doc_id: x for x in media.media_digests(media.store_media(sized), "size").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        x, stored = got[i], media.write_stream(payload)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (x.tail_crc32, x.media_bytes, x.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert got[2].feature == got[len(texts) - 1].feature


def test_empty_table_and_clash(docs_of):
    docs = docs_of([]).selectExpr("doc_id", "text", "0L AS size")
    assert media.media_digests(media.store_media(docs), "size").collect() == []
    with pytest.raises(ValueError):
        media.store_media(docs.withColumnRenamed("size", "Media"))
