"""Operators on small frames: nulls, empty and long texts, repeated rows, empty tables, clashing columns, hot groups."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontamination, htmltext, linededup, media, minhash, recompression, sharding, tokencount, toxicity
from corpusloom.llm.queries import ORACLE_SQL, QUERIES

r = random.Random(7)
VOCAB = ["w%d" % i for i in range(400)]
sentence = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
BASE = sentence(120)
NEAR = BASE.split()
NEAR[60] = "changed"
PASSAGE = sentence(30)
ROWS = [
    (1, BASE), (2, BASE.upper()), (3, " ".join(NEAR)), (4, sentence(100) + " " + PASSAGE + " " + sentence(50)), (5, PASSAGE + " tail"), (6, None), (7, ""), (8, "one"), (9, "one"),
    (10, "\n\n \t"), (11, sentence(20000)), (12, "line a is long enough\nline b is long enough\nline a is long enough"), (12, "line a is long enough\nline b is long enough\nline a is long enough"),
    (None, BASE), *((100 + i, BASE) for i in range(40)),
]


def sets(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("extra", [False, True])
def test_near_duplicates(docs_of, extra):
    got = {(x.doc_id): x for x in minhash.near_duplicates(docs_of(ROWS, extra), shingle=2).collect()}
    rows = [(i, sets(t, 2)) for i, t in ROWS if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for i, s in rows:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), find(i), find(i) == i)
    assert got[None].component_id is None and got[None].kept


def test_star_needs_further_rounds(docs_of):
    # a chain: neighbours are alike, the ends are not
    words = sentence(130).split()
    rows = [(50 - i, " ".join(words[i * 4 : i * 4 + 80])) for i in range(10)]
    got = minhash.near_duplicates(docs_of(rows), shingle=2).collect()
    assert {x.component_id for x in got} == {41}


def test_substring_dedup(docs_of):
    got = {(x.doc_id): x for x in recompression.dedup_substrings(docs_of(ROWS, True)).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in ROWS}
    first = {}
    for i in sorted(words, key=lambda x: (x is None, x)):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] != i:
                gone.update(range(k, k + 13))
        assert got[i].n_words == len(w) and got[i].n_removed == len(gone)
        assert got[i].kept_text == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_line_dedup(docs_of):
    got = {x.doc_id: x for x in linededup.dedup_lines(docs_of(ROWS, True)).collect()}
    assert got[12].kept_text == "line a is long enough\nline b is long enough" and got[12].n_removed == 1
    assert got[1].n_removed == 0 and got[2].kept_text == "" and got[100].kept_text == "" and got[3].kept_text == ""
    assert got[6].kept_text is None and got[7].kept_text == "" and got[10].kept_text == "\n\n \t" and got[9].kept_text == "" and got[8].kept_text == "one"


def test_contamination(spark, docs_of):
    items = spark.createDataFrame([(1, PASSAGE), (2, "one"), (3, None), (4, ""), (5, PASSAGE.upper()), (6, sentence(40))], "item_id long, text string")
    got = {x.doc_id: x for x in decontamination.contamination(docs_of(ROWS), items).collect()}
    assert (got[5].n_words, got[5].n_hit, got[5].n_items, got[5].contaminated, got[5].longest) == (31, 30, 2, True, 30)
    assert got[5].items_sha256 == hashlib.sha256(b"1,5").hexdigest()
    assert (got[4].n_hit, got[4].contaminated) == (30, True) and (got[8].n_hit, got[8].n_items) == (1, 1)
    assert not got[1].contaminated and got[6].n_words == 0 and not got[6].contaminated
    clean = decontamination.decontaminate(docs_of(ROWS, True), items)
    assert clean.columns == docs_of(ROWS, True).columns and {5, 4, 8, 9} & {x.doc_id for x in clean.collect()} == set()


def test_benchmark_in_blocks(spark, docs_of, monkeypatch):
    items = spark.createDataFrame([(i, sentence(20)) for i in range(6)] + [(9, PASSAGE)], "item_id long, text string")
    whole = decontamination.contamination(docs_of(ROWS), items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()
    monkeypatch.setattr(decontamination, "TEST_BLOCK_BYTES", 400)
    assert sorted(decontamination.contamination(docs_of(ROWS), items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect(), key=str) == sorted(whole, key=str)


def test_shards(docs_of):
    df = docs_of(ROWS).withColumn("b", F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    rows = sharding.shard_by_bytes(df, F.col("b"), ["doc_id"], 5).collect()
    assert len(rows) == len(ROWS)
    for s in {x.shard for x in rows}:
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(sum(x.shard == s for x in rows)))
    ordered = sorted(rows, key=lambda x: (x.shard, x.slot))
    ids = [x.doc_id for x in ordered if x.doc_id is not None]
    assert ids == sorted(ids)
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs_of(ROWS, True), F.lit(1), ["doc_id"], 5)


def test_toxicity(spark, docs_of):
    rows = [(i, sentence(30) + (" idiot scum " if i % 5 == 0 else " ") + sentence(10)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs_of(rows), labels)
    odd = [*ROWS, (500, "You 1D10T, ѕсum"), (501, "plain words")]
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs_of(odd), lexicon).collect()}
    assert got[500].score >= 0.3 > got[501].score and 0 <= got[6].score < 0.3 and got[7].score == got[6].score
    nothing = toxicity.learn_lexicon(docs_of([]), labels.limit(0))
    assert toxicity.score_toxicity(docs_of(ROWS), nothing).where("score >= 0.3").count() == 0


def test_tokens_and_media(spark, docs_of):
    tokenizers = pytest.importorskip("public_tokenizers")
    pieces = tokencount.load_pieces(tokenizers.path("word_bpe_49k.json"))
    got = {x.doc_id: x for x in tokencount.count_pieces(docs_of(ROWS, True), pieces).collect()}
    assert got[6].n_pieces == 0 and got[8].n_pieces == 1 and got[11].n_words >= 20000
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode_ids(bpe.encode_texts(docs_of(ROWS, True), ranks, tokenizers.PATTERN), ranks, tokenizers.PATTERN)
    assert all(bytes(x.decoded) == (x.text or "").encode() for x in coded.collect())
    stored = media.probe_media(media.store_media(docs_of(ROWS)), prefix="m_").collect()
    assert all(x.m_frames > 0 and x.m_crc_bad == 0 for x in stored)
    foreign = spark.createDataFrame([(None,), (b"",), (b"text",)], "media binary")
    assert [x.frames for x in media.probe_media(foreign).collect()] == [0, 0, 0]


def test_html_pages(spark):
    page = lambda i: f'<html><body><div>Menu home</div><div>Follow us</div><div>All rights</div><div>{sentence(20)} {i}</div></body></html>'
    pages = [(i, "http://a.example/%d" % i, page(i)) for i in range(8)]
    got = htmltext.extract_articles(spark.createDataFrame([*pages, (90, None, None), (91, "bad", "")], "page_id long, url string, html string")).collect()
    assert len(got) == 10
    for x in got:
        assert "Menu" not in x.text and "rights" not in x.text and (x.page_id >= 90 or x.text.endswith(str(x.page_id)))
        assert x.n_chars == len(x.text)


def test_empty_tables(spark, docs_of):
    empty = docs_of([])
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(empty).count() == linededup.dedup_lines(empty).count() == recompression.dedup_substrings(empty).count() == 0
    assert decontamination.contamination(empty, items).count() == sharding.shard_by_bytes(empty, F.lit(1), ["doc_id"]).count() == 0
    assert not [x for x in decontamination.contamination(docs_of(ROWS), items).collect() if x.contaminated]
    assert htmltext.extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_registered():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(f"op{n}" for n in range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
