"""Benchmark decontamination over suffix arrays of the training texts.

Each block of training text is a shard. Its suffix array holds the word positions whose suffixes can match
a test suffix at all (their first words begin some test window; a lossless filter), sorted by the words that
follow. Every test suffix is then binary-searched in every shard, which gives all its verbatim locations;
runs along one diagonal give the longest matches. The map has no shuffle, so a passage in a third of all
documents costs no more than any other text.

The test side is taken in blocks of bounded bytes, each broadcast: its size is counted first, and a larger
benchmark takes more passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import prefixed, with_arrow_columns
from corpusloom.llm.textblocks import ALNUM, blocks, gram_hash, words
from corpusloom.session import persist_table

WINDOW = 13
#: Bytes of benchmark text that one pass broadcasts.
TEST_BLOCK_BYTES = 16 << 20
_BITS = 22


class TestSuffixes:
    """All windows of some items: distinct word rows, their lengths, and the (item, offset) of each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items = [i for i, _ in items]
        self.window = window
        column = pa.array([t or "" for _, t in items], pa.string())
        rows, owner, offset = [], [], []
        for block in blocks(column):
            w = words(block, ALNUM, True)
            for k in range(block.hi - block.lo):
                h = w.hash[w.first[k] : w.first[k + 1]]
                if not len(h):
                    continue
                size = min(window, len(h))
                for j in range(len(h) - size + 1):
                    rows.append(np.concatenate((h[j : j + size], np.zeros(window - size, np.uint64))))
                    owner.append(block.lo + k)
                    offset.append(j)
        grid = np.array(rows, np.uint64).reshape(len(rows), window)
        self.rows, back = np.unique(grid, axis=0, return_inverse=True)
        back = back.reshape(-1)
        self.size = (self.rows != 0).sum(1)
        order = np.argsort(back, kind="stable")
        self.post_at = np.searchsorted(back[order], np.arange(len(self.rows) + 1))
        self.post_item = np.array(owner, np.int64)[order]
        self.post_offset = np.array(offset, np.int64)[order]
        self.lead = int(min(4, self.size.min())) if len(self.rows) else 1
        self.lead_hash = gram_hash_rows(self.rows, self.lead)
        self.leads = np.unique(self.lead_hash)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.leads >> np.uint64(64 - _BITS)).astype(np.int64)] = True


def gram_hash_rows(rows: np.ndarray, n: int) -> np.ndarray:
    return np.array([gram_hash(r[:n], n)[0] for r in rows], np.uint64) if len(rows) else np.zeros(0, np.uint64)


def _bounds(array: np.ndarray, tests: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test row, the range of sorted ``array`` rows that begin with its first ``size`` words."""
    cols = np.arange(tests.shape[1])
    inside = cols < size[:, None]
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(array), np.int64)
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) // 2
            row, want = array[mid], tests[active]
            differ = (row != want) & inside[active]
            col = differ.argmax(1)
            k = np.arange(len(active))
            less = differ[k, col] & (row[k, col] < want[k, col])
            go = less | (~differ[k, col] if upper else False)
            lo[active[go]] = mid[go] + 1
            hi[active[~go]] = mid[~go]
        out.append(lo)
    return out[0], out[1]


def search_block(w, n_docs: int, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in one shard: word position, document, distinct window, window length."""
    none = np.zeros(0, np.int64)
    h, lead = w.hash, tests.lead
    if not len(tests.rows) or len(h) < lead:
        return none, none, none, none
    g = gram_hash(h, lead)
    cand = np.flatnonzero(tests.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
    found = np.searchsorted(tests.leads, g[cand])
    cand = cand[tests.leads[np.minimum(found, len(tests.leads) - 1)] == g[cand]]
    doc = np.searchsorted(w.first, cand, "right") - 1
    ok = cand + lead <= w.first[doc + 1]
    cand, doc = cand[ok], doc[ok]
    if not len(cand):
        return none, none, none, none
    at = cand[:, None] + np.arange(tests.window)
    grid = np.where(at < w.first[doc + 1][:, None], h[np.minimum(at, len(h) - 1)], np.uint64(0))
    order = np.lexsort(grid.T[::-1])  # the suffix array of this shard
    grid = grid[order]
    use = np.flatnonzero(np.isin(tests.lead_hash, g[cand]))
    lo, hi = _bounds(grid, tests.rows[use], tests.size[use])
    n = hi - lo
    which = np.repeat(use, n)
    place = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if n.sum() else none
    return cand[place], doc[place], which, tests.size[which]


def _runs(pos, doc, item, offset, size):
    """Maximal verbatim matches: occurrences that follow each other along one diagonal, joined."""
    order = np.lexsort((pos, pos - offset, item, doc))
    pos, doc, item, offset, size = (x[order] for x in (pos, doc, item, offset, size))
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - offset[1:] != pos[:-1] - offset[:-1]) | (pos[1:] != pos[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(pos)) - 1
    return doc[head], item[head], pos[head], offset[head], pos[tail] - pos[head] + size[tail]


_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("doc_word", "item_word", "n_words"))]))


def _matcher(shared, text_col: str, window: int):
    def make():
        tests = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n_words, rows = [], []
            for block in blocks(batch.column(batch.schema.get_field_index(text_col))):
                n = block.hi - block.lo
                w = words(block, ALNUM, True)
                n_words.append(np.diff(w.first))
                pos, doc, which, size = search_block(w, n, tests)
                out = [[] for _ in range(n)]
                if len(pos):
                    count = tests.post_at[which + 1] - tests.post_at[which]
                    post = np.repeat(tests.post_at[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                    k = np.repeat(np.arange(len(pos)), count)
                    for d, i, p, o, m in zip(*(x.tolist() for x in _runs(pos[k], doc[k], tests.post_item[post], tests.post_offset[post], size[k])), strict=True):
                        out[d].append({"item_id": tests.items[i], "doc_word": p - int(w.first[d]), "item_word": o, "n_words": m})
                rows += out
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
            return [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(rows, kind)]

        return work

    return make


def _test_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks of bounded bytes the benchmark's rows take, and the rows of each."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + F.length("i") + 64), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // TEST_BLOCK_BYTES))
    part = lambda k: rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
    return n, (sorted((r.i, r.t) for r in part(k).collect()) for k in range(n))


def find_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, prefix: str = ""
) -> DataFrame:
    """``docs`` plus ``n_words`` (long) and ``matches``: longest verbatim matches with their locations.

    A match is (item_id, doc_word, item_word, n_words): word offsets from 0. Words are lower-cased (A-Z) runs of
    ASCII letters, digits and non-ASCII characters. A match has at least ``window`` words, or is a whole item that
    has fewer. Null texts, and items without id, text or words, match nothing; equal items are found each.
    """
    out, spark = docs, docs.sparkSession
    fields = prefixed([("n_words", T.LongType()), ("matches", _MATCH)], prefix)
    n, m = prefix + "n_words", prefix + "matches"
    for k, items in enumerate(_test_blocks(benchmark, item_id, item_text)[1]):
        shared = spark.sparkContext.broadcast(TestSuffixes(items, window))
        if not k:
            out = with_arrow_columns(out, _matcher(shared, text_col, window), fields)
        else:
            own = prefixed([("n_words", T.LongType()), ("matches", _MATCH)], "__loom_")
            out = with_arrow_columns(persist_table(out, "decontaminate"), _matcher(shared, text_col, window), own)
            out = out.withColumn(m, F.concat(m, "__loom_matches")).drop("__loom_n_words", "__loom_matches")
    return out.select(*docs.columns, n, m)


def _summary(n_col: str, m_col: str):
    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return _summarise(*(batch.column(batch.schema.get_field_index(c)) for c in (n_col, m_col)))

        return work

    return make


def _matched_and_summarised(shared, text_col: str, window: int):
    """Both in one map, so that a task keeps one worker."""

    def make():
        match = _matcher(shared, text_col, window)()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = match(batch)
            return [*found, *_summarise(*found)]

        return work

    return make


def _summarise(n_words: pa.Array, matches: pa.Array) -> list[pa.Array]:
    total = n_words.to_pylist()
    sizes = np.diff(np.asarray(matches.offsets)) if not matches.null_count else np.array([len(x or ()) for x in matches.to_pylist()])
    items, digest, longest = [0] * len(total), [_EMPTY] * len(total), [0] * len(total)
    hit = np.zeros(len(total), np.int64)
    for i in np.flatnonzero(sizes).tolist():
        found = matches[i].as_py()
        names = sorted({x["item_id"] for x in found})
        end = -1
        for a, b in sorted((x["doc_word"], x["doc_word"] + x["n_words"]) for x in found):
            hit[i] += max(0, b - max(a, end))
            end = max(end, b)
        items[i], digest[i] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
        longest[i] = max(x["n_words"] for x in found)
    bad = (hit > 0) & (20 * hit >= np.array(total, np.int64))
    return [pa.array(hit), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad), pa.array(longest, pa.int64())]


_EMPTY = hashlib.sha256(b"").hexdigest()


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", prefix: str = "", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``find_matches`` plus n_hit, n_items, items_sha256, contaminated and longest.

    n_hit counts words inside any match; contaminated means n_hit > 0 and at least a twentieth of the words.
    Ids are compared and listed as strings, sorted, each once. A document without words is never contaminated.
    """
    fields = prefixed(
        [("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("longest", T.LongType())], prefix
    )
    n_blocks, tests = _test_blocks(benchmark, item_id, item_text)
    if n_blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(TestSuffixes(next(tests), window))
        first = prefixed([("n_words", T.LongType()), ("matches", _MATCH)], prefix)
        return with_arrow_columns(docs, _matched_and_summarised(shared, text_col, window), first + fields)
    found = find_matches(docs, benchmark, text_col, item_id, item_text, window, prefix)
    return with_arrow_columns(found, _summary(prefix + "n_words", prefix + "matches"), fields)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The documents that are not contaminated, with their own columns; rows without text stay."""
    p = "__loom_d_"
    return contamination(docs, benchmark, text_col, p, **kw).where(~F.col(p + "contaminated")).select(*docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by any benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    report = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[CAST(i AS BIGINT) : CAST(i + least(13, len(w)) - 1 AS BIGINT)], ' ') AS g
  FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins
), occ AS (
  SELECT d.doc_id, i, d.n, item_id FROM (
    SELECT doc_id, i, n, array_to_string(w[CAST(i AS BIGINT) : CAST(i + n - 1 AS BIGINT)], ' ') AS g
    FROM dw, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) t(i)
  ) d JOIN wins ON wins.g = d.g AND wins.n = d.n
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM occ, unnest(range(i, i + n)) t(k) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
), runs AS (
  SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) + 12 AS n FROM (
    SELECT DISTINCT o.doc_id, o.item_id, o.i, o.i - b.j AS diag FROM occ o JOIN (
      SELECT item_id, j, array_to_string(w[CAST(j AS BIGINT) : CAST(j + 12 AS BIGINT)], ' ') AS g FROM bw, unnest(range(1, greatest(len(w) - 11, 1))) t(j)) b
      ON b.item_id = o.item_id JOIN dw ON dw.doc_id = o.doc_id AND array_to_string(dw.w[CAST(o.i AS BIGINT) : CAST(o.i + 12 AS BIGINT)], ' ') = b.g) GROUP BY doc_id, item_id, diag) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
