"""Byte-level BPE encoding and decoding as recursive SQL inside each partition.

Texts are cut by the tokenizer's pattern. Every distinct word of a batch that isn't known yet goes into a DuckDB
connection of the worker as token-position rows, one a byte. A recursive query joins neighbours with the merge
table and contracts, in each step, the leftmost pair of least rank of every word, until no word has a pair left.
In long words that hold nothing with which the new token could form one of lesser rank, the other pairs of that
rank would follow one by one from the left, so they are contracted in the same step: a word of one repeated
letter takes a few steps. Decoding joins ids with the vocabulary and puts the bytes together by an aggregation
ordered by position.

Null and empty texts have no ids; rows that repeat stay as they are, each with its own result; an empty table gives an
empty result; a new name that the table has, in whatever case, is an error.

The rows of finished words leave the recursion. The merge table follows from the ranks: every way to cut a token into two tokens. Both are bounded by the vocabulary file.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import threading
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import give_back, prefixed, with_arrow_columns

#: Words whose ids a worker remembers in each of two generations, and the longest that it remembers: about 130 MB.
CACHE_WORDS, CACHE_CHARS = 280_000, 64
#: Seconds after a task's end in which the worker's next task finds its codec.
IDLE_SECONDS = 3.0
#: Bytes beyond which a word takes the query for long words.
LONG_WORD = 64
#: Token rows that one decoding query takes, beyond one text.
DECODE_ROWS = 400_000

#: Bits of the place in a position.
PLACE_BITS = 32

# A position is word << 32 | place. Each step contracts one pair of each word, the leftmost of least rank.
_ENCODE = """
WITH RECURSIVE step(g, tok, live) AS (
  SELECT g, tok, true FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT s.g, s.tok, lead(s.g) OVER w AS ng, lead(s.tok) OVER w AS nt, lag(s.g) OVER w AS pg FROM step s WHERE s.live WINDOW w AS (ORDER BY s.g)
   ), best AS (
     SELECT p.g >> 32 AS word, min(m.merged::BIGINT << 32 | (p.g & 4294967295)) AS b
     FROM pairs p JOIN merges m ON m.l = p.tok AND m.r = p.nt WHERE p.g >> 32 = p.ng >> 32 GROUP BY p.g >> 32
   )
   SELECT p.g, CASE WHEN (p.g & 4294967295) = (b.b & 4294967295) THEN (b.b >> 32)::INTEGER ELSE p.tok END, b.b IS NOT NULL
   FROM pairs p LEFT JOIN best b ON b.word = p.g >> 32
   WHERE b.b IS NULL OR p.pg IS NULL OR p.pg <> (p.g >> 32 << 32 | (b.b & 4294967295)))
)
SELECT (g >> 32)::INTEGER AS word, list(tok ORDER BY g) AS ids FROM step WHERE NOT live GROUP BY word ORDER BY word
"""

# The same for long words: all pairs of the least rank together where that is proven equal. Of pairs that overlap,
# the leftmost wins, then every second one.
_ENCODE_LONG = """
WITH RECURSIVE step(g, tok, live) AS (
  SELECT g, tok, true FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT s.g, s.tok, lead(s.g) OVER w AS ng, lead(s.tok) OVER w AS nt FROM step s WHERE s.live WINDOW w AS (ORDER BY s.g)
   ), ranked AS (
     SELECT p.g, m.merged FROM pairs p JOIN merges m ON m.l = p.tok AND m.r = p.nt WHERE p.g >> 32 = p.ng >> 32
   ), best AS (
     SELECT g >> 32 AS word, min(merged::BIGINT << 32 | (g & 4294967295)) AS b FROM ranked GROUP BY g >> 32
   ), risk AS (
     SELECT DISTINCT b.word FROM best b JOIN risky k ON k.merged = b.b >> 32 LEFT JOIN pairs p ON p.g >> 32 = b.word AND p.tok = k.partner
     WHERE p.g IS NOT NULL OR k.partner = k.merged
   ), hits AS (
     SELECT p.g, p.tok, (b.b >> 32)::INTEGER AS merged, r.g IS NOT NULL AND (k.word IS NULL OR (b.b & 4294967295) = (p.g & 4294967295)) AS hit
     FROM pairs p LEFT JOIN best b ON b.word = p.g >> 32 LEFT JOIN ranked r ON r.g = p.g AND r.merged = b.b >> 32
       LEFT JOIN risk k ON k.word = p.g >> 32
   ), runs AS (
     SELECT *, row_number() OVER w - max(CASE WHEN hit THEN 0 ELSE row_number END) OVER w AS nth
     FROM (SELECT *, row_number() OVER (ORDER BY g) AS row_number FROM hits) WINDOW w AS (ORDER BY g)
   ), chosen AS (
     SELECT g, tok, merged, hit AND nth % 2 = 1 AS take, lag(hit AND nth % 2 = 1) OVER (ORDER BY g) AS gone FROM runs
   )
   SELECT g, CASE WHEN take THEN merged ELSE tok END, merged IS NOT NULL FROM chosen WHERE NOT coalesce(gone, false))
)
SELECT (g >> 32)::INTEGER AS word, list(tok ORDER BY g) AS ids FROM step WHERE NOT live GROUP BY word ORDER BY word
"""

_DECODE = """
SELECT c.doc, string_agg(v.piece, '' ORDER BY c.pos) AS text FROM codes c JOIN vocab v ON v.id = c.id GROUP BY c.doc ORDER BY c.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id): every cut of a token into two tokens. The rank of a merge is its merged id."""
    out = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                out.append((a, b, rank))
    return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: str = "200MB"):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory})
        merges = merge_table(ranks)
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))  # noqa: E741
        self._load("merges", {"l": l, "r": r, "merged": m})
        # tokens that, once made, join some partner to a token of no greater rank than their own
        risky = sorted({(a, b) for a, b, m in merges if a >= m} | {(b, a) for a, b, m in merges if b >= m})
        self._load("risky", {"merged": pa.array([x for x, _ in risky], pa.int32()), "partner": pa.array([x for _, x in risky], pa.int32())})
        # bytes as the code points 0 to 255: pieces needn't be valid UTF-8
        self._load("vocab", {"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        # words met lately, and those met before them: a word that is met again moves up
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of non-empty words: a word that is a token is that token, others are contracted in SQL."""
        out: list[list[int] | None] = [None if (i := self.ranks.get(w)) is None else [i] for w in words]
        for query, rest in (
            (_ENCODE, [k for k, ids in enumerate(out) if ids is None and len(words[k]) <= LONG_WORD]),
            (_ENCODE_LONG, [k for k, ids in enumerate(out) if ids is None and len(words[k]) > LONG_WORD]),
        ):
            if not rest:
                continue
            size = np.array([len(words[k]) for k in rest])
            if int(size.max()) >> PLACE_BITS:
                raise ValueError(f"a word of {size.max()} bytes is beyond {PLACE_BITS} bits")
            raw = np.frombuffer(b"".join(words[k] for k in rest), np.uint8)
            pos = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("bytes", pa.table({"g": pa.array(np.repeat(np.arange(len(rest), dtype=np.int64), size) << PLACE_BITS | pos), "tok": pa.array(self.byte_id[raw])}))
            for k, ids in self.db.execute(query).fetchall():
                out[rest[k]] = ids
            self.db.unregister("bytes")
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by commas, for each text."""
        cut = [self.pattern.findall(t) for t in texts]
        known, before, fresh = self.known, self.before, []
        for w in set().union(*cut):
            if w not in known:
                if (ids := before.get(w)) is None:
                    fresh.append(w)
                else:
                    known[w] = ids
        fresh.sort()
        long_: dict[str, str] = {}
        for w, ids in zip(fresh, self.encode_words([w.encode("utf-8") for w in fresh]), strict=True):
            (known if len(w) <= CACHE_CHARS else long_)[w] = ",".join(map(str, ids))
        if long_:
            out = [",".join([known[w] if w in known else long_[w] for w in words]) for words in cut]
        else:
            out = [",".join([known[w] for w in words]) for words in cut]
        if len(known) > CACHE_WORDS:
            self.known, self.before = {}, known
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list."""
        out = [b""] * len(ids)
        lo = 0
        while lo < len(ids):
            hi, rows = lo, 0
            while hi < len(ids) and (hi == lo or rows + len(ids[hi]) <= DECODE_ROWS):
                rows += len(ids[hi])
                hi += 1
            size = np.array([len(x) for x in ids[lo:hi]])
            flat = np.concatenate(ids[lo:hi]) if rows else np.zeros(0, np.int32)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            table = pa.table({"doc": pa.array(np.repeat(np.arange(lo, hi, dtype=np.int32), size)), "pos": pa.array(pos.astype(np.int32)), "id": pa.array(flat.astype(np.int32))})
            self.db.register("codes", table)
            for k, text in self.db.execute(_DECODE).fetchall():
                out[k] = text.encode("latin-1")
            self.db.unregister("codes")
            lo = hi
        return out


def _parse(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)


class _Worker:
    """The worker's codec: building one costs more than a task, so the next task finds it, but an idle worker lets it go."""

    codec: Codec | None = None
    key: tuple[str, str] | None = None
    turn = 0
    lock = threading.Lock()

    @classmethod
    def take(cls, ranks: dict[bytes, int], digest: str, pattern: str) -> Codec:
        with cls.lock:
            cls.turn += 1
            if cls.key != (digest, pattern):
                cls.codec, cls.key = Codec(ranks, pattern), (digest, pattern)
            return cls.codec

    @classmethod
    def done(cls) -> None:
        """A task has ended: unless another begins soon, drop the codec."""
        timer = threading.Timer(IDLE_SECONDS, cls.drop, (cls.turn,))
        timer.daemon = True
        timer.start()

    @classmethod
    def drop(cls, turn: int) -> None:
        with cls.lock:
            if turn != cls.turn:
                return
            cls.codec = cls.key = None
        gc.collect()
        give_back()


def _with_codec(df: DataFrame, ranks: dict[bytes, int], pattern: str, work: Callable) -> Callable:
    """A maker for ``with_arrow_columns`` of ``work(codec, batch)``; the vocabulary is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def make():
        codec = _Worker.take(shared.value, digest, pattern)

        def run(batch):
            return work(codec, batch)

        run.close = _Worker.done
        return run

    return make


def _texts(batch, name, chars: int = 1 << 19):
    """The texts of a column (null: empty), a bounded number of characters at a time."""
    part, size = [], 0
    for t in batch.column(batch.schema.get_field_index(name)):
        t = t.as_py() or ""
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_texts(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` plus a list<int> of token ids. Null and empty texts have an empty list."""

    def work(codec, batch):
        flat, size = [], [0]
        for part in _texts(batch, text_col):
            for ids in codec.encode(part):
                flat.append(_parse(ids))
                size.append(size[-1] + len(flat[-1]))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
        return [pa.ListArray.from_arrays(pa.array(size, pa.int32()), values)]

    return with_arrow_columns(df, _with_codec(df, ranks, pattern, work), [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], [] if keep_text else [text_col])


def decode_ids(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids", bytes_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` plus the bytes of a token id list (null: empty). Ids outside the vocabulary give nothing."""

    def work(codec, batch):
        lists = batch.column(batch.schema.get_field_index(ids_col))
        return [pa.array(codec.decode([np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in lists]), pa.binary())]

    return with_arrow_columns(df, _with_codec(df, ranks, pattern, work), [T.StructField(bytes_col, T.BinaryType())], [] if keep_ids else [ids_col])


def encode_checked(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` plus ``ids`` (list<int>), ``n_tokens`` and ``round_trip``: whether the ids decode to the text byte by byte.

    One pass, so a task holds one codec. Null and empty texts have no ids and round-trip.
    """

    def work(codec, batch):
        flat, size, same = [], [0], []
        for part in _texts(batch, text_col):
            ids = [_parse(e) for e in codec.encode(part)]
            same += [t.encode("utf-8") == d for t, d in zip(part, codec.decode(ids), strict=True)]
            for x in ids:
                flat.append(x)
                size.append(size[-1] + len(x))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
        return [pa.ListArray.from_arrays(pa.array(size, pa.int32()), values), pa.array(np.diff(size).astype(np.int64)), pa.array(same, pa.bool_())]

    fields = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("round_trip", T.BooleanType())]
    return with_arrow_columns(df, _with_codec(df, ranks, pattern, work), prefixed(fields, prefix))


DIGEST = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def bpe_digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``df`` plus the number of tokens, and digests of the ids and of the bytes that the ids decode to."""

    def work(codec, batch):
        n, one, two = [], [], []
        for part in _texts(batch, text_col):
            encoded = codec.encode(part)
            ids = [_parse(e) for e in encoded]
            n += [len(i) for i in ids]
            one += [hashlib.sha256(e.encode()).hexdigest() for e in encoded]
            two += [hashlib.sha256(d).hexdigest() for d in codec.decode(ids)]
        return [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]

    return with_arrow_columns(df, _with_codec(df, ranks, pattern, work), prefixed(DIGEST, prefix), [] if keep_text else [text_col])


def op2_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_digests(docs, ranks, public_tokenizers.PATTERN, keep_text=False)
