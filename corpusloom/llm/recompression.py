"""Removal of long repeats by recompression.

Every document is parsed by the rounds of recompression: first each run of one word becomes a symbol, then in
each round the symbols fall into a left and a right half by their names, and every left symbol followed by a
right one becomes a pair. A symbol's name is a hash of what it is made of, and its half a hash of its name and
the round: names are global without any exchange of dictionaries, so equal word sequences get equal symbols
inside, wherever they stand. Only symbols at the borders can differ, and which those are follows from the
sequence itself.

Three Spark rounds, one a level of symbols, find out which names documents share:

1. *Anchors* (round 3 of the parse). Each 13-word window has an anchor, the widest of the symbols that its own words
   determine (the window's own name if there are none). A window that occurs in two documents has the same anchor in
   both, so only windows whose anchor two documents share are alive.
2. *Blocks* (round 8). The block of a symbol is it and what follows as far as a window that starts in it may reach.
   If a smaller document has a block of that name, all windows that start in the symbol are repeats: long repeats
   are settled by a row for several words, and copies without a window of their own.
3. *Windows* (words). What is alive and not settled, the borders of repeats and their first occurrences, is compared
   window by window. The first document that has a window never settles it, so it is there to be found.

Blocks and windows have 128-bit names over the hashes of their words. All rounds are grouped minima with partial
aggregation and joins that Spark may split, so a passage or copy held by a third of all documents is spread out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import map_batches, with_arrow_columns
from corpusloom.llm.idjoin import by_id, whole_ids
from corpusloom.llm.namefilter import NameFilter
from corpusloom.llm.textblocks import NOT_SPACE, blocks, gram_hash, mix, stream, words
from corpusloom.session import drop_table, persist_table, ship_package

WINDOW = 13
#: Rounds of the parse after which symbols are anchors, and after which they head blocks.
ROUNDS, BLOCK_ROUNDS = 3, 8
_RUN, _PAIR, _SIDE, _NEXT = stream(51, 2), stream(52, 2), stream(53, 64), stream(57, 2)
_ALONE = np.uint64(0x7F4A7C159E3779B9)
#: An odd base of the second name of a block, and its inverse modulo 2**64.
_BASE = int(stream(58, 1)[0])
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LIMIT = 1 << 19


def _pairs(name: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols are left ones in round ``k``, and which pair with the next symbol."""
    left = mix(name ^ _SIDE[k]) >> np.uint64(63) == 0
    joined = np.zeros(len(name), bool)
    joined[:-1] = left[:-1] & ~left[1:] & (owner[1:] == owner[:-1])
    return left, joined


def _contract(name: np.ndarray, width: np.ndarray, owner: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after a round: pairs have a name of both names."""
    head = np.flatnonzero(np.append(True, ~joined[:-1]))
    two, nxt = joined[head], np.minimum(head + 1, len(name) - 1)
    pair = mix((name[head] ^ name[head] >> np.uint64(29)) * _PAIR[0] + name[nxt] * _PAIR[1])
    return np.where(two, pair, name[head]), width[head] + np.where(two, width[nxt], 0), owner[head]


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """Start words of all windows of a block's texts, the name of each window's anchor, and the symbols they came from.

    Symbols are their names, widths in words and texts.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(n)
    start = start[start + window <= first[doc + 1]] if n else start
    if not len(start):
        return start, np.zeros(0, np.uint64), None
    with np.errstate(over="ignore"):
        # runs of one word; lo and hi: the symbols that a window determines
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        of_word = np.cumsum(new) - 1
        size = np.diff(np.append(head, n))
        name = np.where(size > 1, mix(h[head] * _RUN[0] + size.astype(np.uint64) * _RUN[1]), h[head])
        width, owner = size, doc[head]
        lo, hi = of_word[start] + 1, of_word[start + window - 1]
        for k in range(rounds):
            left, joined = _pairs(name, owner, k)
            last = len(name) - 1
            lo = lo + ((lo < hi) & ~left[np.minimum(lo, last)])
            hi = hi - ((lo < hi) & left[np.maximum(hi - 1, 0)])
            to = np.cumsum(np.append(True, ~joined[:-1])) - 1
            lo, hi = to[np.minimum(lo, last)], np.where(lo < hi, to[np.maximum(hi - 1, 0)] + 1, 0)
            name, width, owner = _contract(name, width, owner, joined)
        # the widest determined symbol, ties by name
        rank = np.minimum(width, 15).astype(np.uint64) << np.uint64(60) | mix(name) >> np.uint64(4)
        some = hi > lo
        best, at = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
        for j in range(int((hi - lo).max(initial=0))):
            i = np.minimum(lo + j, len(name) - 1)
            better = (lo + j < hi) & (rank[i] > best)
            at[better] = i[better]
            best[better] = rank[i[better]]
        own = ~some
        out = name[at]
        if own.any():
            out[own] = mix(gram_hash(h, window, 54)[start[own]] ^ _ALONE)
    return start, out, (name, width, owner)


def symbol_blocks(h: np.ndarray, first: np.ndarray, symbols: tuple, alive: np.ndarray, rounds: tuple[int, int] = (ROUNDS, BLOCK_ROUNDS), window: int = WINDOW):
    """The blocks that alive windows start in: two names, text, and the run of alive starts, first and one past the last.

    ``alive`` marks start words. A block of several runs of alive windows has a row for each.
    """
    name, width, owner = symbols
    with np.errstate(over="ignore"):
        for k in range(*rounds):
            name, width, owner = _contract(name, width, owner, _pairs(name, owner, k)[1])
        begin = np.concatenate(([0], np.cumsum(width)))
        # runs of alive starts inside one symbol
        of_word = np.repeat(np.arange(len(name)), width)
        edge = np.ones(len(h), bool)
        edge[1:] = ~alive[:-1] | (of_word[1:] != of_word[:-1])
        lo = np.flatnonzero(alive & edge)
        edge[:-1] = ~alive[1:] | (of_word[1:] != of_word[:-1])
        edge[-1:] = True
        hi = np.flatnonzero(alive & edge) + 1
        own = of_word[lo]
        # the last symbol that a window may reach
        stop = np.minimum(np.searchsorted(begin, begin[own + 1] + window - 1), np.searchsorted(begin, first[owner[own] + 1]))
        count = stop - own
        one = np.zeros(len(own), np.uint64)
        for q in range(int(count.max(initial=0))):
            on = q < count
            one[on] = mix(one[on] * _NEXT[0] + name[own[on] + q] * _NEXT[1])
        power = np.cumprod(np.append(np.uint64(1), np.full(len(h), _BASE, np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(h), _BASE_INVERSE, np.uint64)))
        total = np.append(np.uint64(0), np.cumsum(mix(h ^ _ALONE) * power[:-1]))
        a, b = begin[own], begin[stop]
        two = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) + (begin[own + 1] - a).astype(np.uint64) * _NEXT[0])
    return one, two, owner[own], lo, hi


def _names128(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gram_hash(h, WINDOW, 55), gram_hash(h, WINDOW, 56)


def _anchor_rows(batches):
    """(name, doc, tk, lo, hi): an anchor and the windows, by start word, that it anchors in a row."""
    for batch in batches:
        for block in blocks(batch.column(2), _LIMIT):
            w = words(block, NOT_SPACE, False)
            start, name, _ = anchors(w.hash, w.first)
            if not len(start):
                continue
            doc = np.searchsorted(w.first, start, "right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(start)) - 1
            who = pa.array(doc[head] + block.lo)
            base = w.first[doc[head]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[head].view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array((start[head] - base).astype(np.int32)), pa.array((start[tail] - base + 1).astype(np.int32))],
                names=["name", "doc", "tk", "lo", "hi"],
            )


def _block_rows(shared: NameFilter | None):
    """(b1, b2, doc, tk, lo, hi): blocks and the alive windows that start in them.

    Alive are the windows whose anchor is in ``shared``, or those in the ranges that the batches have after the text.
    """

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(2), _LIMIT):
                w = words(block, NOT_SPACE, False)
                start, name, symbols = anchors(w.hash, w.first)
                if not len(start):
                    continue
                alive = np.zeros(len(w.hash), bool)
                if shared is not None:
                    alive[start] = shared.may_hold(name)
                else:
                    for k in range(block.hi - block.lo):
                        alive[w.first[k] + _spread(*unpack(batch.column(3)[block.lo + k].as_py()))] = True
                one, two, doc, lo, hi = symbol_blocks(w.hash, w.first, symbols, alive)
                who, base = pa.array(doc + block.lo), w.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(0).take(who), batch.column(1).take(who),
                        pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)),
                    ],
                    names=["b1", "b2", "doc", "tk", "lo", "hi"],
                )

    return run


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the ranges ``lo`` to ``hi`` (excluded)."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


def pack(lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Sorted ranges as bytes, those that touch as one: two or three bytes a range."""
    if len(lo):
        new = np.append(True, lo[1:] > hi[:-1])
        lo, hi = lo[new], hi[np.append(new[1:], True)]
    return zlib.compress(np.diff(np.stack((lo, hi), 1).reshape(-1), prepend=0).astype("<u4").tobytes(), 1)


def unpack(packed: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that ``pack`` packed; none for null."""
    flat = np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)) if packed else np.zeros(0, np.int64)
    return flat[::2], flat[1::2]


def _packed(rows: DataFrame, *columns: str) -> DataFrame:
    """``(doc, tk)`` and the lists of (lo, hi) in ``columns``, sorted and packed."""
    keys = rows.schema.fields[:2]

    def run(batches):
        for batch in batches:
            out = [batch.column(0), batch.column(1)]
            for c in columns:
                column = batch.column(batch.schema.get_field_index(c))
                flat, packed = column.flatten(), []
                lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                at = column.offsets.to_numpy() - column.offsets[0].as_py()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    order = np.argsort(lo[a:b], kind="stable")
                    packed.append(pack(lo[a:b][order], hi[a:b][order]) if b > a else None)
                out.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in keys), *columns])

    return map_batches(rows, run, T.StructType([*keys, *(T.StructField(c, T.BinaryType()) for c in columns)]))


def _window_rows(shared: NameFilter | None):
    """(w1, w2, doc, tk, at): the names of the windows in the ranges given, but for those that ``shared`` rules out."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(2), _LIMIT):
                w = words(block, NOT_SPACE, False)
                one, two = _names128(w.hash)
                at = [_spread(*unpack(batch.column(3)[k].as_py())) for k in range(block.lo, block.hi)]
                who = np.repeat(np.arange(len(at)), [len(x) for x in at])
                at = np.concatenate(at)
                place = w.first[who] + at
                if shared is not None:
                    keep = shared.may_hold(one[place])
                    at, who, place = at[keep], who[keep], place[keep]
                rows = pa.array(who + block.lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[place].view(np.int64)), pa.array(two[place].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32))],
                    names=["w1", "w2", "doc", "tk", "at"],
                )

    return run


def _first_documents(rows: DataFrame, names: list[str], unnamed: bool) -> DataFrame:
    """The names that two documents have, with the smallest document of each as ``src``. ``unnamed``: some ids are null."""
    least = [F.min("doc").alias("src"), F.max("doc").alias("hi")]
    if not unnamed:
        return rows.groupBy(*names).agg(*least).where("src < hi").select(*names, "src")
    found = rows.groupBy(*names).agg(*least, F.max(F.col("doc").isNull()).alias("unnamed"))
    return found.where("src < hi or (src is not null and unnamed)").select(*names, "src")


def _later() -> Column:
    """Whether a row's document comes after ``src``; a document without an id comes last."""
    return F.col("src").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("src")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 27) -> DataFrame:
    """Stored ``(doc, tk, settled, found)``: per document the packed runs of start words, first and one past the last, of
    windows that a smaller document also has.

    ``tk`` is a hash of the text: rows that repeat an id and a text are one document, other texts of an id are
    documents of equal rank. Null ids sort last. Shared anchors are looked up in a bit table of at most 2**``filter_bits``
    bits; if there are too many for that, by a join. Windows likewise, or all of them are joined.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keyed = docs.where(F.col(text_col).isNotNull()).select(whole_ids(docs, id_col).alias("doc"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    own = T.StructField("doc", keyed.schema["doc"].dataType)
    fields = lambda before, after: T.StructType([*(T.StructField(c, T.LongType()) for c in before), own, T.StructField("tk", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in after)])

    unnamed = not docs.where(F.col(id_col).isNull()).isEmpty()
    ranges_of = lambda rows, keep: F.collect_set(F.when(keep, F.struct("lo", "hi"))).alias(rows)

    spans = map_batches(keyed, _anchor_rows, fields(["name"], ["lo", "hi"]))
    shared = persist_table(_first_documents(spans, ["name"], unnamed).select("name"), "repeat-anchors")
    anchored = NameFilter.of(shared, F.col("name"), filter_bits)
    if anchored is not None:
        alive = keyed
    else:
        ranges = persist_table(_packed(spans.join(shared, "name").groupBy("doc", "tk").agg(ranges_of("r", F.lit(True))), "r"), "repeat-alive")
        alive = by_id(keyed, ranges, ["doc", "tk"], "inner", True).select("doc", "tk", "text", "r")
    found_blocks = persist_table(map_batches(alive, _block_rows(anchored), fields(["b1", "b2"], ["lo", "hi"])), "repeat-blocks")
    drop_table(shared)
    source = persist_table(_first_documents(found_blocks, ["b1", "b2"], unnamed), "repeat-block-sources")
    judged = found_blocks.join(source, ["b1", "b2"], "left").groupBy("doc", "tk").agg(ranges_of("settled", _later()), ranges_of("open", ~_later()))
    judged = persist_table(_packed(judged, "settled", "open"), "repeat-judged")
    drop_table(found_blocks, source)

    rest = persist_table(judged.where("open is not null").select("doc", "tk", "open"), "repeat-open")
    texts = by_id(keyed, rest, ["doc", "tk"], "inner", True).select("doc", "tk", "text", "open")
    windows = lambda shared: map_batches(texts, _window_rows(shared), fields(["w1", "w2"], ["at"]))
    # half a name tells which windows may have a partner; those are named once more, in full
    likely = persist_table(_first_documents(windows(None), ["w1"], unnamed).select("w1"), "repeat-likely")
    again = persist_table(windows(NameFilter.of(likely, F.col("w1"), filter_bits)), "repeat-windows")
    source = persist_table(_first_documents(again, ["w1", "w2"], unnamed), "repeat-sources")
    drop_table(likely, rest)
    starts = again.join(source, ["w1", "w2"]).where(_later()).groupBy("doc", "tk").agg(F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))).alias("found"))
    starts = persist_table(_packed(starts, "found"), "repeat-starts")
    no = F.lit(None).cast("binary")
    both = judged.where("settled is not null").select("doc", "tk", "settled", no.alias("found")).union(starts.select("doc", "tk", no, "found"))
    out = persist_table(both.groupBy("doc", "tk").agg(F.first("settled", True).alias("settled"), F.first("found", True).alias("found")), "repeat-found")
    drop_table(judged, again, source, starts)
    return out


def _strip(text_col: str):
    def make():
        def work(batch):
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            texts, settled, found = col(text_col), col("__loom_settled"), col("__loom_found")
            total, removed, kept = [], [], []
            for block in blocks(texts, _LIMIT):
                w = words(block, NOT_SPACE, False)
                raw = block.data.tobytes()
                for k in range(block.hi - block.lo):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    total.append(b - a)
                    gone = np.zeros(b - a, bool)
                    for packed in (settled[block.lo + k].as_py(), found[block.lo + k].as_py()):
                        if packed:
                            edge = np.zeros(b - a + 1, np.int64)
                            lo, hi = unpack(packed)
                            np.add.at(edge, lo, 1)
                            np.add.at(edge, hi + WINDOW - 1, -1)
                            gone |= np.cumsum(edge)[:-1] > 0
                    stay = np.flatnonzero(~gone) + a
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]).decode("utf-8"))
            return [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

        return work

    return make


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept_text`` (words that stay, joined by one space).

    Words are runs of anything but white space. A word goes if a window of 13 words over it also starts in a
    document with a smaller id. Null, empty and shorter texts lose nothing; repeats inside one document stay. Ids may
    be of any type that orders; a null id comes last. Rows that repeat an id and a text are one document; other texts of
    an id don't take from each other. An empty table gives an empty result. A new name that ``docs`` has, in whatever
    case, is an error: give a ``prefix``.
    """
    keys = {"doc": "__loom_doc", "tk": "__loom_tk", "settled": "__loom_settled", "found": "__loom_found"}
    found = repeats(docs, id_col, text_col).withColumnsRenamed(keys)
    keyed = docs.withColumns({"__loom_doc": whole_ids(docs, id_col), "__loom_tk": F.xxhash64(text_col)})
    joined = by_id(keyed, found, ["__loom_doc", "__loom_tk"], "left", True).select(*docs.columns, "__loom_settled", "__loom_found")
    fields = [T.StructField(prefix + "n_words", T.LongType()), T.StructField(prefix + "n_removed", T.LongType()), T.StructField(prefix + "kept_text", T.StringType())]
    return with_arrow_columns(joined, _strip(text_col), fields, ["__loom_settled", "__loom_found"])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Removal of 13-word repeats from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs).drop("text")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[CAST(i AS BIGINT) : CAST(i + 12 AS BIGINT)], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 11, 1))) t(i)
), src AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM win JOIN src USING (g), unnest(range(i, i + 13)) t(k) WHERE src.d < doc_id GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: ks IS NULL OR NOT list_contains(ks, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
