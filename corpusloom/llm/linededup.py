"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard checks, one line kept per component.

A line is what stands between newlines, compared without outer white space and with A-Z folded. Its set is its
distinct runs of 8 characters (the whole line if shorter); lines link at similarity 0.8 or more. Blank lines
are no lines: they always stay.

Signatures are grouped minima over all shingles of a block of texts. Equal
lines become one class before any bucket is made, so a line repeated in a third of all documents is one row
from there on. 14 bands of 4 rows find a pair at similarity 0.8 in 9994 of 10000 cases; what they find is
checked on full sets, and components join what a third line links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import map_batches, with_arrow_columns
from corpusloom.llm.idjoin import by_id, unrepeated, whole_ids
from corpusloom.llm.minhash import linked_components
from corpusloom.llm.textblocks import LOWER, Block, blocks, long_list, mix, stream
from corpusloom.session import drop_table, persist_table, ship_package

SHINGLE, PERCENT = 8, 80
BANDS, ROWS = 14, 4
BINS = BANDS * ROWS
_PICK = (stream(41, BINS * 512).reshape(BINS, 512) >> np.uint64(33)).astype(np.int64) % BINS
_ROW, _SALT, _A = stream(42, ROWS), stream(43, BANDS), stream(44, 8)
_KEY_BITS = 44
_NONE = np.uint64(2**64 - 1)


class Lines:
    """The non-blank lines of a block: owner text, number in it, code point range, and all shingle hashes."""

    def __init__(self, block: Block):
        data = LOWER[block.data]
        lead = (data & 0xC0) != 0x80
        self.chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        count = np.concatenate(([0], np.cumsum(lead)))
        doc_at = count[block.offsets]  # code points before each text
        c, n = self.chars, len(self.chars)
        newline = np.flatnonzero(c == 10)
        texts = np.flatnonzero(np.diff(doc_at) > 0)
        begin = np.unique(np.concatenate((doc_at[texts], newline + 1)))
        begin = begin[begin < n]
        doc = np.searchsorted(doc_at, begin, "right") - 1
        end = np.minimum(np.append(newline, n)[np.searchsorted(newline, begin)], doc_at[doc + 1])
        # numbers count every line of a text, blank ones too
        breaks = np.searchsorted(newline, begin)
        number = breaks - np.searchsorted(newline, doc_at[doc])
        solid = np.flatnonzero((c != 32) & ((c < 9) | (c > 13)))
        first = np.searchsorted(solid, begin)
        last = np.searchsorted(solid, end)
        keep = last > first
        self.doc, self.number = doc[keep], number[keep]
        self.begin, self.end = solid[first[keep]] if len(solid) else begin[keep], (solid[last[keep] - 1] + 1) if len(solid) else end[keep]
        self.doc_at = doc_at

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in line order, and where each line's begin (one more at the end)."""
        c = self.chars
        size = np.maximum(self.end - self.begin - SHINGLE + 1, 1)
        at = np.concatenate(([0], np.cumsum(size)))
        with np.errstate(over="ignore"):
            pad = np.concatenate((c, np.zeros(SHINGLE, np.uint64)))
            two = pad[:-1] << np.uint64(21) | pad[1:]
            four = two[:-2] * _A[0] + (two[2:] ^ np.uint64(0x5BD1)) * _A[1]
            four ^= four >> np.uint64(31)
            eight = mix(four[:-4] * _A[2] + four[4:] * _A[3])
            pos = np.repeat(self.begin - at[:-1], size) + np.arange(at[-1])
            g = eight[pos]
            for k in np.flatnonzero(self.end - self.begin < SHINGLE).tolist():
                word = c[self.begin[k] : self.end[k]]
                g[at[k]] = mix(np.array([(word * _A[: len(word)]).sum(dtype=np.uint64) + np.uint64(len(word))]))[0]
        return g, at


def bucket_keys(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A (lines, bands) grid of bucket keys."""
    n = len(at) - 1
    grid = np.full((n, BINS), _NONE)
    with np.errstate(over="ignore"):
        flat = grid.reshape(-1)
        for lo in range(0, n, 1 << 18):
            hi = min(n, lo + (1 << 18))
            part = g[at[lo] : at[hi]]
            cell = np.repeat(np.arange(lo, hi) * BINS, np.diff(at[lo : hi + 1])) + (((part >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, cell, part)
        full = grid != _NONE
        row, col = np.nonzero(~full)
        for k in range(_PICK.shape[1]):
            if not len(row):
                break
            look = _PICK[col, k]
            hit = full[row, look]
            grid[row[hit], col[hit]] = grid[row[hit], look[hit]]
            row, col = row[~hit], col[~hit]
        for r, c in zip(row.tolist(), col.tolist(), strict=True):  # all looks missed: the next full bin round the circle
            filled = np.flatnonzero(full[r])
            grid[r, c] = grid[r, filled[np.searchsorted(filled, c) % len(filled)]]
        key = mix(mix(grid.reshape(n, BANDS, ROWS) * _ROW).sum(2, dtype=np.uint64) + _SALT)
    return key >> np.uint64(64 - _KEY_BITS) | np.arange(BANDS, dtype=np.uint64) << np.uint64(_KEY_BITS)


_LIMIT = 1 << 19
#: Texts whose lines are in memory together.
_TEXTS = 1000


def _line_rows(batches):
    salt = stream(45, 1)[0]
    for batch in batches:
        ids, tks = batch.column(0), batch.column(1)
        for block in blocks(batch.column(2), _LIMIT):
            lines = Lines(block)
            if not len(lines.doc):
                continue
            g, at = lines.shingles()
            with np.errstate(over="ignore"):
                f1 = np.add.reduceat(g, at[:-1])
                f2 = np.add.reduceat(g * (g ^ salt), at[:-1])
            keys = bucket_keys(g, at)
            who = pa.array(lines.doc + block.lo)
            columns = [ids.take(who), tks.take(who), pa.array(lines.number.astype(np.int32)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))]
            columns.append(long_list(keys.reshape(-1), np.arange(len(keys) + 1) * BANDS))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "tk", "line", "f1", "f2", "keys"])


def _item_rows(batches):
    """(id, item): the lines wanted of each text, without outer white space."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _TEXTS):
            texts, wanted, ids = (c.slice(lo, _TEXTS) for c in batch.columns)
            items = []
            for text, numbers in zip(texts, wanted.to_pylist(), strict=True):
                lines = text.as_py().split("\n")
                items += [lines[k].strip(" \t\x0b\x0c\r") for k in numbers]
            yield pa.RecordBatch.from_arrays([ids.flatten().cast(pa.int64()), pa.array(items, pa.string())], names=["id", "item"])


def sets_of_lines(column: pa.Array) -> list[np.ndarray]:
    """Sorted shingle sets of a column of lines."""
    out = []
    for block in blocks(column, _LIMIT):
        g, at = Lines(block).shingles()
        out += [np.unique(g[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def removable_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, tk, lines)``: for each document that loses lines, their numbers from 0, sorted.

    ``tk`` is a hash of the text, so that rows of one id with other texts are told apart. Of each component the line
    with the smallest (id, number) stays. Null ids sort last; rows that repeat an id and a text are one document.
    """
    ship_package(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    own = [T.StructField("doc", keyed.schema["doc"].dataType), T.StructField("tk", T.LongType()), T.StructField("line", T.IntegerType())]
    schema = T.StructType([*own, T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    lines = persist_table(map_batches(keyed, _line_rows, schema).withColumn("id", F.monotonically_increasing_id()), "lines")
    classes = persist_table(lines.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("hi")).where("rep < hi").drop("hi"), "line-classes")
    copies = persist_table(lines.select("f1", "f2", "id").join(classes, ["f1", "f2"]).where("id <> rep").select("id", "rep"), "line-copies")
    bands = by_id(lines.select("id", "keys"), copies.select("id"), "id", "left_anti").select(F.explode("keys").alias("key"), "id")

    def items_of(ids: DataFrame) -> DataFrame:
        of_doc = by_id(lines.select("doc", "tk", "line", "id"), ids, "id", "left_semi")
        lists = of_doc.groupBy("doc", "tk").agg(F.collect_list(F.struct("line", "id")).alias("w"))
        # two plain lists take 12 bytes a line in a broadcast, a list of structs 32
        wanted = persist_table(lists.select("doc", "tk", F.col("w.line").alias("wanted"), F.col("w.id").alias("ids")), "line-wanted")
        out = map_batches(by_id(keyed, wanted, ["doc", "tk"], "inner", True).select("text", "wanted", "ids"), _item_rows, "id long, item string")
        # rows that repeat an id and a text give equal items
        return out if single else out.dropDuplicates(["id"])

    single = unrepeated(keyed.select("doc", "tk"), ["doc", "tk"])
    labels = persist_table(linked_components(bands, items_of, PERCENT, sets_of_lines), "line-labels")
    label = labels.select(F.col("node").alias("rep"), "component")
    # every line that shares its component: copies, their classes' first lines, and linked lines
    rooted = (
        copies.join(label, "rep", "left").select("id", F.coalesce("component", "rep").alias("root"))
        .union(classes.select(F.col("rep")).join(label, "rep", "left").select(F.col("rep").alias("id"), F.coalesce("component", "rep").alias("root")))
        .union(labels.select(F.col("node").alias("id"), F.col("component").alias("root")))
        .union(labels.select(F.col("component").alias("id"), F.col("component").alias("root")))
        .distinct()
    )
    placed = persist_table(by_id(lines.select("doc", "tk", "line", "id"), persist_table(rooted, "line-roots"), "id", "inner").drop("id"), "line-placed")
    # a null id comes last
    place = F.struct(F.col("doc").isNull(), "doc", "line", "tk")
    kept = persist_table(placed.groupBy("root").agg(F.min(place).alias("keep")), "line-kept")
    gone = placed.join(kept, "root").where(place != F.col("keep")).select("doc", "tk", "line").distinct()
    out = persist_table(gone.groupBy("doc", "tk").agg(F.sort_array(F.collect_list("line")).alias("lines")), "line-removals")
    drop_table(lines, classes, copies, labels, placed, kept)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        whole_ids(docs, id_col).alias("doc"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text")
    ).where("text is not null")


def _cut(text_col: str):
    def make():
        def work(batch):
            texts = batch.column(batch.schema.get_field_index(text_col))
            gone = batch.column(batch.schema.get_field_index("__loom_lines"))
            total = pc.fill_null(pc.add(pc.count_substring(texts, "\n").cast(pa.int64()), 1), 0)
            removed = pc.fill_null(pc.list_value_length(gone).cast(pa.int64()), 0)
            touched = pc.greater(removed, 0)
            new = []
            for t, g in zip(texts.filter(touched).to_pylist(), gone.filter(touched).to_pylist(), strict=True):
                drop = set(g)
                new.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
            return [pc.replace_with_mask(texts, touched, pa.array(new, texts.type)), total, removed]

        return work

    return make


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus ``kept_text``, ``n_lines`` and ``n_removed`` (names take ``prefix``).

    A null text has no lines and stays null; an empty text has one blank line. A document whose lines all go keeps
    its row, with an empty text. Of equal and near lines the first by (id, number) stays; a null id comes last; ids may be
    of any type that orders. Rows that repeat an id and a text are one document and lose the same lines. An empty table
    gives an empty result. A new name that ``docs`` has, in whatever case, is an error: give a ``prefix``.
    """
    removals = removable_lines(docs, id_col, text_col).withColumnRenamed("lines", "__loom_lines")
    keyed = docs.withColumns({"__loom_doc": whole_ids(docs, id_col), "__loom_tk": F.xxhash64(text_col)})
    removals = removals.withColumnsRenamed({"doc": "__loom_doc", "tk": "__loom_tk"})
    joined = by_id(keyed, removals, ["__loom_doc", "__loom_tk"], "left", True).select(*docs.columns, "__loom_lines")
    fields = [T.StructField(prefix + "kept_text", T.StringType()), T.StructField(prefix + "n_lines", T.LongType()), T.StructField(prefix + "n_removed", T.LongType())]
    return with_arrow_columns(joined, _cut(text_col), fields, ["__loom_lines"])


def keep_first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the columns it has, and texts that keep one line of each component.

    ``drop_emptied`` drops documents that lost lines and have none left but blank ones; those without lines before stay.
    """
    p = "__loom_l_"
    out = dedup_lines(docs, id_col, text_col, p)
    if drop_emptied:
        out = out.where((F.col(p + "n_removed") == 0) | F.col(p + "kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col(p + "kept_text").alias(c) if c == text_col else c for c in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Fuzzy line dedup of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs).drop("text")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force_sets(line: str) -> set:
    """The set of a line as the docstring above defines it (for tests)."""
    line = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))} if line else set()


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
