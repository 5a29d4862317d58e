"""MinHash near-duplicates of documents, exact on every link it reports.

1. One pass makes each document's set of word shingles, its size, a 128-bit set fingerprint, and a signature by
   one-permutation hashing: a bin per range of the hash space, empty bins filled from a bin that a universal
   hash picks (optimal densification). Bands of the signature are the bucket keys.
2. Documents with equal sets are one class; only its smallest document goes on. Copies in any number cost one row.
3. In a bucket, every member is paired with one centre: a star, so pairs grow as the rows, not as their square.
   Each pair is checked on full sets. Buckets that then hold more than one component take a few further centres, each
   for the members outside its component, once; in a bucket of up to eight, every member is a centre in turn, which
   settles it.
4. Members of larger buckets that then still hold more than one component are joined exactly: two sets at the threshold
   share a shingle of their rarest few, at places that leave room for the rest. No pair of them is left out.
5. Components come from distributed label propagation.

At similarity 0.8, 32 bands of 5 rows miss a pair in 3 of 10^6; links through a third document lower that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import map_batches, prefixed, with_arrow_columns
from corpusloom.llm.idjoin import by_id, unrepeated
from corpusloom.llm.textblocks import NOT_SPACE, blocks, gram_hash, long_list, mix, stream, words
from corpusloom.operators.graph import connected_components
from corpusloom.session import drop_table, persist_table, ship_package

BANDS, ROWS = 32, 5
#: Centres that a bucket takes in the second round; in one of at most ``SMALL`` members every member is one in turn.
CENTRES, SMALL = 6, 8
#: Bits of the table that counts shingles; shingles that share a place in it share a count.
COUNT_BITS = 22


class Signer:
    """One-permutation signatures of sorted sets of 64-bit hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.edge = np.array([-(-(i << 64) // self.k) for i in range(self.k)], np.uint64)
        # which bin an empty bin looks at, in turn
        self.pick = (stream(31, self.k * 1024).reshape(self.k, 1024) >> np.uint64(33)).astype(np.int64) % self.k
        self.coeff = stream(32, rows)
        self.band_salt = stream(33, bands)

    def signature(self, sets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sets, self.edge)
        full = np.append(at[1:], len(sets)) > at
        out = np.zeros(self.k, np.uint64)
        out[full] = sets[at[full]]
        empty = np.flatnonzero(~full)
        if len(empty):
            for width in (16, 1024):
                seen = full[self.pick[empty, :width]]
                hit = seen.any(1)
                out[empty[hit]] = out[self.pick[empty[hit], seen[hit].argmax(1)]]
                empty = empty[~hit]
                if not len(empty):
                    break
            else:  # a few bins of tiny sets: the next full bin round the circle
                filled = np.flatnonzero(full)
                out[empty] = out[filled[np.searchsorted(filled, empty) % len(filled)]]
        return out

    def keys(self, sets: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            grid = self.signature(sets).reshape(self.bands, self.rows)
            return mix(mix(grid * self.coeff).sum(1, dtype=np.uint64) + self.band_salt)


def shingle_sets(block, shingle: int, is_word: np.ndarray = NOT_SPACE):
    """For each text of a block, its sorted set of shingle hashes (the whole sequence if it is shorter)."""
    w = words(block, is_word, True)
    g = gram_hash(w.hash, shingle)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(g[a : b - shingle + 1])
        else:
            yield gram_hash(w.hash[a:b], b - a) if b > a else w.hash[:0]


def _signatures(text_col: str, shingle: int):
    def make():
        signer, s1, s2 = Signer(), *stream(34, 2)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n, f1, f2, keys = [], [], [], []
            with np.errstate(over="ignore"):
                for block in blocks(batch.column(batch.schema.get_field_index(text_col))):
                    for sets in shingle_sets(block, shingle):
                        n.append(len(sets))
                        f1.append(mix(sets ^ s1).sum(dtype=np.uint64))
                        f2.append(mix(sets ^ s2).sum(dtype=np.uint64))
                        keys.append(signer.keys(sets) if len(sets) else sets)
            size = np.array([len(k) for k in keys], np.int64)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            return [pa.array(n, pa.int64()), as_long(f1), as_long(f2), long_list(flat, np.concatenate(([0], np.cumsum(size))))]

        return work

    return make


def sets_of_texts(shingle: int):
    """A function from a column of texts to their shingle sets."""
    return lambda column: [x for block in blocks(column.cast(pa.string())) for x in shingle_sets(block, shingle)]


def stored_sets(column: pa.Array) -> list[np.ndarray]:
    """Sets from sorted 64-bit hashes as bytes."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


#: Rows whose sets are in memory together.
_TOGETHER = 512


def _in_parts(batch, columns: list[str], sets):
    """Sets of the columns named, a bounded number of rows at a time; equal items, such as a star's centre, are made once."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    for lo in range(0, batch.num_rows, _TOGETHER):
        parts = [c.slice(lo, _TOGETHER).dictionary_encode() for c in columns]
        made = [sets(p.dictionary) for p in parts]
        yield from zip(*([m[k] for k in p.indices.to_pylist()] for m, p in zip(made, parts, strict=True)), strict=True)


def _check(percent: int, sets):
    def make():
        def work(batch):
            ok = []
            for x, y in _in_parts(batch, ["sa", "sb"], sets):
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            return [pa.array(ok, pa.bool_())]

        return work

    return make


def shingle_counts(items: DataFrame, sets) -> np.ndarray:
    """How many items hold a shingle of each place, up to 65535: a table of fixed size."""

    def count_rows(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for (x,) in _in_parts(batch, ["item"], sets):
                np.add.at(total, _place(x), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "n"])

    rows = map_batches(items.select("item"), count_rows, "place int, n long").groupBy("place").agg(F.least(F.sum("n"), F.lit(65535)).cast("int").alias("n"))
    count = np.zeros(1 << COUNT_BITS, np.uint16)
    found = rows.toArrow()
    count[found["place"].to_numpy()] = found["n"].to_numpy()
    return count


def _place(sets: np.ndarray) -> np.ndarray:
    return (mix(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _prefix_rows(counts, percent: int, sets_of_items):
    """(g, component, id, n, at, short): the rarest shingles of each set, those that a partner at the threshold must share one of.

    ``short`` marks the fewer that do for a partner of at least the same size.
    """

    def run(batches):
        count = counts.value
        for batch in batches:
            g, at, short, size, rows = [], [], [], [], []
            for k, (sets,) in enumerate(_in_parts(batch, ["item"], sets_of_items)):
                n = len(sets)
                long_ = n + percent * n // -100 + 1
                held = count[_place(sets)]
                order = np.lexsort((sets, held))[:long_]
                place = np.flatnonzero(held[order] > 1)  # a shingle that no other set holds finds no partner
                g.append(sets[order[place]])
                at.append(place)
                short.append(place < n + 2 * percent * n // -(100 + percent) + 1)
                size.append(np.full(len(place), n))
                rows.append(np.full(len(place), k))
            if not g:
                continue
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(g).view(np.int64)), batch.column(1).take(rows), batch.column(0).take(rows),
                    pa.array(np.concatenate(size)), pa.array(np.concatenate(at)), pa.array(np.concatenate(short)),
                ],
                names=["g", "component", "id", "n", "at", "short"],
            )

    return run


def exact_candidates(items: DataFrame, percent: int, sets=stored_sets) -> DataFrame:
    """Stored pairs ``(hi, lo)`` of other components, from stored ``(id, component, item)`` rows: all at the threshold are among them.

    ``sets`` makes sorted sets of a column of items. Shingles are ordered by how many sets hold them, the rarest first. Of
    two sets at the threshold, the smaller has the first shingle they share in its short prefix, the larger in its long one,
    and behind it both have enough shingles left for the overlap. Members of one component never meet: components that share
    a shingle are paired first.
    """
    spark = items.sparkSession
    ship_package(spark)
    count = shingle_counts(items, sets)
    rows = map_batches(
        items.select("id", "component", "item"),
        _prefix_rows(spark.sparkContext.broadcast(count), percent, sets),
        T.StructType([T.StructField("g", T.LongType()), T.StructField("component", items.schema["component"].dataType), T.StructField("id", items.schema["id"].dataType), *prefixed([("n", T.LongType()), ("at", T.LongType()), ("short", T.BooleanType())], "")]),
    )
    prefixes = persist_table(rows, "minhash-prefixes")
    shared = prefixes.groupBy("g").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("short").alias("probed")).where("c0 < c1 and probed").select("g")
    rows = persist_table(prefixes.join(shared, "g", "left_semi"), "minhash-shared")
    small, large = rows.where("short").drop("short"), rows.drop("short").withColumnsRenamed({"component": "c2", "id": "id2", "n": "n2", "at": "at2"})
    # what holds for every pair of members rules out pairs of components
    of = lambda side, c, n, at, to: side.groupBy("g", c).agg(F.min(n).alias(f"n{to}"), F.max(F.col(n) - F.col(at)).alias(f"left{to}"))
    both = of(small, "component", "n", "at", "_a").join(of(large, "c2", "n2", "at2", "_b"), "g")
    fits = lambda left, left2, n, n2: F.least(left, left2) * (100 + percent) >= (F.col(n) + F.col(n2)) * percent
    both = both.where((F.col("component") != F.col("c2")) & fits("left_a", "left_b", "n_a", "n_b")).select("g", "component", "c2", "left_b", "n_b")
    left, left2 = F.col("n") - F.col("at"), F.col("n2") - F.col("at2")
    pairs = both.join(small, ["g", "component"]).where(fits(left, F.col("left_b"), "n", "n_b")).join(large, ["g", "c2"]).where(fits(left, left2, "n", "n2"))
    pairs = pairs.where((F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2"))))
    out = persist_table(pairs.select(F.greatest("id", "id2").alias("hi"), F.least("id", "id2").alias("lo")).distinct(), "minhash-exact-pairs")
    drop_table(prefixes, rows)
    return out


def linked_components(bands: DataFrame, items_of, percent: int, sets=stored_sets) -> DataFrame:
    """``(node, component)`` of all ids that have a link to a smaller one, from bucket rows ``(key, id)``.

    ``items_of(ids)`` gives the ``(id, item)`` rows of stored ids, of which ``sets`` makes sorted sets of 64-bit hashes.
    Stars, checks on full sets and the exact end are as the module says: no two members of a bucket are left that have a
    link and other components.
    A bucket of two is settled by its one pair, so only members of larger ones are looked up.
    """
    groups = persist_table(
        bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi"), "minhash-buckets"
    )
    members = persist_table(by_id(bands, groups.where("size > 2").select("key"), "key", "inner").select("key", "id").distinct(), "minhash-members")
    # a centre is the member with most company in all its buckets: of edited copies, the original
    ranked = persist_table(members.join(members.groupBy("id").agg(F.count(F.lit(1)).alias("weight")), "id"), "minhash-ranked")
    best = lambda: F.min_by("id", F.struct(-F.col("weight"), "id")).alias("mid")
    pair = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))

    def verified(pairs: DataFrame, items: DataFrame | None = None) -> DataFrame:
        own = []
        if items is None:
            own.append(ids := persist_table(pairs.select(F.explode(F.array("hi", "lo")).alias("id")).distinct(), "minhash-candidates"))
            own.append(items := persist_table(items_of(ids), "minhash-items"))
        both = pairs.join(items.select(F.col("id").alias("lo"), F.col("item").alias("sb")), "lo").join(
            items.select(F.col("id").alias("hi"), F.col("item").alias("sa")), "hi"
        )
        ok = with_arrow_columns(both, _check(percent, sets), [T.StructField("ok", T.BooleanType())], ["sa", "sb"])
        out = persist_table(ok.where("ok").select("hi", "lo").distinct(), "minhash-links")
        drop_table(*own)
        return out

    first = persist_table(ranked.groupBy("key").agg(best()), "minhash-centres")
    stars = ranked.join(first, "key").where("id <> mid").select(*pair("id", "mid"))
    tested = persist_table(stars.union(groups.where("size = 2").select("hi", "lo")).distinct(), "minhash-pairs")
    drop_table(groups)
    found = verified(tested)

    labels = connected_components(found, "hi", "lo")

    def place(labels: DataFrame) -> DataFrame:
        of = labels.withColumnRenamed("node", "id")
        return persist_table(ranked.join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "minhash-placed")

    placed = place(labels)
    some = F.array_distinct(F.array(*[F.min_by(F.struct("id", "component"), F.xxhash64("key", "id", F.lit(k))) for k in range(CENTRES)]))
    open_ = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"), some.alias("m"))
    open_ = persist_table(open_.where("c0 < c1").select("key", "n", "m"), "minhash-centres")
    centre = open_.where(F.col("n") > SMALL).select("key", F.inline("m").alias("mid", "mc"))
    few = placed.join(open_.where(F.col("n") <= SMALL).select("key"), "key", "left_semi").select("key", F.col("id").alias("mid"), F.col("component").alias("mc"))
    more = placed.join(centre.union(few), "key").where("component <> mc").select(*pair("id", "mid")).distinct()
    more = persist_table(more.join(tested, ["hi", "lo"], "left_anti"), "minhash-pairs")
    if not more.isEmpty():
        again = verified(more)
        if not again.isEmpty():
            labels = connected_components(found.union(again), "hi", "lo")
            drop_table(placed)
            placed = place(labels)

    # what the stars leave open: buckets of more than one component
    still = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"))
    still = still.where((F.col("c0") < F.col("c1")) & (F.col("n") > SMALL)).select("key")
    ids = persist_table(placed.join(still, "key", "left_semi").select("id", "component").distinct(), "minhash-open-ids")
    drop_table(members, ranked, first, open_, tested, more)
    if not ids.isEmpty():
        items = persist_table(items_of(ids.select("id")).join(ids, "id"), "minhash-open-items")
        pairs = exact_candidates(items, percent, sets)
        ends = verified(pairs, items)
        drop_table(items, pairs)
        if not ends.isEmpty():
            # links between components: their components are the new names
            for end in ("hi", "lo"):
                ends = ends.join(ids.withColumnsRenamed({"id": end, "component": f"{end}_c"}), end).drop(end).withColumnRenamed(f"{end}_c", end)
            names = connected_components(ends, "hi", "lo").select(F.col("node").alias("root"), F.col("component").alias("new"))
            # a root may have no label of its own yet
            every = labels.union(names.select("root", F.col("root").alias("component"))).distinct()
            labels = persist_table(every.join(names, F.col("component") == F.col("root"), "left").select("node", F.coalesce("new", "component").alias("component")), "minhash-labels")
    drop_table(placed, ids)
    return labels.where("node <> component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles`` (long), ``component_id``, ``kept`` (boolean).

    Words are A-Z-folded runs of anything but white space; a document's set is its distinct runs of ``shingle``
    words, or its whole sequence if shorter. Two documents link if 100 * common >= ``percent`` * union.
    component_id is the smallest id reachable, kept marks that document itself.

    Null, empty and wordless texts have 0 shingles, link with nothing and are kept. A row whose id is null links
    with nothing; its component_id is null and it is kept. Rows that repeat an id get one component: the least that
    any of its texts has. Other columns
    of ``docs`` are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [("n", T.LongType()), ("f1", T.LongType()), ("f2", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    sig = persist_table(with_arrow_columns(docs, _signatures("text", shingle), prefixed(fields, ""), ["text"]), "minhash-signatures")
    linked = sig.where("n > 0 and id is not null")

    # classes of equal sets; those of one id need no row
    classes = persist_table(
        linked.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last"), "minhash-classes"
    )
    member = linked.drop("keys").join(classes, ["f1", "f2", "n"], "left").select("id", "n", "f1", "f2", F.coalesce("rep", "id").alias("rep"))
    copies = persist_table(member.where("id <> rep").select("id", "f1", "f2").distinct(), "minhash-copies")
    reps = by_id(linked, copies, ["id", "f1", "f2"], "left_anti")

    def items_of(ids: DataFrame) -> DataFrame:
        out = by_id(docs.where("id is not null"), ids, "id", "left_semi").select("id", F.col("text").alias("item"))
        # where rows repeat an id, every text's set is compared, each once
        return out if single else out.distinct()

    single = unrepeated(reps.select("id"), ["id"])
    labels = linked_components(reps.select(F.explode("keys").alias("key"), "id"), items_of, percent, sets_of_texts(shingle))

    # back to all documents: a copy has its class's component
    top = persist_table(
        member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
        .where("id <> component").groupBy("id").agg(F.min("component").alias("component")),
        "minhash-removed",
    )
    drop_table(classes, copies)
    out = by_id(sig.select("id", "n"), top, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.col("component").isNull().alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, shingle, percent).where("not kept").select(id_col).distinct()
    return by_id(docs, persist_table(gone, "minhash-gone"), id_col, "left_anti").select(*docs.columns)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct([w[CAST(i AS BIGINT)] || ' ' || w[CAST(i + 1 AS BIGINT)] FOR i IN range(1, len(w))]) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), link AS (
  SELECT x, y FROM common WHERE 100 * c >= 80 * (nx + ny - c)
), both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT DISTINCT x AS node, x AS other FROM both_ways
  UNION
  SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.other
), comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM s LEFT JOIN comp ON comp.node = s.doc_id
"""
