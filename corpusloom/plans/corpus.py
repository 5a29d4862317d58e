"""Corpus queries: classification, dedup, contamination, similarity, text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import classify, text
from corpusloom.functions.values import literal_udf, signature_udf, wrap_udf
from corpusloom.operators import sampling, similarity
from corpusloom.operators.graph import connected_components
from corpusloom.plans.registry import query

_NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"""
WITH d AS (SELECT *, {_NORM} AS t FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY sha256(t) ORDER BY doc_id) > 1 AS dup FROM d),
b AS (SELECT DISTINCT substr(t, CAST(i + 1 AS BIGINT), 60) AS w FROM (SELECT {_NORM} AS t FROM benchmark), unnest(range(0, greatest(length(t) - 60, 0), 30)) x(i)),
c AS (SELECT DISTINCT doc_id FROM d, unnest(range(0, greatest(length(t) - 60, 0), 1)) x(i) WHERE substr(t, CAST(i + 1 AS BIGINT), 60) IN (SELECT w FROM b))
SELECT source, lang, count(*) AS n_in, CAST(sum(CAST(dup AS INT)) AS BIGINT) AS n_dup,
  CAST(sum(CASE WHEN NOT dup AND c.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_contaminated,
  CAST(sum(CASE WHEN NOT dup AND c.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
  CAST(sum(CASE WHEN NOT dup AND c.doc_id IS NULL THEN length(t) ELSE 0 END) AS BIGINT) AS chars_kept
FROM k LEFT JOIN c USING (doc_id) GROUP BY source, lang
""")
def clean_corpus_report(t):
    """Exact dedup, then contamination, then counts by source and language."""
    docs = t.documents.select("doc_id", "source", "lang", text.normalise(F.col("text")).alias("t")).withColumn("h", text.fingerprint(F.col("t")))
    keepers = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    bad = similarity.shingle_hits(docs, t.benchmark.select(text.normalise(F.col("text")).alias("b")), "doc_id", F.col("t"), F.col("b")).withColumn("bad", F.lit(True))
    rows = docs.join(keepers, "doc_id", "left").join(bad, "doc_id", "left")
    dup, hit = F.col("first").isNull(), F.col("bad").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_in"), count(dup).alias("n_dup"), count(~dup & hit).alias("n_contaminated"), count(~dup & ~hit).alias("n_kept"),
        F.sum(F.when(~dup & ~hit, F.length("t")).otherwise(0)).cast("long").alias("chars_kept"),
    )


# The classifier's patterns, as in functions/classify.py, for the SQL.
_SIG = " + ".join(
    f"CAST(regexp_matches(s, '{p}') AS INT)"
    for p in (
        r"(?m)^\s*[.\w]+\s*:\s*\{", r"\\d\s+\.[a-zA-Z]", r"(?i)\bselect\b[^\n]{0,80}\bfrom\b", r"\bupsert\b|\binsert\b", "0N!", r"\.z\.[a-z]{1,3}\b",
        r"`[a-zA-Z][\w.]*", r"(?m)^\s*//", r"\beach\b|\bover\b|\bscan\b", r"\{\[[a-zA-Z][\w;]*\]",
    )
)
_CLASSIFIED = rf"""
WITH f AS (SELECT 'd' || doc_id AS id, source AS repo, text AS t FROM documents UNION ALL SELECT 'p' || page_id, 'web', html FROM pages),
g AS (SELECT *, substr(t, 1, 200000) AS s, substr(t, 1, 4000) AS h, substr(t, 1, 2000) AS h2 FROM f),
c AS (SELECT *, {_SIG} AS n, length(s) AS z FROM g),
e AS (SELECT id, repo, n, octet_length(encode(t)) AS bytes, CASE
  WHEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty'
  WHEN regexp_matches(t, '^\s*[\[{{]\s*"') THEN 'json'
  WHEN regexp_matches(h, 'SyntaxVersion=|BeginHotkey=|MacroID=') OR (regexp_matches(h2, '(?m)^\s*\[[A-Za-z ]+\]\s*$') AND contains(h2, '=')) THEN 'ini/quickmacro'
  WHEN length(regexp_replace(s, '[^一-鿿぀-ヿ]', '', 'g')) > z * 0.02 THEN 'cjk-heavy'
  WHEN regexp_matches(h, '(?i)<(html|div|span|script)\b') THEN 'html'
  WHEN regexp_matches(h, '(?m)^\s*(import |from \w+ import |def \w+\(|function \w+\(|const \w+ =)') AND NOT regexp_matches(h, '(?m)^\s*[.\w]+\s*:\s*\{{') THEN 'python/js'
  WHEN n < CASE WHEN z < 4000 THEN 1 WHEN z < 20000 THEN 2 ELSE 3 END THEN 'too-few-q-signals'
  WHEN z > 50000 AND n / greatest(z / 1024, 1) < 0.02 THEN 'signal-sparse' ELSE 'keep' END AS reason FROM c),
r AS (SELECT id, repo, CASE WHEN reason IN ('too-few-q-signals', 'signal-sparse', 'keep') THEN n ELSE 0 END AS n_signals, bytes, reason FROM e)
"""


def _classified(t):
    files = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("source").alias("repo"), F.col("text").alias("t")).unionAll(
        t.pages.select(F.concat(F.lit("p"), F.col("page_id")), F.lit("web"), F.col("html"))
    )
    return classify.classified(files, "t")


@query(_CLASSIFIED + "SELECT reason, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(n_signals) AS BIGINT) AS n_signals FROM r GROUP BY reason")
def doc_classify_reasons(t):
    """Files and bytes by the classifier's reason."""
    return _classified(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("n_signals").cast("long").alias("n_signals"))


@query(_CLASSIFIED + "SELECT id, repo, n_signals, CAST(bytes AS BIGINT) AS bytes, reason FROM r WHERE reason <> 'keep'")
def rejected_files(t):
    """The dead letters: every dropped file with its reason and evidence."""
    return _classified(t).where("reason <> 'keep'")


@query(_CLASSIFIED + "SELECT repo, CAST(sum(bytes) AS BIGINT) AS bytes FROM r WHERE reason <> 'keep' GROUP BY repo ORDER BY bytes DESC, repo LIMIT 10")
def largest_drops(t):
    """The ten repositories that lose most bytes."""
    return _classified(t).where("reason <> 'keep'").groupBy("repo").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "repo").limit(10)


@query(f"SELECT min(doc_id) AS doc_id, sha256({_NORM}) AS digest, count(*) AS n_copies FROM documents GROUP BY sha256({_NORM})")
def exact_dedup_first(t):
    """One document of each normalised text, the one with the smallest id."""
    return t.documents.select("doc_id", text.fingerprint(text.normalise(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


def _strided(t, full):
    docs = t.documents.select("doc_id", text.normalise(F.col("text")).alias("t"))
    tests = t.benchmark.select(text.normalise(F.col("text")).alias("b"))
    return similarity.shingle_hits(docs, tests, "doc_id", F.col("t"), F.col("b"), full=full)


_STRIDE_SQL = """
WITH b AS (SELECT DISTINCT substr(t, CAST(i + 1 AS BIGINT), 60) AS w FROM (SELECT {n} AS t FROM benchmark), unnest(range(0, greatest(length(t) - 60, 0), 30)) x(i))
SELECT DISTINCT doc_id FROM (SELECT doc_id, {n} AS t FROM documents), unnest(range(0, greatest(length(t) - 60, 0), {k})) x(i)
WHERE substr(t, CAST(i + 1 AS BIGINT), 60) IN (SELECT w FROM b)
"""


@query(_STRIDE_SQL.format(n=_NORM, k=1))
def shingle_contam_full(t):
    """Documents sharing a 60-character window with the benchmark, at any offset."""
    return _strided(t, True)


@query(_STRIDE_SQL.format(n=_NORM, k=30))
def shingle_contam_strided(t):
    """The same with both sides in steps of 30: the phase-locked variant."""
    return _strided(t, False)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))"
_PAIRS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT doc_id, item_id, len(d.w) AS nl, len(b.w) AS nr, len(list_intersect(d.w, b.w)) AS common FROM d, b WHERE len(d.w) > 0 AND len(b.w) > 0)
"""


def _pairs(t, without=()):
    d = t.documents.select("doc_id", text.word_set(F.col("text"), without).alias("lw"))
    b = t.benchmark.select("item_id", text.word_set(F.col("text"), without).alias("rw"))
    return similarity.overlaps(d, b, "doc_id", "item_id", "lw", "rw")


@query(_PAIRS + "SELECT DISTINCT doc_id FROM p WHERE common > 0.6 * least(nl, nr)")
def word_overlap_contam(t):
    """Documents whose words overlap a benchmark item by more than 0.6 of the smaller set."""
    return _pairs(t).where(F.col("common") > 0.6 * F.least("nl", "nr")).select("doc_id").distinct()


@query(_PAIRS + "SELECT doc_id, item_id, CAST(common AS BIGINT) AS common, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY common / (nl + nr - common) DESC, item_id) AS rank FROM p WHERE common > 0) WHERE rank <= 3")
def jaccard_neighbours_top3(t):
    """The three benchmark items nearest to each document."""
    return similarity.nearest(similarity.jaccard(_pairs(t)), "doc_id", "item_id", "jaccard").select("doc_id", "item_id", "common", "rank")


@query(_PAIRS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE 10 * common > 4 * (nl + nr - common))")
def near_variant_clean_subset(t):
    """Documents with no benchmark item above similarity 0.4."""
    near = _pairs(t).where(10 * F.col("common") > 4 * (F.col("nl") + F.col("nr") - F.col("common"))).select("doc_id").distinct()
    return t.documents.select("doc_id").join(near, "doc_id", "left_anti")


_BOILER = "['" + "','".join(text.BOILERPLATE) + "']"


@query(f"SELECT item_id, len(w) AS n_words, array_to_string(list_sort(w), ' ') AS words FROM (SELECT item_id, list_filter({_WORDS}, lambda x: NOT list_contains({_BOILER}, x)) AS w FROM benchmark)")
def telling_words(t):
    """Word sets without boilerplate."""
    w = t.benchmark.select("item_id", text.word_set(F.col("text"), text.BOILERPLATE).alias("w"))
    return w.select("item_id", F.size("w").cast("long").alias("n_words"), F.array_join(F.array_sort("w"), " ").alias("words"))


_EDGES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_NORM} AS t FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY t) AS b FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY substr(t, 1, 180)) FROM d
  UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY right(t, 60)) FROM d),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, b.b FROM reach r JOIN both_ways b ON b.a = r.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
"""


def _components(t):
    d = t.documents.select("doc_id", text.normalise(F.col("text")).alias("t"))
    keys = F.array(F.concat(F.lit("w"), F.sha2("t", 256)), F.concat(F.lit("p"), F.sha2(F.substring("t", 1, 180), 256)), F.concat(F.lit("s"), F.sha2(F.right("t", F.lit(60)), 256)))
    rows = d.select("doc_id", F.explode(keys).alias("k"))
    least = rows.groupBy("k").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    edges = rows.join(least, "k").where("doc_id <> lo").select(F.col("doc_id").alias("src"), F.col("lo").alias("dst"))
    return connected_components(edges)


@query(_EDGES + "SELECT node AS doc_id, component FROM comp")
def near_dup_components(t):
    """Documents joined by equal text, equal beginning or equal end, with their component."""
    return _components(t).select(F.col("node").alias("doc_id"), "component")


_U = lambda seed, key: f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


@query(_EDGES + f"""
, g AS (SELECT coalesce(component, doc_id) AS grp, doc_id, lang, n_chars FROM documents LEFT JOIN comp ON node = doc_id),
s AS (SELECT grp, count(*) AS size, arg_max(lang, n_chars * 1000000 + doc_id) AS stratum FROM g GROUP BY grp),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY {_U("holdout", "grp")}, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY stratum) AS total FROM s)
SELECT grp, size, stratum FROM q WHERE before < round_even(total * 0.15, 0)
""")
def stratified_group_holdout(t):
    """Whole near-duplicate groups held out, 15 % of each stratum; a group's stratum is its longest member's."""
    comp = _components(t).withColumnRenamed("node", "doc_id")
    g = t.documents.select("doc_id", "lang", "n_chars").join(comp, "doc_id", "left").withColumn("grp", F.coalesce("component", "doc_id"))
    groups = g.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.max_by("lang", F.struct("n_chars", "doc_id")).alias("stratum"))
    return sampling.quota_groups(groups, ["stratum"], "grp", "size", 0.15, "holdout").select("grp", "size", "stratum")


@query(rf"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(o > 0.05 * greatest(z, 1), false) OR len(w) = 0 OR (len(w) > 40 AND top > 0.3 * len(w)) AS degenerate
FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o, length(text) AS z FROM documents)
LEFT JOIN (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS x FROM documents) GROUP BY doc_id, x) GROUP BY doc_id) USING (doc_id)
""")
def degenerate_text(t):
    """Documents that look like collapsed generations."""
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_words"), text.degenerate(F.col("text")).alias("degenerate"))


@query(r"""
SELECT lang, avg(CASE WHEN regexp_matches(lower(text), '(the|de|der|la) ') THEN 1.0 ELSE 0.0 END) AS marker_rate, quantile_cont(length(text), 0.5) AS median_chars,
  avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END) AS nonempty_rate, count(DISTINCT substr(text, 1, 200)) AS distinct_prefixes FROM documents GROUP BY lang
""")
def loop_rate_median_len(t):
    """Rate metrics, median length and distinct prefixes by language."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    c = F.col("text")
    return t.documents.groupBy("lang").agg(
        rate(F.lower(c).rlike("(the|de|der|la) ")).alias("marker_rate"), F.percentile(F.length(c), 0.5).alias("median_chars"),
        rate(c != "").alias("nonempty_rate"), F.count_distinct(F.substring(c, 1, 200)).alias("distinct_prefixes"),
    )


@query("""
WITH s AS (SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source)
SELECT source, bytes, CAST(row_number() OVER (ORDER BY bytes DESC, source) AS INT) AS rank, round(sum(bytes) OVER (ORDER BY bytes DESC, source) / (SELECT sum(bytes) FROM s), 6) AS share_so_far
FROM s ORDER BY bytes DESC, source LIMIT 10
""")
def source_concentration_top10(t):
    """The ten largest sources and the share of all bytes down to each."""
    s = t.documents.groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    total = s.agg(F.sum("bytes").alias("total"))
    top = s.orderBy(F.desc("bytes"), "source").limit(10)
    w = Window.orderBy(F.desc("bytes"), "source")  # ten rows
    return top.crossJoin(F.broadcast(total)).select(
        "source", "bytes", F.row_number().over(w).alias("rank"), F.round(F.sum("bytes").over(w) / F.col("total"), 6).alias("share_so_far")
    )


@query(r"""
SELECT source, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS tokens FROM documents GROUP BY source
""")
def corpus_size(t):
    """Files, bytes and white-space tokens by source."""
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).cast("long").alias("tokens")
    )


_STOP = "['" + "','".join(text.NAME_STOPWORDS) + "']"
_RES = "['" + "','".join(text.RESERVED) + "']"


@query(f"""
WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: NOT list_contains({_STOP}, x))[1:3] AS w FROM benchmark),
n AS (SELECT item_id, substr(trim(regexp_replace(CASE WHEN len(w) = 0 THEN 'compute' ELSE array_to_string(w, '_') END, '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS s FROM w)
SELECT item_id, CASE WHEN s = '' OR regexp_matches(s, '^[0-9]') OR list_contains({_RES}, s) THEN 'f_' || s ELSE s END AS name FROM n
""")
def slug_names(t):
    """Function names from task texts."""
    return t.benchmark.select("item_id", text.name_slug(F.concat(F.lit("x"), F.col("item_id")), F.lit(None).cast("string"), F.col("text")).alias("name"))


@query("""
SELECT v AS value, tag FROM (VALUES ('true', 'boolean'), ('12', 'int'), ('-3', 'int'), ('1.5', 'float'), ('2e3', 'float'), ('"x"', 'string'), ('{"a": 1}', 'dict'), ('null', 'any'),
 ('[]', 'list'), ('[1, 2]', 'int[]'), ('[1, 2.5]', 'float[]'), ('["a", "b"]', 'string[]'), ('[true]', 'boolean[]'), ('[1, "a"]', 'list'), ('[[1], [2]]', 'list')) t(v, tag)
""")
def value_tags(t):
    """Type tags of JSON values."""
    values = ["true", "12", "-3", "1.5", "2e3", '"x"', '{"a": 1}', "null", "[]", "[1, 2]", "[1, 2.5]", '["a", "b"]', "[true]", '[1, "a"]', "[[1], [2]]"]
    return t.spark.createDataFrame([(v,) for v in values], "value string").select("value", text.type_tag(F.col("value")).alias("tag"))


@query(r"""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END AS first_q,
  CASE WHEN turn % 3 = 1 THEN 'and' ELSE 'solve:{' || turn || '}' END AS last_block, CASE WHEN turn % 3 <> 1 THEN 'solve:{' || turn || '}' END AS solve_block FROM conversations
""")
def code_blocks(t):
    """First tagged block, last block, and the block that starts with the expected name."""
    tag = F.when(F.col("turn") % 3 == 0, "q").when(F.col("turn") % 3 == 1, "python").otherwise("")
    solve = F.concat(F.lit("solve:{"), F.col("turn"), F.lit("}"))
    full = F.concat(F.lit("Answer:\n```"), tag, F.lit("\n"), F.col("text"), F.lit("\n```\nand\n```k\n"), solve, F.lit("\n```"))
    c = t.conversations.select("conv_id", "turn", full.alias("t"))
    return c.select("conv_id", "turn", F.sha2(text.fenced_block(F.col("t"), "q"), 256).alias("first_q"), text.last_code_block(F.col("t")).alias("last_block"), text.solve_block(F.col("t")).alias("solve_block"))


@query("""
SELECT sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS ids_sha256, count(*) AS n FROM labels WHERE quality = 1
""")
def id_checksum(t):
    """Checksum of a published id list (a bounded artefact): sorted ids joined by newlines."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), "\n")
    return t.labels.where("quality = 1").agg(F.sha2(ids, 256).alias("ids_sha256"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT lang, count(*) AS n, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unlabelled, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good
FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang
""")
def enrichment_counts(t):
    """Outer enrichment by labels, with the rows that found none."""
    j = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), count(F.col("quality").isNull()).alias("unlabelled"), count(F.col("quality") == 1).alias("good"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_heldout(t):
    """Rows refused because another set holds their id."""
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_allowlist(t):
    """Rows whose id is in a set."""
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL
SELECT 'left', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
""")
def set_difference_report(t):
    """Ids in both sets and in either alone."""
    a, b = t.documents.select("doc_id", F.lit(True).alias("l")).distinct(), t.labels.select("doc_id", F.lit(True).alias("r")).distinct()
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
    found = a.join(b, "doc_id", "full").select(side.alias("side")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    every = t.spark.createDataFrame([("both",), ("left",), ("right",)], "side string")
    return every.join(found, "side", "left").select("side", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 1)")
def name_match_drop(t):
    """Rows whose name, in any case, is in a forbidden list."""
    bad = t.part.where("p_size = 1").select(F.lower("p_name").alias("n")).distinct()
    return t.part.withColumn("n", F.lower("p_name")).join(bad, "n", "left_anti").select("p_partkey", "p_brand")


@query(f"""
SELECT doc_id, list_contains(['each', 'over', 'from', 'by', 'in'], f) AS reserved, CASE WHEN list_contains({_RES}, f) THEN f || 'Arg' ELSE f END AS renamed
FROM (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]+')) AS f FROM documents)
""")
def reserved_arguments(t):
    """Reserved-word filter and rename on argument lists."""
    d = t.documents.select("doc_id", F.array(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))).alias("args"))
    fixed = F.transform("args", lambda a: F.when(a.isin(text.RESERVED), F.concat(a, F.lit("Arg"))).otherwise(a))
    return d.where(F.size("args") <= 3).select("doc_id", F.arrays_overlap("args", text.words_of(["each", "over", "from", "by", "in"])).alias("reserved"), fixed[0].alias("renamed"))


@query()
def rename_identifiers(t):
    """Identifier renaming with a capture guard (look-behind: no SQL counterpart)."""
    code = F.concat(F.lit("f:{[x] x+"), F.col("source"), F.lit("+`x+ax+x1}"))
    return t.documents.select("doc_id", text.rename_identifier(code, F.lit("x"), F.lit("y")).alias("code"), text.rename_identifier(code, F.lit("x"), F.lit("ax")).alias("captured"))


@query()
def wrapped_texts(t):
    """Benchmark texts wrapped at 88 columns."""
    return t.benchmark.select("item_id", wrap_udf("text").alias("wrapped"))


@query()
def value_literals(t):
    """Literals of JSON values in the target language."""
    return t.events.select("event_id", literal_udf("props").alias("literal"))


@query()
def python_signatures(t):
    """Name and arguments of Python source, parsed only."""
    source = F.concat(F.lit("def f_"), F.col("item_id"), F.lit("(a, b=1):\n    return a\n"))
    return t.benchmark.select("item_id", signature_udf(source).alias("s")).select("item_id", "s.name", "s.args")


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS readable FROM events
""")
def json_rows(t):
    """Tolerant reading of JSON text: malformed rows become null instead of failing."""
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("readable"))


@query(r"""
SELECT source, count(*) AS n, CAST(sum(CAST(regexp_extract(line, 'took ([0-9]+) chars', 1) AS BIGINT)) AS BIGINT) AS chars, CAST(sum(CASE WHEN regexp_matches(line, 'lang=en') THEN 1 ELSE 0 END) AS BIGINT) AS english
FROM (SELECT source, 'doc ' || doc_id || ' took ' || n_chars || ' chars lang=' || lang AS line FROM documents) GROUP BY source
""")
def log_scrape(t):
    """Figures scraped from log lines."""
    line = F.concat(F.lit("doc "), "doc_id", F.lit(" took "), "n_chars", F.lit(" chars lang="), "lang")
    logs = t.documents.select("source", line.alias("line"))
    return logs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.regexp_extract("line", "took ([0-9]+) chars", 1).cast("long")).alias("chars"), F.sum(F.col("line").rlike("lang=en").cast("long")).alias("english")
    )


@query()
def greedy_near_dup_accept(t):
    """Benchmark items accepted one by one in id order, each unless it is like an accepted one."""
    w = t.benchmark.select("item_id", text.word_set(F.col("text")).alias("w"))
    pairs = similarity.overlaps(w.withColumnRenamed("item_id", "a"), w.withColumnRenamed("item_id", "b"), "a", "b", "w", "w").where("a < b")
    near = pairs.where(100 * F.col("common") > 20 * (F.col("nl") + F.col("nr") - F.col("common")))
    return similarity.greedy_accept(w, near, "item_id")
