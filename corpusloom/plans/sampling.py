"""Sampling, splits, order-dependent operators, records and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import sampling
from corpusloom.plans.registry import query


def _u(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


@query(f"SELECT doc_id FROM documents ORDER BY {_u('sample', 'doc_id')}, doc_id LIMIT 100")
def fixed_size_sample(t):
    """A sample of 100 rows (the operator's own size)."""
    return sampling.fixed_sample(t.documents.select("doc_id"), "doc_id", 100, "sample")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_u('family', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 1000 // (SELECT count(DISTINCT source) FROM documents)")
def family_cap_sample(t):
    """An equal share of 1,000 for every family."""
    share = t.documents.agg((F.lit(1000) / F.count_distinct("source")).cast("int").alias("n")).first()["n"]
    return sampling.per_group_sample(t.documents.select("doc_id", "source"), "source", "doc_id", share, "family")


@query(f"""
WITH k AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY {_u('split', 'conv_id')}, conv_id) AS rn, count(*) OVER () AS n FROM k)
SELECT conv_id, turn, CASE WHEN rn <= greatest(1, CAST(floor(n * 0.08) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM conversations JOIN r USING (conv_id)
""")
def split_by_problem(t):
    """All views of a problem on one side of the split."""
    keys = sampling.ranked_split(t.conversations.select("conv_id").distinct(), "conv_id", 0.08, "split")
    return t.conversations.select("conv_id", "turn").join(keys, "conv_id")


@query(f"""
SELECT user_id FROM (SELECT user_id, CASE WHEN k = 0 THEN 0.25 WHEN k < n THEN 2.0 ELSE 0.25 END * CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE 1.0 END AS w
 FROM (SELECT user_id, count(*) AS n, sum(CAST(value > 50 AS INT)) AS k FROM events GROUP BY user_id)) ORDER BY -ln(({_u('draw', 'user_id')} + 0.5) / 4294967296.0) / w, user_id LIMIT 40
""")
def learnability_draw(t):
    """A weighted draw without replacement; problems sometimes solved weigh most."""
    h = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("k"))
    w = F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), 2.0).otherwise(0.25) * F.when(F.col("user_id") % 3 == 0, 1.5).otherwise(1.0)
    return sampling.weighted_sample(h, "user_id", w, 40, "draw").select("user_id")


@query(f"""
SELECT doc_id, CASE WHEN u < 0.4 THEN 'hard' WHEN u < 0.85 THEN 'medium' ELSE 'easy' END AS level FROM (SELECT doc_id, {_u('level', 'doc_id')} / 4294967296.0 AS u FROM documents)
""")
def weighted_levels(t):
    """A weighted categorical draw through cumulative weights."""
    u = text.uniform("level", F.col("doc_id")) / sampling.TWO32
    return t.documents.select("doc_id", F.when(u < 0.4, "hard").when(u < 0.85, "medium").otherwise("easy").alias("level"))


_SAMPLES = "WITH s AS (SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value > 50 AS passed, event_id, value, event_type FROM events)"


def samples(t):
    """Scored samples: a task's events in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(F.col("user_id").alias("task"), (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("value") > 50).alias("passed"), "event_id", "value", "event_type")


@query(_SAMPLES + "SELECT task, event_id, row_number() OVER (PARTITION BY task ORDER BY idx) - 1 AS idx FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY idx DESC) AS back FROM s) WHERE back <= 10")
def trim_last_n(t):
    """The last ten samples of each task, renumbered."""
    s = samples(t).withColumn("back", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("idx")))).where("back <= 10")
    return s.select("task", "event_id", (F.row_number().over(Window.partitionBy("task").orderBy("idx")) - 1).cast("long").alias("idx"))


@query(_SAMPLES + "SELECT task, event_id, row_number() OVER (PARTITION BY task ORDER BY src, idx) - 1 AS idx FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS src FROM s)")
def merge_samples(t):
    """Two runs put after each other and renumbered."""
    s = samples(t).withColumn("src", F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1))
    return s.select("task", "event_id", (F.row_number().over(Window.partitionBy("task").orderBy("src", "idx")) - 1).cast("long").alias("idx"))


@query(_SAMPLES + "SELECT task, event_id FROM (SELECT task, event_id, row_number() OVER (PARTITION BY task ORDER BY event_type = 'error', length(CAST(event_id AS VARCHAR)), idx) AS rn FROM s WHERE passed) WHERE rn = 1")
def candidate_preference(t):
    """Among passing candidates the clean one first, then the shortest, then the earliest."""
    s = samples(t).where("passed").withColumn("k", F.struct((F.col("event_type") == "error").alias("e"), F.length(F.col("event_id").cast("string")).alias("l"), "idx"))
    return s.groupBy("task").agg(F.min_by("event_id", "k").alias("event_id"))


@query("SELECT o_orderkey, CASE row_number() OVER (ORDER BY o_orderkey) % 3 WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' ELSE 'hard' END AS rung FROM orders")
def round_robin_ladder(t):
    """Levels in turn, by the global row number (prefix sums over range partitions)."""
    one = t.orders.select("o_orderkey", F.lit(1).cast("long").alias("n"))
    rn = sampling.running_offsets(one, "o_orderkey", "n")
    return rn.select("o_orderkey", F.element_at(text.words_of(["easy", "medium", "hard"]), (F.col("start") % 3 + 1).cast("int")).alias("rung"))


_TOK = r"regexp_extract_all(text, '\S+')"


def _ids(c):
    return F.transform(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("int"))


@query(rf"""
WITH d AS (SELECT doc_id, list_concat([CAST('0x' || substr(md5(x), 1, 6) AS INT) FOR x IN {_TOK}], [-1]) AS t FROM documents),
p AS (SELECT doc_id, t, sum(len(t)) OVER (ORDER BY doc_id) - len(t) AS start FROM d),
c AS (SELECT start + i AS place, t[CAST(i + 1 AS BIGINT)] AS tok FROM p, unnest(range(len(t))) x(i))
SELECT CAST(place // 2048 AS BIGINT) AS block, CAST(sum(tok) AS BIGINT) AS token_sum, sha256(string_agg(CAST(tok AS VARCHAR), ',' ORDER BY place)) AS digest, CASE WHEN place // 2048 < greatest(1, CAST(floor((SELECT count(*) FROM c) // 2048 * 0.02) AS BIGINT)) THEN 'val' ELSE 'train' END AS split
FROM c GROUP BY place // 2048 HAVING count(*) = 2048
""")
def sequence_pack(t):
    """Documents and end marks cut into blocks of 2,048 tokens; the first 2 % of blocks are for validation."""
    docs = t.documents.select("doc_id", _ids(F.col("text")).alias("tokens"))
    total = t.documents.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")) + 1).alias("n")).select(F.greatest(F.lit(1), F.floor(F.floor(F.col("n") / 2048) * 0.02)).alias("v"))
    blocks = sampling.pack(docs, "doc_id", "tokens", 2048, F.lit(-1)).crossJoin(F.broadcast(total))  # one row
    sums = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    digest = F.sha2(F.array_join(F.transform("tokens", lambda x: x.cast("string")), ","), 256)
    return blocks.select("block", sums.alias("token_sum"), digest.alias("digest"), F.when(F.col("block") < F.col("v"), "val").otherwise("train").alias("split"))


@query(r"""
WITH u AS (SELECT a.conv_id, a.turn, len(regexp_extract_all(a.text, '\S+')) AS np, len(regexp_extract_all(b.text, '\S+')) AS nr FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, CAST(256 AS BIGINT) AS block_len, CAST(nr AS BIGINT) AS supervised, CAST(np + nr AS BIGINT) AS real_len FROM u WHERE np + nr <= 256
""")
def prompt_mask_stats(t):
    """Prompt tokens masked with -100, blocks padded to 256, longer samples dropped."""
    a, b = t.conversations.where("role = 'user'"), t.conversations.where("role = 'assistant'")
    j = a.alias("a").join(b.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    e = j.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), _ids(F.col("a.text")).alias("p"), _ids(F.col("b.text")).alias("r")).where(F.size("p") + F.size("r") <= 256)
    mask = F.concat(F.array_repeat(F.lit(-100), F.size("p")), "r", F.array_repeat(F.lit(-100), F.lit(256) - F.size("p") - F.size("r")))
    e = e.withColumn("labels", mask)
    real = F.lit(256) - F.array_position(F.transform(F.reverse("labels"), lambda x: x != -100), True) + 1
    return e.select("conv_id", "turn", F.size("labels").cast("long").alias("block_len"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("supervised"), F.when(F.array_contains(F.transform("labels", lambda x: x != -100), True), real).otherwise(1).cast("long").alias("real_len"))


@query(f"""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {_u('order', 'doc_id')}, doc_id) - 1 AS rn FROM documents),
w AS (SELECT *, rn // 64 AS win, row_number() OVER (PARTITION BY rn // 64 ORDER BY n_chars, doc_id) - 1 AS k FROM r),
b AS (SELECT win, k // 8 AS batch, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS widest FROM w GROUP BY win, k // 8)
SELECT win, batch, n, chars, widest FROM b WHERE n = 8
""")
def length_grouped_batches(t):
    """Windows of 64 of a shuffled order, sorted by length, cut into batches of 8; remainders dropped."""
    keyed = t.documents.select(F.struct(text.uniform("order", F.col("doc_id")).alias("u"), "doc_id").alias("o"), "doc_id", "n_chars", F.lit(1).cast("long").alias("one"))
    rn = sampling.running_offsets(keyed, "o", "one").withColumn("win", F.floor(F.col("start") / 64))
    w = rn.withColumn("k", F.row_number().over(Window.partitionBy("win").orderBy("n_chars", "doc_id")) - 1)
    b = w.groupBy("win", F.floor(F.col("k") / 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("widest"))
    return b.where("n = 8")


@query(r"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS answer, trim(regexp_replace(a.text, '\s+', ' ', 'g')) AS norm FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
q AS (SELECT conv_id, turn, 'answer' AS task, sha256('Task:' || chr(10) || trim(prompt)) AS prompt, sha256(trim(answer)) AS response FROM p UNION ALL
SELECT conv_id, turn, 'ask', sha256('What was asked?' || chr(10) || trim(answer)), sha256(trim(prompt)) FROM p UNION ALL
SELECT p.conv_id, p.turn, 'fix', sha256('Wrong for: ' || trim(p.prompt) || chr(10) || r.bad), sha256(trim(p.answer)) FROM p JOIN
 (SELECT substr(norm, 1, 180) AS k, arg_max(substr(answer, 1, 200), conv_id * 1000 + turn) AS bad FROM p WHERE length(answer) < 600 GROUP BY 1) r ON r.k = substr(p.norm, 1, 180))
SELECT * FROM q
""")
def sft_samples(t):
    """Multi-task samples from question and answer pairs; wrong answers join by the first 180 characters, the last wins."""
    a, b = t.conversations.where("role = 'user'"), t.conversations.where("role = 'assistant'")
    p = a.alias("a").join(b.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn"))).select("a.conv_id", "a.turn", F.col("a.text").alias("prompt"), F.col("b.text").alias("answer"))
    key = F.substring(text.normalise(F.col("prompt")), 1, 180)
    bad = p.where(F.length("answer") < 600).groupBy(key.alias("k")).agg(F.max_by(F.substring("answer", 1, 200), F.col("conv_id") * 1000 + F.col("turn")).alias("bad"))
    h = lambda *c: F.sha2(F.concat(*c), 256)
    x, y = F.trim("prompt"), F.trim("answer")
    views = F.array(
        F.struct(F.lit("answer").alias("task"), h(F.lit("Task:\n"), x).alias("prompt"), h(y).alias("response")),
        F.struct(F.lit("ask").alias("task"), h(F.lit("What was asked?\n"), y).alias("prompt"), h(x).alias("response")),
        F.struct(F.lit("fix").alias("task"), h(F.lit("Wrong for: "), x, F.lit("\n"), F.col("bad")).alias("prompt"), h(y).alias("response")),
    )
    joined = p.withColumn("k", key).join(bad, "k", "left")
    return joined.select("conv_id", "turn", F.explode(views).alias("v")).select("conv_id", "turn", "v.*").where("prompt is not null")


@query("SELECT item_id, CAST(i AS INT) AS sample FROM benchmark, unnest(range(4)) x(i)")
def task_sample_grid(t):
    """Every task with every sample number."""
    return t.benchmark.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample"))


@query("SELECT stage, lo, hi, lo < coalesce(max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS overlaps FROM (VALUES ('verify', 0, 100), ('audit', 100, 160), ('release', 150, 350), ('rollout', 400, 500)) t(stage, lo, hi)")
def seed_ranges(t):
    """Stages whose seed ranges overlap an earlier one (a short table of stages)."""
    s = t.spark.createDataFrame([("verify", 0, 100), ("audit", 100, 160), ("release", 150, 350), ("rollout", 400, 500)], "stage string, lo int, hi int")
    before = F.max("hi").over(Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    return s.select("stage", "lo", "hi", (F.col("lo") < F.coalesce(before, "lo")).alias("overlaps"))
