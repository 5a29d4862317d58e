"""Evaluation and reinforcement-learning reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.values import agree, agree_absolute, agree_or_both_fail, agreement_udf
from corpusloom.operators import evaluation
from corpusloom.operators.sampling import running_offsets
from corpusloom.plans.registry import query
from corpusloom.plans.sampling import _u, samples

_TASKS = "WITH k AS (SELECT user_id AS task, count(*) AS n, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS c FROM events GROUP BY user_id)"


def tasks(t):
    return t.events.groupBy(F.col("user_id").alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("c"))


_PK = ", ".join(f"round(avg(CASE WHEN n - c < {k} THEN 1.0 ELSE 1.0 - (SELECT product((n - c - i) / n_i) FROM (SELECT i, CAST(n - i AS DOUBLE) AS n_i FROM unnest(range({k})) x(i))) END), 6) AS pass_at_{k}" for k in (1, 5, 10, 20))


@query(_TASKS + f"SELECT {_PK}, count(*) AS n_tasks FROM k WHERE n >= 20")
def pass_at_k(t):
    """Unbiased pass@k over tasks with enough samples."""
    k = tasks(t).where("n >= 20")
    return k.agg(*[F.round(F.avg(evaluation.pass_at_k(F.col("n"), F.col("c"), j)), 6).alias(f"pass_at_{j}") for j in (1, 5, 10, 20)], F.count(F.lit(1)).alias("n_tasks"))


def _numbered(rows):
    """Rows with a dense ``idx`` from 0 in task order."""
    return running_offsets(rows.withColumn("one", F.lit(1).cast("long")), "task", "one").withColumnRenamed("start", "idx")


_BOOT = """
, v AS ({v}), b AS (SELECT b, avg(x) AS m FROM (SELECT b, {u} % (SELECT count(*) FROM v) AS idx FROM unnest(range({r})) t(b), unnest(range((SELECT count(*) FROM v))) j(j)) d JOIN v USING (idx) GROUP BY b),
s AS (SELECT list(m ORDER BY m) AS s FROM b)
SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(x) FROM v), 6) AS mean, round(s[{lo}], 6) AS lo, round(s[{hi}], 6) AS hi FROM s
"""


@query(_TASKS + _BOOT.format(v="SELECT row_number() OVER (ORDER BY task) - 1 AS idx, c / n AS x FROM k", u=_u("boot", "b || ':' || j"), r=10000, lo=251, hi=9751))
def bootstrap_ci(t):
    """Mean pass rate with a bootstrap interval over tasks."""
    v = _numbered(tasks(t).select("task", (F.col("c") / F.col("n")).alias("x")))
    return evaluation.bootstrap(v, "x", 10_000, "boot").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


_PAIRED = "WITH a AS (SELECT user_id AS task, avg(CAST(value > 50 AS DOUBLE)) AS x FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), z AS (SELECT user_id AS task, avg(CAST(value > 50 AS DOUBLE)) AS y FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1), k AS (SELECT * FROM a JOIN z USING (task))"


def paired(t):
    left = F.col("event_type").isin("click", "view")
    rate = lambda c: F.avg((F.col("value") > 50).cast("double")).alias(c)
    return t.events.where(left).groupBy(F.col("user_id").alias("task")).agg(rate("x")).join(t.events.where(~left).groupBy(F.col("user_id").alias("task")).agg(rate("y")), "task")


@query(_PAIRED + _BOOT.format(v="SELECT row_number() OVER (ORDER BY task) - 1 AS idx, x - y AS x FROM k", u=_u("pair", "b || ':' || j"), r=10000, lo=251, hi=9751))
def paired_bootstrap(t):
    """Mean difference of two runs over the same draws of tasks."""
    v = _numbered(paired(t).select("task", (F.col("x") - F.col("y")).alias("x")))
    return evaluation.bootstrap(v, "x", 10_000, "pair").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(_PAIRED + "SELECT CAST(sum(CAST(x > y AS INT)) AS BIGINT) AS wins, CAST(sum(CAST(x < y AS INT)) AS BIGINT) AS losses, CAST(sum(CAST(x = y AS INT)) AS BIGINT) AS ties, CAST(sum(CAST(x = 0 AND y = 0 AS INT)) AS BIGINT) AS never FROM k")
def win_loss_tie(t):
    """Tasks won, lost, tied and never solved."""
    count = lambda c: F.count_if(c).cast("long")
    x, y = F.col("x"), F.col("y")
    return paired(t).agg(count(x > y).alias("wins"), count(x < y).alias("losses"), count(x == y).alias("ties"), count((x == 0) & (y == 0)).alias("never"))


_ROLL = "WITH r AS (SELECT CAST(dayofyear(ts) AS INT) AS round, user_id AS id, CASE WHEN event_type = 'error' THEN 0.0 WHEN value > 90 THEN 1.0 ELSE floor(value) / 500.0 END AS reward, event_type = 'signup' AS looped, event_type = 'error' AS failed FROM events)"


def rollouts(t):
    """Graded rewards: 0 for a failure, 1 for a full pass, else a fifth of the share."""
    bad = F.col("event_type") == "error"
    graded = F.when(bad, 0.0).when(F.col("value") > 90, 1.0).otherwise(F.floor("value") / 500.0)
    return t.events.select(F.dayofyear("ts").alias("round"), F.col("user_id").alias("id"), graded.alias("reward"), (F.col("event_type") == "signup").alias("looped"), bad.alias("failed"))


@query(_ROLL + """
, g AS (SELECT round, id, count(*) AS n, sum(reward) AS s, sum(CAST(reward = 1 AS INT)) AS p, count(DISTINCT reward) AS kinds, sum(CAST(looped AS INT)) AS l, sum(CAST(failed AS INT)) AS f FROM r GROUP BY round, id)
SELECT round, count(*) AS prompts, CAST(sum(n) AS BIGINT) AS rollouts, round_even(sum(s) / sum(n), 4) AS mean_reward, CAST(sum(p) AS BIGINT) AS full_passes, CAST(sum(CAST(kinds > 1 AS INT)) AS BIGINT) AS groups_with_spread, CAST(sum(l) AS BIGINT) AS loops, CAST(sum(f) AS BIGINT) AS errors FROM g GROUP BY round
""")
def round_summary(t):
    """One line a round."""
    g = rollouts(t).groupBy("round", "id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("s"), F.count_if(F.col("reward") == 1).alias("p"), F.count_distinct("reward").alias("kinds"), F.count_if("looped").alias("l"), F.count_if("failed").alias("f")
    )
    return g.groupBy("round").agg(
        F.count(F.lit(1)).alias("prompts"), F.sum("n").alias("rollouts"), F.bround(F.sum("s") / F.sum("n"), 4).alias("mean_reward"), F.sum("p").alias("full_passes"),
        F.count_if(F.col("kinds") > 1).alias("groups_with_spread"), F.sum("l").alias("loops"), F.sum("f").alias("errors"),
    )


@query(_ROLL + ", g AS (SELECT round, id, count(*) AS n, round(sum(reward), 6) AS total, count(DISTINCT reward) AS kinds FROM r GROUP BY round, id) SELECT r.round, r.id, round(r.reward - g.total / g.n, 6) + 0.0 AS advantage, count(*) AS n FROM r JOIN g USING (round, id) WHERE kinds > 1 GROUP BY ALL")
def group_advantage(t):
    """Rewards less their group's mean; groups without spread go."""
    r = rollouts(t)
    g = r.groupBy("round", "id").agg(F.count(F.lit(1)).alias("k"), F.round(F.sum("reward"), 6).alias("total"), F.count_distinct("reward").alias("kinds")).where("kinds > 1")
    a = r.join(g, ["round", "id"]).withColumn("advantage", F.round(F.col("reward") - F.col("total") / F.col("k"), 6) + 0.0)
    return a.groupBy("round", "id", "advantage").agg(F.count(F.lit(1)).alias("n"))


@query(_ROLL + "SELECT id, count(*) AS attempts, CAST(sum(CAST(reward = 1 AS INT)) AS BIGINT) AS passes FROM r GROUP BY id")
def history_merge(t):
    """Attempts and passes merged over all rounds, as old state plus new rows."""
    r = rollouts(t).select("id", "round", F.lit(1).cast("long").alias("attempts"), (F.col("reward") == 1).cast("long").alias("passes"))
    merge = lambda d: d.groupBy("id").agg(F.sum("attempts").alias("attempts"), F.sum("passes").alias("passes"))
    return merge(merge(r.where("round <= 15")).unionByName(r.where("round > 15").drop("round")))


@query(_ROLL + """
, m AS (SELECT round, id, round(avg(reward), 6) AS score FROM r GROUP BY round, id), p AS (SELECT *, lag(score) OVER (PARTITION BY id ORDER BY round) AS prev FROM m),
d AS (SELECT round, avg(CAST(failed AS DOUBLE)) AS degenerate FROM r GROUP BY round)
SELECT round, count(prev) AS repeated, round(sum(score - prev) / count(prev), 6) AS change, CASE WHEN degenerate > 0.25 OR sum(score - prev) / count(prev) < -0.01 THEN 'STOP' ELSE 'ok' END AS verdict FROM p JOIN d USING (round) GROUP BY round, degenerate
""")
def collapse_check(t):
    """Stop where too much output is degenerate or repeated problems got worse than when last seen."""
    r = rollouts(t)
    m = r.groupBy("round", "id").agg(F.round(F.avg("reward"), 6).alias("score"))
    p = m.withColumn("prev", F.lag("score").over(Window.partitionBy("id").orderBy("round")))
    d = r.groupBy("round").agg(F.avg(F.col("failed").cast("double")).alias("degenerate"))
    change = F.sum(F.col("score") - F.col("prev")) / F.nullif(F.count("prev"), F.lit(0))
    out = p.join(d, "round").groupBy("round", "degenerate").agg(F.count("prev").alias("repeated"), change.alias("c"))
    return out.select("round", "repeated", F.round("c", 6).alias("change"), F.when((F.col("degenerate") > 0.25) | (F.col("c") < -0.01), "STOP").otherwise("ok").alias("verdict"))


@query(_ROLL + """
, d AS (SELECT round, avg(CAST(failed AS DOUBLE)) > 0.25 AS stop, sum(reward) AS s FROM r GROUP BY round), w AS (SELECT round, max(CAST(stop AS INT)) OVER (ORDER BY round) AS stopped FROM d)
SELECT round, max(CASE WHEN stopped = 0 THEN round END) OVER (ORDER BY round) AS last_good FROM w
""")
def last_good_round(t):
    """The last round before the first stop (one row a round)."""
    d = rollouts(t).groupBy("round").agg((F.avg(F.col("failed").cast("double")) > 0.25).alias("stop"))
    w = Window.orderBy("round")
    s = d.withColumn("stopped", F.bool_or("stop").over(w))
    return s.select("round", F.last(F.when(~F.col("stopped"), F.col("round")), ignorenulls=True).over(w).alias("last_good"))


_CAND = "WITH c AS (SELECT event_type AS name, avg(CASE WHEN user_id % 2 = 0 THEN CAST(value > 50 AS DOUBLE) END) AS clean, avg(CASE WHEN user_id % 2 = 1 THEN CAST(value > 50 AS DOUBLE) END) AS style, avg(CAST(value > 80 AS DOUBLE)) AS loops FROM events GROUP BY 1)"


def candidates(t):
    p = (F.col("value") > 50).cast("double")
    return t.events.groupBy(F.col("event_type").alias("name")).agg(
        F.avg(F.when(F.col("user_id") % 2 == 0, p)).alias("clean"), F.avg(F.when(F.col("user_id") % 2 == 1, p)).alias("style"), F.avg((F.col("value") > 80).cast("double")).alias("loops")
    )


@query(_CAND + "SELECT name, round((clean + style) / 2, 6) AS combined FROM c ORDER BY (clean + style) / 2 DESC, name DESC LIMIT 3")
def candidate_select(t):
    """The three best candidates by the mean of two scores."""
    c = candidates(t).withColumn("m", (F.col("clean") + F.col("style")) / 2)
    return c.orderBy(F.desc("m"), F.desc("name")).limit(3).select("name", F.round("m", 6).alias("combined"))


@query(_CAND + "SELECT arg_min(name, loops) AS chosen, round(min(loops), 6) AS loops, min(loops) <= (SELECT loops FROM c WHERE name = 'view') - 0.2 AS accepted FROM c WHERE (clean + style) / 2 >= (SELECT (clean + style) / 2 FROM c WHERE name = 'view') - 0.03")
def idiom_select(t):
    """Least loops among candidates that lose at most 0.03 against the base; accepted if 0.2 below it."""
    c = candidates(t).withColumn("m", (F.col("clean") + F.col("style")) / 2)
    base = c.where("name = 'view'").select(F.col("m").alias("bm"), F.col("loops").alias("bl"))
    ok = c.crossJoin(F.broadcast(base)).where(F.col("m") >= F.col("bm") - 0.03)  # one row
    return ok.agg(F.min_by("name", "loops").alias("chosen"), F.round(F.min("loops"), 6).alias("loops"), (F.min("loops") <= F.max("bl") - 0.2).alias("accepted"))


@query(_CAND + "SELECT arg_max(name, clean) AS start_from, CAST(CASE WHEN max(loops) <= 0.1 THEN 0.02 ELSE 0.05 END AS DOUBLE) AS kl, CASE WHEN max(clean) >= 0.4 AND min(style) > 0.1 THEN 'pass' ELSE 'fail' END AS gate FROM c")
def gate_decisions(t):
    """Start checkpoint, penalty rule and a threshold gate."""
    return candidates(t).agg(
        F.max_by("name", "clean").alias("start_from"), F.when(F.max("loops") <= 0.1, F.lit(0.02)).otherwise(F.lit(0.05)).alias("kl"),
        F.when((F.max("clean") >= 0.4) & (F.min("style") > 0.1), "pass").otherwise("fail").alias("gate"),
    )


@query("""
WITH s AS (SELECT count(*) AS n, count(DISTINCT user_id) AS tasks, avg(CAST(props <> '' AS DOUBLE)) AS nonempty, count(DISTINCT substr(props, 1, 200)) AS kinds, avg(CAST(event_type = 'error' AS DOUBLE)) AS errors FROM events)
SELECT n, tasks, nonempty >= 0.95 AS nonempty_ok, kinds, errors <= 0.05 AS errors_ok, CASE WHEN nonempty >= 0.95 AND errors <= 0.05 THEN 'valid' ELSE 'invalid' END AS verdict FROM s
""")
def sample_run_validation(t):
    """Completeness and quality checks of a run, with a verdict."""
    rate = lambda c: F.avg(c.cast("double"))
    s = t.events.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("tasks"), rate(F.col("props") != "").alias("ne"), F.count_distinct(F.substring("props", 1, 200)).alias("kinds"), rate(F.col("event_type") == "error").alias("er"))
    good, few = F.col("ne") >= 0.95, F.col("er") <= 0.05
    return s.select("n", "tasks", good.alias("nonempty_ok"), "kinds", few.alias("errors_ok"), F.when(good & few, "valid").otherwise("invalid").alias("verdict"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds, max(n) / sum(n) > 0.3 AS dominated FROM c GROUP BY user_id HAVING sum(n) >= 5 AND count(*) >= 2")
def dominant_share_filter(t):
    """Problems whose answers are dominated by one value; too few valid inputs or one answer only don't count."""
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("top")).where("total >= 5 and kinds >= 2").select("user_id", F.col("total").alias("n"), "kinds", (F.col("top") / F.col("total") > 0.3).alias("dominated"))


@query("SELECT event_type, count(*) AS requests, CAST(sum(length(props)) AS BIGINT) AS tokens, round(sum(length(props)) * 0.5 * CASE WHEN event_type = 'purchase' THEN 25 ELSE 5 END / 1000000, 6) AS cost FROM events GROUP BY event_type")
def usage_cost(t):
    """Token totals and cost at a batch discount, by a price table."""
    price = F.broadcast(t.spark.createDataFrame([("purchase", 25.0)], "event_type string, price double"))
    u = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.length("props")).cast("long").alias("tokens")).join(price, "event_type", "left")
    return u.select("event_type", "requests", "tokens", F.round(F.col("tokens") * 0.5 * F.coalesce("price", F.lit(5.0)) / 1e6, 6).alias("cost"))


@query("""
SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'crashed' WHEN count(DISTINCT event_type) < 2 THEN 'duplicate' WHEN avg(value) > 60 THEN 'agreed' ELSE 'wrong answer' END AS verdict, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS passed,
 min(CASE WHEN value <= 50 THEN event_id END) AS first_failure FROM events GROUP BY user_id
""")
def audit_verdicts(t):
    """A verdict per record from outcome rows, with the first failing case."""
    v = F.col("value")
    verdict = F.when(F.bool_or(F.col("event_type") == "error"), "crashed").when(F.count_distinct("event_type") < 2, "duplicate").when(F.avg("value") > 60, "agreed").otherwise("wrong answer")
    return t.events.groupBy("user_id").agg(verdict.alias("verdict"), F.count_if(v > 50).alias("passed"), F.min(F.when(v <= 50, F.col("event_id"))).alias("first_failure"))


@query("WITH m AS (SELECT user_id, event_type AS mode, sum(CAST(value <= 50 AS INT)) AS failures, min(CASE WHEN value <= 50 THEN event_id END) AS first_failure FROM events GROUP BY 1, 2) SELECT user_id, mode, CAST(failures AS BIGINT) AS failures, first_failure FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY failures, mode) AS rn FROM m) WHERE rn = 1")
def best_mode_check(t):
    """The mode with fewest failures for each solution."""
    m = t.events.groupBy("user_id", F.col("event_type").alias("mode")).agg(F.count_if(F.col("value") <= 50).alias("failures"), F.min(F.when(F.col("value") <= 50, F.col("event_id"))).alias("first_failure"))
    best = m.groupBy("user_id").agg(F.min(F.struct("failures", "mode", "first_failure")).alias("b"))
    return best.select("user_id", "b.mode", "b.failures", "b.first_failure")


@query("WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, value > 90 AS ok FROM events) SELECT user_id, min(CASE WHEN ok THEN attempt END) AS first_success, count(*) AS attempts FROM s GROUP BY user_id")
def retry_ladder(t):
    """The attempt at which each problem first succeeded."""
    s = samples(t).select(F.col("task").alias("user_id"), (F.col("idx") + 1).alias("attempt"), (F.col("value") > 90).alias("ok"))
    return s.groupBy("user_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_success"), F.count(F.lit(1)).alias("attempts"))


@query("SELECT user_id, CAST(list_min(v) AS DOUBLE) AS lo, greatest(CAST(list_max(v) AS DOUBLE), list_min(v) + 1) AS hi FROM (SELECT user_id, list(floor(value)) AS v FROM events GROUP BY user_id)")
def numeric_domain(t):
    """Value ranges of seen inputs, at least one wide."""
    g = t.events.groupBy("user_id").agg(F.min(F.floor("value")).cast("double").alias("lo"), F.max(F.floor("value")).cast("double").alias("h"))
    return g.select("user_id", "lo", F.greatest("h", F.col("lo") + 1).alias("hi"))


@query("SELECT conv_id, coalesce(bool_or(lower(rtrim(trim(text), '.')) <> 'no'), true) AS dropped FROM conversations GROUP BY conv_id")
def judge_any(t):
    """Any answer but a plain no drops the row."""
    reply = F.lower(F.rtrim(F.trim("text"), F.lit(".")))
    return t.conversations.groupBy("conv_id").agg(F.coalesce(F.bool_or(reply != "no"), F.lit(True)).alias("dropped"))


@query("""
SELECT conv_id, turn, split_part(trained, '<|im_start|>assistant', -1) = split_part(served, '<|im_start|>assistant', -1) AS same FROM (
  SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text AS trained,
    '<|im_start|>assistant' || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS served FROM conversations)
""")
def prompt_parity(t):
    """A training prompt and a served prompt, rendered apart, agree if what follows their last assistant mark agrees."""
    mark = F.lit("<|im_start|>assistant")
    trained = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"), mark, F.lit("\n"), "text")
    served = F.concat(mark, F.lit("\n"), text.normalise(F.col("text")))
    last = lambda c: F.substring_index(c, "<|im_start|>assistant", -1)
    return t.conversations.select("conv_id", "turn", (last(trained) == last(served)).alias("same"))


@query("SELECT event_type AS model, round(avg(CAST(value > 50 AS DOUBLE)), 6) AS pass_rate, round(count(*) / 30.0, 6) AS per_day, avg(CAST(value > 50 AS DOUBLE)) >= 0.15 AND count(*) / 30.0 >= 9 AS qualifies FROM events GROUP BY 1")
def screening(t):
    """Candidates that are right and fast enough."""
    p, n = F.avg((F.col("value") > 50).cast("double")), F.count(F.lit(1)) / 30.0
    return t.events.groupBy(F.col("event_type").alias("model")).agg(F.round(p, 6).alias("pass_rate"), F.round(n, 6).alias("per_day"), ((p >= 0.15) & (n >= 9)).alias("qualifies"))


@query()
def value_agreement(t):
    """Recursive agreement of JSON values under the three rules."""
    e = t.events.select("event_id", "props", F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(".0000001}")).alias("got"))
    return e.select("event_id", agreement_udf(agree)("props", "got").alias("agrees"), agreement_udf(agree_absolute)("props", "got").alias("older"), agreement_udf(agree_or_both_fail)("props", "got").alias("differential"))


@query("""
SELECT d.doc_id, CASE WHEN l.quality = 1 AND contains(d.text, 'the ') THEN 'vec:' || substr(d.text, 1, 40) ELSE substr(d.text, 1, 40) END AS solution,
  CASE WHEN l.quality = 1 AND contains(d.text, 'the ') THEN substr(d.text, 1, 40) END AS solution_imperative FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def record_rewrite(t):
    """A rewrite is swapped in where there is one and the text loops; the original is kept beside it."""
    old = F.substring("text", 1, 40)
    swap = (F.col("quality") == 1) & F.col("text").contains("the ")
    j = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(swap, F.concat(F.lit("vec:"), old)).otherwise(old).alias("solution"), F.when(swap, old).alias("solution_imperative"))


@query("""
WITH o AS (SELECT event_type, CASE WHEN value < 5 THEN '''type' ELSE 'trace' || chr(10) || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS out, CAST(CAST(floor(value) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS want FROM events)
SELECT event_type, CASE WHEN starts_with(out, '''') THEN 'error' WHEN split_part(out, chr(10), -1) = want THEN 'pass' ELSE 'wrong answer' END AS outcome, count(*) AS n FROM o GROUP BY ALL
""")
def own_test_check(t):
    """The last line of a run's output against the expected one; a leading quote is an error."""
    whole = F.floor("value").cast("long")
    o = t.events.select(
        "event_type", F.when(F.col("value") < 5, "'type").otherwise(F.concat(F.lit("trace\n"), whole.cast("string"))).alias("out"),
        (whole + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).cast("string").alias("want"),
    )
    outcome = F.when(F.col("out").startswith("'"), "error").when(F.substring_index("out", "\n", -1) == F.col("want"), "pass").otherwise("wrong answer")
    return o.groupBy("event_type", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, '// @overview' || chr(10) || '// ' || p_name || chr(10) || '//' || chr(10) || '// @param size {int}  part size' || chr(10) || '// @param price {float}  retail price' || chr(10) || '//' || chr(10) ||
 '// @return {int}   result' || chr(10) || 'f_' || p_partkey || ':{[size;price]' || chr(10) || '    }' AS prompt FROM part
""")
def prompt_render(t):
    """A documented stub: overview, tagged parameters, return, signature."""
    args = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("t"), F.lit(d).alias("d")) for n, k, d in (("size", "int", "part size"), ("price", "float", "retail price"))])
    params = F.transform(args, lambda a: F.concat(F.lit("// @param "), a["n"], F.lit(" {"), a["t"], F.lit("}  "), a["d"]))
    head = F.concat(F.lit("f_"), "p_partkey", F.lit(":{["), F.array_join(F.transform(args, lambda a: a["n"]), ";"), F.lit("]"))
    lines = F.concat(F.array(F.lit("// @overview"), F.concat(F.lit("// "), "p_name"), F.lit("//")), params, F.array(F.lit("//"), F.lit("// @return {int}   result"), head, F.lit("    }")))
    return t.part.select("p_partkey", F.array_join(lines, "\n").alias("prompt"))


@query("""
WITH o AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'q error' WHEN value > 90 THEN 'pass' WHEN value < 10 THEN 'did not load' ELSE 'wrong answer' END AS outcome FROM events)
SELECT user_id, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes FROM (SELECT user_id, outcome, count(*) AS n FROM o GROUP BY ALL) GROUP BY user_id
""")
def failure_taxonomy(t):
    """Outcome counts of each problem."""
    kind = F.when(F.col("event_type") == "error", "q error").when(F.col("value") > 90, "pass").when(F.col("value") < 10, "did not load").otherwise("wrong answer")
    c = t.events.groupBy("user_id", kind.alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "n"))), lambda x: F.concat(x["o"], F.lit("="), x["n"])), ",").alias("outcomes"))
