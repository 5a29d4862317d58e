"""Queries whose work once grew past its limit: each piece is done once, with the results of the plain way."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import classify
from corpusloom.operators import evaluation
from corpusloom.operators.draws import uniforms
from corpusloom.plans import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_judged_once(spark, tmp_path):
    spark.createDataFrame([(1, "x", "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<html>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("rejected_files", "largest_drops", "doc_classify_reasons"):
        plan = optimized(QUERIES[name](spark, str(tmp_path)))
        for pattern in ("SyntaxVersion=", r"\bupsert\b", "(?i)<(html|"):
            assert plan.count(pattern) == 1, (name, pattern)


def test_hints_lose_no_signal_and_the_cascade_is_as_before(spark):
    draw, parts = random.Random(5), [
        "a.b : {", "  x:{", "\\d  .q", "SeLeCt x fRoM", "select", "upsert", "inserted", "insert", "0N!", ".z.ts", "`sym", "//", "\n//", "each", "reach", "over", "{[x;y]", "中文字", "é", "\n", " ", "\t", "{", "[\"a", "=", "[A b]\n",
        "MacroID=", "<div", "import x", "def f(", "word " * 40, "😀", "\x0b\x0c",
    ]
    texts = [None, "", " \n\t", "\x0b\x0c", "\x0c{ \"", "x" * 60_000, "x" * 200_000 + "0N!", "a" * 999 + "中" * 20 + "a"] + ["".join(draw.choices(parts, k=draw.randint(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = classify.classified(rows, "t").where("reason <> 'none'").collect()
    t, sample, head, head2 = F.col("t"), F.substring("t", 1, 200_000), F.substring("t", 1, 4000), F.substring("t", 1, 2000)
    n, size = sum((sample.rlike(p).cast("int") for p in classify.SIGNALS), F.lit(0)), F.length(sample)
    plain = (
        F.when(F.coalesce(F.trim(t, F.lit(" \t\n\r\x0b\x0c")), F.lit("")) == "", "empty")
        .when(t.rlike(classify.JSON_START), "json")
        .when(head.rlike("SyntaxVersion=|BeginHotkey=|MacroID=") | (head2.rlike(classify.INI_START) & head2.contains("=")), "ini/quickmacro")
        .when(F.length(F.regexp_replace(sample, "[^一-鿿぀-ヿ]", "")) > size * 0.02, "cjk-heavy")
        .when(head.rlike(classify.HTML), "html")
        .when(head.rlike(classify.OTHER_CODE) & ~head.rlike(classify.SIGNALS[0]), "python/js")
        .when(n < F.when(size < 4000, 1).when(size < 20_000, 2).otherwise(3), "too-few-q-signals")
        .when((size > 50_000) & (n / F.greatest(size / 1024, F.lit(1)) < 0.02), "signal-sparse")
        .otherwise("keep")
    )
    want = rows.select("id", n.alias("n"), plain.alias("reason")).collect()
    counted = ("too-few-q-signals", "signal-sparse", "keep")
    assert {r.id: (r.n_signals, r.reason) for r in got} == {r.id: (r.n if r.reason in counted else 0, r.reason) for r in want}
    assert {r.reason for r in got} >= {"empty", "json", "ini/quickmacro", "cjk-heavy", "html", "python/js", "too-few-q-signals", "keep"}


def test_array_draws_are_the_hashes():
    for seed, start, stop in (("boot", 0, 1200), ("é" * 20, 95, 105), ("s" * 38, 0, 120), ("s" * 49, 0, 12), ("s" * 70, 8, 12), ("s" * 120, 0, 1001), ("x", 99_990, 100_010), ("x", 3, 3)):
        resamples, got = [0, 7, 10, 99, 1234], {}
        for some, u in uniforms(seed, resamples, start, stop):
            for b, row in zip(some, u, strict=True):
                got.setdefault(b, []).append(row)
        for b in resamples:
            want = [int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:8], 16) for j in range(start, stop)]
            assert np.concatenate(got.get(b, [np.array([], int)])).tolist() == want, (seed, b)


def test_places_are_laid_out_once_for_all_resamples(monkeypatch):
    made, plain = [], np.arange
    monkeypatch.setattr(np, "arange", lambda *args: made.append(args) or plain(*args))
    assert sum(u.size for _, u in uniforms("pair", [1000], 100_000, 150_000)) == 50_000
    once = len(made)
    assert sum(u.size for _, u in uniforms("pair", list(range(1000, 1040)), 100_000, 150_000)) == 40 * 50_000
    assert 0 < once == len(made) - once


def test_bootstrap_sums_arrays_not_rows(spark, monkeypatch):
    schema = "idx long, x double"
    cases = [[(i, i * i % 7 / 3) for i in range(137)], [(0, 1.5), (1, None), (2, 2.5)], [(0, None)], []]
    for rows in cases:
        values = spark.createDataFrame(rows, schema)
        held, joined = (evaluation.bootstrap(values, "x", 40, "boot", most) for most in (1 << 20, -1))
        got = held.first()
        rounded = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        assert rounded(got) == rounded(joined.first()), rows
        assert "Generate" not in optimized(held) and "Generate" in optimized(joined)
    # one resample's places dealt to several tasks
    values = spark.createDataFrame(cases[0], schema)
    whole = evaluation.bootstrap(values, "x", 40, "boot").first()
    monkeypatch.setattr(evaluation, "PLACES", 50)
    assert rounded(evaluation.bootstrap(values, "x", 40, "boot").first()) == rounded(whole)


def test_paired_resamples_draw_the_same_places(spark, tmp_path):
    rows = [(u, kind, float(v)) for u in range(30) for kind, v in (("click", u * 37 % 100), ("view", u * 11 % 90), ("error", u * 53 % 100), ("signup", 60))] + [(99, "click", 70.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["paired_bootstrap"](spark, str(tmp_path))
    assert "Generate" not in optimized(df)
    rate = lambda u, left: np.mean([v > 50 for w, kind, v in rows if w == u and (kind in ("click", "view")) == left])
    x = np.array([rate(u, True) - rate(u, False) for u in range(30)])
    means = sorted(np.mean([x[int(hashlib.md5(f"pair:{b}:{j}".encode()).hexdigest()[:8], 16) % 30] for j in range(30)]) for b in range(10_000))
    got = df.first()
    assert got["n"] == 30 and np.allclose([got["mean"], got["lo"], got["hi"]], [x.mean(), means[250], means[9750]], atol=2e-6)
