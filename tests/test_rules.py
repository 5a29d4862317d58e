"""Rules on rows that are easy to get wrong."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from corpusloom.operators import similarity
from corpusloom.plans import QUERIES
from corpusloom.sources.readers import read_listed
from corpusloom.sources.writers import rewrite_with_backup

def test_only_a_plain_no_keeps_a_row(spark, tmp_path):
    rows = [(1, "No."), (1, " no "), (2, "no way that is the same"), (3, "yes"), (4, "NO")]
    spark.createDataFrame(rows, "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.dropped for r in QUERIES["judge_any"](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}

def test_listed_files_match_by_path_end(spark, tmp_path):
    files = spark.createDataFrame([("file:/x/a/x.q",), ("file:/x/b/x.q",), ("file:/x/b/y.q",)], "path string")
    (tmp_path / "keep.txt").write_text("a/x.q  y.q\n")
    assert sorted(r.path for r in read_listed(spark, str(tmp_path / "keep.txt"), files).collect()) == ["file:/x/a/x.q", "file:/x/b/y.q"]

def test_a_second_rewrite_keeps_the_first_backup(spark, tmp_path):
    path, backup = f"{tmp_path}/t", f"{tmp_path}/b"
    spark.range(3).write.parquet(path)
    rewrite_with_backup(spark.range(2), path, backup)
    rewrite_with_backup(spark.range(1), path, backup)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(backup).count() == 3
    assert not (tmp_path / "t.staged").exists()

def test_window_hits_by_broadcast_and_by_join(spark):
    base = "".join(chr(97 + i * i * 7 % 26) for i in range(200)) + "é中😀" * 30
    docs = spark.createDataFrame([(1, "xx" + base[:130] + "yy"), (2, base[30:90]), (3, base[31:200]), (4, ""), (5, None), (6, "😀" + base[150:280] + "z" * 50_000)], "k long, t string")
    tests = spark.createDataFrame([(base,)], "b string")
    for full in (True, False):
        want = set()
        step = 1 if full else 30
        windows = {base[i : i + 60] for i in range(0, len(base) - 60, 30)}
        for r in docs.collect():
            t = r.t or ""
            if any(t[i : i + 60] in windows for i in range(0, len(t) - 60, step)):
                want.add(r.k)
        for most in (1 << 20, 0):
            got = similarity.shingle_hits(docs, tests, "k", F.col("t"), F.col("b"), full=full, most=most)
            assert {r.k for r in got.collect()} == want
