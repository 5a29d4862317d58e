import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.values import agree, agree_absolute, agree_or_both_fail, literal
from corpusloom.operators import evaluation, sampling, similarity
from corpusloom.operators.graph import connected_components
from corpusloom.sources import readers, writers
from corpusloom.streaming import logs


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert column(spark, ["a```q\nx\n```", "none", "```\nlast\n```"], lambda c: text.fenced_block(c, "q")) == ["x", None, None]
    assert column(spark, ["plain", "```q\na\n``` ```\nb\n```", " "], text.last_code_block) == ["plain", "b", None]
    assert column(spark, ["while[x;y]", "awhile[x]"], text.has_loop) == [True, False]
    assert column(spark, ["", "é" * 3, "a " * 41, "a b c"], text.degenerate) == [True, True, True, False]
    assert column(spark, ["abc STOP def", "STOP x"], lambda c: text.cut_at(c, ["STOP"])) == ["abc", "STOP x"]
    assert column(spark, ["x @overview\n// One\n// two\n@param p"], text.overview) == ["One two"]
    assert column(spark, ["f x.y x `x xy"], lambda c: text.rename_identifier(c, F.lit("x"), F.lit("q"))) == ["f q.y q `x xy"]


def test_agreement():
    assert agree({"a": 1}, {"a": 1.0000001}) and agree([1], 1) and agree("ab", ["a", "b"]) and agree(None, []) and agree(True, 1)
    assert not agree(1, 2) and not agree({"a": 1}, {"b": 1}) and not agree(1, {"__error__": "x"}) and not agree(2, True)
    assert not agree_absolute(1e9, 1e9 + 1) and agree(1e9, 1e9 + 1)
    assert agree_or_both_fail({"__error__": "a"}, {"__error__": "b"}) and not agree_or_both_fail({"__error__": "a"}, 1)


def test_literals():
    values = [True, 3, 1.0, "a", "ab", [], [1], [1, 2], {"a": 1}, {"a": 1, "b": 2}, {}]
    assert [literal(v) for v in values] == ["1b", "3", "1.0", 'enlist "a"', '"ab"', "()", "enlist 1", "(1;2)", "(enlist`a)!enlist 1", "(`a`b)!(1;2)", "()!()"]
    with pytest.raises(ValueError):
        literal(None)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 120)] + [(500, i) for i in range(501, 510)] + [(None, 3), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shingles_find_a_planted_passage_at_any_offset(spark):
    r = random.Random(1)
    passage = "".join(r.choice("abcdefgh ") for _ in range(200))
    docs = spark.createDataFrame([(1, "x" * 17 + passage), (2, passage), (3, "y" * 300), (4, "short")], "k int, t string")
    tests = spark.createDataFrame([(passage,)], "b string")
    hits = lambda full: sorted(x.k for x in similarity.shingle_hits(docs, tests, "k", F.col("t"), F.col("b"), full=full).collect())
    assert hits(True) == [1, 2] and hits(False) == [2]


def test_greedy(spark):
    nodes, edges = spark.range(6).withColumnRenamed("id", "k"), [(0, 1), (1, 2), (2, 3), (4, 5)]
    got = similarity.greedy_accept(nodes, spark.createDataFrame(edges, "a long, b long"), "k")
    assert sorted(r.k for r in got.collect()) == [0, 2, 4]


def test_packing(spark):
    docs = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [4, 5, 6, 7])], "k long, t array<int>")
    got = {r.block: r.tokens for r in sampling.pack(docs, "k", "t", 4, F.lit(0)).collect()}
    assert got == {0: [1, 2, 3, 0], 1: [0, 4, 5, 6]}


def test_pass_at_k(spark):
    row = spark.range(1).select(evaluation.pass_at_k(F.lit(30), F.lit(7), 5).alias("x"), evaluation.pass_at_k(F.lit(3), F.lit(2), 2).alias("y")).first()
    assert row.x == pytest.approx(0.7638766087) and row.y == 1.0


def test_readers_and_writers(spark, tmp_path):
    p = str(tmp_path)
    assert readers.read_optional(spark, f"{p}/missing", "a int").count() == 0
    writers.append_jsonl(spark.createDataFrame([(1,)], "a int"), f"{p}/log")
    writers.append_jsonl(spark.createDataFrame([(2,)], "a int"), f"{p}/log")
    assert sorted(r.a for r in readers.read_optional(spark, f"{p}/log", "a int").collect()) == [1, 2]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.q").write_bytes(b"ok \xff text")
    (tmp_path / "d/y.k").write_bytes(b"  ")
    (tmp_path / "d/z.txt").write_bytes(b"no")
    assert [r.text for r in readers.read_text_files(spark, f"{p}/d", (".q", ".k")).collect()] == ["ok  text"]
    (tmp_path / "j.json").write_text(json.dumps({"data": ["a", {"b": 1}]}))
    assert [r.item for r in readers.read_tolerant_json(spark, f"{p}/j.json").orderBy("ordinal").collect()] == ["a", '{"b":1}']
    writers.write_blobs(spark.createDataFrame([("a",), ("a",), ("b",)], "c string"), "c", f"{p}/blobs")
    assert spark.read.parquet(f"{p}/blobs").count() == 2
    spark.range(3).write.parquet(f"{p}/t")
    writers.rewrite_with_backup(spark.range(2), f"{p}/t", f"{p}/b")
    assert spark.read.parquet(f"{p}/t").count() == 2 and spark.read.parquet(f"{p}/b").count() == 3


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    events.write.parquet(f"{tmp_path}/in")
    stream = logs.first_seen(logs.stream_log(spark, f"{tmp_path}/in", "id int, t timestamp"), "id", "t", "1 hour")
    logs.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(r.id for r in spark.read.schema("id int").json(f"{tmp_path}/out").collect()) == [1, 2]
