"""Line dedup against a plain recomputation: null and text ids, ties, repeats, empty tables, clashing names."""

import random

import pytest

from corpusloom.llm import linededup, recompression


def plain(rows):
    """Kept texts by the rule: all pairs of lines, components, the first by (id, number) stays."""
    lines = [(i, k, linededup.brute_force_sets(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(lines)):
        for a in range(b):
            x, y = lines[a][2], lines[b][2]
            if 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    gone = {lines[k][:2] for k in range(len(lines)) if find(k) != k}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def texts(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice((3, 7, 9, 40, 120)))) for _ in range(25)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(r.randrange(6)):
            x = list(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 2))):
                x[r.randrange(len(x))] = r.choice("xyzQ")
            lines.append("".join(x) if r.random() < 0.9 else "  ")
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n", "é" * 9, "É" * 9]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_kept_texts(spark, kind):
    name = (lambda k: k) if kind == "long" else (lambda k: f"id{k:03}")
    rows = [(name(k), t) for k, t in enumerate(texts(60, 4))]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs.union(docs.limit(9))).collect()}
    want = plain(rows)
    assert {i: r.kept_text for i, r in got.items()} == want
    assert all(r.n_lines == (0 if r.text is None else r.text.count("\n") + 1) for r in got.values())


def test_null_ids_come_last_and_empty_tables_and_clashes(spark):
    line = "a line that is long enough to count as one of its own"
    docs = spark.createDataFrame([(None, line), (2**63 - 1, line), (5, "other words altogether, and no more")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in linededup.dedup_lines(docs).collect()}
    assert got == {None: "", 2**63 - 1: line, 5: "other words altogether, and no more"}
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs.withColumnRenamed("doc_id", "N_LINES"), "N_LINES")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_substrings_with_null_and_text_ids(spark, kind):
    name = (lambda k: k) if kind == "long" else (lambda k: f"id{k:03}")
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    passage = [words[k] for k in range(30)]
    rows = [(name(k), " ".join([*r.choices(words, k=r.randrange(40)), *passage[: r.randrange(31)], *r.choices(words, k=5)])) for k in range(40)]
    rows += [(None, " ".join(passage)), (name(99), None), (name(98), "")]
    seen, want = {}, {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        w = (t or "").split()
        gone = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in seen for j in range(k, k + 13)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
        seen |= {tuple(w[k : k + 13]): i for k in range(len(w) - 12)}
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    assert {x.doc_id: x.kept_text for x in recompression.dedup_substrings(docs).collect()} == want
    assert recompression.dedup_substrings(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        recompression.dedup_substrings(docs.withColumn("N_Words", docs.doc_id))
