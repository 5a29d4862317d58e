"""Hot families just below the threshold: every planted link must be found."""

import random

import numpy as np

from corpusloom.llm import linededup, minhash


def components(ids, sets, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(sets[i], sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def linked(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_documents_of_a_hot_family(docs_of):
    # 88 of 100 words are common: 0.786; planted pairs share one word more: 0.802
    sets = {i: {f"c{k}" for k in range(88)} | {f"own{i}x{k}" for k in range(12)} for i in range(300)}
    for k in range(40):
        sets[250 - k].discard(f"own{250 - k}x0")
        sets[250 - k].add(f"own{k}x0")
    want = components(list(sets), sets, linked)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs_of([(i, " ".join(sorted(s))) for i, s in sets.items()]), shingle=1).collect()}
    assert len(set(want.values())) == 260 and got == want


def test_lines_of_a_hot_family(docs_of):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # 100 shingles of 129 or so are common; the tails of planted pairs begin alike
    base = word(107)
    lines = {i: base + word(r.choice((14, 15, 16))) for i in range(1000)}
    for k in range(60):
        lines[900 - k] = lines[k][:111] + word(10)
    sets = {i: linededup.brute_force_sets(t) for i, t in lines.items()}
    roots = components(list(lines), sets, linked)
    got = {x.doc_id for x in linededup.dedup_lines(docs_of(list(lines.items()))).collect() if x.n_removed}
    assert 60 <= len(roots) - len(set(roots.values())) and got == {i for i, c in roots.items() if i != c}


def test_candidates_are_exact_for_sets_of_all_sizes(spark):
    r = random.Random(6)
    rows, sets = [], {}
    for i in range(150):
        if i % 3:
            s = set(sets[i - 1])
            for x in r.sample(sorted(s), min(len(s) - 1, r.randrange(0, 1 + len(s) // 4))):
                s.discard(x)
            s |= {r.randrange(1, 2**63) for _ in range(r.randrange(0, 1 + len(s) // 6))}
        else:
            s = {r.randrange(1, 2**63) for _ in range(r.choice((1, 2, 5, 9, 30, 200)))}
        sets[i] = s
        rows.append((i, i, bytearray(np.sort(np.array(sorted(s), np.uint64)).tobytes())))
    stored = spark.createDataFrame(rows, "id long, component long, item binary")
    got = {(x.hi, x.lo) for x in minhash.exact_candidates(stored, 80).collect()}
    want = {(i, j) for i in sets for j in range(i) if linked(sets[i], sets[j])}
    assert len(want) > 30 and want <= got
