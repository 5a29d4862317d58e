"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, takes accents off, maps look-alike letters of other scripts and digit substitutions to Latin
letters, and leaves words with single spaces between them. Lexicon entries are whole words or word beginnings;
each has the log-odds of a toxic label as its weight. A match inside an exception phrase doesn't count. A text's
weight, normalised by a slow function of its length, goes through a logistic curve.

The lexicon is learnt from at most ``train_rows`` labelled rows (by hash of the id), as are the curve and the
exception phrases; labels, lang, source and ids are never inputs of a score. Scoring is a map over whole texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import map_batches, prefixed, with_arrow_columns
from corpusloom.llm.idjoin import by_id
from corpusloom.session import persist_table, ship_package

#: Labelled rows that the lexicon is learnt from at most.
TRAIN_ROWS = 40_000
#: Entries a lexicon has at most, the strongest first.
LEXICON_ENTRIES = 4096
#: Least likelihood-ratio statistic and share of toxic documents of an entry.
LEAST_G2, LEAST_SHARE = 17.0, 0.8
#: A word beginning is lengthened while it keeps this share of its toxic documents.
KEEP_SHARE = 0.95
#: Documents of the average kind that an entry's log-odds are drawn towards.
SHRINK = 4.0
STEM = range(3, 15)

# Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_MAP = str.maketrans(LOOKALIKE)
_MARKS = re.compile(r"[̀-ͯ]+")
_GAP = re.compile(r"[\W_]+")
#: Phrases in which a lexicon word is harmless; others are learnt.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "stupid simple")


def fold(text: str) -> str:
    """``" word word "``: folded words with one space on each side; a single space for none."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return f" {_GAP.sub(' ', text.translate(_MAP)).strip()} ".replace("  ", " ")


@dataclass
class Lexicon:
    """Entries such as ``" word "`` or ``" begin"`` with weights, exception phrases, and the curve."""

    entries: dict[str, float]
    exceptions: list[str]
    base: float = -3.0
    slope: float = 1.0


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.auto = lexicon, ahocorasick.Automaton()
        for p, w in lexicon.entries.items():
            self.auto.add_word(p, (len(p), w))
        for p in lexicon.exceptions:
            self.auto.add_word(f" {p.strip()} ", (len(p.strip()) + 2, None))
        self.some = len(self.auto) > 0
        if self.some:
            self.auto.make_automaton()

    def weigh(self, folded: str) -> tuple[float, int, int]:
        """Sum of weights, matches, matches inside exception phrases. Of entries that begin at one place the longest counts."""
        if not self.some:
            return 0.0, 0, 0
        hits: dict[int, tuple[int, float]] = {}
        spans = []
        for end, (n, w) in self.auto.iter(folded):
            start = end - n + 1
            if w is None:
                spans.append((start, end))
            elif start not in hits or n > hits[start][0]:
                hits[start] = (n, w)
        total, count, excused = 0.0, 0, 0
        for start, (n, w) in hits.items():
            if any(a <= start and start + n - 1 <= b for a, b in spans):
                excused += 1
            else:
                total, count = total + w, count + 1
        return total, count, excused

    def normal(self, weight: float, n_words: int) -> float:
        return math.log1p(weight) / (1.0 + 0.1 * math.log1p(n_words / 100))

    def score(self, weight: float, n_words: int) -> float:
        z = self.lexicon.base + self.lexicon.slope * self.normal(weight, n_words)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def features(folded: str) -> set[str]:
    """Whole words and word beginnings of a folded text, as entries."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for n in STEM:
            if n > len(w):
                break
            out.add(f" {w[:n]}")
    return out


def _count_rows(batches):
    """(entry, toxic, clean) counts of documents, summed over a batch."""
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen[y].update(features(fold(t.as_py() or "")))
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())],
            names=["entry", "toxic", "clean"],
        )


def _phrase_rows(entries: list[str]):
    """(phrase, toxic, clean): a lexicon match with the word before or after it."""

    def run(batches):
        matcher = Matcher(Lexicon(dict.fromkeys(entries, 1.0), []))
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                folded, found = fold(t.as_py() or ""), set()
                for end, (n, _) in matcher.auto.iter(folded) if matcher.some else ():
                    start = end - n + 1
                    stop = folded.find(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                    if before >= 0:
                        found.add(folded[before + 1 : stop])
                    if after >= 0:
                        found.add(folded[start + 1 : after])
                seen[y].update(found)
            names = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())],
                names=["entry", "toxic", "clean"],
            )

    return run


def _g2(a: float, b: float, n1: float, n0: float) -> float:
    """Likelihood-ratio statistic of a toxic and b clean documents, out of n1 and n0."""
    p = n1 / (n1 + n0)
    e1, e0 = (a + b) * p, (a + b) * (1 - p)
    return 2 * sum(o * math.log(o / e) for o, e in ((a, e1), (b, e0)) if o > 0 and e > 0)


def training_filter(id_col: str = "doc_id"):
    """Rows that labels may be learnt from; the others are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from labelled rows outside the held-out part. Without labels of both kinds, an empty one.

    A row labelled twice counts as toxic if either label says so. Rows with a null id or label aren't used.
    """
    ship_package(docs.sparkSession)
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & training_filter(id_col))
        .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__loom_y"))
        .orderBy(F.xxhash64(F.col(id_col)), id_col).limit(train_rows)
    )
    chosen = persist_table(chosen, "toxicity-labels")
    rows = persist_table(by_id(docs.select(id_col, text_col), chosen, id_col, "inner").select(F.col(text_col).alias("t"), F.col("__loom_y").cast("int").alias("y"), (F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(5)) == 0).alias("curve")), "toxicity-train")
    # one row in five is kept for the curve, which so sees entries as they do on new texts
    everything, rows = rows, rows.where("not curve").drop("curve")
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, list(EXCEPTIONS))
    totals = F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    counts = map_batches(rows, _count_rows, "entry string, toxic long, clean long").groupBy("entry").agg(*totals)
    a, b = F.col("toxic"), F.col("clean")
    p = n1 / (n1 + n0)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = 2 * (term(a, (a + b) * p) + term(b, (a + b) * (1 - p)))
    strong = counts.where((a >= 3) & (a / n1 > b / n0) & (a >= LEAST_SHARE * (a + b)) & (g2 >= LEAST_G2))
    found = {r.entry: (r.toxic, r.clean) for r in strong.orderBy(g2.desc(), "entry").limit(8 * LEXICON_ENTRIES).collect()}
    entries = _narrow(found)
    best = sorted(entries, key=lambda e: (-_g2(*found[e], n1, n0), e))[:LEXICON_ENTRIES]
    prior = math.log(n1 / n0)
    weights = {}
    for e in sorted(best):
        a, b = found[e]
        weights[e] = math.log((a + SHRINK * p) / (b + SHRINK * (1 - p))) - prior
    b = F.col("clean")
    phrases = map_batches(rows, _phrase_rows(sorted(weights)), "entry string, toxic long, clean long").groupBy("entry").agg(*totals)
    harmless = phrases.where((b >= 5) & (F.col("toxic") <= 0.1 * b)).orderBy(b.desc(), "entry").limit(LEXICON_ENTRIES).collect()
    out = Lexicon(weights, sorted({*EXCEPTIONS, *(r.entry for r in harmless)}))
    return _fit_curve(out, everything.where("curve").drop("curve"))


def _narrow(found: dict[str, tuple[int, int]]) -> set[str]:
    """Of nested word beginnings, the longest that keeps nearly all toxic documents of each."""
    longer: dict[str, list[str]] = {}
    for e in found:
        word = e[1:-1] if e.endswith(" ") else e[1:-1]
        parent = f" {word}"
        if parent in found and parent != e:
            longer.setdefault(parent, []).append(e)
    out = set()

    def walk(e: str) -> None:
        keep = [c for c in longer.get(e, ()) if found[c][0] >= KEEP_SHARE * found[e][0]]
        walk(max(keep, key=lambda c: (found[c][0], len(c), c))) if keep else out.add(e)

    children = {c for cs in longer.values() for c in cs}
    for e in sorted(found.keys() - children):
        walk(e)
    return out


def _fit_curve(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Logistic base and slope by damped Newton steps over the (bounded) training rows."""
    data = np.array([(r.x, r.y) for r in _weigh(rows, lexicon, "t").select("x", "y").collect()], float).reshape(-1, 2)
    if len(set(data[:, 1])) < 2:
        return lexicon
    x, y = data[:, 0], data[:, 1]
    w = np.array([-2.0, 0.5])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (q - y) + 1e-2 * len(x) / 1000 * w
        hess = (design * (q * (1 - q))[:, None]).T @ design + np.eye(2) * (1e-2 * len(x) / 1000 + 1e-6)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.entries, lexicon.exceptions, round(float(w[0]), 6), round(float(max(w[1], 0.05)), 6))


def _weigh(df: DataFrame, lexicon: Lexicon, text_col: str) -> DataFrame:
    def make():
        matcher = Matcher(lexicon)

        def work(batch):
            out = []
            for t in batch.column(batch.schema.get_field_index(text_col)):
                folded = fold(t.as_py() or "")
                out.append(matcher.normal(matcher.weigh(folded)[0], folded.count(" ") - 1))
            return [pa.array(out, pa.float64())]

        return work

    return with_arrow_columns(df, make, [T.StructField("x", T.DoubleType())])


def score_toxicity(df: DataFrame, lexicon: Lexicon, text_col: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``df`` plus ``score`` (0 to 1), ``n_matches`` and ``n_excused`` (long). Null and empty texts score the base rate."""

    def make():
        matcher = Matcher(lexicon)

        def work(batch):
            score, hits, excused = [], [], []
            for t in batch.column(batch.schema.get_field_index(text_col)):
                folded = fold(t.as_py() or "")
                w, n, e = matcher.weigh(folded)
                score.append(matcher.score(w, max(0, folded.count(" ") - 1)))
                hits.append(n)
                excused.append(e)
            return [pa.array(score, pa.float64()), pa.array(hits, pa.int64()), pa.array(excused, pa.int64())]

        return work

    return with_arrow_columns(df, make, prefixed([("score", T.DoubleType()), ("n_matches", T.LongType()), ("n_excused", T.LongType())], prefix), [] if keep_text else [text_col])


THRESHOLD = 0.3


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    p = "__loom_t_"
    return score_toxicity(docs, learn_lexicon(labelled, labels), text_col, p).where(F.col(p + "score") < THRESHOLD).select(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from the labels of rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, lexicon, keep_text=False)
    return out.select("doc_id", (~training_filter()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")
