"""A source-file classifier: an ordered cascade with an inspectable reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Structural signals of the wanted language, and of files that only look like it.
SIGNALS = (
    r"(?m)^\s*[.\w]+\s*:\s*\{",
    r"\\d\s+\.[a-zA-Z]",
    r"(?i)\bselect\b[^\n]{0,80}\bfrom\b",
    r"\bupsert\b|\binsert\b",
    r"0N!",
    r"\.z\.[a-z]{1,3}\b",
    r"`[a-zA-Z][\w.]*",
    r"(?m)^\s*//",
    r"\beach\b|\bover\b|\bscan\b",
    r"\{\[[a-zA-Z][\w;]*\]",
)
#: What a text with the signal of that place surely holds, cheap to look for: only such texts are searched by the pattern.
HINTS = (
    lambda t: t.contains("{") & t.contains(":"),
    lambda t: t.contains(r"\d"),
    lambda t: t.rlike("(?i)select"),
    lambda t: t.contains("upsert") | t.contains("insert"),
    lambda t: t.contains("0N!"),
    lambda t: t.contains(".z."),
    lambda t: t.contains("`"),
    lambda t: t.contains("//"),
    lambda t: t.contains("each") | t.contains("over") | t.contains("scan"),
    lambda t: t.contains("{["),
)
BLANKS = " \t\n\r\x0b\x0c"
JSON_START = r'^\s*[\[{]\s*"'
INI_START = r"(?m)^\s*\[[A-Za-z ]+\]\s*$"
MACRO = ("SyntaxVersion=", "BeginHotkey=", "MacroID=")
OTHER_CODE = r"(?m)^\s*(import |from \w+ import |def \w+\(|function \w+\(|const \w+ =)"
HTML = r"(?i)<(html|div|span|script)\b"
NOT_WIDE = r"[^一-鿿぀-ヿ]+"
SAMPLE = 200_000


def n_signals(t: Column) -> Column:
    """How many of the signals occur in the sample."""
    sample = F.substring(t, 1, SAMPLE)
    out = F.lit(0)
    for p, hint in zip(SIGNALS, HINTS, strict=True):
        out = out + (hint(t) & sample.rlike(p)).cast("int")
    return out


def early_reason(t: Column) -> Column:
    """Why not, by the rules before the signals; null if none of them fires. A null text is empty."""
    sample, head, head2 = F.substring(t, 1, SAMPLE), F.substring(t, 1, 4000), F.substring(t, 1, 2000)
    macro = head.contains(MACRO[0]) | head.contains(MACRO[1]) | head.contains(MACRO[2])
    wide = F.length(F.regexp_replace(sample, NOT_WIDE, ""))
    return (
        F.when(F.coalesce(F.trim(t, F.lit(BLANKS)), F.lit("")) == "", "empty")
        .when(F.substring(F.ltrim(t, F.lit(BLANKS)), 1, 1).isin("[", "{") & t.rlike(JSON_START), "json")
        .when(macro | (head2.contains("=") & head2.rlike(INI_START)), "ini/quickmacro")
        .when((F.octet_length(sample) > F.length(sample)) & (wide > F.length(sample) * 0.02), "cjk-heavy")
        .when(head.contains("<") & head.rlike(HTML), "html")
        .when(head.rlike(OTHER_CODE) & ~head.rlike(SIGNALS[0]), "python/js")
    )


def reason(early: Column, size: Column, signals: Column) -> Column:
    """``keep`` or why not; the first rule that fires names the reason. ``size``: characters of the sample."""
    need = F.when(size < 4000, 1).when(size < 20_000, 2).otherwise(3)
    return (
        F.when(early.isNotNull(), early)
        .when(signals < need, "too-few-q-signals")
        .when((size > 50_000) & (signals / F.greatest(size / 1024, F.lit(1)) < 0.02), "signal-sparse")
        .otherwise("keep")
    )


def classified(files: DataFrame, text: str) -> DataFrame:
    """``files`` less ``text``, plus ``n_signals``, ``bytes`` and ``reason``. Each text is judged once, whatever reads the
    columns, and its signals are counted only where no earlier rule decides.
    """
    t, early = F.col(text), F.col("__early")
    judged = once(files, F.octet_length(t).cast("long").alias("bytes"), F.length(F.substring(t, 1, SAMPLE)).alias("__size"), early_reason(t).alias("__early"))
    counted = once(judged, F.when(early.isNull(), n_signals(t)).otherwise(0).alias("n_signals"))
    return counted.select(*[c for c in files.columns if c != text], "n_signals", "bytes", reason(early, F.col("__size"), F.col("n_signals")).alias("reason"))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` plus columns computed once a row: a generator of one row, past which Spark neither copies expressions nor pushes filters on them."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))
