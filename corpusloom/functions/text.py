"""Text functions as Column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"

# Words too common in task statements to tell tasks apart, and those left out of names.
BOILERPLATE = (
    "write function python find given check whether list array string number numbers elements element return"
).split()
NAME_STOPWORDS = (
    "given list return write function that which with from each into their this your should integer integers string strings number numbers "
    "where when will have value values records record input output returns compute find"
).split()

# Reserved words of the target language.
RESERVED = (
    "abs acos aj aj0 ajf ajf0 all and any asc asin asof atan attr avg avgs bin binr by ceiling cols cor cos count cov cross csv cut delete deltas desc dev "
    "differ distinct div do dsave each ej ema enlist eval except exec exit exp fby fills first fkeys flip floor from get getenv group gtime hclose hcount "
    "hdel hopen hsym iasc idesc if ij ijf in insert inter inv key keys last like lj ljf load log lower lsq ltime ltrim mavg max maxs mcount md5 mdev med "
    "meta min mins mmax mmin mmu mod msum neg next not null or over parse peach pj prd prds prev prior rand rank ratios raze read0 read1 reciprocal reval "
    "reverse rload rotate rsave rtrim save scan scov sdev select set setenv show signum sin sqrt ss ssr string sublist sum sums sv svar system tables tan "
    "til trim type uj ujf ungroup union update upper upsert use value var view views vs wavg where while within wj wj1 wsum ww xasc xbar xcol xcols xdesc "
    "xexp xgroup xkey xlog xprev xrank"
).split()


def words_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalise(t: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def fingerprint(t: Column, digits: int = 64) -> Column:
    """Hex SHA-256, cut to ``digits``."""
    return F.substring(F.sha2(t.cast("binary"), 256), 1, digits)


def fenced_block(t: Column, tag: str) -> Column:
    """The first fenced block with this tag, trimmed; null if there is none."""
    pattern = f"(?s){FENCE}{tag}\\s*\\n(.*?){FENCE}"
    return F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 1), F.lit(" \t\n\r")))


def last_code_block(t: Column, tags: str = "q|k") -> Column:
    """The last block fenced with one of the tags or none, else the whole text; null if that is blank."""
    found = F.regexp_extract_all(t, F.lit(f"(?s){FENCE}(?:{tags})?\\s*\\n(.*?){FENCE}"), F.lit(1))
    return F.nullif(F.trim(F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(t), F.lit(" \t\n\r")), F.lit(""))


def solve_block(t: Column) -> Column:
    """``last_code_block`` if it starts with the expected name, else null."""
    code = last_code_block(t)
    return F.when(code.startswith("solve"), code)


def has_loop(t: Column) -> Column:
    return t.rlike(r"\b(while|do)\[")


def word_set(t: Column, without: list[str] = ()) -> Column:
    """Distinct words of four or more letters a-z in the lower-cased text."""
    out = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(out, words_of(list(without))) if without else out


def overview(t: Column) -> Column:
    """Text between an overview tag and the first parameter tag, comment marks off, lines joined."""
    body = F.split_part(F.regexp_replace(t, r"(?s)^.*?@overview", ""), F.lit("@param"), F.lit(1))
    return F.trim(F.array_join(F.transform(F.split(body, "\n"), lambda x: F.trim(x, F.lit("/ "))), " "))


def cut_at(t: Column, markers: list[str]) -> Column:
    """Text before the first marker that isn't at its very beginning, trimmed."""
    out = t
    for m in markers:
        at = F.instr(out, m)
        out = F.when(at > 1, F.substring(out, F.lit(1), at - 1)).otherwise(out)
    return F.trim(out)


def name_slug(record_id: Column, given: Column, text: Column) -> Column:
    """A function name: from an ``ms__`` id, the given name, or the text's first three telling words."""
    telling = F.slice(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(NAME_STOPWORDS)), 1, 3)
    raw = F.coalesce(F.when(record_id.startswith("ms__"), F.substr(record_id, F.lit(5))), F.nullif(given, F.lit("")), F.nullif(F.array_join(telling, "_"), F.lit("")), F.lit("compute"))
    clean = F.substring(F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), F.lit("_")), 1, 40)
    return F.when((clean == "") | clean.rlike("^[0-9]") | clean.isin(RESERVED), F.concat(F.lit("f_"), clean)).otherwise(clean)


def rename_identifier(code: Column, old: Column, new: Column) -> Column:
    """``code`` with one identifier renamed; null if the new name already occurs (it would be captured)."""
    bounded = lambda x: F.concat(F.lit(r"(?<![\w`.])\Q"), x, F.lit(r"\E(?!\w)"))
    return F.when(~F.regexp_like(code, bounded(new)), F.regexp_replace(code, bounded(old), new))


def type_tag(v: Column) -> Column:
    """The tag of a JSON value: boolean, int, float, string, dict, any, or a list of one kind."""
    def atom(x: Column) -> Column:
        x = F.trim(x)
        return (
            F.when(x.isin("true", "false"), "boolean").when(x.rlike(r"^-?[0-9]+$"), "int").when(x.rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), "float")
            .when(x.startswith('"'), "string").when(x.startswith("{"), "dict").when(x.startswith("["), "list").otherwise("any")
        )

    items = F.from_json(v, "array<string>")
    inner = F.regexp_extract_all(v, F.lit(r'"(?:[^"\\]|\\.)*"|[^\[\],\s]+'), F.lit(0))
    kinds = F.array_sort(F.array_distinct(F.transform(inner, atom)))
    flat = ~F.substring(F.trim(v), 2, 2**30).contains("[") & ~v.contains("{")
    of_list = (
        F.when(F.size(items) == 0, "list").when(~flat, "list")
        .when((F.size(kinds) == 1) & F.element_at(kinds, 1).isin("int", "float", "string", "boolean"), F.concat(F.element_at(kinds, 1), F.lit("[]")))
        .when(F.array_join(kinds, ",") == "float,int", "float[]").otherwise("list")
    )
    return F.when(F.trim(v).startswith("["), of_list).otherwise(atom(v))


def degenerate(t: Column) -> Column:
    """No words; over 5 % non-ASCII characters; or over 40 words with one making up over 30 %.

    The top share is an aggregate over the sorted words: linear after the sort, where counting each word would be
    quadratic in long texts.
    """
    w = F.array_sort(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    run = F.aggregate(
        w,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("top")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when(x == a["last"], a["n"] + 1).otherwise(1).alias("n"),
            F.greatest(a["top"], F.when(x == a["last"], a["n"] + 1).otherwise(1)).alias("top"),
        ),
    )["top"]
    other = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    return (F.size(w) == 0) | (other > 0.05 * F.greatest(F.length(t), F.lit(1))) | ((F.size(w) > 40) & (run > 0.3 * F.size(w)))


def uniform(seed: str, key: Column) -> Column:
    """A reproducible 32-bit draw for a key: independent of partitions, unlike rand()."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
