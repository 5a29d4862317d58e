"""Main text of web pages, by templates deduced from the pages of each host.

Tokens of a page are its container tags, each with the path of containers it stands in, its other tags and its whole
text runs. A token's occurrence vector says how often it stands on each page of a host; tokens with equal vectors form
an equivalence class. A class is a candidate if it has ``MIN_CLASS`` tokens, a tag among them (a class of texts alone
is data that repeats), and stands on ``MIN_PAGES`` different pages and ``MIN_SHARE`` of the host's. It is valid if on
every page its tokens come in one order, tuple after tuple, and no tuple straddles one of a commoner class: valid classes
nest, and together are the host's template.

What stands between template tokens are slots. The template labels each: as the containers it lies in, by tag and
class names as hints; and as a menu where most of its text on all pages of the host is link text. A page's main text is
what its article slots hold, or all slots that aren't furniture where it has no article slot; template texts are never
part of it. Containers that some pages open inside a slot (a notice, reader comments) are told by the same hints.
Pages of hosts without a template have their hints alone.

Vectors are never collected: a vector's hash is a sum over pages, so hosts of any size are pre-aggregated. Copies of a
page count as one page. Only template tokens return to the pages.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.arrowmap import map_batches, prefixed, with_arrow_columns
from corpusloom.llm.idjoin import by_id
from corpusloom.llm.textblocks import mix
from corpusloom.session import drop_table, persist_table, ship_package

#: A template token stands on at least so many different pages, and so large a share, of its host; a class has so many tokens.
MIN_PAGES, MIN_SHARE, MIN_CLASS = 4, 1 / 3, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|xmp)\b(?P<ra>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
#: Elements that open a container; others (p, li, inline tags) need no end tag to be right.
_CONTAINER = frozenset("html head body article main section div nav header footer aside form ul ol dl table fieldset figure menu dialog details blockquote select button".split())
_FURNITURE = frozenset("head nav footer aside form menu dialog select button".split())
_DROPPED = frozenset("script style noscript template textarea title svg iframe xmp".split())
#: Words of class, id and role that mark furniture.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist discussion replies reply respond disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager search searchform complementary contentinfo".split()
)
_BODY_MARKS = frozenset("article main content post entry story".split())


def _marks(attrs: str) -> set[str]:
    out = set()
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in values):
            out.add("hidden")
        elif name in ("class", "id", "role"):
            for v in values:
                out.update(p.lower() for p in _PART.findall(v))
    return out


FURNITURE, BODY, TAG = 1, 2, 4


class Run:
    """A text run: its text, the label of its place, its depth, its place among the tokens, whether it is a link's."""

    __slots__ = ("at", "depth", "label", "link", "text")

    def __init__(self, text: str, label: int, depth: int, at: int, link: bool):
        self.text, self.label, self.depth, self.at, self.link = text, label, depth, at, link


class Parsed:
    """Text runs in page order (a run ``" "`` where a block begins or ends), and all tokens with label and depth."""

    def __init__(self, page: str):
        self.runs: list[Run] = []
        self.tokens: list[int] = []
        self.labels: list[int] = []
        self.depths: list[int] = []
        # open containers: name, path hash, label
        self.stack: list[tuple[str, int, int]] = [("", 17, 0)]
        self.link = False
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m["tag"]:
                self._tag(m["tag"].lower(), bool(m["end"]), m["attrs"])
            elif m["raw"]:
                self._token(hash_of(self.stack[-1][1], "<" + m["raw"].lower()), TAG)
        if at < len(page):
            self._text(page[at:])

    def _token(self, name: int, kind: int) -> None:
        self.tokens.append(name)
        self.labels.append(self.stack[-1][2] | kind)
        self.depths.append(len(self.stack))

    def _text(self, raw: str) -> None:
        _, path, label = self.stack[-1]
        self.runs.append(Run(html_lib.unescape(raw), label, len(self.stack), len(self.tokens), self.link))
        if raw.strip():
            self._token(hash_of(path, raw.strip()), 0)

    def _tag(self, tag: str, end: bool, attrs: str) -> None:
        stack = self.stack
        if tag not in _INLINE:
            self.runs.append(Run(" ", stack[-1][2], len(stack), len(self.tokens), False))
        if tag == "a":
            self.link = not end
        if end:
            if tag in _CONTAINER:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        name = hash_of(stack[k][1], "</")
                        del stack[k:]
                        self._token(name, TAG)
                        break
            return
        _, path, label = stack[-1]
        if tag not in _CONTAINER or attrs.rstrip().endswith("/"):
            self._token(hash_of(path, "<" + tag), TAG)
            return
        marks = _marks(attrs)
        body = bool(label & BODY)
        furniture = bool(label & FURNITURE) or tag in _FURNITURE or (tag == "header" and not body) or "hidden" in marks
        if not furniture and tag not in ("html", "body", "main"):
            furniture = bool(marks & _MARKS) and not (tag == "article" and not body and not marks & {"comment", "comments", "reply"})
        body = body or tag in ("article", "main") or (bool(marks & _BODY_MARKS) and tag in ("div", "section") and not furniture)
        own = hash_of(path, tag + " " + " ".join(sorted(marks)))
        stack.append((tag, own, furniture * FURNITURE | body * BODY))
        self._token(own, TAG)


def hash_of(path: int, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(what.encode("utf-8", "surrogatepass"), digest_size=8, key=path.to_bytes(8, "big")).digest(), "big")


#: A template: token -> (class, place in the class, size of the class, pages of the class, label of the slot after it).
Template = dict[int, tuple[int, int, int, int, int]]


class Slots:
    """Walks a page's tokens along a template: the open tuples, the slot at hand, and the classes found invalid."""

    def __init__(self, parsed: Parsed, template: Template):
        self.parsed, self.template, self.next = parsed, template, 0
        self.open: list[list] = []  # class, next place, size, pages, slot
        self.slot: tuple[int, int, int] | None = None  # token before it, label, depth of its container
        self.invalid: set[int] = set()

    def until(self, at: int) -> None:
        """Take the tokens before number ``at``."""
        tokens, template = self.parsed.tokens, self.template
        while self.next < at:
            token = tokens[self.next]
            if token in template:
                self._take(token, self.parsed.depths[self.next])
            self.next += 1

    def _take(self, token: int, depth: int) -> None:
        cls, place, size, pages, label = self.template[token]
        slot = (token, label, depth)
        above = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == cls), None)
        if (above is None) != (place == 0) or (above is not None and self.open[above][1] != place):
            self.invalid.add(cls)
            self.open = [x for x in self.open if x[0] != cls]
            self.slot = slot
            return
        if above is None:
            self.open.append([cls, 1, size, pages, slot])
        else:
            for other in self.open[above + 1 :]:  # tuples that straddle this one: the rarer class isn't nested
                self.invalid.add(min((other[3], other[2], other[0]), (pages, size, cls))[2])
            del self.open[above + 1 :]
            self.open[above][1:] = [place + 1, size, pages, slot]
        if place == size - 1:  # the tuple ends: back in the slot that holds it
            self.open.pop()
            slot = self.open[-1][4] if self.open else slot
        self.slot = slot


def main_text(page: str, template: Template) -> str:
    """What the article slots of a page hold; if it has none with text, what all slots hold that aren't furniture."""
    parsed = Parsed(page)
    slots = Slots(parsed, template)
    chosen: list[tuple[str, bool]] = []
    for r in parsed.runs:
        slots.until(r.at)
        if not r.text.strip():
            chosen.append((r.text, True))
            continue
        if r.at < len(parsed.tokens) and parsed.tokens[r.at] in template:
            continue
        label = r.label
        if slots.slot and r.depth >= slots.slot[2]:  # a slot ends with its container
            label |= slots.slot[1]
        if not label & FURNITURE:
            chosen.append((r.text, bool(label & BODY)))
    if any(body and t.strip() for t, body in chosen):
        chosen = [x for x in chosen if x[1]]
    return " ".join("".join(t for t, _ in chosen).split())


def host_of(url_col: str):
    """The host of a url, lower-cased; empty for a null or malformed one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _vector_rows(batches):
    """(host, token, pages, vector, place, label): per batch, sums over its pages (host, html, copies of the page).

    vector is a sum of hashes of (page, count), pages counts each copy as its share of one page.
    """
    for batch in batches:
        sums: dict[tuple, list] = {}
        with np.errstate(over="ignore"):
            for host, page, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                page = page.as_py() or ""
                parsed = Parsed(page)
                key = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                count = Counter(parsed.tokens)
                names = np.fromiter(count.keys(), np.uint64, len(count))
                vector = mix(np.uint64(key) ^ mix(np.fromiter(count.values(), np.uint64, len(count))))
                first = {t: i for i, t in reversed(list(enumerate(parsed.tokens)))}
                for t, v in zip(names.tolist(), vector.tolist(), strict=True):
                    row = sums.setdefault((host, t), [0.0, 0, 0, 0])
                    row[0] += 1 / copies
                    row[1] = row[1] + v & (1 << 64) - 1
                    row[2] += first[t]
                    row[3] |= parsed.labels[first[t]]
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()), pa.array([sums[k][0] for k in keys], pa.float64()),
                pa.array([_signed(sums[k][1]) for k in keys], pa.int64()), pa.array([sums[k][2] for k in keys], pa.int64()), pa.array([sums[k][3] for k in keys], pa.int32()),
            ],
            names=["host", "token", "pages", "vector", "place", "label"],
        )


_FIELDS = ["token", "cls", "rank", "size", "pages", "label"]


def _template_of(columns: list) -> Template:
    """The template from the lists of ``_FIELDS`` (empty for null)."""
    if columns[0] is None:
        return {}
    return {t & (1 << 64) - 1: tuple(rest) for t, *rest in zip(*columns, strict=True)}


def _templates(batch: pa.RecordBatch, first: int) -> list[Template]:
    """The template of each row, made once for each host of a batch; the host is column ``first``, ``_FIELDS`` follow."""
    made: dict[str, Template] = {}
    for k, host in enumerate(batch.column(first).to_pylist()):
        if host not in made:
            made[host] = _template_of([batch.column(first + 1 + i)[k].as_py() for i in range(len(_FIELDS))])
    return [made[h] for h in batch.column(first).to_pylist()]


def _slot_rows(batches):
    """(host, token, invalid, chars, links): pages on which the token's class is found invalid, and for the slot after it
    letters of text and of link text."""
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for host, page, template in zip(batch.column(1).to_pylist(), batch.column(0), _templates(batch, 1), strict=True):
            if not template:
                continue
            parsed = Parsed(page.as_py() or "")
            slots = Slots(parsed, template)
            for r in parsed.runs:
                slots.until(r.at)
                size = len(r.text.strip())
                if size and slots.slot and r.depth >= slots.slot[2] and parsed.tokens[r.at] not in template:
                    row = sums.setdefault((host, slots.slot[0]), [0, 0, 0])
                    row[1] += size
                    row[2] += size * r.link
            slots.until(len(parsed.tokens))
            if slots.invalid:
                for t, (cls, *_) in template.items():
                    if cls in slots.invalid:
                        sums.setdefault((host, t), [0, 0, 0])[0] += 1
        keys = list(sums)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64())]
        columns += [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "token", "invalid", "chars", "links"])


def _by_host(tokens: DataFrame) -> DataFrame:
    """``(host, *_FIELDS as lists)``."""
    lists = tokens.groupBy("host").agg(F.collect_list(F.struct(*_FIELDS)).alias("t"))
    return lists.select("host", *[F.col("t")[c].alias(c) for c in _FIELDS])


def candidate_classes(pages: DataFrame) -> DataFrame:
    """``(host, *_FIELDS)``: tokens of the candidate classes of each host, from ``pages(host, html)``, in their order by mean place."""
    keyed = pages.withColumn("h", F.xxhash64("html"))
    contents = persist_table(keyed.groupBy("host", "h").agg(F.count(F.lit(1)).alias("copies")), "html-contents")
    repeated = persist_table(contents.where("copies > 1"), "html-copies")
    total = contents.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    rows = by_id(keyed, repeated, ["host", "h"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    rows = map_batches(rows, _vector_rows, "host string, token long, pages double, vector long, place long, label int")
    tokens = rows.groupBy("host", "token").agg(
        F.round(F.sum("pages")).cast("long").alias("pages"), F.expr("try_sum(cast(vector as decimal(38,0)))").alias("vector"), F.sum("place").alias("place"), F.bit_or("label").alias("label")
    )
    tokens = persist_table(tokens.where(F.col("pages") >= MIN_PAGES).join(total, "host").where(F.col("pages") >= F.col("total") * MIN_SHARE), "html-tokens")
    classes = tokens.groupBy("host", "vector").agg(F.count(F.lit(1)).cast("int").alias("size"), F.count_distinct("place").alias("places"), F.bit_or("label").alias("any"))
    classes = classes.where((F.col("size") >= MIN_CLASS) & (F.col("size") == F.col("places")) & (F.col("any").bitwiseAND(TAG) > 0))
    rank = F.row_number().over(Window.partitionBy("host", "vector").orderBy("place")) - 1
    out = tokens.join(classes.drop("any", "places"), ["host", "vector"]).withColumns({"cls": F.xxhash64("vector"), "rank": rank})
    out = persist_table(out.select("host", *_FIELDS), "html-classes")
    drop_table(contents, repeated, tokens)
    return out


def deduce_templates(pages: DataFrame) -> DataFrame:
    """``(host, *_FIELDS as lists)``: the template of each host, from ``pages(host, html)``; see the module's text."""
    classes = candidate_classes(pages)
    lists = persist_table(_by_host(classes), "html-candidates")
    seen = by_id(pages, lists, "host", "inner").select("html", "host", *_FIELDS)
    seen = map_batches(seen, _slot_rows, "host string, token long, invalid long, chars long, links long")
    seen = persist_table(seen.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("invalid", "chars", "links")]), "html-slots")
    menu = (F.col("links") * 2 > F.col("chars")) & (F.col("label").bitwiseAND(BODY) == 0)
    valid = classes.join(seen, ["host", "token"], "left").where("coalesce(invalid, 0) = 0")
    label = F.when(menu, F.col("label").bitwiseOR(FURNITURE)).otherwise(F.col("label")).cast("int")
    out = persist_table(_by_host(valid.withColumn("label", label)), "html-templates")
    drop_table(classes, lists, seen)
    return out


def extract_articles(pages: DataFrame, url_col: str = "url", html_col: str = "html", prefix: str = "", keep_html: bool = False) -> DataFrame:
    """``pages`` plus ``text`` (empty if none) and ``n_chars`` (its code points, long). Names take ``prefix``.

    Null and empty html give an empty text; rows without a host share one host; repeated rows give equal results and
    count once in the template. An empty table gives an empty result, texts of any length are read whole, and a new name that ``pages`` has, in
    whatever case, is an error: give a ``prefix``. A host's template is bounded by what its pages have in common, and
    joins the pages by host: broadcast if all templates are proven small, else by a join that splits hot hosts.
    """
    ship_package(pages.sparkSession)
    with_host = pages.withColumn("__loom_host", host_of(url_col))
    templates = deduce_templates(with_host.select(F.col("__loom_host").alias("host"), F.col(html_col).alias("html")))
    own = ["__loom_host", *(f"__loom_{c}" for c in _FIELDS)]
    joined = by_id(with_host, templates.toDF(*own), "__loom_host", "left").select(*pages.columns, *own)

    def make():
        def work(batch):
            html = batch.column(batch.schema.get_field_index(html_col))
            texts = [main_text(page.as_py() or "", t) for page, t in zip(html, _templates(batch, batch.schema.get_field_index(own[0])), strict=True)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    drop = own + ([] if keep_html else [html_col])
    return with_arrow_columns(joined, make, prefixed([("text", T.StringType()), ("n_chars", T.LongType())], prefix), drop)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_articles(pages).select("page_id", "url", "text", "n_chars")
