"""Page templates: classes, order and nesting against plain recomputation, and what the template decides."""

import html as html_lib
import random
import re
from collections import Counter, defaultdict

from corpusloom.llm import htmltext
from corpusloom.llm.htmltext import BODY, FURNITURE, MIN_CLASS, MIN_PAGES, MIN_SHARE, TAG

SF = "/root/testdata/sf0.01"


def names(t):
    return [x & (1 << 64) - 1 for x in t]


def brute_force_template(pages):
    """{frozenset of tokens} of valid classes, by whole occurrence vectors of the different pages."""
    parsed = [htmltext.Parsed(p) for p in sorted(set(pages))]
    counts = [Counter(p.tokens) for p in parsed]
    label = {t: x for p in parsed for t, x in zip(p.tokens, p.labels, strict=True)}
    classes = defaultdict(list)
    for t in label:
        classes[tuple(c[t] for c in counts)].append(t)
    out = []
    for vector, tokens in classes.items():
        on = sum(v > 0 for v in vector)
        if on < MIN_PAGES or on < MIN_SHARE * len(parsed) or len(tokens) < MIN_CLASS or not any(label[t] & TAG for t in tokens):
            continue
        sequences = [[t for t in p.tokens if t in set(tokens)] for p in parsed]
        order = next(s for s in sequences if s)[: len(tokens)]
        if len(set(order)) == len(tokens) and all(s == order * (len(s) // len(order)) for s in sequences):
            out.append(frozenset(tokens))
    return out


def driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    return pages, [x.asDict() for x in pages.collect()]


def test_classes_equal_whole_vectors(spark):
    pages, rows = driver_pages(spark)
    hosts = defaultdict(list)
    for x in rows:
        hosts[re.sub(r"^\w+://([^/?#:]+).*", r"\1", x["url"]).lower()].append(x["html"])
    got = defaultdict(set)
    found = htmltext.deduce_templates(pages.select(htmltext.host_of("url").alias("host"), "html")).collect()
    for x in found:
        for t, cls in zip(names(x.token), x.cls, strict=True):
            got[x.host, cls].add(t)
    want = {(h, c) for h, p in hosts.items() for c in brute_force_template(p)}
    # nesting can only take classes away
    assert {(h, frozenset(t)) for (h, _), t in got.items()} <= want
    assert len(got) >= len([h for h, p in hosts.items() if len(set(p)) >= MIN_PAGES]) > 5
    assert len(got) > 0.8 * len(want)


def test_articles_of_all_pages(spark):
    _, rows = driver_pages(spark)
    got = {x.page_id: x.text for x in htmltext.op9_html_extraction(spark, SF).collect()}
    for x in rows:
        article = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", x["html"])[1]
        article = re.sub(r"(?s)<(script|style|form|aside)\b.*?</\1>|<!--.*?-->", " ", article)
        article = re.sub(r"</?(?:p|h\d|br|li|ul|ol|div|blockquote|table|tr|td)\b[^>]*>", " \\g<0>", article)
        assert got[x["page_id"]] == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", article)).split())


def test_the_template_decides_on_pages_with_an_article(spark):
    pages, rows = driver_pages(spark)
    found = {x.host: x for x in htmltext.deduce_templates(pages.select(htmltext.host_of("url").alias("host"), "html")).collect()}
    changed = 0
    for x in rows:
        host = re.sub(r"^\w+://([^/?#:]+).*", r"\1", x["url"]).lower()
        if host in found:
            true = htmltext._template_of([list(found[host][c]) for c in htmltext._FIELDS])
            other = {t: (*v[:4], v[4] | FURNITURE if v[4] & BODY else v[4]) for t, v in true.items()}
            changed += htmltext.main_text(x["html"], true) != htmltext.main_text(x["html"], other)
    assert changed > 50


def test_repeated_text_inside_the_article_goes_and_copies_stay(spark):
    r = random.Random(3)
    words = lambda n: " ".join("w%d" % r.randrange(9999) for _ in range(n))
    page = lambda body, note="": f"<html><body><nav><ul><li>Home</li></ul></nav><article><h1>{words(4)}</h1><div>Read it aloud</div><p>{body}</p>{note}</article></body></html>"
    bodies = [words(30) for _ in range(8)]
    copy = "<html><body><article><h1>Same</h1><p>One text</p><p>Another text</p></article></body></html>"
    rows = [(i, "http://a.example/%d" % i, page(b, "<div class='comments'>nay</div>" * (i % 2))) for i, b in enumerate(bodies)]
    rows += [(100 + i, "http://b.example/%d" % i, copy) for i in range(12)]
    rows += [(200, "http://a.example/long", page(words(60000))), (0, "http://a.example/0", rows[0][2]), (None, None, None)]
    table = spark.createDataFrame([(*x, "x") for x in rows], "page_id long, url string, html string, Host string")
    got = defaultdict(set)
    for x in htmltext.extract_articles(table).collect():
        got[x.page_id].add(x.text)
    for i, b in enumerate(bodies):
        assert len(got[i]) == 1 and (text := min(got[i])).endswith(b) and "aloud" not in text and "Home" not in text
    assert all(got[100 + i] == {"Same One text Another text"} for i in range(12)) and got[None] == {""}
    assert len(min(got[200]).split()) == 60004


def test_menus_without_a_name_go(spark):
    page = lambda i: f"<html><body><div id=q><a href=/{i}>to the {i} th</a> <a>go</a></div><section><h2>T {i}</h2><p>Some words number {i}</p></section><div id=z>End</div></body></html>"
    pages = spark.createDataFrame([(i, "http://c.example/%d" % i, page(i)) for i in range(9)], "page_id long, url string, html string")
    assert {x.page_id: x.text for x in htmltext.extract_articles(pages).collect()} == {i: f"T {i} Some words number {i}" for i in range(9)}


def test_order_and_nesting():
    def walk(tokens, template):
        parsed = htmltext.Parsed("")
        parsed.tokens, parsed.depths = tokens, [1] * len(tokens)
        slots = htmltext.Slots(parsed, template)
        slots.until(len(tokens))
        return slots.invalid

    template = {t: ("ab".index(c), k, 2, 9 - "ab".index(c), 0) for c in "ab" for k, t in enumerate((c, c.upper()))}
    assert walk(list("abBbBA"), template) == set()
    assert walk(list("abAB"), template) == {1}  # b straddles a, and stands on fewer pages
    assert walk(list("Aa"), template) == {0} and walk(list("aa"), template) == {0}
    assert walk(list("bBxbByaA"), template) == set()
