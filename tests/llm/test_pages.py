"""Operators over pages: HTML text, WARC bundles, URL rules."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import html_text, url_rules, warc

from .conftest import PAGES

LONG = "Long enough a sentence to be an article paragraph, with commas and all that. " * 4


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>{body}<footer>&copy; foot</footer></body></html>'


CASES = [
    (page(f'<div class="ad">Buy now.</div><article><h1>Head&amp;line</h1><p>One <b>bold\n  text</b><p>{LONG}<br>next</article>'), f"Head&line\nOne bold text\n{LONG}next"),
    (page(f"<article><p>{LONG}</p><aside class='sidebar'>Side.</aside><p>x</p><section class=comments><p>A reader says: {LONG}</p></section></article>"), f"{LONG.strip()}\nx"),
    (page(f'<main><div id="cookie-notice"><p>We use cookies.</p></div><p>{LONG}</p><form><label>Mail</label></form></main>'), LONG.strip()),
    (f"<html><body><article><h1>Cut</h1><p>{LONG}<a hre", f"Cut\n{LONG.strip()}"),
    (page(f"<aside><article><p>Related: {LONG}</p></article></aside><article><p>{LONG}</p></article><div class='newsletter'><p>Join us. {LONG}</p></div>"), LONG.strip()),
    (page(f'<div class="has-sidebar"><article><p>See.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article></div>'), "See.\none\ntwo\na\nb"),
    ("", ""),
    (None, ""),
    ("no tags at all", "no tags at all"),
    (f"<p>{LONG}</p>", LONG.strip()),
    (f"<h1>T</h1><p>{LONG}</p>", f"T\n{LONG.strip()}"),
    (f"<html>{LONG}", LONG.strip()),
    (f"<div>{LONG}</div>", LONG.strip()),
    (f"<body>{LONG}</body>", LONG.strip()),
    ("<html><head><title>T</title></head><body><p>One.</p><ul><li>two<li>three</ul></body></html>", "One.\ntwo\nthree"),
    (f"<html><body><nav><a href=a>Home</a> <a href=b>Shop</a></nav><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><footer>Imprint</footer></body></html>", f"Head\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<html><body><div class=menu><a href=a>Home</a></div>{LONG}<div class=ad><p>Buy now. {LONG}</p></div></body></html>", LONG.strip()),
]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(model, html, text):
    assert model.extract(html) == text


def test_pages_without_article(model):
    html = page(f'<div class="content"><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>Side.</p></div>')
    assert model.extract(html) == f"{LONG.strip()}\n{LONG.strip()}"


#: Blocks of hand-labelled pages: + is content. Their class names are misleading, compound, or on no list.
PROSE = "Prose of a paragraph, with commas, that goes on for a while. It has several sentences. They end with stops."
LABELLED = [
    "<div class='post-body side-by-side'>+p +p</div>",
    "<article><h1>+</h1><div data-id='share-42' data-role=menu>+p</div></article>",
    "<article class='post format-aside category-legal'>+p +p</article>",
    "<div id=content class=share-enabled>+p +p</div>",
    "<article>+p +p</article><div class=comments>-p -p -p -p -p -p -p -p</div>",
    "<article>+p +p<section id=comments>-p -p -p -p -p -p</section></article>",
    "<article>+p</article><ol class=comment-list><li class=comment id=comment-3><article>-p</article></li><li class=comment id=comment-4><article>-p</article></li></ol>",
    "<div class=wrap><div><a href=x>-Home</a> <a href=y>News</a></div><div class=txt>+p <p>+Short.</p> +p</div><div class=cookie-banner>-We use cookies.</div></div>",
    "<main>+p<div class=related-posts><h3>-Related</h3><ul><li><a href=a>-One</a></li><li><a href=b>-Two</a></li></ul></div></main>",
    "<main>+p<div class=ad-slot><p>-Buy this now, it is cheap.</p></div>+p</main>",
    "<main>+p</main><div id=left-sidebar>-p -p</div>",
    "<header class=site-header><h1>-Site</h1></header><article><ul><li><a href=a>+Only links here</a></li></ul>+p</article>",
]


def labelled_blocks(page):
    """(html, content blocks, other blocks) of a labelled page; every block gets its own number."""
    import itertools
    import re

    number = itertools.count(1)
    keep, drop = [], []

    def block(m):
        text = f"{m[2].strip() or 'Head'} {next(number)}" if m[2] != "p" else f"{PROSE} {next(number)}"
        (keep if m[1] == "+" else drop).append(text)
        return f"<p>{text}</p>" if m[2] == "p" else text

    return "<html><body>" + re.sub(r"(?<=[>\s])([+-])(p(?![a-z])|[A-Z][^<]*|)", block, page) + "</body></html>", keep, drop


def test_precision_and_recall_on_labelled_pages(model):
    right = found = wanted = 0
    for page in LABELLED:
        html, keep, drop = labelled_blocks(page)
        got = model.extract(html).split("\n")
        right += len(set(got) & set(keep))
        found += len([x for x in got if x])
        wanted += len(keep)
        assert keep and not set(keep) & set(drop)
    assert right / found >= 0.95 and right / wanted >= 0.95, (right, found, wanted)


def test_training_changes_the_model(spark):
    """A name that no list has is learned from pages that label themselves, and is then dropped elsewhere."""
    lesson = f"<html><body><main><p>{LONG}</p><aside class=qzx><p>{LONG}</p></aside><p>{LONG}</p></main></body></html>"
    exam = f"<html><body><main><p>{LONG}</p><div class=qzx><p>Promise. {LONG}</p></div></main></body></html>"
    trained = html_text.train(spark.createDataFrame([(i, "u", lesson, "h", "d", 1) for i in range(60)], PAGES))
    untrained = html_text.TreeModel({})
    assert "Promise" in untrained.extract(exam) and "Promise" not in trained.extract(exam)
    assert trained.extract(exam) == LONG.strip()


def test_very_long_and_deep_pages(model):
    assert len(model.extract("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").split("\n")) == 5000
    assert model.extract("<article>" + "<div>" * 12 + f"<p>{LONG}</p>") == LONG.strip()


def test_marginals_equal_enumeration(model):
    import itertools
    import math

    nodes, _ = html_text.parse_page("<article><p>abc</p><div class=ad><p>buy</p></div></article>")
    weights = {}
    for states in itertools.product(html_text.STATES, repeat=len(nodes) - 1):
        s = (html_text.FRAME, *states)  # the page has an article
        w = 0.0
        for i, n in enumerate(nodes[1:], 1):
            w += model.edge_of(s[n.parent], n)[s[i]] + model.own(n)[s[i]]
        weights[s] = math.exp(w)
    total = sum(weights.values())
    want = [sum(w for s, w in weights.items() if s[i] == html_text.CONTENT) / total for i in range(len(nodes))]
    assert model.marginals(nodes) == pytest.approx(want, abs=1e-9)


def test_text_equals_article_of_all_pages(spark):
    """Every page of the given tables has one article without parts to drop: a plain cut is the truth."""
    import html as h
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["main_text"] == "\n".join(b for b in blocks if b)


def test_html_edges(spark):
    rows = [(1, "u", CASES[0][0], "h", "d", 1), (1, "u", CASES[0][0], "h", "d", 1), (None, None, None, None, None, None)]
    out = html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == 3 and {r["main_text"] for r in out} == {CASES[0][1], ""}
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def warc_truth(rows):
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    best = {}
    for r in rows:
        if len((r[2] or "").encode()) >= 1000 and r[0] is not None:
            best[digest(r[2])] = max(best.get(digest(r[2]), r[0]), r[0])
    out = []
    for r in rows:
        b = best.get(digest(r[2]))
        again = b is not None and b != r[0]
        out.append((r[0], len((r[2] or "").encode()), digest(r[2]), "revisit" if again else "response", b if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    big = "é" * 700
    html = [big, big, "small", "small", None, "", big + "x", big, "y" * 999, "y" * 999, "z" * 1000, "z" * 1000, LONG * 500]
    rows = [(i, f"http://h/{i}\r\nX: y", h, "h", "d", 3) for i, h in enumerate(html)] + [(None, None, big, None, None, None), (7, "u", big, "h", "d", 1)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    bundles = warc.write_bundles(pages, frame_bytes=2000, bundle_bytes=3000).cache()
    found = warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == warc_truth(rows)
    for b in bundles.collect():
        archive = bytes(b["archive"])
        assert sum(x[1] for x in warc.read_seek_table(archive)) + 8 + 8 * len(warc.read_seek_table(archive)) + 9 == len(archive)
        for e in b["index"]:
            head, _ = warc.read_record(archive, e["frame"], e["offset"], e["length"])
            assert head["WARC-Record-ID"] == f"<urn:page:{'null' if e['page_id'] is None else e['page_id']}>"
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0
    plain = warc.with_revisits(pages)
    for few in (0, 1):
        assert sorted(map(tuple, warc.with_revisits(pages, broadcast_groups=few).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert "SortMergeJoin" not in plain._jdf.queryExecution().executedPlan().toString()


def test_warc_files_are_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    pages = spark.createDataFrame([(1, "u", "hello", None, None, None)], PAGES)
    bundles = warc.write_bundles(pages)
    warc.export_bundles(bundles, f"file://{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("*.warc.zst")
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read_bytes()), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and b"hello" in plain


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_url_rules_equal_brute_force(spark):
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/148.html?x=/es/", "http://org", "http://org/", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr?/fr/", "http://com/de/9#z", "com/de/", None, "", "http://", "://org/x", "http://a..org/", "http://u:p@x.com:80/de/", "http://x.com/de/://y.org/", "http://q.net/es/", "http://a.b.c.d.e.org/es/en", "HTTP://Ö.ORG/" + "é" * 5000]
    rows = [(i % 15, u, "h", "x", "d", 4) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, PAGES)
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark)).collect()
    want = [(i % 15, *judge(u, url_rules.RULES)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ties = (("x.com", "/a", "allow"), ("x.com", "/a", "block"), ("x.com", "/a", "block"))
    assert url_rules.judge_urls(spark.createDataFrame([(1, "http://x.com/ab", None, None, None, None)], PAGES), url_rules.rule_table(spark, ties)).first()["verdict"] == "block"
    assert {r["verdict"] for r in url_rules.judge_urls(pages, url_rules.rule_table(spark).limit(0)).collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark)).count() == 0


def test_long_urls_expand_into_few_expressions(spark):
    long = "http://" + "a." * 50_000 + "example.org/en/1" + "x" * 50_000
    pages = spark.createDataFrame([(1, long, None, None, None, None)], PAGES)
    r = url_rules.judge_urls(pages, url_rules.rule_table(spark)).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(long, url_rules.RULES)
    e = url_rules.expressions(F.col("host"), F.col("path"), [1, 2], [1, 4, 5])
    frame = spark.createDataFrame([("a.b.c", "/x/"), ("c", "/xyz"), ("", "")], "host string, path string")
    got = [[(x["host"], x["prefix"]) for x in r["e"]] for r in frame.select(e.alias("e")).collect()]
    assert got == [[("c", "/"), ("b.c", "/")], [("c", "/"), ("c", "/xyz")], []]


def test_url_plan_has_no_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = url_rules.judge_urls(pages, url_rules.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan
