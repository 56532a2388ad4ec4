"""Rules on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, html, jsonld, stemming, text, urls
from newsloom.operators import articles
from tests.reference_html import paragraphs_text

c = F.col


def run(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column.alias("x")).collect()]


def test_classify_order(spark):
    m = "https://a.com"
    cases = [
        ("https://a.com", m, "3_1"),
        ("https://b.pdf", "https://b.pdf", "3_1"),
        ("https://a.com/opinion/x/y.pdf", m, "3_2"),
        ("https://a.com/opinion/one", m, "3_3"),
        ("https://a.com/autoridad/a-b-c-d", m, "3_3"),
        ("https://a.com/a-b-c-d-e", m, "3_4"),
        ("mailto:x@a.com", m, "3_4"),
        ("https://a.com/x/a-b-c", m, "3_5"),
        ("https://a.com/x/a.html", m, "3_5"),
        ("https://b.com/x/a-b-c-d", m, "3_6"),
        ("https://a.com/x/a-b-c-d", "https://a.com/", "0"),
        ("https://a.com/x/y/años-y-b", m, "0"),
    ]
    got = run(spark, [k[:2] for k in cases], "u string, m string", urls.classify(c("u"), c("m")))
    assert got == [k[2] for k in cases]


def test_absolutise_and_cut(spark):
    rows = [("//b.com/x",), ("/x?y=1",), ("https://c.com/",), ("http://c.com/",), ("www.d.com",)]
    link = urls.absolutise(urls.cut_query(c("u")), F.lit("https://a.com/"))
    assert run(spark, rows, "u string", link) == [
        "https://b.com/x", "https://a.com/x", "https://c.com/", "http://c.com/", "https://www.d.com"
    ]


def test_url_parts(spark):
    rows = [("https://a.com/x/y.html",), ("https://a.com/x/",), ("https://a.com",), ("plain",)]
    assert run(spark, rows, "u string", urls.last_node(c("u"))) == ["y", "x", "a", None]
    assert run(spark, rows, "u string", urls.topic(c("u"))) == ["x", "x", "", "plain"]
    assert run(spark, rows, "u string", urls.path_depth(c("u"))) == [2, 1, 0, 0]


def test_clean_topics(spark):
    rows = [("A b, C d",), ("A b",), ("¿x?",), ("#Y(z), W%",)]
    assert run(spark, rows, "t string", text.clean_topics(c("t"))) == ["a-b,c-d", "a b", "x", "yz,w"]


def test_entities(spark):
    rows = [("a &amp; b",), ("&eacute;&#233;&#xE9;&#128512;",), ("&amp;lt; &nosuch; & &",), ("none",)]
    assert run(spark, rows, "t string", text.decode_entities(c("t"))) == [
        "a & b", "ééé😀", "&lt; &nosuch; & &", "none"
    ]


def test_entities_equal_the_standard_table(spark):
    from html import unescape

    rows = ["&notit; &notin; &notin &NotEqualTilde; &CounterClockwiseContourIntegral;", "&#146;&#x92;&#150 &#129;|",
            "&#0; &#00000000065; &#99999999999999999999; &#xD800; &#x110000; &#1;&#11;&#13;|&#xFDD0;|", "&ampx &AMP &apos &bogus; &#; &#x;"]
    assert run(spark, [(r,) for r in rows], "t string", text.decode_entities(c("t"))) == [unescape(r) for r in rows]


def test_text_of_a_long_page_is_linear(spark):
    """One page of 32,000 tags; with arrays in the fold this took half a minute."""
    page = "".join(f"<p>a{i} <b>b</b> c</p>\n" for i in range(8000))
    (got,) = run(spark, [(page,)], "h string", html.element_text(html.visible_markup(c("h"))))
    assert got == "".join(f"a{i} b c" for i in range(8000))


@pytest.mark.parametrize("word,stem", [
    ("cheques", "chequ"), ("chequeo", "cheque"), ("chía", "chi"), ("chicas", "chic"),
    ("torá", "tor"), ("tórax", "torax"), ("toreándolo", "tor"), ("toreó", "tore"),
    ("torneos", "torne"), ("torniquete", "torniquet"), ("deporte", "deport"),
    ("deportes", "deport"), ("economia", "economi"), ("economias", "economi"),
    ("noticia", "notici"), ("noticias", "notici"), ("rápidamente", "rapid"),
    ("actividades", "activ"), ("investigación", "investig"), ("psicología", "psicolog"),
    ("construyendo", "constru"), ("siguen", "sig"), ("y", "y"), ("", ""),
    # From the sample vocabulary published with the rules.
    ("cheraw", "cheraw"), ("chesca", "chesc"), ("chester", "chest"), ("chetumal", "chetumal"),
    ("chetumaleños", "chetumaleñ"), ("chevrolet", "chevrolet"), ("cheyene", "cheyen"),
    ("cheyenne", "cheyenn"), ("chi", "chi"), ("chiapaneca", "chiapanec"), ("chiapas", "chiap"),
    ("chiba", "chib"), ("chic", "chic"), ("chica", "chic"), ("chicago", "chicag"), ("chicana", "chican"),
    ("chicano", "chican"), ("chicharrones", "chicharron"), ("chichen", "chich"),
    ("chichimecas", "chichimec"), ("chicles", "chicl"), ("chico", "chic"), ("torácica", "torac"),
    ("torácico", "torac"), ("torbellino", "torbellin"), ("torcedores", "torcedor"), ("torcer", "torc"),
    ("torcida", "torc"), ("torcidos", "torc"), ("tordesillas", "tordesill"), ("toreo", "tore"),
    ("torera", "torer"), ("torero", "torer"), ("toreros", "torer"), ("tormenta", "torment"),
    ("tormentas", "torment"), ("tornado", "torn"), ("tornados", "torn"), ("tornar", "torn"),
    ("torneo", "torne"), ("tornillo", "tornill"), ("torno", "torn"),
])
def test_stem(spark, word, stem):
    assert run(spark, [(word,)], "w string", stemming.stem(c("w"))) == [stem]


def test_parse_instant(spark):
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    cases = {
        "2023-10-02T12:25:00+02:00": utc(2023, 10, 2, 10, 25),
        "2023-10-02T12:25:00Z": utc(2023, 10, 2, 12, 25),
        "2023-10-02T12:25:00+0200": utc(2023, 10, 2, 10, 25),
        "2023-10-02T12:25:00.250-05:00": utc(2023, 10, 2, 17, 25) + 250000,
        "20231002T122500+00:00": utc(2023, 10, 2, 12, 25),
        "2023-10-02 12:25+01": utc(2023, 10, 2, 11, 25),
        "2023-10-02T12:25:00": None, "2023-10-02": None, "12:25": None, "": None, "x": None,
        "2023-13-02T12:25:00Z": None,
    }
    got = run(spark, [(k,) for k in cases], "t string", F.unix_micros(dates.parse_instant(c("t"))))
    assert got == list(cases.values())


PAGES = [
    "<html><body><p>a</p>b<p>c\n\n\nd</p></body></html>",
    "<body><article><p>one<b>two<p>three</p>four</article>five</body>",
    "<div><p>x</div>y<p>z",
    "<p>1 < 2 &amp; 3</p><P CLASS='a>b'>up</P><p/>q",
    "<ul><li><p>a<li><p>b</ul>c</p>d",
    "<p>t<!-- <p>no</p> -->u<script>var a='</p>';</script>v</p>w",
    "no tags at all", "", "<p>\n</p>\n<p>\n</p>",
]


def test_element_text_equals_tree(spark):
    """The fold over tags gives what a tree of the page gives."""
    got = run(spark, [(p,) for p in PAGES], "h string", html.element_text(html.visible_markup(c("h"))))
    assert got == [paragraphs_text(p) for p in PAGES]


def test_element_text_of_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        "html", html.element_text(html.visible_markup(c("html"))).alias("t")).collect()
    assert rows and all(r["t"] == paragraphs_text(r["html"]) for r in rows)


def test_tag_grammar(spark):
    page = """<html LANG=es><head><meta name=k content='a>b'><meta name="k2" name="k3" content></head>
      <body><a href="/x?a=1&amp;b=2">t</a><a href=''>n</a><a name=z>m</a><A HREF=/y>u</A></body></html>"""
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(
        html.body_hrefs(c("h")).alias("links"),
        html.page_lang(html.visible_markup(c("h"))).alias("lang"),
        html.page_tags(c("h")).alias("tags"),
    ).first()
    assert r["links"] == ["/x?a=1&b=2", "/y"] and r["lang"] == "es"
    metas = [t["attrs"] for t in r["tags"] if t["tag"] == "meta"]
    assert metas == [{"name": "k", "content": "a>b"}, {"name": "k3", "content": ""}]


def leaves(spark, *blocks):
    df = spark.createDataFrame([(list(blocks),)], "b array<string>")
    rows = df.select(jsonld.block_objects(c("b")).alias("o")).select(
        F.explode(jsonld.json_leaves("o")).alias("x")).select("x.*").collect()
    return [(r["path"], r["value"]) for r in rows]


def test_json_leaves(spark):
    assert leaves(spark, '{"a":{"b":{"c":1,"d":"x"}},"l":[{"q":1}],"n":null,"t":true}') == [
        ("a.b.c", "1"), ("a.b.d", "x"), ("a.b", "c,d"), ("a", "b"), ("l", '[{"q":1}]'),
        ("n", None), ("t", "true"),
    ]
    assert leaves(spark, '{"a":1,"b":2,"a":3}') == [("a", "3"), ("b", "2")]
    assert leaves(spark, '{"a":"x\ny"}', "{broken", '[{"z":1},2,{"y":{}}]') == [
        ("a", "x y"), ("z", "1"), ("y", "")]
    deep = "{\"k\":" * 9 + "1" + "}" * 9
    for n in (13, 120):
        deeper = "{\"k\":" * n + "{\"articleBody\":\"x\"}" + "}" * n
        assert leaves(spark, deeper)[0] == (".".join("k" * n) + ".articleBody", "x")
    assert [p for p, _ in leaves(spark, deep)][0] == ".".join("k" * 9)


def fields(spark, *blocks, only_body=True):
    page = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    df = spark.createDataFrame([(page,)], "h string")
    return jsonld.with_article_fields(df, c("h"), "f", only_body).first()["f"]


def test_article_fields(spark):
    assert fields(spark, '{"@type":"WebPage","articleBody":"x"}') is None
    assert fields(spark, '{"articleBody":"<b>x</b>","@type":"NewsArticle"}')["body"] == "x"
    assert fields(spark, '{"@type":"NewsMediaOrganization","articleBody":"x"}',
                  '{"@type":"NewsArticle","articleBody":"y"}') is None
    assert fields(spark, '{"articleBody":"first","@type":"NewsMediaOrganization"}') is None
    both = fields(spark, '[{"articleBody":"first","@type":"Media"},{"@type":"Article"}]')
    assert both["body"] == "first"
    f = fields(spark, '{"@type":"NewsArticle","headline":"H","description":"D","articleSection":"Sport",'
               '"keywords":["A b","C"],"datePublished":"p","dateModified":"m","articleBody":"B"}',
               only_body=False)
    assert f.asDict() == {
        "title": "H", "description": "D", "body": "B", "creation_datetime": "p",
        "modified_datetime": "m", "main_topic": "sport", "other_topic": "a-b,c"}


def article(head, body="<p>text</p>", start="<html lang='es'>"):
    return f"{start}<head>{head}</head><body>{body}</body></html>"


A = '<meta property="og:type" content="article">'
T = '<meta property="og:title" content="T">'


def when(value):
    return f'<meta property="article:published_time" content="{value}">'


def test_gates(spark):
    ok = when("2024-01-01T12:00:00+01:00")
    cases = [
        ("<div>no</div>", "5_8"), ("<html><body></body></html>", "5_9"), (article(T), "5_7"),
        (article(A), "5_2"), (article(A + when("")), "5_3"),
        (article(A + '<meta property="article:published_time">'), "5_1"),
        (article(A + when("2024-01-01T12:00:00")), "5_1"), (article(A + when("soon")), "5_1"),
        (article(A + when("2023-12-31T23:59:59+00:00")), "5_4"),
        (article(A + when("2024-01-01T00:00:00+00:00")), "5_5"),
        (article(A + ok + T, ""), "5_6"), (article(A + ok + T), "0"),
        (article(A + when("2030-01-01T00:00:00Z") + T), "0"),
    ]
    df = spark.createDataFrame(
        [(str(i), "m", 1.0, h) for i, (h, _) in enumerate(cases)],
        "url string, media_url string, score double, html string")
    out = articles.article_outcomes(df, dates.instant_literal("2024-01-02 00:00:00+00:00"))
    got = {int(r["url"]): r["status_code"] for r in out.collect()}
    assert [got[i] for i in range(len(cases))] == [s for _, s in cases]


def test_fetch_errors_come_first(spark):
    df = spark.createDataFrame(
        [("u", "m", 1.0, None, e) for e in ("too_many_redirects", "unicode_error", "reset")],
        "url string, media_url string, score double, html string, fetch_error string")
    out = articles.article_outcomes(df, F.current_timestamp())
    assert sorted(r["status_code"] for r in out.collect()) == ["1_1", "1_2", "1_3"]
