"""Text of HTML, by cases read off the parsing rules, and against a parser on well-formed pages."""

import random
import time
from html.parser import HTMLParser

import duckdb
import pytest

from postlake.functions.markup import body_text, lines_of, strip_html

CASES = [
    ("plain & text", "plain & text"),
    ("<p>One<p>Two", "OneTwo"),
    ("a < b and c > d", "a < b and c > d"),
    ("1 <2 and <b>3</b>", "1 <2 and 3"),
    ("<a title='x > y' href=\"a>b\">link</a>", "link"),
    ("<a title=x>y>z</a>", "y>z"),
    ("<a b='c>text", ""),
    ("<a b=\"c>text</a><p>more", ""),
    ("before <a b='c>text", "before "),
    ("<p 'odd\">x", "x"),
    ("<p a=b'c\"d>x", "x"),
    ("<p a = 'b>c'>x", "x"),
    ("<p a==>x", "x"),
    ("<br/>x<br / >y", "xy"),
    ("x<!-- a > b -- c -->y", "xy"),
    ("x<!-->y", "xy"),
    ("x<!--->y", "xy"),
    ("x<!-- a --!>y", "xy"),
    ("x<!-- never ends", "x"),
    ("x<!doctype html>y", "xy"),
    ("x<?php echo 1 ?>y", "xy"),
    ("x</ p>y", "xy"),
    ("x</>y", "xy"),
    ("x</", "x</"),
    ("x<", "x<"),
    ("x<p", "x"),
    ("<ul><li>&lt;b&gt; &amp;amp; &#65;&#x42;&#X43; &copy &notit; &eacute;&#128; &unknown;</li></ul>", "<b> &amp; ABC © ¬it; é€ &unknown;"),
    ("&nbsp;x&#160;", "\xa0x\xa0"),
    ("y<script>if (a<b) { '</p>' }</script>x", "yif (a<b) { '</p>' }x"),
    ("y<script>&amp;</script ><style>p > a</style>", "y&amp;p > a"),
    ("y<script>never ends </scriptx>", "ynever ends </scriptx>"),
    ("y<textarea><b>&amp;</b></textarea>z", "y<b>&</b>z"),
    ("y<template>no<template>no</template>no</template>z", "yz"),
    ("<script>head</script><style>head</style><title>head</title><meta x><p>body", "body"),
    ("<html><head> <title>T</title> </head>\n<body> <p>b</p></body></html> end", " b end"),
    ("  <head></head>  x", "x"),
    ("</p>x", "x"),
    ("<TITLE>a</Title>B", "B"),
    ("<xmp><b></xmp>c", "<b>c"),
    ("x<plaintext><b>&amp;", "x<b>&amp;"),
    ("a\r\nb\rc", "a\nb\nc"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_body_text(text, expected):
    assert body_text(text) == expected


def test_lines(spark):
    texts = ["<p> one </p>\n\n \n<p>　two﻿\n</p>", None, "", "<div>x</div>"]
    assert [lines_of(x) for x in texts] == ["one\ntwo", "", "", "x"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r["x"] for r in rows.orderBy("k").select(strip_html(rows["t"]).alias("x")).collect()] == ["one\ntwo", "", "", "x"]


def test_well_formed_pages_like_a_parser():
    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out = []

        def handle_data(self, data):
            self.out.append(data)

    rng = random.Random(5)
    for _ in range(300):
        parts = ["start"]
        for _ in range(rng.randint(1, 12)):
            tag = rng.choice(["p", "div", "b", "a href='x>y'", 'img alt="a < b"', "li class=x"])
            parts.append(rng.choice([f"<{tag}>{rng.choice(['word', 'a &amp; b', '&#233;', ' '])}</{tag.split()[0]}>", "<!-- c > d -->", "text\n", "<br>", "<script>x < y && '</b>'</script>"]))
        page = "".join(parts)
        parser = Text()
        parser.feed(page)
        parser.close()
        assert body_text(page) == "".join(parser.out), page


def test_time_of_odd_texts():
    began = time.perf_counter()
    for text in ("<a '" * 50_000, "<" * 200_000, "<p " + "a='b' " * 100_000, "<!--" * 50_000, "<p =" * 50_000, "<script>" * 30_000, "</" * 100_000, "<p a=\"" * 30_000, "&" * 100_000):
        body_text(text)
    assert time.perf_counter() - began < 20


def test_body_text_like_its_sql_without_semicolons(spark, tmp_path):
    """A title that is cut to a length may end with a reference without its semicolon."""
    from postlake.plans.registry import ORACLE_SQL, QUERIES

    pages = ["<p>a &amp</p>b &am", "<h1>&copy &middot &lt&gt &quot</h1>&amp;lt &amp;amp &amp;amp; &nbsp;&rsquo;&#39;", "<body class=x>&amp&amp;&ampx<br>&mdash;&hellip;", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ours = {r["page_id"]: r["plain"] for r in QUERIES["page_body_text"](spark, str(tmp_path)).collect()}
    assert ours[0] == "a &\nb &am" and ours == dict(con.sql(ORACLE_SQL["page_body_text"]).fetchall())
