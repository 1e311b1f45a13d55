"""Anchors of pages, hosts of links, edges between hosts, and queries beside their SQL twins."""

from __future__ import annotations

import time
from collections import Counter

import duckdb
import pytest

from metricspark.llm import urls
from metricspark.llm.queries import ORACLES, QUERIES

PAGES = [
    ('<a href="http://x.org/1">', ["http://x.org/1"]),
    (f'<a data-x="{"d" * 2500}" style=\'{"s" * 9000}\' href="http://x.org/2">', ["http://x.org/2"]),
    ('<a title="1 > 0" href=http://x.org/3>text</a>', ["http://x.org/3"]),
    ("<A\n  CLASS=b\n  HREF = 'http://x.org/4' >", ["http://x.org/4"]),
    ('<a href="first" href="second">', ["first"]),
    ("<abbr href=no><area href=no><a>", []),
    ("<a/href=/slash>", ["/slash"]),
    ("<a href>", [""]),
    ('<a href="">x</a><a disabled href=y>', ["", "y"]),
    ('<a href="  http://x.org/5\n">', ["http://x.org/5"]),
    ('<a href="unclosed', [""]),
    ("<a data-href=no>", []),
    ("<a =x href=z>", ["z"]),
    ("", []),
    ("<a " + "k='v' " * 20_000 + "href=far>", ["far"]),
]


@pytest.mark.parametrize("at", range(len(PAGES)))
def test_links(at):
    html, want = PAGES[at]
    assert list(urls.links(html)) == want


def test_long_pages_take_linear_time():
    for text in ("<a " * 200_000, '<a href="' * 100_000, "<a b='" * 100_000, "<a " + " " * 500_000 + "=" * 500_000):
        start = time.perf_counter()
        sum(1 for _ in urls.links(text))
        assert time.perf_counter() - start < 20


def test_hosts_of_links_are_hosts_of_urls(spark):
    links = ["http://A.b.C/d?e", "https://h?q=/", "ftp://h#x/y", "/path", "x", "mailto:a@b.c", "http://", "a?u=http://in.org/x", "://odd.org"]
    rows = spark.createDataFrame([(x,) for x in links], "url string").select("url", urls.host_of(urls.F.col("url")).alias("host"))
    assert {r.url: r.host for r in rows.collect()} == {x: urls.linked_host(x) for x in links}
    assert urls.linked_host("//Cdn.org/x?u=http://z") == "cdn.org"


def test_edges(spark):
    rows = [("a.org", "<a href=http://b.org/><a href='//C.org/1'><a href=/own>"), ("a.org", "<a href=http://b.org/2>"), ("", "<a href=http://b.org>"), ("b.org", None)]
    pages = spark.createDataFrame(rows * 3, "host string, html string")
    assert Counter((r.src, r.dst, r.n) for r in urls.host_edges(pages).collect()) == {("a.org", "b.org", 6): 1, ("a.org", "c.org", 3): 1}
    assert urls.host_edges(pages.where("false")).collect() == []


def test_a_host_of_many_labels(spark):
    host = ".".join(["l"] * 1500) + ".bad.net"
    pages = spark.createDataFrame([(1, f"http://{host}/x", None)], "page_id long, url string, html string")
    assert urls.judge(pages, [("bad.net", "/", "block")]).first().verdict == "block"


def test_an_empty_table_and_rules_that_tie(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", None)], "page_id long, url string, html string")
    rules = [("a.org", "/x", "block"), ("a.org", "/x", "allow")]
    assert [r.verdict for r in urls.judge(pages, rules).collect()] == ["block"]
    assert urls.judge(pages.where("false"), rules).collect() == [] and urls.judge(pages, []).first().verdict == "allow"


@pytest.mark.parametrize("name", ["op5_url_link_graph", "op12_ranked_lexical_search"])
def test_twins(spark, name):
    folder = "/root/testdata/sf0.001"
    query = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.execute(f"create view {table} as from '{folder}/{table}.parquet'")
    columns = sorted(query.columns)
    twin = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in query.collect()) == Counter(twin)
