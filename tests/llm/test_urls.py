from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from logloom.llm.urls import host_and_path, judge_urls, judge_urls_sql

SF = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = judge_urls(spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = con.execute(judge_urls_sql())
    names = [d[0] for d in want.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, [got.select(*names).schema and r for r in spark.createDataFrame(want.fetchall(), got.select(*names).schema).collect()]))


def test_host_path_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/en/12": ("notexample.org", "/en/12", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com/DE/1": ("x.com", "/DE/1", None, "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://a.org?x/": ("a.org", "", None, "allow"),
        "ftp://h:80/p://q": ("h:80", "/p://q", None, "allow"),
        "no scheme/org/": ("", "", None, "allow"),
        "://org/x": ("org", "/x", "org/", "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.Com/" + "a/" * 5000: ("É.com", "/" + "a/" * 5000, None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, template string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, labels).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert judge_urls(pages.limit(0), labels).count() == 0
    host, _ = host_and_path(F.lit("HTTP://UP.net#"))
    assert spark.range(1).select(host.alias("h")).first().h == "up.net"


def test_bad_sections_are_blocked_and_variable_segments_merge(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 4 == 0 else ('news', 'blog', 'tips')[i % 3]}/{i}.html") for i in range(400)] + [(400, "http://h.net/spam/new.html"), (401, "http://h.net/spam/77.html"), (401, "http://h.net/spam/77.html"), (None, "http://h.net/news/5.html")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, None) for i in range(300)] + [(3, None, None), (None, 0, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = judge_urls(pages, labels).collect()
    assert len(got) == len(rows) and all((r.verdict == "block") == r.path.startswith("/spam") for r in got)
    assert {r.template for r in got if r.path.startswith("/spam")} == {"/spam/*"}
    alike = judge_urls(pages, spark.createDataFrame([(i, i % 7 % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int"))
    assert {r.template for r in alike.collect()} == {"/*/*"}


def test_deep_paths_are_told_apart(spark):
    """As the SQL does it with as many levels as there are."""
    rng = random.Random(6)
    rows = [(i, f"http://h.net/en/blog/2024/{'casino' if i % 4 == 0 else 'news'}/{'abc'[i % 3]}/{i}.html") for i in range(400)]
    rows += [(i, f"http://{rng.choice('pq')}.net/" + "/".join(rng.choice(("x", "y", "z", "v1", "")) for _ in range(rng.randrange(8)))) for i in range(400, 2400)]
    rows += [(i, "http://long.net/" + "s/" * 60 + ("bad", "fine")[i % 2] + f"/{i}") for i in range(2400, 2500)]
    quality = lambda i, u: 0 if "casino" in u or "bad/" in u or "x/y" in u and rng.random() < 0.8 or rng.random() < 0.1 else 1
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, quality(i, u), None) for i, u in rows if i % 5], "doc_id long, quality int, toxic int")
    got = judge_urls(pages, labels)
    by = {r.page_id: r for r in got.collect()}
    assert {by[i].verdict for i in range(0, 400, 4)} == {"block"} and {by[i].verdict for i in range(400) if i % 4} == {"allow"}
    assert by[0].template.startswith("/*/*/*/casino/") and all(by[i].verdict == ("block", "allow")[i % 2] for i in range(2400, 2500))
    con = duckdb.connect()
    con.register("all_pages", pages.toArrow())
    con.execute("CREATE VIEW pages AS SELECT * FROM all_pages WHERE page_id < 2400")
    con.register("labels", labels.toArrow())
    want = {r[0]: r[1:] for r in con.execute(f"SELECT page_id, verdict, template FROM ({judge_urls_sql(depth=8)})").fetchall()}
    less = judge_urls(pages.where("page_id < 2400"), labels.where("doc_id < 2400")).collect()
    assert {r.page_id: (r.verdict, r.template) for r in less} == want and len({t for _, t in want.values()}) > 10
