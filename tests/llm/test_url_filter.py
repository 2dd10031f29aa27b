import re

from conftest import SF
from loomseq.llm.url_filter import HOST_RULES, LITERAL, PATTERN_RULES, HostRule, PatternRule, filter_urls, op6_url_filter


def plain(url, HOST_RULES=HOST_RULES, PATTERN_RULES=PATTERN_RULES):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name)) if fits else None
    pattern = next((r.name for r in PATTERN_RULES if re.search(r.pattern, url.lower())), None)
    return host, path, rule and rule.name, rule.action if rule else "block" if pattern else "allow"


ODD = [
    None, "", "x", "://", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com", "http://example.com/", "http://example.com/en", "http://xexample.com/en/", "http://a.example.com/en/", "ftp://net/es/", "http://a.net/fr/?q",
    "http://u.net?/es/", "http://a://b.com/en/", "http://spam-farm.example.org/", "http://no.spam/", "http://x.org/cheap--pills", "http://x.org/best-casino", "http://x.org/xxx", "http://x.org/login?a", "http://x.org/\nlogin/", "http://x.com.\n/en/", "http://www.example.com/en/" + "a" * 50_000, "http://É.net/es/é",
    "http://com.foo.org/a.com /b", "http://a\nb.com/x", "http://com\n/en/", "http://a b.net/es/x", "http://x.org/a net/es/", "http://www.example.com /en/", "\u2028://com/",
]


def test_odd_urls_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(ODD)] + [(None, ODD[5], "h", "v")] * 2, "page_id long, url string, html string, verdict string")
    rows = filter_urls(df, keep=["page_id"]).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(ODD[5 if r.page_id is None else r.page_id])
    assert filter_urls(df.limit(0), keep=["page_id"]).count() == 0


def test_whole_table(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op6_url_filter(spark, SF).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(pages[r.page_id])


def test_long_lists_are_tables(spark):
    hosts = (*HOST_RULES, *(HostRule("block" if i % 2 else "allow", f"h{i}.org", f"/p{i % 7}/") for i in range(LITERAL + 50)))
    patterns = (*PATTERN_RULES, *(PatternRule(f"w{i}", rf"/w{i}([/?#]|$)", (f"w{i}",)) for i in range(LITERAL + 50)), PatternRule("any", r"zz$", ()))
    urls = [*ODD, *(f"http://a.h{i}.org/p{i % 5}/w{i}" for i in range(0, 300, 3)), "http://q.de/w9/zz", "http://q.de/zz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = filter_urls(df, keep=["page_id"], host_rules=hosts, pattern_rules=patterns).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], hosts, patterns)
    assert filter_urls(df, keep=["page_id"], host_rules=(), pattern_rules=()).where("verdict = 'allow'").count() == len(urls)


def test_odd_urls_by_sql(spark, tmp_path):
    import duckdb
    from loomseq.llm.url_filter import ORACLE

    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE})").fetchall()}
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op6_url_filter(spark, str(tmp_path)).collect()} == want
