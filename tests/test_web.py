"""Urls, pages, links, searches."""

import hashlib
import hmac
import ipaddress
import unicodedata

import pytest
from pyspark.sql import functions as F

from fitgrid.functions import html as H
from fitgrid.functions import urls as U
from fitgrid.functions.companies import bare_company, employment_fit, nfkc
from fitgrid.operators import candidates, facts, leads, pages, privacy


def ask(spark, parse, *values):
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    return [r.r for r in df.select("n", parse(F.col("v")).alias("r")).orderBy("n").collect()]


def test_canonical_urls(spark):
    assert ask(
        spark, U.canonical_url, "https://Jobs.Example.com:443/a?utm_source=x&b=1#f", "https://example.com",
        "http://example.com/", "https://user@example.com/", "https://example.com:8443/", "https://10.0.0.1/", "https://localhost/",
        "https://db.internal/", "https://a..com/", " https://example.com/", "https://example.com/" + "x" * 2048, "https://example.com/?utm_term=1",
    ) == ["https://jobs.example.com/a?b=1", "https://example.com/"] + [None] * 9 + ["https://example.com/"]


def test_addresses(spark):
    v4 = ["10.1.2.3", "100.64.0.1", "8.8.8.8", "172.31.9.9", "172.32.0.1", "198.19.1.1", "239.1.1.1", "192.0.1.1"]
    assert ask(spark, U.blocked_ipv4, *v4) == [True, True, False, True, False, True, True, False]
    v6 = ["2001:4860:4860::8888", "2001:db8::1", "2001:1ff::1", "2001:200::1", "2002:1::", "3fff:fff::1", "3fff:1000::", "fe80::1", "::1"]
    assert ask(spark, U.blocked_ipv6, *v6) == [False, True, True, False, True, True, False, True, True]
    forms = ["2001:0DB8:0:0:0:0:0:1", "2001:db8::", "::1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "0:0:1::"]
    assert ask(spark, U.canonical_ipv6, *forms) == [str(ipaddress.ip_address(f)) for f in forms]
    assert ask(spark, U.client_ip, "1.1.1.1, 9.9.9.9", "a, ::FFFF:1.2.3.4", "nonsense", "2001:DB8::1") == [
        "9.9.9.9", "1.2.3.4", None, "2001:db8::1"]


def test_pseudonyms_are_hmacs_of_the_day(spark):
    df = spark.createDataFrame([(1, 2, "1.1.1.1", " ")], "event_id int, user_id int, forwarded_for string, user_agent string") \
        .withColumn("ts", F.lit("2024-01-05 23:59:59").cast("timestamp_ntz"))
    row = privacy.daily_pseudonyms(df, "secret").first()
    assert row.ip_key == hmac.new(b"secret", b"2024-01-05|1.1.1.1", hashlib.sha256).hexdigest()
    assert row.ua_key is None and set(row.asDict()) == {"event_id", "user_id", "ip_key", "ua_key"}


def test_site_kinds_and_boards(spark):
    urls = ["https://hrmos.co/pages/a/jobs/12", "https://hrmos.co/about", "https://herp.careers/v1/a/abcd", "https://jobs.lever.co/acme/1",
            "https://boards.greenhouse.io/embed/job_board?for=acme", "https://www.workable.com/x", "https://acme.workable.com/"]
    assert ask(spark, U.site_kind, *urls) == ["hrmos", "generic", "herp", "hosted-ats", "hosted-ats", "hosted-ats", "hosted-ats"]
    assert [b and tuple(b) for b in ask(spark, U.board_of, *urls)] == [
        None, None, None, ("lever", "acme"), ("greenhouse", "acme"), None, ("workable", "acme")]
    assert ask(spark, U.url_shape, "https://a.jp/jobs/1", "https://a.jp/jobs?b=1&a=2") == ["https://a.jp/jobs/*", "https://a.jp/jobs?a&b"]


def test_fragments_follow_the_page():
    page = """<html><body><nav>menu</nav><main data-job><h1>Role</h1>intro <b>text</b><h2>Work</h2><p>one<p>two
      <table><tr><th>Pay</th><td>600</td></tr></table><dl><dt>Place</dt><dd>Tokyo</dd><dd>Osaka</dd></dl>
      <div data-company><p>About us</p></div><p hidden>no</p><p style="display: none">no</p><script>x</script>tail</main>
      <section itemtype="https://schema.org/Organization"><p>Other</p></section></body></html>"""
    rows = H.page_fragments(page)
    job = [(text, section) for scope, _, text, _, section in rows if scope == "job"]
    assert job == [("Role", "Role"), ("intro text", "Role"), ("Work", "Work"), ("one", "Work"), ("two", "Work"),
                   ("Pay 600", "Pay"), ("Place Tokyo Osaka", "Place"), ("tail", "Place")]
    assert [text for scope, _, text, _, _ in rows if scope == "company"] == ["About us"]
    assert rows[1][3].startswith("main:line-1:gap-1") and H.page_fragments("") == []


def test_pages_with_several_jobs_have_no_identity(spark):
    def page(n, body):
        return (n, f'<script type="application/ld+json">{body}</script>')
    one = '{"@type":"JobPosting","title":"T","hiringOrganization":"C","employmentType":["full time","odd"]}'
    df = spark.createDataFrame([
        page(1, one), page(2, f"[{one},{one}]"), page(3, f'[{one},{one.replace("T", "U")}]'), page(4, "{bad"),
        page(5, '{"@graph":[{"@type":"Thing"},' + one + "]}"), page(6, '{"@type":"JobPosting","title":5,"hiringOrganization":"C"}'),
    ], "page_id bigint, html string")
    rows = {r.page_id: (r.title, r.employer, r.employment_types) for r in pages.page_postings(df).collect()}
    assert rows == {n: ("T", "C", ["FULL_TIME"]) for n in (1, 2, 5)}


def test_robots_rules(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: a\nUser-agent: fitgrid\nDisallow: /x\nAllow: /x/y\nDisallow: /*.pdf$\nDisallow: /t\nAllow: /t\n"
    robots = spark.createDataFrame([("https://a.jp", 200, body), ("https://b.jp", 403, ""), ("https://c.jp", 429, "")],
                                   "origin string, status int, body string")
    urls = ["https://a.jp/x", "https://a.jp/x/y/z", "https://a.jp/f.pdf", "https://a.jp/f.pdf?a", "https://a.jp/t", "https://a.jp/",
            "https://b.jp/x", "https://c.jp/x", "https://d.jp/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "url_id int, url string")
    got = [r.decision for r in leads.robots_decisions(df, robots, "fitgrid").orderBy("url_id").collect()]
    assert got == ["disallowed", "allowed", "disallowed", "allowed", "allowed", "allowed", "allowed", "held", "held"]
    other = [r.decision for r in leads.robots_decisions(df.limit(1), robots, "other").collect()]
    assert other == ["disallowed"]


def test_robots_rules_and_paths_meet_in_one_spelling(spark):
    robots = spark.createDataFrame([("https://a.jp", 200, "User-agent: *\nDisallow: /%7Euser/\nDisallow: /x%2fy\nDisallow: /50%\n")],
                                   "origin string, status int, body string")
    urls = ["https://a.jp/~user/x", "https://a.jp/%7euser/x", "https://a.jp/x%2Fy", "https://a.jp/x/y", "https://a.jp/50%25", "https://a.jp/user"]
    got = [r.decision for r in leads.robots_decisions(
        spark.createDataFrame(list(enumerate(urls)), "url_id int, url string"), robots, "fitgrid").orderBy("url_id").collect()]
    assert got == ["disallowed"] * 3 + ["allowed"] + ["disallowed", "allowed"]


def test_links_are_resolved_and_read_decoded(spark):
    page = "https://A.jp:443/recruit/x/index.html?q"
    hrefs = ["../jobs/1", "./2", "../../../z", "..", "a/./b/.", "HTTPS://B.JP:443/C?d#e", "//c.jp", "/%2E%2e/k", "?p=1", "mailto:x", "#top",
             "http://d.jp:443/", " /s "]
    df = spark.createDataFrame([(i, h, page) for i, h in enumerate(hrefs)], "n int, h string, p string")
    got = [r.r for r in df.select("n", U.absolute_url(F.col("h"), F.col("p")).alias("r")).orderBy("n").collect()]
    assert got == ["https://a.jp/recruit/jobs/1", "https://a.jp/recruit/x/2", "https://a.jp/z", "https://a.jp/recruit/", "https://a.jp/recruit/x/a/b/",
                   "https://b.jp/C?d", "https://c.jp/", "https://a.jp/k", "https://a.jp/recruit/x/index.html?p=1", None,
                   "https://a.jp/recruit/x/index.html?q", "http://d.jp:443/", "https://a.jp/s"]
    assert ask(spark, U.is_listing, "https://a.jp/%E6%8E%A1%E7%94%A8/", "https://a.jp/%E6%8E%A1", "https://a.jp/%zz/") == [True, False, False]
    links = spark.createDataFrame([(1, "https://a.jp/", 0, "https://a.jp/%E6%8E%A1%E7%94%A8/1", "x")], "page_id int, url string, position int, link string, text string")
    assert [r.lead_rank for r in leads.career_links(links).collect()] == [1] and leads.posting_links(links, 9).count() == 1


def test_hand_over_to_the_employers_other_domain(spark):
    page = "https://corp.sample.co.jp/careers/midcareer/"
    html = """<a href="https://japan-job-jp.sample.careers/%E6%88%A6%E7%95%A5?l-id=1">s</a> <a href="/%E3%82%B8%E3%83%A7%E3%83%96/1/2">k</a>
      <a href="https://news.example/careers/x">News</a> <a href="https://sample.careers/about/x">no</a> <a href="https://sample.example/x">no</a>"""
    links = leads.anchors(spark.createDataFrame([(1, page, html)], "page_id int, url string, html string"))
    own = "https://corp.sample.co.jp/%E3%82%B8%E3%83%A7%E3%83%96/1/2"
    def found(domains):
        rows = spark.createDataFrame([(1, x) for x in domains], "page_id int, domain string")
        return [r.link for r in leads.posting_links(links, 10, rows).orderBy("link_rank").collect()]
    other = "https://japan-job-jp.sample.careers/%E6%88%A6%E7%95%A5?l-id=1"
    assert [r.link for r in leads.posting_links(links, 10).collect()] == [own]
    assert found(["corp.sample.co.jp"]) == [other, own]
    assert found(["www.jobs.co.jp", "else.jp"]) == [own]  # labels that name nobody, and another employer


def test_rules_of_job_sites(spark):
    urls = {
        "https://hrmos.co/pages/a/jobs/12": ("hrmos", False, True), "https://hrmos.co/pages/a/jobs/": ("hrmos", True, False),
        "https://herp.careers/v1/a": ("herp", True, False), "https://herp.careers/v1/a/abcd": ("herp", False, True),
        "https://jobs.lever.co/acme": ("hosted-ats", True, True), "https://jobs.lever.co/acme/jobs/1": ("hosted-ats", False, True),
        "https://jobs.lever.co/": ("hosted-ats", True, False), "https://a.jp/recruit/x": ("generic", True, None),
        "https://a.jp/recruit/1/2/3/4/5": ("generic", False, None), "https://a.jp/ir": ("generic", False, None)}
    assert list(zip(*(ask(spark, f, *urls) for f in (U.site_kind, U.is_listing, U.is_posting)))) == list(urls.values())
    pairs = [("https://hrmos.co/pages/a/jobs/1", "https://hrmos.co/pages/a/jobs", True), ("https://hrmos.co/pages/b/jobs/1", "https://hrmos.co/pages/a/jobs", False),
             ("https://herp.careers/v1/a/abcd", "https://herp.careers/v1/a", True), ("https://herp.careers/v1/b/abcd", "https://herp.careers/v1/a", False),
             ("https://a.jp/jobs/1", "https://a.jp/jobs", True), ("https://a.jp/recruit/x", "https://a.jp/recruit", True),
             ("https://a.jp/recruit", "https://a.jp/", False), ("https://a.jp/jobs/1", "https://a.jp/jobs/1", False)]
    df = spark.createDataFrame(pairs, "link string, page string, want boolean")
    assert [r.got for r in df.select(U.is_posting_link(F.col("link"), F.col("page")).alias("got")).collect()] == [p[2] for p in pairs]


def test_reachable_pages_are_cut_by_a_named_budget_only(spark):
    start = spark.createDataFrame([(1, "https://www.acme.co.jp/", "www.acme.co.jp")], "company_id int, url string, domain string")
    links = spark.createDataFrame(
        [("https://www.acme.co.jp/", f"https://www.acme.co.jp/p{i}") for i in range(100)]
        + [("https://www.acme.co.jp/p1", f"https://www.acme.co.jp/q{i}") for i in range(5)], "url string, link string")
    def hops(budget):
        return sorted(r.hop for r in leads.reachable_pages(start, links, budget=budget).collect())
    assert hops(None) == [0] + [1] * 100 + [2] * 5
    assert hops(40) == [0] + [1] * 40 and hops(103) == [0] + [1] * 100 + [2] * 3


def test_a_foreign_fragment_ends_a_section(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 3, "a", "z"), (2, 1, "a", "x"), (2, 2, "a", "y"), (2, 3, "", "q"), (2, 4, "a", "z")],
                                 "document_id int, position int, section string, text string")
    assert [(r.document_id, r.text) for r in facts.section_groups(rows).collect()] == [(2, "x y")]


def test_sitemaps_that_name_each_other_end(spark):
    robots = spark.createDataFrame([("https://a.jp", "Sitemap: https://a.jp/s.xml")], "origin string, body string")
    maps = spark.createDataFrame([
        ("https://a.jp/s.xml", "<loc>https://a.jp/jobs.xml</loc><loc>https://a.jp/p?a=1&amp;b=2</loc><loc>https://b.jp/jobs.xml</loc>"),
        ("https://a.jp/jobs.xml", "<loc>https://a.jp/job-s.xml</loc><loc>https://a.jp/q</loc>"),
        ("https://a.jp/job-s.xml", "<loc>https://a.jp/jobs.xml</loc><loc>https://a.jp/r</loc>")], "url string, xml string")
    got = sorted(r.page_url for r in leads.sitemap_urls(robots, maps).collect())
    assert got == ["https://a.jp/p?a=1&b=2", "https://a.jp/q", "https://a.jp/r", "https://b.jp/jobs.xml"]


def test_company_names(spark):
    names = ["株式会社ＡＢＣ", "Acme Co., Ltd.", "㈱ラクス", "ｱｸﾒ Inc.", "(株)"]
    got = ask(spark, lambda c: bare_company(nfkc(c)), *names)
    assert got == ["abc", "acme", "ラクス", unicodedata.normalize("NFKC", "ｱｸﾒ"), ""]


def test_contained_names_equal_all_pairs(spark):
    import random
    rng = random.Random(4)
    inner = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    outer = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    got = candidates.contained_names(
        spark.createDataFrame([(n,) for n in inner + inner], "inner string"), spark.createDataFrame([(n,) for n in outer], "outer string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in inner for b in outer if a in b)


def test_copies_of_a_name_stay_one_row(spark):
    df = spark.createDataFrame([("Acme Inc.",)] * 500 + [("Acme Japan",), ("Other",)], "company_name string")
    rows = sorted(map(tuple, candidates.same_company_pairs(df).collect()))
    assert rows == [("acme", "acme", 500, 500), ("acme", "acmejapan", 500, 1)]


@pytest.mark.parametrize("wanted, declared, title, expected", [
    ("full_time", ["FULL_TIME"], "x", True), ("full_time", ["INTERN"], "正社員", False), ("full_time", [], "正社員の営業", True),
    ("full_time", [], "アルバイト", False), ("full_time", [], "営業", None), ("new_grad", ["FULL_TIME"], "新卒採用", True),
    ("contract", ["TEMPORARY"], "x", True), (None, ["FULL_TIME"], "x", None),
])
def test_employment_fit(spark, wanted, declared, title, expected):
    df = spark.createDataFrame([(wanted, declared, title)], "w string, d array<string>, t string")
    assert df.select(employment_fit(F.col("w"), F.col("d"), F.col("t")).alias("r")).first().r == expected


def test_resolution_needs_confidence_and_distance(spark):
    searches = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "query_id int")
    ranked = spark.createDataFrame(
        [(q, f"c{i}", i, m, t) for q, n, m, t in ((1, 5, 1, 2), (2, 2, 1, 2), (3, 4, 0, 0), (4, 2, 1, 2)) for i in range(1, n + 1)],
        "query_id int, candidate_id string, position int, matched_terms int, total_terms int")
    chosen = spark.createDataFrame([
        (1, "c2", 0.9, {"c2": 0.85, "c1": 0.15}), (2, "c2", 0.9, {"c2": 0.8, "c1": 0.16}), (4, "none", 0.9, {"none": 0.9, "c2": 0.05})],
        "query_id int, choice string, confidence double, probabilities map<string,double>")
    rows = {r.query_id: tuple(r)[1:] for r in candidates.decide_resolutions(searches, ranked, chosen).collect()}
    assert rows == {
        1: ("resolved", "confident_selection", "c2", False), 2: ("candidates", "ambiguous", "c2,c1", False),
        3: ("candidates", "company_listing", "c1,c2,c3", True), 4: ("candidates", "ambiguous", "c2,c1", False),
        5: ("not_found", "no_candidates", "", False)}
