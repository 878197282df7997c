"""Page, link and board queries over pages written from the part and supplier tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrid.bindings import Domain, ntz
from fitgrid.functions import urls as U
from fitgrid.operators import facts, leads, pages
from fitgrid.plans.registry import query
from fitgrid.plans.twins import twin
from fitgrid.plugins import score_axes
from fitgrid.sources.boards import board_postings

S = F.lit


def text(*parts):
    """Concatenation of texts and columns."""
    return F.concat(*[S(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Posting pages -------------------------------------------------------------------------------

def posting_pages(d: Domain) -> DataFrame:
    """One posting page per part; its number picks the JSON-LD form, the site and the state."""
    k, c, title, name = F.col("page_id"), F.col("company_id"), F.col("title"), F.col("company_name")
    base = d.postings_of(d.parts).join(d.companies, "company_id").select(
        F.col("job_posting_id").alias("page_id"), "company_id", "title", "company_name")
    until = text(',"validThrough":"', F.when(k % 8 == 1, "2023-01-01").otherwise("2025-01-01"), '"')
    def posting(kind, what, organization, rest):
        return text('{"@type":', kind, ',"title":"', what, '","hiringOrganization":', organization, until, rest, "}")
    plain = '"JobPosting"'
    org = text('{"name":"', name, '","url":"https://www.corp', c, '.co.jp/"}')
    quoted = text('"', name, '"')
    forms = [
        posting(plain, title, org, ',"employmentType":"full-time","jobLocation":{"address":{"addressRegion":"東京都"}}'),
        text('[{"@type":"Organization","name":"', name, '"},',
             posting('["JobPosting"]', title, text('{"name":"', name, '"}'), ',"employmentType":["PART_TIME","weird"]'), "]"),
        text('{"@graph":[', posting(plain, title, text('{"name":"', name, '"}'), ',"jobLocationType":"TELECOMMUTE"'), "]}"),
        posting(plain, title, quoted, ',"jobLocation":[{"address":"大阪府"}]'),
        text("[", posting(plain, title, quoted, ""), ",", posting(plain, text(title, " II"), quoted, ""), "]"),
        S("{bad"),
    ]
    script = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    html = text(
        "<html><head><title>", title, " | ", name, '</title><meta property="og:site_name" content="', name,
        '"><script type="application/ld+json">', script, "</script></head><body><nav><a href='/'>menu</a></nav><main><h1>",
        title, "</h1><h2>業務内容</h2><p>", F.repeat(S("設計と開発を担当します。"), S(10)),
        "</p><table><tr><th>勤務地</th><td>東京都</td></tr></table><dl><dt>年収</dt><dd>600万円〜800万円</dd></dl><p>",
        F.when(k % 12 == 3, "募集は終了しました").otherwise("応募する"), "</p>",
        F.when(k % 5 == 0, "<h2>関連求人</h2><p>別の仕事</p>").otherwise(""), "</main><footer>end</footer></body></html>")
    url = (F.when(k % 3 == 0, text("https://www.corp", c, ".co.jp/recruit/jobs/", k))
           .when(k % 3 == 1, text("https://hrmos.co/pages/corp", c, "/jobs/", k))
           .otherwise(text("https://jobsite.example.com/jobs/", k)))
    return base.select(
        "page_id", url.alias("url"), html.alias("html"),
        F.when(k % 10 == 9, "Other").otherwise(name).alias("company"), S(None).cast("string").alias("employment_type"))


_PAGES = """posting_pages as (select p_partkey as k, p_partkey % 6 as v, p_name || ' ' || p_type as title, company_id as c, company_name as name
      from part join companies on company_id = p_partkey % (select count(*) from supplier))"""
_FRAGMENTS = _PAGES + """,
    page_rows as (select k as page_id, position, text, section from (
      select k, 1 as position, title as text, title as section from posting_pages
      union all select k, 2, '業務内容', '業務内容' from posting_pages
      union all select k, 3, repeat('設計と開発を担当します。', 10), '業務内容' from posting_pages
      union all select k, 4, '勤務地 東京都', '勤務地' from posting_pages
      union all select k, 5, '年収 600万円〜800万円', '年収' from posting_pages
      union all select k, 6, case when k % 12 = 3 then '募集は終了しました' else '応募する' end, '業務内容' from posting_pages
      union all select k, 7, '関連求人', '関連求人' from posting_pages where k % 5 = 0
      union all select k, 8, '別の仕事', '関連求人' from posting_pages where k % 5 = 0) z)"""


@query("page_fragments", twin("select * from page_rows", extra=_FRAGMENTS))
def page_fragments(d: Domain):
    return pages.page_fragments(posting_pages(d)).where("scope = 'job'").select(
        "page_id", "position", "text", "section")


@query("related_listing_trim", twin(
    "select page_id, position, text from page_rows where position <= 6", extra=_FRAGMENTS))
def related_listing_trim(d: Domain):
    return pages.trim_related(pages.page_fragments(posting_pages(d))).select("page_id", "position", "text")


@query("raw_page_texts")
def raw_page_texts(d: Domain):
    """Fragments, hash and sufficiency of every raw page as it was fetched."""
    return pages.page_texts(pages.page_fragments(d.pages)).select(
        "page_id", "fragments", "content_hash", "sufficient")


@query("page_snapshots")
def page_snapshots(d: Domain):
    """Raw pages as versions of their address without query."""
    stored = d.pages.withColumn("url", F.concat(U.origin(F.col("url")), U.path(F.col("url"))))
    return pages.page_snapshots(stored, pages.page_texts(pages.page_fragments(stored)))


@query("page_versions", twin("""
    select page_id, url, row_number() over (partition by url order by page_id) as version,
      lag(closed) over (partition by url order by page_id) is distinct from closed or lag(page_id) over (partition by url order by page_id) is null as changed
    from (select k as page_id, 'https://corp' || c || '.example.com/' as url, (k % 12 = 3)::int as closed from posting_pages) z""", extra=_PAGES))
def page_versions(d: Domain):
    """Snapshots of posting texts stored under one address per company."""
    fragments = pages.page_fragments(posting_pages(d)).where("position = 6")
    stored = d.job_postings.select(
        F.col("job_posting_id").alias("page_id"), text("https://corp", F.col("company_id"), ".example.com/").alias("url"))
    return pages.page_snapshots(stored, pages.page_texts(fragments), bucket=500).select(
        "page_id", "url", "version", "changed")


@query("jsonld_postings", twin("""
    select k as page_id, title, name as employer, case v when 0 then 'FULL_TIME' when 1 then 'PART_TIME' else '' end as employment_types,
      case v when 0 then '東京都' when 3 then '大阪府' else '' end as regions, v = 2 as telecommute from posting_pages where v <= 3""", extra=_PAGES))
def jsonld_postings(d: Domain):
    return pages.page_postings(posting_pages(d)).withColumn(
        "employment_types", F.array_join("employment_types", ";")).withColumn("regions", F.array_join("regions", ";"))


@query("page_identity", twin("select k as page_id, title, name as employer from posting_pages where v = 5", extra=_PAGES))
def page_identity(d: Domain):
    found = posting_pages(d)
    return pages.page_identities(found.join(pages.structured_postings(found), "page_id", "left_anti"))


_VERDICTS = _PAGES + """,
    verdicts as (select k as page_id, case when reason is null then 'accepted' else 'rejected' end as verdict, reason,
        case when reason is null then case when k % 3 = 1 then 'ats' when v in (0, 5) then 'official' else 'web' end end as source_kind,
        case when reason is null then title end as title
      from (select *, case when v = 4 then 'multiple_postings' when v = 5 then case when k % 10 = 9 then 'not_job_posting' end
          when k % 12 = 3 then 'closed' when k % 10 = 9 then 'company_mismatch' when k % 8 = 1 then 'expired' end as reason from posting_pages) z)"""


@query("verify_postings", twin("select * from verdicts", extra=_VERDICTS))
def verify_postings(d: Domain):
    return pages.verify_postings(posting_pages(d), ntz("2024-01-31")).drop("url")


@query("rejection_breakdown", twin(
    "select verdict, coalesce(reason, '') as reason, count(*) as pages from verdicts group by 1, 2", extra=_VERDICTS))
def rejection_breakdown(d: Domain):
    return pages.rejection_breakdown(pages.verify_postings(posting_pages(d), ntz("2024-01-31")))


@query("axis_scorer")
def axis_scorer(d: Domain):
    """The bundled keyword scorer, judged by the same thresholds as any other scorer."""
    choices, evidence = score_axes(d.posting_fragments)
    return facts.axis_judgements(choices, evidence)


# Boards --------------------------------------------------------------------------------------

def board_answers(d: Domain) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    url = text("https://jobs.example.com/b/", k)
    plain_url = F.when(k % 9 == 0, text("http://jobs.example.com/b/", k)).otherwise(url)
    title = F.when(k % 13 == 0, "  ").otherwise(text(" ", name, " "))
    kind = F.element_at(F.array(S("Full-time"), S("Internship"), S("Contract work"), S("unclear")), (k % 7 % 4 + 1).cast("int"))
    bodies = [
        text('{"jobs":[{"absolute_url":"', plain_url, '","title":"', title, '","location":{"name":"Tokyo"}}]}'),
        text('[{"hostedUrl":"', plain_url, '","text":"', title, '","categories":{"location":"Osaka","commitment":"', kind, '"}}]'),
        text('{"jobs":[{"jobUrl":"', plain_url, '","title":"', title, '","isListed":', F.when(k % 5 == 0, "false").otherwise("true"),
             ',"employmentType":"', kind, '"}]}'),
        text('{"jobs":[{"title":"', title, '","shortcode":"S', k, '","city":"Kyoto","country":"Japan","employment_type":"', kind, '"}]}'),
    ]
    providers = F.array(*[S(p) for p in ("greenhouse", "lever", "ashby", "workable")])
    turn = (k % 4 + 1).cast("int")
    return d.raw("part").select(
        F.element_at(providers, turn).alias("provider"), text("board", k).alias("board_id"),
        F.element_at(F.array(*bodies), turn).alias("body"))


@query("ats_board_union", """
    select (['greenhouse', 'lever', 'ashby', 'workable'])[k % 4 + 1] as provider, 'board' || k as board_id,
      case when k % 4 = 3 then 'https://apply.workable.com/board' || k || '/j/S' || k || '/' else 'https://jobs.example.com/b/' || k end as url,
      title, (['Tokyo', 'Osaka', null, 'Kyoto, Japan'])[k % 4 + 1] as location,
      case when k % 4 = 0 then null else (['FULL_TIME', 'INTERN', 'CONTRACTOR', null])[k % 7 % 4 + 1] end as employment_type
    from (select p_partkey as k, p_name as title from part) z
    where k % 13 <> 0 and (k % 4 = 3 or k % 9 <> 0) and not (k % 4 = 2 and k % 5 = 0)""")
def ats_board_union(d: Domain):
    return board_postings(board_answers(d))


# Links ---------------------------------------------------------------------------------------

def a(href, words):
    return text('<li><a class="x" href="', href, '"><b>', words, "</b></a></li>")


def listing_pages(d: Domain) -> DataFrame:
    s = F.col("s_suppkey")
    html = F.concat(
        S("<html><body><ul>"), a(text("/recruit/jobs/", s, "1"), "エンジニア"), a(text("jobs/", s, "2#apply"), "営業"),
        F.when(s % 4 != 0, a(text("/recruit/jobs/", s, "3"), "x")).otherwise(""),
        a(text("https://boards.greenhouse.io/corp", s, "/jobs/", s), "Apply"), a(S("/about/company"), "求人"),
        a(text("http://www.corp", s, ".co.jp/recruit/jobs/9"), "job"), a(S("https://unrelated.example.org/jobs/1"), "job"),
        a(S("/ir/news"), "IR"), a(S("/recruit/"), "top"), S("</ul></body></html>"))
    return d.raw("supplier").select(
        s.alias("page_id"), text("https://www.corp", s, ".co.jp/recruit/").alias("url"), html.alias("html"))


_LINKS = """links as (select s_suppkey as page_id, n, case n when 1 then 'https://www.corp' || s_suppkey || '.co.jp/recruit/jobs/' || s_suppkey || '1'
        when 2 then 'https://www.corp' || s_suppkey || '.co.jp/recruit/jobs/' || s_suppkey || '2' when 3 then 'https://www.corp' || s_suppkey || '.co.jp/recruit/jobs/' || s_suppkey || '3'
        when 4 then 'https://boards.greenhouse.io/corp' || s_suppkey || '/jobs/' || s_suppkey when 5 then 'https://www.corp' || s_suppkey || '.co.jp/about/company'
        when 6 then 'http://www.corp' || s_suppkey || '.co.jp/recruit/jobs/9' when 7 then 'https://unrelated.example.org/jobs/1'
        when 8 then 'https://www.corp' || s_suppkey || '.co.jp/ir/news' else 'https://www.corp' || s_suppkey || '.co.jp/recruit/' end as link
      from supplier cross join range(1, 10) t(n) where n <> 3 or s_suppkey % 4 <> 0)"""


@query("posting_links", twin("""
    select page_id, link, row_number() over (partition by page_id order by n) as link_rank from links where n <= 4""", extra=_LINKS))
def posting_links(d: Domain):
    return leads.posting_links(leads.anchors(listing_pages(d)), limit=4).select("page_id", "link", "link_rank")


@query("related_posting_links", twin("""
    select page_id, link, row_number() over (partition by page_id order by n) as link_rank from (
      select * from links where n <= 4
      union all select s_suppkey, 10, 'https://jp-saiyo.corp' || s_suppkey || '.careers/jobs/7' from supplier
      union all select s_suppkey, 12, 'https://corp' || s_suppkey || '-recruit.example.com/x' from supplier) z""", extra=_LINKS))
def related_posting_links(d: Domain):
    """The same lists with hand-overs to the employer's careers sites on other domains, and one to a stranger's."""
    pages = listing_pages(d)
    s = F.col("page_id")
    more = F.concat(
        a(text("https://jp-saiyo.corp", s, ".careers/jobs/7"), "x"), a(text("https://corp", s + 1, ".careers/jobs/8"), "x"),
        a(text("https://corp", s, "-recruit.example.com/x"), "x"), a(text("https://corp", s, "-news.example.com/x"), "x"))
    pages = pages.withColumn("html", F.concat(F.expr("substr(html, 1, instr(html, '</ul>') - 1)"), more, F.lit("</ul></body></html>")))
    domains = pages.select("page_id", text("corp", s, ".co.jp").alias("domain"))
    return leads.posting_links(leads.anchors(pages), limit=9, domains=domains).select("page_id", "link", "link_rank")


@query("career_links", twin("""
    select page_id, link, case n when 4 then 0 when 5 then 2 else 1 end as lead_rank from links where n <= 5""", extra=_LINKS))
def career_links(d: Domain):
    return leads.career_links(leads.anchors(listing_pages(d))).select("page_id", "link", "lead_rank")


@query("listing_siblings", "select s_suppkey as page_id, 1 as sibling_shapes from supplier where s_suppkey % 4 <> 0")
def listing_siblings(d: Domain):
    return leads.listing_pages(leads.anchors(listing_pages(d)))


def job_urls(d: Domain) -> DataFrame:
    k = F.col("p_partkey")
    forms = [
        text("https://hrmos.co/pages/acme", k, "/jobs/", k), text("https://hrmos.co/pages/acme", k, "/jobs/"),
        text("https://herp.careers/v1/acme", k, "/abcd", k), text("https://boards.greenhouse.io/acme", k, "/jobs/", k),
        text("https://jobs.lever.co/acme", k), text("https://acme", k, ".workable.com/"),
        text("https://www.acme", k, ".co.jp/recruit/jobs/", k), text("https://www.acme", k, ".co.jp/ir/report"),
        text("https://apply.workable.com/j/ABC", k)]
    made = d.raw("part").select(F.element_at(F.array(*forms), (k % 9 + 1).cast("int")).alias("url"))
    return made.unionAll(d.pages.select("url"))


@query("job_site_kind", """
    with urls as (select k, k % 9 as f from (select p_partkey as k from part) z),
    kinds as (select (['hrmos', 'hrmos', 'herp', 'hosted-ats', 'hosted-ats', 'hosted-ats', 'generic', 'generic', 'hosted-ats'])[f + 1] as site_kind,
        f in (1, 4, 5, 6, 8) as is_listing, case when f in (0, 2, 3, 4, 8) then true when f in (1, 5) then false end as is_posting,
        (['', '', '', 'greenhouse', 'lever', 'workable', '', '', ''])[f + 1] as provider from urls
      union all select 'generic', regexp_matches(regexp_extract(url, '^https?://[^/?#]*(.*)$', 1), '(?i)(^|/)(careers?|jobs?|recruit|positions?|openings?|join)(/|$|[-_.])'), null, '' from pages)
    select site_kind, is_listing, is_posting, provider, count(*) as urls from kinds group by 1, 2, 3, 4""")
def job_site_kind(d: Domain):
    url = F.col("url")
    return job_urls(d).groupBy(
        U.site_kind(url).alias("site_kind"), U.is_listing(url).alias("is_listing"), U.is_posting(url).alias("is_posting"),
        F.coalesce(U.board_of(url)["provider"], S("")).alias("provider")).agg(F.count("*").alias("urls"))


# Sitemaps and crawl rules --------------------------------------------------------------------

def robots_files(d: Domain) -> DataFrame:
    s = F.col("s_suppkey")
    everyone = "User-agent: *\nDisallow: /private # closed\nAllow: /private/open\nDisallow: /*.pdf$\n\n"
    own = "User-Agent: other\nUser-agent: FitGrid\nDisallow: /recruit/secret\n"
    body = F.concat(S(everyone), F.when(s % 2 == 0, text(own, "Sitemap: https://www.corp", s, ".co.jp/sitemap-index.xml\n"))
                    .otherwise(""))
    status = F.when(s % 7 == 0, 404).when(s % 7 == 1, 429).when(s % 7 == 2, 500).otherwise(200)
    return d.raw("supplier").select(text("https://www.corp", s, ".co.jp").alias("origin"), status.alias("status"), body.alias("body"))


def sitemap_files(d: Domain) -> DataFrame:
    s, home = F.col("s_suppkey"), text("https://www.corp", F.col("s_suppkey"), ".co.jp")
    def loc(*parts):
        return text("<url><loc> ", home, *parts, " </loc></url>")
    index = F.concat(*[loc(f"/jobs-{i}.xml") for i in range(3)], loc("/news.xml"), loc("/top"), loc("/recruit/jobs/"))
    def child(i):
        folder = F.when((s % 6 == 0) & S(i == 2), "/ja/recruit/jobs/").otherwise("/recruit/jobs/")
        return F.array_join(F.transform(F.sequence(S(1), S(10)), lambda n: text(
            "<url><loc>", home, folder, f"{i}", n, "</loc></url>")), "")
    files = F.array(
        F.struct(text(home, "/sitemap-index.xml").alias("url"), index.alias("xml")),
        *[F.struct(text(home, f"/jobs-{i}.xml").alias("url"), child(i).alias("xml")) for i in range(3)],
        F.struct(text(home, "/news.xml").alias("url"), loc("/news/1").alias("xml")),
        F.struct(text(home, "/sitemap.xml").alias("url"), F.concat(loc("/careers/x"), loc("/recruit/jobs/1")).alias("xml")))
    return d.raw("supplier").select(F.inline(files))


_SITEMAP = """site_urls as (select s as site_id, 'https://www.corp' || s || '.co.jp' as origin, 'https://www.corp' || s || '.co.jp' || p as page_url from (
        select s_suppkey as s, case when i = 2 and s_suppkey % 6 = 0 then '/ja' else '' end || '/recruit/jobs/' || i || n as p
          from supplier cross join range(0, 3) a(i) cross join range(1, 11) b(n) where s_suppkey % 2 = 0
        union all select s_suppkey, p from supplier cross join (values ('/top'), ('/recruit/jobs/')) v(p) where s_suppkey % 2 = 0
        union all select s_suppkey, p from supplier cross join (values ('/careers/x'), ('/recruit/jobs/1')) v(p) where s_suppkey % 2 = 1) z)"""


@query("sitemap_urls", twin("select origin, page_url from site_urls", extra=_SITEMAP))
def sitemap_urls(d: Domain):
    return leads.sitemap_urls(robots_files(d).select("origin", "body"), sitemap_files(d))


_CLASSES = _SITEMAP + """,
    classes as (select site_id, 'detail' as kind, page_url as url, 0 as audience_rank, 0 as posting_rank,
        case when site_id % 6 = 0 then 10 else 30 end as siblings
      from site_urls where site_id % 2 = 0 and page_url like '%/recruit/jobs/_%' and (site_id % 6 <> 0 or page_url like '%/ja/%')
      union all select site_id, 'listing', page_url, 0, 0, 0 from site_urls where site_id % 6 <> 0 and page_url like '%/recruit/jobs/')"""


def classified(d: Domain) -> DataFrame:
    found = leads.sitemap_urls(robots_files(d).select("origin", "body"), sitemap_files(d))
    site = F.regexp_extract("origin", r"corp(\d+)\.", 1).cast("bigint")
    return leads.classify_sitemap(found.select(site.alias("site_id"), F.col("page_url").alias("url")))


@query("sitemap_classification", twin("select * from classes", extra=_CLASSES))
def sitemap_classification(d: Domain):
    return classified(d)


@query("lead_order", twin("""
    select company_id, url, 0 as audience_rank, min(group_rank) as group_rank from (
      select page_id as company_id, link as url, case when n = 4 then 0 else 3 end as group_rank from links where n <= 5
      union all select site_id, url, case kind when 'listing' then 1 else 2 end from classes
      union all select s_suppkey, 'https://' || w || '.corp' || s_suppkey || '.co.jp/', 4 from supplier cross join (values ('careers'), ('recruit'), ('jobs')) v(w)) z
    group by 1, 2""", extra=_LINKS + ", " + _CLASSES))
def lead_order(d: Domain):
    career = leads.career_links(leads.anchors(listing_pages(d))).select(
        F.col("page_id").alias("company_id"), F.col("link").alias("url"),
        F.when(F.col("lead_rank") == 0, 0).otherwise(3).alias("group_rank"), F.col("position").cast("bigint").alias("place"))
    mapped = classified(d).select(
        F.col("site_id").alias("company_id"), "url", F.when(F.col("kind") == "listing", 1).otherwise(2).alias("group_rank"),
        F.col("siblings").alias("place"))
    s = F.col("s_suppkey")
    usual = d.raw("supplier").select(s.alias("company_id"), F.posexplode(F.array(*[
        text(f"https://{w}.corp", s, ".co.jp/") for w in ("careers", "recruit", "jobs")])).alias("place", "url")
    ).select("company_id", "url", S(4).alias("group_rank"), F.col("place").cast("bigint").alias("place"))
    return leads.lead_order(career.unionByName(mapped).unionByName(usual)).select(
        "company_id", "url", "audience_rank", "group_rank")


@query("robots_decisions", """
    select s * 10 + n as url_id, case when s % 7 = 0 then 'allowed' when s % 7 in (1, 2) then 'held'
      when s % 2 = 0 then case when n = 4 then 'disallowed' else 'allowed' end
      when n in (0, 2) then 'disallowed' else 'allowed' end as decision
    from (select s_suppkey as s, n from supplier cross join range(0, 6) t(n)) z""")
def robots_decisions(d: Domain):
    s = F.col("s_suppkey")
    paths = ["/private/x", "/private/open/x", "/a/doc.pdf", "/a/doc.pdf?x=1", "/recruit/secret/1", "/ok"]
    urls = d.raw("supplier").select(s, F.posexplode(F.array(*[
        text("https://www.corp", s, ".co.jp", p) for p in paths])).alias("n", "url")
    ).select((s * 10 + F.col("n")).alias("url_id"), "url")
    return leads.robots_decisions(urls, robots_files(d), "fitgrid")


@query("link_reachability", twin("""
    select page_id as company_id, link as url, case n when 9 then 0 else 1 end as hop from links where n not in (6, 7)
    union all select s_suppkey, 'https://www.corp' || s_suppkey || '.co.jp/recruit/jobs/' || s_suppkey || '1' || m, h from supplier
      cross join (values ('/more', 2), ('/more/more', 3)) v(m, h)""", extra=_LINKS))
def link_reachability(d: Domain):
    s = F.col("s_suppkey")
    first = text("https://www.corp", s, ".co.jp/recruit/jobs/", s, "1")
    chain = [first, text(first, "/more"), text(first, "/more/more"), text(first, "/more/more/more")]
    deeper = d.raw("supplier").select(F.inline(F.array(*[
        F.struct(a.alias("url"), b.alias("link")) for a, b in zip(chain, chain[1:])])))
    links = leads.anchors(listing_pages(d)).select("url", "link").unionByName(deeper)
    start = d.raw("supplier").select(
        s.alias("company_id"), text("https://www.corp", s, ".co.jp/recruit/").alias("url"),
        text("www.corp", s, ".co.jp").alias("domain"))
    return leads.reachable_pages(start, links).select("company_id", "url", "hop")
