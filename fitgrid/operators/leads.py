"""Links, sitemaps and crawl rules: where postings may be found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.functions import urls as U
from fitgrid.functions.text import squeezed
from fitgrid.operators.candidates import registrable_domain
from fitgrid.operators.keyed import moved, top_per_key
from fitgrid.session import checkpointed

_ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
SIBLINGS = 8
LISTING_SIBLINGS = 3


def anchors(pages: DataFrame) -> DataFrame:
    """Links of every page in order: (page_id, url, position, link, text)."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(_ANCHOR), 1).alias("href"),
        F.regexp_extract_all("html", F.lit(_ANCHOR), 2).alias("inner"))
    rows = pages.select("page_id", "url", F.posexplode(pairs).alias("position", "a"))
    return rows.select(
        "page_id", "url", "position",
        U.absolute_url(F.replace("a.href", F.lit("&amp;"), F.lit("&")), F.col("url")).alias("link"),
        squeezed(F.regexp_replace("a.inner", "<[^>]*>", " ")).alias("text")
    ).where("link is not null")


# Labels of a domain that do not name the employer, and how long a naming one is at least.
_NO_BRAND = r"^(?:www|global|group|corp|corporate|careers?|jobs?|recruit|saiyo|info|online)$"
_BRAND_CHARS = 4

# Which kinds of links count, by where they lead.
_ACCEPTED = {"same site": ("posting", "list", "worded"), "board": ("any",), "own careers site": ("any",), "elsewhere": ()}


def brands(domains: DataFrame) -> DataFrame:
    """``page_id, brand``: labels of a page's official domains (``page_id, domain``) that name the employer."""
    labels = domains.select("page_id", F.explode(F.split(F.lower("domain"), r"\.")).alias("brand"))
    return labels.where((F.char_length("brand") >= _BRAND_CHARS) & ~F.col("brand").rlike(_NO_BRAND)).distinct()


def own_careers_links(links: DataFrame, domains: DataFrame) -> DataFrame:
    """``page_id, link`` of careers links to another domain that carries the employer's brand as a label.

    Labels of the link's host meet the page's brands by an equal join.
    """
    named = links.where(F.concat(U.host(F.col("link")), U.decoded(U.path(F.col("link")))).rlike(U.CAREER)).select(
        "page_id", "link", F.explode(F.array_distinct(F.split(U.host(F.col("link")), "[.-]"))).alias("brand"))
    return named.join(brands(domains), ["page_id", "brand"], "left_semi").select("page_id", "link").distinct()


def classified_links(links: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """``links`` with ``leads_to`` (a key of the table above) and ``looks_like``, the kinds a link belongs to.

    ``domains`` names the official domains of a page's employer; without it no
    other site is the employer's own.
    """
    link, page = F.col("link"), F.col("url")
    on_board = (U.site_kind(link) != "generic") & (U.path(link) != "/")
    if domains is None:
        known = links.withColumn("own", F.lit(False))
    else:
        own = own_careers_links(links, domains).withColumn("own", F.lit(True))
        known = links.join(own, ["page_id", "link"], "left")
    bare = F.regexp_replace(U.path(page), "/$", "")
    deeper = (F.regexp_replace(U.path(link), "/$", "") != bare) & F.startswith(U.path(link), F.concat(bare, F.lit("/")))
    kinds = {
        "any": F.lit(True),
        "posting": U.is_posting_link(link, page),
        "list": (U.site_kind(page) != "generic") & U.is_listing(link) & deeper,
        "worded": F.col("text").rlike(U.JOB_LINK_TEXT) & U.decoded(F.concat(U.path(link), U.search(link))).rlike(U.CAREER_PATH),
    }
    return known.withColumn(
        "leads_to", F.when(U.origin(link) == U.origin(page), "same site").when(on_board, "board")
        .when(F.col("own"), "own careers site").otherwise("elsewhere")
    ).withColumn("looks_like", F.array_compact(F.array(*[F.when(holds, name) for name, holds in kinds.items()]))).drop("own")


def posting_links(links: DataFrame, limit: int, domains: DataFrame | None = None) -> DataFrame:
    """Likely postings of a listing page in page order, at most ``limit`` per page.

    Links on the page's own site count by what they look like; a page may hand
    over to a job board, or to the employer's careers site on another domain
    where ``domains`` (``page_id, domain``) says which are official.
    """
    rows = classified_links(
        links.where((U.scheme(F.col("link")) == "https") & ~U.decoded(U.path(F.col("link"))).rlike(U.NOT_JOB_PATH)), domains)
    accepted = [(F.col("leads_to") == where) & F.arrays_overlap("looks_like", F.array(*map(F.lit, kinds)))
                for where, kinds in _ACCEPTED.items() if kinds]
    first = rows.where(reduce(Column.__or__, accepted)).groupBy("page_id", "link").agg(F.min("position").alias("position"))
    return top_per_key(first, ["page_id"], [F.col("position").asc()], limit, rank="link_rank")


def career_links(links: DataFrame) -> DataFrame:
    """Careers links of official pages: boards first, then careers paths, then careers wording."""
    link, page = F.col("link"), F.col("url")
    board = (U.site_kind(link) != "generic") & (U.path(link) != "/")
    own = registrable_domain(U.host(link)) == registrable_domain(U.host(page))
    place = U.decoded(U.path(link))
    careerish = F.concat(U.host(link), place).rlike(U.CAREER) | F.col("text").rlike(U.CAREER_TEXT)
    rank = F.when(U.site_kind(link) != "generic", 0).when(place.rlike(U.CAREER), 1).otherwise(2)
    rows = links.where((U.scheme(link) == "https") & (board | (own & careerish & (link != page))))
    return rows.groupBy("page_id", "link").agg(
        F.min(rank).alias("lead_rank"), F.min("position").alias("position"))


def sitemap_urls(robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Page urls reached from the sitemaps an origin declares, child sitemaps included.

    ``robots``: (origin, body); ``sitemaps``: (url, xml). Child sitemaps are
    followed only where their name hints at postings; each sitemap is read once.
    """
    home = F.concat(F.col("origin"), F.lit("/"))
    usable = lambda u: F.startswith(u, home) & ~F.endswith(u, F.lit(".gz"))
    declared = F.filter(F.regexp_extract_all(
        F.coalesce("body", F.lit("")), F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)[ \t]*$"), 1), usable)
    start = checkpointed(robots.select("origin", F.explode(F.when(F.size(declared) > 0, declared).otherwise(
        F.array(F.concat(home, F.lit("sitemap.xml"))))).alias("url")).distinct())
    entries = sitemaps.select("url", F.explode(F.transform(
        F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1),
        lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))).alias("loc"))
    is_child = F.startswith(F.col("loc"), home) & F.col("loc").rlike(r"\.xml(?:$|\?)") & ~F.col("loc").endswith(".gz")
    pages, seen, todo = None, start, start
    while True:
        listed = todo.join(moved(entries), "url").withColumn("child", is_child)
        found = listed.where(~F.col("child")).select("origin", F.col("loc").alias("page_url"))
        pages = found if pages is None else pages.unionByName(found)
        hinted = listed.where(F.col("child") & F.col("loc").rlike(r"(?i)job|career|recruit|posting|position|saiyo"))
        todo = checkpointed(hinted.select("origin", F.col("loc").alias("url")).distinct().join(
            moved(seen), ["origin", "url"], "left_anti"))
        if todo.isEmpty():
            return pages.distinct()
        seen = seen.unionByName(todo)


def _under_careers(url: Column) -> Column:
    place = F.regexp_replace(U.path(url), "/$", "")
    folder = F.when(U.search(url) != "", place).otherwise(F.regexp_replace(place, "[^/]*$", ""))
    name = F.regexp_extract(place, "([^/]*)$", 1)
    return U.decoded(F.concat(folder, U.search(url))).rlike(U.CAREER) | U.decoded(name).rlike(U.CAREERS_ROOT)


def classify_sitemap(urls: DataFrame, japanese: bool = True, students: bool = False) -> DataFrame:
    """Posting details (many siblings of one shape) and the listings that name them, per site.

    Shapes are counted and their ranks taken from one example, so a site whose
    sitemap holds millions of postings is only counted, never collected. The urls
    are read many times below, so they are found once and kept.
    """
    url = F.col("url")
    under = checkpointed(urls.where(url.startswith("https://") & _under_careers(url)).select(
        "site_id", "url", U.url_shape(url).alias("shape")).distinct())
    example = U.decoded(F.min("url"))
    groups = under.groupBy("site_id", "shape").agg(
        F.count("*").alias("siblings"),
        F.when(example.rlike(U.STUDENT_PATH) == students, 0).otherwise(1).alias("audience_rank"),
        F.when(example.rlike(U.POSTING_PATH), 0).otherwise(1).alias("posting_rank")
    ).where(F.col("siblings") >= SIBLINGS)
    details = under.join(moved(groups), ["site_id", "shape"]).withColumn(
        "local", U.decoded(F.concat(U.path(url), U.search(url))).rlike(U.JAPANESE_PATH))
    if japanese:
        localized = details.groupBy("site_id").agg(F.bool_or("local").alias("has_local"))
        details = details.join(moved(localized), "site_id").where(F.col("local") | ~F.col("has_local")).drop("has_local")
    parent = F.concat(U.origin(url), F.regexp_replace(U.path(url), "[^/]+/?$", ""))
    parents = details.groupBy("site_id", parent.alias("parent")).agg(
        F.min("audience_rank").alias("audience_rank")).where(U.decoded(F.col("parent")).rlike(U.POSTING_PATH))
    present = under.select("site_id", F.concat(F.regexp_replace("url", "/$", ""), F.lit("/")).alias("slashed")).distinct()
    listings = (
        parents.withColumn("slashed", F.concat(F.regexp_replace("parent", "/$", ""), F.lit("/")))
        .join(moved(present), ["site_id", "slashed"], "left_semi")
        .join(moved(details.select("site_id", F.col("url").alias("parent"))), ["site_id", "parent"], "left_anti")
    )
    return details.select(
        "site_id", F.lit("detail").alias("kind"), "url", "audience_rank", "posting_rank", "siblings"
    ).unionByName(listings.select(
        "site_id", F.lit("listing").alias("kind"), F.col("parent").alias("url"), "audience_rank",
        F.lit(0).alias("posting_rank"), F.lit(0).cast("bigint").alias("siblings")))


def listing_pages(links: DataFrame) -> DataFrame:
    """Pages linking at least three urls of one shape, none of which is their own: landings, not postings."""
    shapes = links.select("page_id", "url", "link").distinct().groupBy(
        "page_id", "url", U.url_shape(F.col("link")).alias("shape")).agg(F.count("*").alias("n"))
    own = F.col("shape") == U.url_shape(F.col("url"))
    return shapes.where(F.col("n") >= LISTING_SIBLINGS).groupBy("page_id").agg(
        F.count("*").alias("sibling_shapes"), F.bool_or(own).alias("own_shape")
    ).where(~F.col("own_shape")).select("page_id", "sibling_shapes")


def reachable_pages(
    leads: DataFrame, links: DataFrame, max_hops: int = 3, budget: int | None = None
) -> DataFrame:
    """Pages reached from official leads over stored links, job sites first, each url once per company.

    ``leads``: (company_id, url, domain). A foreign page counts only if it is a
    board or named after the company's domain. A ``budget`` cuts the pages of a
    company over all hops together, leads aside; without one nothing is cut.
    """
    brand = F.regexp_extract("domain", r"^(?:www\.)?([a-z0-9-]{4,})", 1)
    frontier = leads.select("company_id", "domain", "url", F.lit(0).alias("hop")).distinct()
    visited = checkpointed(frontier)
    frontier = visited
    for hop in range(1, max_hops + 1):
        link = F.col("link")
        own = registrable_domain(U.host(link)) == registrable_domain(F.col("domain"))
        board = (U.site_kind(link) != "generic") & (U.path(link) != "/")
        named = (brand != "") & F.array_contains(F.split(U.host(link), "[.-]"), brand) & U.decoded(link).rlike(U.CAREER)
        stepped = (
            frontier.join(links.select("url", "link").distinct(), "url")
            .where((U.scheme(link) == "https") & (own | board | named))
            .groupBy("company_id", "domain", "link").agg(F.count("*").alias("seen"))
            .withColumn("job_site", F.when(U.site_kind(link) != "generic", 0).when(U.decoded(link).rlike(U.CAREER), 1).otherwise(2))
            .join(visited.select("company_id", F.col("url").alias("link")), ["company_id", "link"], "left_anti")
        )
        if budget is not None:
            used = visited.where("hop > 0").groupBy("company_id").agg(F.count("*").alias("used"))
            stepped = top_per_key(
                stepped, ["company_id"], [F.col("job_site").asc(), F.col("link").asc()], budget, rank="place"
            ).join(used, "company_id", "left").where(F.col("place") + F.coalesce("used", F.lit(0)) <= budget)
        frontier = checkpointed(stepped.select(
            "company_id", "domain", F.col("link").alias("url"), F.lit(hop).alias("hop")))
        visited = visited.unionByName(frontier)
    return visited


def lead_order(ranked: DataFrame, students: bool = False) -> DataFrame:
    """One ordered list of leads per company; a url keeps its best place.

    ``ranked``: (company_id, url, group_rank, place). Pages for another audience go last.
    """
    audience = F.when(U.decoded(F.col("url")).rlike(U.STUDENT_PATH) == students, 0).otherwise(1)
    best = ranked.groupBy("company_id", "url").agg(F.min(F.struct("group_rank", "place")).alias("best"))
    return best.select("company_id", "url", audience.alias("audience_rank"), "best.*")


# Crawl rules ---------------------------------------------------------------------------------

def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """Rules of each robots file that apply to the agent, its own groups before "*"."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    record = F.trim(F.regexp_replace("line", "#.*$", ""))
    parsed = lines.select(
        "origin", "n", F.lower(F.trim(F.regexp_extract(record, r"^([^:]*):", 1))).alias("key"),
        F.trim(F.regexp_extract(record, r"^[^:]*:(.*)$", 1)).alias("value")
    ).where(F.col("key").isin("user-agent", "allow", "disallow"))
    # A group starts at an agent line that follows a rule; one file is a short, bounded group.
    over = Window.partitionBy("origin").orderBy("n")
    is_agent = F.col("key") == "user-agent"
    starts = F.when(is_agent & (F.coalesce(F.lag("key").over(over), F.lit("")) != "user-agent"), 1).otherwise(0)
    grouped = parsed.withColumn("starts", starts).withColumn("group_no", F.sum("starts").over(over))
    agents = grouped.where(is_agent).groupBy("origin", "group_no").agg(
        F.bool_or(F.lower("value") == agent).alias("own"), F.bool_or(F.col("value") == "*").alias("everyone"))
    any_own = agents.groupBy("origin").agg(F.bool_or("own").alias("any_own"))
    usable = agents.join(any_own, "origin").where(
        F.when(F.col("any_own"), F.col("own")).otherwise(F.col("everyone"))).select("origin", "group_no")
    return grouped.where(~is_agent & (F.col("value") != "")).join(usable, ["origin", "group_no"]).select(
        "origin", (F.col("key") == "allow").alias("allow"), F.col("value").alias("rule"),
        U.plain_codes(F.col("value")).alias("plain_rule")).distinct()


def _rule_matches(place: Column, rule: Column) -> Column:
    """Prefix rules compare as text; only rules with a wildcard become patterns."""
    body = F.regexp_replace(rule, r"\$$", "")
    exact = F.endswith(rule, F.lit("$"))
    quoted = F.array_join(F.transform(F.split(body, r"\*"), lambda p: F.regexp_replace(
        p, r"([|\\{}()\[\]^$+?.])", r"\\$1")), ".*")
    pattern = F.concat(F.lit("^"), quoted, F.when(exact, "$").otherwise(""))
    return (F.when(F.contains(body, F.lit("*")), F.rlike(place, pattern))
            .when(exact, place == body).otherwise(F.startswith(place, body)))


def robots_decisions(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """allowed / disallowed / held per url; the longest rule wins and "allow" wins ties.

    Rules and paths meet in one spelling of their percent codes.

    ``robots``: (origin, status, body). A 4xx answer except 429 means no rules,
    any other failure holds the origin back.
    """
    rules = robots_rules(robots.where("status = 200"), agent)
    rows = urls.select("url_id", U.origin(F.col("url")).alias("origin"), U.plain_codes(
        F.concat(U.path(F.col("url")), U.search(F.col("url")))).alias("place"))
    matched = rows.join(rules, "origin").where(_rule_matches(F.col("place"), F.col("plain_rule")))
    winners = matched.groupBy("url_id").agg(
        F.max(F.struct(F.length("rule").alias("n"), "allow")).alias("w"))
    status = F.col("status")
    no_rules = status.between(400, 499) & (status != 429)
    return rows.join(robots.select("origin", "status"), "origin", "left").join(winners, "url_id", "left").select(
        "url_id",
        F.when(no_rules, "allowed").when(status.isNull() | (status != 200), "held")
        .when(F.coalesce("w.allow", F.lit(True)), "allowed").otherwise("disallowed").alias("decision"))
