"""Page corpora: fragments, snapshots, structured postings, verification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.functions import html as H
from fitgrid.functions import urls as U
from fitgrid.functions.companies import bare_company, nfkc, same_company
from fitgrid.functions.text import squeezed
from fitgrid.operators.keyed import split_lag, split_row_number
from fitgrid.session import checkpointed

MIN_JOB_CHARACTERS = 100


def page_fragments(pages: DataFrame) -> DataFrame:
    """Pages → visible fragments in page order; Python sees one Arrow batch of pages at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page_id, *row) for page_id, html in zip(batch["page_id"], batch["html"])
                    for row in H.page_fragments(html or "")]
            yield pd.DataFrame(rows, columns=["page_id", "scope", "position", "text", "locator", "section"])
    return pages.select("page_id", "html").mapInPandas(
        run, "page_id bigint, scope string, position int, text string, locator string, section string")


# Headings of lists of other postings.
_RELATED = (
    r"(?iu)(?:^|\s)(?:関連求人|関連ポジション|その他の求人|その他のポジション|おすすめ求人|おすすめのポジション|"
    r"同じ会社の求人|(?:related|other|similar)\s+(?:jobs|positions|openings))(?:\s|$)")


def trim_related(fragments: DataFrame) -> DataFrame:
    """Cut a page's job fragments at the first "related jobs" marker at least 100 characters in."""
    before = Window.partitionBy("page_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    marker = F.regexp_instr("text", F.lit(_RELATED)) - 1
    offset = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    marked = fragments.where("scope = 'job'").withColumn("marker", marker).withColumn("offset", offset)
    ends = (F.col("marker") >= 0) & (F.col("offset") + F.col("marker") >= MIN_JOB_CHARACTERS)
    first = F.min(F.when(ends, F.struct("position", "marker"))).over(Window.partitionBy("page_id"))
    kept = marked.withColumn("cut", first).where(
        F.col("cut").isNull() | (F.col("position") <= F.col("cut.position")))
    text = F.when(F.col("position") == F.col("cut.position"),
                  F.trim(F.expr("substring(text, 1, cut.marker)"))).otherwise(F.col("text"))
    return kept.withColumn("text", text).where("text <> ''").select(*fragments.columns)


def page_texts(fragments: DataFrame) -> DataFrame:
    """One row per page: job text, content hash over all scopes, and whether the text suffices."""
    def text_of(scope: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("scope") == scope, F.struct("position", "text"))))
        return F.array_join(F.transform(rows, lambda r: r["text"]), " ")
    return fragments.groupBy("page_id").agg(
        text_of("job").alias("job_text"), text_of("company").alias("company_text"),
        F.count("*").alias("fragments")
    ).select(
        "page_id", "fragments", "job_text",
        F.sha2(F.concat_ws("\n\n", "job_text", "company_text"), 256).alias("content_hash"),
        (F.length(F.regexp_replace("job_text", r"[\s　]", "")) >= MIN_JOB_CHARACTERS).alias("sufficient"))


def page_snapshots(pages: DataFrame, texts: DataFrame, bucket: int = 4096) -> DataFrame:
    """Version number per url and a changed flag against the version before, in page order."""
    # Hashes are read several times below; the pages behind them are parsed once.
    hashes = checkpointed(texts.select("page_id", "content_hash", "sufficient"))
    rows = pages.select("page_id", "url").join(hashes, "page_id") \
        .withColumn("bucket", F.floor(F.col("page_id") / bucket))
    numbered = split_row_number(rows, ["url"], "bucket", ["page_id"], "version")
    stepped = split_lag(numbered, ["url"], "bucket", ["page_id"], ["content_hash"])
    return stepped.select(
        "page_id", "url", "version", "content_hash", "sufficient",
        (~F.col("content_hash").eqNullSafe(F.col("previous_content_hash"))).alias("changed"))


# Structured data -----------------------------------------------------------------------------

_LD_SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
# The declared employment types that are kept.
_TYPES = ("FULL_TIME", "PART_TIME", "CONTRACTOR", "TEMPORARY", "INTERN", "VOLUNTEER", "PER_DIEM", "OTHER")


def _items(node: Column) -> Column:
    """The elements of a JSON array, or the one value, as an array of variants."""
    return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array(node))


def _text(node: Column, path: str) -> Column:
    """A member that is text, else null."""
    value = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(node, path, "string"))


def _texts(node: Column, path: str) -> Column:
    value = F.try_variant_get(node, path, "variant")
    listed = F.filter(_items(value), lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(
        F.transform(listed, lambda v: F.try_variant_get(v, "$", "string")))


def structured_nodes(pages: DataFrame) -> DataFrame:
    """Every JSON-LD node of every page: top-level arrays and graphs are flattened."""
    scripts = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_LD_SCRIPT), 1)).alias("script"))
    top = scripts.select("page_id", F.explode(_items(F.try_parse_json("script"))).alias("node"))
    graph = F.try_variant_get("node", "$['@graph']", "array<variant>")
    return top.select("page_id", F.explode(F.concat(
        F.array("node"), F.coalesce(graph, F.array().cast("array<variant>")))).alias("node"))


def structured_postings(pages: DataFrame) -> DataFrame:
    """One row per declared job posting of a page."""
    node = F.col("node")
    organization = F.coalesce(_text(node, "$.hiringOrganization"), _text(node, "$.hiringOrganization.name"))
    types = F.transform(_texts(node, "$.employmentType"),
                        lambda t: F.regexp_replace(F.upper(t), r"[\s-]+", "_"))
    # A place may be given as plain text or as region and locality.
    places = F.flatten(F.transform(
        _items(F.try_variant_get(node, "$.jobLocation", "variant")),
        lambda p: F.array_compact(F.array(
            _text(p, "$.address"), _text(p, "$.address.addressRegion"), _text(p, "$.address.addressLocality")))))
    remote = F.exists(_texts(node, "$.jobLocationType"), lambda t: F.upper(t) == "TELECOMMUTE")
    return (
        structured_nodes(pages).where(F.array_contains(_texts(node, "$['@type']"), "JobPosting"))
        .select(
            "page_id", F.trim(_text(node, "$.title")).alias("title"), F.trim(organization).alias("employer"),
            F.filter(types, lambda t: t.isin(*_TYPES)).alias("employment_types"),
            F.coalesce(places, F.array().cast("array<string>")).alias("regions"), remote.alias("telecommute"),
            _texts(node, "$.hiringOrganization.url").alias("organization_urls"),
            F.to_timestamp_ntz(F.substring(_text(node, "$.validThrough"), 1, 10), F.lit("yyyy-MM-dd")).alias("valid_through"))
        .where((F.col("title") != "") & (F.col("employer") != ""))
    )


def page_postings(pages: DataFrame) -> DataFrame:
    """The posting a page is about; a page declaring several different jobs has none."""
    name = F.struct("title", "employer")
    rows = structured_postings(pages).groupBy("page_id").agg(
        F.min(name).alias("low"), F.max(name).alias("high"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("employment_types")))).alias("employment_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("regions")))).alias("regions"),
        F.bool_or("telecommute").alias("telecommute"))
    return rows.where("low = high").select("page_id", "low.*", "employment_types", "regions", "telecommute")


# Identity and verification by page evidence ---------------------------------------------------

# Headings, titles, markers and paths that tell postings from other careers pages.
_LISTING_HEADING = (
    r"(?iu)^(?:採用情報|採用サイト|キャリア採用|中途採用|新卒採用|求人(?:情報|一覧)?|募集(?:職種|要項)?(?:一覧)?|職種一覧|"
    r"ポジション一覧|careers?|jobs?|open (?:positions|roles)|join us|recruit(?:ing|ment)?)$")
_POSTING_PARTS = (
    r"(?iu)業務内容|仕事内容|職務内容|responsibilit",
    r"(?iu)応募資格|必須(?:スキル|要件|条件|経験)|求める|歓迎|requirements?|qualifications?",
    r"(?iu)勤務地|work\s*location", r"(?iu)給与|年収|月給|報酬|salary|compensation",
    r"(?iu)雇用形態|employment\s*type", r"(?iu)勤務時間|就業時間|working\s*hours")
_JOB_MARKERS = (
    r"(?iu)仕事内容|業務内容|職務内容|職務概要|job description|responsibilities|what you['’]ll do",
    r"(?iu)応募資格|必須要件|応募要件|求める人物|requirements|qualifications|what you['’]ll need",
    r"(?iu)勤務地|勤務場所|work location|locations?",
    r"(?iu)雇用形態|正社員|契約社員|employment type|full[- ]time|part[- ]time",
    r"(?iu)給与|年収|月給|salary|compensation|pay range",
    r"(?iu)応募する|エントリー|応募はこちら|apply now|apply for|submit application")
_CLOSED = (
    r"(?iu)募集(?:は|を)?終了|受付(?:は|を)?終了|掲載(?:は|を)?終了|このポジションは(?:充足|終了)|no longer accepting|"
    r"position (?:has been )?(?:closed|filled)|job (?:is )?(?:closed|expired)")
_OPEN = (
    r"(?iu)(?:プレ)?エントリー(?:を)?受付中|応募受付中|募集中|applications? (?:are )?open|apply now|pre-?entry")
_GENERIC_TITLE = (
    r"(?iu)^(?:採用情報|求人一覧|募集職種(?:を探す)?|募集ポジション|キャリア採用|中途採用|新卒採用|careers?|jobs?|"
    r"job search|search jobs|open positions?)$")
_CAREERS_SITE_TITLE = (
    r"(?iu)採用(?:サイト|情報|ページ)|よくある(?:質問|ご質問)|(?<![A-Za-z0-9_])faq(?![A-Za-z0-9_])|"
    r"^(?:かんたん)?(?:応募|エントリー)(?:フォーム)?$")
_HIRING_TRACK = r"(?u)^[^\s]{0,10}採用(?:[・/／][^\s]{0,10}採用)*$"
_LISTING_URL = r"(?i)(?:jobsearch|job-categories|/jobs?/?$|/careers?/?$|/recruit(?:ing|ment)?/?$)"
_CAREERS_ROOT_URL = r"(?i)/(?:careers?|jobs?|recruit(?:ing|ment)?|saiyou?)(?:/index\.html?)?/?$"
_RECRUITMENT_PATH = (
    r"(?i)(?:^|/)(?:recruit(?:ing|ment)?|careers|jobs|newgrads?|new-grads?|graduates?|entry-level|join-us)"
    r"(?:/|$|[-_.])")
_EMPLOYMENT_TEXT = {
    "new_grad": r"新卒|新卒採用|new.?grad|graduate|entry.?level", "intern": r"インターン|internship?|intern",
    "full_time": r"中途|キャリア採用|正社員|full.?time|experienced hire", "contract": r"契約社員|業務委託|contract",
    "part_time": r"アルバイト|パート|part.?time"}


def _count(text: Column, patterns) -> Column:
    total = F.lit(0)
    for pattern in patterns:
        total = total + F.when(text.rlike(pattern), 1).otherwise(0)
    return total


def _tag_texts(html: Column, tag: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)
    return F.filter(F.transform(found, lambda t: squeezed(F.regexp_replace(t, "<[^>]*>", " "))), lambda t: t != "")


def _meta(html: Column, key: str, name: str) -> Column:
    tag = F.regexp_extract(html, rf"""(?is)<meta(?=[^>]*{key}\s*=\s*["']{name}["'])[^>]*content\s*=\s*["']([^"']*)["']""", 1)
    text = squeezed(tag)
    return F.when(text != "", text)


def visible_text(html: Column) -> Column:
    """Page text with scripts, styles and tags removed by expression."""
    dropped = F.regexp_replace(html, r"(?is)<(script|style|template|noscript)(?:\s[^>]*)?>.*?</\1>", " ")
    return squeezed(F.regexp_replace(F.regexp_replace(dropped, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " "))


def page_identities(pages: DataFrame) -> DataFrame:
    """Title and employer a page states about itself; every condition must hold."""
    html = F.col("html")
    organizations = structured_nodes(pages).where(
        F.array_contains(_texts(F.col("node"), "$['@type']"), "Organization")
    ).groupBy("page_id").agg(F.min(_text(F.col("node"), "$.name")).alias("low"),
                             F.max(_text(F.col("node"), "$.name")).alias("high"))
    rows = pages.join(organizations, "page_id", "left").select(
        "page_id", _tag_texts(html, "h1").alias("headings"),
        F.coalesce(_meta(html, "property", "og:site_name"),
                   F.when(F.col("low") == F.col("high"), F.col("low"))).alias("employer"),
        F.array_compact(F.array(F.get(_tag_texts(html, "title"), F.lit(0)), _meta(html, "property", "og:title"))).alias("titles"),
        _count(visible_text(html), _POSTING_PARTS).alias("parts"))
    title = F.get("headings", F.lit(0))
    named = F.exists("titles", lambda t: F.contains(t, title) & F.contains(t, F.col("employer")))
    return rows.where(
        (F.size("headings") == 1) & (F.length(title) <= 200) & ~title.rlike(_LISTING_HEADING)
        & F.col("employer").isNotNull() & (F.length("employer") <= 200) & named & (F.col("parts") >= 2)
    ).select("page_id", title.alias("title"), "employer")


def _posting_title(headings: Column, company: Column, wanted: Column) -> Column:
    """First part of a title source that names a job rather than the site or the employer."""
    parts = F.filter(F.flatten(F.transform(headings, lambda h: F.split(
        h, r"\s*(?:\||｜|–|—)\s*|\s+-\s+"))), lambda p: F.trim(p) != "")
    employed = F.lit(False)
    def fits(part: Column) -> Column:
        answer = employed
        for kind, pattern in _EMPLOYMENT_TEXT.items():
            answer = answer | ((wanted == kind) & part.rlike(f"(?iu){pattern}"))
        return F.coalesce(answer, F.lit(False))
    def own_name(part: Column) -> Column:
        bare = bare_company(part)
        rest = F.replace(bare, company, F.lit(""))
        return (company != "") & F.contains(bare, company) & rest.rlike("^[a-z0-9&]{0,5}$")
    by_type = F.get(F.filter(parts, fits), F.lit(0))
    by_name = F.get(F.filter(parts, lambda p: ~p.rlike(_GENERIC_TITLE) & ~own_name(p)
                             & F.length(F.trim(p)).between(2, 300)), F.lit(0))
    return F.trim(F.coalesce(by_type, by_name))


def verify_postings(candidates: DataFrame, now: Column) -> DataFrame:
    """Candidate pages → accepted posting with its source kind, or the reason against it.

    ``candidates``: (page_id, url, html, company, employment_type).
    """
    declared = structured_postings(candidates)
    name = F.struct("title", "employer")
    per_page = declared.groupBy("page_id").agg(
        F.count_distinct(name).alias("postings"),
        F.min(F.struct("title", "employer", "valid_through", "organization_urls")).alias("ld"))
    html, url = F.col("html"), F.col("url")
    text = visible_text(html)
    features = candidates.select(
        "page_id", "url", "company", "employment_type",
        bare_company(nfkc("company")).alias("asked"),
        F.array_compact(F.array(
            F.get(_tag_texts(html, "h1"), F.lit(0)), _meta(html, "property", "og:title"),
            _meta(html, "name", "twitter:title"), F.get(_tag_texts(html, "title"), F.lit(0)))).alias("titles"),
        _meta(html, "property", "og:site_name").alias("site_name"), text.alias("text"),
        U.site_kind(url).alias("site_kind"))
    t = F.col("text")
    title = _posting_title(F.col("titles"), F.col("asked"), F.col("employment_type"))
    wanted_words = F.lit(False)
    for kind, pattern in _EMPLOYMENT_TEXT.items():
        wanted_words = wanted_words | ((F.col("employment_type") == kind) & t.rlike(f"(?iu){pattern}"))
    rows = features.join(per_page, "page_id", "left").select(
        "*", title.alias("page_title"), t.rlike(_CLOSED).alias("closed"), t.rlike(_OPEN).alias("open"),
        _count(t, _JOB_MARKERS).alias("markers"),
        F.coalesce(wanted_words, F.lit(False)).alias("wanted"),
        F.coalesce(same_company(F.col("asked"), bare_company(F.col("site_name"))), F.lit(False)).alias("own_site"))
    place = F.concat(U.path(url), U.search(url))
    ats = F.col("site_kind") != "generic"
    detail = place.rlike(U.DETAIL_PATH) & ~url.rlike(_LISTING_URL)
    landing = U.path(url).rlike(_RECRUITMENT_PATH) & F.col("wanted") & (F.col("markers") >= 1)
    evidence = (same_company(F.col("asked"), bare_company(F.concat_ws(" ", "site_name", F.array_join("titles", " "))))
                | F.contains(bare_company(t), F.col("asked")))
    titled = (F.col("page_title").isNotNull() & ~F.col("page_title").rlike(_CAREERS_SITE_TITLE)
              & ~F.coalesce(F.col("page_title") == F.col("site_name"), F.lit(False)))
    enough = ((~F.col("page_title").rlike(_HIRING_TRACK) & (F.col("markers") >= 2)
               & ((ats & F.coalesce(U.is_posting(url), F.lit(True))) | detail
                  | (F.col("own_site") & ~U.path(url).rlike(_CAREERS_ROOT_URL)))) | landing)
    generic_ok = F.coalesce(titled & evidence & enough, F.lit(False))
    n = F.coalesce("postings", F.lit(0))
    reason = (
        F.when(n > 1, "multiple_postings")
        .when((n == 0) & F.col("closed") & ~F.col("open"), "closed")
        .when((n == 0) & ~generic_ok, "not_job_posting")
        .when((n == 1) & F.col("closed"), "closed")
        .when((n == 1) & ~same_company(F.col("asked"), bare_company(F.col("ld.employer"))), "company_mismatch")
        .when((n == 1) & (F.col("ld.valid_through") < now), "expired"))
    page_host = F.regexp_replace(U.host(url), r"^www\.", "")
    named_by_org = F.exists("ld.organization_urls", lambda o: (
        (page_host == F.regexp_replace(U.host(o), r"^www\.", ""))
        | F.endswith(page_host, F.concat(F.lit("."), F.regexp_replace(U.host(o), r"^www\.", "")))))
    official = F.when(n == 1, F.coalesce(named_by_org, F.lit(False))).otherwise(F.col("own_site") | landing)
    return rows.select(
        "page_id", "url", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("verdict"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.when(ats, "ats").when(official, "official").otherwise("web")).alias("source_kind"),
        F.when(reason.isNull(), F.when(n == 1, F.col("ld.title")).otherwise(F.col("page_title"))).alias("title"))


def rejection_breakdown(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("pages"))
