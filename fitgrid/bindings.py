"""Domain tables derived from the test tables.

Integer rules only, so another engine can state the same rows (see
``plans/twins.py``). Times are zone-free; a Tokyo day is the date nine hours on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrid.schemas import RAW_TABLES, axis_array
from fitgrid.sources.tables import spread

AS_OF = "2024-01-31 00:00:00"
# Fixed value: parts per task where a part becomes a page or up to two dozen rows.
PART_PIECE = 50_000


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def tokyo_day(ts: Column) -> Column:
    return (ts + F.expr("interval 9 hours")).cast("date")


def code(number: Column) -> Column:
    """Two-digit prefecture code."""
    return F.lpad(number.cast("string"), 2, "0")


def abuse_rows(events: DataFrame) -> DataFrame:
    """Abuse events of a table or stream of events, with keys that change every day."""
    kind = F.col("event_type")
    k = F.regexp_extract("props", r"(\d+)", 1)
    day = F.col("ts").cast("date").cast("string")
    return events.select(
        "event_id", "user_id", "ts",
        F.when(kind == "click", "analysis_new").when(kind == "view", "analysis_cached")
        .when(kind == "error", "analysis_quota_rejected")
        .when(kind == "signup", "career_profile_saved").otherwise("share_created")
        .alias("event_type"),
        F.when(F.col("event_id") % 20 != 0, F.sha2(F.concat_ws("|", day, k), 256))
        .alias("ip_key"),
        F.sha2(F.concat_ws("|", day, (F.col("user_id") % 7).cast("string")), 256)
        .alias("ua_key"),
    )


class Domain:
    """Lazy domain tables over one directory of test tables.

    ``lines_by`` names a key of the evaluations (``l_orderkey`` or ``evaluation_id``)
    that order lines are dealt by before they are grouped: what is keyed by it next
    need not move a second time.
    """

    def __init__(self, spark: SparkSession, directory: str, lines_by: str | None = None):
        self.spark, self.directory, self.lines_by = spark, directory, lines_by

    def dealt_by(self, key: str) -> Domain:
        return Domain(self.spark, self.directory, key)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_TABLES[name]).parquet(f"{self.directory}/{name}.parquet")

    # People and profiles ------------------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"))

    @cached_property
    def profile_versions(self) -> DataFrame:
        o = self.raw("orders")
        # Version numbers grow with (date, key); no per-user ranking is needed for that.
        version = (F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("bigint")
                   * 1_000_000_000_000 + F.col("o_orderkey"))
        return o.select(
            F.col("o_orderkey").alias("profile_version_id"),
            F.col("o_custkey").alias("user_id"),
            version.alias("version"),
            F.when(F.col("o_orderkey") % 13 == 0, 2).otherwise(1).alias("axis_catalog_version"),
            F.when(F.col("o_orderstatus") == "P", "draft").otherwise("completed").alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def profile_axis_values(self) -> DataFrame:
        version, axis = F.col("profile_version_id"), F.col("axis_idx")
        return (
            self.raw("orders")
            .select(F.col("o_orderkey").alias("profile_version_id"), F.inline(axis_array()))
            .select(
                "profile_version_id", "axis_key",
                ((version * 7 + axis * 13) % 101).cast("int").alias("preference"),
                (((version + axis) % 5) * 25).cast("int").alias("importance"),
            )
        )

    @cached_property
    def target_roles(self) -> DataFrame:
        roles = F.array(F.struct(F.lit(1).alias("role_order"),
                                 F.col("o_orderpriority").alias("role_text")))
        second = F.array(F.struct(F.lit(2).alias("role_order"), F.lit("Engineer").alias("role_text")))
        both = F.when(F.col("o_orderkey") % 2 == 0, F.concat(roles, second)).otherwise(roles)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("profile_version_id"), F.inline(both))

    @cached_property
    def career_constraints(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.raw("orders").select(
            key.alias("profile_version_id"),
            F.when(key % 5 != 0, 3_000_000 + (key % 8) * 1_000_000).alias("min_salary"),
            F.when(key % 4 != 0, F.array(code(1 + key % 47), code(1 + (key * 5) % 47)))
            .alias("allowed_prefectures"),
            (key % 3 == 0).alias("full_remote_required"),
        )

    @cached_property
    def educations(self) -> DataFrame:
        key = F.col("c_custkey")
        years = F.array((2024 + (key * key) % 11).cast("int"), F.lit(2020))
        return (
            self.raw("customer").where(key % 6 != 0)
            .select(key.alias("user_id"), F.explode(years).alias("year"))
            .select("user_id", F.make_date("year", F.lit(3), F.lit(31)).alias("ended_on"))
        )

    # Companies, postings, evaluations -----------------------------------------------------

    @cached_property
    def companies(self) -> DataFrame:
        key, name = F.col("s_suppkey"), F.col("s_name")
        full = (F.when(key % 3 == 0, F.concat(F.lit("株式会社"), name))
                .when(key % 3 == 1, F.concat(name, F.lit(" Inc."))).otherwise(name))
        return self.raw("supplier").select(key.alias("company_id"), full.alias("company_name"))

    @cached_property
    def parts(self) -> DataFrame:
        """Parts for work that makes many rows or a page of each."""
        return spread(self.raw("part"), "p_partkey", piece=PART_PIECE)

    @cached_property
    def job_postings(self) -> DataFrame:
        return self.postings_of(self.raw("part"))

    def postings_of(self, parts: DataFrame) -> DataFrame:
        # The company of a posting is the part key folded onto the supplier keys.
        n = self.raw("supplier").agg(F.count("*")).scalar()
        key = F.col("p_partkey")
        return parts.select(
            key.alias("job_posting_id"),
            (key % n).alias("company_id"),
            F.concat_ws(" ", "p_name", "p_type").alias("title"),
            F.concat(F.lit("https://jobs.example.com/p/"), key.cast("string"),
                     F.lit("?utm_source=x")).alias("url"),
            F.array(F.when(key % 4 == 0, "PART_TIME").otherwise("FULL_TIME"))
            .alias("employment_types"),
        )

    @cached_property
    def company_queries(self) -> DataFrame:
        """One posting search per nation, by company name start and two role words."""
        s = self.raw("supplier").select("s_suppkey", F.substring("s_name", 1, 17).alias("company"))
        n = self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"))
        role = F.when(F.col("query_id") % 4 == 3, F.lit(None)).otherwise(
            F.element_at(F.array(*[F.lit(w) for w in ("red ECONOMY", "blue widget", "small PROMO")]),
                         (F.col("query_id") % 3 + 1).cast("int")))
        wanted = F.element_at(
            F.array(F.lit(None).cast("string"), F.lit("full_time"), F.lit("part_time")),
            (F.col("query_id") % 3 + 1).cast("int"))
        return n.join(s, n["query_id"] == s["s_suppkey"]).select(
            "query_id", "company", role.alias("role_query"), wanted.alias("employment_type"))

    @cached_property
    def job_conditions(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
        state = (F.when(key % 7 == 0, "unknown").when(key % 7 == 1, "conflicting")
                 .when(key % 7 == 2, "stale").otherwise("known"))
        return self.raw("part").select(
            key.alias("job_posting_id"), state.alias("salary_status"),
            (size * 200_000).alias("salary_minimum"),
            (size * 200_000 + 2_000_000).alias("salary_maximum"),
            F.when(key % 11 == 0, "USD").otherwise("JPY").alias("salary_currency"),
            F.lit("year").alias("salary_period"),
            F.when(key % 9 == 0, "unknown").otherwise("known").alias("location_status"),
            F.array(code(1 + key % 47)).alias("prefectures"),
            F.when(key % 8 == 0, "conflicting").otherwise("known").alias("remote_status"),
            (key % 2 == 0).alias("full_remote"),
        )

    @cached_property
    def evaluations(self) -> DataFrame:
        order, line = F.col("l_orderkey"), F.col("l_linenumber")
        lines, keys, identity = self.raw("lineitem"), ["l_orderkey", "l_linenumber"], (order * 10 + line).alias("evaluation_id")
        if self.lines_by == "evaluation_id":
            lines, keys = lines.repartition(order * 10 + line).select("*", identity), ["evaluation_id", *keys]
            identity = F.col("evaluation_id")
        else:
            lines = lines.repartition(self.lines_by) if self.lines_by else spread(lines, "l_orderkey")
        return (
            lines.groupBy(*keys)
            .agg(F.min("l_partkey").alias("job_posting_id"), F.min("l_suppkey").alias("company_id"),
                 F.max("l_shipdate").alias("created_at"))
            .select(
                identity, "l_orderkey",
                "job_posting_id", "company_id",
                F.when((line == 1) & (order % 4 == 0), "company").otherwise("job")
                .alias("target_type"),
                F.when(order % 17 == 0, 2).otherwise(1).alias("axis_catalog_version"),
                F.concat(F.lit("public-rules-v"), (order % 3 + 1).cast("string"))
                .alias("evaluator_version"),
                "created_at",
            )
        )

    @cached_property
    def evaluated_axis_values(self) -> DataFrame:
        kind = (F.col("job_posting_id") * 3 + F.col("company_id") + F.col("axis_idx") * 5) % 10
        rows = self.evaluations.select(
            "evaluation_id", "job_posting_id", "company_id", "axis_catalog_version", "created_at",
            F.inline(axis_array()))
        k = F.col("k")
        return (
            rows.withColumn("k", kind).where(k != 0)
            .select(
                "evaluation_id", "axis_key",
                F.when((F.col("evaluation_id") % 19 == 0) & (F.col("axis_idx") == 3), 2)
                .otherwise(F.col("axis_catalog_version")).alias("axis_version"),
                F.when(k == 1, "unknown").when(k == 2, "conflicting").when(k == 3, "stale")
                .when(k.isin(4, 5), "range").otherwise("known").alias("observation_status"),
                F.when(k.isin(3, 5, 7, 9), 50).when(k.isin(4, 6), 0).when(k == 8, 100)
                .alias("anchor_value"),
                F.when(k == 4, 50).when(k == 5, 100).alias("anchor_max"),
            )
        )

    @cached_property
    def evaluation_sources(self) -> DataFrame:
        key = F.col("evaluation_id")
        ages = F.array(key % 40, key % 90)
        return (
            self.evaluations.select("evaluation_id", "created_at", F.explode(ages).alias("days"))
            .select("evaluation_id", (F.col("created_at") - F.make_dt_interval(F.col("days").cast("int")))
                    .alias("fetched_at"))
        )

    @cached_property
    def requested_pairs(self) -> DataFrame:
        """Every completed profile with the evaluations asked for from it."""
        e = self.evaluations.withColumnRenamed("axis_catalog_version", "target_version")
        p = self.profile_versions.where("status = 'completed'").select(
            "profile_version_id", "user_id",
            F.col("axis_catalog_version").alias("profile_catalog_version"))
        return e.join(p, e["l_orderkey"] == p["profile_version_id"]).select(
            F.col("evaluation_id").alias("match_result_id"), "user_id", "profile_version_id",
            "evaluation_id", "job_posting_id", "company_id", "target_type",
            "profile_catalog_version", "target_version", "created_at")

    @cached_property
    def match_results(self) -> DataFrame:
        # An equality would become a key of the join, and lines dealt by the order alone would move again.
        same_version = F.col("profile_catalog_version").between(F.col("target_version"), F.col("target_version"))
        return self.requested_pairs.where((F.col("target_type") == "job") & same_version).select(
            "match_result_id", "user_id", "profile_version_id", "evaluation_id",
            "job_posting_id", "company_id", "created_at")

    @cached_property
    def analysis_jobs(self) -> DataFrame:
        key, state = F.col("o_orderkey"), F.col("o_orderstatus")
        status = F.when(state == "P", "queued").when(state == "O", "running").otherwise("completed")
        return self.raw("orders").select(
            key.alias("job_id"), F.col("o_custkey").alias("user_id"), (key % 500).alias("url_id"),
            status.alias("status"), (key % 5).cast("int").alias("attempts"),
            F.col("o_orderdate").alias("created_at"),
            F.when(state == "O", F.col("o_orderdate") + F.make_dt_interval((key % 30).cast("int")))
            .alias("lease_until"),
            F.when(state == "F", key * 10 + 2).alias("evaluation_id"),
        )

    @cached_property
    def job_runs(self) -> DataFrame:
        """When each job was queued, leased and ended: open orders wait or run, filled ones have ended."""
        key, state = F.col("o_orderkey"), F.col("o_orderstatus")
        hours = lambda n: F.make_dt_interval(hours=n.cast("int"))
        queued = F.col("o_orderdate") + F.make_dt_interval(mins=(key * 37 % 1440).cast("int"))
        leased = queued + hours(1 + key % 50)
        return self.raw("orders").select(
            key.alias("job_id"), queued.alias("queued_at"),
            F.when(state != "P", leased).alias("leased_at"),
            F.when(state != "P", leased + hours(key % 30)).alias("lease_until"),
            F.when(state == "F", leased + hours(key % 45))
            .when((state == "P") & (key % 3 == 0), queued + hours(key % 200)).alias("ended_at"))

    # Events -------------------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def abuse_events(self) -> DataFrame:
        return abuse_rows(self.events)

    @cached_property
    def consent_policies(self) -> DataFrame:
        # A small versioned reference table.
        rows = [(1, "community_benchmark", "1.0", "2023-12-01"),
                (2, "community_benchmark", "2.0", "2024-01-15"),
                (3, "community_benchmark", "3.0", "2024-03-01"),
                (4, "external_aggregate_use", "1.0", "2023-12-01")]
        return self.spark.createDataFrame(
            rows, "policy_id bigint, purpose string, version string, effective string"
        ).select("policy_id", "purpose", "version",
                 F.col("effective").cast("timestamp_ntz").alias("effective_at"))

    @cached_property
    def consent_events(self) -> DataFrame:
        ts, kind = F.col("ts"), F.col("event_type")
        return self.events.where(kind.isin("signup", "error")).select(
            "event_id", "user_id", F.lit("community_benchmark").alias("purpose"),
            F.when(ts < ntz("2024-01-15"), 1).otherwise(2).cast("bigint").alias("policy_id"),
            F.when(kind == "signup", "granted").otherwise("withdrawn").alias("action"),
            ts.alias("recorded_at"))

    @cached_property
    def requests(self) -> DataFrame:
        """Analysis requests: click asks for a new analysis, view may be served from store."""
        return self.events.where(F.col("event_type").isin("click", "view")).select(
            "event_id", "user_id", "ts", "event_type", (F.col("event_id") % 40).alias("url_id"))

    @cached_property
    def reservations(self) -> DataFrame:
        return self.events.select(
            "event_id", "ts", F.col("ts").cast("date").alias("usage_date"),
            (1 + F.col("event_id") % 7).alias("units"))

    @cached_property
    def http_requests(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            "event_id", "ts", kind.alias("route"),
            F.when((kind == "error") & (F.col("value") > 15), 500).otherwise(200).alias("status"),
            F.round(F.col("value") * 10).cast("bigint").alias("duration_ms"))

    @cached_property
    def company_interest(self) -> DataFrame:
        return self.events.where("event_type = 'view'").select(
            "user_id", (F.col("event_id") % 3).alias("company_id"), F.col("ts").alias("created_at"))

    # Text and pages -----------------------------------------------------------------------

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.raw("documents"), "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.raw("pages"), "page_id")

    @cached_property
    def posting_fragments(self) -> DataFrame:
        """Posting text per part, one row per fragment, written from the part's numbers."""
        key, size = F.col("p_partkey"), F.col("p_size")
        low, high = (300 + size * 5).cast("string"), (400 + size * 10).cast("string")
        prefectures = F.array(*[F.lit(p) for p in ("東京都", "大阪府", "北海道", "Yokohama", "福岡市")])
        place = F.element_at(prefectures, (key % 5 + 1).cast("int"))
        texts = [
            (1, "給与", F.when(key % 4 == 0, "月給 30万円").otherwise(
                F.concat(F.lit("年収 "), low, F.lit("万円〜"), high, F.lit("万円")))),
            (2, "働き方", F.when(key % 3 == 0, "週2日出社。").when(key % 3 == 1, "フルリモート可")
             .otherwise("原則出社です。")),
            (3, "勤務時間", F.when(key % 5 == 0, "コアタイムなし").when(key % 5 == 1, "フレックスタイム制")
             .otherwise("固定勤務時間")),
            (4, "給与", F.when(key % 10 == 1, "年収 500万円〜700万円").otherwise(F.lit(None))),
            (5, "勤務地", F.concat(F.lit("勤務地： "), place,
                                F.when(key % 6 == 0, "（将来的に変更）").otherwise(""),
                                F.lit(" 休日 土日"))),
            (6, "技術スタック", F.when(key % 2 == 0, F.concat(
                F.lit("技術スタック: "), F.col("p_brand"), F.lit("、Python"))).otherwise(
                "We use TypeScript and go fast with AWS")),
            (7, "雇用形態", F.when(key % 3 == 0, "雇用形態 正社員").when(key % 3 == 1, "雇用形態 業務委託")
             .otherwise("雇用形態は面談で決定")),
            (8, "求める人物像", F.concat(F.col("p_name"), F.lit(" の経験。連絡先 hr"), key.cast("string"),
                                   F.lit("@example.com"))),
            (9, "業務内容", F.concat(F.col("p_type"), F.lit(" の設計と開発"))),
        ]
        cells = F.array(*[
            F.struct(F.lit(pos).alias("position"), F.lit(section).alias("section"),
                     text.alias("text")) for pos, section, text in texts])
        return (self.parts.select(key.alias("document_id"), F.inline(cells))
                .where(F.col("text").isNotNull()))

    @cached_property
    def judgements(self) -> DataFrame:
        """Model weights per (document, axis); integer shares of a/(a+b+c), see FIXTURES."""
        key, axis = F.col("document_id"), F.col("axis_idx")
        return self.parts.select(
            F.col("p_partkey").alias("document_id"), F.inline(axis_array())
        ).select(
            "document_id", "axis_key", "axis_idx",
            (1 + (key * 7 + axis) % 40).alias("w0"),
            (1 + (key * 3 + axis * 11) % 25).alias("w50"),
            (1 + (key + axis * 5) % 10).alias("w100"))

    @cached_property
    def judgement_evidence(self) -> DataFrame:
        """Three cited fragments per (document, axis); weights out of 100."""
        key, axis, f = F.col("document_id"), F.col("axis_idx"), F.col("position")
        rows = self.judgements.select(
            "document_id", "axis_key", "axis_idx", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("position"))
        weight = (F.when(f == 1, 40 + (key + axis) % 21).when(f == 2, 15 + (key * 3 + axis) % 21)
                  .otherwise(5 + (key * 5 + axis * 3) % 21))
        text = (F.when((f == 1) & (key % 6 == 0), "変更の範囲：会社の定める業務")
                .when((f == 2) & (key % 4 == 0), "フレックスタイム制の勤務時間")
                .otherwise(F.lit("設計方針を自分で決める")))
        return rows.select("document_id", "axis_key", "position", weight.alias("weight"), text.alias("text"))
