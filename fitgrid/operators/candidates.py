"""Companies and postings found for searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.functions.companies import bare_company, employment_fit, nfkc, role_terms, same_company
from fitgrid.operators.keyed import top_per_key
from fitgrid.session import checkpointed


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def contained_names(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of distinct names where the outer name contains the inner one.

    Every inner name is looked up by one of its three-letter pieces only, the
    one fewest outer names have; shorter names are looked up whole. The join is
    on equal pieces and the exact test follows, so no pair is missed and a
    frequent piece is used only by names that have nothing rarer.
    """
    size = F.least(F.length("inner"), F.lit(3))
    pieces = inner.where("inner <> ''").distinct().select("inner", F.explode(_grams(F.col("inner"), size)).alias("piece"))
    spans = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: n <= F.length("outer"))
    index = (
        outer.where("outer <> ''").distinct()
        .select("outer", F.explode(F.array_distinct(F.flatten(
            F.transform(spans, lambda n: _grams(F.col("outer"), n))))).alias("piece"))
        .join(pieces.select("piece").distinct(), "piece", "left_semi")
    )
    counts = index.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = (
        pieces.join(counts, "piece", "left")
        .groupBy("inner").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"))
    )
    return rarest.join(index, "piece").where(F.contains("outer", "inner")).select("inner", "outer")


def same_company_pairs(companies: DataFrame) -> DataFrame:
    """Pairs of folded names where one contains the other, with how many companies carry each.

    Companies of one name are counted, not paired with each other: a name held
    by very many companies stays one row.
    """
    named = companies.select(bare_company(nfkc("company_name")).alias("name")).where("name <> ''")
    counts = checkpointed(named.groupBy("name").agg(F.count("*").alias("companies")))
    pairs = contained_names(
        counts.select(F.col("name").alias("inner")), counts.select(F.col("name").alias("outer")))
    return (
        pairs.join(counts.select(F.col("name").alias("inner"), F.col("companies").alias("inner_companies")), "inner")
        .join(counts.select(F.col("name").alias("outer"), F.col("companies").alias("outer_companies")), "outer")
        .where((F.col("inner") != F.col("outer")) | (F.col("inner_companies") > 1))
        .select("inner", "outer", "inner_companies", "outer_companies")
    )


def known_postings(
    searches: DataFrame, companies: DataFrame, postings: DataFrame, employment_facts: DataFrame, limit: int
) -> DataFrame:
    """Stored postings of companies whose name contains the search or is contained in it."""
    asked = searches.select("query_id", F.lower(F.trim("company")).alias("asked"))
    named = companies.select("company_id", "company_name", F.lower("company_name").alias("named"))
    a, n = asked.select("asked"), named.select("named")
    wide = contained_names(a.toDF("inner"), n.toDF("outer")).toDF("asked", "named")
    narrow = contained_names(n.toDF("inner"), a.toDF("outer")).toDF("named", "asked")
    names = wide.unionByName(narrow).distinct()
    found = (
        asked.join(names, "asked").join(named, "named")
        .join(postings.select("job_posting_id", "company_id", "title", "url"), "company_id")
    )
    page = top_per_key(found, ["query_id"], [F.col("job_posting_id").desc()], limit, rank="position")
    types = top_per_key(
        employment_facts.where("status = 'known'"), ["job_posting_id"],
        [F.col("created_at").desc(), F.col("evaluation_id").desc()]
    ).select("job_posting_id", "employment_type")
    return page.join(types, "job_posting_id", "left").select(
        "query_id", "position", "job_posting_id", "company_name", "title", "url", "employment_type")


def priority_union(*sources: DataFrame) -> DataFrame:
    """Candidates of several sources; the earlier source wins a shared url."""
    rows = None
    for rank, source in enumerate(sources):
        part = source.withColumn("source_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    return top_per_key(rows, ["query_id", "url"], [F.col("source_rank").asc(), F.col("input_order").asc()])



def source_order(source: Column) -> Column:
    return (F.when(source == "official", 0).when(source == "ats", 1).when(source == "known", 2).otherwise(3))


def rank_candidates(searches: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """Same company, employment not contradicted, most role words first; ids c1 to cn per search."""
    asked = searches.select(
        "query_id", bare_company(nfkc("company")).alias("asked_company"),
        role_terms(nfkc(F.coalesce("role_query", F.lit("")))).alias("terms"), "employment_type")
    first = top_per_key(candidates, ["query_id", "url"], [F.col("input_order").asc()])
    rows = (
        first.withColumns({"folded_company": bare_company(nfkc("company_name")), "folded_title": F.lower(nfkc("title"))})
        .join(asked, "query_id")
        .where(same_company(F.col("asked_company"), F.col("folded_company")))
        .withColumn("fit", employment_fit(F.col("employment_type"), F.col("employment_types"), F.col("title")))
        .where(F.coalesce("fit", F.lit(True)))
        .withColumn("matched_terms", F.size(F.filter(
            "terms", lambda t: F.contains(F.col("folded_title"), t))))
        .withColumn("total_terms", F.size("terms"))
    )
    ranked = top_per_key(
        rows, ["query_id"],
        [F.col("matched_terms").desc(), source_order(F.col("source")).asc(), F.col("input_order").asc()],
        limit, rank="position")
    return ranked.select(
        "query_id", F.concat(F.lit("c"), F.col("position").cast("string")).alias("candidate_id"),
        "position", "url", "title", "company_name", "source", "matched_terms", "total_terms")


# When a semantic choice is accepted, and how many choices are shown.
MIN_CONFIDENCE, MAX_RUNNER_UP, SHOWN = 0.8, 0.15, 3


def decide_resolutions(
    searches: DataFrame, ranked: DataFrame, selections: DataFrame, listing_limit: int = SHOWN
) -> DataFrame:
    """One decision per search from its ranked candidates and an optional semantic choice.

    ``ranked`` holds at most the ranking limit per search; ``selections`` has
    (query_id, choice, confidence, probabilities map).
    """
    chosen = selections.select("query_id", "choice", "confidence", "probabilities")
    full = (F.col("total_terms") > 0) & (F.col("matched_terms") == F.col("total_terms"))
    share = F.coalesce(F.col("probabilities")[F.col("candidate_id")], F.lit(0.0))
    per_query = ranked.join(chosen, "query_id", "left").groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("total_terms").alias("total_terms"),
        F.count_if(full).alias("n_full"), F.min(F.when(full, F.col("candidate_id"))).alias("full_id"),
        F.bool_or(F.col("candidate_id") == F.col("choice")).alias("choice_exists"),
        F.array_sort(F.collect_list(F.struct("position", "candidate_id"))).alias("by_rank"),
        F.array_sort(F.collect_list(F.struct((-share).alias("p"), "position", "candidate_id"))).alias("by_share"))
    rows = searches.select("query_id").join(per_query, "query_id", "left").join(chosen, "query_id", "left")
    others = F.array_max(F.concat(F.array(F.lit(0.0)), F.map_values(F.map_filter(
        "probabilities", lambda k, v: k != F.col("choice")))))
    certainty = F.least("confidence", F.coalesce(F.col("probabilities")[F.col("choice")], F.lit(0.0)))
    confident = F.coalesce(F.col("choice_exists") & (certainty >= MIN_CONFIDENCE) & (others <= MAX_RUNNER_UP),
                           F.lit(False))
    none, listing, single = F.col("n").isNull(), F.col("total_terms") == 0, F.col("n_full") == 1
    reason = (F.when(none, "no_candidates").when(listing, "company_listing")
              .when(single, "single_full_match").when(confident, "confident_selection")
              .otherwise("ambiguous"))
    status = (F.when(none, "not_found").when(listing, "candidates")
              .when(single | confident, "resolved").otherwise("candidates"))
    def ids(name: str, n: int) -> Column:
        return F.array_join(F.transform(F.slice(name, 1, n), lambda c: c["candidate_id"]), ",")
    shown = (F.when(none, "").when(listing, ids("by_rank", listing_limit)).when(single, F.col("full_id"))
             .when(confident, F.col("choice")).when(F.col("choice").isNotNull(), ids("by_share", SHOWN))
             .otherwise(ids("by_rank", SHOWN)))
    more = (F.when(none | (~listing & (single | confident)), False)
            .otherwise(F.col("n") > F.when(listing, listing_limit).otherwise(SHOWN)))
    return rows.select("query_id", status.alias("status"), reason.alias("reason"),
                       shown.alias("candidate_ids"), more.alias("has_more"))


def valid_selections(selections: DataFrame, ranked: DataFrame) -> DataFrame:
    """Choices limited to the ids given; anything else becomes "none"."""
    given = ranked.select("query_id", F.col("candidate_id").alias("choice"), F.lit(True).alias("given"))
    return selections.join(given, ["query_id", "choice"], "left").withColumn(
        "choice", F.when(F.col("given"), F.col("choice")).otherwise("none")).drop("given")


# Registries and official sites ---------------------------------------------------------------

# Second levels of national domains under which names are registered.
_SECOND_LEVELS = ("co", "ne", "or", "ac", "go", "ed", "com", "net", "org")


def registrable_domain(host: Column) -> Column:
    """Last two labels, or three under a national second level such as co.jp."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    second = F.element_at(labels, F.when(n >= 2, -2).otherwise(-1))
    three = ((n >= 3) & second.isin(*_SECOND_LEVELS)
             & (F.length(F.element_at(labels, -1)) == 2))
    take = F.least(n, F.when(three, 3).otherwise(2))
    return F.array_join(F.slice(labels, n - take + 1, take), ".")


def registry_sites(searches: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries of exactly the asked name, if all of them agree on one domain."""
    asked = searches.select("query_id", bare_company(nfkc("company")).alias("name")).where("name <> ''")
    named = registry.where("site is not null and closed_on is null").select(
        bare_company(nfkc("company_name")).alias("name"),
        F.regexp_replace("site", "^http:", "https:").alias("site"))
    sites = named.withColumn(
        "domain", registrable_domain(F.regexp_extract("site", r"^https://([^/?#:]+)", 1))
    ).groupBy("name").agg(
        F.min("domain").alias("domain"), F.max("domain").alias("last_domain"),
        F.count("*").alias("records"), F.min("site").alias("site"))
    return asked.join(sites.where("domain = last_domain"), "name").select(
        "query_id", "domain", "site", "records")


def official_sites(searches: DataFrame, entities: DataFrame, claims: DataFrame, employer_types: list[str]) -> DataFrame:
    """Official sites of reference entities that are the asked employer.

    ``entities``: (entity_id, query_id, label, types, has_industry); ``claims``:
    (entity_id, claim_order, url, rank, languages). Sites in the asked language
    come first, then preferred ones, at most four per search.
    """
    usable = entities.where(
        ~F.array_contains("types", "disambiguation")
        & (F.arrays_overlap("types", F.array(*[F.lit(t) for t in employer_types])) | F.col("has_industry")))
    asked = searches.select("query_id", bare_company(nfkc("company")).alias("asked"),
                            F.col("company").rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]").alias("japanese"))
    named = usable.withColumn("named", bare_company(nfkc("label"))).join(asked, "query_id").where(
        same_company(F.col("asked"), F.col("named")))
    score = (F.when(F.col("japanese") & F.array_contains("languages", "ja"), 0).otherwise(2)
             + F.when(F.col("rank") == "preferred", 0).otherwise(1))
    rows = claims.where("rank <> 'deprecated'").join(
        named.select("entity_id", "query_id", "japanese"), "entity_id"
    ).withColumn("score", score).withColumn("url", F.regexp_replace("url", "^http:", "https:")) \
        .where(F.col("url").startswith("https:"))
    best = top_per_key(rows, ["query_id", "url"], [
        F.col("score").asc(), F.col("claim_order").asc(), F.col("entity_id").asc()])
    return top_per_key(
        best, ["query_id"], [F.col("score").asc(), F.col("claim_order").asc(), F.col("url").asc()], 4, rank="position"
    ).select("query_id", "position", "entity_id", "url", "score")
