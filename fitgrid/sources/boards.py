"""Posting lists of hosted boards, four providers with one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of each provider's answer that are read.
_SCHEMAS = {
    "greenhouse": "struct<jobs:array<struct<absolute_url:string,title:string,location:struct<name:string>>>>",
    "lever": "array<struct<hostedUrl:string,text:string,categories:struct<location:string,commitment:string>>>",
    "ashby": "struct<jobs:array<struct<jobUrl:string,title:string,location:string,employmentType:string,isListed:boolean>>>",
    "workable": ("struct<jobs:array<struct<title:string,shortcode:string,url:string,city:string,country:string,"
                 "employment_type:string>>>"),
}


def declared_type(text: Column) -> Column:
    """Free text of a board as a declared employment type, null when it names none."""
    plain = F.regexp_replace(F.lower(text), r"[\s_-]", "")
    return (F.when(plain.contains("intern"), "INTERN").when(plain.contains("parttime"), "PART_TIME")
            .when(plain.contains("contract") | plain.contains("temporary"), "CONTRACTOR")
            .when(plain.contains("fulltime") | plain.contains("permanent"), "FULL_TIME"))


def _posting(url: Column, title: Column, location: Column, kind: Column, listed: Column) -> Column:
    return F.struct(url.alias("url"), F.trim(title).alias("title"), location.alias("location"),
                    declared_type(kind).alias("employment_type"), listed.alias("listed"))


def board_postings(answers: DataFrame) -> DataFrame:
    """(provider, board_id, body) → one row per listed, titled https posting."""
    none, yes = F.lit(None).cast("string"), F.lit(True)

    def read(provider: str, items: str | None, shape) -> DataFrame:
        body = F.from_json("body", _SCHEMAS[provider])
        rows = answers.where(F.col("provider") == provider).select(
            "provider", "board_id", F.explode(body if items is None else body[items]).alias("j"))
        return rows.select("provider", "board_id", shape(F.col("j")).alias("p")).select("provider", "board_id", "p.*")

    parts = [
        read("greenhouse", "jobs", lambda j: _posting(
            j["absolute_url"], j["title"], j["location"]["name"], none, yes)),
        read("lever", None, lambda j: _posting(
            j["hostedUrl"], j["text"], j["categories"]["location"], j["categories"]["commitment"], yes)),
        read("ashby", "jobs", lambda j: _posting(
            j["jobUrl"], j["title"], j["location"], j["employmentType"], F.coalesce(j["isListed"], yes))),
        read("workable", "jobs", lambda j: _posting(
            F.coalesce(j["url"], F.concat(F.lit("https://apply.workable.com/"), F.col("board_id"),
                                          F.lit("/j/"), j["shortcode"], F.lit("/"))),
            j["title"], F.nullif(F.concat_ws(", ", F.nullif(j["city"], F.lit("")), F.nullif(j["country"], F.lit(""))),
                                 F.lit("")), j["employment_type"], yes)),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.where(F.col("listed") & F.col("url").startswith("https://") & (F.col("title") != "")).drop("listed")
