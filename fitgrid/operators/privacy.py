"""Ownership, pseudonyms, retention and erasure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.functions.urls import client_ip
from fitgrid.operators.keyed import newest, top_per_key


def owned_rows(child: DataFrame, parent: DataFrame, key: str, owners: DataFrame) -> DataFrame:
    """Child rows whose parent belongs to one of the owners."""
    own = parent.join(owners.select("user_id"), "user_id", "left_semi")
    return child.join(own.select(key), key, "left_semi")


def readable_results(requests: DataFrame, access: DataFrame, results: DataFrame, owners: DataFrame) -> DataFrame:
    """Discovery results an owner has access to; a request without results keeps its status row."""
    allowed = access.join(owners.select("user_id"), "user_id", "left_semi")
    return allowed.join(requests, "request_id").join(results, "request_id", "left")


def live_shares(shares: DataFrame) -> DataFrame:
    """The newest unrevoked link per match, without owner columns."""
    live = top_per_key(shares.where("revoked_at is null"), ["match_result_id"], newest("shared_at", "token"))
    return live.select("token", "shared_at", "match_result_id")


def prefecture_lookup(names: DataFrame, prefectures: DataFrame) -> DataFrame:
    """Codes of prefecture names; an unknown name gives an error row."""
    return names.join(F.broadcast(prefectures), "prefecture_name", "left").withColumn(
        "is_error", F.col("prefecture_code").isNull())


def _hash_block(secret: str, fill: int) -> Column:
    padded = secret.encode().ljust(64, b"\0")
    return F.unhex(F.lit(bytes(b ^ fill for b in padded).hex()))


def keyed_hash(secret: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, from two plain hashes; secrets of up to 64 bytes."""
    if len(secret.encode()) > 64:
        raise ValueError("the secret must not be longer than one hash block")
    inner = F.unhex(F.sha2(F.concat(_hash_block(secret, 0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(_hash_block(secret, 0x5C), inner), 256)


def daily_pseudonyms(events: DataFrame, secret: str) -> DataFrame:
    """Address and agent become keys that change with the UTC day; the raw values are dropped."""
    day = F.date_format("ts", "yyyy-MM-dd")
    def key(value: Column) -> Column:
        return F.when(value.isNotNull(), keyed_hash(secret, F.concat_ws("|", day, value)))
    agent = F.trim("user_agent")
    return events.select(
        "event_id", "user_id", key(client_ip(F.col("forwarded_for"))).alias("ip_key"),
        key(F.when(agent != "", agent)).alias("ua_key"))


def expired_texts(documents: DataFrame, now: Column, days: int, limit: int | None = None) -> DataFrame:
    """Document ids whose text is due for removal, oldest first when a run is bounded."""
    due = documents.where(F.col("text").isNotNull() & (F.col("fetched_at") <= now - F.expr(f"interval {days} days")))
    due = due.select("document_id", "fetched_at")
    if limit is not None:
        due = due.orderBy("fetched_at", "document_id").limit(limit)
    return due.select("document_id")


def retain_texts(documents: DataFrame, now: Column, days: int, limit: int | None = None) -> DataFrame:
    """Documents with due texts emptied; hash and times stay."""
    due = expired_texts(documents, now, days, limit).withColumn("due", F.lit(True))
    return documents.join(due, "document_id", "left").withColumn(
        "text", F.when(F.col("due").isNull(), F.col("text"))).drop("due")


def retention_split(events: DataFrame, days_by_kind: Mapping[str, int], now: Column) -> DataFrame:
    """Rows with a ``keep`` flag; the rule of a kind is its age limit in days."""
    days = F.lit(None).cast("int")
    for kind, limit in days_by_kind.items():
        days = F.when(F.col("kind") == kind, limit).otherwise(days)
    return events.withColumn(
        "keep", F.coalesce(F.col("ts") > now - F.make_dt_interval(days), F.lit(True)))


def erase_users(tables: Mapping[str, DataFrame], lineage: Mapping[str, tuple[str, str] | None],
                users: DataFrame) -> dict[str, DataFrame]:
    """Remaining rows per table after the users are removed.

    ``lineage`` names, per table, its parent and the key to it; None marks a
    table that carries ``user_id`` itself. Parents come before children.
    """
    gone: dict[str, DataFrame] = {}
    left: dict[str, DataFrame] = {}
    for name, parent in lineage.items():
        table = tables[name]
        if parent is None:
            removed, key = users.select("user_id"), "user_id"
        else:
            removed, key = gone[parent[0]].select(parent[1]).distinct(), parent[1]
        gone[name] = table.join(removed, key, "left_semi")
        left[name] = table.join(removed, key, "left_anti")
    return left


def erasure_report(tables: Mapping[str, DataFrame], left: Mapping[str, DataFrame]) -> DataFrame:
    report = None
    for name, rows in left.items():
        after = rows.agg(F.count("*")).scalar()
        line = tables[name].agg(F.count("*").alias("before_rows")).select(
            F.lit(name).alias("table_name"), "before_rows", after.alias("kept_rows")
        ).select("table_name", (F.col("before_rows") - F.col("kept_rows")).alias("removed_rows"), "kept_rows")
        report = line if report is None else report.unionByName(line)
    return report
