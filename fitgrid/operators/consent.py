"""Versioned policies, consent decisions and legal acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrid.functions.axes import tenths
from fitgrid.operators.keyed import newest, split_lag, top_per_key


def current_policies(policies: DataFrame, at: Column) -> DataFrame:
    """Policy version in effect per purpose."""
    return top_per_key(
        policies.where(F.col("effective_at") <= at), ["purpose"], newest("effective_at", "policy_id"))


def latest_decisions(decisions: DataFrame, at: Column) -> DataFrame:
    return top_per_key(
        decisions.where(F.col("recorded_at") <= at), ["purpose", "user_id"],
        newest("recorded_at", "event_id"))


def consented_users(decisions: DataFrame, policies: DataFrame, at: Column) -> DataFrame:
    """Users whose latest decision grants the policy current at ``at``."""
    granted = latest_decisions(decisions, at).where("action = 'granted'")
    return granted.join(
        current_policies(policies, at).select("purpose", "policy_id"), ["purpose", "policy_id"]
    ).select("purpose", "user_id")


def consent_status(users: DataFrame, decisions: DataFrame, policies: DataFrame, at: Column) -> DataFrame:
    """Every user and current purpose, false where nothing was decided."""
    latest = latest_decisions(decisions, at).select(
        "purpose", "user_id", "action", F.col("policy_id").alias("decided_policy"), "recorded_at")
    granted = (F.col("action") == "granted") & (F.col("decided_policy") == F.col("policy_id"))
    # One entry per purpose: the purposes are a short reference list, users stay where they are.
    listed = current_policies(policies, at).agg(
        F.collect_list(F.struct("purpose", "policy_id", "version"))).scalar()
    every = users.select("user_id", listed.alias("p")).select("user_id", F.inline("p"))
    return every.join(latest, ["purpose", "user_id"], "left").select(
        "user_id", "purpose", "version", F.coalesce(granted, F.lit(False)).alias("granted"), "recorded_at")


def consent_changes(decisions: DataFrame) -> DataFrame:
    """Decisions that change something: no repeats, no withdrawal without a grant.

    After a grant the effective state is that grant, after a withdrawal it is
    "not granted", so the previous decision alone tells whether a row counts.
    """
    steps = split_lag(
        decisions.withColumn("hour", F.date_trunc("hour", "recorded_at")), ["purpose", "user_id"], "hour",
        ["recorded_at", "event_id"], ["action", "policy_id"])
    was_granted = F.coalesce(F.col("previous_action") == "granted", F.lit(False))
    repeats = was_granted & (F.col("previous_policy_id") == F.col("policy_id"))
    kept = F.when(F.col("action") == "granted", ~repeats).otherwise(was_granted)
    return steps.where(kept).select(*decisions.columns)


def consent_rate(consented: DataFrame, policies: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """Consented and total users per current purpose, percent to one place."""
    agreed = consented.groupBy("purpose").agg(F.count("*").alias("n"))
    total = users.agg(F.count("*")).scalar()
    n = F.coalesce("n", F.lit(0))
    return (
        current_policies(policies, at).join(agreed, "purpose", "left")
        .select("purpose", "version", n.alias("consented_users"), total.alias("total_users"))
        .withColumn("consent_percent", tenths(F.col("consented_users") * 100, F.col("total_users")))
    )


def current_documents(documents: DataFrame, at: Column) -> DataFrame:
    """Latest published and effective document per type."""
    live = documents.where((F.col("published_at") <= at) & (F.col("effective_at") <= at))
    return top_per_key(live, ["document_type"], newest("effective_at", "document_id"))


def required_action(document_type: Column) -> Column:
    return F.when(document_type == "terms", "accepted").otherwise("acknowledged")


def legal_status(users: DataFrame, documents: DataFrame, acknowledgements: DataFrame, at: Column) -> DataFrame:
    """Per user and current document: when the required action was first taken."""
    current = current_documents(documents, at).select(
        "document_type", "document_id", required_action(F.col("document_type")).alias("action"))
    done = acknowledgements.where(F.col("recorded_at") <= at).join(
        current, ["document_id", "action"], "left_semi"
    ).groupBy("user_id", "document_id").agg(F.min("recorded_at").alias("acted_at"))
    listed = current.agg(F.collect_list(F.struct("document_type", "document_id"))).scalar()
    every = users.select("user_id", listed.alias("d")).select("user_id", F.inline("d"))
    return every.join(done, ["user_id", "document_id"], "left")


def legal_history(documents: DataFrame, acknowledgements: DataFrame, limit: int = 100) -> DataFrame:
    """Newest acknowledgements per user with the document they belong to."""
    newest_first = top_per_key(
        acknowledgements, ["user_id"], newest("recorded_at", "event_id"), limit, rank="position")
    return newest_first.join(documents.select("document_id", "document_type"), "document_id").select(
        "user_id", "position", "document_id", "document_type", "action", "recorded_at")
