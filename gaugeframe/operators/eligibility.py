"""Evidence joins: compile evidence by content hash and review decisions by pair decide who counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ledger_mismatch(expected: dict[str, Column], given: dict[str, Column], found: Column) -> Column:
    """Name of the first field of a review row that is not as expected; null if all are."""
    chain = F.when(~found, F.lit("missing"))
    for name, want in expected.items():
        chain = chain.when(~F.coalesce(given[name].eqNullSafe(want), F.lit(False)), F.lit(name))
    return chain


def decide(rows: DataFrame, evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows (item_id, kind in base/counter/variant, label, side, parent_id, pair_id, target_hash,
    contract_ok, statement_changed) with eligible, verified and reason.

    evidence: (target_hash, returncode), one row per hash; ledger: (pair_id, decision, policy,
    positive_hash, negative_hash, reviewed, validator, notes), one row per pair.
    """
    own = evidence.select("target_hash", F.col("returncode").alias("own_code"), F.lit(True).alias("_own"))
    parent = rows.select(F.col("item_id").alias("parent_id"), F.col("target_hash").alias("parent_hash"))
    parent_code = evidence.select(F.col("target_hash").alias("parent_hash"), F.col("returncode").alias("parent_code"))
    reviews = ledger.select("pair_id", "decision", "policy", F.col("positive_hash").alias("l_positive"), F.col("negative_hash").alias("l_negative"), F.col("reviewed").alias("l_reviewed"), F.col("validator"), F.col("notes"), F.lit(True).alias("_review"))
    joined = rows.join(own, "target_hash", "left").join(parent, "parent_id", "left").join(parent_code, "parent_hash", "left").join(reviews, "pair_id", "left")
    c = F.col
    filled = lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0
    counter = c("kind") == "counter"
    mismatch = ledger_mismatch(
        {"decision": F.lit("approve"), "policy": F.lit("pair-validity"), "positive_hash": c("parent_hash"), "negative_hash": c("target_hash"), "reviewed": F.lit(True), "validator": F.lit(True), "notes": F.lit(True)},
        {"decision": c("decision"), "policy": c("policy"), "positive_hash": c("l_positive"), "negative_hash": c("l_negative"), "reviewed": c("l_reviewed"), "validator": filled(c("validator")), "notes": filled(c("notes"))},
        F.coalesce(c("_review"), F.lit(False)),
    )
    joined = joined.withColumn("_mismatch", F.when(counter, mismatch))
    approved = joined.filter(counter).select("pair_id", c("_mismatch").isNull().alias("pair_approved")).groupBy("pair_id").agg(F.bool_and("pair_approved").alias("pair_approved"))
    joined = joined.join(approved, "pair_id", "left").withColumn("pair_approved", F.coalesce("pair_approved", F.lit(False)))
    own_ok, own_bad = F.coalesce(c("own_code") == 0, F.lit(False)), F.coalesce(c("own_code") != 0, F.lit(False))
    parent_ok, parent_bad = F.coalesce(c("parent_code") == 0, F.lit(False)), F.coalesce(c("parent_code") != 0, F.lit(False))
    negative = F.coalesce(c("side") == "negative", F.lit(False))
    needs = {
        "counter": [("parent_not_accepted", parent_ok), ("not_rejected", own_bad), ("statement_unchanged", c("statement_changed")), ("review", c("_mismatch").isNull())],
        "base": [("label", F.coalesce(c("label") == 1, F.lit(False))), ("not_accepted", own_ok)],
        "positive": [("contract", c("contract_ok")), ("parent_not_accepted", parent_ok), ("not_accepted", own_ok)],
        "negative": [("contract", c("contract_ok")), ("parent_not_rejected", parent_bad), ("not_rejected", own_bad), ("pair_not_approved", c("pair_approved"))],
    }
    which = F.when(c("kind") == "variant", F.when(negative, "negative").otherwise("positive")).otherwise(c("kind"))
    failed = F.lit(None).cast("string")
    for name, rules in needs.items():
        text = F.concat_ws(";", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules])
        failed = F.when(which == name, text).otherwise(failed)
    reason = F.when(which.isin(*needs), failed).otherwise(F.concat(F.lit("unknown_kind:"), F.coalesce(c("kind"), F.lit(""))))
    out = joined.withColumn("reason", reason).withColumn("eligible", reason == "").withColumn("verified", (reason == "") & which.isin("base", "positive"))
    return out.select(*rows.columns, "own_code", "parent_code", "pair_approved", "eligible", "verified", "reason")


def kind_report(decided: DataFrame) -> DataFrame:
    return decided.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.count_if("verified").alias("n_verified"))


def pair_structure(decided: DataFrame) -> DataFrame:
    """Per pair: eligible variants of each side and the approval; complete if both sides have one."""
    per = decided.filter("pair_id is not null").groupBy("pair_id").agg(F.count_if((F.col("kind") == "variant") & F.col("eligible") & (F.col("side") == "positive")).alias("positive"), F.count_if((F.col("kind") == "variant") & F.col("eligible") & (F.col("side") == "negative")).alias("negative"), F.bool_or("pair_approved").alias("approved"))
    return per.withColumn("complete", F.col("approved") & (F.col("positive") > 0) & (F.col("negative") > 0))


def timeout_closure(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every row with excluded: some row of its unit has a content hash whose check timed out."""
    timed_out = evidence.filter("returncode is null").select("target_hash")
    units = rows.join(timed_out, "target_hash", "left_semi").select("unit_id").distinct().withColumn("excluded", F.lit(True))
    return rows.join(units, "unit_id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def timeout_seconds(state: Column, returncode: Column, tail: Column) -> Column:
    """Seconds named by a timeout message; only for errors without a return code."""
    return F.when(returncode.isNull() & (state == "error"), F.try_to_number(F.nullif(F.regexp_extract(tail, r"after (\d+(?:\.\d+)?) seconds", 1), F.lit("")), F.lit("999999.999")).cast("double"))


def attrition(closure: DataFrame) -> DataFrame:
    """Rows, distinct hashes and units kept and excluded."""
    return closure.groupBy("excluded").agg(F.count("*").alias("n_rows"), F.count_distinct("target_hash").alias("n_hashes"), F.count_distinct("unit_id").alias("n_units"))


def verification_state(source_code: Column, target_code: Column, expect_accept: Column) -> Column:
    return (
        F.when(source_code.isNull() | target_code.isNull(), "error").when(source_code != 0, "unexpected")
        .when((target_code == 0) & expect_accept, "accepted").when((target_code != 0) & ~expect_accept, "rejected").otherwise("unexpected")
    )
