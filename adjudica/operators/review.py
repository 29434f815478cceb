"""The review queue as append-only tables: tasks, feedback, and the views that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica import settings as S


def reasons(validation: Column, confidences: Column | None, decision: Column, settings: S.Settings = S.DEFAULTS) -> Column:
    """Why a person must look. ``confidences``: a map of field to confidence, as text or number."""
    low = F.array().cast("array<string>")
    if confidences is not None:
        low = F.map_keys(F.map_filter(confidences, lambda k, v: F.coalesce(v.try_cast("double"), F.lit(1.0)) < settings.field_confidence))
    found = F.array_compact(F.array(
        F.when(F.size(validation["issues"]) > 0, F.lit("validation_issues")),
        F.when(F.size(validation["missing_required"]) > 0, F.lit("missing_required_fields")),
        F.when(F.size(low) > 0, F.concat(F.lit("low_confidence_fields: ['"), F.array_join(low, "', '"), F.lit("']"))),
        F.when(decision["decision"].isin("review", "escalate"), F.lit("decision_requires_human_review")),
        F.when(F.coalesce(decision["confidence"], F.lit(1.0)) < settings.review_confidence, F.lit("low_decision_confidence")),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unspecified_review_reason")))


def tasks(decided: DataFrame, created_at: Column, confidences_col: str | None = None) -> DataFrame:
    """A pending task for every claim that a person must see."""
    why = reasons(F.col("validation"), F.col(confidences_col) if confidences_col else None, F.col("decision"))
    return decided.filter("decision.requires_human").withColumns({"review_reasons": why, "status": F.lit("pending"), "created_at": created_at})


def latest(feedback: DataFrame, key: str = "claim_id", at: str = "reviewed_at", tie: str | None = None) -> DataFrame:
    """The last submission of each claim, combined before the shuffle; of those at one time the one with the largest
    ``tie``, else with the largest hash of its content."""
    rest = [c for c in feedback.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(F.col(at), F.col(tie) if tie else F.xxhash64(F.to_json(F.struct(*rest)))))
    return feedback.groupBy(key).agg(last.alias("_last")).select(*[key if c == key else F.col("_last")[c].alias(c) for c in feedback.columns])


def pending(all_tasks: DataFrame, feedback: DataFrame, key: str = "claim_id") -> DataFrame:
    return all_tasks.join(feedback.select(key).distinct(), key, "left_anti")


def orphans(feedback: DataFrame, all_tasks: DataFrame, key: str = "claim_id") -> DataFrame:
    """Feedback on claims that have no task: an error to report."""
    return feedback.join(all_tasks.select(key), key, "left_anti")


def chosen_value(inferred: Column, extracted: Column) -> Column:
    """What an editor shows of a field."""
    return F.coalesce(F.nullif(inferred, F.lit("")), F.nullif(extracted, F.lit("")))


def corrections(fields: Column) -> Column:
    """Only corrections that hold something."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))


def merged(fields: Column, corrected: Column) -> Column:
    """A map with each correction in its field's place."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(fields, empty), F.coalesce(corrected, empty), lambda k, old, new: F.coalesce(new, old))


def finals(all_tasks: DataFrame, feedback: DataFrame, finalized_at: Column, key: str = "claim_id") -> DataFrame:
    """claim, text, fields, decision, comments and reviewer after the last submission. Tasks have raw_text, fields
    (a map) and decision (text); feedback corrected_fields, corrected_text, overridden_decision, comments, reviewer."""
    joined = all_tasks.alias("t").join(latest(feedback, key).alias("f"), key, "left")
    return joined.select(
        key, finalized_at.alias("finalized_at"),
        F.coalesce(F.nullif(F.col("f.corrected_text"), F.lit("")), "t.raw_text").alias("raw_text"),
        merged(F.col("t.fields"), corrections(F.col("f.corrected_fields"))).alias("final_fields"),
        F.coalesce(F.nullif(F.col("f.overridden_decision"), F.lit("")), "t.decision").alias("final_decision"),
        F.col("f.comments").alias("review_comments"), F.col("f.reviewer").alias("reviewer"),
    )


def approve(claims: DataFrame, reviewer: str, reviewed_at: Column) -> DataFrame:
    return feedback_rows(claims, reviewer, reviewed_at, decision=F.lit("approve"))


def submit(claims: DataFrame, corrected: Column, reviewer: str, reviewed_at: Column) -> DataFrame:
    return feedback_rows(claims, reviewer, reviewed_at, corrected=corrections(corrected))


def override(claims: DataFrame, decision: str, reviewer: str, reviewed_at: Column, comments: str | None = None) -> DataFrame:
    return feedback_rows(claims, reviewer, reviewed_at, decision=F.lit(decision), comments=comments)


def feedback_rows(claims: DataFrame, reviewer: str, reviewed_at: Column, corrected: Column | None = None, decision: Column | None = None, comments: str | None = None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    fields = corrected if corrected is not None else F.lit(None).cast("map<string,string>")
    return claims.select("claim_id", fields.alias("corrected_fields"), nothing.alias("corrected_text"), (nothing if decision is None else decision).alias("overridden_decision"), F.lit(comments).cast("string").alias("comments"), F.lit(reviewer).alias("reviewer"), reviewed_at.alias("reviewed_at"), F.lit("review_completed").alias("status"))
