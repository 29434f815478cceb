"""The decision rules: amounts against each other, severe damage, doubtful fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica import settings as S
from adjudica.functions import text as X
from adjudica.operators.validate import low_confidence_of

FAILED = "named_struct('decision','review','confidence',0.4D,'requires_human',true,'reasons',array('decision_failed'),'evidence',named_struct('amount',cast(null as double),'insured_amount',cast(null as double),'low_confidence_fields',cast(array() as array<string>)),'flags',array('engine_error'))"


def decide(df: DataFrame, fields_col: str = "normalized", out: str = "decision") -> DataFrame:
    """Adds the decision struct; reasons and flags stand in the order of the rules."""
    return df.withColumn(out, X.let(F.col(fields_col), lambda f: F.when(f.isNotNull(), decision_of(f)).otherwise(F.expr(FAILED))))


def decision_of(f: Column) -> Column:
    read = F.struct(
        X.float_plain(f["amount_estimated"]["value"]).alias("amount"),
        X.float_plain(f["insured_amount"]["value"]).alias("insured_amount"),
        low_confidence_of(f).alias("low_confidence_fields"),
        F.lower(F.coalesce(f["damage"]["value"], F.lit(""))).rlike(S.SEVERE_DAMAGE).alias("severe"),
    )
    return X.let(read, lambda r: X.let(case_of(r["amount"], r["insured_amount"]), lambda case: decision_with(r, case)))


def case_of(amount: Column, insured: Column) -> Column:
    ratio = F.when(insured > 0, amount / insured).otherwise(0.0)
    return F.when(amount.isNull() | insured.isNull(), "unknown").when(amount <= 0, "nothing").when(amount > insured, "over").when(ratio >= 0.9, "near").otherwise("within")


def by_case(case: Column, rows: dict, rest) -> Column:
    out = F.lit(rest) if rest is not None else F.lit(None).cast("string")
    for name, value in rows.items():
        out = F.when(case == name, F.lit(value)).otherwise(out)
    return out


def decision_with(r: Column, case: Column) -> Column:
    doubtful = F.size(r["low_confidence_fields"]) > 0
    decision = by_case(case, {"nothing": "reject", "over": "reject", "within": "approve"}, "review")
    base = by_case(case, {"nothing": 0.95, "over": 0.95, "near": 0.75, "within": 0.9}, 0.45)
    reason = by_case(case, {"nothing": "non_positive_claim_amount", "over": "claimed_amount_exceeds_insured", "near": "amount_close_to_insured_limit", "within": "amount_within_insured_limit"}, "insufficient_amount_information")
    flag = by_case(case, {"nothing": "invalid_amount", "over": "over_limit", "near": "near_limit", "within": "within_limit"}, None)
    said = lambda condition, code: F.when(condition, F.lit(code))
    no_amount, no_insured = r["amount"].isNull(), r["insured_amount"].isNull()
    reasons = F.array(said(no_amount, "amount_missing_or_invalid"), said(no_insured, "insured_amount_missing_or_invalid"), said(r["severe"], "high_risk_damage_detected"), reason, said(doubtful, "low_confidence_fields_present"))
    flags = F.array(said(no_amount, "missing_amount"), said(no_insured, "missing_insured_amount"), said(r["severe"], "high_risk"), flag, said(doubtful, "low_confidence"))
    return F.struct(
        decision.alias("decision"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.when(doubtful, 0.2).otherwise(0.0))), 2).alias("confidence"),
        ((decision == "review") | doubtful).alias("requires_human"),
        F.array_compact(reasons).alias("reasons"),
        r.dropFields("severe").alias("evidence"),
        F.array_compact(flags).alias("flags"),
    )
