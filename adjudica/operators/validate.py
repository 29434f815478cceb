"""Validation of normalized fields: missing values, cross-field rules, plausibility, an explainable risk score."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from adjudica import settings as S
from adjudica.functions import normalize as N, text as X


def present(f: Column) -> Column:
    return F.coalesce(f["success"], F.lit(False)) & (F.coalesce(f["value"], F.lit("")) != "")


def tried(f: Column) -> Column:
    return F.coalesce(f["original"], F.lit("")) != ""


def codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in pairs]))


def normalize_fields(df: DataFrame, as_of: date, nfkc: X.NFKC = X.nfkc, out: str = "normalized") -> DataFrame:
    """Adds a struct of the ten normalized fields from string columns of their names."""
    return df.withColumn(out, N.all_fields({n: F.col(n) for n in S.FIELDS}, as_of, nfkc))


def not_provided(fields: Column) -> Column:
    """An insured amount that was never given says so."""
    own = fields["insured_amount"]
    none = F.struct(F.lit(None).cast("string").alias("original"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("success"), F.lit("not_provided").alias("notes"))
    return fields.withField("insured_amount", F.when(tried(own), own).otherwise(none))


def number_of(f: Column) -> Column:
    return X.let(F.array(f["value"], f["original"]), lambda x: F.coalesce(X.float_bare(F.get(x, 0)), X.float_bare(F.get(x, 1))))


def odd_phone(value: Column) -> Column:
    return X.let(X.digits(value), lambda own: (own != "") & (own.rlike(r"^(\d)\1*$") | F.endswith(own, F.lit("0000")) | F.startswith(own, F.lit("000"))))


def issues_of(f: Column) -> Column:
    return X.let(F.array(number_of(f["amount_estimated"]), number_of(f["insured_amount"])), lambda n: issues_with(f, F.get(n, 0), F.get(n, 1)))


def issues_with(f: Column, amount: Column, insured: Column) -> Column:
    both = amount.isNotNull() & insured.isNotNull()
    return codes(*[(~present(f[n]), f"{n}_missing") for n in S.REQUIRED], (amount.isNull(), "amount_missing_or_invalid"), (both & (amount > insured), "amount_exceeds_insured"), (both & (amount <= 0), "non_positive_amount"))


def warnings_of(f: Column, as_of: date, settings: S.Settings, several: Column | None = None) -> Column:
    day, dated = F.try_to_date(f["date"]["value"], "yyyy-MM-dd"), present(f["date"])
    today = F.lit(as_of)
    many = [(F.array_contains(several, n), f"{n}_multiple_candidates") for n in S.SEVERAL_CANDIDATES] if several is not None else []
    return codes(
        *many,
        (number_of(f["insured_amount"]).isNull(), "insured_amount_missing_or_invalid"),
        (~dated, "date_invalid_format"),
        (dated & day.isNull(), "date_validation_parse_failed"),
        (dated & (day > F.date_add(today, settings.future_days)), "date_in_future"),
        (dated & (day < F.date_sub(today, settings.old_days)), "date_too_old"),
        (tried(f["phone"]) & ~f["phone"]["success"], "phone_normalization_failed"),
        (odd_phone(F.coalesce(f["phone"]["value"], F.lit(""))), "phone_suspicious"),
        (tried(f["email"]) & ~f["email"]["success"], "email_normalization_failed"),
        (F.lower(F.coalesce(f["email"]["value"], F.lit(""))).rlike(S.ODD_DOMAIN_END), "email_domain_suspicious"),
    )


def low_confidence_of(f: Column, names: tuple[str, ...] = S.FIELDS) -> Column:
    """Fields that were tried and failed, in order of the fields."""
    return codes(*[(tried(f[n]) & ~F.coalesce(f[n]["success"], F.lit(False)), n) for n in names])


def is_low(score: Column, label: Column, settings: S.Settings = S.DEFAULTS) -> Column:
    """Of a field with a score or a label of its own."""
    return F.coalesce(score < settings.low_score, F.lit(False)) | F.coalesce(F.lower(label).isin(*S.WEAK_LABELS), F.lit(False))


def validate(df: DataFrame, as_of: date, fields_col: str = "normalized", out: str = "validation", settings: S.Settings = S.DEFAULTS, several_col: str | None = None) -> DataFrame:
    """Adds the validation struct. ``several_col``: names of the fields with more than one candidate."""
    several = F.col(several_col) if several_col else None

    def judged(f: Column) -> Column:
        missing = codes(*[(~present(f[n]), n) for n in S.REQUIRED])
        found = F.struct(issues_of(f).alias("issues"), warnings_of(f, as_of, settings, several).alias("warnings"), low_confidence_of(f).alias("low"), missing.alias("missing"))
        return X.let(found, lambda c: X.let(advice_of(c), lambda a: result_of(f, c, a, settings)))

    return df.withColumn(out, F.when(F.col(fields_col).isNotNull(), X.let(not_provided(F.col(fields_col)), judged)))


def advice_of(c: Column) -> Column:
    """struct<risk, advice>."""
    exceeds = F.array_contains(c["issues"], "amount_exceeds_insured")
    about_amount = F.size(F.filter(c["issues"], lambda i: F.contains(i, F.lit("amount")) | F.contains(i, F.lit("non_positive"))))
    risk = F.lit(0.10) + 0.20 * F.size(c["missing"]) + 0.18 * about_amount + 0.05 * F.size(c["warnings"]) + 0.05 * F.size(c["low"]) + F.when(exceeds, 0.35).otherwise(0.0)
    advice = lambda r: F.when(exceeds, "reject").when(F.size(c["missing"]) > 0, "review").when(r >= 0.7, "review").otherwise("approve")
    return X.let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)), lambda r: F.struct(r.alias("risk"), advice(r).alias("advice")))


# The reasons' sentences.
EXCEEDS, NOT_POSITIVE = "Claimed amount greater than insured amount.", "Claim amount is zero or negative."
ALL_VALID, SOME_WEAK, CRITICAL = "All required fields valid.", "Some fields need manual review.", "Critical violation detected."


def result_of(f: Column, c: Column, a: Column, settings: S.Settings) -> Column:
    given = F.array_compact(F.array(F.when(F.array_contains(c["issues"], "amount_exceeds_insured"), F.lit(EXCEEDS)), F.when(F.array_contains(c["issues"], "non_positive_amount"), F.lit(NOT_POSITIVE))))
    default = F.when(a["advice"] == "approve", ALL_VALID).when(a["advice"] == "review", SOME_WEAK).otherwise(CRITICAL)
    names = F.array(*[F.lit(n) for n in S.FIELDS])
    explained = F.struct(
        F.lit(settings.low_score).alias("low_confidence_threshold"),
        F.array_sort(c["low"]).alias("low_confidence_fields"),
        F.map_from_arrays(names, F.array(*[F.coalesce(f[n]["success"], F.lit(False)) for n in S.FIELDS])).alias("field_success_map"),
        F.map_from_arrays(names, F.array(*[F.coalesce(f[n]["notes"], F.lit("")) for n in S.FIELDS])).alias("field_notes"),
    )
    return F.struct(
        f.alias("fields"),
        F.array_sort(F.array_distinct(c["issues"])).alias("issues"),
        F.array_sort(F.array_distinct(c["warnings"])).alias("warnings"),
        F.array_sort(F.array_distinct(c["missing"])).alias("missing_required"),
        F.round(a["risk"], 3).alias("risk_score"),
        a["advice"].alias("recommendation"),
        X.let(given, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(default))).alias("decision_reasons"),
        (F.size(c["missing"]) == 0).alias("is_complete"),
        explained.alias("explainability"),
    )


def fallback(validation: Column) -> Column:
    """What stands for a claim whose fields could not be read: (issues, risk, recommendation)."""
    return F.struct(
        F.when(validation.isNull(), F.array(F.lit("validator_error"))).otherwise(validation["issues"]).alias("issues"),
        F.when(validation.isNull(), F.lit(1.0)).otherwise(validation["risk_score"]).alias("risk_score"),
        F.when(validation.isNull(), F.lit("review")).otherwise(validation["recommendation"]).alias("recommendation"),
    )
