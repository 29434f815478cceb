"""Normalizers: a raw string in, struct<original, value, success, notes> out; a failed value is '' and never null."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from adjudica import settings as S
from adjudica.functions import text as X

OUT = "struct<original:string,value:string,success:boolean,notes:string>"


def outcome(raw: Column, value: Column | None, notes: Column | str) -> Column:
    kept = F.lit("") if value is None else F.coalesce(value, F.lit(""))
    notes = F.lit(notes) if isinstance(notes, str) else notes
    return F.struct(raw.alias("original"), kept.alias("value"), F.lit(value is not None).alias("success"), notes.alias("notes"))


def is_empty(raw: Column) -> Column:
    return raw.isNull() | (raw == "")


def amount(raw: Column, nfkc: X.NFKC = X.nfkc, settings: S.Settings = S.DEFAULTS) -> Column:
    bare = F.regexp_replace(X.repair_digits(X.strip(X.clean_unicode(raw, nfkc))), r"(?i)(Rs\.?|₹|INR|USD|\$)", "")
    parsed = X.found(F.translate(bare, ", ", ""), r"(?U)-?\d+(\.\d+)?", 0).try_cast("double")
    return X.let(
        parsed,
        lambda number: F.when(is_empty(raw), outcome(raw, None, "empty_input"))
        .when(number.isNull(), outcome(raw, None, "no_numeric_found"))
        .when(F.abs(number) > settings.max_amount, outcome(raw, None, "unrealistic_amount"))
        .otherwise(outcome(raw, X.two_places(number), "normalized")),
    )


def date_text(raw: Column, as_of: date, nfkc: X.NFKC = X.nfkc) -> Column:
    """ISO text stays as it is. Else yyyyMMdd, y-m-d, and month-first n-n-y (day-first if the first is above 12);
    with fewer than three numbers it is no date, rather than one filled up from today."""
    packed, ymd, any_order = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})[-.](\d{1,2})[-.](\d{1,2})$", r"^(\d{1,2})[-.](\d{1,2})[-.](\d{4}|\d{2})$"

    def text(y: Column, m: Column, d: Column) -> Column:
        return F.format_string("%04d-%02d-%02d", y, m, d)

    def iso(own: Column) -> Column:
        part = lambda p, g: X.found(own, p, g).try_cast("int")
        first, second, last = (part(any_order, g) for g in (1, 2, 3))
        short = F.when(last > as_of.year % 100 + 50, last + 1900).otherwise(last + 2000)
        year = F.when(F.length(F.regexp_extract(own, any_order, 3)) == 2, short).otherwise(last)
        month, day = F.when(first > 12, second).otherwise(first), F.when(first > 12, first).otherwise(second)
        return F.when(own.rlike(packed), text(*(part(packed, g) for g in (1, 2, 3)))).when(own.rlike(ymd), text(*(part(ymd, g) for g in (1, 2, 3)))).when(own.rlike(any_order), text(year, month, day))

    def judged(own: Column) -> Column:
        return X.let(
            F.try_to_date(iso(own), "yyyy-MM-dd"),
            lambda parsed: F.when(is_empty(raw), outcome(raw, None, "empty_input"))
            .when(own.rlike(r"^\d{4}-\d{2}-\d{2}$"), outcome(raw, own, "iso_format"))
            .when(parsed.isNull(), outcome(raw, None, "parse_failed"))
            .when((F.year(parsed) < 1900) | (F.year(parsed) > as_of.year + 1), outcome(raw, None, "year_out_of_range"))
            .otherwise(outcome(raw, F.date_format(parsed, "yyyy-MM-dd"), "parsed")),
        )

    return X.let(X.repair_digits(X.strip(X.clean_unicode(raw, nfkc))), judged)


def date_with_months(raw: Column, as_of: date, nfkc: X.NFKC = X.nfkc) -> Column:
    """Second contract: slashes and month names are read before digits are repaired; day first, then month."""
    own = F.regexp_replace(X.strip(X.clean_unicode(raw, nfkc)), r"(?i)(\d{1,2})(st|nd|rd|th)\b", "$1")
    named = X.found(own, rf"(?i)^(\d{{1,2}}\s+(?:{S.MONTHS})[a-z]*\s+\d{{4}})$", 1)
    short = F.regexp_replace(named, r"(?i)^(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})$", "$1 $2 $3")
    slashed = X.found(own, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1)
    parsed = F.coalesce(F.try_to_date(F.initcap(short), "d MMM yyyy"), F.try_to_date(slashed, "d/M/yyyy"))
    return F.when(parsed.isNotNull(), outcome(raw, F.date_format(parsed, "yyyy-MM-dd"), "parsed")).otherwise(date_text(raw, as_of, nfkc))


def phone(raw: Column, nfkc: X.NFKC = X.nfkc) -> Column:
    return X.let(
        X.digits(X.clean_unicode(raw, nfkc)),
        lambda own: F.when(is_empty(raw), outcome(raw, None, "empty_input"))
        .when(~F.length(own).between(7, 15), outcome(raw, None, "invalid_length"))
        .when(own.rlike("^[6-9][0-9]{9}$"), outcome(raw, F.concat(F.lit("+91"), own), "indian_format"))
        .when(own.rlike("^0[6-9][0-9]{9}$"), outcome(raw, F.concat(F.lit("+91"), F.substring(own, 2, 10)), "leading_zero_indian"))
        .otherwise(outcome(raw, F.concat(F.lit("+"), own), "generic_format")),
    )


def email(raw: Column, nfkc: X.NFKC = X.nfkc) -> Column:
    def mended(domain: Column) -> Column:
        """Each mistyped domain in turn, on what the ones before made of it."""
        for bad, good in S.DOMAINS.items():
            domain = _mend(domain, bad, good)
        return domain

    def judged(own: Column) -> Column:
        whole = F.concat(F.substring_index(own, "@", 1), F.lit("@"), mended(F.regexp_replace(own, "(?s)^[^@]*@", "")))
        return X.let(
            whole,
            lambda address: F.when(is_empty(raw), outcome(raw, None, "empty_input"))
            .when(~F.contains(own, F.lit("@")), outcome(raw, None, "missing_at_symbol"))
            .when(~address.rlike(r"^[a-z0-9_.+\-]+@[a-z0-9\-]+\.[a-z]{2,}$"), outcome(raw, None, "invalid_email_format"))
            .otherwise(outcome(raw, address, "valid")),
        )

    plain = F.replace(F.replace(F.lower(X.strip(X.clean_unicode(raw, nfkc))), F.lit(" "), F.lit("")), F.lit("(at)"), F.lit("@"))
    return X.let(X.let(plain, lambda x: F.when(F.contains(x, F.lit("@")), x).otherwise(F.regexp_replace(x, r"(?U)\bat\b", "@"))), judged)


def _mend(domain: Column, bad: str, good: str) -> Column:
    return X.let(domain, lambda d: F.when(F.contains(d, F.lit(bad)), F.lit(good)).otherwise(d))


def string(raw: Column, nfkc: X.NFKC = X.nfkc) -> Column:
    return F.when(is_empty(raw), outcome(raw, None, "empty_input")).otherwise(outcome(raw, X.collapse(X.clean_unicode(raw, nfkc)), "cleaned"))


def normalizer(name: str, as_of: date, nfkc: X.NFKC = X.nfkc, months: bool = False):
    if name in ("amount_estimated", "insured_amount"):
        return lambda raw: amount(raw, nfkc)
    if name == "date":
        return lambda raw: (date_with_months if months else date_text)(raw, as_of, nfkc)
    return {"phone": lambda raw: phone(raw, nfkc), "email": lambda raw: email(raw, nfkc)}.get(name, lambda raw: string(raw, nfkc))


def all_fields(raw: dict[str, Column], as_of: date, nfkc: X.NFKC = X.nfkc, months: bool = False) -> Column:
    return X.held(F.struct(*[X.let(raw[n], normalizer(n, as_of, nfkc, months)).alias(n) for n in S.FIELDS]))


def inferred(name: str, raw: Column, as_of: date) -> Column:
    """As the field's normalizer, but words for "nothing" are empty."""
    return X.let(
        raw,
        lambda x: F.when(x.isNull() | x.isin("", "null", "None"), outcome(x, None, "empty")).otherwise(X.let(X.strip(x), normalizer(name, as_of))),
    )
