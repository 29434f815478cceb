"""The named queries over the claims view, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from adjudica import settings as S
from adjudica.functions import normalize as N, numeric as Q, redact as R, text as X
from adjudica.operators import access, audit, infer as I, retention, review
from adjudica.operators.extract import extract_fields, several
from adjudica.plans.claims import AS_OF, claims, claims_sql, form_sql, forms
from adjudica.plans.pipeline import process_columns, process_text
from adjudica.sources.files import html_to_text
from adjudica.sources.pages import assess_pages, best_variant
from adjudica.sources.store import load_claims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the SQL side: claims, their normalized columns, validation and decision as common table expressions

AT = "DATE '2000-06-01'"


def sql_bare(c: str) -> str:
    return f"trim(regexp_replace({c}, '[^0-9.,\\-₹Rs$ ]', '', 'g'))"


def sql_amount(c: str) -> str:
    number = f"regexp_extract(replace(replace(regexp_replace({sql_bare(c)}, '(Rs\\.?|₹|INR|USD|\\$)', '', 'gi'), ',', ''), ' ', ''), '-?[0-9]+(\\.[0-9]+)?')"
    return f"CASE WHEN coalesce({c}, '') = '' THEN '' WHEN {number} = '' THEN '' ELSE printf('%.2f', {number}::DOUBLE) END"


SQL_DIGITS = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
SQL_PHONE = f"CASE WHEN length({SQL_DIGITS}) NOT BETWEEN 7 AND 15 THEN '' WHEN regexp_full_match({SQL_DIGITS}, '[6-9][0-9]{{9}}') THEN '+91' || {SQL_DIGITS} WHEN regexp_full_match({SQL_DIGITS}, '0[6-9][0-9]{{9}}') THEN '+91' || {SQL_DIGITS}[2:] ELSE '+' || {SQL_DIGITS} END"
SQL_MAIL = "replace(lower(replace(coalesce(email, ''), ' ', '')), '(at)', '@')"
SQL_EMAIL = f"CASE WHEN regexp_full_match(regexp_replace({SQL_MAIL}, '@.*gmai\\.com.*$', '@gmail.com'), '[a-z0-9_.+\\-]+@[a-z0-9\\-]+\\.[a-z]{{2,}}') THEN regexp_replace({SQL_MAIL}, '@.*gmai\\.com.*$', '@gmail.com') ELSE '' END"
SQL_DATE = f"CASE WHEN regexp_full_match({sql_bare('date')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {sql_bare('date')} WHEN regexp_full_match({sql_bare('date')}, '[0-9]{{8}}') THEN strftime(try_strptime({sql_bare('date')}, '%Y%m%d'), '%Y-%m-%d') ELSE '' END"


def sql_string(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


CLAIMS = "c AS (" + claims_sql("format('{{:,.2f}}', ({x})::DOUBLE)") + ")"
FORMS = f"WITH {CLAIMS}, f AS ({form_sql('SELECT * FROM c')})"
NORMAL = f"""WITH {CLAIMS},
n AS (SELECT claim_key, segment, nationkey, claim_id AS raw_claim_id, {sql_string('claim_id')} AS claim_id, {sql_string('policy_no')} AS policy_no, {sql_string('claimant_name')} AS claimant_name,
  phone AS raw_phone, {SQL_PHONE} AS phone, email AS raw_email, {SQL_EMAIL} AS email, {sql_string('vehicle')} AS vehicle, {sql_string('damage')} AS damage,
  date AS raw_date, {SQL_DATE} AS date, {sql_amount('amount_estimated')} AS amount, {sql_amount('insured_amount')} AS insured FROM c)"""
VALID = f"""{NORMAL},
p AS (SELECT *, try_cast(amount AS DOUBLE) AS a, try_cast(insured AS DOUBLE) AS i, try_cast(date AS DATE) AS d, regexp_replace(phone, '[^0-9]', '', 'g') AS pd FROM n),
w AS (SELECT *,
  list_filter([CASE WHEN claim_id = '' THEN 'claim_id' END, CASE WHEN policy_no = '' THEN 'policy_no' END, CASE WHEN date = '' THEN 'date' END, CASE WHEN amount = '' THEN 'amount_estimated' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN a IS NULL THEN 'amount_missing_or_invalid' END, CASE WHEN a > i THEN 'amount_exceeds_insured' END, CASE WHEN a <= 0 AND i IS NOT NULL THEN 'non_positive_amount' END], lambda x: x IS NOT NULL) AS rules,
  list_filter([CASE WHEN i IS NULL THEN 'insured_amount_missing_or_invalid' END, CASE WHEN date = '' THEN 'date_invalid_format' END, CASE WHEN d > {AT} + 1 THEN 'date_in_future' END, CASE WHEN d < {AT} - 1825 THEN 'date_too_old' END,
    CASE WHEN coalesce(raw_phone, '') <> '' AND phone = '' THEN 'phone_normalization_failed' END,
    CASE WHEN pd <> '' AND (replace(pd, left(pd, 1), '') = '' OR suffix(pd, '0000') OR prefix(pd, '000')) THEN 'phone_suspicious' END,
    CASE WHEN coalesce(raw_email, '') <> '' AND email = '' THEN 'email_normalization_failed' END,
    CASE WHEN regexp_matches(email, '\\.(con|cm|coo|gmal|hotnail)$') THEN 'email_domain_suspicious' END], lambda x: x IS NOT NULL) AS warnings,
  list_filter([CASE WHEN coalesce(raw_phone, '') <> '' AND phone = '' THEN 'phone' END, CASE WHEN coalesce(raw_email, '') <> '' AND email = '' THEN 'email' END, CASE WHEN coalesce(raw_date, '') <> '' AND date = '' THEN 'date' END], lambda x: x IS NOT NULL) AS low FROM p),
v AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0.10::DOUBLE + 0.20::DOUBLE * len(missing) + 0.18::DOUBLE * (len(rules) + list_contains(missing, 'amount_estimated')::INT) + 0.05::DOUBLE * len(warnings) + 0.05::DOUBLE * len(low)
  + CASE WHEN list_contains(rules, 'amount_exceeds_insured') THEN 0.35::DOUBLE ELSE 0::DOUBLE END)) AS risk FROM w),
r AS (SELECT *, CASE WHEN list_contains(rules, 'amount_exceeds_insured') THEN 'reject' WHEN len(missing) > 0 THEN 'review' WHEN risk >= 0.7::DOUBLE THEN 'review' ELSE 'approve' END AS recommendation,
  list_sort(list_concat(list_transform(missing, lambda x: x || '_missing'), rules)) AS issues FROM v)"""
DECIDED = f"""{VALID},
k AS (SELECT *, CASE WHEN a IS NULL OR i IS NULL THEN 'unknown' WHEN a <= 0 THEN 'nothing' WHEN a > i THEN 'over' WHEN i > 0 AND a / i >= 0.9::DOUBLE THEN 'near' ELSE 'within' END AS kase, regexp_matches(lower(damage), '{S.SEVERE_DAMAGE}') AS severe FROM r),
e AS (SELECT *, CASE kase WHEN 'nothing' THEN 'reject' WHEN 'over' THEN 'reject' WHEN 'within' THEN 'approve' ELSE 'review' END AS decision,
  round(greatest(0::DOUBLE, CASE kase WHEN 'nothing' THEN 0.95::DOUBLE WHEN 'over' THEN 0.95::DOUBLE WHEN 'near' THEN 0.75::DOUBLE WHEN 'within' THEN 0.9::DOUBLE ELSE 0.45::DOUBLE END - CASE WHEN len(low) > 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END), 2) AS confidence,
  array_to_string(list_filter([CASE WHEN a IS NULL THEN 'amount_missing_or_invalid' END, CASE WHEN i IS NULL THEN 'insured_amount_missing_or_invalid' END, CASE WHEN severe THEN 'high_risk_damage_detected' END,
    CASE kase WHEN 'nothing' THEN 'non_positive_claim_amount' WHEN 'over' THEN 'claimed_amount_exceeds_insured' WHEN 'near' THEN 'amount_close_to_insured_limit' WHEN 'within' THEN 'amount_within_insured_limit' ELSE 'insufficient_amount_information' END,
    CASE WHEN len(low) > 0 THEN 'low_confidence_fields_present' END], lambda x: x IS NOT NULL), '|') AS reasons,
  array_to_string(list_filter([CASE WHEN a IS NULL THEN 'missing_amount' END, CASE WHEN i IS NULL THEN 'missing_insured_amount' END, CASE WHEN severe THEN 'high_risk' END,
    CASE kase WHEN 'nothing' THEN 'invalid_amount' WHEN 'over' THEN 'over_limit' WHEN 'near' THEN 'near_limit' WHEN 'within' THEN 'within_limit' END, CASE WHEN len(low) > 0 THEN 'low_confidence' END], lambda x: x IS NOT NULL), '|') AS flags FROM k)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_columns(claims(spark, sf_dir), AS_OF)


# ---- normalizers

def normalized(spark: SparkSession, sf_dir: str, column: str, name: str) -> DataFrame:
    own = N.normalizer(column, AS_OF)(F.col(column))
    return claims(spark, sf_dir).select("claim_key", own.alias("x")).select("claim_key", F.col("x.value").alias(name), F.col("x.success").alias("success"))


@query(f"{NORMAL} SELECT claim_key, amount AS amount_value, amount <> '' AS success FROM n")
def normalize_amount(spark, sf_dir):
    return normalized(spark, sf_dir, "amount_estimated", "amount_value")


@query(f"{NORMAL} SELECT claim_key, phone AS phone_value, phone <> '' AS success FROM n")
def normalize_phone(spark, sf_dir):
    return normalized(spark, sf_dir, "phone", "phone_value")


@query(f"{NORMAL} SELECT claim_key, email AS email_value, email <> '' AS success FROM n")
def normalize_email(spark, sf_dir):
    return normalized(spark, sf_dir, "email", "email_value")


@query(f"{NORMAL} SELECT claim_key, vehicle AS vehicle_value, true AS success FROM n")
def normalize_string(spark, sf_dir):
    return normalized(spark, sf_dir, "vehicle", "vehicle_value")


@query(f"{NORMAL} SELECT claim_key, date AS date_value, date <> '' AS success FROM n")
def normalize_date_iso(spark, sf_dir):
    return normalized(spark, sf_dir, "date", "date_value")


SQL_MISREAD = "replace(replace(amount_estimated, '0', 'O'), '1', 'l')"
SQL_ZEROS = f"regexp_replace(regexp_replace({SQL_MISREAD}, '[Oo]([0-9])', '0\\1', 'g'), '([0-9])[Oo]', '\\10', 'g')"
SQL_ONES = f"regexp_replace(regexp_replace({SQL_ZEROS}, '[lI]([0-9])', '1\\1', 'g'), '([0-9])[lI]', '\\11', 'g')"


@query(f"WITH {CLAIMS} SELECT claim_key, trim(regexp_replace({SQL_ONES}, '[^0-9.,\\-₹Rs$ ]', '', 'g')) AS repaired FROM c")
def ocr_digit_repair(spark, sf_dir):
    """Zeros and ones misread as letters, and what the repair makes of them."""
    return claims(spark, sf_dir).select("claim_key", X.repair_digits(F.translate("amount_estimated", "01", "Ol")).alias("repaired"))


# ---- validation and decision

@query(f"{VALID} SELECT claim_key, array_to_string(list_sort(missing), '|') AS missing, len(missing) = 0 AS is_complete FROM r")
def validate_missing(spark, sf_dir):
    v = F.col("validation")
    return decided(spark, sf_dir).select("claim_key", F.array_join(v["missing_required"], "|").alias("missing"), v["is_complete"].alias("is_complete"))


@query(f"{VALID} SELECT claim_key, array_to_string(list_sort(warnings), '|') AS warnings, array_to_string(list_sort(low), '|') AS low_confidence FROM r")
def validate_warnings(spark, sf_dir):
    v = F.col("validation")
    return decided(spark, sf_dir).select("claim_key", F.array_join(v["warnings"], "|").alias("warnings"), F.array_join(v["explainability"]["low_confidence_fields"], "|").alias("low_confidence"))


@query(f"{VALID} SELECT claim_key, round(risk, 3) AS risk_score, array_to_string(issues, '|') AS issues FROM r")
def validate_risk(spark, sf_dir):
    v = F.col("validation")
    return decided(spark, sf_dir).select("claim_key", v["risk_score"].alias("risk_score"), F.array_join(v["issues"], "|").alias("issues"))


@query(f"{VALID} SELECT claim_key, recommendation FROM r")
def validate_recommendation(spark, sf_dir):
    return decided(spark, sf_dir).select("claim_key", F.col("validation.recommendation").alias("recommendation"))


@query(f"{DECIDED} SELECT claim_key, decision, confidence, decision = 'review' OR len(low) > 0 AS requires_human, a AS amount, i AS insured_amount FROM e")
def decision_per_claim(spark, sf_dir):
    d = F.col("decision")
    return decided(spark, sf_dir).select("claim_key", d["decision"].alias("decision"), d["confidence"].alias("confidence"), d["requires_human"].alias("requires_human"), d["evidence"]["amount"].alias("amount"), d["evidence"]["insured_amount"].alias("insured_amount"))


@query(f"{DECIDED} SELECT claim_key, reasons, flags FROM e")
def decision_reasons(spark, sf_dir):
    return decided(spark, sf_dir).select("claim_key", F.array_join("decision.reasons", "|").alias("reasons"), F.array_join("decision.flags", "|").alias("flags"))


@query(f"{DECIDED} SELECT decision, count(*) AS n, sum((confidence * 100)::BIGINT)::BIGINT AS confidence_hundredths FROM e GROUP BY decision")
def decision_counts(spark, sf_dir):
    made = decided(spark, sf_dir).select(F.col("decision.decision").alias("decision"), F.col("decision.confidence").alias("c"))
    return made.groupBy("decision").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c") * 100).cast("long")).alias("confidence_hundredths"))


# ---- extraction from forms, letters and notes

def rx(pattern: str) -> str:
    """A pattern of the rules as an SQL literal; the engine's classes are ASCII's, as all that these texts hold."""
    return "'" + X.ascii_form(pattern).replace("'", "''") + "'"


def sql_line(pattern: str, group: int = 1, lines: str = "s") -> str:
    """From the first line that matches."""
    return f"list_filter(list_transform({lines}, lambda t: regexp_extract(t, {rx(pattern)}, {group})), lambda t: t <> '')[1]"


def sql_whole(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN unfit THEN '' ELSE regexp_extract(x, {rx(pattern)}, {group}) END"


def sql_collapse(value: str) -> str:
    return f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"


def sql_keyword(words: tuple[str, ...]) -> str:
    told = " OR ".join(f"contains(lower(t), '{w}')" for w in words)
    return f"list_filter(list_transform(s, lambda t: CASE WHEN {told} THEN regexp_extract(t, {rx(S.CODE)}, 0) ELSE '' END), lambda t: t <> '')[1]"


def sql_following(i: str, most: int) -> str:
    stop = f"list_position(list_transform(s[{i} + 1:{i} + {most}], lambda u: u = '' OR regexp_matches(u, {rx(S.HEADER)})), true)"
    return f"array_to_string(s[{i} + 1:least({i} + {most}, {i} + coalesce(nullif({stop}, 0), {most} + 1) - 1)], ' ')"


def sql_with_following(pattern: str, clean) -> str:
    base = f"regexp_extract(s[i], {rx(pattern)}, 1)"
    return f"list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN {base} <> '' THEN trim({clean(base)} || ' ' || {sql_following('i', 3)}) END), lambda t: t IS NOT NULL)[1]"


def sql_token(value: str) -> str:
    """The first amount token of a value, null if there is none."""
    number = f"regexp_replace(regexp_extract({value}, {rx(S.AMOUNT)}, 2), '[\\s,]', '', 'g')"
    return f"CASE WHEN {number} <> '' THEN regexp_replace(regexp_extract({value}, {rx(S.AMOUNT)}, 1), '(.)$', '\\1 ') || printf('%.2f', {number}::DOUBLE) END"


def sql_labelled(value: str) -> str:
    return f"list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN regexp_matches(r[i], {rx(S.ESTIMATE)}) THEN {value} END), lambda t: t IS NOT NULL)[1]"


SQL_HERE, SQL_NEXT = sql_token("r[i]"), sql_token(sql_following("i", 2))
SQL_INSURED = f"regexp_replace({sql_whole(S.INSURED_AMOUNT, 2)}, '[,\\s]', '', 'g')"
SQL_PHONE_FIRST = sql_line(S.PHONE)
SQL_PHONE_OTHER = f"list_filter(regexp_extract_all(x, {rx(S.PHONE)}, 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g') <> regexp_replace(p, '[^0-9]', '', 'g'))[1]"


def sql_phone(value: str) -> str:
    return f"CASE WHEN starts_with({value}, '+') THEN '+' ELSE '' END || regexp_replace({value}, '[^0-9]', '', 'g')"


# For each field its rules in order: (value, method).
SQL_FIELDS = {
    "claim_id": [(sql_collapse(sql_whole(S.CLAIM_ID)), "regex"), (sql_keyword(S.CLAIM_ID_WORDS), "keyword")],
    "policy_no": [(sql_collapse(sql_whole(S.POLICY_NO)), "regex"), (sql_keyword(S.POLICY_NO_WORDS), "keyword")],
    "claimant_name": [(sql_collapse(sql_line(S.NAME_LINE)), "regex-line"), (sql_collapse(sql_line(S.SIGNATURE, lines="r")), "signature"), (f"list_filter(s[1:20], lambda t: regexp_matches(t, {rx(S.TITLE_CASE)}))[1]", "titlecase")],
    "phone": [(f"CASE WHEN length(regexp_replace(p, '[^0-9]', '', 'g')) IN (6, 8) THEN {sql_phone(SQL_PHONE_OTHER)} END", "alt-phone"), (sql_phone("p"), "regex")],
    "email": [(sql_whole(S.EMAIL, 0), "regex")],
    "vehicle": [(sql_with_following(S.VEHICLE, "trim({})".format), "multiline")],
    "registration_no": [(sql_collapse(sql_whole(S.REGISTRATION, 0)), "regex"), (sql_collapse(sql_line(S.REGISTRATION_LINE)), "regex")],
    "make": [(sql_collapse(sql_line(S.MAKE)), "regex")],
    "model": [(sql_collapse(sql_line(S.MODEL)), "regex")],
    "year": [(sql_collapse(sql_line(S.YEAR)), "regex")],
    "damage": [(sql_with_following(S.DAMAGE, sql_collapse), "multiline")],
    "amount_estimated": [(sql_labelled(f"CASE WHEN {SQL_HERE} IS NOT NULL THEN {SQL_HERE} END"), "labelled"), (sql_labelled(SQL_NEXT), "labelled-next"), (f"CASE WHEN NOT unfit THEN {sql_token('x')} END", "heuristic")],
    "insured_amount": [(f"printf('%.2f', try_cast({SQL_INSURED} AS DOUBLE))", "labelled")],
    "date": [(sql_line(S.DATE), "regex")],
}
LINED = f"""{FORMS}, u AS (SELECT claim_key, raw_text AS x, raw_text = '' OR (length(raw_text) > 2000 AND length(regexp_replace(raw_text, '[^\\x20-\\x7E\\n\\r\\t]', '', 'g')) < 0.55 * length(raw_text)) AS unfit FROM f),
v AS (SELECT *, CASE WHEN unfit THEN [] ELSE string_split(x, chr(10)) END AS r FROM u), w AS (SELECT *, list_transform(r, lambda t: trim(t)) AS s FROM v), l AS (SELECT *, {SQL_PHONE_FIRST} AS p FROM w)"""


def sql_extracted(*names: str) -> str:
    tried = ", ".join(f"nullif({value}, '') AS {n}_{k}" for n in names for k, (value, _) in enumerate(SQL_FIELDS[n]))
    value = lambda n: "coalesce(" + ", ".join(f"{n}_{k}" for k in range(len(SQL_FIELDS[n]))) + f", NULL) AS {n}"
    method = lambda n: "CASE " + " ".join(f"WHEN {n}_{k} IS NOT NULL THEN '{m}'" for k, (_, m) in enumerate(SQL_FIELDS[n])) + f" ELSE 'init' END AS {n}_method"
    return f"{LINED}, t AS (SELECT claim_key, x, unfit, {tried} FROM l), e AS (SELECT claim_key, x, unfit, {', '.join(value(n) for n in names)}, {', '.join(method(n) for n in names)} FROM t)"


def extracted(spark, sf_dir, *names):
    e = F.col("extracted")
    return extract_fields(forms(spark, sf_dir), names=names).select("claim_key", *[e[n]["value"].alias(n) for n in names], *[e[n]["method"].alias(f"{n}_method") for n in names])


def sql_of(*names: str) -> str:
    return f"{sql_extracted(*names)} SELECT claim_key, {', '.join(names)}, {', '.join(n + '_method' for n in names)} FROM e"


@query(sql_of("claim_id", "policy_no"))
def extract_ids(spark, sf_dir):
    return extracted(spark, sf_dir, "claim_id", "policy_no")


@query(sql_of("amount_estimated", "insured_amount"))
def extract_amounts(spark, sf_dir):
    return extracted(spark, sf_dir, "amount_estimated", "insured_amount")


@query(sql_of("claimant_name", "phone", "email", "date"))
def extract_contact(spark, sf_dir):
    return extracted(spark, sf_dir, "claimant_name", "phone", "email", "date")


@query(sql_of("vehicle", "registration_no", "make", "model", "year"))
def extract_vehicle(spark, sf_dir):
    return extracted(spark, sf_dir, "vehicle", "registration_no", "make", "model", "year")


@query(sql_of("damage"))
def extract_multiline_damage(spark, sf_dir):
    return extracted(spark, sf_dir, "damage")


@query(f"""{sql_extracted(*S.NOTED_IF_MISSING)} SELECT claim_key, CASE WHEN x = '' THEN 'EMPTY_TEXT' WHEN unfit THEN 'BINARY_OR_GIBBERISH_TEXT' ELSE
  array_to_string(list_filter([{', '.join(f"CASE WHEN {n} IS NULL THEN 'missing_{n}' END" for n in S.NOTED_IF_MISSING)}], lambda t: t IS NOT NULL), '|') END AS notes FROM e""")
def extract_notes(spark, sf_dir):
    return extract_fields(forms(spark, sf_dir)).select("claim_key", F.array_join("extract_notes", "|").alias("notes"))


@query(f"""{sql_extracted('policy_no', 'email')}, d AS (SELECT claim_key, list_distinct(list_transform(regexp_extract_all(x, {rx(S.CLAIM_ID)}, 1), lambda t: upper(t))) AS c, list_distinct(list_transform(regexp_extract_all(x, {rx(S.PHONE)}, 1), lambda t: regexp_replace(t, '[^0-9]', '', 'g'))) AS p,
  list_distinct(list_transform(regexp_extract_all(x, {rx(S.POLICY_NO)}, 1), lambda t: upper(t))) AS n, list_distinct(list_transform(regexp_extract_all(x, {rx(S.EMAIL)}, 0), lambda t: lower(t))) AS e FROM l)
SELECT claim_key, array_to_string(list_filter([CASE WHEN len(n) > 1 THEN 'policy_no' END, CASE WHEN len(c) > 1 THEN 'claim_id' END, CASE WHEN len(p) > 1 THEN 'phone' END, CASE WHEN len(e) > 1 THEN 'email' END], lambda t: t IS NOT NULL), '|') AS several FROM d""")
def several_candidates(spark, sf_dir):
    """Fields of which a text holds more than one value."""
    return forms(spark, sf_dir).select("claim_key", F.array_join(several(F.col("raw_text")), "|").alias("several"))


@query(f"""{FORMS}, l AS (SELECT claim_key, unnest(range(len(string_split(raw_text, chr(10)))))::INTEGER AS line_no, unnest(string_split(raw_text, chr(10))) AS line FROM f WHERE raw_text <> '') SELECT * FROM l""")
def line_index(spark, sf_dir):
    rows = forms(spark, sf_dir).select("claim_key", F.inline(X.numbered(X.split_lines(F.col("raw_text")))))
    return rows.select("claim_key", F.col("index").alias("line_no"), F.col("text").alias("line"))


# ---- inference and summaries

@query(f"""{FORMS} SELECT claim_key, regexp_extract(raw_text, '(?i)CLM?[/\\-]?\\w+', 0) AS claim_id, regexp_extract(raw_text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\\.[A-Za-z0-9]{{2,}}', 0) AS email,
  regexp_extract(raw_text, '[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}', 0) AS date, trim(regexp_extract(raw_text, '(?:Nature of Damage|Damage)\\s*:\\s*(.*)', 1)) AS damage FROM f""")
def rule_infer(spark, sf_dir):
    text = F.col("raw_text")
    return forms(spark, sf_dir).select("claim_key", *[F.coalesce(I.rule_value(n, text), F.lit("")).alias(n) for n in ("claim_id", "email", "date", "damage")])


@query(f"""{VALID} SELECT claim_key, 'Claim ' || coalesce(nullif(claim_id, ''), 'Unknown') || ' for ' || coalesce(nullif(vehicle, ''), 'Unknown') || ', estimated amount ' || coalesce(nullif(amount, ''), 'Unknown') || '.' AS summary, recommendation AS decision,
  CASE WHEN len(issues) + len(missing) = 0 THEN 'No issues.' ELSE trim(CASE WHEN len(issues) > 0 THEN 'Issues: ' || array_to_string(issues, ', ') ELSE '' END || CASE WHEN len(missing) > 0 THEN ' Missing: ' || array_to_string(list_sort(missing), ', ') ELSE '' END) END AS reasoning FROM r""")
def fallback_summary(spark, sf_dir):
    held = decided(spark, sf_dir)
    fields = F.struct(*[F.struct(F.col("normalized")[n]["value"].alias("value"), F.lit(None).cast("string").alias("canonical")).alias(n) for n in S.FIELDS])
    made = held.select("claim_key", I.rule_summary(fields, F.col("validation")).alias("s"))
    return made.select("claim_key", "s.summary", "s.decision", "s.reasoning")


# The chain from raw columns on, over what was extracted from the texts instead of the claims' own columns.
TEXT_ROWS = f"""x0 AS ({sql_extracted(*S.FIELDS)} SELECT claim_key, NULL AS segment, NULL AS nationkey, {', '.join(S.FIELDS)}, coalesce(policy_no, nullif(regexp_extract(x, '(?i)P[NO]L?/?\\w+'), ''), '') AS any_policy FROM e)"""
TEXT_DECIDED = DECIDED.replace(" FROM c)", " FROM x0)", 1).replace(f"WITH {CLAIMS}", f"WITH {TEXT_ROWS}", 1)


@query(f"""{TEXT_DECIDED} SELECT e.claim_key, round(risk, 3) AS risk_score, recommendation, {sql_string('any_policy')} AS policy_no,
  'Claim ' || coalesce(x0.claim_id, 'Unknown') || ' for ' || coalesce(x0.vehicle, 'Unknown') || ', estimated amount ' || coalesce(printf('%.2f', try_cast(replace(regexp_extract(x0.amount_estimated, '[0-9][0-9,.]*'), ',', '') AS DOUBLE)), 'Unknown') || '.' AS summary,
  decision, decision = 'review' OR len(low) > 0 AS hitl_required FROM e JOIN x0 ON e.claim_key = x0.claim_key""")
def text_to_decision(spark, sf_dir):
    """Text to decision, on every form."""
    made = process_text(forms(spark, sf_dir), AS_OF, extracted=S.FIELDS, inferred=("policy_no",))
    return made.select("claim_key", F.col("validation.risk_score").alias("risk_score"), F.col("validation.recommendation").alias("recommendation"), F.col("inferred.policy_no.value").alias("policy_no"), F.col("summary.summary").alias("summary"), F.col("decision.decision").alias("decision"), "hitl_required")


# ---- masks

MAIL_SQL = "'([a-zA-Z0-9_.+-]{1,64})@([a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+)'"


def masked_sql(table: str, key: str, text: str = "text") -> str:
    return f"""WITH t AS (SELECT {key}, {text} AS x, regexp_split_to_array({text}, {MAIL_SQL}) AS parts, regexp_extract_all({text}, {MAIL_SQL}, 1) AS users, regexp_extract_all({text}, {MAIL_SQL}, 2) AS domains FROM {table})
SELECT {key}, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda j: parts[j] || CASE WHEN j <= len(users) THEN users[j][1:greatest(1, least(3, length(users[j]) // 2))] || repeat('*', greatest(0, length(users[j]) - greatest(1, least(3, length(users[j]) // 2)))) || '@' || domains[j] ELSE '' END), '')) AS masked_md5 FROM t"""


@query(masked_sql("documents", "doc_id"))
def redact_email(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(R.emails_in(F.col("text"))).alias("masked_md5"))


PHONE_SQL = "'(\\+?[0-9][0-9\\-\\s.]{6,}[0-9])'"


@query(f"""WITH t AS (SELECT doc_id, regexp_split_to_array(text, {PHONE_SQL}) AS parts, list_transform(regexp_extract_all(text, {PHONE_SQL}), lambda m: right(regexp_replace(m, '[^0-9]', '', 'g'), 10)) AS digits FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda j: parts[j] || CASE WHEN j <= len(digits) THEN digits[j][1:2] || repeat('*', length(digits[j]) - 4) || right(digits[j], 2) ELSE '' END), '')) AS masked_md5 FROM t""")
def redact_phone(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(R.phones_in(F.col("text"))).alias("masked_md5"))


@query(f"""WITH {CLAIMS} SELECT claim_key, 'CLM-' || CASE WHEN length(v) <= 3 THEN left(v, 1) || repeat('*', length(v) - 1) ELSE left(v, 2) || repeat('*', length(v) - 3) || right(v, 1) END AS masked FROM (SELECT claim_key, claim_id[5:] AS v FROM c)""")
def redact_ids(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_key", R.ids(F.col("claim_id")).alias("masked"))


SQL_GAP = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def sql_names(value: str) -> str:
    """A mark after every character that no word has, so that one such character can end a match and begin the next."""
    marked = f"regexp_replace({value}, '([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1), 'g')"
    return f"replace(regexp_replace({marked}, '(^|\\x01)([A-Z][a-z]+)(?:{SQL_GAP}\\x01)+([A-Z])[a-z]+($|[^\\p{{L}}\\p{{N}}_\\x01])', '\\1\\2 \\3***\\4', 'g'), chr(1), '')"


@query(f"SELECT doc_id, md5({sql_names('text')}) AS masked_md5 FROM documents")
def redact_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(R.names(F.col("text"))).alias("masked_md5"))


SQL_ID = "'(?i)\\b(CLM|CLAIM|PN|POLICY|POL)\\b([-:\\s]*)([A-Z0-9\\-_/]+)'"


def sql_joined(masked: str) -> str:
    """Parts between matches, each followed by its masked match."""
    return f"array_to_string(list_transform(range(1, len(parts) + 1), lambda j: parts[j] || CASE WHEN j <= len(a) THEN {masked} ELSE '' END), '')"


SQL_MASKED_MAIL = sql_joined("a[j][1:greatest(1, least(3, length(a[j]) // 2))] || repeat('*', greatest(0, length(a[j]) - greatest(1, least(3, length(a[j]) // 2)))) || '@' || b[j]")
SQL_MASKED_PHONE = sql_joined("a[j][1:2] || repeat('*', length(a[j]) - 4) || right(a[j], 2)")
SQL_MASKED_ID = sql_joined("a[j] || b[j] || CASE WHEN length(c[j]) <= 3 THEN left(c[j], 1) || repeat('*', length(c[j]) - 1) ELSE left(c[j], 2) || repeat('*', length(c[j]) - 3) || right(c[j], 1) END")


@query(f"""WITH m AS (SELECT conv_id, turn, regexp_split_to_array(text, {MAIL_SQL}) AS parts, regexp_extract_all(text, {MAIL_SQL}, 1) AS a, regexp_extract_all(text, {MAIL_SQL}, 2) AS b FROM conversations),
t AS (SELECT conv_id, turn, {SQL_MASKED_MAIL} AS x FROM m),
p AS (SELECT conv_id, turn, regexp_split_to_array(x, {PHONE_SQL}) AS parts, list_transform(regexp_extract_all(x, {PHONE_SQL}), lambda k: right(regexp_replace(k, '[^0-9]', '', 'g'), 10)) AS a FROM t),
u AS (SELECT conv_id, turn, {SQL_MASKED_PHONE} AS x FROM p),
i AS (SELECT conv_id, turn, regexp_split_to_array(x, {SQL_ID}) AS parts, regexp_extract_all(x, {SQL_ID}, 1) AS a, regexp_extract_all(x, {SQL_ID}, 2) AS b, regexp_extract_all(x, {SQL_ID}, 3) AS c FROM u),
n AS (SELECT conv_id, turn, {SQL_MASKED_ID} AS x FROM i)
SELECT conv_id, turn, md5({sql_names('x')}) AS masked_md5 FROM n""")
def redact_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(R.text(F.col("text"))).alias("masked_md5"))


@query("""SELECT c_custkey, c_name AS name, left(u, greatest(1, least(3, length(u) // 2))) || repeat('*', length(u) - greatest(1, least(3, length(u) // 2))) || '@example.com' AS email,
  'CLM-' || CASE WHEN length(k) <= 3 THEN left(k, 1) || repeat('*', length(k) - 1) ELSE left(k, 2) || repeat('*', length(k) - 3) || right(k, 1) END AS ref
  FROM (SELECT c_custkey, c_name, 'user' || c_custkey::VARCHAR AS u, c_custkey::VARCHAR AS k FROM customer)""")
def redact_nested(spark, sf_dir):
    """A struct within an array within a struct; the name is on the list of what stays."""
    person = F.struct(F.col("c_name").alias("name"), F.struct(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email")).alias("contact"), F.array(F.struct(F.concat(F.lit("CLM-"), F.col("c_custkey").cast("string")).alias("ref"))).alias("history"))
    made = R.redact_columns(read(spark, sf_dir, "customer").select("c_custkey", person.alias("person")), keep=("name",))
    return made.select("c_custkey", F.col("person.name").alias("name"), F.col("person.contact.email").alias("email"), F.get("person.history", 0)["ref"].alias("ref"))


# ---- text primitives

@query("SELECT doc_id, length(text) > 2000 AND length(regexp_replace(text, '[^\\x20-\\x7E\\n\\r\\t]', '', 'g'))::DOUBLE / greatest(1, length(text)) < 0.55::DOUBLE AS gibberish FROM documents")
def gibberish_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.is_gibberish(F.col("text")).alias("gibberish"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.sha256(F.col("text")).alias("sha256"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1:40], chr(10)) AS context FROM documents")
def context_40_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.context(F.col("text")).alias("context"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(X.tolerant_json(F.col("props")), "$.k", "string").alias("k"))


SQL_TOKENS = "regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|</?[a-zA-Z!][^>]*>|[^<]+|<')"
SQL_PIECE = "CASE WHEN regexp_matches(t, '^(?s:<(script|style).*)$') THEN regexp_replace(t, '(?s)^<[^>]*>(.*)</(script|style)>$', '\\1') WHEN regexp_matches(t, '^</?[a-zA-Z!]') THEN '' ELSE replace(replace(replace(replace(regexp_replace(t, '&amp;?', chr(1), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), chr(1), '&') END"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform({SQL_TOKENS}, lambda t: {SQL_PIECE}), lambda t: t <> ''), chr(10)) AS page_text FROM pages")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("page_text"))


# ---- pages and words

@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN 0.1::DOUBLE ELSE round(greatest(0.10::DOUBLE, least(0.99::DOUBLE, CASE WHEN n_chars > 2000 THEN 0.95::DOUBLE WHEN n_chars > 800 THEN 0.85::DOUBLE WHEN n_chars > 300 THEN 0.7::DOUBLE WHEN n_chars > 100 THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END - CASE WHEN doc_id % 3 = 0 THEN 0.12::DOUBLE ELSE 0::DOUBLE END - CASE WHEN doc_id % 5 = 0 THEN 0.08::DOUBLE ELSE 0::DOUBLE END)), 2) END AS confidence FROM documents")
def page_confidence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", Q.confidence_of_length(F.col("n_chars"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0).alias("confidence"))


@query("""WITH b AS (SELECT l_orderkey, round_even(l_quantity / 10, 0) AS x FROM lineitem), g AS (SELECT l_orderkey, x, count(*) AS n FROM b GROUP BY ALL)
SELECT l_orderkey, sum(n)::BIGINT >= 6 AND count(*) FILTER (n >= 3) >= 2 AS has_table FROM g GROUP BY l_orderkey""")
def table_detect(spark, sf_dir):
    """Line items as the blocks of an order's page, their left edges by quantity."""
    blocks = F.collect_list(F.struct((F.col("l_quantity") / 10).alias("x0")))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(blocks.alias("b")).select("l_orderkey", Q.has_table(F.col("b")).alias("has_table"))


@query("SELECT user_id, arg_max('e' || event_id::VARCHAR, (value, length(event_id::VARCHAR), event_id::VARCHAR)) AS best_event, max(value) AS confidence FROM events GROUP BY user_id")
def ocr_argmax(spark, sf_dir):
    """Events as the results of one user's page variants."""
    tried = read(spark, sf_dir, "events").select("user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"), F.col("value").alias("confidence"), F.lit("none").alias("engine"))
    return best_variant(tried, "user_id").select("user_id", F.col("text").alias("best_event"), "confidence")


@query("SELECT user_id, count(*) AS n, round(CASE WHEN avg(value) > 1 THEN least(1::DOUBLE, avg(value) / 100) ELSE avg(value) END, 3) AS mean_confidence FROM events GROUP BY user_id")
def ocr_mean_conf(spark, sf_dir):
    """Events as the words of one user's picture."""
    made = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("value").alias("conf")))).alias("words"))
    return made.select("user_id", F.size("words").cast("long").alias("n"), Q.mean_confidence(F.col("words")).alias("mean_confidence"))


@query("""WITH b AS (SELECT l_orderkey, l_extendedprice AS y, l_quantity AS x, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, string_agg(n::VARCHAR, chr(10) ORDER BY y, x, n) AS page_text, sha256(string_agg(n::VARCHAR, chr(10) ORDER BY y, x, n)) AS sha256 FROM b GROUP BY l_orderkey""")
def page_order(spark, sf_dir):
    """Line items as the blocks of a page without a text layer, placed by price and quantity."""
    block = F.struct(F.col("l_quantity").cast("double").alias("x0"), F.col("l_extendedprice").cast("double").alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_linenumber").cast("string").alias("text"), F.col("l_linenumber").cast("int").alias("no"))
    pages = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(block).alias("blocks")).withColumn("layer", F.lit(""))
    return assess_pages(pages).select("l_orderkey", F.col("text").alias("page_text"), "sha256")


# ---- review, audit, retention, access

@query(f"{DECIDED} SELECT claim_key, 'pending' AS status, reasons AS decision_reasons FROM e WHERE decision = 'review' OR len(low) > 0")
def review_queue(spark, sf_dir):
    made = review.tasks(decided(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return made.select("claim_key", "status", F.array_join("decision.reasons", "|").alias("decision_reasons"))


REASONS_SQL = "list_filter([CASE WHEN len(issues) > 0 THEN 'validation_issues' END, CASE WHEN len(missing) > 0 THEN 'missing_required_fields' END, CASE WHEN decision = 'review' THEN 'decision_requires_human_review' END, CASE WHEN confidence < 0.8::DOUBLE THEN 'low_decision_confidence' END], lambda x: x IS NOT NULL)"


@query(f"{DECIDED} SELECT claim_key, CASE WHEN len({REASONS_SQL}) = 0 THEN 'unspecified_review_reason' ELSE array_to_string({REASONS_SQL}, '|') END AS reasons FROM e WHERE decision = 'review' OR len(low) > 0")
def review_reasons(spark, sf_dir):
    made = review.tasks(decided(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return made.select("claim_key", F.array_join("review_reasons", "|").alias("reasons"))


def feedback(spark, sf_dir):
    """Purchases as submissions on the claim of the user's number."""
    events = read(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("claim_key"), F.col("ts").alias("reviewed_at"), "event_id", F.col("event_type").alias("overridden_decision"), F.col("value").cast("string").alias("comments"))


@query(f"{DECIDED} SELECT count(*) AS pending FROM e WHERE (decision = 'review' OR len(low) > 0) AND claim_key NOT IN (SELECT user_id FROM events)")
def pending_count(spark, sf_dir):
    queue = review.tasks(decided(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return review.pending(queue, feedback(spark, sf_dir), "claim_key").agg(F.count("*").alias("pending"))


@query("SELECT user_id AS claim_key, event_id, event_type AS overridden_decision FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_feedback(spark, sf_dir):
    return review.latest(feedback(spark, sf_dir), "claim_key", tie="event_id").select("claim_key", "event_id", "overridden_decision")


@query(f"""{DECIDED}, l AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1)
SELECT claim_key, coalesce(l.event_type, decision) AS final_decision, CASE WHEN l.event_type IS NULL THEN e.vehicle ELSE 'corrected by ' || l.event_type END AS vehicle, e.damage AS damage FROM e LEFT JOIN l ON claim_key = user_id""")
def merge_corrections(spark, sf_dir):
    last = review.latest(feedback(spark, sf_dir), "claim_key", tie="event_id")
    fixed = F.create_map(F.lit("vehicle"), F.concat(F.lit("corrected by "), F.col("overridden_decision")), F.lit("damage"), F.lit(""))
    last = last.select("claim_key", "overridden_decision", review.corrections(fixed).alias("corrected"))
    n = F.col("normalized")
    joined = decided(spark, sf_dir).join(last, "claim_key", "left").withColumn("m", review.merged(F.create_map(F.lit("vehicle"), n["vehicle"]["value"], F.lit("damage"), n["damage"]["value"]), F.col("corrected")))
    return joined.select("claim_key", F.coalesce("overridden_decision", "decision.decision").alias("final_decision"), F.col("m")["vehicle"].alias("vehicle"), F.col("m")["damage"].alias("damage"))


@query("SELECT user_id AS claim_id, count(*) AS n_events, sha256(string_agg(event_type || ':' || event_id::VARCHAR, ',' ORDER BY ts, event_id)) AS events_sha256 FROM events GROUP BY user_id")
def audit_rebuild(spark, sf_dir):
    flat = read(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), F.col("ts").alias("timestamp"), "event_id", "event_type")
    held = audit.documents(flat, tie="event_id")
    said = F.array_join(F.transform("events", lambda e: F.concat(e["event_type"], F.lit(":"), e["event_id"].cast("string"))), ",")
    return held.select("claim_id", "n_events", F.sha2(said, 256).alias("events_sha256"))


@query(f"""WITH {CLAIMS} SELECT c.claim_id AS claim, CASE WHEN claim_key % 4 = 0 THEN c.claim_id || '_' || epoch(c.modified)::BIGINT::VARCHAR ELSE c.claim_id END AS moved_to FROM c WHERE modified < TIMESTAMP '2000-06-01' - INTERVAL 1825 DAY""")
def retention_archive_plan(spark, sf_dir):
    """Orders as claim folders; every fourth name is taken in the archive already."""
    held = claims(spark, sf_dir).select(F.col("claim_id").alias("claim"), "modified", "claim_key")
    return retention.archive_plan(held.select("claim", "modified"), held.filter("claim_key % 4 = 0").select("claim"), F.lit(AS_OF).cast("timestamp"), 0).select("claim", "moved_to")


@query(f"WITH {CLAIMS} SELECT claim_id AS claim FROM c WHERE modified < TIMESTAMP '2000-06-01' - INTERVAL 730 DAY")
def retention_delete_plan(spark, sf_dir):
    held = claims(spark, sf_dir).select(F.col("claim_id").alias("claim"), "modified")
    return retention.delete_plan(held, F.lit(AS_OF).cast("timestamp")).select("claim")


@query(f"{DECIDED} SELECT claim_key, raw_claim_id AS raw_id, CASE WHEN claim_key % 3 = 0 THEN NULL ELSE vehicle END AS vehicle, CASE WHEN claim_key % 5 = 0 THEN NULL ELSE decision END AS decision FROM e")
def load_claim(spark, sf_dir):
    """Four stage tables, two of them with gaps."""
    made = decided(spark, sf_dir)
    stage = lambda keep, **columns: made.filter(keep).select("claim_key", *[F.col(c).alias(k) for k, c in columns.items()])
    joined = load_claims(stage("true", raw_id="claim_id"), stage("true", text="damage"), stage("claim_key % 3 <> 0", vehicle="normalized.vehicle.value"), stage("claim_key % 5 <> 0", decision="decision.decision"), "claim_key")
    return joined.select("claim_key", F.col("raw.raw_id").alias("raw_id"), F.col("fields.vehicle").alias("vehicle"), F.col("decision.decision").alias("decision"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS allowed FROM customer")
def role_check(spark, sf_dir):
    users = spark.sql("SELECT * FROM VALUES ('u0', 'admin'), ('u1', 'reviewer'), ('u2', 'auditor'), ('u3', 'viewer') AS t(username, role)")
    people = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("u"), (F.col("c_custkey") % 5).cast("string")).alias("username"))
    return access.with_access(people, F.broadcast(users), "reviewer").select("c_custkey", "allowed")


# ---- extensions: reports over decisions, which the claims rules themselves do not have

@query(f"{DECIDED} SELECT segment, decision, count(*) AS n FROM e GROUP BY ROLLUP (segment, decision)")
def decision_rollup(spark, sf_dir):
    made = decided(spark, sf_dir).select("segment", F.col("decision.decision").alias("decision"))
    return made.rollup("segment", "decision").agg(F.count("*").alias("n"))


@query(f"{DECIDED} SELECT * FROM (SELECT segment, claim_key, round(risk, 3) AS risk_score, row_number() OVER (PARTITION BY segment ORDER BY round(risk, 3) DESC, claim_key)::INTEGER AS place FROM e) WHERE place <= 10")
def risk_rank(spark, sf_dir):
    made = decided(spark, sf_dir).select("segment", "claim_key", F.col("validation.risk_score").alias("risk_score"))
    order = Window.partitionBy("segment").orderBy(F.col("risk_score").desc(), "claim_key")
    return made.withColumn("place", F.row_number().over(order)).filter("place <= 10").select("segment", "claim_key", "risk_score", "place")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_event_audit(spark, sf_dir):
    made = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("hour"), "event_type", "n")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    made = read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return made.filter("n > 1")
