from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from adjudica import settings as S
from adjudica.operators import access, audit, infer, retention, review
from adjudica.operators.decide import decide
from adjudica.operators.validate import fallback, is_low, normalize_fields, validate
from adjudica.plans.pipeline import process_columns, process_text

AS_OF = date(2025, 11, 15)
GOOD = {"claim_id": "CLM-1", "policy_no": "POL-1", "claimant_name": "Asha", "phone": "9876543210", "email": "a@b.com", "vehicle": "Car", "damage": "bumper", "date": "2025-03-04", "amount_estimated": "100.00", "insured_amount": "1000"}
SCHEMA = ", ".join(f"{n} string" for n in S.FIELDS)


def run(spark, *changes):
    rows = [tuple({**GOOD, **c}[n] for n in S.FIELDS) for c in changes]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    return process_columns(df, AS_OF).orderBy("i").collect()


def test_validation(spark):
    good, missing, over, zero, odd, old, future, bad = run(
        spark, {}, {"claim_id": None, "date": "?"}, {"amount_estimated": "2000"}, {"amount_estimated": "0"}, {"phone": "0000000000", "email": "a@b.cm"},
        {"date": "2019-01-01", "insured_amount": None}, {"date": "2026-01-01"}, {"phone": "12", "email": "nope", "amount_estimated": "none"},
    )
    v = good.validation
    assert (v.issues, v.warnings, v.missing_required, v.risk_score, v.recommendation, v.is_complete) == ([], [], [], 0.1, "approve", True)
    assert v.decision_reasons == ["All required fields valid."] and v.explainability.field_success_map["phone"]
    v = missing.validation
    assert v.missing_required == ["claim_id", "date"] and v.recommendation == "review" and v.warnings == ["date_invalid_format"]
    assert v.risk_score == pytest.approx(0.1 + 0.4 + 0.05 + 0.05) and v.explainability.low_confidence_fields == ["date"]
    v = over.validation
    assert v.issues == ["amount_exceeds_insured"] and v.recommendation == "reject" and v.risk_score == pytest.approx(0.63)
    assert zero.validation.issues == ["non_positive_amount"] and zero.validation.decision_reasons == ["Claim amount is zero or negative."]
    assert odd.validation.warnings == ["email_domain_suspicious", "phone_suspicious"]
    assert old.validation.warnings == ["date_too_old", "insured_amount_missing_or_invalid"] and old.validation.fields.insured_amount.notes == "not_provided"
    assert future.validation.warnings == ["date_in_future"]
    v = bad.validation
    assert v.issues == ["amount_estimated_missing", "amount_missing_or_invalid"] and v.warnings == ["email_normalization_failed", "phone_normalization_failed"]
    assert v.risk_score == pytest.approx(min(1, 0.1 + 0.2 + 0.36 + 0.1 + 0.15))


def test_unreadable_fields(spark):
    df = normalize_fields(spark.createDataFrame([tuple(GOOD.values())], SCHEMA), AS_OF).withColumn("normalized", F.when(F.lit(False), F.col("normalized")))
    row = decide(validate(df, AS_OF)).select("decision", fallback(F.col("validation")).alias("v")).first()
    assert row.v.issues == ["validator_error"] and row.v.risk_score == 1.0 and row.v.recommendation == "review"
    assert (row.decision.reasons, row.decision.confidence, row.decision.flags) == (["decision_failed"], 0.4, ["engine_error"])


def test_several_candidates_and_labels(spark):
    df = normalize_fields(spark.createDataFrame([tuple(GOOD.values())], SCHEMA), AS_OF).withColumn("many", F.array(F.lit("phone"), F.lit("email")))
    assert validate(df, AS_OF, several_col="many").first().validation.warnings == ["email_multiple_candidates", "phone_multiple_candidates"]
    rows = spark.createDataFrame([(0.5, None), (0.7, "Weak"), (None, "high"), (0.6, None)], "s double, l string")
    assert [r[0] for r in rows.select(is_low(F.col("s"), F.col("l"))).collect()] == [True, True, False, False]


def test_decisions(spark):
    got = [r.decision for r in run(spark, {}, {"amount_estimated": "0"}, {"amount_estimated": "1000.01"}, {"amount_estimated": "900"}, {"insured_amount": None}, {"damage": "Engine FIRE"}, {"phone": "1"}, {"insured_amount": "", "phone": "1"}, {"amount_estimated": "", "insured_amount": "0"})]
    assert [(d.decision, d.confidence, d.requires_human) for d in got] == [
        ("approve", 0.9, False), ("reject", 0.95, False), ("reject", 0.95, False), ("review", 0.75, True), ("review", 0.45, True), ("approve", 0.9, False), ("approve", 0.7, True), ("review", 0.25, True), ("review", 0.45, True),
    ]
    assert got[0].reasons == ["amount_within_insured_limit"] and got[0].flags == ["within_limit"]
    assert got[5].reasons == ["high_risk_damage_detected", "amount_within_insured_limit"] and got[5].flags == ["high_risk", "within_limit"]
    assert got[4].reasons == ["insured_amount_missing_or_invalid", "insufficient_amount_information"] and got[4].flags == ["missing_insured_amount"]
    assert got[7].evidence.low_confidence_fields == ["phone"] and got[7].flags == ["missing_insured_amount", "low_confidence"]


FORM = "Claim Reference: CLM-998877\nPolicy Number: POL-12\nDate of Incident: 2025-03-04\nFull Name: Asha Example\nPhone: 9876543210\nInsured Amount: 3000\nDamage: bumper\nEstimated Cost: 100.00\n"


def test_pipeline_from_text(spark):
    df = spark.createDataFrame([(1, FORM), (2, ""), (3, "no fields at all")], "n int, raw_text string")
    got = {r.n: r for r in process_text(df, AS_OF).collect()}
    assert got[1].decision.decision == "approve" and got[1].validation.recommendation == "approve" and not got[1].hitl_required
    assert got[1].summary.summary == "Claim CLM-998877 for Unknown, estimated amount 100.00." and got[1].inferred.policy_no.value == "POL-12"
    assert got[2].extract_notes == ["EMPTY_TEXT"] and got[2].hitl_required and got[3].validation.recommendation == "review"


def test_inference(spark):
    text = "Name: asha o'neil\nemail a@b.com, +91 98765-43210 on 2024/01/02 paid Rs. 1,500.50\nDamage: door \nModel: XY\nref CLM-77 PNL/9"
    got = spark.createDataFrame([(text,)], "t string").select(*[infer.rule_value(n, F.col("t")).alias(n) for n in S.FIELDS]).first()
    assert (got.claim_id, got.phone, got.email, got.date, got.damage, got.vehicle) == ("CLM-77", "+919876543210", "a@b.com", "2024/01/02", "door", "XY")
    assert got.amount_estimated == got.insured_amount == "Rs. 1,500.50" and got.claimant_name == "Asha O"
    df = spark.createDataFrame([(text, {"vehicle": "From a model", "date": ""})], "raw_text string, answers map<string,string>")
    row = infer.infer(df, AS_OF, extracted_col=None, answers_col="answers").first().inferred
    assert row.vehicle.value == "From a model" and row.amount_estimated.value == "1500.50" and row.date.notes == "parsed"


def test_summaries(spark):
    df = process_text(spark.createDataFrame([(1, FORM, '{"summary": "s", "confidence": "0.9"}'), (2, FORM, "not json"), (3, "x", None)], "n int, raw_text string, answer string"), AS_OF, summary_col="answer")
    got = {r.n: r.summary for r in df.collect()}
    assert (got[1].source, got[1].summary, got[1].confidence, got[1].decision) == ("llm", "s", 0.9, "approve")
    assert got[2].source == got[3].source == "rule" and got[3].reasoning.startswith("Issues: amount_estimated_missing")
    assert "Missing: amount_estimated, claim_id" in got[3].reasoning


def test_review(spark):
    at = F.lit(datetime(2025, 1, 1))
    schema = "claim_id string, validation struct<issues:array<string>,missing_required:array<string>>, conf map<string,string>, decision struct<decision:string,confidence:double,requires_human:boolean>"
    rows = [("a", (["x"], []), {"phone": "0.2", "date": "low"}, ("review", 0.45, True)), ("b", ([], ["y"]), None, ("approve", 0.9, True)), ("c", ([], []), {}, ("approve", 0.9, True)), ("d", ([], []), {}, ("approve", 0.9, False))]
    queue = review.tasks(spark.createDataFrame(rows, schema), at, "conf")
    got = {r.claim_id: r.review_reasons for r in queue.collect()}
    assert got == {"a": ["validation_issues", "low_confidence_fields: ['phone']", "decision_requires_human_review", "low_decision_confidence"], "b": ["missing_required_fields"], "c": ["unspecified_review_reason"]}
    table = queue.select("claim_id", F.lit("old text").alias("raw_text"), F.create_map(F.lit("k"), F.lit("v"), F.lit("j"), F.lit("w")).alias("fields"), F.col("decision.decision").alias("decision"))
    later = F.lit(datetime(2025, 1, 2))
    ids = table.filter("claim_id in ('a')").select("claim_id")
    fixed = F.create_map(F.lit("k"), F.lit("new"), F.lit("j"), F.lit(""))
    sent = review.override(ids, "reject", "r1", at, "why").unionByName(review.submit(ids, fixed, "r2", later)).unionByName(review.approve(table.filter("claim_id = 'b'").select("claim_id"), "r3", at))
    assert [r.claim_id for r in review.pending(queue, sent).collect()] == ["c"] and review.orphans(sent, queue).count() == 0
    final = {r.claim_id: r for r in review.finals(table, sent, later).collect()}
    assert final["a"].final_fields == {"k": "new", "j": "w"} and final["a"].final_decision == "review" and final["a"].reviewer == "r2"
    assert final["b"].final_decision == "approve" and final["c"].reviewer is None and final["c"].raw_text == "old text"


def test_audit(spark):
    df = spark.createDataFrame([("a", datetime(2025, 1, 2)), ("a", datetime(2025, 1, 1)), ("b", datetime(2025, 1, 1))], "claim_id string, at timestamp")
    events = audit.events(df, "review_task_created", F.to_json(F.struct("claim_id")), F.col("at"))
    held = {r.claim_id: r for r in audit.documents(events).collect()}
    assert held["a"].n_events == 2 and [e.timestamp.day for e in held["a"].events] == [1, 2]
    assert audit.broken(events).count() == 0 and audit.broken(events.withColumn("details", F.lit("{}"))).count() == 3
    assert [r.timestamp.day for r in audit.trail(events, "a").collect()] == [1, 2]


def test_retention(spark):
    as_of = F.lit(datetime(2025, 1, 1))
    claims = spark.createDataFrame([("new", datetime(2024, 12, 1)), ("old", datetime(2019, 1, 1)), ("taken", datetime(2018, 1, 1)), ("gone", None)], "claim string, modified timestamp")
    plan = {r.claim: r.moved_to for r in retention.archive_plan(claims, claims.filter("claim = 'taken'"), as_of, 0).collect()}
    assert plan == {"old": "old", "taken": "taken_1514764800"}
    assert {r.claim for r in retention.archive_plan(claims, claims.limit(0), as_of, 10).collect()} == {"new", "old", "taken"}
    assert {r.claim for r in retention.delete_plan(claims, as_of, 0).collect()} == {"new", "old", "taken"}
    deleted = retention.delete_plan(claims, as_of)
    assert {r.claim for r in retention.kept(claims, deleted).collect()} == {"new", "gone"}


def test_access(spark, capsys):
    users = spark.createDataFrame([("root", "admin"), ("rita", "reviewer")], "username string, role string")
    people = spark.createDataFrame([("root",), ("rita",), ("nobody",)], "username string")
    allowed = lambda u, role: {r.username: r.allowed for r in access.with_access(people, u, role).collect()}
    assert allowed(users, "reviewer") == {"root": True, "rita": True, "nobody": False} and not allowed(users, "auditor")["rita"]
    more = access.add_user(access.remove_user(users, "rita"), "nobody", "viewer")
    assert allowed(more, "viewer") == {"root": True, "rita": False, "nobody": True}
    with pytest.raises(ValueError):
        access.add_user(users, "x", "king")
    logger = access.masked_logger("masks")
    assert access.masked_logger("masks") is logger and len(logger.handlers) == 1
    logger.warning("mail %s or 9876543210", "john.doe@example.com")
    assert "joh***@example.com or 98******10" in capsys.readouterr().err


def test_settings_from_conf_and_environment():
    from adjudica.settings import Settings

    conf = {"adjudica.low_score": "0.7"}.get
    made = Settings.load(conf, {"ADJUDICA_LOW_SCORE": "0.1", "ADJUDICA_ARCHIVE_DAYS": "30"})
    assert (made.low_score, made.archive_days, made.max_amount) == (0.7, 30, 1e10)
    with pytest.raises(ValueError):
        Settings.load(env={"ADJUDICA_FUTURE_DAYS": "soon"})


def test_event_hashes_know_no_time_zone(spark, tmp_path):
    from adjudica.operators import audit

    flat = audit.events(spark.createDataFrame([("c", datetime(2025, 1, 1))], "claim_id string, at timestamp"), "saved", F.lit("{}"), F.col("at"))
    flat.write.parquet(f"{tmp_path}/events")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert audit.broken(spark.read.parquet(f"{tmp_path}/events")).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_latest_of_equal_times(spark):
    from adjudica.operators import review

    rows = [("c", datetime(2025, 1, 1), "a"), ("c", datetime(2025, 1, 1), "b"), ("d", datetime(2025, 1, 2), None)]
    picked = {tuple(review.latest(spark.createDataFrame(given, "claim_id string, reviewed_at timestamp, comments string").repartition(3)).orderBy("claim_id").collect()) for given in (rows, rows[::-1])}
    assert len(picked) == 1 and review.latest(spark.createDataFrame(rows, "claim_id string, reviewed_at timestamp, comments string"), tie="comments").filter("claim_id = 'c'").first().comments == "b"
