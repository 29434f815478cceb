"""Further named queries and their SQL: explanations, failures, review actions, audit hashes, files, pages, the store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from adjudica import settings as S
from adjudica.functions import text as X
from adjudica.operators import audit, infer as I, review
from adjudica.operators.decide import decide
from adjudica.operators.extract import extract_fields
from adjudica.operators.validate import ALL_VALID, CRITICAL, EXCEEDS, NOT_POSITIVE, SOME_WEAK, fallback
from adjudica.plans.claims import AS_OF, claims, forms
from adjudica.plans.queries import CLAIMS, DECIDED, VALID, decided, feedback, query, read, sql_extracted
from adjudica.sources.files import decode_full, decode_plain, route
from adjudica.sources.pages import assess_pages, document_text, ocr_result
from adjudica.sources.store import ClaimStore, export_json

# ---- validation and decision

SQL_GIVEN = f"list_filter([CASE WHEN list_contains(rules, 'amount_exceeds_insured') THEN '{EXCEEDS}' END, CASE WHEN list_contains(rules, 'non_positive_amount') THEN '{NOT_POSITIVE}' END], lambda x: x IS NOT NULL)"


@query(f"""{VALID} SELECT claim_key, CASE WHEN len({SQL_GIVEN}) > 0 THEN array_to_string({SQL_GIVEN}, '|') WHEN recommendation = 'approve' THEN '{ALL_VALID}' WHEN recommendation = 'review' THEN '{SOME_WEAK}' ELSE '{CRITICAL}' END AS reasons,
  0.6::DOUBLE AS threshold, (claim_id <> '')::INT + (policy_no <> '')::INT + (claimant_name <> '')::INT + (phone <> '')::INT + (email <> '')::INT + (vehicle <> '')::INT + (damage <> '')::INT + (date <> '')::INT + (amount <> '')::INT + (insured <> '')::INT AS n_success,
  CASE WHEN insured = '' THEN 'not_provided' ELSE 'normalized' END AS insured_note, phone <> '' AS phone_success FROM r""")
def validate_explained(spark, sf_dir):
    """Reasons, and what the explanation says of each field."""
    v, e = F.col("validation"), F.col("validation.explainability")
    return decided(spark, sf_dir).select(
        "claim_key", F.array_join(v["decision_reasons"], "|").alias("reasons"), e["low_confidence_threshold"].alias("threshold"),
        F.size(F.map_filter(e["field_success_map"], lambda k, x: x)).alias("n_success"), e["field_notes"]["insured_amount"].alias("insured_note"), e["field_success_map"]["phone"].alias("phone_success"),
    )


@query(f"""{DECIDED} SELECT claim_key, CASE WHEN claim_key % 7 = 0 THEN 'validator_error' ELSE array_to_string(issues, '|') END AS issues, CASE WHEN claim_key % 7 = 0 THEN 1.0::DOUBLE ELSE round(risk, 3) END AS risk_score,
  CASE WHEN claim_key % 7 = 0 THEN 'review' ELSE recommendation END AS recommendation, CASE WHEN claim_key % 7 = 0 THEN 'review' ELSE decision END AS decision, CASE WHEN claim_key % 7 = 0 THEN 'decision_failed' ELSE reasons END AS reasons, CASE WHEN claim_key % 7 = 0 THEN 0.4::DOUBLE ELSE confidence END AS confidence FROM e""")
def failure_rows(spark, sf_dir):
    """Every seventh claim's fields could not be read."""
    broken = F.col("claim_key") % 7 == 0
    made = decided(spark, sf_dir).withColumn("normalized", F.when(~broken, F.col("normalized"))).withColumn("validation", F.when(~broken, F.col("validation")))
    made = decide(made).withColumn("f", fallback(F.col("validation")))
    d = F.col("decision")
    return made.select("claim_key", F.array_join("f.issues", "|").alias("issues"), F.col("f.risk_score").alias("risk_score"), F.col("f.recommendation").alias("recommendation"), d["decision"].alias("decision"), F.array_join(d["reasons"], "|").alias("reasons"), d["confidence"].alias("confidence"))


# ---- inference and prompts

SQL_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in S.FIELDS) + "], lambda t: t IS NOT NULL)"
SQL_CONTEXT = "array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda t: trim(t)), lambda t: t <> '')[1:40], chr(10))"
PROMPT_HEAD = "Read the claim below and answer with one JSON object and nothing else. It has these keys, null where the claim does not say: "


@query(f"{sql_extracted(*S.FIELDS)} SELECT claim_key, array_to_string({SQL_MISSING}, ',') AS missing, md5('{PROMPT_HEAD}' || array_to_string({SQL_MISSING}, ', ') || '.' || chr(10) || chr(10) || 'Claim:' || chr(10) || {SQL_CONTEXT}) AS prompt_md5 FROM e")
def model_prompts(spark, sf_dir):
    """What a model would be asked for each text."""
    made = extract_fields(forms(spark, sf_dir), names=S.FIELDS).withColumn("missing", I.missing_fields(F.col("extracted")))
    return made.select("claim_key", F.array_join("missing", ",").alias("missing"), F.md5(I.prompt(F.col("raw_text"), F.col("missing"))).alias("prompt_md5"))


SQL_RULE_MAIL = "regexp_extract(x, '[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\\.[A-Za-z0-9]{2,}')"
SQL_RULE_DATE = "regexp_extract(x, '([0-9]{4}[-/][0-9]{2}[-/][0-9]{2})', 1)"
SQL_RULE_CLAIM = "regexp_extract(x, '(?i)CLM?[/\\-]?\\w+')"


def sql_mended(address: str) -> str:
    plain = f"lower({address})"
    return f"CASE WHEN regexp_full_match(regexp_replace({plain}, '@.*gmai\\.com.*$', '@gmail.com'), '[a-z0-9_.+\\-]+@[a-z0-9\\-]+\\.[a-z]{{2,}}') THEN regexp_replace({plain}, '@.*gmai\\.com.*$', '@gmail.com') ELSE '' END"


@query(f"{sql_extracted('claim_id', 'email', 'date')}, g AS (SELECT claim_key, coalesce(claim_id, nullif({SQL_RULE_CLAIM}, ''), '') AS c, coalesce(email, nullif({SQL_RULE_MAIL}, ''), '') AS m, coalesce(date, nullif({SQL_RULE_DATE}, ''), '') AS d FROM e) SELECT claim_key, trim(regexp_replace(c, '\\s+', ' ', 'g')) AS claim_id, {sql_mended('m')} AS email, CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN d ELSE '' END AS date FROM g")
def inferred_fields(spark, sf_dir):
    """What was extracted, else what a rule finds, normalized by field."""
    made = I.infer(extract_fields(forms(spark, sf_dir), names=S.FIELDS), AS_OF)
    return made.select("claim_key", *[F.col("inferred")[n]["value"].alias(n) for n in ("claim_id", "email", "date")])


def sql_value(name: str) -> str:
    return f"""'"{name}":{{' || CASE WHEN {name} IS NULL THEN '' ELSE '"value":' || to_json({name})::VARCHAR END || '}}'"""


@query(f"{sql_extracted(*S.FIELDS)} SELECT claim_key, md5('{{' || {sql_value('claim_id')} || ',' || {sql_value('policy_no')} || ',' || {sql_value('email')} || '}}') AS compact_md5 FROM e")
def compact_fields(spark, sf_dir):
    """Values as a prompt shows them: three fields' values as JSON, missing ones left out."""
    made = extract_fields(forms(spark, sf_dir), names=S.FIELDS)
    kept = F.from_json(I.compact(F.col("extracted")), "struct<" + ",".join(f"{n}:struct<value:string>" for n in ("claim_id", "policy_no", "email")) + ">")
    return made.select("claim_key", F.md5(F.to_json(kept)).alias("compact_md5"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled FROM part")
def title_case(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.title(F.col("p_name")).alias("titled"))


# ---- review and audit

@query(f"""{DECIDED} SELECT claim_key, CASE claim_key % 3 WHEN 0 THEN 'approve' WHEN 1 THEN NULL ELSE 'reject' END AS overridden_decision, CASE WHEN claim_key % 3 = 1 THEN vehicle END AS corrected_vehicle, CASE WHEN claim_key % 3 = 1 THEN false END AS has_damage,
  CASE WHEN claim_key % 3 = 2 THEN 'over the limit' END AS comments, 'review_completed' AS status FROM e""")
def review_actions(spark, sf_dir):
    """A third of the claims is approved, a third corrected, a third overridden; empty corrections are left out."""
    made = decided(spark, sf_dir).withColumn("claim_id", F.col("claim_key").cast("string"))
    third = lambda n: made.filter(F.col("claim_key") % 3 == n)
    given = F.create_map(F.lit("vehicle"), F.col("normalized.vehicle.value"), F.lit("damage"), F.lit(""))
    at = F.lit(AS_OF).cast("timestamp")
    rows = review.approve(third(0), "r1", at).unionByName(review.submit(third(1), given, "r1", at)).unionByName(review.override(third(2), "reject", "r1", at, "over the limit"))
    return rows.select(F.col("claim_id").cast("long").alias("claim_key"), "overridden_decision", F.col("corrected_fields")["vehicle"].alias("corrected_vehicle"), F.map_contains_key("corrected_fields", "damage").alias("has_damage"), "comments", "status")


@query(f"""{DECIDED}, l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1)
SELECT claim_key, coalesce('text of ' || event_type, 'claim ' || claim_key::VARCHAR) AS raw_text, vehicle, coalesce(event_type, damage) AS damage, CASE WHEN event_type IS NULL THEN decision ELSE event_type END AS final_decision, event_type IS NOT NULL AS reviewed FROM e LEFT JOIN l ON claim_key = user_id""")
def final_claims(spark, sf_dir):
    """Every claim after its last submission: text, fields and decision."""
    n = F.col("normalized")
    tasks = decided(spark, sf_dir).select("claim_key", F.concat(F.lit("claim "), F.col("claim_key").cast("string")).alias("raw_text"), F.create_map(F.lit("vehicle"), n["vehicle"]["value"], F.lit("damage"), n["damage"]["value"]).alias("fields"), F.col("decision.decision").alias("decision"))
    given = review.latest(feedback(spark, sf_dir), "claim_key", tie="event_id").withColumns({"corrected_fields": F.create_map(F.lit("damage"), F.col("overridden_decision"), F.lit("vehicle"), F.lit("")), "corrected_text": F.concat(F.lit("text of "), F.col("overridden_decision")), "reviewer": F.lit("r")})
    made = review.finals(tasks, given, F.lit(AS_OF).cast("timestamp"), "claim_key")
    return made.select("claim_key", "raw_text", F.col("final_fields")["vehicle"].alias("vehicle"), F.col("final_fields")["damage"].alias("damage"), "final_decision", F.col("reviewer").isNotNull().alias("reviewed"))


@query("SELECT event_id::VARCHAR AS claim_id, sha256(event_type || coalesce(props, '') || epoch_us(ts)::VARCHAR) AS event_hash FROM events")
def audit_hashes(spark, sf_dir):
    own = read(spark, sf_dir, "events")
    flat = own.select(F.col("event_id").cast("string").alias("claim_id"), "event_type", "props", "ts")
    return flat.select("claim_id", audit.event_hash(F.col("event_type"), F.col("props"), F.col("ts")).alias("event_hash"))


@query("SELECT user_id AS claim_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def audit_viewer(spark, sf_dir):
    """Every claim's events in the order that the viewer shows them."""
    flat = read(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), F.col("ts").alias("timestamp"), "event_id")
    held = audit.documents(flat, tie="event_id")
    return held.select("claim_id", F.posexplode("events").alias("at", "e")).select("claim_id", F.col("e.event_id").alias("event_id"), (F.col("at") + 1).cast("long").alias("place"))


# ---- files, pages, export, the store

SQL_PATH = "'in/../' || replace(p_name, ' ', '/') || CASE p_partkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.txt' WHEN 4 THEN '.eml' WHEN 5 THEN '.msg' WHEN 6 THEN '.doc' ELSE '' END"


@query(f"""WITH f AS (SELECT p_partkey, {SQL_PATH} AS path, p_partkey % 16 < 8 AS picture FROM part)
SELECT p_partkey, regexp_extract(path, '[^/]*$') AS name, CASE p_partkey % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN CASE WHEN picture THEN 'image' ELSE 'unknown' END WHEN 2 THEN CASE WHEN picture THEN 'image' ELSE 'unknown' END WHEN 3 THEN 'text' WHEN 4 THEN 'email' WHEN 5 THEN 'email' ELSE 'unknown' END AS type,
  CASE p_partkey % 8 WHEN 0 THEN CASE WHEN picture THEN 'pdf_text' ELSE 'pdf_scanned' END WHEN 1 THEN CASE WHEN picture THEN 'image_ocr' ELSE 'unknown' END WHEN 2 THEN CASE WHEN picture THEN 'image_ocr' ELSE 'unknown' END WHEN 3 THEN 'text_file' WHEN 4 THEN 'email_ingest' WHEN 5 THEN 'email_ingest' ELSE 'unknown' END AS processor,
  CASE WHEN p_partkey % 8 IN (1, 2) AND NOT picture THEN 'invalid_image' WHEN p_partkey % 8 IN (6, 7) THEN 'unsupported_extension' ELSE '' END AS route_notes FROM f""")
def file_routes(spark, sf_dir):
    """Parts as files, their kind by number: half of the pictures begin like pictures."""
    end = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".jpg", ".txt", ".eml", ".msg", ".doc", "")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    path = F.concat(F.lit("in/../"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), end)
    picture = F.col("p_partkey") % 16 < 8
    held = read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.when(picture, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.unhex(F.lit("00"))).alias("content"), picture.alias("has_text"))
    return route(held, has_text_col="has_text").select("p_partkey", X.safe_name(F.col("path")).alias("name"), "type", "processor", "route_notes")


SQL_FULL = "trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""SELECT doc_id, md5({SQL_FULL}) AS text_md5, len(list_filter(string_split({SQL_FULL}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS n_lines, octet_length(encode(text))::BIGINT AS n_bytes, md5(replace(replace(text, chr(65279), ''), chr(65533), '')) AS plain_md5 FROM documents""")
def file_texts(spark, sf_dir):
    """Documents as text files, read both ways."""
    held = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")).withColumn("full", decode_full(F.col("content")))
    return held.select("doc_id", F.md5("full.text").alias("text_md5"), F.size("full.lines").cast("long").alias("n_lines"), F.col("full.size").alias("n_bytes"), F.md5(decode_plain(F.col("content"))).alias("plain_md5"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_quantity::INT::VARCHAR AS text, l_returnflag AS layer FROM lineitem)
SELECT l_orderkey, trim(string_agg(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE text END, chr(10) ORDER BY l_linenumber, text), chr(10)) AS joined, count(*) AS num_pages, count(*) FILTER (l_linenumber % 2 = 0) AS n_scanned FROM p GROUP BY l_orderkey""")
def document_pages(spark, sf_dir):
    """Line items as the pages of an order's document; every second page is a picture without text."""
    said = F.concat("l_returnflag", F.lit(" "), F.col("l_quantity").cast("int").cast("string"))
    block = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), said.alias("text"), F.lit(0).alias("no")))
    odd = F.col("l_linenumber") % 2 == 1
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("int").alias("page_no"), F.when(odd, F.col("l_returnflag")).otherwise("").alias("layer"), F.when(odd, block).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,text:string,no:int>>")).alias("blocks"))
    made = assess_pages(pages)
    counted = made.groupBy("path").agg(F.count_if("scanned").alias("n_scanned"))
    return document_text(made).join(counted, "path").select(F.col("path").alias("l_orderkey"), F.col("raw_text").alias("joined"), F.col("num_pages").cast("long").alias("num_pages"), "n_scanned")


@query("""SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS text, count(*)::BIGINT AS n_lines FROM events WHERE event_type <> '' GROUP BY user_id""")
def ocr_lines(spark, sf_dir):
    """Events as the words that an OCR engine read for one user."""
    word = F.struct("event_id", F.concat(F.lit(" "), "event_type").alias("text"), F.lit(1).alias("left"), F.lit(2).alias("top"), F.lit(3).alias("width"), F.lit(4).alias("height"), F.lit(90.0).alias("conf"))
    held = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(word)).alias("words")).withColumn("engine", F.lit("e"))
    return ocr_result(held).select("user_id", "text", F.size("lines").cast("long").alias("n_lines"))


@query("SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'odd': CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment ELSE '' END})::VARCHAR AS json FROM customer")
def json_export(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).otherwise("").alias("odd"))
    return export_json(rows).select(F.get_json_object("json", "$.c_custkey").cast("long").alias("c_custkey"), "json")


@query(f"""WITH {CLAIMS} SELECT claim_id, CASE WHEN claim_key % 3 = 0 THEN 'second' ELSE 'first' END AS decision, CASE WHEN claim_key % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS batch FROM c WHERE claim_key % 5 <> 0 OR claim_key % 3 = 0""")
def store_roundtrip(spark, sf_dir):
    """Two batches: the second holds claims that the first has and others; then both are folded into one."""
    own = claims(spark, sf_dir).select("claim_id", "claim_key")
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = folder or f"file://{tempfile.mkdtemp()}"
    store = ClaimStore(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}")
    batch = lambda rows, name, n: rows.select("claim_id", F.lit(name).alias("decision"), F.lit(n).cast("long").alias("batch_no"))
    store.save("decision", batch(own.filter("claim_key % 5 <> 0"), "first", 1))
    store.save("decision", batch(own.filter("claim_key % 3 = 0"), "second", 2))
    store.compact("decision")
    return store.load("decision").select("claim_id", "decision", F.col("batch_no").alias("batch"))


