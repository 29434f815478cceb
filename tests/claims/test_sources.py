from datetime import date, datetime

from pyspark.sql import functions as F

from adjudica.sources import adapters, files, mail, pages
from adjudica.sources.store import ClaimStore, export_json, load_claims
from adjudica.streaming import intake
from adjudica.plans.pipeline import process_files

AS_OF = date(2025, 11, 15)
PNG = b"\x89PNG\r\n\x1a\n rest"
MAIL = b"From: a@b.com\r\nTo: c@d.com\r\nSubject: Claim\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=X\r\n\r\n--X\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--X\r\nContent-Type: text/plain\r\n\r\nClaim Reference: CLM-12345\r\n--X\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"../x.pdf\"\r\n\r\ndata\r\n--X--\r\n"


def folder(tmp_path):
    for name, content in {"a.txt": "﻿Claim Reference: CLM-998877\r\n".encode(), "b.PNG": PNG, "c.jpg": b"not a picture", "d.pdf": b"%PDF", "e.eml": MAIL, "f.xyz": b"?", "g.msg": b"?", "h.txt": b"caf\xe9 \n\n x "}.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_routes_and_text(spark, tmp_path):
    routed = files.route(files.read_files(spark, folder(tmp_path)))
    got = {r.original_name: r for r in routed.withColumn("full", files.decode_full(F.col("content"))).withColumn("plain", files.decode_plain(F.col("content"))).collect()}
    assert {n: (r.type, r.processor) for n, r in got.items()} == {
        "a.txt": ("text", "text_file"), "b.PNG": ("image", "image_ocr"), "c.jpg": ("unknown", "unknown"), "d.pdf": ("pdf", "pdf_scanned"),
        "e.eml": ("email", "email_ingest"), "f.xyz": ("unknown", "unknown"), "g.msg": ("email", "email_ingest"), "h.txt": ("text", "text_file"),
    }
    assert got["c.jpg"].route_notes == "invalid_image" and got["a.txt"].claim_id == "claim_" + got["a.txt"].sha256[:8]
    assert got["a.txt"].plain == "Claim Reference: CLM-998877\r\n" and got["h.txt"].plain == "caf \n\n x "
    assert (got["h.txt"].full.text, got["h.txt"].full.lines, got["h.txt"].full.encoding) == ("café \n\n x", ["café", "x"], "latin-1")
    mails = mail.read_mails(routed.filter("type = 'email'"))
    done = {r.original_name: r for r in process_files(routed, AS_OF, mails=mails).collect()}
    assert done["a.txt"].extracted.claim_id.value == "CLM-998877" and done["e.eml"].extracted.claim_id.value == "CLM-12345"
    assert done["b.PNG"].extract_notes == ["EMPTY_TEXT"]


def test_mail():
    got = mail.read_eml(MAIL)
    assert got["body"] == "Claim Reference: CLM-12345" and got["attachments"] == [{"name": "x.pdf", "content": b"data"}] and got["sender"] == "a@b.com" and got["subject"] == "Claim"
    assert mail.read_eml(b"Content-Type: text/html\r\n\r\n<b>only</b> html")["body"] == "only\n html"
    assert mail.read_msg(b"?") == mail.nothing("email")


def test_attachments_are_routed_like_files(spark, tmp_path):
    routed = files.route(files.read_files(spark, folder(tmp_path), "*.eml"))
    rows = files.route(mail.attachments(mail.read_mails(routed))).collect()
    assert [(r.original_name, r.type, r.processor, bytes(r.content), r.size) for r in rows] == [("x.pdf", "pdf", "pdf_scanned", b"data", 4)]
    kept = mail.attachments(mail.read_mails(routed).withColumn("claim_id", F.lit("c7"))).first()
    assert kept.claim_id == "c7" and kept.path.endswith("e.eml/0/x.pdf")


def test_html(spark):
    assert files.html_text("<p>a<b>b</b></p>&amp;<script>x</script>") == "a\nb\n&\nx" and files.html_text(None) == ""
    df = spark.createDataFrame([("<i>t</i>",), (None,)], "h string")
    assert [r[0] for r in df.select(files.html_to_text(F.col("h"))).collect()] == ["t", ""]


def test_pages(spark):
    grid = [(float(10 * c), float(r), 0.0, 0.0, f"cell {r}{c}", 3 * r + c) for r in range(3) for c in range(3)]
    rows = [("p", 1, "layer", grid, ""), ("p", 2, "", [], ""), ("p", 3, "t", [(5.0, 2.0, 0.0, 0.0, "second " * 60, 1), (1.0, 1.0, 0.0, 0.0, "first", 0)], "")]
    got = pages.assess_pages(spark.createDataFrame(rows, f"path string, {pages.PAGE_ROWS}"))
    by = {r.page_no: r for r in got.collect()}
    assert by[1].table_detected and not by[3].table_detected and by[2].scanned and not by[1].scanned
    assert by[1].text.startswith("cell 00\ncell 01") and by[3].text.startswith("first\nsecond")
    assert (by[1].confidence, by[2].confidence, by[3].confidence) == (0.27, 0.1, 0.7)
    assert pages.document_text(got).first().num_pages == 3


def test_words_and_adapters(spark):
    df = spark.createDataFrame([("a", b"x"), ("b", b"")], "path string, content binary")
    none = pages.ocr_result(pages.read_words(df)).collect()
    assert all((r.text, r.engine, r.confidence) == ("", "none", 0.0) for r in none)
    words = [{"text": " Hi ", "left": 1, "top": 2, "width": 3, "height": 4, "conf": 90.0}, {"text": " ", "left": 0, "top": 0, "width": 0, "height": 0, "conf": 0.0}, {"text": "you", "left": 5, "top": 6, "width": 7, "height": 8, "conf": None}]
    row = pages.ocr_result(pages.read_words(df, lambda raw: [{"words": words, "engine": "fake"}] if raw else [])).first()
    assert (row.text, row.confidence, row.lines[0].bbox) == ("Hi you", 0.45, [1, 2, 3, 4])
    variants = spark.createDataFrame([("a", "x", 0.2, "e"), ("a", "y", 0.9, "e")], "path string, text string, confidence double, engine string")
    assert pages.best_variant(variants).first().text == "y"
    ties = spark.createDataFrame([("a", "x", 0.9, "e"), ("a", "yy", 0.9, "e"), ("a", None, None, None), ("b", None, None, "n")], variants.schema)
    assert {r.path: r.text for r in pages.best_variant(ties).collect()} == {"a": "yy", "b": None}
    assert pages.open_pdf(df).count() == 2 and not pages.page_images(df).first().success


def test_model_adapter(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, None), (4, "bad")], "n int, prompt string")

    def client():
        def call(prompt):
            if prompt == "bad":
                raise RuntimeError
            return 'sure: {"vehicle": "Car"}'

        return call

    got = {r.n: r.m for r in adapters.ask(df, "prompt", client).select("n", adapters.answers_map(F.col("answer")).alias("m")).collect()}
    assert got[1] == got[2] == {"vehicle": "Car"} and got[3] is None and got[4] is None
    assert adapters.ask(df, "prompt").filter("answer is not null").count() == 0


def test_store(spark, tmp_path):
    store = ClaimStore(spark, f"file://{tmp_path}/store")
    (tmp_path / "in").mkdir()
    routed = files.route(files.read_files(spark, folder(tmp_path / "in"), "*.txt"))
    at = F.lit(datetime(2025, 1, 1))
    store.save_raw(routed, at)
    store.save_stages(process_files(routed, AS_OF), at)
    store.save_stages(process_files(routed, AS_OF), at)
    claims = store.claims().collect()
    assert len(claims) == 2 and all(c.decision.decision == "review" and c.fields.extracted is not None for c in claims)
    store.append("audit_events", routed.select("claim_id"))
    store.append("audit_events", routed.select("claim_id"))
    assert store.load("audit_events").count() == 4
    part = load_claims(*[store.load(s) for s in ("raw", "extracted", "fields")], store.load("decision").limit(0))
    assert all(r.decision is None for r in part.collect())
    assert '"claim_id"' in export_json(routed.select("claim_id", "size")).first().json


def test_store_keeps_all_batches(spark, tmp_path):
    """A second batch adds its claims and replaces decisions that changed; a batch without its mark doesn't count."""
    store = ClaimStore(spark, f"file://{tmp_path}/store")
    rows = lambda *given: spark.createDataFrame(list(given), "claim_id string, decision string, score double")
    held = lambda: sorted(tuple(r) for r in store.load("decision").collect())
    assert store.save("decision", rows(("c1", "review", 0.1), ("c2", "approve", 0.2))) == 1
    assert store.save("decision", rows(("c3", "reject", 0.3), ("c1", "approve", None))) == 2
    want = [("c1", "approve", None), ("c2", "approve", 0.2), ("c3", "reject", 0.3)]
    assert held() == want
    (tmp_path / "store" / "decision" / "batch=3").mkdir()
    assert held() == want and store.batches("decision") == [1, 2]
    assert store.save("decision", rows(("c4", "a", 1.0), ("c4", "a", 1.0))) == 4
    assert held() == [*want, ("c4", "a", 1.0)]
    assert store.compact("decision") == 5 and store.batches("decision") == [5] and held() == [*want, ("c4", "a", 1.0)]
    assert store.save("decision", rows()) == 6 and len(held()) == 4
    assert {(r.name, r.batch, r.n_rows) for r in store.load("manifest").collect()} == {("decision", n, k) for n, k in ((1, 2), (2, 2), (4, 2), (5, 4), (6, 0))}


def test_retention_is_carried_out(spark, tmp_path):
    from adjudica.operators import retention

    for name in ("c1", "c2"):
        (tmp_path / "claims" / name).mkdir(parents=True)
        (tmp_path / "claims" / name / "raw.txt").write_text(name)
    roots = [f"file://{tmp_path}/{name}" for name in ("claims", "archive")]
    plan = spark.createDataFrame([("c1", "c1_7"), ("c2", "c2"), ("gone", "gone"), ("..", "..")], "claim string, moved_to string")
    outcomes = lambda df: {r.claim: r.outcome for r in df.collect()}
    assert set(outcomes(retention.carry_out(plan, *roots, move=True)).values()) == {"planned"} and (tmp_path / "claims" / "c1").exists()
    want = {"c1": "moved", "c2": "moved", "gone": "missing", "..": "failed: odd name"}
    for _ in range(2):  # a task that runs again finds its work done
        assert outcomes(retention.carry_out(plan, *roots, move=True, dry_run=False)) == want
    assert (tmp_path / "archive" / "c1_7" / "raw.txt").read_text() == "c1" and not (tmp_path / "claims" / "c1").exists()
    assert outcomes(retention.carry_out(plan.filter("claim = 'c2'"), *roots, move=False, dry_run=False)) == {"c2": "deleted"}
    assert not (tmp_path / "archive" / "c2").exists() and (tmp_path / "archive" / "c1_7").exists()


def test_page_pictures():
    import numpy as np

    from adjudica.sources import enhance

    rng = np.random.default_rng(0)
    page = np.full((60, 90, 3), 200, np.uint8) + rng.integers(0, 20, (60, 90, 1)).astype(np.uint8)
    page[20:24, 10:80] = 40
    page = (page * np.linspace(0.6, 1, 90)[None, :, None]).astype(np.uint8)  # unevenly lit
    made = enhance.page(page)
    assert set(np.unique(made)) == {0, 255} and (made[20:24, 12:78] == 0).mean() > 0.95 and (made[40:, :] == 255).mean() > 0.8
    own = enhance.grey(page)
    assert own.shape == (60, 90) and enhance.grey(own) is not None and enhance.smooth(own).std() < own.std()
    plain = sum(np.pad(own.astype(float), 15, mode="edge")[15 + dy : 75 + dy, 15 + dx : 105 + dx] for dy in range(-15, 16) for dx in range(-15, 16)) / 31**2
    assert (enhance.threshold(own) == np.where(own > plain - 10, 255, 0)).all()
    assert set(enhance.variants(page)) == {"grey", "denoise", "contrast", "sharpen", "adaptive", "rotate"} and enhance.variants(page)["rotate"].shape == (90, 60)


def test_stream(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    source = folder(tmp_path / "drop")
    stream = intake.start(intake.drop_folder(spark, source).select("claim_id", "original_name", "raw_text"), AS_OF, f"{tmp_path}/out", f"{tmp_path}/check")
    stream.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {r.original_name for r in got.select("original_name").collect()} == {"a.txt", "h.txt"}
    (tmp_path / "events").mkdir(exist_ok=True)
    events = spark.readStream.schema("event_hash string, timestamp timestamp, event string").json(f"{tmp_path}/events")
    (tmp_path / "events").mkdir(exist_ok=True)
    (tmp_path / "events" / "e.json").write_text("\n".join(['{"event_hash": "h", "timestamp": "2025-01-01T00:00:00", "event": "x"}'] * 3))
    query = intake.once(events).writeStream.format("memory").queryName("once").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == 1
