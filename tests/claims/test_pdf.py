import zlib
from datetime import date

from hypothesis import given, settings, strategies as st

from adjudica.plans.pipeline import process_files
from adjudica.sources import files, pages, pdf

MAP = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0041> <02> <20B9> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange 1 beginbfrange <20> <21> [<0058> <00590059>] endbfrange"


def stream(number, content, head=b"", flate=True):
    body = zlib.compress(content) if flate else content
    return b"%d 0 obj\n<< %s /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (number, head, len(body), b"/Filter /FlateDecode" if flate else b"", body)


def document(*contents, flate=True, packed=False, extra=b""):
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    plain = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] /Resources 3 0 R >>" % (kids, len(contents)),
        3: b"<< /Font << /F1 4 0 R /F2 5 0 R >> >>", 4: b"<< /Type /Font /BaseFont /Helvetica >>", 5: b"<< /Type /Font /ToUnicode 6 0 R >>",
    }
    for i in range(len(contents)):
        plain[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
    out = b"%PDF-1.7\n%\xe2\xe3\n"
    if packed:
        body, head = b"", b""
        for n, value in plain.items():
            head += b"%d %d " % (n, len(body))
            body += value + b" "
        out += stream(90, head + body, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(head)))
    else:
        out += b"".join(b"%d 0 obj\n%s\nendobj\n" % item for item in plain.items())
    out += stream(6, MAP)
    for i, content in enumerate(contents):
        out += stream(11 + 2 * i, content, flate=flate)
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


CLAIM = b"BT /F1 12 Tf 50 700 Td (Claim Reference: CLM-12345) Tj 0 -14 Td (Policy \\(Number\\): P-777) Tj T* [(Spa) -20 (ced) -400 (out)] TJ ET"
SECOND = b"q 1 0 0 1 0 100 cm BT /F2 10 Tf 1 0 0 1 50 300 Tm <0110> Tj <021112> Tj ET Q % note (\nBT /F2 10 Tf 50 20 Td <2021> Tj ET BT /F1 9 Tf 50 500 Td (caf\\351 \\x) Tj ET"


def test_pages_and_places():
    for flate in (True, False):
        for packed in (True, False):
            one, two = pdf.read_pdf(document(CLAIM, SECOND, flate=flate, packed=packed))
            assert one["layer"] == "Claim Reference: CLM-12345\nPolicy (Number): P-777\nSpaced out" and (one["page_no"], two["page_no"]) == (1, 2)
            assert [(b["x0"], b["y1"]) for b in one["blocks"]] == [(50.0, 100.0), (50.0, 114.0), (50.0, 126.0)]
            assert [(b["text"], b["y1"]) for b in two["blocks"]] == [("Aa\u20b9bc", 400.0), ("XYY", 780.0), ("caf\u00e9 x", 300.0)]


def test_what_is_no_pdf():
    assert [pdf.read_pdf(x)[0]["notes"] for x in (None, b"", b"text", b"%PDF-1.4 nothing")] == ["no PDF", "no PDF", "no PDF", "no pages"]
    assert pdf.read_pdf(document(CLAIM, extra=b"99 0 obj << >> endobj trailer << /Encrypt 99 0 R >>"))[0]["notes"] == "encrypted"
    assert pdf.read_pdf(document(b""))[0]["blocks"] == [] and not pdf.has_text(document(b"", b"", CLAIM)) and pdf.has_text(document(b"", CLAIM))
    loop = document(CLAIM).replace(b"/Parent 2 0 R /Contents 11 0 R", b"/Kids [2 0 R 10 0 R]          ")
    assert isinstance(pdf.read_pdf(loop), list)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 1200), st.integers(0, 60))
def test_broken_files_give_rows(noise, at, cut):
    whole = document(CLAIM, SECOND, flate=False)
    for raw in (whole[:at] + noise + whole[at + cut :], b"%PDF-1.4 " + noise, whole[:at]):
        rows = pdf.read_pdf(raw)
        assert rows and all(set(r) == {"page_no", "layer", "blocks", "notes"} for r in rows)


def test_predictors():
    raw = bytes([2, 1, 2, 3, 2, 1, 1, 1, 1, 5, 1, 1, 4, 9, 0, 0, 3, 2, 2, 2])
    assert pdf.unpredicted(raw, {"Predictor": 12, "Columns": 3}, lambda x: x)[:9] == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7])
    assert pdf.unpredicted(b"abc", {}, lambda x: x) == b"abc"


def test_from_files_to_decisions(spark, tmp_path):
    """A PDF with a text layer is routed as one, read, and its claim decided; one without is scanned."""
    (tmp_path / "a.pdf").write_bytes(document(CLAIM))
    (tmp_path / "b.pdf").write_bytes(document(b"0 0 m 10 10 l S"))
    (tmp_path / "c.txt").write_bytes(b"Claim Reference: CLM-99999")
    routed = files.route(pages.text_layer(files.read_files(spark, str(tmp_path))), has_text_col="has_text")
    assert {r.original_name: (r.processor, r.has_text) for r in routed.collect()} == {"a.pdf": ("pdf_text", True), "b.pdf": ("pdf_scanned", False), "c.txt": ("text_file", None)}
    done = {r.original_name: r for r in process_files(routed, date(2025, 11, 15), pages_text=pages.pdf_texts(routed)).collect()}
    assert done["a.pdf"].extracted.claim_id.value == "CLM-12345" and done["c.txt"].extracted.claim_id.value == "CLM-99999"
    assert done["b.pdf"].extract_notes == ["EMPTY_TEXT"]
