import unicodedata
from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from adjudica import settings as S
from adjudica.functions import normalize as N, redact as R, text as X
from adjudica.operators import extract as E
from adjudica.operators.extract import extract_fields, whole_amount
from adjudica.sources import adapters

AS_OF = date(2025, 11, 15)


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def outcomes(spark, values, f):
    return [(r.value, r.success, r.notes) for r in column(spark, values, f)]


def test_amounts(spark):
    cases = {
        "Rs. 15,500": ("15500.00", True, "normalized"), "$1200.50": ("1200.50", True, "normalized"), "no money here": ("", False, "no_numeric_found"), "Rs. 999999999999999": ("", False, "unrealistic_amount"),
        "": ("", False, "empty_input"), None: ("", False, "empty_input"), "₹1,25,000": ("125000.00", True, "normalized"), "1O0": ("100.00", True, "normalized"), "l5": ("15.00", True, "normalized"), "-5": ("-5.00", True, "normalized"),
    }
    assert outcomes(spark, list(cases), N.amount) == list(cases.values())


def test_dates(spark):
    cases = {
        "2024-10-12": ("2024-10-12", True, "iso_format"), "20241012": ("2024-10-12", True, "parsed"), "15-03-2023": ("2023-03-15", True, "parsed"), "05-03-2023": ("2023-05-03", True, "parsed"),
        "14-11-25": ("2025-11-14", True, "parsed"), "2024-1-5": ("2024-01-05", True, "parsed"), "15.03.2023": ("2023-03-15", True, "parsed"), "12 Oct 2024": ("", False, "parse_failed"), "": ("", False, "empty_input"),
        "12-12-1800": ("", False, "year_out_of_range"), "2O24-lO-l2": ("", False, "parse_failed"), "31-02-2023": ("", False, "parse_failed"),
    }
    assert outcomes(spark, list(cases), lambda x: N.date_text(x, AS_OF)) == list(cases.values())
    second = {"12 Oct 2024": "2024-10-12", "12th October 2024": "2024-10-12", "12/10/2024": "2024-10-12", "2024-10-12": "2024-10-12", "nothing": ""}
    assert [o[0] for o in outcomes(spark, list(second), lambda x: N.date_with_months(x, AS_OF))] == list(second.values())


def test_phones(spark):
    cases = {
        "+91 98765 43210": ("+919876543210", True, "generic_format"), "9876543210": ("+919876543210", True, "indian_format"), "09876543210": ("+919876543210", True, "leading_zero_indian"),
        "12345": ("", False, "invalid_length"), "": ("", False, "empty_input"), "1234567": ("+1234567", True, "generic_format"), "1" * 16: ("", False, "invalid_length"),
    }
    assert outcomes(spark, list(cases), N.phone) == list(cases.values())


def test_emails(spark):
    cases = {
        "john@gmai.com": ("john@gmail.com", True, "valid"), "john.doe (at) gmail.com": ("john.doe@gmail.com", True, "valid"), "not-an-email": ("", False, "missing_at_symbol"), "A@B.COM ": ("a@b.com", True, "valid"),
        "a@x.co.in": ("", False, "invalid_email_format"), "a@b@c.com": ("", False, "invalid_email_format"), "": ("", False, "empty_input"), "x@mail.yaho.com": ("x@yahoo.com", True, "valid"), "x@icloud.con": ("x@icloud.com", True, "valid"),
    }
    assert outcomes(spark, list(cases), N.email) == list(cases.values())


def test_strings_and_unicode(spark):
    assert outcomes(spark, ["ﬁle —  test x", None], N.string) == [("file - test x", True, "cleaned"), ("", False, "empty_input")]
    assert column(spark, ["Ａ１　b"], X.clean_unicode) == ["A1 b"]
    odd = ["½ ①", "plain", None, "", "ﬁn ²", "Ａ　ｂ", "é́", "ﷺ", "㍿", "ℌ", "¨", "각", "가", "ﾊﾟ", "😀"]
    assert column(spark, odd, X.nfkc) == [None if v is None else unicodedata.normalize("NFKC", v) for v in odd]
    assert column(spark, ["on 12 Oct 2024 maybe", "none", None], lambda x: adapters.fuzzy_date(x, "2000-07-09"))[0::2] == ["2024-10-12", None]
    assert [o[0] for o in outcomes(spark, ["null", " 5 "], lambda x: N.inferred("amount_estimated", x, AS_OF))] == ["", "5.00"]


def test_lines(spark):
    assert column(spark, ["a\r\nb\rc\n", "", "x", "a\n\nb"], X.split_lines) == [["a", "b", "c"], [], ["x"], ["a", "", "b"]]
    lines = "first\nVehicle hit 2 trees, badly.\n 2nd line, odd. \n\nnever"
    assert column(spark, [lines], lambda x: X.following(X.split_lines(x), F.lit(0), 3)) == ["Vehicle hit 2 trees, badly. 2nd line, odd."]
    assert column(spark, ["Some Plain Words", "Name:", "a1, b2", "abc"], X.is_header) == [True, True, False, False]
    assert column(spark, ["o'neil mCDONALD"], X.title) == ["O'Neil Mcdonald"]
    assert column(spark, ["a\x01\x01" * 1500, "a" * 3000, "\x01" * 10], X.is_gibberish) == [True, False, False]
    assert column(spark, ["/x/../y/a..b.pdf"], X.safe_name) == ["ab.pdf"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="0Ool1I5,.-Rs₹x ​", max_size=12), min_size=30, max_size=60))
def test_digit_repair_as_by_passes(spark, values):
    import re

    def plain(s):
        for a, d in (("[Oo]", "0"), ("[lI]", "1")):
            for p in (rf"(?<=\d){a}(?=\d)", rf"{a}(?=\d)", rf"(?<=\d){a}"):
                s = re.sub(p, d, s)
        return re.sub(r"[^\d.,\-₹Rs$ ]", "", s.replace("​", "")).strip()

    assert column(spark, values, X.repair_digits) == [plain(v) for v in values]


FORM = """MOTOR VEHICLE INSURANCE CLAIM FORM

Claim Reference: CLM-998877
Policy Number: POL-12
Date of Incident: 2025-03-04

Full Name: Asha Example
Contact Number: +91 98765 43210
Email Address: asha.example@example.com

Registration Number: XX-01-YZ-0001
Make: Sample
Model: Demo
Year: 2020

Insured Amount: ₹300000.00
Nature of Damage: Front bumper
Estimated Repair Cost: ₹12,345.50
"""


def one(spark, text):
    row = extract_fields(spark.createDataFrame([(text,)], "raw_text string")).first()
    return row, {n: (row.extracted[n].value, row.extracted[n].score, row.extracted[n].confidence, row.extracted[n].method) for n in S.EXTRACTED}


def test_form(spark):
    row, got = one(spark, FORM)
    assert got["claim_id"] == ("CLM-998877", 0.95, "high", "regex") and got["policy_no"][0] == "POL-12"
    assert got["claimant_name"] == ("Asha Example", 0.95, "high", "regex-line")
    assert got["phone"] == ("+919876543210", 0.85, "high", "alt-phone")
    assert got["email"][0] == "asha.example@example.com" and got["registration_no"][0] == "XX-01-YZ-0001"
    assert got["vehicle"] == ("INSURANCE CLAIM FORM", 0.85, "high", "multiline")
    assert (got["make"][0], got["model"][0], got["year"][0], got["date"][0]) == ("Sample", "Demo", "2020", "2025-03-04")
    assert got["damage"][0] == "Front bumper Estimated Repair Cost: ₹12,345.50"
    assert got["amount_estimated"] == ("₹ 12345.50", 0.95, "high", "labelled") and row.extracted["amount_estimated"].canonical == "12345.50"
    assert got["insured_amount"] == ("300000.00", 0.92, "high", "labelled")
    assert row.extract_notes == [] and len(row.raw_lines) == 18


def test_fallbacks(spark):
    _, got = one(spark, "Ravi Kumar\nour clm is AB12-77\npn QQ/778\nRepair estimate\n: 4 500 only, ok.\nClaimant Signature: R. Kumar")
    assert got["claim_id"] == ("AB12-77", 0.75, "medium", "keyword") and got["policy_no"][0] == "QQ/778"
    assert got["claimant_name"][3] == "signature" and got["amount_estimated"] == ("4500.00", 0.9, "high", "labelled-next")
    _, got = one(spark, "Ravi Kumar\nplain 12 words")
    assert got["claimant_name"] == ("Ravi Kumar", 0.7, "medium", "titlecase") and got["amount_estimated"] == ("12.00", 0.7, "medium", "heuristic")
    assert got["email"] == (None, 0.0, "low", "init")
    _, got = one(spark, "Estimated cost 45000")
    assert got["amount_estimated"][0] == "450.00"
    assert column(spark, ["₹45000", "Rs. 1,25,000.50", "none"], whole_amount) == ["45000.00", "125000.50", None]


def test_unfit_texts(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "é" * 3000), (3, "nothing here")], "n int, raw_text string")
    got = {r.n: r for r in extract_fields(df).collect()}
    assert [got[i].extract_notes for i in range(3)] == [["EMPTY_TEXT"], ["EMPTY_TEXT"], ["BINARY_OR_GIBBERISH_TEXT"]]
    assert got[3].extract_notes == [f"missing_{n}" for n in S.NOTED_IF_MISSING] and got[2].raw_lines == []


def test_masks(spark):
    assert column(spark, ["john.doe@example.com", "a@b.co", "none", ""], R.email) == ["joh*****@example.com", "a@b.co", "none", ""]
    assert column(spark, ["+91 98765 43210", "1234", "12345", "x"], R.phone) == ["98******10", "****", "12*45", "x"]
    assert column(spark, ["CLM-998877 and POL 12", "Claim: CLM-9", "no"], R.ids) == ["CLM-99***7 and POL 1*", "Claim: CL**9", "no"]
    assert column(spark, ["Asha", "Asha B Example", " "], R.name) == ["A***", "Asha E***", " "]
    text = "Asha Example wrote x.yz@example.com twice, x.yz@example.com; call 9876543210 on 2024-10-12. PN:AB12345"
    assert column(spark, [text, None, ""], R.text) == ["Asha E*** wrote x.**@example.com twice, x.**@example.com; call 98******10 on 20****12. PN:AB****5", None, ""]


def test_masks_in_nested_values(spark):
    df = spark.sql("SELECT 'a.bc@x.io' AS top, named_struct('keep', 'a.bc@x.io', 'deep', array(named_struct('m', 'a.bc@x.io', 'n', 5))) AS s, map('keep', 'a.bc@x.io', 'k', 'a.bc@x.io') AS m, 7 AS n, cast(null as struct<a:string>) AS none")
    row = R.redact_columns(df, keep=("keep",)).first()
    assert row.top == "a.**@x.io"
    assert row.s.keep == "a.bc@x.io" and row.s.deep[0].m == row.top != "a.bc@x.io" and row.s.deep[0].n == 5
    assert row.m == {"keep": "a.bc@x.io", "k": row.top} and row.n == 7 and row.none is None


@pytest.mark.parametrize("text, block", [("so {\"a\": {\"b\": \"}\"}} x", "{\"a\": {\"b\": \"}\"}}"), ("none", None), ("{open", None), (None, None)])
def test_json_blocks(text, block):
    assert adapters.json_block_of(text) == block


def test_tolerant_json(spark):
    got = column(spark, ['{"k": "v"}', "{'k': 'v',}", "nope {", None], lambda x: F.try_variant_get(X.tolerant_json(x), "$.k", "string"))
    assert got == ["v", "v", None, None]


def test_superscripts_and_ligatures_are_folded_in_the_plan(spark):
    """Compatibility forms reach every normalizer, inside the nested plan too."""
    from adjudica.plans.pipeline import process_columns

    row = {n: "" for n in S.FIELDS} | {"claim_id": "CLM\u2011①", "amount_estimated": "Rs. １２３.５０", "date": "２０２５-01-02", "email": "ａ@b.com", "phone": "９８７６５４３２１０", "vehicle": "oﬃce　car"}
    got = process_columns(spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in row)), AS_OF).first().normalized
    assert (got.amount_estimated.value, got.date.value, got.email.value, got.phone.value, got.vehicle.value) == ("123.50", "2025-01-02", "a@b.com", "+919876543210", "office car")


def test_dates_with_months_in_the_plan(spark):
    from adjudica.plans.pipeline import process_text

    df = spark.createDataFrame([("Claim Reference: CLM-12345\nDate: 5 March 2025\nPolicy Number: P-1234\nPolicy Number: P-9999",)], "raw_text string")
    made = process_text(df, AS_OF, months=True, warn_several=True).first()
    assert made.normalized.date.value == "2025-03-05" and "policy_no_multiple_candidates" in made.validation.warnings
    plain = process_text(df, AS_OF).first()
    assert not plain.normalized.date.success and "policy_no_multiple_candidates" not in plain.validation.warnings


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="Make Yr:20\x00-9\n\u20b9é\u00a0+()", max_size=60), min_size=10, max_size=40))
def test_first_line_as_by_lines(spark, texts):
    """One search of the joined lines finds what a search line by line does, for plain texts and others."""
    import re

    for pattern in (S.PHONE, S.YEAR, S.MAKE):
        got = column(spark, texts, lambda x, p=pattern: X.first_found(X.one_text(X.split_lines(x)), p, 1, X.is_plain(x)))
        own = re.compile(X.ascii_form(pattern).replace("(?i)", ""), re.IGNORECASE if "i" in pattern[:4] else 0)
        for text, value in zip(texts, got, strict=True):
            lines = [line.strip() for line in re.split(S.LINE_END, text)]
            assert value == next((m.group(1) for line in lines if (m := own.search(line))), None)


def test_a_pattern_runs_once_in_a_held_value(spark):
    x = F.col("x")
    made = spark.createDataFrame([("Ab 1",), ("",), (None,)], "x string").select(X.held(X.found(x, "([A-Z]b)")).alias("y"), X.held(E.phone_value(X.found(x, r"(\d)"))).alias("z"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2
    assert [tuple(r) for r in made.collect()] == [("Ab", "1"), (None, None), (None, None)]


def test_lines_are_searched_from_the_first_match_on(spark):
    texts = ["one\n vehicle\nVehicle:  Red  Car \nwith 2 racks\n\nMake: X", "a\x00Vehicle: Blue\nVehicle: Green\n", "none", "Vehicle: é Van\nloss", "\n\nVehicle: Last"]
    want = ["Red  Car with 2 racks", "Blue Vehicle: Green", None, "é Van loss", "Last"]
    made = E.extract_fields(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string"), names=("vehicle",)).orderBy("i")
    assert [r.extracted.vehicle.value for r in made.collect()] == want
