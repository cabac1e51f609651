import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkattest import constants as C
from sparkattest.functions import domains as D
from sparkattest.functions import fields as X
from sparkattest.functions import scores as S
from sparkattest.functions import text as T
from sparkattest.operators.extraction import extract_fields

TEXT = """Certificate of Completion
This is to certify that John Walker
has completed the course Data Science
Issued by University of Cambridge and was awarded the grade A
Marks: 95 out of 100
Date: June 15, 2022
Certificate ID: CERT-2022-123455
Verification Code: ab12CD34
"""


def fields(spark, text, **options):
    return extract_fields(spark.createDataFrame([(1, text)], "id int, text string"), **options).first().asDict(recursive=True)


def test_whole_document(spark):
    f = fields(spark, TEXT)
    assert f["cert_id"] == "CERT-2022-123455"
    assert f["candidate_name"] == "John Walker"
    assert f["organization"] == "University of Cambridge"
    assert f["issue_date"] == "2022-06-15"
    assert (f["marks_obtained"], f["marks_total"], f["grade"]) == (95.0, 100.0, "A")
    assert f["certificate_title"] == "Certificate of Completion"
    assert [c["code"] for c in f["verification_codes"]] == ["ab12CD34", "CERT-2022-123455"]
    assert [c["kind"] for c in f["verification_codes"]] == ["issuer_verification_code", "certificate_id"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("on June 15, 2022 at", "2022-06-15"), ("15 June 2022", "2022-06-15"), ("15/06/2022", "2022-06-15"),
        ("2022-6-5", "2022-06-05"), ("3rd Sept 1999", "1999-09-03"), ("2024-02-31", "2024-02-31"), ("no date", None),
        ("in 1995 and 3.4.2001", "2001-04-03"),
    ],
)
def test_date_layouts(spark, text, expected):
    assert fields(spark, text)["issue_date"] == expected


def test_names_and_organizations(spark):
    assert fields(spark, "Asha Avery has completed tasks")["candidate_name"] == "Asha Avery"
    assert fields(spark, "The Training Academy has completed the audit")["candidate_name"] is None
    bare = "CERTIFICATE\nJOHN QUENTIN WALKER\nsome words"
    assert fields(spark, bare, org_guard=False)["candidate_name"] == "JOHN QUENTIN WALKER"
    assert fields(spark, bare)["candidate_name"] is None
    assert fields(spark, "JOHN QUENTIN WALKER\nsome words", org_guard=False)["candidate_name"] is None
    assert fields(spark, "Awarded by the course faculty\nCisco Academy\n")["organization"] == "Cisco Academy"


def test_course_block_above_title(spark):
    text = "Rohith Kumar\nIntroduction to Software\nSimulation\nCertificate of Completion\nAwarded to Rohith Kumar\nIssued by Forage Academy\n"
    assert fields(spark, text)["course"] == "Introduction to Software Simulation"
    assert fields(spark, "MBA holders meet")["course"] == "MBA"


def test_codes_keep_the_first_label(spark):
    text = "Enrolment verification code: QWERTY99 and verification code QWERTY99, serial no. 12345"
    codes = fields(spark, text)["verification_codes"]
    assert [(c["label"], c["code"]) for c in codes] == [("enrolment verification code", "QWERTY99"), ("serial no", "12345")]


def test_grade_pitfall(spark):
    assert fields(spark, "upgraded system")["grade"] == "D"
    assert fields(spark, "upgraded system", strict_grade=True)["grade"] is None
    assert fields(spark, "Grade: B", strict_grade=True)["grade"] == "B"


def test_empty_text(spark):
    f = fields(spark, None)
    assert f["cert_id"] is None and f["organization"] == "" and f["verification_codes"] == []


@pytest.mark.parametrize(
    "value,expected",
    [("sJLRwfFRRwiZ6mSZk", "sJLR**********SZk"), ("abcd", "****"), ("abcdef", "abcd****ef"), (None, ""), ("  ab ", "**")],
)
def test_masking(one, value, expected):
    assert one(T.mask_identifier(F.col("x")), "x string", value) == expected


def test_masking_inside_json(one):
    raw = '{"code":"sJLRwfFRRwiZ6mSZk","a":{"token":12,"name":"code"},"list":[{"cert_id":"CERT-2022-123455"}]}'
    masked = one(T.mask_json_values(F.col("x")), "x string", raw)
    assert masked == '{"code":"sJLR**********SZk","a":{"token":"**","name":"code"},"list":[{"cert_id":"CERT*********455"}]}'


def test_check_digit_and_bands(one):
    assert one(S.cert_id_checksum_valid(F.col("x")), "x string", "CERT-2022-123455")
    assert not one(S.cert_id_checksum_valid(F.col("x")), "x string", "CERT-2022-123456")
    assert not one(S.cert_id_checksum_valid(F.col("x")), "x string", None)
    assert one(S.grade_band(F.col("x")), "x double", 89.99) == "B"


def test_dates(one):
    assert one(S.parse_date(F.col("x")), "x string", "2024-02-31") is None
    assert one(S.parse_date(F.col("x")), "x string", "2024-02-28T10:00:00") == dt.date(2024, 2, 28)
    assert not one(S.date_consistent(F.col("x"), dt.date(2024, 1, 1)), "x date", dt.date(2024, 1, 2))
    assert one(S.pdf_timestamp(F.col("x")), "x string", "D:202401") is None
    assert one(S.pdf_timestamp(F.col("x")), "x string", "D:20240131") == dt.datetime(2024, 1, 31)


def test_types(spark):
    def flags(text):
        df = spark.createDataFrame([(text.lower(), "")], "t string, i string")
        return df.select(*[c.alias(n) for n, c in T.type_flag_columns(F.col("t"), F.col("i")).items()]).first()

    assert flags("We like technology")["technical"] == 0
    assert flags("Technical Certification in cloud")["technical"] == 1
    assert flags("University certification in engineering")["technical"] == 0
    assert flags("Certification for awsome people")["technical"] == 0


def test_domains(one):
    assert one(D.candidate_domains(F.col("x")), "x string", "Cisco Networking Academy") == [
        "cisco.networking.academy.com", "cisco.networking.academy.edu", "cisco.networking.academy.org",
        "cisco.networking.com", "cisco.networking.edu", "cisco.networking.org",
    ]
    assert one(D.candidate_domains(F.col("x")), "x string", "  ") == []


def test_constants_are_whole():
    assert len(C.FEATURE_COLUMNS) == 31 == len(set(C.FEATURE_COLUMNS))
    assert len(C.KNOWN_ISSUERS) == 39 and len(C.SUSPICIOUS_KEYWORDS) == 12 and len(C.CODE_LABELS) == 20


@pytest.mark.parametrize(("raw", "shown"), [
    ('{"identifier":{"value":"SECRET-123456"},"code":[["ABCDEFGH12345"]]}', '{"identifier":"****","code":"****"}'),
    ('{"a":{"code":{"x":"}]"},"b":1}}', '{"a":{"code":"****","b":1}}'),
    ('{"code":[1,{"token":"T"}],"b":[2]}', '{"code":"****","b":[2]}'),
    ('{"code":{"broken":', '{"withheld": "****"}'),
    ('{"b":{"c":[1]}}', '{"b":{"c":[1]}}'),
])
def test_masking_leaves_nothing_below_a_sensitive_key(one, raw, shown):
    assert one(T.mask_json_values(F.col("x")), "x string", raw) == shown


def test_longest_line_looks_at_each_line_once(spark):
    from sparkattest.functions.fields import course_longest_line

    lines = F.array(F.lit("Short"), F.lit("Alpha beta one"), F.lit("Gamma delta 12"), F.lit("Grade: excellent work"))
    df = spark.range(1).select(F.when(F.col("id") >= 0, lines).alias("lines")).select(
        course_longest_line(F.col("lines"), F.lit("x"), F.lit("")).alias("v"), course_longest_line(F.slice("lines", 1, 0), F.lit("x"), F.lit("")).alias("none")
    )
    assert tuple(df.first()) == ("Alpha beta one", None)  # the first of two equally long ones
    plan = spark.range(1).select(course_longest_line(F.array(F.col("id").cast("string")), F.lit("x"), F.lit("")).alias("v"))
    assert plan._jdf.queryExecution().analyzed().toString().count("roll[ \\t]+no") == 1


def test_words_that_hold_another_one_are_not_searched(spark):
    from sparkattest.functions.text import contains_any

    words = ["awarded", "award", "is awarded", "seal", "award"]
    docs = spark.createDataFrame([("is awarded",), ("reward", ), ("awar",), ("seals",), ("",), (None,)], "low string")
    found = docs.select("low", contains_any(F.col("low"), words).alias("hit"))
    assert [r["hit"] for r in found.collect()] == [any(w in (r["low"] or "") for w in words) for r in docs.collect()]
    assert found._jdf.queryExecution().analyzed().toString().lower().count("contains(") == 2


def test_kinds_of_codes_follow_their_labels(spark):
    import re

    docs = spark.createDataFrame([(label.title() + ": ab-" + str(n),) for n, label in enumerate(C.CODE_LABELS)], "text string")
    for label, row in zip(C.CODE_LABELS, docs.select(X.verification_codes(F.col("text")).alias("codes")).collect(), strict=True):
        kind = (
            "certificate_id" if re.search("certificate|certification|credential", label)
            else "reference_number" if re.search("reference|serial", label) else "issuer_verification_code"
        )
        assert [(c["label"], c["kind"]) for c in row["codes"]] == [(label, kind)]
    twice = spark.createDataFrame([("Serial No: abcd\nReference No: abcd\nCredential ID: efgh\nSerial No: abcd",)], "text string")
    codes = twice.select(X.verification_codes(F.col("text")).alias("codes")).first()["codes"]
    assert [(c["label"], c["code"]) for c in codes] == [("credential id", "efgh"), ("reference no", "abcd")]
