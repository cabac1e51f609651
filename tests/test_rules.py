import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkattest import constants as C
from sparkattest.operators import evidence as E
from sparkattest.operators.evidence import fuse, masses_from_array
from sparkattest.operators.features import build_features
from sparkattest.operators.findings import FINDING_TYPE
from sparkattest.operators.intelligence import ood_status, review_priority, review_status
from sparkattest.operators.issuers import assess_issuer, registry_lookup
from sparkattest.plans.verify import verify_documents

AS_OF = dt.date(2025, 1, 1)


@pytest.mark.parametrize(
    "prediction,risk,high,medium,expected",
    [
        ("suspicious", 0.1, 0, 0, "high_risk"), ("genuine", 0.5, 0, 0, "high_risk"), ("genuine", 0.3, 0, 0, "manual_review"),
        ("genuine", 0.1, 1, 0, "manual_review"), ("genuine", 0.1, 0, 2, "manual_review"), ("genuine", 0.1, 0, 1, "low_risk"),
    ],
)
def test_review_status(one, prediction, risk, high, medium, expected):
    expr = review_status(F.col("p"), F.col("r"), F.col("h"), F.col("m"))
    assert one(expr, "p string, r double, h int, m int", prediction, risk, high, medium) == expected


@pytest.mark.parametrize(
    "risk,status,keys,dup,ood,completeness,structure,expected",
    [
        (0.1, "low_risk", [], False, "normal", 1.0, 1.0, "low"), (0.35, "low_risk", [], False, "normal", 1.0, 1.0, "medium"),
        (0.1, "low_risk", [], False, "insufficient_information", 1.0, 1.0, "medium"),
        (0.1, "low_risk", [], True, "normal", 1.0, 1.0, "high"), (0.9, "low_risk", [], False, "normal", 1.0, 1.0, "high"),
        (0.1, "low_risk", ["invalid_date"], False, "normal", 1.0, 1.0, "high"),
        (0.1, "low_risk", ["unknown_issuer"], False, "normal", 1.0, 1.0, "medium"),
        (0.1, "low_risk", [], False, "unusual", 1.0, 1.0, "high"), (0.1, "low_risk", [], False, "normal", 0.5, 1.0, "medium"),
    ],
)
def test_priority(spark, risk, status, keys, dup, ood, completeness, structure, expected):
    findings = [(k, k, "attention", "high" if k == "invalid_date" else "medium", "") for k in keys]
    row = spark.createDataFrame(
        [(risk, status, findings, dup, ood, completeness, structure)],
        f"r double, s string, f {FINDING_TYPE}, d boolean, o string, c double, t double",
    )
    got = row.select(review_priority(*[F.col(x) for x in "rsfdoct"]).alias("v")).first()["v"]
    assert got == expected


def test_ood(spark):
    schema = "primary_type string, structure_completeness double, issuer_status string, type_academic int, type_online int, type_workshop int, blank_document boolean, color_anomaly boolean, text_present boolean, high_findings int, c double"
    rows = [
        ("unknown", 0.0, "missing", 0, 0, 0, True, False, False, 0, 0.0),
        ("academic", 1.0, "ok", 1, 0, 0, False, False, True, 0, 1.0),
        ("academic", 1.0, "ok", 1, 1, 0, False, False, True, 0, 1.0),
        ("academic", 1.0, "ok", 1, 0, 0, False, False, True, 1, 1.0),
    ]
    got = spark.createDataFrame(rows, schema).select(ood_status(F.col("c"), F.lit(0), F.lit(0)).alias("v")).collect()
    assert [r["v"] for r in got] == ["insufficient_information", "normal", "unusual", "unusual"]


FUSE = "prediction string, risk_score double, positive_mass double, negative_mass double, fail_items int, tampering_status string, qr_status string, issuer_verification string, code_state string, anomaly_level string, duplicate_type string, ood_status string, ocr_failed boolean, text_present boolean, candidate_name string, organization string, course string, issue_date string"
BASE = dict(
    prediction="genuine", risk_score=0.1, positive_mass=5.0, negative_mass=0.0, fail_items=0, tampering_status="none_detected",
    qr_status="no_qr", issuer_verification="ISSUER_UNKNOWN", code_state="NO_CODE", anomaly_level="low", duplicate_type=None,
    ood_status="normal", ocr_failed=False, text_present=True, candidate_name="A", organization="B", course="C", issue_date="D",
)


@pytest.mark.parametrize(
    "change,decision,confidence",
    [
        ({}, "VERIFIED", 0.95), ({"ocr_failed": True}, "INSUFFICIENT_EVIDENCE", 0.85),
        ({"ood_status": "insufficient_information"}, "INSUFFICIENT_EVIDENCE", 0.85),
        ({"tampering_status": "strong_indicators"}, "SUSPICIOUS", -0.1), ({"duplicate_type": "cert_id"}, "SUSPICIOUS", -0.1),
        ({"qr_status": "verified_externally", "risk_score": 0.9}, "REQUIRES_VERIFICATION", 0.85),
        ({"negative_mass": 2.0, "positive_mass": 2.0, "fail_items": 1}, "SUSPICIOUS", 0.5),
        ({"negative_mass": 1.8, "risk_score": 0.6, "fail_items": 1}, "SUSPICIOUS", 0.116),
        ({"risk_score": 0.6}, "REQUIRES_VERIFICATION", 0.85), ({"code_state": "VERIFICATION_UNAVAILABLE"}, "REQUIRES_VERIFICATION", 0.85),
        ({"anomaly_level": "high"}, "REQUIRES_VERIFICATION", 0.85), ({"fail_items": 1, "negative_mass": 0.5}, "REQUIRES_VERIFICATION", 0.85),
        ({"positive_mass": 1.0}, "REQUIRES_VERIFICATION", 0.53),
        ({"issuer_verification": "VERIFICATION_UNAVAILABLE"}, "VERIFIED", 0.95),
    ],
)
def test_fusion_ladder(spark, change, decision, confidence):
    values = {**BASE, **change}
    row = spark.createDataFrame([tuple(values.values())], FUSE)
    got = fuse(row).first()
    assert (got["decision"], got["decision_confidence"]) == (decision, pytest.approx(confidence, abs=1e-9))


def test_masses_are_not_negative_and_match(spark):
    evidence = [[("PASS", "low", 0.5), ("FAIL", "high", 0.6), ("WARNING", "low", 0.1), ("UNKNOWN", "low", 0.1)]]
    df = spark.createDataFrame([tuple(evidence)], "evidence array<struct<status:string,severity:string,confidence:double>>")
    row = masses_from_array(df).first()
    assert (row["positive_mass"], row["negative_mass"], row["uncertain_items"], row["fail_items"]) == (0.5, 1.8, 2, 1)


ANOMALY = "array<struct<key:string,label:string,status:string,severity:string,detail:string>>"
SMALL = "prediction string, risk_score double, confidence double, ocr_failed boolean, extraction_method string, text_present boolean, extraction_confidence double, structure_completeness double, primary_type string, credential_statement boolean, candidate_name string, organization string, course string, issue_date string, forensic_anomalies " + ANOMALY
SMALL_ROW = ("genuine", 0.2, 0.3, False, "pdf_text", True, 0.6, 0.5, "unknown", False, "A", "B", "C", "D", [(f"k{i}", "l", "w", "low", "d") for i in range(7)])


def test_declared_provider_changes_the_decision(spark):
    from sparkattest.operators.models import ScorerRegistry

    row = spark.createDataFrame([SMALL_ROW], SMALL)
    assert fuse(E.with_masses(row)).first()["decision"] == "REQUIRES_VERIFICATION"
    registry = ScorerRegistry()
    registry.register("second", lambda d: d.withColumns({"prediction": F.lit("genuine"), "risk_score": F.lit(0.05), "confidence": F.lit(0.95)}))
    scored = registry.apply(row)
    got = fuse(E.with_masses(scored, providers=registry.providers())).first()
    assert (got["decision"], got["risk_score"], got["confidence"]) == ("VERIFIED", 0.2, 0.3)  # the main verdict is untouched

    def against(df):
        return [E.Item("watch", "EXTERNAL", "watch_list", F.col("organization") == "B", "FAIL", "high", 0.9, "Listed.")]

    got = fuse(E.with_masses(scored, providers=[*registry.providers(), against])).first()
    assert got["decision"] == "SUSPICIOUS" and got["fail_items"] == 1


@pytest.mark.parametrize("limits,kept", [(E.ITEM_LIMITS, 5), (E.ALL_ITEMS, 7), ({"forensic_anomalies": 2}, 2)])
def test_item_limits_can_be_lifted(spark, limits, kept):
    row = spark.createDataFrame([SMALL_ROW], SMALL)
    both = E.with_masses(E.with_evidence_items(row, limits=limits), limits=limits)
    sums = ["positive_mass", "negative_mass", "uncertain_items", "fail_items"]
    assert both.select(*sums).first() == masses_from_array(both.select("evidence")).select(*sums).first()
    table = E.evidence_table(both.withColumn("document_id", F.lit(1)))
    assert [r["signal"] for r in table.filter("category = 'FORENSICS'").orderBy("position").collect()] == [f"k{i}" for i in range(kept)]


RAW = "cert_id string, issuer string, organization string, issue_date string, candidate_name string, course string, marks_total double, marks_obtained double, grade string, has_signature boolean, has_seal boolean, has_qr boolean, has_url boolean, text_snippet string, title string, certificate_type string, blank_ratio double, sharpness double, noise_level double, color_anomaly int, label int"


def test_golden_records(spark):
    rows = [
        ("CERT-2022-123455", "University of Cambridge", "University of Cambridge", "2022-06-15", "John Walker", "Computer Science", 100.0, 95.0, "A", True, True, True, False, "This is to certify that John Walker has completed", "Certificate", "academic", 0.05, 0.85, 0.05, 0, 0),
        ("FREECERT-2022-999999", "Online Degree Emporium", "", "2026-12-01", "", "", 100.0, 150.0, "F", False, False, False, True, "Buy verified certificates online. No exam needed.", "", "academic", 0.9, 0.15, 0.5, 1, 1),
    ]
    good, bad = build_features(spark.createDataFrame(rows, RAW), as_of=AS_OF).collect()
    assert [c for c in good.asDict() if c in C.FEATURE_COLUMNS] == C.FEATURE_COLUMNS
    for name in ("cert_id_format_valid", "cert_id_checksum_valid", "issuer_known", "marks_pattern_valid", "grade_consistency_valid", "date_consistency_valid"):
        assert (good[name], bad[name]) == (1, 0), name
    assert (good["issuer_domain_trust"], bad["issuer_domain_trust"]) == (1.0, 0.15)
    assert bad["suspicious_keyword_count"] == 3 and bad["suspicious_url_present"] == 1
    assert bad["text_field_completeness"] == 0.25 and bad["visual_blank_ratio"] == 0.9


def test_training_and_runtime_modes_differ_as_stated(spark):
    raw = spark.createDataFrame([("Ann", "X", "C", "I", "t", "T")], "candidate_name string, organization string, course string, issuer string, text_snippet string, title string")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("cert_id", "issue_date", "marks_total", "marks_obtained", "grade")})
    a = build_features(raw, mode="training", as_of=AS_OF).first()
    b = build_features(raw.withColumnsRenamed({"text_snippet": "text", "title": "certificate_title"}), mode="runtime", as_of=AS_OF).first()
    assert (a["candidate_name_present"], b["candidate_name_present"]) == (0, 1)
    assert a["text_field_completeness"] == 1.0 == b["text_field_completeness"]


def test_issuer_domain_alone_never_verifies(spark):
    registry = spark.createDataFrame([("Acme School", ["ACME"], "acme.example")], "name string, aliases array<string>, verification_domain string")
    docs = spark.createDataFrame(
        [(1, " acme ", ["verify.acme.example"], None), (2, "Other", [], None), (3, "Acme School", [], "VERIFIED_BY_ISSUER"), (4, "", [], None)],
        "id int, organization string, domains array<string>, answer string",
    )
    for limit in (1000, 0):  # broadcast and shuffle lookups agree
        rows = {r["id"]: r for r in assess_issuer(registry_lookup(docs, registry, max_broadcast=limit), domains="domains", response="answer").collect()}
        assert (rows[1]["domain_consistency"], rows[1]["issuer_status_final"], rows[1]["verification_result"]) == ("consistent", "known_unverified", "VERIFICATION_UNAVAILABLE")
        assert rows[2]["issuer_verification"] == "ISSUER_UNKNOWN"
        assert rows[3]["issuer_state"] == "ISSUER_VERIFIED" and rows[4]["issuer_status_final"] == "unknown"


def test_verification_ignores_partitioning(spark):
    text = "Certificate of Achievement\nThis is to certify that Asha Avery\nUniversity of Oxford\nCourse: Robotics\nDate: 2020-01-02\nCertificate ID: CERT-2020-123455"
    rows = [(i, "me", text if i % 3 else "", "genuine", 0.1, 0.9) for i in range(12)]
    docs = spark.createDataFrame(rows, "document_id long, owner string, text string, prediction string, risk_score double, confidence double")

    def run(n):
        out = verify_documents(docs.repartition(n), as_of=AS_OF)
        return sorted(map(tuple, out.select("document_id", "decision", "decision_confidence", "duplicate_of", "duplicate_type").collect()))

    first, second = run(1), run(7)
    assert first == second
    assert first[0][1] == "INSUFFICIENT_EVIDENCE" and first[2][3] == 1 and first[2][4] == "file"


def test_decisions_write_plain_columns_and_count_without_items(spark):
    import glob

    from sparkattest.plans.queries.rules import decided, printed_domain, provider_decided
    from sparkattest.session import shared_folder

    sf, folder = "/root/testdata/sf0.001", shared_folder(spark)
    for rows, providers, limits in (
        (decided(spark, sf, with_items=True), [], E.ITEM_LIMITS), (provider_decided(spark, sf, with_items=True), [printed_domain], E.ALL_ITEMS),
    ):
        items = E.evidence_table(rows).select("document_id", "category", "status", "confidence").cache()
        narrow = E.item_rows(rows, fields=["category", "status", "confidence"], providers=providers, limits=limits)
        assert items.exceptAll(narrow).isEmpty() and narrow.exceptAll(items).isEmpty()
        kinds = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "FAIL", "WARNING", "UNKNOWN")]
        counted = E.category_counts(rows, providers=providers, limits=limits)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, items.groupBy("document_id", "category").agg(*kinds).collect()))
    written = [spark.read.parquet(p).columns for p in glob.glob(f"{folder}/table-*")]
    built_later = {"findings", "checks", "trust_signals", "risk_signals", "tampering_findings"}
    assert not any({"candidate_name", "file_fingerprint"} <= set(c) and built_later & set(c) for c in written)


def test_audit_details_are_built_only_where_selected(spark):
    from sparkattest.operators.audit import document_events

    schema = (
        "document_id long, extracted_text_length int, extraction_method string, extraction_confidence double, prediction string, risk_score double, "
        "confidence double, review_status string, structure_completeness double, trust_signals array<string>, risk_signals array<string>, "
        "findings array<string>, high_findings int, assessment string, decision string, decision_confidence double, evidence_degraded boolean, "
        "verification_codes array<string>, code_state string"
    )
    rest = (12, "pdf_text", 0.9, "genuine", 0.12345, 0.87655, "low_risk", 0.8, ["a"], [], ["f"], 1, "LIKELY_GENUINE", "VERIFIED", 0.7)
    docs = spark.createDataFrame([(1, *rest, False, ["c"], "NOT_VERIFIED"), (2, *rest, True, [], None), (3, None, *rest[1:], None, None, "NO_CODE")], schema)
    events = document_events(docs)
    rows = {(r["verification_id"], r["seq"]): r for r in events.collect()}
    kinds = ["DOCUMENT_RECEIVED", "TEXT_EXTRACTION", "FEATURE_EXTRACTION", "ML_ANALYSIS", "INTELLIGENCE_ANALYSIS", "CONSISTENCY_ANALYSIS", "VERIFICATION_CODE_ANALYSIS"]
    last = ["EVIDENCE_FUSION", "FINAL_DECISION"]
    for doc, names in ((1, [*kinds, *last]), (2, [*kinds, "PIPELINE_FAILED", *last]), (3, [*kinds, *last])):
        assert [rows[doc, k]["event_type"] for k in range(len(names))] == names and (doc, len(names)) not in rows
    failed, codes, fusion = rows[2, 7], rows[1, 6], rows[2, 8]
    assert (failed["status"], failed["severity"], failed["details"], failed["title"]) == ("failed", "warning", '{"degraded":true}', "Evidence degraded")
    assert (codes["severity"], codes["description"], codes["details"]) == ("error", "Code state: NOT_VERIFIED", '{"state":"NOT_VERIFIED","code_count":1}')
    assert (fusion["severity"], fusion["stage"], fusion["description"]) == ("success", "fusion", "Assessment: LIKELY_GENUINE")
    assert rows[1, 5]["severity"] == "error" and rows[3, 0]["details"] == "{}" and rows[1, 3]["details"].startswith('{"prediction":"genuine","risk_score":0.1235')
    narrow = events.select("verification_id", "seq", "event_type", "status", "severity")
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "structstojson" not in plan.lower() and "findings" not in plan.replace("high_findings", "").split("LogicalRDD")[0]
    assert {tuple(r) for r in narrow.collect()} == {tuple(r[c] for c in narrow.columns) for r in rows.values()}


def test_rules_run_in_methods_that_are_compiled(spark):
    from sparkattest.session import COMPILED_BYTES

    key = "spark.sql.codegen.hugeMethodLimit"
    docs = spark.createDataFrame([(1, "o", "Certificate", "genuine", 0.1, 0.9)], "document_id long, owner string, text string, prediction string, risk_score double, confidence double")
    spark.conf.unset(key)
    try:
        verify_documents(docs, as_of=AS_OF)
        assert spark.conf.get(key) == str(COMPILED_BYTES)
        spark.conf.set(key, "20000")
        verify_documents(docs, as_of=AS_OF)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.unset(key)
