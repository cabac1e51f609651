"""Certificate-shaped tables derived from the generic test tables.

One SQL text per derived table serves both Spark and the comparison engine, so
every check starts from the same input. Nothing is filtered or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CERTIFICATES = """
SELECT o.o_orderkey AS document_id,
       c.c_mktsegment AS owner,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
            WHEN o.o_orderkey % 17 = 0 THEN 'FREECERT-' || CAST(year(o.o_orderdate) AS STRING) || '-999999'
            ELSE 'CERT-' || CAST(year(o.o_orderdate) AS STRING) || '-' || lpad(CAST((o.o_custkey * 7919 + o.o_orderkey % 3) % 1000000 AS STRING), 6, '0') END AS cert_id,
       CASE WHEN o.o_orderkey % 11 = 0 THEN '' ELSE 'University of ' || n.n_name END AS issuer,
       CASE WHEN n.n_regionkey IN (0, 1, 2) THEN 1 ELSE 0 END AS issuer_in_registry,
       CASE WHEN o.o_orderkey % 19 = 0 THEN ''
            ELSE (CASE o.o_custkey % 4 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Liam' WHEN 2 THEN 'Mina' ELSE 'Noor' END) || ' ' ||
                 (CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Avery' WHEN 'BUILDING' THEN 'Brook' WHEN 'FURNITURE' THEN 'Frost' WHEN 'HOUSEHOLD' THEN 'Hale' ELSE 'Mason' END) END AS candidate_name,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Data Science' WHEN '2-HIGH' THEN 'Robotics' WHEN '3-MEDIUM' THEN 'Economics' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'Cloud Computing' END AS course,
       CAST(o.o_orderdate AS DATE) AS issue_date,
       CAST(100 AS DOUBLE) AS marks_total,
       CAST(CAST(floor(o.o_totalprice / 4500) AS INT) AS DOUBLE) AS marks_obtained,
       CASE o.o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END AS grade,
       CAST(CAST(round(o.o_totalprice * 100) AS BIGINT) % 10000 AS DOUBLE) / 10000 AS risk_score,
       CASE WHEN o.o_orderkey % 50 = 0 THEN 'error'
            WHEN CAST(round(o.o_totalprice * 100) AS BIGINT) % 10000 >= 5000 THEN 'suspicious' ELSE 'genuine' END AS prediction,
       CAST(o.o_custkey AS STRING) || '|' || o.o_orderpriority AS file_key,
       o.o_orderdate AS created_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

TEXTS = """
SELECT t.*,
       CASE WHEN document_id % 43 = 0 THEN '' ELSE concat_ws(chr(10),
         CASE WHEN document_id % 12 = 7 AND course <> '' THEN concat_ws(chr(10), candidate_name, course, 'Field Report', title) ELSE title END,
         CASE WHEN candidate_name = '' THEN 'To whom it may concern'
              WHEN document_id % 29 = 0 THEN candidate_name || ' has successfully completed all tasks'
              WHEN document_id % 7 = 0 THEN 'Awarded to ' || candidate_name
              ELSE 'This is to certify that ' || candidate_name END,
         CASE WHEN course = '' THEN NULL
              WHEN document_id % 4 = 0 THEN 'for completing ' || course
              WHEN document_id % 4 = 1 THEN 'Course: ' || course || '.'
              WHEN document_id % 4 = 2 THEN 'who studied ' || lower(course) || ' with care'
              ELSE 'and completed the ' || course || ' program' END,
         CASE WHEN issuer = '' THEN NULL
              WHEN document_id % 5 = 0 THEN 'Issued by ' || issuer || ' and was passed with merit'
              WHEN document_id % 5 = 1 THEN 'Organization: ' || issuer || ', campus north'
              WHEN document_id % 5 = 2 THEN issuer
              WHEN document_id % 5 = 3 THEN 'Presented by the course faculty' || chr(10) || issuer
              ELSE 'offered by ' || issuer || ' in collaboration with Partner Institute' END,
         'Marks obtained: ' || CAST(CAST(marks_obtained AS INT) AS STRING) || ' out of 100',
         CASE WHEN document_id % 31 = 0 THEN 'Upgraded system' ELSE 'Grade: ' || grade END,
         CASE WHEN document_id % 41 = 0 THEN 'Date unknown'
              WHEN document_id % 4 = 0 THEN 'Date: ' || CAST(issue_date AS STRING)
              WHEN document_id % 4 = 1 THEN 'Date: ' || lpad(CAST(day(issue_date) AS STRING), 2, '0') || '/' || lpad(CAST(month(issue_date) AS STRING), 2, '0') || '/' || CAST(year(issue_date) AS STRING)
              WHEN document_id % 4 = 2 THEN 'Date: ' || month_name || ' ' || CAST(day(issue_date) AS STRING) || ', ' || CAST(year(issue_date) AS STRING)
              ELSE 'Date: ' || CAST(day(issue_date) AS STRING) || ' ' || substr(month_name, 1, 3) || ' ' || CAST(year(issue_date) AS STRING) END,
         CASE WHEN cert_id IS NULL AND document_id % 2 = 0 THEN 'Candidate ID: pending ' || CAST(document_id AS STRING)
              WHEN cert_id IS NOT NULL THEN 'Certificate ID: ' || cert_id END,
         CASE WHEN document_id % 8 = 0 THEN 'Verification Code: vc' || lpad(CAST(document_id AS STRING), 10, '0')
              WHEN document_id % 8 = 3 THEN 'Reference No: RF-' || lpad(CAST(document_id AS STRING), 7, '0') END,
         CASE WHEN document_id % 6 < 2 THEN 'Authorized signature and official seal' END,
         CASE WHEN document_id % 9 = 0 THEN 'Scan the QR code to verify' END,
         CASE WHEN document_id % 37 = 0 THEN 'Buy your verified certificate online at www.instantcerts.com'
              WHEN document_id % 53 = 0 THEN 'Fast track, no exam' END) END AS text
FROM (SELECT c.*,
             CASE document_id % 6 WHEN 0 THEN 'Certificate of Completion' WHEN 1 THEN 'Technical Certification'
                  WHEN 2 THEN 'Workshop Participation Certificate' WHEN 3 THEN 'Certificate of Training'
                  WHEN 4 THEN 'Academic Degree Certificate' ELSE 'Statement of Results' END AS title,
             CASE document_id % 6 WHEN 0 THEN 'completion' WHEN 1 THEN 'technical' WHEN 2 THEN 'workshop'
                  WHEN 3 THEN 'training' WHEN 4 THEN 'academic' ELSE 'online' END AS certificate_type,
             CASE month(issue_date) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
                  WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September'
                  WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS month_name
      FROM certificates_v c) t
"""

RAW_RECORDS = """
SELECT document_id, cert_id, issuer, CAST(issue_date AS STRING) AS issue_date, candidate_name, course,
       CASE WHEN document_id % 23 = 0 THEN '' ELSE issuer END AS organization,
       marks_total, marks_obtained, grade, document_id % 6 < 2 AS has_signature, document_id % 6 < 3 AS has_seal,
       document_id % 9 = 0 AS has_qr, document_id % 37 = 0 AS has_url, text AS text_snippet, title, certificate_type,
       CAST(document_id % 100 AS DOUBLE) / 200 AS blank_ratio, CAST(document_id % 90 AS DOUBLE) / 100 AS sharpness,
       CAST(document_id % 40 AS DOUBLE) / 100 AS noise_level,
       CASE WHEN document_id % 21 = 0 THEN 1 ELSE 0 END AS color_anomaly,
       CASE WHEN prediction = 'suspicious' THEN 1 ELSE 0 END AS label, issuer_in_registry, risk_score
FROM texts_v
"""

VERIFICATIONS = """
SELECT 'V' || CAST(document_id AS STRING) AS verification_id, document_id, owner AS user_id,
       'scan_' || CAST(document_id AS STRING) || (CASE WHEN document_id % 2 = 0 THEN '.pdf' ELSE '.png' END) AS filename,
       prediction, risk_score, CASE WHEN risk_score >= 0.5 THEN risk_score ELSE 1 - risk_score END AS confidence,
       CASE WHEN document_id % 4 = 0 THEN 'forest_v2' ELSE 'forest_v3' END AS model_version, created_at,
       CASE WHEN prediction = 'error' OR document_id % 15 = 0 THEN NULL WHEN risk_score >= 0.5 THEN 'high_risk'
            WHEN risk_score >= 0.3 THEN 'manual_review' ELSE 'low_risk' END AS review_status,
       issuer,
       CASE WHEN document_id % 47 = 0 THEN 'not json' WHEN document_id % 59 = 0 THEN '[1]' WHEN document_id % 61 = 0 THEN NULL
            ELSE '{"academic":' || (CASE WHEN document_id % 3 = 0 THEN '1' ELSE '0' END) || ',"technical":' || (CASE WHEN document_id % 5 = 0 THEN '1' ELSE '0' END) ||
                 ',"training":' || (CASE WHEN document_id % 2 = 0 THEN '1' ELSE '0' END) || ',"completion":' || (CASE WHEN document_id % 7 = 0 THEN '1' ELSE '0' END) || '}' END AS certificate_type,
       CASE WHEN document_id % 67 = 0 THEN '{broken' ELSE
            '{"candidate_name":"' || candidate_name || '","organization":"' || issuer || '","course":"' || course ||
            '","issue_date":"' || CAST(issue_date AS STRING) || '","cert_id":' || (CASE WHEN cert_id IS NULL THEN 'null' ELSE '"' || cert_id || '"' END) || '}' END AS extracted_info,
       CASE WHEN document_id % 5 = 0 THEN '' WHEN document_id % 4 = 1 THEN 'unusual' WHEN document_id % 31 = 3 THEN 'insufficient_information' ELSE 'normal' END AS ood_status,
       CASE WHEN document_id % 10 = 3 THEN NULL WHEN risk_score >= 0.5 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS review_priority,
       '{"ood_status":"' || (CASE WHEN document_id % 2 = 0 THEN 'normal' ELSE 'unusual' END) || '","review_priority":"low","primary_type":"' || (CASE WHEN document_id % 3 = 0 THEN 'academic' ELSE 'training' END) || '"}' AS intelligence_json,
       CASE WHEN document_id % 71 = 0 THEN NULL ELSE
            '{"verification_evidence":{"assessment":"' || (CASE WHEN document_id % 4 = 0 THEN 'LIKELY_GENUINE' WHEN risk_score >= 0.6 THEN 'LIKELY_SUSPICIOUS' WHEN document_id % 9 = 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN risk_score < 0.35 THEN 'LIKELY_GENUINE' ELSE 'REQUIRES_VERIFICATION' END) ||
            '"},"anomaly":{"score":' || CAST(document_id % 100 AS STRING) || ',"level":"' || (CASE WHEN document_id % 100 >= 60 THEN 'high' ELSE 'low' END) || '"}}' END AS evidence_json,
       CAST(NULL AS STRING) AS duplicate_of, CAST(NULL AS STRING) AS duplicate_type,
       file_key AS file_fingerprint, cert_id AS cert_id_fingerprint,
       CASE WHEN candidate_name = '' OR issuer = '' OR course = '' THEN NULL
            ELSE lower(candidate_name || '|' || issuer || '|' || course) || '|' || CAST(issue_date AS STRING) END AS identity_fingerprint,
       candidate_name, course, cert_id, issue_date
FROM certificates_v
"""

FEEDBACK = """
SELECT verification_id, document_id, user_id,
       CASE WHEN document_id % 10 = 0 THEN 'uncertain'
            WHEN risk_score >= 0.55 OR (risk_score >= 0.3 AND document_id % 4 = 0) THEN 'confirmed_suspicious'
            ELSE 'confirmed_genuine' END AS reviewer_label,
       CASE WHEN document_id % 4 = 0 THEN 'checked by phone' ELSE '' END AS reviewer_note,
       prediction AS original_prediction, risk_score AS original_risk_score, confidence AS original_confidence, model_version,
       CASE document_id % 7 WHEN 0 THEN 'completion' WHEN 1 THEN 'technical' WHEN 2 THEN 'training' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'academic' END AS certificate_type,
       CASE WHEN document_id % 33 = 0 THEN NULL ELSE CAST(document_id % 6 AS DOUBLE) / 5 END AS extraction_completeness,
       review_status, issuer, ood_status, review_priority, file_fingerprint, cert_id_fingerprint, identity_fingerprint,
       CASE WHEN risk_score >= 0.6 THEN 'LIKELY_SUSPICIOUS' WHEN document_id % 9 = 1 THEN 'INSUFFICIENT_EVIDENCE'
            WHEN risk_score < 0.35 THEN 'LIKELY_GENUINE' ELSE 'REQUIRES_VERIFICATION' END AS assessment,
       created_at AS reviewed_at, candidate_name, course, cert_id, issue_date
FROM verifications_v WHERE prediction <> 'error' AND document_id % 3 = 0
"""

REVIEWED = """
SELECT document_id, verification_id, reviewer_label, CASE WHEN reviewer_label = 'confirmed_suspicious' THEN 1 ELSE 0 END AS label,
       coalesce(certificate_type, 'unknown') AS certificate_type, issuer, extraction_completeness,
       CASE WHEN (reviewer_label = 'confirmed_genuine') <> (original_prediction = 'genuine') THEN 1 ELSE 0 END AS is_disagreement,
       file_fingerprint, cert_id_fingerprint, identity_fingerprint, coalesce(cert_id, '') AS certificate_id,
       CASE WHEN document_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
       candidate_name, issuer AS organization, course, CAST(issue_date AS STRING) AS issue_date, cert_id,
       original_prediction, original_risk_score, model_version, ood_status, reviewed_at, reviewer_note
FROM feedback_v WHERE reviewer_label IN ('confirmed_genuine', 'confirmed_suspicious')
"""

# Dependency order of the derived tables.
DERIVED = {
    "certificates_v": (CERTIFICATES, ["orders", "customer", "nation"]),
    "texts_v": (TEXTS, ["certificates_v"]),
    "raw_v": (RAW_RECORDS, ["texts_v"]),
    "verifications_v": (VERIFICATIONS, ["certificates_v"]),
    "feedback_v": (FEEDBACK, ["verifications_v"]),
    "reviewed_v": (REVIEWED, ["feedback_v"]),
}


TEXT_TABLES = ("texts_v", "raw_v")


def ctes(*names: str) -> str:
    """A WITH clause that defines the named derived tables and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in DERIVED and name not in ordered:
            for need in DERIVED[name][1]:
                add(need)
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n][0].strip()})" for n in ordered)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame over the Parquet inputs."""
    orders = table(spark, sf_dir, "orders").drop("o_comment")
    if name in TEXT_TABLES:  # dealt by id, because a row costs far more than its bytes suggest
        orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    base = {
        "orders": orders,
        "customer": table(spark, sf_dir, "customer"), "nation": table(spark, sf_dir, "nation"),
    }
    # Braces of JSON literals are doubled; the only real placeholders are the base tables.
    body = ctes(name).replace("{", "{{").replace("}", "}}")
    for key in base:
        body = body.replace(f"FROM {key} ", f"FROM {{{key}}} ").replace(f"JOIN {key} ", f"JOIN {{{key}}} ")
    return spark.sql(f"{body}\nSELECT * FROM {name}", **base)
