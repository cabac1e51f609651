"""Stored verifications: filters, listings, dashboards, JSON columns, audit trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import history as H
from ...operators.audit import event_counts, prepare_events, timeline
from ...sources.readers import reject_reason
from ...sources.writers import file_id, manifest_records, manifest_summary, union_evolved
from ..derived import ctes, derived, table
from ..ingestion import ingest, ingestion_summary
from . import query
from .documents import AS_OF

V = ctes("verifications_v")
VF = ctes("feedback_v")


def stored(spark, sf):
    return derived(spark, sf, "verifications_v")


@query(
    "history_filters",
    V + """ SELECT verification_id, issuer, risk_score FROM verifications_v WHERE user_id = 'BUILDING' AND prediction = 'genuine' AND review_status = 'manual_review'
  AND issuer ILIKE '%nation_1%' AND filename ILIKE '%.PDF%' AND risk_score BETWEEN 0.3 AND 0.45 AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2001-02-01'""",
)
def history_filters(spark, sf):
    rows = H.filter_history(
        stored(spark, sf), user_id="BUILDING", prediction="genuine", review_status="manual_review", issuer="nation_1",
        filename=".PDF", risk_min=0.3, risk_max=0.45, date_from="1996-01-01", date_to="2001-01-31",
    )
    return rows.select("verification_id", "issuer", "risk_score")


@query(
    "history_by_type_flag",
    V + """ SELECT verification_id FROM verifications_v WHERE document_id % 47 <> 0 AND document_id % 59 <> 0 AND document_id % 61 <> 0 AND document_id % 3 = 0 AND contains(lower(issuer), 'nation_2')""",
)
def history_by_type_flag(spark, sf):
    rows = H.filter_history(stored(spark, sf), certificate_type="academic", issuer="NATION_2", literal_search=True, date_from="not a date")
    return rows.select("verification_id")


@query(
    "history_listing",
    VF + f""" SELECT v.{', v.'.join(H.LISTING)}, f.reviewer_label, f.reviewed_at, CAST(CASE f.reviewer_label WHEN 'confirmed_genuine' THEN f.original_prediction <> 'genuine' WHEN 'confirmed_suspicious' THEN f.original_prediction <> 'suspicious' WHEN 'uncertain' THEN false END AS INT) AS is_disagreement
FROM verifications_v v LEFT JOIN feedback_v f ON f.verification_id = v.verification_id""",
)
def history_listing(spark, sf):
    from ...operators.feedback import is_disagreement

    feedback = derived(spark, sf, "feedback_v").withColumn(
        "is_disagreement", is_disagreement(F.col("reviewer_label"), F.col("original_prediction")).cast("int")
    )
    return H.listing(stored(spark, sf), feedback)


@query(
    "newest_verifications",
    V + " SELECT verification_id, created_at, prediction FROM verifications_v ORDER BY created_at DESC, verification_id DESC LIMIT 20",
)
def newest_verifications(spark, sf):
    return H.newest(stored(spark, sf).select("verification_id", "created_at", "prediction"))


@query(
    "verification_details",
    V + """ SELECT verification_id, coalesce(nullif(ood_status, ''), json_extract_string(intelligence_json, '$.ood_status')) AS ood_status,
  coalesce(nullif(review_priority, ''), json_extract_string(intelligence_json, '$.review_priority')) AS review_priority, json_extract_string(intelligence_json, '$.primary_type') AS primary_type FROM verifications_v""",
)
def verification_details(spark, sf):
    return H.detail(stored(spark, sf)).select("verification_id", "ood_status", "review_priority", "primary_type")


_FLAGS_OK = "(document_id % 47 <> 0 AND document_id % 59 <> 0 AND document_id % 61 <> 0)"
_COMPLETE = "CASE WHEN document_id % 67 = 0 THEN 0.0 ELSE round((CAST(candidate_name <> '' AS INT) + CAST(issuer <> '' AS INT) + CAST(course <> '' AS INT) + 1 + CAST(cert_id IS NOT NULL AS INT)) / 5.0, 4) END"


@query(
    "stored_json_columns",
    V + f""" SELECT verification_id, CAST(CASE WHEN {_FLAGS_OK} THEN 4 ELSE 0 END AS INT) AS n_flags, {_COMPLETE} AS completeness,
  CASE WHEN NOT {_FLAGS_OK} THEN NULL WHEN document_id % 3 = 0 THEN 'academic' WHEN document_id % 5 = 0 THEN 'technical' WHEN document_id % 2 = 0 THEN 'training' WHEN document_id % 7 = 0 THEN 'completion' END AS primary_type,
  CASE WHEN document_id % 67 <> 0 THEN course END AS course, json_extract_string(evidence_json, '$.verification_evidence.assessment') AS final_assessment,
  CAST(json_extract_string(evidence_json, '$.anomaly.score') AS DOUBLE) AS anomaly_score, json_extract_string(evidence_json, '$.anomaly.level') AS anomaly_level,
  CAST(document_id % 67 <> 0 AS INT) AS is_object FROM verifications_v""",
)
def stored_json_columns(spark, sf):
    snap = H.evidence_snapshot(F.col("evidence_json"))
    return stored(spark, sf).select(
        "verification_id", F.size(H.parse_flags(F.col("certificate_type"))).alias("n_flags"),
        H.stored_completeness(F.col("extracted_info")).alias("completeness"),
        H.stored_primary_type(F.col("certificate_type")).alias("primary_type"),
        H.parse_fields(F.col("extracted_info"))["course"].alias("course"), *[c.alias(n) for n, c in snap.items()],
        H.parse_object(F.col("extracted_info")).isNotNull().cast("int").alias("is_object"),
    )


@query(
    "event_payloads",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events",
)
def event_payloads(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"].alias("k"), "event_type")


@query(
    "error_rows",
    V + """ SELECT verification_id, CASE WHEN document_id % 67 = 0 THEN 'error' ELSE prediction END AS prediction, CASE WHEN document_id % 67 = 0 THEN 0.0 ELSE risk_score END AS risk_score FROM verifications_v""",
)
def error_rows(spark, sf):
    v = stored(spark, sf)
    failed = H.parse_object(F.col("extracted_info")).isNull()
    return H.error_rows(v, failed).select("verification_id", "prediction", "risk_score")


@query(
    "dashboard_metrics",
    V + f""" SELECT count(*) AS total, count(*) FILTER (WHERE prediction = 'genuine') AS genuine_count, count(*) FILTER (WHERE prediction = 'suspicious') AS suspicious_count,
  count(*) FILTER (WHERE prediction = 'error') AS error_count, coalesce(round(avg(risk_score) FILTER (WHERE prediction <> 'error'), 4), 0) AS average_risk_score,
  coalesce(round(avg(confidence) FILTER (WHERE prediction <> 'error'), 4), 0) AS average_confidence, count(*) FILTER (WHERE prediction <> 'error' AND review_status = 'manual_review') AS manual_review_count,
  round(avg({_COMPLETE}) FILTER (WHERE prediction <> 'error'), 4) AS average_completeness,
  round(count(*) FILTER (WHERE prediction <> 'error' AND review_status = 'manual_review') / count(*) FILTER (WHERE prediction <> 'error'), 4) AS manual_review_rate FROM verifications_v""",
)
def dashboard_metrics(spark, sf):
    return H.dashboard(stored(spark, sf))


@query(
    "filtered_summary",
    V + """ SELECT count(*) AS total, count(*) FILTER (WHERE prediction = 'genuine') AS genuine, count(*) FILTER (WHERE prediction = 'suspicious') AS suspicious,
  count(*) FILTER (WHERE prediction <> 'error' AND review_status = 'manual_review') AS manual_review, coalesce(round(avg(risk_score) FILTER (WHERE prediction <> 'error'), 4), 0) AS average_risk_score
FROM verifications_v WHERE user_id = 'MACHINERY' AND risk_score >= 0.2""",
)
def filtered_summary(spark, sf):
    return H.history_summary(H.filter_history(stored(spark, sf), user_id="MACHINERY", risk_min=0.2))


DISTRIBUTIONS = f"""dist_v AS (
  SELECT half, 'prediction' AS dimension, prediction AS value FROM src WHERE prediction <> 'error'
  UNION ALL SELECT half, 'review_status', coalesce(review_status, 'low_risk') FROM src WHERE prediction <> 'error'
  UNION ALL SELECT half, 'model_version', model_version FROM src
  UNION ALL SELECT half, 'issuer', trim(issuer) FROM src WHERE prediction <> 'error' AND trim(issuer) <> ''
  UNION ALL SELECT half, 'certificate_type', flag FROM (SELECT half, unnest(list_filter([CASE WHEN document_id % 3 = 0 THEN 'academic' END, CASE WHEN document_id % 5 = 0 THEN 'technical' END,
     CASE WHEN document_id % 2 = 0 THEN 'training' END, CASE WHEN document_id % 7 = 0 THEN 'completion' END], lambda x: x IS NOT NULL)) AS flag FROM src WHERE prediction <> 'error' AND {_FLAGS_OK})
)"""


@query(
    "value_distributions",
    V + ", src AS (SELECT *, 0 AS half FROM verifications_v), " + DISTRIBUTIONS + " SELECT dimension, value, count(*) AS n FROM dist_v GROUP BY dimension, value",
)
def value_distributions(spark, sf):
    return H.distributions(stored(spark, sf))


@query(
    "top_issuers",
    V + " SELECT issuer, count(*) AS n FROM verifications_v WHERE prediction <> 'error' AND issuer <> '' GROUP BY issuer ORDER BY n DESC, issuer LIMIT 15",
)
def top_issuers(spark, sf):
    return H.top_issuers(stored(spark, sf))


@query(
    "certificate_foreign_key",
    V + " SELECT v.verification_id, c.c_name, v.prediction FROM verifications_v v LEFT JOIN orders o ON o.o_orderkey = v.document_id LEFT JOIN customer c ON c.c_custkey = o.o_custkey",
)
def certificate_foreign_key(spark, sf):
    v = stored(spark, sf).select("verification_id", "document_id", "prediction")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("c_custkey"))
    return v.join(o, "document_id", "left").join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select(
        "verification_id", "c_name", "prediction"
    )


@query(
    "retention_list",
    "SELECT o_orderkey AS file_no FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn FROM orders) WHERE rn > 200",
)
def retention_list(spark, sf):
    files = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("modified_at"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("file_no")
    )
    return H.retention_excess(files).select("file_no")


@query(
    "evolved_schema_union",
    "SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels",
)
def evolved_schema_union(spark, sf):
    return union_evolved(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality"))


@query(
    "file_admission",
    """WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.png' WHEN 2 THEN 'c.exe' WHEN 3 THEN '' ELSE 'd.jpeg' END AS name, doc_id % 11 = 0 AS big, doc_id % 2 = 0 AS real FROM documents)
SELECT doc_id, CASE WHEN name = '' THEN 'missing_name' WHEN name = 'c.exe' THEN 'extension' WHEN big THEN 'size' WHEN NOT real OR name <> 'a.pdf' THEN 'magic' END AS reject_reason FROM f""",
)
def file_admission(spark, sf):
    k = F.col("doc_id")
    name = F.when(k % 5 == 0, "a.pdf").when(k % 5 == 1, "b.png").when(k % 5 == 2, "c.exe").when(k % 5 == 3, "").otherwise("d.jpeg")
    content = F.encode(F.when(k % 2 == 0, F.concat(F.lit("%PDF-1.7"), "text")).otherwise(F.col("text")), "UTF-8")
    length = F.when(k % 11 == 0, 20_000_000).otherwise(1000)
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", reject_reason(name, length, content).alias("reject_reason"))


_ING = """ing AS (SELECT doc_id, sha256(text) AS sha, text, CASE doc_id % 4 WHEN 0 THEN 'genuine' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'uncertain' ELSE 'genuine' END AS label FROM documents),
frozen AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 97 = 0),
st AS (SELECT i.*, CASE WHEN f.sha IS NOT NULL THEN 'external_validation' WHEN count(*) OVER (PARTITION BY i.sha) > 1 THEN 'duplicate' ELSE 'unique' END AS duplicate_status FROM ing i LEFT JOIN frozen f ON f.sha = i.sha),
st2 AS (SELECT *, CASE WHEN duplicate_status <> 'unique' THEN 'skipped' WHEN trim(text) <> '' THEN 'success' ELSE 'failed' END AS extraction_status FROM st)"""


def ingested(spark, sf):
    k = F.col("doc_id")
    label = F.when(k % 4 == 1, "suspicious").when(k % 4 == 2, "uncertain").otherwise("genuine")
    docs = table(spark, sf, "documents").select("doc_id", "text", label.alias("label"), F.concat(F.col("source"), F.lit(".pdf")).alias("original_filename"))
    frozen = table(spark, sf, "documents").filter(k % 97 == 0).select(F.sha2("text", 256).alias("sha256"))
    return ingest(docs, seq="doc_id", as_of=AS_OF, frozen=frozen)


@query(
    "ingestion_summary",
    "WITH " + _ING + " SELECT label, duplicate_status, extraction_status, count(*) AS n FROM st2 GROUP BY ALL",
)
def ingestion_summary_query(spark, sf):
    return ingestion_summary(ingested(spark, sf))


@query(
    "manifest_records",
    "WITH " + _ING + " SELECT doc_id, sha1('document:' || sha) AS file_id, extraction_status, duplicate_status FROM st2",
)
def manifest_records_query(spark, sf):
    return ingested(spark, sf).select("doc_id", file_id(F.col("sha256")).alias("file_id"), "extraction_status", "duplicate_status")


@query(
    "manifest_summary",
    "WITH " + _ING + """ SELECT count(*) AS total_records, count(*) FILTER (WHERE label = 'genuine') AS genuine_count, count(*) FILTER (WHERE label = 'suspicious') AS suspicious_count,
  count(*) FILTER (WHERE label = 'uncertain') AS uncertain_count, count(*) FILTER (WHERE extraction_status = 'success') AS extraction_success_count, count(*) FILTER (WHERE extraction_status = 'success') AS feature_success_count,
  count(*) FILTER (WHERE duplicate_status = 'unique') AS unique_count, count(*) FILTER (WHERE duplicate_status = 'duplicate') AS duplicate_count, count(*) FILTER (WHERE duplicate_status = 'external_validation') AS external_validation_rejected FROM st2""",
)
def manifest_summary_query(spark, sf):
    return manifest_summary(manifest_records(ingested(spark, sf)))


@query(
    "training_eligibility",
    "WITH " + _ING + " SELECT sha AS source_sha256, CASE label WHEN 'genuine' THEN 0 ELSE 1 END AS label, 'src' AS source FROM st2 WHERE extraction_status = 'success' AND label <> 'uncertain'",
)
def training_eligibility(spark, sf):
    from ..ingestion import training_rows

    rows = training_rows(ingested(spark, sf))
    return rows.select("source_sha256", "label", F.left("source_filename", F.lit(3)).alias("source"))


@query(
    "conversation_timeline",
    "SELECT conv_id AS verification_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS event_number, role AS event_type FROM conversations",
)
def conversation_timeline(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("verification_id"), "turn", F.col("role").alias("event_type"))
    return timeline(c, seq="turn", bucket=2)


@query(
    "events_per_conversation",
    "SELECT d.doc_id AS verification_id, count(c.turn) AS event_count, CAST(count(c.turn) > 0 AS INT) AS started FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id",
)
def events_per_conversation(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("verification_id"))
    events = table(spark, sf, "conversations").select(F.col("conv_id").alias("verification_id"), "turn")
    return event_counts(docs, events).withColumn("started", F.col("started").cast("int"))


@query(
    "prepared_audit_events",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'success' WHEN 'assistant' THEN 'info' ELSE 'warning' END AS severity, CASE WHEN length(trim(text)) > 200 THEN left(trim(text), 199) || '…' WHEN trim(text) = '' THEN role ELSE trim(text) END AS title,
  CASE WHEN trim(text) = '' THEN NULL WHEN length(trim(text)) > 500 THEN left(trim(text), 499) || '…' ELSE trim(text) END AS description, '{"token":"abcd*****xyz","turn":' || CAST(turn AS VARCHAR) || '}' AS details FROM conversations""",
)
def prepared_audit_events(spark, sf):
    c = table(spark, sf, "conversations")
    events = c.select(
        "conv_id", "turn", F.col("role").alias("event_type"), F.col("text").alias("title"), F.col("text").alias("description"),
        F.when(F.col("role") == "user", "completed").when(F.col("role") == "assistant", "recorded").otherwise("unavailable").alias("status"),
        F.concat(F.lit('{"token":"abcdefghixyz","turn":'), F.col("turn").cast("string"), F.lit("}")).alias("details"),
    )
    return prepare_events(events).select("conv_id", "turn", "severity", "title", "description", "details")


