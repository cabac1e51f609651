"""Duplicates, families, splits, leakage, quality and schema checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ...functions import text as T
from ...operators import leakage as L
from ...operators import quality as K
from ...operators.duplicates import dedupe_reviewed, keep_first, mark_exact_copies, prior_duplicates, removed_count
from ...operators.families import connected_families
from ...operators.history import snapshot_features
from ...operators.models import usable_rows
from ...operators.splits import assign_splits, labeled_records, stratified_split, template_splits
from ...session import cut_lineage
from ...sources.writers import split_write_back
from ..candidates import collect_reviewed
from ..derived import ctes, derived, table
from . import query
from .documents import TRAINING_FEATURES_SQL, training_features_df

RV = ctes("reviewed_v")
V = ctes("verifications_v")
_LONG = " UNION ALL ".join(f"SELECT document_id, split, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM reviewed_v" for c in C.LINK_COLUMNS)


def reviewed(spark, sf):
    return derived(spark, sf, "reviewed_v")


# --- duplicates ---------------------------------------------------------------


@query(
    "prior_duplicates",
    V + """, f AS (SELECT document_id, user_id, kind, rank, value FROM (
    SELECT document_id, user_id, 'file' AS kind, 1 AS rank, file_fingerprint AS value FROM verifications_v WHERE prediction <> 'error'
    UNION ALL SELECT document_id, user_id, 'cert_id', 2, cert_id_fingerprint FROM verifications_v WHERE prediction <> 'error'
    UNION ALL SELECT document_id, user_id, 'identity', 3, identity_fingerprint FROM verifications_v WHERE prediction <> 'error') WHERE coalesce(value, '') <> ''),
m AS (SELECT *, min(document_id) OVER (PARTITION BY user_id, kind, value) AS first_id FROM f),
b AS (SELECT document_id, kind, first_id, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS rn FROM m WHERE first_id < document_id)
SELECT v.verification_id, CAST(b.document_id IS NOT NULL AS INT) AS is_duplicate, 'V' || CAST(b.first_id AS VARCHAR) AS duplicate_of, b.kind AS duplicate_type FROM verifications_v v LEFT JOIN b ON b.document_id = v.document_id AND b.rn = 1""",
)
def prior_duplicates_query(spark, sf):
    v = derived(spark, sf, "verifications_v").drop("duplicate_of", "duplicate_type")
    rows = v.select("verification_id", "document_id", "user_id", "prediction", *C.FINGERPRINT_COLUMNS)
    out = prior_duplicates(rows, seq="document_id", owner="user_id", doc_id="verification_id")
    return out.select("verification_id", F.col("is_duplicate").cast("int").alias("is_duplicate"), "duplicate_of", "duplicate_type")


@query(
    "exact_copies",
    """WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), w AS (SELECT doc_id, count(*) OVER (PARTITION BY sha) AS copies, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS rn,
  first_value(doc_id) OVER (PARTITION BY sha ORDER BY doc_id) AS f1, nth_value(doc_id, 2) OVER (PARTITION BY sha ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f2 FROM d)
SELECT doc_id, copies, CASE WHEN copies > 1 THEN 'duplicate' ELSE 'unique' END AS duplicate_status, CASE WHEN copies > 1 THEN CASE WHEN rn = 1 THEN f2 ELSE f1 END END AS duplicate_of FROM w""",
)
def exact_copies(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return mark_exact_copies(docs, seq="doc_id").select("doc_id", "copies", "duplicate_status", "duplicate_of")


@query(
    "keep_first_text",
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(trim(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))))",
)
def keep_first_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.trim(T.normalize_text(F.col("text")))).alias("digest"))
    return keep_first(docs, ["digest"], seq="doc_id").select("doc_id")


@query(
    "deduplicated_reviews",
    RV + """, d AS (SELECT min(document_id) AS document_id FROM reviewed_v GROUP BY coalesce(file_fingerprint, ''), coalesce(cert_id_fingerprint, ''), coalesce(identity_fingerprint, ''))
SELECT document_id, verification_id, label FROM reviewed_v WHERE document_id IN (SELECT document_id FROM d)""",
)
def deduplicated_reviews(spark, sf):
    return dedupe_reviewed(reviewed(spark, sf), seq="document_id").select("document_id", "verification_id", "label")


@query(
    "removed_reviews",
    RV + """ SELECT count(*) AS rows_before, count(DISTINCT (coalesce(file_fingerprint, ''), coalesce(cert_id_fingerprint, ''), coalesce(identity_fingerprint, ''))) AS rows_after,
  count(*) - count(DISTINCT (coalesce(file_fingerprint, ''), coalesce(cert_id_fingerprint, ''), coalesce(identity_fingerprint, ''))) AS removed FROM reviewed_v""",
)
def removed_reviews(spark, sf):
    rows = reviewed(spark, sf)
    return removed_count(rows, dedupe_reviewed(rows, seq="document_id"))


# --- families and splits ------------------------------------------------------


_FAMILIES = RV.replace("WITH ", "WITH RECURSIVE ", 1) + f""", l AS ({_LONG}),
hub AS (SELECT column_name, value, min(document_id) AS h FROM l WHERE trim(value) <> '' GROUP BY column_name, value),
star AS (SELECT DISTINCT document_id AS u, h AS v FROM l JOIN hub USING (column_name, value)),
e AS (SELECT u, v FROM star UNION SELECT v, u FROM star),
reach AS (SELECT document_id AS u, document_id AS r FROM reviewed_v UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.r)
SELECT u AS document_id, min(r) AS family_id FROM reach GROUP BY u"""


@query("linked_families", _FAMILIES)
def linked_families(spark, sf):
    """Connected families over all shared fingerprints."""
    return connected_families(reviewed(spark, sf), "document_id").select("document_id", "family_id")


@query("family_safe_split")
def family_safe_split(spark, sf):
    """Greedy split of families; checked against a family-by-family walk in the tests."""
    return assign_splits(reviewed(spark, sf), "document_id").select("document_id", "family_id", "split")


_TEMPLATE = """t AS (SELECT document_id, verification_id, reviewed_at, sha1('phase12-label-group-v1:' || regexp_replace(lower(issuer), '[^a-z0-9]+', '', 'g') || ':' || certificate_type) AS template_key FROM reviewed_v),
i AS (SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY reviewed_at, document_id) - 1 AS template_index FROM t)"""


@query(
    "template_rotation_split",
    RV + f""", {_TEMPLATE} SELECT document_id, template_key, CAST(template_index AS BIGINT) AS template_index, CASE WHEN left(sha1(template_key || ':' || CAST(template_index AS VARCHAR)), 1) IN ('0', '1', '2', '3') THEN 'test' ELSE 'train' END AS split FROM i""",
)
def template_rotation_split(spark, sf):
    return template_splits(reviewed(spark, sf), "document_id").select("document_id", "template_key", "template_index", "split")


@query(
    "whole_template_split",
    RV + f""", {_TEMPLATE} SELECT document_id, CASE WHEN left(sha1(template_key), 1) IN ('0', '1', '2', '3') THEN 'test' ELSE 'train' END AS split FROM t""",
)
def whole_template_split(spark, sf):
    return template_splits(reviewed(spark, sf), "document_id", whole_group=True).select("document_id", "split")


@query(
    "labeled_export",
    RV + f""", {_TEMPLATE} SELECT r.verification_id AS document_id, r.reviewer_label AS ground_truth, r.original_prediction AS prediction, round(r.original_risk_score, 4) AS risk_score, coalesce(r.issuer, '') AS issuer, r.certificate_type,
  coalesce(r.ood_status, '') AS ood_status, r.model_version, CASE WHEN left(sha1(i.template_key || ':' || CAST(i.template_index AS VARCHAR)), 1) IN ('0', '1', '2', '3') THEN 'test' ELSE 'train' END AS split,
  CAST(r.reviewer_note <> '' AS INT) AS review_note_present, r.reviewed_at AS created_at, coalesce(nullif(r.file_fingerprint, ''), nullif(r.cert_id_fingerprint, ''), '') AS fingerprint FROM reviewed_v r JOIN i ON i.document_id = r.document_id""",
)
def labeled_export(spark, sf):
    rows = labeled_records(template_splits(reviewed(spark, sf), "document_id"))
    return rows.withColumn("review_note_present", F.col("review_note_present").cast("int")).select(
        "document_id", "ground_truth", "prediction", "risk_score", "issuer", "certificate_type", "ood_status", "model_version",
        "split", "review_note_present", "created_at", "fingerprint",
    )


@query(
    "stratified_split",
    ctes("raw_v") + """, r AS (SELECT document_id, label, row_number() OVER (PARTITION BY label ORDER BY left(sha256('42:' || CAST(document_id AS VARCHAR)), 8), document_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM raw_v)
SELECT document_id, label, CASE WHEN rk <= floor(n * 0.2) THEN 'test' WHEN rk <= floor(n * 0.2) + floor(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def stratified_split_query(spark, sf):
    return stratified_split(derived(spark, sf, "raw_v").select("document_id", "label"), "document_id")


@query(
    "split_write_back",
    ctes("feedback_v") + """ SELECT verification_id, CASE WHEN reviewer_label <> 'uncertain' THEN CASE WHEN document_id % 5 = 0 THEN 'test' ELSE 'train' END WHEN document_id % 4 = 0 THEN 'old' END AS split, CASE WHEN reviewer_label <> 'uncertain' THEN 'b1' END AS dataset_batch FROM feedback_v""",
)
def split_write_back_query(spark, sf):
    assigned = reviewed(spark, sf).withColumn("dataset_batch", F.lit("b1"))
    fb = derived(spark, sf, "feedback_v").withColumn("split", F.when(F.col("document_id") % 4 == 0, "old"))
    return split_write_back(fb, assigned).select("verification_id", "split", "dataset_batch")


# --- leakage ------------------------------------------------------------------

@query(
    "cross_split_values",
    RV + f", l AS ({_LONG}) SELECT column_name, value FROM l WHERE trim(value) <> '' GROUP BY column_name, value HAVING count(DISTINCT split) > 1",
)
def cross_split_values(spark, sf):
    return L.shared_values(reviewed(spark, sf))


@query(
    "cross_split_counts",
    RV + f", l AS ({_LONG}), g AS (SELECT column_name, value, count(DISTINCT split) AS s FROM l WHERE trim(value) <> '' GROUP BY column_name, value) SELECT column_name, count(*) FILTER (WHERE s > 1) AS cross_split_values FROM g GROUP BY column_name",
)
def cross_split_counts(spark, sf):
    return L.cross_split_counts(reviewed(spark, sf))


@query(
    "leakage_gate",
    RV + """, s AS (SELECT file_fingerprint, CASE WHEN left(sha1(file_fingerprint), 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END AS split FROM reviewed_v WHERE trim(file_fingerprint) <> ''),
g AS (SELECT file_fingerprint, count(DISTINCT split) AS n FROM s GROUP BY file_fingerprint)
SELECT 'file_fingerprint' AS column_name, count(*) FILTER (WHERE n > 1) AS cross_split_values, CAST(count(*) FILTER (WHERE n > 1) = 0 AS INT) AS ok FROM g""",
)
def leakage_gate(spark, sf):
    """A split by hash of one key passes the gate for that key."""
    side = F.when(F.left(F.sha1("file_fingerprint"), F.lit(1)).isin("0", "1", "2"), "test").otherwise("train")
    rows = reviewed(spark, sf).select("document_id", "file_fingerprint", side.alias("split"))
    return L.check_split_leakage(rows).withColumn("ok", F.col("ok").cast("int"))


@query(
    "external_overlap",
    "SELECT doc_id, CAST(sha256(text) IN (SELECT sha256(text) FROM benchmark UNION ALL SELECT sha256(text) FROM documents WHERE doc_id % 50 = 0) AS INT) AS in_external_set FROM documents",
)
def external_overlap(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hashed = docs.withColumn("file_fingerprint", F.sha2("text", 256))
    frozen = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("sha256")).union(
        docs.filter(F.col("doc_id") % 50 == 0).select(F.sha2("text", 256))
    )
    out = L.external_overlap(hashed, frozen)
    return out.select("doc_id", F.col("in_external_set").cast("int").alias("in_external_set"))


@query("hash_intersection", "SELECT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1")
def hash_intersection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    even, odd = docs.filter(F.col("doc_id") % 2 == 0), docs.filter(F.col("doc_id") % 2 == 1)
    return even.select("sha256").intersect(odd.select("sha256"))


@query("hash_inventory", "SELECT 'file_' || CAST(doc_id AS VARCHAR) || '.pdf' AS file_name, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0")
def hash_inventory(spark, sf):
    k = F.col("doc_id")
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("file:/frozen/file_"), k.cast("string"), F.when(k % 3 == 0, ".txt").otherwise(".pdf")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return L.external_hashes(files)


@query(
    "duplicate_report",
    RV + f""", l AS ({_LONG}), g AS (SELECT column_name, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY column_name, value)
SELECT column_name, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS affected_rows FROM g GROUP BY column_name""",
)
def duplicate_report(spark, sf):
    return L.duplicate_report(reviewed(spark, sf))


@query(
    "repeated_hashes",
    """WITH d AS (SELECT sha256(text) AS sha, lang, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) SELECT sha AS sha256, left(sha, 16) || '...' AS sha_prefix, lang, count(*) AS n, copies FROM d WHERE copies > 1 GROUP BY sha, lang, copies""",
)
def repeated_hashes(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"), "lang")
    return L.hash_groups(docs, label="lang")


@query(
    "repeated_hash_members",
    "SELECT doc_id, source, copies FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) WHERE copies > 1",
)
def repeated_hash_members(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return L.hash_group_members(docs, keep=["doc_id", "source"]).select("doc_id", "source", "copies")


@query(
    "split_crossings",
    RV + """, k AS (SELECT split, coalesce(nullif(file_fingerprint, ''), nullif(cert_id_fingerprint, ''), nullif(identity_fingerprint, '')) AS fp, sha1('phase12-label-group-v1:' || regexp_replace(lower(issuer), '[^a-z0-9]+', '', 'g') || ':' || certificate_type) AS tk FROM reviewed_v)
SELECT 'fingerprint_cross_split' AS kind, fp AS value FROM k WHERE fp IS NOT NULL GROUP BY fp HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'template_cross_split', tk FROM k GROUP BY tk HAVING count(DISTINCT split) > 1""",
)
def split_crossings(spark, sf):
    return L.cross_split_report(reviewed(spark, sf))


@query(
    "leakage_summary",
    RV + f""", fr AS (SELECT DISTINCT file_fingerprint AS f FROM reviewed_v WHERE document_id % 100 = 0), l AS ({_LONG}),
g AS (SELECT column_name, value, count(DISTINCT split) AS s FROM l WHERE trim(value) <> '' GROUP BY column_name, value),
c AS (SELECT 'external_overlap' AS "check", count(*) FILTER (WHERE file_fingerprint IN (SELECT f FROM fr)) AS violations FROM reviewed_v
  UNION ALL SELECT 'duplicate_hashes', count(*) FROM (SELECT file_fingerprint FROM reviewed_v GROUP BY file_fingerprint HAVING count(*) > 1)
  UNION ALL SELECT 'split_leakage:' || column_name, count(*) FILTER (WHERE s > 1) FROM g GROUP BY column_name)
SELECT "check", violations, CAST(violations = 0 AS INT) AS ok FROM c""",
)
def leakage_summary(spark, sf):
    rows = reviewed(spark, sf)
    frozen = rows.filter(F.col("document_id") % 100 == 0).select(F.col("file_fingerprint").alias("sha256"))
    return L.leakage_summary(rows, frozen).withColumn("ok", F.col("ok").cast("int"))


# --- quality and schema -------------------------------------------------------


@query(
    "missing_field_rates",
    RV + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CAST(coalesce(trim({c}), '') = '' AS INT)), 4) AS missing_rate FROM reviewed_v" for c in C.CORE_FIELDS),
)
def missing_field_rates(spark, sf):
    return K.missing_field_rates(reviewed(spark, sf))


_SIZES = """z AS (SELECT 'certificate_type' AS dimension, certificate_type AS item, count(*) AS n FROM reviewed_v GROUP BY ALL UNION ALL SELECT 'issuer', CASE WHEN issuer = '' THEN 'unknown' ELSE issuer END, count(*) FROM reviewed_v GROUP BY ALL)"""


@query("underrepresented_groups", RV + f", {_SIZES} SELECT dimension, item, n FROM z WHERE n < 170")
def underrepresented_groups(spark, sf):
    return K.underrepresented(reviewed(spark, sf), below=170)


@query(
    "quality_report",
    RV + f""", {_SIZES}, l AS ({_LONG}), du AS (SELECT column_name, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL), cs AS (SELECT column_name, value, count(DISTINCT split) AS s FROM l WHERE trim(value) <> '' GROUP BY ALL),
o AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS genuine, count(*) FILTER (WHERE label = 1) AS suspicious, round(avg(extraction_completeness), 4) AS average_completeness,
  count(*) FILTER (WHERE extraction_completeness < 0.4) AS completeness_low, count(*) FILTER (WHERE extraction_completeness >= 0.4 AND extraction_completeness < 0.8) AS completeness_medium,
  count(*) FILTER (WHERE extraction_completeness >= 0.8) AS completeness_high, sum(is_disagreement) AS disagreements FROM reviewed_v),
p AS (SELECT *, round(suspicious / genuine, 4) AS suspicious_to_genuine, round(disagreements / n_rows, 4) AS disagreement_rate FROM o)
{' UNION ALL '.join(f"SELECT 'overall' AS section, 'all' AS item, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM p" for m in ('n_rows', 'genuine', 'suspicious', 'suspicious_to_genuine', 'average_completeness', 'completeness_low', 'completeness_medium', 'completeness_high', 'disagreements', 'disagreement_rate'))}
UNION ALL SELECT dimension, item, 'n_rows', n FROM z UNION ALL SELECT 'issuer_diversity', 'all', 'issuers', count(*) FROM z WHERE dimension = 'issuer'
UNION ALL SELECT 'duplicates', column_name, 'groups', count(*) FILTER (WHERE n > 1) FROM du GROUP BY column_name UNION ALL SELECT 'duplicates', column_name, 'affected_rows', coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) FROM du GROUP BY column_name
{' '.join(f"UNION ALL SELECT 'missing_field_rate', '{c}', 'rate', round(avg(CAST(coalesce(trim({c}), '') = '' AS INT)), 4) FROM reviewed_v" for c in C.CORE_FIELDS)}
UNION ALL SELECT 'cross_split', column_name, 'shared_values', count(*) FILTER (WHERE s > 1) FROM cs GROUP BY column_name""",
)
def quality_report(spark, sf):
    return K.quality_report(reviewed(spark, sf))


def messy_features(spark, sf):
    t = training_features_df(spark, sf)
    return t.withColumns(
        {
            "course_present": F.when(F.col("document_id") % 10 != 0, F.col("course_present")),
            "qr_present": F.when(F.col("document_id") % 4 == 0, "yes").otherwise(F.col("qr_present").cast("string")),
            "text_duplicate_similarity": F.lit(None).cast("double"),
        }
    )


_FEATURE_ROWS = []
for _c in C.FEATURE_COLUMNS:
    _n = {"course_present": "count(*) FILTER (WHERE document_id % 10 <> 0)", "text_duplicate_similarity": "0"}.get(_c, "count(*)")
    _b = "count(*) FILTER (WHERE document_id % 4 = 0)" if _c == "qr_present" else "0"
    _FEATURE_ROWS.append(
        f"SELECT '{_c}' AS feature, 1 AS in_schema, CAST({_n} AS BIGINT) AS present_count, CAST({_b} AS BIGINT) AS non_numeric, round({_n} / count(*), 4) AS rate, CAST({_n} = 0 AS INT) AS zero_coverage FROM raw_v"
    )


@query("feature_coverage", ctes("raw_v") + " " + " UNION ALL ".join(_FEATURE_ROWS))
def feature_coverage(spark, sf):
    return K.feature_coverage(messy_features(spark, sf)).withColumns(
        {"in_schema": F.col("in_schema").cast("int"), "zero_coverage": F.col("zero_coverage").cast("int")}
    )


@query(
    "feature_null_rates",
    ctes("raw_v") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(CAST({ {'course_present': 'document_id % 10 = 0', 'text_duplicate_similarity': 'true'}.get(c, 'false')} AS INT)), 4) AS null_rate FROM raw_v"
        for c in C.FEATURE_COLUMNS
    ),
)
def feature_null_rates(spark, sf):
    return K.null_rates(messy_features(spark, sf))


@query(
    "training_schema_checks",
    ctes("raw_v") + """ SELECT * FROM (SELECT unnest(['missing_features', 'missing_label', 'invalid_labels', 'empty_class', 'small_class', 'null_features', 'dtype_mismatch', 'insufficient_rows', 'unknown_certificate_types']) AS check_name,
  unnest(['error', 'error', 'error', 'error', 'warning', 'error', 'error', 'error', 'warning']) AS severity,
  unnest([CAST(0 AS BIGINT), 0, (SELECT count(*) FROM raw_v WHERE document_id % 25 = 0), 0, 0, (SELECT count(*) FROM raw_v), 1, 0, (SELECT count(*) FROM raw_v WHERE certificate_type <> 'academic')]) AS violations)""",
)
def training_schema_checks(spark, sf):
    rows = messy_features(spark, sf).withColumn("label", F.when(F.col("document_id") % 25 == 0, 7).otherwise(F.col("label")))
    return K.schema_checks(rows)


_NULL_RATE = {"course_present": "document_id % 10 = 0", "text_duplicate_similarity": "true"}


@query(
    "schema_alignment",
    ctes("raw_v") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {int(c != 'seal_present')} AS in_schema, {int(c not in ('seal_present', 'qr_present'))} AS numeric_type, "
        f"{int(c not in ('seal_present', 'cert_id_format_valid', 'cert_id_checksum_valid'))} AS same_position, "
        + ("max(CAST(NULL AS DOUBLE))" if c == "seal_present" else f"round(avg(CAST({_NULL_RATE.get(c, 'false')} AS INT)), 4)") + " AS null_rate FROM raw_v"
        for c in C.FEATURE_COLUMNS
    ),
)
def schema_alignment(spark, sf):
    """A table with a dropped column, a text column and two swapped columns against the contract."""
    full = training_features_df(spark, sf)
    order = ["cert_id_checksum_valid", "cert_id_format_valid", *[c for c in C.FEATURE_COLUMNS[2:] if c != "seal_present"]]
    messy = messy_features(spark, sf).select("document_id", *order)
    return K.alignment_table(messy, full)


@query(
    "training_readiness",
    ctes("raw_v") + " SELECT count(*) AS row_count, count(*) FILTER (WHERE label = 0) AS genuine_count, count(*) FILTER (WHERE label = 1) AS suspicious_count, CAST(0 AS BIGINT) AS schema_errors, CAST(0 AS BIGINT) AS alignment_errors, 1 AS would_pass_training FROM raw_v",
)
def training_readiness(spark, sf):
    return K.readiness(training_features_df(spark, sf)).withColumn("would_pass_training", F.col("would_pass_training").cast("int"))


@query("unexpected_languages", "SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'fr')")
def unexpected_languages(spark, sf):
    return K.unexpected_values(table(spark, sf, "documents"), "lang", ["en", "fr"])


@query("raw_set_counts", ctes("raw_v") + " SELECT certificate_type, label, count(*) AS n FROM raw_v GROUP BY ALL")
def raw_set_counts(spark, sf):
    return derived(spark, sf, "raw_v").groupBy("certificate_type", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "usable_training_rows",
    TRAINING_FEATURES_SQL + " SELECT document_id, label, suspicious_keyword_count FROM training_v WHERE document_id % 10 <> 0 AND document_id % 6 <> 0",
)
def usable_training_rows(spark, sf):
    rows = training_features_df(spark, sf).withColumns(
        {
            "course_present": F.when(F.col("document_id") % 10 != 0, F.col("course_present")),
            "features_available": F.col("document_id") % 6 != 0,
        }
    )
    return usable_rows(cut_lineage(rows)).select("document_id", "label", "suspicious_keyword_count")


def with_snapshots(spark, sf):
    """Verifications whose stored JSON holds features for two of three rows."""
    v = derived(spark, sf, "verifications_v")
    stored = F.when(F.col("document_id") % 3 != 0, F.concat(F.lit('{"features":{"issuer_known":1,"visual_noise":'), (F.col("document_id") % 10).cast("string"), F.lit("}}")))
    return v.withColumn("intelligence_json", stored)


@query(
    "feature_snapshots",
    TRAINING_FEATURES_SQL + """ SELECT 'V' || CAST(document_id AS VARCHAR) AS verification_id, CAST(document_id % 3 <> 0 OR document_id % 2 = 0 AS INT) AS features_available,
  CASE WHEN document_id % 3 <> 0 THEN 1.0 WHEN document_id % 2 = 0 THEN CAST(issuer_known AS DOUBLE) END AS issuer_known, CASE WHEN document_id % 3 <> 0 THEN CAST(document_id % 10 AS DOUBLE) WHEN document_id % 2 = 0 THEN visual_noise END AS visual_noise FROM training_v""",
)
def feature_snapshots(spark, sf):
    again = training_features_df(spark, sf).filter(F.col("document_id") % 2 == 0).withColumn(
        "verification_id", F.concat(F.lit("V"), F.col("document_id").cast("string"))
    )
    out = snapshot_features(with_snapshots(spark, sf), again)
    return out.select("verification_id", F.col("features_available").cast("int").alias("features_available"), "issuer_known", "visual_noise")


@query(
    "collected_reviews",
    ctes("feedback_v") + """ SELECT verification_id, reviewer_label, CASE WHEN reviewer_label = 'confirmed_suspicious' THEN 1 ELSE 0 END AS label, coalesce(certificate_type, 'unknown') AS certificate_type,
  CASE WHEN document_id % 67 = 0 THEN '' ELSE coalesce(cert_id, '') END AS certificate_id, 0 AS features_available FROM feedback_v WHERE reviewer_label <> 'uncertain'""",
)
def collected_reviews(spark, sf):
    rows = collect_reviewed(derived(spark, sf, "feedback_v").drop("candidate_name", "course", "cert_id", "issue_date"), with_snapshots(spark, sf))
    return rows.select(
        "verification_id", "reviewer_label", "label", "certificate_type", "certificate_id",
        F.col("features_available").cast("int").alias("features_available"),
    )


