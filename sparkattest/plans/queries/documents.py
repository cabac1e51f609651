"""Text, fields, scalars and features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ... import constants as C
from ...functions import domains as D
from ...functions import scores as S
from ...functions import semantics as M
from ...functions import text as T
from ...operators.extraction import diagnostics, extract_fields, with_extraction_quality
from ...operators.features import build_features, feature_projection
from ..derived import ctes, derived, table
from ..verify import runtime_features
from . import query
from . import sql as Q

AS_OF = dt.date(2000, 1, 1)


def ints(*names: str) -> list:
    return [F.col(n).cast("int").alias(n) for n in names]


_FIELDS = f"""
SELECT document_id, cert_id, candidate_name, organization, course, issue_date, marks_total, marks_obtained, grade, certificate_title,
       {', '.join(f'CAST(has_{m} AS INT) AS has_{m}' for m in ('signature', 'seal', 'qr', 'url'))},
       array_to_string(list_transform(list_filter(codes, lambda s, i: list_position(list_transform(codes, lambda x: x.code), s.code) = i), lambda s: s.label || '=' || s.code || '=' || s.kind), ';') AS codes
FROM fields_v"""


def _all_fields(docs, **options):
    fields = extract_fields(docs, **options)
    codes = F.transform("verification_codes", lambda c: F.concat_ws("=", c["label"], c["code"], c["kind"]))
    return fields.select(
        "document_id", "cert_id", "candidate_name", "organization", "course", "issue_date", "marks_total",
        "marks_obtained", "grade", "certificate_title", *ints("has_signature", "has_seal", "has_qr", "has_url"),
        F.array_join(codes, ";").alias("codes"),
    )


@query("certificate_fields", Q.fields_sql() + _FIELDS)
def certificate_fields(spark, sf):
    return _all_fields(derived(spark, sf, "texts_v").select("document_id", "text"))


@query("recovered_fields", Q.fields_sql(bare=True) + _FIELDS)
def recovered_fields(spark, sf):
    """The same texts taken as recovered from images: names and courses without a title or a label are accepted."""
    return _all_fields(derived(spark, sf, "texts_v").select("document_id", "text"), allow_bare_name=True)


@query("document_fields", Q.fields_sql(Q.DOCUMENT_TEXTS) + _FIELDS)
def document_fields(spark, sf):
    return _all_fields(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("recovered_document_fields", Q.fields_sql(Q.DOCUMENT_TEXTS, bare=True) + _FIELDS)
def recovered_document_fields(spark, sf):
    return _all_fields(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"), allow_bare_name=True)


@query(
    "extraction_diagnostics",
    Q.intel_sql() + f"""
SELECT document_id, extraction_method AS method, extraction_confidence, extraction_completeness,
       CASE WHEN extraction_confidence >= 0.7 THEN 'high' WHEN extraction_confidence >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_level,
       CAST(NOT ocr_failed AS INT) AS text_sufficient, length(trim(text)) AS extracted_text_length,
       {' + '.join(Q.flag(Q.present(c)) for c in C.CORE_FIELDS)} AS fields_detected, 5 AS fields_total
FROM quality_v""",
)
def extraction_diagnostics(spark, sf):
    docs = with_extraction_quality(extract_fields(derived(spark, sf, "texts_v").select("document_id", "text")))
    return diagnostics(docs.withColumn("text_sufficient", F.col("text_sufficient").cast("int"))).select(
        "document_id", "method", "extraction_confidence", "extraction_completeness", "confidence_level",
        "text_sufficient", "extracted_text_length", "fields_detected", "fields_total",
    )


def _snippets(role: str) -> str:
    parts = []
    for p in C.ROLE_PHRASES[role]:
        at = f"instr(low, {Q.lit(p)})"
        parts.append(
            f"CASE WHEN {at} > 0 THEN trim(replace(substr(text, greatest({at} - 120, 1), {at} + {len(p)} + 120 - greatest({at} - 120, 1)), chr(10), ' ')) END"
        )
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)[1:3]"


@query(
    "semantic_roles",
    ctes("texts_v") + f"""
SELECT document_id, {', '.join(f'{Q.flag(Q.any_of("low", w))} AS role_{r}' for r, w in C.ROLE_PHRASES.items())},
       CASE WHEN {Q.match('low', 'student[- ]level')} THEN 'student_level' WHEN contains(low, 'professional') THEN 'professional'
            WHEN contains(replace(low, 'associate level', ''), 'associate') THEN 'associate' WHEN contains(low, 'advanced') THEN 'advanced' WHEN contains(low, 'expert') THEN 'expert'
            WHEN contains(low, 'fundamentals') THEN 'fundamentals' WHEN contains(low, 'essentials') THEN 'essentials' ELSE 'unknown' END AS credential_level,
       {Q.flag(Q.any_of('low', C.VERIFICATION_PHRASES))} AS verification_present,
       {' + '.join(Q.flag(Q.any_of('low', w)) for w in C.ROLE_PHRASES.values())} AS role_count,
       array_to_string(list_concat({', '.join(f"list_transform({_snippets(r)}, lambda s: '{r}:' || s)" for r in C.ROLE_PHRASES)}), '~') AS statements
FROM (SELECT document_id, text, lower(text) AS low FROM texts_v)""",
)
def semantic_roles(spark, sf):
    docs = derived(spark, sf, "texts_v").select("document_id", "text", F.lower("text").alias("low"))
    low, text = F.col("low"), F.col("text")
    phrases = F.transform(M.statements(text, low), lambda s: F.concat_ws(":", s["role"], s["phrase"]))
    return docs.select(
        "document_id", *[f.cast("int").alias(f"role_{r}") for r, f in M.role_flags(low).items()],
        M.credential_level(low).alias("credential_level"),
        M.verification_present(low).cast("int").alias("verification_present"), M.role_count(low).alias("role_count"),
        F.array_join(phrases, "~").alias("statements"),
    )


_FLAGS = Q.type_flags("low", "low_issuer")


@query(
    "document_wording",
    f"""
SELECT doc_id, {Q.count_of('low', C.SUSPICIOUS_KEYWORDS)} AS keyword_count, {Q.flag(Q.any_of('low', C.URL_MARKERS))} AS url_marker,
       {Q.flag(Q.any_of('low', C.TITLE_WORDS))} AS title_word, {Q.flag(Q.any_of('low', C.RECIPIENT_PHRASES))} AS recipient_phrase,
       {', '.join(f'{e} AS type_{n}' for n, e in _FLAGS.items())}, {Q.primary(_FLAGS)} AS primary_type
FROM (SELECT doc_id, lower(text) AS low, lower(source) AS low_issuer FROM documents)""",
)
def document_wording(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"), F.lower("source").alias("low_issuer"))
    low = F.col("low")
    flags = T.type_flag_columns(low, F.col("low_issuer"))
    named = docs.select(
        "doc_id", T.count_contained(low, C.SUSPICIOUS_KEYWORDS).alias("keyword_count"),
        T.contains_any(low, C.URL_MARKERS).cast("int").alias("url_marker"),
        T.contains_any(low, C.TITLE_WORDS).cast("int").alias("title_word"),
        T.contains_any(low, C.RECIPIENT_PHRASES).cast("int").alias("recipient_phrase"),
        *[f.alias(f"type_{n}") for n, f in flags.items()],
    )
    return named.withColumn("primary_type", T.primary_type({n: F.col(f"type_{n}") for n in flags}))


@query(
    "certificate_type_flags",
    ctes("texts_v") + f"""
SELECT document_id, {', '.join(f'{e} AS type_{n}' for n, e in _FLAGS.items())}, {Q.primary(_FLAGS)} AS primary_type
FROM (SELECT document_id, lower(text) AS low, lower(issuer) AS low_issuer FROM texts_v)""",
)
def certificate_type_flags(spark, sf):
    docs = derived(spark, sf, "texts_v").select("document_id", F.lower("text").alias("low"), F.lower("issuer").alias("iss"))
    flags = T.type_flag_columns(F.col("low"), F.col("iss"))
    named = docs.select("document_id", *[f.alias(f"type_{n}") for n, f in flags.items()])
    return named.withColumn("primary_type", T.primary_type({n: F.col(f"type_{n}") for n in flags}))


@query(
    "content_fingerprints",
    """SELECT doc_id, sha256(text) AS file_fingerprint, md5(trim(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')))) AS normalized_digest,
       regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS issuer_key FROM documents""",
)
def content_fingerprints(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.file_fingerprint(F.col("text")).alias("file_fingerprint"),
        F.md5(F.trim(T.normalize_text(F.col("text")))).alias("normalized_digest"),
        T.normalize_issuer(F.col("source")).alias("issuer_key"),
    )


@query(
    "identity_fingerprints",
    ctes("certificates_v") + """
SELECT document_id, regexp_replace(upper(cert_id), '[^A-Z0-9-]', '', 'g') AS cert_id_fingerprint,
       CASE WHEN candidate_name <> '' AND issuer <> '' AND course <> '' AND issue_date IS NOT NULL
            THEN sha256(lower(candidate_name) || '|' || lower(issuer) || '|' || lower(course) || '|' || CAST(issue_date AS VARCHAR)) END AS identity_fingerprint,
       sha1('phase12-label-group-v1:' || regexp_replace(lower(issuer), '[^a-z0-9]+', '', 'g') || ':' || course) AS template_key
FROM certificates_v""",
)
def identity_fingerprints(spark, sf):
    c = derived(spark, sf, "certificates_v")
    return c.select(
        "document_id", T.cert_id_fingerprint(F.col("cert_id")).alias("cert_id_fingerprint"),
        T.identity_fingerprint(F.col("candidate_name"), F.col("issuer"), F.col("course"), F.col("issue_date")).alias("identity_fingerprint"),
        T.template_key(F.col("issuer"), F.col("course")).alias("template_key"),
    )


def _mask(v: str) -> str:
    tail = f"CASE WHEN length({v}) > 7 THEN 3 ELSE 2 END"
    return (
        f"CASE WHEN {v} IS NULL THEN '' WHEN length({v}) <= 4 THEN repeat('*', length({v})) "
        f"ELSE left({v}, 4) || repeat('*', CAST(greatest(4, length({v}) - 4 - {tail}) AS INT)) || right({v}, CAST({tail} AS INT)) END"
    )


@query(
    "masked_identifiers",
    ctes("certificates_v") + f"""
SELECT document_id, {_mask('cert_id')} AS masked_id, {_mask('short_id')} AS masked_short,
       CAST(coalesce(regexp_matches(cert_id, '^[A-Za-z0-9._-]{{6,64}}$'), false) AS INT) AS well_formed
FROM (SELECT document_id, cert_id, CAST(document_id AS VARCHAR) AS short_id FROM certificates_v)""",
)
def masked_identifiers(spark, sf):
    c = derived(spark, sf, "certificates_v")
    return c.select(
        "document_id", T.mask_identifier(F.col("cert_id")).alias("masked_id"),
        T.mask_identifier(F.col("document_id")).alias("masked_short"),
        T.code_well_formed(F.col("cert_id")).cast("int").alias("well_formed"),
    )


@query(
    "masked_audit_details",
    ctes("certificates_v") + f"""
SELECT document_id, '{{"cert_id":"' || {_mask('cert_id')} || '","outer":{{"code":"' || {_mask('num')} || '","file":"f' || num || '"}},"list":[{{"token":"' || {_mask('num2')} || '"}}],"identifier":"****","more":{{"code":"****"}}}}' AS details
FROM (SELECT document_id, coalesce(cert_id, 'none') AS cert_id, CAST(document_id AS VARCHAR) AS num, CAST(document_id * 7919 AS VARCHAR) AS num2 FROM certificates_v)""",
)
def masked_audit_details(spark, sf):
    c = derived(spark, sf, "certificates_v")
    number = F.col("document_id").cast("string")
    raw = F.concat(
        F.lit('{"cert_id":"'), F.coalesce("cert_id", F.lit("none")), F.lit('","outer":{"code":"'), number,
        F.lit('","file":"f'), number, F.lit('"},"list":[{"token":'), (F.col("document_id") * 7919).cast("string"),
        F.lit('}],"identifier":{"value":{"deep":["}'), number, F.lit('"]}},"more":{"code":[["'), number, F.lit('"],{"token":1}]}}'),
    )
    return c.select("document_id", T.mask_json_values(raw).alias("details"))


@query(
    "safe_names",
    ctes("verifications_v") + """
SELECT verification_id, left(regexp_replace(regexp_replace(filename || '.v' || user_id, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}_-]', '_', 'g'), 80) AS stem,
       CASE WHEN length(trim(extracted_info)) > 60 THEN left(trim(extracted_info), 59) || '…' ELSE trim(extracted_info) END AS shown
FROM verifications_v""",
)
def safe_names(spark, sf):
    v = derived(spark, sf, "verifications_v")
    return v.select(
        "verification_id", T.safe_stem(F.concat("filename", F.lit(".v"), "user_id")).alias("stem"),
        T.safe_text(F.col("extracted_info"), 60).alias("shown"),
    )


@query(
    "truncated_texts",
    """SELECT doc_id, CASE WHEN trim(text) = '' THEN NULL WHEN length(trim(text)) > 500 THEN left(trim(text), 499) || '…' ELSE trim(text) END AS shown,
       CASE WHEN trim(text) = '' THEN 'unknown error' WHEN length(trim(text)) > 200 THEN left(trim(text), 199) || '…' ELSE trim(text) END AS error_text FROM documents""",
)
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.safe_text(F.col("text")).alias("shown"), T.truncate_error(F.col("text")).alias("error_text")
    )


_HOST = r"://([^/?#]*)"
PAYLOADS = """payload_v AS (
  SELECT page_id, 'full' AS form, url AS payload FROM pages
  UNION ALL SELECT page_id, 'bare', regexp_replace(url, '^[a-z]+://', '') FROM pages
)"""


def _payloads(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    forms = F.array(
        F.struct(F.lit("full").alias("form"), F.col("url").alias("payload")),
        F.struct(F.lit("bare").alias("form"), F.regexp_replace("url", "^[a-z]+://", "").alias("payload")),
    )
    return pages.select("page_id", F.explode(forms).alias("p")).select("page_id", "p.*")


PAYLOAD_PARTS = f"""parts_v AS (
  SELECT page_id, form, payload, web OR bare AS is_url, CASE WHEN web THEN lower(regexp_extract(payload, '^([A-Za-z]+)://', 1)) WHEN bare THEN 'http' END AS scheme,
         nullif(lower(CASE WHEN web THEN regexp_extract(payload, '{_HOST}', 1) WHEN bare THEN regexp_extract(payload, {Q.lit(C.BARE_DOMAIN)}, 1) END), '') AS domain,
         CASE WHEN web THEN regexp_extract(payload, '://[^/?#]*([^?#]*)', 1)
              WHEN bare AND length(payload) > length(regexp_extract(payload, {Q.lit(C.BARE_DOMAIN)}, 1)) THEN substr(payload, length(regexp_extract(payload, {Q.lit(C.BARE_DOMAIN)}, 1)) + 1) END AS path
  FROM (SELECT *, contains(payload, '://') AND regexp_matches(payload, '^(?i:https?)://') AS web, NOT contains(payload, '://') AND {Q.match('payload', C.BARE_DOMAIN)} AS bare FROM payload_v)
)"""


@query(
    "url_payloads",
    "WITH " + PAYLOADS + ",\n" + PAYLOAD_PARTS + f"""
SELECT page_id, form, CAST(is_url AS INT) AS is_url, scheme, CAST(coalesce(scheme = 'https', false) AS INT) AS is_https, domain,
       CASE WHEN contains(domain, '.') THEN regexp_extract(domain, '[^.]*$', 0) END AS tld, path,
       CAST(coalesce({Q.any_of('lower(path)', C.VERIFICATION_PATH_WORDS)}, false) OR coalesce({Q.any_of('domain', C.VERIFICATION_DOMAIN_WORDS)}, false) AS INT) AS verification_page
FROM parts_v""",
)
def url_payloads(spark, sf):
    parts = D.payload_parts(F.col("payload"))
    return _payloads(spark, sf).select(
        "page_id", "form",
        *[(c.cast("int") if n in ("is_url", "is_https", "verification_page") else c).alias(n) for n, c in parts.items()],
    )


def _cand(name: str) -> str:
    stripped = f"lower(trim({name}))"
    for s in C.ORG_SUFFIXES:
        stripped = f"replace({stripped}, {Q.lit(s)}, '')"
    tokens = f"list_filter(regexp_split_to_array({stripped}, '[^a-z0-9]+'), lambda t: t <> '')"
    useful = f"list_filter({tokens}, lambda t: t NOT IN {Q.inlist(C.ISSUER_FILLER_WORDS)})"

    def tlds(parts: str, n: int) -> str:
        return f"CASE WHEN len({parts}) >= {n} THEN list_transform(['.com', '.edu', '.org'], lambda e: array_to_string({parts}, '.') || e) ELSE [] END"

    return f"list_concat({tlds(tokens, 2)}, {tlds(useful, 1)})"


@query(
    "candidate_domains",
    ctes("certificates_v") + f"SELECT document_id, array_to_string({_cand('issuer')}, ' ') AS domains FROM certificates_v",
)
def candidate_domains(spark, sf):
    c = derived(spark, sf, "certificates_v")
    return c.select("document_id", F.array_join(D.candidate_domains(F.col("issuer")), " ").alias("domains"))


@query(
    "domain_consistency",
    "WITH " + PAYLOADS + ",\n" + PAYLOAD_PARTS + f""",
named_v AS (SELECT page_id, form, domain, CASE WHEN page_id % 3 = 0 THEN 'Other School Ltd' ELSE replace(regexp_replace(domain, '\\.[^.]*$', ''), '.', ' ') END AS issuer FROM parts_v)
SELECT page_id, form, issuer, CASE WHEN domain IS NULL THEN 'no_qr'
       WHEN len(list_filter(list_concat({_cand('issuer')}, ['example.org']), lambda e: domain = e OR ends_with(domain, '.' || e) OR ends_with(e, '.' || domain))) > 0 THEN 'consistent' ELSE 'inconsistent' END AS consistency
FROM named_v""",
)
def domain_consistency(spark, sf):
    parts = D.payload_parts(F.col("payload"))
    rows = _payloads(spark, sf).select("page_id", "form", parts["domain"].alias("domain"))
    issuer = F.when(F.col("page_id") % 3 == 0, "Other School Ltd").otherwise(
        F.replace(F.regexp_replace("domain", r"\.[^.]*$", ""), F.lit("."), F.lit(" "))
    )
    named = rows.withColumn("issuer", issuer)
    expected = F.array_union(D.candidate_domains(F.col("issuer")), F.array(F.lit("example.org")))
    domains = F.array_compact(F.array("domain"))
    return named.select("page_id", "form", "issuer", D.domain_consistency(domains, expected).alias("consistency"))


@query(
    "issue_dates",
    """WITH d AS (SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR)
        WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T10:20:30' WHEN 2 THEN '' WHEN 3 THEN '2024-02-31' ELSE CAST(year(o_orderdate) - 10 AS VARCHAR) || '-01-15' END AS raw FROM orders)
SELECT document_id, TRY_CAST(left(raw, 10) AS DATE) AS parsed, CAST(coalesce(year(TRY_CAST(left(raw, 10) AS DATE)) BETWEEN 1990 AND 2026, false) AS INT) AS year_ok,
       CAST(coalesce(year(TRY_CAST(left(raw, 10) AS DATE)) BETWEEN 1990 AND 2026 AND TRY_CAST(left(raw, 10) AS DATE) <= DATE '2000-01-01', false) AS INT) AS date_ok,
       CASE document_id % 4 WHEN 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 37230 SECOND WHEN 1 THEN CAST(day AS TIMESTAMP) END AS stamp
FROM d""",
)
def issue_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    text = day.cast("string")
    compact = F.date_format(day, "yyyyMMdd")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderkey") % 5 == 0, text).when(F.col("o_orderkey") % 5 == 1, F.concat(text, F.lit("T10:20:30")))
        .when(F.col("o_orderkey") % 5 == 2, "").when(F.col("o_orderkey") % 5 == 3, "2024-02-31")
        .otherwise(F.concat((F.year(day) - 10).cast("string"), F.lit("-01-15"))).alias("raw"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("D:"), compact, F.lit("102030+02'00'")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("D:"), compact))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("D:"), F.left(compact, F.lit(6)))).otherwise("unknown").alias("pdf"),
    )
    parsed = S.parse_date(F.col("raw"))
    return rows.select(
        "document_id", parsed.alias("parsed"), S.year_valid(parsed).cast("int").alias("year_ok"),
        S.date_consistent(parsed, AS_OF).cast("int").alias("date_ok"),
        S.pdf_timestamp(F.col("pdf")).cast("timestamp_ntz").alias("stamp"),
    )


_PCT = "CASE WHEN marks_total > 0 THEN marks_obtained / marks_total * 100 ELSE 0.0 END"


@query(
    "certificate_scores",
    ctes("certificates_v") + f"""
SELECT document_id, CAST(coalesce({Q.match('cert_id', C.STANDARD_CERT_ID)}, false) AS INT) AS format_ok, CAST({Q.checksum_ok('cert_id')} AS INT) AS checksum_ok,
       CAST(marks_total > 0 AND marks_obtained BETWEEN 0 AND marks_total AS INT) AS marks_ok, {_PCT} AS pct, {Q.band(_PCT)} AS band,
       CAST(upper(grade) = {Q.band(_PCT)} AS INT) AS grade_ok, CAST({Q.known('issuer2')} AS INT) AS known,
       CAST(CASE WHEN {Q.known('issuer2')} THEN 1.0 WHEN issuer2 = '' THEN 0.0 WHEN {Q.any_of('lower(issuer2)', C.LOW_TRUST_ISSUER_WORDS)} THEN 0.15 ELSE 0.4 END AS DOUBLE) AS trust
FROM (SELECT *, CASE document_id % 4 WHEN 0 THEN 'ETH Zurich ' WHEN 1 THEN 'Fast Diploma Emporium' ELSE issuer END AS issuer2 FROM certificates_v)""",
)
def certificate_scores(spark, sf):
    c = derived(spark, sf, "certificates_v").withColumns(
        {
            "issuer2": F.when(F.col("document_id") % 4 == 0, "ETH Zurich ").when(F.col("document_id") % 4 == 1, "Fast Diploma Emporium").otherwise(F.col("issuer")),
            "pct": S.marks_percent(F.col("marks_total"), F.col("marks_obtained")),
        }
    )
    return c.select(
        "document_id", S.cert_id_format_valid(F.col("cert_id")).cast("int").alias("format_ok"),
        S.cert_id_checksum_valid(F.col("cert_id")).cast("int").alias("checksum_ok"),
        S.marks_valid(F.col("marks_total"), F.col("marks_obtained")).cast("int").alias("marks_ok"), "pct",
        S.grade_band(F.col("pct")).alias("band"), S.grade_consistent(F.col("grade"), F.col("pct")).cast("int").alias("grade_ok"),
        S.issuer_known(F.col("issuer2")).cast("int").alias("known"), S.issuer_trust(F.col("issuer2")).alias("trust"),
    )


_RAW_TYPES = Q.type_flags("lower(text_snippet)", "lower(issuer)")
_RAW_DAY = "TRY_CAST(issue_date AS DATE)"
_NAME_OK = "(length(trim(candidate_name)) > 3)"


def feature_values(types: dict, name_ok: str, org: str, issuer: str, title: str, text: str, known: str, completeness: str, visual: list[str], link: str, flags: list[str]) -> str:
    low = f"lower({text})"
    date_ok = f"({_RAW_DAY} IS NOT NULL)"
    issuer_ok, title_ok = org, Q.present(title)
    pct = "CASE WHEN marks_total > 0 THEN coalesce(marks_obtained / marks_total * 100, 0.0) ELSE 0.0 END"
    values = {
        "cert_id_format_valid": Q.flag(f"coalesce({Q.match('cert_id', C.STANDARD_CERT_ID)}, false)"),
        "cert_id_checksum_valid": Q.flag(Q.checksum_ok("cert_id")),
        "issuer_known": Q.flag(known),
        "issue_year_valid": Q.flag(f"coalesce(year({_RAW_DAY}) BETWEEN 1990 AND 2026, false)"),
        "date_consistency_valid": Q.flag(f"coalesce(year({_RAW_DAY}) BETWEEN 1990 AND 2026 AND {_RAW_DAY} <= DATE '2000-01-01', false)"),
        "candidate_name_present": Q.flag(name_ok), "course_present": Q.flag(Q.present("course")),
        "organization_present": Q.flag(Q.present("organization")), "text_field_completeness": completeness,
        "marks_pattern_valid": Q.flag("coalesce(marks_total > 0 AND marks_obtained BETWEEN 0 AND marks_total, false)"),
        "grade_consistency_valid": Q.flag(f"coalesce(upper(trim(grade)) = {Q.band(pct)}, false)"),
        "suspicious_keyword_count": Q.count_of(low, C.SUSPICIOUS_KEYWORDS),
        "suspicious_url_present": Q.flag(f"({Q.any_of(low, C.URL_MARKERS)} OR {link})"),
        "signature_present": Q.flag(flags[0]), "seal_present": Q.flag(flags[1]), "qr_present": Q.flag(flags[2]),
        "visual_blank_ratio": visual[0], "visual_sharpness": visual[1], "visual_noise": visual[2], "visual_color_anomaly": visual[3],
        "text_duplicate_similarity": "CAST(0.0 AS DOUBLE)",
        "issuer_domain_trust": f"CAST(CASE WHEN {known} THEN 1.0 WHEN trim({issuer}) = '' THEN 0.0 WHEN {Q.any_of(f'lower({issuer})', C.LOW_TRUST_ISSUER_WORDS)} THEN 0.15 ELSE 0.4 END AS DOUBLE)",
        **{f"certificate_type_{t}": types[t] for t in ("academic", "completion", "training", "technical")},
        "recipient_present": Q.flag(name_ok), "completion_date_present": Q.flag(date_ok),
        "issuer_present": Q.flag(issuer_ok), "completion_title_present": Q.flag(title_ok),
        "certificate_structure_completeness": f"round(({Q.flag(name_ok)} + {Q.flag(date_ok)} + {Q.flag(issuer_ok)} + {Q.flag(title_ok)}) / 4.0, 4)::DOUBLE",
    }
    return ", ".join(f"{values[c]} AS {c}" for c in C.FEATURE_COLUMNS)


TRAINING_FEATURES_SQL = ctes("raw_v") + f""",
training_v AS (SELECT document_id, label, certificate_type, risk_score, {feature_values(
    _RAW_TYPES, _NAME_OK, f"({Q.present('issuer')} OR {Q.present('organization')})", 'issuer', 'title', 'text_snippet',
    "(issuer_in_registry = 1 AND issuer <> '')", Q.fraction('candidate_name', 'course', 'organization', 'issuer'),
    ['blank_ratio', 'sharpness', 'noise_level', 'color_anomaly'], 'has_url', ['has_signature', 'has_seal', 'has_qr'])}
FROM raw_v)"""


def training_features_df(spark, sf, keep=("document_id", "label", "certificate_type")):
    raw = derived(spark, sf, "raw_v")
    known = (F.col("issuer_in_registry") == 1) & (F.col("issuer") != "")
    return build_features(raw, mode="training", as_of=AS_OF, known_issuer=known, keep=list(keep))


@query("training_features", TRAINING_FEATURES_SQL + f" SELECT document_id, label, certificate_type, {', '.join(C.FEATURE_COLUMNS)} FROM training_v")
def training_features(spark, sf):
    return training_features_df(spark, sf)


_RT = Q.type_flags("low", "lower(organization)")


@query(
    "runtime_features",
    Q.fields_sql() + f"""
SELECT document_id, {feature_values(
    _RT, Q.present('candidate_name'), Q.present('organization'), 'organization', 'certificate_title', 'text',
    "(issuer_in_registry = 1 AND organization <> '')", "round(" + Q.fraction('candidate_name', 'course', 'organization') + ", 4)",
    ['CAST(0.0 AS DOUBLE)'] * 3 + ['0'], 'false', ['has_signature', 'has_seal', 'has_qr'])}
FROM fields_v""",
)
def runtime_features_query(spark, sf):
    docs = derived(spark, sf, "texts_v").select("document_id", "text", "issuer_in_registry")
    known = (F.col("issuer_in_registry") == 1) & (F.col("organization") != "")
    return runtime_features(docs, as_of=AS_OF, known_issuer=known)


@query(
    "feature_vectors",
    TRAINING_FEATURES_SQL + " SELECT document_id, "
    + ", ".join(
        f"CASE WHEN document_id % 7 = 0 THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}" if i % 5 == 0 else f"CAST({c} AS DOUBLE) AS {c}"
        for i, c in enumerate(C.FEATURE_COLUMNS)
    ) + " FROM training_v",
)
def feature_vectors(spark, sf):
    messy = training_features_df(spark, sf)
    broken = {
        c: F.when(F.col("document_id") % 14 == 0, "n/a").when(F.col("document_id") % 7 != 0, F.col(c).cast("string"))
        for i, c in enumerate(C.FEATURE_COLUMNS) if i % 5 == 0
    }
    return feature_projection(messy.withColumns(broken), keep=["document_id"])


@query(
    "row_snapshots",
    ctes("certificates_v") + """
SELECT document_id, '{"document_id":' || CAST(document_id AS VARCHAR) || ',"issuer":"' || issuer || '","identity":{"name":"' || candidate_name || '","course":"' || course || '"},"prediction":"' || prediction || '"}' AS snapshot
FROM certificates_v""",
)
def row_snapshots(spark, sf):
    c = derived(spark, sf, "certificates_v")
    body = F.struct("document_id", "issuer", F.struct(F.col("candidate_name").alias("name"), "course").alias("identity"), "prediction")
    return c.select("document_id", F.to_json(body).alias("snapshot"))
