"""SQL text for the comparison engine: helpers and shared relational CTEs.

The field cascades are written relationally here (one row per line of text), so
the check does not repeat the higher-order functions it checks.
"""

from __future__ import annotations

import re

from ... import constants as C
from ..derived import ctes


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(words: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def count_of(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {lit(w)}) AS INT)" for w in words) + ")"


def rx(column: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({column}, {lit(pattern)}, {group}), '')"


def match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def present(column: str) -> str:
    return f"(coalesce(trim(CAST({column} AS VARCHAR)), '') <> '')"


TRIM_PUNCT = lit(r"""[ .:;,()"']+$""")
STRIP_BOTH = lit(r"""^[.,;:()"']+|[.,;:()"']+$""")
# The clause break without its lookahead: the letter it looks at is dropped with the rest.
CLAUSE_AND_REST = "(" + C.ISSUER_CLAUSE_BREAK.replace("(?=[a-z])", "[a-z]") + r")[\s\S]*$"


def title_kind(line: str) -> str:
    low = f"lower(trim({line}))"
    return (
        f"CASE WHEN {low} = '' OR length({low}) > 60 THEN '' "
        f"WHEN starts_with({low}, 'certificate') OR ends_with({low}, 'certificate') THEN 'certificate' "
        f"WHEN starts_with({low}, 'certification') OR ends_with({low}, 'certification') THEN 'certification' ELSE '' END"
    )


def clean_issuer(v: str) -> str:
    head = f"regexp_replace({v}, {lit(CLAUSE_AND_REST)}, '')"
    head = f"regexp_replace({head}, {lit(C.ISSUER_DANGLING)}, '')"
    return f"left(regexp_replace({head}, {TRIM_PUNCT}, ''), 100)"


def generic(v: str) -> str:
    low = f"lower(trim({v}))"
    return (
        f"(coalesce(trim({v}), '') = '' OR {low} IN {inlist(C.GENERIC_ISSUERS + C.BARE_ORG_NOUNS)} "
        f"OR length(trim({v})) < 3 OR length(trim({v})) > 60 OR regexp_full_match({low}, 'the[ \\t]+[a-z][a-z \\t]*') "
        f"OR NOT regexp_matches(trim({v}), '[A-Z]'))"
    )


def org_line(line: str) -> str:
    head = f"regexp_replace(trim({line}), {TRIM_PUNCT}, '')"
    return (
        f"CASE WHEN length({head}) BETWEEN 3 AND 40 AND len(regexp_split_to_array({head}, '\\s+')) <= 4 "
        f"AND NOT {any_of(f'lower({head})', C.ORG_LINE_REJECT)} AND NOT {match(head, C.DATE_IN_TEXT)} "
        f"AND NOT {generic(head)} THEN {head} ELSE '' END"
    )


def whole(part: str) -> str:
    return rf"(?i)^(?:{part})$"


def _iso(y: str, m: str, d: str) -> str:
    return f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"


def _month(g: str) -> str:
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    return f"CAST(list_position({months}, lower(left({g}, 3))) AS VARCHAR)"


def date_iso(hit: str) -> str:
    def g(part: str, i: int) -> str:
        return f"regexp_extract({hit}, {lit(whole(part))}, {i})"

    i, d, mf, df = C.DATE_ISO_PART, C.DATE_DMY_PART, C.DATE_MONTH_FIRST_PART, C.DATE_DAY_FIRST_PART
    return (
        f"CASE WHEN {match(hit, whole(i))} THEN {_iso(g(i, 1), g(i, 2), g(i, 3))} "
        f"WHEN {match(hit, whole(d))} THEN {_iso(g(d, 3), g(d, 2), g(d, 1))} "
        f"WHEN {match(hit, whole(mf))} THEN {_iso(g(mf, 3), _month(g(mf, 1)), g(mf, 2))} "
        f"WHEN {hit} IS NOT NULL THEN {_iso(g(df, 3), _month(g(df, 2)), g(df, 1))} END"
    )


def organizational(name: str) -> str:
    low = f"lower(trim({name}))"
    return (
        f"({any_of(low, C.NAME_REJECT_WORDS + C.ORG_SUFFIXES + C.COURSE_KEYWORDS)} OR starts_with({low}, 'the ') "
        f"OR starts_with({low}, 'a ') OR starts_with({low}, 'an '))"
    )


def tidy_course(v: str) -> str:
    return f"left(regexp_replace(trim({v}), '[ \\t.:;,]+$', ''), 120)"


def keyword_course(low: str) -> str:
    shown = [(w, w.upper() if len(w) <= 4 else w.title()) for w in C.COURSE_KEYWORDS]
    return "CASE " + " ".join(f"WHEN contains({low}, {lit(w)}) THEN {lit(s)}" for w, s in shown) + " END"


def codes_list() -> str:
    parts = []
    for label in C.CODE_LABELS:
        kind = (
            "certificate_id" if any(k in label for k in ("certificate", "certification", "credential"))
            else "reference_number" if any(k in label for k in ("reference", "serial"))
            else "issuer_verification_code"
        )
        pattern = rf"(?i){re.escape(label)}[\s\S]*?({C.CODE_TOKEN})"
        parts.append(
            f"list_transform(regexp_extract_all(text, {lit(pattern)}, 1), lambda c: {{'label': {lit(label)}, 'code': c, 'kind': {lit(kind)}}})"
        )
    return "list_concat(" + ", ".join(parts) + ")"


NAME_LINE_OK = (
    f"length(stripped) BETWEEN 5 AND 60 AND NOT regexp_matches(stripped, '\\d') AND {match('stripped', C.NAME_LINE)} "
    f"AND NOT {any_of('lower(stripped)', C.NAME_REJECT_WORDS + C.COURSE_KEYWORDS)} AND {title_kind('stripped')} = '' "
    f"AND {org_line('stripped')} = ''"
)

LINES = f"""lines_v AS (
  SELECT document_id, j, line, {title_kind('line')} AS kind, regexp_replace(trim(line), {STRIP_BOTH}, '', 'g') AS stripped,
         {org_line('line')} AS org
  FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM texts_v)
),
line_facts_v AS (
  SELECT document_id,
         arg_min({clean_issuer('trim(line)')}, j) FILTER (WHERE {any_of('lower(line)', C.ORG_WORDS)} AND length(trim(line)) > 4
             AND NOT contains(line, ',') AND NOT {generic(clean_issuer('trim(line)'))}) AS keyword_issuer,
         arg_min(left(trim(line), 100), j) FILTER (WHERE kind = 'certificate') AS title1,
         arg_min(left(trim(line), 100), j) FILTER (WHERE kind = 'certification') AS title2,
         min(j) FILTER (WHERE kind <> '') AS title_at,
         coalesce(arg_min(stripped, j) FILTER (WHERE {NAME_LINE_OK} AND stripped = upper(stripped)), arg_min(stripped, j) FILTER (WHERE {NAME_LINE_OK})) AS bare
  FROM lines_v GROUP BY document_id
),
title_issuer_v AS (
  SELECT t.document_id, arg_min(CASE WHEN coalesce(b.org, '') <> '' THEN b.org ELSE a.org END, t.j) AS neighbour
  FROM lines_v t LEFT JOIN lines_v b ON b.document_id = t.document_id AND b.j = t.j - 1
                 LEFT JOIN lines_v a ON a.document_id = t.document_id AND a.j = t.j + 1
  WHERE t.kind <> '' AND NOT contains(t.line, '&') AND NOT contains(t.line, ',')
    AND (coalesce(b.org, '') <> '' OR coalesce(a.org, '') <> '')
  GROUP BY t.document_id
)"""

CERT_GUARD = r"(?:^|[^A-Za-z0-9])(CERT-\d{4}-\d{6})(?:$|[^A-Za-z0-9])"

FIELDS = f"""named_v AS (
  SELECT t.document_id, t.owner, t.text, lower(t.text) AS low, t.prediction, t.risk_score, t.issuer_in_registry, t.file_key, t.created_at,
         f.title1, f.title2, f.title_at,
         upper({rx('t.text', CERT_GUARD, 1)}) AS cert_id,
         coalesce(trim({rx('t.text', C.NAME_AFTER_PHRASE, 1)}),
                  CASE WHEN NOT {organizational(f"regexp_extract(t.text, {lit(C.NAME_BEFORE_VERB)}, 1)")} THEN trim({rx('t.text', C.NAME_BEFORE_VERB, 1)}) END,
                  CASE WHEN f.title_at IS NOT NULL THEN f.bare END) AS candidate_name,
         {clean_issuer(rx('t.text', C.ISSUER_LABEL, 1))} AS label_issuer,
         {clean_issuer(rx('t.text', C.ISSUER_MARKER, 1))} AS marker_issuer,
         f.keyword_issuer, n.neighbour,
         {date_iso('t.hit')} AS issue_date,
         CAST({rx('t.text', C.MARKS_IN_TEXT, 1)} AS DOUBLE) AS marks_obtained,
         CAST({rx('t.text', C.MARKS_IN_TEXT, 2)} AS DOUBLE) AS marks_total,
         upper({rx('t.text', C.GRADE_IN_TEXT, 1)}) AS grade
  FROM (SELECT *, {rx('text', C.DATE_IN_TEXT, 0)} AS hit FROM texts_v) t
  LEFT JOIN line_facts_v f ON f.document_id = t.document_id LEFT JOIN title_issuer_v n ON n.document_id = t.document_id
),
org_v AS (
  SELECT *, coalesce(CASE WHEN NOT {generic('label_issuer')} THEN label_issuer END, CASE WHEN NOT {generic('marker_issuer')} THEN marker_issuer END,
                     keyword_issuer, neighbour, '') AS organization FROM named_v
),
above_v AS (
  SELECT l.document_id, l.j, l.stripped,
         l.stripped <> '' AND (length(l.stripped) > 120 OR {match('l.stripped', C.DATE_IN_TEXT)} OR lower(l.stripped) IN {inlist(C.COURSE_STOP_LINES)}
           OR (coalesce(o.candidate_name, '') <> '' AND lower(l.stripped) = lower(trim(o.candidate_name)))
           OR (o.organization <> '' AND lower(l.stripped) = lower(trim(o.organization)))
           OR {match('l.line', C.LABELED_LINE)} OR NOT regexp_matches(l.stripped, '^[A-Z]') OR regexp_matches(l.stripped, '[.!?]$')) AS stops
  FROM lines_v l JOIN org_v o ON o.document_id = l.document_id AND l.j < o.title_at
),
block_v AS (
  SELECT document_id, string_agg(stripped, ' ' ORDER BY j) AS block
  FROM (SELECT *, max(CASE WHEN stops THEN j ELSE 0 END) OVER (PARTITION BY document_id) AS stop_at FROM above_v)
  WHERE j > stop_at AND stripped <> '' GROUP BY document_id
),
fields_v AS (
  SELECT o.document_id, o.owner, o.text, o.low, o.prediction, o.risk_score, o.issuer_in_registry, o.file_key, o.created_at,
         o.cert_id, o.candidate_name, o.organization, o.issue_date, o.marks_total, o.marks_obtained, o.grade,
         coalesce(CASE WHEN length(b.block) BETWEEN 3 AND 120 THEN b.block END, {tidy_course(rx('o.text', C.COURSE_LABEL, 1))},
                  {tidy_course(rx('o.text', C.COURSE_PHRASE.replace("(?-i:[A-Z])", "(?-i:[A-Z])"), 1))}, {keyword_course('o.low')}) AS course,
         coalesce(o.title1, o.title2) AS certificate_title,
         contains(o.low, 'signature') AS has_signature, {any_of('o.low', ['seal', 'stamp'])} AS has_seal,
         {any_of('o.low', ['qr', 'barcode'])} AS has_qr, {any_of('o.low', C.LINK_MARKERS)} AS has_url,
         {codes_list()} AS codes
  FROM (SELECT * FROM org_v) o LEFT JOIN block_v b ON b.document_id = o.document_id
)"""


DOCUMENT_TEXTS = """texts_v AS (
  SELECT doc_id AS document_id, '' AS owner, coalesce(text, '') AS text, '' AS prediction, 0.0 AS risk_score, 0 AS issuer_in_registry, '' AS file_key,
         CAST(NULL AS TIMESTAMP) AS created_at FROM documents
)"""

LONGEST_LINE = f"""longest_v AS (
  SELECT document_id, left(arg_min(stripped, struct_pack(n := -length(stripped), j := j)), 100) AS longest
  FROM (SELECT l.*, o.organization, o.candidate_name FROM lines_v l JOIN org_v o ON o.document_id = l.document_id)
  WHERE length(stripped) BETWEEN 3 AND 120 AND (organization = '' OR lower(stripped) <> lower(trim(organization)))
    AND (coalesce(candidate_name, '') = '' OR lower(stripped) <> lower(trim(candidate_name)))
    AND {title_kind('stripped')} = '' AND NOT {match('line', C.LABELED_LINE)} AND NOT {match('stripped', C.DATE_IN_TEXT)}
    AND NOT ({org_line('stripped')} <> '' AND NOT {any_of('lower(stripped)', C.COURSE_KEYWORDS)} AND organization <> '')
  GROUP BY document_id
)"""


def fields_sql(texts: str | None = None, *, bare: bool = False) -> str:
    """The field tables over the derived certificates, or over the named texts; `bare` turns the image-text fallbacks on."""
    fields = FIELDS
    if bare:
        fields = fields.replace("CASE WHEN f.title_at IS NOT NULL THEN f.bare END", "f.bare")
        fields = fields.replace(f"{keyword_course('o.low')})", f"{keyword_course('o.low')}, g.longest)")
        fields = fields.replace("LEFT JOIN block_v b ON b.document_id = o.document_id", "LEFT JOIN block_v b ON b.document_id = o.document_id LEFT JOIN longest_v g ON g.document_id = o.document_id")
        fields = fields.replace("fields_v AS (", LONGEST_LINE + ",\nfields_v AS (")
    return (f"WITH {texts}" if texts else ctes("texts_v")) + ",\n" + LINES + ",\n" + fields


def flag(expr: str) -> str:
    return f"CAST({expr} AS INT)"


def type_flags(low: str, issuer: str) -> dict[str, str]:
    domain = r"\b(?:" + "|".join(re.escape(w) for w in C.TECHNICAL_DOMAIN_WORDS) + r")\b"
    academic_text = any_of(low, C.ACADEMIC_WORDS + C.ACADEMIC_CONTEXT_WORDS)

    def either(words: list[str]) -> str:
        return flag(f"({any_of(low, words)} OR {any_of(issuer, words)})")

    return {
        "academic": flag(f"({academic_text} OR {any_of(issuer, C.ACADEMIC_WORDS)})"),
        "technical": flag(f"(NOT {academic_text} AND {any_of(low, C.TECHNICAL_CONTEXT_WORDS)} AND {match(low, domain)})"),
        "training": either(C.TRAINING_WORDS),
        "completion": either(C.COMPLETION_WORDS),
        "online": flag(any_of(low, C.ONLINE_WORDS)),
        "workshop": either(C.WORKSHOP_WORDS),
    }


def checksum_ok(cert: str) -> str:
    serial = f"regexp_extract({cert}, {lit(C.STANDARD_CERT_ID)}, 2)"
    terms = " + ".join(f"TRY_CAST(substr({serial}, {i}, 1) AS INT) * {i}" for i in range(1, 6))
    return f"coalesce({match(cert, C.STANDARD_CERT_ID)} AND ({terms}) % 10 = TRY_CAST(substr({serial}, 6, 1) AS INT), false)"


def band(pct: str) -> str:
    return f"CASE WHEN {pct} >= 90 THEN 'A' WHEN {pct} >= 75 THEN 'B' WHEN {pct} >= 60 THEN 'C' WHEN {pct} >= 50 THEN 'D' WHEN {pct} >= 35 THEN 'E' ELSE 'F' END"


def known(issuer: str) -> str:
    return f"(lower(trim({issuer})) IN {inlist([n.lower() for n in C.KNOWN_ISSUERS])})"


AS_OF = "2000-01-01"


def primary(flags: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {flags[n]} > 0 THEN '{n}'" for n in C.TYPE_PRECEDENCE) + " ELSE 'unknown' END"


def fraction(*columns: str) -> str:
    return "(" + " + ".join(flag(present(c)) for c in columns) + f") / {float(len(columns))}"


_TYPES = type_flags("low", "lower(organization)")
_KNOWN_ISSUER = "(issuer_in_registry = 1 AND organization <> '')"
_DAY = "TRY_CAST(issue_date AS DATE)"
_PCT = "CASE WHEN marks_total > 0 THEN marks_obtained / marks_total * 100 ELSE 0.0 END"

INTEL = f"""status_v AS (
  SELECT *, {_DAY} AS day,
         CASE WHEN {present('candidate_name')} THEN 'ok' ELSE 'missing' END AS recipient_status,
         CASE WHEN {present('course')} THEN 'ok' ELSE 'missing' END AS course_status,
         CASE WHEN NOT {present('cert_id')} THEN 'missing' WHEN {checksum_ok('cert_id')} THEN 'ok' ELSE 'warning' END AS certificate_id_status,
         CASE WHEN NOT {present('organization')} THEN 'missing' WHEN {_KNOWN_ISSUER} THEN 'ok' ELSE 'warning' END AS issuer_status,
         CASE WHEN {_DAY} IS NULL THEN 'missing' WHEN year({_DAY}) BETWEEN 1990 AND 2026 AND {_DAY} <= DATE '{AS_OF}' THEN 'ok' ELSE 'warning' END AS date_status,
         {fraction('candidate_name', 'organization', 'course', 'cert_id', 'issue_date')} AS structure_completeness,
         {', '.join(f'{sql} AS type_{name}' for name, sql in _TYPES.items())},
         {count_of('low', C.SUSPICIOUS_KEYWORDS)} AS keyword_count, {any_of('low', C.URL_MARKERS)} AS url_marker,
         {_PCT} AS pct, trim(text) <> '' AS text_present
  FROM fields_v
),
finding_v AS (
  SELECT *, {primary({n: f'type_{n}' for n in _TYPES})} AS primary_type,
         recipient_status = 'missing' AS f_missing_recipient,
         date_status = 'warning' AS f_invalid_date,
         coalesce(marks_total > 0 AND marks_obtained > marks_total, false) AS f_marks_exceed_total,
         coalesce(marks_total <= 0 AND marks_obtained IS NOT NULL, false) AS f_invalid_marks,
         coalesce({present('grade')} AND marks_total > 0 AND marks_obtained IS NOT NULL AND upper(trim(grade)) <> {band('pct')}, false) AS f_grade_marks_mismatch,
         certificate_id_status = 'warning' AS f_bad_id,
         NOT {present('cert_id')} AND coalesce(trim({rx('text', C.LABELED_ID, 1)}), '') <> '' AS f_labeled_id,
         issuer_status = 'warning' AS f_unknown_issuer,
         {present('organization')} AND {present('cert_id')} AND NOT coalesce({match('cert_id', C.STANDARD_CERT_ID)}, false) AS f_cert_id_issuer_mismatch,
         keyword_count > 0 AS f_suspicious_wording, url_marker AS f_suspicious_url,
         structure_completeness < 0.4 AS f_low_structure
  FROM status_v
),
intel_v AS (
  SELECT *,
         concat_ws(';', CASE WHEN f_missing_recipient THEN 'missing_recipient' END, CASE WHEN f_invalid_date THEN 'invalid_date' END,
           CASE WHEN f_marks_exceed_total THEN 'marks_exceed_total' END, CASE WHEN f_invalid_marks THEN 'invalid_marks' END,
           CASE WHEN f_grade_marks_mismatch THEN 'grade_marks_mismatch' END, CASE WHEN f_bad_id THEN 'invalid_cert_id' END,
           CASE WHEN f_labeled_id THEN 'invalid_cert_id' END, CASE WHEN f_unknown_issuer THEN 'unknown_issuer' END,
           CASE WHEN f_cert_id_issuer_mismatch THEN 'cert_id_issuer_mismatch' END, CASE WHEN f_suspicious_wording THEN 'suspicious_wording' END,
           CASE WHEN f_suspicious_url THEN 'suspicious_url' END, CASE WHEN f_low_structure THEN 'low_structure' END) AS finding_keys,
         {' + '.join(flag(f) for f in ('f_invalid_date', 'f_marks_exceed_total', 'f_grade_marks_mismatch', 'f_bad_id', 'f_labeled_id', 'f_suspicious_wording', 'f_suspicious_url'))} AS high_findings,
         {' + '.join(flag(f) for f in ('f_missing_recipient', 'f_invalid_marks', 'f_unknown_issuer', 'f_cert_id_issuer_mismatch', 'f_low_structure'))} AS medium_findings,
         NOT (f_marks_exceed_total OR f_invalid_marks OR f_grade_marks_mismatch) AS marks_ok,
         round({fraction('candidate_name', 'organization', 'course', 'issue_date', 'cert_id')}, 4) AS extraction_completeness
  FROM finding_v
),
quality_v AS (
  SELECT *, CASE WHEN text_present THEN 'pdf_text' ELSE 'none' END AS extraction_method,
         CASE WHEN text_present THEN round(least(0.6 + 0.4 * extraction_completeness, 0.95), 4) ELSE 0.0 END AS extraction_confidence,
         NOT (text_present AND length(trim(text)) >= 40 AND (extraction_completeness >= 0.4 OR length(trim(text)) >= 150)) AS ocr_failed,
         len(codes) AS n_codes
  FROM intel_v
),
signal_v AS (
  SELECT *, (ocr_failed OR NOT text_present OR extraction_confidence < 0.4 OR extraction_method = 'none') AS low_confidence,
         medium_findings + {flag("issuer_status = 'warning'")} + {flag('NOT text_present')} AS medium_base
  FROM quality_v
)"""


def intel_sql() -> str:
    return fields_sql() + ",\n" + INTEL


DUPLICATES = """valid_prints AS (
  SELECT document_id, owner, kind, rank, value FROM (
    SELECT document_id, owner, 'file' AS kind, 1 AS rank, file_key AS value FROM fields_v WHERE prediction <> 'error'
    UNION ALL SELECT document_id, owner, 'cert_id', 2, regexp_replace(upper(cert_id), '[^A-Z0-9-]', '', 'g') FROM fields_v WHERE prediction <> 'error'
    UNION ALL SELECT document_id, owner, 'identity', 3, sha256(lower(trim(candidate_name)) || '|' || lower(trim(organization)) || '|' || lower(trim(course)) || '|' || issue_date)
      FROM fields_v WHERE prediction <> 'error' AND coalesce(candidate_name, '') <> '' AND organization <> '' AND coalesce(course, '') <> '' AND issue_date IS NOT NULL
  ) WHERE coalesce(value, '') <> ''
),
duplicate_v AS (
  SELECT document_id, kind AS duplicate_type, first_id AS duplicate_of FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS rn FROM (
      SELECT *, min(document_id) OVER (PARTITION BY owner, kind, value) AS first_id FROM valid_prints)
    WHERE first_id < document_id) WHERE rn = 1
)"""

_PRIOR = "d.duplicate_of IS NOT NULL"
REVIEW = f"""review_v AS (
  SELECT s.*, d.duplicate_of, d.duplicate_type,
         CASE WHEN prediction = 'suspicious' OR risk_score >= 0.5 THEN 'high_risk'
              WHEN risk_score >= 0.3 OR high_findings > 0 OR medium_base + {flag('low_confidence')} >= 2 THEN 'manual_review' ELSE 'low_risk' END AS review_status,
         CASE WHEN NOT text_present AND extraction_completeness < 0.2 THEN 'insufficient_information'
              WHEN primary_type = 'unknown' OR structure_completeness < 0.4 OR issuer_status = 'warning' OR (type_academic > 0 AND type_online > 0)
                OR (type_academic > 0 AND type_workshop > 0) OR NOT text_present OR high_findings > 0 OR (keyword_count > 0 AND url_marker) THEN 'unusual'
              ELSE 'normal' END AS ood_status
  FROM signal_v s LEFT JOIN duplicate_v d ON d.document_id = s.document_id
),
priority_v AS (
  SELECT *, CASE WHEN duplicate_of IS NOT NULL OR review_status = 'high_risk' OR risk_score >= 0.5 OR high_findings > 0 OR ood_status = 'unusual' OR structure_completeness < 0.4 THEN 'high'
                 WHEN risk_score >= 0.3 OR review_status = 'manual_review' OR medium_findings >= 2 OR medium_findings > 0 OR ood_status = 'insufficient_information' OR extraction_completeness < 0.6 THEN 'medium'
                 ELSE 'low' END AS review_priority,
         CASE review_status WHEN 'low_risk' THEN 'accept' WHEN 'high_risk' THEN 'investigate' ELSE 'manual_review' END AS recommended_action
  FROM review_v
)"""


def review_sql() -> str:
    return intel_sql() + ",\n" + DUPLICATES + ",\n" + REVIEW


_PARTS = [
    ("ocr_failed OR extraction_method = 'none'", 1.0, 0.35),
    ("NOT (ocr_failed OR extraction_method = 'none') AND NOT text_present", 0.6, 0.3),
    ("NOT (ocr_failed OR extraction_method = 'none') AND text_present AND extraction_confidence < 0.4", 0.55, 0.3),
    ("NOT (ocr_failed OR extraction_method = 'none') AND text_present AND extraction_confidence >= 0.4 AND extraction_confidence < 0.7", 0.25, 0.25),
    ("primary_type = 'unknown'", 0.7, 0.25),
    ("structure_completeness < 0.4", 0.65, 0.25),
    ("structure_completeness >= 0.4 AND structure_completeness < 0.6", 0.3, 0.2),
    ("high_findings > 0", 0.75, 0.3),
    ("high_findings = 0 AND medium_findings > 0", 0.35, 0.2),
    ("issuer_final = 'unknown'", 0.4, 0.1),
    ("issuer_final = 'extracted_but_unverified'", 0.25, 0.1),
    ("issuer_final = 'known_unverified'", 0.15, 0.1),
]
_ROLES = any_of("low", [w for words in C.ROLE_PHRASES.values() for w in words])


# (applies and has the status, status, confidence, severity)
_TERMS: list[tuple[str, str, float | str, str]] = [
    ("prediction <> 'suspicious' AND risk_score < 0.3", "PASS", "confidence", "low"),
    ("coalesce(risk_score, 0) < 0.3", "PASS", 0.6, "low"),  # feature analysis
    ("TRUE", "PASS", 0.6, "low"),  # an empty visual report
    ("NOT (ocr_failed OR extraction_method = 'none') AND text_present", "PASS", "extraction_confidence", "low"),
    ("structure_completeness >= 0.6", "PASS", 0.7, "low"),
    ("primary_type <> 'unknown'", "PASS", 0.6, "low"),
    (_ROLES, "PASS", 0.7, "low"),
    ("recipient_status = 'ok'", "PASS", 0.7, "low"),
    ("issuer_status = 'ok'", "PASS", 0.7, "low"),
    ("date_status = 'ok'", "PASS", 0.7, "low"),
    ("date_status = 'warning'", "FAIL", 0.6, "high"),
    ("course_status = 'ok'", "PASS", 0.7, "low"),
    ("certificate_id_status = 'ok'", "PASS", 0.7, "low"),
    ("certificate_id_status = 'warning'", "FAIL", 0.6, "high"),
    ("marks_ok", "PASS", 0.7, "low"),
    ("NOT marks_ok", "FAIL", 0.6, "high"),
    ("structure_completeness >= 0.6", "PASS", 0.7, "low"),
    ("n_codes > 0", "PASS", 0.6, "low"),
    ("duplicate_type = 'cert_id'", "FAIL", 0.9, "high"),
    ("duplicate_of IS NOT NULL AND duplicate_type <> 'cert_id'", "FAIL", 0.7, "medium"),
]


def _mass(status: str, terms: list[tuple[str, str, float | str, str]] = _TERMS) -> str:
    w = {"low": 1, "medium": 2, "high": 3}
    parts = [f"CASE WHEN {cond} THEN {w[sev]} * round(CAST({conf} AS DECIMAL(10, 4)), 3) ELSE 0 END" for cond, st, conf, sev in terms if st == status]
    return "round(CAST(" + " + ".join(parts) + " AS DOUBLE), 6)"


REGISTERED = "lower(trim(organization)) IN (SELECT lower('University of ' || n_name) FROM nation WHERE n_regionkey IN (0, 1, 2))"

DECISION = f"""checked_v AS (
  SELECT *, CASE WHEN NOT {present('organization')} THEN 'unknown' WHEN {REGISTERED} THEN 'known_unverified' ELSE 'extracted_but_unverified' END AS issuer_final,
         CASE WHEN {present('organization')} AND {REGISTERED} THEN 'VERIFICATION_UNAVAILABLE' ELSE 'ISSUER_UNKNOWN' END AS issuer_verification,
         CASE WHEN n_codes > 0 THEN 'VERIFICATION_UNAVAILABLE' ELSE 'NO_CODE' END AS code_state,
         CASE WHEN risk_score >= 0.5 THEN risk_score ELSE round(1 - risk_score, 4) END AS confidence
  FROM priority_v
),
anomaly_v AS (
  SELECT *, coalesce(({' + '.join(f'CASE WHEN {c} THEN {v} * {w} ELSE 0 END' for c, v, w in _PARTS)})::DOUBLE
                     / nullif(({' + '.join(f'CASE WHEN {c} THEN {w} ELSE 0 END' for c, _, w in _PARTS)})::DOUBLE, 0), 0.0) AS raw_score
  FROM checked_v
),
mass_v AS (
  SELECT *, round(raw_score, 4) AS anomaly_score, CASE WHEN raw_score >= 0.6 THEN 'high' WHEN raw_score >= 0.35 THEN 'moderate' ELSE 'low' END AS anomaly_level,
         {_mass('PASS')} AS positive_mass, {_mass('FAIL')} AS negative_mass,
         {' + '.join(flag(c) for c in ("date_status = 'warning'", "certificate_id_status = 'warning'", 'NOT marks_ok', 'duplicate_of IS NOT NULL'))} AS fail_items,
         prediction = 'suspicious' OR risk_score >= 0.5 AS ml_high
  FROM anomaly_v
),
decision_v AS (
  SELECT *, CASE
      WHEN ocr_failed OR (NOT text_present AND coalesce(candidate_name, '') = '' AND organization = '' AND coalesce(course, '') = '' AND coalesce(issue_date, '') = '') OR ood_status = 'insufficient_information' THEN 'INSUFFICIENT_EVIDENCE'
      WHEN duplicate_type = 'cert_id' THEN 'SUSPICIOUS'
      WHEN negative_mass >= 2 AND negative_mass >= positive_mass THEN 'SUSPICIOUS'
      WHEN ml_high AND negative_mass >= 1.5 THEN 'SUSPICIOUS'
      WHEN ml_high THEN 'REQUIRES_VERIFICATION'
      WHEN n_codes > 0 AND (positive_mass >= 1.5 OR negative_mass >= 1) THEN 'REQUIRES_VERIFICATION'
      WHEN anomaly_level = 'high' AND positive_mass >= 1 THEN 'REQUIRES_VERIFICATION'
      WHEN positive_mass >= 2 AND negative_mass < 1 AND fail_items = 0 AND anomaly_level <> 'high' THEN 'VERIFIED'
      ELSE 'REQUIRES_VERIFICATION' END AS decision
  FROM mass_v
),
decided_v AS (
  SELECT *, round(CASE decision WHEN 'VERIFIED' THEN least(0.95, 0.5 + (positive_mass - negative_mass) * 0.12)
                                WHEN 'SUSPICIOUS' THEN least(0.95, 0.5 + (negative_mass - positive_mass) * 0.12)
                                ELSE greatest(0.4, least(0.85, 0.45 + (negative_mass + positive_mass) * 0.08)) END, 3) AS decision_confidence
  FROM decision_v
)"""


def decision_sql() -> str:
    return review_sql() + ",\n" + DECISION


# --- the decision with the results of outside providers ------------------------

_UNCONFIRMED = "('VERIFICATION_UNAVAILABLE', 'NOT_VERIFIED')"
_PROVIDER_PARTS = [
    *_PARTS[:9], ("edge_alignment < 0.65", 0.6, 0.15), ("duplicated_regions > 0", 0.6, 0.2), ("forensic_severity > 0", "least(1.0, forensic_severity * 0.25)", 0.15),
    *_PARTS[9:], ("tampering_status = 'strong_indicators'", 0.7, 0.2), ("tampering_status = 'possible'", 0.35, 0.15),
]
_PROVIDER_TERMS = [
    *[t for t in _TERMS if t[0] != "TRUE"],
    ("n_visual = 0", "PASS", 0.6, "low"),
    ("n_forensic = 0", "PASS", 0.6, "low"),
    ("tampering_status = 'none_detected'", "PASS", 0.5, "low"),
    ("tampering_status = 'strong_indicators'", "FAIL", 0.75, "high"),
    ("qr_status = 'verified_externally'", "PASS", 0.8, "medium"),
    ("issuer_verification = 'VERIFIED_BY_ISSUER'", "PASS", 0.9, "medium"),
    ("issuer_verification = 'NOT_VERIFIED'", "FAIL", 0.8, "medium"),
    # an answered identifier counts 0.85 with medium severity in place of 0.6 with low
    ("code_state = 'VERIFIED_BY_ISSUER'", "PASS", 0.85, "medium"),
    ("domain_consistency = 'consistent'", "PASS", 0.7, "low"),
    ("domain_consistency = 'inconsistent'", "FAIL", 0.7, "medium"),
]
_PROVIDER_TERMS = [("n_codes > 0 AND code_state <> 'VERIFIED_BY_ISSUER'", *t[1:]) if t[0] == "n_codes > 0" else t for t in _PROVIDER_TERMS]


def _term(value: float | str, weight: float) -> str:
    return f"({value})::DOUBLE * ({weight})::DOUBLE"


def provider_sql(physical: str, registry: str) -> str:
    """The decision over documents with physical signals, printed domains, QR states and issuer answers.

    The anomaly score is rounded from its decimal digits: rounding the double multiplies first and lifts
    0.41874999999999996 to 0.4188. `physical` defines physical_v (counts, severity and tampering status by document), `registry` is a
    table of registry keys `k` and domains `d`.
    """
    return review_sql() + ",\n" + physical + f""",
outside_v AS (
  SELECT r.*, x.n_forensic, x.n_visual, x.forensic_severity, x.edge_alignment, x.duplicated_regions, x.tampering_status, g.k IS NOT NULL AS registered, g.d AS registry_domain,
         CASE r.document_id % 10 WHEN 0 THEN 'VERIFIED_BY_ISSUER' WHEN 1 THEN 'NOT_VERIFIED' END AS answer,
         CASE r.document_id % 12 WHEN 0 THEN 'verified_externally' WHEN 1 THEN 'verification_page_found' WHEN 2 THEN 'invalid_qr' ELSE 'no_qr' END AS qr_status,
         CASE r.document_id % 4 WHEN 0 THEN 'verify.' || lower(replace(regexp_replace(c.issuer, '^.* ', ''), '_', '-')) || '.example.edu' WHEN 1 THEN 'elsewhere.example.net' END AS printed_domain,
         CASE WHEN r.risk_score >= 0.5 THEN r.risk_score ELSE round(1 - r.risk_score, 4) END AS confidence
  FROM priority_v r JOIN physical_v x ON x.document_id = r.document_id JOIN certificates_v c ON c.document_id = r.document_id LEFT JOIN {registry} g ON g.k = lower(trim(r.organization))
),
answered_v AS (
  SELECT *, CASE WHEN NOT {present('organization')} THEN 'ISSUER_UNKNOWN' WHEN answer IS NOT NULL THEN answer WHEN registered THEN 'VERIFICATION_UNAVAILABLE' ELSE 'ISSUER_UNKNOWN' END AS issuer_verification,
         CASE WHEN NOT {present('organization')} OR printed_domain IS NULL THEN 'no_qr' WHEN printed_domain = registry_domain OR ends_with(printed_domain, '.' || registry_domain) THEN 'consistent' ELSE 'inconsistent' END AS domain_consistency
  FROM outside_v
),
checked_v AS (
  SELECT *, CASE WHEN NOT {present('organization')} THEN 'unknown' WHEN issuer_verification = 'VERIFIED_BY_ISSUER' THEN 'externally_verified' WHEN registered THEN 'known_unverified' ELSE 'extracted_but_unverified' END AS issuer_final,
         CASE WHEN n_codes = 0 THEN 'NO_CODE' WHEN issuer_verification IN ('VERIFIED_BY_ISSUER', 'NOT_VERIFIED') THEN issuer_verification ELSE 'VERIFICATION_UNAVAILABLE' END AS code_state
  FROM answered_v
),
anomaly_v AS (
  SELECT *, coalesce(({' + '.join(f'CASE WHEN {c} THEN {_term(v, w)} ELSE 0::DOUBLE END' for c, v, w in _PROVIDER_PARTS)})
                     / nullif(({' + '.join(f'CASE WHEN {c} THEN ({w})::DOUBLE ELSE 0::DOUBLE END' for c, _, w in _PROVIDER_PARTS)}), 0), 0.0) AS raw_score
  FROM checked_v
),
mass_v AS (
  SELECT *, CAST(round(CAST(CAST(raw_score AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) AS anomaly_score, CASE WHEN raw_score >= 0.6 THEN 'high' WHEN raw_score >= 0.35 THEN 'moderate' ELSE 'low' END AS anomaly_level,
         {_mass('PASS', _PROVIDER_TERMS)} AS positive_mass, {_mass('FAIL', _PROVIDER_TERMS)} AS negative_mass,
         {' + '.join(flag(c) for c in ("date_status = 'warning'", "certificate_id_status = 'warning'", 'NOT marks_ok', 'duplicate_of IS NOT NULL', "tampering_status = 'strong_indicators'", "issuer_verification = 'NOT_VERIFIED'", "domain_consistency = 'inconsistent'"))} AS fail_items,
         prediction = 'suspicious' OR risk_score >= 0.5 AS ml_high,
         qr_status = 'verified_externally' OR issuer_verification = 'VERIFIED_BY_ISSUER' OR code_state = 'VERIFIED_BY_ISSUER' AS external,
         code_state IN {_UNCONFIRMED} OR (issuer_verification IN {_UNCONFIRMED} AND code_state <> 'NO_CODE') AS open_check
  FROM anomaly_v
),
rung_v AS (
  SELECT *, CASE
      WHEN ocr_failed OR (NOT text_present AND coalesce(candidate_name, '') = '' AND organization = '' AND coalesce(course, '') = '' AND coalesce(issue_date, '') = '') OR ood_status = 'insufficient_information' THEN 'thin'
      WHEN tampering_status = 'strong_indicators' THEN 'tampering'
      WHEN duplicate_type = 'cert_id' THEN 'same_identifier'
      WHEN external AND (ml_high OR negative_mass >= 1) THEN 'conflict'
      WHEN negative_mass >= 2 AND negative_mass >= positive_mass THEN 'negative'
      WHEN ml_high AND negative_mass >= 1.5 THEN 'model_and_negative'
      WHEN ml_high THEN 'model'
      WHEN open_check AND (positive_mass >= 1.5 OR negative_mass >= 1) THEN 'open_check'
      WHEN positive_mass >= 2 AND negative_mass < 1 AND fail_items = 0 AND anomaly_level <> 'high' THEN 'agreement'
      ELSE 'mixed' END AS rung
  FROM mass_v
),
decided_v AS (
  SELECT *, CASE WHEN rung = 'thin' THEN 'INSUFFICIENT_EVIDENCE' WHEN rung IN ('tampering', 'same_identifier', 'negative', 'model_and_negative') THEN 'SUSPICIOUS'
                 WHEN rung = 'agreement' THEN 'VERIFIED' ELSE 'REQUIRES_VERIFICATION' END AS decision
  FROM rung_v
)"""
