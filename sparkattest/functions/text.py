"""Text predicates, normalization, masking and fingerprints as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def clean(col: Column) -> Column:
    """Blank strings become NULL; the one missing-value rule used everywhere."""
    trimmed = F.trim(col)
    return F.when(trimmed != "", trimmed)


def present(col: Column) -> Column:
    """True when a value is neither NULL nor blank; never NULL itself."""
    return F.coalesce(F.trim(col.cast("string")) != "", F.lit(False))


def contains_any(low: Column, words: list[str]) -> Column:
    """True when any literal word occurs; short-circuits inside generated code.

    A word that holds another one of the list is not searched: where it occurs, the shorter one does too.
    """
    least = [w for w in dict.fromkeys(words) if not any(other != w and other in w for other in words)]
    hit = reduce(lambda a, b: a | b, [low.contains(w) for w in least])
    return F.coalesce(hit, F.lit(False))


def count_contained(low: Column, words: list[str]) -> Column:
    """Number of distinct words that occur at least once."""
    total = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])
    return F.coalesce(total, F.lit(0))


def word_alternation(words: list[str]) -> str:
    """A whole-word regular expression over literal words."""
    return r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def extract(text: Column, pattern: str, group: int) -> Column:
    """First match of a capture group, NULL when nothing (or only blanks) matched."""
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit)


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value computed once.

    Inside a lambda each mention of an expression is evaluated again; binding it
    through a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def title_kind(line: Column) -> Column:
    """'certificate', 'certification' or '' for one line of text."""

    def kind(low: Column) -> Column:
        return (
            F.when((low == "") | (F.length(low) > 60), "")
            .when(low.startswith("certificate") | low.endswith("certificate"), "certificate")
            .when(low.startswith("certification") | low.endswith("certification"), "certification")
            .otherwise("")
        )

    return let(F.lower(F.trim(line)), kind)


def suspicious_keyword_count(text: Column) -> Column:
    return count_contained(F.lower(text), C.SUSPICIOUS_KEYWORDS)


def suspicious_url_present(text: Column) -> Column:
    return contains_any(F.lower(text), C.URL_MARKERS)


def title_present(text: Column) -> Column:
    return contains_any(F.lower(text), C.TITLE_WORDS)


def recipient_phrase_present(text: Column) -> Column:
    return contains_any(F.lower(text), C.RECIPIENT_PHRASES)


def type_flag_columns(low_text: Column, low_issuer: Column) -> dict[str, Column]:
    """The independent certificate-type flags over lower-cased text and issuer."""

    def either(words: list[str]) -> Column:
        return contains_any(low_text, words) | contains_any(low_issuer, words)

    academic_text = contains_any(low_text, C.ACADEMIC_WORDS + C.ACADEMIC_CONTEXT_WORDS)
    academic = academic_text | contains_any(low_issuer, C.ACADEMIC_WORDS)
    technical = (
        ~academic_text
        & contains_any(low_text, C.TECHNICAL_CONTEXT_WORDS)
        & F.coalesce(low_text.rlike(word_alternation(C.TECHNICAL_DOMAIN_WORDS)), F.lit(False))
    )
    flags = {
        "academic": academic,
        "completion": either(C.COMPLETION_WORDS),
        "training": either(C.TRAINING_WORDS),
        "technical": technical,
        "workshop": either(C.WORKSHOP_WORDS),
        "online": contains_any(low_text, C.ONLINE_WORDS),
    }
    return {name: flag.cast("int") for name, flag in flags.items()}


def primary_type(flags: dict[str, Column]) -> Column:
    """First raised flag in precedence order, 'unknown' when none is."""
    rule = F
    for name in C.TYPE_PRECEDENCE:
        rule = rule.when(flags[name] > 0, F.lit(name))
    return rule.otherwise(F.lit("unknown"))


def mask_identifier(col: Column) -> Column:
    """Keep four leading and two or three trailing characters, star the rest."""
    s = F.trim(col.cast("string"))
    n = F.length(s)
    tail = F.when(n > 7, 3).otherwise(2)
    stars = F.greatest(F.lit(4), n - 4 - tail)
    return (
        F.when(s.isNull(), F.lit(""))
        .when(n <= 4, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.left(s, F.lit(4)), F.repeat(F.lit("*"), stars), F.right(s, tail)))
    )


JSON_DEPTH = 8


def _json_container(depth: int) -> str:
    """A balanced JSON object or array of at most `depth` levels; braces inside strings do not count."""
    text = r'"(?:[^"\\]|\\.)*"'
    inner = rf'(?:[^"\[\]{{}}]|{text})*+'
    for _ in range(depth - 1):
        inner = rf'(?:[^"\[\]{{}}]|{text}|[\[{{]{inner}[\]}}])*+'
    return rf"[\[{{]{inner}[\]}}]"


def mask_json_values(json: Column, keys: list[str] | None = None) -> Column:
    """Mask whatever lies under sensitive keys, at any depth: scalars in part, objects and arrays whole.

    Finds every `"key": value` fragment and replaces it with its masked form; text
    without a sensitive key is returned as it is. Should a sensitive key still hold an object or array
    (broken JSON, or more than JSON_DEPTH levels), the whole text is withheld.
    """
    names = "|".join(re.escape(k) for k in (keys or C.SENSITIVE_KEYS))
    head = rf'"(?:{names})"\s*:\s*'
    value = rf'("(?:[^"\\]|\\.)*"|{_json_container(JSON_DEPTH)}|-?[0-9][0-9.eE+-]*|true|false)'
    found = F.array_distinct(F.regexp_extract_all(json, F.lit(head + value), F.lit(0)))
    container = F.lit(rf"^{head}[\[{{]")

    def masked(fragment: Column) -> Column:
        raw = F.regexp_extract(fragment, rf"^{head}([\s\S]*)$", 1)
        inner = F.regexp_replace(raw, r'^"([\s\S]*)"$', "$1")
        label = F.regexp_extract(fragment, rf"^({head})", 1)
        scalar = F.replace(mask_identifier(inner), F.lit('"'), F.lit("'"))
        return F.concat(label, F.lit('"'), F.when(F.regexp(fragment, container), "****").otherwise(scalar), F.lit('"'))

    # longest first: a fragment may lie inside another
    ordered = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    out = F.aggregate(ordered, json, lambda acc, m: F.replace(acc, m, masked(m)))
    return F.when(out.rlike(rf"{head}[\[{{]"), F.lit('{"withheld": "****"}')).otherwise(out)


def safe_text(col: Column, limit: int = 500) -> Column:
    """Trim, drop blanks, shorten to `limit` characters ending in an ellipsis."""
    s = clean(col)
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 1)), F.lit("…"))).otherwise(s)


def truncate_error(col: Column, limit: int = 200) -> Column:
    return F.coalesce(safe_text(col, limit), F.lit("unknown error"))


def safe_stem(filename: Column) -> Column:
    """File name without its last extension, unsafe characters as underscores."""
    name = F.regexp_replace(filename, r"^.*/", "")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    safe = F.left(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), F.lit(80))
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit("unnamed")).otherwise(safe)


def normalize_text(col: Column) -> Column:
    """Collapse white space and lower-case; NULL becomes the empty string."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(col.cast("string"), F.lit(""))), r"\s+", " "))


def normalize_issuer(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", "")


def file_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def cert_id_fingerprint(cert_id: Column) -> Column:
    return F.when(present(cert_id), F.regexp_replace(F.upper(cert_id), "[^A-Z0-9-]", ""))


def identity_fingerprint(name: Column, issuer: Column, course: Column, issue_date: Column) -> Column:
    """SHA-256 of recipient, issuer, course and date; NULL unless all four exist."""
    parts = [normalize_text(c) for c in (name, issuer, course, issue_date)]
    complete = reduce(lambda a, b: a & b, [p != "" for p in parts])
    return F.when(complete, F.sha2(F.concat_ws("|", *parts), 256))


def template_key(issuer: Column, certificate_type: Column) -> Column:
    """Group key of documents printed from one issuer and type template."""
    return F.sha1(
        F.concat_ws(
            ":", F.lit(C.TEMPLATE_SALT), normalize_issuer(issuer),
            F.coalesce(certificate_type, F.lit("")),
        )
    )


def code_well_formed(code: Column) -> Column:
    s = F.trim(F.coalesce(code, F.lit("")))
    return reduce(lambda a, b: a | b, [s.rlike(p) for p in C.CODE_SHAPES])
