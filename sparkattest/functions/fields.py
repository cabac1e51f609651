"""Identity-field extraction from certificate text as pure column expressions.

Nothing here needs a Python worker: the cascades are regular expressions and
higher-order functions over the array of lines of one document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import contains_any, extract, let, title_kind


# The same dates, with a look ahead that spares ordinary words the full pattern.
DATE_SEARCH = C.DATE_IN_TEXT.replace(r"\b(?:", r"\b(?=\d|[jfmasond][a-z]{2,8}[.,]?\s+\d)(?:", 1)


# What a text in lower case must hold before its search can find anything.
GATES = {
    "cert_id": ["cert-"], "name": ["certif", "awarded", "present", "completed", "thank"], "marks": ["mark", "score", "percent", "obtained", "total"],
    "grade": ["grade"], "label": ["organization", "institution", "university", "college", "institute", "academy"],
    "marker": [" by", "training provider", "instructor"], "course_label": ["course", "program", "subject", "module", "track", "pathway", "area", "speciali", "certification"],
    "course_phrase": ["complet"], "codes": ["verification", "code", "credential", "certificate", "reference", "serial"], "title": ["certificat"],
}


def searched(gate: str, low: Column, text: Column, pattern: str, group: int) -> Column:
    """The first match of a group, '' without one. Texts without a word of the gate are not searched."""
    return F.when(contains_any(low, GATES[gate]), F.regexp_extract(text, pattern, group)).otherwise("")


def line_kinds(low: Column, lines: Column) -> Column:
    """title_kind of every line; lines of a text that holds no title word are not looked at."""
    return F.when(contains_any(low, GATES["title"]), F.transform(lines, title_kind)).otherwise(F.array().cast("array<string>"))


def cert_id(text: Column) -> Column:
    return F.upper(extract(text, C.CERT_ID_IN_TEXT, 0))


def name_after_phrase(text: Column) -> Column:
    return F.trim(extract(text, C.NAME_AFTER_PHRASE, 1))


def looks_organizational(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return (
        F.coalesce(low == "", F.lit(True))
        | contains_any(low, C.NAME_REJECT_WORDS + C.ORG_SUFFIXES + C.COURSE_KEYWORDS)
        | low.startswith("the ") | low.startswith("a ") | low.startswith("an ")
    )


def name_before_verb(text: Column, low: Column) -> Column:
    """Every variant of the verb contains 'completed', so other texts are not searched."""
    name = F.when(low.contains("completed"), extract(text, C.NAME_BEFORE_VERB, 1))
    return let(name, lambda n: F.when(~looks_organizational(n), F.trim(n)))


def bare_name(lines: Column, org_guard: bool = True) -> Column:
    """A line holding only a name: the first all-capitals one, else the first.

    `org_guard` also skips lines that could be an organization heading, which
    rejects most short names; turn it off to find ordinary two-word names.
    """
    trimmed = F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"""^[.,;:()"']+|[.,;:()"']+$""", ""))

    def plausible(x: Column) -> Column:
        low = F.lower(x)
        ok = (
            F.length(x).between(5, 60) & x.rlike(C.NAME_LINE)
            & ~contains_any(low, C.NAME_REJECT_WORDS + C.COURSE_KEYWORDS)
            & (title_kind(x) == "")
        )
        return ok & (organization_line(x) == "") if org_guard else ok

    def choose(found: Column) -> Column:
        capitals = F.filter(
            found,
            lambda x: (x == F.upper(x)) & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 4),
        )
        return F.coalesce(F.try_element_at(capitals, F.lit(1)), F.try_element_at(found, F.lit(1)))

    return let(F.filter(trimmed, plausible), choose)


def clean_issuer(value: Column) -> Column:
    """Cut at a clause, drop a dangling preposition and closing punctuation."""
    head = F.split(value, C.ISSUER_CLAUSE_BREAK, 2)[0]
    head = F.regexp_replace(head, C.ISSUER_DANGLING, "")
    return F.left(F.regexp_replace(head, r"""[ .:;,()"']+$""", ""), F.lit(100))


def generic_issuer(value: Column) -> Column:
    """True for boilerplate that cannot be the name of an organization."""

    def generic(name: Column) -> Column:
        low = F.lower(name)
        return (
            ~F.length(name).between(3, 60)
            | low.isin(C.GENERIC_ISSUERS + C.BARE_ORG_NOUNS)
            | (low.startswith("the") & low.rlike(r"^the[ \t]+[a-z][a-z \t]*\z"))
            | ~name.rlike("[A-Z]")
        )

    return let(F.trim(F.coalesce(value, F.lit(""))), generic)


def holds_date(text: Column) -> Column:
    """A date in the text; every layout has a four-digit year, which is searched first."""
    return text.rlike(r"(?:19|20)\d{2}") & text.rlike(DATE_SEARCH)


def organization_line(line: Column) -> Column:
    """The line as a plausible organization heading, '' otherwise."""

    def heading(head: Column) -> Column:
        ok = (
            F.length(head).between(3, 40)
            & (F.size(F.split(head, r"\s+")) <= 4)
            & ~contains_any(F.lower(head), C.ORG_LINE_REJECT)
            & ~holds_date(head)
            & ~generic_issuer(head)
        )
        return F.when(ok, head).otherwise("")

    return let(F.regexp_replace(F.trim(line), r"""[ .:;,()"']+$""", ""), heading)


def usable_issuer(issuer: Column) -> Column:
    return F.when(~generic_issuer(issuer), issuer)


def issuer_from_keyword_line(lines: Column) -> Column:
    named = F.filter(
        lines,
        lambda x: (F.length(F.trim(x)) > 4) & ~x.contains(",") & let(F.lower(x), lambda low: contains_any(low, C.ORG_WORDS)),
    )
    names = F.filter(F.transform(named, lambda x: clean_issuer(F.trim(x))), lambda x: ~generic_issuer(x))
    return F.try_element_at(names, F.lit(1))


def issuer_from_title_neighbour(lines: Column, kinds: Column) -> Column:
    """Heading right before, else right after, the first fitting title line; only neighbours of title lines are looked at."""

    def around(line: Column, i: Column) -> Column:
        def heading(j: Column) -> Column:
            other = F.when(j >= 0, F.get(lines, j))
            return F.coalesce(organization_line(other), F.lit(""))

        before, after = heading(i - 1), heading(i + 1)
        fits = (F.get(kinds, i) != "") & ~line.contains("&") & ~line.contains(",")
        return F.when(fits, let(before, lambda b: F.when(b != "", b).otherwise(after))).otherwise("")

    found = F.try_element_at(F.filter(F.transform(lines, around), lambda x: x != ""), F.lit(1))
    return F.when(F.exists(kinds, lambda k: k != ""), found)


def issuer(label_issuer: Column, marker_issuer: Column, low: Column, lines: Column, kinds: Column) -> Column:
    """Labeled field, then issuing phrase, then keyword line, then title neighbour."""
    return F.coalesce(
        usable_issuer(label_issuer), usable_issuer(marker_issuer),
        F.when(contains_any(low, C.ORG_WORDS), issuer_from_keyword_line(lines)), issuer_from_title_neighbour(lines, kinds), F.lit(""),
    )


def certificate_title(lines: Column, kinds: Column) -> Column:
    """The first 'certificate' line, else the first 'certification' line."""

    def first(kind: str) -> Column:
        at = F.array_position(kinds, F.lit(kind)).cast("int")
        return F.when(at > 0, F.get(lines, at - 1))

    return F.left(F.trim(F.coalesce(first("certificate"), first("certification"))), F.lit(100))


def date_hit(text: Column) -> Column:
    """The first date of the text as it is written."""
    return F.when(text.rlike(r"(?:19|20)\d{2}"), extract(text, DATE_SEARCH, 0))


def date_iso(hit: Column) -> Column:
    """A written date as YYYY-MM-DD; the calendar is not checked."""

    def whole(part: str) -> str:
        return rf"(?i)^(?:{part})$"

    def group(part: str, g: int) -> Column:
        return F.regexp_extract(hit, whole(part), g)

    months = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])

    def month_number(word: Column) -> Column:
        return F.array_position(months, F.lower(F.left(word, F.lit(3)))).cast("string")

    def iso(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    iso_part, dmy, mfirst, dfirst = (
        C.DATE_ISO_PART, C.DATE_DMY_PART, C.DATE_MONTH_FIRST_PART, C.DATE_DAY_FIRST_PART,
    )
    return (
        F.when(hit.rlike(whole(iso_part)), iso(group(iso_part, 1), group(iso_part, 2), group(iso_part, 3)))
        .when(hit.rlike(whole(dmy)), iso(group(dmy, 3), group(dmy, 2), group(dmy, 1)))
        .when(hit.rlike(whole(mfirst)), iso(group(mfirst, 3), month_number(group(mfirst, 1)), group(mfirst, 2)))
        .when(hit.isNotNull(), iso(group(dfirst, 3), month_number(group(dfirst, 2)), group(dfirst, 1)))
    )


def marks_hit(text: Column) -> Column:
    """The first 'marks x out of y' wording."""
    return extract(text, C.MARKS_IN_TEXT, 0)


def marks(hit: Column) -> tuple[Column, Column]:
    """(obtained, total) of a marks wording."""
    return (
        F.regexp_extract(hit, C.MARKS_IN_TEXT, 1).try_cast("double"),
        F.regexp_extract(hit, C.MARKS_IN_TEXT, 2).try_cast("double"),
    )


def grade(text: Column, strict: bool = False) -> Column:
    """Grade letter. The default pattern also fires inside words such as 'upgraded'."""
    return F.upper(extract(text, C.GRADE_IN_TEXT_STRICT if strict else C.GRADE_IN_TEXT, 1))


def _tidy_course(value: Column) -> Column:
    return F.left(F.regexp_replace(F.trim(value), r"[ \t.:;,]+$", ""), F.lit(120))


def course_phrase(low: Column, text: Column) -> Column:
    return F.coalesce(
        F.when(contains_any(low, GATES["course_label"]), _tidy_course(extract(text, C.COURSE_LABEL, 1))),
        F.when(contains_any(low, GATES["course_phrase"]), _tidy_course(extract(text, C.COURSE_PHRASE, 1))),
    )


def course_keyword(low: Column) -> Column:
    """First listed subject the text mentions, in display case."""
    shown = {w: (w.upper() if len(w) <= 4 else w.title()) for w in C.COURSE_KEYWORDS}
    return F.coalesce(*[F.when(low.contains(w), F.lit(label)) for w, label in shown.items()])


def first_title_line(kinds: Column) -> Column:
    """One-based position of the first title line, 0 without one."""
    ends = [F.array_position(kinds, F.lit(k)) for k in ("certificate", "certification")]
    return F.coalesce(F.least(*[F.when(e > 0, e) for e in ends]), F.lit(0)).cast("int")


def course_above_title(lines: Column, title_at: Column, name: Column, organization: Column) -> Column:
    """Title-cased block directly above the first title line, read upwards."""
    above = F.when(title_at > 1, F.reverse(F.slice(lines, F.lit(1), title_at - 1)))
    low_name, low_org = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(organization, F.lit(""))))

    def stops(text: Column, line: Column) -> Column:
        low, first = F.lower(text), F.left(text, F.lit(1))
        return (
            (F.length(text) > 120) | (first != F.upper(first)) | ~first.rlike(r"\p{L}")
            | low.isin(C.COURSE_STOP_LINES)
            | ((low_name != "") & (low == low_name)) | ((low_org != "") & (low == low_org))
            | (title_kind(text) != "") | text.rlike(r"[.!?]$") | line.rlike(C.LABELED_LINE) | holds_date(text)
        )

    def step(acc: Column, line: Column) -> Column:
        def extend(text: Column) -> Column:
            skip = acc["done"] | (text == "")
            return let(
                ~skip & stops(text, line),
                lambda stop: F.struct(
                    (acc["done"] | stop).alias("done"),
                    F.when(skip | stop, acc["text"]).otherwise(F.trim(F.concat_ws(" ", text, acc["text"]))).alias("text"),
                ),
            )

        return let(F.regexp_replace(F.trim(line), r"""^[.,;:"'()]+|[.,;:"'()]+$""", ""), extend)

    start = F.struct(F.lit(False).alias("done"), F.lit("").alias("text"))
    found = F.aggregate(above, start, step, lambda acc: acc["text"])
    return F.when(F.length(found).between(3, 120), found)


def course_longest_line(lines: Column, name: Column, organization: Column) -> Column:
    """Longest line that is not an identity, title, date or labeled line."""
    low_name, low_org = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(organization, F.lit(""))))
    stripped = F.transform(
        lines,
        lambda x: F.struct(x.alias("raw"), F.regexp_replace(F.trim(x), r"""^[.,;:()"']+|[.,;:()"']+$""", "").alias("text")),
    )

    def keep(s: Column) -> Column:
        low = F.lower(s["text"])
        org_heading = (organization_line(s["text"]) != "") & ~contains_any(low, C.COURSE_KEYWORDS)
        return (
            F.length(s["text"]).between(3, 120)
            & ((low_org == "") | (low != low_org)) & ((low_name == "") | (low != low_name))
            & (title_kind(s["text"]) == "") & ~s["raw"].rlike(C.LABELED_LINE)
            & ~holds_date(s["text"]) & ~(org_heading & (low_org != ""))
        )

    texts = F.transform(F.filter(stripped, keep), lambda s: s["text"])
    # One pass that keeps the first longest: an expression named inside a lambda would be worked out again for every line.
    longest = F.aggregate(texts, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))
    return F.left(longest, F.lit(100))


def verification_codes(text: Column) -> Column:
    """Labeled credential identifiers as array<struct<label, code, kind>>.

    The code is the first token after its label. Labels are found in one scan; a
    label that ends with another label wins over it, as it does in list order. A
    code named by several labels keeps the first label in list order.
    """
    rests: dict[str, list[str]] = {}
    for label in C.CODE_LABELS:
        word, rest = label.split(" ", 1)
        rests.setdefault(word, []).append(rest)
    labels = "|".join(f"{word} (?:{'|'.join(rest)})" for word, rest in rests.items())
    pattern = F.lit(rf"(?i)(?=[euvcrs])({labels})(?=[\s\S]*?({C.CODE_TOKEN}))")
    pairs = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.lower).alias("label"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("code"),
    )

    def naming(*words: str) -> list[str]:
        return [listed for listed in C.CODE_LABELS if any(w in listed for w in words)]

    def described(pair: Column, at: Column) -> Column:
        label, rank = pair["label"], F
        for number, listed in enumerate(C.CODE_LABELS):
            rank = rank.when(label == listed, F.lit(number))
        kind = (
            F.when(label.isin(naming("certificate", "certification", "credential")), "certificate_id")
            .when(label.isin(naming("reference", "serial")), "reference_number").otherwise("issuer_verification_code")
        )
        return F.struct(
            rank.alias("rank"), at.alias("at"), label.alias("label"),
            pair["code"].alias("code"), kind.alias("kind"),
        )

    found = F.array_sort(F.transform(pairs, described))

    def first_per_code(items: Column) -> Column:
        kept = let(
            F.transform(items, lambda s: s["code"]),
            lambda codes: F.filter(items, lambda s, i: ~F.array_contains(F.slice(codes, F.lit(1), i), s["code"])),
        )
        return F.transform(kept, lambda s: F.struct(s["label"].alias("label"), s["code"].alias("code"), s["kind"].alias("kind")))

    return let(found, first_per_code)


def presence_flags(low: Column) -> dict[str, Column]:
    """Plain substring marks; 'timestamp' therefore raises the seal flag too."""
    return {
        "has_signature": contains_any(low, ["signature"]),
        "has_seal": contains_any(low, ["seal", "stamp"]),
        "has_qr": contains_any(low, ["qr", "barcode"]),
        "has_url": contains_any(low, C.LINK_MARKERS),
    }
