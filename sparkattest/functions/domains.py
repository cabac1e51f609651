"""URL payloads and issuer domains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import contains_any


def payload_parts(payload: Column) -> dict[str, Column]:
    """Scheme, domain, top-level domain, path and page flags of a decoded payload."""
    absolute = payload.contains("://")
    web = absolute & payload.rlike(r"^(?i:https?)://")
    bare = ~absolute & F.trim(payload).rlike(C.BARE_DOMAIN)
    bare_host = F.regexp_extract(F.trim(payload), C.BARE_DOMAIN, 1)
    host = F.lower(F.when(web, F.regexp_extract(payload, r"://([^/?#]*)", 1)).when(bare, bare_host))
    domain = F.when(host != "", host)
    rest = F.substr(F.trim(payload), F.length(bare_host) + 1)
    path = F.when(web, F.regexp_extract(payload, r"://[^/?#]*([^?#]*)", 1)).when(
        bare & rest.rlike(r"^[/?#]"), rest
    )
    scheme = F.when(web, F.lower(F.regexp_extract(payload, r"^([A-Za-z]+)://", 1))).when(bare, "http")
    page = contains_any(F.lower(path), C.VERIFICATION_PATH_WORDS) | contains_any(
        domain, C.VERIFICATION_DOMAIN_WORDS
    )
    return {
        "is_url": F.coalesce(web | bare, F.lit(False)),
        "scheme": scheme,
        "is_https": F.coalesce(scheme == "https", F.lit(False)),
        "domain": domain,
        "tld": F.when(domain.contains("."), F.substring_index(domain, ".", -1)),
        "path": path,
        "verification_page": page,
    }


def candidate_domains(issuer: Column) -> Column:
    """Plausible web domains of an issuer name; consistency evidence only."""
    name = F.lower(F.trim(F.coalesce(issuer, F.lit(""))))
    for suffix in C.ORG_SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    tokens = F.filter(F.split(name, "[^a-z0-9]+"), lambda t: t != "")
    meaningful = F.filter(tokens, lambda t: ~t.isin(C.ISSUER_FILLER_WORDS))
    empty = F.array().cast("array<string>")

    def with_tlds(parts: Column, at_least: int) -> Column:
        head = F.array_join(parts, ".")
        return F.when(F.size(parts) >= at_least, F.array(*[F.concat(head, F.lit(t)) for t in C.CANDIDATE_TLDS])).otherwise(empty)

    return F.concat(with_tlds(tokens, 2), with_tlds(meaningful, 1))


def domain_matches(domain: Column, expected: Column) -> Column:
    """Equal, or either one is a dot-separated suffix of the other."""
    return F.exists(
        expected,
        lambda e: (domain == e) | domain.endswith(F.concat(F.lit("."), e)) | e.endswith(F.concat(F.lit("."), domain)),
    )


def domain_consistency(domains: Column, expected: Column) -> Column:
    """'consistent', 'inconsistent' or 'no_qr' for the domains printed on a document."""
    any_match = F.exists(domains, lambda d: domain_matches(d, expected))
    return (
        F.when(F.coalesce(F.size(domains), F.lit(0)) <= 0, "no_qr")
        .when(any_match, "consistent").otherwise("inconsistent")
    )
