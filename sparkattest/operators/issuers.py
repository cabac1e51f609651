"""Issuer registry lookups, domain consistency and issuer-side check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import candidate_domains, domain_consistency
from ..functions.text import mask_identifier, present
from .findings import yes

# A registry is a curated list; refuse to broadcast anything larger than this.
MAX_REGISTRY_NAMES = 1_000_000


def registry_names(registry: DataFrame) -> DataFrame:
    """One row per reachable name: the issuer's own name and each alias, lower-cased."""
    names = F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    keyed = registry.withColumn("_name", names).withColumn("registry_key", F.lower(F.trim("_name"))).drop("_name")
    return keyed.dropDuplicates(["registry_key"])


def registry_lookup(
    docs: DataFrame, registry: DataFrame, issuer: str = "organization", *,
    max_broadcast: int = MAX_REGISTRY_NAMES,
) -> DataFrame:
    """Left join to the registry by name or alias.

    The registry is counted up to `max_broadcast`; a larger one is joined by
    shuffle instead of broadcast.
    """
    names = registry_names(registry)
    payload = [F.col(c).alias(f"registry_{c}") for c in names.columns if c not in ("registry_key", "aliases")]
    slim = names.select("registry_key", *payload)
    small = slim.limit(max_broadcast + 1).count() <= max_broadcast
    keyed = docs.withColumn("registry_key", F.lower(F.trim(F.col(issuer))))
    joined = keyed.join(F.broadcast(slim) if small else slim, "registry_key", "left")
    return joined.withColumn("issuer_identified", F.col("registry_name").isNotNull()).drop("registry_key")


def profile_result() -> Column:
    """Offline answer: unknown issuer, else verification unavailable."""
    return F.when(
        ~present(F.col("organization")) | ~F.col("issuer_identified"), "ISSUER_UNKNOWN"
    ).otherwise("VERIFICATION_UNAVAILABLE")


def response_result(status_code: Column, body: Column, success_marker: Column, negative_marker: Column) -> Column:
    """Classify a fetched issuer response by its documented markers."""
    low = F.lower(F.coalesce(body, F.lit("")))
    ok = F.lower(F.trim(F.coalesce(success_marker, F.lit(""))))
    bad = F.lower(F.trim(F.coalesce(negative_marker, F.lit(""))))
    answered = yes(status_code.between(200, 299))
    return (
        F.when(answered & (ok != "") & low.contains(ok), "VERIFIED_BY_ISSUER")
        .when(answered & (bad != "") & low.contains(bad), "NOT_VERIFIED")
        .otherwise("VERIFICATION_UNAVAILABLE")
    )


def first_conclusive(*results: Column) -> Column:
    """Ordered verifiers: the first that is neither NULL, skipped nor unavailable."""
    open_states = ("skipped", "unavailable")
    return F.coalesce(*[F.when(~r.isin(*open_states), r) for r in results])


def masked_identifiers(codes: Column) -> Column:
    return F.filter(F.transform(codes, lambda c: mask_identifier(c["code"])), lambda m: m != "")


def assess_issuer(df: DataFrame, *, domains: str | None = None, response: str | None = None) -> DataFrame:
    """Final issuer status, state and result after reconciliation.

    Needs `organization`, `issuer_identified`, `registry_verification_domain`.
    `domains` names an array column of printed domains, `response` a column with
    the classified endpoint answer (NULL when no endpoint is configured). Only an
    endpoint answer can verify; a matching domain alone never does.
    """
    printed = F.col(domains) if domains else F.array().cast("array<string>")
    expected = F.array_compact(
        F.array_union(F.array("registry_verification_domain"), candidate_domains(F.col("organization")))
    )
    named = present(F.col("organization"))
    authority = F.coalesce(F.col(response) if response else F.lit(None).cast("string"), profile_result())
    staged = df.withColumns(
        {
            "candidate_domains": candidate_domains(F.col("organization")),
            "domain_consistency": F.when(named, domain_consistency(printed, expected)).otherwise("no_qr"),
            "issuer_verification": F.when(named, authority).otherwise("ISSUER_UNKNOWN"),
        }
    )
    known, match = F.col("issuer_identified"), F.col("domain_consistency")
    verified = F.col("issuer_verification") == "VERIFIED_BY_ISSUER"
    rejected = F.col("issuer_verification") == "NOT_VERIFIED"
    plain = F.when(known, "known_unverified").otherwise("extracted_but_unverified")
    return staged.withColumns(
        {
            "issuer_status_final": F.when(~named, "unknown").when(verified, "externally_verified").otherwise(plain),
            "issuer_state": F.when(~named, "ISSUER_UNKNOWN")
            .when(verified, "ISSUER_VERIFIED")
            .when(rejected | known | match.isin("consistent", "inconsistent"), "COULD_NOT_BE_VERIFIED")
            .otherwise("ISSUER_UNKNOWN"),
            "verification_result": F.when(~named, "ISSUER_UNKNOWN")
            .when(verified, "VERIFIED_BY_ISSUER").when(rejected, "NOT_VERIFIED")
            .when((match == "consistent") | known, "VERIFICATION_UNAVAILABLE")
            .when(match == "inconsistent", "NOT_VERIFIED").otherwise("ISSUER_UNKNOWN"),
        }
    )


def code_state(codes: Column, issuer_result: Column, external_enabled: bool = False) -> Column:
    """State of a document's identifiers given the issuer-side result."""
    none = F.coalesce(F.size(codes), F.lit(0)) <= 0
    if not external_enabled:
        return F.when(none, "NO_CODE").otherwise("VERIFICATION_UNAVAILABLE")
    return (
        F.when(none, "NO_CODE")
        .when(issuer_result.isin("VERIFIED_BY_ISSUER", "NOT_VERIFIED"), issuer_result)
        .otherwise("VERIFICATION_UNAVAILABLE")
    )
