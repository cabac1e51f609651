"""Documents in, auditable decisions out: the whole verification as one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import cert_id_fingerprint, identity_fingerprint
from ..operators.anomaly import with_anomaly
from ..operators.duplicates import prior_duplicates
from ..operators.evidence import ITEM_LIMITS, Provider, degraded_defaults, fuse, with_evidence_items, with_masses
from ..operators.extraction import extract_fields, with_extraction_quality
from ..operators.features import build_features
from ..operators.intelligence import intelligence, with_review, with_text_marks
from ..operators.issuers import assess_issuer, code_state, registry_lookup
from ..session import cut_lineage, keep_methods_compiled


def analyze(
    docs: DataFrame, *, as_of: dt.date, known_issuer: Column | None = None, extracted: bool = False,
    max_year: int = C.MAX_ISSUE_YEAR,
) -> DataFrame:
    """Extraction, quality and all advisory columns; one narrow stage.

    `extracted` skips field extraction for tables that already carry the fields.
    """
    fields = docs if extracted else extract_fields(docs)
    return intelligence(with_extraction_quality(fields), as_of=as_of, known_issuer=known_issuer, max_year=max_year)


def with_issuer_checks(
    df: DataFrame, registry: DataFrame | None, *, domains: str | None = None, response: str | None = None,
    external_enabled: bool = False,
) -> DataFrame:
    """Registry lookup, issuer reconciliation and identifier state."""
    if registry is None:
        known = df.withColumns(
            {"issuer_identified": F.lit(False), "registry_verification_domain": F.lit(None).cast("string")}
        )
    else:
        known = registry_lookup(df, registry)
    assessed = assess_issuer(known, domains=domains, response=response)
    state = code_state(F.col("verification_codes"), F.col("issuer_verification"), external_enabled)
    return assessed.withColumn("code_state", state)


def verify_documents(
    docs: DataFrame, *, as_of: dt.date, seq: str = "document_id", owner: str = "owner",
    known_issuer: Column | None = None, registry: DataFrame | None = None, extracted: bool = False,
    with_items: bool = False, max_year: int = C.MAX_ISSUE_YEAR, domains: str | None = None, response: str | None = None,
    external_enabled: bool = False, providers: Sequence[Provider] = (), limits: dict[str, int] = ITEM_LIMITS,
) -> DataFrame:
    """Scored documents (text, prediction, risk_score, confidence) to decisions.

    Provider results are columns of the documents: qr_status, tampering_status, forensic_anomalies,
    visual_anomalies; `domains` names the printed domains and `response` the classified issuer answer.
    A provider without a column counts as one that found nothing. `providers` declare further
    evidence items over the checked columns; these enter the array and the masses like the others.

    Extraction and text marks run once over the texts and are written without them; the rules
    run on that table, and what a caller does not select is not built. Only the duplicate lookup and an
    oversized registry shuffle. `with_items` also keeps the evidence array; the decision itself needs
    only the two masses.
    """
    keep_methods_compiled(docs.sparkSession)  # the rules are long expressions
    read = with_text_marks(with_extraction_quality(docs if extracted else extract_fields(docs)))
    if "file_fingerprint" not in read.columns:
        read = read.withColumn("file_fingerprint", F.sha2(F.col("text"), 256))
    if known_issuer is not None:  # it may read the text, so it is judged before the cut
        read, known_issuer = read.withColumn("_issuer_known", known_issuer), F.col("_issuer_known")
    # The texts are read once: from here on a table without them, of plain columns, serves every branch.
    compact = cut_lineage(read.drop("text"))
    printed = compact.withColumns(
        {
            "cert_id_fingerprint": cert_id_fingerprint(F.col("cert_id")),
            "identity_fingerprint": identity_fingerprint(
                F.col("candidate_name"), F.col("organization"), F.col("course"), F.col("issue_date")
            ),
        }
    )
    looked = prior_duplicates(printed.withColumn("_doc", F.col(seq)), seq=seq, owner=owner, doc_id="_doc").drop("_doc")
    advised = intelligence(looked, as_of=as_of, known_issuer=known_issuer, max_year=max_year, marked=True)
    reviewed = with_review(
        build_features(advised, mode="runtime", as_of=as_of, known_issuer=known_issuer, max_year=max_year, marked=True)
    )
    checked = with_anomaly(
        with_issuer_checks(reviewed, registry, domains=domains, response=response, external_enabled=external_enabled)
    )
    evidence = with_evidence_items(checked, providers=providers, limits=limits) if with_items else checked
    return degraded_defaults(fuse(with_masses(evidence, providers=providers, limits=limits))).drop("_issuer_known")


def decision_report(decided: DataFrame, by: list[str]) -> DataFrame:
    """Documents and mean decision confidence per decision and group."""
    return decided.groupBy("decision", *by).agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("decision_confidence"), 4).alias("mean_confidence")
    )


def runtime_features(docs: DataFrame, *, as_of: dt.date, known_issuer: Column | None = None) -> DataFrame:
    """The 31 features straight from document text."""
    fields = extract_fields(docs)
    return build_features(
        fields, mode="runtime", as_of=as_of, known_issuer=known_issuer, keep=["document_id"]
    )
