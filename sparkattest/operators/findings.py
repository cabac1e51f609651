"""Small builders for per-document lists of findings.

A finding is declared once as a `Rule`; it can be rendered as an array column
for people or as plain boolean and count columns for aggregation. The second
form stays inside generated code and builds no strings.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING_TYPE = "array<struct<key:string,label:string,status:string,severity:string,detail:string>>"


@dataclass
class Rule:
    key: str
    label: str
    severity: str
    when: Column
    detail: Column
    status: str = "attention"


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def as_array(rules: list[Rule]) -> Column:
    items = [
        F.when(
            yes(r.when),
            F.struct(
                F.lit(r.key).alias("key"), F.lit(r.label).alias("label"),
                F.lit(r.status).alias("status"), F.lit(r.severity).alias("severity"),
                F.coalesce(r.detail.cast("string"), F.lit("")).alias("detail"),
            ),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*items)).cast(FINDING_TYPE)


def count_of(rules: list[Rule], severity: str | None = None) -> Column:
    picked = [yes(r.when).cast("int") for r in rules if severity is None or r.severity == severity]
    return reduce(lambda a, b: a + b, picked, F.lit(0))


def any_rule(rules: list[Rule], keys: list[str]) -> Column:
    """True when a rule with one of the keys holds; any_key without the array."""
    return reduce(lambda a, b: a | b, [yes(r.when) for r in rules if r.key in keys], F.lit(False))


def any_key(findings: Column, keys: list[str]) -> Column:
    return F.exists(findings, lambda f: f["key"].isin(keys))


def severity_count(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["severity"] == severity))


def keys_text(findings: Column) -> Column:
    """Keys in order as one string, handy for reports and comparisons."""
    return F.array_join(F.transform(findings, lambda f: f["key"]), ";")


def percent_text(value: Column) -> Column:
    return F.concat(F.round(value * 100, 0).cast("int").cast("string"), F.lit("%"))
