"""What a document says about itself: roles, level, verification wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import contains_any


def role_flags(low: Column) -> dict[str, Column]:
    return {role: contains_any(low, words) for role, words in C.ROLE_PHRASES.items()}


def role_snippets(text: Column, low: Column, role: str, limit: int = C.SNIPPETS_PER_ROLE) -> Column:
    """Up to `limit` surrounding fragments of the phrases of one role."""

    def fragment(phrase: str) -> Column:
        at = F.instr(low, phrase)
        start = F.greatest(at - C.SNIPPET_RADIUS, F.lit(1))
        end = at + len(phrase) + C.SNIPPET_RADIUS
        return F.when(at > 0, F.trim(F.translate(F.substring(text, start, end - start), "\n", " ")))

    return F.slice(F.array_compact(F.array(*[fragment(p) for p in C.ROLE_PHRASES[role]])), 1, limit)


def statements(text: Column, low: Column) -> Column:
    """All snippets as array<struct<role, phrase>> in role order."""

    def of(role: str) -> Column:
        return F.transform(
            role_snippets(text, low, role), lambda s: F.struct(F.lit(role).alias("role"), s.alias("phrase"))
        )

    return reduce(lambda a, b: F.concat(a, b), [of(role) for role in C.ROLE_PHRASES])


def credential_level(low: Column) -> Column:
    rule = F
    for level, pattern in C.LEVEL_PATTERNS:
        rule = rule.when(low.rlike(pattern), F.lit(level))
    return rule.otherwise(F.lit("unknown"))


def verification_present(low: Column) -> Column:
    return contains_any(low, C.VERIFICATION_PHRASES)


def credential_statement_present(low: Column) -> Column:
    return contains_any(low, [w for words in C.ROLE_PHRASES.values() for w in words])


def role_count(low: Column) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in role_flags(low).values()])
