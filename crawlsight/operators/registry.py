"""The rule registry: declarations that compile into one projection per family."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, truncated
from ..schema import ISSUE_COLUMNS


@dataclass(frozen=True)
class Rule:
    """A page rule: who it concerns is the guard's business, what is wrong the predicate's."""

    code: str
    severity: str | Column
    category: str
    when: Column
    evidence: Column | None = None
    metric: Column | None = None
    message: str = ""
    advice: str = ""


@dataclass(frozen=True)
class Family:
    name: str
    rules: tuple[Rule, ...]
    guard: Column | None = None
    evidence_length: int = 140
    #: Arrays of issue structs for rules that find several things on one page.
    many: tuple[Column, ...] = field(default=())
    #: What several rules read, by name: found once for each page, and named ``_f.name`` in the rules.
    facts: dict[str, Column] = field(default_factory=dict)


def _text(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def issue(code: str, severity: str | Column, category: str, evidence: Column | None = None, metric: Column | None = None, message: str = "", advice: str = "", length: int = 140) -> Column:
    return F.struct(
        _text(severity).alias("severity"), F.lit(category).alias("category"), F.lit(code).alias("code"), F.lit(message or code.replace("_", " ")).alias("message"),
        F.lit(advice or f"Review {code.replace('_', ' ')}.").alias("recommendation"),
        truncated(blank(evidence), length).alias("evidence") if evidence is not None else F.lit("").alias("evidence"),
        (metric if metric is not None else F.lit(None)).cast("long").alias("metric"),
    )


def compile_family(pages: DataFrame, family: Family) -> DataFrame:
    """Issues of one family: a filter by its guard, one array of structs, one explode. No shuffle."""
    rows = pages.filter(family.guard) if family.guard is not None else pages
    if family.facts:
        rows = rows.withColumn("_f", F.struct(*[value.alias(name) for name, value in family.facts.items()]))
    found = [F.when(r.when, issue(r.code, r.severity, r.category, r.evidence, r.metric, r.message, r.advice, family.evidence_length)) for r in family.rules]
    parts = []
    if found:
        parts.append(F.filter(F.array(*found), lambda x: x.isNotNull()))
    parts += family.many
    issues = F.concat(*parts) if len(parts) > 1 else parts[0]
    # Outer: what an inner explode calls for, that the array isn't empty, the optimizer would find out by making the array, with all facts, twice.
    out = rows.select(F.col("finalUrl").alias("url"), "pageType", F.explode_outer(issues).alias("i")).filter("i IS NOT NULL").select("url", "pageType", "i.*")
    return out.select(*ISSUE_COLUMNS)


def run(pages: DataFrame, families: Iterable[Family]) -> DataFrame:
    """All families over one page table: a union, so that no projection outgrows generated code."""
    return reduce(DataFrame.unionByName, [compile_family(pages, f) for f in families])
