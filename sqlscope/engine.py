"""audit(): a query log, an index catalogue and the optional event tables in, findings and reports out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame

from sqlscope.config import AuditConfig
from sqlscope.operators import catalog_rules, explain, features, group_rules, predicate_rules, reports
from sqlscope.schema import ISSUE


@dataclass(frozen=True)
class Context:
    """What a rule sees: log (normalized, tested), features per pattern, catalogue, events and settings."""

    log: DataFrame
    features: DataFrame
    catalog: DataFrame
    config: AuditConfig
    lazy: DataFrame | None = None
    explicit: DataFrame | None = None
    count_baseline: DataFrame | None = None
    return_types: DataFrame | None = None
    plans: DataFrame | None = None
    where: DataFrame | None = None


Rule = Callable[[Context], DataFrame]
#: Rules of users: register with add_rule().
EXTRA: dict[str, Rule] = {}


def add_rule(name: str, rule: Rule) -> None:
    """A rule returns rows of the columns in schema.ISSUE."""
    EXTRA[name] = rule


@dataclass(frozen=True)
class AuditResult:
    issues: DataFrame
    summary: DataFrame
    counts: DataFrame
    log: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what the rules share, once results are read."""
        for x in self.held:
            x.unpersist()

    def failures(self, config: AuditConfig) -> DataFrame:
        return reports.failures(self.issues, config)


def context(log: DataFrame, catalog: DataFrame, config: AuditConfig | None = None, **more: DataFrame | None) -> Context:
    config = config or AuditConfig()
    kept = features.normalized(features.tested(features.suppressed(log, config), config))
    return Context(kept, features.build(log, catalog, config), catalog, config, **more)


def run_rules(c: Context) -> DataFrame:
    """All findings before suppression. Rules of shape P cost one pass together; the others reuse the features."""
    parts = [predicate_rules.evaluate(c.features, c.config), predicate_rules.conversions(c.features)]
    parts += catalog_rules.evaluate(c.features, c.catalog, c.config, c.where)
    parts += [f(c.features, c.config) for f in (group_rules.n_plus_one_suspect, group_rules.repeated_insert, group_rules.slow_query, group_rules.mergeable)]
    parts += [f(c.log, c.config) for f in (group_rules.collection_reinsert, group_rules.derived_delete)]
    if "duplicate-query" not in c.config.disabled:
        parts.append(group_rules.duplicate_query(c.log, c.config))
    if c.lazy is not None:
        parts.append(group_rules.lazy_n_plus_one(c.lazy, c.config))
        if c.explicit is not None:
            parts.append(group_rules.find_by_id(c.explicit, c.lazy, c.log))
    if c.count_baseline is not None:
        parts.append(group_rules.count_regression(group_rules.statement_counts(c.log), c.count_baseline))
    if c.plans is not None:
        parts.append(explain.findings(c.features, c.plans))
    parts += [rule(c) for rule in EXTRA.values()]
    found = reduce(lambda a, b: a.unionByName(b), [p.select(*ISSUE) for p in parts])
    return reports.by_return_type(found, c.return_types).select(*ISSUE)


def audit(log: DataFrame, catalog: DataFrame, config: AuditConfig | None = None, baseline: DataFrame | None = None, **more: DataFrame | None) -> AuditResult:
    """Findings with buckets, a summary row per test, and statement counts. What rules share is computed once and held until release()."""
    config = config or AuditConfig()
    c = context(log, catalog, config, **more)
    c = replace(c, features=c.features.persist(), catalog=catalog.persist())
    c = replace(c, where=catalog_rules.known_where(c.features, c.catalog).persist())
    found = run_rules(c)
    if not config.enabled:
        found = found.filter("false")
    found = reports.override(reports.suppress(found, config), config)
    issues = reports.classify(reports.acknowledge(found, baseline))
    whole = features.normalized(features.suppressed(log, config))
    return AuditResult(issues, reports.summary(whole), reports.statement_counts(whole), whole, (c.features, c.where, c.catalog))
