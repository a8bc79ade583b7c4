"""Settings of an audit. Thresholds are fixed values of the rule catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AuditConfig:
    enabled: bool = True
    n_plus_one: int = 3
    offset_pagination: int = 1000
    or_clause: int = 3
    #: Statements of a test that a capture keeps, where it is given to files.read_log().
    max_queries: int = 10_000
    large_in_list: int = 100
    too_many_joins: int = 5
    excessive_columns: int = 15
    repeated_insert: int = 3
    write_amplification: int = 6
    slow_warn_ms: int = 500
    slow_error_ms: int = 3000
    include_setup: bool = False
    collection_min_inserts: int = 2
    collection_max_where: int = 4
    derived_delete: int = 3
    mergeable: int = 3
    covering_extra: int = 3
    disabled: frozenset[str] = field(default_factory=lambda: frozenset({"duplicate-query"}))
    suppress_queries: tuple[str, ...] = ()
    suppress_issues: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    fail_on: frozenset[str] = field(default_factory=frozenset)
