"""What sites may disclose."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# The names by which sites set their rules in the environment.
MIN_ROWS = "SUMMARY_MINIMUM_ROWS"
PRIVACY_THRESHOLD = "SUMMARY_PRIVACY_THRESHOLD"
ALLOWED_COLUMNS = "SUMMARY_ALLOWED_COLUMNS"
DISALLOWED_COLUMNS = "SUMMARY_DISALLOWED_COLUMNS"
ALLOW = "SUMMARY_ALLOW_"  # and a metric in upper case
TTEST_MIN_ROWS = "T_TEST_MINIMUM_NUMBER_OF_RECORDS"
FISHER_MIN_ROWS = "FISHER_MINIMUM_NUMBER_OF_RECORDS"

METRICS = ("min", "max", "count", "sum", "missing", "variance", "counts_unique_values", "num_complete_rows")


@dataclass(frozen=True)
class Policy:
    """min_rows: rows, and non-null values of each column, that a site needs to take part in a summary.
    privacy_threshold: a categorical column is masked at a site if one of its values is rarer there.
    allowed_columns, disallowed_columns: both apply where both are set.
    hidden: METRICS that are not shared.
    ttest_min_rows, fisher_min_rows: a site needs more rows than this.
    """

    min_rows: int = 5
    privacy_threshold: int = 5
    allowed_columns: tuple[str, ...] | None = None
    disallowed_columns: tuple[str, ...] = ()
    hidden: frozenset[str] = field(default_factory=frozenset)
    ttest_min_rows: int = 3
    fisher_min_rows: int = 3

    def shows(self, metric: str) -> bool:
        return metric not in self.hidden

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Policy:
        """Environment variables as sites set them; column lists are split at commas and not trimmed."""
        env = os.environ if env is None else env

        def columns(name: str) -> tuple[str, ...] | None:
            return tuple(env[name].split(",")) if env.get(name) else None

        def number(name: str, default: int) -> int:
            try:
                return int(env.get(name) or default)
            except ValueError as e:
                raise ValueError(f"{name} is not a whole number: {env[name]!r}") from e

        off = {"false", "0", "no", "n", "f", "off"}
        hidden = {m for m in METRICS if str(env.get(ALLOW + m.upper(), "true")).strip().lower() in off}
        return cls(
            min_rows=number(MIN_ROWS, 5),
            privacy_threshold=number(PRIVACY_THRESHOLD, 5),
            allowed_columns=columns(ALLOWED_COLUMNS),
            disallowed_columns=columns(DISALLOWED_COLUMNS) or (),
            hidden=frozenset(hidden),
            ttest_min_rows=number(TTEST_MIN_ROWS, 3),
            fisher_min_rows=number(FISHER_MIN_ROWS, 3),
        )
