"""Roles of the columns of a feature table."""

from __future__ import annotations

from dataclasses import dataclass, replace

BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"


@dataclass(frozen=True)
class TableSpec:
    """Which column is the row key, the target, and the role of every feature.

    Spark rows have no position, so every rule that depends on row order uses `key`.
    """

    key: str
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    target: str | None = None
    task: str = BINARY

    def __post_init__(self):
        overlap = set(self.categorical) & set(self.numeric)
        if overlap:
            raise ValueError(f"columns with two roles: {sorted(overlap)}")
        if self.task not in (BINARY, MULTICLASS, REGRESSION):
            raise ValueError(f"unknown task {self.task!r}")

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numeric]

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.features, *([self.target] if self.target else [])]

    def check(self, columns) -> None:
        """Reject a table whose columns do not cover the declared roles."""
        missing = set(self.columns) - set(columns)
        if missing:
            raise ValueError(f"columns without data: {sorted(missing)}")

    def with_roles(self, **changes) -> "TableSpec":
        return replace(self, **changes)
