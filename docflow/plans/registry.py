"""Named passes and plugins: DataFrame transforms that run in order, each failure kept to itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.diff import snapshot_diff

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class PassReport:
    ran: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    diffs: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class PassManager:
    """Passes in the order they were added, by stage; with ``track`` (id, hash) each pass's changes are kept."""

    passes: list[tuple[str, str, Transform]] = field(default_factory=list)

    def add(self, name: str, run: Transform, stage: str = "default") -> PassManager:
        self.passes.append((name, stage, run))
        return self

    def run(self, df: DataFrame, stage: str | None = None, track: tuple[str, str] | None = None) -> tuple[DataFrame, PassReport]:
        report = PassReport()
        for name, at, run in self.passes:
            if stage is not None and at != stage:
                continue
            try:
                out = run(df)
                _ = out.schema  # a plan that cannot be analysed fails here, before the next pass
            except Exception as error:  # noqa: BLE001  one pass must not stop the others
                report.failed[name] = str(error)
                continue
            if track:
                report.diffs[name] = snapshot_diff(df, out, *track)
            df = out
            report.ran.append(name)
        return df, report


class Registry:
    """Named things with capabilities; the one of highest priority is the best for a capability."""

    def __init__(self):
        self._held: dict[str, tuple[object, frozenset, int]] = {}

    def register(self, name: str, thing: object, capabilities: tuple[str, ...] = (), priority: int = 0) -> None:
        if name in self._held:
            raise ValueError(f"{name} is registered already")
        self._held[name] = (thing, frozenset(capabilities), priority)

    def unregister(self, name: str) -> bool:
        return self._held.pop(name, None) is not None

    def get(self, name: str) -> object:
        return self._held[name][0]

    def best(self, capability: str) -> object | None:
        fit = [(p, n) for n, (_, c, p) in self._held.items() if capability in c]
        return self._held[max(fit, key=lambda x: (x[0], x[1]))[1]][0] if fit else None
