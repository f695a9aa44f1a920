"""A graph of DataFrame operators: order, selective runs, cached results, what an edit affects."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop_cut


@dataclass
class Operator:
    """``run`` takes the context (name -> DataFrame) and gives the DataFrame of this name."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    version: str = "1"


@dataclass
class OperatorGraph:
    operators: dict[str, Operator] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)

    def add(self, name: str, run: Callable, *after: str, version: str = "1") -> OperatorGraph:
        if name in self.operators:
            raise ValueError(f"{name} is there already")
        self.operators[name] = Operator(name, run, after, version)
        return self

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """Names so that each comes after what it needs, alphabetical among free ones; ValueError for a cycle or an unknown name."""
        wanted = set(self.operators if names is None else names)
        for n in wanted | {d for o in self.operators.values() for d in o.after}:
            if n not in self.operators:
                raise ValueError(f"no operator {n}")
        out: list[str] = []
        while len(out) < len(wanted):
            free = sorted(n for n in wanted - set(out) if all(d in out or d not in wanted for d in self.operators[n].after))
            if not free:
                raise ValueError(f"a cycle among {', '.join(sorted(wanted - set(out)))}")
            out.append(free[0])
        return out

    def dependents(self, name: str) -> set[str]:
        """What needs ``name``, directly or not."""
        out: set[str] = set()
        while True:
            more = {o.name for o in self.operators.values() if set(o.after) & (out | {name})} - out
            if not more:
                return out
            out |= more

    def run(self, context: dict[str, DataFrame], names: Iterable[str] | None = None, cache: ResultCache | None = None) -> dict[str, DataFrame]:
        """Build the plans in order (lazily; a cache writes its results). One trace row per operator."""
        context = dict(context)
        for name in self.order(names):
            op, began = self.operators[name], time.time()
            hit = False
            if cache is not None:
                key = cache.key(op, context)
                found = cache.get(key)
                hit = found is not None
                context[name] = found if hit else cache.put(key, op.run(context))
            else:
                context[name] = op.run(context)
            self.trace.append({"operator": name, "cached": hit, "seconds": round(time.time() - began, 3)})
        return context

    def affected(self, changed: Iterable[str]) -> list[str]:
        """Operators to run again when the outputs of ``changed`` did change, in order."""
        names = set(changed)
        for n in list(names):
            names |= self.dependents(n)
        return self.order(names)


class ResultCache:
    """Results by operator, version, the plans it reads and the files below them, by size and time.

    They are written to the shared folder; the least used goes first, with its
    files. A file that is written anew under its path has another key.
    """

    def __init__(self, spark: SparkSession, most: int = 256):
        self.spark, self.most, self.held = spark, most, {}

    def key(self, op: Operator, context: dict[str, DataFrame]) -> str:
        inputs = {n: [context[n].semanticHash(), self._files(context[n])] for n in sorted(op.after) if n in context}
        return hashlib.sha256(json.dumps([op.name, op.version, inputs], sort_keys=True).encode()).hexdigest()

    def _files(self, df: DataFrame) -> list[tuple[str, int, int]]:
        """(path, size, time) of the files that a plan reads; one entry per file, none of their rows."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        out = []
        for name in sorted(df.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(conf).getFileStatus(path)
            out.append((name, status.getLen(), status.getModificationTime()))
        return out

    def get(self, key: str) -> DataFrame | None:
        found = self.held.pop(key, None)
        if found is not None:
            self.held[key] = found
        return found

    def put(self, key: str, df: DataFrame) -> DataFrame:
        while len(self.held) >= self.most:
            drop_cut(self.held.pop(next(iter(self.held))))
        self.held[key] = cut(df, "result")
        return self.held[key]


#: The stages of a document build and what each needs.
STAGES = (("parse", ()), ("analyze", ("parse",)), ("plan", ("analyze",)), ("translate", ("plan",)), ("review", ("translate",)), ("layout", ("translate",)), ("render", ("layout",)))


def incremental_plan(changes: DataFrame, first: dict[str, str]) -> DataFrame:
    """Rows (stage, n): how many changed ids each stage must do again.

    ``changes`` has (id, change); ``first`` names the first stage that a kind of
    change touches. The stages behind it follow from :data:`STAGES`.
    """
    graph = OperatorGraph()
    for name, after in STAGES:
        graph.add(name, lambda c: None, *after)
    stages = F.array().cast("array<string>")
    for change, stage in first.items():
        stages = F.when(F.col("change") == change, F.array(*map(F.lit, graph.affected([stage])))).otherwise(stages)
    return changes.select("id", F.explode(stages).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def repair_loop(df: DataFrame, detect: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame, DataFrame], DataFrame], most: int = 2) -> tuple[DataFrame, list[int]]:
    """Detect and repair until no issue is left, none is gained, or ``most`` rounds are done; issue counts of each round."""
    counts = [detect(df).count()]
    for _ in range(most):
        if not counts[-1]:
            break
        fixed = cut(repair(df, detect(df)), "repair")
        left = detect(fixed).count()
        if left >= counts[-1]:
            break
        df = fixed
        counts.append(left)
    return df, counts
