"""Queries over a table of typed nodes: a builder, and a small text language.

    MATCH kind [WHERE p op v AND ...] [ORDER BY p [DESC]] [LIMIT n] [RETURN p, ...]

The text is parsed on the driver into the same DataFrame plan as the builder
makes. What cannot be parsed is an error, never ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATORS = ("==", "!=", ">=", "<=", ">", "<", "=")


@dataclass
class GraphQuery:
    nodes: DataFrame
    id: str = "id"
    type: str = "node_type"
    kind: str | None = None
    tests: list[tuple[str, str, object]] = field(default_factory=list)
    order: tuple[str, bool] | None = None
    most: int | None = None
    wanted: tuple[str, ...] = ()

    def match(self, kind: str | None = None) -> GraphQuery:
        self.kind = kind
        return self

    def where(self, prop: str, op: str, value: object) -> GraphQuery:
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        self.tests.append((prop, op, value))
        return self

    def order_by(self, prop: str, desc: bool = False) -> GraphQuery:
        self.order = (prop, desc)
        return self

    def limit(self, n: int) -> GraphQuery:
        if n < 0:
            raise ValueError("a limit is 0 or more")
        self.most = n
        return self

    def select(self, *props: str) -> GraphQuery:
        self.wanted = props
        return self

    def matched(self) -> DataFrame:
        """All matching nodes, before order and limit. A missing property satisfies ``!=`` only."""
        out = self.nodes
        if self.kind not in (None, "*"):
            out = out.where(F.col(self.type) == self.kind)
        for prop, op, value in self.tests:
            c, v = F.col(prop) if prop in out.columns else F.lit(None), F.lit(value)
            out = out.where({"==": c == v, "=": c == v, "!=": ~c.eqNullSafe(v), ">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v}[op])
        return out

    def run(self) -> DataFrame:
        """Matching nodes: ascending order puts missing values last, descending first; ties by id."""
        out = self.matched()
        keys = [F.col(self.id)]
        if self.order:
            c = F.col(self.order[0])
            keys.insert(0, c.desc_nulls_first() if self.order[1] else c.asc_nulls_last())
        if self.order or self.most is not None:
            out = out.orderBy(*keys)
        if self.most is not None:
            out = out.limit(self.most)
        have = set(self.nodes.columns)
        return out.select(*(F.col(p) if p in have else F.lit(None).cast("string").alias(p) for p in self.wanted)) if self.wanted else out


_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(-?\d+\.\d+|-?\d+)|([A-Za-z_*][\w.*]*)|(==|!=|>=|<=|>|<|=|,))""")


def parse_query(text: str, nodes: DataFrame, id: str = "id", type: str = "node_type") -> GraphQuery:
    """The query that ``text`` asks of ``nodes``; ValueError for anything outside the grammar."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        string, number, word, sign = m.groups()
        tokens.append(("value", string[1:-1]) if string else ("value", float(number) if "." in number else int(number)) if number else ("word", word) if word else ("sign", sign))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(kind: str, *allowed: str):
        nonlocal place
        k, v = tokens[place]
        if k != kind or (allowed and str(v).upper() not in allowed):
            raise ValueError(f"expected {' or '.join(allowed) or kind}, found {v!r}")
        place += 1
        return v

    is_next = lambda *words: tokens[place][0] == "word" and str(tokens[place][1]).upper() in words
    query = GraphQuery(nodes, id, type)
    take("word", "MATCH")
    query.match(take("word"))
    if is_next("WHERE"):
        take("word", "WHERE")
        while True:
            prop = take("word")
            query.where(prop, take("sign"), take("value"))
            if not is_next("AND"):
                break
            take("word", "AND")
    if is_next("ORDER"):
        take("word", "ORDER"), take("word", "BY")
        prop = take("word")
        desc = is_next("DESC", "ASC") and take("word").upper() == "DESC"
        query.order_by(prop, desc)
    if is_next("LIMIT"):
        take("word", "LIMIT")
        query.limit(int(take("value")))
    if is_next("RETURN"):
        take("word", "RETURN")
        props = [take("word")]
        while tokens[place] == ("sign", ","):
            take("sign")
            props.append(take("word"))
        query.select(*props)
    take("end")
    return query


def having(nodes: DataFrame, **properties) -> DataFrame:
    """Nodes whose properties have these values; a value of None asks for null."""
    for name, value in properties.items():
        nodes = nodes.where(F.col(name).eqNullSafe(F.lit(value)))
    return nodes


def in_range(nodes: DataFrame, prop: str, lo, hi) -> DataFrame:
    return nodes.where(F.col(prop).between(lo, hi))


def nearest(nodes: DataFrame, prop: str, value: float, k: int, id: str = "id") -> DataFrame:
    """The ``k`` nodes nearest to ``value``, ties by id (a top-k, never a full sort)."""
    return nodes.where(F.col(prop).isNotNull()).withColumn("distance", F.abs(F.col(prop) - F.lit(value))).orderBy("distance", id).limit(k)


def type_counts(nodes: DataFrame, type: str = "node_type") -> DataFrame:
    return nodes.groupBy(type).agg(F.count("*").alias("n"))


def index_stats(nodes: DataFrame, props: list[str]) -> DataFrame:
    """Rows (prop, size, distinct_values): how many nodes have each property, and how many values it has."""
    wide = nodes.agg(*(F.struct(F.lit(p).alias("prop"), F.count(p).alias("size"), F.countDistinct(p).alias("distinct_values")).alias(p) for p in props))
    return wide.select(F.explode(F.array(*props)).alias("s")).select("s.*")


def violations(nodes: DataFrame, required: dict[str, list[str]], type: str = "node_type", id: str = "id") -> DataFrame:
    """Rows (id, missing) for nodes that lack a property that their type requires."""
    rules = F.lit(None).cast("array<string>")
    for kind, props in required.items():
        missing = F.filter(F.array(*(F.when(F.col(p).isNull(), F.lit(p)) for p in props)), lambda x: x.isNotNull())
        rules = F.when(F.col(type) == kind, missing).otherwise(rules)
    return nodes.select(F.col(id), rules.alias("missing")).where(F.size("missing") > 0)


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "out", relation: str | None = None) -> DataFrame:
    """Distinct (id, neighbor) one step away, along, against or in both directions."""
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return both.join(ids.select("id").distinct(), "id").distinct()
