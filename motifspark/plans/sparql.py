"""A small pattern language: SELECT [DISTINCT] vars WHERE { triples, FILTER, OPTIONAL {}, { } UNION { } }.

Triples become filtered scans of the edge relation joined on shared
variables; the order comes from plans.estimate.join_order with injected counts
when given, else it is the written one, starting joins with shared variables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators.counting import OPS

TOKEN = re.compile(r"\?\w+|<\d+>|\d+|\{|\}|\.|\(|\)|<=|>=|!=|[<>=]|\w+|\*")


@dataclass
class Group:
    triples: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    optionals: list = field(default_factory=list)
    unions: list = field(default_factory=list)


@dataclass
class Query:
    variables: list
    distinct: bool
    where: Group


def parse(text: str) -> Query:
    tokens = TOKEN.findall(text)
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        token = tokens[at]
        if want and token.lower() != want:
            raise ValueError(f"expected {want}, found {token}")
        at += 1
        return token

    def group() -> Group:
        take("{")
        out = Group()
        while tokens[at] != "}":
            word = tokens[at].lower()
            if word == "filter":
                take()
                take("(")
                out.filters.append((take()[1:], take(), int(take())))
                take(")")
            elif word == "optional":
                take()
                out.optionals.append(group())
            elif word == "{":
                branches = [group()]
                while tokens[at].lower() == "union":
                    take()
                    branches.append(group())
                out.unions.append(branches)
            else:
                out.triples.append(tuple(x if x[0] == "?" else int(x.strip("<>")) for x in (take(), take(), take())))
            if tokens[at] == ".":
                take()
        take("}")
        return out

    take("select")
    distinct = tokens[at].lower() == "distinct"
    if distinct:
        take()
    variables = []
    while tokens[at].lower() != "where":
        variables.append(take()[1:])
    take("where")
    return Query(variables, distinct, group())


def scan(e: DataFrame, triple) -> DataFrame:
    """Rows of one triple pattern: constants become predicates on the scan, variables columns."""
    frame, names = e, {}
    for column, x in zip(("src", "label", "dest"), triple, strict=True):
        if isinstance(x, int):
            frame = frame.where(F.col(column) == x)
        elif x[1:] in names:
            frame = frame.where(F.col(column) == F.col(names[x[1:]]))
        else:
            names[x[1:]] = column
    return frame.select(*[F.col(c).alias(v) for v, c in names.items()])


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner", hint: str | None = None) -> DataFrame:
    if left is None:
        return right
    keys = [c for c in left.columns if c in right.columns]
    right = right.hint(hint) if hint else right
    return left.join(right, keys, how) if keys else left.crossJoin(right)


def plan(e: DataFrame, where: Group, order: list[int] | None = None, hint: str | None = None) -> DataFrame:
    out, todo = None, [where.triples[i] for i in order] if order else list(where.triples)
    while todo:
        known = set(out.columns) if out is not None else set()
        nxt = next((t for t in todo if known & {x[1:] for x in t if isinstance(x, str)}), todo[0]) if not order else todo[0]
        todo.remove(nxt)
        out = _join(out, scan(e, nxt), hint=hint)
    for branches in where.unions:
        # the rest is joined with each branch: what a branch leaves unbound is no key
        parts = [_join(out, plan(e, b, hint=hint), hint=hint) for b in branches]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
    test = lambda name, op, value: F.col(name) != value if op == "!=" else OPS[op](F.col(name), value)
    early = [f for f in where.filters if out is not None and f[0] in out.columns]
    for f in early:
        out = out.where(test(*f))
    for g in where.optionals:
        out = _join(out, plan(e, g, hint=hint), "left")
    # those on an optional variable; a comparison with an unbound one holds for no row
    for f in where.filters:
        if f not in early:
            out = out.where(test(*f) if f[0] in out.columns else F.lit(False))
    return out


def run(e: DataFrame, text: str, order: list[int] | None = None, hint: str | None = None) -> DataFrame:
    query = parse(text)
    out = plan(e, query.where, order, hint)
    out = out.select(*query.variables) if query.variables else out
    return out.distinct() if query.distinct else out
