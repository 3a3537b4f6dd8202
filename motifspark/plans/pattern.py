"""Patterns of labelled edges over virtual vertices; sub-patterns are bit masks over the edge list."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Pattern:
    edges: tuple[tuple[int, int, int], ...]  # (source vertex, label, target vertex), in string order of "s-d"

    @classmethod
    def of(cls, edges) -> Pattern:
        return cls(tuple(sorted(map(tuple, edges), key=lambda e: (f"{e[0]}-{e[2]}", e[1]))))

    @classmethod
    def parse(cls, vlist: str, labels: str) -> Pattern:
        """From "0-1;1-2" and "3->5"."""
        ends = [tuple(map(int, x.split("-"))) for x in vlist.split(";")]
        return cls.of((s, label, d) for (s, d), label in zip(ends, map(int, labels.split("->")), strict=True))

    @property
    def vlist(self) -> str:
        return ";".join(f"{s}-{d}" for s, _, d in self.edges)

    @property
    def label_seq(self) -> str:
        return "->".join(str(label) for _, label, _ in self.edges)

    @property
    def size(self) -> int:
        return len(self.edges)

    @property
    def full(self) -> int:
        return (1 << len(self.edges)) - 1

    @cached_property
    def vertices(self) -> tuple[int, ...]:
        return tuple(sorted({v for s, _, d in self.edges for v in (s, d)}))

    @property
    def acyclic(self) -> bool:
        return self.connected(self.full) and len(self.vertices) == len(self.edges) + 1

    def sub(self, mask: int) -> Pattern:
        return Pattern(tuple(e for i, e in enumerate(self.edges) if mask >> i & 1))

    def ends(self, mask: int) -> set[int]:
        return {v for i, (s, _, d) in enumerate(self.edges) if mask >> i & 1 for v in (s, d)}

    def connected(self, mask: int) -> bool:
        rest = {i for i in range(self.size) if mask >> i & 1}
        if not rest:
            return False
        seen = set(self.ends(1 << rest.pop()))
        while more := [i for i in rest if seen & self.ends(1 << i)]:
            for i in more:
                seen |= self.ends(1 << i)
                rest.discard(i)
        return not rest

    def subsets(self, least: int = 1, most: int | None = None, acyclic: bool = False) -> list[int]:
        """Connected edge subsets by size, then value."""
        most = self.size if most is None else most
        found = [m for m in range(1, self.full + 1) if least <= m.bit_count() <= most and self.connected(m)]
        return sorted((m for m in found if not acyclic or self.sub(m).acyclic), key=lambda m: (m.bit_count(), m))

    @property
    def shape(self) -> str:
        """single, path, star, fork, tree, cyclic or disconnected."""
        degree = sorted(sum(v in (s, d) for s, _, d in self.edges) for v in self.vertices)
        if self.size == 1:
            return "single"
        if not self.connected(self.full):
            return "disconnected"
        if not self.acyclic:
            return "cyclic"
        if degree[-1] <= 2:
            return "path"
        if degree[-1] == self.size:
            return "star"
        return "fork" if len([d for d in degree if d > 1]) == 2 else "tree"

    def triangles(self) -> list[int]:
        return [m for m in self.subsets(3, 3) if len(self.ends(m)) == 3]

    def fused(self) -> Pattern:
        """A path with its two ends made one vertex."""
        ends = [v for v in self.vertices if sum(v in (s, d) for s, _, d in self.edges) == 1]
        keep, gone = min(ends), max(ends)
        return Pattern(tuple((keep if s == gone else s, label, keep if d == gone else d) for s, label, d in self.edges))


def parse_query(line: str) -> tuple[Pattern, int]:
    """ "vlist,labels,count" """
    vlist, labels, count = line.strip().split(",")
    return Pattern.parse(vlist, labels), int(count)


def parse_legacy(line: str) -> tuple[Pattern, dict[int, tuple[str, int]], int]:
    """ "n,src-[l]>dest,...,filters,filter or -1,...,count"; a filter belongs to the vertex of its place. """
    parts = line.strip().split(",")
    n = int(parts[0])
    edges = [tuple(map(int, re.fullmatch(r"(\d+)-\[(\d+)\]>(\d+)", x).groups())) for x in parts[1 : n + 1]]
    count = int(parts[n + 1])
    filters = {i: (m[1], int(m[2])) for i, x in enumerate(parts[n + 2 : n + 2 + count]) if (m := re.fullmatch(r"(<=|>=|<|>|=)(-?\d+)", x))}
    return Pattern.of(edges), filters, int(parts[-1])


def to_sparql(pattern: Pattern) -> str:
    return f"select {' '.join(f'?v{v}' for v in pattern.vertices)} where {{ {' '.join(f'?v{s} <{label}> ?v{d} .' for s, label, d in pattern.edges)} }}"


def base_and_extensions(pattern: Pattern) -> list[tuple[int, int]]:
    """(base, extension) masks: each edge split off, with both parts swapped as well; the base must be connected."""
    pairs = [(pattern.full ^ 1 << i, 1 << i) for i in range(pattern.size)]
    return [(b, e) for x in pairs for b, e in (x, x[::-1]) if b and e and pattern.connected(b)]


def label_product(vlist: str, labels, count: int):
    """Patterns of a shape over a list of labels, in order, as many as asked."""
    n = vlist.count(";") + 1
    for seq in itertools.islice(itertools.product(labels, repeat=n), count):
        yield Pattern.parse(vlist, "->".join(map(str, seq)))
