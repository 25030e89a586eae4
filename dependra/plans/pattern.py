"""Graph patterns: what is parsed on the driver and compiled into joins.

A pattern has vertices 0..n-1 with labels (word, pos, lemma, wc, root; each also negated with not_), and not_indep / not_outdep
(lists of relations that no incoming / outgoing edge may have), and edges with relation or not_relation.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable

LABELS = ("word", "pos", "lemma", "wc", "root")
LISTS = ("not_indep", "not_outdep")
MARKS = ("query", "only_A", "only_B", "focus_point", "collo_item", "collo_A", "collo_B")


@dataclasses.dataclass(frozen=True)
class Pattern:
    vertices: tuple[dict, ...]
    edges: tuple[tuple[int, int, dict], ...]
    name: str | None = None
    #: The vertex of the whole query that each vertex comes from.
    vids: tuple[int, ...] = ()

    def __post_init__(self):
        if not self.vids:
            object.__setattr__(self, "vids", tuple(range(len(self.vertices))))
        for v in self.vertices:
            for k in v:
                if k.removeprefix("not_") not in LABELS and k not in LISTS + MARKS + ("vid",):
                    raise ValueError(f"unknown vertex attribute {k}")
        seen = set()
        for s, t, e in self.edges:
            if (s, t) in seen:
                raise ValueError("parallel edges")
            seen.add((s, t))
            if any(k not in ("relation", "not_relation", "only_A", "only_B") for k in e):
                raise ValueError(f"unknown edge attribute in {e}")

    def __len__(self) -> int:
        return len(self.vertices)

    def subpattern(self, keep: Iterable[int]) -> Pattern:
        """The induced part, renumbered in the order of its vertices."""
        keep = sorted(keep)
        at = {v: i for i, v in enumerate(keep)}
        return Pattern(tuple(dict(self.vertices[v]) for v in keep), tuple((at[s], at[t], dict(e)) for s, t, e in self.edges if s in at and t in at), self.name, tuple(self.vids[v] for v in keep))

    def without(self, *names: str) -> Pattern:
        drop = lambda d: {k: v for k, v in d.items() if k not in names}
        return Pattern(tuple(drop(v) for v in self.vertices), tuple((s, t, drop(e)) for s, t, e in self.edges), self.name, self.vids)

    def marked(self, name: str) -> list[int]:
        """Vertices with a mark; its value must be true, anything else is refused."""
        found = [i for i, v in enumerate(self.vertices) if name in v]
        if any(self.vertices[i][name] is not True for i in found):
            raise ValueError(f"{name} must be true where it is given")
        return found

    # Structure, as the canonical order and the choice of a focus point need it.

    def reach(self, v: int, forward: bool = True) -> set[int]:
        seen, todo = {v}, [v]
        while todo:
            x = todo.pop()
            for s, t, _ in self.edges:
                a, b = (s, t) if forward else (t, s)
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    def roots(self) -> list[int]:
        return [v for v in range(len(self)) if len(self.reach(v)) == len(self)]

    def antiroots(self) -> list[int]:
        return [v for v in range(len(self)) if len(self.reach(v, False)) == len(self)]

    def star_centers(self) -> list[int]:
        near = lambda v: {v} | {t for s, t, _ in self.edges if s == v} | {s for s, t, _ in self.edges if t == v}
        return [v for v in range(len(self)) if len(near(v)) == len(self)]

    def is_star(self) -> bool:
        return bool(self.star_centers())

    def is_purely_structural(self) -> bool:
        return all(x in (".+", ".*") for d in (*self.vertices, *(e for _, _, e in self.edges)) for x in d.values())

    def focus_point(self) -> int | None:
        """The first root, else antiroot, else star centre, in canonical order."""
        order = canonical_order([_frozen(v) for v in self.vertices], [(s, t, _frozen(e)) for s, t, e in self.edges])
        for some in (self.roots(), self.antiroots(), self.star_centers()):
            if some:
                return min(some, key=order.index)
        return None


def _frozen(d: dict) -> str:
    return json.dumps(d, sort_keys=True, ensure_ascii=False)


def canonical_order(labels: list[str], edges: list[tuple[int, int, str]]) -> list[int]:
    """An order of the vertices that isomorphic labelled graphs share (up to automorphism).

    Colours are refined by the coloured neighbourhoods; what is left is told apart by the smallest serialisation over the
    permutations within colour classes, found branch by branch. Of vertices that can be exchanged (twins, or by an automorphism that the
    search has met) only one is tried, so that symmetric graphs take no longer than others.
    """
    n = len(labels)
    out = [[(t, e) for s, t, e in edges if s == v] for v in range(n)]
    into = [[(s, e) for s, t, e in edges if t == v] for v in range(n)]

    def refine(colour: list[int]) -> list[int]:
        while True:
            keys = [(colour[v], sorted((e, colour[t]) for t, e in out[v]), sorted((e, colour[s]) for s, e in into[v])) for v in range(n)]
            order = sorted(range(n), key=lambda v: keys[v])
            new, last = [0] * n, -1
            for i, v in enumerate(order):
                if i == 0 or keys[v] != keys[order[i - 1]]:
                    last += 1
                new[v] = last
            if len(set(new)) == len(set(colour)):
                return new
            colour = new

    def twins(v: int, w: int) -> bool:
        """Whether exchanging the two changes nothing."""
        swap = lambda xs, a, b: sorted((b if x == a else x, e) for x, e in xs)
        return swap(out[v], w, v) == sorted(out[w]) and swap(into[v], w, v) == sorted(into[w]) if not any(x in (v, w) for x, _ in out[v] + into[v] + out[w] + into[w]) else False

    best: list = [None, None]
    same: list[list[int]] = []  # automorphisms that have been found

    def alike(path: list[int]) -> list[int]:
        """A name for the orbit of each vertex under the automorphisms found that leave the path where it is."""
        top = list(range(n))

        def find(x: int) -> int:
            while top[x] != x:
                x = top[x]
            return x

        for m in same:
            if all(m[v] == v for v in path):
                for v in range(n):
                    x, y = sorted((find(v), find(m[v])))
                    top[y] = x
        return [find(v) for v in range(n)]

    def search(colour: list[int], path: list[int]) -> None:
        colour = refine(colour)
        classes: dict[int, list[int]] = {}
        for v, c in enumerate(colour):
            classes.setdefault(c, []).append(v)
        tied = next((classes[c] for c in sorted(classes) if len(classes[c]) > 1), None)
        if tied is None:
            order = sorted(range(n), key=lambda v: colour[v])
            at = {v: i for i, v in enumerate(order)}
            text = sorted((at[s], at[t], e) for s, t, e in edges)
            if best[0] is None or text < best[0]:
                best[:] = [text, order]
            elif text == best[0]:
                moved = [0] * n
                for v, w in zip(best[1], order):
                    moved[v] = w
                same.append(moved)
            return
        # Of those that can be exchanged, one is tried.
        tried: list[int] = []
        for v in tied:
            if any(twins(v, w) for w in tried):
                continue
            if tried:
                orbit = alike(path)
                if any(orbit[v] == orbit[w] for w in tried):
                    continue
            search([2 * c + (1 if c == colour[v] and w != v else 0) for w, c in enumerate(colour)], [*path, v])
            tried.append(v)

    first = {x: i for i, x in enumerate(sorted(set(labels)))}
    search([first[x] for x in labels], [])
    return best[1] if n else []


def parse(graph: dict) -> Pattern:
    """From node-link JSON; vertices are renumbered by ascending id."""
    nodes = sorted(graph["nodes"], key=lambda x: x["id"])
    at = {x["id"]: i for i, x in enumerate(nodes)}
    vertices = tuple({k: v for k, v in x.items() if k not in ("id", "vid")} for x in nodes)
    edges = tuple((at[x["source"]], at[x["target"]], {k: v for k, v in x.items() if k not in ("source", "target", "key")}) for x in graph.get("links", []))
    return Pattern(vertices, edges, (graph.get("graph") or {}).get("description") if isinstance(graph.get("graph"), dict) else None)


def read_queries(path: str) -> list[Pattern]:
    with open(path, encoding="utf-8") as f:
        return [parse(g) for g in json.load(f)]


def from_adjacency(matrix: list[list[dict]]) -> Pattern:
    """Vertex labels on the diagonal; an empty dictionary elsewhere is no edge."""
    n = range(len(matrix))
    return Pattern(tuple(dict(matrix[i][i]) for i in n), tuple((i, j, dict(matrix[i][j])) for i in n for j in n if i != j and matrix[i][j]))


def to_adjacency(p: Pattern, canonical: bool = False) -> list[list[dict]]:
    order = canonical_order([_frozen(v) for v in p.vertices], [(s, t, _frozen(e)) for s, t, e in p.edges]) if canonical else list(range(len(p)))
    at = {v: i for i, v in enumerate(order)}
    out = [[{} for _ in order] for _ in order]
    for v in range(len(p)):
        out[at[v]][at[v]] = dict(p.vertices[v])
    for s, t, e in p.edges:
        out[at[s]][at[t]] = dict(e)
    return out


def skeletize(p: Pattern, only_vertices: bool = False) -> Pattern:
    """Without vertex labels, and edge labels unless only_vertices; unconnected vertices vanish."""
    linked = sorted({v for s, t, _ in p.edges for v in (s, t)})
    at = {v: i for i, v in enumerate(linked)}
    return Pattern(tuple({} for _ in linked), tuple((at[s], at[t], dict(e) if only_vertices else {}) for s, t, e in p.edges), p.name)


@dataclasses.dataclass(frozen=True)
class Association:
    """The four patterns of a query annotated with A, B and AB, and the focus point in n."""

    c: Pattern
    a: Pattern
    b: Pattern
    n: Pattern
    focus: int


def split_association(query: Pattern) -> Association:
    for v in query.vertices:
        if v.get("query") not in ("A", "B", "AB"):
            raise ValueError("every vertex needs query: A, B or AB")

    def part(roles: tuple[str, ...], lose: tuple[str, ...], focus: bool) -> Pattern:
        p = query.subpattern(i for i, v in enumerate(query.vertices) if v["query"] in roles)

        def strip(d: dict) -> dict:
            gone = {x for k in lose for x in d.get(k, ())}
            return {k: v for k, v in d.items() if k not in gone and k not in ("query", "only_A", "only_B") and (focus or k != "focus_point")}

        return Pattern(tuple(strip(v) for v in p.vertices), tuple((s, t, strip(e)) for s, t, e in p.edges), p.name, p.vids)

    c, a, b, n = part(("A", "B", "AB"), (), False), part(("A", "AB"), ("only_B",), False), part(("B", "AB"), ("only_A",), False), part(("AB",), ("only_A", "only_B"), True)
    marked = n.marked("focus_point")
    n = n.without("focus_point")
    focus = marked[0] if marked else n.focus_point()
    if focus is None:
        raise ValueError("the query has no focus point")
    return Association(c, a, b, n, focus)
