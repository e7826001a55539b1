"""What a pipeline or workflow is: nodes and edges, read from JSON-like dictionaries and checked before anything runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Node types. Fixed values.
TYPES = ("source", "filter", "map", "aggregate", "sort", "deduplicate", "join", "branch", "output")


class SpecError(ValueError):
    """The graph can't be run as it stands."""


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    config: dict = field(default_factory=dict)
    label: str = ""


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    source_handle: str | None = None
    target_handle: str | None = None


def order(keys: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """Topological order; of those that are ready, the one listed first."""
    keys = list(keys)
    waits, after = dict.fromkeys(keys, 0), {k: [] for k in keys}
    for a, b in edges:
        if a not in waits or b not in waits:
            raise SpecError(f"an edge names {a if a not in waits else b!r}, which isn't a node")
        waits[b] += 1
        after[a].append(b)
    ready, out = deque(k for k in keys if not waits[k]), []
    while ready:
        out.append(k := ready.popleft())
        for b in after[k]:
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    if len(out) < len(keys):
        raise SpecError("the graph has a cycle: " + ", ".join(k for k in keys if k not in out))
    return out


def reachable(start: Iterable[str], edges: Iterable[tuple[str, str]], backward: bool = False) -> set[str]:
    """What can be reached from `start`, itself left out unless a cycle leads back."""
    step: dict[str, list[str]] = {}
    for a, b in edges:
        step.setdefault(b if backward else a, []).append(a if backward else b)
    seen: set[str] = set()
    queue = deque(start)
    while queue:
        for b in step.get(queue.popleft(), []):
            if b not in seen:
                seen.add(b)
                queue.append(b)
    return seen


@dataclass
class Pipeline:
    nodes: list[Node]
    edges: list[Edge]

    @classmethod
    def parse(cls, spec: dict) -> Pipeline:
        nodes = []
        for n in spec.get("nodes") or []:
            data = n.get("data") or {}
            nodes.append(Node(str(n["id"]), n.get("type") or data.get("type") or "", data.get("config") or n.get("config") or {}, data.get("label") or str(n["id"])))
        edges = [Edge(str(e["source"]), str(e["target"]), e.get("sourceHandle"), e.get("targetHandle")) for e in spec.get("edges") or []]
        out = cls(nodes, edges)
        out.check()
        return out

    def node(self, key: str) -> Node:
        return next(n for n in self.nodes if n.id == key)

    def order(self) -> list[str]:
        return order((n.id for n in self.nodes), ((e.source, e.target) for e in self.edges))

    def inputs(self, key: str) -> list[Edge]:
        """Incoming edges as listed; a join's right side comes last if its edge says so."""
        found = [e for e in self.edges if e.target == key]
        return sorted(found, key=lambda e: e.target_handle == "join_right") if self.node(key).type == "join" else found

    def check(self) -> None:
        if not self.nodes:
            raise SpecError("a pipeline needs nodes")
        ids = [n.id for n in self.nodes]
        if len(set(ids)) < len(ids):
            raise SpecError("two nodes have the same id")
        self.order()
        for n in self.nodes:
            if n.type not in TYPES:
                raise SpecError(f"node {n.id!r} has the unknown type {n.type!r}")
            count = len(self.inputs(n.id))
            least, most = {"source": (0, 0), "join": (2, 2)}.get(n.type, (1, 1))
            if not least <= count <= most:
                raise SpecError(f"node {n.id!r} ({n.type}) takes {least} input{'s' * (least != 1)}, not {count}")


@dataclass
class Workflow:
    """Pipelines by key, and which waits for which."""

    pipelines: dict[str, object]
    edges: list[tuple[str, str]]

    @classmethod
    def parse(cls, spec: dict) -> Workflow:
        found: dict[str, object] = {}
        for n in spec.get("nodes") or []:
            data = n.get("data") or {}
            key = n.get("key") or n.get("id")
            if not key:
                raise SpecError("every node of a workflow needs a key")
            found[str(key)] = next((x for x in (n.get("pipeline_id"), n.get("pipelineId"), data.get("pipeline_id"), data.get("pipelineId")) if x is not None), None)
        if not found:
            raise SpecError("a workflow needs nodes")
        out = cls(found, [(str(e["source"]), str(e["target"])) for e in spec.get("edges") or []])
        out.order()
        return out

    def order(self) -> list[str]:
        return order(self.pipelines, self.edges)

    def downstream(self, key: str) -> set[str]:
        return reachable([key], self.edges)
