"""Query trees as data: boxes that bind variables, filters, size filters, constraints, gates. Read from and written to JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

EVENT, OBJECT = "Event", "Object"
GATES = ("OR", "AND", "NOT")


@dataclass(frozen=True, order=True)
class Variable:
    kind: str
    index: int

    @property
    def name(self) -> str:
        return f"{'e' if self.kind == EVENT else 'o'}{self.index + 1}"

    @staticmethod
    def parse(said: dict) -> Variable:
        (kind, index), *more = said.items()
        if more or kind not in (EVENT, OBJECT):
            raise ValueError(f"not a variable: {said}")
        return Variable(kind, int(index))

    @staticmethod
    def named(name: str) -> Variable:
        return Variable({"e": EVENT, "o": OBJECT}[name[0]], int(name[1:]) - 1)


def event(i: int) -> Variable:
    return Variable(EVENT, i)


def obj(i: int) -> Variable:
    return Variable(OBJECT, i)


@dataclass
class Box:
    """Filters, size filters and constraints stay the dictionaries of the wire format; the compiler knows their tags."""

    new_events: dict[int, list[str]] = field(default_factory=dict)
    new_objects: dict[int, list[str]] = field(default_factory=dict)
    filters: list[dict] = field(default_factory=list)
    size_filters: list[dict] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)
    event_labels: dict[int, str] = field(default_factory=dict)
    object_labels: dict[int, str] = field(default_factory=dict)
    labels: list[dict] = field(default_factory=list)

    @staticmethod
    def parse(said: dict) -> Box:
        numbered = lambda key: {int(k): v for k, v in (said.get(key) or {}).items()}
        return Box(numbered("newEventVars"), numbered("newObjectVars"), list(said.get("filters") or []), list(said.get("sizeFilters") or []), list(said.get("constraints") or []), numbered("evVarLabels"), numbered("obVarLabels"), list(said.get("labels") or []))

    def to_json(self) -> dict:
        text = lambda d: {str(k): v for k, v in d.items()}
        return {"newEventVars": text(self.new_events), "newObjectVars": text(self.new_objects), "filters": self.filters, "sizeFilters": self.size_filters, "constraints": self.constraints, "evVarLabels": text(self.event_labels), "obVarLabels": text(self.object_labels), "labels": self.labels}

    @property
    def new_vars(self) -> dict[Variable, list[str]]:
        return {**{event(i): t for i, t in self.new_events.items()}, **{obj(i): t for i, t in self.new_objects.items()}}


@dataclass
class Node:
    box: Box
    children: list[int] = field(default_factory=list)
    #: None for a box of its own, else the gate that it was.
    gate: str | None = None


@dataclass
class Tree:
    nodes: list[Node]
    edge_names: dict[tuple[int, int], str] = field(default_factory=dict)

    @staticmethod
    def parse(said: dict | str) -> Tree:
        said = json.loads(said) if isinstance(said, str) else said
        names = {tuple(edge): name for edge, name in said.get("edgeNames") or []}
        nodes = []
        for i, x in enumerate(said["nodes"]):
            (tag, body), *_ = x.items()
            if tag == "Box":
                nodes.append(Node(Box.parse(body[0]), list(body[1])))
            elif tag in GATES:
                nodes.append(Node(Box(), [body] if tag == "NOT" else list(body), tag))
            else:
                raise ValueError(f"unknown node {tag}")
        tree = Tree(nodes, names)
        for i, n in enumerate(nodes):
            if n.gate:
                n.box.constraints = [{"type": n.gate, "child_names": [tree.edge(i, c) for c in n.children]}]
        tree.validate()
        return tree

    def validate(self) -> None:
        seen: set[int] = set()
        for i, n in enumerate(self.nodes):
            for c in n.children:
                if not 0 <= c < len(self.nodes) or c == i or c in seen:
                    raise ValueError(f"node {c} is no proper child of {i}")
                seen.add(c)

    def edge(self, parent: int, child: int) -> str:
        return self.edge_names.get((parent, child), f"UNNAMED - {child}")

    @property
    def roots(self) -> list[int]:
        below = {c for n in self.nodes for c in n.children}
        return [i for i in range(len(self.nodes)) if i not in below]

    def parents(self) -> dict[int, int]:
        return {c: i for i, n in enumerate(self.nodes) for c in n.children}

    def to_json(self) -> dict[str, Any]:
        nodes = [{n.gate: n.children[0] if n.gate == "NOT" else n.children} if n.gate else {"Box": [n.box.to_json(), n.children]} for n in self.nodes]
        return {"nodes": nodes, "edgeNames": [[list(k), v] for k, v in self.edge_names.items()]}


def forest(trees: list[Tree]) -> Tree:
    """Several trees as one, their indices shifted."""
    nodes: list[Node] = []
    names: dict[tuple[int, int], str] = {}
    for t in trees:
        at = len(nodes)
        names |= {(a + at, b + at): n for (a, b), n in t.edge_names.items()}
        for i, n in enumerate(t.nodes):
            box = n.box
            if n.gate:  # gates name their edges by number unless these have names
                box = Box(constraints=[{"type": n.gate, "child_names": [t.edge_names.get((i, c), f"UNNAMED - {c + at}") for c in n.children]}])
            nodes.append(Node(box, [c + at for c in n.children], n.gate))
    return Tree(nodes, names)
