"""Questions about all nodes of many pages at once.

The nodes of a batch of pages lie end to end in document order, each with the number of its last descendant. So
"inside a marked node" is a running maximum, what lies below a node is a difference of two prefix sums, and the
nearest marked ancestor comes from doubling parent steps: a few numpy passes over the batch, whatever the pages' shape.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from leafmill.sources.pages import _Nodes

#: Ancestors that decide how a node is written.
ON_PATH = frozenset(("pre", "ul", "ol", "li", "sup", "a"))


class Flat:
    """The node columns of a batch of pages. A node without parent has the number ``n``, one past all nodes."""

    def __init__(self, nodes: pa.ListArray):
        rows = nodes.flatten()
        ends, attrs = nodes.offsets.to_numpy().astype(np.int64), rows.field("attrs")
        each = attrs.offsets.to_numpy() - attrs.offsets[0].as_py()
        names, values = attrs.keys.to_pylist(), attrs.items.to_pylist()
        columns = [rows.field(x).to_pylist() for x in ("last", "parent", "item", "tag", "text")]
        self._fill(ends - ends[0], *columns, each.tolist(), names, values)

    @classmethod
    def of(cls, read: _Nodes) -> Flat:
        """The nodes as the parser left them."""
        flat = cls.__new__(cls)
        flat._fill(np.array(read.page_ends, np.int64), read.last, read.parent, read.item, read.tag, read.text, read.attr_ends, read.names, read.values)
        return flat

    def _fill(self, ends: np.ndarray, last: list, parent: list, item: list, tag: list, text: list, attr_ends: list, names: list, values: list) -> None:
        self.ends = ends
        self.n = len(tag)
        self.no = np.arange(self.n)
        self.page = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        base = ends[:-1][self.page]
        self.last = np.array(last, np.int64) + base
        up = np.array(parent, np.int64)
        self.parent = np.where(up < 0, self.n, up + base)
        self.item = item
        codes: dict[str, int] = {}
        self.code = np.array([codes.setdefault(x, len(codes)) for x in tag], np.int64)
        self.names: list[str] = list(codes)
        self.text: list[str | None] = text
        self._attrs: dict[str, dict[int, str]] = {}
        for node in np.flatnonzero(np.diff(attr_ends)).tolist():
            for k in range(attr_ends[node], attr_ends[node + 1]):
                self._attrs.setdefault(names[k], {})[node] = values[k]
        is_text = self.tags("#text").tolist()
        self.stripped = [t.strip() if own else "" for t, own in zip(self.text, is_text)]
        #: Length of each text run, as it stands and stripped.
        self.raw_size = np.array([len(t) if own else 0 for t, own in zip(self.text, is_text)], np.int64)
        self.size = np.array([len(t) for t in self.stripped], np.int64)
        self.runs = np.flatnonzero(self.size)

    def tags(self, *names: str) -> np.ndarray:
        return np.isin(self.code, [i for i, x in enumerate(self.names) if x in names])

    def tag(self, node: int) -> str:
        return self.names[self.code[node]]

    def attr(self, name: str) -> dict[int, str]:
        """The nodes that have an attribute, with its value."""
        return dict(self._attrs.get(name, {}))

    def with_class(self, *names: str) -> np.ndarray:
        wanted, out, classes = set(names), np.zeros(self.n, bool), self.attr("class")
        has = {value: not wanted.isdisjoint(value.split()) for value in set(classes.values())}
        out[[node for node, value in classes.items() if has[value]]] = True
        return out

    def inside(self, marked: np.ndarray, itself: bool = True) -> np.ndarray:
        """Which nodes are below a marked one, or marked."""
        reach = np.maximum.accumulate(np.where(marked, self.last, -1)) if self.n else self.no
        return reach >= self.no if itself else np.concatenate(([-1], reach[:-1]))[: self.n] >= self.no

    def below(self, values: np.ndarray) -> np.ndarray:
        """For every node the sum of ``values`` over the nodes below it."""
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.last + 1] - sums[self.no + 1]

    def nearest(self, marked: np.ndarray) -> np.ndarray:
        """The closest marked node at or above each node, or ``n``."""
        up = np.append(np.where(marked, self.no, self.parent), self.n)
        while True:
            further = up[up]
            if (further == up).all():
                return up
            up = further

    def first_below(self, marked: np.ndarray, node: int) -> int:
        """The first marked node below one, or ``n``."""
        at = np.flatnonzero(marked[node + 1 : self.last[node] + 1])
        return node + 1 + int(at[0]) if len(at) else self.n

    def text_of(self, node: int) -> str:
        """The stripped text runs below a node, joined by spaces."""
        low, high = np.searchsorted(self.runs, (node, self.last[node] + 1))
        return " ".join(self.stripped[i] for i in self.runs[low:high])

    def raw_text(self, node: int) -> str:
        return "".join(self.text[i] for i in range(node + 1, int(self.last[node]) + 1) if self.raw_size[i])

    def written(self, groups: list[np.ndarray], kept: np.ndarray, tag: Callable[[int], str], mark: Callable[[int, str, str], tuple[str, str]]) -> list[str]:
        """What each group of ``kept`` nodes writes: ``mark(node, tag, path)`` gives what a node opens and closes with.

        What loses its parent hangs on the nearest kept one. A ``path`` names the ancestors in ``ON_PATH`` and the parent, so
        that it stays short in a deep page.
        """
        above, out = np.append(self.nearest(kept), self.n)[self.parent], []
        for own in groups:
            names: dict[int, str] = {}
            chains: dict[int, str] = {}
            parts: list[str] = []
            closing: list[tuple[int, str]] = []
            for i, last, parent in zip(own.tolist(), self.last[own].tolist(), above[own].tolist()):
                while closing and closing[-1][0] < i:
                    parts.append(closing.pop()[1])
                names[i] = name = tag(i)
                chain, at = (chains[parent], f"{names[parent]}/") if parent in names else ("/", "")
                chains[i] = chain + at if at[:-1] in ON_PATH else chain
                opens, closes = mark(i, name, chain + at)
                parts.append(opens)
                closing.append((last, closes))
            out.append("".join(parts + [closes for _, closes in reversed(closing)]))
        return out
