"""Compressed tries of whole texts (bytes): each edge holds the run of bytes up to the next branch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


def common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` are those of ``b`` from ``at`` on; found by halving, so long runs are compared at once."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """``label`` leads here from the parent; ``rows`` of the texts that end here, ``least`` of their ids."""

    __slots__ = ("children", "label", "least", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.rows = label, {}, None, None


class Trie:
    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0

    def insert(self, text: bytes, key: Any, row: Any) -> None:
        """Add a row under its text; ``key`` is its id, null ones never are the least."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += len(text) - at
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = common(child.label, text, at)
                middle = Node(child.label[:n])
                node.children[text[at]] = middle
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node, at = middle, at + n
        if node.rows is None:
            node.rows = []
        node.rows.append((key, row))
        if key is not None and (node.least is None or key < node.least):
            node.least = key

    def terminals(self) -> Iterator[tuple[Any, list]]:
        """The least id and the rows (id, row) of each text."""
        open_nodes = [self.root]
        while open_nodes:
            node = open_nodes.pop()
            if node.rows is not None:
                yield node.least, node.rows
            open_nodes.extend(node.children.values())
