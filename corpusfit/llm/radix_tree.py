"""An adaptive radix tree over byte strings made of fixed-width parts.

Inner nodes have four layouts that grow with their children: up to 4 and up to 16 sorted key bytes with a list of children, up to 48
children behind a table of 256 places, and a full table of 256 children. Path compression keeps the bytes that all keys below a node
share in the node. Keys may end anywhere on a multiple of the width, also at a node with children, so a node carries a value of its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any


class Node4:
    """Up to four children, key bytes sorted. A place without children has this layout too."""

    room = 4
    __slots__ = ("prefix", "value", "bytes", "children")

    def __init__(self, prefix: bytes = b"", value: Any = None):
        self.prefix, self.value = prefix, value
        self.bytes, self.children = bytearray(), []

    def child(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node) -> None:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = node
        else:
            self.bytes.insert(at, byte)
            self.children.insert(at, node)

    def full(self) -> bool:
        return len(self.children) >= self.room

    def items(self) -> Iterator[tuple[int, Any]]:
        return zip(self.bytes, self.children)


class Node16(Node4):
    """Up to sixteen children, key bytes sorted."""

    room = 16
    __slots__ = ()


class Node48:
    """Up to 48 children; a table has the place of each key byte's child, counted from one."""

    room = 48
    __slots__ = ("prefix", "value", "places", "children")

    def __init__(self, prefix: bytes = b"", value: Any = None):
        self.prefix, self.value = prefix, value
        self.places, self.children = bytearray(256), []

    def child(self, byte: int):
        place = self.places[byte]
        return self.children[place - 1] if place else None

    def put(self, byte: int, node) -> None:
        if place := self.places[byte]:
            self.children[place - 1] = node
        else:
            self.children.append(node)
            self.places[byte] = len(self.children)

    def full(self) -> bool:
        return len(self.children) >= self.room

    def items(self) -> Iterator[tuple[int, Any]]:
        return ((byte, self.children[place - 1]) for byte, place in enumerate(self.places) if place)


class Node256:
    """A child for every key byte."""

    room = 256
    __slots__ = ("prefix", "value", "children")

    def __init__(self, prefix: bytes = b"", value: Any = None):
        self.prefix, self.value = prefix, value
        self.children: list[Any] = [None] * 256

    def child(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, node) -> None:
        self.children[byte] = node

    def full(self) -> bool:
        return False

    def items(self) -> Iterator[tuple[int, Any]]:
        return ((byte, node) for byte, node in enumerate(self.children) if node is not None)


LAYOUTS = (Node4, Node16, Node48, Node256)


def _grown(node):
    """The node in the next larger layout."""
    larger = LAYOUTS[LAYOUTS.index(type(node)) + 1](node.prefix, node.value)
    for byte, child in node.items():
        larger.put(byte, child)
    return larger


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


class RadixTree:
    """Keys of bytes with values that ``merge`` puts together when a key comes again."""

    def __init__(self, merge: Callable[[Any, Any], Any]):
        self.merge, self.root, self.nodes = merge, Node4(), 1

    def insert(self, key: bytes, value: Any) -> None:
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            same = _shared(node.prefix, key[at:at + len(node.prefix)])
            if same < len(node.prefix):
                # The path parts inside the compressed bytes: a node for what is shared goes above.
                above = Node4(node.prefix[:same])
                above.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1:]
                self.nodes += 1
                self._hang(parent, byte, above)
                node = above
            at += same
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            child = node.child(key[at])
            if child is None:
                if node.full():
                    node = _grown(node)
                    self._hang(parent, byte, node)
                node.put(key[at], Node4(key[at + 1:], value))
                self.nodes += 1
                return
            parent, byte, node, at = node, key[at], child, at + 1

    def _hang(self, parent, byte: int, node) -> None:
        if parent is None:
            self.root = node
        else:
            parent.put(byte, node)

    def walk(self) -> Iterator[tuple[bytes, Any, int, int]]:
        """Nodes before their children and children in byte order: key of the node, node, and the lengths of its key's and its parent's."""
        waiting = [(b"", self.root, 0)]
        while waiting:
            before, node, above = waiting.pop()
            key = before + node.prefix
            yield key, node, len(key), above
            waiting += [(key + bytes([byte]), child, len(key)) for byte, child in reversed(list(node.items()))]

    def layouts(self) -> dict[str, int]:
        """How many nodes have which layout."""
        out = {kind.__name__: 0 for kind in LAYOUTS}
        for _, node, _, _ in self.walk():
            out[type(node).__name__] += 1
        return out


def aligned_depths(tree: RadixTree, width: int, fold: Callable[[Any, Any], Any]) -> Iterator[tuple[bytes, Any]]:
    """``(key, value)`` for every prefix that is a whole number of parts: the values of all keys below, folded.

    Bytes inside a part give no row; a compressed path gives one for each part that it passes. Children come before their parents.
    """
    order = list(tree.walk())
    folded: dict[int, Any] = {}
    for key, node, length, above in reversed(order):
        value = node.value
        for _, child in node.items():
            below = folded.pop(id(child))
            value = below if value is None else fold(value, below)
        folded[id(node)] = value
        if value is None:
            continue
        # Aligned depths after the parent's end: those up to the parent's belong to it.
        first = (above // width + 1) * width if node is not tree.root else 0
        for depth in range(length // width * width, first - 1, -width):
            yield key[:depth], value
