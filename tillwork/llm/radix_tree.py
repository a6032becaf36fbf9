"""An adaptive radix tree over byte keys: nodes grow through four layouts, and runs of single children are one path.

Keys are sequences of units of a fixed width (turn ids, big-endian), so one key may be the beginning of another; a node
holds a value where a key ends. ``aligned`` walks the tree bottom up and reports the depths between units only: the
other branching points are a matter of bytes and stand for nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator


class Few:
    """Up to 4 or 16 children: sorted bytes beside the children."""

    __slots__ = ("size", "bytes", "children")

    def __init__(self, size: int = 4):
        self.size, self.bytes, self.children = size, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def put(self, byte: int, child: Node) -> Few | Indexed:
        """The layout that holds the child as well; a larger one if there is no room."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = child
            return self
        if len(self.bytes) == self.size:
            wider = Few(16) if self.size == 4 else Indexed()
            for b, c in self.items():
                wider.put(b, c)
            return wider.put(byte, child)
        self.bytes.insert(at, byte)
        self.children.insert(at, child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.children)


class Indexed:
    """Up to 48 children: a place for each byte that says which child, or that there is none."""

    __slots__ = ("index", "children")
    NONE = 255

    def __init__(self):
        self.index, self.children = bytearray([self.NONE]) * 256, []

    def get(self, byte: int) -> Node | None:
        at = self.index[byte]
        return None if at == self.NONE else self.children[at]

    def put(self, byte: int, child: Node) -> Indexed | Full:
        at = self.index[byte]
        if at != self.NONE:
            self.children[at] = child
            return self
        if len(self.children) == 48:
            wider = Full()
            for b, c in self.items():
                wider.put(b, c)
            return wider.put(byte, child)
        self.index[byte] = len(self.children)
        self.children.append(child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.children[at]) for b, at in enumerate(self.index) if at != self.NONE)


class Full:
    """A child for every byte."""

    __slots__ = ("children",)

    def __init__(self):
        self.children: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.children[byte]

    def put(self, byte: int, child: Node) -> Full:
        self.children[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, c) for b, c in enumerate(self.children) if c is not None)


class Node:
    """``path``: the bytes after the branching one that all keys below share."""

    __slots__ = ("path", "value", "layout")

    def __init__(self, path: bytes, value: object = None):
        self.path, self.value, self.layout = path, value, Few()

    def put(self, byte: int, child: Node) -> None:
        self.layout = self.layout.put(byte, child)


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many first bytes of ``a`` the key ``b`` has from ``at`` on."""
    if b.startswith(a, at):
        return len(a)
    n = 0
    for x, y in zip(a, memoryview(b)[at:]):
        if x != y:
            break
        n += 1
    return n


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: object) -> None:
        """Keys are distinct, and values are not None."""
        above, byte, node, at = None, 0, self.root, 0
        while True:
            n = shared(node.path, key, at)
            if n < len(node.path):
                upper = Node(node.path[:n])
                upper.put(node.path[n], node)
                node.path = node.path[n + 1:]
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node = upper
            at += n
            if at == len(key):
                node.value = value
                return
            child = node.layout.get(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1:], value))
                return
            above, byte, node, at = node, key[at], child, at + 1

    def aligned(self, width: int, start: Callable, join: Callable, close: Callable) -> object:
        """Fold the tree from below, with a report for each depth that is a multiple of ``width``, the root's last.

        ``start(value)`` makes the state of a place where a key ends (value None: where none does), ``join(state, below)``
        adds the state of a child, and ``close(state, units)`` turns the state of a node at that many units into what its
        parent's state is joined with.
        """
        result = None
        # Node, its first byte's depth, its last byte's depth, children to come, state.
        stack = [(self.root, -1, len(self.root.path), iter(self.root.layout.items()), start(self.root.value))]
        while stack:
            node, top, bottom, rest, state = stack[-1]
            child = next(rest, None)
            if child is not None:
                below = child[1]
                stack.append((below, bottom, bottom + 1 + len(below.path), iter(below.layout.items()), start(below.value)))
                continue
            stack.pop()
            # The bytes of this node end at the depths top + 1 .. bottom; the root's path begins at depth 0.
            for depth in range(bottom - bottom % width, top, -width):
                below = close(state, depth // width)
                state = start(None)
                join(state, below)
                result = below
            if stack:
                join(stack[-1][4], state)
        return result
