"""Ropes: texts as height-balanced trees whose nodes know their code points and line ends."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

#: Code points of a leaf at most.
LEAF = 4096


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf has ``text``, an inner node two children. ``chars`` and ``ends`` (line ends) are cached
    at every node; ``open`` says that the last line has no end."""

    chars: int
    ends: int
    open: bool
    height: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    @property
    def units(self) -> int:
        """Lines, the last of which may lack its end."""
        return self.ends + self.open

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            at = waiting.pop()
            if at.left is None:
                yield at.text
            else:
                waiting += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def _leaf(text: str) -> Rope | None:
    return Rope(len(text), text.count("\n"), text[-1] != "\n", 0, text) if text else None


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.chars + b.chars, a.ends + b.ends, b.open, max(a.height, b.height) + 1, "", a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node over trees whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def join(*parts: Rope | None) -> Rope | None:
    """The parts one after the other; None is the empty rope. Takes time in the difference of heights."""
    whole = None
    for part in parts:
        whole = _join(whole, part)
    return whole


def _join(a: Rope | None, b: Rope | None) -> Rope | None:
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _balanced(a.left, _join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(_join(a, b.left), b.right)
    return _node(a, b)


def build(text: str, leaf: int = LEAF) -> Rope | None:
    """A balanced rope over ``text``, built level by level."""
    level = [_leaf(text[k : k + leaf]) for k in range(0, len(text), leaf)]
    while len(level) > 1:
        level = [_join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def _after_end(text: str, rank: int) -> int:
    at = 0
    for _ in range(rank):
        at = text.index("\n", at) + 1
    return at


def _split(rope: Rope | None, rank: int, by: str) -> tuple[Rope | None, Rope | None]:
    """Cut right behind the ``rank``-th code point or line end, found by the counts of the nodes."""
    if rope is None or rank <= 0:
        return None, rope
    if rope.left is None:
        at = rank if by == "chars" else _after_end(rope.text, rank)
        return _leaf(rope.text[:at]), _leaf(rope.text[at:])
    before = getattr(rope.left, by)
    if rank <= before:
        a, b = _split(rope.left, rank, by)
        return a, _join(b, rope.right)
    a, b = _split(rope.right, rank - before, by)
    return _join(rope.left, a), b


def split_chars(rope: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The first ``rank`` code points, and the rest."""
    return (rope, None) if rope is None or rank >= rope.chars else _split(rope, rank, "chars")


def split_units(rope: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The first ``rank`` lines, and the rest."""
    return (rope, None) if rope is None or rank >= rope.units else _split(rope, rank, "ends")
