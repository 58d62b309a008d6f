"""Boxes of ISO base media files, and a reader of their big-endian fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple


class Box(NamedTuple):
    type: str
    offset: int  # of the content within the file
    content: bytes


class Short(ValueError):
    """The data end before the field does."""


class Damaged(ValueError):
    """The file breaks a rule without which it can't be read."""


class Fields:
    """A cursor over bytes; reading past the end raises Short."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left:
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self, n: int) -> int:
        """An unsigned number of n bytes."""
        return int.from_bytes(self.take(n), "big")

    def s(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big", signed=True)

    def code(self) -> str:
        """Four characters, each byte one."""
        return self.take(4).decode("latin-1")

    def text(self, most: int = 4096) -> str:
        """Up to a zero byte or the end."""
        end = self.data.find(b"\0", self.at)
        raw = self.data[self.at : end if end >= 0 else len(self.data)]
        if len(raw) > most:
            raise Damaged("a string is too long")
        self.at = min(self.at + len(raw) + 1, len(self.data))
        return raw.decode("utf-8", "replace")

    def full(self) -> tuple[int, int]:
        """Version and flags."""
        x = self.u(4)
        return x >> 24, x & 0xFFFFFF


class Bits:
    """Numbers of any number of bits, the highest first."""

    def __init__(self, data: bytes):
        self.value, self.n, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def u(self, n: int) -> int:
        if self.at + n > self.n:
            raise Short
        self.at += n
        return self.value >> (self.n - self.at) & ((1 << n) - 1)


def boxes(data: bytes, offset: int = 0) -> Iterator[Box]:
    """The boxes that stand one behind the other in data, which begins at `offset` of the file. A header that can't be right ends them."""
    at = 0
    while at + 8 <= len(data):
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        kind = data[at + 4 : at + 8].decode("latin-1")
        if size == 1:
            if at + 16 > len(data):
                return
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            return
        yield Box(kind, offset + at + head, data[at + head : at + size])
        at += size


class Hole:
    """Content that was not read."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


def outline(read: Callable[[int, int], bytes], size: int, wanted: set[str]) -> Iterator[Box]:
    """boxes() of a file of some size, whose bytes read(at, n) gives: headers and the contents of wanted types alone."""
    at = 0
    while at + 8 <= size:
        head = read(at, min(16, size - at))
        n, begin, kind = int.from_bytes(head[:4], "big"), 8, head[4:8].decode("latin-1")
        if n == 1:
            if len(head) < 16:
                return
            n, begin = int.from_bytes(head[8:], "big"), 16
        elif n == 0:
            n = size - at
        if n < begin or at + n > size:
            return
        yield Box(kind, at + begin, read(at + begin, n - begin) if kind in wanted else Hole(n - begin))
        at += n


#: Boxes that hold boxes, and how many bytes stand before these.
HOLDERS = {"meta": 4, "iprp": 0, "ipco": 0, "iref": 4, "moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "tref": 0, "dinf": 0}


def box_tree(data: bytes) -> list[tuple[int, int | None, int, str, int, int]]:
    """(box_id, parent_id, depth, type, content_off, content_len) of all boxes, however deep, parents first."""
    out: list[tuple[int, int | None, int, str, int, int]] = []
    todo = [(boxes(data), None, 0)]
    while todo:
        level, parent, depth = todo[-1]
        if (b := next(level, None)) is None:
            todo.pop()
            continue
        out.append((len(out), parent, depth, b.type, b.offset, len(b.content)))
        skip = HOLDERS.get(b.type)
        if b.type == "iinf" and len(b.content) >= 6:
            skip = 6 if b.content[0] == 0 else 8
        if skip is not None:
            todo.append((boxes(b.content[skip:], b.offset + skip), out[-1][0], depth + 1))
    return out
