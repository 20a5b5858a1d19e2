"""Pages of tables and indexes as bytes: what a page image holds, and images for tests."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from tessera.functions.lsn import PAGE

#: Fixed values of the format: header and line pointer sizes, the flag of a page all of whose rows all
#: can see, states of a line pointer, bits of a row's header, the special part of an index page.
HEADER, POINTER, ALL_VISIBLE = 24, 4, 0x0004
UNUSED, NORMAL, REDIRECT, DEAD = range(4)
XMIN_FROZEN, XMAX_INVALID = 0x0300, 0x0800
SPECIAL, LEAF, NOBODY = 16, 0x0001, 0xFFFFFFFF
ROW_HEADER, ENTRY_HEADER, ENTRY_SIZE = 24, 8, 0x1FFF
FROZEN = 2


@dataclass
class Item:
    """What a line pointer stands for: a row or index entry, a redirect, or a dead place."""

    state: int = NORMAL
    data: bytes | None = None
    xmin: int = 0
    xmax: int = 0
    cid: int = 0
    target: int = 0
    lsn: int = 0


@dataclass
class Page:
    """A block's items by their number from 1 on; level and siblings are an index page's."""

    items: dict[int, Item] = field(default_factory=dict)
    all_visible: bool = False
    level: int | None = None
    leaf: bool | None = None
    before: int | None = None
    after: int | None = None
    lsn: int = 0

    def place(self, number: int, item: Item) -> None:
        """Puts an entry before those from `number` on, which move up by one."""
        for k in sorted((k for k in self.items if k >= number), reverse=True):
            self.items[k + 1] = self.items.pop(k)
        self.items[number] = item


def row_item(data: bytes, lsn: int) -> Item:
    """A stored row, with the transactions that its header names."""
    if len(data) < ROW_HEADER:
        return Item(NORMAL, data, lsn=lsn)
    xmin, xmax, cid, _, _, _, mask = struct.unpack_from("<IIIIHHH", data)
    frozen, alive = mask & XMIN_FROZEN == XMIN_FROZEN, mask & XMAX_INVALID
    return Item(NORMAL, data, FROZEN if frozen else xmin, 0 if alive else xmax, cid, lsn=lsn)


def parsed(image: bytes, lsn: int) -> Page:
    """The page that an image shows. Bytes that are no page have no items."""
    page = Page(lsn=lsn)
    if len(image) < HEADER:
        return page
    flags, lower, _, special = struct.unpack_from("<HHHH", image, 10)
    page.all_visible = bool(flags & ALL_VISIBLE)
    index = HEADER < special <= len(image) - SPECIAL
    if index:
        before, after, page.level, marks = struct.unpack_from("<IIIH", image, special)
        page.leaf = bool(marks & LEAF)
        page.before, page.after = (None if x == NOBODY else x for x in (before, after))
    for number in range(1, (min(lower, len(image)) - HEADER) // POINTER + 1):
        (pointer,) = struct.unpack_from("<I", image, HEADER + (number - 1) * POINTER)
        at, state, size = pointer & 0x7FFF, pointer >> 15 & 3, pointer >> 17
        if state == NORMAL:
            data = image[at : at + size]
            page.items[number] = Item(NORMAL, data, lsn=lsn) if index else row_item(data, lsn)
        elif state != UNUSED:
            page.items[number] = Item(state, target=at if state == REDIRECT else 0, lsn=lsn)
    return page


def row(xmin: int, data: bytes, xmax: int = 0, cid: int = 0, mask: int = 0) -> bytes:
    """A row as it is stored."""
    return struct.pack("<IIIIHHHBx", xmin, xmax, cid, 0, 0, 0, mask, ROW_HEADER) + data


def entry(data: bytes, block: int = 0, number: int = 0) -> bytes:
    """An index entry as it is stored: where its row is, its size, its key."""
    return struct.pack("<IHH", block, number, ENTRY_HEADER + len(data)) + data


def image_of(items: list[bytes | int | None], *, level: int | None = None, before: int | None = None, after: int | None = None, flags: int = 0) -> bytes:
    """A page with these items: bytes for a row or an entry, a number for a redirect, None for a dead
    place. With a level it is an index page."""
    special = PAGE if level is None else PAGE - SPECIAL
    at, pointers, body = special, [], []
    for x in items:
        if isinstance(x, bytes):
            at -= len(x)
            body.insert(0, x)
            pointers.append(at | NORMAL << 15 | len(x) << 17)
        else:
            pointers.append(DEAD << 15 if x is None else x | REDIRECT << 15)
    lower = HEADER + POINTER * len(pointers)
    head = struct.pack("<QHHHHHHI", 0, 0, flags, lower, at, special, PAGE, 0)
    tail = b"" if level is None else struct.pack("<IIIHH", NOBODY if before is None else before, NOBODY if after is None else after, level, LEAF if level == 0 else 0, 0)
    return (head + struct.pack(f"<{len(pointers)}I", *pointers)).ljust(at, b"\0") + b"".join(body) + tail
