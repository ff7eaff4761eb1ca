"""Tagged records of changes to the set of live runs, as manifests hold them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from tidemark.functions.codec import Damage, get_uvarint, put_uvarint, readable

# Tags of the fields of an edit.
COMPARATOR, LOG_NUMBER, NEXT_FILE, LAST_SEQ, DELETED, NEW = 1, 2, 3, 4, 5, 6


class UnknownEdit(ValueError):
    """A record that isn't whole, or has a tag that isn't known: tags don't say how long their fields are, so none is skipped."""


@dataclass
class Edit:
    """Fields that are None are not part of the edit."""

    comparator: bytes | None = None
    log_number: int | None = None
    next_file: int | None = None
    last_seq: int | None = None
    #: (level, number)
    deleted: list[tuple[int, int]] = field(default_factory=list)
    #: (level, number, size, smallest, largest)
    new: list[tuple[int, int, int, bytes, bytes]] = field(default_factory=list)

    def encode(self) -> bytes:
        def text(data: bytes) -> bytes:
            return put_uvarint(len(data)) + data

        out = b"" if self.comparator is None else put_uvarint(COMPARATOR) + text(self.comparator)
        for tag, value in ((LOG_NUMBER, self.log_number), (NEXT_FILE, self.next_file), (LAST_SEQ, self.last_seq)):
            out += b"" if value is None else put_uvarint(tag) + put_uvarint(value)
        for level, number in self.deleted:
            out += put_uvarint(DELETED) + put_uvarint(level) + put_uvarint(number)
        for level, number, size, smallest, largest in self.new:
            out += b"".join(map(put_uvarint, (NEW, level, number, size))) + text(smallest) + text(largest)
        return out


def decode(data: bytes) -> Edit:
    at, edit = 0, Edit()

    def number() -> int:
        nonlocal at
        try:
            value, at = get_uvarint(data, at)
        except ValueError as e:
            raise UnknownEdit(str(e)) from e
        return value

    def text() -> bytes:
        nonlocal at
        size = number()
        if at + size > len(data):
            raise UnknownEdit("cut off")
        at += size
        return data[at - size : at]

    read: dict[int, Callable[[], None]] = {
        COMPARATOR: lambda: setattr(edit, "comparator", text()),
        LOG_NUMBER: lambda: setattr(edit, "log_number", number()),
        NEXT_FILE: lambda: setattr(edit, "next_file", number()),
        LAST_SEQ: lambda: setattr(edit, "last_seq", number()),
        DELETED: lambda: edit.deleted.append((number(), number())),
        NEW: lambda: edit.new.append((number(), number(), number(), text(), text())),
    }
    while at < len(data):
        tag = number()
        if tag not in read:
            raise UnknownEdit(f"tag {tag}")
        read[tag]()
    return edit


def decode_manifest(log: bytes) -> list[Edit]:
    """All edits of a framed manifest. Unlike a log of writes, a damaged manifest is refused as a whole: what is left of it
    would name the wrong runs."""
    records, status = readable(log)
    if status != "ok":
        raise Damage(status)
    return [decode(r) for r in records]
