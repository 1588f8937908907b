"""TIFF directories of either byte order, with the directories below them, and the strict rules of a raw frame."""

from __future__ import annotations

from dataclasses import dataclass

#: Bytes of the value types 1 to 12, and of directory pointers (13).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
#: Tags whose values are offsets of directories.
POINTERS = (330, 34665, 34853)
#: Directories of a file, at most: more are a loop.
MOST_DIRECTORIES = 64


class Broken(ValueError):
    """A file that is no TIFF, or none that can be read."""


@dataclass(frozen=True)
class Tag:
    """Type, number of values, and their bytes in the file's order; ``at`` is where they stand."""

    kind: int
    count: int
    raw: bytes
    at: int


@dataclass(frozen=True)
class Tiff:
    """Byte order and directories, the first one first; ``end`` is where the last byte of any of them ends."""

    order: str
    directories: list[dict[int, Tag]]
    end: int

    def numbers(self, tag: int) -> list[int] | None:
        """Whole-number values of a tag, in the first directory that has it."""
        for d in self.directories:
            if tag in d and d[tag].kind in (1, 3, 4, 13):
                size, raw = SIZES[d[tag].kind], d[tag].raw
                return [int.from_bytes(raw[i : i + size], self.order) for i in range(0, len(raw), size)]
        return None

    def number(self, tag: int) -> int | None:
        found = self.numbers(tag)
        return found[0] if found else None

    def text(self, tag: int) -> str | None:
        for d in self.directories:
            if tag in d and d[tag].kind == 2:
                return d[tag].raw.split(b"\0")[0].decode("latin-1")
        return None

    def raw(self, tag: int) -> bytes | None:
        return next((d[tag].raw for d in self.directories if tag in d), None)

    def ratio(self, tag: int) -> tuple[int, int] | None:
        """A rational's numerator and denominator."""
        for d in self.directories:
            if tag in d and d[tag].kind in (5, 10) and d[tag].count:
                signed = d[tag].kind == 10
                return tuple(int.from_bytes(d[tag].raw[i : i + 4], self.order, signed=signed) for i in (0, 4))  # type: ignore[return-value]
        return None


def read(data: bytes) -> Tiff:
    """All directories of a file, whatever its pixels are; raises ``Broken``."""
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(data[:4])
    if order is None or len(data) < 8:
        raise Broken("not a TIFF")

    def whole(at: int, size: int) -> int:
        if at + size > len(data):
            raise Broken(f"byte {at} is outside the file")
        return int.from_bytes(data[at : at + size], order)

    todo, seen, found, end = [whole(4, 4)], set(), [], 8
    while todo:
        at = todo.pop(0)
        if at in seen or len(found) >= MOST_DIRECTORIES:
            raise Broken(f"directory {at} is met again")
        seen.add(at)
        tags: dict[int, Tag] = {}
        count = whole(at, 2)
        end = max(end, at + 6 + 12 * count)
        for i in range(count):
            entry = at + 2 + 12 * i
            tag, kind, n = whole(entry, 2), whole(entry + 2, 2), whole(entry + 4, 4)
            size = SIZES.get(kind, 0) * n
            start = entry + 8 if size <= 4 else whole(entry + 8, 4)
            if start + size > len(data):
                raise Broken(f"tag {tag} points outside the file")
            tags[tag] = Tag(kind, n, data[start : start + size], start)
            end = max(end, start + size if size > 4 else end)
            if tag in POINTERS or kind == 13:
                todo += [p for j in range(n) if (p := int.from_bytes(tags[tag].raw[4 * j : 4 * j + 4], order))]
        found.append(tags)
    return Tiff(order, found, end)


#: Tags that a raw frame needs, by name.
NEEDED = {
    256: "width",
    257: "height",
    258: "bits",
    259: "compression",
    262: "photometric",
    273: "strip_offset",
    277: "samples",
    279: "strip_bytes",
}
#: Bytes that a strip may be padded with.
MOST_PADDING = 64


def raw_frame(data: bytes) -> dict[str, int]:
    """Numbers of an uncompressed single-strip mosaic frame; raises ``Broken`` for any other file, naming the first rule broken."""
    t = read(data)
    top = t.directories[0]
    first = Tiff(t.order, [top], t.end)
    if t.order != "little":
        raise Broken("big-endian")
    if 322 in top or 323 in top:
        raise Broken("tiled")
    f: dict[str, int] = {}
    for tag, name in NEEDED.items():
        value = first.number(tag)
        if value is None:
            raise Broken(f"no {name}")
        f[name] = value
    rows = first.number(278)
    rules = (
        (rows is not None and rows != f["height"], "rows per strip"),
        (f["compression"] != 1, "compressed"),
        (f["photometric"] != 32803, "no mosaic"),
        (f["samples"] != 1, "samples"),
        (f["bits"] not in (8, 10, 12), "depth"),
        (top[279].count != 1, "strips"),
        (f["bits"] == 12 and f["width"] * f["height"] % 2 == 1, "odd pixel count"),
        (f["bits"] == 10 and f["width"] % 4 != 0, "width"),
    )
    for broken, what in rules:
        if broken:
            raise Broken(what)
    pad = f["strip_bytes"] - f["width"] * f["height"] * f["bits"] // 8
    if not 0 <= pad <= MOST_PADDING or (f["bits"] == 12 and pad % 3):
        raise Broken("strip length")
    end = f["strip_offset"] + f["strip_bytes"]
    if end > len(data):
        raise Broken("strip outside the file")
    if t.end > f["strip_offset"]:
        raise Broken("metadata in the strip")
    if data[end:].strip(b"\0"):
        raise Broken("tail")
    return f


def write(directories: list[list[tuple[int, int, list]]], order: str = "little", payload: bytes = b"") -> bytes:
    """A file of directories of (tag, type, values), each but the first named by tag 330 of the first; tag 273 gets the payload's place.

    For fixtures and small sidecars; not a container writer for frames.
    """
    top = [t for t in directories[0] if t[0] != 330] + ([(330, 4, [0] * (len(directories) - 1))] if len(directories) > 1 else [])
    tables = [sorted(d) for d in [top, *directories[1:]]]

    def encode(kind: int, values: list) -> bytes:
        if kind in (1, 2, 7):
            return bytes(values)
        if kind in (5, 10):
            return b"".join(int(x).to_bytes(4, order, signed=kind == 10) for pair in values for x in pair)
        return b"".join(int(v).to_bytes(SIZES[kind], order) for v in values)

    starts, at = [], 8
    for d in tables:
        starts.append(at)
        at += 2 + 12 * len(d) + 4 + sum(len(e) + len(e) % 2 for _, k, v in d if len(e := encode(k, v)) > 4)
    out = bytearray(b"II*\0" if order == "little" else b"MM\0*") + starts[0].to_bytes(4, order)
    for d, start in zip(tables, starts, strict=True):
        far, extra = start + 2 + 12 * len(d) + 4, bytearray()
        out += len(d).to_bytes(2, order)
        for tag, kind, values in d:
            values = starts[1:] if tag == 330 else [at] if tag == 273 else values
            raw = encode(kind, values)
            out += tag.to_bytes(2, order) + kind.to_bytes(2, order) + len(values).to_bytes(4, order)
            if len(raw) <= 4:
                out += raw.ljust(4, b"\0")
            else:
                out += (far + len(extra)).to_bytes(4, order)
                extra += raw + b"\0" * (len(raw) % 2)
        out += b"\0" * 4 + extra
    return bytes(out) + payload
