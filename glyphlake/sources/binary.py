"""Table functions over media bytes: one row per chunk, segment, box or frame.

Walkers stop at the first part that does not fit and say so in ``note``.
"""

from __future__ import annotations

import struct
from collections.abc import Generator, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "seq int, offset long, kind string, payload binary, parent string, note string"
Part = tuple[int, int, str, bytes, str, str | None]
CONTAINERS = {"moov", "udta", "trak", "mdia", "minf", "stbl", "ilst", "dinf", "edts", "moof", "traf", "mvex", "mfra", "iprp", "ipco", "meta"}
#: Containers that have a version and flags before their boxes.
FULL_BOXES = {"meta"}
#: Most directories of a TIFF file that are followed, and most entries of one that are read.
MAX_DIRECTORIES, MAX_ENTRIES = 4096, 4096


def png_chunks(data: bytes) -> Iterator[Part]:
    at, seq = 8, 0
    while data[:8] == b"\x89PNG\r\n\x1a\n" and at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        whole = at + 12 + size <= len(data)
        yield seq, at, kind.decode("latin-1"), data[at + 8 : at + 8 + size], "", None if whole else "truncated chunk"
        if not whole or kind == b"IEND":
            return
        at, seq = at + 12 + size, seq + 1


def jpeg_segments(data: bytes, start: int = 0) -> Generator[Part, None, int]:
    """Segments up to the image data; bytes between segments are passed over.  Returns where the walk ends."""
    at, seq = start + 2, 0
    while data[start : start + 2] == b"\xff\xd8" and (at := data.find(b"\xff", at)) >= 0:
        here = at
        while data[at : at + 1] == b"\xff":
            at += 1
        if at >= len(data):
            break
        marker, at = data[at], at + 1
        if marker in (0xD9, 0xDA):
            yield seq, here, f"{marker:02X}", b"", "", None
            seq += 1
            if marker == 0xDA:
                return at
        elif not 0xD0 <= marker <= 0xD8:
            if at + 2 > len(data):
                break
            size = struct.unpack_from(">H", data, at)[0]
            good = size >= 2 and at + size <= len(data)
            yield seq, here, f"{marker:02X}", data[at + 2 : at + size] if good else b"", "", None if good else "bad segment length"
            if not good:
                return at
            at, seq = at + size, seq + 1
    return len(data)


def _sub_blocks(data: bytes, at: int) -> tuple[int, bytes, bool]:
    """Where a chain of GIF sub-blocks ends, what they hold, and whether the chain is whole."""
    parts = []
    while at < len(data):
        size, at = data[at], at + 1
        if not size:
            return at, b"".join(parts), True
        if at + size > len(data):
            break
        parts.append(data[at : at + size])
        at += size
    return at, b"".join(parts), False


def gif_blocks(data: bytes) -> Iterator[Part]:
    """Images and extensions (comment, application, or the label's number); a cut one is noted, and the walk goes on behind the cut."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        yield 0, 0, "header", b"", "", "not a GIF"
        return
    if len(data) < 13:
        yield 0, 0, "header", b"", "", "truncated GIF header"
        return
    palette = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    at, seq = 13 + palette(data[10]), 0
    while at < len(data) and data[at] != 0x3B:
        start, mark = at, data[at]
        if mark not in (0x2C, 0x21):
            at += 1
            continue
        kind, payload, whole = "image", b"", False
        if mark == 0x2C:
            if at + 10 <= len(data):
                at += 10 + palette(data[at + 9]) + 1
                if at <= len(data):
                    at, payload, whole = _sub_blocks(data, at)
            else:
                at = len(data)
        elif at + 2 <= len(data):
            kind = {0xFE: "comment", 0xFF: "application"}.get(data[at + 1], f"{data[at + 1]:02X}")
            at, payload, whole = _sub_blocks(data, at + 2)
        else:
            kind, at = "extension", len(data)
        yield seq, start, kind, payload if whole else b"", "", None if whole else f"truncated GIF {'image block' if mark == 0x2C else 'extension'}"
        seq += 1


# Bytes of each TIFF field type; others count as one byte.
_TIFF_SIZES = {3: 2, 8: 2, 4: 4, 9: 4, 5: 8, 10: 8, 12: 8, 11: 4}
_TIFF_DIRECTORIES = {34665, 34853, 40965}


def tiff_entries(data: bytes) -> Iterator[Part]:
    """Entries of all directories, breadth first, in both byte orders and both sizes; kind is the tag, payload the declared value, parent the directory's offset."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(order + "H", data, 2)[0] if order and len(data) >= 4 else 0
    if version not in (42, 43):
        yield 0, 0, "", b"", "", "not a TIFF"
        return
    big = version == 43
    count_of, offset_of, entry_size, start = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 4)
    counted, pointer = struct.calcsize(count_of), struct.calcsize(order + offset_of)
    read = lambda what, at: struct.unpack_from(order + what, data, at)[0] if 0 <= at <= len(data) - struct.calcsize(order + what) else 0
    first = read(offset_of, start)
    if not first or first + counted > len(data):
        yield 0, 0, "", b"", "", "TIFF with no image file directories"
        return
    queue, seen, seq = [first], set(), 0
    while queue and len(seen) < MAX_DIRECTORIES:
        at = queue.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        if at + counted > len(data):
            continue
        declared = read(count_of, at)
        for i in range(min(declared, MAX_ENTRIES)):
            entry = at + counted + i * entry_size
            if entry + entry_size > len(data):
                break
            tag, kind = struct.unpack_from(order + "HH", data, entry)
            number, field = read(offset_of, entry + 4), entry + 4 + pointer
            size, inline = number * _TIFF_SIZES.get(kind, 1), data[field : field + pointer]
            where = read(offset_of, field)
            value = inline[:size] if size <= pointer else data[where : where + size] if where + size <= len(data) else b""
            yield seq, entry, str(tag), value, str(at), None
            seq += 1
            if tag in _TIFF_DIRECTORIES:
                own = inline if size <= pointer else value
                if len(own) >= pointer or size <= pointer:
                    queue.append(struct.unpack(order + offset_of, own[:pointer])[0])
        queue.append(read(offset_of, at + counted + declared * entry_size))


def riff_chunks(data: bytes) -> Iterator[Part]:
    at, seq = 12, 0
    form = data[8:12].decode("latin-1")
    while data[:4] == b"RIFF" and at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        whole = at + 8 + size <= len(data)
        yield seq, at, kind.decode("latin-1"), data[at + 8 : at + 8 + size], form, None if whole else "truncated chunk"
        if not whole:
            return
        at, seq = at + 8 + size + size % 2, seq + 1


def bmff_boxes(data: bytes) -> Iterator[Part]:
    """Boxes depth first; parent is the path of containers."""
    stack, seq = [(0, len(data), "")], 0
    while stack:
        at, end, parent = stack.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        good = head <= size <= end - at
        name = kind.decode("latin-1")
        yield seq, at, name, data[at + head : at + size] if good else b"", parent, None if good else "truncated"
        seq += 1
        if good:
            stack.append((at + size, end, parent))
            if name in CONTAINERS:
                stack.append((at + head + 4 * (name in FULL_BOXES), at + size, f"{parent}/{name}"))


def id3_frames(data: bytes) -> Iterator[Part]:
    if data[:3] != b"ID3" or len(data) < 10:
        return
    version, flags = data[3], data[5]
    synchsafe = lambda b: sum((x & 0x7F) << 7 * (len(b) - 1 - i) for i, x in enumerate(b))
    end, at, seq = min(len(data), 10 + synchsafe(data[6:10])), 10, 0
    if flags & 0x40 and version >= 3 and end >= 14:
        at += synchsafe(data[10:14]) if version == 4 else 4 + struct.unpack_from(">I", data, 10)[0]
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= end and data[at]:
        raw = data[at + name : at + 2 * name]
        size = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        good = at + head + size <= end
        yield seq, at, data[at : at + name].decode("latin-1"), data[at + head : min(at + head + size, end)], f"2.{version}", None if good else "truncated"
        if not good:
            return
        at, seq = at + head + size, seq + 1


WALKERS = {f.__name__: f for f in (png_chunks, jpeg_segments, gif_blocks, tiff_entries, riff_chunks, bmff_boxes, id3_frames)}


def register_walkers(spark: SparkSession) -> None:
    """Registers each walker as a SQL table function of a binary value, for use with LATERAL."""
    for name, walk in WALKERS.items():

        class Walker:
            walker = staticmethod(walk)

            def eval(self, content: bytes):
                if content is not None:
                    yield from self.walker(bytes(content))

        spark.udtf.register(name, udtf(Walker, returnType=SCHEMA))
