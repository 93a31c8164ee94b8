"""The parts of .docx and .xlsx files. Such a file is a zip of ten or more parts, mostly small, and ``zipfile`` spends more on each than its parser does.

Ordinary archives are read from their directory; parts that stay are copied as they lie there. All others (comments, encryption, 64-bit sizes, other
methods, odd names or whatever looks broken) go through ``zipfile``, which also names the error.
"""

from __future__ import annotations

import functools
import io
import struct
import zipfile
import zlib

_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
_PLACE = struct.Struct("<4s2xH2HxxxxxxxxLLHHHxxxxxxxxL")  # what of an entry tells whether it is ordinary, and where it lies
_CONTENT, _HEAD = struct.Struct("<10xH4xLLLH12xL"), struct.Struct("<4s2x2H16x2H")
_DATED = (1 << 5) | 1  # 1980-01-01


@functools.lru_cache(maxsize=64)
def _deflated(data: bytes) -> tuple[int, bytes]:
    """Checksum and compressed bytes; files of one writer have parts in common. A window no longer than a small part is set up in a fraction of the time."""
    bits = max(9, min(15, len(data).bit_length()))
    packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -bits, max(1, min(8, bits - 7)))
    return zlib.crc32(data), packer.compress(data) + packer.flush()


def _written(entries: list[tuple]) -> bytes:
    """The archive of (the directory's fields from the version to the date, checksum, packed bytes, size, name, extra, comment, attributes)."""
    out, directory, at = [], [], 0
    for (made, need, flags, method, time, date), crc, raw, size, name, extra, comment, attributes in entries:
        head = _LOCAL.pack(b"PK\3\4", need, flags, method, time, date, crc, len(raw), size, len(name), len(extra))
        directory += [_ENTRY.pack(b"PK\1\2", made, need, flags, method, time, date, crc, len(raw), size, len(name), len(extra), len(comment), 0, *attributes, at), name, extra, comment]
        out += [head, name, extra, raw]
        at += len(head) + len(name) + len(extra) + len(raw)
    listed = b"".join(directory)
    return b"".join([*out, listed, _END.pack(b"PK\5\6", 0, 0, len(entries), len(entries), len(listed), at, 0)])


def zipped(parts: dict[str, bytes]) -> bytes:
    """A new archive; all parts have the same date."""
    if len(parts) >= 0xFFFF or sum(map(len, parts.values())) >= 1 << 31 or not all(n.isascii() for n in parts):
        to = io.BytesIO()
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in parts.items():
                z.writestr(name, data)
        return to.getvalue()
    return _written([((0x314, 20, 0, 8, 0, _DATED), *_deflated(data), len(data), name.encode(), b"", b"", (0, 0o600 << 16)) for name, data in parts.items()])


class Archive:
    """The parts of a file by name."""

    def __init__(self, data: bytes):
        self.data, self.entries, self.zip = data, {}, None
        if not self._directory():
            self.entries, self.zip = {}, zipfile.ZipFile(io.BytesIO(data))

    def _directory(self) -> bool:
        data, to = self.data, len(self.data) - _END.size
        if to < 0:
            return False
        sign, disk, first, here, n, size, start, comment = _END.unpack_from(data, to)
        if sign != b"PK\5\6" or disk or first or here != n or n == 0xFFFF or comment or start + size != to:
            return False
        at, before, found = start, -1, []
        for _ in range(n):
            if at + _ENTRY.size > to:
                return False
            sign, need, flags, method, packed, size, n_name, n_extra, n_comment, offset = _PLACE.unpack_from(data, at)
            raw = data[at + _ENTRY.size : at + _ENTRY.size + n_name]
            # parts lie one behind the other
            if sign != b"PK\1\2" or need > 20 or flags & ~0x80E or method & ~8 or (packed | size) >> 31 or not before < offset < start or not raw.isascii():
                return False
            found.append((raw.decode(), at, offset))
            at, before = at + _ENTRY.size + n_name + n_extra + n_comment, offset
        limits = [*(offset for _, _, offset in found[1:]), start]
        self.entries = {name: (at, limit) for (name, at, _), limit in zip(found, limits)}
        return at == to and len(self.entries) == n and not any("\0" in x or "\\" in x for x in self.entries)

    def _entry(self, name: str) -> tuple:
        """(what ``_written`` takes without the packed bytes, the packed bytes as they lie in the archive); none of these if its own head isn't as the directory says."""
        data, (at, limit) = self.data, self.entries[name]
        _, made, need, flags, method, time, date, crc, packed, size, n_name, n_extra, n_comment, _, inner, outer, offset = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        raw, end = data[at : at + n_name], at + n_name + n_extra
        own = ((made, need, flags & ~8, method, time, date), crc, size, raw, data[at + n_name : end], data[end : end + n_comment], (inner, outer))
        if offset + _LOCAL.size > limit:
            return own, None
        sign, _, flags, same, _, _, _, _, _, n_name, n_extra = _LOCAL.unpack_from(data, offset)
        at = offset + _LOCAL.size + n_name
        to = at + n_extra + packed
        if sign != b"PK\3\4" or flags & ~0x80E or same != method or data[at - n_name : at] != raw or to > limit:
            return own, None
        return own, data[to - packed : to]

    def names(self) -> list[str]:
        return self.zip.namelist() if self.zip else list(self.entries)

    def read(self, name: str) -> bytes:
        if self.zip is None and name in self.entries:
            data, (at, limit) = self.data, self.entries[name]
            method, crc, packed, size, n_name, offset = _CONTENT.unpack_from(data, at)
            if offset + _LOCAL.size <= limit:
                sign, flags, same, local_name, n_extra = _HEAD.unpack_from(data, offset)
                place = offset + _LOCAL.size + local_name
                to = place + n_extra + packed
                if sign == b"PK\3\4" and not flags & ~0x80E and same == method and to <= limit and data[place - local_name : place] == data[at + _ENTRY.size : at + _ENTRY.size + n_name]:
                    found = data[to - packed : to]
                    try:
                        if method:
                            found = zlib.decompress(found, -15, max(1, min(size, 1 << 20)))
                    except zlib.error:
                        found = None
                    if found is not None and len(found) == size and zlib.crc32(found) == crc:
                        return found
        return (self.zip or zipfile.ZipFile(io.BytesIO(self.data))).read(name)

    def with_parts(self, new: dict[str, bytes]) -> bytes:
        """The archive with new contents of some parts, in the same order."""
        made = []
        for name in self.entries:
            (fields, crc, size, *rest), packed = self._entry(name)
            if name in new:
                made.append(((*fields[:3], 8, *fields[4:]), *_deflated(new[name]), len(new[name]), *rest))
            elif packed is not None:
                made.append((fields, crc, packed, size, *rest))
        if self.entries and len(made) == len(self.entries) and sum(len(x[2]) for x in made) < 1 << 31:
            return _written(made)
        to, of = io.BytesIO(), self.zip or zipfile.ZipFile(io.BytesIO(self.data))
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as target:
            for x in of.infolist():
                target.writestr(x, new[x.filename] if x.filename in new else of.read(x))
        return to.getvalue()
