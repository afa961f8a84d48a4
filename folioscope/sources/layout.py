"""The byte layout of page archives: what readers and the writer agree on."""

from __future__ import annotations

import io
import lzma
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

MAGIC, MAJOR, NONE32 = 0x044D495A, 5, 0xFFFFFFFF
HEADER = struct.Struct("<IHH16sIIQQQQIIQ")
REDIRECT, LINKTARGET, DELETED = 0xFFFF, 0xFFFE, 0xFFFD
KINDS = {REDIRECT: "redirect", LINKTARGET: "linktarget", DELETED: "deleted"}
RAW, XZ, ZSTD = (0, 1), 4, 5
WINDOW, LONGEST = 512, 1 << 20


class ArchiveError(ValueError):
    """Bytes that don't follow the layout."""


@dataclass(frozen=True)
class Header:
    major: int
    minor: int
    uuid: str
    entry_count: int
    cluster_count: int
    path_pos: int
    title_pos: int
    cluster_pos: int
    mime_pos: int
    main_page: int | None
    layout_page: int | None
    checksum_pos: int


def open_uri(path: str):
    """A seekable binary file, by path or URI."""
    if "://" not in path:
        return open(path, "rb")
    from ..session import file_system

    system, at = file_system(path)
    return system.open_input_file(at)


def read_at(f, start: int, size: int) -> bytes:
    """Exactly ``size`` bytes from ``start``."""
    f.seek(start)
    data = f.read(size)
    if len(data) < size:
        raise ArchiveError(f"{size} bytes at {start} go past the end")
    return data


def header(f) -> Header:
    magic, major, minor, uid, *rest = HEADER.unpack(read_at(f, 0, HEADER.size))
    if magic != MAGIC:
        raise ArchiveError("this is no page archive")
    if major != MAJOR:
        raise ArchiveError(f"version {major} is not supported")
    page = lambda v: None if v == NONE32 else v
    counts, positions = rest[:2], rest[2:6]
    if max(*positions, rest[8]) >= 1 << 63:
        raise ArchiveError("a position is too large")
    return Header(major, minor, str(uuid.UUID(bytes=uid)), *counts, *positions, page(rest[6]), page(rest[7]), rest[8])


def mime_list(f, h: Header) -> list[str]:
    """NUL-terminated strings up to an empty one, however long the list is."""
    size = 4096
    while True:
        f.seek(h.mime_pos)
        data = f.read(size)
        end = 0 if data[:1] == b"\0" else data.find(b"\0\0") + 1
        if end or data[:1] == b"\0":
            return [x.decode("utf-8", "replace") for x in data[:end].split(b"\0") if x]
        if len(data) < size or size > LONGEST:
            raise ArchiveError("the MIME list doesn't end")
        size *= 4


def pointers(f, start: int, first: int, count: int, width: int) -> list[int]:
    """``count`` numbers of ``width`` bytes from a pointer list."""
    data = read_at(f, start + first * width, count * width)
    return list(struct.unpack(f"<{count}{'Q' if width == 8 else 'I'}", data))


def entry(f, offset: int) -> dict:
    """A directory entry: type, kind, namespace, path, title, cluster_id, blob_id, redirect_id."""
    f.seek(offset)
    window = f.read(WINDOW)
    if len(window) < 2:
        raise ArchiveError("the entry lies past the end")
    kind_id = int.from_bytes(window[:2], "little")
    out = {"type": kind_id, "kind": KINDS.get(kind_id, "content"), "namespace": None, "path": None, "title": None, "cluster_id": None, "blob_id": None, "redirect_id": None}
    if kind_id in (LINKTARGET, DELETED):
        return out
    at = 12 if kind_id == REDIRECT else 16
    size = WINDOW
    while True:
        first = window.find(b"\0", at)
        second = window.find(b"\0", first + 1) if first >= 0 else -1
        if second >= 0:
            break
        if len(window) < size:
            raise ArchiveError("the entry is cut off")
        if size > LONGEST:
            raise ArchiveError("the entry's path and title don't end")
        size *= 4
        f.seek(offset)
        window = f.read(size)
    out["namespace"] = chr(window[3])
    if kind_id == REDIRECT:
        out["redirect_id"] = int.from_bytes(window[8:12], "little")
    else:
        out["cluster_id"], out["blob_id"] = struct.unpack("<II", window[8:16])
    out["path"] = window[at:first].decode("utf-8", "replace")
    out["title"] = window[first + 1 : second].decode("utf-8", "replace")
    return out


def full_path(e: dict) -> str | None:
    return None if e["path"] is None else f"{e['namespace']}/{e['path']}"


def cluster_ends(starts: list[int], all_starts: list[int], h: Header) -> list[int]:
    """Where each cluster's bytes end (the last one's included): before the next larger start, or the checksum."""
    order = sorted({*all_starts, h.checksum_pos})
    after = dict(zip(order, order[1:]))
    return [after.get(s, h.checksum_pos) - 1 for s in starts]


def unpack_cluster(data: bytes, zstd: bool = False) -> list[bytes]:
    """The blobs of a cluster."""
    kind = data[0]
    if kind in RAW:
        payload = data[1:]
    elif kind == XZ:
        try:
            payload = lzma.LZMADecompressor(lzma.FORMAT_XZ).decompress(data[1:])
        except (lzma.LZMAError, EOFError) as e:
            raise ArchiveError(f"xz: {e}") from e
    elif kind == ZSTD and zstd:
        import zstandard

        payload = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[1:])).read()
    else:
        raise ArchiveError(f"compression {kind} is not supported")
    if len(payload) < 4:
        raise ArchiveError("the cluster is cut off")
    n = int.from_bytes(payload[:4], "little") // 4
    if n < 1 or len(payload) < 4 * n:
        raise ArchiveError("the cluster's offsets are cut off")
    offsets = struct.unpack(f"<{n}I", payload[: 4 * n])
    if any(a > b for a, b in zip(offsets, offsets[1:])) or offsets[-1] > len(payload):
        raise ArchiveError("the cluster's offsets are out of range")
    return [payload[a:b] for a, b in zip(offsets, offsets[1:])]


def pack_cluster(blobs: list[bytes], compression: int) -> bytes:
    at = 4 * (len(blobs) + 1)
    offsets = [at]
    for b in blobs:
        at += len(b)
        offsets.append(at)
    payload = struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(blobs)
    return bytes([compression]) + (lzma.compress(payload, preset=1) if compression == XZ else payload)


def build(entries: list[dict], mimes: list[str], clusters: list[bytes], main_page: int | None = None, uid: str | None = None, major: int = MAJOR) -> bytes:
    """A whole archive. Entries (type, namespace, path, title, cluster_id, blob_id, redirect_id) come sorted by full path bytes."""
    mime = b"".join(m.encode() + b"\0" for m in mimes) + b"\0"
    at = HEADER.size + len(mime)
    path_pos = at
    at += 8 * len(entries)
    raw = lambda x: x if isinstance(x, bytes) else (x or "").encode()
    titles = sorted(range(len(entries)), key=lambda i: (raw(entries[i].get("title")), i))
    title_pos = at
    at += 4 * len(entries)
    cluster_pos = at
    at += 8 * len(clusters)
    starts = []
    for c in clusters:
        starts.append(at)
        at += len(c)
    offsets, dirents = [], []
    checksum = at
    at += 16
    for e in entries:
        offsets.append(at)
        ns = ord(e.get("namespace") or "-")
        d = struct.pack("<HBBI", e["type"], 0, ns, 0)
        if e["type"] == REDIRECT:
            d += struct.pack("<I", e["redirect_id"])
        elif e["type"] not in (LINKTARGET, DELETED):
            d += struct.pack("<II", e["cluster_id"], e["blob_id"])
        if e["type"] not in (LINKTARGET, DELETED):
            d += raw(e["path"]) + b"\0" + raw(e["title"]) + b"\0"
        dirents.append(d)
        at += len(d)
    uid_bytes = uuid.UUID(uid).bytes if uid else bytes(16)
    head = HEADER.pack(MAGIC, major, 0, uid_bytes, len(entries), len(clusters), path_pos, title_pos, cluster_pos, HEADER.size, NONE32 if main_page is None else main_page, NONE32, checksum)
    lists = struct.pack(f"<{len(offsets)}Q", *offsets) + struct.pack(f"<{len(titles)}I", *titles) + struct.pack(f"<{len(starts)}Q", *starts)
    return head + mime + lists + b"".join(clusters) + bytes(16) + b"".join(dirents)


def search_path(f, h: Header, wanted: bytes, right: bool = False) -> int:
    """Where a full path would stand in the path list: entries before it, or up to and with it. Entries without a path sort first."""
    lo, hi = 0, h.entry_count
    while lo < hi:
        mid = (lo + hi) // 2
        e = entry(f, pointers(f, h.path_pos, mid, 1, 8)[0])
        p = (full_path(e) or "").encode()
        if p < wanted or (right and (p == wanted or p.startswith(wanted))):
            lo = mid + 1
        else:
            hi = mid
    return lo


def ranges(total: int, size: int, low: int = 0) -> Iterator[tuple[int, int]]:
    for at in range(low, total, size):
        yield at, min(at + size, total)
