"""Files and the pieces of them that tasks read."""

from __future__ import annotations

import glob
import gzip
import io
import os
import struct
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow.fs as pafs

SPLIT_BYTES = 128 << 20
#: Gzip whose blocks can be read each on its own.
BLOCKS = "blocks"
#: The first bytes of compressed files.
_MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bz2", b"\xfd7zXZ": "xz", b"\x28\xb5\x2f\xfd": "zstd"}


@dataclass(frozen=True)
class Split:
    """Bytes ``start`` to ``stop`` of a file; ``number`` counts the splits of a file."""

    path: str
    number: int
    start: int
    stop: int
    compression: str


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def expand(paths: str | Iterable[str]) -> list[str]:
    """Files named by paths, folders and local patterns, in order."""
    found: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        if "://" not in path and any(c in path for c in "*?["):
            found += sorted(glob.glob(path))
            continue
        fs, inner = filesystem(path)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            prefix = path.split("://")[0] + "://" if "://" in path else ""
            found += sorted(prefix + f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        elif info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        else:
            found.append(path)
    return found


def head(path: str, size: int = 64) -> bytes:
    fs, inner = filesystem(path)
    with fs.open_input_stream(inner, compression=None) as stream:
        return stream.read(size)


def compression_of(path: str) -> str:
    """By content, not by name."""
    first = head(path, 8)
    return next((name for magic, name in _MAGIC.items() if first.startswith(magic)), "")


def open_binary(path: str, compression: str) -> io.BufferedIOBase:
    """The decompressed bytes of a file."""
    fs, inner = filesystem(path)
    raw = fs.open_input_file(inner)
    if compression in ("gzip", BLOCKS):
        return gzip.GzipFile(fileobj=raw)
    if compression == "bz2":
        import bz2

        return bz2.BZ2File(raw)
    if compression == "xz":
        import lzma

        return lzma.LZMAFile(raw)
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def block_size(data: bytes, at: int = 0) -> int | None:
    """Bytes of the compressed block that begins at a place, or None if none does."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or at + 18 > len(data):
        return None
    extra, field = struct.unpack_from("<H", data, at + 10)[0], at + 12
    while field + 6 <= at + 12 + extra and field + 6 <= len(data):
        size = struct.unpack_from("<H", data, field + 2)[0]
        if data[field : field + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def plan(paths: str | Iterable[str], split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """Splits of plain files and of files of compressed blocks, and other compressed files whole."""
    found = []
    for path in expand(paths):
        fs, inner = filesystem(path)
        size, kind = fs.get_file_info(inner).size, compression_of(path)
        if kind == "gzip" and block_size(head(path)):
            kind = BLOCKS
        step = split_bytes if kind in ("", BLOCKS) else max(size, 1)
        for number, start in enumerate(range(0, max(size, 1), step)):
            found.append(Split(path, number, start, min(size, start + step), kind))
    return found
