"""Local archives unpacked on the driver, by include and exclude patterns; exclusion wins. Executors find
what `unpacked` makes, as it goes to the shared folder."""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import os
import shutil
import tarfile
import tempfile
import zipfile

from .readers import BadRecord, UnsupportedFormat


def wanted(name: str, include: list[str] | None, exclude: list[str] | None) -> bool:
    hit = lambda patterns: any(fnmatch.fnmatch(name, p) or fnmatch.fnmatch(os.path.basename(name), p) for p in patterns)
    return not hit(exclude or []) and (include is None or hit(include))


def _inside(folder: str, name: str) -> str:
    """Where a member goes; one that would leave the folder is refused."""
    to = os.path.realpath(os.path.join(folder, name))
    if not to.startswith(os.path.realpath(folder) + os.sep):
        raise BadRecord(f"{name} leaves the folder")
    os.makedirs(os.path.dirname(to), exist_ok=True)
    return to


def uncompressed(data: bytes, most: int = 1 << 30) -> bytes:
    """What the old `compress` wrote: codes of 9 bits and more, least significant bit first, in groups of
    eight; a clear code starts the table anew. More than `most` bytes are refused."""
    if data[:2] != b"\x1f\x9d":
        raise BadRecord("not a .Z file")
    widest, clears = data[2] & 31, bool(data[2] & 128)
    roots = [bytes([i]) for i in range(256)]
    table, out, size = roots + [b""] * clears, [], 0
    at, width, before = 3, 9, None
    start, bit = at, 0  # of the run of codes of one width, which fills whole groups
    while 8 * start + bit + width <= 8 * len(data):
        byte = start + bit // 8
        code = int.from_bytes(data[byte : byte + 4], "little") >> bit % 8 & (1 << width) - 1
        bit += width
        if clears and code == 256:
            start, bit, width, table, before = start + -(-bit // (8 * width)) * width, 0, 9, roots + [b""], None
            continue
        if before is None:
            entry = table[code]
        else:
            if code > len(table):
                raise BadRecord("a code that is not in the table")
            entry = table[code] if code < len(table) else before + before[:1]
            if len(table) < 1 << widest:
                table.append(before + entry[:1])
        out.append(entry)
        before, size = entry, size + len(entry)
        if size > most:
            raise BadRecord(f"more than {most} bytes")
        if len(table) == 1 << width and width < widest:
            start, bit, width = start + -(-bit // (8 * width)) * width, 0, width + 1
    return b"".join(out)


def _members(t: tarfile.TarFile, folder: str, include: list[str] | None, exclude: list[str] | None) -> list[str]:
    found = []
    for m in t:
        if m.isfile() and wanted(m.name, include, exclude):
            with t.extractfile(m) as source, open(to := _inside(folder, m.name), "wb") as out:
                shutil.copyfileobj(source, out)
            found.append(to)
    return found


def unpacked(spark, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """As extract(), with the files in the shared folder, where executors find them; archives within an
    archive (.zip, .tar.Z) are unpacked too."""
    from ..session import put, scratch

    to, out = scratch(spark, "unpacked"), []
    with tempfile.TemporaryDirectory() as folder:
        waiting, n = [(path, os.path.join(folder, "0"))], 0
        while waiting:
            archive, where = waiting.pop()
            inner = (".zip", ".tar.Z", ".tar.gz", ".tar")
            for f in extract(archive, where, [*include, *[f"*{e}" for e in inner]] if include is not None else None, exclude):
                n += 1
                if f.endswith(inner):
                    waiting.append((f, os.path.join(folder, str(n))))
                else:
                    with open(f, "rb") as source:
                        out.append(put(spark, f"{to}/{n:04d}/{os.path.basename(f)}", source.read()))
    if not out:
        raise BadRecord(f"nothing in {path} is wanted")
    return sorted(out)


def extract(path: str, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Files of a zip, tar, gzip or bzip2 archive, sorted; any other file is passed on as it is."""
    os.makedirs(folder, exist_ok=True)
    found = []
    if path.endswith(".7z"):
        raise UnsupportedFormat("7z: no reader is installed here")
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            for m in z.infolist():
                if not m.is_dir() and wanted(m.filename, include, exclude):
                    with z.open(m) as source, open(to := _inside(folder, m.filename), "wb") as out:
                        shutil.copyfileobj(source, out)
                    found.append(to)
    elif tarfile.is_tarfile(path):
        with tarfile.open(path) as t:
            found = _members(t, folder, include, exclude)
    elif path.endswith(".tar.Z"):
        with open(path, "rb") as f, tarfile.open(fileobj=io.BytesIO(uncompressed(f.read()))) as t:
            found = _members(t, folder, include, exclude)
    elif path.endswith((".gz", ".bz2", ".Z")):
        name = os.path.splitext(os.path.basename(path))[0]
        if wanted(name, include, exclude):
            opened = {".gz": gzip.open, ".bz2": bz2.open, ".Z": lambda p: io.BytesIO(uncompressed(open(p, "rb").read()))}
            with opened[os.path.splitext(path)[1]](path) as source, open(to := _inside(folder, name), "wb") as out:
                shutil.copyfileobj(source, out)
            found.append(to)
    elif wanted(os.path.basename(path), include, exclude):
        found.append(path)
    if not found:
        raise BadRecord(f"nothing in {path} is wanted")
    return sorted(found)
