"""Where bytes come from: files, memory, HTTP, and a cache of aligned chunks before any of them.

A reader is any object with ``size`` and ``read(offset, length)``.
"""

from __future__ import annotations

import mmap
import os
import urllib.request
from collections import OrderedDict

from fathom.errors import NoSource, ShortRead

CHUNK = 1 << 20


class FileRanges:
    """A file, read by seek."""

    def __init__(self, path: str):
        self.path, self.file = path, open(path, "rb")
        self.size = os.fstat(self.file.fileno()).st_size

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) < length:
            raise ShortRead(f"{length} bytes at {offset} of {self.path}")
        return out

    def close(self) -> None:
        self.file.close()


class BytesRanges:
    """Bytes in memory, or any buffer."""

    def __init__(self, data):
        self.data, self.size = memoryview(data), len(data)

    def read(self, offset: int, length: int) -> bytes:
        if offset + length > self.size:
            raise ShortRead(f"{length} bytes at {offset} of {self.size}")
        return bytes(self.data[offset : offset + length])

    def close(self) -> None:
        self.data.release()


class MmapRanges(BytesRanges):
    """A file mapped into memory."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        super().__init__(self.map)

    def close(self) -> None:
        super().close()
        self.map.close()
        self.file.close()


class HttpRanges:
    """An address that answers range requests; its size is asked for with the first byte."""

    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout, self.requests = url, timeout, 0
        with self._get(0, 1) as r:
            total = r.headers.get("Content-Range", "").rpartition("/")[2]
            if r.status != 206 or not total.isdigit():
                raise NoSource(f"{url} does not answer range requests")
            self.size = int(total)

    def _get(self, offset: int, length: int):
        self.requests += 1
        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
        return urllib.request.urlopen(ask, timeout=self.timeout)

    def read(self, offset: int, length: int) -> bytes:
        if not length:
            return b""
        with self._get(offset, length) as r:
            out = r.read()
        if len(out) != length:
            raise ShortRead(f"{length} bytes at {offset} of {self.url}")
        return out

    def close(self) -> None:
        pass


class CachedRanges:
    """Aligned chunks of another reader, the most recently used ones; neighbouring chunks that miss are one read.

    Reads of ``bypass`` bytes or more go past the cache.
    """

    def __init__(self, inner, chunk: int = CHUNK, most: int = 64, bypass: int | None = None):
        self.inner, self.chunk, self.most, self.size = inner, chunk, most, inner.size
        self.bypass = bypass or 4 * chunk
        self.chunks: OrderedDict[int, bytes] = OrderedDict()
        self.hits = self.misses = 0

    def _load(self, wanted: list[int]) -> None:
        missing = [k for k in wanted if k not in self.chunks]
        self.hits += len(wanted) - len(missing)
        self.misses += len(missing)
        while missing:
            n = 1
            while n < len(missing) and missing[n] == missing[0] + n:
                n += 1
            at = missing[0] * self.chunk
            raw = self.inner.read(at, min(n * self.chunk, self.size - at))
            for i in range(n):
                self.chunks[missing[i]] = raw[i * self.chunk : (i + 1) * self.chunk]
            missing = missing[n:]

    def read(self, offset: int, length: int) -> bytes:
        if offset + length > self.size:
            raise ShortRead(f"{length} bytes at {offset} of {self.size}")
        if length >= self.bypass:
            return self.inner.read(offset, length)
        if not length:
            return b""
        first, last = offset // self.chunk, (offset + length - 1) // self.chunk
        self._load(list(range(first, last + 1)))
        for k in range(first, last + 1):
            self.chunks.move_to_end(k)
        out = b"".join(self.chunks[k] for k in range(first, last + 1))
        while len(self.chunks) > self.most:
            self.chunks.popitem(last=False)
        at = offset - first * self.chunk
        return out[at : at + length]

    def prefetch(self, offset: int, length: int) -> None:
        end = min(self.size, offset + length)
        if end > offset:
            self._load(list(range(offset // self.chunk, (end - 1) // self.chunk + 1)))

    def close(self) -> None:
        self.inner.close()


def open_ranges(source):
    """A reader for a path, an address, bytes, or a reader as it is."""
    if source is None:
        raise NoSource("there is no file or address to read from")
    if isinstance(source, (bytes, bytearray, memoryview)):
        return BytesRanges(source)
    if not isinstance(source, (str, os.PathLike)):
        return source
    source = os.fspath(source)
    if source.startswith(("http://", "https://")):
        return CachedRanges(HttpRanges(source))
    return FileRanges(local(source))


def local(path: str) -> str:
    """A path as Python opens it."""
    return path[5:].replace("//", "/", 1) if path.startswith("file:") else path
