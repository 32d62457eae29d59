"""Random access to bytes: local and remote files, memory, and HTTP ranges."""

from __future__ import annotations

import re
import threading
import urllib.request
from collections import OrderedDict
from typing import Protocol

from rasterloom.sources.errors import Truncated


class ByteSource(Protocol):
    size: int

    def read(self, offset: int, length: int) -> bytes: ...


def _checked(data: bytes, offset: int, length: int) -> bytes:
    if len(data) != length:
        raise Truncated(f"{length} bytes at {offset}, got {len(data)}")
    return data


class BytesSource:
    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read(self, offset: int, length: int) -> bytes:
        return _checked(bytes(self.data[offset : offset + length]), offset, length)


class FileSource:
    """A file of any file system that pyarrow knows; plain paths are local."""

    def __init__(self, path: str):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
        self.file = where.open_input_file(inner)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset + length > self.size:
            raise Truncated(f"{length} bytes at {offset} of {self.size}")
        return _checked(self.file.read_at(length, offset), offset, length)


class HttpSource:
    """Ranges of a URL, fetched in chunks of which the last used are kept."""

    def __init__(self, url: str, chunk: int = 256 << 10, cache_bytes: int = 64 << 20, slots: int = 257):
        self.url, self.chunk, self.slots, self.cache_bytes = url, chunk, slots, cache_bytes
        self.kept: OrderedDict[int, bytes] = OrderedDict()
        self.held = self.requests = 0
        self.lock = threading.Lock()
        self.size = self._length()

    def _length(self) -> int:
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, method="HEAD")) as r:
                if (n := r.headers.get("Content-Length")) is not None:
                    return int(n)
        except urllib.error.HTTPError:
            pass
        with urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": "bytes=0-0"})) as r:
            total = re.fullmatch(r"bytes 0-0/(\d+)", r.headers.get("Content-Range") or "")
            if r.status != 206 or not total:
                raise Truncated(f"{self.url} does not say how long it is")
            return int(total[1])

    def _fetch(self, k: int) -> bytes:
        with self.lock:
            if k in self.kept:
                self.kept.move_to_end(k)
                return self.kept[k]
        a, b = k * self.chunk, min((k + 1) * self.chunk, self.size) - 1
        with urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": f"bytes={a}-{b}"})) as r:
            if r.status != 206:
                raise Truncated(f"{self.url} does not serve ranges")
            data = _checked(r.read(), a, b - a + 1)
        with self.lock:
            self.requests += 1
            if self.slots and self.cache_bytes >= len(data):
                self.kept[k] = data
                self.held += len(data)
                while self.held > self.cache_bytes or len(self.kept) > self.slots:
                    self.held -= len(self.kept.popitem(last=False)[1])
        return data

    def read(self, offset: int, length: int) -> bytes:
        if offset + length > self.size:
            raise Truncated(f"{length} bytes at {offset} of {self.size}")
        if not length:
            return b""
        first, last = offset // self.chunk, (offset + length - 1) // self.chunk
        data = b"".join(self._fetch(k) for k in range(first, last + 1))
        return data[offset - first * self.chunk :][:length]


def open_source(path: str, chunk: int = 256 << 10, cache_bytes: int = 64 << 20) -> ByteSource:
    return HttpSource(path, chunk, cache_bytes) if re.match(r"https?://", path) else FileSource(path)
