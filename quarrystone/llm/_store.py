"""Binary shards in the shared folder: written by workers, memory-mapped by workers."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs
import zstandard


@lru_cache(1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one block: first bytes of all numbers, then second ones, and so on, compressed at once, so that sorted or small numbers cost little."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    planes = b"".join([a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in parts])
    return np.array([len(parts), *[a.nbytes for a in parts]], np.int64).tobytes() + _zstd()[0].compress(planes)


def unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    n = 1 + len(kinds)
    sizes, raw = np.frombuffer(block, np.int64, n)[1:].tolist(), np.frombuffer(_zstd()[1].decompress(memoryview(block)[8 * n :]), np.uint8)
    at, out = 0, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel())
        at += size
    return out


def _split(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write under another name, then rename: a task that runs twice leaves one whole file."""
    fs, path = _split(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    fs.move(part, f"{path}/{name}")


@lru_cache(4096)
def mapped(folder: str, name: str, may_lack: bool = False) -> np.ndarray:
    """The file's bytes as a memory map; one in a store that is no mounted file system is read into memory, never to a local disk.
    ``may_lack``: a shard that got nothing has no file."""
    fs, path = _split(folder)
    path = f"{path}/{name}"
    if may_lack and fs.get_file_info(path).type == pafs.FileType.NotFound:
        return np.zeros(0, np.uint8)
    if not isinstance(fs, pafs.LocalFileSystem):
        with fs.open_input_stream(path) as src:
            return np.frombuffer(src.read(), np.uint8)
    return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)


def runs(sorted_values: np.ndarray):
    """(start, end, value) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(sorted_values)], strict=True):
        if a < b:
            yield int(a), int(b), int(sorted_values[a])


class SortedHashes:
    """A sorted array of 64-bit hashes with a 64-bit count each, cut into files by the top bits of the hash."""

    def __init__(self, folder: str, kind: str, sizes: np.ndarray):
        self.folder, self.kind, self.bits = folder, kind, int(len(sizes)).bit_length() - 1
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(self.offsets[k + 1] - self.offsets[k])
        raw = mapped(self.folder, f"{self.kind}-{k}") if n else np.zeros(0, np.uint8)
        return raw[: 8 * n].view(np.uint64), raw[8 * n :].view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count of each of the sorted ``keys``; -1 and 0 where it is absent."""
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for a, b, k in runs(shard_of(keys, self.bits)):
            hashes, counts = self.shard(k)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, keys[a:b]), len(hashes) - 1)
                hit = hashes[at] == keys[a:b]
                place[a:b] = np.where(hit, at + self.offsets[k], -1)
                count[a:b] = np.where(hit, counts[at], 0)
        return place, count


class PackedTable:
    """Sorted keys of KEY bits with small numbers, five bytes a key, in one file a shard.

    The last two bits of a key's five bytes are 1 to 3 for that value, or 0 where the value is kept at the end of the file in 64
    bits; with ``columns`` numbers a key, each is one byte unless one of them is larger. A key that is absent is taken
    for one that is there with a chance of the shard's keys / 2**KEY; equal keys are added up.
    """

    KEY = 38

    def __init__(self, folder: str, kind: str, columns: int = 0):
        self.folder, self.kind, self.columns = folder, kind, columns

    def write(self, k: int, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` below 2**KEY in any order; ``values`` of shape (n,) or (n, columns)."""
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order].reshape(len(keys), self.columns or 1).astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        if len(first) < len(keys):
            keys, values = keys[first], np.add.reduceat(values, first, axis=0)
        far = (values > (255 if self.columns else 3)).any(1) | (values[:, 0] < (0 if self.columns else 1))
        code = np.where(far, 0, 1 if self.columns else values[:, 0]).astype(np.uint64)
        five = (keys.astype(np.uint64) << np.uint64(2)) | code
        own = np.where(far[:, None], 0, values).astype(np.uint8) if self.columns else np.zeros((0, 0), np.uint8)
        at = np.flatnonzero(far)
        head = np.array([len(keys), len(at)], np.int64)
        write(self.folder, f"{self.kind}-{k}", head, values[at], at.astype(np.uint32), (five >> np.uint64(8)).astype(np.uint32), (five & np.uint64(255)).astype(np.uint8), own)

    def find(self, shards: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The values of each (shard, key), zeros where it is absent; any order."""
        width = self.columns or 1
        out = np.zeros((len(keys), width), np.int64)
        if not len(keys):
            return out if self.columns else out[:, 0]
        spread = np.uint64(64 - self.KEY - int(shards.max()).bit_length())
        both = ((shards.astype(np.uint64) << np.uint64(self.KEY)) | keys) << spread
        order = np.arange(len(keys)) if (both[1:] >= both[:-1]).all() else order_of(both)
        high, low = (keys[order] >> np.uint64(6)).astype(np.uint32), (keys[order] & np.uint64(63)).astype(np.uint8)
        for a, b, k in runs(shards[order]):
            raw = mapped(self.folder, f"{self.kind}-{k}", True)
            if not len(raw):
                continue
            n, m = (int(x) for x in raw[:16].view(np.int64))
            s = 16 + 8 * width * m
            far, far_at = raw[16:s].view(np.int64).reshape(m, width), raw[s : s + 4 * m].view(np.uint32)
            s += 4 * m
            hi, lo, own = raw[s : s + 4 * n].view(np.uint32), raw[s + 4 * n : s + 5 * n], raw[s + 5 * n :]
            at = np.searchsorted(hi, high[a:b]) if n else np.zeros(b - a, np.int64)
            place = np.full(b - a, -1, np.int64)
            open_ = np.flatnonzero(at < n)
            while len(open_):  # several keys may share the first four bytes
                x = at[open_]
                same = hi[x] == high[a:b][open_]
                hit = same & (lo[x] >> 2 == low[a:b][open_])
                place[open_[hit]] = x[hit]
                open_ = open_[same & ~hit]
                at[open_] += 1
                open_ = open_[at[open_] < n]
            hit = np.flatnonzero(place >= 0)
            code = (lo[place[hit]] & 3).astype(np.int64)
            found = own.reshape(n, width)[place[hit]].astype(np.int64) if self.columns else code[:, None].copy()
            big = np.flatnonzero(code == 0)
            found[big] = far[np.searchsorted(far_at, place[hit][big])]
            out[order[a:b][hit]] = found
        return out if self.columns else out[:, 0]


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def order_of(x: np.ndarray) -> np.ndarray:
    """Indices that put unsigned 64-bit numbers in order, equal ones as they came. Hashes are sorted by their top bits with the index
    in the others, which is a plain sort; where that leaves another order, as numbers agree in the top bits, they are sorted as they are."""
    n = np.uint64(len(x).bit_length())
    packed = (x >> n << n) | np.arange(len(x), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << n) - np.uint64(1))).astype(np.int64)
    y = x[order]
    return order if (y[1:] >= y[:-1]).all() else np.argsort(x, kind="stable")


def distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and the place of each number among them."""
    order = order_of(x)
    y = x[order]
    new = np.r_[True, y[1:] != y[:-1]][: len(y)]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return y[new], back


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts, in 64 bits."""
    k, c = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (counts, np.int64)))
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    return k[first], np.add.reduceat(c, first) if len(k) else c
