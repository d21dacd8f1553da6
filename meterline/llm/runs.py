"""Helpers of the operators that work on word and hash arrays inside tasks.

A run is a sorted array of 64-bit keys, with equal keys summed where they carry counts.
Runs travel as one compressed binary per partition and task instead of a row per key.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard



def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = keys.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: bytes.split() parts at exactly space and U+0009 to U+000D."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to `most` words."""

    def __init__(self, seed: int = 0, most: int = 1 << 20):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(n: int, base: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(2 * n, self.base), powers(2 * n, self.inverse)
        return self.up[:n], self.down[:n]


_POWERS = Powers(0xD1342543DE82EF95)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of `size` word hashes: a polynomial modulo 2^64 by prefix sums, mixed."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    up, down = _POWERS.to(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * down[:len(words) - size + 1])


def sliding(of: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """np.minimum or np.maximum over every `size` neighbours, by doubling."""
    have, out = 1, of
    while 2 * have <= size:
        out, have = pick(out[:len(out) - have], out[have:]), 2 * have
    return pick(out[:len(of) - size + 1], out[size - have:size - have + len(of) - size + 1])


#: A random number for each byte, equal for A-Z and a-z; 0 for the white space between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES[_SPACE] = 0
_BYTES[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]
#: Bytes of text hashed at a time.
CHUNK_BYTES = 2 << 20


def lowered_word_hashes(column: pa.Array):
    """(first row, hashes, words of each row) of runs of rows of a text column.

    The words' bytes are hashed where Arrow holds them, A-Z as a-z: a polynomial of the bytes' numbers
    by prefix sums, then mixed. A null is the empty text.
    """
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, "right")) - 1)
        part, begin = text[ends[row]:ends[last]], ends[row:last] - ends[row]
        word = ~_SPACE[part]
        border = np.zeros(len(part) + 1, bool)
        border[begin] = True
        border[-1] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | border[1:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | border[1:-1]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        up, down = _POWERS.to(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * up[:-1], dtype=np.uint64)])
        hashes = mixed((sums[stops] - sums[starts]) * down[starts])
        yield row, hashes, np.diff(np.searchsorted(starts, np.append(begin, len(part))))
        row = last


def packed(numbers: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte planes apart, as high bytes repeat."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def packed_sorted(keys: np.ndarray) -> bytes:
    """Compressed bytes of sorted 64-bit keys, as differences."""
    return packed(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts (rows of `counts` for each key)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first, axis=0)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array below a shared folder; a repeated task replaces its file whole."""
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    if not isinstance(system, pafs.LocalFileSystem) and system.get_file_info(f"{path}/{name}").type == pafs.FileType.File:
        system.delete_file(f"{path}/{name}")  # a local move replaces by itself
    system.move(part, f"{path}/{name}")


def dealt(part: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, indices in order) of the parts that have any."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[a:b]) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """An even part for every key, whatever the keys' distribution."""
    return (mixed(keys) % np.uint64(parts)).astype(np.int64)


_COPIES: dict[str, np.ndarray] = {}


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A written array, memory-mapped; from a store that cannot be mapped, by a copy that ends with the worker."""
    system, path = pafs.FileSystem.from_uri(folder)
    file = f"{path}/{name}"
    if not isinstance(system, pafs.LocalFileSystem):
        if file not in _COPIES:
            with system.open_input_stream(file) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
                shutil.copyfileobj(source, copy)
            array = np.memmap(copy.name, kind, "r") if os.path.getsize(copy.name) else np.empty(0, kind)
            os.unlink(copy.name)  # the mapping keeps it
            _COPIES[file] = array
        return _COPIES[file]
    return np.memmap(file, kind, "r") if os.path.getsize(file) else np.empty(0, kind)
