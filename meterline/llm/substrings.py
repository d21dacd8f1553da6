"""Substring deduplication by relative Lempel-Ziv parsing of the documents against an index of the corpus.

The reference is the corpus itself: the first place of every word window that occurs
more than once, in blocks of sorted hash arrays that workers map. A document is parsed from left to right. Where the blocks hold an
earlier place of the window at hand, a factor begins; it grows word by word as long as the next window lies next in the
reference. Where it ends the windows across its border are looked up too, so a passage that goes on at another
place is a factor of its own from its first window on. Factors are as long as a window or longer by that; they are the duplicate spans,
and their words are what is removed. As only first places are kept, a factor ends where the first place jumps, although a later place might
have gone on: the next factor then takes over inside the border, so the words covered are the same.

Three passes over the text, none of which shuffles it:

1. Anchors. The anchor of a window is the least hash of the `GRAM`-word groups in it, so
   equal windows have equal anchors, and one anchor serves about seven windows. Tasks
   send how often they met each; what occurs once in the corpus is dropped.
2. Places. Windows whose anchor repeats are sent with their first place in the task, one per
   window text and task, so a passage of a third of all documents is no large group.
   The first places overall become the index.
3. Parse. The documents are parsed against the index.

Windows are known by 96-bit hashes of their words' hashes. Places are ordered by (doc_id, start).

Defined cases. A null text has no words. A null id is smaller than all others. Rows with one
id share the places of that id: of two equal rows neither is earlier. A text shorter than a window
stays. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import scratch
from meterline.llm.runs import (WordHashes, dealt, mapped, mixed, packed, packed_sorted, part_of, save, sliding, summed,
                                unpacked, unpacked_sorted, window_hashes, words_of)

GRAM = 8
#: Words that a task works on at a time, and keys that it holds before it sends them.
CHUNK_WORDS, HELD_KEYS = 500_000, 2_000_000
NO_ID = -(1 << 63)
_OTHER = np.uint64(0xA0761D6478BD642F)
SPANS = "array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"


@dataclass
class Chunk:
    """Documents laid end to end."""

    ids: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    words: int = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.texts.append(words)
        self.words += len(words)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            chunk.add(doc_id.as_py(), words_of(text.as_py()))
            if chunk.words >= CHUNK_WORDS:
                yield chunk
                chunk = Chunk()
    if chunk.ids:
        yield chunk


_HASHES = WordHashes()


class Windows:
    """Hashes of all windows of a chunk, and the anchors of the valid ones."""

    def __init__(self, chunk: Chunk, size: int):
        self.size, self.lengths = size, np.array([len(w) for w in chunk.texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        flat = [w for words in chunk.texts for w in words]
        hashes = _HASHES.of(flat)
        total = len(hashes)
        self.starts = np.empty(0, np.int64)  # of valid windows, in the chunk
        self.anchor = self.at = np.empty(0, np.uint64)
        self.hashes = hashes
        if total < size:
            return
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        whole = doc[:total - size + 1] == doc[size - 1:]
        grams = window_hashes(hashes, GRAM)
        grams[doc[:total - GRAM + 1] != doc[GRAM - 1:]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        reach = size - GRAM + 1
        least = sliding(grams, reach, np.minimum)
        self.starts = np.flatnonzero(whole)
        self.anchor = least[self.starts]
        # A group is an anchor where some valid window has it as its least.
        spread = np.zeros(len(least) + 2 * (reach - 1), np.uint64)
        spread[reach - 1:reach - 1 + len(least)] = np.where(whole, least, 0)
        top = sliding(spread, reach, np.maximum)
        self.anchors = grams[(top == grams) & (top > 0)]
        self.doc = doc

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the windows at `starts`."""
        first = window_hashes(self.hashes, self.size)[starts]
        second = window_hashes(mixed(self.hashes ^ _OTHER), self.size)[starts]
        return first, (second >> np.uint64(32)).astype(np.uint32)


class Blocks:
    """Sorted arrays of keys in mapped blocks."""

    def __init__(self, folder: str, name: str, sizes: tuple[int, ...]):
        self.folder, self.sizes = folder, sizes
        self.keys = [mapped(folder, f"{name}-{p}", "<u8") if n else np.empty(0, np.uint64) for p, n in enumerate(sizes)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key its block and its first place there, or -1."""
        part = part_of(keys, len(self.sizes))
        place = np.full(len(keys), -1, np.int64)
        for p, at in dealt(part, len(self.sizes)):
            held = self.keys[p]
            if len(held):
                found = np.searchsorted(held, keys[at])
                hit = held[np.minimum(found, len(held) - 1)] == keys[at]
                place[at[hit]] = found[hit]
        return part, place


@lru_cache(maxsize=2)
def _anchors(folder: str, sizes: tuple[int, ...]) -> Blocks:
    return Blocks(folder, "anchor", sizes)


class Index(Blocks):
    """The first place of every repeated window."""

    def __init__(self, folder: str, sizes: tuple[int, ...]):
        super().__init__(folder, "window", sizes)
        load = lambda name, kind: [mapped(folder, f"{name}-{p}", kind) if n else np.empty(0, kind) for p, n in enumerate(sizes)]
        self.second, self.docs, self.starts = load("second", "<u4"), load("doc", "<i8"), load("start", "<u4")

    def places(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the index has each window, and its document and start there."""
        part, place = self.find(first)
        known = np.zeros(len(first), bool)
        docs, starts = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for p, at in dealt(np.where(place >= 0, part, len(self.sizes)), len(self.sizes)):
            here = place[at]
            while len(at):  # windows that agree in the first 64 bits lie side by side
                hit = self.second[p][here] == second[at]
                known[at[hit]], docs[at[hit]], starts[at[hit]] = True, self.docs[p][here[hit]], self.starts[p][here[hit]]
                at, here = at[~hit], here[~hit] + 1
                more = (here < self.sizes[p]) & (self.keys[p][np.minimum(here, self.sizes[p] - 1)] == first[at])
                at, here = at[more], here[more]
        return known, docs, starts


@lru_cache(maxsize=2)
def _index(folder: str, sizes: tuple[int, ...]) -> Index:
    return Index(folder, sizes)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_inverse=True)


def repeated_windows(windows: Windows, anchors: Blocks) -> np.ndarray:
    """Starts, in the chunk, of the windows whose anchor the corpus has twice."""
    values, back = _distinct(windows.anchor)
    return windows.starts[(anchors.find(values)[1] >= 0)[back]] if len(values) else windows.starts


def _send(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"part": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def _find_anchors(docs: DataFrame, folder: str, size: int, parts: int) -> tuple[tuple[int, ...], int]:
    """Write the anchors that occur twice or more; the blocks' sizes and the occurrences in all."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys, counts = summed(keys, np.ones(len(keys), np.int64))
        rows = {"part": [], "keys": [], "counts": []}
        for p, at in dealt(part_of(keys, parts), parts):
            rows["part"].append(p)
            rows["keys"].append(packed_sorted(keys[at]))
            rows["counts"].append(packed(counts[at]))
        return _send(rows)

    def met(batches):
        held, n = [], 0
        for chunk in chunks(batches):
            windows = Windows(chunk, size)
            if len(windows.starts):
                held.append(windows.anchors)
                n += len(windows.anchors)
            if n >= HELD_KEYS:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def write(key, table):
        p = key[0].as_py()
        keys, counts = summed(np.concatenate([unpacked_sorted(k.as_py()) for k in table["keys"]]),
                              np.concatenate([unpacked(c.as_py(), "<i8") for c in table["counts"]]))
        twice = counts > 1
        save(folder, f"anchor-{p}", keys[twice].astype("<u8"))
        return pa.table({"part": pa.array([p], pa.int32()), "n": [int(twice.sum())], "met": [int(counts[twice].sum())]})

    made = docs.mapInArrow(met, "part int, keys binary, counts binary").groupBy("part").applyInArrow(
        write, "part int, n long, met long").collect()
    sizes = {r["part"]: r["n"] for r in made}
    return tuple(sizes.get(p, 0) for p in range(parts)), sum(r["met"] for r in made)


def _first(first, second, docs, starts, counts):
    """Per distinct window: its least place, and the sum of its counts. Ordered by key."""
    order = np.lexsort((starts, docs, second, first))
    first, second, docs, starts, counts = (x[order] for x in (first, second, docs, starts, counts))
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    # Only "once or oftener" counts; a sum would widen the type.
    return first[new], second[new], docs[new], starts[new], np.minimum(np.add.reduceat(counts, new), 2).astype(np.uint32)


def _find_places(docs: DataFrame, folder: str, size: int, anchor_sizes: tuple[int, ...], parts: int) -> tuple[int, ...]:
    """Write the index: the first place of every window that occurs twice or more."""
    names = ("keys", "second", "docs", "starts", "counts")

    def sent(held: list[tuple]) -> pa.RecordBatch:
        columns = _first(*[np.concatenate(c) for c in zip(*held, strict=True)])
        rows = {"part": [], **{n: [] for n in names}}
        for p, at in dealt(part_of(columns[0], parts), parts):
            rows["part"].append(p)
            rows["keys"].append(packed_sorted(columns[0][at]))
            for name, column in zip(names[1:], columns[1:], strict=True):
                rows[name].append(packed(column[at]))
        return _send(rows)

    def met(batches):
        anchors = _anchors(folder, anchor_sizes)
        held, n = [], 0
        for chunk in chunks(batches):
            windows = Windows(chunk, size)
            starts = repeated_windows(windows, anchors)
            if len(starts):
                first, second = windows.keys(starts)
                doc = windows.doc[starts]
                ids = np.array([NO_ID if i is None else i for i in chunk.ids], np.int64)[doc]
                held.append((first, second, ids, (starts - windows.begins[doc]).astype(np.uint32), np.ones(len(starts), np.uint32)))
                n += len(starts)
            if n >= HELD_KEYS:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def write(key, table):
        p = key[0].as_py()
        kinds = {"second": "<u4", "docs": "<i8", "starts": "<u4", "counts": "<u4"}
        columns = [np.concatenate([unpacked_sorted(k.as_py()) for k in table["keys"]])]
        columns += [np.concatenate([unpacked(c.as_py(), kinds[n]) for c in table[n]]) for n in names[1:]]
        first, second, ids, starts, counts = _first(*columns)
        twice = counts > 1
        for name, column, kind in (("window", first, "<u8"), ("second", second, "<u4"), ("doc", ids, "<i8"), ("start", starts, "<u4")):
            save(folder, f"{name}-{p}", column[twice].astype(kind))
        return pa.table({"part": pa.array([p], pa.int32()), "n": [int(twice.sum())]})

    made = docs.mapInArrow(met, "part int, " + ", ".join(f"{n} binary" for n in names)).groupBy("part").applyInArrow(
        write, "part int, n long").collect()
    sizes = {r["part"]: r["n"] for r in made}
    return tuple(sizes.get(p, 0) for p in range(parts))


@dataclass
class Factors:
    """Greedy factors of documents laid end to end: where each starts there, its words, and its place in the reference."""

    start: np.ndarray
    length: np.ndarray
    ref_doc: np.ndarray
    ref_start: np.ndarray

    @classmethod
    def parsed(cls, starts: np.ndarray, docs: np.ndarray, ref_docs: np.ndarray, ref_starts: np.ndarray, size: int) -> Factors:
        """From the windows that the reference holds earlier, in order, with their documents and reference places.

        A factor begins at the first such window and grows by a word as long as the next window continues it in the
        reference. Where it ends, the windows across its border are checked too: one that the reference holds elsewhere begins the
        next factor inside the last words of this one. So every factor has `size` words or more, and each window with an earlier place
        lies whole in one.
        """
        if not len(starts):
            return cls(starts, starts, ref_docs, ref_starts)
        goes_on = (np.diff(starts) == 1) & (np.diff(docs) == 0) & (np.diff(ref_docs) == 0) & (np.diff(ref_starts) == 1)
        begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        end = np.append(begin[1:], len(starts))
        return cls(starts[begin], end - begin + size - 1, ref_docs[begin], ref_starts[begin])

    def covered(self, total: int) -> np.ndarray:
        """Which of `total` words lie in a factor."""
        change = np.zeros(total + 1, np.int64)
        np.add.at(change, self.start, 1)
        np.add.at(change, self.start + self.length, -1)
        return np.cumsum(change[:-1]) > 0


def deduplicate(docs: DataFrame, size: int = 20, keys_per_part: int = 4_000_000, with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 and its factors as `spans`; `kept_text` if asked for."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    folder = scratch(spark, "windows")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # An anchor stands for about 40 bytes of text.
    anchor_sizes, met = _find_anchors(texts, folder, size, max(1, -(-total // (40 * keys_per_part))))
    sizes = _find_places(texts, folder, size, anchor_sizes, max(1, -(-met * 7 // keys_per_part)))

    def parsed(batches):
        anchors, index = _anchors(folder, anchor_sizes), _index(folder, sizes)
        for chunk in chunks(batches):
            windows = Windows(chunk, size)
            starts = repeated_windows(windows, anchors)
            none = np.empty(0, np.int64)
            found = Factors(none, none, none, none)
            if len(starts):
                doc = windows.doc[starts]
                ids = np.array([NO_ID if i is None else i for i in chunk.ids], np.int64)[doc]
                own = starts - windows.begins[doc]
                known, ref_docs, ref_starts = index.places(*windows.keys(starts))
                later = known & ((ids > ref_docs) | ((ids == ref_docs) & (own > ref_starts)))
                found = Factors.parsed(starts[later], doc[later], ref_docs[later], ref_starts[later], size)
            covered = found.covered(int(windows.begins[-1]))
            of = np.searchsorted(found.start, windows.begins)  # the factors of each document
            spans = list(zip(found.start.tolist(), found.length.tolist(), found.ref_doc.tolist(), found.ref_start.tolist(), strict=True))
            rows = []
            for d, (doc_id, words) in enumerate(zip(chunk.ids, chunk.texts, strict=True)):
                gone = covered[windows.begins[d]:windows.begins[d + 1]]
                n = int(gone.sum())
                text = b" ".join(words if not n else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                begin = int(windows.begins[d])
                own_spans = [{"start": a - begin, "length": length, "ref_doc": r, "ref_start": s} for a, length, r, s in spans[of[d]:of[d + 1]]]
                row = (doc_id, len(words), n, hashlib.sha256(text).hexdigest(), own_spans)
                rows.append((*row, text.decode()) if with_text else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    span = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                       ("spans", pa.list_(span)), *[("kept_text", pa.string())] * with_text])
    return texts.mapInArrow(parsed, f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPANS}"
                            + ", kept_text string" * with_text)
