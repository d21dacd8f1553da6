"""Exact Jaccard join of shingle sets in metric space, and the components of its links.

Jaccard distance is a metric: what lies within eps of x has a distance to any pivot that
differs from x's by eps at most. Documents are dealt into regions of pivots, copied over a
border where the triangle inequality leaves a link across it open, and regions are joined on
their own.

Level 0. Unrelated documents are all at distance 1 from each other, and no document
pivot tells them apart. The first pivots are therefore single shingles. A document's
home is its first shingle in one fixed order, and eps bounds how many of its shingles
a linked document may lack: whatever lies within eps has its home, or its copy, among the
first n - ceil(t n) + 1 shingles of both. The order is by how many documents share a
shingle's bucket of a counting sketch, rare ones first, so a passage that many
documents share is no pivot for them. Each document has a profile, its distances to the
empty set within classes of shingles; documents whose profiles differ by more than a link
allows do not meet. Pivots whose documents meet form one region.

Deeper. A region above `leaf` shingles is split by document pivots: documents go to the
nearest pivot's region and to those whose distance is at most 2 eps more. Documents with
no pivot nearer than 1 - eps form one more region, which those with none nearer than
1 - 2 eps join. Regions are split again until they fit. One that does not get smaller is dense; most of it hangs together
through its pivots by then, and the rest of it is compared with all of it in blocks.

Leaves are joined exactly in one task: each document against those that share one of its
first shingles, differ in size and in distance to the leaf's pivots by no more than eps
allows, and are not yet known to hang together with it. That loses no component and never lists all
pairs of a group of copies.

Documents with equal sets are one class, known by 128 bits and the size, and take part once.
Orders, classes and results are sorted or dense arrays that workers map; the text is never
shuffled. Sets of 64-bit shingle hashes are compared as such.

Defined cases. A null text or one without words has an empty set, links with nothing and is its own component.
A null id counts as the least one, so a component that holds it has a null id.
Rows with one id are each a document. A very long text is one set in one task: its shingles have to fit it. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.common import scratch
from meterline.llm.components import components
from meterline.llm.runs import (dealt, lowered_word_hashes, mapped, mixed, packed, packed_sorted, part_of, save,
                                unpacked, unpacked_sorted, window_hashes)
from meterline.session import settled

#: Words of a shingle of op6; the pipeline takes its own.
SHINGLE = 4
#: Buckets of the counting sketch, and of one block of it.
SKETCH, BLOCK = 1 << 21, 1 << 16
#: Tasks whose sketches one task sums.
FAN_IN = 256
HELD_KEYS = 1_000_000
#: Least number of classes of shingles that a profile counts, and shingles for each class of a larger set.
LEAST_CLASSES, PER_CLASS = 32, 16
#: Bytes of profiles compared at a time.
COMPARED = 8 << 20
#: Bytes of sets in one batch of rows.
HELD_BYTES = 4 << 20
PIVOTS = 16
#: Stands for the region beyond all pivots.
FAR = -1
NO_ID = -(1 << 63)
#: No value in a dense array; an id this large is not expected.
NONE = (1 << 63) - 1
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """(first row, shingles, sizes) of runs of rows: sorted distinct shingle hashes of each row, end to end."""
    for row, words, lengths in lowered_word_hashes(column):
        begin = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(ends[-1], np.uint64)
        at = np.repeat(begin[:-1] - ends[:-1], counts) + np.arange(ends[-1])  # the first word of each shingle
        whole = np.repeat(lengths >= size, counts)
        flat[whole] = window_hashes(words, size)[at[whole]] if whole.any() else 0
        for d in np.flatnonzero((lengths > 0) & (lengths < size)).tolist():
            own = words[begin[d]:begin[d + 1]]
            flat[ends[d]] = mixed(window_hashes(own, len(own)) ^ np.uint64(len(own)))[0]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            flat[a:b].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[ends[:-1][counts > 0]] = True
        kept = np.concatenate([[0], np.cumsum(new)])
        yield row, flat[new], np.diff(kept[ends])


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two columns; 0 of an empty one."""
    out = np.zeros((len(sizes), 2), np.uint64)
    some = sizes > 0
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1][some]
    if len(begin):
        first = mixed(flat ^ _OTHER)
        out[some, 0] = np.add.reduceat(first, begin)
        out[some, 1] = np.add.reduceat(mixed(first + _OTHER), begin)
    return out


def classes_of(sizes: np.ndarray) -> np.ndarray:
    """log2 of the number of a set's profile classes."""
    return np.ceil(np.log2(np.maximum(sizes / PER_CLASS, LEAST_CLASSES))).astype(np.int64)


def profiles(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set, how many shingles lie in each class, up to 255; a class is the first bits of a hash.

    These are distances to the empty set within the classes. By the triangle inequality two sets differ
    in at least as many shingles as their profiles do in sum. Classes grow with the set, as
    the profiles of unrelated sets differ by the root of sizes times classes.
    """
    bits = classes_of(sizes)
    ends = np.concatenate([[0], np.cumsum(1 << bits)])
    at = np.repeat(ends[:-1], sizes) + (flat >> np.repeat(64 - bits, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=ends[-1]), 255).astype(np.uint8).tobytes()
    return [counts[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def ids_of(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


class Classes:
    """The classes' mapped arrays: key, least id, profile; a class's number is its place in them."""

    def __init__(self, folder: str, offsets: tuple[int, ...]):
        self.offsets, parts = offsets, len(offsets) - 1
        load = lambda name, kind: [mapped(folder, f"{name}-{p}", kind) if offsets[p + 1] > offsets[p] else np.empty(0, kind)
                                   for p in range(parts)]
        self.first, self.second, self.ids = load("first", "<u8"), load("second", "<u8"), load("id", "<i8")
        self.profile, self.begin = load("profile", "u1"), load("begin", "<i8")

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and least ids of classes that exist, by their keys."""
        first, second = first.astype(np.uint64), second.astype(np.uint64)
        number, least = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        for p, at in dealt(part_of(first, len(self.first)), len(self.first)):
            place = np.searchsorted(self.first[p], first[at])
            while (off := self.second[p][place] != second[at]).any():
                place[off] += 1  # keys that agree in the first half lie side by side
            number[at], least[at] = place + self.offsets[p], self.ids[p][place]
        return number, least


    def _rows(self, numbers: np.ndarray, bits: int) -> np.ndarray:
        """The profiles of classes that have 2^bits entries."""
        out = np.empty((len(numbers), 1 << bits), np.int16)
        for p, at in dealt(np.searchsorted(self.offsets, numbers, "right") - 1, len(self.first)):
            begin = self.begin[p][numbers[at] - self.offsets[p]]
            out[at] = self.profile[p][begin[:, None] + np.arange(1 << bits)]
        return out

    def may_link(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
        """False where profiles rule a link out: linked sets differ in (100 - p) / (100 + p) of their sizes' sum at most."""
        bits_a, bits_b = classes_of(sizes_a), classes_of(sizes_b)
        apart = np.empty(len(a), np.int64)
        for key in np.unique(bits_a << 8 | bits_b).tolist():
            x, y = key >> 8, key & 255
            at = np.flatnonzero((bits_a == x) & (bits_b == y))
            step, low = max(1, COMPARED >> max(x, y)), min(x, y)
            for some in np.split(at, range(step, len(at), step)):
                coarse = lambda rows: rows.reshape(len(some), 1 << low, -1).sum(axis=2, dtype=np.int32)  # noqa: B023, E731
                apart[some] = np.abs(coarse(self._rows(a[some], x)) - coarse(self._rows(b[some], y))).sum(axis=1)
        return (100 + percent) * apart <= (100 - percent) * (sizes_a + sizes_b)


@lru_cache(maxsize=2)
def _classes(folder: str, offsets: tuple[int, ...]) -> Classes:
    return Classes(folder, offsets)


@lru_cache(maxsize=2)
def _sketch(folder: str) -> np.ndarray:
    return np.concatenate([mapped(folder, f"sketch-{b}", "<i8") for b in range(SKETCH // BLOCK)])


def _read(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document its id, size and key; per task its sketch, in blocks."""

    def met(batches):
        counts = np.zeros(SKETCH, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for row, flat, sizes in shingle_sets(batch.column(1), shingle):
                np.add.at(counts, (flat % np.uint64(SKETCH)).astype(np.int64), 1)
                n, keys = len(sizes), set_keys(flat, sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, n), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(2).slice(row, n),
                    pa.array(profiles(flat, sizes), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        blocks = [(b, counts[b * BLOCK:(b + 1) * BLOCK]) for b in range(SKETCH // BLOCK)]
        blocks = [(b, packed(c)) for b, c in blocks if c.any()]
        if blocks:
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([
                *[pa.nulls(n, pa.int64())] * 5, pa.nulls(n, pa.binary()),
                pa.array([b for b, _ in blocks], pa.int32()), pa.array([task // FAN_IN] * n, pa.int32()),
                pa.array([c for _, c in blocks], pa.binary())], names)

    names = ["doc_id", "n", "first", "second", "tag", "profile", "block", "fan", "counts"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(
        met, "doc_id long, n long, first long, second long, tag long, profile binary, block int, fan int, counts binary")


def _write_sketch(read: DataFrame, folder: str) -> None:
    def total(table) -> np.ndarray:
        return sum((unpacked(c.as_py(), "<i8") for c in table["counts"]), np.zeros(BLOCK, np.int64))

    def some(key, table):
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([packed(total(table))], pa.binary())})

    def write(key, table):
        save(folder, f"sketch-{key[0].as_py()}", total(table))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    rows = read.where("block IS NOT NULL").select("block", "fan", "counts")
    summed = rows.groupBy("block", "fan").applyInArrow(some, "block int, counts binary")
    written = {r["block"] for r in summed.groupBy("block").applyInArrow(write, "block int").collect()}
    for b in set(range(SKETCH // BLOCK)) - written:
        save(folder, f"sketch-{b}", np.zeros(BLOCK, np.int64))


def _write_classes(read: DataFrame, folder: str, per_part: int) -> tuple[int, ...]:
    """Write the classes; the offsets of their parts."""
    keyed = read.where("n > 0").groupBy("first", "second", "n").agg(
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.min("profile").alias("profile"))
    keyed = settled(keyed)
    parts = max(1, -(-keyed.count() // per_part))

    def placed(batches):
        for batch in batches:
            part = part_of(batch.column(0).to_numpy().astype(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

    def write(key, table):
        p = key[0].as_py()
        first, second = (table[c].to_numpy().astype(np.uint64) for c in ("first", "second"))
        order = np.lexsort((second, first))
        for name, column in (("first", first), ("second", second), ("id", table["id"].to_numpy())):
            save(folder, f"{name}-{p}", column[order])
        classes = 1 << classes_of(table["n"].to_numpy()[order])
        save(folder, f"begin-{p}", (np.cumsum(classes) - classes).astype("<i8"))
        kept = table["profile"].to_pylist()
        save(folder, f"profile-{p}", np.frombuffer(b"".join(kept[k] for k in order.tolist()), np.uint8))
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(first)]})

    made = keyed.mapInArrow(placed, "first long, second long, n long, id long, profile binary, part int").groupBy("part").applyInArrow(
        write, "part int, n long").collect()
    sizes = {r["part"]: r["n"] for r in made}
    return tuple(np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(parts)])]).astype(int).tolist())


def _representatives(batches, classes: Classes, shingle: int):
    """(number, least id, set) of the classes, once for each row that has a class's least id."""
    for batch in batches:
        ids = ids_of(batch.column(0))
        for row, flat, sizes in shingle_sets(batch.column(1), shingle):
            some = np.flatnonzero(sizes > 0)
            keys = set_keys(flat, sizes)[some]
            number, least = classes.find(keys[:, 0], keys[:, 1])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for k in np.flatnonzero(ids[row + some] == least).tolist():
                yield int(number[k]), int(least[k]), flat[ends[some[k]]:ends[some[k] + 1]]


class Forest:
    """Union-find over numbers met so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.Table:
        pairs = [(x, self.root(x)) for x in self.up]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _meet_group(nodes: np.ndarray, sizes: np.ndarray, classes: Classes, forest: Forest, percent: int) -> None:
    """Join whatever profiles do not keep apart; each node is compared with those not yet joined to it."""
    roots = np.array([forest.root(x) for x in nodes.tolist()])
    for k in range(len(nodes)):
        others = np.flatnonzero(roots != roots[k])
        if not len(others):
            return
        one = np.full(len(others), k)
        ok = others[classes.may_link(nodes[others], nodes[one], sizes[others], sizes[one], percent)]
        for x in np.unique(roots[ok]).tolist():
            forest.join(int(nodes[k]), x)
        if len(ok):
            roots[np.isin(roots, np.append(roots[ok], roots[k]))] = forest.root(int(nodes[k]))


def _shingle_regions(docs: DataFrame, folder: str, offsets: tuple[int, ...], percent: int, parts: int, shingle: int) -> DataFrame:
    """(a, b): classes that meet in the region of a shingle, as a forest for each part of the shingles."""

    def sent(held):
        keys, nodes, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        rows = {"part": [], "keys": [], "nodes": [], "sizes": []}
        for p, at in dealt(part_of(keys[order], parts), parts):
            at = order[at]
            rows["part"].append(p)
            rows["keys"].append(packed_sorted(keys[at]))
            rows["nodes"].append(packed(nodes[at]))
            rows["sizes"].append(packed(sizes[at]))
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in rows.items()})

    def met(batches):
        classes, counts = _classes(folder, offsets), _sketch(folder)
        held, n = [], 0
        for number, _, s in _representatives(batches, classes, shingle):
            keep = len(s) - least_overlap(len(s), percent) + 1
            order = np.lexsort((s, counts[(s % np.uint64(SKETCH)).astype(np.int64)]))[:keep]
            held.append((s[order], np.full(keep, number, np.int64), np.full(keep, len(s), np.uint32)))
            n += keep
            if n >= HELD_KEYS:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def meet(key, table):
        keys = np.concatenate([unpacked_sorted(k.as_py()) for k in table["keys"]])
        nodes = np.concatenate([unpacked(c.as_py(), "<i8") for c in table["nodes"]])
        sizes = np.concatenate([unpacked(c.as_py(), "<u4") for c in table["sizes"]]).astype(np.int64)
        order = np.lexsort((nodes, sizes, keys))
        keys, nodes, sizes = keys[order], nodes[order], sizes[order]
        # In size order, a group ends where nothing above can be linked with anything below.
        near = (keys[1:] == keys[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:])
        begin = np.concatenate([[0], np.flatnonzero(~near) + 1])
        length = np.diff(np.append(begin, len(keys)))
        classes, forest = _classes(folder, offsets), Forest()
        two = begin[length == 2]
        a, b, size_a, size_b = np.unique(np.stack([nodes[two], nodes[two + 1], sizes[two], sizes[two + 1]]), axis=1)
        ok = (a != b) & classes.may_link(a, b, size_a, size_b, percent)
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            forest.join(x, y)
        for at, n in zip(begin[length > 2].tolist(), length[length > 2].tolist(), strict=True):
            own = nodes[at:at + n].tolist()
            if len({forest.root(x) for x in own}) > 1:
                _meet_group(np.array(own), sizes[at:at + n], classes, forest, percent)
        return forest.edges()

    runs = docs.select("doc_id", "text").mapInArrow(met, "part int, keys binary, nodes binary, sizes binary")
    return runs.groupBy("part").applyInArrow(meet, "a long, b long")


def _write_dense(pairs: DataFrame, folder: str, name: str, size: int, per_part: int) -> int:
    """Write `value` by `node` as dense arrays, NONE where a node has no value; the nodes of a part."""
    parts = max(1, -(-size // per_part))
    per = max(1, -(-size // parts))
    length = lambda q: max(0, min(size - q * per, per))

    def write(key, table):
        q = key[0].as_py()
        dense = np.full(length(q), NONE, np.int64)
        dense[table["node"].to_numpy() - q * per] = table["value"].to_numpy()
        save(folder, f"{name}-{q}", dense)
        return pa.table({"part": pa.array([q], pa.int32())})

    placed = pairs.select(F.expr(f"cast(node div {per} as int)").alias("part"), "node", "value")
    done = {r["part"] for r in placed.groupBy("part").applyInArrow(write, "part int").collect()}
    for q in set(range(parts)) - done:
        save(folder, f"{name}-{q}", np.full(length(q), NONE, np.int64))
    return per


class Dense:
    def __init__(self, folder: str, name: str, size: int, per: int):
        self.parts, self.per = [mapped(folder, f"{name}-{q}", "<i8") for q in range(max(1, -(-size // per)))], per

    def of(self, nodes: np.ndarray) -> np.ndarray:
        out = np.full(len(nodes), NONE, np.int64)
        for q, at in dealt(nodes // self.per, len(self.parts)):
            out[at] = self.parts[q][nodes[at] - q * self.per]
        return out


@lru_cache(maxsize=4)
def _dense(folder: str, name: str, size: int, per: int) -> Dense:
    return Dense(folder, name, size, per)


def overlaps(one: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with sets laid end to end (none of them empty)."""
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[place] == flat).astype(np.int64), ends[:-1])


class Leaf:
    """The sets of one region, with what is known of who hangs together with whom."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.nodes, self.percent = nodes, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(flat)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, shared))] = np.arange(len(values))
        flat, ends = rank[flat], np.concatenate([[0], np.cumsum(self.sizes)])
        self.sets = [np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.flat, self.ends = np.concatenate(self.sets), ends
        self.groups = np.unique(labels, return_inverse=True)[1]
        keep = self.sizes - -(-percent * self.sizes // 100) + 1
        self.firsts = [s[:k] for s, k in zip(self.sets, keep.tolist(), strict=True)]
        owner = np.repeat(np.arange(len(sets)), keep)
        first = np.concatenate(self.firsts)
        order = np.argsort(first, kind="stable")
        self.owner, self.begin = owner[order], np.searchsorted(first[order], np.arange(len(values) + 1))

    def distance(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlaps and unions of set i with `others`."""
        parts = [self.sets[j] for j in others]
        both = overlaps(self.sets[i], np.concatenate(parts), np.concatenate([[0], np.cumsum(self.sizes[others])]))
        return both, self.sizes[i] + self.sizes[others] - both

    def join(self) -> None:
        """Bring together whatever a chain of links connects."""
        eps, away = 1 - self.percent / 100 + 1e-9, []
        everyone = np.arange(len(self.sizes))
        if len(self.sizes) > 64:
            for p in np.argsort(mixed(self.nodes.astype(np.uint64)))[:4]:
                both, union = self.distance(int(p), everyone)
                away.append(1 - both / union)
                self._link(int(p), everyone[100 * both >= self.percent * union])
        for i in range(len(self.sizes)):
            if (self.groups == self.groups[i]).all():
                return
            found = np.concatenate([self.owner[self.begin[v]:self.begin[v + 1]] for v in self.firsts[i].tolist()])
            found = found[self.groups[found] != self.groups[i]]
            if not len(found):
                continue
            found = np.unique(found)
            small, large = np.minimum(self.sizes[found], self.sizes[i]), np.maximum(self.sizes[found], self.sizes[i])
            ok = 100 * small >= self.percent * large
            for d in away:
                ok &= np.abs(d[found] - d[i]) <= eps
            found = found[ok]
            if len(found):
                both, union = self.distance(i, found)
                self._link(i, found[100 * both >= self.percent * union])

    def _link(self, i: int, others: np.ndarray) -> None:
        met = np.unique(self.groups[others])
        self.groups[np.isin(self.groups, met)] = self.groups[i]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, least node of its group)."""
        order = np.lexsort((self.nodes, self.groups))
        groups = self.groups[order]
        begin = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        least = np.repeat(self.nodes[order][begin], np.diff(np.concatenate([begin, [len(order)]])))
        return self.nodes[order], least


def _join_leaves(regions: DataFrame, percent: int, leaf: int) -> DataFrame:
    """(a, b): a forest of the links in each region. Small regions share a task; `regions` (region, node, label, n, data)."""
    total = regions.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total // leaf))

    def joined(key, table):
        region, nodes, labels = (table[c].to_numpy() for c in ("region", "node", "label"))
        sets = [unpacked_sorted(d.as_py()) for d in table["data"]]
        order = np.argsort(region, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], region[order][1:] != region[order][:-1]]))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in np.split(order, begin[1:]):
            one = Leaf(nodes[at], [sets[k] for k in at.tolist()], labels[at], percent)
            one.join()
            x, y = one.edges()
            a.append(x[x != y])
            b.append(y[x != y])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    dealt_out = regions.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks)).cast("int"))
    return dealt_out.groupBy("task").applyInArrow(joined, "a long, b long")


def _sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.sum("n").alias("size"))


@lru_cache(maxsize=64)
def _pivots(folder: str, level: int, region: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(mapped(folder, f"pivot-{x}-{level}-{region}", k) for x, k in (("sets", "<u8"), ("ends", "<i8"), ("nodes", "<i8")))


def _split(big: DataFrame, folder: str, level: int, percent: int) -> DataFrame:
    """The rows of oversized regions in the regions of their document pivots.

    `links` are pivots within eps, named on one row per node and parent; `label` is one of them if any.
    """
    eps = 1 - percent / 100 + 1e-9
    # The pivots of a region are the least by a hash of their number.
    first = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(level)), "node")
    chosen = big.select("region", "node").withColumn("k", F.row_number().over(first)).where(F.col("k") <= PIVOTS)
    pivots = big.select("region", "node", "data").join(chosen.select("region", "node"), ["region", "node"], "left_semi")

    def write(key, table):
        region = key[0].as_py()
        order = np.argsort(table["node"].to_numpy())
        sets = [unpacked_sorted(table["data"][k].as_py()) for k in order.tolist()]
        save(folder, f"pivot-sets-{level}-{region}", np.concatenate(sets).astype("<u8"))
        save(folder, f"pivot-ends-{level}-{region}", np.cumsum([0, *map(len, sets)]).astype("<i8"))
        save(folder, f"pivot-nodes-{level}-{region}", table["node"].to_numpy()[order].astype("<i8"))
        return pa.table({"region": [region]})

    pivots.groupBy("region").applyInArrow(write, "region long").count()

    def moved(batches):
        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                flat, ends, nodes = _pivots(folder, level, r["region"])
                s = unpacked_sorted(r["data"])
                both = overlaps(s, flat, ends)
                union = np.diff(ends) + len(s) - both
                links = nodes[100 * both >= percent * union].tolist()
                label = min(links, default=r["label"])
                away = 1 - both / union
                near = away.min()
                homes = nodes[(away <= near + 2 * eps) & (both > 0)].tolist() if near < 1 - eps else []
                for pivot in homes + [FAR] * int(near >= 1 - 2 * eps):
                    rows.append({**r, "pivot": pivot, "label": label, "links": links})
                    links, held = [], held + len(r["data"])
                if held >= HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()),
                        ("data", pa.binary()), ("pivot", pa.int64()), ("links", pa.list_(pa.int64()))])
    rows = big.select("region", "node", "label", "n", "data").mapInArrow(
        moved, "region long, node long, label long, n long, data binary, pivot long, links array<long>")
    return rows.withColumnRenamed("region", "parent").withColumn("region", F.xxhash64("parent", F.lit(level), "pivot"))


def _blocks(dense: DataFrame, leaf: int) -> DataFrame:
    """Cells of regions that pivots do not divide: what a label does not hold together, against all, block by block."""
    sizes = dense.groupBy("region", "label").agg(F.sum("n").alias("size"))
    facts = sizes.groupBy("region").agg(F.sum("size").alias("all"), F.max(F.struct("size", "label")).alias("most"))
    half = max(1, leaf // 2)
    facts = facts.select(
        F.col("region").alias("_region"), F.col("most.label").alias("_most"),
        F.ceil(F.col("all") / half).cast("int").alias("_a"),
        F.greatest(F.ceil((F.col("all") - F.col("most.size")) / half), F.lit(1)).cast("int").alias("_q"))
    met = dense.join(facts, dense["region"] == facts["_region"])
    block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda q, a: F.struct(q.alias("q"), a.alias("a"))
    down = F.transform(every(F.col("_q")), lambda i: cell(i, block(F.col("_a"))))
    across = F.transform(every(F.col("_a")), lambda j: cell(block(F.col("_q")), j))
    cells = F.when(F.col("label") == F.col("_most"), down).otherwise(F.array_union(down, across))
    return met.withColumn("_cell", F.explode(cells)).select(
        F.xxhash64("region", "_cell").alias("region"), "node", "label", "n", "data")


def _join_regions(regions: DataFrame, folder: str, percent: int, leaf: int) -> list[DataFrame]:
    """Forests (a, b) of all links of the regions (region, node, label, n, data)."""
    columns = ["region", "node", "label", "n", "data"]
    forests, level = [], 0
    while True:
        sized = regions.join(_sizes(regions), "region")
        forests.append(_join_leaves(sized.where(F.col("size") <= leaf).select(*columns), percent, leaf))
        big = sized.where(F.col("size") > leaf)
        if big.isEmpty():
            return forests
        split = settled(_split(big, folder, level, percent))
        forests.append(split.select(F.col("node").alias("a"), F.explode("links").alias("b")))
        # A region that keeps nine tenths of its parent is dense.
        parents = _sizes(big).select(F.col("region").alias("parent"), F.col("size").alias("whole"))
        facts = split.groupBy("region", "parent").agg(F.sum("n").alias("part")).join(parents, "parent")
        stuck = facts.where((F.col("part") > leaf) & (F.col("part") > 0.9 * F.col("whole"))).select("region")
        dense = split.join(stuck, "region", "left_semi").select(*columns)
        forests.append(_join_leaves(_blocks(dense, leaf), percent, leaf))
        regions, level = settled(split.join(stuck, "region", "left_anti").select(*columns)), level + 1


def similar(docs: DataFrame, percent: int = 85, leaf: int = 2_000_000, per_part: int = 1_000_000,
            shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, tag): a row per document, linked at 100 * overlap >= percent * union.

    `component` numbers the components whatever the ids, null for an empty set; `tag` is a hash of the text. A shingle is `shingle` words. `leaf` bounds the shingles that one task joins, `per_part` the keys of one block of an array.
    """
    texts = docs.select("doc_id", "text")
    folder = scratch(docs.sparkSession, "jaccard")
    read = settled(_read(texts, shingle))
    _write_sketch(read, folder)
    offsets = _write_classes(read, folder, per_part)
    size = offsets[-1]
    rows = read.where("block IS NULL").select("doc_id", "n", "first", "second", "tag")
    if not size:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                           F.lit(None).cast("long").alias("component"), "tag")
    shingles = rows.agg(F.sum("n")).first()[0]
    firsts = shingles * (100 - percent) // 100 + size
    met = components(_shingle_regions(texts, folder, offsets, percent, max(1, -(-firsts // per_part)), shingle))
    alike = met.select("node", F.col("label").alias("value")).unionByName(
        met.select(F.col("label").alias("node"), F.col("label").alias("value")).distinct())
    per = _write_dense(alike, folder, "region", size, per_part)

    def gathered(batches):
        classes, regions = _classes(folder, offsets), _dense(folder, "region", size, per)
        held = []
        for number, least, s in _representatives(batches, classes, shingle):
            region = int(regions.of(np.array([number]))[0])
            if region != NONE:
                held.append((region, number, number, len(s), packed_sorted(s), least))
            if len(held) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)

    names = ["region", "node", "label", "n", "data", "id"]
    sets = texts.mapInArrow(gathered, "region long, node long, label long, n long, data binary, id long")
    sets = settled(sets.dropDuplicates(["node"]))
    forests = _join_regions(sets.drop("id"), folder, percent, leaf)
    links = forests[0]
    for f in forests[1:]:
        links = links.unionByName(f)
    joined = settled(components(links))
    labels = _write_dense(joined.select("node", F.col("label").alias("value")), folder, "label", size, per_part)
    placed = sets.select("node", "id").join(joined, "node", "left").select(F.coalesce("label", "node").alias("node"), "id")
    least = _write_dense(placed.groupBy("node").agg(F.min("id").alias("value")), folder, "least", size, per_part)

    def answered(batches):
        classes, label, ids = _classes(folder, offsets), _dense(folder, "label", size, labels), _dense(folder, "least", size, least)
        for batch in batches:
            n = batch.column(1).to_numpy()
            component = ids_of(batch.column(0)).copy()
            some = np.flatnonzero(n > 0)
            number, own = classes.find(batch.column(2).to_numpy()[some], batch.column(3).to_numpy()[some])
            root = label.of(number)
            root = np.where(root == NONE, number, root)
            found, group = ids.of(root), np.zeros(len(n), np.int64)
            group[some] = root
            component[some] = np.where(found == NONE, own, found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(component, pa.int64(), mask=component == NO_ID),
                 pa.array(group, pa.int64(), mask=n == 0), batch.column(4)],
                ["doc_id", "n_shingles", "component_id", "component", "tag"])

    return rows.mapInArrow(answered, "doc_id long, n_shingles long, component_id long, component long, tag long")


def one_of_each(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """`docs` with one row of every component: that of the least id, a null being the least, then of the least text hash.

    Of rows equal in id and text one stays, and so it is for rows with an empty set.
    """
    grouped = similar(docs, percent=percent, shingle=shingle)
    row = F.struct("doc_id", "tag")
    best = grouped.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(row).alias("r")).select("r.*")
    kept = best.unionByName(grouped.where(F.col("component").isNull()).select("doc_id", "tag").distinct())
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    tagged = docs.withColumn("_own", F.xxhash64("text"))
    stays = tagged.join(kept, tagged["doc_id"].eqNullSafe(kept["_id"]) & (tagged["_own"] == kept["_tag"]), "left_semi")
    first = Window.partitionBy("doc_id", "_own").orderBy(F.hash("text"), *[c for c in ("source", "lang", "n_chars") if c in docs.columns])
    return stays.withColumn("_row", F.row_number().over(first)).where("_row = 1").select(*docs.columns)
