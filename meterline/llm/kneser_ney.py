"""Interpolated modified Kneser-Ney bigrams, counted in Spark, mapped by the workers.

Counting goes through sorted runs. Tasks count the words of their rows and send a
compressed run per range of word hashes; each range's runs are summed and written as a
sorted hash array. A word's id is its place in these arrays. Bigrams are counted the same way, as
pairs of ids, dealt by a mix of both words, so that a word before a third of all
others is still many parts. Each part yields what its bigrams add to every context (how
often, how many followers seen once, twice, oftener) and to every word (how many
different words it follows); summed by ranges of ids these are dense arrays.

To the driver come sizes of parts and counts of counts. Workers map the arrays and look words
and bigrams up by binary search, a batch at a time.

P(w|u) = max(c(uw) - D(c), 0) / c(u) + g(u) P(w);  P(w) = max(N(w) - D(N), 0) / N + g / (V + 1)

with N(w) the words that w follows, D from the counts of counts of each order, and V + 1
for one class of unknown words. A document begins in a context of its own.

A word is known by a 64-bit hash, a pair by the numbers of its words: beyond `MOST_WORDS` different words training stops with an
error. Counts have 64 bits. Two parameters bound memory: `words_per_part` and
`pairs_per_part`, counted on average over evenly spread keys.

Defined cases. A null text is the empty text: one end token. A null id counts as an
empty one. Repeated rows each count. With no training token the model is uniform over
the one class of unknown words, which has probability 1. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import scratch
from meterline.llm.runs import (dealt, lowered_word_hashes, mapped, mixed, packed, packed_sorted, save, summed,
                                unpacked, unpacked_sorted)

#: Stands for the end of a document among the hashes of words.
END = np.uint64(0x5851F42D4C957F2D)
UNKNOWN = -1
#: Keys that a task holds before it sends a run.
KEYS_PER_RUN = 2_000_000
#: Two numbers of words make a key; two numbers are kept for the beginning and for unknown words.
MOST_WORDS = (1 << 32) - 2
RUN = "part int, keys binary, counts binary"


def token_hashes(column: pa.Array):
    """(first row, hashes, tokens of each row) of runs of rows: the words with A-Z lowered, then the end."""
    for row, words, lengths in lowered_word_hashes(column):
        lengths = lengths + 1
        out = np.full(int(lengths.sum()), END, np.uint64)
        word = np.ones(len(out), bool)
        word[np.cumsum(lengths) - 1] = False
        out[word] = words
        yield row, out, lengths


def _runs(part: np.ndarray, keys: np.ndarray, counts: np.ndarray, parts: int):
    """Batches of (part, keys, counts) of sorted `keys`."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rows = {"part": [], "keys": [], "counts": []}
    for p in range(parts):
        at = order[ends[p]:ends[p + 1]]
        if len(at):
            rows["part"].append(p)
            rows["keys"].append(packed_sorted(keys[at]))
            rows["counts"].append(packed(counts[at]))
    if rows["part"]:
        yield pa.RecordBatch.from_pydict({"part": pa.array(rows["part"], pa.int32()),
                                          "keys": pa.array(rows["keys"], pa.binary()),
                                          "counts": pa.array(rows["counts"], pa.binary())})


def _merged(table, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for k, c in zip(table["keys"], table["counts"], strict=True):
        keys.append(unpacked_sorted(k.as_py()))
        counts.append(unpacked(c.as_py(), "<i8").reshape(-1, columns))
    return summed(np.concatenate(keys), np.concatenate(counts))


def _count_words(parts: int):
    shift = 64 - (parts - 1).bit_length()

    def send(held: list[tuple]):
        keys, counts = summed(*[np.concatenate(c) for c in zip(*held, strict=True)])
        part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
        return _runs(part, keys, counts, parts)

    def counted(batches):
        held, n = [], 0
        for batch in batches:
            for _, hashes, _ in token_hashes(batch.column(0)):
                held.append(np.unique(hashes, return_counts=True))
                n += len(held[-1][0])
                if n >= KEYS_PER_RUN:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    return counted


class Vocabulary:
    """Word ids and counts over the mapped hash arrays."""

    def __init__(self, folder: str, offsets: tuple[int, ...]):
        parts = len(offsets) - 1
        self.offsets, self.size = offsets, offsets[-1]
        self.shift = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else None
        self.hashes = [mapped(folder, f"word-{p}", "<u8") if offsets[p + 1] > offsets[p] else np.empty(0, np.uint64)
                       for p in range(parts)]
        self.counts = [mapped(folder, f"count-{p}", "<i8") if offsets[p + 1] > offsets[p] else np.empty(0, np.int64)
                       for p in range(parts)]

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token its word's id, or UNKNOWN, and its count."""
        keys, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(keys), UNKNOWN, np.int64), np.zeros(len(keys), np.int64)
        part = (keys >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(keys), np.int64)
        for p, at in dealt(part, len(self.hashes)):
            held = self.hashes[p]
            if len(held):
                place = np.searchsorted(held, keys[at])
                hit = held[np.minimum(place, len(held) - 1)] == keys[at]
                ids[at[hit]] = place[hit] + self.offsets[p]
                counts[at[hit]] = self.counts[p][place[hit]]
        return ids[back], counts[back]


@lru_cache(maxsize=2)
def vocabulary(folder: str, offsets: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(folder, offsets)


def pair_keys(ids: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """(context << 32 | word) of every token; a document's first token follows context `size`."""
    context = np.empty(len(ids), np.int64)
    context[1:] = ids[:-1]
    context[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = size
    return (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)


def pair_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(parts)).astype(np.int64)


def _count_pairs(folder: str, offsets: tuple[int, ...], parts: int):
    def send(keys: list[np.ndarray]):
        keys = np.concatenate(keys)
        keys, counts = summed(keys, np.ones(len(keys), np.int64))
        return _runs(pair_part(keys, parts), keys, counts, parts)

    def counted(batches):
        words = vocabulary(folder, offsets)
        held, n = [], 0
        for batch in batches:
            for _, hashes, lengths in token_hashes(batch.column(0)):
                held.append(pair_keys(words.of(hashes)[0], lengths, words.size))
                n += len(hashes)
                if n >= KEYS_PER_RUN:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    return counted


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of keys counted 1, 2, 3 and 4 times; k / 2 where these say nothing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def id_part(parts: int, size: int) -> int:
    """Ids of one part of the dense arrays."""
    return max(1, -(-(size + 1) // parts))


def train(docs: DataFrame, folder: str, words_per_part: int = 1_000_000, pairs_per_part: int = 2_000_000) -> dict:
    """Count `docs` (text) and write the arrays below `folder`; the model's numbers, small enough for the driver."""
    texts = docs.select("text")
    sized = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    # A token has two bytes at least, but for the end of a document; distinct words are far fewer.
    most = (sized["bytes"] or 0) // 2 + sized["n"]
    word_parts = 1 << max(0, (-(-most // (8 * words_per_part)) - 1).bit_length())

    def write_words(key, table):
        p = key[0].as_py()
        hashes, counts = _merged(table)
        save(folder, f"word-{p}", hashes.astype("<u8"))
        save(folder, f"count-{p}", counts[:, 0].astype("<i8"))
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(hashes)], "tokens": [int(counts.sum())]})

    made = texts.mapInArrow(_count_words(word_parts), RUN).groupBy("part").applyInArrow(
        write_words, "part int, n long, tokens long").collect()
    sizes = {r["part"]: r["n"] for r in made}
    offsets = tuple(np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(word_parts)])]).tolist())
    total, size = sum(r["tokens"] for r in made), offsets[-1]
    if size >= MOST_WORDS:
        raise ValueError(f"{size} different words: pairs of their numbers do not fit 64 bits")
    model = {"folder": folder, "offsets": offsets, "tokens": total, "words": size, "pair_parts": 1, "id_parts": 1,
             "pair_counts": (0, 0, 0, 0), "word_counts": (0, 0, 0, 0), "pairs": 0, "followers": 0}
    if not total:
        return model
    pair_parts = max(1, -(-total // pairs_per_part))
    id_parts = max(1, -(-(size + 1) // words_per_part))
    per = id_part(id_parts, size)

    def write_pairs(key, table):
        p = key[0].as_py()
        keys, counts = _merged(table)
        counts = counts[:, 0]
        save(folder, f"pair-{p}", keys.astype("<u8"))
        save(folder, f"times-{p}", counts.astype("<i8"))
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        seen = np.stack([counts, counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64)
        contexts, facts = summed(context, seen)
        words, follows = summed(word, np.ones((len(word), 1), np.int64))
        rows = [("c", -1, b"", packed(np.array(_counts_of_counts(counts), np.int64)))]
        for kind, ids, values in (("u", contexts, facts), ("w", words, follows)):
            ends = np.searchsorted(ids, np.arange(id_parts + 1) * per)
            rows += [(kind, q, packed_sorted(ids[a:b]), packed(values[a:b].ravel()))
                     for q, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        kinds, parts, ids, values = zip(*rows, strict=True)
        return pa.table({"kind": list(kinds), "part": pa.array(parts, pa.int32()), "keys": pa.array(ids, pa.binary()),
                         "counts": pa.array(values, pa.binary())})

    def write_ids(key, table):
        kind, q = key[0].as_py(), key[1].as_py()
        if kind == "c":
            counts, values = sum(unpacked(c.as_py(), "<i8") for c in table["counts"]), ()
        else:
            columns = 4 if kind == "u" else 1
            ids, values = _merged(table, columns)
            dense = np.zeros((min(per, size + 1 - q * per), columns), "<i8")
            dense[ids.astype(np.int64) - q * per] = values
            save(folder, f"{'context' if kind == 'u' else 'follows'}-{q}", dense)
            counts = _counts_of_counts(values[:, 0])
        return pa.table({"kind": [kind], "part": pa.array([q], pa.int32()), "counts": [[int(x) for x in counts]],
                         "n": [len(values)], "sum": [0 if kind == "c" else int(values[:, 0].sum())]})

    pairs = texts.mapInArrow(_count_pairs(folder, offsets, pair_parts), RUN).groupBy("part").applyInArrow(
        write_pairs, "kind string, part int, keys binary, counts binary")
    facts = pairs.groupBy("kind", "part").applyInArrow(
        write_ids, "kind string, part int, counts array<long>, n long, sum long").collect()
    counted = lambda kind: tuple(sum(r["counts"][k] for r in facts if r["kind"] == kind) for k in range(4))
    return model | {"pair_parts": pair_parts, "id_parts": id_parts, "pair_counts": counted("c"), "word_counts": counted("w"),
                    "pairs": sum(r["sum"] for r in facts if r["kind"] == "w"),
                    "followers": sum(r["n"] for r in facts if r["kind"] == "w"),
                    "dense": tuple(sorted((r["kind"], r["part"]) for r in facts if r["kind"] != "c"))}


class Model:
    """Log probabilities over the mapped arrays."""

    def __init__(self, folder, offsets, tokens, words, pair_parts, id_parts, pair_counts, word_counts, pairs, followers, dense=()):
        self.words, self.size, self.total, self.pairs = vocabulary(folder, offsets), words, tokens, pairs
        self.parts, self.per = pair_parts, id_part(id_parts, words)
        self.pair_d, self.word_d = discounts(pair_counts), discounts(word_counts)
        if not tokens:
            return
        self.keys = [mapped(folder, f"pair-{p}", "<u8") for p in range(pair_parts)] if pairs else []
        self.times = [mapped(folder, f"times-{p}", "<i8") for p in range(pair_parts)] if pairs else []
        self.dense = {(kind, q): mapped(folder, f"{'context' if kind == 'u' else 'follows'}-{q}", "<i8").reshape(
            -1, 4 if kind == "u" else 1) for kind, q in dense}
        # Lower order: the part that discounting frees goes evenly to V words and the unknown class.
        n1, n2 = word_counts[0], word_counts[1]
        self.free = sum(d * n for d, n in zip(self.word_d, (n1, n2, followers - n1 - n2), strict=True)) / max(1, pairs)

    def _dense(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """The rows of sorted distinct `ids`."""
        out = np.zeros((len(ids), 4 if kind == "u" else 1), np.int64)
        q = ids // self.per
        for k in np.unique(q):
            if (kind, int(k)) in self.dense:
                out[q == k] = self.dense[kind, int(k)][ids[q == k] - k * self.per]
        return out

    def _times(self, keys: np.ndarray) -> np.ndarray:
        """How often each of the sorted distinct pairs was seen."""
        out = np.zeros(len(keys), np.int64)
        part = pair_part(keys, self.parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in range(self.parts):
            at, held = order[ends[p]:ends[p + 1]], self.keys[p]
            if len(at) and len(held):
                place = np.searchsorted(held, keys[at])
                hit = held[np.minimum(place, len(held) - 1)] == keys[at]
                out[at[hit]] = self.times[p][place[hit]]
        return out

    def log10(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 probability of every token of documents laid end to end."""
        if not self.total:
            return np.zeros(len(ids))
        words = np.where(ids == UNKNOWN, self.size + 1, ids)  # no row of the arrays
        keys, back = np.unique(pair_keys(words, lengths, self.size), return_inverse=True)
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        distinct, at = np.unique(word, return_inverse=True)
        follows = np.where(distinct <= self.size, self._dense("w", np.minimum(distinct, self.size))[:, 0], 0)
        lower = (follows - discount(follows, self.word_d)) / max(1, self.pairs) + self.free / (self.size + 1)
        lower = lower[at]
        distinct, at = np.unique(context, return_inverse=True)
        facts = np.where((distinct <= self.size)[:, None], self._dense("u", np.minimum(distinct, self.size)), 0)[at]
        times, total = self._times(keys), facts[:, 0]
        free = facts[:, 1:] @ np.array(self.pair_d)
        known = total > 0
        p = np.where(known, (times - discount(times, self.pair_d) + free * lower) / np.maximum(total, 1), lower)
        return np.log10(p)[back]


@lru_cache(maxsize=2)
def _model(items: tuple) -> Model:
    return Model(**dict(items))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` (doc_id, held_out, text) scored: a row per document."""
    items = tuple(sorted(model.items()))

    def scored(batches):
        lm = _model(items)
        for batch in batches:
            for row, hashes, lengths in token_hashes(batch.column(2)):
                ids, counts = lm.words.of(hashes)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                base = np.log10((counts + 0.5) / (lm.total + 0.5 * (lm.size + 1)))
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(lengths.astype(np.int64)),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.full(n, lm.total, np.int64)), pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(lm.log10(ids, lengths), starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train_and_score(docs: DataFrame) -> DataFrame:
    """Every document scored by a model of those not held out, with its perplexity."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(marked.where(~F.col("held_out")), scratch(docs.sparkSession, "kneser-ney"))
    return score(marked, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
