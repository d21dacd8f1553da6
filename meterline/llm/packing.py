"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs linear * n + quadratic * n^2: attention stays inside a
piece, so long pieces are dear. A document of more than a sequence is cut into whole
sequences and a rest. The rests of a block of documents then meet in as many
sequences as their tokens fill: in descending order each goes to the cheapest sequence
that has room for it, and is cut only where none has, at the room of the cheapest with any.
A block therefore wastes less than one sequence, and its sequences cost nearly the same.

Documents stay where they are read: a task tokenises and packs its own rows, block by
block, so nothing is shuffled, and a rerun of a lost task gives the same pieces. A task
holds one document and the rests of one block. Sequence ids carry the task's number.

Ids are those of `tokenizers` for the vocabulary's JSON file. They are computed by
`tiktoken` from the same vocabulary as ranks, four times as fast; a text that holds an added
token of the JSON file goes through `tokenizers` itself. Both are compared in the tests.

Defined cases. A null text is the empty text: one end token. Equal documents are packed
one by one. Null ids are kept. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "cost double")


class Tokens:
    """Token ids of texts under a byte-level BPE vocabulary, each with the end token behind it."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str, end_id: int):
        import tiktoken

        self.json_path, self.end = json_path, np.array([end_id], "<u4")
        with open(json_path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file).get("added_tokens", [])]
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = None

    def ids(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            if self.exact is None:
                from tokenizers import Tokenizer
                self.exact = Tokenizer.from_file(self.json_path)
            own = np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            own = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([own.astype("<u4", copy=False), self.end])


@lru_cache(maxsize=2)
def _tokens(*parameters) -> Tokens:
    return Tokens(*parameters)


def public_vocabulary(name: str = "byte_bpe_50k", end_id: int = 0) -> tuple[str, str, str, int]:
    """The parameters of `Tokens` for a vocabulary of the machine's public tokenizers."""
    import public_tokenizers

    return (str(public_tokenizers.path(f"{name}.json")), str(public_tokenizers.path(f"{name}.tiktoken")),
            public_tokenizers.PATTERN, end_id)


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) of every piece; sequences count from 0.

    Items are at most `capacity` long. As many sequences are opened as the total needs.
    """
    total = sum(lengths)
    count = -(-total // capacity)
    fill, cost = [0] * count, [0.0] * count
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, k) for k in range(count)]
    cheapest = np.full(capacity + 1, np.inf)  # of the sequences with so much room
    if count:
        cheapest[capacity] = 0.0
    todo = [(-n, item, 0) for item, n in enumerate(lengths) if n]
    heapq.heapify(todo)  # a cut rest goes back among the items of its length
    out = []
    while todo:
        n, item, start = heapq.heappop(todo)
        n = -n
        room = n + int(cheapest[n:].argmin())
        if cheapest[room] == np.inf:
            room = 1 + int(cheapest[1:].argmin())
            heapq.heappush(todo, (-(n - room), item, start + room))
            n = room
        _, k = heapq.heappop(heaps[room])
        cheapest[room] = heaps[room][0][0] if heaps[room] else np.inf
        out.append((item, start, n, k, fill[k]))
        fill[k] += n
        cost[k] += linear * n + quadratic * n * n
        heapq.heappush(heaps[room - n], (cost[k], k))
        cheapest[room - n] = heaps[room - n][0][0]
    return out


def pack(docs: DataFrame, vocabulary: tuple[str, str, str, int], max_tokens: int = 1024, linear: float = 1.0,
         quadratic: float = 1 / 2048, block_docs: int = 8192, with_ids: bool = False) -> DataFrame:
    """A row per piece of a document: where it lies in the document and in its sequence.

    `with_ids` adds the piece's token ids, as little-endian unsigned 32-bit binary.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(*vocabulary)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        rests: list[tuple] = []

        def put(doc_id, ids, start, total, seq, offset):
            n = len(ids)
            row = (doc_id, start, n, zlib.crc32(ids.tobytes()), total, seq, offset, linear * n + quadratic * n * n)
            rows.append((*row, ids.tobytes()) if with_ids else row)

        def flush():
            nonlocal sequence
            pieces = balance([len(r[1]) for r in rests], max_tokens, linear, quadratic)
            for item, start, n, k, offset in pieces:
                doc_id, ids, before, total = rests[item]
                put(doc_id, ids[start:start + n], before + start, total, sequence + k, offset)
            sequence += 1 + max((p[3] for p in pieces), default=-1)
            rests.clear()

        def drained():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.ids(text.as_py() or "")
                total, whole = len(ids), len(ids) // max_tokens * max_tokens
                for at in range(0, whole, max_tokens):
                    put(doc_id, ids[at:at + max_tokens], at, total, sequence, 0)
                    sequence += 1
                if total > whole:
                    rests.append((doc_id, ids[whole:].copy(), whole, total))
                if len(rests) >= block_docs:
                    flush()
                if len(rows) >= 4096:
                    yield drained()
        flush()
        if rows:
            yield drained()

    fields = [("doc_id", pa.int64()), *[(n, pa.int64()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("cost", pa.float64())]
    arrow = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA + ", ids binary" * with_ids)
