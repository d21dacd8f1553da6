import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from meterline.llm import packing
from tests.llm.fixtures import awkward, awkward_texts, empty


@pytest.fixture(scope="module")
def exact():
    import public_tokenizers
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_ids_are_those_of_tokenizers(exact):
    tokens = packing.Tokens(*packing.public_vocabulary())
    rng = random.Random(2)
    texts = [t for t in awkward_texts() if t is not None and len(t) < 40_000]
    texts += ["a<|endoftext|>b", "  lead\n\n\ntrail  ", "don't we'll I'M", "１２３ ٣ ½", "日本語のテキスト", "é‍﻿"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD800), rng.randrange(0xE000, 0x1F800)]))
                      for _ in range(200)) for _ in range(100)]
    for text in texts:
        assert tokens.ids(text).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 0], text[:80]


def test_pieces_cover_every_document_once(spark, exact):
    docs = awkward(spark, extra="start,sequence_id")
    pieces = packing.pack(docs, packing.public_vocabulary(), with_ids=True).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append([*exact.encode(r.text or "", add_special_tokens=False).ids, 0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length and p.length > 0
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for doc_id, texts in ids.items():
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            own = sorted(by_doc[doc_id], key=lambda p: p.start)
            assert np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in own]).tolist() == texts[0]
            assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
            assert {p.doc_tokens for p in own} == {len(texts[0])}
    tasks = len({s >> 36 for s in by_sequence})
    for own in by_sequence.values():
        own = sorted(own, key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert sum(p.length for p in own) <= 1024
    total = sum(len(t) for texts in ids.values() for t in texts)
    assert len(by_sequence) * 1024 - total < 1024 * tasks


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 1025) for _ in range(3000)]
    pieces = packing.balance(lengths, 1024, 1.0, 1 / 2048)
    cost, fill = defaultdict(float), defaultdict(int)
    for _, _, n, k, offset in pieces:
        assert fill[k] == offset
        fill[k] += n
        cost[k] += n + n * n / 2048
    assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= 1024
    assert len(fill) == -(-sum(lengths) // 1024)
    in_order = [0.0] * len(fill)  # the same pieces in the order of the documents
    at = 0
    for n in lengths:
        while n:
            k, take = at // 1024, min(n, 1024 - at % 1024)
            in_order[k] += take + take * take / 2048
            at, n = at + take, n - take
    assert np.std(list(cost.values())) < np.std(in_order)


def test_empty(spark):
    assert packing.pack(empty(spark), packing.public_vocabulary()).count() == 0
    assert packing.balance([], 1024, 1.0, 1.0) == []
