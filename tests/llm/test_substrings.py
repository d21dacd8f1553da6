import hashlib

import numpy as np

from meterline.llm import substrings
from tests.llm.fixtures import awkward, empty, rows, awkward_texts, DOCUMENTS


def brute(docs, size):
    """docs: (doc_id, words); None sorts first."""
    order = lambda d: (-(1 << 63) if d is None else d)
    first = {}
    for d, words in docs:
        for i in range(len(words) - size + 1):
            key = tuple(words[i:i + size])
            at = (order(d), i)
            first[key] = min(first.get(key, at), at)
    out = []
    for d, words in docs:
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i:i + size])] < (order(d), i):
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    docs = awkward(spark, extra="n_words,spans")
    data = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    for size, per_part in ((20, 4_000_000), (9, 300)):
        got = substrings.deduplicate(docs, size=size, keys_per_part=per_part).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == brute(data, size)


def test_factors_are_copies_of_earlier_text(spark):
    docs = spark.createDataFrame(rows(awkward_texts()), DOCUMENTS)
    words = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    n = 0
    for r in substrings.deduplicate(docs, with_text=True).collect():
        covered = set()
        for s in r.spans:
            own = words[r.doc_id][s.start:s.start + s.length]
            assert own == words[s.ref_doc][s.ref_start:s.ref_start + s.length] and len(own) == s.length >= 20
            assert (s.ref_doc, s.ref_start) < (r.doc_id, s.start)
            covered.update(range(s.start, s.start + s.length))
            n += 1
        assert len(covered) == r.n_removed
        assert r.kept_text.encode().split() == [w for i, w in enumerate(words[r.doc_id]) if i not in covered]
    assert n > 10


def test_windows_cross_no_document_and_ties_count_twice():
    chunk = substrings.Chunk()
    chunk.add(1, [b"a"] * 19)
    chunk.add(2, [b"a"] * 22)
    windows = substrings.Windows(chunk, 20)
    assert windows.starts.tolist() == [19, 20, 21]
    assert len(windows.anchors) > 1 and len(np.unique(windows.anchors)) == 1


def test_empty(spark):
    assert substrings.deduplicate(empty(spark)).count() == 0
