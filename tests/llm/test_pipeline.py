"""Every stage of the pipeline against a brute-force version, each on its own input."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from meterline.llm import mixing, packing
from tests.llm import test_jaccard, test_mixing, test_rules, test_secrets
from tests.llm.fixtures import DOCUMENTS, awkward, empty, sentence


def stages():
    return dict(corpus_pipeline.STAGES)


def documents(spark):
    """The awkward ones, some with secrets in them, and a clashing column."""
    docs = awkward(spark, extra="kept")
    prose = "plain words before a key and then some more of them to make the text long enough to be kept by all rules "
    rows = [(2000 + i, f"{prose}{i} {chr(97 + i) * 5} {secret} {prose[::-1]}", "en", "src1", 1)
            for i, secret in enumerate(t for t in test_secrets.TEXTS if t and len(t) < 200)]
    rng = random.Random(21)
    rows += [(3000 + i, f"{sentence(rng, 30, 3000)}\nAll rights reserved 2024 by the makers of this\n{sentence(rng, 30, 3000)}", "en", "src0", 1)
             for i in range(20)]
    return docs.unionByName(spark.createDataFrame(rows, DOCUMENTS), allowMissingColumns=True)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_stages_match_brute_force(spark):
    run = stages()
    docs = documents(spark)
    out = run["quality_rules"](spark, docs, "").collect()
    line = "all rights reserved 0000 by the makers of this"
    want = Counter()
    for r in docs.collect():
        n, *_, failed = test_rules.brute(r.text)
        # Enough documents of src0 hold the line; the other hosts have too few.
        kept = [x for x in (r.text or "").split("\n") if r.source != "src0" or x.strip().lower().replace("2024", "0000") != line]
        left = sum(len(test_rules.split_words(x)) for x in kept)
        if not failed and left >= 20 and n - left <= 0.5 * n:
            text = "\n".join(kept)
            want[(r.doc_id, text, r.lang, r.source, len(text))] += 1
    assert bag(out) == want
    assert not any("All rights" in r.text for r in out if r.source == "src0")

    docs = spark.createDataFrame(out, DOCUMENTS)
    out = run["near_duplicates"](spark, docs, "").collect()
    rows = docs.collect()
    want = test_jaccard.one_of_each([(r.doc_id, r.text) for r in rows], corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE)
    kept = Counter(((r.doc_id is not None, r.doc_id or 0), r.text) for r in out)
    assert len(out) == sum(want.values()) < docs.count() and set(out) <= set(rows)
    assert all(sum(kept[c] for c in choices) == n for choices, n in want.items())

    docs = spark.createDataFrame(out, DOCUMENTS)
    out = run["secret_scan"](spark, docs, "").collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    masked = 0
    for r in out:
        spans = test_secrets.brute(texts[r.doc_id])
        added = "gho_" in texts[r.doc_id] or "PRIVATE KEY" in texts[r.doc_id]
        if spans and not added:
            expected, at = "", 0
            for start, _, end, _ in spans:
                if start >= at:
                    expected += texts[r.doc_id][at:start] + "[secret]"
                at = max(at, end)
            assert r.text == expected + texts[r.doc_id][at:]
            masked += 1
        elif not added:
            assert r.text == texts[r.doc_id]
        assert r.n_chars == len(r.text) and "AKIAZ9Z9" not in r.text
    assert masked > 4

    docs = spark.createDataFrame(out, DOCUMENTS)
    out = run["source_mixing"](spark, docs, "").collect()
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len(r.text.encode()) + 1
    scale = sum(size.values()) / sum(math.sqrt(x) for x in size.values())
    want = Counter()
    for r in docs.collect():
        rate = round(math.sqrt(size[r.source]) * scale / size[r.source], mixing.DECIMALS)
        parts = max(1, math.ceil(rate / mixing.SPLIT))
        own = "" if r.doc_id is None else r.doc_id
        want[tuple(r)] += sum(test_mixing.poisson(test_mixing.uniform(0, own, j) / 2**52, rate / parts) for j in range(1, parts + 1))
    assert bag(out) == +want

    docs = spark.createDataFrame(out, DOCUMENTS)
    pieces = run["sequence_packing"](spark, docs, "").collect()
    tokens = packing.Tokens(*packing.public_vocabulary())
    # Every id of every copy of a document lies in one piece; pieces of copies start at the same places.
    need, got, places = Counter(), Counter(), defaultdict(list)
    own = defaultdict(dict)
    for r in docs.collect():
        ids = list(tokens.ids(r.text))
        own[r.doc_id][tuple(ids)] = ids
        need.update((r.doc_id, tuple(ids), k) for k in range(len(ids)))
    for p in pieces:
        crc = lambda ids: zlib.crc32(b"".join(struct.pack("<I", i) for i in ids))
        of = [k for k, ids in own[p.doc_id].items() if len(ids) == p.doc_tokens and crc(ids[p.start:p.start + p.length]) == p.ids_crc32]
        assert of, "no document has these ids there"
        got.update((p.doc_id, of[0], k) for k in range(p.start, p.start + p.length))
        places[p.sequence_id] += range(p.offset, p.offset + p.length)
    assert got == need
    assert all(sorted(at) == list(range(len(at))) and len(at) <= 1024 for at in places.values())


def test_near_copies_of_five_words_and_four_fifths(spark):
    rng = random.Random(31)
    whole = lambda k, n: [f"{k}-{rng.randrange(10**9)}" for _ in range(n)]
    sets = lambda words, size: {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
    alike = lambda a, b, size: len(sets(a, size) & sets(b, size)) / len(sets(a, size) | sets(b, size))
    base, other = whole("a", 300), whole("b", 300)
    longer = base + whole("c", 65)
    edited = list(other)
    for at in range(20, 300, 50):
        edited[at] = f"e{at}"
    apart = whole("d", 300)
    further = apart + whole("f", 80)
    assert 0.815 < alike(base, longer, 5) < 0.825 and alike(base, longer, 4) < 0.85
    assert 0.8 < alike(other, edited, 5) < 0.85 and alike(apart, further, 5) < 0.8
    texts = [base, longer, other, edited, apart, further]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS)
    assert sorted(r.doc_id for r in stages()["near_duplicates"](spark, docs, "").collect()) == [0, 2, 4, 5]


def test_columns_and_registration(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mixing", "sequence_packing"]
    assert entry.queries()["pipeline"] and "pipeline" not in entry.oracle_sql()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty(spark), "").columns == list(corpus_pipeline.COLUMNS), name


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, None, None, None, None)]])
def test_runs_on_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
