import random
from collections import Counter

import pytest

from meterline.llm import jaccard
from meterline.llm.components import components
from tests.llm.fixtures import awkward, empty, sentence


def brute(docs, percent, size=4):
    """[(doc_id, text)] -> {position: (n, component)}; a null id is the least."""
    least, sets, root = groups(docs, percent, size)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def one_of_each(docs, percent, size):
    """Positions of the rows that stand for their group, by their least id, null first; equal texts of one id count once."""
    _, sets, root = groups(docs, percent, size)
    seen, out = {}, Counter()
    for i, (d, text) in enumerate(docs):
        group = root(i) if sets[i] else ("empty", d, text)
        seen.setdefault(group, set()).add(((d is not None, d or 0), text))
    for rows in seen.values():
        least = min(k for k, _ in rows)
        out[tuple(sorted({(k, t) for k, t in rows if k == least}, key=repr))] += 1
    return out


def groups(docs, percent, size):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    order = lambda d: (d is not None, d or 0)
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d, key=order)
    return least, sets, root


def answers(frame, **parameters):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(frame, **parameters).collect()), key=repr)


def test_matches_brute_force(spark):
    docs = awkward(spark, extra="region,n_shingles,component_id")
    assert answers(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 85)


@pytest.fixture(scope="module")
def crowd():
    """Chains of near copies around three texts, one shared passage, and bystanders."""
    rng = random.Random(11)
    passage = sentence(rng, 60, 10_000)
    docs = []
    for k in range(3):
        words = sentence(rng, 80, 10_000).split()
        for _ in range(50):
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(80)] = f"e{rng.randrange(10_000)}"
            docs.append(" ".join(words))
    docs += [f"{passage} {sentence(rng, 20, 10_000)}" for _ in range(60)]
    docs += [sentence(rng, rng.randrange(3, 60), 10_000) for _ in range(60)]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("leaf", [2_000_000, 3_000, 400])
def test_splitting_regions_loses_no_link(spark, crowd, leaf):
    frame = spark.createDataFrame(crowd, "doc_id long, text string")
    assert answers(frame, leaf=leaf, per_part=2_000) == brute(crowd, 85)


def test_dense_region_in_blocks(spark):
    rng = random.Random(3)
    common = sentence(rng, 100, 10_000).split()
    docs = []
    for i in range(60):  # all within reach of each other's pivots, linked only here and there
        words = list(common)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(100)] = f"x{rng.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert answers(frame, leaf=500) == brute(docs, 85)


def test_one_row_of_each_group_where_ids_are_null_or_shared(spark):
    rng = random.Random(9)
    texts = [sentence(rng, 80, 10_000) for _ in range(5)]
    near = lambda k, n: f"{texts[k]} " + " ".join(f"n{n}" for _ in range(3))
    rows = [(None, near(0, i)) for i in range(6)] + [(None, near(1, i)) for i in range(4)]  # two groups without ids
    rows += [(3, texts[2]), (9, near(2, 1)), (3, texts[3]), (8, near(3, 1)), (7, texts[4]), (7, texts[4])]  # an id of two groups
    rows += [(None, ""), (None, None), (5, " "), (5, " ")]
    frame = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    got = jaccard.one_of_each(frame, 80, 5).collect()
    want = one_of_each(rows, 80, 5)
    order = lambda d: (d is not None, d or 0)
    kept = Counter((order(r.doc_id), r.text) for r in got)
    assert sum(kept.values()) == sum(want.values()) == 5 + 3
    for choices, n in want.items():
        assert sum(kept[c] for c in choices) == n, choices


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k != v}


def test_empty(spark):
    assert jaccard.similar(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert answers(blank) == [(1, 0, 1), (2, 0, 2)]
