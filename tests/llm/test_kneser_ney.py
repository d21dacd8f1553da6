import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from meterline.llm import kneser_ney as kn
from tests.llm.fixtures import awkward, empty


def brute(docs):
    """[(doc_id, text)] -> {(doc_id, text): (held, n, known, N, base, score)}."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    train = [tokens(t) for d, t in docs if not held(d)]
    count = Counter(w for x in train for w in x)
    total, distinct = sum(count.values()), len(count)
    pairs = Counter(p for x in train for p in zip([None, *x], x))
    follows = Counter(w for _, w in pairs)
    context = defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), n in pairs.items():
        context[u][0] += n
        context[u][min(n, 3)] += 1
    of = lambda c: kn.discounts(tuple(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))
    d2, d1 = of(pairs), of(follows)
    cut = lambda n, d: n - d[min(n, 3) - 1] if n else 0.0
    free = sum(d1[min(v, 3) - 1] for v in follows.values()) / max(1, len(pairs))

    def p(u, w):
        low = cut(follows[w], d1) / len(pairs) + free / (distinct + 1)
        if u not in context:
            return low
        c = context[u]
        return (cut(pairs[u, w], d2) + sum(d * n for d, n in zip(d2, c[1:])) * low) / c[0]

    out = {}
    for d, t in docs:
        x = tokens(t)
        out[d, t] = (held(d), len(x), sum(count[w] > 0 for w in x), total,
                     sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in x),
                     sum(math.log10(p(u, w)) for u, w in zip([None, *x], x)))
    return out, p, count, context


def test_matches_brute_force(spark, tmp_path):
    docs = awkward(spark, extra="held_out,score")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    want, p, count, context = brute(data)
    marked = docs.select("doc_id", "text", kn.held_out(docs["doc_id"]).alias("held_out"))
    for k, parameters in enumerate(({}, {"words_per_part": 40, "pairs_per_part": 900})):
        model = kn.train(marked.where("NOT held_out"), str(tmp_path / str(k)), **parameters)
        got = defaultdict(list)
        for r in kn.score(marked, model).collect():
            got[r.doc_id].append(r)
        for (d, _), w in want.items():
            for r in got[d]:
                assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
                assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)
    # Every context's distribution sums to 1 over the words and the class of unknown ones.
    for u in [None, *list(context)[1:40:8]]:
        assert sum(p(u, w) for w in count) + p(u, b"never seen") == pytest.approx(1.0)


def test_learns_what_follows_what(spark):
    rng = random.Random(8)
    after = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(3)] for i in range(60)}
    docs = []
    for d in range(300):
        words = ["w0"]
        for _ in range(60):
            words.append(rng.choice(after[words[-1]]))
        docs.append((d, " ".join(words)))
    rows = kn.train_and_score(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert rows and sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.5


def test_discounts():
    assert kn.discounts((0, 5, 5, 5)) == (0.5, 1.0, 1.5)
    d = kn.discounts((100, 40, 20, 10))
    y = 100 / 180
    assert d == pytest.approx((1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))


def test_nothing_to_learn_from_and_empty(spark):
    assert kn.train_and_score(empty(spark)).count() == 0
    held = [d for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    rows = kn.train_and_score(spark.createDataFrame([(d, "some words") for d in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in rows] == [(3, 0, 0, 0.0, 0.0)] * 2
