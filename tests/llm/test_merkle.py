import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meterline.llm import merkle
from tests.llm import fixtures


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fields(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    """The root, and each node's siblings from below."""
    proofs, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for k in range(0, len(nodes), 2):
            run = nodes[k:k + 2]
            for j, members in enumerate(own[k:k + 2]):
                for m in members:
                    proofs[m] += run[:j] + run[j + 1:]
            above.append(h(*run))
            held.append([m for members in own[k:k + 2] for m in members])
        nodes, own = above, held
    return nodes[0], proofs


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted (doc_id, leaf, subroot, root, proof hash)."""
    groups = {}
    for r in rows:
        doc_id, text, lang, source, n_chars = r
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), h(fields((doc_id, source, lang, n_chars, text))), doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = tree([leaf for _, leaf, _ in groups[g]])
    root, top = tree([trees[g][0] for g in names])
    return sorted(((doc_id is not None, doc_id or 0), leaf, trees[g][0], root, h(*proof, *top[n]))
                  for n, g in enumerate(names) for (_, leaf, doc_id), proof in zip(groups[g], trees[g][1]))


def run(docs, levels, tampered=None):
    leaf = lambda n: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    listed = merkle.manifest(docs, "lang", "doc_id", leaf(F.col("n_chars")), levels, changed=leaf(F.col("n_chars") + 1))
    claimed = F.when(tampered, F.col("changed")).otherwise(F.col("leaf")) if tampered is not None else F.col("leaf")
    return merkle.checked(listed.withColumn("claimed", claimed), "doc_id", "claimed").collect()


def plain(rows):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_odd_tables(spark, levels):
    docs = fixtures.awkward(spark, "digest,key,place,nodes,root,witness,leaf")
    got = run(docs, levels)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)
    assert plain(got) == brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1), (3, 1, 5), (4, 8, 16), (17, 9, 33, 1, 2), (31, 100)])
def test_every_shape_of_groups(spark, sizes):
    rows = [(k, f"t{k}", f"g{g}", "s", k) for g, size in enumerate(sizes) for k in range(1000 * g, 1000 * g + size)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, fixtures.DOCUMENTS)
    assert plain(run(docs, 2)) == brute(rows)


def test_many_groups_and_group_order_by_bytes(spark):
    names = [None, "", "=", "a", "Z", "é", "\U0001f600", "￿", *[f"l{k}" for k in range(60)]]
    rows = [(k, "t", name, None, None) for k, name in enumerate(names)]
    assert plain(run(spark.createDataFrame(rows, fixtures.DOCUMENTS), 2)) == brute(rows)


def test_a_changed_row_is_found_and_a_null_count_is_not_changed(spark):
    rows = [(k, f"t{k}", "en", "s", None if k == 3 else k) for k in range(20)]
    got = run(spark.createDataFrame(rows, fixtures.DOCUMENTS), 2, F.col("doc_id").isin(3, 4, 19))
    assert {r["doc_id"] for r in got if not r["verified"]} == {4, 19}
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in got)


def test_witnesses_grow_with_every_completed_sibling():
    digests = [h(str(k)) for k in range(11)]
    appends, seen = merkle.Appends(), []
    for d in digests:
        before = [len(w) for w in appends.witnesses]
        appends.append(d)
        assert all(len(w) >= n for w, n in zip(appends.witnesses, before))
        seen.append([height for height, _, _ in appends.open])
    assert seen[6] == [2, 1, 0] and seen[7] == [3] and seen[10] == [3, 1, 0]
    root, proofs = tree(digests)
    assert appends.closed(4) == root and appends.witnesses == proofs
    assert [merkle.climbed(d, k, 11, iter(p)) for k, (d, p) in enumerate(zip(digests, proofs))] == [root] * 11


@pytest.mark.parametrize("sizes", [[{"a": 1}, {"a": 1, "b": 3}, {"b": 1}], [{"a": 9, "b": 4}, {"a": 7}, {"a": 1, "c": 5}], [{"a": 40}, {"a": 1}]])
def test_a_ledger_of_batches_is_the_manifest_of_the_whole(spark, tmp_path, sizes):
    ledger, rows, at = merkle.Ledger(spark, str(tmp_path / "ledger"), 2), [], 0
    leaf = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    for n, groups in enumerate(sizes, start=1):
        batch = [(at + k, f"t{at + k}", g, "s", k) for g, size in groups.items() for k in range(1000 * ord(g), 1000 * ord(g) + size)]
        at += 50
        rows += batch
        random.Random(n).shuffle(batch)
        for _ in range(2 if n == 2 else 1):  # a batch that is repeated replaces itself
            ledger.append(spark.createDataFrame(batch, fixtures.DOCUMENTS), "lang", "doc_id", leaf, n)
        listed = ledger.manifest(n, "doc_id")
        got = merkle.checked(listed.withColumn("claimed", F.col("leaf")), "doc_id", "claimed").collect()
        assert all(r["verified"] for r in got) and plain(got) == brute(rows)
    # Full blocks were written once.
    full = spark.read.parquet(str(tmp_path / "ledger" / "full"))
    assert full.count() == full.select("key", "place").distinct().count()


def test_empty_table(spark):
    assert run(fixtures.empty(spark), 2) == []


def test_a_group_is_many_blocks(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
                                    F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    listed = merkle.manifest(docs, "lang", "doc_id", merkle.leaf(F.col("doc_id")), 3)
    places = [r["place"] for r in listed.select("place").orderBy("doc_id").collect()]
    assert places == list(range(1000))
