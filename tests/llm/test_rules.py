from pyspark.sql import functions as F

from meterline.llm import rules
from tests.llm.fixtures import awkward, empty

SPACES = " \t\n\x0b\x0c\r"


def split_words(text):
    return [w for w in (text or "").translate({ord(c): " " for c in SPACES}).split(" ") if w]


def brute(text):
    words, text = split_words(text), text or ""
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [line for line in text.split("\n") if split_words(line)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_base_counts_match_brute_force(spark):
    docs = awkward(spark, extra="n_words,kept,clean_text,h1")
    got = rules.base_counts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.doc_id


def test_shared_lines_go_and_depleted_documents_are_rejected(spark):
    docs = awkward(spark, extra="kept,_removed")
    got = rules.apply_rules(docs, min_docs=5, min_left=20, max_lost=0.5).collect()
    assert len(got) == docs.count()
    with_line = [r for r in got if r.text and "All rights reserved" in r.text]
    assert len(with_line) == 30
    for r in with_line:
        assert "All rights reserved" not in r.clean_text and r.n_removed_words == 9 and r.kept
        assert r.clean_text == "\n".join(x for x in r.text.split("\n") if "All rights" not in x)
    # Copies of one document keep their lines: they are one text.
    for r in got:
        if r.text and r.text.startswith(next(t.text for t in got if t.doc_id == 5)[:40]):
            assert r.n_removed_lines == 0


def test_depletion(spark):
    line = "some words that every page of this host repeats again and again without an end"
    texts = [f"{line} \nown a b c d {chr(97 + i)}\n{line}" for i in range(26)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = rules.apply_rules(docs, min_docs=20)
    assert {r.n_removed_lines for r in got.collect()} == {2}
    assert got.where("kept").count() == 0
    other = docs.withColumn("source", F.col("doc_id").cast("string"))
    assert rules.apply_rules(other, min_docs=20).where("n_removed_lines > 0").count() == 0


def own_words(i, n=60):
    own = "".join(chr(97 + int(d)) for d in str(i))  # digits are all one in a normalised line
    return " ".join(f"{own}-{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


def block(name, n):
    return [f"{name} {chr(97 + k)} of every page on this host" for k in range(n)]


def test_headers_and_footers_of_several_lines_go(spark):
    shared = block("header", 5) + block("footer", 5)
    page = lambda i, n: "\n".join([*shared[:5], own_words(i, n), *shared[5:]])
    # The last five hold little beside the shared lines.
    rows = [(i, page(i, 300 if i < 25 else 25), "h") for i in range(30)]
    got = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for r in got:
        assert (r.n_removed_lines, r.n_removed_words) == (10, 80)
        assert r.clean_text == own_words(r.doc_id, 300 if r.doc_id < 25 else 25)
        assert r.kept == (r.doc_id < 25)


def test_copies_count_once_and_hide_no_footer(spark):
    footer = block("footer", 5)
    copied = ["the copied page " + own_words(0), "its second line " + own_words(1)]
    rows = [(i, "\n".join(copied + footer), "h") for i in range(200)]
    rows += [(1000 + i, "\n".join([own_words(1000 + i)] + footer), "h") for i in range(25)]
    rows += [(2000 + i, "\n".join(copied + footer), "only copies") for i in range(40)]
    got = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept and r.n_removed_lines == (0 if r.source == "only copies" else 5), r.doc_id
        if r.doc_id < 1000:
            assert r.clean_text == "\n".join(copied)


def test_lines_beyond_the_broadcast_meet_by_a_shuffle(spark):
    rows = [(i, "\n".join([own_words(i), *block(f"host {chr(97 + i % 4)}", 6 + i % 4), "everywhere " * 3]), f"h{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.clean_text, r.n_removed_lines, r.kept) for r in rules.apply_rules(docs).collect())
    assert {r[2] for r in want} == {7, 8, 9, 10}
    for most in (1, 5, 33):
        got = rules.apply_rules(docs, most_heavy=most)
        assert sorted((r.doc_id, r.clean_text, r.n_removed_lines, r.kept) for r in got.collect()) == want


def test_a_text_of_very_many_lines(spark):
    lines = [f"shared {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}" if k % 2 else own_words(k, 3) for k in range(100_000)]
    rows = [(0, "\n".join(lines), "h")] + [(i, "\n".join([own_words(i), *lines[1:4000:2]]), "h") for i in range(1, 21)]
    got = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    frequent = set(lines[1:4000:2])
    assert got[0].clean_text == "\n".join(x for x in lines if x not in frequent)
    assert got[0].n_removed_lines == sum(x in frequent for x in lines)


def test_empty(spark):
    assert rules.apply_rules(empty(spark)).count() == 0
