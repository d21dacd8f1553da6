"""Quality rules: within-document counts, and lines that many documents of a host share.

A line is addressed by two hashes of its normalised form (ASCII letters lowered,
digits as 0, white space collapsed). Per host - the `source` of a document - the
distinct whole texts that hold a line are counted. A line of `min_docs` texts is removed
wherever the host has it, and a document that loses too much is rejected. Copies of one
text count once, so a group of them, however large, does not deplete itself and is left
to deduplication. Texts that differ anywhere count each.

Nothing is ever grouped by line alone without a count below it, so a line of a third
of all documents stays one partial count per task. The lines to remove meet the documents' lines in two ways: those that
make up 1 / `MOST_HEAVY` of all removed places or more, at most `MOST_HEAVY` by that, are broadcast; the others have few
places each and meet by a shuffle, which is left out where there are none.

Defined cases. A null text has no words and one blank line. A null id or host is a
value like any other. Rows equal in id, host and text are each answered. Blank lines count for nothing and stay. A text with fewer words than
a window repeats none. An empty table gives an empty table. Columns named like the
added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import SPACE_CHARS, SPACES, UPPER, has_word, let, words
from meterline.session import settled

#: Words of a window of the within-document repetition count.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Most lines that are broadcast, at 20 bytes and their host's name each.
MOST_HEAVY = 10_000


def repeated_words(of: Column, window: int = WINDOW) -> Column:
    """How many words of the array `of` lie in a window of words that occurs twice or more."""

    def covered(starts: Column) -> Column:
        later = F.aggregate(F.sequence(F.lit(1), F.size(starts) - 1), F.lit(0), lambda n, k: n + F.least(
            F.lit(window), F.get(starts, k) - F.get(starts, k - 1)))
        return later + window

    def repeats(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        twice = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                                   lambda k: same(s, k, k - 1) | same(s, k, k + 1))
        starts = let(placed, lambda s: F.array_sort(F.transform(twice(s), lambda k: F.get(s, k)["i"])))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(starts, covered)).otherwise(F.lit(0))

    def windows(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - window),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return let(each, repeats)

    hashed = let(F.transform(of, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(of) > window, hashed).otherwise(F.lit(0)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", words(F.col("text")))
    lines = F.filter(F.split(text, "\n", -1), has_word)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def normalised(line: Column) -> Column:
    bare = F.btrim(F.translate(line, UPPER + "123456789", UPPER.lower() + "0" * 9), F.lit(SPACE_CHARS))
    return F.regexp_replace(bare, SPACES, " ")


def document_lines(keyed: DataFrame) -> DataFrame:
    """A row per non-blank line of a document: host, hash of the whole text, hashes, place and words."""
    hashed = F.transform(
        F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line, i: F.struct(
            i.alias("i"), line.alias("line"))), lambda s: has_word(s["line"])),
        lambda s: let(normalised(s["line"]), lambda line: F.struct(
            F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), s["i"].alias("i"),
            F.size(F.split(line, " ")).alias("n"))))
    return keyed.select("_k1", "_k2", "source", F.xxhash64("text").alias("whole"), F.explode(hashed).alias("l")).select(
        "_k1", "_k2", "source", "whole", "l.*")


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(source, h1, h2, places) of the lines above the limits of their host."""
    line = ["source", "h1", "h2"]
    texts = lines.groupBy(*line, "whole").agg(F.count(F.lit(1)).alias("places"))
    return texts.groupBy(*line).agg(F.count(F.lit(1)).alias("texts"), F.sum("places").alias("places")).where(
        F.col("texts") >= min_docs).select(*line, "places")


def _met(lines: DataFrame, frequent: DataFrame, how: str) -> DataFrame:
    named = frequent.select(F.col("source").alias("_source"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    return lines.join(named, lines["source"].eqNullSafe(named["_source"]) & (lines["h1"] == named["_h1"])
                      & (lines["h2"] == named["_h2"]), how)


def places_of(lines: DataFrame, frequent: DataFrame, most_heavy: int = MOST_HEAVY) -> DataFrame:
    """(_k1, _k2, i, n): where documents hold a frequent line."""
    many, places = frequent.agg(F.count(F.lit(1)), F.sum("places")).first()
    columns = ("_k1", "_k2", "i", "n")
    if many <= most_heavy:
        return _met(lines, F.broadcast(frequent), "inner").select(*columns)
    weighty = F.col("places").cast("decimal(38,0)") * most_heavy >= F.lit(places)
    heavy = frequent.where(weighty)
    hit = _met(lines, F.broadcast(heavy), "inner").select(*columns)
    rest = _met(_met(lines, F.broadcast(heavy), "left_anti"), frequent.where(~weighty), "inner")
    return hit.unionByName(rest.select(*columns))


def apply_rules(docs: DataFrame, min_docs: int = 20, min_left: int = 20, max_lost: float = 0.5,
                most_heavy: int = MOST_HEAVY) -> DataFrame:
    """`docs` with the base counts, `clean_text`, `n_removed_lines`, `n_removed_words` and `kept`.

    `kept` is false where the base rules fail, where fewer than `min_left` words are
    left, or where more than the share `max_lost` of the words is removed.
    """
    docs = docs.drop("_k1", "_k2", "_r1", "_r2", "_removed", "_words", "clean_text", "n_removed_lines", "n_removed_words")
    keyed = docs.withColumns({"_k1": F.xxhash64("doc_id", "source", "text"), "_k2": F.hash("doc_id", "source", "text")})
    lines = document_lines(keyed)
    hit = places_of(lines, settled(frequent_lines(lines, min_docs)), most_heavy)
    # Repeated rows of one document bring the same places; the set keeps each once.
    removed = hit.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("i", "n")).alias("_removed"))
    removed = removed.withColumnsRenamed({"_k1": "_r1", "_k2": "_r2"})
    counted = base_counts(keyed)
    joined = counted.join(removed, (counted["_k1"] == removed["_r1"]) & (counted["_k2"] == removed["_r2"]), "left")
    none = F.array().cast("array<struct<i:int,n:int>>")
    joined = joined.withColumn("_removed", F.coalesce("_removed", none))
    lost = F.aggregate("_removed", F.lit(0), lambda n, s: n + s["n"]).cast("long")
    # By hashing what goes, not by a search for each line: a text may lose very many of them.
    staying = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.transform("_removed", lambda s: s["i"]))
    clean = let(F.split("text", "\n", -1), lambda ls: F.array_join(F.transform(staying(ls), lambda i: F.get(ls, i)), "\n"))
    joined = joined.withColumns({
        "clean_text": F.when(F.size("_removed") > 0, clean).otherwise(F.col("text")),
        "n_removed_lines": F.size("_removed").cast("long"), "n_removed_words": lost})
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < min_left) | (F.col("n_removed_words") > max_lost * F.col("n_words"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_k1", "_k2", "_r1", "_r2", "_removed")
