"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def awkward_texts(seed: int = 5) -> list[str | None]:
    """Null, empty, blank, very long, copies, near copies, shared lines, odd spaces and odd characters."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 40, 5000)
    line = "All rights reserved 2024 by the makers of this"
    texts: list[str | None] = [
        None, "", " \t\n\x0b\x0c\r ", "one", "two words", base, base, base, " ".join(near), base.upper(),
        sentence(rng, 30_000, 5000), "x" * 50_000, "a " * 300, "the same line\n" * 30, " nbsp em\u0085nel \U0001f600 é ß İ",
        "tab\tand\nnewline\r\nmixed\x0bspace " * 10, base + "\n" + passage, passage + "\n" + sentence(rng, 90), "#*$%&|<> " * 40,
    ]
    texts += [f"{sentence(rng, 60, 3000)}\n{line}\n{sentence(rng, 50, 3000)}" for _ in range(30)]
    texts += [sentence(rng, rng.randrange(1, 200), 50) for _ in range(40)]
    for _ in range(12):  # a group of near copies
        words = base.split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(words))
    return texts


def rows(texts: list[str | None], start: int = 0) -> list[tuple]:
    sources = ["src0", "src0", "src0", "src1", None]
    langs = ["en", "fr", None]
    return [(start + i, t, langs[i % 3], sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


def awkward(spark, extra: str = "", repeat: bool = True, null_id: bool = True):
    """The documents above; `extra` are clashing column names, comma-separated."""
    data = rows(awkward_texts())
    if repeat:
        data += [data[5], data[5], data[13]]
    if null_id:
        data.append((None, "a text without an id " * 8, "en", "src1", 168))
    frame = spark.createDataFrame(data, DOCUMENTS).repartition(3)
    for name in filter(None, extra.split(",")):
        from pyspark.sql import functions as F
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
