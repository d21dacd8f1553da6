"""Secret scans through an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its bytes. A ledger in
the shared folder knows which rules, in which version, have seen which blob, and
what they found; an ingest scans a blob only with the rules it has not met, and one
copy of it only. What the ledger holds about a blob then joins back to every path
that ever had it.

A rule's matches are found by one `regexp_replace` that puts marks around them: the
pieces between the marks carry every position, so nothing leaves the JVM. Positions
are code points, ends exclusive. Matches are leftmost and do not overlap within a
rule; one whose tail (the part the length rule is about) is too short is dropped but
has used up its text.

Defined cases. A null text is the empty text. Rows that repeat are each answered.
Null ids are paths like any other. The mark itself, U+E000, is read as U+FFFD in a
text that has it, which no rule matches. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import let

MARK, STAND_IN = "\ue000", "\ufffd"
#: Matches put into one list before lists are put together.
RUN = 256
SALTS = 8
LEDGER_SCHEMA = "blob string, rules array<string>, found array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """`head` and `tail` are regular expressions; the tail needs `least` code points."""

    kind: str
    version: int
    head: str
    tail: str
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_HEAD = (f"(?:{'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token')))}|{_either_case('api')}_?{_either_case('key')})"
               r"""["']?\x20*[:=]\x20*["']?""")
BASE_RULES = (
    Rule("assign", 1, ASSIGN_HEAD, "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", 1, "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, "", "[0-9a-f]+", 24),
)
#: Formats with a fixed lead-in, added to the base rules.
ADDED_RULES = (
    Rule("forge", 1, "gh[opsu]_", "[A-Za-z0-9]+", 36),
    Rule("chat", 1, "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("jwt", 1, "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", 1, "", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 20),
)
RULES = BASE_RULES + ADDED_RULES


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<rule, start, end>> of a rule's matches in a text without the mark."""
    marked = F.regexp_replace(text, f"({rule.head})({rule.tail})", f"{MARK}$1{MARK}$2{MARK}")
    kind = "array<struct<rule:string,start:int,end:int>>"

    def placed(p: Column) -> Column:
        size = lambda i: F.length(F.get(p, i))
        n = ((F.size(p) - 1) / 3).cast("int")

        def one(acc: Column, k: Column) -> Column:
            tail = size(3 * k + 2)
            end = acc["pos"] + size(3 * k + 1) + tail
            hit = F.array(F.struct(F.lit(rule.key).alias("rule"), acc["pos"].alias("start"), end.alias("end")))
            out = F.when(tail >= rule.least, F.concat(acc["out"], hit)).otherwise(acc["out"])
            return F.struct((end + size(3 * k + 3)).alias("pos"), out.alias("out"))

        def run(acc: Column, k: Column) -> Column:
            start = F.struct(acc["pos"].alias("pos"), F.array().cast(kind).alias("out"))
            done = F.aggregate(F.sequence(k, F.least(k + (RUN - 1), n - 1)), start, one)
            return let(done, lambda d: F.struct(d["pos"].alias("pos"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        first = F.struct(size(F.lit(0)).alias("pos"), F.array().cast(f"array<{kind}>").alias("out"))
        found = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(RUN)), first, run, lambda acc: F.flatten(acc["out"]))
        return F.when(n > 0, found).otherwise(F.array().cast(kind))

    return let(F.split(marked, MARK, -1), placed)


def addressed(versions: DataFrame) -> DataFrame:
    """`versions` with `blob`, the SHA-256 of the text's bytes."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


class BlobLedger:
    """The ledger below `root`; every ingest adds one folder of it, which a replay overwrites."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        """All rows, with the `batch` that brought them."""
        try:
            return self.spark.read.schema(f"{LEDGER_SCHEMA}, batch int").parquet(self.root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{LEDGER_SCHEMA}, batch int")

    def ingest(self, versions: DataFrame, batch: int, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> None:
        """Scan what `versions` (key, text) brings that the ledger lacks.

        What an earlier run of the same batch has left counts as lacking: it is about to be overwritten.
        """
        paths = addressed(versions.select(key, "text"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        seen = self.read().where(F.col("batch") != batch).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        # One path stands for each blob; the list is narrow, and the text moves once, by path, not by blob.
        chosen = paths.groupBy("blob").agg(F.min(key).alias("_path"))
        lacking = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        todo = chosen.join(seen, "blob", "left").select(F.col("blob").alias("_blob"), "_path", lacking.alias("rules"))
        todo = todo.where(F.size("rules") > 0)
        texts = paths.join(todo, paths[key].eqNullSafe(todo["_path"]) & (paths["blob"] == todo["_blob"]))
        text = F.translate(F.coalesce("text", F.lit("")), MARK, STAND_IN)
        none = F.array().cast("array<struct<rule:string,start:int,end:int>>")
        lists = [F.when(F.array_contains("rules", r.key), spans(F.col("_text"), r)).otherwise(none) for r in rules]
        found = texts.withColumn("_text", text).select("blob", "rules", F.concat(*lists).alias("found"))
        found.dropDuplicates(["blob"]).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found): what the given rule versions found in each blob that has any finding."""
        keys = [r.key for r in rules]
        kept = F.filter("found", lambda s: s["rule"].isin(keys))
        held = self.read().select("blob", kept.alias("found")).where(F.size("found") > 0)
        return held.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))

    def on_paths(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
        """`versions` with `found`: array<struct<start, rank, end, kind>> in order, empty where nothing was found."""
        ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
        ordered = F.array_sort(F.transform("found", lambda s: F.struct(
            s["start"].alias("start"), ranks[s["rule"]].alias("rank"), s["end"].alias("end"),
            F.substring_index(s["rule"], "@", 1).alias("kind"))))
        held = self.findings(rules).select("blob", ordered.alias("found"), F.explode(
            F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
        # A blob of a third of all paths is met under a salt of the path.
        salted = addressed(versions.drop("found", "blob")).withColumn(
            "_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        joined = salted.join(held, ["blob", "_salt"], "left").drop("_salt")
        return joined.withColumn("found", F.coalesce("found", none))


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every found span, overlapping ones as one, replaced by `mask`."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask))
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], piece)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.aggregate(found, start, step, finish)).otherwise(text)
