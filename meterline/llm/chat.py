r"""Chat samples from event logs: fold a log into final messages, then render them with a loss mask.

A log has a row per event: `conv_id`, `seq` (any orderable type), `turn`, `kind`, `role` and `text`.

* `message` begins a message at its turn; `delta` appends its text to the message begun last at its turn.
* `edit` and `regenerate` begin a message anew: whatever stood at their turn or a later one is gone.
  An edit brings its text along, a regeneration's text mostly follows as deltas.

So an event survives unless an edit or regeneration with a greater `seq` stands at its turn or an
earlier one: a running maximum of `seq` in the order of turns. It is computed in ranges of `turns_per_chunk` turns, with
one summary row per (conversation, range) carried across, so the events of one endless
conversation are many tasks, and only its rendered ranges meet, as its sample is one value. Texts
are shuffled once; those of conversations longer than a range once more.

The template of a message is `### <role>: <text></turn>\n`. Inside texts and roles `\` is written `\s`,
`###` `\h`, `</turn>` `\t`, and in roles `:` `\c`; every backslash of the output begins such a code,
so replacing the codes, `\s` last, gives the text back, and no text can hold a mark.
`loss_spans` marks the texts of the `assistant` in code points and in bytes of the sample.

Defined cases. A null text or role is empty. A null id is a conversation of its own. A null turn, and
a null seq within its turn, come before all others; an event of a null seq survives no edit or regeneration. A delta without a
message begins one. Events of one seq: those that begin a message first, then by role and text. An unknown or null kind
counts as `message`. Repeated events are events each. Extra columns are not read. An empty log gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.timecols import floor_div
from meterline.llm.common import let

#: Marks and codes of the template.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
CODES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_CODES = (*CODES, (":", "\\c"))
BRANCHES = ("edit", "regenerate")
SPAN = "struct<start:long,length:long,byte_start:long,byte_length:long>"


def escaped(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _keyed(events: DataFrame, turns_per_chunk: int) -> DataFrame:
    """The columns of a log, with a key that is never null and the range of turns."""
    first = F.lit(-(1 << 63) // turns_per_chunk).cast("long")
    branch = F.coalesce(F.col("kind").isin(*BRANCHES), F.lit(False))
    return events.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_conv"),
        F.coalesce(floor_div(F.col("turn"), turns_per_chunk), first).alias("_chunk"), "turn", "seq",
        F.when(branch, F.col("seq")).alias("_branch"), F.when(F.col("kind") == "delta", 1).otherwise(0).alias("_late"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def final_messages(events: DataFrame, turns_per_chunk: int = 256) -> DataFrame:
    """(conv_id, _conv, _chunk, _chunks, turn, later, role, text): a row per message that is left of the logs.

    Messages of one turn follow each other by falling `later`. Rows lie by (_conv, _chunk).
    """
    source = _keyed(events, turns_per_chunk)
    ranges = source.groupBy("_conv", "_chunk").agg(F.max("_branch").alias("_cut"))
    before = Window.partitionBy("_conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("_conv", "_chunk", F.max("_cut").over(before).alias("_cut"),
                            F.count(F.lit(1)).over(Window.partitionBy("_conv")).alias("_chunks"))
    here = Window.partitionBy("_conv", "_chunk").orderBy(
        F.asc_nulls_first("turn"), F.desc_nulls_last("seq"), F.desc("_late"), F.desc("role"), F.desc("text"))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    cut = F.greatest(F.max("_branch").over(upto), F.col("_cut"))
    left = source.join(carried, ["_conv", "_chunk"]).withColumn("_cut", cut).where(
        F.col("_cut").isNull() | F.coalesce(F.col("seq") >= F.col("_cut"), F.lit(False)))
    # Counted from a turn's end: how many messages begin after the one that the event belongs to.
    begun = Window.partitionBy("_conv", "_chunk", "turn").orderBy(
        F.desc_nulls_last("seq"), F.desc("_late"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    counted = left.withColumn("later", F.coalesce(F.sum(1 - F.col("_late")).over(begun), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", "_late", "role", "text")))
    return counted.groupBy("conv_id", "_conv", "_chunk", "_chunks", "turn", "later").agg(parts.alias("_parts")).select(
        "conv_id", "_conv", "_chunk", "_chunks", "turn", "later", F.col("_parts")[0]["role"].alias("role"),
        F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))


def _pieces(messages: DataFrame) -> DataFrame:
    """A row per conversation and range of turns: its rendered text, spans from its own start, sizes."""
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_CODES), F.lit(MIDDLE))
    drawn = messages.withColumns({"_head": head, "_body": escaped(F.col("text"))})
    drawn = drawn.withColumn("_all", F.concat("_head", "_body", F.lit(TAIL)))
    order = Window.partitionBy("_conv", "_chunk").orderBy(F.asc_nulls_first("turn"), F.desc("later"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumns({
        "_n": F.row_number().over(order),
        "_start": F.coalesce(F.sum(F.length("_all").cast("long")).over(before), F.lit(0)) + F.length("_head"),
        "_byte": F.coalesce(F.sum(F.octet_length("_all").cast("long")).over(before), F.lit(0)) + F.octet_length("_head")})
    span = F.when(F.col("role") == "assistant", F.struct(
        F.col("_start").alias("start"), F.length("_body").cast("long").alias("length"),
        F.col("_byte").alias("byte_start"), F.octet_length("_body").cast("long").alias("byte_length")))
    rows = F.array_sort(F.collect_list(F.struct("_n", "_all", span.alias("span"))))
    joined = placed.groupBy("conv_id", "_conv", "_chunk", "_chunks").agg(rows.alias("_rows"))
    return joined.select(
        "conv_id", "_conv", "_chunk", "_chunks", F.size("_rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("_rows", lambda r: r["_all"]), "").alias("formatted"),
        F.filter(F.transform("_rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def _shifted(spans: Column, chars: Column, size: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        (s["start"] + chars).alias("start"), s["length"].alias("length"),
        (s["byte_start"] + size).alias("byte_start"), s["byte_length"].alias("byte_length")))


def format_chats(events: DataFrame, turns_per_chunk: int = 256) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): one sample per conversation of the log."""
    pieces = _pieces(final_messages(events, turns_per_chunk))
    columns = ("conv_id", "n_turns", "formatted", "loss_spans")
    short = pieces.where("_chunks = 1").select(*columns)
    before = Window.partitionBy("_conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    long = pieces.where("_chunks > 1").withColumns({
        "_chars": F.coalesce(F.sum(F.length("formatted").cast("long")).over(before), zero),
        "_bytes": F.coalesce(F.sum(F.octet_length("formatted").cast("long")).over(before), zero)})
    long = long.groupBy("conv_id", "_conv").agg(
        F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct(
            "_chunk", "formatted", _shifted(F.col("loss_spans"), F.col("_chars"), F.col("_bytes")).alias("spans")))).alias("_all"))
    long = long.select("conv_id", "n_turns", F.array_join(F.transform("_all", lambda p: p["formatted"]), "").alias("formatted"),
                       F.flatten(F.transform("_all", lambda p: p["spans"])).alias("loss_spans"))
    return short.unionByName(long)


def read_back(formatted: Column) -> Column:
    """The turns of a sample as array<struct<role, text>>, from its text alone."""
    def turn(part: Column) -> Column:
        head = F.substring_index(part, MIDDLE, 1)
        text = F.substr(part, F.length(head) + F.lit(len(MIDDLE) + 1))
        role = F.substr(head, F.lit(len(HEAD) + 1))
        return F.struct(unescaped(role, ROLE_CODES).alias("role"), unescaped(text).alias("text"))

    parts = F.split(formatted, TAIL, -1)
    return F.transform(F.filter(parts, lambda p, i: i < F.size(parts) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda b: F.transform(spans, lambda s: unescaped(F.decode(
        F.substring(b, s["byte_start"].cast("int") + 1, s["byte_length"].cast("int")), "UTF-8")))
    return F.array_join(let(F.encode(formatted, "UTF-8"), cut), "")


def streamed_log(rows: DataFrame, *identity: str, piece: int = 1024) -> DataFrame:
    """The log that tables of final turns stand for: each text begun as a message and streamed on in deltas.

    `identity` names columns that tell rows of one turn apart where role and text do not.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))
    cut = rows.select("conv_id", "turn", "role", F.unhex(F.md5(text)).alias("_digest"), *identity, F.posexplode(pieces).alias("_piece", "text"))
    return cut.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "_digest", *identity, "_piece").alias("seq"), "turn",
                      F.when(F.col("_piece") == 0, "message").otherwise("delta").alias("kind"), "role", "text")
