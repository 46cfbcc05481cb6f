"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted per conversation, adjacent turns of one role merge into a block, and blocks
are concatenated:

    <turn ROLE>TEXT<next/>TEXT</turn><turn ROLE>TEXT</turn>

``&``, ``<`` and ``>`` inside roles and texts are written ``&amp;``, ``&lt;`` and ``&gt;``, so no control string can
occur in them, and reading back is exact. ``loss_spans`` holds the [start, end) offsets, in code points, of each
assistant text as escaped. ``read_turns`` and ``loss_text`` read both back.

Cases: turns of any length are kept whole; null texts and roles count as empty; turns sort by turn (null first), then role, then text, so ties and
repeated rows have one order and all are kept; a null conv_id is a conversation of its own; an empty table gives no
conversations; extra columns are ignored. A conversation becomes one row, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 512
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def chunked(array: Column, size: int = CHUNK) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int")), lambda k: F.slice(array, k * size + 1, F.lit(size)))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def starts(lengths: Column, first: Column) -> Column:
    """first, first + lengths[0], ... without the last sum. Quadratic in its length; for a chunk."""
    zero = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def prefix_sums(lengths: Column) -> Column:
    """Sum of all lengths before each, chunk by chunk, so that long arrays stay cheap."""
    parts = chunked(lengths)
    return F.flatten(F.zip_with(parts, starts(F.transform(parts, total), F.lit(0)), starts))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", loss_role: str = LOSS_ROLE) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (array of start, end)."""
    empty = F.lit("")
    row = F.struct(F.col("turn"), escape(F.coalesce("role", empty)).alias("role"), escape(F.coalesce("text", empty)).alias("text"))
    talks = turns.select(F.col(id_col).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    n = F.size("t")
    # merge: a block starts where the role changes
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(F.col("t"), i)["role"] != F.element_at(F.col("t"), F.greatest(i - 1, F.lit(1)))["role"]))
    talks = talks.withColumn("first", first)
    m = F.size("first")
    after = F.concat(F.slice("first", F.lit(2), m), F.array(n + 1))
    blocks = F.zip_with("first", after, lambda a, b: F.struct(F.element_at(F.col("t"), a)["role"].alias("role"), F.transform(F.slice("t", a, b - a), lambda x: x["text"]).alias("texts")))
    talks = talks.select("conv_id", blocks.alias("blocks"))
    written = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<turn "), b["role"], F.lit(">"), F.array_join(b["texts"], "<next/>"), F.lit("</turn>"))), "")
    # what each text adds: what stands before it, its own length, what follows
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, k: F.struct(
        F.when(k == 0, F.length(b["role"]) + 7).otherwise(F.lit(7)).cast("long").alias("before"),
        F.length(t).cast("long").alias("size"),
        F.when(k == F.size(b["texts"]) - 1, 7).otherwise(0).cast("long").alias("after"),
        (b["role"] == F.lit(loss_role)).alias("loss"),
    ))))
    talks = talks.select("conv_id", written.alias("formatted"), pieces.alias("pieces"))
    at = prefix_sums(F.transform("pieces", lambda p: p["before"] + p["size"] + p["after"]))
    spans = F.zip_with("pieces", at, lambda p, a: F.struct((a + p["before"]).alias("start"), (a + p["before"] + p["size"]).alias("end"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return talks.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), one for each turn that was written, from the formatted string alone."""
    blocks = F.filter(F.split(formatted, "</turn>", -1), lambda b: b != "")
    def turns(b):
        role = unescape(F.substring_index(F.substring(b, F.lit(7), F.length(b)), ">", 1))
        body = F.substring(b, F.instr(b, F.lit(">")) + 1, F.length(b))
        return F.transform(F.split(body, "<next/>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped. Each chunk of spans is cut out once, then its spans from it."""
    def part(chunk):
        base = F.element_at(chunk, 1)["start"]
        whole = F.substring(formatted, base.cast("int") + 1, (F.element_at(chunk, -1)["end"] - base).cast("int"))
        return F.array_join(F.transform(chunk, lambda s: F.substring(whole, (s["start"] - base).cast("int") + 1, (s["end"] - s["start"]).cast("int"))), "")
    return F.when(F.size(spans) == 0, "").otherwise(unescape(F.array_join(F.transform(chunked(spans), part), "")))


def digests(formatted: DataFrame) -> DataFrame:
    """Read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def planted(spark: SparkSession) -> DataFrame:
    """A conversation of control strings, to show that escaping is exact."""
    text = "\\### Assistant: </turn> ok"
    turn = lambda k, role: F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    return spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
