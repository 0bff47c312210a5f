r"""Chat formatting with Spark expressions only.

Template: ``<s>`` + one block per run of same-role turns + ``</s>``; a block is
``<|start|>role<|body|>text(<|next|>text)*<|end|>``. Turns of one role that follow each other share a block,
their borders kept by ``<|next|>``, so the output holds the turns exactly. Control strings inside texts and
roles get one backslash after their first character (``<\s>``); strings that already look so get one more,
which makes the escape reversible. The loss mask covers the texts of assistant turns.

Cases: null text or role is empty; turns that tie go by role, then text; repeated rows are turns of their own;
a null conv_id is a conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEGIN, FINISH, START, BODY, NEXT, END = "<s>", "</s>", "<|start|>", "<|body|>", "<|next|>", "<|end|>"
CONTROL = r"(/?s>|/?INST\]|/?SYS>>|\|[a-z_]+\|>)"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    """One more backslash after the first character of each control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: each conversation as one string."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    heads = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    convs = convs.withColumn("heads", heads)
    stop = lambda k: F.when(k + 1 < F.size("heads"), F.get("heads", k + 1)).otherwise(F.size("turns") + 1)
    runs = F.transform("heads", lambda h, k: F.slice("turns", h, stop(k) - h))
    texts = lambda run: F.array_join(F.transform(run, lambda t: escape(t["text"])), NEXT)
    blocks = F.transform(runs, lambda run: F.concat(F.lit(START), escape(run[0]["role"]), F.lit(BODY), texts(run), F.lit(END)))
    return convs.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(blocks, ""), F.lit(FINISH)).alias("formatted"))


def parsed(df: DataFrame) -> DataFrame:
    """Reads formatted strings back: adds blocks (role, texts), the texts unescaped."""
    inner = F.expr(f"substring(formatted, {len(BEGIN + START) + 1}, length(formatted) - {len(BEGIN + START + END + FINISH)})")
    parts = F.split(inner, r"<\|end\|><\|start\|>")
    block = lambda b: F.struct(
        unescape(F.substring_index(b, BODY, 1)).alias("role"),
        F.transform(F.split(F.substring_index(b, BODY, -1), r"<\|next\|>"), unescape).alias("texts"),
    )
    return df.withColumn("blocks", F.transform(parts, block))


def digests(df: DataFrame) -> DataFrame:
    """One row for each formatted conversation: what a reader of the output sees."""
    read = parsed(df).withColumn("loss_texts", F.flatten(F.transform(F.filter("blocks", lambda b: b["role"] == "assistant"), lambda b: b["texts"])))
    read = read.withColumn("loss", F.array_join("loss_texts", "")).withColumn(
        "seen", F.array_join(F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n"))))), "")
    )
    hexed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select(
        "conv_id",
        F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, b: acc + F.size(b["texts"])).alias("n_turns"),
        hexed("seen").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hexed("loss").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts are made of control strings."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
