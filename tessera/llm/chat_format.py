"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it are context, and only
its own text is under the loss. A conversation that does not end on an assistant turn gets one
more record, its whole text with an empty loss span, so that no turn is lost.

The template of a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts ``&`` becomes
``&amp;`` and then ``<|`` becomes ``&lt;|``; in roles ``\\n`` becomes ``&#10;`` besides. No text
can so form a control string, and reading back in the opposite order restores it.

DataFrame functions only. The turns of a conversation are gathered once; the examples are
generated from that array one at a time, so a task holds one conversation and one example. The
output of this method is, by its definition, quadratic in the number of turns of a conversation.

Defined cases: a null text or role is empty; rows of a conversation are ordered by (turn, role,
text) with nulls first, so ties and repeated rows have one order; repeated rows are turns of their
own; a null ``conv_id`` is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def format_examples(conversations: DataFrame) -> DataFrame:
    """``(conv_id, example, formatted, loss_start, loss_chars)`` with a row for each example.

    ``example`` is the position of its last turn. ``loss_start`` is the 0-based code point at which
    the trainable reply begins in ``formatted``, and ``loss_chars`` its escaped length (0 for the
    record of a conversation that ends on another turn).
    """
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = gathered.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape_text(t["text"]).alias("body"),
                (t["role"] == ASSISTANT).alias("reply"),
            ),
        ).alias("parts"),
    )
    ends = F.filter(
        F.sequence(F.lit(0), F.size("parts") - 1),
        lambda i: F.get("parts", i)["reply"] | (i == F.size("parts") - 1),
    )
    at = parts.select("conv_id", "parts", F.explode(ends).alias("example"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(END))
    last = F.get("parts", F.col("example"))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("example")), whole), "")
    built = at.select("conv_id", "example", context.alias("context"), last.alias("last"))
    return built.select(
        "conv_id",
        "example",
        F.concat("context", whole(F.col("last"))).alias("formatted"),
        (F.char_length("context") + F.char_length(F.col("last.head"))).cast("long").alias("loss_start"),
        F.when(F.col("last.reply"), F.char_length(F.col("last.body"))).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of one formatted example."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.char_length(p))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape_text(F.left(body(p), F.char_length(body(p)) - len(END))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """What the formatted examples of each conversation say, read back from them."""
    reply = unescape_text(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars")))
    rows = examples.select("conv_id", "example", "formatted", F.when(F.col("loss_chars") > 0, reply).otherwise("").alias("reply"))
    by = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("full"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    read = by.withColumn("turns", read_back(F.col("full")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
