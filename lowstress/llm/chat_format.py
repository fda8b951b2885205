"""Chat formatting with Spark expressions only: sort, merge, escape, concatenate, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: Strings that must not survive inside a text: this template's own and those of common others.
CONTROL = (START, SEP, NEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Turns of a conversation that one first-level group holds; longer conversations are spread over many groups.
CHUNK = 64


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undo escape(): a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _runs(items: Column, role, build) -> Column:
    """Split an array into maximal runs of equal role (linear time) and build() one value per run."""
    n = F.size(items)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(at, lambda i: (i == 1) | (role(F.element_at(items, i)) != role(F.element_at(items, F.greatest(i - 1, F.lit(1))))))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n + 1))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: build(F.slice(items, x["s"], x["e"] - x["s"])))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: its id, segments array<struct<piece, in_loss>>, formatted, n_blocks.

    ``formatted`` is the segments' concatenation; the segments under the loss mask are exactly the
    (escaped) texts of the ``learn`` role. Adjacent turns of one role share a block, with a marker
    between their texts, so that the turns can be read back.

    Rows are ordered by turn (null first), then role, then text, so ties and repeated rows have a
    defined place and every row is kept; a null text or role is empty; a null id is a conversation of
    its own; other columns are not read; an empty table gives no rows. A long conversation is first
    sorted and merged in groups of 64 turn numbers; only merged blocks meet in one row, the output.
    """
    t = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    t = t.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    parts = t.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = parts.select(
        "conv", "chunk",
        _runs(F.col("turns"), lambda x: x["role"], lambda run: F.struct(F.element_at(run, 1)["role"].alias("role"), F.transform(run, lambda x: x["text"]).alias("texts"))).alias("blocks"),
    )
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "blocks"))).alias("parts"))
    whole = whole.select("conv", F.flatten(F.transform("parts", lambda x: x["blocks"])).alias("blocks"))
    merged = whole.select(
        "conv",
        _runs(F.col("blocks"), lambda x: x["role"], lambda run: F.struct(F.element_at(run, 1)["role"].alias("role"), F.flatten(F.transform(run, lambda x: x["texts"])).alias("texts"))).alias("blocks"),
    )
    segment = lambda piece, inside: F.struct(piece.alias("piece"), inside.alias("in_loss"))

    def block(b: Column) -> Column:
        lead = F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))
        body = F.flatten(
            F.transform(
                b["texts"],
                lambda x, i: F.array(segment(F.when(i == 0, lead).otherwise(F.lit(NEXT)), F.lit(False)), segment(escape(x), b["role"] == learn)),
            )
        )
        return F.concat(body, F.array(segment(F.lit(END), F.lit(False))))

    out = merged.select("conv", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", block)).alias("segments"))
    return out.select(F.col("conv").alias(conv), "segments", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "n_blocks")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    cut = lambda c, mark: F.split(c, r"\Q" + mark + r"\E", -1)

    def turns(block: Column) -> Column:
        halves = cut(F.regexp_replace(block, r"\Q" + END + r"\E$", ""), SEP)
        return F.transform(cut(F.element_at(halves, 2), NEXT), lambda x: F.struct(unescape(F.element_at(halves, 1)).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(cut(formatted, START), 2, F.length(formatted) + 1), turns))
