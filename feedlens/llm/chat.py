"""Chat formatting with Spark expressions only.

Method: the turns of a conversation are collected as structs and sorted, neighbours of one role
are merged into one block (array functions find the block borders), and the blocks are
concatenated to one string. Within a block the single turns stay apart by a separator, so the
output can be read back turn by turn.

Escaping happens row by row before turns are collected. A backslash is doubled, and a backslash
is put behind the first character of every control string, of this template or of other common
ones, so that no control string survives inside a text; ``\\x`` reads back as ``x``.

The loss mask is carried as segments (text, loss): the output string is their concatenation, and
loss is true exactly on the texts of the trained roles.

Defined cases: null text and null role are empty; turns sort by turn (nulls first), then role,
then text, so ties are settled by content; repeated rows are turns of their own; a null conv_id
is a conversation of its own. An empty table gives no rows. Other columns are ignored. A
conversation is one output string by definition; its turns are pre-collected per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
BEGIN, TEXT, NEXT, END = "<|im_start|>", "<|im_role|>", "<|im_next|>", "<|im_end|>"
# Control strings start with one of these; each is broken behind its first character.
CONTROL = r"<(?=\||s>|/s>|<SYS>|</SYS>|bos>|eos>|pad>|unk>|start_of_turn>|end_of_turn>)|\[(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # 0-based positions at which the role changes
    cuts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (
        F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    with_cuts = sorted_turns.withColumn("cuts", cuts)
    block = lambda first, k: F.struct(
        F.get("turns", first)["role"].alias("role"),
        F.slice("turns", first + 1, F.coalesce(F.get("cuts", k + 1), F.size("turns")) - first).alias("turns"))
    blocks = with_cuts.select("conv_id", F.transform("cuts", block).alias("blocks"))
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def segments(b: Column) -> Column:
        head = plain(F.concat(F.lit(BEGIN), escape(b["role"]), F.lit(TEXT)))
        body = F.flatten(F.transform(b["turns"], lambda t, i: F.array(
            plain(F.when(i == 0, "").otherwise(F.lit(NEXT))),
            F.struct(t["text"].alias("text"), b["role"].isin(*trained).alias("loss")))))
        return F.concat(F.array(head), body, F.array(plain(F.lit(END))))

    out = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted string."""
    blocks = F.filter(F.split(formatted, f"\\Q{END}\\E"), lambda b: b != "")
    role = lambda b: F.split(F.substring(b, len(BEGIN) + 1, 1 << 30), f"\\Q{TEXT}\\E", 2)
    return F.flatten(F.transform(F.transform(blocks, role), lambda p: F.transform(
        F.split(p[1], f"\\Q{NEXT}\\E"), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
