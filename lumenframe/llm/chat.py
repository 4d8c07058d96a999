"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Every assistant turn makes an example of its own: all turns before
it and its own header are ``context``, only its text (``target``) is under the loss mask. Turns after the last reply
belong to no reply; a last row without target has the whole conversation as context, so nothing is lost. Contexts are
written out in full, so rows grow with the square of a conversation's turns: that is what the expansion asks for.

Control strings inside roles and texts are escaped by one more backslash between ``<`` and ``|`` (a run of backslashes
there, of any length, gets longer by one), which ``unescape`` takes away again.

Edge cases: null text or role is empty; null turns come first; ties of a turn are ordered by role, then text;
conversations without an assistant have one row without target; rows without conv_id form one conversation; an
empty table gives no rows. Line breaks and ``%`` in roles are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, CLOSE = "<|im_start|>", "<|im_end|>", "<|im_end|>\n"
REPLY = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chat(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (int, from 0), n_context (turns before the reply), context, target (null: the rest)."""
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    header = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
    conv = conv.select("conv_id", "turns", header.alias("headers"), F.transform("turns", lambda t: escape(t["text"])).alias("texts"))
    shown = F.zip_with("headers", "texts", lambda h, t: F.concat(h, t, F.lit(CLOSE)))
    # an example ends at a reply; turns after the last one make the rest
    ends = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == REPLY, i)), lambda i: i.isNotNull())
    rest = F.when(F.coalesce(F.element_at("turns", -1)["role"] == REPLY, F.lit(False)), F.array().cast("array<int>")).otherwise(F.array(F.size("turns")))
    conv = conv.select("conv_id", "headers", "texts", shown.alias("shown"), F.concat(ends, rest).alias("ends"))
    rows = conv.select("conv_id", "headers", "texts", "shown", F.posexplode("ends").alias("example", "n_context"))
    context = F.concat(F.array_join(F.slice("shown", F.lit(1), F.col("n_context")), ""), F.coalesce(F.get("headers", F.col("n_context")), F.lit("")))
    return rows.select("conv_id", "example", "n_context", context.alias("context"), F.get("texts", F.col("n_context")).alias("target"))


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say, parsed from them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_examples, example_chars (of all contexts and targets)."""
    ends = F.coalesce(F.concat("target", F.lit(CLOSE)), F.lit(""))
    # the last example of a conversation holds all its turns; of the others the loss and the length are kept
    conv = examples.groupBy("conv_id").agg(
        F.max_by(F.concat("context", ends), "example").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", unescape(F.col("target")).alias("text"))))).alias("replies"),
        F.count("target").alias("n_examples"),
        F.sum(F.when(F.col("target").isNotNull(), F.char_length("context") + F.char_length("target")).otherwise(0)).alias("example_chars"),
    )
    loss = F.array_join(F.transform("replies", lambda r: r["text"]), "")
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2_000_000_000)
    conv = conv.select("conv_id", loss.alias("loss"), F.char_length("formatted").alias("chars"), parts.alias("parts"), "n_examples", "example_chars")

    def turn(p: Column) -> Column:
        p = F.substring_index(p, END, 1)
        role = F.substring_index(p, "\n", 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(F.substr(p, F.char_length(role) + 2)), F.lit("\n"))

    said = F.array_join(F.transform("parts", turn), "")
    return conv.select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"), "n_examples", "example_chars")
