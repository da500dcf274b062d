r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role form a block. Template:

    <s>[ROLE]role[/ROLE]text[TURN]text of the next turn of that role</s><s>[ROLE]...

The texts of the trained role are the loss mask, an array of spans: start and length in the UTF-8 bytes of the formatted
string, one for each turn, without the template's own strings. Bytes let Spark cut a span without a walk from the front.

A control string inside a role or text gets one more backslash behind its first character (`</s>` becomes `<\/s>`,
`<\/s>` becomes `<\\/s>`), so no escaped text holds one and taking a backslash away restores it.

Null roles and texts count as empty, turns without a number come first, turns of equal number are in order of role and
text, repeated rows are repeated turns, rows without conv_id form one conversation. Extra columns are not read, whatever
their names; an empty table gives no conversations; a text of any length is one turn. A conversation is one value by its
nature: its rows meet in one task, which Spark's partial collection prepares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template and of formats alike.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]", "[INST]", "[/INST]")
_BODY = r"(/?s>|/?ROLE\]|TURN\]|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _BODY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _BODY, "$1$2$3")


_HEAD, _ROLE_END, _NEXT, _END = "<s>[ROLE]", "[/ROLE]", "[TURN]", "</s>"


def format_chats(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """rows: conv_id, turn, role, text. Returns conv_id, formatted and mask (an array of start, length), one row per conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # the escaped texts and, by the roles of the neighbours, where blocks begin and end
    role = lambda i: F.get("turns", i)["role"]
    marked = lambda t, i: F.struct(
        escape(t["text"]).alias("text"),
        (t["role"] == trained_role).alias("trained"),
        F.when((i == 0) | (role(i - 1) != t["role"]), F.concat(F.lit(_HEAD), escape(t["role"]), F.lit(_ROLE_END))).otherwise(_NEXT).alias("before"),
        F.when(F.coalesce(role(i + 1) == t["role"], F.lit(False)), "").otherwise(_END).alias("after"),
    )
    merged = sorted_.select("conv_id", F.transform("turns", marked).alias("turns"))
    n = lambda x: F.octet_length(x)
    mask = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + n(t["before"]) + n(t["text"]) + n(t["after"])).alias("at"),
            F.when(t["trained"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + n(t["before"])).alias("start"), n(t["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return merged.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["before"], t["text"], t["after"])), "").alias("formatted"), mask.alias("mask"))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """What stands under the mask, unescaped, one string for each span."""
    cut = lambda raw: F.transform(mask, lambda m: unescape(F.decode(F.substring(raw, m["start"] + 1, m["length"]), "UTF-8")))
    # an array of one binds the bytes, so that they are made once and not for every span
    return F.flatten(F.transform(F.array(F.encode(formatted, "UTF-8")), cut))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The way back: adds turns, an array of (role, text), read from formatted alone."""
    blocks = formatted.withColumn("blocks", F.slice(F.split("formatted", r"<s>\[ROLE\]", -1), 2, F.greatest(F.size(F.split("formatted", r"<s>\[ROLE\]", -1)) - 1, F.lit(0))))

    def turns(block: Column) -> Column:
        raw = F.substring_index(block, "[/ROLE]", 1)
        head = F.length(raw) + len("[/ROLE]")
        body = F.substring(block, head + 1, F.length(block) - head - len("</s>"))
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda t: F.struct(unescape(raw).alias("role"), unescape(t).alias("text")))

    return blocks.withColumn("turns", F.flatten(F.transform("blocks", turns))).drop("blocks")


def chat_digest(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Formats, reads back, and sums up each conversation; loss is what stands under the mask, the texts of trained_role."""
    read = parse_chats(format_chats(rows, trained_role)).withColumn("loss", F.array_join(masked_texts(F.col("formatted"), F.col("mask")), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
