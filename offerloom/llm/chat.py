"""Chat formatting with a grammar round trip, in column expressions only.

conversation := turn*
turn         := open body "</s>"
open         := "<s>" | "<s~>" | "<s~~>"               (escape level 0, 1, 2)
body         := text                                     (assistant)
              | "[INST]" role NEWLINE text "[/INST]"     (every other role)

The parser cuts at every "</s>", reads the level off the opening mark and takes a body that begins with
"[INST]" for a turn of another role. A turn is rendered at level 0 and parsed again; if that does not give
back role and text, it is escaped one level further: level 1 escapes the control strings, level 2 every
character that could begin one. "~" is the escape character, as in JSON pointers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.llm.common import query, table

# Fixed values of the format: control strings and their escapes, level by level.
END = "</s>"
OPEN = ["<s>", "<s~>", "<s~~>"]
USER_OPEN, USER_CLOSE = "[INST]", "[/INST]"
ASSISTANT = "assistant"
ESCAPES = [
    [],
    [("~", "~0"), ("</s>", "~1/s>"), ("<s>", "~1s>"), ("[INST]", "~2INST]"), ("[/INST]", "~2/INST]")],
    [("~", "~0"), ("<", "~1"), ("[", "~2")],
]
UNESCAPES = [[], *[[("~2", "["), ("~1", "<"), ("~0", "~")]] * 2]
ROLE_ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), ("\n", "~3")]
ROLE_UNESCAPES = [("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")]


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _cut(text: Column, front: str | None = None, back: str | None = None) -> Column:
    """*text* without the given strings at its ends."""
    begin = len(front or "")
    size = F.char_length(text) - F.lit(begin + len(back or ""))
    return F.when(size > 0, F.substring(text, F.lit(begin + 1), size)).otherwise("")


def render_turn(role: Column, text: Column, level: int) -> Column:
    body = _swap(text, ESCAPES[level])
    other = F.concat(F.lit(USER_OPEN), _swap(role, ROLE_ESCAPES), F.lit("\n"), body, F.lit(USER_CLOSE))
    return F.concat(F.lit(OPEN[level]), F.when(role == ASSISTANT, body).otherwise(other), F.lit(END))


def parse_turn(piece: Column) -> Column:
    """struct(role, text) of what stands before an "</s>"; null if it is no turn."""
    parsed = F.lit(None).cast("struct<role:string,text:string>")
    for level in range(len(OPEN)):
        body = _cut(piece, OPEN[level])
        newline = F.locate("\n", body)
        inner = F.substring(body, newline + F.lit(1), F.char_length(body))
        other = F.struct(
            _swap(F.substring(body, F.lit(len(USER_OPEN) + 1), newline - F.lit(len(USER_OPEN) + 1)), ROLE_UNESCAPES).alias("role"),
            _swap(_cut(inner, back=USER_CLOSE), UNESCAPES[level]).alias("text"),
        )
        own = F.struct(F.lit(ASSISTANT).alias("role"), _swap(body, UNESCAPES[level]).alias("text"))
        user = F.startswith(body, F.lit(USER_OPEN))
        complete = (newline > 0) & F.endswith(inner, F.lit(USER_CLOSE))
        parsed = F.when(F.startswith(piece, F.lit(OPEN[level])), F.when(user & complete, other).when(~user, own)).otherwise(parsed)
    return parsed


def parse(formatted: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation."""
    pieces = F.split(formatted, F.lit("</s>"), -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn)


def _survives(role: Column, text: Column, level: int) -> Column:
    """Whether a turn rendered at *level* is parsed back as one turn with its role and text."""
    turns = parse(render_turn(role, text, level))
    return (F.size(turns) == 1) & F.coalesce((turns[0]["role"] == role) & (turns[0]["text"] == text), F.lit(False))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted) of all conversations of (conv_id, turn, role, text).

    Turns stand in the order of turn, equal numbers in that of role and text; null numbers come first. A
    null text or role is the empty string; null conv_ids are one conversation. Rows that repeat are turns of
    their own. A conversation is one row, as its text is one value. Every turn has the lowest escape level
    at which it survives the round trip; the last level always does. An empty table gives an empty result.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    last = len(OPEN) - 1
    risky = F.contains(text, F.lit("<")) | F.contains(text, F.lit("[")) | F.contains(role, F.lit("<")) | F.contains(role, F.lit("["))
    level = reduce(lambda rest, k: F.when(_survives(role, text, k), k).otherwise(rest), reversed(range(last)), F.lit(last))
    leveled = clean.withColumn("level", F.when(risky, level).otherwise(F.when(_survives(role, text, 0), 0).otherwise(level)))
    rendered = reduce(lambda rest, k: F.when(F.col("level") == k, render_turn(role, text, k)).otherwise(rest), range(last), render_turn(role, text, last))
    row = F.struct("turn", "role", "text", rendered.alias("piece"))
    grouped = leveled.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    formatted = F.array_join(F.col("rows.piece"), "")
    again = parse(F.col("formatted"))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    checked = grouped.withColumn("formatted", formatted).withColumn("parsed", again)
    same = F.when(F.col("parsed") == source, F.col("formatted")).otherwise(F.raise_error(F.lit("round trip failed")))
    return checked.select("conv_id", F.size("rows").cast("long").alias("n_turns"), same.alias("formatted"), "parsed")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output itself says, parsed back: turns, the text under the loss mask (assistant texts), sizes."""
    turns = F.col("parsed")
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op7_chat_format")
def op7(spark, sf_dir):
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(own).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(extra)))
