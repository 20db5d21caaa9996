r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar (deterministic, no look-ahead beyond a control string):

    conversation := turn*
    turn         := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

where role and text hold no control string and role no line feed. A turn is
first rendered as it is and parsed again; if the parse doesn't give back exactly
that role and text, the conflicting content is escaped and the turn is rendered
anew, and the escaped form parses to the source for every input: a control
string gets one backslash behind its "<|" (one more if it has some already), and
reading takes one away. Line feeds in roles become "<|nl|>". Texts without a
conflict stay as they are. After the turns are joined, the whole conversation
is parsed again and compared with the source turns (a conversation that didn't
come back would fail the query), and what the queries return is read from that parse.

Loss mask: spans (start, length) in code points of the formatted text, one for
each assistant text, excluding its header and end marker.

Edge cases: null texts and roles are empty; turns sort by turn (nulls first),
then role, then text, so ties and repeated rows have one order; a null conv_id is
a conversation of its own; an empty table gives no rows; extra columns are
ignored. A conversation's result is one row, so its rows meet in one task;
all work there is linear in its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
ASSISTANT = "assistant"
_END = r"<\|im_end\|>"


def _add_slash(c: Column, names: str) -> Column:
    return F.regexp_replace(c, rf"<\|(\\*)({names})\|>", r"<|\\$1$2|>")


def _drop_slash(c: Column, names: str) -> Column:
    return F.regexp_replace(c, rf"<\|\\(\\*)({names})\|>", r"<|$1$2|>")


def escape_text(c: Column) -> Column:
    return _add_slash(c, "im_start|im_end")


def unescape_text(c: Column) -> Column:
    return _drop_slash(c, "im_start|im_end")


def escape_role(c: Column) -> Column:
    return F.replace(_add_slash(c, "im_start|im_end|nl"), F.lit("\n"), F.lit(LINE))


def unescape_role(c: Column) -> Column:
    return _drop_slash(F.replace(c, F.lit(LINE), F.lit("\n")), "im_start|im_end|nl")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def _parse_segment(segment: Column, index: Column) -> Column:
    """segment: what stands before an end marker; those after the first begin with the line feed of the turn before."""
    head = F.when(index > 0, F.lit("\n" + START)).otherwise(F.lit(START))
    inner = segment.substr(F.length(head) + 1, F.length(segment))
    role = F.substring_index(inner, "\n", 1)
    text = inner.substr(F.length(role) + 2, F.length(inner))
    sound = F.startswith(segment, head) & F.contains(inner, F.lit("\n")) & ~F.contains(inner, F.lit(START))
    return F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text"), sound.alias("sound"))


def segments(formatted: Column) -> Column:
    return F.split(formatted, _END, -1)


def parse(parts: Column) -> Column:
    """Turns (role, text, sound) from segments(): the grammar's parser."""
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _parse_segment)


def _survives(rendered: Column, role: Column, text: Column) -> Column:
    parts = segments(rendered)
    turn = F.get(parse(parts), F.lit(0))
    return (F.size(parts) == 2) & (F.get(parts, F.lit(1)) == "\n") & turn.sound & (turn.role == role) & (turn.text == text)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, parts, rows, turns): the text, its mask, and what a parse of the text gives back."""
    c = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    c = c.withColumn("plain", _survives(render(role, text), role, text))
    c = c.withColumns({"r": F.when(F.col("plain"), role).otherwise(escape_role(role)), "t": F.when(F.col("plain"), text).otherwise(escape_text(text))})
    c = c.withColumn("rendered", render(F.col("r"), F.col("t")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.withColumns(
        {
            "n": F.row_number().over(order),
            "start": F.coalesce(F.sum(F.length("rendered")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "head": F.length(F.col("r")) + len(START) + 1,
            "loss": F.when(role == ASSISTANT, F.length("t")),
            "source": F.xxhash64(role, text),
        }
    )
    c = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "start", "head", "loss", "source", "rendered"))).alias("rows"))
    c = c.withColumn("formatted", F.array_join(F.transform("rows", lambda x: x.rendered), "")).withColumn("sources", F.transform("rows", lambda x: x.source))
    masked = F.filter("rows", lambda x: x.loss.isNotNull())
    c = c.withColumn("loss_spans", F.transform(masked, lambda x: F.struct((x.start + x["head"]).alias("start"), x.loss.alias("length"))))
    c = c.withColumn("rows", F.transform("rows", lambda x: F.struct(x.start.alias("start"), (x.start + x["head"]).alias("at"), x.loss.alias("loss"))))
    c = c.withColumn("parts", segments(F.col("formatted")))
    c = c.withColumn("turns", parse(F.col("parts")))
    # The whole conversation's parse against the source rows: what doesn't come back is refused, not returned.
    back = F.forall("turns", lambda t: t.sound) & (F.transform("turns", lambda t: F.xxhash64(t.role, t.text)) == F.col("sources"))
    refused = F.raise_error(F.concat(F.lit("conversation doesn't survive its grammar: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return c.withColumn("formatted", F.when(back, F.col("formatted")).otherwise(refused)).drop("sources")


def masked_text(c: DataFrame) -> Column:
    """All text under the loss mask, unescaped, in order. Each span is cut from the segment that holds it, so the cost is linear."""

    def cut(segment: Column, i: Column) -> Column:
        row = F.get(c.rows, i)
        # A segment after the first starts one code point early, with the line feed.
        return unescape_text(segment.substr(row["at"] - row["start"] + F.when(i > 0, 2).otherwise(1), row["loss"].cast("long")))

    under = F.filter(F.transform(F.slice(c.parts, F.lit(1), F.size(c.parts) - 1), lambda s, i: F.when(F.get(c.rows, i)["loss"].isNotNull(), cut(s, i))), lambda x: x.isNotNull())
    return F.array_join(under, "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """What the formatted texts give back when read: one row per conversation."""
    c = format_chats(conversations)
    c = c.withColumn("under", masked_text(c))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return c.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
