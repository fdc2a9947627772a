"""Chat formatting (operator 8): messages rebuilt from an event log, then rendered.

Events of a conversation are folded message by message: an edit or a
regeneration starts a message's text anew, streamed deltas are appended. The
messages are rendered with a template whose control strings cannot come from
a text, as texts are escaped.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands before a role, between role and text, and after a text.
OPEN, BETWEEN, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
#: Events that start a message's text anew; a delta adds to it.
RESETS = ("message", "edit", "regenerate")
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Text without < and [, so that it holds no control string; undone by ``unescape``."""
    for raw, safe in (("\\", "\\b"), ("<", "\\l"), ("[", "\\i")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("<", "\\l"), ("[", "\\i"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) from events (conv_id, seq, event, turn, role, text).

    Events of a message are taken by seq (ties: by event, role, text). The
    text is that of the last message, edit or regenerate event and of all
    deltas after it; null texts are empty. The role is the last one given.
    The rows of a conversation are dealt by conv_id alone, so that one
    shuffle serves the rendering too.
    """
    own = Window.partitionBy("conv_id", "turn").orderBy("seq", "event", "role", "text")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = events.select("conv_id", "seq", "event", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.repartition("conv_id").withColumn("at", F.row_number().over(own))
    e = e.withColumn("reset", F.max(F.when(F.col("event").isin(*RESETS), F.col("at"))).over(whole)).withColumn("role", F.last("role", ignorenulls=True).over(whole))
    kept = e.where(F.col("reset").isNull() | (F.col("at") >= F.col("reset")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return kept.groupBy("conv_id", "turn").agg(F.first("role", ignorenulls=True).alias("role"), F.array_join(texts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``spans`` from messages (conv_id, turn, role, text).

    ``spans`` has for each turn, in order, where it starts in ``formatted``
    and where its loss mask starts and ends (code points; null for roles
    other than the assistant's). A conversation is one row, as its format is
    one string.
    """
    lead = F.length(F.concat(F.lit(OPEN), "_role", F.lit(BETWEEN)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = messages.select("conv_id", "turn", (F.col("role") == LEARNED_ROLE).alias("_learn"), escape(F.coalesce("role", F.lit(""))).alias("_role"), escape(F.coalesce("text", F.lit(""))).alias("_text"))
    m = m.select("conv_id", "turn", "_learn", lead.cast("long").alias("_lead"), F.length("_text").cast("long").alias("_size"), F.concat(F.lit(OPEN), "_role", F.lit(BETWEEN), "_text", F.lit(CLOSE)).alias("_turn"))
    m = m.withColumn("_start", F.coalesce(F.sum(F.length("_turn")).over(before), F.lit(0)).cast("long"))
    start = F.when(F.col("_learn"), F.col("_start") + F.col("_lead"))
    end = F.when(F.col("_learn"), F.col("_start") + F.col("_lead") + F.col("_size"))
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("_turn").alias("text"), F.struct(F.col("_start").alias("turn_start"), start.alias("loss_start"), end.alias("loss_end")).alias("span")))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("formatted"), F.transform("turns", lambda x: x["span"]).alias("spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold and render an event log; see ``fold`` and ``render``. An empty log gives no rows."""
    return render(fold(events))


def events_of(conversations: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) as a whole message; rows of equal turn stay apart, by role and text."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return c.select("conv_id", number.alias("seq"), F.lit("message").alias("event"), number.alias("turn"), "role", "text")


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log whose fold gives the rows (conv_id, turn, role, text) again, as a chat service would write it.

    By turns, a message is streamed in two deltas, is corrected by an edit,
    or is regenerated and then streamed on. Null texts stay null.
    """
    whole = events_of(conversations)
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("event"), text.alias("text"))
    draft = F.concat(rest, F.lit(" ..."))
    streamed = F.array(event("message", F.lit("")), event("delta", first), event("delta", rest))
    edited = F.array(event("message", draft), event("edit", F.col("text")))
    again = F.array(event("message", F.lit("")), event("delta", draft), event("regenerate", first), event("delta", rest))
    kind = F.pmod(F.col("turn"), F.lit(3))
    events = F.when(kind == 0, streamed).when(kind == 1, edited).otherwise(again)
    log = whole.select("conv_id", "turn", "role", F.posexplode(events).alias("at", "e"))
    return log.select("conv_id", (F.col("turn") * 8 + F.col("at")).alias("seq"), F.col("e.event").alias("event"), "turn", "role", F.col("e.text").alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss of what ``render`` gave, from its string and spans alone.

    ``turns``: array of role and text, unescaped; ``loss``: the unescaped
    text under the loss mask.
    """
    chunk = F.split("formatted", "</s>", -1)
    parts = formatted.withColumn("_chunks", F.slice(chunk, F.lit(1), F.size(chunk) - 1))

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
        role = F.substring_index(body, BETWEEN, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.length(role) + len(BETWEEN) + 1, F.length(body))).alias("text"))

    def lost(x: Column, s: Column) -> Column:
        return F.when(s["loss_start"].isNull(), "").otherwise(F.substring(x, (s["loss_start"] - s["turn_start"] + 1).cast("int"), (s["loss_end"] - s["loss_start"]).cast("int")))

    return parts.select("conv_id", "formatted", F.transform("_chunks", turn).alias("turns"), unescape(F.array_join(F.zip_with("_chunks", "spans", lost), "")).alias("loss"))
