"""Dialogue tasks: one a session and user turn, with query views, history and exclusions, all as DataFrames.

messages: session_id, seq (the order of messages), role, content. A task is a user message; its history is all before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_nested(sessions: DataFrame) -> DataFrame:
    """Rows session_id, seq, role, content from sessions with conversations: array<struct<role, content>>."""
    return sessions.select("session_id", F.posexplode("conversations").alias("seq", "m")).select("session_id", "seq", "m.role", "m.content")


def from_parallel(sessions: DataFrame) -> DataFrame:
    """The same from sessions with arrays role and content of equal length."""
    return from_nested(sessions.select("session_id", F.arrays_zip("role", "content").alias("conversations")))


def nest(messages: DataFrame) -> DataFrame:
    """The inverse of from_nested()."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    return messages.groupBy("session_id").agg(F.transform(rows, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("conversations"))


def spoken_role(role: Column) -> Column:
    """user and assistant stay, others speak as assistant."""
    return F.when(role.isin("user", "assistant"), role).otherwise("assistant")


def tasks(messages: DataFrame) -> DataFrame:
    """session_id, seq, query, turn_number (1 for a session's first user message); messages without text are no tasks."""
    u = messages.where("role = 'user' and content is not null and trim(content) <> ''")
    return u.select("session_id", "seq", F.col("content").alias("query"), F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).alias("turn_number"))


def _lines(rows: DataFrame, order: str = "at") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("use"), F.struct(order, "line")))), lambda s: s.line), "\n")


def query_views(messages: DataFrame, recent: int = 4, dialogue_roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Per task: current, full (all messages up to it), recent (the last `recent` of them and it) and dialogue (without other roles)."""
    t = tasks(messages)
    line = F.concat_ws(": ", spoken_role(F.col("role")), F.coalesce("content", F.lit("")))
    h = messages.select("session_id", F.col("seq").alias("at"), "role", line.alias("line"))
    j = t.join(h, "session_id").where("at <= seq").withColumn("back", F.row_number().over(Window.partitionBy("session_id", "seq").orderBy(F.desc("at"))))
    pick = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", "line")))), lambda s: s.line), "\n")
    return j.groupBy("session_id", "seq", "query").agg(pick(F.lit(True)).alias("full"), pick(F.col("back") <= recent + 1).alias("recent"), pick(F.col("role").isin(*dialogue_roles)).alias("dialogue"))


def recent_user_text(messages: DataFrame, last: int = 2) -> DataFrame:
    """Per task: the last user messages before it, oldest first, joined by blanks; empty for a session's first."""
    t = tasks(messages)
    u = t.select("session_id", F.col("turn_number").alias("at"), F.col("query").alias("line"))
    j = t.join(u, "session_id", "left").withColumn("use", (F.col("at") < F.col("turn_number")) & (F.col("at") >= F.col("turn_number") - last))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("use"), F.struct("at", "line")))), lambda s: s.line)
    return j.groupBy("session_id", "seq", "query").agg(F.array_join(texts, " ").alias("recent"))


def told_messages(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """messages as they are spoken: music is an assistant's line about the item (lines: item_id, line), or its id if there is none."""
    music = F.col("role") == "music"
    j = messages.join(lines, music & (F.col("content") == F.col("item_id")), "left")
    return j.select("session_id", "seq", spoken_role(F.col("role")).alias("role"), F.when(music, F.coalesce("line", "content")).otherwise(F.col("content")).alias("content"))


def history_ids(messages: DataFrame) -> DataFrame:
    """session_id, seq, item_id: music messages' contents, and the first id of 36 characters that an assistant's message names."""
    named = F.nullif(F.regexp_extract(F.coalesce("content", F.lit("")), r"track_id:\s*([0-9a-fA-F-]{36})", 1), F.lit(""))
    item = F.when(F.col("role") == "music", F.nullif(F.col("content"), F.lit(""))).when(F.col("role") == "assistant", named)
    return messages.select("session_id", "seq", item.alias("item_id")).where("item_id is not null")


def before_last_turn(plays: DataFrame) -> DataFrame:
    """plays without each session's last turn, which may be hidden."""
    last = plays.groupBy(F.col("session_id").alias("q_session")).agg(F.max("turn_number").alias("q_last"))
    return plays.join(last, (F.col("session_id") == F.col("q_session")) & (F.col("turn_number") < F.col("q_last"))).select(*plays.columns)


def last_message(messages: DataFrame) -> DataFrame:
    """Per session: its last message, and the next turn's number."""
    return messages.groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("content", "seq").alias("query"), F.max_by("role", "seq").alias("role"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_turn"))


def exclusions(plays: DataFrame) -> DataFrame:
    """Per session and turn: the distinct items played in the session before; via each item's first play, so no self-join grows with repeats."""
    first = plays.groupBy("session_id", "item_id").agg(F.min("turn_number").alias("first"))
    turns = plays.select("session_id", "turn_number").distinct()
    return turns.join(first, "session_id").where("first < turn_number").select("session_id", "turn_number", "item_id")
