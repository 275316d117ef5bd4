"""Chats and messages as two relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import short_title


def touch(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """updated_at becomes that of the last message; a blank title becomes the first user message's."""
    w = Window.partitionBy("chat_id").orderBy("turn")
    asked = messages.where("role = 'user'").withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("chat_id", short_title(F.col("content")).alias("first_title"))
    last = messages.groupBy("chat_id").agg(F.max("created_at").alias("last_at"))
    j = chats.join(asked, "chat_id", "left").join(last, "chat_id", "left")
    blank = F.trim(F.coalesce("title", F.lit(""))) == ""
    return j.select("chat_id", F.when(blank, F.coalesce("first_title", "title")).otherwise(F.col("title")).alias("title"), "created_at", F.greatest("updated_at", F.coalesce("last_at", "updated_at")).alias("updated_at"))


def listed(chats: DataFrame) -> DataFrame:
    """Chats from the latest on, ties by id; adds place. Chats are ranked within their hour, and each hour starts after the chats of later ones, so one task orders hours, not chats."""
    hour = F.substring(F.col("updated_at").cast("string"), 1, 13)
    dealt = chats.withColumn("_hour", hour)
    later = Window.orderBy(F.desc("_from")).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("_hour").alias("_from")).agg(F.count("*").alias("_n")).select("_from", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_hour").orderBy(F.desc("updated_at"), "chat_id")
    placed = dealt.withColumn("_nth", F.row_number().over(within)).join(starts, F.col("_hour").eqNullSafe(F.col("_from")))
    return placed.withColumn("place", (F.col("_before") + F.col("_nth")).cast("int")).drop("_hour", "_from", "_n", "_before", "_nth")


def previous_question(messages: DataFrame) -> DataFrame:
    """Adds the last user message before each message of its chat."""
    w = Window.partitionBy("chat_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous_question", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))


def delete_chats(chats: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both relations without the given chats."""
    g = gone.select("chat_id").distinct()
    return chats.join(g, "chat_id", "left_anti"), messages.join(g, "chat_id", "left_anti")


def split_attachments(messages: DataFrame) -> DataFrame:
    """The first attachment and the rest."""
    a = F.col("attachments")
    return messages.withColumn("primary", F.when(F.size(a) > 0, F.element_at(a, 1))).withColumn("secondary", F.when(F.size(a) > 1, F.slice(a, F.lit(2), F.size(a))).otherwise(F.slice(a, 1, 0)))


def message_view(messages: DataFrame) -> DataFrame:
    """Messages as a client gets them: id, chat_id, role, content, created_at, and the parsed arrays of sources and attachments (empty where there are none)."""
    none = F.array().cast("array<string>")
    parsed = [F.coalesce(F.from_json(F.col(f"{c}_json"), "array<string>"), none).alias(c) for c in ("sources", "attachments")]
    return messages.select(F.col("message_id").alias("id"), "chat_id", "role", "content", "created_at", *parsed)


def chat_view(chats: DataFrame) -> DataFrame:
    """Chats as a client gets them."""
    return chats.select(F.col("chat_id").alias("id"), "title", "created_at", "updated_at")
