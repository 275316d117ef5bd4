"""Plans over the conversations table: validation, titles, history, chat lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import chat, rag
from brindle.plans.registry import plan
from brindle.sources.readers import table

STRIP = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def _messages(spark, d):
    c = table(spark, d, "conversations")
    # turns give the clock: a message is as late as its chat and place say
    at = F.date_format(F.timestamp_seconds(F.col("conv_id") % 17 * 1000 + F.col("turn") * 7), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.select(F.col("conv_id").alias("chat_id"), "turn", "role", F.col("text").alias("content"), at.alias("created_at"))


MESSAGES = "messages AS (SELECT conv_id AS chat_id, turn, role, text AS content, strftime(make_timestamp((conv_id % 17 * 1000 + turn * 7) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM conversations)"
CHATS = "chats0 AS (SELECT chat_id, CASE WHEN chat_id % 4 = 0 THEN 'Kept title' ELSE ' ' END AS title, '1970-01-01T00:00:00Z' AS created_at, '1970-01-01T00:00:00Z' AS updated_at FROM messages GROUP BY 1)"
TITLE = "CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 57) || '...' END"


def _chats(spark, d):
    start = F.lit("1970-01-01T00:00:00Z")
    return _messages(spark, d).select("chat_id").distinct().select("chat_id", F.when(F.col("chat_id") % 4 == 0, "Kept title").otherwise(" ").alias("title"), start.alias("created_at"), start.alias("updated_at"))


@plan(f"WITH {MESSAGES} SELECT chat_id, turn, CASE WHEN {STRIP.replace('{t}', 'content')} = '' THEN 'empty' WHEN length({STRIP.replace('{t}', 'content')}) > 4000 THEN 'too_long' WHEN regexp_matches(content, '[\\x{{0400}}-\\x{{04FF}}]') THEN 'language' END AS reason, length({STRIP.replace('{t}', 'content')})::INT AS chars FROM messages")
def query_validation(spark, d):
    v = _messages(spark, d).select("chat_id", "turn", T.valid_query(F.col("content")).alias("v"))
    return v.select("chat_id", "turn", "v.reason", F.length("v.query").alias("chars"))


@plan(f"WITH {MESSAGES} SELECT chat_id, turn, regexp_matches(lower(content), 'diagram|schematic|figure|table|chart|plot|image|photo|picture') AS visual FROM messages")
def visual_intent(spark, d):
    return _messages(spark, d).select("chat_id", "turn", T.wants_visuals(F.col("content")).alias("visual"))


@plan(f"WITH {MESSAGES}, s AS (SELECT chat_id, turn, {STRIP.replace('{t}', 'replace(content, chr(10), chr(32))')} AS t FROM messages) SELECT chat_id, turn, {TITLE} AS title FROM s")
def title_trim(spark, d):
    return _messages(spark, d).select("chat_id", "turn", T.short_title(F.col("content")).alias("title"))


@plan(
    f"""WITH {MESSAGES}, l AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS back FROM messages),
  s AS (SELECT chat_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || {STRIP.replace('{t}', 'content')} AS line, {STRIP.replace('{t}', 'content')} AS c FROM l WHERE back <= 8)
  SELECT chat_id, coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (c <> ''), '') AS history FROM s GROUP BY 1"""
)
def chat_history(spark, d):
    return rag.history(_messages(spark, d))


@plan(f"WITH {MESSAGES} SELECT chat_id, turn, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_question FROM messages")
def prev_user_message(spark, d):
    return chat.previous_question(_messages(spark, d)).select("chat_id", "turn", "previous_question")


TOUCHED = f"""{MESSAGES}, {CHATS}, f AS (SELECT chat_id, {TITLE} AS first_title FROM (SELECT chat_id, {STRIP.replace('{t}', 'replace(content, chr(10), chr(32))')} AS t, row_number() OVER (PARTITION BY chat_id ORDER BY turn) AS n FROM messages WHERE role = 'user') WHERE n = 1),
  touched AS (SELECT c.chat_id, CASE WHEN trim(c.title) = '' THEN coalesce(f.first_title, c.title) ELSE c.title END AS title, greatest(c.updated_at, m.last_at) AS updated_at FROM chats0 c LEFT JOIN f USING (chat_id) LEFT JOIN (SELECT chat_id, max(created_at) AS last_at FROM messages GROUP BY 1) m USING (chat_id))"""


@plan(f"WITH {TOUCHED} SELECT chat_id, title, updated_at, row_number() OVER (ORDER BY updated_at DESC, chat_id)::INT AS place FROM touched")
def chats_list(spark, d):
    return chat.listed(chat.touch(_chats(spark, d), _messages(spark, d))).select("chat_id", "title", "updated_at", "place")


@plan(f"WITH {MESSAGES} SELECT chat_id, turn, role FROM messages WHERE chat_id % 3 <> 0")
def delete_cascade(spark, d):
    chats, messages = _chats(spark, d), _messages(spark, d)
    return chat.delete_chats(chats, messages, chats.where("chat_id % 3 = 0"))[1].select("chat_id", "turn", "role")


@plan(f"WITH {MESSAGES}, s AS (SELECT chat_id, turn, content, unnest(range(0, length(content), 60)) AS ofs FROM messages) SELECT chat_id, turn, (ofs // 60)::INT AS piece, substr(content, ofs + 1, 60) AS token FROM s")
def answer_slices(spark, d):
    return _messages(spark, d).select("chat_id", "turn", F.posexplode(T.slices(F.col("content"))).alias("piece", "token"))


@plan(f"WITH {MESSAGES} SELECT chat_id, turn, 'a' || turn AS first_asset, CASE WHEN turn % 3 = 2 THEN 'b' || turn ELSE '' END AS others FROM messages WHERE turn % 3 > 0")
def attachment_split(spark, d):
    t = F.col("turn")
    a = F.when(t % 3 == 2, F.array(F.concat(F.lit("a"), t.cast("string")), F.concat(F.lit("b"), t.cast("string")))).when(t % 3 == 1, F.array(F.concat(F.lit("a"), t.cast("string")))).otherwise(F.array().cast("array<string>"))
    s = chat.split_attachments(_messages(spark, d).withColumn("attachments", a))
    return s.where(F.col("primary").isNotNull()).select("chat_id", "turn", F.col("primary").alias("first_asset"), F.array_join("secondary", ",").alias("others"))


@plan(f"WITH {MESSAGES} SELECT chat_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'S' || turn END AS source FROM messages")
def message_json(spark, d):
    """Sources as JSON text and back; an empty list is stored as null."""
    m = _messages(spark, d).withColumn("s", F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.concat(F.lit("S"), F.col("turn").cast("string")).alias("sid")))).otherwise(F.array().cast("array<struct<sid:string>>")))
    stored = m.withColumn("sources_json", F.when(F.size("s") > 0, F.to_json("s")))
    return stored.select("chat_id", "turn", F.from_json("sources_json", "array<struct<sid:string>>")[0]["sid"].alias("source"))
