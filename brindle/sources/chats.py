"""The chat store: chats and messages are tables of one store, and what changes both is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle import schemas as S
from brindle.operators import chat
from brindle.sources.store import Store


class Chats:
    """Chats and messages below root. Frames are as in schemas.CHAT and schemas.MESSAGE."""

    def __init__(self, store: Store):
        self.store = store

    def chats(self) -> DataFrame:
        """From the latest on, as a client lists them."""
        held = self.store.read("chats")
        return self.store.spark.createDataFrame([], S.CHAT) if held is None else held

    def messages(self, chats: DataFrame | None = None) -> DataFrame:
        """All messages, or those of some chats (chat_id), of which only the buckets are opened."""
        held = self.store.read("messages", chats)
        return self.store.spark.createDataFrame([], S.MESSAGE) if held is None else held

    def create(self, chats: DataFrame) -> int:
        with self.store.commit() as c:
            return c.upsert("chats", chats, ["chat_id"])

    def post(self, messages: DataFrame) -> int:
        """New messages of chats that there are; their chats' times and blank titles follow, in the same commit. Messages of unknown chats are refused, all of the batch with them."""
        ids = messages.select("chat_id").distinct()
        unknown = ids.join(self.chats(), "chat_id", "left_anti").first()
        if unknown is not None:
            raise KeyError(f"no chat {unknown[0]}")
        with self.store.commit() as c:
            n = c.upsert("messages", messages, ["chat_id", "message_id"], by="chat_id")
            every = c.written("messages").unionByName(self.messages(ids), allowMissingColumns=True).dropDuplicates(["chat_id", "message_id"])
            touched = self.chats().join(ids, "chat_id", "left_semi")
            c.upsert("chats", chat.touch(touched, every), ["chat_id"])
        return n

    def rename(self, titles: DataFrame) -> int:
        """titles (chat_id, title, updated_at) of chats that there are."""
        with self.store.commit() as c:
            return c.upsert("chats", self.chats().drop("title", "updated_at").join(titles, "chat_id").select(*self.chats().columns), ["chat_id"])

    def delete(self, ids: DataFrame) -> tuple[int, int]:
        """Chats with their messages; returns how many of each there were."""
        ids = ids.select("chat_id").distinct()
        gone = self.messages(ids).select("chat_id", "message_id")
        with self.store.commit() as c:
            n = c.delete("chats", self.chats().select("chat_id").join(ids, "chat_id", "left_semi"))
            return n, c.delete("messages", gone) if "messages" in c.state["tables"] else 0
