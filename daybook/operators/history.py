"""What was asked: kept by conversation, listed, resumed, forgotten."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COLUMNS = ("asked_id", "conversation", "asked_at", "source", "question", "stage", "answer")


def record(asked: DataFrame, conversation: str, at, source: str, question: str, stage: str, answer: str) -> DataFrame:
    """The history with one row more; its id is the next one."""
    last = asked.agg(F.coalesce(F.max("asked_id"), F.lit(0)).alias("last")).first().last
    row = asked.sparkSession.createDataFrame([(last + 1, conversation, at, source, question, stage, answer)], "asked_id long, conversation string, asked_at timestamp, source string, question string, stage string, answer string")
    return asked.select(*COLUMNS).unionByName(row)


def recent(asked: DataFrame, most: int = 20) -> DataFrame:
    return asked.orderBy(F.desc("asked_at"), F.desc("asked_id")).limit(most)


def get(asked: DataFrame, asked_id: int) -> DataFrame:
    return asked.where(F.col("asked_id") == asked_id)


def last_conversation(asked: DataFrame, source: str) -> DataFrame:
    """The turns, in order, of the conversation that a source asked in last."""
    last = asked.where(F.col("source") == source).agg(F.max(F.struct("asked_at", "asked_id", "conversation")).alias("l")).select(F.col("l.conversation").alias("conversation"))
    return asked.join(F.broadcast(last), "conversation", "left_semi").orderBy("asked_at", "asked_id")


def delete(asked: DataFrame, asked_id: int) -> DataFrame:
    return asked.where(F.col("asked_id") != asked_id)


def clear(asked: DataFrame) -> DataFrame:
    return asked.limit(0)


def counts(asked: DataFrame) -> DataFrame:
    """One row: questions, conversations, the first and the last time."""
    return asked.agg(F.count("*").alias("questions"), F.countDistinct("conversation").alias("conversations"), F.min("asked_at").alias("first"), F.max("asked_at").alias("last"))
