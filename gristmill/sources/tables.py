"""Tables as record sources: the columns ``line, record, input_error, input_fatal, fields``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.state import fields


def _source(df: DataFrame, line: Column, content: Column, record: Column, extra: dict[str, Column]) -> DataFrame:
    return df.select(line.cast("long").alias("line"), record.alias("record"), F.lit(None).cast("string").alias("input_error"), F.lit(False).alias("input_fatal"), content.alias("fields"), *(c.alias(n) for n, c in extra.items()))


SMALL = 256 << 20
#: Bytes of a scan that a part written in order is made of.
PART = 16 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of a scan, as its files have them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_of(df: DataFrame) -> int:
    """In how many parts the rows of a scan are written in order: a part's task takes no more of a larger table."""
    return 1 + size_of(df) // PART


def is_small(df: DataFrame) -> bool:
    """The scan has fewer splits than there are cores and less than SMALL bytes: dealing it out costs little, on any cluster."""
    return size_of(df) < SMALL and df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where it is small: a small file's texts would else be worked on by one.
    Anything of SMALL bytes or more is left as its scan is split, so no large input is shuffled for this."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


def documents(df: DataFrame, **extra: Column) -> DataFrame:
    """Text records of ``doc_id, text``; line numbers start at 1."""
    return _source(df, F.col("doc_id") + 1, fields(text=F.col("text")), F.to_json(F.struct("text")), extra)


def records(df: DataFrame, line: Column, *names: str) -> DataFrame:
    """Text records whose JSON has the named columns; nulls are left out."""
    return _source(df, line, fields(text=F.col("text")), F.to_json(F.struct(*names)), {})


def turns(df: DataFrame) -> DataFrame:
    """Message records, one per conversation, of ``conv_id, turn, role, text``."""
    talk = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    messages = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    talk = talk.withColumn("messages", messages)
    return _source(talk, F.col("conv_id") + 1, fields(messages=F.col("messages")), F.to_json(F.struct("messages")), {"conversation_id": F.col("conv_id").cast("string")})


def pairs(df: DataFrame, layout: str = "instruction") -> DataFrame:
    """A record per user turn that an assistant turn follows: instruction/output or prompt/response."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = df.withColumn("reply", F.lead("text").over(order)).withColumn("next", F.lead("role").over(order)).where("role = 'user' and next = 'assistant'")
    names = ("instruction", "output") if layout == "instruction" else ("prompt", "response")
    content = fields(**{names[0]: F.col("text"), names[1]: F.col("reply")})
    record = F.to_json(F.struct(F.col("text").alias(names[0]), F.col("reply").alias(names[1])))
    return _source(rows, F.col("conv_id") * 1000 + F.col("turn") + 1, content, record, {"conversation_id": F.col("conv_id").cast("string")})


def synthetic(ids: DataFrame) -> DataFrame:
    """A generated support example for each ``doc_id``, two to a conversation."""
    rows = ids.select("doc_id", F.format_string("Synthetic support example %d: a short account of a question, what was tried, and how it was settled.", F.col("doc_id")).alias("text"))
    return documents(rows, group_id=F.format_string("conversation-%d", F.floor(F.col("doc_id") / 2)))
