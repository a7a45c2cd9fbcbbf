"""Record files that arrive in a folder, read strictly as a stream.

``land`` follows the folder with Spark's file source, which names the files of a micro-batch without reading
them. The strict reader then reads those files as it reads any others, split by split, so faults, size limits and line
numbers are those of a batch run. Files are numbered in the order of their arrival (time of change, then
name); a record's ``line`` is its file's number and its line in that file, so lines ascend over the whole
stream, and ``file`` and ``file_line`` say where it stood. A micro-batch's records appear by one rename, and
a batch that is played again after that does nothing, so ``record_stream``, which follows what has landed, never sees a record
twice or half a batch. The rename has to be atomic, as in HDFS and local file systems. Files must be moved into the
folder whole; one that changes later counts as another file.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.functions.scratch import released
from gristmill.sources.sinks import exists, make_folder, publish
from gristmill.sources.strict import SCHEMA, SUFFIXES, read_files

#: Bits of a line number that count within its file.
LINE_BITS = 40
BINARY = "path string, modificationTime timestamp, length long, content binary"  # the content is never read
FILES = "file_no long, file string, size long, batch long"
LANDED = f"{SCHEMA}, file string, file_line long"


def land(spark: SparkSession, inbox: str, out: str, checkpoint: str, kind: str = "jsonl", max_files: int = 1000, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Start reading the files below ``inbox``, of one ``kind``, into Parquet below ``out/records``, at most ``max_files`` a
    micro-batch. Empty files and those whose names begin with a dot or an underscore are passed over. ``trigger``: as for a stream writer, all that is there by default."""
    if kind not in SUFFIXES.values():
        raise ValueError("kind must be jsonl or csv")
    make_folder(spark, inbox)
    at = F.col("_metadata")
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(inbox)
    names = files.select(at["file_path"].alias("file"), at["file_size"].alias("size"), at["file_modification_time"].alias("time"))

    def take(part: DataFrame, batch: int) -> None:
        session, final = part.sparkSession, f"{out}/records/batch={batch}"
        if exists(session, final):
            return
        came = sorted(part.collect(), key=lambda r: (r["time"], r["file"]))  # max_files rows
        if not came:
            return
        first = landed_files(session, out).where(F.col("batch") < batch).count() if batch else 0
        numbered = [(first + i, r["file"], r["size"]) for i, r in enumerate(came)]
        with released():
            session.createDataFrame(numbered, "file_no long, file string, size long").coalesce(1).write.mode("overwrite").parquet(f"{out}/files/batch={batch}")
            rows = read_files(session, [(f, n) for n, f, _ in numbered], kind)
            urls = session.createDataFrame([(n, f) for n, f, _ in numbered], "file_no long, file string")
            place = F.shiftleft("file_no", LINE_BITS).bitwiseOR(F.col("line"))
            landed = rows.join(F.broadcast(urls), "file_no").withColumn("file_line", F.col("line")).withColumn("line", place).drop("file_no")
            landed.write.mode("overwrite").parquet(f"{out}/_staging/batch={batch}")
        publish(session, f"{out}/_staging/batch={batch}", final)

    return names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def landed_files(spark: SparkSession, out: str) -> DataFrame:
    """``file_no, file, size, batch`` of the files seen so far."""
    return spark.read.schema(FILES).parquet(f"{out}/files")


def record_stream(spark: SparkSession, out: str) -> DataFrame:
    """What ``land`` has written and goes on to write, as a streaming frame: a record source with ``file`` and
    ``file_line``. It is read without a limit of files, so a micro-batch holds whole batches of landing and lines
    of later ones are greater."""
    make_folder(spark, f"{out}/records")
    return spark.readStream.schema(f"{LANDED}, batch long").parquet(f"{out}/records").drop("batch")
