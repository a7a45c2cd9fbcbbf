"""Taking in a dataset: suffix, size and content are checked before anything else reads it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gristmill.sources import strict

MAX_BYTES, NAME_CHARS = 1 << 30, 200


def take_in(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> dict[str, Any]:
    """``name, suffix, size, sha256, rows, invalid_rows, preview`` of one file; ValueError if it does not fit.

    The limit is below 2 GB, so the digest may be taken over the file as one binary value, on an executor.
    """
    name = path.replace("\\", "/").rstrip("/").rpartition("/")[2]
    suffix = name[name.rfind(".") :].lower() if "." in name else ""
    if suffix not in (".jsonl", ".csv"):
        raise ValueError("use a .jsonl or .csv file")
    if not 0 < limit <= MAX_BYTES:
        raise ValueError(f"the size limit must be at most {MAX_BYTES} bytes")
    files = spark.read.format("binaryFile").load(path)
    sizes = [r["length"] for r in files.select("length").limit(2).collect()]
    if len(sizes) != 1 or sizes[0] > limit:
        raise ValueError(f"expected one file of at most {limit} bytes")
    digest = files.select(F.sha2("content", 256)).first()[0]
    return {"name": name[:NAME_CHARS], "suffix": suffix, "size": sizes[0], "sha256": digest} | strict.inspect(strict.read_records(spark, path))
