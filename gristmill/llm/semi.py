"""A first sieve of rows by id whose broadcast has one bound at every size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut

SLOTS = 1 << 26  # bits; at most SLOTS / 64 rows of two longs are broadcast


def bits_of(ids: DataFrame, slot: Column) -> DataFrame:
    """Words of 64 bits of the slots that occur: at most SLOTS / 64 rows ``__gm_cell, __gm_bits``."""
    bits = ids.select(slot.alias("__gm_slot"))
    return bits.groupBy(F.shiftright("__gm_slot", 6).alias("__gm_cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__gm_slot % 64 as int))")).alias("__gm_bits"))


def _bits(ids: DataFrame, id_col: str) -> DataFrame:
    return bits_of(ids.where(F.col(id_col).isNotNull()), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SLOTS)))


def _hit(key: str) -> Column:
    own = F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS))
    return (F.shiftright(own, 6) == F.col("__gm_cell")) & (F.getbit("__gm_bits", F.pmod(own, F.lit(64)).cast("int")) == 1)


def perhaps_among(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose ``key`` may be among the ids: none is lost, some others stay.

    Ids set bits of a table of fixed size, which is broadcast as one row per 64 bits. Some millions of
    ids leave a few hundredths of the other rows; with far more the sieve lets more through and the
    exact join that must follow moves more rows. The plan is the same at every size. Null keys go.
    """
    return rows.where(F.col(key).isNotNull()).join(F.broadcast(_bits(ids, id_col)), _hit(key), "left_semi")


def parted(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be among the ids (as ``perhaps_among``), and all others, null keys too."""
    bits = F.broadcast(cut(_bits(ids, id_col), "sieve"))
    return rows.where(F.col(key).isNotNull()).join(bits, _hit(key), "left_semi"), rows.join(bits, _hit(key), "left_anti")


def row_key(id_col: str, *parts: Column) -> Column:
    """A number that rows of one id and equal ``parts`` share, null ids too."""
    return F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), *parts)


def keyed(rows: DataFrame, id_col: str, *parts: Column) -> DataFrame:
    """``rows`` with ``__gm_row``, their ``row_key``."""
    return rows.withColumn("__gm_row", row_key(id_col, *parts))


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not among the column of ``gone``; only rows that may be move, and a
    null key stays. Rows travel as a struct, so no name of theirs can clash."""
    whole, name = rows.select(F.struct("*").alias("__gm_all"), key.alias("__gm_key")), gone.columns[0]
    some, others = parted(whole, "__gm_key", gone, name)
    left = some.join(gone.select(F.col(name).alias("__gm_key")).hint("shuffle_hash"), "__gm_key", "left_anti")
    return left.select("__gm_all.*").unionByName(others.select("__gm_all.*"))
