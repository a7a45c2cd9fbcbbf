"""Leakage-aware splits: records that share content, a group or a conversation stay together.

Keys of a record are joined into components; components are ranked by a seeded hash. Ranks come from
counts of hash prefixes and a rank inside each prefix, so no task sorts all components.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config as C
from gristmill.functions.scratch import cut, drop
from gristmill.functions.text import blank, digest, fold
from gristmill.operators.components import connected_components
from gristmill.operators.state import training_fault, training_text

SPLITS = ["train", "validation", "test"]
MIN_COMPONENTS = 6
SMALL_EDGES = 500_000  # pairs of keys that one task may finish; some 100 MB


def split_keys(text: Column, group_id: Column | None = None, conversation_id: Column | None = None) -> Column:
    """Keys of a record: its folded text, and its group and conversation where they are not blank."""
    keys = [F.concat(F.lit("text:"), digest(fold(text)))]
    for name, c in (("group_id", group_id), ("conversation_id", conversation_id)):
        if c is not None:
            s = c.cast("string")
            keys.append(F.when(~blank(s), F.concat(F.lit(f"{name}:"), digest(s))))
    return F.array_compact(F.array(*keys))


def with_component(df: DataFrame, keys: str = "keys") -> DataFrame:
    """Add ``component``, the smallest key reachable from the record's keys."""
    first = F.col(keys)[0]
    edges = df.select(first.alias("a"), F.explode(F.slice(keys, 2, 10)).alias("b"))
    roots = connected_components(edges, small=SMALL_EDGES).select(F.col("node").alias("_node"), "root")
    return df.join(roots, first == F.col("_node"), "left").withColumn("component", F.coalesce("root", first)).drop("_node", "root")


def component_ranks(components: DataFrame, seed: int) -> DataFrame:
    """``component, ordering, rank`` (0 first) by seeded hash, then key."""
    hashed = components.select("component").distinct().withColumn("ordering", digest(F.concat(F.lit(f"{seed}:"), F.col("component")))).withColumn("_bin", F.substring("ordering", 1, 4))
    bins = hashed.groupBy("_bin").agg(F.count("*").alias("n"))  # at most 65,536 rows
    bins = bins.select("_bin", (F.sum("n").over(Window.orderBy("_bin")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy("ordering", "component")) - 1
    return hashed.join(bins, "_bin").select("component", "ordering", (F.col("before") + inside).alias("rank"))


def assign(df: DataFrame, config: dict[str, Any] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """``df`` (with ``component``) plus ``split``, and the number of components per split."""
    cfg = C.training_config(config)
    ranks = cut(component_ranks(df, cfg["seed"]), "ranks")
    groups = ranks.count()
    if groups < MIN_COMPONENTS:
        raise ValueError(f"at least {MIN_COMPONENTS} independent groups are required; found {groups}")
    n_val, n_test = (max(1, int(groups * cfg[f"{s}_fraction"])) for s in ("validation", "test"))
    split = F.when(F.col("rank") < n_val, "validation").when(F.col("rank") < n_val + n_test, "test").otherwise("train")
    out = df.join(ranks.select("component", split.alias("split")), "component")
    return out, {"train": groups - n_val - n_test, "validation": n_val, "test": n_test}


def record_fault(kept: DataFrame) -> Column:
    wrong = F.col("id_error") if "id_error" in kept.columns else F.lit(None).cast("string")
    return F.coalesce(wrong, training_fault(F.col("text")))


def faults(kept: DataFrame) -> DataFrame:
    """``line, fault`` of kept records (with ``text``) that cannot be split: badly typed ids, unfit training texts."""
    return kept.select("line", record_fault(kept).alias("fault")).where("fault is not null")


def prepare(records: DataFrame, config: dict[str, Any] | None = None, kept: DataFrame | None = None, chars: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Split records (``line, state`` and optional ``group_id, conversation_id, id_error``): adds text, keys, component, split.

    ``kept``: the lines that count, if not all. ``chars``: hand on only ``line, keys, component, split`` and as much of
    a text, so that one pass over the texts is all there is: whole texts are neither joined nor written.
    Kept records with a badly typed id or an empty or over-long training text raise ValueError.
    """
    has = lambda n: F.col(n) if n in records.columns else None
    df = records.withColumn("text", training_text())
    text, rest = (F.col("text"), [c for c in records.columns if c not in ("line", "fields")]) if chars is None else (F.left("text", F.lit(chars)), [])
    df = df.select("line", *rest, split_keys(F.col("text"), has("group_id"), has("conversation_id")).alias("keys"), record_fault(df).alias("fault"), text.alias("text"))
    base = cut(df if kept is None else df.join(kept.select("line"), "line"), "kept")
    if (first := base.where("fault is not null").agg(F.min_by(F.struct("line", "fault"), "line").alias("x")).first()["x"]) is not None:
        raise ValueError(f"line {first['line']}: {first['fault']}")
    placed, groups = assign(with_component(base.select("line", "keys")), config)
    out = cut(base.drop("fault").join(placed.select("line", "component", "split"), "line"), "split")
    drop(base)
    return out, groups


def leakage(df: DataFrame) -> DataFrame:
    """Keys found in more than one split; empty for a sound split."""
    return df.select("split", F.explode("keys").alias("key")).distinct().groupBy("key").agg(F.count("*").alias("splits")).where("splits > 1")
