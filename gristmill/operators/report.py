"""Aggregates over decisions: counts, errors, dimensions, gates, usage, readiness."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import config as C


def counts(decided: DataFrame, **more: Column) -> DataFrame:
    is_ = lambda d: F.count_if(F.col("result.decision") == d)
    return decided.agg(
        F.count("*").alias("total"), is_("keep").alias("keep"), is_("review").alias("review"), is_("reject").alias("reject"), F.count_if("is_dup").alias("duplicates"),
        F.count_if(F.col("result.error").isNotNull()).alias("error_count"), F.count_if(F.coalesce("result.unevaluated", F.lit(False))).alias("unevaluated"),
        F.count_if("cache_hit").alias("cache_hits"), F.count_if(F.coalesce("result.fatal", F.lit(False))).alias("fatal"),
        *(c.alias(n) for n, c in more.items()),
    )


def shares(decided: DataFrame) -> DataFrame:
    """``records, keep, review, reject``: how many records, and each decision's share in percent."""
    part = lambda d: F.round(100 * F.count_if(F.col("result.decision") == d) / F.greatest(F.count("*"), F.lit(1)), 2).alias(d)
    return decided.agg(F.count("*").alias("records"), part("keep"), part("review"), part("reject"))


def masking(split: DataFrame) -> DataFrame:
    """``masked_rows, prompt_chars, learned_chars`` of rows with ``x``, their ``answer_split``."""
    left = F.coalesce(F.length("x.prompt"), F.lit(0))
    return split.agg(F.count_if(F.col("x.prompt").isNotNull()).alias("masked_rows"), F.sum(left).alias("prompt_chars"), F.sum(F.length("x.full") - left).alias("learned_chars"))


def first_errors(decided: DataFrame, n: int = 20) -> DataFrame:
    return decided.where("result.error is not null").select("line", F.col("result.error").alias("error"), F.col("result.detail").alias("detail")).orderBy("line").limit(n)


def models(decided: DataFrame) -> DataFrame:
    return decided.where("result.model is not null").groupBy(F.col("result.model").alias("model")).agg(F.count("*").alias("n"))


def usage(decided: DataFrame) -> DataFrame:
    total = lambda n: F.coalesce(F.sum(f"usage.{n}"), F.lit(0.0)).alias(n)
    return decided.where("not cache_hit").agg(total("input_tokens"), total("output_tokens"), total("cost"))


def _dimensions(decided: DataFrame) -> DataFrame:
    return decided.where("result.dimensions is not null").select(F.explode("result.dimensions").alias("dimension", "d"))


def dimensions(decided: DataFrame) -> DataFrame:
    is_ = lambda d: F.count_if(F.col("d.decision") == d).alias(d)
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return _dimensions(decided).groupBy("dimension").agg(is_("keep"), is_("review"), is_("reject"), F.count("*").alias("evaluated"), mean("d.confidence").alias("mean_confidence"), mean("d.probability").alias("mean_probability"))


def gates(decided: DataFrame) -> DataFrame:
    return _dimensions(decided).where("d.gate is not null").groupBy("dimension", F.col("d.gate").alias("gate")).agg(F.count("*").alias("n"))


def data_report(decided: DataFrame, config: dict[str, Any], exhausted: bool = True, input_fatal: bool = False) -> dict[str, Any]:
    """The report of a run; every part is a bounded aggregate."""
    cfg = C.screening_config(config)
    c = counts(decided, requests=F.coalesce(F.sum("requests"), F.lit(0))).first().asDict()
    fatal = c.pop("fatal") > 0
    rows, lost = c["total"] - c["duplicates"], c["unevaluated"]
    share = round(lost / rows, 4) if rows else 0.0
    by_dimension = {r["dimension"]: {k: r[k] for k in r.asDict() if k != "dimension"} | {"gates": {}} for r in dimensions(decided).collect()}
    for r in gates(decided).collect():
        by_dimension[r["dimension"]]["gates"][r["gate"]] = r["n"]
    used = usage(decided).first().asDict()
    used["cost"] = round(used["cost"], 8)
    complete = exhausted and not fatal
    demo = cfg["provider"] == "demo"
    report = {
        "status": "complete" if complete else "incomplete", "complete": complete, "mode": "demo_rule_based" if demo else "scorer", "provider": cfg["provider"],
        "counts": {k: c[k] for k in ("total", "keep", "review", "reject", "duplicates")}, "processed": c["total"],
        "errors": [{k: v for k, v in r.asDict().items() if v is not None} for r in first_errors(decided).collect()], "error_count": c["error_count"],
        "unevaluated": lost, "unevaluated_fraction": share, "training_ready": complete and share <= C.MAX_UNEVALUATED, "config": cfg, "config_hash": C.config_hash(cfg),
        "engine_version": C.ENGINE_VERSION, "dimensions": by_dimension, "api_requests": c.pop("requests"), "cache_hits": c["cache_hits"],
        "usage": used, "models": {r["model"]: r["n"] for r in models(decided).limit(1000).collect()}, "thresholds": {} if demo else C.thresholds(C.RUBRICS[cfg["rubric"]], cfg["confidence"]),
        "dedupe": C.RUBRICS[cfg["rubric"]]["dedupe"], "input_exhausted": exhausted and not input_fatal,
    }
    if demo:
        report["notice"] = "Local rules only: length, exact duplicates and e-mail addresses; no scorer was asked."
    elif complete and not report["training_ready"]:
        report["notice"] = f"{lost} of {rows} rows were not evaluated ({share:.1%}, limit {C.MAX_UNEVALUATED:.0%})."
    return report
