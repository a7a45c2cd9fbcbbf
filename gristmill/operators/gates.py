"""Scorer answers to decisions: validation and gates as column expressions bound to a rubric.

An answer row has ``model STRING, id STRING, usage STRUCT<input_tokens, output_tokens, cost>`` and
``answers MAP<STRING, STRUCT<type, choice, score, noul, confidence, probabilities MAP<STRING, DOUBLE>>>``.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import config as C
from gristmill.functions.text import blank, finite, isclose

ANSWER = "struct<type:string,choice:string,score:double,noul:double,confidence:double,probabilities:map<string,double>>"
RESPONSE = f"struct<model:string,id:string,usage:struct<input_tokens:double,output_tokens:double,cost:double>,answers:map<string,{ANSWER}>>"
DIMENSION = "struct<type:string,confidence:double,probability:double,reject_probability:double,gate:string,value:string,decision:string>"
TOLERANCE = 0.015


def _mass(p: Column, options: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(p, F.lit(o)), F.lit(0.0)) for o in options], F.lit(0.0))


def _number_error(c: Column, top: float = 1) -> Column:
    return F.when(c.isNull(), "invalid response").when(~finite(c) | (c < 0) | (c > top), "numeric response outside range")


def _bind(name: str, question: dict[str, Any], gate: dict[str, Any], settings: dict[str, Any]) -> tuple[Column, Column]:
    """First error of a dimension's answer (null if none), and its details."""
    a = F.try_element_at("answers", F.lit(name))
    kind, p, sure = question["type"], a["probabilities"], a["confidence"]
    options = list(question["criteria"]) if kind == "choice" else [str(i) for i in range(len(question["criteria"]))]
    errors = [F.when(a["type"].isNull() | (a["type"] != kind), "wrong answer type")]
    if kind != "noul":
        values = F.map_values(p)
        expected = F.array_sort(F.array(*map(F.lit, options)))
        errors += [
            _number_error(sure),
            F.when(p.isNull(), "invalid response").when(F.array_sort(F.map_keys(p)) != expected, "unexpected probability options"),
            F.when(F.exists(values, lambda v: v.isNull()), "invalid numeric response").when(F.exists(values, lambda v: ~finite(v) | (v < 0) | (v > 1)), "numeric response outside range"),
            F.when(~isclose(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.lit(1.0), TOLERANCE), "invalid probability distribution"),
        ]
    none = F.lit(None)
    gated, chosen, reject_mass, value = none.cast("string"), none.cast("double"), none.cast("double"), none.cast("string")
    if kind == "choice":
        choice = a["choice"]
        chosen, value = F.try_element_at(p, choice), choice
        errors.append(F.when(choice.isNull() | ~choice.isin(options) | (chosen < F.array_max(F.map_values(p))), "invalid selected choice"))
        first = F.when(choice.isin(gate["keep"]), "keep").when(choice.isin(gate["review"]), "review").when(choice.isin(gate["reject"]), "reject")
        errors.append(F.when(first.isNull(), "invalid response"))
        keep_mass, reject_mass = _mass(p, gate["keep"]), _mass(p, gate["reject"])
        gated = F.when((first == "keep") & (keep_mass < settings["min_probability"]), "keep_probability_below_threshold").when((first == "keep") & (reject_mass > settings["max_reject_probability"]), "reject_probability_above_threshold")
        decision = F.when(gated.isNotNull(), "review").otherwise(first)
    else:
        number = a[kind]
        value = number.cast("string")
        errors.append(_number_error(number, len(options) - 1 if kind == "score" else 1))
        if kind == "score":
            mean = reduce(lambda x, y: x + y, [F.lit(float(o)) * F.coalesce(F.try_element_at(p, F.lit(o)), F.lit(0.0)) for o in options])
            errors.append(F.when(~isclose(number, mean, 10 * TOLERANCE), "inconsistent expected score"))
        decision = F.when(number >= gate["keep_at_or_above"], "keep").when(number <= gate["reject_at_or_below"], "reject").otherwise("review")
    if kind != "noul" and settings["use_confidence"]:
        unsure = (sure < settings["min_confidence"]) & (decision == "keep")
        gated, decision = F.when(unsure, "confidence_below_threshold").otherwise(gated), F.when(unsure, "review").otherwise(decision)
    details = F.struct(F.lit(kind).alias("type"), (sure if kind != "noul" else none.cast("double")).alias("confidence"), chosen.alias("probability"), reject_mass.alias("reject_probability"), gated.alias("gate"), value.alias("value"), decision.alias("decision"))
    return F.coalesce(*errors), details.cast(DIMENSION)


def judge_answers(df: DataFrame, rubric: dict[str, Any], confidence: float) -> DataFrame:
    """Add ``answer_error`` (null: valid), ``dimensions``, ``answer_decision`` to rows with the columns of an answer."""
    settings = C.thresholds(rubric, confidence)
    bound = {n: _bind(n, q, rubric["gates"][n], settings[n]) for n, q in rubric["questions"].items()}
    names = F.array_sort(F.array(*map(F.lit, bound)))
    error = F.coalesce(
        F.when(blank(F.col("model")), "missing resolved model"),
        F.when(F.col("answers").isNull(), "invalid response"),
        F.when(F.array_sort(F.map_keys("answers")) != names, "unexpected answer dimensions"),
        *(e for e, _ in bound.values()),
    )
    pairs = [x for n, (_, d) in bound.items() for x in (F.lit(n), d)]
    df = df.withColumn("answer_error", error)
    df = df.withColumn("dimensions", F.when(F.col("answer_error").isNull(), F.create_map(*pairs)))
    found = F.transform(F.map_values("dimensions"), lambda d: d["decision"])
    row = F.when(F.array_contains(found, "reject"), "reject").when(F.array_contains(found, "review"), "review").otherwise("keep")
    return df.withColumn("answer_decision", F.when(F.col("answer_error").isNull(), row))


def clean_usage(usage: Column) -> Column:
    """Usage numbers that are finite and not negative; the rest are null."""
    ok = lambda c: F.when(finite(c) & (c >= 0), c)
    return F.struct(*(ok(usage[n]).alias(n) for n in ("input_tokens", "output_tokens", "cost")))


def thresholds_table(spark, rubric: dict[str, Any], confidence: float) -> DataFrame:
    rows = [(n, s["use_confidence"], float(s["min_probability"]), float(s["max_reject_probability"]), s["min_confidence"]) for n, s in C.thresholds(rubric, confidence).items()]
    return spark.createDataFrame(rows, "dimension string, use_confidence boolean, min_probability double, max_reject_probability double, min_confidence double")
