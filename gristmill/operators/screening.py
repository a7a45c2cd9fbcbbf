"""Screening: dedup, length, cached decisions, rules or scorer answers, one decision per record.

Input rows: ``line, record, input_error, input_fatal, fields`` (see ``state``) and any small columns,
which are carried along. Order is the column ``line``. Texts are read once: one pass gives every row
its identity, size and flags, and that narrow table is all that is shuffled. A hash shared by very
many records costs one aggregated row and a join that adaptive execution splits. Records meet their
decisions again, by line, only where they are written.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import config as C
from gristmill.functions.scratch import cut
from gristmill.functions.text import has_email
from gristmill.operators.budget import Ask, RequestScorer, ask_within, first_lines
from gristmill.operators.gates import DIMENSION, clean_usage, judge_answers
from gristmill.operators.state import state_hash, state_text, with_state

DECISION = f"struct<decision:string,reason:string,error:string,detail:string,unevaluated:boolean,fatal:boolean,model:string,provider_id:string,dimensions:map<string,{DIMENSION}>>"
PARTS = {"decision": "string", "reason": "string", "error": "string", "detail": "string", "unevaluated": "boolean", "fatal": "boolean", "model": "string", "provider_id": "string", "dimensions": f"map<string,{DIMENSION}>"}
ROW_FAILURES = ["invalid_json", "response_too_large", "invalid_request", "request_too_large", "cancelled"]
Replay = Callable[[DataFrame], DataFrame]
Scorer = Replay | RequestScorer


class ScorerError(Exception):
    """A request that gave no answer; ``category`` decides whether the run may go on."""

    def __init__(self, category: str):
        self.category = category
        super().__init__(category)


def _decision(decision, reason, error=None, detail=None, unevaluated=None, fatal=None, model=None, provider_id=None, dimensions=None):
    lit = lambda v, t: (v if hasattr(v, "cast") else F.lit(v)).cast(t)
    none = F.lit(None).cast(f"map<string,{DIMENSION}>")
    return F.struct(
        lit(decision, "string").alias("decision"), lit(reason, "string").alias("reason"), lit(error, "string").alias("error"), lit(detail, "string").alias("detail"),
        lit(unevaluated, "boolean").alias("unevaluated"), lit(fatal, "boolean").alias("fatal"), lit(model, "string").alias("model"), lit(provider_id, "string").alias("provider_id"),
        (none if dimensions is None else dimensions).alias("dimensions"),
    )


def prepared(raw: DataFrame, mode: str) -> DataFrame:
    """Add state, content error, identity and size."""
    return with_state(raw).withColumn("state_hash", F.when(F.col("input_error").isNull(), state_hash(mode))).withColumn("n_chars", F.length(state_text()))


def identities(raw: DataFrame, mode: str, with_states: bool = False) -> DataFrame:
    """Carried columns, errors, identity, size and the local rule's flag, and the state as JSON if wanted."""
    carried = [c for c in raw.columns if c not in ("record", "fields")]
    seen = prepared(raw, mode).withColumn("email", F.coalesce(has_email(state_text()), F.lit(False)))
    states = [F.to_json("state").alias("state")] if with_states else []
    return seen.select(*carried, "content_error", "state_hash", "n_chars", "email", *states)


def narrow(raw: DataFrame, mode: str) -> DataFrame:
    """``identities``, cut: one pass over the texts."""
    return cut(identities(raw, mode), "identities")


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Add ``is_dup``: not the first line of its state."""
    # A copied state has one aggregated row; copies are found by a join on it. Rows without a state join on their line.
    repeated = df.where("state_hash is not null").groupBy("state_hash").agg(F.min("line").alias("first_line"), F.count("*").alias("copies")).where("copies > 1")
    repeated = cut(repeated.select(F.col("state_hash").alias("_key"), "first_line"), "repeated")
    keyed = df.withColumn("_key", F.coalesce("state_hash", F.col("line").cast("string")))
    return keyed.join(repeated, "_key", "left").withColumn("is_dup", F.coalesce(F.col("line") > F.col("first_line"), F.lit(False))).drop("first_line", "_key")


def screen(raw: DataFrame | None, config: dict[str, Any] | None = None, cache: DataFrame | None = None, scorer: Scorer | None = None, seen: DataFrame | None = None, ledger: str | None = None, budget: int | None = None) -> DataFrame:
    """Decide every record: the carried columns and ``result`` (DECISION), ``state_hash``, ``config_hash``, ``is_dup``, ``cache_hit``, ``usage``, ``requests``.

    Order of checks: input error, content error, exact duplicate, length, cached decision, then the
    local rules or the scorer. ``cache`` has ``config_hash, state_hash, result``. A scorer sees only
    distinct, uncached states, in line order, and makes at most ``max_requests`` requests for the run, whatever
    is retried or asked again (see ``budget``); ``requests`` are those made for a row's state. ``ledger`` is
    the folder of their account, for a run that may have to be begun again. ``max_requests`` may be None, for
    no limit, only with ``replay_scorer``, which makes no requests. Malformed answers are asked for once more.
    ``seen``: the result of ``narrow`` for these records and this rubric, where the caller has it; with
    ``is_dup`` its duplicates are known already, and with ``state`` no ``raw`` is needed. ``budget``: what is
    left of ``max_requests``, if some of it was spent before.
    """
    cfg = C.screening_config(config or {})
    rubric = C.RUBRICS[cfg["rubric"]]
    run_hash = C.config_hash(cfg)
    df = narrow(raw, rubric["dedupe"]) if seen is None else seen
    df = df if "is_dup" in df.columns else mark_duplicates(df)
    within = F.col("n_chars").between(cfg["min_chars"], cfg["max_chars"])
    df = df.withColumn("_open", F.col("input_error").isNull() & F.col("content_error").isNull() & ~F.col("is_dup") & F.coalesce(within, F.lit(False)))
    df = df.withColumn("_key", F.when(F.col("_open"), F.col("state_hash")).otherwise(F.col("line").cast("string")))
    if cache is not None:
        known = cache.where(F.col("config_hash") == run_hash).select(F.col("state_hash").alias("_key"), F.col("result").alias("cached"))
        df = df.join(known, "_key", "left")
    else:
        df = df.withColumn("cached", F.lit(None).cast(DECISION))
    df = df.withColumn("cache_hit", F.col("_open") & F.col("cached").isNotNull())
    usage = F.lit(None).cast("struct<input_tokens:double,output_tokens:double,cost:double>")
    if cfg["provider"] == "demo":
        df = df.withColumn("usage", usage).withColumn("requests", F.lit(None).cast("long"))
        judged = {"decision": F.when(F.col("email"), "review").otherwise("keep"), "reason": F.when(F.col("email"), "demo_email_pattern").otherwise("demo_rules_passed")}
    else:
        if scorer is None:
            raise ValueError("provider scorer needs a scorer")
        replays = getattr(scorer, "replays", False)
        if cfg["max_requests"] is None and not replays:
            raise ValueError("max_requests may be None only for replayed answers")
        df = cut(df, "open")
        misses = df.where(F.col("_open") & ~F.col("cache_hit")).select("line", "state_hash")
        judge = lambda rows: judge_answers(rows, rubric, cfg["confidence"])
        if replays:
            if cfg["max_requests"] is not None:
                misses = first_lines(misses, cfg["max_requests"])
            answers = cut(judge(scorer(misses.select("state_hash")).select("state_hash", "failure", "response.*")), "answers")  # read twice, judged once
            counted = answers.where("failure is null and answer_error is null").select("state_hash", F.lit(1).cast("long").alias("requests"))
        else:
            if "state" in df.columns:
                asked = df.where(F.col("_open") & ~F.col("cache_hit")).select("state_hash", "state", "line")
            else:
                asked = with_state(raw).select("line", "state").join(cut(misses, "misses"), "line").select("state_hash", F.to_json("state").alias("state"), "line")
            answers, counted = ask_within(cut(asked, "asked"), scorer, judge, cfg["max_requests"] if budget is None else budget, cfg["concurrency"], ledger)
            answers = cut(answers, "answers")
        scored = _scored(answers).join(counted, "state_hash", "full")
        mine = F.col("_open") & ~F.col("cache_hit")
        df = df.join(scored.withColumnRenamed("state_hash", "_key"), "_key", "left").withColumn("usage", F.when(mine, F.col("usage"))).withColumn("requests", F.when(mine, F.col("requests")))
        spent = _decision("review", "request_budget_exhausted", error="request_budget_exhausted", unevaluated=True, fatal=True)
        df = df.withColumn("scored", F.coalesce(F.col("scored"), spent))
        judged = {n: F.col(f"scored.{n}") for n in PARTS}
    step = (
        F.when(F.col("input_error").isNotNull(), "input").when(F.col("content_error").isNotNull(), "content").when(F.col("is_dup"), "dup").when(~within, "length").when(F.col("cache_hit"), "cached").otherwise("judged")
    )
    local = {
        "decision": {"input": F.lit("review"), "content": F.lit("review"), "dup": F.lit("reject"), "length": F.lit("reject")},
        "reason": {"input": F.col("input_error"), "content": F.lit("invalid_content"), "dup": F.lit("exact_duplicate"), "length": F.lit("content_length_outside_bounds")},
        "error": {"input": F.col("input_error"), "content": F.col("content_error")},
        "fatal": {"input": F.col("input_fatal")},
    }
    df, parts = df.withColumn("_step", step), []
    for n, kind in PARTS.items():
        value = F.when(F.col("_step") == "cached", F.col(f"cached.{n}"))
        for at, c in local.get(n, {}).items():
            value = value.when(F.col("_step") == at, c)
        if n in judged:
            value = value.when(F.col("_step") == "judged", judged[n])
        parts.append(value.cast(kind).alias(n))
    return df.withColumn("result", F.struct(*parts)).withColumn("config_hash", F.lit(run_hash)).drop("cached", "scored", "email", "_step", "_open", "_key")


def with_records(decided: DataFrame, raw: DataFrame) -> DataFrame:
    """Decisions with the records and typed fields they were made on, met by line; ``_apart`` of it is both, unmet."""
    out = decided.join(raw.select("line", "record", "fields"), "line")
    out._apart = decided, raw
    return out


def _scored(final: DataFrame) -> DataFrame:
    """Decisions and usage of judged answers."""
    failed, error = F.col("failure"), F.col("answer_error")
    result = (
        F.when(failed.isNotNull(), _decision("review", failed, error=failed, unevaluated=True, fatal=~failed.isin(ROW_FAILURES)))
        .when(error.isNotNull(), _decision("review", "invalid_response", error="invalid_response", detail=F.substring(error, 1, 120), unevaluated=True))
        .otherwise(_decision(F.col("answer_decision"), "scorer_decision", model=F.col("model"), provider_id=F.when(F.length("id") <= 200, F.col("id")), dimensions=F.col("dimensions")))
    )
    used = F.when(failed.isNull() & error.isNull(), clean_usage(F.col("usage")))
    return final.select("state_hash", result.alias("scored"), used.alias("usage"))


def replay_scorer(answers: DataFrame) -> Replay:
    """A scorer that looks answers up by ``state_hash``; states without one fail as ``invalid_request``."""

    def score(rows: DataFrame) -> DataFrame:
        got = rows.select("state_hash").join(answers.select("state_hash", "response"), "state_hash", "left")
        return got.select("state_hash", "response", F.when(F.col("response").isNull(), "invalid_request").alias("failure"))

    score.replays = True
    return score


class CallableScorer:
    """Calls ``function(state as JSON) -> response dict`` on the executors; a call is a request."""

    attempts = 1

    def __init__(self, function: Callable[[str], dict[str, Any]]):
        self.function = function

    def open(self) -> Ask:
        def ask(state: str, allowed: int, tried: int) -> tuple[Any, str | None, int]:
            try:
                return self.function(state), None, 1
            except ScorerError as e:
                return None, e.category, 1

        return ask


def callable_scorer(function: Callable[[str], dict[str, Any]]) -> RequestScorer:
    return CallableScorer(function)


def cacheable(decided: DataFrame) -> DataFrame:
    """New cache rows of a run: evaluated now, without error, usage left out."""
    fresh = decided.where("not cache_hit and not is_dup and result.error is null and result.reason != 'content_length_outside_bounds'")
    return fresh.select("config_hash", "state_hash", "result")


def newest(cache: DataFrame) -> DataFrame:
    """Cache rows (with ``written``, when) reduced to the newest per configuration and state."""
    return cache.groupBy("config_hash", "state_hash").agg(F.max_by("result", "written").alias("result"))


def audit(decided: DataFrame, mode: str) -> DataFrame:
    """One row per input row with identity and decision."""
    return decided.select("line", "state_hash", "config_hash", F.lit(mode).alias("mode"), "cache_hit", "result.*", "usage")
