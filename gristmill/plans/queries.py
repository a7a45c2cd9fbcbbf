"""The query catalogue: every operator over the supplied tables, whole."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill import config as C
from gristmill.functions.scratch import cut, new_path
from gristmill.functions.text import has_email
from gristmill.operators import bigram, report, split
from gristmill.operators.gates import judge_answers, thresholds_table
from gristmill.operators.screening import cacheable, callable_scorer, narrow, replay_scorer, screen
from gristmill.operators.state import answer_split, conversation, fields, state_hash, state_text, training_fault, training_text, with_state
from gristmill.operators.templates import chat_split
from gristmill.sources import store, strict, tables
from gristmill.streaming.arrivals import LANDED, land, record_stream
from gristmill.streaming.screen import decisions, screen_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SCORED = {"provider": "scorer", "max_requests": None}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return tables.spread(df) if name == "documents" else df


def docs(spark: SparkSession, sf: str, **extra) -> DataFrame:
    return tables.documents(table(spark, sf, "documents"), **extra)


def screened(spark: SparkSession, sf: str, config: dict | None = None, **extra) -> DataFrame:
    return screen(docs(spark, sf, **extra), config)


def _decision(df: DataFrame) -> DataFrame:
    return df.select("line", F.col("result.decision").alias("decision"), F.col("result.reason").alias("reason"), "state_hash")


# Screening


@query
def screen_decision_counts(spark, sf):
    df = screened(spark, sf)
    return df.groupBy(F.col("result.decision").alias("decision"), F.col("result.reason").alias("reason")).agg(F.count("*").alias("n"))


@query
def screen_decisions(spark, sf):
    return _decision(screened(spark, sf))


@query
def screen_decisions_exact(spark, sf):
    return _decision(screened(spark, sf, {"rubric": "code"}))


@query
def duplicate_groups(spark, sf):
    df = narrow(docs(spark, sf), "whitespace").where("state_hash is not null")
    return df.groupBy("state_hash").agg(F.count("*").alias("n"), F.min("line").alias("first_line")).where("n > 1")


@query
def length_bounds(spark, sf):
    n = F.length(F.col("fields.text.value")).cast("long")
    return docs(spark, sf).select("line", n.alias("n_chars"), n.between(8, 32000).alias("within"))


@query
def email_review(spark, sf):
    return docs(spark, sf).where(has_email(F.col("fields.text.value"))).select("line")


@query
def screen_by_lang(spark, sf):
    df = screened(spark, sf, lang=F.col("lang"))
    return df.groupBy("lang", F.col("result.decision").alias("decision")).agg(F.count("*").alias("n"))


@query
def screen_by_source(spark, sf):
    df = screened(spark, sf, source=F.col("source"))
    return df.groupBy("source", F.col("result.decision").alias("decision")).agg(F.count("*").alias("n"))


# Layouts


def _states(raw: DataFrame) -> DataFrame:
    return with_state(raw).select("line", "layout", F.to_json("state").alias("state"), state_hash().alias("state_hash"))


@query
def normalize_text(spark, sf):
    return _states(docs(spark, sf))


@query
def normalize_messages(spark, sf):
    return _states(tables.turns(table(spark, sf, "conversations")))


@query
def normalize_instruction(spark, sf):
    return _states(tables.pairs(table(spark, sf, "conversations")))


@query
def normalize_prompt(spark, sf):
    return _states(tables.pairs(table(spark, sf, "conversations"), "prompt"))


@query
def layout_precedence(spark, sf):
    """Documents as records of several layouts at once, by their id: which one counts, or what is wrong."""
    i, names = F.col("doc_id") % 6, ["text", "prompt", "response", "instruction", "output"]
    present = {"text": i < 2, "prompt": i < 5, "response": i < 4, "instruction": (i < 2) | (i == 3), "output": i < 2}
    value = {"text": F.when(i == 1, "  ").otherwise(F.col("text")), "prompt": F.col("source"), "response": F.col("lang"), "instruction": F.col("lang"), "output": F.col("source")}
    content = fields(**value)
    for n in names:
        content = content.withField(f"{n}.kind", F.when(~present[n], "absent").otherwise(content[n]["kind"]))
    rows = with_state(table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("line"), content.alias("fields")))
    return rows.select("line", "layout", F.col("content_error").alias("error"), F.sha2(state_text().cast("binary"), 256).alias("state_sha256"))


@query
def state_text_lengths(spark, sf):
    return with_state(tables.turns(table(spark, sf, "conversations"))).select("line", F.length(state_text()).cast("long").alias("n_chars"))


@query
def training_texts(spark, sf):
    return with_state(tables.turns(table(spark, sf, "conversations"))).select("line", training_text().alias("text"))


@query
def conversation_pairs(spark, sf):
    df = with_state(tables.pairs(table(spark, sf, "conversations"))).withColumn("turns", conversation())
    return df.select("line", F.size("turns").cast("long").alias("n_turns"), F.col("turns")[0]["content"].alias("asked"), F.element_at("turns", -1)["content"].alias("answered"))


@query
def answer_mask_cut(spark, sf):
    df = with_state(tables.turns(table(spark, sf, "conversations"))).withColumn("x", answer_split())
    return df.select("line", F.length("x.full").cast("long").alias("full_chars"), F.length("x.prompt").cast("long").alias("prompt_chars"))


def _cell(value):
    """A JSON value of a preview as a plain string."""
    return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]


@query
def preview_fields(spark, sf):
    df = tables.records(table(spark, sf, "documents"), F.col("doc_id") + 1, "text", "lang", "source")
    shown = strict.preview(df)
    return shown.select("line", *(_cell(F.col("fields")[n]).alias(n) for n in ("text", "lang", "source")))


@query
def preview_key_union(spark, sf):
    """The first keys of the first records, which have different fields."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id") % 3
    df = tables.records(d.select("doc_id", "text", F.when(i == 1, F.col("lang")).alias("lang"), F.when(i == 2, F.col("source")).alias("source"), F.when(i == 0, F.col("n_chars")).alias("n_chars")), F.col("doc_id") + 1, "text", "lang", "source", "n_chars")
    return strict.preview_keys(strict.preview(df)).select(F.posexplode("keys").alias("pos", "key")).select(F.col("pos").cast("long").alias("pos"), "key")


@query
def screen_messages_decisions(spark, sf):
    return _decision(screen(tables.turns(table(spark, sf, "conversations"))))


# Gates over answers made from labels


def _answer(kind_key, choice, options, top, confidence):
    """An answer whose choice has top/100 and whose other options share the rest 6:4 in a fixed order."""
    keep, review, reject = options
    second = F.floor((100 - top) * 6 / 10)
    third = 100 - top - second
    p_keep = F.when(choice == keep, top).when(choice == review, second).otherwise(third)
    p_review = F.when(choice == review, top).otherwise(second)
    p_reject = F.when(choice == reject, top).otherwise(third)
    share = lambda c: c.cast("double") / F.lit(100.0)
    none = F.lit(None).cast("double")
    p = F.create_map(F.lit(keep), share(p_keep), F.lit(review), share(p_review), F.lit(reject), share(p_reject))
    return F.lit(kind_key), F.struct(F.lit("choice").alias("type"), choice.alias("choice"), none.alias("score"), none.alias("noul"), confidence.alias("confidence"), p.alias("probabilities"))


def label_answers(labels: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of an answer, made from quality and toxic by arithmetic."""
    i, good, toxic = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    sure = (70 + i % 30).cast("double") / F.lit(100.0)
    quality = F.when(good, "good").when(i % 2 == 0, "bad").otherwise("uncertain")
    privacy = F.when(toxic, "sensitive").otherwise("clear")
    trainability = F.when(good & ~toxic, "suitable").when(good, "uncertain").otherwise("unsuitable")
    parts = [
        *_answer("quality", quality, ("good", "uncertain", "bad"), 50 + i % 50, sure),
        *_answer("privacy", privacy, ("clear", "uncertain", "sensitive"), 50 + (i * 7) % 50, sure),
        *_answer("trainability", trainability, ("suitable", "uncertain", "unsuitable"), 50 + (i * 3) % 50, sure),
    ]
    used = F.struct((i % 100 + 10).cast("double").alias("input_tokens"), F.lit(5.0).alias("output_tokens"), ((i % 8).cast("double") * 0.25).alias("cost"))
    return labels.select("doc_id", F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"), F.concat(F.lit("r"), i.cast("string")).alias("id"), used.alias("usage"), F.create_map(*parts).alias("answers"))


def _judged(spark, sf):
    return judge_answers(label_answers(table(spark, sf, "labels")), C.RUBRICS["general"], 0.85)


@query
def gate_decisions(spark, sf):
    d = _judged(spark, sf).select("doc_id", F.explode("dimensions").alias("dimension", "d"))
    return d.select("doc_id", "dimension", F.col("d.decision").alias("decision"), F.col("d.gate").alias("gate"), F.col("d.probability").alias("probability"), F.col("d.reject_probability").alias("reject_probability"))


@query
def gate_row_decisions(spark, sf):
    return _judged(spark, sf).select("doc_id", F.col("answer_decision").alias("decision"))


@query
def gate_invalid_answers(spark, sf):
    a = label_answers(table(spark, sf, "labels"))
    case, q = F.col("doc_id") % 6, F.try_element_at("answers", F.lit("quality"))
    broken = F.map_concat(F.map_filter("answers", lambda k, _: k != "quality"), F.create_map(F.lit("quality"), F.when(case == 2, q.withField("type", F.lit("score"))).when(case == 3, q.withField("probabilities", F.map_filter(q["probabilities"], lambda k, _: k != "bad"))).when(case == 4, q.withField("probabilities", F.transform_values(q["probabilities"], lambda _, v: v / 2))).when(case == 5, q.withField("choice", F.lit("none"))).otherwise(q)))
    a = a.withColumn("model", F.when(case == 0, F.lit(" ")).otherwise(F.col("model")))
    a = a.withColumn("answers", F.when(case == 1, F.map_filter("answers", lambda k, _: k != "privacy")).otherwise(broken))
    return judge_answers(a, C.RUBRICS["general"], 0.85).select("doc_id", F.col("answer_error").alias("error"))


NUMBERS = {
    "questions": {"depth": {"type": "score", "criteria": {"0": "", "1": "", "2": ""}}, "safe": {"type": "noul", "criteria": {}}},
    "gates": {"depth": {"keep_at_or_above": 1.5, "reject_at_or_below": 0.5, "use_confidence": True}, "safe": {"keep_at_or_above": 0.7, "reject_at_or_below": 0.3}},
}


@query
def gate_score_noul(spark, sf):
    i = F.col("doc_id")
    p1, p2 = i % 40, (i * 3) % 50
    share = lambda c: c.cast("double") / F.lit(100.0)
    p = F.create_map(F.lit("0"), share(100 - p1 - p2), F.lit("1"), share(p1), F.lit("2"), share(p2))
    none, sure = F.lit(None).cast("double"), share(70 + i % 30)
    score = F.struct(F.lit("score").alias("type"), F.lit(None).cast("string").alias("choice"), share(p1 + 2 * p2 + F.when(i % 10 == 0, 40).otherwise(0)).alias("score"), none.alias("noul"), sure.alias("confidence"), p.alias("probabilities"))
    noul = F.struct(F.lit("noul").alias("type"), F.lit(None).cast("string").alias("choice"), none.alias("score"), share(i % 101).alias("noul"), none.alias("confidence"), F.lit(None).cast("map<string,double>").alias("probabilities"))
    a = table(spark, sf, "labels").select("doc_id", F.lit("m").alias("model"), F.create_map(F.lit("depth"), score, F.lit("safe"), noul).alias("answers"))
    j = judge_answers(a, NUMBERS, 0.85)
    return j.select("doc_id", F.col("answer_error").alias("error"), F.col("answer_decision").alias("decision"), F.try_element_at("dimensions", F.lit("depth"))["gate"].alias("gate"))


@query
def thresholds(spark, sf):
    """The thresholds of each dimension, with how many answers they let pass and hold back."""
    judged = _judged(spark, sf).select(F.explode("dimensions").alias("dimension", "d"))
    n = judged.groupBy("dimension").agg(F.count("*").alias("answers"), F.count_if(F.col("d.gate").isNotNull()).alias("held_back"))
    return thresholds_table(spark, C.RUBRICS["general"], 0.85).join(n, "dimension")


def scored(spark, sf, cache: DataFrame | None = None) -> DataFrame:
    """Documents judged by answers made from their labels; one pass over the texts serves both sides."""
    raw = docs(spark, sf, doc_id=F.col("doc_id"))
    seen = narrow(raw, "whitespace")
    states = seen.where("state_hash is not null").groupBy("state_hash").agg(F.min("doc_id").alias("doc_id"))
    answers = states.join(label_answers(table(spark, sf, "labels")), "doc_id").select("state_hash", F.struct("model", "id", "usage", "answers").alias("response"))
    return screen(raw, SCORED, cache, replay_scorer(answers), seen)


@query
def scored_decisions(spark, sf):
    df = scored(spark, sf)
    return df.select("line", F.col("result.decision").alias("decision"), F.col("result.reason").alias("reason"), F.col("result.error").alias("error"))


@query
def dimension_report(spark, sf):
    r = report.dimensions(scored(spark, sf))
    return r.select("dimension", "keep", "review", "reject", "evaluated", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("mean_probability", 6).alias("mean_probability"))


@query
def gate_histogram(spark, sf):
    return report.gates(scored(spark, sf))


@query
def usage_totals(spark, sf):
    return report.usage(scored(spark, sf))


@query
def model_histogram(spark, sf):
    return report.models(scored(spark, sf))


@query
def training_readiness(spark, sf):
    c = report.counts(scored(spark, sf))
    rows = F.col("total") - F.col("duplicates")
    share = F.when(rows > 0, F.round(F.col("unevaluated") / rows, 4)).otherwise(0.0)
    return c.select("total", "keep", "review", "reject", "duplicates", "error_count", "unevaluated", share.alias("unevaluated_fraction"), (share <= C.MAX_UNEVALUATED).alias("training_ready"))


@query
def first_errors(spark, sf):
    return report.first_errors(scored(spark, sf)).select("line", "error")


def _judge_by_length(state: str) -> dict:
    """A scorer's answer that depends on the state alone, malformed for every fifth length."""
    size = len(json.loads(state)["text"])
    if size % 5 == 0:
        return {}
    pick = lambda good, *others: {"type": "choice", "choice": good, "confidence": 0.99, "probabilities": {good: 0.98, **dict.fromkeys(others, 0.01)}}
    answers = {n: pick(*q["criteria"]) for n, q in C.RUBRICS["general"]["questions"].items()}
    return {"model": "by-length", "id": str(size), "usage": {"input_tokens": size, "output_tokens": 1, "cost": 0.0}, "answers": answers}


@query
def budgeted_decisions(spark, sf):
    """A scorer of requests within the default budget of a run; malformed answers are asked for once more while it lasts."""
    df = screen(docs(spark, sf), {"provider": "scorer"}, scorer=callable_scorer(_judge_by_length))
    return df.select("line", F.col("result.decision").alias("decision"), F.col("result.reason").alias("reason"), F.coalesce("requests", F.lit(0)).alias("requests"))


@query
def cache_replay(spark, sf):
    first = cut(scored(spark, sf), "first")
    again = scored(spark, sf, cacheable(first))
    return again.agg(F.count_if("cache_hit").alias("cache_hits"), F.count_if(F.col("usage").isNotNull()).alias("requests"), F.count_if("is_dup").alias("duplicates"), F.count_if(F.col("result.decision") == "keep").alias("keep"))


# Splits


def texts(spark, sf) -> DataFrame:
    """``line, text, group_id`` of the documents that have content, cut."""
    group = F.floor(F.col("doc_id") / 4).cast("long")
    return cut(with_state(docs(spark, sf, group_id=group)).where("state is not null").select("line", "group_id", training_text().alias("text")), "texts")


def grouped(spark, sf, kept: DataFrame | None = None) -> DataFrame:
    """``line, keys``: narrow rows, so no text takes part in joins."""
    kept = texts(spark, sf) if kept is None else kept
    return cut(kept.select("line", split.split_keys(F.col("text"), F.col("group_id")).alias("keys")), "keys")


def assigned(spark, sf, config: dict | None = None, kept: DataFrame | None = None) -> DataFrame:
    return split.assign(split.with_component(grouped(spark, sf, kept)), config)[0]


@query
def split_keys(spark, sf):
    return grouped(spark, sf).select("line", F.posexplode("keys").alias("pos", "key")).select("line", F.col("pos").cast("long").alias("pos"), "key")


@query
def components(spark, sf):
    return split.with_component(grouped(spark, sf)).select("line", "component")


@query
def component_sizes(spark, sf):
    return split.with_component(grouped(spark, sf)).groupBy("component").agg(F.count("*").alias("n"))


@query
def split_assignment(spark, sf):
    return assigned(spark, sf).select("line", "component", "split")


@query
def split_counts(spark, sf):
    return assigned(spark, sf).groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("component").alias("groups"))


@query
def split_leakage(spark, sf):
    return split.leakage(assigned(spark, sf)).agg(F.count("*").alias("leaks"))


@query
def split_seed_sensitivity(spark, sf):
    base = cut(split.with_component(grouped(spark, sf)), "components")
    parts = [split.assign(base, {"seed": s})[0].groupBy("split").agg(F.count("*").alias("n"), F.min("line").alias("first_line")).withColumn("seed", F.lit(s).cast("long")) for s in (42, 23)]
    return parts[0].unionByName(parts[1])


# Bigram model


def training(spark, sf, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    cfg = C.training_config(config)
    kept = texts(spark, sf)
    rows = cut(kept.select("line", "text").join(assigned(spark, sf, kept=kept).select("line", "split"), "line"), "split")
    return rows, cut(bigram.batches(rows.where("split = 'train'"), cfg), "steps")


LONG = {"epochs": 2, "max_steps": 10_000, "batch_size": 2}


@query
def batch_steps(spark, sf):
    return training(spark, sf)[1].select("step", F.col("epoch").cast("long").alias("epoch"), "line")


@query
def byte_token_sums(spark, sf):
    return bigram.token_sums(texts(spark, sf), 256)


@query
def bigram_model(spark, sf):
    return bigram.counts(training(spark, sf)[1], 256).select(F.col("prev").cast("long").alias("prev"), F.col("token").cast("long").alias("token"), "n")


@query
def context_totals(spark, sf):
    return bigram.totals(bigram.counts(training(spark, sf)[1], 256)).select(F.col("prev").cast("long").alias("prev"), "total")


@query
def loss_history(spark, sf):
    return bigram.loss_history(training(spark, sf)[1], 256).select("step", F.round("loss", 6).alias("loss"))


@query
def loss_history_long(spark, sf):
    """Two epochs of at most 10,000 steps of two texts: losses of many parts, each found by a task of its own."""
    steps = training(spark, sf, LONG)[1]
    return bigram.loss_history(steps, 256).select("step", F.col("epoch").cast("long").alias("epoch"), F.round("loss", 6).alias("loss"))


@query
def baseline_eval(spark, sf):
    rows, _ = training(spark, sf)
    return bigram.evaluate(rows.where("split != 'train'"), None, 256, ["split"]).select("split", "tokens", F.round("loss", 6).alias("loss"))


@query
def heldout_eval(spark, sf):
    rows, steps = training(spark, sf)
    model = cut(bigram.counts(steps, 256), "model")
    return bigram.evaluate(rows.where("split != 'train'"), model, 256, ["split"]).select("split", "tokens", F.round("loss", 6).alias("loss"), F.round(F.exp("loss"), 4).alias("perplexity"))


@query
def external_eval(spark, sf):
    _, steps = training(spark, sf)
    model = cut(bigram.counts(steps, 256), "model")
    return bigram.evaluate(table(spark, sf, "benchmark").select("text"), model, 256).select("tokens", F.round("loss", 6).alias("loss"))


@query
def lr_schedule(spark, sf):
    """The rate of each step of two epochs over the documents that are trained on."""
    steps = training(spark, sf, LONG)[1].agg(F.max("step").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"), "n")
    return steps.select("step", F.round(bigram.rate_at(F.col("step"), F.col("n"), 2e-4), 12).alias("rate"))


@query
def synthetic_corpus(spark, sf):
    """Generated examples, one per document id, screened."""
    df = screen(tables.synthetic(table(spark, sf, "documents").select("doc_id")))
    return df.groupBy(F.col("result.decision").alias("decision")).agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"))


# Strict files, streams, control tables


def _as_files(spark, sf, df: DataFrame, kind: str, order: str = "doc_id") -> str:
    """``df`` without ``order``, in that order, as the parts of one file, so that no task writes all of it."""
    path, n = new_path(spark, kind), _documents_parts(spark, sf)
    out = df.repartitionByRange(n, order).sortWithinPartitions(order).drop(order).write
    if kind == "jsonl":
        out.option("lineSep", "\n").text(path)
    else:
        out.option("quoteAll", True).option("escape", '"').csv(path)
    return path


@query
def strict_jsonl_scan(spark, sf):
    """Documents written as JSON lines, some of them broken, and read by the strict reader."""
    df = table(spark, sf, "documents")
    bad = F.when(F.col("doc_id") % 50 == 7, '{broken}').when(F.col("doc_id") % 50 == 9, '[1, 2]').when(F.col("doc_id") % 50 == 11, '{"text": NaN}').when(F.col("doc_id") % 50 == 13, '{"text": "x"} y')
    path = _as_files(spark, sf, df.select("doc_id", F.coalesce(bad, F.to_json(F.struct("text", F.col("doc_id").alias("group_id")))).alias("value")), "jsonl")
    rows = strict.read_records(spark, path, "jsonl", parts=True)
    return rows.groupBy(F.coalesce("input_error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query
def jsonl_to_decisions(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("text")).alias("value"))
    return _decision(screen(strict.read_records(spark, _as_files(spark, sf, df, "jsonl"), "jsonl", parts=True)))


@query
def strict_csv_scan(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    header = spark.createDataFrame([(-1, "text", "lang", "source")], df.schema)
    rows = strict.read_records(spark, _as_files(spark, sf, df.unionByName(header), "csv"), "csv", parts=True)
    return screen(rows).groupBy(F.col("result.decision").alias("decision")).agg(F.count("*").alias("n"))


def _documents_parts(spark, sf) -> int:
    return tables.parts_of(spark.read.parquet(f"{sf}/documents.parquet"))


def _streamed(spark, sf, raw: DataFrame, path: str, **how) -> DataFrame:
    """Decisions of a stream over a record source that arrives in files of consecutive lines, four at least and more of a larger table."""
    raw.repartitionByRange(max(4, _documents_parts(spark, sf)), "line").sortWithinPartitions("line").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{path}/in")
    screen_stream(stream, f"{path}/out", f"{path}/checkpoint", **how).awaitTermination()
    return decisions(spark, f"{path}/out")


@query
def stream_screen(spark, sf):
    return _streamed(spark, sf, docs(spark, sf), new_path(spark, "stream")).select("line", "state_hash", "decision", "reason")


@query
def stream_cache_replay(spark, sf):
    """Two streams over one cache: documents with even ids, then all; what the first decided is not decided again."""
    path = new_path(spark, "streams")
    _streamed(spark, sf, docs(spark, sf).where("line % 2 = 1"), f"{path}/even", cache=f"{path}/cache", name="even")
    return _streamed(spark, sf, docs(spark, sf), f"{path}/all", cache=f"{path}/cache", name="all").select("line", "decision", "reason", "cache_hit")


# Faults of files, ids and texts


def _broken_lines(spark, sf) -> DataFrame:
    """``doc_id, value``: documents as JSON lines, some of them broken in each way a line can be; the first with a byte order mark."""
    i = F.col("doc_id")
    hexed = lambda c: F.expr(f"cast(unhex('{c}') as string)")
    bad = (
        F.when(i % 1000 == 3, F.concat(F.lit('{"text": "'), F.repeat(F.lit("x"), 1 << 20), F.lit('"}'))).when(i % 50 == 5, hexed("7B2274657874223A22FF227D")).when(i % 50 == 7, "{broken}").when(i % 50 == 9, "[1, 2]").when(i % 50 == 11, "  ")
        .when(i % 50 == 13, '{"text": "torn \\ud800 pair"}').when(i % 50 == 15, '{"text": "large", "n": 1e400}').when(i % 50 == 17, '{"text": "first", "text": "the last of two keys counts"}')
    )
    mark = F.when(i == 0, hexed("EFBBBF")).otherwise("")
    good = F.to_json(F.struct("text", i.alias("group_id")))
    return table(spark, sf, "documents").select("doc_id", F.concat(mark, F.coalesce(bad, good)).alias("value"))


def _faulty_lines(spark, sf) -> str:
    """Those lines as the parts of one file."""
    return _as_files(spark, sf, _broken_lines(spark, sf), "jsonl")


def _landed(spark, sf) -> str:
    """Those lines as five files that arrive in a folder in parts, a third of them to a micro-batch."""
    path, part, n = new_path(spark, "arrivals"), F.col("doc_id") % 5, max(5, _documents_parts(spark, sf))
    lines = _broken_lines(spark, sf).withColumn("part", part).repartitionByRange(n, "part", "doc_id").sortWithinPartitions("part", "doc_id")
    lines.select("part", "value").write.partitionBy("part").text(f"{path}/in")
    land(spark, f"{path}/in", path, f"{path}/landing", max_files=2 + n // 3).awaitTermination()
    return path


@query
def stream_file_records(spark, sf):
    """Records of files that arrive, with their place: of every fifth document a file, whose parts are in the order of their names."""
    path = _landed(spark, sf)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")
    sizes = spark.read.text(f"{path}/in").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(part).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    places = sizes.select("file", F.coalesce(ahead, F.lit(0)).alias("ahead"))  # a row per file
    rows = spark.read.schema(LANDED).parquet(f"{path}/records").join(F.broadcast(places), "file")
    return rows.select(part.alias("part"), (F.col("ahead") + F.col("file_line")).alias("line"), F.coalesce("input_error", F.lit("none")).alias("error"), "group_id")


@query
def stream_file_decisions(spark, sf):
    """Those files screened as they land; which copy comes first depends on the order of files, how many stay does not."""
    path = _landed(spark, sf)
    screen_stream(record_stream(spark, path), f"{path}/out", f"{path}/screening").awaitTermination()
    return decisions(spark, f"{path}/out").groupBy("decision", "reason").agg(F.count("*").alias("n"), F.countDistinct("line").alias("lines"), F.countDistinct("state_hash").alias("states"))


@query
def strict_jsonl_faults(spark, sf):
    rows = strict.read_records(spark, _faulty_lines(spark, sf), "jsonl", parts=True)
    return rows.select("line", F.coalesce("input_error", F.lit("none")).alias("error"), "input_fatal", "group_id")


@query
def dataset_inspection(spark, sf):
    return strict.inspection(strict.read_records(spark, _faulty_lines(spark, sf), "jsonl", parts=True))


@query
def strict_csv_faults(spark, sf):
    """Documents as CSV with quoted newlines, ragged and blank rows, and an open quote at the end."""
    i = F.col("doc_id")
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('"'))
    row = F.when(i % 20 == 3, F.concat(quoted, F.lit(",x,y"))).when(i % 20 == 5, "").otherwise(F.concat(quoted, F.lit(","), F.col("lang")))
    ends = spark.createDataFrame([(-1, "text,lang"), (1 << 62, '"never closed')], "doc_id long, value string")
    path = _as_files(spark, sf, table(spark, sf, "documents").select("doc_id", row.alias("value")).unionByName(ends), "jsonl")
    return strict.read_records(spark, path, "csv", parts=True).select("line", F.coalesce("input_error", F.lit("none")).alias("error"), "input_fatal", F.sha2(F.col("fields.text.value").cast("binary"), 256).alias("text_sha256"))


@query
def split_id_faults(spark, sf):
    """Grouping ids of every JSON type: strings and integers are keys, nulls are none, the others are faults."""
    i = F.col("doc_id") % 7
    value = F.when(i == 0, "5").when(i == 1, '"five"').when(i == 2, "null").when(i == 3, "5.5").when(i == 4, "true").when(i == 5, "[5]").otherwise('{"a": 5}')
    lines_ = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('{"text": "some text", "group_id": '), value, F.lit("}")).alias("value"))
    rows = strict.read_records(spark, _as_files(spark, sf, lines_, "jsonl"), "jsonl", parts=True)
    faults = split.faults(with_state(rows).withColumn("text", training_text()))
    return rows.join(faults, "line", "left").select("line", "group_id", F.col("fault").alias("fault"))


@query
def training_text_faults(spark, sf):
    """Documents blank, as they are, and repeated beyond the limit."""
    i = F.col("doc_id")
    long_ = F.rpad(F.lit("x"), F.lit(1_000_000) + (i % 3).cast("int"), "y")
    text = F.when(i % 10 == 1, "").when(i % 500 == 7, long_).otherwise(F.col("text"))
    return table(spark, sf, "documents").select((i + 1).alias("line"), training_fault(text).alias("fault"))


@query
def decision_shares(spark, sf):
    """Shares of each decision in percent, and the number of records."""
    return report.shares(screened(spark, sf))


@query
def masking_counters(spark, sf):
    """Rows whose prompt is left out of the loss, characters left out and learned."""
    df = with_state(tables.turns(table(spark, sf, "conversations"))).withColumn("x", answer_split())
    return report.masking(df)


#: Turns between marks, a first system turn where there is none, and the mark of the answer to come.
MARKED = """{% for message in messages %}
    {% if loop.first and message['role'] != 'system' %}
<|im_start|>system
Answer briefly.<|im_end|>
    {% endif %}
{{ '<|im_start|>' + message.role + '\\n' + message['content'] | trim + '<|im_end|>\\n' }}
{%- endfor %}
{% if add_generation_prompt %}
<|im_start|>assistant
{% endif %}
"""
#: Questions and answers in turn, a system turn joined to the first question; other orders are refused.
ALTERNATING = """{% if messages[0]['role'] == 'system' %}{% set told = messages[0]['content'] %}{% set rest = messages[1:] %}{% else %}{% set told = false %}{% set rest = messages %}{% endif %}
{{- bos_token }}
{%- for m in rest %}
{%- if (m['role'] == 'user') != (loop.index0 % 2 == 0) or m['role'] not in ['user', 'assistant'] %}{{ raise_exception('turns must alternate') }}{% endif %}
{%- if m.role == 'user' %}{{ '[INST] ' + (told + '\\n\\n' if loop.first and told != false else '') + m.content.strip() + ' [/INST]' }}{% else %}{{ ' ' ~ m.content | trim ~ eos_token }}{% endif %}
{%- endfor %}"""


def _chats(spark, sf, template: str, **names) -> DataFrame:
    df = with_state(tables.turns(table(spark, sf, "conversations"))).withColumn("x", chat_split(template, **names))
    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return df.select("line", "x.templated", hashed("x.full").alias("full_sha256"), hashed("x.prompt").alias("prompt_sha256"), F.length("x.full").cast("long").alias("full_chars"), F.length("x.prompt").cast("long").alias("prompt_chars"))


@query
def chat_template_marked(spark, sf):
    """Conversations rendered by a chat template, with the part a loss on answers leaves out."""
    return _chats(spark, sf, MARKED)


@query
def chat_template_alternating(spark, sf):
    """A template that refuses some conversations, which then are rendered plainly."""
    return _chats(spark, sf, ALTERNATING, bos_token="<s>", eos_token="</s>")


@query
def token_masking(spark, sf):
    """The same in tokens of a public vocabulary; no SQL, the operator is tested against a tokenizer."""
    import public_tokenizers

    from gristmill.operators.encode import encode, masking_totals

    df = with_state(tables.turns(table(spark, sf, "conversations"))).withColumn("x", answer_split())
    return masking_totals(encode(df, public_tokenizers.path("byte_bpe_50k.json"), 50256, 256))


@query
def recent_runs(spark, sf):
    """Sources as items, written again by each of their documents: the second page of two, by last write."""
    events = table(spark, sf, "documents").select(F.lit("run").alias("kind"), F.col("source").alias("id"), F.col("lang").alias("body"), F.col("doc_id").alias("seq"))
    return store.page(store.newest_items(events, ["kind", "id"]), 2, 2).select("id", "seq", "body")


@query
def last_log_entries(spark, sf):
    """The last two turns of each conversation."""
    return store.last_entries(table(spark, sf, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "text")


# What a run writes, read back


def _run(spark, sf, train: bool = False) -> str:
    from gristmill.plans.pipeline import Pipeline

    path = new_path(spark, "run")
    run = Pipeline(spark, path)
    stored = not tables.is_small(spark.read.parquet(f"{sf}/documents.parquet"))  # a small table is dealt to all cores once
    decided, _ = run.screen(docs(spark, sf, group_id=F.floor(F.col("doc_id") / 4).cast("string")), stored=stored)
    if train:
        run.train(decided)
    return path


@query
def decision_files(spark, sf):
    """Records in the files of each decision, in their order: every file's lines ascend."""
    rows = spark.read.text(f"{_run(spark, sf)}/decisions")
    return rows.select("decision", F.sha2(F.get_json_object("value", "$.text").cast("binary"), 256).alias("text_sha256"))


@query
def audit_rows(spark, sf):
    rows = spark.read.schema("line long, state_hash string, mode string, cache_hit boolean, decision string, reason string").json(f"{_run(spark, sf)}/audit")
    return rows.select("line", "state_hash", "mode", "cache_hit", "decision", "reason")


@query
def split_files(spark, sf):
    """Kept records with their split, component and training text."""
    rows = spark.read.text(f"{_run(spark, sf, True)}/splits")
    get = lambda n: F.get_json_object("value", f"$.{n}")
    return rows.select("split", get("_split_group").alias("component"), F.sha2(get("text").cast("binary"), 256).alias("text_sha256"))


@query
def model_artifact(spark, sf):
    """Cells of the exported model that are not zero."""
    text = spark.read.text(f"{_run(spark, sf, True)}/model/byte_bigram.json", wholetext=True)
    cells = text.select(F.from_json("value", "counts array<array<long>>, model_type string").alias("m")).select(F.posexplode("m.counts").alias("prev", "row"))
    return cells.select(F.col("prev").cast("long").alias("prev"), F.posexplode("row").alias("token", "n")).where("n > 0").select("prev", F.col("token").cast("long").alias("token"), "n")


@query
def stored_decisions(spark, sf):
    """The cache of a run: one row per admissible state."""
    from gristmill.operators.screening import newest
    from gristmill.plans.pipeline import CACHE

    return newest(spark.read.schema(CACHE).parquet(f"{_run(spark, sf)}/cache")).select("state_hash", F.col("result.decision").alias("decision"), F.col("result.reason").alias("reason"))
