"""Records to content-only states: four layouts in a fixed order, text, training text, identity.

A record's content fields arrive typed: each plain field is ``struct<kind, value>`` with kind
``absent``, ``null``, ``string`` or ``other``; messages are ``struct<kind, items, surrogate>`` with kind
``absent``, ``null``, ``empty`` (an empty string), ``list``, ``badjson`` (a string that is no JSON) or
``other``. Items hold null for a role or content that is not a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import blank, canonical_json, digest, fold, let, strip

PLAIN = ["text", "instruction", "input", "output", "prompt", "response"]
FIELD = "struct<kind:string,value:string>"
MESSAGES = "struct<kind:string,items:array<struct<role:string,content:string>>,surrogate:boolean>"
FIELDS = "struct<" + ",".join(f"{n}:{FIELD}" for n in PLAIN) + f",messages:{MESSAGES}>"
STATE = "struct<input:string,instruction:string,messages:array<struct<content:string,role:string>>,output:string,prompt:string,response:string,text:string>"
ROLES = ["system", "user", "assistant", "tool"]
MAX_TRAINING_CHARS = 1_000_000


def fields(messages: Column | None = None, **plain: Column) -> Column:
    """Typed content fields from table columns: an absent argument is an absent field, null is null."""
    parts = []
    for n in PLAIN:
        c = plain.get(n)
        if c is None:
            parts.append(F.struct(F.lit("absent").alias("kind"), F.lit(None).cast("string").alias("value")).alias(n))
        else:
            parts.append(F.struct(F.when(c.isNull(), "null").otherwise("string").alias("kind"), c.cast("string").alias("value")).alias(n))
    if messages is None:
        m = F.struct(F.lit("absent").alias("kind"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("items"), F.lit(False).alias("surrogate"))
    else:
        m = F.struct(F.when(messages.isNull(), "null").otherwise("list").alias("kind"), messages.cast("array<struct<role:string,content:string>>").alias("items"), F.lit(False).alias("surrogate"))
    return F.struct(*parts, m.alias("messages"))


def _layout() -> Column:
    m = F.col("fields.messages.kind")
    kind = lambda n: F.col(f"fields.{n}.kind")
    return (
        F.when(~m.isin("absent", "null", "empty"), "messages")
        .when((kind("text") == "string") & ~blank(F.col("fields.text.value")), "text")
        .when((kind("instruction") != "absent") | (kind("output") != "absent"), "instruction")
        .when((kind("prompt") != "absent") | (kind("response") != "absent"), "prompt")
    )


def _error() -> Column:
    kind = lambda n: F.col(f"fields.{n}.kind")
    value = lambda n: F.col(f"fields.{n}.value")
    empty = lambda n: (kind(n) != "string") | blank(value(n))
    items, mk = F.col("fields.messages.items"), F.col("fields.messages.kind")
    bad_item = F.exists(items, lambda x: x["role"].isNull() | ~x["role"].isin(ROLES) | x["content"].isNull())
    any_kind = lambda names, kinds: F.exists(F.array(*(kind(n) for n in names)), lambda k: k.isin(kinds))
    lay = F.col("layout")
    messages = (
        F.when(mk == "badjson", "messages_must_be_json_array")
        .when((mk != "list") | (F.size(items) <= 0), "messages_must_be_nonempty_array")
        .when(bad_item, "messages_require_string_role_and_content")
        .when(F.forall(items, lambda x: blank(x["content"])), "empty_content")
        .when(F.col("fields.messages.surrogate"), "content_is_not_valid_utf8")
    )
    triple = ["instruction", "input", "output"]
    return (
        F.when(lay.isNull(), "missing_supported_content")
        .when(lay == "messages", messages)
        .when((lay == "instruction") & any_kind(triple, ["other"]), "instruction_input_output_must_be_strings")
        .when((lay == "instruction") & (empty("instruction") | empty("output")), "instruction_and_output_required")
        .when((lay == "prompt") & any_kind(["prompt", "response"], ["other", "null"]), "prompt_response_must_be_strings")
        .when((lay == "prompt") & (empty("prompt") | empty("response")), "prompt_and_response_required")
    )


def with_state(df: DataFrame) -> DataFrame:
    """Add ``layout``, ``content_error`` and ``state`` (null where there is an error) to rows with ``fields``."""
    df = df.withColumn("layout", _layout()).withColumn("content_error", _error())
    ok = F.col("content_error").isNull()
    lay = F.col("layout")
    value = lambda n, at: F.when(ok & (lay == at), F.col(f"fields.{n}.value"))
    items = F.transform("fields.messages.items", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    state = F.struct(
        value("input", "instruction").alias("input"), value("instruction", "instruction").alias("instruction"), F.when(ok & (lay == "messages"), items).alias("messages"),
        value("output", "instruction").alias("output"), value("prompt", "prompt").alias("prompt"), value("response", "prompt").alias("response"), value("text", "text").alias("text"),
    )
    return df.withColumn("state", F.when(ok, state))


def state_text(state: Column | None = None) -> Column:
    """Contents joined by newlines, roles left out."""
    s = F.col("state") if state is None else state
    messages = lambda x: F.array_join(F.transform(x["messages"], lambda m: m["content"]), "\n")
    plain = lambda x: F.concat_ws("\n", *(x[n] for n in PLAIN))
    return let(s, lambda x: F.when(x["messages"].isNotNull(), messages(x)).when(x.isNotNull(), plain(x)))


def training_text(state: Column | None = None) -> Column:
    """What a model is trained on: ``role: content`` lines of messages, else the state text; stripped."""
    s = F.col("state") if state is None else state
    turns = F.array_join(F.transform(s["messages"], lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return strip(F.when(s["messages"].isNotNull(), turns).otherwise(state_text(s)))


def training_fault(text: Column) -> Column:
    """Why a text cannot be trained on, or null."""
    return F.when(text.isNull() | (text == ""), "the training text is empty").when(F.length(text) > MAX_TRAINING_CHARS, f"the training text has more than {MAX_TRAINING_CHARS} characters")


def folded(state: Column) -> Column:
    parts = [fold(state[n]).alias(n) for n in ("input", "instruction")]
    parts.append(F.transform(state["messages"], lambda m: F.struct(fold(m["content"]).alias("content"), m["role"].alias("role"))).alias("messages"))
    return F.struct(*parts, *(fold(state[n]).alias(n) for n in ("output", "prompt", "response", "text")))


def state_hash(mode: str = "whitespace", state: Column | None = None) -> Column:
    """SHA-256 of the canonical JSON of the state, white space folded or exact; null without a state."""
    s = F.col("state") if state is None else state
    return let(s, lambda x: F.when(x.isNotNull(), digest(canonical_json(x if mode == "exact" else folded(x)))))


def conversation(state: Column | None = None) -> Column:
    """The record as turns, or null for a bare passage."""
    s = F.col("state") if state is None else state
    turn = lambda role, c: F.struct(c.alias("content"), F.lit(role).alias("role"))
    asked = F.concat(s["instruction"], F.when(~blank(s["input"]), F.concat(F.lit("\n\n"), s["input"])).otherwise(""))
    return (
        F.when(s["messages"].isNotNull(), s["messages"])
        .when(s["instruction"].isNotNull(), F.array(turn("user", asked), turn("assistant", s["output"])))
        .when(s["prompt"].isNotNull(), F.array(turn("user", s["prompt"]), turn("assistant", s["response"])))
    )


def answer_split(state: Column | None = None) -> Column:
    """``struct<full, prompt>`` of the plain-text rendering: what a loss on answers leaves out.

    Conversations whose last turn is the assistant's lose that answer at the end of the training text;
    ``prompt`` is null where nothing is masked.
    """
    s = F.col("state") if state is None else state
    full, turns = training_text(s), conversation(s)
    last = F.try_element_at(turns, F.lit(-1))
    answer = strip(last["content"])
    masked = (last["role"] == "assistant") & (answer != "") & full.endswith(answer) & (F.length(full) > F.length(answer))
    return F.struct(full.alias("full"), F.when(masked, F.substring(full, F.lit(1), F.length(full) - F.length(answer))).alias("prompt"))
