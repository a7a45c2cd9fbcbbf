"""Text expressions against Python's own string rules."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
MAIL = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")


def test_white_space_is_pythons(spark):
    rows = [(f"a{c}{c}b{c}",) for c in SPACES] + [("\u200ba",), ("",), ("  ",)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", T.fold(F.col("t")).alias("f"), T.strip(F.col("t")).alias("s"), T.blank(F.col("t")).alias("b")).collect():
        assert (r.f, r.s, r.b) == (" ".join(r.t.split()), r.t.strip(), not r.t.strip())
    assert len(SPACES) == 29


def test_white_space_in_long_mixed_texts(spark):
    import random

    rng = random.Random(3)
    pieces = ["word", "é", "漢", "\x7f", "\u167f", "\u1681", "\u200b", " ", " ", "  ", "\n", "\r\n", "\t", *SPACES]
    rows = [("".join(rng.choices(pieces[: rng.choice([2, 9, 12, 13, len(pieces)])], k=rng.randrange(80))),) for _ in range(600)]
    df = spark.createDataFrame([*rows, (None,)], "t string")
    for r in df.select("t", T.fold(F.col("t")).alias("f"), T.strip(F.col("t")).alias("s")).collect():
        assert (r.f, r.s) == ((None, None) if r.t is None else (" ".join(r.t.split()), r.t.strip()))


def test_email_edges(spark):
    rows = ["x a@b.co y", "éa@b.co", "a@b.cö", "a@b.co_", "(a@b.co)", "a@b", "a.b+c@d-e.org.", "́a@b.co", "名a@b.co"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for r in df.select("t", T.has_email(F.col("t")).alias("m")).collect():
        assert r.m == bool(MAIL.search(r.t)), r.t


def test_canonical_json_is_pythons(spark):
    rows = ["plain", 'quo"te \\ back', "tab\t\n\r\x08\x0c", "\x0b\x0e\x1f\x01", "\\u000E literal", "\\\x0e", "ünï 漢 😀", "\x7f\u2028"]
    df = spark.createDataFrame([(r, None) for r in rows], "text string, other string")
    got = df.select("text", T.canonical_json(F.struct("other", "text")).alias("j")).collect()
    for r in got:
        assert r.j == json.dumps({"text": r.text}, ensure_ascii=False, separators=(",", ":"))


def test_byte_tokens_cut_bytes_not_characters():
    import pyarrow as pa

    from gristmill.operators.bigram import tokens

    texts = ["aé漢", "", "xy", "é" * 9]
    context, token, size = tokens(pa.array(["left out", *texts])[1:], 4)
    expected = [[*t.encode()[:4], 256] for t in texts]
    assert size.tolist() == [len(e) for e in expected] and token.tolist() == sum(expected, [])
    assert context.tolist() == sum(([257, *e[:-1]] for e in expected), [])


def test_fold_is_split_and_join(spark):
    import random

    rng = random.Random(0)
    texts = ["".join(rng.choice("ab  \n\t\x1c\x85\u00a0\u3000\u2028\u200b") for _ in range(rng.randrange(25))) for _ in range(500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.fold(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: " ".join(t.split()) for i, t in enumerate(texts)}



def test_digest(spark):
    r = spark.createDataFrame([("ü",)], "t string").select(T.digest(F.col("t")).alias("x")).first()
    assert r.x == hashlib.sha256("ü".encode()).hexdigest()


@pytest.mark.parametrize("a,b,ok", [(1.0, 1.01, True), (1.0, 1.02, False), (1.0, 1.015, True)])
def test_isclose(spark, a, b, ok):
    assert spark.range(1).select(T.isclose(F.lit(a), F.lit(b), 0.0150001)).first()[0] == ok


def test_encoding_masks_a_prompt_that_begins_the_text(spark):
    import pytest

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from gristmill.operators.encode import encode, masking_totals

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pairs = [("user: how? \nassistant: so", "user: how? \nassistant: "), ("a b c", None), ("", None), ("x y z w v u t s r", "x y z w v u t s"), ("inseparable", "insep"), (None, None)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pairs)], "line long, x struct<full:string,prompt:string>")
    for limit in (4, 64):
        got = {r.line: (r.ids, r.masked) for r in encode(rows, path, 50256, limit).collect()}
        for i, (full, prompt) in enumerate(pairs):
            ids = [*t.encode(full or "", add_special_tokens=False).ids[: limit - 1], 50256]
            cut = t.encode(prompt or "", add_special_tokens=False).ids
            assert got[i] == (ids, len(cut) if cut and len(cut) < len(ids) and ids[: len(cut)] == cut else 0)
        assert got[0][1] == 0 or limit > 4
        sums = masking_totals(encode(rows, path, 50256, limit)).first()
        assert sums.masked_rows == sum(m > 0 for _, m in got.values()) and sums.prompt_tokens + sums.learned_tokens == sum(len(ids) for ids, _ in got.values())
    assert {r.masked for r in encode(rows, path, 50256, 64, answer_only=False).collect()} == {0}


def test_texts_are_encoded_in_chunks():
    """A batch is never tokenized whole: slices of bounded size, nulls and long texts included, lose no row."""
    import pyarrow as pa

    from gristmill.operators import encode

    texts = ["x" * (i * 7919 % 90_000) if i % 11 else None for i in range(300)] + ["y" * (2 * encode.CHUNK), "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array(texts), pa.array([t and t[:9] for t in texts])], ["line", "full", "prompt"])
    parts = list(encode.chunks(batch))
    assert len(parts) > 20 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(302))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= encode.CHUNK for p in parts)
    assert list(encode.chunks(batch.slice(0, 0))) == []
