"""Strict files, layouts, the order of checks, scorers, caches and reports."""

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill.operators import report
from gristmill.operators.screening import ScorerError, cacheable, callable_scorer, replay_scorer, screen
from gristmill.sources import strict, strict_csv


def load(spark, tmp_path, data: bytes, name="in.jsonl"):
    path = tmp_path / name
    path.write_bytes(data)
    return strict.read_records(spark, f"file://{path}")


def decide(df, **config):
    rows = screen(df, config).select("line", "result.*", "state_hash").orderBy("line").collect()
    return [(r.line, r.decision, r.reason) for r in rows], rows


def lines(*records):
    return b"".join(json.dumps(r).encode() + b"\n" for r in records)


def test_layouts_and_content_errors(spark, tmp_path):
    good = {"messages": [{"role": "user", "content": "a question", "x": 1}, {"role": "assistant", "content": "an answer"}]}
    cases = [
        ({"text": "plain text here", "secret": 1}, None), (good, None), ({"messages": json.dumps(good["messages"])}, None), ({"instruction": "do the thing", "output": "done it"}, None),
        ({"prompt": "ask a thing", "response": "told", "id": 3}, None), ({"messages": "{", "text": "fallback"}, "messages_must_be_json_array"), ({"messages": [], "text": "x"}, "messages_must_be_nonempty_array"),
        ({"messages": [{"role": 123, "content": "x"}]}, "messages_require_string_role_and_content"), ({"messages": [{"role": "boss", "content": "x"}]}, "messages_require_string_role_and_content"),
        ({"messages": [{"role": "user", "content": " "}]}, "empty_content"), ({"instruction": 5, "output": "x"}, "instruction_input_output_must_be_strings"), ({"instruction": "x", "output": None}, "instruction_and_output_required"),
        ({"prompt": "x", "response": None}, "prompt_response_must_be_strings"), ({"prompt": "x"}, "prompt_and_response_required"), ({"other": 1}, "missing_supported_content"), ({"text": 5}, "missing_supported_content"),
        ({"messages": '[{"role": "user", "content": "\\ud800 torn"}]'}, "content_is_not_valid_utf8"), ({"messages": "", "text": "text after empty messages"}, None), ({"messages": "7"}, "messages_must_be_nonempty_array"),
    ]
    _, rows = decide(load(spark, tmp_path, lines(*(c for c, _ in cases))), min_chars=1)
    assert [r.error for r in rows] == [e for _, e in cases]


def faults(df):
    return [(r.line, r.input_error) for r in df.orderBy("line").collect()]


def test_each_kind_of_broken_line(spark, tmp_path):
    kinds = [
        (b'\xef\xbb\xbf{"text": "a mark before the first line"}', None), (b"no json at all", "invalid_json"), (b"", "skipped"), (b" \t\x0b ", "skipped"), (b'"a string"', "record_must_be_object"), (b"null", "record_must_be_object"),
        (b'{"text": "caf\xe9 in another encoding"}', "invalid_utf8"), (b'{"text": "x", "n": Infinity}', "invalid_json"), (b'{"text": "half a pair \\uDC00"}', "invalid_json"), (b'{"text": "a whole pair \\ud83d\\ude00"}', None),
        (b'{"n": 1e999}', "invalid_json"), (b'{"n": 12345678901234567890123}', None), (b'{"a": 1} {"b": 2}', "invalid_json"), (b'{"a": 1, "a": 2}', None), (b'{"text": "ends with a carriage return"}\r', None), (b"[" * 100_000, "invalid_json"), (b'{"text": "no newline at the end"}', None),
    ]
    got = faults(load(spark, tmp_path, b"\n".join(k for k, _ in kinds)))
    assert got == [(i, e) for i, (_, e) in enumerate(kinds, 1) if e != "skipped"]


def test_line_numbers_over_many_splits_and_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for name in "ab":
            (tmp_path / f"{name}.jsonl").write_bytes(b"\n" * 5 + b"".join(b'{"text": "%b number %d"}\n\n' % (name.encode(), i) for i in range(200)))
        df = strict.read_records(spark, f"file://{tmp_path}", "jsonl")
        assert df.rdd.getNumPartitions() > 4
        want = {(6 + 2 * i, f"{n} number {i}") for n in "ab" for i in range(200)}
        rows = df.select("line", "fields.text.value").collect()
        assert len(rows) == 400 and {tuple(r) for r in rows} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("kind", ["jsonl", "csv"])
def test_parts_of_one_file(spark, tmp_path, kind):
    """A folder of parts gives what one file of the same bytes gives, in many splits, with records over the ends of parts."""
    if kind == "jsonl":
        lines = [b"\xef\xbb\xbf{}"] + [b"{broken" if i % 7 == 3 else b"" if i % 7 == 5 else b'{"text": "number %d"}' % i for i in range(120)]
    else:
        lines = [b"id,text"] + [b'%d,"over\n\nthree lines"' % i if i % 3 else b"%d,one,more" % i for i in range(120)] + [b'"never closed']
    whole = b"\n".join(lines) + b"\n"
    physical = whole.splitlines(keepends=True)
    (tmp_path / "parts").mkdir()
    (tmp_path / f"whole.{kind}").write_bytes(whole)
    for k in range(0, len(physical), 11):
        (tmp_path / "parts" / f"part-{k:05}").write_bytes(b"".join(physical[k : k + 11]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        shown = lambda path, **how: sorted(strict.read_records(spark, f"file://{tmp_path}/{path}", kind, **how).select("line", "input_error", "input_fatal", "record").collect(), key=lambda r: r.line)
        want, got = shown(f"whole.{kind}"), shown("parts", parts=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(want) > 100 and got == want


def test_files_of_queries_are_written_in_parts(spark, tmp_path, monkeypatch):
    """No task writes all lines of a larger table, and the parts hold them in order."""
    from gristmill.plans import queries
    from gristmill.sources import tables

    df = spark.range(1000, numPartitions=3).selectExpr("999 - id as doc_id", "concat('line ', 999 - id) as value")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(tables, "PART", tables.size_of(spark.read.parquet(f"file://{tmp_path}/documents.parquet")) // 5)
    path = queries._as_files(spark, f"file://{tmp_path}", df, "jsonl").removeprefix("file:")
    texts = [p.read_text().splitlines() for p in sorted(Path(path).glob("part-*"))]
    assert len(texts) >= 5 and max(map(len, texts)) < 400 and sum(texts, []) == [f"line {i}" for i in range(1000)]


@pytest.mark.parametrize("end", [b"\n", b""])
def test_size_limit_counts_the_newline(spark, tmp_path, end):
    wrap = lambda n: b'{"text": "' + b"z" * (n - 12) + b'"}'
    limit = 1 << 20
    data = wrap(limit - 1) + b"\n" + wrap(limit) + b"\n" + b'{"text": "small again"}\n' + wrap(limit) + end
    last = "row_exceeds_1_mib" if end else None
    assert faults(load(spark, tmp_path, data)) == [(1, None), (2, "row_exceeds_1_mib"), (3, None), (4, last)]


def test_csv_cells():
    cells = strict_csv.csv_cells
    assert cells('a,"b ""c"", d",\r\n') == ["a", 'b "c", d', ""] and cells('x"y,z\n') == ['x"y', "z"] and cells('"",""') == ["", ""]
    for still_open in ('a,"b', '"x""', '"one\ntwo'):
        assert cells(still_open) is None
    for wrong in ('"a"b\n', "a\rb\n", '"a" ,b\n'):
        with pytest.raises(strict_csv.CsvSyntax):
            cells(wrong)


def test_csv_files(spark, tmp_path):
    read = lambda data: [(r.line, r.input_error, r.fields.text.value) for r in load(spark, tmp_path, data, "t.csv").orderBy("line").collect()]
    assert read(b'\xef\xbb\xbftext,n\r\n"over\ntwo, lines",1\r\n\r\nalone\n"q ""q""",2') == [(2, None, "over\ntwo, lines"), (5, "csv_column_count_mismatch", None), (6, None, 'q "q"')]
    assert read(b"") == []
    assert read(b'text\nfine\n"runs\non') == [(2, None, "fine"), (4, "invalid_csv_syntax", None)]
    assert read(b'text\nfine\n"x" y\nafter\n') == [(2, None, "fine"), (3, "invalid_csv_syntax", None)]
    assert read(b"text\nfine\n\xff\nafter\n") == [(2, None, "fine"), (3, "invalid_utf8", None)]
    for head in (b"text,text", b"text,,n", b""):
        assert read(head + b"\n1,2\n") == [(1, "csv_requires_unique_nonempty_headers", None)]
    big = b'"' + b"line\n" * 300_000
    assert [e for _, e, _ in read(b"text\nfine\n" + big)] == [None, "csv_row_exceeds_1_mib"]
    assert all(r.input_fatal == (r.input_error is not None) for r in load(spark, tmp_path, b'text\nfine\n"open', "u.csv").collect())


def one_by_one(data):
    """A CSV file read line by line by one reader: (line, error, cells or values)."""
    out, names, text, size, start = [], None, "", 0, 1
    parts = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    lines_ = [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    for n, raw in enumerate(lines_, 1):
        start, size = (start, size + len(raw)) if text else (n, len(raw))
        fault = lambda reason: [*out, (n, reason)]  # noqa: B023, E731
        if size > 1 << 20:
            return fault("csv_row_exceeds_1_mib")
        try:
            text += raw.decode()
            cells = strict_csv.csv_cells(text)
        except UnicodeDecodeError:
            return fault("invalid_utf8")
        except strict_csv.CsvSyntax:
            return fault("invalid_csv_syntax")
        if cells is None:
            continue
        blank, text = not text.strip("\r\n"), ""
        if names is None:
            if blank or not all(cells) or len(set(cells)) < len(cells):
                return fault("csv_requires_unique_nonempty_headers")
            names = cells
        elif not blank:
            out.append((start, "csv_column_count_mismatch" if len(cells) != len(names) else None, cells))
    return [*out, (len(lines_), "invalid_csv_syntax")] if text else out


def test_csv_in_many_splits(spark, tmp_path):
    """Files of quoted newlines, quotes, commas and faults, in splits of a few bytes, against one reader."""
    rng = random.Random(9)
    pieces = ["a", "b,", "\n", '""', ",", "long words ", "é", "\r\n", "'"]
    cell = lambda: '"' + "".join(rng.choice(pieces) for _ in range(rng.randrange(30))) + '"' if rng.random() < 0.4 else rng.choice(["plain", "", 'in"side', "x" * rng.randrange(60)])
    files = []
    for i in range(14):
        rows_ = ["id,text,more"] + [",".join(cell() for _ in range(3 if rng.random() < 0.95 else 2)) for _ in range(rng.randrange(5, 40))]
        rows_ += {1: ['"open\n' + "and on\n" * 50], 2: ["a,b\rc,d", "after"], 3: ['"x"y', "after"], 4: ["", "", "end,of,it"]}.get(i % 5, [])
        data = "\n".join(rows_).encode() + (b"\n" if i % 2 else b"")
        files.append({5: b"\xef\xbb\xbf" + data, 7: data.replace(b"long", b"\xff", 1), 8: b'"id\nof it","text ""x""",more' + data[12:], 9: b"id,id" + data, 10: b"\n" + data, 11: b'"never closed' + data.replace(b'"', b"")}.get(i, data))
    for i, data in enumerate(files):
        (tmp_path / f"{i}.csv").write_bytes(data)
    sizes = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        rows = strict_csv.csv_records(spark, f"file://{tmp_path}/*.csv").collect()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    got = {i: [] for i in range(len(files))}
    for r in rows:
        record = strict_csv.named(r.line, r.last, r.cells, r.error, r.names, lambda n, e, fatal: (n, e), lambda n, v, e=None: (n, e, v["_invalid_csv_values"] if e else list(v.values())))
        got[int(r.file.rpartition("/")[2].removesuffix(".csv"))] += [record] if record else []
    for i, data in enumerate(files):
        assert sorted(got[i], key=lambda r: r[0]) == one_by_one(data), i


def test_a_long_cell_is_read_once(spark, tmp_path):
    """A cell of a mebibyte in lines with quotes, as long as a record may be, in several splits, and one byte more."""
    import time

    line = 'some "" text\n'
    fill = (1 << 20) - len('"" \n') + 1
    for more, error in ((0, None), (1, "csv_row_exceeds_1_mib")):
        cell = (line * (fill // len(line) + 1))[: fill + more].replace('"" text\n', '"" text\n')
        cell = cell[: cell.rindex("\n") + 1] + "x" * (len(cell) - cell.rindex("\n") - 1)
        record = f'"{cell}"\n'
        assert len(record) == (1 << 20) + more
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            began = time.time()
            rows = load(spark, tmp_path, f"text\n{record}after\n".encode(), f"long{more}.csv").collect()
            took = time.time() - began
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r.input_error for r in sorted(rows, key=lambda r: r.line)] == ([None, None] if error is None else [error])
        assert error or rows[0].fields.text.value in (cell.replace('""', '"'), "after")
        assert took < 60
    lines_, state, began = [b'"'] + [b'some "" text'] * 80_000, strict_csv.CLOSED, time.time()
    for x in lines_:
        state = strict_csv.after_line(x, state)
    assert state == strict_csv.OPEN and strict_csv.csv_cells("".join(x.decode() + "\n" for x in lines_) + '"') and time.time() - began < 1


def test_ids_and_suffixes(spark, tmp_path):
    ids = [("5", "5", False), ('"five"', "five", False), ("null", None, False), ("5.0", None, True), ("true", None, True), ("[5]", None, True), ("12345678901234567890", "12345678901234567890", False)]
    rows = load(spark, tmp_path, b"".join(b'{"conversation_id": %b}\n' % v.encode() for v, *_ in ids)).orderBy("line").collect()
    assert [(r.conversation_id, r.id_error) for r in rows] == [(k, "conversation_id must be a string or an integer" if bad else None) for _, k, bad in ids]
    assert strict.format_of("X.NDJSON") == "jsonl"
    with pytest.raises(ValueError):
        strict.format_of("x.txt")


def test_order_of_checks(spark, tmp_path):
    data = lines({"text": "short"}, {"text": "short "}, {"text": "spaces   may differ"}, {"text": "\tspaces may\u2003differ\n"}, {"text": "ask some.one@mail.example first"}, {"text": "8 chars!"})
    got, _ = decide(load(spark, tmp_path, data))
    assert [r for _, _, r in got] == ["content_length_outside_bounds", "exact_duplicate", "demo_rules_passed", "exact_duplicate", "demo_email_pattern", "demo_rules_passed"]
    got, _ = decide(load(spark, tmp_path, data), rubric="code")
    assert [r for _, _, r in got][3] == "demo_rules_passed"


def test_input_kept_apart_from_absent(spark, tmp_path):
    _, rows = decide(load(spark, tmp_path, lines({"instruction": "ask it", "output": "told it", "input": ""}, {"instruction": "ask it", "output": "told it"}, {"instruction": "ask it", "output": "told it", "input": None})))
    assert rows[0].state_hash != rows[1].state_hash == rows[2].state_hash and rows[2].reason == "exact_duplicate"


def answer(keep=0.9, confidence=0.95, **change):
    pick = lambda a, b, c: {"type": "choice", "choice": a, "confidence": confidence, "probabilities": {a: keep, b: round(1 - keep, 4), c: 0.0}}
    out = {"model": "m1", "id": "r1", "usage": {"input_tokens": 10, "output_tokens": 2, "cost": 0.5}, "answers": {"quality": pick("good", "uncertain", "bad"), "privacy": pick("clear", "uncertain", "sensitive"), "trainability": pick("suitable", "uncertain", "unsuitable")}}
    return out | change


def scored(spark, tmp_path, function, data=None, cache=None, **config):
    raw = load(spark, tmp_path, data or lines({"text": "the first record"}, {"text": "the first  record"}, {"text": "the second record"}))
    cfg = {"provider": "scorer", **config}
    decided = screen(raw, cfg, cache, callable_scorer(function)).persist()
    return decided, report.data_report(decided, cfg)


def test_scorer_gates_and_usage(spark, tmp_path):
    decided, r = scored(spark, tmp_path, lambda s: answer(0.95 if "first" in s else 0.8))
    assert [x.result.decision for x in decided.orderBy("line").collect()] == ["keep", "reject", "review"]
    assert r["counts"] == {"total": 3, "keep": 1, "review": 1, "reject": 1, "duplicates": 1} and r["api_requests"] == 2
    assert r["usage"] == {"input_tokens": 20, "output_tokens": 4, "cost": 1.0} and r["models"] == {"m1": 2} and r["training_ready"]
    assert r["dimensions"]["privacy"]["gates"] == {"keep_probability_below_threshold": 1} and r["dimensions"]["quality"]["keep"] == 2
    again, r2 = scored(spark, tmp_path, lambda s: 1 / 0, cache=cacheable(decided))
    assert r2["cache_hits"] == 2 and r2["api_requests"] == 0 and r2["usage"]["cost"] == 0 and r2["models"] == {"m1": 2} and r2["counts"] == r["counts"]
    third, r3 = scored(spark, tmp_path, lambda s: answer(), cache=cacheable(decided), confidence=0.5)
    assert r3["cache_hits"] == 0


def test_invalid_answers_are_asked_again_and_not_cached(spark, tmp_path):
    bad = answer()
    bad["answers"]["quality"]["probabilities"]["good"] = 0.2
    decided, r = scored(spark, tmp_path, lambda s: bad, lines({"text": "only one record"}))
    row = decided.first().result
    assert (row.decision, row.reason, row.detail) == ("review", "invalid_response", "invalid probability distribution")
    assert r["unevaluated"] == 1 and r["unevaluated_fraction"] == 1.0 and not r["training_ready"] and r["complete"] and cacheable(decided).count() == 0
    assert r["errors"] == [{"line": 1, "error": "invalid_response", "detail": "invalid probability distribution"}]
    seen = tmp_path / "seen"
    seen.mkdir()

    def second_time(s):
        first = not list(seen.iterdir())
        (seen / "x").touch()
        return bad if first else answer(0.95)

    decided, r = scored(spark, tmp_path, second_time, lines({"text": "only one record"}))
    assert decided.first().result.decision == "keep" and r["training_ready"]


def test_failures_and_budget(spark, tmp_path):
    def fail(category):
        def ask(s):
            raise ScorerError(category)

        return ask

    _, r = scored(spark, tmp_path, fail("authentication"))
    assert r["status"] == "incomplete" and not r["training_ready"]
    _, r = scored(spark, tmp_path, fail("invalid_json"))
    assert r["status"] == "complete" and r["unevaluated"] == 2
    _, r = scored(spark, tmp_path, lambda s: answer(), max_requests=1)
    assert r["status"] == "incomplete" and r["unevaluated"] == 1 and r["api_requests"] == 1
    calls = tmp_path / "calls"
    calls.mkdir()

    def malformed(s):
        (calls / os.urandom(8).hex()).touch()
        return {}

    _, r = scored(spark, tmp_path, malformed, lines(*({"text": f"record number {i}"} for i in range(40))), max_requests=8)
    assert len(list(calls.iterdir())) == 8 == r["api_requests"] and r["unevaluated"] == 40 and r["status"] == "incomplete"


def corrupt():
    base = answer(0.95)
    quality = base["answers"]["quality"]
    with_quality = lambda **k: answer(0.95, answers=base["answers"] | {"quality": quality | k})
    p = quality["probabilities"]
    yield answer(0.95, model=" "), "missing resolved model"
    yield answer(0.95, answers={"quality": quality}), "unexpected answer dimensions"
    yield answer(0.95, answers=None), "invalid response"
    yield with_quality(type="score"), "wrong answer type"
    yield with_quality(confidence=1.5), "numeric response outside range"
    yield with_quality(confidence=None), "invalid response"
    yield with_quality(probabilities={"good": 1.0}), "unexpected probability options"
    yield with_quality(probabilities=p | {"good": -0.1}), "numeric response outside range"
    yield with_quality(probabilities=p | {"good": 0.5}), "invalid probability distribution"
    yield with_quality(choice="bad"), "invalid selected choice"
    yield with_quality(choice="other"), "invalid selected choice"
    yield with_quality(probabilities={"good": 0.94, "uncertain": 0.05, "bad": 0.0}), None


def test_answer_validation(spark):
    from gristmill import config as C
    from gristmill.operators.gates import RESPONSE, judge_answers

    cases = list(corrupt())
    df = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(cases)], "i long, j string").select("i", F.from_json("j", RESPONSE).alias("r")).select("i", "r.*")
    got = judge_answers(df, C.RUBRICS["general"], 0.85).orderBy("i").collect()
    assert [r.answer_error for r in got] == [e for _, e in cases]


def test_gate_order(spark):
    from gristmill import config as C
    from gristmill.operators.gates import RESPONSE, judge_answers

    def one(quality, privacy=(0.95, 0.05, 0.0), confidence=0.9):
        a = answer()
        for name, p, options in (("quality", quality, ("good", "uncertain", "bad")), ("privacy", privacy, ("clear", "uncertain", "sensitive"))):
            a["answers"][name] = {"type": "choice", "choice": options[p.index(max(p))], "confidence": confidence, "probabilities": dict(zip(options, p, strict=True))}
        return json.dumps(a)

    rows = [one((0.5, 0.5, 0.0)), one((0.7, 0.05, 0.25)), one((0.9, 0.1, 0.0), confidence=0.8), one((0.9, 0.1, 0.0), (0.85, 0.15, 0.0), 0.1), one((0.1, 0.2, 0.7))]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, j string").select("i", F.from_json("j", RESPONSE).alias("r")).select("i", "r.*")
    got = judge_answers(df, C.RUBRICS["general"], 0.85).orderBy("i").collect()
    gates = [(r.dimensions["quality"].gate, r.dimensions["privacy"].gate, r.answer_decision) for r in got]
    assert gates == [
        ("keep_probability_below_threshold", None, "review"), ("reject_probability_above_threshold", None, "review"), (None, "confidence_below_threshold", "review"),
        (None, "keep_probability_below_threshold", "review"), (None, None, "reject"),
    ]


def test_replayed_answers_are_judged_once(spark, tmp_path):
    """What reads the answers, for decisions and for counts of requests, reads them judged already."""
    from gristmill.operators.gates import RESPONSE
    from gristmill.plans.queries import SCORED

    raw = load(spark, tmp_path, lines({"text": "the first record"}, {"text": "the second record"}))
    states = [r.state_hash for r in screen(raw).select("state_hash").collect()]
    looked = spark.sparkContext.accumulator(0)

    def look(j):
        looked.add(1)
        return j

    seen = F.udf(look, "string").asNondeterministic()
    answers = spark.createDataFrame([(h, json.dumps(answer(0.95))) for h in states], "state_hash string, j string").withColumn("j", seen("j")).select("state_hash", F.from_json("j", RESPONSE).alias("response"))
    assert [r.requests for r in screen(raw, SCORED, scorer=replay_scorer(answers)).collect()] == [1, 1]
    assert looked.value == 2


def test_replayed_answers_have_no_budget(spark, tmp_path):
    from gristmill.operators.gates import RESPONSE
    from gristmill.plans.queries import SCORED

    raw = load(spark, tmp_path, lines({"text": "the first record"}, {"text": "the second record"}, {"text": "the third record"}))
    states = [r.state_hash for r in screen(raw).select("state_hash").collect()]
    answers = spark.createDataFrame([(h, json.dumps(answer(0.95))) for h in states], "state_hash string, j string").select("state_hash", F.from_json("j", RESPONSE).alias("response"))
    reasons = lambda **k: [r.result.reason for r in screen(raw, SCORED | k, scorer=replay_scorer(answers)).orderBy("line").collect()]
    assert SCORED["max_requests"] is None and reasons() == ["scorer_decision"] * 3
    assert reasons(max_requests=2) == ["scorer_decision"] * 2 + ["request_budget_exhausted"]
    for bad in (None, 0, 1_000_001):
        with pytest.raises(ValueError):
            screen(raw, {"provider": "scorer", "max_requests": bad}, scorer=callable_scorer(lambda s: answer()))
