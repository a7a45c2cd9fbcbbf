"""Files that arrive: numbering, faults, restarts, replays, odd names, and screening of what has landed."""

import json
import os

import pytest

from gristmill.operators.screening import screen
from gristmill.sources.strict import read_records
from gristmill.streaming.arrivals import LINE_BITS, land, landed_files, record_stream
from gristmill.streaming.screen import decisions, screen_stream


class Inbox:
    def __init__(self, spark, where):
        self.spark, self.where, self.url, self.clock = spark, where, f"file://{where}", 1_700_000_000
        os.makedirs(where / "in", exist_ok=True)

    def put(self, name, body):
        path = self.where / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else "".join(json.dumps(r) + "\n" for r in body).encode())
        self.clock += 10
        os.utime(path, (self.clock, self.clock))

    def land(self, **how):
        land(self.spark, f"{self.url}/in", self.url, f"{self.url}/landing", **how).awaitTermination()
        return sorted(self.rows(), key=lambda r: r.line)

    def rows(self):
        path = f"{self.url}/records"
        return self.spark.read.parquet(path).collect() if any(f.name.endswith(".parquet") for f in (self.where / "records").rglob("*")) else []


def test_files_are_numbered_in_order_of_arrival(spark, tmp_path):
    box = Inbox(spark, tmp_path)
    box.put("z.jsonl", [{"text": "first"}, {"text": "second"}])
    box.put("a b%20[1].jsonl", b'{"text": "third"}\n\n[1]\n{"text": "\xff"}')
    box.put("empty.jsonl", b"")
    got = box.land(max_files=2)
    assert [(r.line >> LINE_BITS, r.file_line, r.input_error) for r in got] == [(0, 1, None), (0, 2, None), (1, 1, None), (1, 3, "record_must_be_object"), (1, 4, "invalid_utf8")]
    assert [r.line & ((1 << LINE_BITS) - 1) for r in got] == [r.file_line for r in got] and json.loads(got[4].record)["_invalid_input"]["line"] == 4
    box.put("deep/a.jsonl", [{"text": "late", "group_id": 5}])
    again = box.land()
    assert again[:5] == got and (again[5].line, again[5].file_line, again[5].group_id) == ((2 << LINE_BITS) | 1, 1, "5")
    files = {r.file_no: r for r in landed_files(spark, box.url).collect()}
    assert sorted(files) == [0, 1, 2] and files[2].file.endswith("deep/a.jsonl") and files[2].size > files[2].batch > files[0].batch


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    box = Inbox(spark, tmp_path)
    box.put("a.jsonl", [{"text": "one of them"}])
    box.land()
    box.put("b.jsonl", [{"text": "another"}])
    want = box.land()
    names = sorted(str(p) for p in (tmp_path / "records").rglob("*.parquet"))
    os.remove(tmp_path / "landing" / "commits" / "1")
    (tmp_path / "landing" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert box.land() == want and sorted(str(p) for p in (tmp_path / "records").rglob("*.parquet")) == names
    # The same, had the driver been lost before the records appeared: files keep their numbers.
    os.rename(tmp_path / "records" / "batch=1", tmp_path / "_lost")
    os.remove(tmp_path / "landing" / "commits" / "1")
    (tmp_path / "landing" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert box.land() == want


def test_csv_and_nothing_at_all(spark, tmp_path):
    box = Inbox(spark, tmp_path / "csv")
    assert box.land(kind="csv") == []
    box.put("a.csv", b'text,lang\n"two\nlines",en\nshort\n')
    box.put("b.csv", b'lang,text\nde,"other order"\n')
    got = box.land(kind="csv")
    assert [(r.line >> LINE_BITS, r.file_line, r.input_error, r.fields.text.value) for r in got] == [(0, 2, None, "two\nlines"), (0, 4, "csv_column_count_mismatch", None), (1, 2, None, "other order")]
    with pytest.raises(ValueError):
        land(spark, "x", "x", "x", kind="xml")


def test_landed_files_are_screened_like_one_file(spark, tmp_path):
    texts = ["a first text here", "a second text here", "tiny", "a first  text here", "write to x.y@mail.example", "a second text here", "", "a third text here"]
    box, whole = Inbox(spark, tmp_path), tmp_path / "whole.jsonl"
    whole.write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    want = [(r.result.decision, r.result.reason) for r in screen(read_records(spark, f"file://{whole}")).orderBy("line").collect()]
    for n, (lo, hi) in enumerate([(0, 3), (3, 5), (5, 8)]):
        box.put(f"{9 - n}.jsonl", [{"text": t} for t in texts[lo:hi]])
        box.land()
        screen_stream(record_stream(spark, box.url), f"{box.url}/out", f"{box.url}/screening").awaitTermination()
        assert [(r.decision, r.reason) for r in decisions(spark, f"{box.url}/out").orderBy("line").collect()] == want[:hi]
