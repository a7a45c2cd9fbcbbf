import hashlib
from collections import Counter

from gristmill.functions.scratch import new_path

SCHEMA = "page_id long, url string, html string, digest string, row long"


def pages():
    big = "<p>" + "söme text " * 4000 + "WARC/1.1\r\n\r\n0\r\n\r\n</p>"
    rows = [(i, f"http://h/{i}", f"<b>{i % 4}</b>" * 30) for i in range(20)]
    rows += [(30, "u", None), (31, None, ""), (32, "u", "short"), (33, "u", "short"), (34, "u\r\nX: y", big), (35, "u", big), (35, "u", big), (None, "u", big), (36, "u", big + "x")]
    rows += [(i, "u", f"{i % 2} of the longest ids " * 9) for i in (-5, 10**18, 10**18 + 1, 2**63 - 1, -(2**63), 3 * 10**18)]
    return [(*r, "d", 1) for r in rows]


def test_round_trip(spark):
    from gristmill.llm.warc import round_trip

    rows = pages()
    got = Counter(tuple(r) for r in round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    least = {}
    for i, _, html, *_ in rows:
        if i is not None:
            least[html or ""] = min(least.get(html or "", i), i)
    expected = Counter()
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        first = len(body) < 100 or i == least[html]
        expected[(i, len(body), hashlib.sha256(body).hexdigest(), "response" if first else "revisit", None if first else least[html])] += 1
    assert got == expected
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reassembly_reports_faults(spark):
    from gristmill.llm.warc import RECORD, read_warc, reassemble, write_warc

    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame(pages(), SCHEMA), path)
    records = read_warc(spark, path)
    rows = [tuple(r) for r in records.collect()]
    assert any(r[1] == "continuation" for r in rows)
    origin = next(r[6] for r in rows if r[1] == "continuation" and r[7] == 2)
    for broken in (
        [r for r in rows if not (r[6] == origin and r[7] == 2)],  # a gap
        [r for r in rows if not (r[6] == origin and r[8])],  # no last segment
        [(*r[:9], bytes(r[9])[:-1]) if r[6] == origin and r[7] == 2 else r for r in rows],  # short
        [r for r in rows if r[0] != origin],  # no first segment
    ):
        got = reassemble(spark.createDataFrame(broken, RECORD)).collect()
        assert [r for r in got if not r.complete] and all(r.payload is None for r in got if not r.complete)
        assert sum(not r.complete for r in got) == 1
    doubled = reassemble(spark.createDataFrame(rows + [r for r in rows if r[6] == origin], RECORD)).collect()
    assert all(r.complete for r in doubled)


def test_chunked_framing():
    from gristmill.llm.warc import chunked, dechunked

    for n in (0, 1, 4096, 10_000):
        assert dechunked(chunked(b"x\r\n" * n)) == b"x\r\n" * n
    assert dechunked(b"5;ext=1\r\nabcde\r\n0\r\n\r\n") == b"abcde"
    assert dechunked(b"5\r\nabcde\r\n0\r\nX-A: 1\r\n\r\n") == b"abcde"
    for body in (b"0x5\r\nabcde\r\n0\r\n\r\n", b"1_0\r\n" + b"a" * 16 + b"\r\n0\r\n\r\n", b"-1\r\n\r\n", b"5\r\nabcde\r\n0\r\n", b"5\r\nabcde\r\n0\r\n\r\nx", b"+5\r\nabcde\r\n0\r\n\r\n"):
        assert dechunked(body) is None
    assert dechunked(b"5\r\nabc") is None and dechunked(b"zz\r\n") is None and dechunked(b"") is None


def record(block: bytes, length=None, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\n\r\n"


def test_malformed_headers_end_in_incomplete_records(spark, tmp_path):
    from gristmill.llm.warc import member, read_warc, reassemble

    good = record(HTTP + b"fine", WARC_Type="response", WARC_Record_ID="<good>")
    bad = [
        record(HTTP + b"x", -54, WARC_Type="response", WARC_Record_ID="<negative>"), record(HTTP + b"x", "many", WARC_Type="response", WARC_Record_ID="<words>"),
        record(HTTP + b"x", WARC_Type="response", WARC_Record_ID="<segment>", WARC_Segment_Number="first"), b"GARBAGE\r\n\r\n",
        record(HTTP + b"x", WARC_Type="continuation", WARC_Record_ID="<total>", WARC_Segment_Origin_ID="<none>", WARC_Segment_Number=2, WARC_Segment_Total_Length="1e3"),
        record(HTTP + b"x", WARC_Type="response", WARC_Record_ID="<digest>", WARC_Payload_Digest="sha1:AAAA"),
    ]
    odd = record(HTTP + b"x", WARC_Type="response", WARC_Record_ID="<page>", X_Page_ID="abc")
    body = b"".join(x + good.replace(b"<good>", b"<good%d>" % i) for i, x in enumerate([*bad, odd]))
    short = record(HTTP + b"cut", 5000, WARC_Type="response", WARC_Record_ID="<short>")
    for name, data in (("plain", body + short), ("whole", member(body + short)), ("members", b"".join(member(x) for x in [*bad, odd, short]) + member(good)), ("torn", member(body)[:-20])):
        path = tmp_path / f"{name}.warc"
        path.write_bytes(data)
        got = reassemble(read_warc(spark, f"file://{path}")).collect()
        assert all((r.payload is not None) == r.complete for r in got)
        if name in ("plain", "whole"):
            assert {r.record_id for r in got if r.complete} == {"<page>", *(f"<good{i}>" for i in range(len(bad) + 1))}
            assert sum(not r.complete for r in got) == len(bad) + 1


def test_segments_of_one_number_must_agree(spark):
    from gristmill.llm.warc import RECORD, reassemble

    first = ("<a>", "response", None, 1, None, None, None, 1, None, HTTP + b"one ")
    second = ("<b>", "continuation", None, 1, None, None, "<a>", 2, len(HTTP) + 7, b"two")
    other = ("<c>", "continuation", None, 1, None, None, "<a>", 2, len(HTTP) + 7, b"TWO")
    for rows, payload in (([second, first], b"one two"), ([first, second, second, first], b"one two"), ([first, second, other], None)):
        got = reassemble(spark.createDataFrame(rows, RECORD)).collect()
        assert [r.payload for r in got] == [payload]


def test_records_are_gzip_members(spark):
    import zlib

    from gristmill.llm.warc import write_warc

    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame(pages(), SCHEMA).coalesce(1), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    members = []
    while data:
        z = zlib.decompressobj(31)
        members.append(z.decompress(data))
        data = z.unused_data
    full = [m for m in members if m]
    assert len(full) > len(pages()) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in full)


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    """Incompressible payloads: no archive is much longer than its rows allow, and all come back."""
    import random

    from gristmill.llm import warc

    monkeypatch.setattr(warc, "ROW_BYTES", 50_000)
    monkeypatch.setattr(warc, "FILE_ROWS", 3)
    rng = random.Random(4)
    rows = [(i - 20, "u", "".join(chr(rng.randrange(33, 1000)) for _ in range(rng.choice([50, 30_000]))), "d", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = new_path(spark, "warc")
    warc.write_warc(docs, path)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 4 and max(sizes) < 3 * (50_000 + 2 * warc.SEGMENT)
    got = warc.reassemble(warc.read_warc(spark, path)).collect()
    assert {(r.page_id, r.payload.decode()) for r in got} == {(r[0], r[2]) for r in rows} and all(r.complete for r in got)
