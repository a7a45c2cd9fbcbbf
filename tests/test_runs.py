"""The scorer client, the run store, intake, background runs and the command line."""

import hashlib
import http.server
import json
import os
import socket
import subprocess
import sys
import threading

import pytest

from gristmill.operators.screening import ScorerError
from gristmill.plans.runs import Runs, shown_error, throttled
from gristmill.sources.client import Client, HttpExchange, Reply, http_scorer, wait_before_next
from gristmill.sources.intake import take_in
from gristmill.sources.store import RunStore

OK = Reply(200, None, b'{"a": 1}')


def client(replies, **how):
    """A client whose exchange gives the replies in turn, and the pauses it made."""
    left, pauses = list(replies), []

    def exchange(body):
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return Client(exchange, how.pop("budget", 10), sleep=pauses.append, **how), pauses, left


def failure(c, payload=None):
    with pytest.raises(ScorerError) as e:
        c.ask(payload)
    return e.value.category


def test_waits():
    assert [wait_before_next(n, None) for n in range(4)] == [1, 2, 4, 5]
    assert wait_before_next(0, Reply(503, "0.5", b"")) == 0.5 and wait_before_next(0, Reply(503, "-3", b"")) == 0
    for reply in (Reply(400, None, b""), Reply(302, None, b""), Reply(429, "6", b""), Reply(429, "Wed, 21 Oct 2015 07:28:00 GMT", b""), Reply(503, "nan", b"")):
        assert wait_before_next(0, reply) is None


def test_attempts_and_budget():
    c, pauses, left = client([Reply(500, None, b""), OSError(), OK])
    assert c.ask({}) == {"a": 1} and c.requests == 3 and sum(pauses) == pytest.approx(1 + 2)
    c, _, left = client([Reply(503, "0", b"")] * 5)
    assert failure(c) == "provider_http_error" and len(left) == 2
    c, _, left = client([Reply(429, "0", b""), OK], budget=1)
    assert failure(c) == "request_budget_exhausted" and c.requests == 1
    assert failure(client([Reply(401, None, b"")])[0]) == "authentication" and failure(client([Reply(429, "60", b"")])[0]) == "rate_limit"
    assert failure(client([OSError()], attempts=1)[0]) == "network_error"


def test_answers_and_payloads_that_do_not_fit():
    assert failure(client([Reply(200, None, b"{")])[0]) == "invalid_json" and failure(client([Reply(200, None, b"x" * ((2 << 20) + 1))])[0]) == "response_too_large"
    c, *_ = client([OK])
    assert failure(c, "y" * (1 << 20)) == "request_too_large" and failure(c, float("nan")) == "invalid_request" and failure(c, {1j}) == "invalid_request" and c.requests == 0
    c, *_ = client([Reply(500, None, b""), OK], stopped=iter([False, False, True]).__next__)
    assert failure(c) == "cancelled"


@pytest.fixture
def server():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, self.headers["Authorization"], body, self.client_address))
            out = json.dumps({"echo": json.loads(body)}).encode()
            self.send_response(307 if self.path == "/away" else 200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_one_connection_is_kept(server):
    url, seen = server
    exchange = HttpExchange(f"{url}/score", "secret", 5)
    assert [json.loads(exchange(b'{"n": 1}').body) for _ in range(3)] == [{"echo": {"n": 1}}] * 3
    assert len({s[3] for s in seen}) == 1 and {s[:2] for s in seen} == {("/score", "Bearer secret")}
    exchange.held.sock.shutdown(socket.SHUT_RDWR)  # a stale connection is opened again, once
    assert exchange(b"{}").status == 200
    assert failure(Client(HttpExchange(f"{url}/away", "secret", 5), 5), {}) == "provider_http_error"
    with pytest.raises(ValueError):
        HttpExchange("ftp://x", "k", 5)


def asking(spark, tmp_path, replies, n, budget, tasks=3, attempts=3, path=None, judge=None):
    """Ask about n states through an exchange that replies by ``replies(state text, earlier calls for it)`` and notes every call in a file."""
    from pyspark.sql import functions as F

    from gristmill.operators.budget import ask_within

    calls = tmp_path / "calls"
    calls.mkdir(exist_ok=True)

    def exchange():
        def send(body):
            text = json.loads(body)["text"]
            seen = [f for f in os.listdir(calls) if f.startswith(f"{text}-")]
            with open(calls / f"{text}-{len(seen)}-{os.urandom(4).hex()}", "x"):
                pass
            return replies(text, len(seen))

        return send

    states = spark.createDataFrame([(f"h{i}", json.dumps({"text": f"t{i}"}), i) for i in range(n)], "state_hash string, state string, line long")
    judge = judge or (lambda df: df.withColumn("answer_error", F.when(F.col("model").isNull(), "no model")))
    done, made = ask_within(states, http_scorer("", "", lambda s: s, {"attempts": attempts, "timeout": 5}, exchange), judge, budget, tasks, path)
    got = {r.state_hash: r for r in done.collect()}
    requests = {r.state_hash: r.requests for r in made.collect()}
    return got, requests, len(os.listdir(calls))


def good(text):
    return Reply(200, None, json.dumps({"model": "m", "id": text, "answers": {}}).encode())


def test_states_get_the_budget_in_line_order(spark, tmp_path):
    got, requests, calls = asking(spark, tmp_path, lambda t, n: good(t), 30, 7)
    assert set(got) == {f"h{i}" for i in range(7)} and all(r.id == f"t{h[1:]}" and r.failure is None for h, r in got.items())
    assert calls == 7 == sum(requests.values())


def test_malformed_answers_share_the_budget(spark, tmp_path):
    bad = Reply(200, None, b"{}")
    got, requests, calls = asking(spark, tmp_path, lambda t, n: bad, 40, 8)
    assert calls == 8 == sum(requests.values()) and not got
    (tmp_path / "x").mkdir()
    got, requests, calls = asking(spark, tmp_path / "x", lambda t, n: bad if n == 0 else good(t), 3, 100)
    assert calls == 6 and requests == {"h0": 2, "h1": 2, "h2": 2} and all(r.answer_error is None for r in got.values())


def test_unspent_shares_are_handed_on(spark, tmp_path):
    """Every third state needs three attempts, one has nothing but failures: shares move to those that want them."""
    replies = lambda t, n: good(t) if int(t[1:]) % 3 or (n >= 2 and t != "t3") else Reply(503, "0", b"")
    got, requests, calls = asking(spark, tmp_path, replies, 12, 20)
    assert calls == sum(requests.values()) == 8 + 4 * 3 and len(got) == 12
    assert got["h3"].failure == "provider_http_error" and requests["h3"] == 3 and sum(r.failure is None for r in got.values()) == 11
    (tmp_path / "y").mkdir()
    got, requests, calls = asking(spark, tmp_path / "y", replies, 12, 17)
    assert calls == 17 and len(got) < 12


def test_a_failed_task_spends_nothing_twice(tmp_path):
    """Tasks die after some of their requests; their other attempts ask nothing, later rounds do."""
    script = tmp_path / "run.py"
    script.write_text("""
import json, os, sys
from pathlib import Path
sys.path[:0] = [sys.argv[1]]
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[3,4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
from tests.test_runs import asking, good
from gristmill.sources.client import Reply
folder = Path(sys.argv[2])

def replies(text, n):
    if text in ("t5", "t11") and not (folder / f"died-{text}").exists():
        (folder / f"died-{text}").touch()
        os._exit(1)
    return good(text)

got, requests, calls = asking(spark, folder, replies, 12, int(sys.argv[3]))
print("RESULT", json.dumps([len(got), sum(requests.values()), calls]))
""")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for budget in (14, 60):
        folder = tmp_path / str(budget)
        folder.mkdir()
        ran = subprocess.run([sys.executable, str(script), root, str(folder), str(budget)], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=200)
        settled, counted, calls = json.loads(ran.stdout.split("RESULT")[1])
        assert counted <= calls <= budget and settled <= 12
        assert budget < 60 or settled == 12


def test_a_run_begun_again_takes_over_its_ledger(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    got, requests, calls = asking(spark, tmp_path, lambda t, n: good(t), 10, 6, path=path)
    assert len(got) == 6 and calls == 6
    got, requests, calls = asking(spark, tmp_path, lambda t, n: good(t), 10, 8, path=path)  # two more are granted
    assert len(got) == 8 and calls == 8 and sum(requests.values()) == 8
    spark.createDataFrame([("h8", 8, 1, 0, 1, "{}")], "state_hash string, line long, asking int, tried int, allowed int, state string").write.parquet(f"{path}/2/granted")
    got, requests, calls = asking(spark, tmp_path, lambda t, n: good(t), 10, 10, path=path)  # a round that stopped counts as spent
    assert len(got) == 9 and calls == 9


def test_store(spark, tmp_path):
    s = RunStore(spark, f"file://{tmp_path}/store")
    assert s.get("run", "a") is None and s.list("run") == [] and s.logs("a") == []
    for name, status in (("a", "completed"), ("b", "running"), ("c", "queued")):
        s.put("run", {"id": name, "status": status})
    s.put("dataset", {"id": "a"})
    s.update("a", note="again")
    assert [r["id"] for r in s.list("run")] == ["a", "c", "b"] and [r["id"] for r in s.list("run", 1, 1)] == ["c"]
    assert s.get("run", "a")["note"] == "again" and s.get("dataset", "a") == {"id": "a"}
    s.log("b", "one")
    s.log("b", "two")
    assert [x["message"] for x in s.logs("b")] == ["one", "two"]
    assert s.recover() == 2 and {r["status"] for r in s.list("run")} == {"completed", "failed"} and s.recover() == 0
    for bad in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            s.list("run", *bad)
    with pytest.raises(ValueError):
        s.update("nobody", x=1)


def test_intake(spark, tmp_path):
    body = b'{"text": "a record"}\n{bad\n'
    path = tmp_path / "data.JSONL"
    path.write_bytes(body)
    got = take_in(spark, f"file://{path}")
    assert (got["name"], got["suffix"], got["size"], got["sha256"], got["rows"], got["invalid_rows"]) == ("data.JSONL", ".jsonl", len(body), hashlib.sha256(body).hexdigest(), 2, 1)
    for bad, limit in ((f"file://{path}", 10), (f"file://{path}", 1 << 40), ("file:///x.txt", 10)):
        with pytest.raises(ValueError):
            take_in(spark, bad, limit)


def write(tmp_path, n=30, name="in.jsonl"):
    path = tmp_path / name
    path.write_text("".join(json.dumps({"text": f"note {i} about the matter of {i * i}", "group_id": i // 2}) + "\n" for i in range(n)))
    return f"file://{path}"


def test_runs_and_retry(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/root")
    few, good = write(tmp_path, 4, "few.jsonl"), write(tmp_path)
    a, b = runs.submit(few)["id"], runs.submit(good)["id"]
    runs.wait()
    assert runs.store.get("run", a)["status"] == "failed" and "independent groups" in runs.store.get("run", a)["error"]
    done = runs.store.get("run", b)
    assert done["status"] == "completed" and done["data_report"]["counts"]["keep"] == 30 and done["model_report"]["steps"] > 0 and "data_report.json" in done["artifacts"]
    assert [x["message"] for x in runs.store.logs(b)] == [f"stage {s}" for s in ("screening", "data_evaluation", "training", "model_evaluation", "completed")]
    with pytest.raises(ValueError, match="retried"):
        runs.submit(good, run_id=b)
    runs.submit(good, run_id=a)
    runs.wait()
    again = runs.store.get("run", a)
    assert again["status"] == "completed" and again["attempt"] == 2


def test_cancel(spark, tmp_path):
    from gristmill.plans.pipeline import Pipeline

    begun, go = threading.Event(), threading.Event()

    class Slow(Pipeline):
        def screen(self, raw, source=None):
            begun.set()
            go.wait(30)
            return super().screen(raw, source)

    runs = Runs(spark, f"file://{tmp_path}/root", Slow)
    name = runs.submit(write(tmp_path))["id"]
    assert begun.wait(30)
    runs.cancel(name)
    go.set()
    runs.wait()
    run = runs.store.get("run", name)
    assert run["status"] == "cancelled" and not runs.stops


def test_what_users_see():
    assert shown_error(ValueError("x" * 900)) == "x" * 500 and "secret" not in shown_error(KeyError("secret"))
    sent, clock = [], iter([0.0, 0.1, 0.2, 0.6, 0.7]).__next__
    send = throttled(sent.append, clock)
    for values in ({"n": 1}, {"n": 2}, {"stage": "s"}, {"n": 3}, {"n": 4}):
        send(values)
    assert sent == [{"n": 1}, {"stage": "s"}, {"n": 3}]


def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    call = lambda *args: subprocess.run([sys.executable, "-m", "gristmill", "run", *args], cwd=root, capture_output=True, text=True)
    ran = call("--input", write(tmp_path), "--output", f"file://{tmp_path}/out", "--max-steps", "5")
    assert ran.returncode == 0 and json.loads(ran.stdout)["steps"] == 5 and "stage=training" in ran.stderr and "test loss" in ran.stderr
    assert call("--input", "x.txt", "--output", f"file://{tmp_path}/o2").returncode == 2
    assert call("--input", "x.jsonl", "--output", "y", "--confidence", "7").returncode == 2
