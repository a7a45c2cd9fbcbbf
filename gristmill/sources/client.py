"""A scorer behind HTTP: one exchange policy, applied on the executors in Arrow batches.

A task keeps one connection. Every attempt is a request of the run's budget, which ``operators.budget``
grants state by state.
"""

from __future__ import annotations

import http.client
import json
import math
import os
import time
from base64 import b64encode
from collections.abc import Callable
from typing import Any, NamedTuple
from urllib.parse import unquote, urlsplit
from urllib.request import getproxies, proxy_bypass

from gristmill.operators.budget import Ask
from gristmill.operators.screening import ScorerError

#: Limits and status codes of the exchange. Fixed values.
MAX_REQUEST, MAX_RESPONSE, LONGEST_WAIT, POLL = 1 << 20, 2 << 20, 5.0, 0.1
AGAIN = {408, 429, 500, 502, 503, 504, 529}
REFUSED = {401: "authentication", 403: "authentication", 429: "rate_limit"}
TROUBLE = (http.client.HTTPException, OSError)


class Reply(NamedTuple):
    status: int
    retry_after: str | None
    body: bytes


Exchange = Callable[[bytes], Reply]


def wait_before_next(attempt: int, reply: Reply | None) -> float | None:
    """Seconds to wait after a failed attempt (0 first), or None where asking again is no use.

    No reply is trouble on the network. Advice to wait longer than LONGEST_WAIT, or that is no number
    of seconds, is left to a later run.
    """
    usual = min(2.0**attempt, LONGEST_WAIT)
    if reply is None:
        return usual
    if reply.status not in AGAIN:
        return None
    if not reply.retry_after:
        return usual
    try:
        advised = float(reply.retry_after)
    except ValueError:
        return None
    return max(0.0, advised) if math.isfinite(advised) and advised <= LONGEST_WAIT else None


class Client:
    """Asks until an answer comes, attempts or budget are spent, or the failure is final."""

    def __init__(self, exchange: Exchange, budget: int, attempts: int = 3, stopped: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep):
        self.exchange, self.left, self.attempts, self.stopped, self.sleep = exchange, budget, attempts, stopped, sleep
        self.requests = 0

    def _pause(self, seconds: float) -> None:
        while seconds > 0:
            if self.stopped():
                raise ScorerError("cancelled")
            self.sleep(min(POLL, seconds))
            seconds -= POLL

    def _once(self, body: bytes) -> Reply | None:
        if self.stopped():
            raise ScorerError("cancelled")
        if self.left <= 0:
            raise ScorerError("request_budget_exhausted")
        self.left, self.requests = self.left - 1, self.requests + 1
        try:
            return self.exchange(body)
        except TROUBLE:
            return None

    def ask(self, payload: Any, tried: int = 0) -> Any:
        """The answer; ``tried`` attempts were made before."""
        try:
            body = json.dumps(payload, ensure_ascii=False, allow_nan=False).encode()
        except (TypeError, ValueError):
            raise ScorerError("invalid_request") from None
        if len(body) > MAX_REQUEST:
            raise ScorerError("request_too_large")
        for attempt in range(tried, self.attempts):
            reply = self._once(body)
            if reply and 200 <= reply.status < 300:
                return _answer(reply.body)
            wait = wait_before_next(attempt, reply)
            if wait is None or attempt == self.attempts - 1:
                break
            self._pause(wait)
        raise ScorerError("network_error" if reply is None else REFUSED.get(reply.status, "provider_http_error"))


def _answer(body: bytes) -> Any:
    if len(body) > MAX_RESPONSE:
        raise ScorerError("response_too_large")
    try:
        return json.loads(body)
    except (ValueError, RecursionError):
        raise ScorerError("invalid_json") from None


class HttpExchange:
    """POST to one address over one kept connection; redirects are not followed, so the key goes nowhere else."""

    def __init__(self, url: str, key: str, timeout: float):
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError("the scorer's address must be an http or https URL")
        self.secure, self.host, self.path = parts.scheme == "https", parts.hostname, parts.path or "/"
        self.port, self.key, self.timeout, self.held = parts.port or (443 if self.secure else 80), key, timeout, None

    def _open(self) -> http.client.HTTPConnection:
        """A connection to the host or, for https behind a proxy of the environment, a tunnel to it."""
        if not self.secure:
            return http.client.HTTPConnection(self.host, self.port, timeout=self.timeout)
        named = None if proxy_bypass(self.host) else getproxies().get("https")
        if named is None:
            return http.client.HTTPSConnection(self.host, self.port, timeout=self.timeout)
        proxy = urlsplit(named if "//" in named else f"//{named}")
        tunnel = http.client.HTTPSConnection(proxy.hostname, proxy.port or 3128, timeout=self.timeout)
        user = ":".join(unquote(x or "") for x in (proxy.username, proxy.password)) if proxy.username else None
        tunnel.set_tunnel(self.host, self.port, headers=user and {"Proxy-Authorization": "Basic " + b64encode(user.encode()).decode()})
        return tunnel

    def close(self) -> None:
        if self.held:
            self.held.close()
        self.held = None

    def __call__(self, body: bytes) -> Reply:
        used = self.held is not None
        try:
            return self._send(body)
        except (http.client.RemoteDisconnected, http.client.CannotSendRequest, ConnectionError):
            self.close()
            if not used:
                raise
            return self._send(body)  # the kept connection had gone stale
        except TROUBLE:
            self.close()
            raise

    def _send(self, body: bytes) -> Reply:
        self.held = self.held or self._open()
        self.held.request("POST", self.path, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        answer = self.held.getresponse()
        out = Reply(answer.status, answer.getheader("Retry-After"), answer.read(MAX_RESPONSE + 1))
        if answer.will_close or len(out.body) > MAX_RESPONSE:
            self.close()
        return out


class HttpScorer:
    """Posts ``payload(state)`` for each state. ``exchange`` makes another way to reach the scorer, for tests."""

    def __init__(self, url: str, key_variable: str, payload: Callable[[dict], Any], attempts: int, timeout: float, exchange: Callable[[], Exchange] | None = None):
        self.url, self.key_variable, self.payload, self.attempts, self.timeout, self.exchange = url, key_variable, payload, attempts, timeout, exchange

    def open(self) -> Ask:
        reach = self.exchange() if self.exchange else HttpExchange(self.url, os.environ.get(self.key_variable, ""), self.timeout)
        client = Client(reach, 0, self.attempts)

        def ask(state: str, allowed: int, tried: int) -> tuple[Any, str | None, int]:
            client.left, client.requests = allowed, 0
            try:
                return client.ask(self.payload(json.loads(state)), tried), None, client.requests
            except ScorerError as e:
                return None, None if e.category == "request_budget_exhausted" else e.category, client.requests

        return ask


def http_scorer(url: str, key_variable: str, payload: Callable[[dict], Any], config: dict[str, Any], exchange: Callable[[], Exchange] | None = None) -> HttpScorer:
    """A scorer with the ``attempts`` and ``timeout`` of screening settings. The key is read on the executors from their environment."""
    return HttpScorer(url, key_variable, payload, config["attempts"], config["timeout"], exchange)
