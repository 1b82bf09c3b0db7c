"""Answers of remote services for the rows of a table: bounded calls under way in a task, retries, polling, and the rows' order kept.

A client is built in the task. `ask(payload, timeout)` gives an answer, or Pending with a ticket that
`poll(ticket, timeout)` takes until it gives an answer. What fails with Retry is asked again; any other
exception is the row's error. A call that doesn't come back by the row's deadline is given up: its
thread is left to its own time-out, and its place goes to the next row.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Polls of one ticket at most.
POLLS = 180


class Retry(Exception):
    """The service may answer if it is asked again."""


@dataclass(frozen=True)
class Pending:
    ticket: str


class Client(Protocol):
    def ask(self, payload: object, timeout: float) -> object: ...

    def poll(self, ticket: str, timeout: float) -> object: ...


@dataclass(frozen=True)
class Terms:
    """at_once: calls under way in a task. timeout: of a call. deadline: of a row, with retries and polls. wait: before the first retry, doubled for each further one."""

    at_once: int = 8
    timeout: float = 60.0
    deadline: float = 240.0
    attempts: int = 3
    wait: float = 0.5
    poll_every: float = 1.0
    polls: int = POLLS


@dataclass
class Answer:
    value: object = None
    attempts: int = 0
    polls: int = 0
    error: str | None = None


class HttpClient:
    """JSON over HTTP. body: from a payload to the request's document. answer: from the reply's document to the value, or Pending with the URL to ask on.

    Time-outs, refused connections, statuses of 500 and more, and 429 are worth another attempt.
    """

    def __init__(self, url: str, body: Callable[[object], object], answer: Callable[[dict], object], headers: dict[str, str] | None = None):
        self.url, self.body, self.answer, self.headers = url, body, answer, {"Content-Type": "application/json"} | (headers or {})

    def _call(self, request: urllib.request.Request, timeout: float) -> object:
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return self.answer(json.load(r))
        except urllib.error.HTTPError as e:
            if e.code >= 500 or e.code == 429:
                raise Retry(f"status {e.code}") from e
            raise ValueError(f"status {e.code}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Retry(str(e)) from e

    def ask(self, payload, timeout):
        return self._call(urllib.request.Request(self.url, json.dumps(self.body(payload)).encode(), self.headers), timeout)

    def poll(self, ticket, timeout):
        return self._call(urllib.request.Request(ticket, headers=self.headers), timeout)


def ask(client: Client, payload: object, terms: Terms, until: float, note: Answer, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """One row's answer, by its deadline; `note` shows how far it came meanwhile."""
    def left() -> float:
        return min(terms.timeout, until - clock())

    while True:
        note.attempts += 1
        try:
            found = client.ask(payload, max(0.01, left()))
            while isinstance(found, Pending):
                if note.polls >= terms.polls:
                    raise ValueError(f"no answer after {terms.polls} polls")
                if clock() + terms.poll_every >= until:
                    raise ValueError("no answer by the deadline")
                sleep(terms.poll_every)
                note.polls += 1
                found = client.poll(found.ticket, max(0.01, left()))
            note.value = found
            return note
        except Retry as e:
            pause = terms.wait * 2 ** (note.attempts - 1)
            if note.attempts >= terms.attempts or clock() + pause >= until:
                note.error = f"{e} (attempt {note.attempts})"
                return note
            sleep(pause)
        except Exception as e:  # noqa: BLE001 - a row's error is its result
            note.error = f"{type(e).__name__}: {e}"
            return note


class _Crew:
    """Threads that ask; one that is stuck with a row that was given up is replaced."""

    def __init__(self, client: Client, terms: Terms):
        self.client, self.terms, self.rows = client, terms, queue.SimpleQueue()
        for _ in range(terms.at_once):
            self._hire()

    def _hire(self) -> None:
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while (row := self.rows.get()) is not None:
            row.started = True
            note = ask(self.client, row.payload, self.terms, row.until(), row.note)
            if row.given_up:
                return  # another has this place
            row.note = note
            row.done.set()

    def replace(self) -> None:
        self._hire()

    def close(self) -> None:
        for _ in range(self.terms.at_once):
            self.rows.put(None)


class _Asked:
    def __init__(self, payload: object, deadline: float):
        self.payload, self.deadline = payload, deadline
        self.note, self.done, self.started, self.given_up, self._until = Answer(), threading.Event(), False, False, None

    def until(self) -> float:
        """A row's time runs from its first call, not from its place in the queue."""
        if self._until is None:
            self._until = time.monotonic() + self.deadline
        return self._until

    def result(self, crew: _Crew) -> Answer:
        while not self.done.wait(0.02):
            # a little longer than the call's own limits, which end most calls
            if self.started and time.monotonic() > self.until() + 0.25:
                self.given_up = True
                crew.replace()
                return Answer(None, self.note.attempts, self.note.polls, "given up at the deadline")
        return self.note


def answers(client: Client, payloads: Iterable[object], terms: Terms = Terms()) -> Iterator[Answer]:
    """An answer for each payload, in order; a null payload is not asked for. At most `at_once` calls are under way, and twice as many rows are held."""
    crew, held = _Crew(client, terms), deque()
    try:
        for p in payloads:
            row = _Asked(p, terms.deadline)
            if p is None:
                row.note.error = "nothing to ask"
                row.done.set()
            else:
                crew.rows.put(row)
            held.append(row)
            if len(held) >= 2 * terms.at_once:
                yield held.popleft().result(crew)
        while held:
            yield held.popleft().result(crew)
    finally:
        crew.close()


def looked_up(df: DataFrame, payload: str, make: Callable[[], Client], terms: Terms = Terms(), prefix: str = "reply") -> DataFrame:
    """Adds reply (text; what isn't text becomes JSON), reply_attempts, reply_polls and reply_error to the rows, in their order within a partition.

    make builds the client in the task. Rows are asked in the partitions that df has, so its partitions times `at_once` bound the calls of a cluster.
    Columns that have the new names give way.
    """
    new = [prefix, *(f"{prefix}_{k}" for k in ("attempts", "polls", "error"))]
    names = [c for c in df.columns if c.lower() not in [n.lower() for n in new]]
    kept = df.select(*(F.col(f"`{c}`") for c in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, waiting = make(), deque()

        def payloads() -> Iterator[object]:
            for b in batches:
                if len(b):
                    waiting.append(b)
                    yield from (None if v is None or v != v else v for v in b[payload])

        found: list[Answer] = []
        for a in answers(client, payloads(), terms):
            found.append(a)
            if len(found) == len(waiting[0]):
                b = waiting.popleft()
                text = [x.value if x.value is None or isinstance(x.value, str) else json.dumps(x.value) for x in found]
                yield pd.concat([b.reset_index(drop=True), pd.DataFrame({new[0]: text, new[1]: [x.attempts for x in found], new[2]: [x.polls for x in found], new[3]: [x.error for x in found]})], axis=1)
                found = []

    return kept.mapInPandas(run, f"{fields}, {new[0]} string, {new[1]} int, {new[2]} int, {new[3]} string")
