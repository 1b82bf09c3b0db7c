"""Progress with a clock, over jobs and streams; cancelling; and a service that is slow, fails, polls or never ends."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from gazeloom.operators import tables
from gazeloom.sources import remote
from gazeloom.streaming import progress


def test_reports_are_throttled():
    now, told = [0.0], []
    t = progress.Throttle(told.append, 0.4, lambda: now[0])
    for at, share in ((0, 0.0), (0.1, 0.1), (0.39, 0.2), (0.4, 0.21), (0.9, 0.215), (1.0, 0.22), (1.1, 1.0), (9.0, 1.0), (9.5, 0.3)):
        now[0] = at
        t(share)
    assert told == [0.0, 0.21, 0.22, 1.0]


def test_passes_share_a_run():
    told = []
    p = progress.of_passes(told.append)
    p["detect"](0.5), p["detect"](2), p["render"](0.5), p["render"](1)
    assert told == pytest.approx([0.225, 0.45, 0.725, 1.0])


def slow(spark, n, seconds):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(n, numPartitions=n).mapInPandas(wait, "id long")


def test_progress_of_jobs(spark):
    told = []
    n = progress.watched(spark, lambda: slow(spark, 12, 0.4).groupBy((F.col("id") % 2).alias("k")).count().count(), told.append, poll=0.05, pause=0.1)
    assert n == 2 and told[-1] == 1.0 and told == sorted(told) and any(0 < x < 1 for x in told)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_errors_pass_and_say_nothing_of_the_end(spark):
    told = []
    with pytest.raises(ZeroDivisionError):
        progress.watched(spark, lambda: 1 / 0, told.append)
    assert 1.0 not in told


def test_unwanted_work_is_ended(spark):
    began, told = time.time(), []
    with pytest.raises(progress.JobCancelled):
        progress.watched(spark, lambda: slow(spark, 8, 60).count(), told.append, wanted=lambda: time.time() < began + 3, poll=0.1)
    assert time.time() - began < 40 and spark.range(10).count() == 10


def test_a_cancelled_stage_lets_the_next_run(spark):
    ran = []

    def later():
        while not spark.sparkContext.statusTracker().getActiveStageIds():
            time.sleep(0.1)
        time.sleep(0.5)
        tables.cancel(spark, "long")

    threading.Thread(target=later, daemon=True).start()
    began = time.time()
    outcome = tables.run_stages(spark, [("long", lambda: slow(spark, 8, 60).count()), ("next", lambda: ran.append(spark.range(100).count()))], attempts=1)
    assert outcome["long"].startswith("failed after 1") and outcome["next"] == "ok" and ran == [100] and time.time() - began < 50


def test_progress_of_streams(spark, tmp_path):
    for k in range(4):
        spark.range(25).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = progress.StreamProgress("watched rows", 100, told.append, pause=0)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        for name in ("others", "watched rows"):
            q = stream.writeStream.format("noop").queryName(name).option("checkpointLocation", str(tmp_path / name[:3])).trigger(availableNow=True).start()
            q.awaitTermination(60)
            assert (name == "others") == (told == []) or told
        ends = time.time() + 20
        while 1.0 not in told and time.time() < ends:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[-1] == 1.0 and told == sorted(told) and len(told) >= 3


class Service(http.server.BaseHTTPRequestHandler):
    """What it does is in the payload: slow, fails twice, always fails, refuses, polls, polls for ever, never answers."""

    seen: dict = {}
    at_once = most = 0
    lock = threading.Lock()

    def log_message(self, *a):
        pass

    def reply(self, status, document):
        data = json.dumps(document).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_POST(self):
        say = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["say"]
        with self.lock:
            # a call that the asker has given up goes on here
            Service.at_once += not say.startswith("never")
            Service.most = max(Service.most, Service.at_once)
            n = self.seen[say] = self.seen.get(say, 0) + 1
        try:
            kind = say.split("-")[0]
            if kind == "slow":
                time.sleep(0.4)
            if kind == "never":
                time.sleep(20)
            if kind == "fails" or kind == "twice" and n < 3:
                self.reply(503, {})
            elif kind == "refused":
                self.reply(403, {})
            elif kind in ("polls", "forever"):
                self.reply(200, {"status": "starting", "get": f"http://127.0.0.1:{self.server.server_port}/{say}"})
            else:
                self.reply(200, {"output": say.upper()})
        finally:
            with self.lock:
                Service.at_once -= not say.startswith("never")

    def do_GET(self):
        say = self.path[1:]
        with self.lock:
            n = self.seen[self.path] = self.seen.get(self.path, 0) + 1
        done = say.startswith("polls") and n >= 3
        self.reply(200, {"output": say.upper()} if done else {"status": "processing", "get": f"http://127.0.0.1:{self.server.server_port}{self.path}"})


@pytest.fixture
def service():
    Service.seen, Service.most = {}, 0
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def client(url):
    return remote.HttpClient(url, lambda p: {"say": p}, lambda d: d["output"] if "output" in d else remote.Pending(d["get"]))


TERMS = remote.Terms(at_once=4, timeout=1.0, deadline=3.0, wait=0.05, poll_every=0.05, polls=8)
SAID = ["slow-1", "a", None, "twice-1", "fails-1", "refused-1", "polls-1", "forever-1", "never-1", "b", "slow-2", "c", *(f"d{k}" for k in range(30))]


def test_answers_keep_their_order(service):
    began = time.time()
    got = list(remote.answers(client(service), SAID, TERMS))
    assert time.time() - began < 12 and Service.most <= 4 and len(got) == len(SAID)
    for say, a in zip(SAID, got):
        kind = (say or "null").split("-")[0]
        if kind in ("null", "fails", "refused", "forever", "never"):
            assert a.value is None and a.error, say
        else:
            assert (a.value, a.error) == (say.upper(), None)
    by = {s: a for s, a in zip(SAID, got)}
    assert by["twice-1"].attempts == 3 and by["fails-1"].attempts == 3 and "503" in by["fails-1"].error
    assert by["refused-1"].attempts == 1 and by["polls-1"].polls == 3 and by["forever-1"].polls == 8 and by[None].attempts == 0


class Stuck:
    """A client that minds no time-out."""

    def ask(self, payload, timeout):
        if payload.startswith("stuck"):
            time.sleep(30)
        return payload

    def poll(self, ticket, timeout):
        raise AssertionError


def test_stuck_calls_are_given_up():
    said = [f"{'stuck' if k % 3 == 0 else 'ok'}-{k}" for k in range(12)]
    began = time.time()
    got = list(remote.answers(Stuck(), said, remote.Terms(at_once=2, deadline=0.4)))
    assert time.time() - began < 8
    assert [a.value for a in got] == [None if s.startswith("stuck") else s for s in said]
    assert all("given up" in a.error for s, a in zip(said, got) if s.startswith("stuck"))


def test_rows_get_their_replies(spark, service):
    rows = [(k, s, "x") for k, s in enumerate(SAID)]
    df = spark.createDataFrame(rows, "id int, said string, reply_error string").coalesce(1)
    # the service's address alone goes to the tasks, which can't import this module
    make = lambda url=service: remote.HttpClient(url, lambda p: {"say": p}, lambda d: d["output"] if "output" in d else remote.Pending(d["get"]))
    got = remote.looked_up(df, "said", make, TERMS).collect()
    assert [r.id for r in got] == list(range(len(SAID)))
    assert [r.reply for r in got][:4] == ["SLOW-1", "A", None, "TWICE-1"] and got[5].reply_error == "ValueError: status 403" and got[6].reply_polls == 3
    assert remote.looked_up(df.where("false"), "said", make).count() == 0
