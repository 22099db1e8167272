import threading

import pytest

from tidemark.operators.load import freshness_probe, run_load_test, schedule


class Clock:
    def __init__(self):
        self.now, self.lock = 0.0, threading.Lock()

    def __call__(self):
        with self.lock:
            return self.now

    def sleep(self, s):
        with self.lock:
            self.now += s


def test_schedule():
    assert schedule(4, 1) == [0.0, 0.25, 0.5, 0.75]
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            schedule(*bad)


def test_latency_counts_from_the_intended_time():
    """One worker and a send of 1 s at 2 a second: the queue shows in the latencies."""
    got = run_load_test(lambda i: __import__("time").sleep(0.05), qps=100, seconds=0.1, workers=1)
    assert len(got.latencies_ms) == 10 and got.latencies_ms[-1] > 5 * 30 and got.errors == 0


def test_failures_are_counted():
    def send(i):
        if i % 2:
            raise RuntimeError

    got = run_load_test(send, qps=1000, seconds=0.01)
    assert got.errors == 5 and len(got.latencies_ms) == 5


def test_freshness():
    clock, seen = Clock(), {}
    got = freshness_probe(lambda i: seen.update({i: clock()}), lambda i: i != 2 and clock() - seen[i] >= 0.09, 3, 0.03, 1.0, clock, clock.sleep)
    assert got.errors == 1 and got.latencies_ms == pytest.approx([90, 90])
