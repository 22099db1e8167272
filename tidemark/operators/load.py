"""Measurement harnesses: an open-loop load generator and a freshness probe.

Requests are sent on a fixed schedule, whether or not earlier ones have returned, and latency counts
from the intended send time, so a stalled server cannot hide its queue.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass


@dataclass(frozen=True)
class LoadResult:
    latencies_ms: list[float]
    errors: int


def schedule(qps: float, seconds: float) -> list[float]:
    """Intended send times, from 0."""
    if qps <= 0 or seconds <= 0:
        raise ValueError("rate and duration must be positive")
    return [i / qps for i in range(int(qps * seconds))]


def run_load_test(send: Callable[[int], None], qps: float, seconds: float, workers: int = 16, clock: Callable[[], float] = time.perf_counter, sleep: Callable[[float], None] = time.sleep) -> LoadResult:
    """Calls send(i) for each slot of the schedule. Failures are counted, not raised, and give no latency."""
    times = schedule(qps, seconds)
    began = clock()

    def one(i: int) -> float | None:
        try:
            send(i)
        except Exception:
            return None
        return (clock() - began - times[i]) * 1000

    with ThreadPoolExecutor(workers) as pool:
        futures = []
        for i, at in enumerate(times):
            wait = at - (clock() - began)
            if wait > 0:
                sleep(wait)
            futures.append(pool.submit(one, i))
        got = [f.result() for f in futures]
    return LoadResult([x for x in got if x is not None], sum(x is None for x in got))


def freshness_probe(write: Callable[[int], None], visible: Callable[[int], bool], probes: int, poll_s: float = 0.03, timeout_s: float = 30.0, clock: Callable[[], float] = time.perf_counter, sleep: Callable[[float], None] = time.sleep) -> LoadResult:
    """Time from writing an event until a read shows it, for each probe; never seen counts as an error."""
    out, failed = [], 0
    for i in range(probes):
        began = clock()
        write(i)
        while not (seen := visible(i)) and clock() - began < timeout_s:
            sleep(poll_s)
        if seen:
            out.append((clock() - began) * 1000)
        else:
            failed += 1
    return LoadResult(out, failed)
