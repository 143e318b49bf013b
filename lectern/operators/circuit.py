"""ING-09: a circuit breaker replayed over a log of calls.

CLOSED lets all calls through and counts failures in a row; at `threshold` it opens. OPEN refuses calls until `open_ms` have
passed; then it is HALF_OPEN and lets one call probe. A probe that succeeds closes the circuit, one that fails opens it anew. Each
change begins a new generation, and the result of a call that was admitted in an earlier one changes nothing.

The log is a sorted scan a key: starts and ends of calls in the order of time, ends first where they meet. Between batches
only the key's state and the calls that are under way are carried; a key's log is sequential by nature and is streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wait that a call is told which comes while another one probes.
PROBE_WAIT_MS = 1000


@dataclass
class Circuit:
    """The state of one key."""

    threshold: int
    open_ms: int
    state: str = "CLOSED"
    failures: int = 0
    open_until: int = 0
    probing: bool = False
    generation: int = 0
    under_way: dict[int, tuple[int, bool]] = field(default_factory=dict)  # call: generation, whether it probes

    def start(self, call: int, at: int) -> tuple[bool, int]:
        """Whether the call may go on, and else how long it should wait."""
        if self.state == "OPEN":
            if at < self.open_until:
                return False, self.open_until - at
            self.state, self.probing = "HALF_OPEN", False
        if self.state == "HALF_OPEN":
            if self.probing:
                return False, PROBE_WAIT_MS
            self.probing = True
        self.under_way[call] = (self.generation, self.state == "HALF_OPEN")
        return True, 0

    def end(self, call: int, at: int, outcome: str) -> None:
        """outcome: SUCCESS, FAILURE, OTHER_FAILURE (not the provider's, so it counts as a success) or RELEASED (without a result)."""
        generation, probe = self.under_way.pop(call, (-1, False))
        if generation != self.generation:
            return
        if outcome == "RELEASED":
            self.probing = self.probing and not probe
        elif outcome == "FAILURE":
            self.failures += 1
            if probe or self.failures >= self.threshold:
                self.change("OPEN", at + self.open_ms)
        elif probe:
            self.change("CLOSED", 0)
        else:
            self.failures = 0

    def change(self, state: str, until: int) -> None:
        self.state, self.open_until, self.failures, self.probing = state, until, 0, False
        self.generation += 1


def replayed(calls: DataFrame, threshold: int, open_ms: int) -> DataFrame:
    """key, call_id, admitted, state (once the call has begun), wait_ms of calls (key, call_id, at_ms, end_ms, outcome). A call that isn't admitted has no result."""
    start = calls.select("key", "call_id", F.col("at_ms").alias("ms"), F.lit(1).alias("kind"), F.lit("").alias("outcome"))
    end = calls.select("key", "call_id", F.col("end_ms").alias("ms"), F.when(F.col("end_ms") == F.col("at_ms"), 2).otherwise(0).alias("kind"), "outcome")
    # A call of no length ends right behind its start, before the next call's.
    log = start.union(end).withColumn("kind2", F.when(F.col("kind") == 0, 0).otherwise(1))
    log = log.repartition("key").sortWithinPartitions("key", "ms", "kind2", F.when(F.col("kind2") == 1, F.col("call_id")), "kind", "call_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, circuit = None, None
        for batch in batches:
            out = []
            for k, call, ms, kind, outcome in zip(batch.key, batch.call_id, batch.ms, batch.kind, batch.outcome, strict=True):
                if circuit is None or k != key:
                    key, circuit = k, Circuit(threshold, open_ms)
                if kind == 1:
                    admitted, wait = circuit.start(call, ms)
                    out.append((k, call, admitted, circuit.state, wait))
                elif call in circuit.under_way:
                    circuit.end(call, ms, outcome)
            yield pd.DataFrame(out, columns=["key", "call_id", "admitted", "state", "wait_ms"])

    kinds = dict(calls.dtypes)
    return log.select("key", "call_id", "ms", "kind", "outcome").mapInPandas(scan, f"key {kinds['key']}, call_id long, admitted boolean, state string, wait_ms long")
