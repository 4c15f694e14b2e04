"""What a run cost: time, records, findings, Spark's own figures, and energy where the machine can tell."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from itertools import pairwise
from pathlib import Path

from pyspark.sql import SparkSession

_RAPL = Path("/sys/class/powercap/intel-rapl:0/energy_uj")
#: Watts a busy core is taken to draw where nothing can be read.
WATTS_PER_CORE = 4.0


@dataclass
class Receipt:
    seconds: float = 0.0
    records: dict[str, int] = field(default_factory=dict)
    findings: int = 0
    incidents: int = 0
    jobs: int = 0
    stages: int = 0
    tasks: int = 0
    tokens_in: int = 0
    tokens_out: int = 0
    joules: float = 0.0
    energy_source: str = "none"

    @property
    def records_per_second(self) -> float:
        return sum(self.records.values()) / self.seconds if self.seconds else 0.0

    @property
    def joules_per_incident(self) -> float:
        return self.joules / self.incidents if self.incidents else 0.0

    def as_dict(self) -> dict:
        return asdict(self) | {"records_per_second": self.records_per_second, "joules_per_incident": self.joules_per_incident}


#: A meter that has begun: called, it ends and gives the joules since then, or None.
Meter = Callable[[], float | None]


def _number(path: Path) -> float | None:
    try:
        return float(path.read_text())
    except (OSError, ValueError):
        return None


def counter_meter(path: Path = _RAPL) -> Meter | None:
    """The processor's energy counter, if it can be read; one that wrapped says nothing."""
    before = _number(path)

    def end() -> float | None:
        after = _number(path)
        return (after - before) / 1e6 if after is not None and after >= before else None

    return end if before is not None else None


def rail_meter(root: Path = Path("/sys/class/hwmon"), every: float = 0.1) -> Meter | None:
    """Power of all sensor rails, sampled by a thread and integrated between samples."""
    rails = [p for p in sorted(root.glob("hwmon*/power*_input")) if _number(p) is not None]
    if not rails:
        return None
    samples: list[tuple[float, float]] = []
    over = threading.Event()

    def sample() -> None:
        samples.append((time.monotonic(), sum(_number(p) or 0.0 for p in rails) / 1e6))

    def run() -> None:
        while not over.wait(every):
            sample()

    sample()
    thread = threading.Thread(target=run, daemon=True)
    thread.start()

    def end() -> float:
        over.set()
        thread.join()
        sample()
        return sum((t - s) * (v + w) / 2 for (s, v), (t, w) in pairwise(samples))

    return end


@contextmanager
def metered(spark: SparkSession, group: str = "tamarack-run"):
    """A receipt that is filled in when the block ends; energy is that of the first meter which gives one, else estimated and so labelled."""
    out, began = Receipt(), time.monotonic()
    meters = {"measured: processor counter": counter_meter(), "measured: sensor rails": rail_meter()}
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        yield out
    finally:
        out.seconds = time.monotonic() - began
        tracker = context.statusTracker()
        jobs = tracker.getJobIdsForGroup(group)
        out.jobs = len(jobs)
        for j in jobs:
            info = tracker.getJobInfo(j)
            for s in info.stageIds if info else []:
                stage = tracker.getStageInfo(s)
                if stage:
                    out.stages += 1
                    out.tasks += stage.numTasks
        read = {name: joules for name, meter in meters.items() if meter is not None and (joules := meter()) is not None}
        read["estimated"] = out.seconds * context.defaultParallelism * WATTS_PER_CORE
        out.energy_source, out.joules = next(iter(read.items()))
