"""Runs of the commands in processes of their own, with their memory and CPU over time.

A run's process and all that it starts (the JVM and Python workers) are sampled
every ``PERIOD_MS`` from ``/proc``; elsewhere there are no samples and the
statistics are 0.  What the runs give goes to ``operators.report``.
"""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
import threading
import time
from collections import defaultdict
from pathlib import Path

from .operators.index import STRATEGIES
from .operators.report import scraped_count

PERIOD_MS = 100


def _processes(top: int) -> list[int]:
    """A process and its descendants."""
    children = defaultdict(list)
    for stat in Path("/proc").glob("[0-9]*/stat"):
        try:
            children[int(stat.read_text().rpartition(")")[2].split()[1])].append(int(stat.parent.name))
        except (OSError, IndexError):
            continue  # it ended meanwhile
    found, left = [], [top]
    while left:
        found.append(left.pop())
        left += children[found[-1]]
    return found


def usage(top: int) -> tuple[float, float]:
    """Megabytes resident and CPU seconds so far, of a process and its descendants."""
    memory, ticks = 0, 0
    for pid in _processes(top):
        try:
            memory += int(Path(f"/proc/{pid}/statm").read_text().split()[1])
            ticks += sum(map(int, Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[11:13]))
        except (OSError, IndexError):
            continue
    return memory * os.sysconf("SC_PAGE_SIZE") / 1048576, ticks / os.sysconf("SC_CLK_TCK")


def monitored(command: list[str], env: dict[str, str] | None = None) -> tuple[int, str, list[tuple[int, float, float]]]:
    """Milliseconds, standard output, and samples (timestamp_ms, memory_mb, cpu_percent since the sample before)."""
    samples: list[tuple[int, float, float]] = []
    began = time.perf_counter()
    child = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, env=env)
    over = threading.Event()

    def sample() -> None:
        turn, then, before = 0, began, 0.0
        while not over.is_set():
            memory, cpu = usage(child.pid)
            now = time.perf_counter()
            if memory:
                samples.append((turn * PERIOD_MS, memory, max(0.0, cpu - before) / max(now - then, 1e-3) * 100))
            turn, then, before = turn + 1, now, cpu
            over.wait(max(0.0, began + turn * PERIOD_MS / 1000 - time.perf_counter()))

    watch = threading.Thread(target=sample, daemon=True)
    watch.start()
    out, err = child.communicate()
    took = int((time.perf_counter() - began) * 1000)
    over.set()
    watch.join()
    if child.returncode:
        raise RuntimeError(f"{' '.join(command)}: {err[-2000:]}")
    return took, out, samples


def _size_mb(folder: str) -> float:
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet")) / 1048576


def matrix(kind: str, files: list[str], flags: list[str], threads: list[int], repeats: int) -> tuple[list[tuple], list[tuple], dict[tuple, list[tuple[int]]]]:
    """Every strategy with every number of threads, ``repeats`` times: rows of ``report.RESULTS`` and ``report.SAMPLES``, and the counts by request.

    ``index`` builds indexes by each strategy; ``view`` counts matching records
    through a stored index (``indexed``) and without (``scan``).
    """
    results, samples, counts = [], [], defaultdict(list)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])}
    for file in files:
        with tempfile.TemporaryDirectory(prefix="bench-") as folder:
            runs: list[tuple[str, list[str], tuple | None]] = []
            if kind == "index":
                runs = [(s, ["index", file, "--strategy", s], None) for s in STRATEGIES]
            else:
                base = [sys.executable, "-m", "bitquarry.cli", "--index-dir", folder]
                monitored([*base, "index", file], env)
                for flag in flags:
                    runs += [(f"indexed {flag}", ["query", file, "-f", flag], (file, flag)), (f"scan {flag}", ["fast-count", file, "-f", flag], (file, flag))]
            for (strategy, command, request), n, _ in ((r, n, k) for r in runs for n in threads for k in range(repeats)):
                took, out, seen = monitored([sys.executable, "-m", "bitquarry.cli", "-t", str(n), "--index-dir", folder, *command], env)
                memory, cpu = [x[1] for x in seen] or [0.0], [x[2] for x in seen] or [0.0]
                results.append((n, strategy, took, max(memory), sum(memory) / len(memory), max(cpu), sum(cpu) / len(cpu), _size_mb(folder), len(seen)))
                samples += [(n, strategy, *x) for x in seen]
                if request:
                    counts[request].append((scraped_count(out),))
    return results, samples, dict(counts)
