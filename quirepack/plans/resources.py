"""Memory and workers of a run on one machine; on a cluster Spark's own settings hold."""

from __future__ import annotations

import os
import resource

FALLBACK = 512 << 20
PER_WORKER = 64 << 20


def _number(path: str) -> int | None:
    """The number in a file; None for "max" or where it cannot be read."""
    try:
        with open(path, encoding="ascii") as f:
            return int(f.read())
    except (OSError, ValueError):
        return None


def group_memory(cgroups: str = "/proc/self/cgroup", root: str = "/sys/fs/cgroup") -> int | None:
    """What this process's control group (version 2) and all groups above it still allow."""
    try:
        with open(cgroups, encoding="utf-8") as f:
            own = next((line.rstrip("\n")[3:] for line in f if line.startswith("0::")), None)
    except OSError:
        return None
    parts, left = [p for p in (own or "").split("/") if p], []
    for n in range(len(parts) + 1):
        folder = os.path.join(root, *parts[:n])
        most, now = _number(f"{folder}/memory.max"), _number(f"{folder}/memory.current")
        if most is not None and now is not None:
            left.append(max(0, most - now))
    return min(left, default=None)


def free_memory() -> int | None:
    try:
        with open("/proc/meminfo", encoding="ascii") as f:
            return next((int(line.split()[1]) << 10 for line in f if line.startswith("MemAvailable:")), None)
    except OSError:
        return None


def memory_budget() -> int:
    """Half of the least of free memory, what control groups allow, and the address space limit."""
    space = resource.getrlimit(resource.RLIMIT_AS)[0]
    known = [x for x in (free_memory(), group_memory(), None if space == resource.RLIM_INFINITY else space) if x is not None]
    return min(known) // 2 if known else FALLBACK


def workers(cores: int, tasks: int, budget: int) -> int:
    """No more than cores, tasks, or what the budget has room for; one at least."""
    return max(1, min(cores, tasks, budget // PER_WORKER))


def admitted(costs: list[int], budget: int) -> int:
    """How many of the waiting tasks, first come first served, may run together: as many from the front as fit, and the first one anyway."""
    used, n = 0, 0
    while n < len(costs) and (n == 0 or used + costs[n] <= budget):
        used, n = used + costs[n], n + 1
    return n
