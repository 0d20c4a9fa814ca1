"""Process lineage: marker roots, the closure of their descendants, attribution.

``scope`` names the columns inside which process ids are unique, for example ``["host"]``;
an empty scope says that ids are unique throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import packs
from ..session import cut_lineage, release


def marker_roots(processes: DataFrame, scope: Sequence[str], marker: str = packs.MARKER_FILE) -> DataFrame:
    """Parents of the processes that execute the marker file, since when."""
    hits = processes.filter((F.col("exec_file") == marker) & F.col("ppid").isNotNull())
    return hits.groupBy(*scope, F.col("ppid").alias("pid")).agg(F.min("fork_ts").alias("since"))


def incarnations(processes: DataFrame, scope: Sequence[str], strict_time: bool = False) -> DataFrame:
    """(scope, pid, k, ppid, up, fork_ts): each fork is the k-th life of its process id.

    ``up`` is the life of the parent's id that forked it: the last one begun by then
    (as-of join), or the first one if times are not looked at.  Null if the table has none.
    """
    scope = list(scope)
    lives = processes.filter(F.col("ppid").isNotNull()).select(*scope, "pid", "ppid", "fork_ts").distinct()
    order = Window.partitionBy(*scope, "pid").orderBy("fork_ts", "ppid")
    lives = cut_lineage(lives.withColumn("k", F.row_number().over(order)).withColumn("until", F.lead("fork_ts").over(order)))
    parents = lives.select(*scope, F.col("pid").alias("ppid"), F.col("k").alias("up"), F.col("fork_ts").alias("_from"), F.col("until").alias("_until"))
    if not strict_time:
        found = lives.join(parents.filter("up = 1"), [*scope, "ppid"], "left")
    else:
        # the spans of an id's lives do not overlap, so a fork meets one of them at most
        spans = parents.withColumnsRenamed({c: f"_{c}" for c in (*scope, "ppid")})
        meets = (F.col("fork_ts") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("fork_ts") < F.col("_until")))
        for c in (*scope, "ppid"):
            meets &= F.col(c) == F.col(f"_{c}")
        found = lives.join(spans, meets, "left")
    return found.select(*scope, "pid", "k", "ppid", "up", "fork_ts")


def descendant_pids(processes: DataFrame, roots: DataFrame, scope: Sequence[str], strict_time: bool = False) -> DataFrame:
    """Roots and everything forked below them: (scope, pid, since).

    With ``strict_time`` a child counts only if its parent's id was tracked when it
    forked.  A tracked id stays tracked when it is used again, as in the kernel's table.

    The lives of the ids form a forest, closed by pointer doubling: a number of joins
    logarithmic in its depth.  What a later life inherits from an earlier one of the same id is
    no edge of the forest; one step over ids adds it, and the forest is closed again as long as
    such a step finds something, once for ids that are not used again.
    """
    scope = list(scope)
    lives = cut_lineage(incarnations(processes, scope, strict_time))
    since = roots.select(*scope, "pid", "since")
    tracked = cut_lineage(_step(lives, since, scope, strict_time))
    while True:
        closed = _closed(lives, tracked, scope)
        known = closed.select(*scope, "pid", F.col("fork_ts").alias("since")).unionByName(since).groupBy(*scope, "pid").agg(F.min("since").alias("since"))
        open_lives = lives.join(closed.select(*scope, "pid", "k"), [*scope, "pid", "k"], "left_anti")
        more = cut_lineage(_step(open_lives, known, scope, strict_time))
        release(tracked)
        if more.isEmpty():
            release(more)
            return known
        tracked = cut_lineage(closed.unionByName(more))
        release(closed, more)


def _step(lives: DataFrame, since: DataFrame, scope: list[str], strict_time: bool) -> DataFrame:
    """Lives whose parent's id is tracked."""
    step = lives.join(since.select(*scope, F.col("pid").alias("ppid"), F.col("since").alias("_since")), [*scope, "ppid"])
    step = step.filter(F.col("fork_ts") >= F.col("_since")) if strict_time else step
    return step.select(*scope, "pid", "k", "fork_ts").distinct()


def _closed(lives: DataFrame, tracked: DataFrame, scope: list[str]) -> DataFrame:
    """``tracked`` lives and all below them in the forest, by pointer doubling."""
    flagged = lives.join(tracked.select(*scope, "pid", "k", F.lit(True).alias("tracked")), [*scope, "pid", "k"], "left")
    # state: tracked lives, and open ones with a pointer to an ancestor.
    # Pointers that leave the table resolve to nothing and are dropped.
    state = cut_lineage(flagged.select(
        *scope, "pid", "k", "fork_ts", F.col("ppid").alias("up_pid"), F.col("up").alias("up_k"), F.coalesce("tracked", F.lit(False)).alias("tracked")))
    found = state.filter("tracked").count()
    while True:
        target = state.select(*scope, F.col("pid").alias("up_pid"), F.col("k").alias("up_k"), F.col("up_pid").alias("_pid"), F.col("up_k").alias("_k"),
                              F.col("tracked").alias("_tracked"))
        moved = state.filter("not tracked and up_k is not null").join(target, [*scope, "up_pid", "up_k"]).select(
            *scope, "pid", "k", "fork_ts", F.col("_pid").alias("up_pid"), F.col("_k").alias("up_k"), F.col("_tracked").alias("tracked"))
        moved = moved.filter("tracked or up_k is not null")
        new = cut_lineage(state.filter("tracked").unionByName(moved))
        release(state)
        state = new
        now = state.filter("tracked").count()
        # a life whose nearest root is farther away always has an ancestor
        # at the distance just covered, so no gain means the closure is complete
        if now == found:
            break
        found = now
    below = cut_lineage(state.filter("tracked").select(*scope, "pid", "k", "fork_ts"))
    release(state)
    return below


def scope_events(events: DataFrame, tracked: DataFrame, scope: Sequence[str], time: str | None = None) -> DataFrame:
    """Events of tracked processes; with ``time`` only from when tracking began."""
    if time is None:
        return events.join(tracked.select(*scope, "pid"), [*scope, "pid"], "left_semi")
    since = tracked.select(*scope, "pid", F.col("since").alias("_since"))
    return events.join(since, [*scope, "pid"]).filter(F.col(time) >= F.col("_since")).drop("_since")


def tracked_pid_count(tracked: DataFrame, scope: Sequence[str]) -> DataFrame:
    return tracked.select(*scope, "pid").distinct().groupBy(*scope).agg(F.count("*").alias("tracked_pids"))


def attribute_containers(events: DataFrame, cgroup_lines: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Container id of each event through its process's first container line.
    The lines are reduced to one row per process before the join."""
    first = cgroup_lines.filter(fx.in_container("line")).groupBy(*scope, "pid").agg(F.min_by("line", "line_no").alias("line"))
    ids = first.select(*scope, "pid", fx.container_id("line").alias("container_id"))
    return events.drop("container_id").join(ids, [*scope, "pid"], "left").withColumn(
        "container_id", F.coalesce("container_id", F.lit("")))


def namespace_siblings(processes: DataFrame, marker: str, scope: Sequence[str] = ("host",)) -> DataFrame:
    """Per host: all processes that share the mount namespace of the first
    process (by process id) whose command line contains the marker."""
    first = processes.filter(F.col("cmdline").contains(marker)).groupBy(*scope).agg(F.min_by("mnt_ns", "pid").alias("mnt_ns"))
    return processes.join(first, [*scope, "mnt_ns"]).select(*scope, "pid", "cmdline", "mnt_ns")
