"""Alert rules with a cooldown: fire on the first matching sample, then stay quiet.

Which samples fire depends on the previous fire, a chain through time. Samples
are cut into (rule, time slice) groups that are solved side by side: first every
slice tells, for each way it may be entered, where its chain ends. Slices are
composed into days and days into longer periods in the same form, so a group
holds the summaries of one period's parts, however long the data. The entries
of the longest periods are found in time order and handed down, and each slice
then lists its fires.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from orgloom.functions import fixed_values as V

US = 1_000_000


Rules = Sequence[tuple[str, str, str, int]]


def triggers(health: DataFrame, rules: Rules = V.ALERT_RULES) -> DataFrame:
    """(rule, cooldown_us, us): samples that meet a rule, by its number; equal times once.

    Only numbers travel to Python; names and severities are put back at the end.
    """
    hit = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(i).alias("rule"), F.lit(minutes * 60 * US).cast("long").alias("cooldown_us")))
        for i, (_, cond, _, minutes) in enumerate(rules)]))
    return health.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.inline(hit)).distinct()


def _next(us: np.ndarray, cooldown: int) -> np.ndarray:
    """Index of the next sample that may fire after each sample (len = none)."""
    return np.searchsorted(us, us + cooldown, side="left")


def _per_slice(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Apply ``fn`` to each (rule, slice) of a sorted partition, one slice in memory at a time."""

    def mapper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            changed = (pdf["rule"] != pdf["rule"].shift()) | (pdf["slice_start"] != pdf["slice_start"].shift())
            cuts = np.flatnonzero(changed.to_numpy())
            done = [fn(pdf.iloc[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
            held = pdf.iloc[cuts[-1]:]
            if done:
                yield pd.concat(done)
        if held is not None:
            yield fn(held)

    return mapper


def _slice_exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each entry sample of a slice the last fire of the chain that starts there."""
    us, cooldown, start = pdf["us"].to_numpy(), int(pdf["cooldown_us"].iloc[0]), int(pdf["slice_start"].iloc[0])
    n = len(us)
    nxt = _next(us, cooldown)
    last = np.where(nxt < n, nxt, np.arange(n))  # the end of a chain points at itself
    while (last[last] != last).any():  # path doubling along the next-fire links
        last = last[last]
    entries = min(int(np.searchsorted(us, start + cooldown, side="left")) + 1, n)
    exits = us[last[:entries]]
    keep = np.append(exits[1:] != exits[:-1], True)  # equal exits in a row share one entry
    return pd.DataFrame({"rule": pdf["rule"].iloc[0], "slice_start": start, "cooldown_us": cooldown,
                         "upto": us[:entries][keep], "exit_us": exits[keep]})


MAP = "rule {}, slice_start long, cooldown_us long, upto long, exit_us long"


def _parts(exits: pd.DataFrame, column: str = "slice_start") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(start, upto, exit) of each part in time order."""
    exits = exits.sort_values([column, "upto"])
    start, upto, leave = (exits[c].to_numpy() for c in (column, "upto", "exit_us"))
    cuts = np.append(np.flatnonzero(np.append(True, start[1:] != start[:-1])), len(start))
    return [(int(start[i]), upto[i:j], leave[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]


def _compose(exits: pd.DataFrame) -> pd.DataFrame:
    """The map of a period from the maps of its parts: for each way in, the last fire inside."""
    cooldown, period = int(exits["cooldown_us"].iloc[0]), int(exits["period"].iloc[0])
    ways, leaves = np.empty(0, np.int64), np.empty(0, np.int64)
    reach = period + cooldown  # a chain from before may fire again by then
    for _, upto, leave in _parts(exits):
        # chains that run already meet this part when their cooldown ends
        at = np.searchsorted(upto, leaves + cooldown, side="left")
        on = at < len(upto)
        leaves[on] = leave[at[on]]
        if not len(ways) or ways[-1] < reach:  # the part can still be the first to fire
            n = int(np.searchsorted(upto, reach, side="left")) + 1
            ways, leaves = np.append(ways, upto[:n]), np.append(leaves, leave[:n])
    keep = np.append(leaves[1:] != leaves[:-1], True)
    return pd.DataFrame({"rule": exits["rule"].iloc[0], "slice_start": period, "cooldown_us": cooldown, "upto": ways[keep], "exit_us": leaves[keep]})


def _walk(exits: pd.DataFrame, blocked: int) -> pd.DataFrame:
    """Until when each part is blocked if the first is blocked until ``blocked``."""
    rule, cooldown, out = exits["rule"].iloc[0], int(exits["cooldown_us"].iloc[0]), []
    for start, upto, leave in _parts(exits):
        out.append((rule, start, blocked))
        i = int(np.searchsorted(upto, blocked, side="left"))
        if i < len(upto):
            blocked = int(leave[i]) + cooldown
    return pd.DataFrame(out, columns=["rule", "slice_start", "blocked_until"])


ENTRIES = "rule {}, slice_start long, blocked_until long"


def _first_entries(exits: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
    """Entries of one rule's longest periods, after the last fire of earlier runs."""
    if not len(exits):
        return pd.DataFrame([], columns=["rule", "slice_start", "blocked_until"])
    return _walk(exits, int(carried["last_us"].max()) + int(exits["cooldown_us"].iloc[0]) if len(carried) else -(2**62))


def _inner_entries(exits: pd.DataFrame) -> pd.DataFrame:
    return _walk(exits, int(exits["blocked_until"].iloc[0]))


def _slice_fires(pdf: pd.DataFrame) -> pd.DataFrame:
    us = pdf["us"].to_numpy()
    link = _next(us, int(pdf["cooldown_us"].iloc[0]))
    i = int(np.searchsorted(us, int(pdf["blocked_until"].iloc[0]), side="left"))
    fired = []
    while i < len(us):
        fired.append(i)
        i = int(link[i])
    return pdf.iloc[fired][["rule", "us"]]


CARRIED = "rule string, last_us long"


def _period(width: int) -> Column:
    return F.col("slice_start") - F.pmod(F.col("slice_start"), F.lit(width))


def alert_log(health: DataFrame, rules: Rules = V.ALERT_RULES, slice_minutes: int = 60,
              carried: DataFrame | None = None, parts: Sequence[int] = (24, 30)) -> DataFrame:
    """rule, severity and time (microseconds) of every alert.

    A slice must be longer than any cooldown. ``parts`` tells how many slices make
    a period, how many of those a longer one, and so on. ``carried`` holds the last fire per
    rule of earlier runs (one row per rule).
    """
    if slice_minutes <= max(m for *_, m in rules):
        raise ValueError("a slice must be longer than every cooldown")
    numbers = F.coalesce(*[F.when(F.col("rule") == name, F.lit(i)) for i, (name, *_) in enumerate(rules)])
    before = carried if carried is not None else health.sparkSession.createDataFrame([], CARRIED)
    fires = chain_fires(triggers(health, rules), before.select(numbers.alias("rule"), "last_us").filter("rule IS NOT NULL"), slice_minutes, parts)
    names, severities = (F.array(*[F.lit(r[k]) for r in rules]) for k in (0, 2))
    return fires.select(names[F.col("rule")].alias("rule"), severities[F.col("rule")].alias("severity"), "us")


def chain_fires(hits: DataFrame, before: DataFrame, slice_minutes: int = 60, parts: Sequence[int] = (24, 30)) -> DataFrame:
    """(rule, us) of the fires among ``hits`` (rule, cooldown_us, us; distinct): the first of a rule, then each first one that is its cooldown after the last fire.

    ``before`` holds (rule, last_us) of earlier runs. A slice is longer than any cooldown.
    """
    kind = hits.schema["rule"].dataType.simpleString()
    width = slice_minutes * 60 * US
    hits = hits.withColumn("slice_start", F.col("us") - F.pmod(F.col("us"), F.lit(width)))
    by_slice = ["rule", "slice_start"]
    mapped, entered_as = MAP.format(kind), ENTRIES.format(kind)
    maps = [hits.repartition(*by_slice).sortWithinPartitions(*by_slice, "us").mapInPandas(_per_slice(_slice_exits), mapped)]
    widths = [width]
    for n in parts:
        widths.append(widths[-1] * n)
        maps.append(maps[-1].withColumn("period", _period(widths[-1])).groupBy("rule", "period").applyInPandas(_compose, mapped))
    entries = maps[-1].groupBy("rule").cogroup(before.groupBy("rule")).applyInPandas(_first_entries, entered_as)
    for inner, outer in zip(maps[-2::-1], widths[:0:-1]):
        entered = entries.withColumnRenamed("slice_start", "period")
        entries = inner.withColumn("period", _period(outer)).join(entered, ["rule", "period"]).groupBy("rule", "period").applyInPandas(_inner_entries, entered_as)
    return hits.join(entries, by_slice).repartition(*by_slice).sortWithinPartitions(*by_slice, "us").mapInPandas(
        _per_slice(_slice_fires), f"rule {kind}, us long")


def fired_at(alerts: DataFrame) -> DataFrame:
    return alerts.select("rule", "severity", F.timestamp_micros("us").cast("timestamp_ntz").alias("fired_at"))


def resource_alerts(samples: DataFrame, memory: float = 85, cpu: float = 80) -> DataFrame:
    """Stateless memory and CPU warnings, one row per warning."""
    kinds = F.array_compact(F.array(
        F.when(F.col("memory_usage") > memory, F.struct(F.lit("memory_warning").alias("type"), F.col("memory_usage").alias("value"))),
        F.when(F.col("cpu_usage") > cpu, F.struct(F.lit("cpu_warning").alias("type"), F.col("cpu_usage").alias("value")))))
    return samples.select("event_id", "ts", F.inline(kinds))


def rate_limit_starts(calls: DataFrame, key: str, time: str, seconds: int = 60, carried: DataFrame | None = None) -> DataFrame:
    """(rule, us): when each caller's counting windows start. A window starts at the first call later than ``seconds`` after the last
    one's start, at whatever time that is; ``carried`` holds (rule, last_us) of earlier runs."""
    after = seconds * US + 1
    hits = calls.select(F.col(key).cast("string").alias("rule"), F.lit(after).cast("long").alias("cooldown_us"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    before = carried if carried is not None else calls.sparkSession.createDataFrame([], CARRIED)
    return chain_fires(hits.dropna().distinct(), before, max(60, 2 * seconds // 60))


def rate_limit_windows(calls: DataFrame, starts: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """(key, us, calls): the calls in each window of ``starts``. A window reaches into two stretches of its length, so calls are joined by (key, stretch)."""
    width = (seconds + 1) * US
    opened = starts.select("rule", "us", F.explode(F.array(F.floor(F.col("us") / width), F.floor(F.col("us") / width) + 1)).alias("stretch"))
    made = calls.select(F.col(key).cast("string").alias("rule"), F.unix_micros(F.col(time).cast("timestamp")).alias("at")).dropna()
    counted = made.groupBy("rule", "at").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("at") / width))
    inside = (F.col("at") >= F.col("us")) & (F.col("at") <= F.col("us") + seconds * US)
    return counted.join(opened, ["rule", "stretch"]).filter(inside).groupBy(F.col("rule").alias(key), "us").agg(F.sum("n").alias("calls"))


def rate_limited(windows: DataFrame, key: str, limit: int) -> DataFrame:
    """Calls, allowed and refused ones per window; refused calls are not counted against the limit, so the first ``limit`` calls pass."""
    total = windows.groupBy(key, "us").agg(F.sum("calls").alias("calls"))
    return total.select(key, F.timestamp_micros("us").cast("timestamp_ntz").alias("window_start"), "calls", F.least("calls", F.lit(limit)).alias("allowed"),
                        F.greatest(F.col("calls") - limit, F.lit(0)).alias("refused"), (F.col("calls") >= limit).alias("limited"))
