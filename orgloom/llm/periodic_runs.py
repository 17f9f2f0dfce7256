"""Runs: stretches of words that repeat with a period.

Short periods are found by direct lag scans. A longer period q belongs to the scale K with K / 2 < q <= K. There the
hashes of all K-grams are taken, and the minimum of every window of K / 2 of them is kept (minimizers). Inside a
run of at least four periods the K-grams repeat exactly after q places, not earlier, and a whole window and
its copy q places on fit into the run. So both have their minimum at the same place of the period, and these are
neighbours among the minimizers of one hash: each run is proposed by such a pair. Pairs at a
distance in the scale's range are extended to both sides by comparing words at that lag.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm import words as W
from orgloom.llm.storage import tidy

DIRECT = 8  # the largest period found by direct scans, a power of two
Run = tuple[int, int, int]  # (start, length, period)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTOR = np.uint64(0xD1342543DE82EF95)


def _sliding(x: np.ndarray, w: int, best: Callable) -> np.ndarray:
    """``best`` (an ufunc) of the w values from each place on; len(x) - w + 1 places."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.concatenate([x, np.full(blocks * w - len(x), x[-1])]).reshape(blocks, w)
    ahead = best.accumulate(padded, axis=1).reshape(-1)
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(behind[:n], ahead[w - 1:w - 1 + n])


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """Whether each place holds the minimum of some window of w places."""
    least = _sliding(grams, w, np.minimum)
    wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return _sliding(wide, w, np.maximum) == grams


@cache
def _primes(n: int) -> tuple[int, ...]:
    """The prime factors of n."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def _smallest(v: np.ndarray, start: int, period: int) -> bool:
    """Whether no part of ``period`` is a period of the stretch from ``start`` on, of at least two periods."""
    unit = v[start:start + period]
    return not any((unit[period // p:] == unit[:-(period // p)]).all() for p in _primes(period))


def _reach(v: np.ndarray, at: int, lag: int, lo: int, hi: int) -> tuple[int, int]:
    """The ends of the stretch around the places ``at`` where v[x] == v[x - lag], for lo + lag <= x < hi."""
    right, step = at, 64
    while right < hi:
        unlike = v[right:min(right + step, hi)] != v[right - lag:min(right + step, hi) - lag]
        if unlike.any():
            right += int(unlike.argmax())
            break
        right += len(unlike)
        step *= 2
    left, step = at, 64
    while left > lo + lag:
        begin = max(left - step, lo + lag)
        unlike = v[begin:left] != v[begin - lag:left - lag]
        if unlike.any():
            left -= int(unlike[::-1].argmax())
            break
        left = begin
        step *= 2
    return left, right


def find_runs(v: np.ndarray, first: np.ndarray, least_length: int = 6, least_power: int = 4) -> list[list[Run]]:
    """The runs of each text, by start and period. ``v``: a number per word, equal for equal words; text d has words first[d] to first[d + 1].

    A run is a stretch with smallest period q and a length of at least max(least_length, least_power * q) that no neighbouring word extends.
    """
    if least_power < 4:
        raise ValueError("minimizers propose every run only from four periods on")
    texts = len(first) - 1
    sizes = np.diff(first)
    owner = np.repeat(np.arange(texts), sizes)
    found: list[set[Run]] = [set() for _ in range(texts)]
    for q in range(1, min(DIRECT, len(v) - 1) + 1):
        same = np.concatenate([[False], (v[q:] == v[:-q]) & (owner[q:] == owner[:-q]), [False]])
        turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in turns[turns[:, 1] - turns[:, 0] >= max(least_length, least_power * q) - q].tolist():
            if _smallest(v, s, q):
                d = int(owner[s])
                found[d].add((s - int(first[d]), e - s + q, q))
    # places of the texts that can hold longer periods, and the hashes of their grams
    place, grams, k = np.arange(len(v)), W.mix(v), 1
    while True:
        fits = sizes >= least_power * (max(k, DIRECT) + 1)
        if not fits.any():
            break
        keep = fits[owner[place]]
        if not keep.all():
            place, grams = place[keep], grams[keep]
        longer = np.full(len(grams), _TOP)
        longer[:-k] = W.mix(grams[:-k] * _FACTOR + grams[k:])
        k *= 2
        inside = place + k <= first[owner[place] + 1]
        grams = np.where(inside, longer, _TOP)
        if k > DIRECT:
            _propose(v, first, owner, place, grams, inside, k, least_length, least_power, found)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _propose(v, first, owner, place, grams, inside, k, least_length, least_power, found) -> None:
    """Add the runs with periods above k / 2 and up to k."""
    chosen = np.flatnonzero(minimizers(grams, k // 2) & inside)
    order = chosen[np.argsort(grams[chosen], kind="stable")]
    at = place[order]
    lag = at[1:] - at[:-1]
    pair = np.flatnonzero((grams[order][1:] == grams[order][:-1]) & (lag > k // 2) & (lag <= k) & (owner[at[1:]] == owner[at[:-1]]))
    ends, lags = at[1:][pair], lag[pair]
    passed: dict[int, int] = {}  # lag -> end of the last stretch seen; places come in rising order
    for x, q in sorted(zip(ends.tolist(), lags.tolist())):
        if x < passed.get(q, 0):
            continue
        d = int(owner[x])
        lo, hi = int(first[d]), int(first[d + 1])
        left, right = _reach(v, x, q, lo, hi)
        passed[q] = right
        length = right - left + q
        if length >= max(least_length, least_power * q) and _smallest(v, left - q, q):
            found[d].add((left - q - lo, length, q))


def covered(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def _exact(tokens: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(t, len(number)) for t in tokens], np.uint64)


def judged(
    ids: list, raw: np.ndarray, at: np.ndarray, least_length: int, least_power: int, rewrite: Callable[[int, int], tuple[int, int] | None] | None,
) -> Iterator[dict]:
    """The result rows of the texts at ``at`` in ``raw``."""
    words = W.words_of(raw, at, W.SPACES, False)
    first, counts = words.first, words.counts().tolist()
    v, order = words.hash, {}
    for d, (name, n) in enumerate(zip(ids, counts)):
        told = rewrite(name, n) if rewrite and name is not None and n else None
        if told:
            a, p = told
            order[d] = np.concatenate([np.arange(a), a + np.arange(n - a) % p])
    if order:
        v = v.copy()
        for d, o in order.items():
            v[first[d]:first[d + 1]] = v[first[d]:first[d + 1]][o]
    for d, runs in enumerate(find_runs(v, first, least_length, least_power)):
        tokens = raw[at[d]:at[d + 1]].tobytes().split()
        if d in order:
            tokens = [tokens[o] for o in order[d].tolist()]
        if any(tokens[s:s + n - q] != tokens[s + q:s + n] for s, n, q in runs):  # two words of one hash
            runs = find_runs(_exact(tokens), np.array([0, len(tokens)]), least_length, least_power)[0]
        gone = covered(runs, len(tokens)) if runs else None
        kept = b" ".join([t for t, g in zip(tokens, gone.tolist()) if not g] if runs else tokens)
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        start, length, period = best or (None, None, None)
        yield {
            "id": ids[d], "n_words": counts[d], "n_runs": len(runs), "start": start, "length": length, "period": period,
            "exponent_milli": 1000 * length // period if best else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
            "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": kept.decode() if runs else None}


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_power: int = 4,
    rewrite: Callable[[int, int], tuple[int, int] | None] | None = None,
) -> DataFrame:
    """One row per document row: ``id_col``, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed.

    Words are separated by ASCII white space. A run is a maximal stretch of words with smallest period q and at least
    max(``least_length``, ``least_power`` * q) words. start to exponent_milli describe the run of greatest length / period (ties: smallest start, then
    period); they are null where there is none. ``collapsed`` is the text without the words that a run contains after its first period (null
    where nothing is dropped); the hashes are of the lines ``start,length,period`` and of the kept words joined by blanks.
    ``rewrite(identifier, number of words)`` may give (a, p): words from a on become periodic, word i the word a + (i - a) % p.

    Texts are judged one by one, in stretches of about a megabyte or one longer text, so rows move nowhere. A null text has no words; a
    null identifier is never rewritten; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.raw_column(batch["text"])
            for i, j in W.stretches(at):
                yield pa.RecordBatch.from_pylist(list(judged(batch["id"].slice(i, j - i).to_pylist(), raw, at[i:j + 1], least_length, least_power, rewrite)), schema)

    longs = ("n_words", "n_runs", "start", "length", "period", "exponent_milli")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(kind)), *((n, pa.int64()) for n in longs), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
                        ("runs", run_type), ("collapsed", pa.string())])
    out = rows.mapInArrow(tidy(scan), f"id {kind.simpleString()}, {', '.join(f'{n} bigint' for n in longs)}, runs_sha256 string, collapsed_sha256 string, "
                          "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
