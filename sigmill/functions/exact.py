"""Fisher's exact test, which Spark has no expression for, over Arrow batches.

Fisher's two-sided p is the sum of the probabilities of all tables with the same margins that are no likelier than the
observed one. Tables are put in one of eight equivalent layouts first, so equal questions get equal answers to the bit.
Tables with a short support are computed together, one array row each; long supports one by one, up to the terms that
can't change the sum any more. Every table gets its p in Spark; a bound on the terms is a caller's choice.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms that a single request outside Spark may ask for; the Spark functions have no bound.
WORK_TERMS = 100_000
#: fixed values: how much likelier than the observed table counts as equal; largest exact count
SLACK = 1e-7
EXACT_COUNT = 2**53
#: Supports up to this length are computed in arrays of many tables.
SHORT_SUPPORT = 4096
OK, TOO_LARGE, INVALID = "ok", "batch_required", "invalid"


def canonical(tables: np.ndarray) -> np.ndarray:
    """The lexicographically least of the eight layouts (rows, columns, both swapped, and transposed) of each table."""
    a, b, c, d = tables.T
    layouts = [(a, b, c, d), (b, a, d, c), (c, d, a, b), (d, c, b, a), (a, c, b, d), (c, a, d, b), (b, d, a, c), (d, b, c, a)]
    best = np.stack(layouts[0], 1)
    for layout in layouts[1:]:
        other = np.stack(layout, 1)
        differs = best != other
        first = differs.argmax(1)
        rows = np.arange(len(best))
        less = differs.any(1) & (other[rows, first] < best[rows, first])
        best[less] = other[less]
    return best


def _log_steps(x: np.ndarray, r1, c1, n) -> np.ndarray:
    """log of P(x + 1) / P(x)."""
    return np.log((c1 - x) * (r1 - x)) - np.log((x + 1.0) * (n - r1 - c1 + x + 1.0))


def _short(tables: np.ndarray, width: int) -> np.ndarray:
    a, b, c, d = tables.astype(np.float64).T
    r1, c1, n = a + b, a + c, a + b + c + d
    low, high = np.maximum(0, r1 + c1 - n), np.minimum(r1, c1)
    x = low[:, None] + np.arange(width)[None, :]
    inside = x <= high[:, None]
    steps = np.zeros((len(a), width))
    here = x < high[:, None]
    rows, _ = np.nonzero(here)
    steps[here] = _log_steps(x[here], r1[rows], c1[rows], n[rows])
    logs = np.zeros((len(a), width))
    logs[:, 1:] = np.cumsum(steps[:, :-1], axis=1)
    logs[~inside] = -np.inf
    logs -= logs.max(1, keepdims=True)
    seen = logs[np.arange(len(a)), (a - low).astype(np.int64)][:, None]
    p = np.exp(logs)
    tail = inside & (logs <= seen + math.log1p(SLACK))
    # relative to the largest term of the tail, so that tiny sums keep their digits
    top = np.where(tail, logs, -np.inf).max(1, keepdims=True)
    tail_sum = np.exp(np.where(tail, logs - top, -np.inf)).sum(1)
    return np.where(tail.sum(1) == inside.sum(1), 1.0, np.exp(top[:, 0] + np.log(tail_sum) - np.log(p.sum(1))))


#: Terms that the first step of a walk takes at once, and that later ones, each twice as long, take at most.
_FIRST, _BLOCK = 128, 8192
#: Share of a sum that is too small for its last digit (2**-53).
_NO_DIGIT = 2.0**-60
#: log(n!) less Stirling's formula, for n below 10
_SMALL_ERRORS = [0.0, *(math.log(math.factorial(n)) - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) for n in range(1, 10))]


def _stirling_error(n: float) -> float:
    """log(n!) less Stirling's formula; its asymptotic series from 10 on."""
    if n < 10:
        return _SMALL_ERRORS[int(n)]
    s = 1.0 / (n * n)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation where both are close."""
    gap = (x - mean) / (x + mean)
    if abs(gap) >= 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, k = (x - mean) * gap, 2 * x * gap, 1
    while True:
        power *= gap * gap
        k += 2
        more = total + power / k
        if more == total:
            return total
        total = more


def _log_binomial(x: float, n: float, p: float) -> float:
    """log of the binomial probability in saddle-point form, which keeps its digits for any size of n."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    spread = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return spread - 0.5 * math.log(2 * math.pi * x * (n - x) / n)


def _log_probability(x: int, r1: int, c1: int, n: int) -> float:
    """log of the hypergeometric probability of ``x``, from three binomial ones."""
    p = r1 / n
    return _log_binomial(x, c1, p) + _log_binomial(r1 - x, n - c1, p) - _log_binomial(r1, n, p)


def _blocks(start: int, stop: int, margins: tuple[int, int, int]) -> Iterator[np.ndarray]:
    """Logs of the probabilities from ``start`` to ``stop``, in blocks.

    Within a block each term follows from the ratio of neighbours; blocks are anchored anew.
    """
    way, at, size = (1 if stop >= start else -1), start, _FIRST
    while (stop - at) * way >= 0:
        x = at + way * np.arange(min(size, abs(stop - at) + 1), dtype=np.float64)
        ratios = _log_steps(x[:-1], *map(float, margins)) if way > 0 else -_log_steps(x[1:], *map(float, margins))
        yield _log_probability(at, *margins) + np.concatenate([[0.0], np.cumsum(ratios)])
        at, size = at + way * len(x), min(2 * size, _BLOCK)


def _level(start: int, stop: int, margins: tuple[int, int, int], seen: float, limit: float) -> int:
    """Number of values from ``start`` towards ``stop`` up to the first whose log isn't from ``seen`` to ``limit``."""
    count = 0
    for logs in _blocks(start, stop, margins):
        equal = (logs >= seen) & (logs <= limit)
        if not equal.all():
            return count + int(equal.argmin())
        count += len(logs)
    return count


def _tail(start: int, stop: int, margins: tuple[int, int, int]) -> float:
    """Sum of the probabilities from ``start`` to ``stop``, which fall all the way.

    They fall ever faster, so those that are left are less than a geometric series with the last ratio. Where that is too
    small for the last digit of the sum they needn't be added.
    """
    total = 0.0
    for logs in _blocks(start, stop, margins):
        total += float(np.exp(logs).sum())
        ratio = math.exp(logs[-1] - logs[-2]) if len(logs) > 1 else 1.0
        if math.exp(logs[-1]) * ratio <= total * _NO_DIGIT * (1 - ratio):
            break
    return total


@functools.lru_cache(1 << 14)
def _long(a: int, b: int, c: int, d: int, most: int | None = None) -> tuple[float | None, str]:
    """p of a table with a long support: the two sums outward from the observed value and from the far values like it.

    The probabilities rise from the observed value towards the mode and fall to the far end; tables that are no likelier
    lie on both sides. With ``most`` a p is refused that neither so many of them nor, if it is at least one half, so many
    likelier ones settle.
    """
    margins = r1, c1, n = a + b, a + c, a + b + c + d
    ends = max(0, r1 + c1 - n), min(r1, c1)
    seen = _log_probability(a, *margins)
    limit = seen + math.log1p(SLACK)
    ratio = lambda x: float(_log_steps(np.array([float(x)]), *map(float, margins))[0])
    if a < ends[1] and ratio(a) > 0:
        near, far, way = *ends, 1
    elif a > ends[0] and ratio(a - 1) < 0:
        near, far, way = *ends[::-1], -1
    else:
        return 1.0, OK  # the observed table is the likeliest
    begin = a + way * _level(a, far, margins, seen, limit)  # beyond those that count as equal to the observed
    if (far - begin) * way < 0 or _log_probability(begin, *margins) <= limit:
        return 1.0, OK
    likelier = bisect_left(range(abs(far - begin) + 1), True, key=lambda k: _log_probability(begin + way * k, *margins) <= limit)
    beyond = begin + way * likelier
    own = _tail(begin - way, near, margins)
    other = _tail(beyond, far, margins) if (far - beyond) * way >= 0 else 0.0
    p = min(1.0, own + other)
    if most is not None and abs(ends[1] - ends[0]) + 1 - likelier > most and (likelier > most or p < 0.5):
        return None, TOO_LARGE
    return p, OK


def fisher_two_sided(tables: np.ndarray, most: int | None = WORK_TERMS) -> tuple[np.ndarray, list[str]]:
    """p and status of each row (a, b, c, d): ``invalid`` where it isn't a table.

    With ``most``, the bound of a single request, ``batch_required`` where it takes more terms. A batch passes None.
    """
    tables = np.asarray(tables, np.int64).reshape(-1, 4)
    p, status = np.full(len(tables), np.nan), [INVALID] * len(tables)
    fits = ((tables >= 0) & (tables <= EXACT_COUNT)).all(1)
    valid = np.flatnonzero(fits & (np.where(fits[:, None], tables, 0).sum(1) <= EXACT_COUNT))
    if not len(valid):
        return p, status
    own = canonical(tables[valid])
    a, b, c, d = own.T
    support = np.minimum(a + b, a + c) - np.maximum(0, a - d) + 1
    for n in valid:
        status[n] = OK
    order = np.argsort(support, kind="stable")
    short = order[support[order] <= SHORT_SUPPORT]
    # a row's width follows from its own support: a table gets the same bits whatever it is tested with
    wide = np.maximum(16, 2 ** np.ceil(np.log2(support[short])).astype(np.int64))
    at = 0
    while at < len(short):
        # rows of one width together, about a million cells at a time
        stop = min(int(np.searchsorted(wide, wide[at], "right")), at + (1 << 20) // int(wide[at]))
        p[valid[short[at:stop]]] = np.minimum(_short(own[short[at:stop]], int(wide[at])), 1.0)
        at = stop
    for n in order[support[order] > SHORT_SUPPORT]:
        value, status[valid[n]] = _long(*(int(v) for v in own[n]), most)
        p[valid[n]] = np.nan if value is None else value
    return p, status


def fisher_table(tables: DataFrame) -> DataFrame:
    """``a``, ``b``, ``c``, ``d`` of ``tables`` with ``fisher_p`` (NULL where invalid) and ``fisher_status``; rows stay."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in "abcd"]
            p, status = fisher_two_sided(np.stack(columns, 1), None) if batch.num_rows else (np.zeros(0), [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "abcd"), pa.array(p, pa.float64(), from_pandas=True), pa.array(status, pa.string())], names=[*"abcd", "fisher_p", "fisher_status"])

    return tables.select(*(tables[c].cast("long") for c in "abcd")).mapInArrow(test, "a long, b long, c long, d long, fisher_p double, fisher_status string")


@F.pandas_udf(T.StructType([T.StructField("fisher_p", T.DoubleType()), T.StructField("fisher_status", T.StringType())]))
def _tested(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    tables, at = np.unique(np.stack([x.to_numpy(np.int64) for x in (a, b, c, d)], 1).reshape(-1, 4), axis=0, return_inverse=True)
    p, status = fisher_two_sided(tables, None)
    return pd.DataFrame({"fisher_p": p[at.ravel()], "fisher_status": np.array(status, object)[at.ravel()]})


def with_fisher(cells: DataFrame) -> DataFrame:
    """``cells`` with the exact test, where they lie: nothing is shuffled or joined, and a hot table is no task's burden.

    A table that repeats in a batch is tested once, a long one once in many batches. Cells with a NULL count are not
    tested (``invalid``).
    """
    found = _tested(*(F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in "abcd"))
    p = F.when(~F.isnan("_tested.fisher_p"), F.col("_tested.fisher_p"))
    return cells.withColumn("_tested", found).select(*cells.columns, p.alias("fisher_p"), "_tested.fisher_status")
