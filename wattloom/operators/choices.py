"""The rolling choice between the candidates of releases.py, on arrays of many series.

releases.py makes a row of every step of every issue, which candidates(), intervals() and others hand on. Where only the
choice is asked for, none of these rows has to be there: the slots of some series lie in one array, an issue's steps are a
window of it, and only measured rows come in and issues go out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view

from ..functions.columns import SLOTS

#: Slots of the series that are worked on at once, and steps or medians within them: arrays of one or two megabytes.
SLOTS_AT_ONCE, STEPS_AT_ONCE = 1 << 18, 1 << 17
LEADS = 24
COLUMNS = "issue_at int, day_no int, release_hour int, history long, prior_a double, prior_b double, prior_c double, chosen string"

Issues = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def chooser(given: bool, days: int = 28, least: int = 7) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (series_id, _at, power, _days), with all rows of a series one after another; (series_id, COLUMNS) of each issue.

    Slots without a row have no power; _days is the length of a series' calendar. given: rows also have (day_no, release_hour, leads) of the issue at their time,
    or nulls; otherwise the issues are those of standard_issues().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_series(batches):
            ids = rows["series_id"].combine_chunks().dictionary_encode()
            series = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.append(np.flatnonzero(np.diff(series, prepend=-1)), len(series))
            last = np.maximum.reduceat(_numbers(rows["_days"], 0), starts[:-1]).astype(np.int64) * SLOTS
            step = max(1, int(SLOTS_AT_ONCE // max(1, last.max())))
            for low in range(0, len(last), step):
                high = min(low + step, len(last))
                some = rows.slice(starts[low], starts[high] - starts[low])
                found = _chosen(some, series[starts[low] : starts[high]] - low, last[low:high], given, days, least)
                if len(found[0]):
                    yield _batch(ids.dictionary.take(pa.array(found[0] + low)), *found[1:])

    return run


def _whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole series: those of a batch's last one wait for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("series_id")
        cut = pc.index(ids, ids[-1]).as_py()
        if waiting and (cut or waiting[0].column("series_id")[0] != ids[-1]):
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _numbers(column: pa.ChunkedArray, null: float) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy()


def _batch(ids: pa.Array, at: np.ndarray, day_no: np.ndarray, hour: np.ndarray, history: np.ndarray, priors: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
    whole = [pa.array(x, pa.int32()) for x in (at, day_no, hour)]
    means = [pa.array(x, pa.float64(), mask=history == 0) for x in priors]
    columns = [ids, *whole, pa.array(history, pa.int64()), *means, pa.array(["A", "B", "C"]).take(pa.array(chosen))]
    return pa.RecordBatch.from_arrays(columns, names=["series_id", *(c.split()[0] for c in COLUMNS.split(", "))])


def _chosen(rows: pa.Table, series: np.ndarray, last: np.ndarray, given: bool, days: int, least: int) -> tuple[np.ndarray, ...]:
    """(series, issue_at, day_no, release_hour, history, priors, number of the method) of the issues of some series, which end at the slots `last`."""
    at = _numbers(rows["_at"], 0).astype(np.int64)
    power = np.zeros((len(last), int(last.max()) + SLOTS + 2))  # by slot from 1 on; behind the last, room for an issue's steps
    there = (at > 0) & (at <= last[series])
    power[series[there], at[there]] = _numbers(rows["power"], 0.0)[there]
    issues = _given_issues(rows, series, at, last) if given else standard_issues(power, last)
    errors, steps = method_errors(power, last, issues, shapes(power, int(last.max()), days))
    some = np.flatnonzero(steps)  # an issue at the very end has nothing to be compared with
    order = some[np.lexsort((issues[2][some], issues[3][some], issues[0][some]))]
    history, priors = rolling_means(errors[:, order], issues[0][order] * (LEADS + 1) + issues[3][order], days)
    rounded = np.trunc(priors * 1e9)
    rounded += priors * 1e9 - rounded >= 0.5
    return *(x[order] for x in issues[:4]), history, priors, np.where(history < least, 0, rounded.argmin(axis=0))


def standard_issues(power: np.ndarray, last: np.ndarray) -> Issues:
    """(series, issue_at, day_no, release_hour, leads) as adapters.issues() has them: from the third day on, half the output a day before and half that at the issue."""
    at = np.arange(2 * SLOTS, int(last.max()), SLOTS // 4)
    series, which = np.nonzero(at < last[:, None])
    at = at[which]
    hours = power.ravel()[(series * power.shape[1] + at)[:, None] + np.arange(6 - SLOTS, 1, 6)]
    return series, at, at // SLOTS, at % SLOTS // 6, 0.5 * hours + 0.5 * hours[:, -1:]


def _given_issues(rows: pa.Table, series: np.ndarray, at: np.ndarray, last: np.ndarray) -> Issues:
    """The same from rows; an issue has to lie within its series' calendar."""
    is_issue = rows["leads"].is_valid().to_numpy()
    leads = pc.list_flatten(rows["leads"].drop_null()).to_numpy().reshape(-1, LEADS)
    within = (at[is_issue] > 0) & (at[is_issue] <= last[series[is_issue]])
    columns = (series, at, _numbers(rows["day_no"], 0).astype(np.int64), _numbers(rows["release_hour"], 0).astype(np.int64))
    return *(x[is_issue][within] for x in columns), leads[within]


def shapes(power: np.ndarray, last: int, days: int) -> np.ndarray:
    """What X.shape_residual_median() finds, by slot, with 0 for null. A median is only looked for where half of the values or more are on one side of 0."""
    n, hours = len(power), last // 6
    ends = power[:, : last + 1 : 6]
    left, right = ends[:, :-1, None], ends[:, 1:, None]
    inner = power[:, 1 : last + 1].reshape(n, hours, 6)[:, :, :5]
    past = np.full((n, days + last // SLOTS, LEADS * 5), np.nan)
    past[:, days:] = (inner - (left + (right - left) * np.arange(1, 6) / 6)).reshape(n, -1, LEADS * 5)
    past[:, days : days + 1, :5] = np.nan  # no slot before the first
    known = np.zeros(past.shape[1:], np.int32)  # of the days before; days + d stands for day d
    above, below = np.zeros((n, LEADS * 5), np.int32), np.zeros((n, LEADS * 5), np.int32)
    some = []
    for d in range(days, past.shape[1]):
        known[d] = (past[:1, d - days : d] == past[:1, d - days : d]).sum(axis=1)[0]
        s, c = np.nonzero(2 * np.maximum(above, below) >= np.maximum(known[d], 1))
        some.append(np.stack((s, np.full_like(s, d), c)))
        above += past[:, d] > 0
        below += past[:, d] < 0
        above -= past[:, d - days] > 0
        below -= past[:, d - days] < 0
    found = np.zeros_like(power)
    some = np.concatenate(some, axis=1) if some else np.zeros((3, 0), np.int64)
    for low in range(0, some.shape[1], STEPS_AT_ONCE // days):
        s, d, c = some[:, low : low + STEPS_AT_ONCE // days]
        values = np.sort(past[s[:, None], (d - days)[:, None] + np.arange(days), c[:, None]], axis=1)  # nulls go last
        size, each = known[d, c], np.arange(len(s))
        found[s, (d - days) * SLOTS + c // 5 * 6 + c % 5 + 1] = 0.5 * values[each, (size - 1) // 2] + 0.5 * values[each, size // 2]
    return found


def _lines(knots: np.ndarray) -> np.ndarray:
    """Straight lines between hourly knots at ten minutes, not below 0."""
    left = knots[:, :-1, None]
    inner = left + (knots[:, 1:, None] - left) * np.arange(1, 7) / 6
    return np.maximum(np.concatenate((knots[:, :1], inner.reshape(len(knots), 6 * knots.shape[1] - 6)), axis=1), 0.0)


def biases(power: np.ndarray, issues: Issues, knots: np.ndarray, least: int = 6) -> np.ndarray:
    """What recent_bias() finds; 0 where there is no issue six hours before."""
    series, at, width = issues[0], issues[1], power.shape[1]
    key = series * width + at
    order = np.argsort(key, kind="stable")
    before = order[np.minimum(np.searchsorted(key, key - 36, sorter=order), len(order) - 1)] if len(key) else order
    found = np.zeros(len(key))
    both = np.flatnonzero((key[before] == key - 36) & (series[before] == series))
    for low in range(0, len(both), STEPS_AT_ONCE // 19):
        some = both[low : low + STEPS_AT_ONCE // 19]
        pred, truth = _lines(knots[before[some], 2:7])[:, 6:], sliding_window_view(power.ravel(), 19)[key[some] - 18]
        counts = (truth > 1) | (pred > 1)
        size = counts.sum(axis=1)
        enough = np.flatnonzero(size >= least)
        off, size = np.sort(np.where(counts, truth - pred, np.nan)[enough], axis=1), size[enough]
        each = np.arange(len(enough))
        found[some[enough]] = 0.5 * off[each, (size - 1) // 2] + 0.5 * off[each, size // 2]
    return found


def _mean_off(x: np.ndarray | None, truth: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Mean of what intervals between the endpoints x (None: all 0) are off, over the first `steps` of each row."""
    off = np.abs(truth if x is None else (x[:, :-1] + x[:, 1:]) / 2 - truth)
    if (steps < off.shape[1]).any():
        off = np.where(np.arange(off.shape[1]) < steps[:, None], off, 0.0)
    return off.sum(axis=1) / steps


def method_errors(power: np.ndarray, last: np.ndarray, issues: Issues, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean absolute errors of the candidates A, B and C over the intervals of each issue up to midnight, and how many intervals there are.

    Forecasts without power at the issue and in their hours are 0 throughout, and B and C are A where there is no shape or bias: only others are drawn.
    """
    series, at, _, hour, leads = issues
    first = series * power.shape[1] + at
    knots = np.concatenate((power.ravel()[first][:, None], leads), axis=1)
    bias, shaped_before = biases(power, issues, knots), np.cumsum(shape.ravel() != 0)
    steps = np.maximum(0, np.minimum((LEADS - hour) * 6, last[series] - at))
    errors = np.zeros((3, len(series)))
    for h in np.unique(hour[steps > 0]):
        n = int(LEADS - h) * 6
        these = np.flatnonzero((hour == h) & (steps > 0))
        truths, shaped = sliding_window_view(power.ravel(), n + 1), sliding_window_view(shape.ravel(), n + 1)
        for low in range(0, len(these), STEPS_AT_ONCE // (n + 1)):
            some = these[low : low + STEPS_AT_ONCE // (n + 1)]
            truth, ends = truths[first[some]], steps[some]
            truth = (truth[:, :-1] + truth[:, 1:]) / 2
            errors[:, some] = _mean_off(None, truth, ends)
            lit = knots[some, : n // 6 + 1].any(axis=1)
            drawn = np.flatnonzero(lit)
            a = _lines(knots[some[drawn], : n // 6 + 1])
            errors[:, some[drawn]] = _mean_off(a, truth[drawn], ends[drawn])
            bent = np.flatnonzero(shaped_before[first[some] + n] > shaped_before[first[some] - 1])
            b = shaped[first[some[bent]]]
            b[lit[bent]] += a[np.searchsorted(drawn, bent[lit[bent]])]
            errors[1, some[bent]] = _mean_off(np.maximum(b, 0.0), truth[bent], ends[bent])
            moved = np.flatnonzero(bias[some[drawn]])
            c, drawn = a[moved], drawn[moved]
            c = np.where(c > 1, np.maximum(c + bias[some[drawn]][:, None] * np.exp(-np.arange(n + 1) / 18), 0.0), c)
            errors[2, some[drawn]] = _mean_off(c, truth[drawn], ends[drawn])
    return errors, steps


def rolling_means(errors: np.ndarray, groups: np.ndarray, days: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of up to `days` columns of its group there are before each one, and their means (0 from none)."""
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    rank = np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))
    sums = np.zeros_like(errors)
    for k in range(min(days, len(groups) - 1), 0, -1):  # the oldest first
        sums[:, k:] += np.where(rank[k:] >= k, errors[:, :-k], 0.0)
    history = np.minimum(rank, days)
    return history, sums / np.maximum(history, 1)
