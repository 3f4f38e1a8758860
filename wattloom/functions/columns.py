"""Columns of the ten-minute grid: labels, calendar values, guarded arithmetic.

A day has `SLOTS` slots of `STEP` minutes; slot k is the endpoint at minute k * STEP, so the last is
the next midnight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS, STEP = 144, 10
#: Labels of the last endpoint of a day (fixed values).
MIDNIGHT_LABELS = ("24:00", "0:00+1", "00:00+1")


def minute_of_label(label: Column) -> Column:
    """"07:20" to 440; the labels of midnight to 1440."""
    parts = F.split(F.trim(label), ":")
    clock = F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when(F.trim(label).isin(*MIDNIGHT_LABELS), F.lit(SLOTS * STEP)).otherwise(clock)


def label_of_minute(minute: Column, next_day: str = "") -> Column:
    """440 to "07:20"; from 1440 on, with a prefix for the next day if one is given."""
    shown = minute if not next_day else minute % (SLOTS * STEP)
    text = F.format_string("%02d:%02d", (shown / 60).cast("int"), (shown % 60).cast("int"))
    return F.when(minute >= SLOTS * STEP, F.concat(F.lit(next_day), text)).otherwise(text) if next_day else text


def interval_label(slot: Column, length: int = 1) -> Column:
    """The interval that ends at a slot's endpoint and covers `length` slots."""
    return F.concat_ws("-", label_of_minute((slot - length) * STEP), label_of_minute(slot * STEP))


def shifted_label(slot: Column, next_day: str = "+1 ") -> Column:
    """Slot k in the shifted frame: from its endpoint to the next one."""
    return F.concat_ws("-", label_of_minute(slot * STEP, next_day), label_of_minute((slot + 1) * STEP, next_day))


def calendar(day: Column, slot: Column) -> dict[str, Column]:
    """Nine calendar values of a day and slot, all between -1 and 1; Monday is day 0."""
    at, week, year = (slot - 1) / SLOTS, F.weekday(day), F.dayofyear(day)
    turn = 2 * math.pi
    return {
        "slot_share": (slot - 1) / (SLOTS - 1), "slot_sin": F.sin(turn * at), "slot_cos": F.cos(turn * at),
        "weekday_share": week / 6, "weekend": (week >= 5).cast("double"), "week_sin": F.sin(turn * week / 7), "week_cos": F.cos(turn * week / 7),
        "year_sin": F.sin(turn * year / 365), "year_cos": F.cos(turn * year / 365),
    }


def guarded_ratio(x: Column, y: Column, above: float = 1e-8, otherwise: float | None = None) -> Column:
    """x / y where y is above a limit."""
    return F.when(y > above, x / y).otherwise(F.lit(otherwise).cast("double"))


def not_negative(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def daylight(power: Column, above: float = 1.0) -> Column:
    return power > above
