"""When a recurring scan is due: five cron fields, and whether a run was missed."""

from __future__ import annotations

import datetime as dt


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        every = int(step) if step else 1
        if every < 1:
            raise ValueError(f"step {step!r}")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        if not low <= a <= b <= high:
            raise ValueError(f"{part!r} isn't within {low} to {high}")
        out |= set(range(a, b + 1, every))
    return out


def parse(expression: str) -> tuple[list[set[int]], bool, bool]:
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("five fields are needed")
    sets = [_field(f, a, b) for f, (a, b) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)))]
    sets[4] = {d % 7 for d in sets[4]}
    return sets, fields[2] != "*", fields[4] != "*"


def _day_fits(day: dt.date, sets: list[set[int]], by_day: bool, by_week: bool) -> bool:
    if day.month not in sets[3]:
        return False
    d, w = day.day in sets[2], (day.weekday() + 1) % 7 in sets[4]
    return (d or w) if by_day and by_week else d and w


def fire_time(expression: str, now: dt.datetime, forward: bool = True) -> dt.datetime | None:
    """The next time after ``now``, or the last one up to it, within five years."""
    sets, by_day, by_week = parse(expression)
    step = 1 if forward else -1
    for k in range(366 * 5):
        day = now.date() + dt.timedelta(days=step * k)
        if not _day_fits(day, sets, by_day, by_week):
            continue
        times = [dt.datetime.combine(day, dt.time(h, m), now.tzinfo) for h in sorted(sets[1]) for m in sorted(sets[0])]
        fit = [t for t in times if t > now] if forward else [t for t in times if t <= now]
        if fit:
            return min(fit) if forward else max(fit)
    return None


def overdue(expression: str, last_run: dt.datetime | None, now: dt.datetime) -> bool:
    """Whether the newest result is older than the last time a run was due."""
    due = fire_time(expression, now, forward=False)
    return due is not None and (last_run is None or last_run < due)
