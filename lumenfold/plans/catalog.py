"""All registered queries of the core."""

from __future__ import annotations

from lumenfold.plans.registry import Registry


def core() -> Registry:
    from lumenfold.plans import activity, archive, exchange, fields, frames, library, problems, rules, schedule

    out = Registry()
    for module in (problems, archive, frames, library, activity, schedule, fields, rules, exchange):
        out.merge(module.registry)
    return out
