"""Plain Python versions of the order-dependent rules, to check the Spark jobs against."""

from __future__ import annotations

from datetime import timedelta


def hour(moment):
    return moment.replace(minute=0, second=0, microsecond=0)


def blocks(times, hours):
    """(start, first, last, number of entries) per block and (start, end) per gap, by walking all entries."""
    length = timedelta(microseconds=round(hours * 3_600_000_000))
    found, gaps, start, last = [], [], None, None
    for moment in sorted(times):
        if start is None or moment - start > length or moment - last > length:
            if last is not None and moment - last > length:
                gaps.append((last + length, moment))
            start = hour(moment)
            found.append([start, moment, moment, 0])
        found[-1][2] = moment
        found[-1][3] += 1
        last = moment
    return [tuple(block) for block in found], gaps


def best_price(model, keys):
    """Matched key of a model: exact, variants in order, then the longest key in a containment."""
    variants = [
        model, model, f"anthropic/{model}", f"claude-{model}",
        model.replace("claude-3-", "claude-3."), model.replace("claude-3.", "claude-3-"),
    ]
    for name in variants:
        if name in keys:
            return name
    partial = [key for key in keys if key in model or model in key]
    return min(partial, key=lambda key: (-len(key), key)) if partial else None
