"""Which of a sorted list of ranges holds a key, as a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_LARGEST = (1 << 63) - 1


def listed(values: Sequence, kind: str) -> Column:
    """A constant array from one literal, a text that the optimizer takes apart: with a literal for each value, analysis
    takes most of the time of a query over some thousand partitions. Texts are identifiers, which have no NUL."""
    return F.split(F.lit("\0".join(map(str, values))), "\0").cast(f"array<{kind}>")


def _runs(lowers: Sequence, uppers: Sequence) -> list[tuple[int, int]]:
    """(place of the first, width) of runs of integer ranges that follow each other and are equally wide; width 0: one range."""
    out: list[tuple[int, int]] = []
    for i, (low, high) in enumerate(zip(lowers, uppers)):
        if i and low == uppers[i - 1] and high - low == low - lowers[i - 1] > 0:
            first, width = out[-1]
            if width in (0, high - low) and high - lowers[first] <= _LARGEST:
                out[-1] = first, high - low
                continue
        out.append((i, 0))
    return out


def range_index(key: Column, lowers: Sequence, uppers: Sequence, kind: str) -> Column:
    """The place of the range [lower, upper) that holds key; null if none does.

    Ranges are sorted and don't overlap. A binary search over two constant arrays: it stays in the row,
    where a join on the bounds would be a nested loop over all of them. Integer ranges of one width are searched
    as one, and the place in it is worked out.
    """
    if not lowers:
        return F.lit(None).cast("int")
    runs = _runs(lowers, uppers) if kind == "long" else [(i, 0) for i in range(len(lowers))]
    ends = [i for i, _ in runs[1:]] + [len(lowers)]
    low, high = listed([lowers[i] for i, _ in runs], kind), listed([uppers[i - 1] for i in ends], kind)
    steps = [1 << i for i in reversed(range(len(runs).bit_length()))]
    # bounds at or below the key, so far; a step is taken if the bound it leads to is one of them. Over local rows Spark
    # evaluates this before constants are folded, so the bounds are taken apart once a row and not once a step
    count = F.transform(F.array(low), lambda b: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.coalesce(F.get(b, a + s - 1) <= key, F.lit(False)), a + s).otherwise(a)))[0]
    if any(width for _, width in runs):
        first, width = listed([i for i, _ in runs], "int"), listed([w for _, w in runs], "long")
        place = lambda r: F.get(first, r) + F.when(F.get(width, r) > 0, F.call_function("div", key - F.get(low, r), F.get(width, r)).cast("int")).otherwise(0)
    else:
        place = lambda r: r
    at = F.transform(F.array(count), lambda c: F.when((c > 0) & (key < F.get(high, c - 1)), place(c - 1)))[0]
    return F.when(key.isNotNull(), at)
