"""The greedy part of chapter planning.

Merging neighbours, bundling and splitting each depend on earlier decisions, so they
run per book over unit metadata (no text). The units of a book come from one archive,
which one reader task held whole, so a group here is a few thousand short rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions import titles
from plotweave.operators.corpus import MAX_CHAPTERS, act_groups, cap_groups, kept_units
from plotweave.plans.spread import spread


@dataclass(frozen=True)
class Limits:
    """Sizes in code points."""

    # Fixed values.
    soft_min: int = 3000
    target_min: int = 8000
    target_max: int = 30000
    hard_max: int = 45000
    max_chapters: int = MAX_CHAPTERS


_KEYED_BY = {"CANTO": "book_key", "SCENE": "act_key", "ACT": "act_key"}


class _Book:
    """Unit arrays of one book and the group questions they answer.

    A group is a run of units, so it is kept as (first, last, reason, promoted), and
    every question about it is a difference of running counts or a jump table.
    """

    def __init__(self, units: dict[str, np.ndarray]):
        self.role = units["role"]
        self.total = np.concatenate([[0], np.cumsum(units["size"].astype("int64"))])
        self.flexible = np.concatenate([[0], np.cumsum([r in titles.FLEXIBLE_ROLES for r in self.role])])
        self.canto = np.concatenate([[0], np.cumsum(self.role == "CANTO")])
        self.values = {c: units[c] for c in ("parent", "direct", "act_key", "book_key")}
        self.jump = {c: self._next_named(v) for c, v in self.values.items()}

    @staticmethod
    def _next_named(values: np.ndarray) -> np.ndarray:
        named = np.array([isinstance(v, str) and bool(v.strip()) for v in values])
        where = np.where(named, np.arange(len(values)), len(values))
        return np.minimum.accumulate(where[::-1])[::-1]

    def first_of(self, column: str, group) -> str | None:
        at = self.jump[column][group[0]]
        return self.values[column][at] if at <= group[1] else None

    def size(self, group) -> int:
        return int(self.total[group[1] + 1] - self.total[group[0]])

    def holds(self, counts: np.ndarray, group) -> bool:
        return counts[group[1] + 1] > counts[group[0]]

    def group_role(self, group) -> str:
        if group[2] == "PROMOTE_SCENE_TO_ACT":
            return "ACT"
        return "CANTO" if self.holds(self.canto, group) else self.role[group[0]]

    def broad_key(self, group) -> tuple[str, str]:
        return self.group_role(group), self.first_of("parent", group) or "ROOT"

    def close_key(self, group) -> tuple[str, str]:
        role = self.group_role(group)
        named = self.first_of(_KEYED_BY.get(role, "direct"), group)
        return (role, named) if named else self.broad_key(group)

    def related(self, left, right) -> bool:
        parent = self.first_of("parent", left)
        if parent is not None and parent == self.first_of("parent", right):
            return True
        return self.holds(self.flexible, left) or self.holds(self.flexible, right)


def _joined(left, right, reason: str):
    return left[0], right[1], reason, left[3] if left[3] is not None else right[3]


def pair_short(book: _Book, groups: list, limits: Limits) -> list:
    """One pass: a short group takes its next neighbour; a pair is left alone after that."""
    ceiling = max(limits.target_max, limits.hard_max)
    result, rest = [], iter(range(len(groups)))
    for i in rest:
        here = groups[i]
        if i + 1 < len(groups) and book.size(here) < limits.soft_min:
            there = groups[i + 1]
            if book.related(here, there) and book.size(here) + book.size(there) <= ceiling:
                untouched = here[2] == there[2] == "KEEP_AS_IS"
                result.append(_joined(here, there, "MERGE_SHORT_SIBLINGS" if untouched else "GROUP_SMALL_UNITS"))
                next(rest)
                continue
        result.append(here)
    return result


def bundle(book: _Book, groups: list, limits: Limits, key) -> list:
    """Gather neighbours until a bundle is big enough and the key changes, or it is full."""
    result: list = []
    last_key = None
    for group in groups:
        group_key = key(group)
        size = book.size(result[-1]) if result else 0
        closed = size >= limits.target_min and (group_key != last_key or size >= limits.target_max)
        if not result or closed:
            result.append(group)
        else:
            cantos = book.holds(book.canto, result[-1]) or book.holds(book.canto, group)
            result[-1] = _joined(result[-1], group, "GROUP_CANTOS" if cantos else "PROMOTE_TO_PARENT")
        last_key = group_key
    return result


def split_large(book: _Book, groups: list, limits: Limits) -> list:
    """Cut groups above the hard limit into runs that close once they are full."""
    result = []
    for group in groups:
        first, last, _, promoted = group
        if book.size(group) <= limits.hard_max or first == last:
            result.append(group)
            continue
        start = first
        for unit in range(first, last + 1):
            if unit > start and book.total[unit] - book.total[start] >= limits.target_max:
                result.append((start, unit - 1, "GROUP_SMALL_UNITS", promoted))
                start = unit
        result.append((start, last, "GROUP_SMALL_UNITS", promoted))
    return result


def _start(units: dict[str, np.ndarray]) -> list:
    numbers, acts = units["group_no"], units["act"]
    firsts = np.flatnonzero(np.diff(numbers, prepend=numbers[0] - 1))
    lasts = np.append(firsts[1:] - 1, len(numbers) - 1)
    return [
        (int(f), int(t), "PROMOTE_SCENE_TO_ACT" if isinstance(acts[f], str) else "KEEP_AS_IS",
         acts[f] if isinstance(acts[f], str) else None)
        for f, t in zip(firsts, lasts)
    ]


def _plan(units: dict[str, np.ndarray], limits: Limits, steps: tuple[str, ...]) -> list:
    """Groups of one book, whose units come in order."""
    book = _Book(units)
    groups = _start(units)
    if "pair" in steps:
        groups = pair_short(book, groups, limits)
    if "bundle" in steps:
        for key in (book.close_key, book.broad_key):
            if len(groups) > limits.max_chapters:
                groups = pair_short(book, bundle(book, groups, limits, key), limits)
    if "split" in steps:
        groups = split_large(book, groups, limits)
    return groups


def _planned(units: pd.DataFrame, limits: Limits, steps: tuple[str, ...]) -> pd.DataFrame:
    """Rows of whole books, in the order of book and unit, with the group of each."""
    columns = {c: units[c].to_numpy(dtype=object if units[c].dtype == object else None) for c in units.columns}
    edges = [*np.flatnonzero(np.diff(columns["book_id"], prepend=columns["book_id"][0] - 1)), len(units)]
    numbers, sizes, reasons, promoted = [], [], [], []
    for first, end in zip(edges, edges[1:]):
        groups = _plan({c: values[first:end] for c, values in columns.items()}, limits, steps)
        numbers += range(1, len(groups) + 1)
        sizes += [last - start + 1 for start, last, _, _ in groups]
        reasons += [g[2] for g in groups]
        promoted += [g[3] for g in groups]
    return pd.DataFrame(
        {
            "book_id": columns["book_id"],
            "unit_no": columns["unit_no"],
            "group_no": np.repeat(np.array(numbers), sizes),
            "reason": np.repeat(np.array(reasons, dtype=object), sizes),
            "promoted": np.repeat(np.array(promoted, dtype=object), sizes),
        }
    )


def _whole_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by book, cut between books."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        at = int(np.searchsorted(batch["book_id"].to_numpy(), batch["book_id"].iloc[-1]))
        if at or (held and held[-1]["book_id"].iloc[-1] != batch["book_id"].iloc[0]):
            yield pd.concat([*held, batch.iloc[:at]], ignore_index=True)
            held = []
        held.append(batch.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def plan_groups(
    units: DataFrame, limits: Limits = Limits(), steps: tuple[str, ...] = ("pair", "bundle", "split")
) -> DataFrame:
    """Group number, reason and promoted title of each kept unit."""
    path = F.col("path")
    described = act_groups(kept_units(units)).select(
        "book_id",
        "unit_no",
        "group_no",
        "act",
        "role",
        "size",
        titles.meaningful_ancestor(path).alias("parent"),
        titles.direct_parent(path).alias("direct"),
        titles.ancestor_with_prefix(path, "act ").alias("act_key"),
        titles.ancestor_with_prefix(path, "book ").alias("book_key"),
    )

    def per_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for books in _whole_books(batches):
            if len(books):
                yield _planned(books, limits, steps)

    # Books are many and short: a task takes its books in one sorted run, not one call per book.
    in_order = spread(described.filter("book_id IS NOT NULL"), "book_id").sortWithinPartitions("book_id", "unit_no")
    planned = in_order.mapInPandas(per_books, "book_id long, unit_no int, group_no int, reason string, promoted string")
    return units.drop("group_no", "reason", "promoted").join(planned, ["book_id", "unit_no"], "inner")


def plan_chapters(units: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Units with the chapter each one belongs to."""
    return cap_groups(plan_groups(units, limits), limits.max_chapters)
