"""Helpers for lists and names: as column expressions, and as plain containers for the driver's configuration."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator, MutableMapping, MutableSet

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- columns --------------------------------------------------------------------


def as_array(c: Column, is_array: bool) -> Column:
    """A value as an array of itself; null as an empty one."""
    return F.coalesce(c, F.array().cast("array<string>")) if is_array else F.when(c.isNull(), F.array()).otherwise(F.array(c))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def filter_ordered(a: Column) -> Column:
    """Distinct elements at their first places."""
    return F.array_distinct(a)


def chunks(a: Column, n: int) -> Column:
    """An array in arrays of at most ``n`` elements."""
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int")), lambda k: F.slice(a, k * n + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def runs(a: Column) -> Column:
    """Neighbouring equal elements together: an array of (value, n)."""
    start = F.array().cast("array<struct<value:string,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(last["value"].eqNullSafe(x) & (F.size(acc) > 0), F.lit(False))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x.alias("value"), (last["n"] + 1).alias("n"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("value"), F.lit(1).alias("n")))))

    return F.aggregate(a, start, step)


def replace_windowed(a: Column, window: Column, by: Column) -> Column:
    """Each non-overlapping occurrence of ``window`` in an array replaced by the elements of ``by``, from the left."""
    n = F.size(window)
    out = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(acc: Column, k: Column) -> Column:
        here = (n > 0) & (k + n - 1 <= F.size(a)) & (F.slice(a, k, n) == window)
        return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))).when(here, F.struct(F.concat(acc["out"], by).alias("out"), (n - 1).alias("skip"))).otherwise(F.struct(F.concat(acc["out"], F.slice(a, k, F.lit(1))).alias("out"), F.lit(0).alias("skip")))

    return F.when(F.size(a) > 0, F.aggregate(F.sequence(F.lit(1), F.size(a)), out, step)["out"]).otherwise(a)


def search_sorted(a: Column, x: Column) -> Column:
    """How many elements of a sorted array come before ``x``."""
    return F.size(F.filter(a, lambda y: y < x))


# --- plain ------------------------------------------------------------------------


def flatten(x) -> list:
    """The leaves of nested lists and tuples; strings are leaves."""
    return [z for y in x for z in (flatten(y) if isinstance(y, (list, tuple, set)) else [y])]


class CaseInsensitiveDict(MutableMapping):
    """Keys compared in lower case; iteration gives them in that form, in order of insertion."""

    def __init__(self, *args, default=None, **kwargs):
        self._data, self._default = {}, default
        self.update(*args, **kwargs)

    def __getitem__(self, key: str):
        low = key.lower()
        if low not in self._data and self._default is not None:
            self._data[low] = self._default()
        return self._data[low]

    def __setitem__(self, key: str, value) -> None:
        self._data[key.lower()] = value

    def __delitem__(self, key: str) -> None:
        del self._data[key.lower()]

    def __contains__(self, key) -> bool:
        return isinstance(key, str) and key.lower() in self._data

    def __iter__(self) -> Iterator[str]:
        return iter(self._data)

    def __len__(self) -> int:
        return len(self._data)


class OrderedSet(MutableSet):
    """A set that keeps the order of first insertion."""

    def __init__(self, items: Iterable = ()):
        self._data = dict.fromkeys(items)

    def __contains__(self, x) -> bool:
        return x in self._data

    def __iter__(self):
        return iter(self._data)

    def __len__(self) -> int:
        return len(self._data)

    def add(self, x) -> None:
        self._data[x] = None

    def discard(self, x) -> None:
        self._data.pop(x, None)


@contextlib.contextmanager
def override(target: dict, changes: dict):
    """``changes`` hold in ``target`` within the context; what was there comes back."""
    before = {k: target[k] for k in changes if k in target}
    target.update(changes)
    try:
        yield target
    finally:
        for k in changes:
            if k in before:
                target[k] = before[k]
            else:
                target.pop(k, None)
