"""Array and map functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_in(a: Column, b: Column, b_is_text: bool = False) -> Column:
    """Some element of ``a`` is in ``b`` (an array, or a text that contains it); false for an empty ``a``."""
    return F.exists(a, lambda x: F.contains(b, x) if b_is_text else F.array_contains(b, x))


def all_in(a: Column, b: Column, b_is_text: bool = False) -> Column:
    """Every element of ``a`` is in ``b``; true for an empty ``a``."""
    return F.forall(a, lambda x: F.contains(b, x) if b_is_text else F.array_contains(b, x))


def match_difference(a: Column, b: Column) -> Column:
    """Sum of absolute differences; the query fails for unequal lengths or empty arrays."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.raise_error(F.lit("arrays must have the same length above 0")).cast("double"))


def fill_from(a: Column, b: Column, positions: Column) -> Column:
    """``a`` with the elements of ``b`` at ``positions`` (0-based, of the result) put in.

    The query fails unless there are as many positions as ``b`` is longer than ``a``.
    """
    # the n-th element that is not filled comes from a; n counts the free places before it
    free = lambda i: i - F.size(F.filter(positions, lambda p: p < i))
    filled = F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.when(F.array_contains(positions, i), F.get(b, i)).otherwise(F.get(a, free(i))))
    return F.when(F.size(positions) == F.size(b) - F.size(a), F.when(F.size(b) == 0, b).otherwise(filled)).otherwise(F.raise_error(F.lit("positions must be len(b) - len(a)")).cast("array<double>"))


def updated(original: Column, update: Column) -> Column:
    """A map with the entries of ``update`` in place of those of the same key."""
    kept = F.map_filter(original, lambda k, _: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def attribute(values: Column, name: str, default: Column | None = None) -> Column:
    """One field of every struct or map; missing ones give the default, or fail the query."""
    def take(x: Column) -> Column:
        if default is not None:
            return F.coalesce(x[name], default)
        return F.coalesce(x[name], F.raise_error(F.lit(f"missing {name}")))
    return F.transform(values, take)


def flattened(lists: Column) -> Column:
    """One array of all elements of an array of arrays, in order; null lists count as empty."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def offsets(start: Column, widths: Column) -> Column:
    """Positions from a start and the widths after it: running sums."""
    sums = F.aggregate(widths, F.array(start), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))
    return F.when(widths.isNotNull(), sums)
