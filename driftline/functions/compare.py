"""Column builders that explain a difference between desired and observed values.

Each returns a never-null ``array<string>`` of reasons; an empty array means no
drift. There are three kinds of "nothing" and they stay apart: null, the unset
value of a field (``''`` or ``0``), and an absent map key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out a single time per row."""
    return F.transform(F.array(value), body)[0]


def no_reasons() -> Column:
    return F.array().cast("array<string>")


def reason(condition: Column, name: str | Column) -> Column:
    """``[name]`` where the condition holds, else ``[]`` (also when it is null)."""
    label = name if isinstance(name, Column) else F.lit(name)
    return F.when(condition, F.array(label)).otherwise(no_reasons())


def field_diff(desired: Column, observed: Column, name: str) -> Column:
    """A text field that is always compared; null reads as the empty text."""
    return reason(F.coalesce(desired, F.lit("")) != F.coalesce(observed, F.lit("")), name)


def sparse_diff(desired: Column, observed: Column, name: str, unset: str | int = "") -> Column:
    """A field that is compared only where the desired side sets it."""
    blank = F.lit(unset)
    wanted = F.coalesce(desired, blank)
    return reason((wanted != blank) & (wanted != F.coalesce(observed, blank)), name)


def map_subset_diff(desired: Column, observed: Column, prefix: str = "property") -> Column:
    """Desired keys that are absent from the observed map or hold another value.

    A null desired value accepts any value but still wants the key; observed
    null reads as ``''``; keys only the observed side has are ignored. Sorted.
    """
    empty = F.create_map().cast("map<string,string>")
    have = F.coalesce(observed, empty)
    differing = F.map_filter(
        F.coalesce(desired, empty),
        lambda k, v: ~F.map_contains_key(have, k)
        | (v.isNotNull() & (v != F.coalesce(F.try_element_at(have, k), F.lit("")))),
    )
    return F.transform(
        F.array_sort(F.map_keys(differing)), lambda k: F.concat(F.lit(f"{prefix}:"), k)
    )


def list_size(items: Column) -> Column:
    return F.when(items.isNull(), F.lit(0)).otherwise(F.size(items))


def named_list_diff(desired: Column, observed: Column, prefix: str = "parameter") -> Column:
    """Compare two lists of named entries held inside one row.

    The sizes must match (entries without a body count), every desired name must
    exist, and value and description differ only where both sides state them. Of
    several observed entries with one name the last counts. A null name reads as ``''``.

    Both lists are sorted by name as one, where the observed entry that counts stands right
    before the desired one, so that long lists take n log n. Only a name that the desired side
    repeats looks further back.
    """
    text = lambda c: F.coalesce(c, F.lit(""))

    def entry(name: Column, side: int, at: Column, value: Column, about: Column) -> Column:
        return F.struct(
            text(name).alias("name"), F.lit(side).alias("side"), at.alias("at"),
            value.cast("string").alias("value"), about.cast("string").alias("about"),
        )

    wanted = F.transform(desired, lambda d, i: entry(d["name"], 1, i, d["value"], d["description"]))
    have = F.filter(
        F.transform(observed, lambda o, i: F.when(
            o["parameter"].isNotNull(),
            entry(o["parameter"]["name"], 0, i, o["parameter"]["value"], o["parameter"]["description"]),
        )),
        lambda e: e.isNotNull(),
    )
    nobody = F.filter(wanted, lambda e: F.lit(False))

    def found(entries: Column) -> Column:
        def reasons(want: Column, j: Column) -> Column:
            label = lambda suffix: F.concat(F.lit(f"{prefix}{suffix}:"), want["name"])

            def against(before: Column) -> Column:
                last = F.when(
                    (before["side"] == 1) & (before["name"] == want["name"]),
                    F.try_element_at(F.filter(entries, lambda e: (e["side"] == 0) & (e["name"] == want["name"])), F.lit(-1)),
                ).otherwise(before)

                def compared(last: Column) -> Column:
                    absent = last.isNull() | (last["name"] != want["name"])
                    return F.when(absent, F.array(label(""))).otherwise(F.concat(
                        reason(want["value"] != last["value"], label("_value")),
                        reason((text(want["about"]) != "") & (text(want["about"]) != last["about"]), label("_description")),
                    ))

                return once(last, compared)

            return F.struct(want["side"].alias("side"), want["at"].alias("at"), once(F.get(entries, j - 1), against).alias("why"))

        listed = F.filter(F.transform(entries, reasons), lambda r: r["side"] == 1)
        return F.flatten(F.transform(F.array_sort(listed), lambda r: r["why"]))

    entries = F.array_sort(F.concat(F.coalesce(have, nobody), F.coalesce(wanted, nobody)))
    return F.concat(
        reason(list_size(desired) != list_size(observed), f"{prefix}_count"),
        F.coalesce(once(entries, found), no_reasons()),
    )


def state_fold_equal(desired: Column, observed: Column) -> Column:
    """Equality of two state names without regard to case; null reads as ``''``."""
    return F.lower(F.coalesce(desired, F.lit(""))) == F.lower(F.coalesce(observed, F.lit("")))


def state_exact_equal(desired: Column, observed: Column) -> Column:
    """Equality of two state names, case included; null reads as ``''``."""
    return F.coalesce(desired, F.lit("")) == F.coalesce(observed, F.lit(""))


def count_vs_state(state: Column, running: Column, stopped: Column) -> Column:
    """A desired group state against the counts of its children; null counts are 0."""
    return F.concat(
        reason((state == "RUNNING") & (F.coalesce(stopped, F.lit(0)) > 0), "stopped_count"),
        reason((state == "STOPPED") & (F.coalesce(running, F.lit(0)) > 0), "running_count"),
    )
