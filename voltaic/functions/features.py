"""The list of active features, from switches by group."""

from __future__ import annotations

from collections.abc import Mapping

#: Features that stand for more than one column.
EXPANDED = {"hour_cyclical": ["hour_sin", "hour_cos"]}


def active(*groups: Mapping[str, bool]) -> list[str]:
    """Columns of the features that are switched on, group after group, in the order of each."""
    return [column for group in groups for name, on in group.items() if on for column in EXPANDED.get(name, [name])]
