"""Values that handlers share, found by their type."""

from __future__ import annotations

from typing import TypeVar

V = TypeVar("V")


class Context:
    """One value for each type. Derived contexts don't change the one they come from."""

    def __init__(self, *values: object):
        self._values = {type(v): v for v in values}

    def __len__(self) -> int:
        return len(self._values)

    def __contains__(self, kind: type) -> bool:
        return kind in self._values

    def get(self, kind: type[V]) -> V | None:
        return self._values.get(kind)

    def __getitem__(self, kind: type[V]) -> V:
        """The value of that very type; KeyError if there is none."""
        return self._values[kind]

    def having(self, value: object) -> Context:
        """A context with the value too, in place of one of its type."""
        return Context(*(v for k, v in self._values.items() if k is not type(value)), value)

    def without(self, kind: type) -> Context:
        return Context(*(v for k, v in self._values.items() if k is not kind))
