"""Components and their task ids.

A component is one named stage with ``lanes`` parallel tasks. Task ids follow
declaration order: ``index * lanes + lane + 1``. Lanes are data (a column), not
physical partitions, so results do not depend on how Spark partitions the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopline.functions.clock import WallClock


@dataclass(frozen=True)
class Component:
    name: str
    index: int
    lanes: int = 16
    seed: int = 42
    clock: object = field(default_factory=WallClock)

    def task(self, lane: Column) -> Column:
        return (F.lit(self.index * self.lanes + 1) + lane).cast("bigint")

    def element(self, lane: Column) -> Column:
        """The path element ``<component>:<task>`` of this component's task."""
        return F.concat(F.lit(self.name + ":"), self.task(lane).cast("string"))


class Topology:
    """Hands out components in declaration order with shared lanes, seed and clock (by default the wall clock)."""

    def __init__(self, lanes: int = 16, seed: int = 42, clock=None):
        self.lanes, self.seed = lanes, seed
        self.clock = clock if clock is not None else WallClock()
        self._names: list[str] = []

    def component(self, name: str) -> Component:
        if name in self._names:
            raise ValueError(f"component {name!r} declared twice")
        self._names.append(name)
        return Component(name, len(self._names) - 1, self.lanes, self.seed, self.clock)

    @property
    def names(self) -> list[str]:
        return list(self._names)


class Routed:
    """Several components fed by one DataFrame, chosen per row by its ``stream``.

    Lets two sibling stages (e.g. two senders behind a split) run as one
    projection over a single pass instead of two filtered copies of the input.
    """

    def __init__(self, routes: dict[str, Component], stream_col: str = "stream"):
        if not routes:
            raise ValueError("no routes")
        self.routes = routes
        first = next(iter(routes.values()))
        self.lanes, self.seed, self.clock = first.lanes, first.seed, first.clock
        s = F.col(stream_col)
        name = index = None
        for stream, comp in routes.items():
            name = F.when(s == stream, F.lit(comp.name)) if name is None else name.when(s == stream, F.lit(comp.name))
            index = F.when(s == stream, F.lit(comp.index)) if index is None else index.when(s == stream, F.lit(comp.index))
        self.name, self.index = name, index

    def task(self, lane: Column) -> Column:
        return (self.index * F.lit(self.lanes) + F.lit(1) + lane).cast("bigint")

    def element(self, lane: Column) -> Column:
        return F.concat(self.name, F.lit(":"), self.task(lane).cast("string"))


def name_col(comp) -> Column:
    return comp.name if isinstance(comp.name, Column) else F.lit(comp.name)
