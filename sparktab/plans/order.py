"""Sort keys: direction, loose order of text, and chains of keys."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from functools import cmp_to_key

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktab.errors import QueryException
from sparktab.functions.compare import family
from sparktab.functions.text import number_in
from sparktab.shared import materialize


class Direction(Enum):
    ASC = "asc"
    DESC = "desc"

    @classmethod
    def parse(cls, value) -> Direction:
        key = value if isinstance(value, Direction) else str(value).strip().lower()
        if key in (cls.ASC, "asc", "ascending", "up", "4"):
            return cls.ASC
        if key in (cls.DESC, "desc", "descending", "down", "3"):
            return cls.DESC
        raise QueryException(f"unknown direction {value!r}")


@dataclass(frozen=True)
class SortOn:
    """One key. key: `Column -> Column`, applied before sorting; a callback on values is a Python UDF that returns text.

    Text sorts with numbers first, by value, then other text bytewise; numeric=False sorts it bytewise.
    """

    column: str | int
    direction: Direction | str = Direction.ASC
    key: Callable[[Column], Column] | None = None
    numeric: bool = True

    def __post_init__(self):
        object.__setattr__(self, "direction", Direction.parse(self.direction))

    def prepared(self, table, name: str):
        return table, self

    def columns(self, table) -> list[Column]:
        c, kind = table.resolve(self.column)
        parts = [c]
        if self.key is not None:
            parts = [self.key(c)]
        elif self.numeric and family(kind) == "text":
            parts = [F.when(c.isNotNull(), number_in(c).isNull().cast("int")), number_in(c), c]
        return [p.asc_nulls_first() if self.direction is Direction.ASC else p.desc_nulls_last() for p in parts]


#: Distinct values that a task ranks by a comparator.
RANKED = 100_000


@dataclass(frozen=True)
class CompareOn:
    """One key in the order of a comparator `(a, b) -> int` on values.

    Only the distinct values are compared: they are divided by a sorted sample of them, each part is
    ranked by one task, and the ranks are joined to the records. Values that compare as equal tie.
    """

    column: str | int
    comparator: Callable
    direction: Direction | str = Direction.ASC

    def __post_init__(self):
        object.__setattr__(self, "direction", Direction.parse(self.direction))

    def prepared(self, table, name: str):
        """The table with the rank of each value in a column, and the key on it."""
        c, kind = table.resolve(self.column)
        values = materialize(table.df.select(c.alias("value")).distinct(), "values")
        parts = max(1, values.count() // RANKED)
        comparator = self.comparator
        sample = [r[0] for r in values.orderBy(F.xxhash64("value")).limit(20 * parts).collect()] if parts > 1 else []
        bounds = sorted(sample, key=cmp_to_key(comparator))[20::20]

        def divided(batches):
            compare = cmp_to_key(comparator)
            keys = [compare(v) for v in bounds]
            for pdf in batches:
                pdf["part"] = [bisect_right(keys, compare(v)) for v in pdf["value"].astype(object).where(pdf["value"].notna(), None)]
                yield pdf

        def ranked(pdf):
            compare = cmp_to_key(comparator)
            keys = [compare(v) for v in pdf["value"].astype(object).where(pdf["value"].notna(), None)]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            rank, ranks = 0, [0] * len(keys)
            for before, i in zip([None, *order], order, strict=False):
                rank += before is not None and keys[before] < keys[i]
                ranks[i] = rank
            pdf["rank"] = ranks
            return pdf

        inner = kind.simpleString()
        found = values.mapInPandas(divided, f"value {inner}, part long").groupBy("part").applyInPandas(ranked, f"value {inner}, part long, rank long")
        ranks = materialize(found.select(F.col("value").alias("__value"), F.struct("part", "rank").alias(name)), "ranks")
        joined = table.df.join(ranks, c.eqNullSafe(F.col("__value")), "left").drop("__value")
        return table._with(joined), _Ranked(name, self.direction)

    def columns(self, table) -> list[Column]:
        raise QueryException("a comparator sorts a table, not a plan: use Table.sorted")


@dataclass(frozen=True)
class _Ranked:
    name: str
    direction: Direction

    def columns(self, table) -> list[Column]:
        return [F.col(self.name).asc() if self.direction is Direction.ASC else F.col(self.name).desc()]


@dataclass(frozen=True)
class MultiSort:
    """Keys in order of priority."""

    keys: tuple = ()

    @classmethod
    def all(cls, *keys) -> MultiSort:
        return cls(keys)

    def append(self, *keys) -> MultiSort:
        return MultiSort(self.keys + keys)

    def prepend(self, *keys) -> MultiSort:
        return MultiSort(keys + self.keys)

    def prepared(self, table, name: str):
        return table, self

    def columns(self, table) -> list[Column]:
        return [c for k in self.keys for c in k.columns(table)]
