"""Lazy relations with positions: what selections, vectors and scalars stand on.

A base relation is one version of a table; its columns get names of their own, so that a table may meet itself.
Filters and joins are kept as descriptions and become a DataFrame when one is asked for.  Positions are only
computed when something needs them, so that plain queries push their filters and columns down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.storage import POS, numbered

if TYPE_CHECKING:
    from quern.sources.catalog import Table

_ids = count()
Expr = Callable[[Callable[[str], Column]], Column]

JOIN_HINTS = {"hash": "shuffle_hash", "grace-hash": "merge", "nested-loop": None}


class Relation:
    """Rows of one or more table versions side by side."""

    bases: dict[int, tuple[Table, tuple[int, int, int]]]

    def frame(self, positions: bool = False) -> DataFrame:
        raise NotImplementedError

    @cached_property
    def plain(self) -> DataFrame:
        return self.frame(False)

    @cached_property
    def placed(self) -> DataFrame:
        return self.frame(True)

    @cached_property
    def size(self) -> int:
        """The number of rows, counted once; a relation is of fixed versions."""
        return self.plain.count()


class Base(Relation):
    def __init__(self, table: Table):
        self.table, self.id = table, next(_ids)
        self.source = table.current()
        self.version = table.version
        self.bases = {self.id: (table, table.state)}

    def frame(self, positions: bool = False) -> DataFrame:
        df = self.source.frame(positions)
        return df.select(*[F.col(c).alias(f"b{self.id}_{c}") for c in df.columns if positions or c != POS])


class Filter(Relation):
    """Rows of a relation that a condition on it keeps; span is (column, low, high) where it is a range of a base's column."""

    def __init__(self, below: Relation, make: Expr, pure: Expr | None, span: tuple | None = None):
        self.below, self.make, self.pure, self.span, self.bases = below, make, pure, span, below.bases

    def frame(self, positions: bool = False) -> DataFrame:
        return (self.below.placed if positions else self.below.plain).where(self.make(F.col))


class Joined(Relation):
    """Pairs of rows of two relations with equal keys."""

    def __init__(self, left: Relation, left_key: Column, right: Relation, right_key: Expr, algorithm: str):
        self.left, self.right, self.left_key, self.hint = left, right, left_key, JOIN_HINTS[algorithm]
        self.renamed = {b: next(_ids) for b in right.bases}
        self.right_key = right_key(lambda name: F.col(self._other(name)))
        self.bases = left.bases | {self.renamed[b]: v for b, v in right.bases.items()}

    def _other(self, name: str) -> str:
        base, _, rest = name.partition("_")
        return f"b{self.renamed[int(base[1:])]}_{rest}"

    def frame(self, positions: bool = False) -> DataFrame:
        left, right = (self.left.placed, self.right.placed) if positions else (self.left.plain, self.right.plain)
        right = right.select(*[F.col(c).alias(self._other(c)) for c in right.columns])
        if self.hint:
            right = right.hint(self.hint)
        return left.join(right, self.left_key == self.right_key)


class Zipped(Relation):
    """Rows of two relations of the same length, put together by their ordinals in position order."""

    def __init__(self, left: Relation, left_side: int, right: Relation, right_side: int):
        self.left, self.right, self.sides = left, right, (left_side, right_side)
        self.renamed = {b: next(_ids) for b in right.bases}
        self.bases = left.bases | {self.renamed[b]: v for b, v in right.bases.items()}

    _other = Joined._other

    def frame(self, positions: bool = False) -> DataFrame:
        left = numbered(self.left.placed, f"b{self.sides[0]}_{POS}", name="__n")
        right = numbered(self.right.placed, f"b{self.sides[1]}_{POS}", name="__n")
        right = right.select("__n", *[F.col(c).alias(self._other(c)) for c in right.columns if c != "__n"])
        return left.join(right, "__n").drop("__n")


class Gathered(Relation):
    """A relation beside the rows of a table version that stand at one of its sides' positions."""

    def __init__(self, below: Relation, side: int, table: Table):
        self.below, self.side, self.base = below, side, Base(table)
        self.bases = below.bases | self.base.bases

    def frame(self, positions: bool = False) -> DataFrame:
        here = f"b{self.base.id}_{POS}"
        return self.below.placed.join(self.base.placed, F.col(f"b{self.side}_{POS}") == F.col(here))


@dataclass(frozen=True)
class Selection:
    """Positions of a table: rows of a relation, seen from the side of one of its bases."""

    rel: Relation
    side: int

    @property
    def table(self) -> Table:
        return self.rel.bases[self.side][0]

    def pure(self) -> Expr | None:
        """The condition on the table's columns alone, if that is all there is to it and no row has come or changed since."""
        if self.rel.bases[self.side][1] != self.table.state:
            return None
        if isinstance(self.rel, Base):
            return lambda col: F.lit(True)
        return self.rel.pure if isinstance(self.rel, Filter) else None


@dataclass(frozen=True)
class Vector:
    """Values of a relation's rows, in the order of one side's positions."""

    rel: Relation
    side: int
    name: str | None
    make: Expr
    kind: str = "long"

    @property
    def expr(self) -> Column:
        return self.make(F.col)

    def frame(self, name: str = "v") -> DataFrame:
        return self.rel.plain.select(self.expr.alias(name))

    def ordered(self) -> DataFrame:
        return self.rel.placed.select(F.col(f"b{self.side}_{POS}").alias(POS), self.expr.alias("v")).orderBy(POS)


@dataclass
class Scalar:
    """One number: an aggregate of a vector, or a selection's size.

    Sums and averages of nothing are 0, as the engine has it; those that are not `zero` are null, as SQL has it.
    """

    how: str
    rel: Relation
    make: Expr
    integral: bool = True
    known: list = field(default_factory=list)
    zero: bool = True

    def as_sql(self) -> Scalar:
        """The same number, but null where there is nothing to add up."""
        return Scalar(self.how, self.rel, self.make, self.integral, zero=False)

    def aggregate(self, guard: Column | None = None, col: Callable[[str], Column] = F.col) -> Column:
        """The aggregate, over the rows that guard lets in."""
        value = self.make(col)
        if guard is not None:
            value = F.when(guard, value)
        if self.how == "count":
            return F.count(value)
        if self.how == "sum":
            return F.coalesce(F.sum(value), F.lit(0 if self.integral else 0.0)) if self.zero else F.sum(value)
        if self.how == "avg":
            return F.coalesce(F.avg(value), F.lit(0.0)) if self.zero else F.avg(value)
        return {"min": F.min, "max": F.max}[self.how](value)

    def frame(self, name: str = "v") -> DataFrame:
        return self.rel.plain.agg(self.aggregate().alias(name))

    @property
    def value(self):
        if not self.known:
            self.known.append(self.frame().first()[0])
        return self.known[0]
