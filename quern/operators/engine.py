"""The positional query surface as a Python API; every result is lazy until it is printed, counted or saved."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StructField, StructType

from quern.errors import LengthMismatch, QuernError, TypeMismatch, UnknownName
from quern.operators.relation import JOIN_HINTS, Base, Filter, Gathered, Joined, Relation, Scalar, Selection, Vector, Zipped
from quern.sources import csvfile
from quern.sources.catalog import Database, Table
from quern.sources.storage import POS, numbered, stored

INTEGRAL = (ByteType, ShortType, IntegerType, LongType)


def in_range(value: Column, low, high) -> Column:
    """low <= value < high; None leaves a side open, nulls are outside."""
    condition = value.isNotNull()
    if low is not None or high is not None:
        condition = F.lit(True)
    if low is not None:
        condition = condition & (value >= F.lit(low))
    if high is not None:
        condition = condition & (value < F.lit(high))
    return condition


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self.db: Database | None = Database.open(spark, path) if path else None

    # ---- tables

    def create_db(self, name: str) -> Database:
        """A new database; it takes the place of the current one."""
        self.db = Database(self.spark, name, self.path)
        return self.db

    def _db(self, name: str | None = None) -> Database:
        if self.db is None or (name is not None and self.db.name != name):
            raise UnknownName(f"no database {name or ''}".strip())
        return self.db

    def resolve(self, qualified: str) -> tuple[Table, str | None]:
        """The table, and the column if one is named, of db.table or db.table.column."""
        parts = qualified.split(".")
        if len(parts) not in (2, 3):
            raise UnknownName(f"{qualified} is neither db.table nor db.table.column")
        db = self._db(parts[0])
        return (db.table(parts[1]), None) if len(parts) == 2 else db.column(parts[1], parts[2])

    def create_table(self, name: str, db: str, width: int) -> Table:
        return self._db(db).create_table(name, width)

    def create_column(self, name: str, table: str, kind: DataType | None = None) -> None:
        self.resolve(table)[0].add_column(name, kind)

    def create_index(self, qualified: str, kind: str, clustered: bool) -> None:
        """A layout for the table's files: a clustered index orders them by its column. Results are the same without."""
        table, name = self.resolve(qualified)
        if name is None:
            raise UnknownName(f"{qualified} names no column")
        if kind not in ("btree", "sorted"):
            raise QuernError(f"unknown index {kind}")
        if clustered and any(whole for _, whole in table.indexes.values()):
            raise QuernError(f"table {table.name} has a clustered index")
        table.indexes[name] = (kind, clustered)

    def register(self, name: str, df: DataFrame) -> Table:
        if self.db is None:
            self.create_db("db")
        return self.db.register(name, df)

    def load(self, path: str) -> Table:
        """Replace the rows of the table whose columns the file's header names."""
        names = csvfile.header(self.spark, path)
        found = [self.resolve(n) for n in names]
        if not found or any(c is None for _, c in found):
            raise UnknownName(f"the header of {PurePosixPath(path).name} does not name columns")
        table = found[0][0]
        if any(t is not table for t, _ in found) or sorted(c for _, c in found) != sorted(table.columns):
            raise QuernError("a file loads all columns of one table")
        columns = [c for _, c in found]
        df = csvfile.read(self.spark, path, columns, [table.schema[c].dataType for c in columns])
        placed = stored(numbered(df.select(*table.columns)), table.name)
        table.replace(placed, placed.count())
        return table

    def insert(self, table: str, values: Sequence) -> None:
        self.resolve(table)[0].insert(tuple(values))

    def _marked(self, selection: Selection, table: Table) -> tuple[DataFrame, Column, list[str]]:
        """The current rows of a table, which of them are selected, and the table's columns."""
        if selection.table is not table:
            raise TypeMismatch("the positions are another table's")
        pure = selection.pure()  # rows that were inserted since are in no older selection, whatever their values
        table.current()
        df = table.with_positions()
        if pure is not None:
            return df, F.coalesce(pure(F.col), F.lit(False)), table.columns
        chosen = stored(selection.rel.placed.select(F.col(f"b{selection.side}_{POS}").alias("__hit")).distinct(), "positions")
        return df.join(chosen, F.col(POS) == F.col("__hit"), "left"), F.col("__hit").isNotNull(), table.columns

    def update(self, qualified: str, selection: Selection, value) -> None:
        """Set a column at the selected positions; others keep their values and all their positions."""
        table, name = self.resolve(qualified)
        df, hit, columns = self._marked(selection, table)
        kind = table.schema[name].dataType
        table.replace(df.select(*[F.when(hit, F.lit(value).cast(kind)).otherwise(F.col(c)).alias(c) if c == name else F.col(c) for c in columns], POS))

    def delete(self, qualified: str, selection: Selection) -> None:
        """Drop the selected rows; the others keep their positions."""
        table, _ = self.resolve(qualified)
        df, hit, columns = self._marked(selection, table)
        table.replace(df.where(~hit).select(*columns, POS))

    # ---- queries

    def whole(self, qualified: str) -> Vector:
        """A whole column as a vector."""
        table, name = self.resolve(qualified)
        if name is None:
            raise UnknownName(f"{qualified} names no column")
        base = Base(table)
        return self._column(base, base.id, table, name)

    @staticmethod
    def _column(rel: Relation, side: int, table: Table, name: str) -> Vector:
        kind = "long" if isinstance(table.schema[name].dataType, INTEGRAL) else table.schema[name].dataType.simpleString()
        return Vector(rel, side, name, lambda col: col(f"b{side}_{name}"), kind)

    def select(self, qualified: str, low=None, high=None) -> Selection:
        """Positions whose value is in [low, high)."""
        table, name = self.resolve(qualified)
        if name is None:
            raise UnknownName(f"{qualified} names no column")
        base = Base(table)
        made = lambda col: in_range(col(f"b{base.id}_{name}"), low, high)
        return Selection(Filter(base, made, lambda col: in_range(col(name), low, high), (name, low, high)), base.id)

    def reselect(self, selection: Selection, vector: Vector, low=None, high=None) -> Selection:
        """Of the selected positions those whose value in the vector is in [low, high)."""
        rel = self._together((selection.rel, selection.side), (vector.rel, vector.side))
        pure = None
        if rel is selection.rel and vector.name is not None and vector.side == selection.side and (before := selection.pure()) is not None:
            pure = lambda col: before(col) & in_range(col(vector.name), low, high)
        made = lambda col: in_range(self._right(vector, rel, col), low, high)
        return Selection(Filter(rel, made, pure), selection.side)

    def _together(self, left: tuple[Relation, int], right: tuple[Relation, int]) -> Relation:
        """One relation that holds both: the same one, or rows put together in position order."""
        if left[0] is right[0]:
            return left[0]
        a, b = left[0].size, right[0].size
        if a != b:
            raise LengthMismatch(f"{a} and {b} rows")
        return Zipped(left[0], left[1], right[0], right[1])

    @staticmethod
    def _right(vector: Vector, rel: Relation, col) -> Column:
        """A vector's values in a relation that _together gave, where it was the right one."""
        return vector.make(col if rel is vector.rel else lambda name: col(rel._other(name)))

    def fetch(self, qualified: str, selection: Selection) -> Vector:
        """A column's current values at the selected positions."""
        table, name = self.resolve(qualified)
        if name is None:
            raise UnknownName(f"{qualified} names no column")
        rel, side = selection.rel, selection.side
        of, (version, *_) = rel.bases[side]
        if of is table and version == table.version:  # rows that came since change no others
            return self._column(rel, side, table, name)
        near = Gathered(rel, side, table)
        return Vector(near, side, None, lambda col: col(f"b{near.base.id}_{name}"), self._column(rel, side, table, name).kind)

    def _combined(self, left: Vector, right: Vector, sign: int) -> Vector:
        rel = self._together((left.rel, left.side), (right.rel, right.side))
        wide = "long" if left.kind == right.kind == "long" else "double"

        def make(col):
            x, y = left.make(col).cast(wide), self._right(right, rel, col).cast(wide)
            return x + y if sign > 0 else x - y

        return Vector(rel, left.side, None, make, wide)

    def add(self, left: Vector, right: Vector) -> Vector:
        """Element-wise sums, in 64 bits."""
        return self._combined(left, right, 1)

    def sub(self, left: Vector, right: Vector) -> Vector:
        """Element-wise differences, in 64 bits."""
        return self._combined(left, right, -1)

    def aggregate(self, how: str, vector: Vector) -> Scalar:
        if how not in ("sum", "avg", "min", "max"):
            raise QuernError(f"unknown aggregate {how}")
        wide = how == "sum" and vector.kind == "long"
        return Scalar(how, vector.rel, lambda col: vector.make(col).cast("long") if wide else vector.make(col), vector.kind == "long")

    def count(self, selection: Selection | Vector) -> Scalar:
        return Scalar("count", selection.rel, lambda col: F.lit(1))

    def join(self, left: Vector, left_at: Selection, right: Vector, right_at: Selection, algorithm: str = "hash") -> tuple[Selection, Selection]:
        """Aligned positions of the pairs of rows with equal values. The algorithm is a hint to the planner.

        hash is a shuffled hash join, grace-hash a sort-merge join, which spills; nested-loop leaves the choice to
        the planner, as a loop over all pairs would not survive large inputs and gives the same rows.
        """
        if algorithm not in JOIN_HINTS:
            raise QuernError(f"unknown join {algorithm}")
        a = self._together((left_at.rel, left_at.side), (left.rel, left.side))
        b = self._together((right_at.rel, right_at.side), (right.rel, right.side))
        both = Joined(a, self._right(left, a, F.col), b, lambda col: self._right(right, b, col), algorithm)
        return Selection(both, left_at.side), Selection(both, both.renamed[right_at.side])

    def frame(self, **vectors: Vector) -> DataFrame:
        """Aligned vectors of one relation as the columns of a DataFrame."""
        rel = next(iter(vectors.values())).rel
        if any(v.rel is not rel for v in vectors.values()):
            raise LengthMismatch("the vectors do not stand on the same rows")
        return rel.plain.select(*[v.expr.alias(k) for k, v in vectors.items()])

    def info(self) -> DataFrame:
        return self._db().info()

    def save(self) -> None:
        self._db().save()


def schema_of(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, IntegerType(), True) for n in names])
