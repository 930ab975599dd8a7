"""Tables with versions and positions, one current database, and its storage as Parquet with a JSON catalogue."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quern.errors import DuplicateName, QuernError, UnknownName
from quern.sources.storage import POS, is_scan, listing, read_text, remove, scan_positions, stored, write_text

#: Versions after which a table's lineage is cut.
CUT_EVERY = 20


@dataclass(frozen=True)
class Source:
    """A version's rows: with stored positions, or those that the scan of fixed files gives."""

    df: DataFrame

    def frame(self, positions: bool = False) -> DataFrame:
        if POS in self.df.columns or not positions:
            return self.df
        return scan_positions(self.df)  # unique and in row order, with gaps


@dataclass
class Table:
    name: str
    width: int
    schema: StructType = field(default_factory=StructType)
    version: int = 0  # counts what changes rows
    appended: int = 0  # counts what only adds rows
    source: Source | None = None
    next_pos: int = 0
    pending: list[tuple] = field(default_factory=list)
    indexes: dict[str, tuple[str, bool]] = field(default_factory=dict)
    since_cut: int = 0

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def add_column(self, name: str, kind=None) -> None:
        if name in self.columns:
            raise DuplicateName(f"column {name} exists")
        if len(self.columns) >= self.width:
            raise QuernError(f"table {self.name} has its {self.width} columns")
        self.schema = StructType([*self.schema.fields, StructField(name, kind or IntegerType(), True)])

    def _stored_schema(self) -> StructType:
        return StructType([*self.schema.fields, StructField(POS, LongType(), False)])

    @property
    def state(self) -> tuple[int, int, int]:
        """Equal states have the same rows."""
        return self.version, self.appended, len(self.pending)

    def current(self) -> Source:
        """The rows as they are now; buffered inserts are written first, all at once, behind all others."""
        spark = SparkSession.active()
        if self.source is None:
            self.source = Source(spark.createDataFrame([], self._stored_schema()))
        if self.pending:
            old = self.with_positions()
            rows = [(*values, self.next_pos + i) for i, values in enumerate(self.pending)]
            self.next_pos += len(rows)
            self.pending, self.appended = [], self.appended + 1
            self.source = Source(old.unionByName(spark.createDataFrame(rows, self._stored_schema())))
            self._grown()
        return self.source

    def with_positions(self) -> DataFrame:
        """The stored version with its positions; those of a scan are what earlier selections hold, so they stay."""
        if POS not in self.source.df.columns:
            placed = self.source.frame(True).select(*self.columns, POS)
            last = placed.agg(F.max(POS)).first()[0]
            self.source, self.next_pos = Source(placed), 0 if last is None else last + 1
        return self.source.df

    def replace(self, df: DataFrame, next_pos: int | None = None) -> None:
        self.source, self.pending = Source(df), []
        if next_pos is not None:
            self.next_pos = next_pos
        self.version += 1
        self._grown()

    def _grown(self) -> None:
        self.since_cut += 1
        if self.since_cut >= CUT_EVERY:
            self.source, self.since_cut = Source(stored(self.source.df, self.name)), 0

    def insert(self, values: tuple) -> None:
        if len(values) != len(self.columns):
            raise QuernError(f"table {self.name} takes {len(self.columns)} values")
        self.pending.append(tuple(values))

    def indexed(self, df: DataFrame) -> DataFrame:
        """Rows laid out by the clustered index, if there is one: then row groups are skipped by its column."""
        clustered = next((c for c, (_, whole) in self.indexes.items() if whole), None)
        return df.repartitionByRange(F.col(clustered)).sortWithinPartitions(clustered) if clustered else df


class Database:
    """The one current database."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.tables: dict[str, Table] = {}

    def create_table(self, name: str, width: int) -> Table:
        if name in self.tables:
            raise DuplicateName(f"table {name} exists")
        if width < 1:
            raise QuernError("a table has at least one column")
        found = self.tables[name] = Table(name, width)
        return found

    def register(self, name: str, df: DataFrame) -> Table:
        """A table over a DataFrame: Parquet files as they are; anything else, whose rows have no lasting order, is stored first."""
        found = self.tables[name] = Table(name, len(df.columns), df.schema, source=Source(df if is_scan(df) else stored(df, name)))
        return found

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise UnknownName(f"no table {name}")
        return self.tables[name]

    def column(self, table: str, name: str) -> tuple[Table, str]:
        found = self.table(table)
        if name not in found.columns:
            raise UnknownName(f"no column {name} in {table}")
        return found, name

    def info(self) -> DataFrame:
        """(table_name, column_name, type, rows, index) of every column."""
        rows = []
        for table in self.tables.values():
            n = table.current().df.count()
            for f in table.schema.fields:
                kind, whole = table.indexes.get(f.name, ("", False))
                rows.append((table.name, f.name, f.dataType.simpleString(), n, f"{kind} {'clustered' if whole else 'unclustered'}" if kind else ""))
        return self.spark.createDataFrame(rows, "table_name string, column_name string, type string, rows long, index string")

    def save(self) -> None:
        """Write every table to a folder of its own, then a catalogue that names the folders.

        Whoever opens the database takes the last catalogue, so a crash at any time leaves the one before whole.
        """
        if self.path is None:
            raise QuernError("the database has no path")
        tables = []
        for t in self.tables.values():
            t.current()
            folder = f"{t.name}-{uuid.uuid4().hex}"
            t.indexed(t.with_positions().select(*t.columns, POS)).write.parquet(f"{self.path}/{self.name}/{folder}")
            tables.append({"name": t.name, "folder": folder, "width": t.width, "schema": json.loads(t.schema.json()), "next_pos": t.next_pos, "indexes": t.indexes})
            self._attach(t, folder)
        before = _catalogues(self.spark, self.path)
        number = 1 + int(before[-1][8:-5]) if before else 1
        write_text(self.spark, json.dumps({"database": self.name, "tables": tables}), f"{self.path}/catalog-{number:012d}.json")

    def _attach(self, table: Table, folder: str) -> None:
        table.source = Source(self.spark.read.schema(table._stored_schema()).parquet(f"{self.path}/{self.name}/{folder}"))
        table.since_cut = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Database | None:
        """The database of the last catalogue; what no longer belongs to it is removed."""
        there = _catalogues(spark, path)
        if not there:
            return None
        found = json.loads(read_text(spark, f"{path}/{there[-1]}"))
        db = cls(spark, found["database"], path)
        for t in found["tables"]:
            table = db.tables[t["name"]] = Table(t["name"], t["width"], StructType.fromJson(t["schema"]), next_pos=t["next_pos"], indexes={k: tuple(v) for k, v in t["indexes"].items()})
            db._attach(table, t["folder"])
        for name in there[:-1]:
            remove(spark, f"{path}/{name}")
        for folder in set(listing(spark, f"{path}/{db.name}")) - {t["folder"] for t in found["tables"]}:
            remove(spark, f"{path}/{db.name}/{folder}")
        return db


def _catalogues(spark: SparkSession, path: str) -> list[str]:
    return [n for n in listing(spark, path) if n.startswith("catalog-") and n.endswith(".json")]
