"""A session of the command language: handles, batches, printing, time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from itertools import zip_longest

from pyspark.sql import SparkSession

from quern.errors import BatchError, ParseError, QuernError, TypeMismatch, UnknownName
from quern.operators.engine import Engine
from quern.operators.relation import Scalar, Selection, Vector
from quern.plans import batch
from quern.plans.parser import INT_MAX, Command, _name, bound, number, parse

BATCHED = ("select", "fetch", "sum", "avg", "min", "max", "add", "sub")


@dataclass(frozen=True)
class Moment:
    seconds: float


class Session:
    def __init__(self, spark: SparkSession, path: str | None = None, clock: Callable[[], float] = time.perf_counter):
        self.engine, self.clock = Engine(spark, path), clock
        self.handles: dict[str, Selection | Vector | Scalar | Moment] = {}
        self.queued: list[Command] | None = None
        self.closed = False

    # ---- running

    def run(self, lines: str | Iterable[str]) -> str:
        """What the lines print; an error becomes a line of its own and the rest go on."""
        return "".join(self.printed(lines))

    def printed(self, lines: str | Iterable[str]) -> Iterator[str]:
        """run() line by line: a vector's values come from the executors as they are asked for."""
        for line in lines.splitlines() if isinstance(lines, str) else lines:
            try:
                yield from self._execute(line)
            except QuernError as e:
                yield f"ERROR: {e}\n"

    def execute(self, line: str) -> str:
        """What a line prints; errors are raised."""
        return "".join(self._execute(line))

    def _execute(self, line: str) -> Iterable[str]:
        command = parse(line)
        if command is None or self.closed:
            return ()
        if self.queued is not None:
            if command.name == "batch_execute":
                return self._run_batch()
            if command.name not in BATCHED:
                raise BatchError(f"a batch does not take {command.name}")
            self.queued.append(command)
            return ()
        if command.name == "batch_execute":
            raise BatchError("no batch was begun")
        return getattr(self, f"_do_{command.name}")(command) or ()

    def _run_batch(self) -> Iterable[str]:
        commands, self.queued = self.queued, None
        for command in commands:
            getattr(self, f"_do_{command.name}")(command)
        names = {h for c in commands for h in c.handles}
        batch.evaluate([v for n in sorted(names) if isinstance(v := self.handles.get(n), Scalar)])
        return ()

    def _do_batch_queries(self, c: Command) -> None:
        self.queued = []

    # ---- handles

    def _bind(self, c: Command, *values) -> None:
        for name, value in zip(c.handles, values):
            self.handles[name] = value

    def _get(self, name: str, kind=None):
        if name not in self.handles:
            raise UnknownName(f"no handle {name}")
        found = self.handles[name]
        if kind is not None and not isinstance(found, kind):
            raise TypeMismatch(f"{name} is no {kind.__name__.lower()}")
        return found

    def _vector(self, name: str) -> Vector:
        """A handle's vector, or a whole column."""
        return self.engine.whole(name) if "." in name else self._get(name, Vector)

    # ---- commands

    def _do_create(self, c: Command) -> None:
        kind, name = c.args[0], c.args[1]
        if kind == "db":
            self.engine.create_db(_name(name))
        elif kind == "tbl":
            self.engine.create_table(_name(name), c.args[2], number(c.args[3]))
        elif kind == "col":
            self.engine.create_column(_name(name), c.args[2])
        else:
            if c.args[3] not in ("clustered", "unclustered"):
                raise ParseError(f"unknown layout {c.args[3]}")
            self.engine.create_index(name, c.args[2], c.args[3] == "clustered")

    def _do_load(self, c: Command) -> None:
        self.engine.load(c.args[0])

    def _do_relational_insert(self, c: Command) -> None:
        self.engine.insert(c.args[0], [number(a) for a in c.args[1:]])

    def _do_relational_update(self, c: Command) -> None:
        self.engine.update(c.args[0], self._get(c.args[1], Selection), number(c.args[2]))

    def _do_relational_delete(self, c: Command) -> None:
        self.engine.delete(c.args[0], self._get(c.args[1], Selection))

    def _do_select(self, c: Command) -> None:
        low, high = bound(c.args[-2]), bound(c.args[-1])
        if len(c.args) == 3:
            found = self.engine.select(c.args[0], low, high)
        else:
            found = self.engine.reselect(self._get(c.args[0], Selection), self._vector(c.args[1]), low, high)
        self._bind(c, found)

    def _do_fetch(self, c: Command) -> None:
        self._bind(c, self.engine.fetch(c.args[0], self._get(c.args[1], Selection)))

    def _aggregate(self, c: Command) -> None:
        self._bind(c, self.engine.aggregate(c.name, self._vector(c.args[0])))

    _do_sum = _do_avg = _do_min = _do_max = _aggregate

    def _do_add(self, c: Command) -> None:
        self._bind(c, self.engine.add(self._vector(c.args[0]), self._vector(c.args[1])))

    def _do_sub(self, c: Command) -> None:
        self._bind(c, self.engine.sub(self._vector(c.args[0]), self._vector(c.args[1])))

    def _do_join(self, c: Command) -> None:
        v1, s1, v2, s2, how = c.args
        self._bind(c, *self.engine.join(self._get(v1, Vector), self._get(s1, Selection), self._get(v2, Vector), self._get(s2, Selection), how))

    def _do_time(self, c: Command) -> None:
        """The moment, once all scalars so far have their values; or what has passed since another."""
        batch.evaluate([v for v in self.handles.values() if isinstance(v, Scalar)])
        now = self.clock()
        self._bind(c, Moment(now - self._get(c.args[0], Moment).seconds) if c.args else Moment(now))

    def _do_info(self, c: Command) -> Iterator[str]:
        rows = self.engine.info().collect()  # a row for each column of a table
        return (f"{r.table_name}.{r.column_name} {r.type} {r.rows} {r['index']}".rstrip() + "\n" for r in rows)

    def _do_shutdown(self, c: Command) -> None:
        if self.engine.path and self.engine.db:
            self.engine.save()
        self.closed = True

    # ---- printing

    def _do_print(self, c: Command) -> Iterator[str]:
        values = [self._get(a) if "." not in a else self.engine.whole(a) for a in c.args]
        counts = {i: self.engine.count(v) for i, v in enumerate(values) if isinstance(v, Selection)}
        batch.evaluate([*counts.values(), *(v for v in values if isinstance(v, Scalar))])
        columns = [map(show, (r.v for r in v.ordered().select("v").toLocalIterator())) if isinstance(v, Vector) else iter([self._show(v, counts.get(i))]) for i, v in enumerate(values)]
        return (",".join(cell for cell in row if cell is not None) + "\n" for row in zip_longest(*columns))

    @staticmethod
    def _show(value, count: Scalar | None) -> str:
        if count is not None:
            return str(count.value)
        if isinstance(value, Moment):
            return f"{value.seconds * 1000:f}"
        if value.value is None:  # min and max of nothing
            return str(INT_MAX if value.how == "min" else -INT_MAX)
        return show(value.value)


def show(value) -> str:
    """Whole numbers as they are, others with two places, halves away from zero."""
    if isinstance(value, float):
        return str(Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return "" if value is None else str(value)
