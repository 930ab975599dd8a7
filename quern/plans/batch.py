"""Shared scans: many aggregates or many selections over a table in one pass."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quern.operators.relation import Base, Expr, Filter, Relation, Scalar, Vector
from quern.sources.storage import POS

#: Conditions up to which each is worth an aggregate of its own and their disjunction its planning; more ranges are looked up.
FEW = 16
Member = tuple[Scalar, Base, list[Expr]]


def _root(rel: Relation) -> tuple[Base, list[Expr]] | None:
    """The base of a chain of filters, and their conditions; None for other relations."""
    makes: list[Expr] = []
    while isinstance(rel, Filter):
        makes.append(rel.make)
        rel = rel.below
    return (rel, makes[::-1]) if isinstance(rel, Base) else None


def _under(base: Base):
    """Names of any base of the same table as the columns of this one."""
    return lambda name: F.col(f"b{base.id}_{name.partition('_')[2]}")


def _all(makes: list[Expr], col) -> Column | None:
    whole = None
    for make in makes:
        whole = make(col) if whole is None else whole & make(col)
    return whole


def evaluate(scalars: Sequence[Scalar]) -> None:
    """Find the values of scalars: those over filters of one table version in one scan, by conditional aggregation."""
    groups: dict[tuple, list[Member]] = defaultdict(list)
    for scalar in scalars:
        if scalar.known:
            continue
        found = _root(scalar.rel)
        if found is None:
            scalar.value  # noqa: B018
        else:
            groups[id(found[0].source), found[0].version].append((scalar, *found))
    for group in groups.values():
        row = shared_aggregates(group).first()
        for (scalar, _, _), value in zip(group, row):
            scalar.known.append(value)


def _spans(group: Sequence[Member]) -> list[tuple] | None:
    """(column, low, high) of every scalar, if all are ranges of one column with bounds of one type."""
    spans = [s.rel.span if isinstance(s.rel, Filter) and len(makes) == 1 else None for s, _, makes in group]
    if any(s is None for s in spans) or len({s[0] for s in spans}) != 1:
        return None
    return spans if len({type(b) for _, *bounds in spans for b in bounds if b is not None}) == 1 else None


def _interval(value: Column, bounds: list) -> Column:
    """How many bounds are not above the value, by binary search: a fold over the halving steps."""
    table, steps = F.array(*[F.lit(b) for b in bounds]), [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        return at + F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= value), step).otherwise(0)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def interval_aggregates(group: Sequence[Member], spans: Sequence[tuple]) -> DataFrame:
    """shared_aggregates for any number of ranges of one column, by the intervals between all their bounds.

    A row is looked up once and counts for its interval; there are at most one more of these than bounds.  The ranges
    are unions of intervals, so what they want is put together, by the driver, from the intervals' counts, sums, least
    and greatest.
    """
    first = group[0][1]
    df, col, column = first.plain, _under(first), spans[0][0]
    bounds = sorted({b for _, *own in spans for b in own if b is not None})
    value = col(f"b_{column}")
    if all(low is not None for _, low, _ in spans):
        df = df.where(value >= F.lit(bounds[0]))
    if all(high is not None for _, _, high in spans):
        df = df.where(value < F.lit(bounds[-1]))
    values = {str(s.make(col)): s for s, _, _ in group}
    numbers = {text: i for i, text in enumerate(values)}
    parts = []
    for text, s in values.items():
        x, i = s.make(col), numbers[text]
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"g{i}")]
        if any(o.how in ("sum", "avg") and str(o.make(col)) == text for o, _, _ in group):
            parts.append(F.sum(x).alias(f"s{i}"))
    per = df.where(value.isNotNull()).groupBy(_interval(value, bounds).alias("__at")).agg(*parts)
    rows = sorted(per.collect(), key=lambda r: r["__at"])  # interval k holds what is at or above bound k - 1 and below bound k
    out, kinds = [], []
    for j, ((s, _, _), (_, low, high)) in enumerate(zip(group, spans)):
        i = numbers[str(s.make(col))]
        first_one = bisect_left(bounds, low) + 1 if low is not None else 0
        last_one = bisect_left(bounds, high) if high is not None else len(bounds)
        inside = [r for r in rows if first_one <= r["__at"] <= last_one]
        of = lambda name: [r[name] for r in inside if r[name] is not None]  # noqa: B023, E731
        count, kind = sum(of(f"n{i}")), per.schema[f"l{i}"].dataType
        if s.how == "count":
            found, kind = count, LongType()
        elif s.how == "sum":
            nothing = (0 if s.integral else 0.0) if s.zero else None
            found, kind = sum(of(f"s{i}")) if count else nothing, per.schema[f"s{i}"].dataType
        elif s.how == "avg":
            found, kind = (float(sum(of(f"s{i}"))) / count if count else 0.0 if s.zero else None), DoubleType()
        else:
            found = min(of(f"l{i}"), default=None) if s.how == "min" else max(of(f"g{i}"), default=None)
        out.append(found)
        kinds.append(StructField(f"a{j}", kind, True))
    return df.sparkSession.createDataFrame([tuple(out)], StructType(kinds))


def shared_aggregates(group: Sequence[Member]) -> DataFrame:
    """One row: a column for each scalar, in order."""
    if len({id(s.rel) for s, _, _ in group}) > FEW and (spans := _spans(group)) is not None:
        return interval_aggregates(group, spans)
    first = group[0][1]
    df, col = first.plain, _under(first)
    once: dict[tuple, Column | None] = {}
    for _, _, makes in group:
        if (key := tuple(map(id, makes))) not in once:
            once[key] = _all(makes, col)
    guards = [once[tuple(map(id, makes))] for _, _, makes in group]
    if len(once) <= FEW and () not in once:  # rows that no query wants need not leave the scan
        wanted = None
        for g in once.values():
            wanted = g if wanted is None else wanted | g
        df = df.where(wanted)
    return df.agg(*[s.aggregate(g, col).alias(f"a{i}") for i, ((s, _, _), g) in enumerate(zip(group, guards))])


def shared_vectors(vectors: Sequence[Vector], positions: bool = False) -> DataFrame:
    """(query, v) of every value of the vectors, from one scan: each row is tagged with the queries that want it."""
    found = [_root(v.rel) for v in vectors]
    if any(f is None for f in found) or len({(id(b.source), b.version) for b, _ in found}) != 1:
        frames = [(v.ordered() if positions else v.frame()).withColumn("query", F.lit(i)) for i, v in enumerate(vectors)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    first = found[0][0]
    df, col = first.placed if positions else first.plain, _under(first)
    tags = []
    for i, (v, (_, makes)) in enumerate(zip(vectors, found)):
        guard, row = _all(makes, col), F.struct(F.lit(i).alias("query"), v.make(col).alias("v"))
        tags.append(row if guard is None else F.when(guard, row))
    each = df.select(F.explode(F.array_compact(F.array(*tags))).alias("t"), *([F.col(f"b{first.id}_{POS}").alias(POS)] if positions else []))
    return each.select("t.query", "t.v", *([POS] if positions else []))
