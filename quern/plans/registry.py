"""Registered queries over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import graphs, matrix, ml, tabular, text
from quern.operators.engine import Engine
from quern.operators.relation import Selection, Vector
from quern.plans import batch
from quern.plans.session import Session
from quern.session import table
from quern.sources import csvfile
from quern.sources.storage import shared_dir
from quern.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    found = Engine(spark)
    found.create_db("db")
    for name in tables:
        found.register(name, table(spark, sf_dir, name))
    return found


def _lineitem(spark, sf_dir) -> Engine:
    return engine(spark, sf_dir, "lineitem")


# ---- selections and fetches


@query("SELECT l_suppkey FROM lineitem WHERE l_partkey>=100 AND l_partkey<200")
def select_range_fetch(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return e.fetch("db.lineitem.l_suppkey", e.select("db.lineitem.l_partkey", 100, 200)).frame("l_suppkey")


@query("SELECT p_size FROM part WHERE p_size<10")
def select_open_low(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    return e.fetch("db.part.p_size", e.select("db.part.p_size", None, 10)).frame("p_size")


@query("SELECT p_size FROM part WHERE p_size>=45")
def select_open_high(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    return e.fetch("db.part.p_size", e.select("db.part.p_size", 45, None)).frame("p_size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 57")
def select_point(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    s = e.select("db.lineitem.l_partkey", 57, 58)
    return e.frame(l_orderkey=e.fetch("db.lineitem.l_orderkey", s), l_linenumber=e.fetch("db.lineitem.l_linenumber", s))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4' AND o_totalprice >= 1000.5 AND o_orderdate < TIMESTAMP '1995-01-01'")
def select_other_types(spark, sf_dir):
    import datetime

    e = engine(spark, sf_dir, "orders")
    s = e.select("db.orders.o_orderpriority", "2", "4")
    s = e.reselect(s, e.fetch("db.orders.o_totalprice", s), 1000.5, None)
    s = e.reselect(s, e.fetch("db.orders.o_orderdate", s), None, datetime.datetime(1995, 1, 1))
    return e.fetch("db.orders.o_orderkey", s).frame("o_orderkey")


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey>=100 AND l_partkey<200")
def select_count(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return e.count(e.select("db.lineitem.l_partkey", 100, 200)).frame("n")


def _narrow(e: Engine) -> Selection:
    s = e.select("db.lineitem.l_partkey", 100, 900)
    return e.reselect(s, e.fetch("db.lineitem.l_suppkey", s), 2, 8)


@query("SELECT l_orderkey FROM lineitem WHERE l_partkey>=100 AND l_partkey<900 AND l_suppkey>=2 AND l_suppkey<8")
def reselect_conj(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return e.fetch("db.lineitem.l_orderkey", _narrow(e)).frame("l_orderkey")


# ---- aggregates and vectors


def _fetched(e: Engine, column: str) -> Vector:
    return e.fetch(f"db.lineitem.{column}", e.select("db.lineitem.l_partkey", 100, 200))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_partkey>=100 AND l_partkey<200")
def agg_sum(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return e.aggregate("sum", _fetched(e, "l_linenumber")).as_sql().frame("s")


@query("SELECT avg(l_linenumber) AS a FROM lineitem WHERE l_partkey>=100 AND l_partkey<200")
def agg_avg(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return e.aggregate("avg", _fetched(e, "l_linenumber")).as_sql().frame("a")


def _side_by_side(scalars: dict) -> DataFrame:
    """Scalars of one table as one row, from one scan."""
    df = batch.shared_aggregates([(s, *batch._root(s.rel)) for s in scalars.values()])
    return df.toDF(*scalars)


@query("SELECT min(l_partkey) AS mi, max(l_linenumber) AS ma FROM lineitem WHERE l_partkey>=100 AND l_partkey<200")
def agg_minmax(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return _side_by_side({"mi": e.aggregate("min", _fetched(e, "l_partkey")), "ma": e.aggregate("max", _fetched(e, "l_linenumber"))})


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem")
def agg_whole_column(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return e.aggregate("sum", e.whole("db.lineitem.l_linenumber")).as_sql().frame("s")


@query("SELECT CAST(coalesce(sum(l_linenumber),0) AS BIGINT) AS s, CAST(coalesce(avg(l_linenumber),0.0) AS DOUBLE) AS a, min(l_linenumber) AS m FROM lineitem WHERE l_partkey<0")
def agg_empty(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    v = e.fetch("db.lineitem.l_linenumber", e.select("db.lineitem.l_partkey", None, 0))
    return _side_by_side({"s": e.aggregate("sum", v), "a": e.aggregate("avg", v), "m": e.aggregate("min", v)})


@query("SELECT l_partkey+l_suppkey AS v FROM lineitem WHERE l_orderkey<500")
def combine_add(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    s = e.select("db.lineitem.l_orderkey", None, 500)
    return e.add(e.fetch("db.lineitem.l_partkey", s), e.fetch("db.lineitem.l_suppkey", s)).frame()


@query("SELECT l_partkey-l_suppkey AS v FROM lineitem WHERE l_orderkey<500")
def combine_sub(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    s = e.select("db.lineitem.l_orderkey", None, 500)
    return e.sub(e.fetch("db.lineitem.l_partkey", s), e.fetch("db.lineitem.l_suppkey", s)).frame()


@query(
    "SELECT avg(l_partkey+l_suppkey) AS a1, min(l_suppkey) AS m1, max(l_linenumber) AS m2, avg(l_linenumber-l_suppkey) AS a2, CAST(sum(l_linenumber-l_suppkey) AS BIGINT) AS s1 FROM lineitem WHERE l_partkey>=100 AND l_partkey<900 AND l_suppkey>=2 AND l_suppkey<8"
)
def boss_query(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    s = _narrow(e)
    part, supp, line = (e.fetch(f"db.lineitem.{c}", s) for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    less = e.sub(line, supp)
    found = {"a1": e.aggregate("avg", e.add(part, supp)), "m1": e.aggregate("min", supp), "m2": e.aggregate("max", line), "a2": e.aggregate("avg", less), "s1": e.aggregate("sum", less)}
    return _side_by_side({name: scalar.as_sql() for name, scalar in found.items()})


# ---- joins


def _joined(spark, sf_dir, how: str) -> DataFrame:
    e = engine(spark, sf_dir, "lineitem", "part")
    s, p = e.select("db.lineitem.l_orderkey", None, 5000), e.select("db.part.p_size", None, 10)
    a, b = e.join(e.fetch("db.lineitem.l_partkey", s), s, e.fetch("db.part.p_partkey", p), p, how)
    rows = e.frame(x=e.fetch("db.lineitem.l_linenumber", a), y=e.fetch("db.part.p_size", b))
    return rows.agg(F.avg("x").alias("a"), F.sum("y").alias("s"))


_JOIN_SQL = "SELECT avg(l_linenumber) AS a, CAST(sum(p_size) AS BIGINT) AS s FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_orderkey<5000 AND p_size<10"


@query(_JOIN_SQL)
def join_hash_m1(spark, sf_dir):
    return _joined(spark, sf_dir, "hash")


@query(_JOIN_SQL)
def join_grace(spark, sf_dir):
    return _joined(spark, sf_dir, "grace-hash")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey=n_nationkey")
def join_nested_loop(spark, sf_dir):
    e = engine(spark, sf_dir, "supplier", "nation")
    s, n = e.select("db.supplier.s_suppkey"), e.select("db.nation.n_nationkey")
    a, b = e.join(e.fetch("db.supplier.s_nationkey", s), s, e.fetch("db.nation.n_nationkey", n), n, "nested-loop")
    return e.frame(s_suppkey=e.fetch("db.supplier.s_suppkey", a), n_nationkey=e.fetch("db.nation.n_nationkey", b))


@query("SELECT CAST(sum(c_custkey) AS BIGINT) AS s, avg(s_suppkey) AS a FROM customer JOIN supplier ON c_nationkey=s_nationkey")
def join_many_many(spark, sf_dir):
    e = engine(spark, sf_dir, "customer", "supplier")
    c, s = e.select("db.customer.c_custkey"), e.select("db.supplier.s_suppkey")
    a, b = e.join(e.fetch("db.customer.c_nationkey", c), c, e.fetch("db.supplier.s_nationkey", s), s, "hash")
    rows = e.frame(x=e.fetch("db.customer.c_custkey", a), y=e.fetch("db.supplier.s_suppkey", b))
    return rows.agg(F.sum("x").alias("s"), F.avg("y").alias("a"))


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_totalprice>=100000 AND c_acctbal<5000")
def join_post_fetch(spark, sf_dir):
    e = engine(spark, sf_dir, "orders", "customer")
    o, c = e.select("db.orders.o_totalprice", 100000, None), e.select("db.customer.c_acctbal", None, 5000)
    a, b = e.join(e.fetch("db.orders.o_custkey", o), o, e.fetch("db.customer.c_custkey", c), c, "hash")
    return e.frame(o_orderkey=e.fetch("db.orders.o_orderkey", a), c_name=e.fetch("db.customer.c_name", b), c_acctbal=e.fetch("db.customer.c_acctbal", b))


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey WHERE a.n_nationkey<10 AND b.n_nationkey>=5")
def join_self(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    a, b = e.select("db.nation.n_nationkey", None, 10), e.select("db.nation.n_nationkey", 5, None)
    x, y = e.join(e.fetch("db.nation.n_regionkey", a), a, e.fetch("db.nation.n_regionkey", b), b, "hash")
    return e.frame(x=e.fetch("db.nation.n_nationkey", x), y=e.fetch("db.nation.n_nationkey", y))


@query("SELECT l_orderkey, l_linenumber, p_size, s_nationkey FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey WHERE p_size<5 AND l_linenumber<3")
def join_chain(spark, sf_dir):
    e = engine(spark, sf_dir, "lineitem", "part", "supplier")
    l, p, s = e.select("db.lineitem.l_linenumber", None, 3), e.select("db.part.p_size", None, 5), e.select("db.supplier.s_suppkey")
    l, p = e.join(e.fetch("db.lineitem.l_partkey", l), l, e.fetch("db.part.p_partkey", p), p, "hash")
    l2, s2 = e.join(e.fetch("db.lineitem.l_suppkey", l), l, e.fetch("db.supplier.s_suppkey", s), s, "hash")
    p2 = Selection(l2.rel, p.side)
    return e.frame(l_orderkey=e.fetch("db.lineitem.l_orderkey", l2), l_linenumber=e.fetch("db.lineitem.l_linenumber", l2), p_size=e.fetch("db.part.p_size", p2), s_nationkey=e.fetch("db.supplier.s_nationkey", s2))


# ---- batches


def _batch(spark, sf_dir, ranges: list[tuple[int, int]]) -> DataFrame:
    """(q, n, s) for each range, all from one scan."""
    e = _lineitem(spark, sf_dir)
    scalars = []
    for low, high in ranges:
        s = e.select("db.lineitem.l_partkey", low, high)
        scalars += [e.count(s), e.aggregate("sum", e.fetch("db.lineitem.l_linenumber", s))]
    row = batch.shared_aggregates([(x, *batch._root(x.rel)) for x in scalars])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.col(f"a{2 * i}").alias("n"), F.col(f"a{2 * i + 1}").alias("s")) for i in range(len(ranges))]))
    return row.select(each.alias("r")).select("r.q", "r.n", "r.s")


def _batch_sql(ranges: list[tuple[int, int]]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS q, count(*) AS n, CAST(coalesce(sum(l_linenumber),0) AS BIGINT) AS s FROM lineitem WHERE l_partkey>={a} AND l_partkey<{b}" for i, (a, b) in enumerate(ranges))


_TWO, _NESTED = [(10, 20), (800, 830)], [(810, 820), (800, 830)]
_TEN, _HUNDRED = [(20 * i, 20 * i + 30) for i in range(10)], [((37 * i) % 1900, (37 * i) % 1900 + 40) for i in range(100)]


@query(_batch_sql(_TWO))
def batch_two_ranges(spark, sf_dir):
    return _batch(spark, sf_dir, _TWO)


@query(_batch_sql(_NESTED))
def batch_subsumed(spark, sf_dir):
    return _batch(spark, sf_dir, _NESTED)


@query(_batch_sql(_TEN))
def batch_ten(spark, sf_dir):
    return _batch(spark, sf_dir, _TEN)


@query(_batch_sql(_HUNDRED))
def batch_hundred(spark, sf_dir):
    return _batch(spark, sf_dir, _HUNDRED)


@query(" UNION ALL ".join(f'SELECT {i} AS "query", l_suppkey AS v FROM lineitem WHERE l_partkey>={a} AND l_partkey<{b}' for i, (a, b) in enumerate(_TEN)))
def batch_fetches(spark, sf_dir):
    e = _lineitem(spark, sf_dir)
    return batch.shared_vectors([e.fetch("db.lineitem.l_suppkey", e.select("db.lineitem.l_partkey", a, b)) for a, b in _TEN])


# ---- changes, files, indexes


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size FROM part UNION ALL SELECT * FROM (VALUES (900001, 7), (900002, 60)) v(a, b)) WHERE p_size>=7 AND p_size<9")
def insert_then_select(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.register("part", table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    e.insert("db.part", (900001, 7))
    e.insert("db.part", (900002, 60))
    s = e.select("db.part.p_size", 7, 9)
    return e.frame(p_partkey=e.fetch("db.part.p_partkey", s), p_size=e.fetch("db.part.p_size", s))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_partkey<300")
def fetch_after_insert(spark, sf_dir):
    """A selection keeps its rows, in tables of several files too, when rows are inserted after it, and takes in no new ones."""
    path = f"{shared_dir(spark)}/quern-parts-{uuid.uuid4().hex}"
    table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").repartition(5).write.parquet(path)
    e = engine(spark, sf_dir)
    e.register("lineitem", spark.read.parquet(path))
    s = e.select("db.lineitem.l_partkey", None, 300)
    e.insert("db.lineitem", (5, 1_000_000))
    v = e.fetch("db.lineitem.l_linenumber", s)
    assert e.count(e.select("db.lineitem.l_partkey", 5, 6)).value  # written by now
    return v.rel.plain.agg(F.count(v.expr).alias("n"), F.sum(e.fetch("db.lineitem.l_linenumber", s).expr).alias("s"))


@query("SELECT r_regionkey AS k, 70 AS v FROM region WHERE r_regionkey = 0 UNION ALL SELECT 100, 8")
def update_one_row_then_insert(spark, sf_dir):
    """A table of one row: the inserted row gets a position of its own, and the update reaches only what was selected."""
    e = engine(spark, sf_dir)
    e.register("region", table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.col("r_regionkey").alias("k"), F.lit(7).alias("v")))
    s = e.select("db.region.v", 0, 10)
    e.insert("db.region", (100, 8))
    e.update("db.region.v", s, 70)
    t = e.select("db.region.k")
    assert t.rel.placed.select(f"b{t.side}___pos").distinct().count() == 2
    return e.frame(k=e.fetch("db.region.k", t), v=e.fetch("db.region.v", t))


@query("SELECT p_partkey, v AS p_size FROM (SELECT p_partkey, CASE WHEN p_size>=10 AND p_size<20 AND p_partkey<500 THEN 77 ELSE p_size END AS v FROM part) WHERE v>=15")
def update_then_select(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    s = e.select("db.part.p_size", 10, 20)
    e.update("db.part.p_size", e.reselect(s, e.fetch("db.part.p_partkey", s), None, 500), 77)
    t = e.select("db.part.p_size", 15, None)
    return e.frame(p_partkey=e.fetch("db.part.p_partkey", t), p_size=e.fetch("db.part.p_size", t))


@query("SELECT p_partkey FROM part WHERE NOT (p_size>=10 AND p_size<20) AND p_partkey>=50")
def delete_then_select(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    e.delete("db.part", e.select("db.part.p_size", 10, 20))
    return e.fetch("db.part.p_partkey", e.select("db.part.p_partkey", 50, None)).frame("p_partkey")


@query("SELECT o_orderkey, CASE WHEN c_acctbal<0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN customer ON o_custkey=c_custkey")
def update_through_join(spark, sf_dir):
    e = engine(spark, sf_dir, "orders", "customer")
    o, c = e.select("db.orders.o_orderkey"), e.select("db.customer.c_acctbal", None, 0)
    hit, _ = e.join(e.fetch("db.orders.o_custkey", o), o, e.fetch("db.customer.c_custkey", c), c, "hash")
    e.update("db.orders.o_orderstatus", hit, "X")
    t = e.select("db.orders.o_orderkey")
    return e.frame(o_orderkey=e.fetch("db.orders.o_orderkey", t), o_orderstatus=e.fetch("db.orders.o_orderstatus", t))


@query("SELECT b.p_size AS was, a.v AS v FROM part b JOIN (SELECT p_partkey, CASE WHEN p_size<10 THEN 1000 ELSE p_size END AS v FROM part) a USING (p_partkey) WHERE b.p_size<12")
def fetch_after_update(spark, sf_dir):
    """Positions stay as they were selected; values are the current ones."""
    e = engine(spark, sf_dir, "part")
    s = e.select("db.part.p_size", None, 12)
    was = e.fetch("db.part.p_size", s)
    e.update("db.part.p_size", e.select("db.part.p_size", None, 10), 1000)
    now = e.fetch("db.part.p_size", s)
    return now.rel.plain.select(was.expr.alias("was"), now.expr.alias("v"))


@query("SELECT s_suppkey AS a, CAST(s_nationkey AS INTEGER) AS b FROM supplier WHERE s_suppkey>=3")
def csv_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/quern-csv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("db.t.a"), F.col("s_nationkey").alias("db.t.b"))
    rows.write.option("header", True).csv(path)
    e = engine(spark, sf_dir)
    e.create_table("t", "db", 2)
    e.create_column("a", "db.t", rows.schema[0].dataType)
    e.create_column("b", "db.t")
    e.load(path)
    s = e.select("db.t.a", 3, None)
    return e.frame(a=e.fetch("db.t.a", s), b=e.fetch("db.t.b", s))


@query("SELECT p_partkey, p_size FROM part")
def arriving_files(spark, sf_dir):
    """Files that arrive in a folder one after the other become a table's rows, each once."""
    base = f"{shared_dir(spark)}/quern-arrivals-{uuid.uuid4().hex}"
    rows, found = table(spark, sf_dir, "part").select("p_partkey", "p_size"), None
    for i in range(2):
        rows.where(F.col("p_partkey") % 2 == i).write.mode("append").option("header", True).csv(f"{base}/in")
        found = ingest.appended(spark, f"{base}/in", rows.schema, f"{base}/table", f"{base}/check")
    return found


def _saved(spark, sf_dir, index: str | None) -> Engine:
    path = f"{shared_dir(spark)}/quern-db-{uuid.uuid4().hex}"
    e = Engine(spark, path)
    e.create_db("db")
    e.register("lineitem", table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"))
    if index:
        e.create_index(f"db.lineitem.{index}", "sorted", True)
    e.save()
    return Engine(spark, path)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey>=100 AND l_partkey<130")
def persist_reopen(spark, sf_dir):
    e = _saved(spark, sf_dir, None)
    s = e.select("db.lineitem.l_partkey", 100, 130)
    return e.frame(l_orderkey=e.fetch("db.lineitem.l_orderkey", s), l_linenumber=e.fetch("db.lineitem.l_linenumber", s))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey>=100 AND l_partkey<130")
def index_hint_equiv(spark, sf_dir):
    e = _saved(spark, sf_dir, "l_partkey")
    s = e.select("db.lineitem.l_partkey", 100, 130)
    return e.frame(l_orderkey=e.fetch("db.lineitem.l_orderkey", s), l_linenumber=e.fetch("db.lineitem.l_linenumber", s))


@query("SELECT 'nation' AS table_name, c AS column_name, t AS type, (SELECT count(*) FROM nation) AS \"rows\", '' AS \"index\" FROM (VALUES ('n_nationkey','int'),('n_name','string'),('n_regionkey','int')) v(c, t)")
def info(spark, sf_dir):
    return engine(spark, sf_dir, "nation").info()


@query("SELECT CAST(count(*) AS VARCHAR) || ',' || CAST(sum(l_linenumber) AS VARCHAR) AS printed FROM lineitem WHERE l_partkey>=100 AND l_partkey<200")
def command_language(spark, sf_dir):
    s = Session(spark)
    s.engine = _lineitem(spark, sf_dir)
    out = s.run("s=select(db.lineitem.l_partkey,100,200) -- a script\nf=fetch(db.lineitem.l_linenumber,s)\na=sum(f)\nprint(s,a)")
    return spark.createDataFrame([(line,) for line in out.splitlines()], "printed string")


def _script(engine_: Engine | None, spark, lines: str, clock=None) -> DataFrame:
    """What a script prints, line by line."""
    s = Session(spark, **({"clock": clock} if clock else {}))
    if engine_ is not None:
        s.engine = engine_
    return spark.createDataFrame([(i, line) for i, line in enumerate(s.run(lines).splitlines())], "line int, printed string")


@query("""SELECT * FROM (VALUES (0, 'ERROR: unknown command'), (1, 'ERROR: incorrect number of arguments'), (2, 'ERROR: an argument is empty'), (3, 'ERROR: no handle nowhere'), (4, 'ERROR: invalid number format: 12x'),
(5, 'ERROR: name is too long'), (6, 'ERROR: arguments stand in parentheses'), (7, 'ERROR: cannot create view'), (8, 'ERROR: only a join has two handles')) v(line, printed)
UNION ALL SELECT 9, (SELECT CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey >= 1 AND n_regionkey < 3) || ',' || (SELECT CAST(sum(n_nationkey) AS VARCHAR) FROM nation WHERE n_regionkey >= 1 AND n_regionkey < 3)""")
def language_errors(spark, sf_dir):
    """Errors are lines of their own, and what follows them runs: white space, quotes, comments, arity, numbers, names."""
    name = "n" * 64
    return _script(engine(spark, sf_dir, "nation"), spark, f"""
frobnicate(a)
s=select(db.nation.n_regionkey,1)
s=select(db.nation.n_regionkey,,3)
print(nowhere)
s=select(db.nation.n_regionkey,12x,3)
create(tbl,"{name}",db,2)
print(s
create(view,"v",db)
a,b=sum(db.nation.n_nationkey)
-- a comment alone
 s = select ( "db.nation.n_regionkey" , 1 , 3 ) -- spaces, quotes and a comment
f=fetch(db.nation.n_nationkey,s)
a=sum(f)
print(s,a)""")


@query("SELECT 0 AS line, '1500.000000' AS printed")
def language_time(spark, sf_dir):
    """A moment, and what has passed since it; the clock here moves a second and a half between two looks."""
    ticks = iter([10.0, 11.5])
    return _script(engine(spark, sf_dir, "nation"), spark, "t=time()\na=sum(db.nation.n_nationkey)\nd=time(t)\nprint(d)", lambda: next(ticks))


_SPANS = [(0, 5), (3, 9), (8, 30)]


@query(" UNION ALL ".join(f"SELECT {i} AS line, (SELECT count(*)::VARCHAR || ',' || coalesce(sum(l_suppkey), 0)::VARCHAR || ',' || coalesce(min(l_suppkey), 2147483647)::VARCHAR || ',' || coalesce(max(l_suppkey), -2147483647)::VARCHAR FROM lineitem WHERE l_partkey >= {a} AND l_partkey < {b}) AS printed" for i, (a, b) in enumerate(_SPANS)))
def language_batch(spark, sf_dir):
    """batch_queries() and batch_execute(): what stands between them runs together."""
    lines = [f"s{i}=select(db.lineitem.l_partkey,{a},{b})\nf{i}=fetch(db.lineitem.l_suppkey,s{i})\na{i}=sum(f{i})\nm{i}=min(f{i})\nx{i}=max(f{i})" for i, (a, b) in enumerate(_SPANS)]
    prints = [f"print(s{i},a{i},m{i},x{i})" for i in range(len(_SPANS))]
    return _script(_lineitem(spark, sf_dir), spark, "\n".join(["batch_queries()", *lines, "batch_execute()", *prints]))


def _written(spark, df: DataFrame, comment: str | None = None, **options) -> str:
    """A folder of text files, each with a header or with comment lines in front."""
    path = f"{shared_dir(spark)}/quern-text-{uuid.uuid4().hex}"
    if comment is None:
        df.write.options(**options).csv(path)
    else:
        line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns])
        spark.createDataFrame([(comment,)], "line string").union(df.select(line)).coalesce(1).write.text(path)
    return path


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def tsv_read(spark, sf_dir):
    """Tab-separated text with a header, NA for null."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    path = _written(spark, df, sep="\t", header=True, nullValue="NA")
    return csvfile.read_delimited(spark, path, df.schema.simpleString()[7:-1].replace(":", " "))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS p_size, p_retailprice FROM part")
def comment_header_read(spark, sf_dir):
    """Comma-separated text whose header is a comment line."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), "p_retailprice")
    path = _written(spark, df, "#partkey,size,price")
    return csvfile.read_delimited(spark, path, df.schema.simpleString()[7:-1].replace(":", " "), sep=",", comment="#", header_line=False)


# ---- tables


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2,}') AND regexp_matches(p_type, '^[A-M]')")
def regex_filter(spark, sf_dir):
    return tabular.matching(tabular.matching(table(spark, sf_dir, "part"), "p_name", "[aeiou]{2,}"), "p_type", "^[A-M]").select("p_partkey", "p_name")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id = 8")
def isin_filter(spark, sf_dir):
    return tabular.among(table(spark, sf_dir, "events"), event_type=["click", "view"], user_id=8).select("event_id", "event_type")


@query("SELECT c_custkey, NOT regexp_matches(c_mktsegment, 'E$') AS flag FROM customer")
def derived_flag(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (~F.col("c_mktsegment").rlike("E$")).alias("flag"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_frequency(spark, sf_dir):
    return tabular.frequencies(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def grouped_mean(spark, sf_dir):
    return tabular.means(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", F.round("mean", 6).alias("mean"))


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def grouped_median(spark, sf_dir):
    return tabular.medians(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", F.round("median", 6).alias("median"))


@query("SELECT round(median(value), 6) AS median FROM events")
def global_median(spark, sf_dir):
    return tabular.medians(table(spark, sf_dir, "events"), "value").select(F.round("median", 6).alias("median"))


@query("SELECT l_returnflag, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def min_and_max(spark, sf_dir):
    return tabular.extremes(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@query("SELECT o_orderpriority, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS percent FROM orders GROUP BY o_orderpriority")
def share_of_total(spark, sf_dir):
    return tabular.shares(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, avg(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) * 100 AS rate FROM lineitem GROUP BY ALL")
def rate_by_keys(spark, sf_dir):
    return tabular.rates(table(spark, sf_dir, "lineitem"), F.col("l_quantity") >= 25, "l_returnflag", "l_linestatus", "l_linenumber")


@query("(SELECT c_custkey, c_acctbal, 'first' AS place FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1) UNION ALL (SELECT c_custkey, c_acctbal, 'last' FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1)")
def first_and_last(spark, sf_dir):
    return tabular.first_and_last(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT count(*) AS n FROM customer WHERE regexp_matches(c_name, '7$')")
def rows_after_filter(spark, sf_dir):
    return tabular.matching(table(spark, sf_dir, "customer"), "c_name", "7$").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber, round(avg(l_quantity) / l_linenumber, 6) AS ratio FROM lineitem GROUP BY l_linenumber")
def mean_over_key(spark, sf_dir):
    return tabular.mean_by_key(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber").select("l_linenumber", F.round("ratio", 6).alias("ratio"))


@query("""
WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS m FROM events WHERE event_type IN ('click', 'view')),
n AS (SELECT count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type = 'view') AS n2, sum(m) FILTER (event_type = 'click') AS r FROM r),
t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY value)),
w AS (SELECT n1, n2, r - n1 * (n1 + 1) / 2.0::DOUBLE AS w, ties FROM n, t),
z AS (SELECT n1, n2, w, (w - n1 * n2 / 2.0::DOUBLE - sign(w - n1 * n2 / 2.0::DOUBLE) * 0.5::DOUBLE) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z FROM w)
SELECT n1, n2, w, round(z, 6) AS z, round(sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) + i * 0.0025::DOUBLE, 2) / 2)) * 0.0025::DOUBLE / 3 * sqrt(2 / pi()), 8) AS p
FROM z, range(4001) t(i) GROUP BY ALL""")
def wilcoxon(spark, sf_dir):
    found = tabular.rank_sum(table(spark, sf_dir, "events"), "value", "event_type", "click", "view")
    return found.withColumn("z", F.round("z", 6)).withColumn("p", F.round("p", 8))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, min(value) FILTER (inside) AS low, max(value) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS outside FROM (SELECT event_type, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type) USING (event_type)) GROUP BY event_type")
def box_plots(spark, sf_dir):
    found = tabular.box_statistics(table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outside")


@query('SELECT event_type, "at", round(avg(exp(-pow((value - "at") / 5, 2) / 2)) / (5 * sqrt(2 * pi())), 9) AS density FROM events, (SELECT CAST(unnest(range(0, 100, 10)) AS DOUBLE) AS "at") GROUP BY ALL')
def densities(spark, sf_dir):
    return tabular.density(table(spark, sf_dir, "events"), "value", range(0, 100, 10), 5.0, "event_type").withColumn("density", F.round("density", 9))


@query("""
SELECT "at", round((xx * y - x * xy) / (w * xx - x * x), 5) AS estimate FROM (
  SELECT "at", sum(k) AS w, sum(k * d) AS x, sum(k * d * d) AS xx, sum(k * p_retailprice) AS y, sum(k * d * p_retailprice) AS xy FROM (
    SELECT "at", p_size - "at" AS d, p_retailprice, CASE WHEN abs(p_size - "at") < 12 THEN pow(1 - pow(abs(p_size - "at") / 12.0::DOUBLE, 3), 3) ELSE 0 END AS k FROM part, (SELECT CAST(unnest(range(5, 50, 10)) AS DOUBLE) AS "at")) GROUP BY "at")""")
def local_regression(spark, sf_dir):
    return tabular.local_regression(table(spark, sf_dir, "part"), "p_size", "p_retailprice", range(5, 50, 10), 12.0).withColumn("estimate", F.round("estimate", 5))


@query("SELECT l_suppkey, median(l_extendedprice) AS median FROM lineitem GROUP BY l_suppkey")
def median_by_totals(spark, sf_dir):
    """The way of groups with many different values."""
    return tabular.medians_by_totals(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_suppkey")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
def label_mapping(spark, sf_dir):
    return tabular.mapped(table(spark, sf_dir, "orders"), "o_orderstatus", {"O": 1, "F": 2}, "code").select("o_orderkey", "code")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O')::DOUBLE / count(*) AS p_O, count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) AS p_F FROM lineitem GROUP BY l_returnflag")
def confusion_matrix(spark, sf_dir):
    return tabular.confusion(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


# ---- models


def _sizes(spark) -> DataFrame:
    return spark.range(1, 51, 7).select(F.col("id").cast("double").alias("at"))


_AT = "(SELECT CAST(unnest(range(1, 51, 7)) AS DOUBLE) AS \"at\")"


@query(f'SELECT "at", round(sum(exp(-(p_size - "at") * (p_size - "at") / 9.0) * p_retailprice) / sum(exp(-(p_size - "at") * (p_size - "at") / 9.0)), 4) AS estimate FROM part, {_AT} q GROUP BY "at"')
def kernel_regression(spark, sf_dir):
    found = ml.kernel_regression(table(spark, sf_dir, "part"), _sizes(spark), "p_size", "p_retailprice", "at", 9.0)
    return found.select("at", F.round("estimate", 4).alias("estimate"))


@query(f'SELECT "at", round(avg(p_retailprice), 4) AS estimate FROM (SELECT "at", p_retailprice, row_number() OVER (PARTITION BY "at" ORDER BY (p_size - "at") * (p_size - "at"), p_partkey) AS r FROM part, {_AT} q) WHERE r <= 5 GROUP BY "at"')
def knn_regression(spark, sf_dir):
    found = ml.knn_regression(table(spark, sf_dir, "part"), _sizes(spark), "p_size", "p_retailprice", "p_partkey", "at", 5)
    return found.select("at", F.round("estimate", 4).alias("estimate"))


_KNN = "SELECT s_suppkey, c_mktsegment, row_number() OVER (PARTITION BY s_suppkey ORDER BY (c_nationkey - s_nationkey) * (c_nationkey - s_nationkey) / 9.0::DOUBLE + (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal), c_custkey) AS r FROM customer, supplier"
_KNN_AXES = {"c_nationkey": ("s_nationkey", 9.0), "c_acctbal": ("s_acctbal", 1.0)}


def _neighbours(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")


@query(f"SELECT s_suppkey, c_mktsegment, count(*) / 5.0::DOUBLE AS share FROM ({_KNN}) WHERE r <= 5 GROUP BY ALL")
def knn_proba(spark, sf_dir):
    return ml.knn_votes(*_neighbours(spark, sf_dir), _KNN_AXES, "c_mktsegment", "c_custkey", "s_suppkey", 5)


@query(f"SELECT s_suppkey, arg_min(c_mktsegment, {{'n': -n, 'c': c_mktsegment}}) AS predicted FROM (SELECT s_suppkey, c_mktsegment, count(*) AS n FROM ({_KNN}) WHERE r <= 5 GROUP BY ALL) GROUP BY s_suppkey")
def knn_classify(spark, sf_dir):
    return ml.knn_classify(*_neighbours(spark, sf_dir), _KNN_AXES, "c_mktsegment", "c_custkey", "s_suppkey", 5)


@query("SELECT round(regr_slope(p_retailprice, p_size), 4) AS slope, round(regr_intercept(p_retailprice, p_size), 3) AS intercept FROM part")
def least_squares(spark, sf_dir):
    w = ml.least_squares(table(spark, sf_dir, "part"), [F.lit(1.0), F.col("p_size").cast("double")], F.col("p_retailprice"))
    return spark.range(1).select(F.round(F.lit(float(w[1])), 4).alias("slope"), F.round(F.lit(float(w[0])), 3).alias("intercept"))


@query("SELECT p_partkey, round(pow(p_retailprice / 181.0::DOUBLE, 1), 9) AS a1, round(pow(p_size / 181.0::DOUBLE, 9), 15) AS a9, round(exp(-pow(p_size * 20 / 400.0::DOUBLE - (3 + 7) / 8.0::DOUBLE, 2) / 5), 9) AS b3, round(cos(p_size / 1.81::DOUBLE / 9), 9) AS c9, round(cos(p_size / 0.181::DOUBLE / 49), 9) AS d49, 60 AS functions FROM part")
def basis_expansion(spark, sf_dir):
    """The four named sets: their first or last functions, and how many there are beside the constant."""
    x, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    a, b, c, d = ml.basis(x, "a"), ml.basis(x * 20, "b"), ml.basis(x, "c"), ml.basis(x, "d")
    columns = {"a1": F.round(ml.basis(price, "a")[1], 9), "a9": F.round(a[9], 15), "b3": F.round(b[3], 9), "c9": F.round(c[9], 9), "d49": F.round(d[49], 9)}
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in columns.items()], F.lit(len([a, b, c, d]) + len(b) + len(d) - 4).alias("functions"))


@query("SELECT round(avg((p_retailprice - (900 + p_size)) * (p_retailprice - (900 + p_size))), 3) AS mse FROM part")
def mean_squared_error(spark, sf_dir):
    return ml.mean_squared_error(table(spark, sf_dir, "part"), F.col("p_retailprice"), F.col("p_size") + 900).select(F.round("mse", 3).alias("mse"))


@query("SELECT o_orderstatus, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS prior, round(avg(o_totalprice), 2) AS mean_x, round(avg(o_custkey), 4) AS mean_y, round(covar_pop(o_totalprice, o_custkey) / 1e6, 3) AS cov FROM orders GROUP BY o_orderstatus")
def gaussian_parameters(spark, sf_dir):
    found = ml.gaussian_parameters(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", "o_orderstatus")
    return found.select("o_orderstatus", "n", "prior", F.round("mean_x", 2).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"), F.round(F.col("cov") / 1e6, 3).alias("cov"))


@query("""
WITH g AS (SELECT o_orderstatus AS c, ln(count(*)::DOUBLE / (SELECT count(*) FROM orders)) AS prior, avg(o_totalprice) AS mx, avg(o_custkey) AS my, var_pop(o_totalprice) AS vx, var_pop(o_custkey) AS vy, covar_pop(o_totalprice, o_custkey) AS cov FROM orders GROUP BY c),
d AS (SELECT c, prior, mx, my, vx, vy, cov, vx * vy - cov * cov AS det FROM g),
s AS (SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, c, prior - 0.5 * ln(det) - ((o_totalprice - mx) * (o_totalprice - mx) * vy - (o_totalprice - mx) * (o_custkey - my) * 2 * cov + (o_custkey - my) * (o_custkey - my) * vx) / det / 2 AS score FROM orders, d)
SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, arg_max(c, score) AS predicted FROM s GROUP BY ALL""")
def gaussian_classify(spark, sf_dir):
    return ml.gaussian_classify(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus"), "o_totalprice", "o_custkey", "o_orderstatus", shared=False)


@query("""
WITH RECURSIVE d AS (SELECT p_size / 50.0::DOUBLE AS x, CASE WHEN p_retailprice > 1400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM part),
w(r, w0, w1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT r + 1, any_value(w0) - avg(1 / (1 + exp(-(w0 + w1 * x))) - y), any_value(w1) - avg((1 / (1 + exp(-(w0 + w1 * x))) - y) * x) FROM w, d WHERE r < 20 GROUP BY r)
SELECT round(w0, 8) AS w0, round(w1, 8) AS w1 FROM w WHERE r = 20""")
def logistic_regression(spark, sf_dir):
    x, y = [F.lit(1.0), F.col("p_size") / 50], (F.col("p_retailprice") > 1400).cast("double")
    w = ml.logistic_regression(table(spark, sf_dir, "part"), x, y, 1.0, 20)
    return spark.range(1).select(*[F.lit(round(float(v), 8)).alias(f"w{i}") for i, v in enumerate(w)])


def _softmax_sql(rate: float, rounds: int, l2: float) -> str:
    scores = [f"a{i} + b{i} * x" for i in range(3)]
    exps = ", ".join(f"exp({s}) AS e{i}" for i, s in enumerate(scores))
    grads = ", ".join(f"any_value(a{i}) - {rate} * (sum(e{i} / (e0 + e1 + e2) - (c = {i})::INT) + {l2} * any_value(a{i})), any_value(b{i}) - {rate} * (sum((e{i} / (e0 + e1 + e2) - (c = {i})::INT) * x) + {l2} * any_value(b{i}))" for i in range(3))
    return f"""
WITH RECURSIVE d AS (SELECT o_orderkey, o_totalprice / 100000.0::DOUBLE AS x, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS c FROM orders),
w(r, a0, b0, a1, b1, a2, b2) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT r + 1, {grads} FROM (SELECT w.*, x, c, {exps} FROM w, d WHERE r < {rounds}) GROUP BY r)
SELECT o_orderkey, CASE WHEN a0 + b0 * x >= greatest(a1 + b1 * x, a2 + b2 * x) THEN 'F' WHEN a1 + b1 * x >= a2 + b2 * x THEN 'O' ELSE 'P' END AS predicted FROM d, w WHERE r = {rounds}"""


@query(_softmax_sql(1e-4, 10, 0.001))
def softmax_regression(spark, sf_dir):
    df, x, classes = table(spark, sf_dir, "orders"), [F.lit(1.0), F.col("o_totalprice") / 100_000], ["F", "O", "P"]
    w = ml.softmax_regression(df, x, F.col("o_orderstatus"), classes, 1e-4, 10, 0.001)
    return df.select("o_orderkey", ml.softmax_class(x, w, classes).alias("predicted"))


def _mixture_sql(rates: list[float], rounds: int) -> str:
    n = range(len(rates))
    parts = ", ".join(f"t{i} * b{i} * b{i} * value * exp(-b{i} * value) AS e{i}" for i in n)  # Gamma(2, b)
    total = " + ".join(f"e{i}" for i in n)
    step = ", ".join(f"sum(e{i} / ({total})) / count(*), 2 * sum(e{i} / ({total})) / sum(e{i} / ({total}) * value)" for i in n)
    return f"""
WITH RECURSIVE d AS (SELECT value FROM events WHERE value > 0),
w(r, {", ".join(f"t{i}, b{i}" for i in n)}) AS (SELECT 0, {", ".join(f"1 / {len(rates)}.0::DOUBLE, {b}::DOUBLE" for b in rates)} UNION ALL
  SELECT r + 1, {step} FROM (SELECT r, value, {parts} FROM w, d WHERE r < {rounds}) GROUP BY r)
SELECT {", ".join(f"round(t{i}, 7) AS theta{i}, round(b{i}, 7) AS beta{i}" for i in n)} FROM w WHERE r = {rounds}"""


@query(_mixture_sql([0.05, 0.2, 1.0], 10))
def gamma_mixture(spark, sf_dir):
    theta, beta, _ = ml.gamma_mixture(table(spark, sf_dir, "events").where("value > 0"), "value", 2.0, [0.05, 0.2, 1.0], 10)
    return spark.range(1).select(*[F.lit(round(float(v), 7)).alias(f"theta{i}") for i, v in enumerate(theta)], *[F.lit(round(float(v), 7)).alias(f"beta{i}") for i, v in enumerate(beta)])


def _components_sql(rounds: int = 400) -> str:
    """Eigenvalues by power iteration: of the covariances, then of what is left of them without the first component."""
    names, n = ["a", "b", "c", "d"], range(4)
    cell = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    cells = [(i, j) for i in n for j in range(i, 4)]
    times = lambda i: " + ".join(f"{cell(i, j)} * v{j}" for j in n)
    power = lambda name, source: f"""{name}(r, {", ".join(f"v{i}" for i in n)}) AS (SELECT 0, 0.9::DOUBLE, 0.7::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE UNION ALL
  SELECT r + 1, {", ".join(f"u{i} / sqrt(u0 * u0 + u1 * u1 + u2 * u2 + u3 * u3)" for i in n)} FROM (SELECT r, {", ".join(f"{times(i)} AS u{i}" for i in n)} FROM {name}, {source}) WHERE r < {rounds}),
{name}_value AS (SELECT {" + ".join(f"v{i} * ({times(i)})" for i in n)} AS l, {", ".join(f"v{i}" for i in n)} FROM {name}, {source} WHERE r = {rounds})"""  # noqa: E731
    return f"""
WITH RECURSIVE x AS (SELECT l_quantity / 50.0::DOUBLE AS a, l_extendedprice / 100000.0::DOUBLE AS b, l_discount * 20.0::DOUBLE AS c, l_tax * 10.0::DOUBLE AS d FROM lineitem),
m AS (SELECT {", ".join(f"covar_pop({names[i]}, {names[j]}) AS {cell(i, j)}" for i, j in cells)} FROM x),
{power("p", "m")},
m2 AS (SELECT {", ".join(f"{cell(i, j)} - l * v{i} * v{j} AS {cell(i, j)}" for i, j in cells)} FROM m, p_value),
{power("q", "m2")}
SELECT round(m00 + m11 + m22 + m33 - p_value.l - q_value.l, 8) AS error, round(p_value.l / (m00 + m11 + m22 + m33), 8) AS share0, round((p_value.l + q_value.l) / (m00 + m11 + m22 + m33), 8) AS share1 FROM m, p_value, q_value"""


@query(_components_sql())
def principal_components(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    columns = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100_000, F.col("l_discount") * 20, F.col("l_tax") * 10]
    mean, parts, shares = ml.principal_components(df, columns, 2)
    error = ml.reconstruction_error(df, columns, mean, parts)
    return error.select(F.round("error", 8).alias("error"), *[F.lit(round(float(s), 8)).alias(f"share{i}") for i, s in enumerate(shares[:2])])


_MOVES = "(SELECT user_id % 6 AS state, length(event_type) % 3 AS action, event_id % 6 AS \"to\", value AS reward FROM events)"


def _moves(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(6)).cast("int").alias("state"), F.pmod(F.length("event_type"), F.lit(3)).cast("int").alias("action"), F.pmod("event_id", F.lit(6)).cast("int").alias("to"), F.col("value").alias("reward"))


@query(f"""
WITH RECURSIVE t AS (SELECT state, action, "to", count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY state, action) AS p, sum(reward) / sum(count(*)) OVER (PARTITION BY state, action) AS r FROM {_MOVES} GROUP BY state, action, "to"),
v(k, state, value, action) AS (SELECT 0, state, 0.0::DOUBLE, 0::BIGINT FROM (SELECT unnest(range(6)) AS state) UNION ALL
  SELECT k + 1, state, max(q), arg_max(action, q) FROM (SELECT k, t.state, t.action, sum(t.r + 0.9 * t.p * v.value) AS q FROM v JOIN t ON t."to" = v.state WHERE k < 400 GROUP BY k, t.state, t.action) GROUP BY k, state)
SELECT CAST(state AS INTEGER) AS state, round(value, 6) AS value, CAST(action AS INTEGER) AS action FROM v WHERE k = 400""")
def decision_process(spark, sf_dir):
    """Policy iteration here, 400 rounds of value iteration in SQL."""
    e = _moves(spark, sf_dir).withColumn("w", F.lit(1.0))
    total = e.groupBy("state", "action").agg(F.sum("w").alias("all"))
    moves = e.join(total, ["state", "action"]).select("state", "action", "to", (F.col("w") / F.col("all")).alias("p"), "reward")
    v, policy = ml.policy_iteration(moves, 6, 0.9)
    return spark.createDataFrame([(i, round(float(a), 6), int(b)) for i, (a, b) in enumerate(zip(v, policy))], "state int, value double, action int")


@query(f"""
WITH RECURSIVE t AS (SELECT state, action, "to", count(*) AS n, sum(reward) AS r FROM {_MOVES} GROUP BY ALL),
q(k, state, action, v) AS (SELECT 0, state, action, 0.0::DOUBLE FROM (SELECT DISTINCT state, action FROM t) UNION ALL
  SELECT k + 1, state, action, any_value(v) + 0.5 * (sum(r + 0.9 * n * best) / sum(n) - any_value(v)) FROM (
    SELECT q.k, q.state, q.action, q.v, t.r, t.n, greatest(max(o.v), (SELECT CASE WHEN count(DISTINCT action) < 3 THEN 0.0 ELSE min(-1e300) END FROM t x WHERE x.state = t."to")) AS best
    FROM q JOIN t ON q.state = t.state AND q.action = t.action JOIN q o ON o.state = t."to" WHERE q.k < 20 GROUP BY q.k, q.state, q.action, q.v, t."to", t.r, t.n) GROUP BY k, state, action)
SELECT CAST(state AS INTEGER) AS state, CAST(action AS INTEGER) AS action, round(v, 6) AS value FROM q WHERE k = 20""")
def q_learning(spark, sf_dir):
    moves = _moves(spark, sf_dir)
    seen = {(r.state, r.action) for r in moves.select("state", "action").distinct().collect()}
    q = ml.q_values(moves, 6, 3, 0.9, 0.5, 20)
    return spark.createDataFrame([(i, j, round(float(q[i, j]), 6)) for i, j in sorted(seen)], "state int, action int, value double")


def _uniform_sql(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@query(f"""
WITH RECURSIVE a(id, i, t) AS (SELECT id, 0, -ln({_uniform_sql("id", "0", "0")}) / 2.0::DOUBLE FROM (SELECT unnest(range(2000)) AS id) UNION ALL
  SELECT id, i + 1, t - ln({_uniform_sql("id", "i + 1", "0")}) / 2.0::DOUBLE FROM a WHERE t <= 3.0)
SELECT avg(n) AS mean, round(stddev_samp(n), 9) AS sd FROM (SELECT id, count(*) FILTER (t <= 3.0) AS n FROM a GROUP BY id)""")
def poisson_arrivals(spark, sf_dir):
    return ml.arrivals(spark, 2000, 2.0, 3.0, block=8).withColumn("sd", F.round("sd", 9))


_LLOYD = [(0.1, 0.5), (0.5, 0.7), (0.9, 0.9)]


@query(f"""
WITH RECURSIVE d AS (SELECT p_size / 50.0::DOUBLE AS x, p_retailprice / 2000.0::DOUBLE AS y FROM part),
k(r, {", ".join(f"x{i}, y{i}" for i in range(3))}) AS (SELECT 0, {", ".join(f"{x}::DOUBLE, {y}::DOUBLE" for x, y in _LLOYD)} UNION ALL
  SELECT r + 1, {", ".join(f"coalesce(avg(x) FILTER (c = {i}), any_value(x{i})), coalesce(avg(y) FILTER (c = {i}), any_value(y{i}))" for i in range(3))} FROM (
    SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS c FROM (
      SELECT k.*, x, y, {", ".join(f"(x - x{i}) * (x - x{i}) + (y - y{i}) * (y - y{i}) AS d{i}" for i in range(3))} FROM k, d WHERE r < 6)) GROUP BY r)
SELECT {", ".join(f"round(x{i}, 9) AS x{i}, round(y{i}, 9) AS y{i}" for i in range(3))} FROM k WHERE r = 6""")
def kmeans(spark, sf_dir):
    df = table(spark, sf_dir, "part").select((F.col("p_size") / 50).alias("x"), (F.col("p_retailprice") / 2000).alias("y"))
    centres = ml.clusters(df, ["x", "y"], _LLOYD, 6)
    return spark.range(1).select(*[F.lit(round(float(v), 9)).alias(f"{a}{i}") for i, c in enumerate(centres) for a, v in zip("xy", c)])


@query()
def neural_network(spark, sf_dir):
    """The share of rows that a small network tells right; its start is random, so SQL has no counterpart."""
    df = table(spark, sf_dir, "part")
    x, y = [F.col("p_size") / 50, F.col("p_retailprice") / 2000], (F.col("p_retailprice") > 1400).cast("int")
    layers = ml.perceptron(df, x, y, 2, 8, 2.0, 60)
    return df.agg(F.avg((ml.perceptron_class(x, layers) == y).cast("int")).alias("accuracy"))


# ---- graphs, matrices, texts


def _forest_sql(edges: str) -> str:
    """Prim's algorithm from the smallest node of each component: each step takes the lightest edge out of what is reached."""
    return f"""
WITH RECURSIVE e AS ({edges}),
n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
reach(node, least) AS (SELECT node, node FROM n UNION SELECT r.node, CASE WHEN e.a = r.least THEN e.b ELSE e.a END FROM reach r JOIN e ON e.a = r.least OR e.b = r.least),
roots AS (SELECT DISTINCT root FROM (SELECT node, min(least) AS root FROM reach GROUP BY node)),
p(root, seen, k, w) AS (SELECT root, [root], 0, 0.0::DOUBLE FROM roots UNION ALL
  SELECT root, list_append(seen, node), k + 1, w FROM (SELECT root, seen, k, e.w, CASE WHEN list_contains(seen, a) THEN b ELSE a END AS node, row_number() OVER (PARTITION BY root ORDER BY e.w, a, b) AS place
    FROM p JOIN e ON list_contains(seen, a) <> list_contains(seen, b)) WHERE place = 1)
SELECT count(*) FILTER (k > 0) AS edges, round(sum(w), 9) AS total FROM p"""


def _weighed(forest: DataFrame) -> DataFrame:
    return forest.agg(F.count("*").alias("edges"), F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 9).alias("total"))


@query(_forest_sql("SELECT least(l_suppkey, l_partkey % 40) AS a, greatest(l_suppkey, l_partkey % 40) AS b, CAST(min(l_quantity * 1000 + l_linenumber) AS DOUBLE) AS w FROM lineitem WHERE l_suppkey <> l_partkey % 40 GROUP BY 1, 2"))
def forest_size(spark, sf_dir):
    """The edges of a minimum spanning forest and their weight."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.pmod("l_partkey", F.lit(40)).alias("b"), (F.col("l_quantity") * 1000 + F.col("l_linenumber")).cast("double").alias("w"))
    return _weighed(graphs.spanning_forest(rows))


@query(_forest_sql(f"SELECT a, b, {_uniform_sql('a', 'b', '3')} AS w FROM (SELECT unnest(range(96)) AS a) JOIN (SELECT unnest(range(96)) AS b) ON a < b"))
def random_graph_tree(spark, sf_dir):
    return _weighed(graphs.random_tree(spark, 96, seed=3))


def _points(spark, count: int, axes: int) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("node"), *[ml.uniform(F.col("id"), F.lit(axes), F.lit(i)).alias(f"x{i}") for i in range(axes)])


def _points_sql(count: int, axes: int) -> str:
    columns = ", ".join(f"{_uniform_sql('node', str(axes), str(i))} AS x{i}" for i in range(axes))
    square = " + ".join(f"(p.x{i} - q.x{i}) * (p.x{i} - q.x{i})" for i in range(axes))
    return f"SELECT p.node AS a, q.node AS b, sqrt({square}) AS w FROM (SELECT node, {columns} FROM (SELECT unnest(range({count})) AS node)) p JOIN (SELECT node, {columns} FROM (SELECT unnest(range({count})) AS node)) q ON p.node < q.node"


@query(" UNION ALL ".join(f"SELECT {d} AS axes, * FROM ({_forest_sql(_points_sql(40, d))})" for d in (2, 3, 4)))
def euclidean_tree(spark, sf_dir):
    """Exact trees of points in two, three and four dimensions."""
    found = None
    for d in (2, 3, 4):
        tree = _weighed(graphs.euclidean_tree(_points(spark, 40, d), [f"x{i}" for i in range(d)], 3 / 40 ** (1 / d))).select(F.lit(d).alias("axes"), "edges", "total")
        found = tree if found is None else found.union(tree)
    return found


@query(f"""
WITH RECURSIVE e AS ({_points_sql(60, 2)}),
cut AS (SELECT max(w) AS far FROM (SELECT w FROM (
  WITH RECURSIVE p(seen, k, w) AS (SELECT [0::BIGINT], 0, 0.0::DOUBLE UNION ALL
    SELECT list_append(seen, node), k + 1, w FROM (SELECT seen, k, e.w, CASE WHEN list_contains(seen, a) THEN b ELSE a END AS node, row_number() OVER (ORDER BY e.w, a, b) AS place FROM p JOIN e ON list_contains(seen, a) <> list_contains(seen, b)) WHERE place = 1)
  SELECT w FROM p WHERE k > 0) ORDER BY w LIMIT 55)),
r(node, least) AS (SELECT unnest(range(60)), unnest(range(60)) UNION SELECT r.node, CASE WHEN a = least THEN b ELSE a END FROM r JOIN e ON (a = least OR b = least) AND w <= (SELECT far FROM cut))
SELECT node, min(least) AS cluster FROM r GROUP BY node""")
def linkage(spark, sf_dir):
    """Five single-linkage clusters."""
    return graphs.linkage_clusters(_points(spark, 60, 2), ["x0", "x1"], 5, 0.25)


_A = "(SELECT l_linenumber AS i, CAST(l_suppkey AS INTEGER) AS j, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY ALL)"
_B = "(SELECT CAST(l_suppkey AS INTEGER) AS i, l_linenumber AS j, count(*) AS v FROM lineitem GROUP BY ALL)"


def _matrices(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_suppkey").cast("int").alias("s"))
    a = rows.groupBy(F.col("n").alias("i"), F.col("s").alias("j")).agg(F.sum("n").alias("v"))
    return a, rows.groupBy(F.col("s").alias("i"), F.col("n").alias("j")).agg(F.count("*").alias("v"))


@query(f"SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {_A} a JOIN {_B} b ON a.j = b.i GROUP BY a.i, b.j")
def matrix_multiply(spark, sf_dir):
    return matrix.multiply(*_matrices(spark, sf_dir))


@query(f"SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {_A} a JOIN {_B} b ON a.j = b.i GROUP BY a.i, b.j")
def matrix_multiply_blocked(spark, sf_dir):
    return matrix.multiply_blocked(*_matrices(spark, sf_dir), 16)


def _added(sign: int) -> str:
    return f"SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, j, v FROM {_A} UNION ALL SELECT j, i, {sign} * v FROM {_B}) GROUP BY i, j"


@query(_added(1))
def matrix_add(spark, sf_dir):
    a, b = _matrices(spark, sf_dir)
    return matrix.add(a, b.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query(_added(-1))
def matrix_subtract(spark, sf_dir):
    a, b = _matrices(spark, sf_dir)
    return matrix.add(a, b.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), -1)


@query(r"SELECT doc_id, CAST(strlen(coalesce(text, '')) - strlen(replace(coalesce(text, ''), chr(10), '')) AS INTEGER) AS lines, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS INTEGER) AS words, CAST(strlen(coalesce(text, '')) AS INTEGER) AS bytes FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in text.counts("text").items()])


@query("SELECT page_id, CAST(strpos(html, 'href') AS INTEGER) AS place FROM pages")
def substring_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.found_at("html", "href").alias("place"))


@query("SELECT c_mktsegment, c_name, row_number() OVER (ORDER BY c_mktsegment, c_name) - 1 AS place FROM customer")
def bytewise_sort(spark, sf_dir):
    return text.sorted_bytewise(table(spark, sf_dir, "customer").select("c_mktsegment", "c_name"), "c_mktsegment", "c_name")


@query("SELECT * FROM (SELECT o_custkey, o_orderstatus, CAST(sum(o_orderkey) AS BIGINT) AS total, count(*) AS n, sum(o_orderkey) * 100.0::DOUBLE / (SELECT sum(o_orderkey) FROM orders) AS percent FROM orders GROUP BY ALL) WHERE percent >= 0.02")
def heavy_hitters(spark, sf_dir):
    return text.heavy_hitters(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey", 0.02)


@query("SELECT doc_id, source, turn, place, place % 4 AS sink FROM (SELECT doc_id, source, turn, row_number() OVER (ORDER BY turn, source) - 1 AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents))")
def scatter_gather(spark, sf_dir):
    return text.scatter_gather(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4)
