"""The command language and the API against pandas, over generated tables of several seeds."""

import numpy as np
import pandas as pd
import pytest

from quern.errors import BatchError, LengthMismatch, ParseError, QuernError, UnknownName
from quern.operators.engine import Engine
from quern.plans import batch
from quern.plans.parser import parse
from quern.plans.session import Session, show

N = 400


def data(seed):
    rng = np.random.default_rng(seed)
    col1 = rng.integers(-N // 2, N // 2, N)
    return pd.DataFrame({"col1": col1, "col2": rng.integers(-N // 2, N // 2, N) + col1, "col3": rng.integers(0, 100, N), "col4": rng.integers(2**31 - 10000, 2**31, N)})


def write(df, path, table, final_newline=True, sep=","):
    text = ",".join(f"db1.{table}.{c}" for c in df.columns) + "\n" + "\n".join(sep.join(map(str, r)) for r in df.itertuples(index=False))
    path.write_text(text + ("\n" if final_newline else ""))
    return str(path)


def begun(spark, df, tmp_path, table="tbl2", path=None, **options):
    s = Session(spark, path)
    lines = ['create(db,"db1")', f'create(tbl,"{table}",db1,{len(df.columns)})', *[f'create(col,"{c}",db1.{table})' for c in df.columns]]
    out = s.run([*lines, f'load("{write(df, tmp_path / f"{table}.csv", table, **options)}")'])
    assert out == ""
    return s


@pytest.mark.parametrize("seed", [42, 7])
def test_selects_aggregates_and_vectors(spark, tmp_path, seed):
    df = data(seed)
    s = begun(spark, df, tmp_path, final_newline=seed == 42, sep="," if seed == 42 else ", ")
    out = s.run("""
-- open bounds, in position order
s1=select(db1.tbl2.col1,null,20)
f1=fetch(db1.tbl2.col2,s1)
print(f1)
s2=select(db1.tbl2.col1,-30,31) -- a range
s3=select(s2,f9,0,1)
f2=fetch(db1.tbl2.col2,s2)
s3=select(s2,f2,null,10)
f3=fetch(db1.tbl2.col3,s3)
f4=fetch(db1.tbl2.col4,s3)
a1=avg(f3)
m1=min(f3)
m2=max(f4)
x=add(f3,f4)
y=sub(f3,f4)
t1=sum(x)
t2=avg(y)
print(a1,m1,m2,t1,t2)
print(s3)
w=sum(db1.tbl2.col4)
print(w)
e=select(db1.tbl2.col1,500,600)
g=fetch(db1.tbl2.col1,e)
z1=sum(g)
z2=avg(g)
z3=min(g)
print(e,z1,z2,z3)
""").splitlines()
    below = df[df.col1 < 20]
    assert out[: len(below)] == [str(v) for v in below.col2]
    rest = out[len(below) :]
    assert rest[0] == "ERROR: no handle f9"
    r = df[(df.col1 >= -30) & (df.col1 < 31) & (df.col2 < 10)]
    long = r.astype("int64")
    assert rest[1] == f"{show(float(r.col3.mean()))},{r.col3.min()},{r.col4.max()},{(long.col3 + long.col4).sum()},{show(float((long.col3 - long.col4).mean()))}"
    assert rest[2:4] == [str(len(r)), str(df.col4.sum())]
    assert rest[4] == "0,0,0.00,2147483647"


def test_batches_share_one_scan(spark, tmp_path):
    df = data(3)
    s = begun(spark, df, tmp_path)
    lines = ["batch_queries()"]
    for i in range(10):
        lines += [f"s{i}=select(db1.tbl2.col1,{i * 10},{i * 10 + 25})", f"f{i}=fetch(db1.tbl2.col2,s{i})", f"a{i}=sum(f{i})"]
    assert s.run(lines) == ""
    with pytest.raises(BatchError):
        s.execute("print(a1)")
    s.execute("batch_execute()")
    with pytest.raises(BatchError):
        s.execute("batch_execute()")
    want = [df[(df.col1 >= i * 10) & (df.col1 < i * 10 + 25)].col2 for i in range(10)]
    assert all(s.handles[f"a{i}"].known for i in range(10))
    assert s.run([f"print({','.join(f'a{i}' for i in range(10))})"]) == ",".join(str(w.sum()) for w in want) + "\n"
    fresh = [s.engine.aggregate("sum", s.handles[f"f{i}"]) for i in range(10)]
    plan = batch.shared_aggregates([(a, *batch._root(a.rel)) for a in fresh])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    tagged = batch.shared_vectors([s.handles[f"f{i}"] for i in range(10)])
    assert tagged._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = tagged.toPandas()
    for i, w in enumerate(want):
        assert sorted(got[got["query"] == i].v) == sorted(w)


def test_plans_push_down_and_hint(spark, sf):
    e = Engine(spark)
    e.register("lineitem", spark.read.parquet(f"{sf}/lineitem.parquet"))
    e.register("part", spark.read.parquet(f"{sf}/part.parquet"))
    s = e.select("db.lineitem.l_partkey", 10, 50)
    s = e.reselect(s, e.fetch("db.lineitem.l_suppkey", s), 2, None)
    v = e.fetch("db.lineitem.l_linenumber", s)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = text(v.frame())
    assert "OrEqual(l_partkey,10)" in plan and "LessThan(l_partkey" in plan and plan.count(") Filter") == 1
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan
    p = e.select("db.part.p_size", None, 10)
    for how, node in (("hash", "ShuffledHashJoin"), ("grace-hash", "SortMergeJoin")):
        a, b = e.join(e.fetch("db.lineitem.l_partkey", s), s, e.fetch("db.part.p_partkey", p), p, how)
        assert node in text(e.frame(x=e.fetch("db.lineitem.l_orderkey", a), y=e.fetch("db.part.p_size", b)))


@pytest.mark.parametrize("how", ["hash", "nested-loop", "grace-hash"])
def test_joins_and_positional_gather(spark, tmp_path, how):
    rng = np.random.default_rng(5)
    fact = pd.DataFrame({"col1": rng.zipf(1.5, 300) % 40, "col2": rng.integers(0, 60, 300), "col3": rng.integers(0, 9, 300), "col4": rng.integers(1, 200, 300)})
    dim = pd.DataFrame({"col1": rng.zipf(1.5, 200) % 40, "col2": rng.integers(0, 40, 200)})
    s = begun(spark, fact, tmp_path, "fact")
    s.run(['create(tbl,"dim",db1,2)', 'create(col,"col1",db1.dim)', 'create(col,"col2",db1.dim)', f'load("{write(dim, tmp_path / "dim.csv", "dim")}")'])
    out = s.run(f"""
p1=select(db1.fact.col2,null,30)
p2=select(db1.dim.col2,null,25)
f1=fetch(db1.fact.col1,p1)
f2=fetch(db1.dim.col1,p2)
t1,t2=join(f1,p1,f2,p2,{how})
c1=fetch(db1.fact.col2,t1)
c2=fetch(db1.dim.col2,t2)
c3=fetch(db1.fact.col3,t2)
n=sum(c1)
m=avg(c2)
k=sum(c3)
d=add(c1,c2)
q=max(d)
u=select(t1,c2,3,9)
print(t1,t2,n,m,k,q,u)
""")
    a, b = fact[fact.col2 < 30].reset_index(), dim[dim.col2 < 25].reset_index()
    j = a.merge(b, on="col1")
    gathered = fact.col3.to_numpy()[j["index_y"]]
    both = (j.col2_x + j.col2_y).max()
    assert out == f"{len(j)},{len(j)},{j.col2_x.sum()},{show(float(j.col2_y.mean()))},{gathered.sum()},{both},{((j.col2_y >= 3) & (j.col2_y < 9)).sum()}\n"


def test_self_join_empty_side_and_reused_handles(spark, tmp_path):
    df = data(9).assign(col3=lambda d: d.col3 % 5)
    s = begun(spark, df, tmp_path)
    out = s.run("""
s1=select(db1.tbl2.col1,-50,-20)
s2=select(db1.tbl2.col1,0,40)
f1=fetch(db1.tbl2.col3,s1)
f2=fetch(db1.tbl2.col3,s2)
s1,s2=join(f1,s1,f2,s2,hash)
a=fetch(db1.tbl2.col1,s1)
b=fetch(db1.tbl2.col1,s2)
x=sum(a)
y=sum(b)
print(s1,x,y)
n=select(db1.tbl2.col1,9000,null)
v=fetch(db1.tbl2.col3,n)
r1,r2=join(v,n,f2,s2,hash)
w=select(db1.tbl2.col1,0,40)
v2=fetch(db1.tbl2.col3,w)
r1,r2=join(v,n,v2,w,hash)
print(r1)
same1,same2=join(v2,w,v2,w,hash)
print(same1)
""")
    a, b = df[(df.col1 >= -50) & (df.col1 < -20)], df[(df.col1 >= 0) & (df.col1 < 40)]
    j = a.merge(b, on="col3")
    lines = out.splitlines()
    assert lines[0] == f"{len(j)},{j.col1_x.sum()},{j.col1_y.sum()}"
    assert lines[-2:] == ["0", str((b.col3.value_counts() ** 2).sum())]
    assert lines[1].startswith("ERROR") and len(lines) == 4  # f2 and s2 no longer stand on the same rows


def test_mutations_versions_and_reopening(spark, tmp_path):
    df = data(11)
    s = begun(spark, df, tmp_path, path=str(tmp_path / "store"))
    s.run(["create(idx,db1.tbl2.col3,sorted,clustered)", "create(idx,db1.tbl2.col2,btree,unclustered)"])
    model = df.copy()
    for i in range(10):
        assert s.run([f"relational_insert(db1.tbl2,{-1000 - i},{i},{i % 3},5)"]) == ""
    model = pd.concat([model, pd.DataFrame({"col1": [-1000 - i for i in range(10)], "col2": range(10), "col3": [i % 3 for i in range(10)], "col4": 5})], ignore_index=True)
    out = s.run("""
u=select(db1.tbl2.col1,-1005,-1000)
old=fetch(db1.tbl2.col2,u)
relational_update(db1.tbl2.col2,u,77)
new=fetch(db1.tbl2.col2,u)
a=sum(new)
print(a)
relational_update(db1.tbl2.col3,u,-3)
d=select(db1.tbl2.col3,0,30)
f=fetch(db1.tbl2.col2,d)
d=select(d,f,null,100)
relational_delete(db1.tbl2,d)
left=fetch(db1.tbl2.col1,u)
print(left)
c=select(db1.tbl2.col4,null,null)
t=sum(db1.tbl2.col2)
print(c,t)
""")
    model.loc[(model.col1 >= -1005) & (model.col1 < -1000), "col2"] = 77
    model.loc[(model.col1 >= -1005) & (model.col1 < -1000), "col3"] = -3
    model = model[~((model.col3 >= 0) & (model.col3 < 30) & (model.col2 < 100))]
    lines = out.splitlines()
    assert lines[0] == str(5 * 77) and lines[1:6] == [str(-1001 - i) for i in range(5)]
    assert lines[6] == f"{len(model)},{model.col2.sum()}"
    assert s.run(["shutdown"]) == ""
    again = Session(spark, str(tmp_path / "store"))
    assert again.run(["c=select(db1.tbl2.col4,null,null)", "t=sum(db1.tbl2.col2)", "print(c,t)"]) == lines[6] + "\n"
    info = again.run(["info"])
    assert f"tbl2.col3 int {len(model)} sorted clustered" in info
    for i in range(45):  # a long chain of versions stays cheap
        again.run([f"relational_insert(db1.tbl2,{5000 + i},0,0,0)", f"p=select(db1.tbl2.col1,{5000 + i},{5001 + i})", "relational_update(db1.tbl2.col2,p,1)" if i % 2 else "relational_delete(db1.tbl2,p)"])
    assert again.run(["p=select(db1.tbl2.col1,5000,null)", "f=fetch(db1.tbl2.col2,p)", "a=sum(f)", "print(p,a)"]) == "22,22\n"


def test_update_through_a_join(spark, tmp_path):
    df = pd.DataFrame({"col1": [1, 2, 3, 4], "col2": [2, 2, 9, 9]})
    s = begun(spark, df, tmp_path, "t")
    out = s.run("""
a=select(db1.t.col1,null,null)
x=fetch(db1.t.col1,a)
y=fetch(db1.t.col2,a)
l,r=join(x,a,y,a,hash)
relational_update(db1.t.col2,l,50)
all=select(db1.t.col1,null,null)
v=fetch(db1.t.col2,all)
print(v)
""")
    assert out.split() == ["2", "50", "9", "9"]


def test_zip_of_different_relations(spark, tmp_path):
    df = data(13)
    s = begun(spark, df, tmp_path)
    s.run(["a=select(db1.tbl2.col1,null,null)", "b=select(db1.tbl2.col3,0,null)", "x=fetch(db1.tbl2.col1,a)", "y=fetch(db1.tbl2.col2,b)", "z=add(x,y)", "q=sum(z)"])
    assert s.run(["print(q)"]) == f"{(df.col1 + df.col2).sum()}\n"
    with pytest.raises(LengthMismatch):
        s.run(["c=select(db1.tbl2.col1,0,5)", "w=fetch(db1.tbl2.col1,c)"])
        s.execute("z=add(x,w)")


def test_open_bounds_keep_the_extremes_and_rounding(spark, tmp_path):
    df = pd.DataFrame({"col1": [-(2**31), 0, 2**31 - 1], "col2": [1, 2, 3]})
    s = begun(spark, df, tmp_path, "t")
    assert s.run(["a=select(db1.t.col1,null,null)", "b=select(db1.t.col1,null,1)", "f=fetch(db1.t.col1,a)", "g=add(f,f)", "t=sum(g)", "print(a,b,t)"]) == "3,2,-2\n"
    assert (show(2.345), show(-2.345), show(0.125)) == ("2.35", "-2.35", "0.13")


def test_parse_errors(spark, tmp_path):
    assert parse("  -- nothing") is None and parse("") is None
    assert parse('a , b = join( x,"y" , z,w, hash ) -- c').handles == ("a", "b")
    assert parse("shutdown and more").name == "shutdown"
    for bad in ("fly(1)", "select(a.b.c,1)", "s=select(a.b.c,1,2", f"{'x' * 70}=avg(f)", "fetch(a,,b)", "create(view,x)", "a,b=sum(f)"):
        with pytest.raises(ParseError):
            parse(bad)
    s = Session(spark)
    for line, error in (("select(db.t.c,12abc,3)", ParseError), ("select(db.t.c,1,2)", UnknownName), ("print(x)", UnknownName), ("relational_update(db.t.c,s,1)", UnknownName), ("relational_insert(db.t,99999999999)", ParseError)):
        with pytest.raises(error):
            s.execute(line)
    path = tmp_path / "bad.csv"
    path.write_text("db1.t.zz\n1\n")
    s.run(['create(db,"db1")', 'create(tbl,"t",db1,1)', 'create(col,"a",db1.t)'])
    with pytest.raises(QuernError):
        s.execute(f"load({path})")
    path.write_text("db1.t.a\n1\nx\n")
    with pytest.raises(Exception):
        s.execute(f"load({path})")
    assert s.run(["select(db1.t.a,1,2)", 'create(tbl,"t",db1,1)']) == "ERROR: table t exists\n"
    clock = Session(spark, clock=iter([1.0, 3.5]).__next__)
    assert clock.run(["t=time()", "d=time(t)", "print(d)"]) == "2500.000000\n"


def test_selections_keep_their_rows_when_rows_are_inserted(spark, tmp_path):
    for files in (1, 4, 40):
        path = f"{tmp_path}/a %2+{files}"
        spark.range(1000).selectExpr("id AS a", "id % 7 AS b").repartition(files).write.parquet(path)
        e = Engine(spark)
        e.register("t", spark.read.parquet(path).select("a", "b"))
        s = e.select("db.t.a")
        e.insert("db.t", (5000, 1))
        v = e.fetch("db.t.a", s)
        assert e.aggregate("sum", v).value == 499500 and v.rel.placed.count() == 1000
        assert e.count(e.select("db.t.a")).value == 1001
        e.update("db.t.b", s, 9)
        assert e.count(e.select("db.t.b", 9, 10)).value == 1000
        e.delete("db.t", s)
        assert [r.v for r in e.whole("db.t.a").ordered().collect()] == [5000]


def test_positions_of_tables_without_lasting_order_and_of_one_row(spark):
    e = Engine(spark)
    e.register("t", spark.range(1).toDF("a"))
    e.update("db.t.a", e.select("db.t.a"), 3)
    e.insert("db.t", (4,))
    rows = e.whole("db.t.a").ordered().collect()
    assert [r.v for r in rows] == [3, 4] and len({r[0] for r in rows}) == 2
    e.register("u", spark.range(100).repartition(7).selectExpr("id AS a", "rand() AS b"))
    s = e.select("db.u.b", 0.5, None)
    assert sorted(map(tuple, s.rel.placed.collect())) == sorted(map(tuple, s.rel.placed.collect()))


def test_saves_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "db")
    e = Engine(spark, path)
    e.create_db("x")
    e.register("t", spark.range(3).selectExpr("CAST(id AS INT) a"))
    e.save()
    e.insert("x.t", (7,))
    e.save()
    (tmp_path / "db" / "x" / "t-cut-off").mkdir()  # a save that did not come to its catalogue
    again = Engine(spark, path)
    assert again.count(again.select("x.t.a")).value == 4
    assert len([p for p in (tmp_path / "db" / "x").iterdir()]) == 1
    assert sorted(r.v for r in again.whole("x.t.a").ordered().collect()) == [0, 1, 2, 7]


def test_many_ranges_by_intervals(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(i % 50 if i % 11 else None, i - 100, float(i)) for i in range(400)], "a int, b int, c double"))
    rows = [r for r in e.db.table("t").current().df.collect()]
    ranges = [(i, i + 7) for i in range(-3, 50, 2)] + [(None, 5), (40, None), (None, None), (9, 9), (20, 10)]
    scalars, want = [], []
    for low, high in ranges:
        s = e.select("db.t.a", low, high)
        hit = [r for r in rows if r.a is not None and (low is None or r.a >= low) and (high is None or r.a < high)]
        b, c = [r.b for r in hit], [r.c for r in hit]
        vb, vc = e.fetch("db.t.b", s), e.fetch("db.t.c", s)
        scalars += [e.count(s), *(e.aggregate(h, vb) for h in ("sum", "avg", "min", "max")), e.aggregate("sum", vc), e.aggregate("avg", vc)]
        want += [len(b), sum(b), sum(b) / len(b) if b else 0.0, min(b, default=None), max(b, default=None), sum(c), sum(c) / len(c) if c else 0.0]
    batch.evaluate(scalars)
    assert [x.value for x in scalars] == want
