"""Behaviour of workspaces, tensors, filters, groups and writes, against numpy."""

import operator
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ndspark import Accumulator, ConflictError, Dimension, Tensor, TensorValue, Transaction, View, Workspace, connect, create_workspace, wrap
from ndspark.functions.scalars import camel_case, tensor_name


def got(ws, name, *filters):
    return View(ws, list(filters)).to_numpy(name)


# -- declared behaviour


def test_two_axes_and_append(ws):
    ws.dim1, ws.dim2 = Dimension(None), Dimension(100)
    ws.Test = Tensor("uint32", ("dim1", "dim2"), inits=np.zeros((1000, 100)))
    ws.dim1.append({"Test": np.zeros((1000, 100))})
    assert ws.dim1.length == 2000 and ws.Test.shape == (2000, 100)


def test_overwrite_slice(ws):
    ws.Test = Tensor("uint32", (None,), chunks=(10,), inits=np.arange(100))
    assert (got(ws, "Test") == np.arange(100)).all()
    ws.Test[:10] = np.full(10, 91)
    assert (got(ws, "Test") == np.r_[np.full(10, 91), np.arange(10, 100)]).all()


def test_scalar(ws):
    ws.Test = Tensor("uint32", (), inits=100)
    assert got(ws, "Test") == 100 and len(ws.Test) == 0
    ws.Test = 7
    assert ws.Test.scalar() == 7


def test_strided_write(ws):
    ws.dim1, ws.dim2 = Dimension(40), Dimension(30)
    ws.Test = Tensor("float32", ("dim1", "dim2"), inits=np.arange(1200).reshape(40, 30))
    want = np.arange(1200, dtype="float32").reshape(40, 30)
    want[0:40:10, 0:30:10] = np.arange(12).reshape(4, 3)
    ws.Test[0:40:10, 0:30:10] = np.arange(12).reshape(4, 3)
    assert (got(ws, "Test") == want).all()
    with pytest.raises(ValueError):
        ws.Test[0:40:10, 0:30:10] = np.zeros((40, 3))


def test_append_on_either_axis(ws):
    ws.dim1, ws.dim2 = Dimension(20), Dimension(None)
    a, b = np.random.default_rng(0).integers(0, 9, (20, 30)), np.random.default_rng(1).integers(0, 9, (30, 20))
    ws.Test1 = Tensor("float32", ("dim1", "dim2"), inits=a)
    ws.Test2 = Tensor("int16", ("dim2", "dim1"), inits=b)
    with pytest.raises(AssertionError):
        ws.dim1.append({"Test1": np.zeros((1, 30))})
    with pytest.raises(ValueError):
        ws.dim2.append({"Test1": np.zeros((21, 4)), "Test2": np.zeros((4, 20))})
    with pytest.raises(ValueError):
        ws.dim2.append({"Test1": np.zeros((20, 4))})
    ws.dim2.append({"Test1": np.ones((20, 4)), "Test2": np.ones((4, 20))})
    assert ws.dim2.length == 34
    assert (got(ws, "Test1") == np.hstack([a, np.ones((20, 4))])).all()
    assert (got(ws, "Test2") == np.vstack([b, np.ones((4, 20))])).all()
    ws.Test3 = Tensor("uint8", ("dim2",))
    with pytest.raises(ValueError):
        ws.Test3.append(np.zeros(33))
    ws.Test3.append(np.ones(34))  # catches up
    assert ws.Test3.shape == (34,) and ws.dim2.length == 34


def test_jagged(ws):
    rows = [np.arange(4 * x).reshape(x, 4) for x in range(1, 11)]
    ws.dim1 = Dimension(10)
    ws.Test = Tensor("float32", ("dim1", None, 4), jagged=True, inits=rows)
    assert all((a == b).all() for a, b in zip(got(ws, "Test"), rows, strict=True))
    cut = ws.Test.view((slice(2, None), slice(0, 2), slice(1, 3))).to_numpy("Test")
    assert all((a == b[:2, 1:3]).all() for a, b in zip(cut, rows[2:], strict=True))
    ws.Test[1:3] = [np.ones((2, 4)), np.zeros((5, 4))]
    assert [r.shape for r in got(ws, "Test")][:4] == [(1, 4), (2, 4), (5, 4), (4, 4)]


def test_jagged_append(ws):
    ws.cells, ws.yx = Dimension(None), Dimension(2)
    ws.Coord = Tensor("uint8", ("cells", "yx", None), jagged=True)
    for i in range(1, 4):
        ws.cells.append({"Coord": [np.full((2, i), i)]})
    assert [r.shape for r in got(ws, "Coord")] == [(2, 1), (2, 2), (2, 3)] and ws.Coord.shape == (3, 2, 3)


def test_self_filter(ws):
    ws.dim1 = Dimension(10)
    ws.Test = Tensor("float32", ("dim1",), inits=np.arange(10))
    assert (ws.Test.view(ws.Test > 2).to_numpy("Test") == np.arange(3, 10)).all()


def test_workspaces(ws):
    ws.test = Workspace()
    with pytest.raises(ValueError):
        ws.other = ws.test
    ws.dims = Workspace()
    with pytest.raises(AttributeError):
        ws.test = Dimension(3)
    ws.test.sub = Workspace()
    ws.test.Names = Tensor("string", (None,), inits=np.array(["Hello", "You"], object))
    ws.test.sub.Names = Tensor("string", (None,), inits=np.array(["a"], object))
    assert "test.sub.Names" in ws and "test.none" not in ws and list(ws) == ["dims", "test"]
    ws.test._move_to("dims.moved")
    assert list(got(ws.dims.moved, "Names")) == ["Hello", "You"] and "test" not in ws
    ws.test = Workspace()
    with pytest.raises(ValueError):
        ws.test._move_to("dims.moved")
    del ws.dims.moved.sub
    assert "dims.moved.Names" in ws
    del ws["dims"]
    assert create_workspace(ws, "dims.deep.er")._path == ("dims", "deep", "er")


def test_names(ws):
    for name, value in (("Cells", Dimension(1)), ("age", Tensor("int8", ())), ("Sub", Workspace())):
        with pytest.raises(AttributeError):
            setattr(ws, name, value)
    assert tensor_name("a.b c") == "A_b_c" and tensor_name("1x", {"X_1x"}) == "X_1x_2" and camel_case("transcript_count") == "TranscriptCount"


def test_dimension_in_use(ws):
    ws.cells = Dimension(None)
    ws.Age = Tensor("int8", ("cells",), inits=np.arange(3))
    with pytest.raises(ValueError):
        del ws.cells
    ws.cells = Dimension(None)
    assert ws.cells.length == 3
    with pytest.raises(ValueError):
        ws.cells = Dimension(4)
    del ws.unknown


# -- types


@pytest.mark.parametrize("name", ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"])
def test_extremes(ws, name):
    ends = [np.iinfo(name).min, np.iinfo(name).max]
    ws.V = Tensor(name, (None,), inits=np.array(ends, name))
    assert [int(x) for x in got(ws, "V")] == ends
    with pytest.raises(Exception):
        ws.Bad = Tensor(name, (None,), inits=np.array([ends[1] + 1], object))
    assert "Bad" not in ws


def test_half_precision(ws):
    x = np.array([0.1, 65504, 1e-5, -2.5, 0, 3.14159, 1e6])
    with np.errstate(over="ignore"):
        want = x.astype("float16")
    ws.V = Tensor("float16", (None,), inits=x)
    assert (got(ws, "V") == want).all()


def test_constants_are_cast(spark):
    w = wrap(spark.createDataFrame([(0, 10, "10", 0.1), (1, 11, "9", 0.5)], "i int, n int, s string, x float"), "rows", "i")
    assert list(got(w, "I", w.N > 10.7)) == [1] and list(got(w, "I", w.S == 10)) == [0]
    assert w[w.X == 0.1].X.count() == 0  # a float isn't the double


def test_nan_and_zero(ws):
    x = np.array([np.nan, np.inf, -np.inf, -0.0, 0.0, 1])
    ws.d = Dimension(6)
    ws.V = Tensor("float64", ("d",), inits=x)
    assert list(ws[ws.V == 0].V.sort("idx").toPandas()["idx"]) == [3, 4]
    r = ws.d.groupby().stats("V", ["nnz", "nonzero"]).first()
    assert (r.nnz, r.nonzero) == (2, 4)


# -- filters against a model

N = 12
AGES, SIZES = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]), np.array([2, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5])


@pytest.fixture(scope="module")
def people(spark):
    rows = [(k, int(AGES[k]), int(SIZES[k])) for k in range(N)]
    return wrap(spark.createDataFrame(rows, "idx long, age int, size int"), "people", "idx", {"Age": "age", "Size": "size"})


leaf = st.one_of(
    st.tuples(st.sampled_from(["<", "<=", "==", "!=", ">=", ">"]), st.integers(0, 9)),
    st.tuples(st.just("tt"), st.sampled_from(["<", "==", ">="])),
    st.tuples(st.just("slice"), st.tuples(st.integers(-13, 13), st.integers(-13, 13), st.sampled_from([1, 2, 3, -1, -2]))),
    st.tuples(st.just("at"), st.lists(st.integers(-N, N - 1), max_size=4)),
    st.tuples(st.just("mask"), st.lists(st.booleans(), min_size=N, max_size=N)),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.tuples(st.sampled_from("&|^-"), t, t), st.tuples(st.just("~"), t)), max_leaves=5)
OPS = {"<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">=": operator.ge, ">": operator.gt}


def build(t, w):
    kind = t[0]
    if kind in OPS and len(t) == 2 and isinstance(t[1], int):
        m = OPS[kind](AGES, t[1])
        return OPS[kind](w.Age, t[1]), m
    if kind == "tt":
        return OPS[t[1]](w.Age, w.Size), OPS[t[1]](AGES, SIZES)
    if kind in ("slice", "at", "mask"):
        item = slice(*t[1]) if kind == "slice" else np.array(t[1], int if kind == "at" else bool)
        m = np.zeros(N, bool)
        m[item] = True
        return w.people[item], m
    if kind == "~":
        f, m = build(t[1], w)
        return ~f, ~m
    (f, m), (g, k) = build(t[1], w), build(t[2], w)
    return {"&": (lambda: (f & g, m & k)), "|": (lambda: (f | g, m | k)), "^": (lambda: (f ^ g, m ^ k)), "-": (lambda: (f - g, m & ~k))}[kind]()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(tree)
def test_filter_algebra(people, t):
    f, m = build(("&", ("slice", (None, None, 1)), t) if t[0] == "at" else t, people)
    assert list(got(people, "Age", f)) == list(AGES[m])


def test_positions(people):
    assert list(got(people, "Age", people.people[[5, 2, 2]])) == [4, 4, 9]  # duplicates stay, in ascending order
    assert list(got(people, "Age", people.people[3])) == [1]
    for bad in ([N], [-N - 1]):
        with pytest.raises(IndexError):
            people.people[bad]
    with pytest.raises(IndexError):
        people.people[np.ones(N - 1, bool)]
    with pytest.raises(KeyError):
        people[3]


def test_views(people, spark):
    v = people[people.Age > 2, people.Size > 2]  # two filters on one dimension hold together
    assert list(v.to_numpy("Age")) == list(AGES[(AGES > 2) & (SIZES > 2)])
    assert v.get_shape("Age") == (int(((AGES > 2) & (SIZES > 2)).sum()),)
    assert list(got(people, "Age", people[people.Age > 5] & people.people[:8])) == [9, 6]
    assert list(got(people, "Age", people.people[:8] & people[people.Age > 5])) == [9, 6]
    other = wrap(spark.range(3).withColumnRenamed("id", "k"), "things", "k", into=people) if "things" not in people else people
    with pytest.raises(SyntaxError):
        people.Age.__gt__(2) & other.things[:2]
    with pytest.raises(ValueError):
        people[people.Age > 2, other.things[:2]] & people.people[:3]


def test_square_matrix(ws):
    x = np.arange(16).reshape(4, 4)
    ws.cells = Dimension(4)
    ws.Near = Tensor("int32", ("cells", "cells"), inits=x)
    v = ws[ws.cells[1:3]]
    assert (v.to_numpy("Near") == x[1:3, 1:3]).all()


def test_anonymous_axes(ws):
    x = np.arange(30).reshape(5, 6)
    ws.Grid = Tensor("int32", (None, None), inits=x)
    assert (ws.Grid.view((slice(0, 4), slice(1, 3))).to_numpy("Grid") == x[0:4, 1:3]).all()
    assert (ws.Grid.view((Ellipsis, [0, 5])).to_numpy("Grid") == x[:, [0, 5]]).all()
    rows = {(r.row, r.col): r.v for r in ws.Grid.sparse([4, 2], np.array([True] * 3 + [False] * 3)).collect()}
    assert rows == {(i, j): x[[2, 4]][i, j] for i in range(2) for j in range(3)}
    with pytest.raises(IndexError):
        ws.Grid.view((0, 0, 0))


def test_empty(ws):
    ws.cells = Dimension(None)
    ws.Age = Tensor("int8", ("cells",))
    ws.M = Tensor("int8", ("cells", 3))
    assert ws.Age[:].count() == 0 and ws.M[:].count() == 0 and ws[ws.Age > 1].groupby().mean("Age").count() == 0
    ws.cells.append({"Age": np.zeros(0), "M": np.zeros((0, 3))})
    assert ws.cells.length == 0


# -- groups


@pytest.mark.parametrize("seed", [0, 1])
def test_statistics(ws, seed):
    rng = np.random.default_rng(seed)
    labels, x = np.array(["b", "a", "b", "c", "a", "b", "d", "d"]), rng.normal(size=(8, 3)).round(3)
    ws.cells = Dimension(8)
    ws.Cluster = Tensor("string", ("cells",), inits=labels.astype(object))
    ws.X = Tensor("float64", ("cells", 3), inits=x)
    ws.Y = Tensor("float64", ("cells",), inits=x[:, 0])
    for name in ("sum", "count", "nnz", "mean", "variance", "sd", "skewness", "kurtosis", "min", "max", "first"):
        order, values = ws.cells.groupby("Cluster").to_numpy("X", name)
        assert list(order) == ["b", "a", "c", "d"]  # as they first appear
        for lab, row in zip(order, values, strict=True):
            acc = Accumulator()
            for r in x[labels == lab]:
                acc.add(r)
            np.testing.assert_allclose(row, np.broadcast_to(acc.get(name), 3), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(ws.cells.groupby("Cluster").to_numpy("Y", name)[1], values[:, 0], rtol=1e-9, equal_nan=True)


def test_group_labels(ws, people):
    assert people.people.groupby(np.array([0, 1] * 6)).sum("Age").orderBy("label").toPandas()["sum"].tolist() == [AGES[::2].sum(), AGES[1::2].sum()]
    v = people[people.Age > 3]
    many = v.groupby("Size", lambda c: c % 2).count("Age").orderBy("label").toPandas()
    assert many["count"].tolist() == [int(((AGES > 3) & (SIZES % 2 == k)).sum()) for k in (0, 1)]
    with pytest.raises(ValueError):
        v.groupby(np.zeros(3)).sum("Age").collect()
    ws.cells, ws.genes = Dimension(2), Dimension(2)
    ws.A, ws.B = Tensor("int8", ("cells",), inits=np.arange(2)), Tensor("int8", ("genes",), inits=np.arange(2))
    ws.M = Tensor("int8", ("cells", "genes"), inits=np.eye(2))
    with pytest.raises(ValueError):
        ws.cells.groupby("B").sum("A").collect()
    with pytest.raises(ValueError):
        ws.cells.groupby("M")


# -- writes, commits, exchange


def test_filters_see_new_values(ws):
    ws.d = Dimension(5)
    ws.V = Tensor("int32", ("d",), inits=np.arange(5))
    ws[ws.V > 2].V = 0
    assert list(got(ws, "V", ws.V == 0)) == [0, 0, 0]
    ws[ws.d[1:3]].V = np.array([7, 8])
    assert list(got(ws, "V")) == [0, 7, 8, 0, 0]


def test_transaction(ws, spark):
    other = connect(ws._catalog.root, spark)
    with pytest.raises(RuntimeError), Transaction(ws):
        ws.cells = Dimension(3)
        ws.Age = Tensor("int8", ("cells",), inits=np.arange(3))
        raise RuntimeError
    assert "Age" not in ws and ws._catalog.files.names("data") == []
    with Transaction(ws):
        ws.cells = Dimension(None)
        ws.Age = Tensor("int8", ("cells",), inits=np.arange(3))
        other._catalog.refresh()
        assert "Age" not in other
    other._catalog.refresh()
    assert list(got(other, "Age")) == [0, 1, 2]
    old = ws._catalog.version
    ws.cells.append({"Age": np.arange(2)})
    with pytest.raises(ConflictError):
        other.cells.append({"Age": np.arange(2)})
    assert other.cells.length == 5
    before = connect(ws._catalog.root, spark)
    before._catalog.load(old)
    assert list(got(before, "Age")) == [0, 1, 2]  # a version is one state


def test_a_dead_writer_blocks_nobody(ws, spark):
    """A version that a writer left unfinished is not seen, and is replaced once it is old."""
    ws.d = Dimension(3)
    ws.A = Tensor("int8", ("d",), inits=np.arange(3))
    root = ws._catalog.root
    unfinished = f"{root}/_manifest/{ws._catalog.version + 1:012d}.json"
    with open(unfinished, "w") as f:
        f.write('{"dims": {"d"')
    assert list(got(connect(root, spark), "A")) == [0, 1, 2]
    with pytest.raises(ConflictError):  # it may still be at it
        ws.B = Tensor("int8", ("d",), inits=np.arange(3))
    os.utime(unfinished, (1, 1))
    ws.B = Tensor("int8", ("d",), inits=np.arange(3))
    assert list(got(connect(root, spark), "B")) == [0, 1, 2]


def test_rows_as_filters(ws, spark):
    ws.d = Dimension(20)
    ws.A = Tensor("int8", ("d",), inits=np.arange(20))
    ws.M = Tensor("int8", ("d", 3), inits=np.arange(60).reshape(20, 3))
    even = spark.range(0, 20, 2).union(spark.range(0, 4, 2))
    assert list(got(ws, "A", ws.d[even])) == list(range(0, 20, 2))
    assert list(got(ws, "A", ~ws.d[even] & (ws.A > 9))) == [11, 13, 15, 17, 19]
    assert (got(ws, "M", ws.d[even] - ws.d[:4]) == np.arange(60).reshape(20, 3)[4::2]).all()
    assert [r["sum"] for r in ws[ws.d[even]].groupby(np.arange(10) % 2).sum("M").where("i1 = 0").orderBy("label").collect()] == [3 * sum(range(0, 20, 4)), 3 * sum(range(2, 20, 4))]


def test_batches(ws):
    ws.d = Dimension(10)
    ws.A = Tensor("int8", ("d",), inits=np.arange(10))
    ws.M = Tensor("int8", ("d", 3), inits=np.arange(30).reshape(10, 3))
    ws.J = Tensor("float32", ("d", None), jagged=True, inits=[np.arange(k) for k in range(10)])
    view = ws[ws.A > 2]
    at, values = zip(*view.batches("M", 3), strict=True)
    assert [len(x) for x in at] == [3, 3, 1] and (np.concatenate(values) == np.arange(30).reshape(10, 3)[3:]).all()
    assert [x.tolist() for _, x in view.batches("A", 5)] == [[3, 4, 5, 6, 7], [8, 9]]
    assert [len(r) for _, rows in view.batches("J", 4) for r in rows] == list(range(3, 10)) and [*ws[ws.A > 99].batches("A")] == []


def test_labels_are_read_beside_the_matrix(spark):
    """Labels from the matrix's own file: no join, and no row per value before the labels."""
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("kind"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("m"))
    ws = wrap(rows, "d", "id", {"Kind": "kind", "M": "m"}, {"m": (None, 2)})
    plan = ws.d.groupby("Kind").sum("M")
    assert "Join" not in plan._jdf.queryExecution().toString()
    assert [r["sum"] for r in plan.where("i1 = 0").orderBy("label").collect()] == [sum(range(k, 40, 3)) for k in range(3)]


def test_append_rows(ws, spark):
    ws.d = Dimension(None)
    ws.A, ws.M = Tensor("int64", ("d",)), Tensor("float32", ("d", None))
    rows = spark.range(100).select(F.col("id").alias("A"), F.array(F.col("id").cast("float"), F.lit(1.0)).alias("M"))
    ws.d.append(rows.repartition(7), ["A"])
    ws.d.append(rows.withColumn("A", F.col("A") + 100).repartition(3), ["A"])
    assert list(got(ws, "A")) == list(range(200)) and (got(ws, "M")[:, 0] == np.r_[0:100, 0:100]).all()


def test_snapshot(ws, spark, tmp_path):
    ws.a = Workspace()
    ws.a.cells = Dimension(3)
    ws.a.M = Tensor("int16", ("cells", None), inits=np.arange(6).reshape(3, 2))
    ws.a.J = Tensor("float32", ("cells", None), jagged=True, inits=[np.arange(k) for k in (1, 0, 2)])
    ws.Version = Tensor("string", (), inits="x")
    ws._export(str(tmp_path / "out"))
    copy = connect(str(tmp_path / "copy"), spark)
    copy._import(str(tmp_path / "out"))
    assert (got(copy.a, "M") == np.arange(6).reshape(3, 2)).all() and copy.Version.scalar() == "x"
    assert [len(r) for r in got(copy.a, "J")] == [1, 0, 2]
    assert "cells" in repr(copy.a) and "<table>" in copy.a._repr_html_()


def test_bundle(ws):
    rng = np.random.default_rng(0)
    x = (rng.random((20, 30)) > 0.8) * rng.integers(1, 9, (20, 30))
    ws.cells, ws.genes = Dimension(20), Dimension(30)
    ws.Expression = Tensor("int16", ("cells", "genes"), inits=x)
    ws.Name, ws.Age = Tensor("string", ("cells",), inits=np.array(["n"] * 20, object)), Tensor("int16", ("cells",), inits=np.arange(20))
    ws.Gene, ws.Pca = Tensor("string", ("genes",), inits=np.array([f"g{k}" for k in range(30)], object)), Tensor("float32", ("cells", 2), inits=np.ones((20, 2)))
    b = ws[ws.Age >= 5, ws.genes[10:]].bundle(obs=["auto", "Age->Years"], obs_key="Name", var_key="Gene")
    dense = np.zeros(b.shape, int)
    for r in b.X.collect():
        dense[r.row, r.col] = r.v
    assert (dense == x[5:, 10:]).all() and set(b.obsm) == {"Pca"}
    obs = b.obs.orderBy("idx").toPandas()
    assert obs["Years"].tolist() == list(range(5, 20)) and obs["Name"].is_unique and b.categorical["var"] == []


def test_importers(ws, spark, tmp_path):
    from ndspark.sources.interop import import_layers, import_matrix, import_spatial

    x = spark.createDataFrame([(0, 1, 5), (2, 0, 7)], "row long, col long, v int")
    obs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, cell_name string")
    var = spark.createDataFrame([(0, "g"), (1, "h")], "idx long, `gene.id` string")
    a = create_workspace(ws, "a")
    import_matrix(a, x, obs, var, obsm={"X_umap": spark.createDataFrame([(k, [0.5, 1.5]) for k in range(3)], "idx long, v array<double>")}, uns={"title": "t"}, obsp={"near": x})
    assert (got(a, "Expression") == [[0, 5], [0, 0], [7, 0]]).all() and a.Title.scalar() == "t" and list(got(a, "CellName")) == ["a", "b", "c"]
    b = create_workspace(ws, "b")
    turned = x.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
    import_layers(b, {"spliced": turned, "unspliced": turned}, obs, var)
    assert (got(b, "Expression") == [[0, 10], [0, 0], [14, 0]]).all()
    root = str(tmp_path / "spatial")
    spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "cell_id string, x_centroid double").coalesce(1).write.parquet(f"{root}/cells.parquet")
    spark.createDataFrame([("c2", 1.0, 2.0), ("c2", 3.0, 4.0)], "cell_id string, vx double, vy double").coalesce(1).write.parquet(f"{root}/cell_boundaries.parquet")
    (tmp_path / "spatial" / "experiment.xenium").write_text('{"run_name": "r", "num_cells": 2}')
    (tmp_path / "spatial" / "clusters.csv").write_text("Barcode,Cluster\nc2,5\nc1,4\n")
    c = create_workspace(ws, "c")
    import_spatial(c, root)
    assert c.RunName.scalar() == "r" and list(got(c, "Cluster")) == [4, 5]
    assert got(c, "CellBoundaries")[1].tolist() == [1, 2, 3, 4] + [0] * 22


def test_import_adata(ws):
    from types import SimpleNamespace

    import pandas as pd

    x = np.array([[0, 2.5], [1.0, 0], [0, 0]])
    coo = SimpleNamespace(tocoo=lambda: SimpleNamespace(row=np.array([0, 1]), col=np.array([1, 0]), data=np.array([2.5, 1.0])))
    from ndspark.sources.interop import import_adata

    import_adata(ws, SimpleNamespace(X=x, layers={"raw": coo}, obs=pd.DataFrame({"kind": pd.Categorical(["a", "b", "a"])}, index=["x", "y", "z"]), var=pd.DataFrame({"len": [1, 2]}, index=["g", "h"]), obsm={"X_pca": np.ones((3, 2))}, obsp={"near": np.eye(3)}, uns={"n": 1, "skip": []}))
    assert (got(ws, "Expression") == x).all() and (got(ws, "Raw") == x).all() and list(got(ws, "Kind")) == ["a", "b", "a"]
    assert list(got(ws, "ObsNames")) == ["x", "y", "z"] and ws.N.scalar() == 1 and (got(ws, "Near") == np.eye(3)).all()
    b = ws[:].bundle(obs_key="ObsNames")
    assert b.to_pandas("obs")["ObsNames"].tolist() == ["x", "y", "z"] and "XPca" in b.obsm


def test_jagged_from_rows(ws, spark):
    ws.d = Dimension(None)
    rows = spark.createDataFrame([(0, [1], [5]), (1, [0], []), (2, [2], [6, 7])], "idx long, shape array<int>, v array<int>")
    ws.J = Tensor("int32", ("d", None), jagged=True, inits=rows)
    assert [r.tolist() for r in got(ws, "J")] == [[5], [], [6, 7]] and ws.J.shape == (3, 2)
    with pytest.raises(ValueError):
        ws.K = Tensor("int32", ("d", None), inits=rows.drop("shape"))


def test_storage(ws):
    from ndspark.sources.storage import WorkspaceStorage

    s = WorkspaceStorage(ws)
    ws.rows = Dimension(None)
    s.create("Count", "int32", ("rows",), np.arange(3))
    s.resize("rows", 5)
    assert list(got(ws, "Count")) == [0, 1, 2, 0, 0] and s.list() == ["rows", "Count"]
    with pytest.raises(TypeError):
        s.write("Count", slice(0, 2), np.array([0.5, 1.5]))
    with pytest.raises(IndexError):
        s.read("Count", [9])
    s.delete("Count")
    assert "Count" not in ws


def test_stream(ws, spark, tmp_path):
    from ndspark.streaming.sink import append_stream, batch_writer

    ws.d = Dimension(None)
    ws.A = Tensor("int64", ("d",))
    spark.range(10).withColumnRenamed("id", "A").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("A long").parquet(str(tmp_path / "in"))
    append_stream(stream, ws.d, "s", str(tmp_path / "ck"), ["A"], availableNow=True).awaitTermination(60)
    ws._catalog.refresh()
    assert list(got(ws, "A")) == list(range(10))
    write = batch_writer(ws.d, "s")
    write(spark.range(3).withColumnRenamed("id", "A"), 0)  # seen already
    write(spark.range(3).withColumnRenamed("id", "A"), 1)
    assert ws.d.length == 13


def test_tensor_value():
    with pytest.raises(ValueError):
        TensorValue([np.zeros((1, 2)), np.zeros(3)], jagged=True)
    assert TensorValue([np.zeros((1, 2)), np.zeros((3, 1))], jagged=True).shape == (2, 3, 2)
