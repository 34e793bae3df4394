"""Queries over the sample tables, one per operator, and the SQL that DuckDB runs beside them.

Tables are wrapped as dimensions: nothing is copied, and a query is one Spark plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.bundle import bundle, categorical, selected_bundle
from .operators.view import View
from .plans.staging import shared_folder, staged
from .sources.catalog import Catalog
from .sources.interop import dense
from .transaction import Transaction
from .values import TensorValue
from .workspace import Dimension, Tensor, Workspace, WorkspaceManager, connect, wrap

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def register(name: str, f: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = f, sql


#: Tables with a key that holds 0 ... n-1, and their dimensions.
KEYS = {"events": ("events", "event_id"), "embeddings": ("vecs", "vec_id"), "orders": ("orders", "o_orderkey"), "customer": ("customers", "c_custkey"), "supplier": ("suppliers", "s_suppkey"), "part": ("parts", "p_partkey"), "nation": ("nations", "n_nationkey"), "documents": ("docs", "doc_id"), "pages": ("pages", "page_id"), "benchmark": ("items", "item_id")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ws_of(spark: SparkSession, sf_dir: str, name: str) -> WorkspaceManager:
    dim, key = KEYS[name]
    df = table(spark, sf_dir, name)
    fixed = {"embedding": ("feats", 64)} if name == "embeddings" else None
    return wrap(df, dim, key, fixed=fixed)


def lines(spark: SparkSession, sf_dir: str) -> WorkspaceManager:
    """lineitem has no key. Where positions aren't shown any numbering will do, and this one costs no sort."""
    df = table(spark, sf_dir, "lineitem").withColumn("idx", F.monotonically_increasing_id())
    return wrap(df, "lines", "idx", {"Price": "l_extendedprice", "Discount": "l_discount", "Tax": "l_tax", "Flag": "l_returnflag", "Order": "l_orderkey"})


def scratch(spark: SparkSession) -> WorkspaceManager:
    """A new stored workspace in the folder that driver and executors share."""
    return connect(f"{shared_folder(spark)}/ndspark-{uuid.uuid4().hex}", spark)


# -- scans, filters, slices


@query("SELECT event_id AS idx, value AS \"Value\" FROM events")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "events").Value[:]


def _events(condition: Callable[[WorkspaceManager], object], name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ws = ws_of(spark, sf_dir, "events")
        return ws[condition(ws)].columns("Value", "EventType")

    register(name, run, f'SELECT event_id AS idx, value AS "Value", event_type AS "EventType" FROM events WHERE {sql}')


_events(lambda w: w.EventType == "error", "filter_eq", "event_type = 'error'")
_events(lambda w: w.EventType != "error", "filter_ne", "event_type <> 'error'")
_events(lambda w: w.Value > 100, "filter_gt", "value > 100")
_events(lambda w: w.Value >= 50.0, "filter_ge", "value >= 50")
_events(lambda w: w.Value < 20, "filter_lt", "value < 20")
_events(lambda w: w.Value <= 20, "filter_le", "value <= 20")
_events(lambda w: (w.Value > 20) & (w.EventType == "click"), "filter_and", "value > 20 AND event_type = 'click'")
_events(lambda w: (w.Value > 80) | (w.EventType == "click"), "filter_or", "value > 80 OR event_type = 'click'")
_events(lambda w: (w.Value > 20) ^ (w.EventType == "click"), "filter_xor", "(value > 20) <> (event_type = 'click')")
_events(lambda w: (w.Value > 20) - (w.EventType == "click"), "filter_diff", "value > 20 AND NOT event_type = 'click'")
_events(lambda w: ~((w.Value > 20) & (w.EventType == "click")), "filter_not", "NOT (value > 20 AND event_type = 'click')")
_events(lambda w: w.Value < -1, "filter_empty", "value < -1")
_events(lambda w: w.events[100:200:7], "slice_step", "event_id >= 100 AND event_id < 200 AND (event_id - 100) % 7 = 0")
_events(lambda w: w.events[10:60], "slice_range", "event_id >= 10 AND event_id < 60")
_events(lambda w: w.events[-5:], "slice_negative", "event_id >= (SELECT count(*) - 5 FROM events)")
_events(lambda w: w.events[::-3], "slice_reversed", "((SELECT count(*) FROM events) - 1 - event_id) % 3 = 0")
_events(lambda w: w.events[3], "index_single", "event_id = 3")
_events(lambda w: w.events[[-1, 0]], "index_negative", "event_id IN (0, (SELECT count(*) - 1 FROM events))")
_events(lambda w: w.events[w._spark.range(len(w.events)).where("id % 3 = 0")], "rows_mask", "event_id % 3 = 0")
_events(lambda w: w.events[np.arange(len(w.events)) % 3 == 0], "bool_mask", "event_id % 3 = 0")
_events(lambda w: w.events[0:500] & (w.Value > 20) | w.events[[1, 2, 2]], "filter_tree", "event_id < 500 AND value > 20 OR event_id IN (1, 2)")


@query('SELECT event_id AS idx, value AS "Value" FROM events JOIN (VALUES (5), (2), (2)) v(i) ON event_id = i')
def index_array_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "events").Value[[5, 2, 2]]


@query('SELECT event_id AS idx, value AS "Value" FROM events WHERE event_id % 5 <> 0')
def index_array_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "events")
    return ws[~ws.events[spark.range(0, len(ws.events), 5)]].Value


@query('SELECT p_partkey AS idx, p_size AS "PSize" FROM part WHERE p_size > 10')
def filter_const_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "part")
    return ws[ws.PSize > 10.7].PSize


def _lines(op: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ws = lines(spark, sf_dir)
        return ws[ws.Discount._compare(op, ws.Tax)].columns("Order", "Discount", "Tax").drop("idx")

    register(name, run, f'SELECT l_orderkey AS "Order", l_discount AS "Discount", l_tax AS "Tax" FROM lineitem WHERE l_discount {op.replace("==", "=").replace("!=", "<>")} l_tax')


for _op, _n in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"), ("==", "eq"), ("!=", "ne")):
    _lines(_op, f"filter_tensor_{_n}")

# -- matrices

LONG = "(SELECT vec_id AS i0, label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS v FROM embeddings)"


@query(f"SELECT i0, i1, v FROM {LONG} WHERE label = 3 AND i1 < 8")
def view_two_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "embeddings")
    return ws[ws.Label == 3, ws.feats[:8]].Embedding


@query(f"SELECT i0, i1, v FROM {LONG} WHERE i0 < 100 AND i1 >= 4 AND (i1 - 4) % 5 = 0")
def matrix_slice_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "embeddings").Embedding[0:100, 4::5]


@query(f"SELECT i0, i1, v FROM {LONG} JOIN (VALUES (3), (3), (60)) t(j) ON i1 = j")
def matrix_index_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "embeddings").Embedding[..., [3, -4, 3]]


@query(f"SELECT i0, i1, v FROM {LONG} WHERE i0 % 2 = 0 AND i1 % 2 = 1")
def matrix_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "embeddings")
    return ws.Embedding[np.arange(len(ws.vecs)) % 2 == 0, np.arange(64) % 2 == 1]


@query("SELECT 'vecs' AS axis, count(*) AS n FROM embeddings WHERE label = 3 UNION ALL SELECT 'feats', 8")
def view_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "embeddings")
    shape = ws[ws.Label == 3, ws.feats[:8]].get_shape("Embedding")
    return spark.createDataFrame([*zip(("vecs", "feats"), shape, strict=True)], "axis string, n long")


@query(f"WITH l AS (SELECT *, dense_rank() OVER (ORDER BY i0) - 1 AS r FROM {LONG} WHERE label = 3 AND i1 >= 2 AND i1 < 10) SELECT r AS row, i1 - 2 AS col, v FROM l WHERE v <> 0")
def coo_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "embeddings")
    return ws.Embedding.sparse(ws.Label == 3, slice(2, 10))


# -- joins by position


@query('SELECT o_orderkey AS idx, o_totalprice AS "OTotalprice", c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey')
def dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = ws_of(spark, sf_dir, "orders"), ws_of(spark, sf_dir, "customer")
    segment = customers.CMktsegment[:].select(F.col("idx").alias("OCustkey"), F.col("CMktsegment").alias("segment"))
    return orders[:].columns("OCustkey", "OTotalprice").join(segment, "OCustkey").select("idx", "OTotalprice", "segment")


def _rich(kind: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, customers = ws_of(spark, sf_dir, "orders"), ws_of(spark, sf_dir, "customer")
        f = customers.CAcctbal > 5000
        chosen = customers[f if kind == "semi" else ~f].positions("customers").withColumnRenamed("idx", "OCustkey")
        return orders[:].columns("OCustkey", "OTotalprice").join(chosen, "OCustkey", "left_semi").select("idx", "OTotalprice")

    register(f"{kind}_join_dim", run, f'SELECT o_orderkey AS idx, o_totalprice AS "OTotalprice" FROM orders WHERE o_custkey {sql} (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)')


_rich("semi", "IN")
_rich("anti", "NOT IN")

# -- groups

MOMENTS = """WITH m AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1),
d AS (SELECT g, count(*) AS n, sum((l_extendedprice - mu)^2) AS m2, sum((l_extendedprice - mu)^3) AS m3, sum((l_extendedprice - mu)^4) AS m4 FROM lineitem JOIN m ON g = l_returnflag GROUP BY g)
"""
_SQL = {
    "sum": "round(sum(l_extendedprice), 2)", "count": "count(*)", "nnz": "count(*) FILTER (l_extendedprice > 0)", "nonzero": "count(*) FILTER (l_extendedprice <> 0)", "mean": "round(avg(l_extendedprice), 4)",
    "variance": "round(var_samp(l_extendedprice), 2)", "sd": "round(stddev_samp(l_extendedprice), 4)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
}
_ROUND = {"sum": 2, "mean": 4, "variance": 2, "sd": 4, "skewness": 4, "kurtosis": 4}


def rounded(name: str) -> Column:
    return (F.round(name, _ROUND[name]) + 0.0 if name in _ROUND else F.col(name)).alias(name)  # never -0.0


def _group(stat: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(lines_by_flag(spark, sf_dir), stat)("Price").select("label", rounded(stat))

    register(f"group_{stat}", run, sql)


def lines_by_flag(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    return lines(spark, sf_dir).lines.groupby("Flag")


for _stat, _expression in _SQL.items():
    _group(_stat, f"SELECT l_returnflag AS label, {_expression} AS {_stat} FROM lineitem GROUP BY 1")
_group("skewness", MOMENTS + "SELECT g AS label, round(sqrt(n) * m3 / m2^1.5, 4) AS skewness FROM d")
_group("kurtosis", MOMENTS + "SELECT g AS label, round(n * m4 / (m2 * m2), 4) AS kurtosis FROM d")


@query(MOMENTS + "SELECT g AS label, round(s, 2) AS sum, d.n AS count, round(mean, 4) AS mean, round(m2 / (d.n - 1), 2) AS variance, round(sqrt(m2 / (d.n - 1)), 4) AS sd, round(sqrt(d.n) * m3 / m2^1.5, 4) AS skewness, round(d.n * m4 / (m2 * m2), 4) AS kurtosis, least AS min, most AS max FROM d JOIN (SELECT l_returnflag AS f, sum(l_extendedprice) AS s, avg(l_extendedprice) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1) ON f = g")
def group_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sum", "count", "mean", "variance", "sd", "skewness", "kurtosis", "min", "max"]
    return lines_by_flag(spark, sf_dir).stats("Price", names).select("label", *map(rounded, names))


@query("SELECT event_type AS label, arg_min(value, event_id) AS first FROM events GROUP BY 1")
def group_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "events").events.groupby("EventType").first("Value")


@query('SELECT event_type AS label, count(*) AS count, min(event_id) AS "order" FROM events GROUP BY 1')
def group_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "events").events.groupby("EventType").stats("Value", ["count"], order=True)


@query("SELECT CAST(0 AS DOUBLE) AS label, count(*) AS count, round(avg(value), 4) AS mean FROM events")
def group_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "events").events.groupby().stats("Value", ["count", "mean"]).select("label", "count", rounded("mean"))


@query("SELECT user_id AS label, round(avg(value), 8) AS mean FROM events WHERE value > 20 AND event_type = 'purchase' GROUP BY 1")
def group_filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "events")
    return ws[(ws.Value > 20) & (ws.EventType == "purchase")].groupby("UserId").mean("Value").select("label", F.round("mean", 8).alias("mean"))


@query("SELECT user_id % 10 AS label, round(sum(value), 2) AS sum FROM events GROUP BY 1")
def group_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws_of(spark, sf_dir, "events").events.groupby("UserId", lambda c: c % 10).sum("Value").select("label", rounded("sum"))


@query("SELECT upper(left(event_type, 1)) AS label, count(*) AS count FROM events GROUP BY 1")
def group_projection_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def initial(s: pd.Series) -> pd.Series:
        return s.str[:1].str.upper()

    return ws_of(spark, sf_dir, "events").events.groupby("EventType", initial).count("Value")


@query("SELECT quality AS label, count(*) AS count, round(avg(n_chars), 4) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def group_external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").alias("label"))
    return ws_of(spark, sf_dir, "documents").docs.groupby(labels).stats("NChars", ["count", "mean"]).select("label", "count", rounded("mean"))


@query("SELECT quality AS label, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 4) AS mean FROM labels GROUP BY 1")
def group_bool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").withColumn("bad", F.col("toxic") == 1)
    return wrap(df, "docs", "doc_id", {"Bad": "bad", "Quality": "quality"}).docs.groupby("Quality").mean("Bad").select("label", rounded("mean"))


def _matrix(stat: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(ws_of(spark, sf_dir, "embeddings").vecs.groupby("Label"), stat)("Embedding").select("label", "i1", rounded(stat))

    register(f"group_matrix_{stat}", run, sql)


for _stat, _expression in (("mean", "round(avg(CAST(v AS DOUBLE)), 4) + 0.0"), ("variance", "round(var_samp(CAST(v AS DOUBLE)), 2)"), ("kurtosis", "round(kurtosis_pop(CAST(v AS DOUBLE)) + 3, 4)"), ("nnz", "count(*) FILTER (v > 0)"), ("max", "max(v)"), ("first", "arg_min(v, i0)")):
    _matrix(_stat, f"SELECT label, i1, {_expression} AS {_stat} FROM {LONG} GROUP BY 1, 2")

# -- jagged tensors

TURNS = "(SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"


def talks(spark: SparkSession, sf_dir: str) -> WorkspaceManager:
    """Conversations as a jagged string tensor, from (idx, shape, v) rows."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("Text"))
    rows = staged(rows.select("idx", F.array(F.size("Text")).alias("shape"), F.col("Text").alias("v")))
    ws = WorkspaceManager(Catalog(spark))
    ws.convs = Dimension(None)
    ws.Text = Tensor("string", ("convs", None), jagged=True, inits=rows)
    return ws


@query(f"SELECT conv_id AS idx, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, '|')) AS digest FROM {TURNS}")
def jagged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).Text[:].select("idx", F.get("shape", F.lit(0)).alias("n"), F.md5(F.array_join("v", "|").cast("binary")).alias("digest"))


@query(f"SELECT conv_id AS idx, CAST(least(len(t), 2) AS INTEGER) AS n, md5(array_to_string(t[1:2], '|')) AS digest FROM {TURNS} WHERE conv_id >= 5")
def jagged_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).Text[5:, :2].select("idx", F.get("shape", F.lit(0)).alias("n"), F.md5(F.array_join("v", "|").cast("binary")).alias("digest"))


@query("SELECT conv_id AS idx, count(*) AS n FROM conversations GROUP BY 1")
def jagged_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).Text[:].select("idx", F.get("shape", F.lit(0)).cast("long").alias("n"))


# -- writes: into a stored workspace, read back


def stored_orders(spark: SparkSession, sf_dir: str, first: Column | None = None) -> tuple[WorkspaceManager, DataFrame]:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("Price"), F.col("o_orderstatus").alias("Status"))
    ws = scratch(spark)
    ws.orders = Dimension(None)
    ws.Price = Tensor("float64", ("orders",))
    ws.Status = Tensor("string", ("orders",))
    ws.orders.append(rows if first is None else rows.where(first), ["o_orderkey"])
    return ws, rows


@query('SELECT o_orderkey AS idx, o_totalprice AS "Price", o_orderstatus AS "Status" FROM orders')
def append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, rows = stored_orders(spark, sf_dir, F.col("o_orderkey") < 700)
    ws.orders.append(rows.where("o_orderkey >= 700"), ["o_orderkey"])
    return ws[:].columns("Price", "Status")


@query("SELECT o_orderkey AS idx, CASE WHEN o_totalprice > 200000 THEN 0 ELSE o_totalprice END AS \"Price\" FROM orders")
def overwrite_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, _ = stored_orders(spark, sf_dir)
    ws[ws.Price > 200000].Price = 0
    return ws.Price[:]


@query('SELECT o_orderkey AS idx, 0.0::DOUBLE AS "Price" FROM orders WHERE o_totalprice > 200000')
def overwrite_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, _ = stored_orders(spark, sf_dir)
    ws[ws.Price > 200000].Price = 0
    return ws[ws.Price == 0].Price


@query("SELECT CAST(n_nationkey AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CAST(n_nationkey * 10 + j AS INTEGER) AS v FROM nation, range(5) t(j)")
def append_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").count()
    ws = scratch(spark)
    ws.rows, ws.cols = Dimension(n), Dimension(None)
    whole = np.arange(n)[:, None] * 10 + np.arange(5)[None, :]
    ws.Grid = Tensor("int32", ("rows", "cols"), inits=whole[:, :2])
    ws.cols.append({"Grid": TensorValue(whole[:, 2:])})
    return ws.Grid[:]


@query("SELECT CAST(r_regionkey AS BIGINT) AS idx, r_name AS \"Name\" FROM region")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, copy = scratch(spark), scratch(spark)
    ws.regions = Dimension(None)
    ws.Name = Tensor("string", ("regions",))
    ws.regions.append(table(spark, sf_dir, "region").select(F.col("r_name").alias("Name"), "r_regionkey"), ["r_regionkey"])
    ws._export(f"{ws._catalog.root}-export")
    copy._import(f"{ws._catalog.root}-export")
    return copy.Name[:]


# -- sets of positions, bundles, helpers of importers


def _set(name: str, op: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ws = ws_of(spark, sf_dir, "events")
        return op(ws[ws.Value > 50].positions("events"), ws[ws.EventType == "click"].positions("events"))

    register(name, run, f"SELECT event_id AS idx FROM events WHERE value > 50 {sql} SELECT event_id FROM events WHERE event_type = 'click'")


_set("set_intersect", DataFrame.intersect, "INTERSECT")
_set("set_union", lambda a, b: a.union(b).distinct(), "UNION")
_set("set_except", DataFrame.subtract, "EXCEPT")


@query('SELECT vec_id AS idx, label AS "Cluster" FROM embeddings WHERE label < 5')
def bundle_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "embeddings")
    return bundle(ws[ws.Label < 5], "Embedding", obs=["Label->Cluster"], var=[], rows="vecs", cols="feats").obs


@query(f"WITH l AS (SELECT *, dense_rank() OVER (ORDER BY i0) - 1 AS r FROM {LONG} WHERE label < 2) SELECT r AS row, i1 AS col, v FROM l WHERE v <> 0")
def bundle_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "embeddings")
    return bundle(ws[ws.Label < 2], "Embedding", obs="auto", var=[], rows="vecs", cols="feats").X


@query("SELECT c AS column_name FROM (SELECT 'event_type' AS c, count(DISTINCT event_type) AS d, count(*) AS n FROM events UNION ALL SELECT 'props', count(DISTINCT props), count(*) FROM events) WHERE d < 0.1 * n")
def bundle_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = categorical(table(spark, sf_dir, "events").select("event_type", "props"))
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query("SELECT conv_id AS idx, CAST(j AS BIGINT) AS j, coalesce((SELECT length(text) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = j), 0)::BIGINT AS v FROM (SELECT DISTINCT conv_id FROM conversations) a, range(8) t(j)")
def polygon_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.scalars import padded

    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") < 8, F.struct("turn", F.char_length("text").alias("n"))))), lambda x: x["n"].cast("long")).alias("v"))
    return rows.select("idx", F.posexplode(padded(F.col("v"), 8)).alias("j", "v")).select("idx", F.col("j").cast("long").alias("j"), F.col("v").cast("long").alias("v"))


@query("SELECT a AS idx, CAST(b AS BIGINT) AS j, count(n_nationkey) AS v FROM range(5) x(a) CROSS JOIN range(25) y(b) LEFT JOIN nation ON n_regionkey = a AND n_nationkey = b GROUP BY 1, 2")
def import_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("row"), F.col("n_nationkey").cast("long").alias("col"), F.lit(1).cast("long").alias("v"))
    return dense(cells, 5, 25).select("idx", F.posexplode("v").alias("j", "v")).select("idx", F.col("j").cast("long").alias("j"), "v")


# -- workspaces, single tensors, exchange of small ones


def regions(spark: SparkSession, sf_dir: str, ws: WorkspaceManager) -> WorkspaceManager:
    ws.regions = Dimension(None)
    ws.Name = Tensor("string", ("regions",))
    ws.regions.append(table(spark, sf_dir, "region").select(F.col("r_name").alias("Name"), "r_regionkey"), ["r_regionkey"])
    return ws


@query("SELECT CAST(r_regionkey AS BIGINT) AS idx, r_name AS \"Name\" FROM region")
def workspace_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    root.a = Workspace()
    regions(spark, sf_dir, root.a)
    root.b = Workspace()
    root.a._move_to("b.c")
    assert "a" not in root and "b.c.Name" in root
    return root["b.c"].Name[:]


@query("SELECT * FROM (VALUES ('Other', 'tensor'), ('regions', 'dimension'), ('inner', 'workspace')) v(name, kind)")
def workspace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = regions(spark, sf_dir, scratch(spark))
    ws.Other = Tensor("int32", ("regions",), inits=np.arange(5))
    ws.inner = Workspace()
    del ws.Name
    kinds = {type(ws._get_tensor("Other")): "tensor", type(ws._get_dimension("regions")): "dimension", type(ws._get_workspace("inner")): "workspace"}
    return spark.createDataFrame([(name, kinds[type(ws[name])]) for name in ws], "name string, kind string")


@query("SELECT count(*) AS v FROM region")
def scalar_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = scratch(spark)
    ws.N = Tensor("int64", (), inits=table(spark, sf_dir, "region").count())
    return ws.N[:]


@query("SELECT CAST(n_nationkey AS BIGINT) AS idx, CAST(n_regionkey AS INTEGER) AS \"V\" FROM nation")
def tensor_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = np.array([r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_regionkey").collect()])
    ws = scratch(spark)
    ws.V = Tensor("int32", (None,), inits=values[:10])
    ws.V.append(values[10:])
    return ws.V[:]


@query("SELECT CAST(r_regionkey AS BIGINT) AS idx, upper(r_name) AS \"Upper\" FROM region")
def transaction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failed transaction did is undone; a whole one is seen at once."""
    ws = regions(spark, sf_dir, scratch(spark))
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("idx"), F.upper("r_name").alias("v"))
    try:
        with Transaction(ws):
            del ws.Name
            raise InterruptedError
    except InterruptedError:
        pass
    with Transaction(ws):
        ws.Upper = Tensor("string", ("regions",), inits=rows)
        del ws.Name
    return connect(ws._catalog.root, spark)[:].columns("Upper")


@query("SELECT r % 3 AS label, count(*) AS count FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation WHERE n_regionkey > 0) GROUP BY 1")
def group_array_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = ws_of(spark, sf_dir, "nation")
    view = ws[ws.NRegionkey > 0]
    return view.groupby(np.arange(view.get_length("nations")) % 3).count("NName")


@query("SELECT CAST(n_nationkey AS BIGINT) AS idx, n_name AS \"NName\" FROM nation")
def batch_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = [*ws_of(spark, sf_dir, "nation")[:].batches("NName", 7)]
    assert [len(at) for at, _ in read] == [7, 7, 7, 4]
    return spark.createDataFrame([(int(k), v) for at, values in read for k, v in zip(at, values, strict=True)], "idx long, NName string")


def cells(spark: SparkSession, sf_dir: str) -> WorkspaceManager:
    """nation x region as cells x genes, with a second layer, embeddings of both and marks."""
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()
    n = len(nations)
    ws = WorkspaceManager(Catalog(spark))
    ws.cells, ws.genes = Dimension(n), Dimension(5)
    hot = np.array([[int(r.n_regionkey == g) for g in range(5)] for r in nations])
    ws.Expression, ws.Spliced = Tensor("int32", ("cells", "genes"), inits=hot * 7), Tensor("int32", ("cells", "genes"), inits=hot * np.arange(n)[:, None])
    ws.Region = Tensor("string", ("cells",), inits=np.array([f"r{r.n_regionkey}" for r in nations], object))
    ws.Pca, ws.Loading = Tensor("float64", ("cells", 2), inits=np.arange(2 * n).reshape(n, 2)), Tensor("float64", ("genes", 2), inits=np.arange(10).reshape(5, 2))
    ws.Selected, ws.Valid = Tensor("bool", ("cells",), inits=np.arange(n) % 2 == 0), Tensor("bool", ("genes",), inits=np.arange(5) != 1)
    return ws


@query("SELECT CAST(n_nationkey AS BIGINT) AS row, CAST(n_regionkey AS BIGINT) AS col, CAST(n_nationkey AS INTEGER) AS v FROM nation WHERE n_nationkey > 0")
def bundle_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)[:].bundle(layers=["Spliced->spliced"]).layers["spliced"]


@query("SELECT 'Loading' AS name, CAST(g AS BIGINT) AS idx, CAST(j AS BIGINT) AS j, CAST(2 * g + j AS DOUBLE) AS v FROM range(5) x(g), range(2) y(j) UNION ALL SELECT 'Pca', n_nationkey, j, 2 * n_nationkey + j FROM nation, range(2) y(j) WHERE n_regionkey > 1")
def bundle_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = cells(spark, sf_dir)
    b = ws[(ws.Region != "r0") & (ws.Region != "r1")].bundle()
    rows = b.varm["Loading"].withColumn("name", F.lit("Loading")).unionByName(b.obsm["Pca"].withColumn("name", F.lit("Pca")))
    return rows.select("name", "idx", F.posexplode("v").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS idx, 'r' || n_regionkey || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS \"Region\" FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)")
def bundle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)[:].bundle(obs=[], var=[], obs_key="Region").obs


@query("SELECT CAST(n_nationkey // 2 AS BIGINT) AS row, CAST(CASE WHEN n_regionkey > 1 THEN n_regionkey - 1 ELSE 0 END AS BIGINT) AS col, CAST(7 AS INTEGER) AS v FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey <> 1")
def bundle_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected_bundle(cells(spark, sf_dir), True, "Valid").X


@query("SELECT p_partkey AS idx, CAST((p_size + 65535) % 65536 AS BIGINT) AS total, 'p' || p_size AS text, CAST(p_size AS DOUBLE) AS x, 0.5::DOUBLE AS y FROM part")
def import_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of 16-bit layers, decoded bytes and points, as importers make them."""
    from .functions.scalars import decoded, layer_sum, points

    size = F.col("p_size").cast("long")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), layer_sum(F.array(size), F.array(F.lit(65535).cast("long")))[0].alias("total"), decoded(F.concat(F.lit("p"), size.cast("string")).cast("binary")).alias("text"), points(size.cast("double"), F.lit(0.5).cast("double")).alias("p"))
    return rows.select("idx", "total", "text", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("SELECT * FROM (VALUES ('event_id', 'EventId'), ('event_type', 'EventType'), ('props', 'Props'), ('ts', 'Ts'), ('user_id', 'UserId'), ('value', 'Value')) v(name, tensor)")
def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.scalars import camel_snake_pairs

    return spark.createDataFrame([*camel_snake_pairs(sorted(table(spark, sf_dir, "events").columns)).items()], "name string, tensor string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a filtered, grouped mean over events."""
    ws = ws_of(spark, sf_dir, "events")
    return View(ws, [(ws.Value > 20) & (ws.EventType == "purchase")]).groupby("UserId").mean("Value")
