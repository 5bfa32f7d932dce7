"""Source and sink queries: the tables make a round trip through the shared scratch folder."""

import json

from pyspark.sql import functions as F

from tabloom.functions.lineage import scratch
from tabloom.operators import encode as enc
from tabloom.operators import scale as sc
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import query
from tabloom.sources import sinks, tables

PART = "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"


@query("read_delimited", "SRC1", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def _(spark, d):
    path = scratch(spark, "semicolon")
    fx.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.option("sep", ";").option("header", True).csv(path)
    return tables.read_delimited(spark, path, PART, sep=";")


RUN = "dataset string, encoder string, generator string, teacher string, random_state int, performance double"
RUN_COLS = ["dataset", "encoder", "generator", "teacher", "random_state", "performance"]


def run_dirs(spark, d):
    path = scratch(spark, "runs")
    r = fx.results(spark, d).select(*RUN_COLS)
    for name, cond in (("exp-a_20240101_101500_1-2-3", "random_state <= 3"), ("exp-a_20240102_101500_4-5_x", "random_state in (4, 5)"), ("exp-b_20240103_120000_6-7", "random_state > 5")):
        r.where(cond).write.option("header", True).csv(f"{path}/{name}")
    return path


@query("read_runs", "SRC2", f"WITH {fx.RESULTS_SQL} SELECT {', '.join(RUN_COLS)} FROM res")
def _(spark, d):
    return tables.read_runs(spark, run_dirs(spark, d), RUN).drop("path")


@query("read_attach_labels", "SRC3", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    t = fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    parts = [t.where("lang = 'en'").drop("lang"), t.where("lang <> 'en'").drop("lang")]
    return tables.attach_labels(parts, fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("read_dataset", "SRC4", "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def _(spark, d):
    base = scratch(spark, "dataset")
    fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(f"{base}/customer")
    fx.table(spark, d, "orders").select("o_orderkey", "o_custkey").write.option("header", True).csv(f"{base}/orders")
    meta = json.dumps({"tables": {
        "customer": {"path": "customer", "fields": {"c_custkey": {"type": "id"}, "c_name": {"type": "categorical"}, "c_acctbal": {"type": "numerical"}}},
        "orders": {"path": "orders", "fields": {"o_orderkey": {"type": "id"}, "o_custkey": {"type": "id", "ref": {"table": "customer", "field": "c_custkey"}}}}}})
    t = tables.read_dataset(spark, meta, base, max_columns=2)
    (child, ck, parent, pk), = tables.foreign_keys(meta)
    return t[child].join(t[parent], t[child][ck] == t[parent][pk]).select("c_custkey", "c_name", "o_orderkey")


@query("read_capped", "SRC5", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r <= 5000")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.select(*tables.cap_columns(li.columns, 3)).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return tables.cap_rows(li, "k", 5000).drop("k")


@query("read_group_runs", "SRC6", """SELECT 'exp-a' AS base, NULL AS suffix, 1::BIGINT AS runs, '1,2,3' AS seeds UNION ALL SELECT 'exp-a', 'x', 1, '4,5' UNION ALL SELECT 'exp-b', NULL, 1, '6,7'""")
def _(spark, d):
    g = tables.group_runs(tables.read_runs(spark, run_dirs(spark, d), RUN), by_suffix=True)
    return g.select("base", "suffix", "runs", F.concat_ws(",", F.col("seeds").cast("array<string>")).alias("seeds"))


@query("write_results", "SNK1", f"WITH {fx.RESULTS_SQL} SELECT {', '.join(RUN_COLS)} FROM res")
def _(spark, d):
    path = sinks.write_results(fx.results(spark, d).select(*RUN_COLS), scratch(spark, "results"), by=["dataset"])
    return spark.read.option("header", True).schema(RUN).csv(path)


@query("write_collected_scores", "SNK2", f"WITH {fx.RESULTS_SQL} SELECT DISTINCT {', '.join(RUN_COLS)} FROM res")
def _(spark, d):
    path, out = run_dirs(spark, d), scratch(spark, "scores")
    fx.results(spark, d).select(*RUN_COLS).where("random_state = 1").write.option("header", True).csv(f"{path}/again")
    return spark.read.option("header", True).schema(RUN).csv(sinks.collect_scores(spark, path, RUN, out))


@query("write_ranks", "SNK3", f"""WITH {fx.RESULTS_SQL} SELECT 'performance' AS metric, dataset, coalesce(generator, 'nan') AS generator,
row_number() OVER (PARTITION BY dataset ORDER BY avg(performance)) - 1 AS rank FROM res GROUP BY 2, 3""")
def _(spark, d):
    from pyspark.sql import Window

    m = fx.results(spark, d).groupBy("dataset", F.coalesce("generator", F.lit("nan")).alias("generator")).agg(F.avg("performance").alias("m"))
    r = m.select(F.lit("performance").alias("metric"), "dataset", "generator", (F.row_number().over(Window.partitionBy("dataset").orderBy("m")) - 1).cast("long").alias("rank"))
    path = sinks.write_ranks(r, scratch(spark, "ranks"))
    return sinks.read_ranks(spark, path, "metric string, dataset string, generator string, rank long")


@query("write_libsvm", "SNK4", f"""WITH {fx.MIXED_SQL} SELECT CASE WHEN status = 'F' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, count(*) AS n,
round(sum((price - (SELECT min(price) FROM mixed)) / (SELECT max(price) - min(price) FROM mixed)), 4) AS price FROM mixed GROUP BY 1""")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    m = fx.mixed(spark, d).select("segment", "price", "status")
    hot = enc.one_hot(sc.fit_min_max(m, ["price"]).transform(m), ["segment"])
    feats = [c for c in hot.columns if c != "status"]
    path = sinks.write_libsvm(hot, scratch(spark, "libsvm"), "status", ["F"], feats)
    back = spark.read.format("libsvm").option("numFeatures", len(feats)).load(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(vector_to_array("features")[feats.index("price")]), 4).alias("price"))
