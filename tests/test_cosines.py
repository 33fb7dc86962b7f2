"""Nearest vectors and all pairs against plain expressions, on odd rows too, and how they are worked off."""

from __future__ import annotations

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barwright.operators import embed, vector_index


def odd_items(spark, kind="double", d=5):
    """Copies of a few vectors, one of them in a third of the rows; rows without a vector, with nulls, NaN, infinities, zeros
    and other lengths; ids that come twice, with one vector or two; rows without an id."""
    rng = np.random.default_rng(4)
    few = rng.standard_normal((40, d)).round(2)
    rows = [(i, few[0 if i % 3 == 0 else rng.integers(40)].tolist()) for i in range(300)] + [(i, rng.standard_normal(d).tolist()) for i in range(300, 420)]
    odd = [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] + [1.0] * (d - 1), [1.0, 2.0], [-0.0] * d, [1e-20] * d]
    rows += [(420 + i, odd[i % len(odd)]) for i in range(60)]
    rows += [(i, few[0].tolist()) for i in (0, 0, 0, 0, 0, 3, 300, 305, 430)] + [(None, few[1].tolist()), (None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, f"id long, v array<{kind}>")


def plain(items, queries):
    q = queries.select(F.col("id").alias("query"), embed.unit("v").alias("_q"))
    return items.select("id", embed.unit("v").alias("_v")).crossJoin(F.broadcast(q)).select("query", "id", embed.dot("_q", "_v").alias("cosine"))


def told(df, *columns):
    """Rows with the bits of cosines (NaN and null as texts), in an order."""
    bits = lambda x: str(x) if x is None or math.isnan(x) else x.hex()
    return sorted(tuple(bits(r[c]) if c == "cosine" else str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block", [17, 10_000])
def test_odd_rows(spark, kind, block):
    items = odd_items(spark, kind).cache()
    asked = items.where("id % 5 = 0 or id is null")
    want = plain(items, asked)
    assert told(embed.cosine_pairs(items, asked, "id", "v", block=block), "query", "id", "cosine") == told(want, "query", "id", "cosine")
    for k in (1, 7, 470):
        w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
        best = want.where("query <> id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        got = embed.nearest(items, asked, "id", "v", k, block=block)
        assert told(got, "query", "rank", "id", "cosine") == told(best, "query", "rank", "id", "cosine")


def test_near_ties(spark):
    """Cosines that single precision doesn't tell apart are ranked by all their digits."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    items = spark.createDataFrame([(i, (base + 1e-9 * rng.standard_normal(16) * (i % 50)).tolist()) for i in range(900)], "id long, v array<double>").cache()
    asked = items.where("id % 100 = 7")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    want = plain(items, asked).where("query <> id").withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    assert told(embed.nearest(items, asked, "id", "v", 10), "query", "rank", "id") == told(want, "query", "rank", "id")


def test_keys_of_text(spark):
    items = odd_items(spark).where("id is not null").selectExpr("concat('é', id) as id", "v").cache()
    asked = items.where("id like '%7'")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    want = plain(items, asked).where("query <> id").withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    assert told(embed.nearest(items, asked, "id", "v", 4), "query", "rank", "id") == told(want, "query", "rank", "id")


def test_no_queries_or_items(spark):
    items = odd_items(spark)
    none = items.where("id < 0")
    for a, b in ((items, none), (none, items), (none, none)):
        assert embed.nearest(a, b, "id", "v", 3).count() == 0 == embed.cosine_pairs(a, b, "id", "v").count()


def test_one_file_is_many_tasks(spark, tmp_path):
    """The items of a single file are dealt to tasks by their pairs."""
    items = spark.range(20_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id"))).alias("v"))
    items.coalesce(1).write.parquet(f"file://{tmp_path}/v")
    items = spark.read.parquet(f"file://{tmp_path}/v")
    asked = items.where("id % 100 = 0")
    assert items.rdd.getNumPartitions() == 1
    for found in (embed.cosine_pairs(items, asked, "id", "v"), embed.nearest(items, asked, "id", "v", 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(4)" in plan and "NestedLoop" not in plan and "Broadcast" not in plan


def test_recall_runs_the_exact_search_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    exact = spark.range(40).selectExpr("id % 4 as query", "id").mapInArrow(counted, "query long, id long")
    found = spark.range(30).selectExpr("id % 4 as query", "id")
    assert vector_index.recall(found, exact, "id") == 0.75
    assert runs.value == 40


def test_norms_are_summed_once(spark):
    """The work on a vector grows with its length, not with the length's square."""
    long = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda i: F.sin(i + F.col("id"))).alias("v")).cache()
    long.count()

    def took(x):
        t = time.monotonic()
        long.select(x.alias("x")).write.format("noop").mode("overwrite").save()
        return time.monotonic() - t

    took(embed.dot("v", "v"))
    assert took(embed.unit("v")) < 1 + 10 * took(embed.dot("v", "v"))


def test_index_search_on_copies(spark, tmp_path):
    """A search by cells finds what the plain join by cell finds, with copies in a third of the rows and repeated ids."""
    items = odd_items(spark).where("id is null or size(v) = 5").cache()
    index = vector_index.build_index(items, f"file://{tmp_path}/ix", "id", "v", cells=12)
    asked = items.where("id % 5 = 0")
    cells = vector_index._with_cells(vector_index._usable(asked, "id", "v"), "v", index.centres, 4).select(F.col("id").alias("query"), F.col("v").alias("_q"), F.explode("cells").alias("cell"))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    want = index.rows(spark).join(cells, "cell").where("query <> id").select("query", "id", embed.dot("_q", "v").alias("cosine"))
    want = want.withColumn("rank", F.row_number().over(w)).where("rank <= 6")
    for block in (13, 10_000):
        got = vector_index.search(index, asked, 6, probes=4, block=block)
        assert told(got, "query", "rank", "id", "cosine") == told(want, "query", "rank", "id", "cosine")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # a query's vector isn't copied for each of its cells
    assert vector_index.search(index, asked.where("id < 0"), 6, probes=4).count() == 0


def test_rounding_is_that_of_sql(spark):
    """Halves go as DuckDB has them, which scales first; `F.round`, used before, goes by the decimal text."""
    halves = [(2 * k + 1) * 5e-6 for k in range(4_000)]
    x = [0.0, -0.0, 1.0, -1.0, 1e-7, -1e-7, float("nan"), None, *halves, *(-h for h in halves), *(float(np.nextafter(h, 1)) for h in halves), *(float(np.nextafter(h, 0)) for h in halves)]
    df = spark.createDataFrame(list(enumerate(x)), "id long, c double").coalesce(1)
    got = df.select("id", embed.rounded_cosine("c", 5).alias("cosine"))
    con = duckdb.connect()
    con.register("t", df.toArrow())
    want = dict(con.execute("SELECT id, round(c, 5) + 0.0 FROM t").fetchall())
    bits = lambda x: str(x) if x is None or math.isnan(x) else x.hex()
    assert {r.id: bits(r.cosine) for r in got.collect()} == {k: bits(v) for k, v in want.items()}
    before = df.select("id", (F.round("c", 5) + 0.0).alias("cosine")).collect()
    assert any(r.cosine is not None and bits(r.cosine) != bits(want[r.id]) for r in before)
