"""Operator 5: approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one class, which carries the smallest ids that any query could ask for. Classes are dealt to shards by
hash. Each shard builds its graph; each block of queries searches every shard by beam search; the candidates are scored
again in double precision and merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stage
from quantloom.llm.pruned_graph import SEARCH_BEAM, beam_search, build, lifted

#: Vectors in a shard at most (about), shards at least, and queries in a block (about). Recall falls as shards grow under
#: the same beam: the README has what was measured at this size.
SHARD_ROWS, LEAST_SHARDS, QUERY_BLOCK = 12_500, 6, 16_384


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that are not null, not zero, of finite components and of the commonest length (products of
    others are not defined). Single-precision vectors stay so, all others are double.

    Ids that are null take no part. Of the lengths that occur equally often the smaller counts as the commonest.
    """
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast(f"array<{kind}>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.coalesce(fine, F.lit(False)))
    length = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return v.join(F.broadcast(length), F.size("v") == F.col("d"), "left_semi")  # one row


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found of every vector whose id ``every`` divides: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a query never finds its own id.
    Fewer candidates than ``k`` give fewer rows; an empty table gives none. A repeated id counts as two candidates only
    if its vectors differ. Null ids, and vectors that are null, zero or hold anything not finite, take no part, nor do
    vectors of another length than the commonest. Other columns are not read.
    """
    vectors = stage(usable(df, id_col, vec_col).distinct(), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")  # ranks are limited before the shuffle, so a hot class is no load
    members = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = stage(members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.col("ids")[0]), "classes")
    total = classes.count()
    shards = max(LEAST_SHARDS, -(-total // SHARD_ROWS))
    queries = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    bound = classes.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
    shard = F.pmod(F.xxhash64("class", F.lit(11)), F.lit(shards)).cast("int")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        x = lifted(np.stack(pdf["v"].to_numpy()).astype(np.float32), bound)
        graph, start = build(x)
        out = pdf[["shard", "class", "v"]].copy()
        out["near"] = list(graph.astype(np.int32))
        out["start"] = np.arange(len(x)) == start
        out["place"] = np.arange(len(x))
        return out

    made = classes.select(shard.alias("shard"), "class", "v").groupBy("shard")
    made = stage(made.applyInPandas(index, f"shard int, class long, v {classes.schema['v'].dataType.simpleString()}, near array<int>, start boolean, place int"), "graph")

    def search(graph: pa.Table, asked: pa.Table) -> pa.Table:
        g, q = graph.to_pandas().sort_values("place"), asked.to_pandas()
        out = {"query_id": [], "class": [], "score": []}
        if len(g) and len(q):
            raw = np.stack(g["v"].to_numpy())
            x, near, names = lifted(raw.astype(np.float32), bound), np.stack(g["near"].to_numpy()).astype(np.int64), g["class"].to_numpy()
            start = int(np.flatnonzero(g["start"].to_numpy())[0])
            ask = np.stack(q["v"].to_numpy())
            width = min(beam, len(x))
            for at in range(0, len(ask), 256):
                block = ask[at : at + 256]
                ids, _ = beam_search(x, near, start, np.pad(block.astype(np.float32), ((0, 0), (0, 1))), max(width, 2))
                score = np.einsum("qkd,qd->qk", raw[ids].astype(np.float64), block.astype(np.float64))
                score[ids < 0] = -np.inf
                best = np.lexsort((names[ids], -score), axis=1)[:, : k + 1]
                rows = np.repeat(np.arange(len(block)), best.shape[1]).reshape(best.shape)
                good = np.isfinite(score[rows, best])
                out["query_id"].append(q["vec_id"].to_numpy()[at : at + 256][rows[good]])
                out["class"].append(names[ids[rows, best][good]])
                out["score"].append(score[rows, best][good])
        return pa.table({c: np.concatenate(v) if v else np.array([], np.float64 if c == "score" else np.int64) for c, v in out.items()})

    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int")
    asked = queries.select(block.alias("block"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = made.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "query_id long, class long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    found = found.join(classes.select("class", "ids"), "class").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
