"""What the operators of this subpackage share: staging, input normalisation, Arrow helpers, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one slice that an Arrow function turns into Python objects at once; bounds a worker's memory.
SLICE_ROWS = 512


#: Rounds of ``components`` whose jumps one plan follows.
JUMPS = 6
#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A local session that names none gets a folder of its own; on a cluster that would be a folder which other machines
    don't see, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="quantloom-"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a read, not a recomputation, and several readers share the work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, so that extra columns with clashing names can do no harm."""
    return df.select(*(df[source].alias(name) for name, source in columns.items()))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def key_of(doc_id: Column, text: Column) -> Column:
    """A key that is the same for rows of the same id and text alone; a null text counts as an empty one."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.lit("\0"), F.coalesce(text, F.lit("")))))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, row): each row whole in a struct, so that none of its columns can clash, beside its ``key_of``."""
    return df.select(key_of(df[id_col], df[text_col]).alias("key"), F.struct(*[df[c] for c in df.columns]).alias("row"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str | StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` of a function from a slice to columns (lists or arrays by name)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            columns = make(part)
            arrays = [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.mapInArrow(run, schema)


def sample_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer) of the least hashes of ``key``, always the same ones.

    Rows are first thinned to twice the wanted number over the whole table, so that what tasks send on doesn't grow
    with their number.
    """
    total = df.count()
    h = F.xxhash64(key)
    if total > 4 * rows:
        df = df.where(F.pmod(h, F.lit(total)) < 2 * rows)
    return df.orderBy(h, key).limit(rows)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node reachable.

    Contraction: in each round every representative hooks onto the neighbour, or itself, of the least hash (another one each
    round), one pointer jump follows, and edges are rewritten between the new representatives; edges inside a component
    vanish, so the tables shrink. By hashes about a third of a chain is left each round, in whatever order its nodes are
    named, so the rounds grow with the logarithm of its length; some node hooks in every round that has an edge, so they
    end. Only aggregations and equi-joins are used, and nothing is gathered on the driver. A round stages its jumps and its
    edges; nodes follow the jumps of JUMPS rounds at once. Null ends are ignored. Nodes without edges are not in the result.
    """
    plain = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    links = stage(plain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    label = nodes.withColumn("component", F.col("node"))
    links, number = links.where("a <> b"), 0
    while not links.isEmpty():
        number += 1
        rank = lambda c, k=number: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("p")).select(F.col("a").alias("k"), F.least("p", rank("a"))["id"].alias("p"))
        up = hook.select(F.col("k").alias("p"), F.col("p").alias("pp"))
        hook = stage(hook.join(up, "p", "left").select("k", F.coalesce("pp", "p").alias("p")), "jumps")
        label = label.join(hook.withColumnRenamed("k", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        label = label if number % JUMPS else stage(label, "labels")
        left = links.join(hook.select(F.col("k").alias("a"), F.col("p").alias("pa")), "a").select("pa", "b")
        links = left.join(hook.select(F.col("k").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        links = stage(links.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if not number:
        return label
    label = stage(label, "labels") if number % JUMPS else label
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return label.join(least, "component").select("node", F.col("least").alias("component"))
