"""Strategy files as rows (SRC16, SRC17, G21): one row a strategy with its JSON as a variant, one row a gene.

Files are read and decoded by tasks; which file of a horizon counts, and which of several strategies of a name, are windows
over the rows. Texts that are no JSON give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The order in which the files of a horizon are looked for, that of all files in a search by name, and the
#: keys under which genes name features.
TAILS = ("_top5_unique", "_top10", "")
PATTERNS = (r"^found_strategies\.json$", r"^candidates\.json$", r"^\w*strategies_\w*_top5_unique\.json$", r"^\w*strategies_\w*_top10\.json$", r"^\w*strategies_\w*\.json$", r"^optimized_\w*\.json$")
FEATURE_KEYS = ("feature", "regime_feature", "feature_left", "feature_right", "feature_a", "feature_b", "feature_short", "feature_long")
NONE = -999.0


def _get(path: str, kind: str, v: str = "item") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def strategy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, item variant, name, horizon, robust_return, full_return, sortino_oos) of every strategy in the files of a
    path; a file holds a list or one object.

    A horizon that is missing is the first number between the underscores of the file's name. Metrics stand under
    ``metrics`` or beside it; robust_return falls back to test_return, sortino_oos to test_sortino, and all to -999.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+\.json)(/part-[^/]*)?$", 1).alias("file"), F.trim("value").alias("text"))
    listed = F.when(F.col("text").startswith("{"), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    raw = raw.select("file", F.try_parse_json(listed).alias("all")).where("all is not null")
    raw.createOrReplaceTempView(view := f"strategy_files_{abs(hash(path)) % 10**12}")
    rows = spark.sql(f"SELECT file, v.pos AS pos, v.value AS item FROM {view}, LATERAL variant_explode(all) v").where("schema_of_variant(item) LIKE 'OBJECT%'")
    named = F.filter(F.split(F.regexp_replace("file", r"\.json$", ""), "_"), lambda p: p.rlike(r"^\d+$"))
    first = lambda *paths: F.coalesce(*[_get(p, "double") for p in paths], F.lit(NONE))
    return rows.select(
        "file", "pos", "item", _get("$.name", "string").alias("name"), F.coalesce(_get("$.horizon", "int"), F.get(named, F.lit(0)).try_cast("int")).alias("horizon"),
        first("$.metrics.robust_return", "$.robust_return", "$.test_return").alias("robust_return"), first("$.metrics.full_return", "$.full_return").alias("full_return"), first("$.metrics.sortino_oos", "$.test_sortino").alias("sortino_oos"),
    )


def of_horizons(rows: DataFrame) -> DataFrame:
    """The strategies of the first file that each horizon has, in the order of TAILS (SRC16); the horizon is that of the
    file's name, ``file_horizon``."""
    parts = F.regexp_extract("file", r"_(\d+)(_top5_unique|_top10)?\.json$", 1)
    tail = F.regexp_extract("file", r"_\d+(_top5_unique|_top10)?\.json$", 1)
    ranked = rows.withColumns({"file_horizon": parts.try_cast("int"), "_rank": F.array_position(F.array(*[F.lit(t) for t in TAILS]), tail)}).where("file_horizon is not null")
    best = ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy("file_horizon")))
    return best.where("_rank = _best").drop("_rank", "_best")


def by_name(rows: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Of every name the first strategy, by the first of ``patterns`` that its file matches, then file and place (SRC17)."""
    rank = F.coalesce(*[F.when(F.col("file").rlike(p), k) for k, p in enumerate(patterns)])
    w = Window.partitionBy("name").orderBy("_rank", "file", "pos")
    return rows.withColumn("_rank", rank).where("_rank is not null and name is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def gene_rows(rows: DataFrame) -> DataFrame:
    """(file, pos, name, side, place, type, gene variant, features) of every gene (G21); genes without a type are left out."""
    rows.createOrReplaceTempView(view := f"strategy_genes_{abs(hash(tuple(rows.columns))) % 10**12}")
    sides = " UNION ALL ".join(f"SELECT file, s.pos AS pos, name, '{side}' AS side, g.pos AS place, g.value AS gene FROM {view} s, LATERAL variant_explode(try_variant_get(s.item, '$.{side}_genes', 'variant')) g" for side in ("long", "short"))
    genes = rows.sparkSession.sql(sides).withColumn("type", _get("$.type", "string", "gene")).where("type is not null")
    features = F.array_distinct(F.filter(F.array(*[_get(f"$.{k}", "string", "gene") for k in FEATURE_KEYS]), lambda f: f.isNotNull()))
    return genes.select("file", "pos", "name", "side", "place", "type", "gene", features.alias("features"))


def gene_counts(genes: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` commonest (type, feature) of genes (AG14): a report. A gene without features counts once, with none."""
    rows = genes.select("type", F.explode_outer("features").alias("feature")).groupBy("type", "feature").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "type", F.asc_nulls_first("feature")).limit(n)
