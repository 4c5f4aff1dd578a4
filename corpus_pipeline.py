"""A cleaning pipeline over ``documents``: quality, boilerplate lines, near-duplicates, long repeats, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents, and only take rows away or
shorten ``text`` (``n_chars`` follows it). Null texts count as empty ones. Rows of a null doc_id pass the near-duplicate
stage as they are. Rows of one doc_id and different texts are different documents; of rows of one doc_id and one text
one stays there. Any other columns go along unchanged, whatever their names. An empty table passes through as an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import knn_quality, long_repeats, packing, shingle_sets, site_lines
from quantloom.llm.common import keyed, stage, stored

TOKENIZER = "byte_bpe_50k.json"


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where a table has such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote accepts."""
    model = knn_quality.train(docs, stored(spark, sf_dir, "labels"))
    return knn_quality.score(docs, model, whole=True).where("predicted = 1").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many documents of their source hold."""
    return _sized(site_lines.dedup_texts(docs, "source"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Pairs are chosen by SimHash fingerprints whose reach is wide enough for that, then checked on the shingles.
    """
    groups = shingle_sets.similar_texts(docs.where("doc_id is not null"))
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key")).select("key")
    rows = keyed(docs.where("doc_id is not null")).join(first, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return rows.select("row.*").unionByName(docs.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur elsewhere too."""
    found = long_repeats.remove_passages(docs).where("kept_text is not null").dropDuplicates(["key"])
    rows = keyed(docs).join(found, "key", "left")
    text = F.coalesce("kept_text", "row.text")
    return _sized(rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, placed in sequences."""
    import public_tokenizers  # where the vocabulary files are; only this stage needs them

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("packing", pack),
]

#: Neighbour votes, components of near-duplicates and the packing plan have no SQL. Tests compare the near-duplicate stage
#: with brute force; of the others they check columns, counts and single ids, and the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
