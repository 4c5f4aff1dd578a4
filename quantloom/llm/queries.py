"""The registered queries: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import stored


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.media_chunks import media_features

    return media_features(stored(spark, sf_dir, "documents"))


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.knn_quality import score, train

    documents = stored(spark, sf_dir, "documents")
    return score(documents, train(documents, stored(spark, sf_dir, "labels")))


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.site_lines import dedup_html

    return dedup_html(stored(spark, sf_dir, "pages"))


def op4_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.simhash import near_duplicates

    return near_duplicates(stored(spark, sf_dir, "documents"))


def op5_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.neighbours import nearest

    return nearest(stored(spark, sf_dir, "embeddings"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quantloom.llm.piece_codec import encode_decode

    return encode_decode(stored(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quantloom.llm.packing import pack

    return pack(stored(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), kept_words=700_000, slice_bytes=4 << 20)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.licences import scan_licences

    return scan_licences(stored(spark, sf_dir, "documents"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.language_model import score

    return score(stored(spark, sf_dir, "documents"))


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.long_repeats import remove_repeats

    return remove_repeats(stored(spark, sf_dir, "documents")).drop("key", "kept_text")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.phrases import collocations

    return collocations(stored(spark, sf_dir, "documents")).drop("pointer")


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.decontaminate import contaminated

    return contaminated(stored(spark, sf_dir, "documents"), stored(spark, sf_dir, "benchmark")).drop("hit_spans")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.merkle import manifest

    return manifest(stored(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from quantloom.llm import decontaminate, merkle, site_lines

    return {"op3_site_lines": site_lines.SQL, "op12_winnowing": decontaminate.SQL, "op13_merkle_manifest": merkle.SQL}
