"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.llm import (
    alignment, decontamination, jaccard, language, mixing, neighbours, packing, quality, secrets, sharding, spelling,
    substrings, token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Queries that SQL can express.
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under the name of its function."""
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier, out of all documents."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases of 13 words in all documents."""
    found = decontamination.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op2_decontamination"] = decontamination.DECONTAMINATION_SQL


@query
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents joined at a similarity of 0.75 of five-word shingles."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


ORACLES["op3_jaccard"] = jaccard.JACCARD_SQL


@query
def op3_jaccard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op3_jaccard, each with its number of links."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query
def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of op3_jaccard between different sets of shingles."""
    return jaccard.similar_sets(table(spark, sf_dir, "documents"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked weak parts of all documents."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


ORACLES["op4_secrets"] = secrets.SECRETS_SQL


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language.identify_languages(table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a field over their lines."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back."""
    import public_tokenizers

    folder = token_files.fresh_folder(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer)
    return token_files.read_token_files(spark, folder)


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in all documents, with how common each link is."""
    import public_tokenizers

    found = alignment.align_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent form they are one letter away from."""
    words = spelling.corpus_words(table(spark, sf_dir, "documents"))
    return spelling.variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of power-of-two lengths, written and read back."""
    import public_tokenizers

    folder = packing.fresh_folder(spark)
    packing.write_sequences(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=2
    )
    return packing.read_sequences(spark, folder, with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
