"""Registered queries of the training-data operators: thin calls that derive digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm.common import documents, read_table, scratch
from kbforge.llm.setm import PHRASES_SQL
from kbforge.llm.strata import RANKED_SQL
from kbforge.llm.waterfill import MIX_SQL


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as byte planes, digests read back from the files."""
    from kbforge.llm.bitplanes import read_digests, write_ids

    docs = documents(spark, sf_dir)
    path = scratch(spark, "ids")
    write_ids(docs, path, tokenizer_path())
    return read_digests(spark, path)


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    from kbforge.llm.simhash_segments import as_hex, near_duplicates

    found = near_duplicates(documents(spark, sf_dir), words=3, max_bits=2)
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    from kbforge.llm.waterfill import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from kbforge.llm.blocktext import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, base rules and the verdict of boosted trees for every document."""
    from kbforge.llm.gbt_quality import train, verdicts

    docs = documents(spark, sf_dir)
    return verdicts(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op5_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base kinds and hard-to-guess credential values."""
    from kbforge.llm.guesscost import common_words, scan

    docs = documents(spark, sf_dir)
    return scan(docs, common_words(docs))


def op6_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by the factorization machine."""
    from kbforge.llm.fm_toxicity import scores, train

    docs = documents(spark, sf_dir)
    return scores(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document; documents without a leak have no row."""
    from kbforge.llm.tiling import contamination

    return contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the byte convolutional network."""
    from kbforge.llm.bytecnn import predictions, train

    docs = documents(spark, sf_dir)
    return predictions(docs, train(docs))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the sparse rule ensemble."""
    from kbforge.llm.rulefit import scores, train

    docs = documents(spark, sf_dir)
    return scores(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op11_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard similarity 0.85 of its 4-word shingles."""
    from kbforge.llm.combinations import similar_documents

    return similar_documents(documents(spark, sf_dir), words=4, percent=85)


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, by the length-stratified index."""
    from kbforge.llm.strata import ranked

    return ranked(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op13_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of two and three words."""
    from kbforge.llm.setm import collocations

    return collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_bitplane_ids": op1_bitplane_ids,
    "op2_simhash_components": op2_simhash_components,
    "op3_block_text": op3_block_text,
    "op4_quality_trees": op4_quality_trees,
    "op5_guess_cost_secrets": op5_guess_cost_secrets,
    "op6_fm_toxicity": op6_fm_toxicity,
    "op7_string_tiling": op7_string_tiling,
    "op8_byte_cnn_language": op8_byte_cnn_language,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_mix_sources": op10_mix_sources,
    "op11_combination_join": op11_combination_join,
    "op12_stratified_search": op12_stratified_search,
    "op13_setm_phrases": op13_setm_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op10_mix_sources": MIX_SQL,
    "op12_stratified_search": RANKED_SQL,
    "op13_setm_phrases": PHRASES_SQL,
}
