"""The corpus pipeline: toxic documents out, one of each near-duplicate group, repeated passages out, sources mixed, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, others that docs may
have besides included, whatever their names. Rows that repeat, null texts, empty texts and null ids are kept unless a stage's decision
removes them; a null text has no word, byte or token. Texts are read whole, however long. Of equal choices the least id is taken, null last, then
the least hash of the text. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import common, exactdedup, jaccard, mixing, packing, simhash, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores under 0.5."""
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by a Jaccard likeness of 5-word shingles of at least 0.8.

    SimHash over anchors finds what differs in few bits, prefix filtering what SimHash misses; whole sets decide on both.
    """
    return simhash.one_of_each(docs, find=jaccard.near_copies)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings of 400 bytes that also start elsewhere, and of passages of over 50 words that another has too."""
    return exactdedup.remove(docs, "doc_id", "text", chars="n_chars", words=exactdedup.PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in an order that interleaves the sources, each weighing the square root of its documents while it lasts."""
    return mixing.mixed_order(docs, "source", "doc_id", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 4096 tokens, with their token ids; each input partition is packed in the order in which its rows were written."""
    import public_tokenizers

    return packing.pack(packing.in_file_order(docs), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", toxic_out), ("simhash near-dedup", near_duplicates_out), ("suffix-array dedup", repeats_out), ("mixing", mixed), ("best-fit packing", packed)]
#: SQL has neither the tokenizer nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
