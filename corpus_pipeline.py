"""Documents to packed training sequences, in five stages.

Each stage works on what the one before kept. The first four return the columns of documents: the language stage drops
texts that no model explains, line dedup shortens texts and drops those of which nothing is left, then one document of
each group of near duplicates stays, and documents with passages of the benchmark go. The last stage packs the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskwise.llm import decontaminate, groups, language, lines, packing
from deskwise.llm.common import free_name, table, written
from deskwise.llm.queries import tokenizer_path


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns of these names, in upper or lower case, renamed, and the way back."""
    back = {free_name(docs, f"own_{c}"): c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed({c: t for t, c in back.items()}), back


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text a language model explains; the models are learnt from those whose crc32 permits it.

    Null texts, texts without a letter and those that every model finds improbable go; the others stay as they are, rows
    that repeat each other included. Without any labelled document nothing can be explained and nothing stays.
    """
    renamed, back = _aside(docs, ("lang_pred", "score", "bits_per_symbol", "n_letters", "accepted"))
    model = language.train(language.training_rows(docs))
    return language.predict(renamed, model).where("accepted").select(*renamed.columns).withColumnsRenamed(back)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that repeat earlier ones; ``n_chars`` is set anew.

    Documents that lost lines and have nothing but white space left go. Null, empty and blank texts stay as they are.
    """
    renamed, back = _aside(docs, ("n_lines", "n_removed"))
    found = lines.without_repeated(renamed)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.where(r"n_removed = 0 or text rlike '\\S'").select(*renamed.columns).withColumnsRenamed(back)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id; of repeated rows one.

    Null texts and texts without words are near nothing and stay.
    """
    return groups.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark; each row goes or stays for its own text, whatever its id."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens, in sequences of at most 1024; a null or empty text is its end token."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("language", known_language),
    ("line dedup", distinct_lines),
    ("near duplicates", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]
#: The models and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
