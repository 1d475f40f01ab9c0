"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield import ready
from quietfield.llm import exact_dedup, langid, mixing, packing, similar
from quietfield.llm.common import cut

#: No SQL: the stages train a model, hash shingles, rake weights and run a tokenizer.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters go. lang becomes the recognised one where it was null.

    Where no labelled row can be learnt from there is no model: every document with letters stays as it is, lang null or not.
    Null and letterless texts go, repeated rows stay, texts are read whole, and an empty table stays empty."""
    ready(spark)
    model = langid.learn(docs)
    if model is None:
        return langid.lettered(docs)
    names = docs.columns
    kept = [docs[f"`{c}`"].alias(f"_keep_{k}") for k, c in enumerate(names)]  # whatever columns are called
    found = langid.predict(docs, model, keep=kept).where(F.col("lang_pred") != langid.UNKNOWN)
    lang = names.index("lang")
    columns = [F.coalesce(f"_keep_{k}", "lang_pred") if k == lang else F.col(f"_keep_{k}") for k in range(len(names))]
    return found.select([c.alias(n) for c, n in zip(columns, names, strict=True)])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space, the one with the smallest id, a null id last.

    Null counts as the empty text; of rows with one id and text the first by place stays; an empty table stays empty."""
    ready(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (5-word shingles, similarity 0.8), the one with the smallest id.

    Rows are told apart by their place in the stage's input, so rows of one id, or without one, go only if their own text is a
    near copy of a kept one. Texts without words, null included, are copies of each other. An empty table stays empty."""
    ready(spark)
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities.

    A null source or language is a value of its axis, a null text is one token, repeated rows are drawn alike, rows without an id
    each by their text, and an empty table stays empty."""
    ready(spark)
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences: null texts are their end id, long ones are cut into pieces.

    Repeated rows are packed each, null ids stay null, and an empty table packs nothing."""
    ready(spark)
    return packing.packed(docs, keep=200_000)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
