"""Corpus preparation: five stages over the documents, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import jaccard, language, mixing, packing, quality, scratch


_mark = 0


def _begin(spark: SparkSession, first: bool = False) -> None:
    """Delete the intermediate tables of the stage before, whose output has been written by now."""
    global _mark
    if not first:
        scratch.sweep(spark, _mark)
    _mark = scratch.mark()


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letter (null and empty texts too), or a score under 0.5.

    Three in four documents with a language are learned from; without any, all
    documents go.  Repeated rows stay or go together; an empty table stays empty.
    """
    _begin(spark, first=True)
    model = language.fit(docs.where(~language.held_out("doc_id", 4, 2)))
    return language.keep_identified(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted to be of low quality.

    Labels of documents that are gone are not learned from; without any label
    all documents stay.  Null texts count as empty ones; repeated rows stay or
    go together; an empty table stays empty.
    """
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~language.held_out("doc_id", 5, 0)))
    return quality.keep_good(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least id.

    Of repeated rows one stays; texts without words, null and empty ones
    too, are nobody's copies and all stay; an empty table stays empty.
    """
    _begin(spark)
    return jaccard.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix has it: never, or up to three times.

    Null sources are one source; texts without words go with their hash like
    others; an empty table stays empty.
    """
    _begin(spark)
    return mixing.apply(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: one row per piece, of each copy.

    Null and empty texts are the closing token alone; an empty table stays empty.
    """
    import public_tokenizers

    _begin(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("jaccard_dedup", jaccard_stage),
    ("source_mix", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models, hash draws and a vocabulary have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table is deleted once the next one is written.

    Columns beside those of documents pass through all stages but the last,
    whatever their names; nulls in them mean nothing to any stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name, swept=False)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
