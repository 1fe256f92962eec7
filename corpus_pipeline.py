"""Corpus preparation: from raw documents to packed sequences.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import exact_dedup, jaccard_join, mixing, packing, quality
from tallywork.llm.common import materialize, read_table, recorded, remove, run_dir
from tallywork.llm.tokens import vocabulary


#: Documents of a window of training positions.
WINDOW_ROWS = 1024
#: Intermediate tables of the latest call of each stage but the last, by the stage's name.
_left: dict[str, list[str]] = {}


def stage(f):
    """f as a stage, which first removes the intermediate tables of the stage before it: that one's result has been written, as docs reads it.

    Those of the last stage stay, as its result may be read at any later time, also after other runs.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [g.__name__ for _, g in STAGES]
        place = names.index(f.__name__)
        if place:
            remove(spark, _left.pop(names[place - 1], []))
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        if place < len(names) - 1:
            _left.setdefault(f.__name__, []).extend(made)
        return out

    return run_stage


@stage
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to labels.quality, rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the smallest doc_id."""
    return exact_dedup.one_of_each(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 or more connect, one stays."""
    return jaccard_join.drop_near_copies(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target words, documents repeated or left out, in the order of the curriculum."""
    return mixing.mix_documents(docs)


def position_window(docs: DataFrame) -> Column | None:
    """A name of each row's window, WINDOW_ROWS neighbours in training order; None, with a warning, for rows that are not read from Parquet.

    The stage before writes its rows sorted by position, so the file's name and the row's place in it give the order,
    whatever the number and the size of the files.
    """
    at = F.col("_metadata.row_index")
    try:
        docs.select(at)
    except AnalysisException:
        warnings.warn("the documents are not read from Parquet: they have no training order", stacklevel=2)
        return None
    return F.concat_ws("/", F.col("_metadata.file_name"), F.lpad(F.expr(f"_metadata.row_index div {WINDOW_ROWS}").cast("string"), 12, "0"))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids: windows of training positions in their order, in each the neighbours on the Hilbert curve."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), window=position_window(docs))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables between stages go as soon as the next stage's result is written; those that the last result reads stay."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for _, apply in STAGES[:-1]:
        place = run_dir(spark, "pipeline")
        docs = materialize(apply(spark, docs, sf_dir), place)
        remove(spark, before)
        before = [place]
    return STAGES[-1][1](spark, docs, sf_dir)
