"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns
documents with the same columns; the last returns packed pieces. `run` writes each stage's rows as
Parquet in the shared scratch folder and reads them again, so that a lost executor repeats one
stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.line_dedup import dedup_lines
from docloom.llm.minhash import keep_one_of_each
from docloom.llm.packing import pack_documents
from docloom.llm.quality import keep_good
from docloom.llm.queries import table, tokenizer_path
from docloom.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules, with all their columns. A null text has no words and goes;
    rows that repeat are judged alike."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line. One whose every line with a word is such a
    line is a copy and goes; one that had no words stays, and so does a null text. Rows that agree in
    id and text lose the same lines. n_chars, if it is there, follows the text; other columns are carried."""
    out = dedup_lines(docs, drop_copies=True)
    return out.selectExpr(*(f"CAST(char_length(text) AS {t}) AS n_chars" if c == "n_chars" else f"`{c}`" for c, t in docs.dtypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8), with all
    its columns. Null texts and texts without words are alike to nothing and stay, as do rows without
    an id; rows that repeat the kept id stay as rows."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens. A null text is the end token
    alone; every row is packed, repeated ones too; only ids and texts play a part."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]
#: Packing is no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
