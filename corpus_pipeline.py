"""A corpus pipeline of five operators: toxicity, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, mixing, packing, toxicity
from tidemark.llm.shared import new_dir, table

#: A document in another language than it names goes only if the log odds of that against the one named are at least so high (1,000 to 1), and
#: of its words' evidence between the two less than this share is for the one named; mixed ones have more and stay.
NAMED_ODDS, NAMED_SHARE = 7.0, 0.05


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; all labels teach.

    Null and empty texts have no neighbours and stay, long texts are scored whole, repeated rows fare alike, a null id teaches nothing. No labels of one
    kind: nothing goes. An empty table stays empty. Columns keep their values whatever their names.
    """
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index, with_row=True).filter("predicted = 0").select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go (null and empty texts among them), and those that are certainly in another language than they name.

    A null language names none. Long texts are read whole, repeated rows fare alike, ties go to the first language by name. An empty table stays
    empty. Columns keep their values whatever their names.
    """
    model = language.fit(docs)
    wrong = F.coalesce((F.col("named_odds") >= NAMED_ODDS) & (F.col("named_share") < NAMED_SHARE), F.lit(False))
    return language.identify(docs, model, named_col="lang", with_row=True).filter((F.col("lang_pred") != language.UNKNOWN) & ~wrong).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays, once; texts without words all stay.

    Null ids come after all others; of rows alike in id and text the first by the other columns stays. Long texts are compared whole. An
    empty table stays empty. Names that start with ``_tm_`` are the operator's own.
    """
    return jaccard.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: repeated by whole epochs, the last one cut at its source's budget.

    A null source is a source of its own. Texts without words go, as nothing of them is taken; a long text at the cut is taken in part. Rows alike at the
    cut share what it takes. An empty table stays empty. Names that start with ``_tm_`` are the operator's own.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 2048 tokens.

    A null or empty text is its end id alone, a null id stays null, a long text is cut into many pieces, repeated rows are documents of their own, other
    columns are left out. An empty table gives no rows.
    """
    return packing.pack(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the nearest examples' votes nor token ids; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
