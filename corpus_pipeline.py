"""A corpus pipeline of five stages: toxic documents go, one of each group of near copies stays, personal data is
masked, sources are mixed to target weights, and what is left is tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results, for every stage: an empty table gives no row; extra columns are carried along with their values, whatever
they are named; texts are worked on whole; rows are told apart by nothing but what is said here.

* toxicity: a null or empty text is scored as one without hits; rows that repeat an id or a text are judged alike.
* ngram_join: of documents that tie in a group the least id stays; of rows that repeat an id one stays, the least by text and
  then by all columns; rows without an id stay.
* pii: a null text stays null; of spans that start together the one whose kind is listed first is masked.
* mixing: a null source is a source; rows that repeat an id are drawn alike; a null id is drawn as the text `null`.
* bpe: a null text has no ids and decodes to the empty text; the result has the columns that tokenize() lists.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, mixing, ngram_join, pii, toxicity
from attestra.llm.common import Workspace, aside, read_table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    own, back = aside(docs, "score", "predicted")
    return back(toxicity.score(own, model).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of the similarity join; rows without an id stay."""
    placed = ngram_join.join_components(docs)
    copies = placed.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    again = placed.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # One row an id, told by its values alone, so that a task that runs again picks the same.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    picked = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("r"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(picked.select("r.*"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span replaced by its kind, and n_chars brought up to date."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn for their source, in the order of the global shuffle."""
    own, back = aside(docs, "copy", "rate", "mix_key", "_source", "_first", "_below", "_u", "_count", "_block")
    return back(mixing.shuffled(mixing.replicate(own)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number, and the text that they decode to."""
    decoded = bpe.encode(docs.select("doc_id", "source", "text"), RANK_FILE, public_tokenizers.PATTERN, decoded="decoded", keep=["doc_id", "source"])
    return decoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The fitted toxicity scores and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space = read_table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, space.written(stage(spark, docs, sf_dir), name)
        space.dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
