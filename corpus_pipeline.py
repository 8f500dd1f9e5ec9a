"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.llm import bpe, langid, mixing, nearjoin, secrets
from crawlsight.llm.common import cut_lineage


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those without a letter, and those in no learned language by its calibrated floor (``langid.REJECT``).

    Where nothing has a language to learn from, only those without a letter go.
    Null and empty texts have no letter; repeated rows are judged alike; an empty
    table stays empty; texts are read whole; other columns stay.
    """
    model = langid.fit(docs)
    if model is None:
        return langid.lettered(docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # its columns may have any names
    return langid.predict(docs.select(whole, "text"), model).filter(~F.col("rejected")).select("row.*")


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest id.

    Null and empty texts are linked to nothing and stay; of rows alike in id and
    text one stays; of ties in id the text with the smallest digest; an empty
    table stays empty; texts are compared whole; other columns stay.
    """
    return nearjoin.deduplicate(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the lengths follow.

    No row goes. Null texts stay null, with a null length; texts without a secret
    stay as they are; repeated rows are masked alike; an empty table stays empty;
    texts are searched whole; other columns stay.
    """
    masked = secrets.redact(docs, model=secrets.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken twice, once or not at all, by their sources' targets.

    Texts without a word, null ones too, take no words and aren't taken; a null
    source is one of its own; of rows alike, as many are taken as the plan says;
    an empty table stays empty; other columns stay.
    """
    return mixing.apply(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows: ids of each text, and a digest of what they decode to.

    A null or empty text has no ids and the digest of nothing; texts are encoded
    whole; repeated rows give repeated rows; an empty table gives none; columns
    but ``doc_id``, ``source`` and ``text`` go.
    """
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), decoded="decoded").drop("text")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", identify),
    ("n-gram Jaccard join", join_near),
    ("secret scan", hide_secrets),
    ("source mixing", mix),
    ("BPE encoding", tokenize),
]

#: Learning, compression and BPE can't be put in SQL; a test compares the whole run with a plain one on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
