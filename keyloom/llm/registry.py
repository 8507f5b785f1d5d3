"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, html, lattice, media, mixing, oracles, shards, simhash, substring, toxicity, warc
from keyloom.llm.common import Workspace, small_reads, spread, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), k=4, radius=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(spread(table(spark, sf_dir, "pages")))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(table(spark, sf_dir, "documents"), shards=16)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(spread(table(spark, sf_dir, "documents")))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.98)


#: The tree over documents: English apart from the other languages, then languages, then sources.
def domain():
    return F.when(F.col("lang") == "en", "english").otherwise("other")


DOMAIN_WEIGHTS = {"english": 0.6, "other": 0.4}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no text is returned, so the texts are read and their words counted once only
    counted = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.n_words(F.col("text")).alias("words"))
    with small_reads(spark):
        docs = Workspace(spark, "mixing-words").save(counted, "words")
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mixed(docs, levels, [DOMAIN_WEIGHTS, None, None], share=1.0, max_epochs=2, tokens=F.col("words"))
    return out.select("doc_id", domain().alias("domain"), "lang", "source", "n_tokens", "epochs")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(spread(table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spread(table(spark, sf_dir, "pages")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(spread(table(spark, sf_dir, "documents")), lines, public_tokenizers.PATTERN)


_ALL = (op1_simhash, op2_toxicity, op3_html, op4_shards, op5_media, op6_lattice, op7_mixing, op8_substring, op9_warc, op10_bpe)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op3_html": oracles.HTML, "op6_lattice": oracles.LATTICE, "op8_substring": oracles.SUBSTRING, "op9_warc": oracles.WARC}
