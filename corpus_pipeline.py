"""From raw documents to tokens: toxicity, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet on
the shared folder and reads it again for the next stage.  All but the last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives an empty table; null texts count as empty; other columns than those
of ``documents`` are left out; rows of one doc_id are one document and go or stay together; rows without a doc_id are
never dropped as toxic or as a copy; very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, mixing, registry, simhash, substring, toxicity
from keyloom.llm.common import Workspace, spread, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: five-word shingles.  Three fingerprints of 64 bits; two of them are searched within 9 bits, and
#: all 192 bits must agree within 32.  For shingle sets of similarity 0.8 a bit differs with probability
#: acos(0.8 * 2 / 1.8) / pi = 0.151, in 29 of 192 on average; 3 more, as the estimate scatters.  These pairs
#: and those of min-hash bands are candidates; a link needs SIMILARITY of the whole shingle sets.
SHINGLE, RADIUS, BLOCKS, CHECKS, CHECK_BITS, SEARCHED = 5, 9, 5, 2, 32, 2
SIMILARITY = 0.8
#: Share of all tokens that the mix takes; nothing is taken twice.
MIX_SHARE = 0.9


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids``; rows without doc_id stay."""
    return docs.join(ids, "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold.  Empty texts are scored like others; without labels of both
    kinds nothing is dropped."""
    ws = Workspace(spark, "stage-toxicity")
    scores = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return _keep(docs, ws.save(scores.where("predicted = 1").select("doc_id").distinct(), "rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates.  Empty texts are one group; a row repeated in all
    its columns stays once."""
    ws = Workspace(spark, "stage-simhash")
    twice = ws.save(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if not twice.isEmpty():
        again = docs.join(twice, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates()
        docs = ws.save(_keep(docs, twice).unionByName(again), "documents")
    found = simhash.near_duplicates(docs, SHINGLE, RADIUS, BLOCKS, CHECKS, CHECK_BITS, SEARCHED, least=SIMILARITY)
    return _keep(docs, ws.save(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words and more that stand earlier; untouched where there are none.  A document whose
    text goes altogether stays with an empty text; a null text becomes an empty one."""
    out = substring.deduplicated(docs, keep=["lang", "source", "n_chars"])
    changed = F.col("kept_text").isNotNull()
    return out.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source",
                      F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of the tokens, dealt to domains, languages and sources by weight; each document at most once.  Null languages
    and sources are groups of their own; texts without words come along with the prefix of their source."""
    levels = {"domain": registry.domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mixed(docs, levels, [registry.DOMAIN_WEIGHTS, None, None], share=MIX_SHARE, max_epochs=1).where("epochs > 0").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the token ids, and whether they decode to the text.  Empty texts have no ids."""
    lines = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.token_rows(docs, lines, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("mixing", mix_sources),
    ("byte-level bpe", tokenize),
]
#: No stage but the last could be put in SQL of acceptable cost; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spread(table(spark, sf_dir, "documents").select(*COLUMNS))
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
