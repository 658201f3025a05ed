"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all its predecessor kept, and its result is
written and read again before the next one starts.

1. toxicity: documents scored at least tessel.llm.toxicity.THRESHOLD go.
2. line dedup: lines within two edits of an earlier line go; a document left without text goes.
3. n-gram Jaccard join: of documents linked by five-word shingles at similarity 0.8 one stays.
4. benchmark decontamination: documents with an aligned benchmark item go.
5. mixing: documents get the rate that brings their domains to the target weights (mix_domain, mix_tokens, mix_rate);
   those with rate zero go.

Every stage but the last returns the columns of its documents, further ones included; the last adds its three, in place of columns
of their names. Null and empty texts: kept by stages 1 to 4 unless the model scores the empty text as toxic; they have no
lines, no shingles and no seeds, and the prior's rate. Very long texts are handled whole. Repeated rows (equal id and text) lose
the same lines and leave one row in stage 3 if they have words. Ties: the smallest id (nulls last), then the text's digest, wins.
Null ids are kept like others. Empty tables pass through.

Near copies of whole documents lose the lines they share with the first copy in stage 2 already; stage 3 then sees what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontaminate, jaccard, lines, mixing, toxicity
from tessel.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(docs, Scratch(spark))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, Scratch(spark))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.kept(docs, table(spark, sf_dir, "labels"), Scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing to target weights", mix_to_targets),
]

#: No stage's rows can be written in SQL (trained models, alignment, iterative components); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs
