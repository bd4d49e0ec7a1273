"""From raw documents to token ids: five stages, each over all rows its predecessor kept.

1. ``language``: rows whose text has no letter, or in which no language is clear (the best
   has under 35 per cent), go; texts in two languages stay.
2. ``near_dedup``: one row of each class of near copies stays (five words, Jaccard 0.8).
3. ``decontaminate``: rows that hold a benchmark item, whole or edited, go.
4. ``secrets``: rows stay; what is found in their texts is replaced by a mark, and
   ``n_chars`` follows.
5. ``bpe``: rows become token ids; the digest of what they decode to comes along.

A stage takes (spark, docs, sf_dir) and returns the columns of its input, the last its own.
Null ids, texts, languages and sources pass through every stage; a null text is dropped by
the first.  An empty table stays empty.  Rows that repeat are near copies of each other and
leave one; of ties the smallest doc_id stays.  Texts of any length are read whole.  Columns
called like a result of an operator keep their values; the last stage returns its own columns
only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, decontaminate, language, near_dedup, secrets
from vellum.llm.queries import tokenizer_path
from vellum.llm.staging import remove, stage, watched

#: Part of a text that its best language needs.
LEAST_CLEAR = 0.35

Step = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What stages have left: the folders of each, when it returned, and the files that it read.
_left: list[tuple[list[str], float, set[str]]] = []


def _written(spark: SparkSession, docs: DataFrame) -> tuple[set[str], float]:
    """The files that ``docs`` reads, and when the first of them was written."""
    files = docs.inputFiles()
    times = []
    for file in files[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.replace("%20", " "))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            times.append(fs.getFileStatus(path).getModificationTime() / 1000)
    return set(files), min(times, default=0.0)


def alone(step: Step) -> Step:
    """``step``, which first deletes what an earlier stage has staged, if its own input was written since.

    The result of a stage is read once it is written, and its successor reads that table, which is
    younger than the stage.  A call on a table that is older, or that the earlier stage has read itself, is no
    successor and deletes nothing.
    """

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read, since = _written(spark, docs) if _left else (set(), 0.0)
        done = [x for x in _left if since > x[1] and not x[2] & read and not any(path.rpartition("/")[2] in file for path in x[0] for file in read)]
        for x in done:
            remove(spark, x[0])
            _left.remove(x)
        with watched() as made:
            out = step(spark, docs, sf_dir)
        _left.append((made, time.time(), set(docs.inputFiles())))
        return out

    return run


@alone
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is clear."""
    columns = docs.columns
    model = language.fit(docs)
    # an input column called like a result of the operator is set aside meanwhile
    aside = {c: f"__in_{c}" for c in columns if c.lower() in ("lang_pred", "score", "shares")}
    found = language.predict(docs.withColumnsRenamed(aside), model)
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CLEAR)).drop("lang_pred", "score", "shares")
    return kept.withColumnsRenamed({v: k for k, v in aside.items()}).select(columns)


@alone
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


@alone
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@alone
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced."""
    out = secrets.hide(docs, changed="__changed")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


@alone
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the decoded text."""
    both = bpe.recode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    digest = F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", digest)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", hide_secrets),
    ("bpe", encode),
]

#: SQL can't express the language model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, step in STAGES[:-1]:
        result = step(spark, docs, sf_dir)
        with watched() as made:
            docs = stage(result, f"pipeline-{name}")
        remove(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
