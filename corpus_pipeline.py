"""From documents to packed training sequences, in five stages.

1. ``quality_rules``: documents that fail the base test or a certified rule go.
2. ``line_dedup``: of similar lines one stays in the corpus; a document left without any line goes.
3. ``near_duplicates``: of each class of near-duplicate documents one stays. Documents are linked by fingerprints of
   three-word shingles that differ in at most three bits, or by five-word shingles of which they share four fifths.
4. ``mixing``: documents are repeated by Poisson counts, so that sources approach their target weights.
5. ``packing``: documents become sequences of 2048 tokens.

Each stage takes the documents that the one before it kept. All but the last return the columns of
``documents`` and any others of the input, whatever their names; ``n_chars`` follows the text.

Cases: null, empty and blank texts fail the base test of the first stage; a stage that gets them all the same keeps
them (line_dedup), takes them for copies of each other (near_duplicates), repeats them like others (mixing), or packs
their end id (packing). Null ids and repeated rows are documents of their own until near_duplicates, which keeps
one of equal texts, the least id, null last. Null languages and sources are a stratum and a source. Very long texts are handled whole, within a
row. Ties are broken by ids and hashes, so results do not depend on partitions. Empty tables give empty results.

A stage stages tables for itself, which its result reads. ``run`` removes them when the result of the stage has been
written. Of stages that are called one by one, those of a stage go when the next stage is called with documents from files written
since, provided no other result of the same stage may still be waiting for them; else they stay.
"""

from __future__ import annotations

import time
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import line_dedup, packing, poisson_mix, quality_rules, simhash
from cartwise.session import remove, scratch, stage

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_EXTRA = "_columns_beside"
_waiting: dict[tuple[str, str], list[tuple[str, float]]] = defaultdict(list)  # application and stage -> folders, and when they were made


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    measured = stage(quality_rules.measure(docs), "measured")
    cutoffs = quality_rules.calibrate(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(measured, cutoffs).filter("kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs).filter("n_dropped = 0 or n_dropped < n_lines")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, near_copies=True).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(docs, poisson_mix.tempered_targets(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


_STEPS = [
    ("quality_rules", filter_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def _keeping_columns(step, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``step`` on the columns of documents; others are carried in one struct, out of the way of the step's own names."""
    extra = [c for c in docs.columns if c not in _COLUMNS]
    if not extra or step is pack_sequences:
        return step(spark, docs.select(*[c for c in docs.columns if c in _COLUMNS]), sf_dir)
    own = [c for c in docs.columns if c in _COLUMNS]
    out = step(spark, docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in extra]).alias(_EXTRA)), sf_dir)
    return out.select(*[F.col(_EXTRA).getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns])


def _newer(spark: SparkSession, docs: DataFrame, since: float) -> bool:
    """Whether ``docs`` are read from files that were all written later."""
    files = docs.inputFiles()
    if not files:
        return False
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in (min(files), max(files))]
    return all(p.getFileSystem(conf).getFileStatus(p).getModificationTime() >= since * 1000 for p in paths)


def _stage(at: int):
    name, step = _STEPS[at]

    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        before = _waiting[app, _STEPS[at - 1][0]] if at else []
        if len(before) == 1 and _newer(spark, docs, before[0][1]):
            remove(spark, before.pop()[0])
        with scratch(spark, name) as folder:
            out = _keeping_columns(step, spark, docs, sf_dir)
        _waiting[app, name].append((folder, time.time()))
        return out

    return called


STAGES = [(name, _stage(at)) for at, (name, _) in enumerate(_STEPS)]

#: Similar lines, fingerprints and token ids are beyond SQL; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of ``documents``; each stage's result is a table before the next reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in _STEPS[:-1]:
        with scratch(spark, f"{name}-result") as result:
            with scratch(spark, name) as folder:
                out = _keeping_columns(step, spark, docs, sf_dir)
            docs = stage(out, name)
        remove(spark, folder)
        if before:
            remove(spark, before)
        before = result
    packed = _keeping_columns(_STEPS[-1][1], spark, docs, sf_dir)  # its pieces are a table by now
    remove(spark, before)
    return packed
