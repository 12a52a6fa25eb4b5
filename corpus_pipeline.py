"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import curriculum_mix, decontaminate, jaccard_join, language_id, minimax_shards
from tessera.llm.storage import materialize, remove, work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16
#: Share of a document's words that its main language holds at least.
MAIN_SHARE = 0.5


def row_key() -> Column:
    """64-bit hash of a whole row; rows that share it are equal in all columns."""
    return F.xxhash64(*[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]).alias("_t_row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the language found into ``lang`` and drops documents without one: null
    texts, texts without a letter, and texts of which no language holds ``MAIN_SHARE``
    of the words.  If there are no labelled rows to learn a language from, ``lang``
    stays and texts with a letter stay.  Repeated rows and null ids are judged row by
    row; an empty table gives an empty one, and further columns go."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    if not model.languages:
        return docs.select(*COLUMNS).filter(F.col("text").cast("string").rlike(r"\p{L}"))
    judged = language_id.identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_SHARE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row stays, that of the smallest id (null
    ids come last).  Rows are told apart by content, so that ids may be null or
    repeated; of rows that are equal in all columns one stays.  Texts without words
    link with nothing, and all their rows stay.  An empty table gives an empty one."""
    keyed = docs.select(*COLUMNS, row_key())
    classes = jaccard_join.jaccard_classes(keyed.select(F.col("_t_row").alias("doc_id"), "text")).filter("n_shingles > 0")
    members = materialize(classes.groupBy(F.col("doc_id").alias("_t_row")).agg(F.first("component_id").alias("_t_class"), F.count("*").alias("_t_rows")), "members")
    ids = keyed.select("_t_row", "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_t_row")
    found = members.join(ids, "_t_row").groupBy("_t_class").agg(F.min_by("_t_row", rank).alias("_t_least"), F.sum("_t_rows").alias("_t_size"))
    # Written first, so that the join below is one of two tables and a large class can be split.
    least = materialize(found.filter("_t_size > 1"), "least")
    flags = members.join(least, "_t_class").select("_t_row", (F.col("_t_row") == F.col("_t_least")).alias("_t_stays"), "_t_rows")
    joined = keyed.join(flags.filter("not _t_stays or _t_rows > 1"), "_t_row", "left").filter("_t_stays is null or _t_stays")
    once = joined.filter("_t_stays").dropDuplicates(["_t_row"])
    return joined.filter("_t_stays is null").unionByName(once).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item.  Null and empty texts hold none, rows are
    judged one by one, and an empty benchmark drops nothing."""
    found = decontaminate.find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.filter(F.size("matches") == 0).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the mix does not take, repeats those it takes again, and
    sorts by training position, so that the written files hold the curriculum.  A
    document that is taken in part is kept whole.  Rows are told apart by content: ids
    may be null or repeated.  Texts without words are not taken; ties of position go
    by content.  An empty table gives an empty one."""
    keyed = docs.select(*COLUMNS, row_key())
    readings = curriculum_mix.readings(curriculum_mix.mix_sources(keyed, keep=["_t_row"])).select("_t_row", "position")
    rows = keyed.dropDuplicates(["_t_row"])  # equal rows: one stands for the readings of all
    return rows.join(readings, "_t_row").orderBy("position", "_t_row").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns every document to a shard and a slot; see ``shard_documents`` for odd rows."""
    return minimax_shards.shard_documents(docs, SHARDS, keep=COLUMNS)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix_to_targets", mix_to_targets),
    ("shard", shard),
]

#: No stage but the mix can be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; tables between stages are written to the
    shared folder, and each goes when the next is written (the last with the application)."""
    base = work_folder(spark, f"corpus-{uuid.uuid4().hex}")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{base}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
