"""From raw documents to packed training sequences: quality, exact and near duplicates, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of documents, and further ones that ``docs`` has,
whatever their names: columns are handled by place, doc_id, text and source found by name. Decisions are about
rows, told apart by doc_id and text together; rows that repeat both are one document, of which exact_dedup leaves
one row. Null doc_ids are ids of their own each, null texts count as empty, a null source is a source. Texts
are whole, however long. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxsearch.llm.common import by_place, join_unique, key_filter, materialize, may_pass
from proxsearch.llm.exact_dedup import exact_dedup
from proxsearch.llm.minhash import near_dedup
from proxsearch.llm.mixing import mixed_documents
from proxsearch.llm.packing import pack
from proxsearch.llm.quality import good_documents
from proxsearch.llm.queries import tokenizer_path


def _named(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``docs`` by place, with did (doc_id as text, empty for null) and k, a hash of it; where columns are; all places."""
    placed, at = by_place(docs, doc_id="doc_id", text="text")
    named = placed.withColumn("did", F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")))
    return named.withColumn("k", F.xxhash64("did")), at, placed.columns


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; none does where there are no labels to learn from.

    A null text counts as empty; rows that repeat, and ties, are judged alike. An empty table stays empty; long texts
    are judged whole; other columns stay, whatever their names.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null one only if there is no other.

    A null text equals an empty one. Of several rows with that doc_id and text, one stays. Rows that share a doc_id
    with a row that goes, but not its text, stay. Only rows whose doc_id is that of a row that goes are moved. An
    empty table stays empty; long texts are compared whole; other columns stay, whatever their names.
    """
    judged = exact_dedup(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), F.col("text_sha256").alias("sha"), "kept")
    told = judged.groupBy("did", "sha").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    told = materialize(told.where("NOT kept OR n > 1").withColumn("k", F.xxhash64("did")))
    total = told.agg(F.sum("n")).first()[0] or 0
    named, at, places = _named(docs)
    filt = key_filter(told, "k")
    near = may_pass(named, filt, "k").withColumn("sha", F.sha2(F.coalesce(F.col(at["text"]), F.lit("")), 256))
    joined = join_unique(near.select("did", "sha", *places), told.drop("k"), ["did", "sha"], "n", total, "left")
    once = joined.where("kept").groupBy("did", "sha").agg(F.first(F.struct(*places)).alias("row")).select("row.*")
    out = may_pass(named, filt, "k", False).select(*places).unionByName(joined.where("n IS NULL").select(*places)).unionByName(once)
    return out.toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by sets of 3-word shingles, the one with the smallest doc_id stays.

    Rows with a null doc_id have no copies, as in near_dedup, and stay; so do texts without words. Ties (rows that
    share a doc_id) are settled by a hash of the text. Where ids are unique only rows that may go are moved; where they
    repeat, rows are numbered first and written beside their numbers. An empty table stays empty; long texts are compared whole; other
    columns stay, whatever their names.
    """
    named, at, places = _named(docs)
    repeated = named.groupBy("did").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND did != ''")
    if not repeated.limit(1).count():
        gone = materialize(near_dedup(docs, percent=85, n_words=3).where("NOT kept").select(F.col("doc_id").cast("string").alias("did")).withColumn("k", F.xxhash64("did")))
        filt = key_filter(gone, "k")
        left = may_pass(named, filt, "k").join(gone.select("did"), "did", "left_anti")
        return may_pass(named, filt, "k", False).select(*places).unionByName(left.select(*places)).toDF(*docs.columns)
    rows = materialize(named.select(F.monotonically_increasing_id().alias("r"), *places))
    doc_id = F.col(at["doc_id"]).cast("long")
    found = near_dedup(rows.where(doc_id.isNotNull()), percent=85, n_words=3, id_col="r", text_col=at["text"]).select(F.col("doc_id").alias("r"), "component_id")
    order = F.struct(doc_id, F.xxhash64(at["text"]), "r").alias("order")
    first = rows.select("r", order).join(found, "r").groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.r").alias("r"))
    kept = rows.join(materialize(first), "r", "left_semi").unionByName(rows.where(doc_id.isNull()))
    return kept.select(*places).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Rows without any word (null and empty texts among them) go, having nothing to give. Rows that repeat are documents of
    their own. An empty table stays empty; long texts count whole; other columns stay, whatever their names.
    """
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids; a document that the mix repeats is packed each time.

    A null text is the end id alone; null doc_ids are kept. Long texts are cut, nothing is lost. An empty table gives no
    pieces. Other columns are ignored, whatever their names.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: SQL can't fit the classifier, so there is none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        out = materialize(stage(spark, out, sf_dir))
    return STAGES[-1][1](spark, out, sf_dir)
