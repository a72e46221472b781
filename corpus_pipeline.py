"""Corpus pipeline: classify, drop near copies, mask secrets, mix sources, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet
into the shared folder and reads it again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold import attach
from lumenfold.llm import jaccard, mixing, packing, quality, secrets
from lumenfold.llm._scratch import written
from lumenfold.llm._skew import only
from lumenfold.llm.queries import CAPACITY, END_ID, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Scores below it are rejected.
QUALITY_CUT = 0.3
#: Near copies share 80 of 100 of their five-word shingles.
SHINGLE, SIMILAR, OF = 5, 80, 100
#: Rows without an id are named from here up.
NAMELESS = 1 << 62


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    attach(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, QUALITY_CUT, keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the component's id.

    Documents without a word are linked with nothing and stay; of rows that repeat one id one stays.
    A row without an id is judged under a hash of its text, from 2^62 up, so that one with an id
    stays before it; without a word it has no copies and stays.
    """
    attach(spark)
    judged = F.col("doc_id").isNotNull() | (mixing.n_words(F.col("text")) > 0)
    name = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))
    rows = docs.where(judged).select(*COLUMNS, name.alias("_id"))
    found = jaccard.join_components(rows.select(F.col("_id").alias("doc_id"), "text"), SHINGLE, SIMILAR, OF)
    # rows of one id are one document, in the component of those with words
    ids = found.groupBy("doc_id").agg(F.min(F.when(F.col("n_shingles") > 0, F.col("component_id"))).alias("c"), F.count(F.lit(1)).alias("n"))
    gone = written(ids.where("c <> doc_id OR n > 1").select(F.col("doc_id").alias("_id")), "gone")
    many = written(ids.where("(c IS NULL OR c = doc_id) AND n > 1").select(F.col("doc_id").alias("_id")), "many")
    once = only(rows, gone, "_id", "left_anti").select(*COLUMNS)
    # of rows that repeat an id, the least with words: an aggregate, so that no id's rows meet in one task
    row = F.struct((mixing.n_words(F.col("text")) == 0).alias("empty"), *COLUMNS)
    again = only(rows, many, "_id").groupBy("_id").agg(F.min(row).alias("row"))
    return once.unionByName(again.select("row.*").select(*COLUMNS)).unionByName(docs.where(~judged).select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked and ``n_chars`` counted anew."""
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut is shortened to its part.

    Only sizes and hashes are sorted; texts are then repeated or cut where they are. Rows that equal
    the cut in id and size share its words: equal rows are counted, and what is sorted are the
    different texts of that one id.
    """
    cuts = written(mixing.cut_points(docs, (5, 2, 1), 1.0, 3.0).withColumnRenamed("source", "s").withColumnRenamed("words", "_room"), "cuts")
    size = mixing.n_words(F.col("text"))
    rows = docs.select(*COLUMNS).join(cuts, F.col("source").eqNullSafe(F.col("s")))
    place = F.struct(mixing.mix_key().alias("key"), F.col("doc_id").alias("doc_id"), size.alias("size"))
    here = F.col("cut").isNotNull() & (mixing.mix_key() == F.col("cut.key")) & F.col("doc_id").eqNullSafe(F.col("cut.doc_id")) & (size == F.col("cut.size"))
    once_more = F.when(F.col("cut").isNotNull() & (place < F.col("cut")), 1).otherwise(0)
    plain = rows.where(size > 0).where(~F.coalesce(here, F.lit(False))).select(*COLUMNS, (F.col("epochs") + once_more).alias("whole"), F.lit(0).cast("long").alias("words"))
    ends = rows.where(here).groupBy(*COLUMNS, F.col("cut.size").alias("size"), "epochs", "_room").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(F.sha2("text", 256), "lang", "n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.floor(F.col("_room") / F.col("size")) - before  # whole rows that are left to give
    more = F.greatest(F.lit(0), F.least(F.col("n"), left))
    part = F.when((left >= 0) & (left < F.col("n")), F.col("_room") % F.col("size")).otherwise(0)
    ends = ends.select(*COLUMNS, (F.col("epochs") * F.col("n") + more).alias("whole"), part.alias("words"))
    # copies 1 to `whole` are the document, copy 0 is its part
    whole, part = F.col("whole").cast("int"), F.col("words").cast("int")
    copies = F.concat(F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.expr("array()")), F.when(part > 0, F.array(F.lit(0))).otherwise(F.expr("array()")))
    rows = plain.unionByName(ends).select(*COLUMNS, part.alias("words"), F.explode(copies).alias("copy"))
    # the words and what stands before each, up to the cut
    n = F.col("words")
    found, before = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), F.split("text", mixing.WORD, -1)
    lengths = F.zip_with(F.slice(before, F.lit(1), n), F.slice(found, F.lit(1), n), lambda g, w: F.length(g) + F.length(w))
    head = F.substring(F.col("text"), F.lit(1), F.aggregate(lengths, F.lit(0), lambda x, y: x + y))
    rows = rows.withColumn("text", F.when(F.col("copy") == 0, head).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their sequences."""
    attach(spark)
    return packing.pack(docs, tokenizer_path(), CAPACITY, END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scan", mask_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: SQL expresses neither the classifier nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
