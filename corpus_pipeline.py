"""A corpus pipeline of five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm import jaccard_trie, langid, mixing, packing, suffix_dedup
from gazeloom.llm.shared import Scratch

#: Language identification keeps what it is this sure of.
SURE = 0.5


def neutral(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """docs with all but the used columns under names that no operator gives, and the columns that give their names back."""
    names = {c: c if c in used else f"kept_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those whose language is in doubt; lang becomes the language found."""
    plain, back = neutral(docs, "doc_id", "text", "lang")
    found = langid.identify(spark, plain).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE))
    return found.withColumn("lang", F.col("lang_pred")).select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the least doc_id stays.

    Texts without words are linked with nothing. Of rows equal in doc_id and text, one stays; a null doc_id goes only if a linked one isn't null.
    """
    plain, back = neutral(docs, "doc_id", "text")
    groups = jaccard_trie.similar(spark, plain.select("doc_id", "text"), 5, 80, 100)
    # a row is named by doc_id and text; of rows equal in both, one stays. One exchange serves the join and the duplicates
    named = lambda df: df.withColumn("doc_key", F.coalesce("doc_id", F.lit(-1)))
    gone = groups.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = named(plain).withColumn("text_hash", F.xxhash64("text"))
    stays = rows.join(named(gone).select("doc_key", "text_hash").distinct().hint("merge"), ["doc_key", "text_hash"], "left_anti")
    return stays.dropDuplicates(["doc_key", "text_hash"]).select(*back)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 200 bytes or more that come again; documents of which nothing is left go. Texts that lose nothing stay as they are, null and empty ones too."""
    plain, back = neutral(docs, "doc_id", "text", "n_chars")
    cut = suffix_dedup.deduplicated(spark, plain, 200)
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.where((F.col("n_removed") == 0) | (F.trim("text") != "")).select(*back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix takes them: a row for each time taken, rounded to whole texts; those not taken go, and so do those without words."""
    # the mix carries the other columns along, so no join by doc_id is needed
    others = [c for c in docs.columns if c != "doc_id"]
    kept = [f"kept_{k}" for k in range(len(others))]
    carried = docs.select("doc_id", "text", "source", *(F.col(f"`{c}`").alias(n) for c, n in zip(others, kept)))
    taken, _ = mixing.mix(spark, carried, keep=tuple(kept))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    repeated = taken.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    columns = {c: F.col(n).alias(c) for c, n in zip(others, kept)}
    return repeated.select(*(columns.get(c, F.col(c)) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows into sequences of 2048 ids; null and empty texts are the end id alone."""
    return packing.pack(spark, docs.select("doc_id", "text"), 2048)


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packed)]
#: Learned language models, hash tries and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        docs = scratch.save(result, f"{k}-{name}")
    return docs
