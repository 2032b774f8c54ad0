r"""Mixing sources to target weights by repetition.

Words are summed per source; a source's target is its weight's share of the mix, at most `most` times its own
size, what is above being shared again by weight; its rate is target over size. A document is emitted
floor(rate) times, and once more if a hash of (seed, doc_id) as a uniform number is below the rate's fraction.
The seed of each source is the one of `seeds` whose draw comes closest to the source's target, so that small
sources meet their targets too; reruns give the same mix.

Edge cases: a null text has size 0; a null source is the last source; a source without words has target 0 and
its documents are left out; rows of one doc_id fare alike, and those of a null doc_id; a very long text is one draw of
its size, so a source of few such texts may miss its target by one of them; an empty table gives an empty result;
other columns are kept by `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._shared import checked_broadcast, free_name, partitions, written

SEEDS = 32


def words(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _uniform(seed):
    return F.shiftrightunsigned(F.xxhash64(F.col("_doc"), seed), 11) * F.lit(2.0**-53)


def _numbered(df: DataFrame, *order) -> DataFrame:
    """df with its place `_i`, from 0, in the given order: by ranges, without one task for all."""
    spark = df.sparkSession
    df = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    df = written(df.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("_r")), "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = df.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return df.join(checked_broadcast(base), "_p").withColumn("_i", F.col("_base") + F.col("_r")).drop("_p", "_r", "_base")


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target. Weights repeat over sources by code point, null last."""
    t = _numbered(sizes, F.col("source").asc_nulls_last())
    w = F.create_map(*[F.lit(x) for i, x in enumerate(weights) for x in (i, float(x))])[F.pmod("_i", F.lit(len(weights))).cast("int")]
    t = written(t.select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("most")), "sources")
    total = t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    # level: what one unit of weight gets; sources whose limit lies below keep their limit
    level, capped = 0.0, -1
    while True:
        under = F.col("most") < level * F.col("w")
        r = t.agg(F.count_if(under).alias("n"), F.coalesce(F.sum(F.when(under, F.col("most"))), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.when(~under, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if r.n == capped or not r.w:
            break
        level, capped = (total - r.most) / r.w, r.n
    return t.select("source", "source_size", F.least(F.col("most"), level * F.col("w")).alias("target"))


def rates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **how) -> tuple[DataFrame, DataFrame]:
    """sizes (_doc, source, size per row of docs) and source, source_size, target, times, fraction, seed per source."""
    sizes = written(docs.select(F.col(id_column).alias("_doc"), F.col(source_column).alias("source"), words(text_column).alias("size")), "sizes")
    t = written(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    t = t.select("*", F.floor(rate).alias("times"), (rate - F.floor(rate)).alias("fraction"))
    drawn = _with_source(sizes, t)
    drawn = drawn.groupBy("source").agg(*(F.sum(F.when(_uniform(F.lit(k)) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"d{k}") for k in range(SEEDS)))
    drawn = drawn.withColumnRenamed("source", "_source")
    missed = F.array_min(F.array(*(F.struct(F.abs(F.col("target") - F.col("times") * F.col("source_size") - F.col(f"d{k}")).alias("by"), F.lit(k).alias("seed")) for k in range(SEEDS))))
    best = t.join(drawn, F.col("source").eqNullSafe(F.col("_source"))).select(*t.columns, missed["seed"].alias("seed"))
    return sizes, written(best, "rates")


def _with_source(rows: DataFrame, t: DataFrame) -> DataFrame:
    t = t.withColumnRenamed("source", "_source")
    return rows.join(checked_broadcast(t), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def copies():
    return (F.col("times") + F.when(_uniform(F.col("seed")) < F.col("fraction"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **how) -> DataFrame:
    """docs, each row as often as the mix takes it; the same columns."""
    _, t = rates(docs, id_column, text_column, source_column, **how)
    m, copy = free_name(docs, "_mix"), free_name(docs, "_copy")
    t = t.select(F.struct("source", "times", "fraction", "seed").alias(m))
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.col(f"{m}.seed")), 11) * F.lit(2.0**-53)
    n = (F.col(f"{m}.times") + F.when(u < F.col(f"{m}.fraction"), 1).otherwise(0)).cast("int")
    out = docs.join(checked_broadcast(t), F.col(source_column).eqNullSafe(F.col(f"{m}.source")))
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, t = rates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _with_source(sizes, t).select(F.col("_doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))
