r"""Exact duplicates by content-defined chunk recipes, in DataFrame functions alone.

Texts are equal if they are identical once each run of ASCII white space is one blank. Such a text is cut where its
content says so (after a sentence's end, at least LEAST and at most MOST code points apart), so that copies are cut alike and a
chunk is small however long its document is. A chunk's identifier is a 64-bit hash that was verified: all distinct chunks meet
by hash and content, and where one hash stands for several contents, these are numbered. A document's recipe is the ordered
list of its chunks' identifiers, and two texts are equal just if their recipes are.

Contents are moved once, as distinct chunks after a partial aggregation; documents are compared and joined as lists of
numbers, about a hundredth of their text.

Edge cases: a null text counts as an empty one, whose recipe has no chunk; a text without a sentence's end is cut
every MOST code points; of equal texts all rows with the smallest doc_id are kept, rows that repeat it among them; a null
doc_id ranks last, and a group without any doc_id is kept whole, with a null keep_id; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._shared import checked_broadcast, table, written

LEAST, MOST = 512, 4096
#: Up to the first sentence's end in reach; where there is none, as much as a chunk may hold.
_CHUNK = r"(?s).{%d,%d}?(?<=[.!?] )|.{1,%d}"
#: Runs of white space that are not one blank already.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text in pieces, in order; nothing is lost or added."""
    return F.regexp_extract_all(text, F.lit(_CHUNK % (least, most, most)), F.lit(0))


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashed: Callable[[Column], Column] = F.xxhash64, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, text_sha256, recipe (verified identifiers as array<struct<h, k>>, k > 0 only where contents share a hash) for each row of docs."""
    texts = docs.select(F.col(id_column).alias("doc_id"), normalized(F.col(text_column)).alias("text"))
    cut = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text"), least, most).alias("chunks"))
    hashes = written(cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: hashed(c)).alias("hashes")), "recipes")
    each = texts.select(F.explode(chunks(F.col("text"), least, most)).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk")
    shared = each.groupBy("h", "chunk").count().groupBy("h").count().where("count > 1").select("h")
    shared = written(shared, "shared-hashes")
    plain = F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("k")))
    if shared.isEmpty():
        return hashes.select("doc_id", "text_sha256", plain.alias("recipe"))
    # contents that share a hash are numbered, and the recipes that name such a hash are made from the contents
    held = checked_broadcast(shared)
    contents = each.join(held, "h", "left_semi").distinct()
    contents = written(contents.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1), "numbered-chunks")
    placed = cut.withColumn("row", F.monotonically_increasing_id())  # before the chunks become rows
    placed = placed.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("at", "chunk")).withColumn("h", hashed(F.col("chunk")))
    placed = placed.join(contents, ["h", "chunk"], "left")
    listed = placed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "h", F.coalesce("k", F.lit(0)).alias("k"))))).alias("listed"))
    return written(listed.select("doc_id", "text_sha256", F.transform("listed", lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"))).alias("recipe")), "numbered-recipes")


def duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    rows = recipes(docs, id_column, text_column, **how)
    # copies only, and written: the join below has no aggregation in its stage, so a recipe of many copies can be split there
    groups = written(rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "copies")
    size = groups.agg(F.count("*") + F.coalesce(F.sum(F.size("recipe")), F.lit(0))).first()[0]  # a recipe counts with its length
    out = rows.join(checked_broadcast(groups, size), "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""
