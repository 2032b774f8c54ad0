r"""Merkle manifest of a dataset, stored sparsely: only every few levels are written, the rest is recomputed.

A document's leaf is the SHA-256 of its fields, each as octet count, ':' and value, '-' for null. Leaves of one
source, in order of doc_id, make a tree in which every `ARITY` consecutive nodes become one; what remains at the
top is the source's subroot, and the subroots, in order of source, make one more tree of the same shape with the
root on top. Digests are lowercase hex text.

Of each tree the levels 0, STRIDE, 2 STRIDE, ... are written. An aligned subtree is a stored node with the
ARITY^STRIDE stored nodes below it at most, so it is one small group: its missing interior levels are recomputed
from the nodes below, what they give to proofs is emitted, and they are gone again. A proof is a chain of (left, right):
the digests beside the path in each run, from leaf to root.

Only digests are shuffled, never texts: a row of some 100 octets per document. A source of any size is many groups.

Edge cases: null fields are part of a leaf; a null source is the first tree; null doc_ids come first in their source,
rows of one doc_id in order of their leaf, so repeated rows have a place each and equal results up to their proofs; a
source of one document has its leaf as subroot; an only source's subroot is the root; an empty table has no root and
gives an empty result; very long texts are hashed where they are read; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._shared import ascii_lower, checked_broadcast, partitions, table, work_path, written
from stormshift.llm._sql import crc32_table, crc32_text

ARITY, STRIDE = 16, 2
DIGEST = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CHAIN = "array<struct<left: string, right: string>>"


def leaf(*fields: Column) -> Column:
    each = (f.cast("string") for f in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in each)), 256)


def fold(start: Column, chain: Column) -> Column:
    """The root that a leaf and its chain give."""
    return F.aggregate(chain, start, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def siblings(chain: Column) -> Column:
    """All digests of a chain, from leaf to root and from left to right."""
    return F.array_join(F.transform(chain, lambda x: F.concat(x["left"], x["right"])), "")


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows(tree, ...) with n, the rows of their tree, and i, their place in it from 0; no task holds more than a range."""
    n = partitions(rows.sparkSession)
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # repeated rows can be dealt to several ranges, too
    rows = rows.repartitionByRange(n, "tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie")
    rows = written(rows.withColumns({"_p": F.spark_partition_id(), "_r": F.monotonically_increasing_id().bitwiseAND(2**33 - 1)}), "merkle-ranges")
    runs = rows.groupBy("tree", "_p").agg(F.count("*").alias("_n"), F.min("_r").alias("_first"))
    w = Window.partitionBy("tree")  # a row for each range that the tree lies in
    before = F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("tree", "_p", (before - F.col("_first")).alias("_from"), F.sum("_n").over(w).alias("n")), "merkle-runs")
    return rows.join(checked_broadcast(runs), ["tree", "_p"]).withColumn("i", F.col("_from") + F.col("_r")).drop("_p", "_r", "_from")


@dataclass(frozen=True)
class Tree:
    """Trees of nodes(tree, n, i, digest, ...): the stored levels from the leaves up, and tops(tree, n, digest)."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int
    stride: int

    @property
    def block(self) -> int:
        return self.arity**self.stride

    def interior(self, own: str = "own") -> dict[str, Column]:
        """own1, own2, ...: the unstored levels of a group's subtree, each the joined digests of its nodes, from `own`."""
        out, run = {}, self.arity * DIGEST
        for k in range(1, self.stride):
            below = F.col(own if k == 1 else f"{own}{k - 1}")
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(below) - 1) / run).cast("int"))
            out[f"{own}{k}"] = F.array_join(F.transform(starts, lambda g: F.sha2(F.substring(below, g * run + 1, F.lit(run)), 256)), "")
        return out

    def reaches(self, k: int) -> Column:
        """Whether a tree of n nodes has a run at the k-th level of a subtree."""
        return F.col("n") > self.arity**k


def _grouped(t: Tree, nodes: DataFrame, *more: str) -> DataFrame:
    """Aligned subtrees: tree, block, n, members in order, own and its interior levels."""
    m = F.array_sort(F.collect_list(F.struct("i", "digest", *more)))
    g = nodes.groupBy("tree", F.expr(f"i div {t.block}").alias("block")).agg(F.max("n").alias("n"), m.alias("m"))
    g = g.withColumn("own", F.array_join(F.col("m.digest"), ""))
    for name, column in t.interior().items():
        g = g.withColumn(name, column)
    return g


def build(leaves: DataFrame, order: tuple[str, ...], path: str, arity: int = ARITY, stride: int = STRIDE) -> Tree:
    """leaves(tree, digest, ...) in order of `order` -> their trees, stored under path."""
    spark = leaves.sparkSession

    def stored(df: DataFrame, level: int) -> DataFrame:
        df.write.parquet(f"{path}/level={level}")
        return spark.read.schema(df.schema).parquet(f"{path}/level={level}")

    t = Tree([stored(_ranked(leaves, *order), 0)], leaves, arity, stride)
    nodes, tops = t.levels[0].select("tree", F.col("n").alias("all"), "n", "i", "digest"), []
    while True:
        tops.append(nodes.where("n = 1").select("tree", "all", "digest"))
        rest = nodes.where("n > 1")
        if rest.isEmpty():
            break
        top = F.sha2(F.col("own"), 256)
        for k in range(1, stride):
            top = F.when(t.reaches(k), F.sha2(F.col(f"own{k}"), 256)).otherwise(top)
        sizes = F.expr(f"(n + {t.block - 1}) div {t.block}")
        g = _grouped(t, rest, "all").select("tree", F.col("m.all")[0].alias("all"), sizes.alias("n"), F.col("block").alias("i"), top.alias("digest"))
        nodes = stored(g, len(t.levels) * stride)
        t.levels.append(nodes)
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    found = found.withColumnRenamed("all", "n")
    found.write.parquet(f"{path}/tops")
    return Tree(t.levels, spark.read.schema(found.schema).parquet(f"{path}/tops"), arity, stride)


def proofs(t: Tree, above: DataFrame, *payload: str, wanted: str | None = None) -> DataFrame:
    """tree, i, digest, payload, the columns of above, and chain for each leaf, or for those that `wanted` (SQL) names.

    above(tree, chain, ...): how a tree's top goes on. Stored levels are walked from the top; each subtree is recomputed,
    gives its nodes their part of the chain, and is dropped. The part above a subtree is joined to it once.
    """
    carried = [c for c in above.columns if c not in ("tree", "chain")]
    upper, above = None, above.join(t.tops.select("tree", "n"), "tree")
    for level in range(len(t.levels) - 1, -1, -1):
        nodes, more = t.levels[level], payload if level == 0 else ()
        if level:
            nodes = nodes.where("n > 1")
        elif wanted:
            blocks = nodes.where(wanted).select("tree", F.expr(f"i div {t.block}").alias("_b")).distinct()
            nodes = nodes.join(blocks, (nodes["tree"] == blocks["tree"]) & (F.expr(f"i div {t.block}") == F.col("_b")), "left_semi")
        # trees that end in this subtree go on as `above` says, the others with the stored node over it
        below = t.block**level
        tails = above.where(F.expr(f"(n + {below - 1}) div {below} <= {t.block}")).select("tree", F.lit(0).cast("long").alias("block"), "chain", *carried)
        if upper is not None:
            tails = tails.unionByName(upper.select("tree", F.col("i").alias("block"), "chain", *carried))
        upper = _dealt(t, _grouped(t, nodes, *more).join(tails, ["tree", "block"]), carried, more)
    return upper.where(wanted) if wanted else upper


def _dealt(t: Tree, g: DataFrame, carried: list[str], payload: tuple[str, ...]) -> DataFrame:
    """The nodes of subtrees with their chains: first a row per run, so that a whole subtree is not repeated for each node."""
    run = t.arity * DIGEST

    def link(own: Column, at: Column, place: Column) -> Column:
        own = F.substring(own, at * run + 1, F.lit(run))
        return F.struct(F.substring(own, F.lit(1), place * DIGEST).alias("left"), F.substring(own, (place + 1) * DIGEST + 1, F.lit(run)).alias("right"))

    none = F.array().cast(CHAIN)
    runs = F.explode(F.sequence(F.lit(0), F.expr(f"(size(m) - 1) div {t.arity}"))).alias("g")
    g = g.select("tree", "n", "m", "own", *(f"own{k}" for k in range(1, t.stride)), "chain", *carried, runs)
    links, at = none, F.col("g")
    for k in range(1, t.stride):
        above = F.floor(at / t.arity).cast("int")
        links = F.concat(links, F.when(t.reaches(k), F.array(link(F.col(f"own{k}"), above, at - above * t.arity)).cast(CHAIN)).otherwise(none))
        at = above
    own = F.substring("own", F.col("g") * run + 1, F.lit(run))
    g = g.select("tree", "n", own.alias("own"), F.concat(links, F.col("chain")).alias("chain"), *carried, F.posexplode(F.slice("m", F.col("g") * t.arity + 1, t.arity)).alias("j", "x"))
    first = F.when(F.col("n") > 1, F.array(link(F.col("own"), F.lit(0), F.col("j"))).cast(CHAIN)).otherwise(none)
    return g.select("tree", "x.i", "x.digest", *(F.col(f"x.{c}").alias(c) for c in payload), *carried, F.concat(first, F.col("chain")).alias("chain"))


@dataclass(frozen=True)
class Manifest:
    """sources: the trees of documents' leaves; top: the tree of their subroots; root: None for an empty dataset."""

    sources: Tree
    top: Tree
    root: str | None

    def proofs(self, *payload: str, wanted: str | None = None) -> DataFrame:
        """subroot and chain (from the leaf to the root) of each leaf, with columns that were stored with it."""
        end = self.top.tops.select("tree", F.array().cast(CHAIN).alias("chain"))
        above = proofs(self.top, end, "source").select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "chain")
        return proofs(self.sources, above, *payload, wanted=wanted)


def write_manifest(leaves: DataFrame, order: tuple[str, ...], path: str, arity: int = ARITY, stride: int = STRIDE) -> Manifest:
    """leaves(source, digest, ...): stored under path with all their columns but source."""
    # a name that sorts as its source does, null first
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    sources = build(leaves.withColumn("tree", tree).drop("source"), order, f"{path}/sources", arity, stride)
    tops = sources.tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    top = build(tops, ("source",), f"{path}/top", arity, stride)
    root = top.tops.first()  # one row, one digest
    return Manifest(sources, top, root and root.digest)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(*own[:-1], ascii_lower("text")))
    # written first: dealing by ranges looks at its input twice
    leaves = written(docs.select("doc_id", "source", leaf(*own).alias("digest"), tampered.alias("tampered")), "leaves")
    manifest = write_manifest(leaves, ("doc_id", "digest"), work_path(spark, "manifest"))
    found = manifest.proofs("doc_id", "tampered")
    found = found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(siblings(F.col("chain")), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "digest"), F.col("chain")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 8) -> str:
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    joined = lambda text: " || ".join(map(field, [*FIELDS[:-1], text]))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc32_text("CAST(doc_id AS VARCHAR)")
    parts = [
        crc32_table(),
        f"""leaves AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({joined('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({joined(lower)}) END AS tampered FROM documents, crc_table)""",
        "l0 AS MATERIALIZED (SELECT *, leaf AS d, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
    ]

    def tree(name: str) -> None:
        for k in range(levels):
            parts.append(f"{name}r{k} AS MATERIALIZED (SELECT tree, i // {ARITY} AS b, max(n) AS n, string_agg(d, '' ORDER BY i) AS r FROM {name}{k} WHERE n > 1 GROUP BY tree, i // {ARITY})")
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, b AS i, (n + {ARITY - 1}) // {ARITY} AS n, sha256(r) AS d FROM {name}r{k})")

    tree("l")
    parts.append("subroots AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, d FROM l{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    parts.append("s0 AS MATERIALIZED (SELECT '' AS tree, tree AS source, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM subroots)")
    tree("s")
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT d FROM s{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    parts.append("p0 AS (SELECT doc_id, tree, leaf, i, '' AS proof, coalesce(tampered, leaf) AS d FROM l0)")
    for k in range(2 * levels):
        name, level = ("l", k) if k < levels else ("s", k - levels)
        left, right = f"substring(r, 1, {DIGEST} * (p.i % {ARITY}))", f"substring(r, {DIGEST} * (p.i % {ARITY}) + {DIGEST + 1})"
        at = "p.tree" if name == "l" else "''"
        before = f"p{k}" if k != levels else f"(SELECT p.* EXCLUDE (i), s0.i FROM p{k} p JOIN s0 ON s0.source = p.tree)"
        parts.append(f"p{k + 1} AS (SELECT p.doc_id, p.tree, p.leaf, CASE WHEN r IS NULL THEN p.i ELSE p.i // {ARITY} END AS i, CASE WHEN r IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN r IS NULL THEN d ELSE sha256({left} || d || {right}) END AS d FROM {before} p LEFT JOIN {name}r{level} q ON q.tree = {at} AND q.b = p.i // {ARITY})")
    return "WITH " + ",\n".join(parts) + f" SELECT p.doc_id, p.leaf, u.d AS subroot, root.d AS root, sha256(p.proof) AS proof_sha256, p.d AS folded_root, p.d = root.d AS verified FROM p{2 * levels} p JOIN subroots u ON u.tree = p.tree, root"


ORACLE = _oracle()
