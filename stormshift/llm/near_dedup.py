"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set: its distinct shingles of five words (A-Z in lower case; fewer words: all of them as one).
Per permutation both the smallest and the largest hash are kept, so each hash evaluation yields two values of
the signature. Bands of the signature deal documents into buckets, and a link can only be missed if no band of
the two agrees. The length of a band follows the threshold (band_size): at 0.85, 36 bands of 7 values miss less than 1 in a
million links; at 0.8, 42 of 6 values 3 in a million.

Candidates are confirmed on full sets in two steps. First each document is compared with one hub, the smallest member
of the bucket that most of its bands name: work in proportion to the documents, which settles groups whose members are
all close to one text. Then only buckets whose members are not one component yet go on: documents that share such
buckets, directly or through others, form a group, and all its pairs that no link joins so far are compared.

Exact copies of a text are one node from the start. A group is compared in blocks of `chunk` documents by
`chunk`, each block in one task that returns a spanning forest of its links, never the pairs.

Edge cases: null text, or text without words, has an empty set and is linked with nothing; rows of one doc_id
are one vertex; a null doc_id keeps a null component and links nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormshift.llm._encode import release
from stormshift.llm._graph import components
from stormshift.llm._shared import free_name, utf8, written

PERMUTATIONS = 126


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = 5, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes. known: hashes of words met before, kept by the caller."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    try:
        h = [known[w] for w in own]
    except KeyError:
        if len(known) > 300_000:
            known.clear()
        for w in own:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = [known[w] for w in own]
    h = np.array(h, np.uint64)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


_draw = np.random.default_rng(20_240_229)
_A = _draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def signature(members: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation (x -> a x + b mod 2^64, upper half): 2 x PERMUTATIONS values."""
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(members), 512):
        x = ((members[None, i : i + 512] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32)
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    return np.stack([low, high], 1).ravel()


def band_size(percent: int) -> int:
    """The most values a band may have so that at most 1 in 100,000 links at the threshold shares no band."""
    values = 2 * PERMUTATIONS
    return next((b for b in range(values, 0, -1) if values % b == 0 and (1 - (percent / 100) ** b) ** (values // b) <= 1e-5), 1)


def band_keys(members: np.ndarray, band: int) -> list[int]:
    with np.errstate(over="ignore"):
        rows = signature(members).reshape(-1, band).astype(np.uint64)
        key = np.arange(1, len(rows) + 1, dtype=np.uint64)
        for i in range(band):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64).tolist()


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, chunk: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs. Links: 100 * intersection >= percent * union."""
    spark, band = docs.sparkSession, band_size(percent)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text"))
    rows = rows.withColumn("copy", F.xxhash64("text", F.length("text")))

    def sign(batches):
        release()
        known: dict[bytes, int] = {}  # freed with the task
        for batch in batches:
            sizes, bands = [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), words, known)
                sizes.append(len(own))
                bands.append(band_keys(own, band) if len(own) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("copy"), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "copy", "n_shingles", "bands"])

    signed = written(rows.mapInArrow(sign, "doc_id long, copy long, n_shingles long, bands array<long>"), "signatures")
    live = signed.where("n_shingles > 0 and doc_id is not null")
    repeated = not live.groupBy("doc_id").count().where("count > 1").isEmpty()
    texts = rows.dropDuplicates(["doc_id", "copy"]) if repeated else rows
    # copies of a text: one node, the smallest doc_id. (Two texts of one 64-bit hash would only share candidates and be told apart below.)
    copies = live.groupBy("copy").agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands"), F.count("*").alias("n"))
    copies = written(copies, "copies")
    buckets = written(copies.select("node", F.explode("bands").alias("band")), "bands")
    # this and the other small sides below are written: then their joins have no aggregation in their stage, and a hot key can be split
    shared = written(buckets.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared-bands")
    stars = written(buckets.join(shared, "band").select("band", F.col("first").alias("hub"), "node"), "stars")

    def link(group: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        own = group.column("own").to_numpy()
        left, right = (own == group.column(side)[0].as_py() for side in "ij")
        sets = [shingles(t.as_py(), words, known) for t in group.column("text")]
        pairs = forest(sets, group.column("label").to_numpy(), left, right, percent)
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def confirmed(dealt: DataFrame, name: str) -> DataFrame:
        """dealt(component, i, j, own, label, text) -> links of labels, found between own = i and own = j."""
        return written(dealt.groupBy("component", "i", "j").applyInArrow(link, "a long, b long"), name)

    # first step: own 0 is the hub, own 1 its documents, dealt to as many tasks as they need
    voted = stars.where("hub <> node").groupBy("node", "hub").count().groupBy("node").agg(F.min(F.struct(-F.col("count"), "hub"))["hub"].alias("component"))
    voted = written(voted, "hubs")
    sizes = written(voted.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "sizes")
    spread = voted.join(sizes, "component")
    spread = written(spread.withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "spread")
    sides = spread.select("component", "part", F.lit(1).alias("own"), "node").union(
        spread.select("component", "part", F.lit(0).alias("own"), F.col("component").alias("node")).distinct()
    )
    dealt = texts.join(sides.withColumnRenamed("node", "doc_id"), "doc_id")
    dealt = dealt.select(F.struct("component", "part").alias("component"), F.lit(0).alias("i"), F.lit(1).alias("j"), "own", F.col("doc_id").alias("label"), "text")
    near = confirmed(dealt, "near")
    settled = components(near)
    # second step: buckets that hold several components so far
    labels = settled.withColumnRenamed("component", "label")
    marked = written(stars.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "marked")
    open_ = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    open_ = written(open_, "open-bands")
    groups = components(marked.join(open_, "band").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    members = written(groups.groupBy("component").agg(F.count("*").alias("n")), "group-sizes")
    sized = groups.join(members, "component").join(labels, "node", "left")
    sized = written(sized.select(F.col("node").alias("doc_id"), "component", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), F.coalesce("label", "node").alias("label")), "groups")
    # blocks (i, j), i <= j, of a group's chunks: a document of chunk c goes to (c, j >= c) and (i <= c, c)
    dealt = texts.join(sized, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "text")
    linked = components(confirmed(dealt, "links"))
    # copies of a text follow their node; a vertex alone is its own component
    named = live.select("doc_id", "copy").distinct().join(copies.select("copy", "node"), "copy")
    if repeated:  # several texts under one doc_id: all are its links
        edges = settled.union(linked).union(named.select("node", "doc_id")).toDF("a", "b")
        labels = components(edges).withColumnRenamed("component", "label")
        named = named.select("doc_id", F.col("doc_id").alias("node")).distinct()
    named = named.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("node"))
    named = named.join(linked.withColumnRenamed("component", "name"), "node", "left").select("doc_id", F.coalesce("name", "node").alias("name"))
    named = written(named, "names")
    lowest = written(named.groupBy("name").agg(F.min("doc_id").alias("component_id")), "lowest")
    found = named.join(lowest, "name").select("doc_id", "component_id")
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def forest(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links, as pairs of labels, that join what neither labels nor earlier links join, between rows of left and of right; at most one less than there are rows."""
    label = np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends, mark, out = np.cumsum(sizes), np.zeros(len(distinct), np.int32), []
    starts, place = ends - sizes, np.arange(len(sets))
    once = bool((left & right).all())  # a block of a chunk with itself: each pair has one turn
    for p in np.flatnonzero(left & (sizes > 0)):
        # sets of such different sizes can't be linked, and what is joined already needs no comparison
        fit = 100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p])
        if once:
            fit &= place > p
        rest = np.flatnonzero(right & (sizes > 0) & (label != label[p]) & fit)
        if not len(rest):
            continue
        mark[at[starts[p] : ends[p]]] = 1
        both = np.add.reduceat(mark[np.concatenate([at[starts[q] : ends[q]] for q in rest])], np.cumsum(sizes[rest]) - sizes[rest])
        mark[at[starts[p] : ends[p]]] = 0
        for q in rest[100 * both >= percent * (sizes[rest] + sizes[p] - both)].tolist():
            if label[p] != label[q]:
                label[label == label[q]] = label[p]
                out.append((labels[p], labels[q]))
    return out


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id; the same columns.

    Of rows with equal doc_id and text one stays; rows without a doc_id all stay.
    """
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, **how)
    name = free_name(docs, "_gone")
    gone = found.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, F.col(id_column) == F.col(name), "left_anti")
    again = docs.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias(name)).count().where("count > 1").select(name)
    if again.isEmpty():
        return kept
    again = written(again, "repeated")  # only rows of these ids are shuffled with their text
    twice = kept.join(again, F.col(id_column) == F.col(name), "left_semi").dropDuplicates([id_column, text_column])
    return kept.join(again, F.col(id_column) == F.col(name), "left_anti").unionByName(twice)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, m) AS (SELECT a, a FROM two_way UNION SELECT l.b, r.m FROM reach r JOIN two_way l ON l.a = r.doc_id),
found AS (SELECT doc_id, min(m) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(f.m, d.doc_id) AS component_id, coalesce(f.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""
