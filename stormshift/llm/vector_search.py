"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, so that the largest inner product is the smallest distance. Centroids come from balanced k-means
on a bounded sample. A vector is listed under its nearest centroid, and under others that are
nearly as near, `replicas` at most (boundary vectors). Centroids, 4,096 at most, are searched by a graph of near
centroids that every task holds. A query reads the lists whose centroid is at most a ratio farther
than its nearest one; the ratio is taken from some trial rows, so that `recall` of their true nearest
neighbours among all rows lie in the lists read. The sample also gives each query a score that its k nearest surely reach;
only rows that reach it leave a list, so that hits grow with the queries and not with the lists read. Lists
and their queries are dealt in parts of bounded size; inner products inside a part are exact, in double
precision, on the vectors as given.

Equal vectors are one entry with their k + 1 smallest ids: no more of them can be among the k nearest.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; shorter vectors count
as padded with zeros; repeated rows of an id are one; fewer candidates than k give fewer rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._shared import partitions, written

SAMPLE, TRIALS, LIST_SIZE, MOST_LISTS, PART = 20_000, 128, 256, 4_096, 4_096


class Index:
    """Centroids (in one more dimension) and the graph between them."""

    def __init__(self, centroids: np.ndarray, norm: float, degree: int = 24):
        self.centroids, self.norm, self.ratio, self.width = centroids, norm, 1.0, 1
        d = _distances(centroids, centroids)
        near = np.argsort(d, 1)[:, 1 : degree + 1]
        some = np.random.default_rng(3).integers(0, len(centroids), (len(centroids), 4))  # long links keep the graph together
        self.links = np.concatenate([near, some], 1)
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, 32).astype(int))

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate([x, more[:, None]], 1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `width` centroids of each row, by beam search over the graph: numbers and distances, nearest first.

        A row keeps a pool of the best it has met; its work follows the centroids it visits, not all of them.
        """
        n, k = len(x), len(self.centroids)
        width = min(width, k)
        beam = min(k, max(width, 16))
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)
        pool, dist, done = np.zeros((n, 0), int), np.zeros((n, 0)), np.zeros((n, 0), bool)
        nodes = np.broadcast_to(self.entries, (n, len(self.entries)))
        while True:
            fresh = ~seen[rows, nodes]
            seen[rows, nodes] = True
            d = np.full(nodes.shape, np.inf)
            r, c = np.nonzero(fresh)
            for i in range(0, len(r), 50_000):
                part = r[i : i + 50_000], c[i : i + 50_000]
                diff = x[part[0]] - self.centroids[nodes[part]]
                d[part] = np.sqrt((diff * diff).sum(1))
            pool, dist, done = np.concatenate([pool, nodes], 1), np.concatenate([dist, d], 1), np.concatenate([done, np.zeros(nodes.shape, bool)], 1)
            if pool.shape[1] > beam:
                best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                pool, dist, done = pool[rows, best], dist[rows, best], done[rows, best]
            # the nearest that are not yet followed, a few at a time
            open_ = np.where(done, np.inf, dist)
            some = np.argsort(open_, 1)[:, :8]
            if not np.isfinite(open_[rows, some]).any():
                break
            done[rows, some] = True
            nodes = np.where(np.isfinite(open_[rows, some])[:, :, None], self.links[pool[rows, some]], self.entries[0]).reshape(n, -1)
            nodes = np.sort(nodes, 1)
            nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = self.entries[0]  # a centroid once; this one is always seen
        order = np.argsort(dist, 1, kind="stable")[:, :width]
        return pool[rows, order], dist[rows, order]

    def lists(self, x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, list, and whether it lies within the ratio: all such lists of each row and its `least` nearest, nearest first."""
        found, todo, k = [], np.arange(len(x)), len(self.centroids)
        wide = min(k, max(least, self.width))
        while len(todo):
            near, d = self.search(x[todo], wide)
            inside = d <= self.ratio * d[:, :1] + 1e-12
            over = inside[:, -1] & (wide < k)  # there may be more: these rows search again, wider
            r, c = np.nonzero((inside | (np.arange(d.shape[1]) < least)) & ~over[:, None])
            found.append((todo[r], near[r, c], inside[r, c]))
            todo, wide = todo[over], min(k, 2 * wide)
        r, near, inside = (np.concatenate(f) for f in zip(*found))
        order = np.argsort(r, kind="stable")
        return r[order], near[order], inside[order]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def balanced_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means whose distances grow with a cluster's size so far, so that no cluster stays large."""
    draw = np.random.default_rng(seed)
    centroids, weight = x[draw.choice(len(x), k, replace=False)].copy(), np.zeros(k)
    for _ in range(rounds):
        own = np.concatenate([(_distances(x[i : i + 2_000], centroids) ** 2 + weight).argmin(1) for i in range(0, len(x), 2_000)])
        sizes = np.bincount(own, minlength=k)
        spread = ((x - centroids[own]) ** 2).sum(1).mean()
        weight = 0.5 * weight + 0.5 * spread * 0.2 * (sizes / (len(x) / k) - 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def fit(sample: np.ndarray, n: int, norm: float, list_size: int) -> Index:
    """Centroids of about n / list_size lists, MOST_LISTS at most."""
    lists = int(np.clip(n // list_size, 1, min(MOST_LISTS, len(sample))))
    index = Index(np.zeros((1, sample.shape[1] + 1)), norm)
    return Index(balanced_means(index.lift(sample), lists), norm)


def _calibrated(posts: DataFrame, index: Index, trials: np.ndarray, own: np.ndarray, pad, k: int, recall: float) -> tuple[float, int]:
    """The ratio of distances at which `recall` of the trials' true k nearest, found among all rows, lie in a list that is read; and
    how many lists a trial then reads, for a start of the search.

    A task keeps the best of what it has met for each trial, so what leaves it does not grow with the rows.
    """
    d = _distances(index.lift(trials, True), index.centroids)
    far = d / np.maximum(d.min(1, keepdims=True), 1e-12)
    most = 4 * k  # an entry stands in some lists

    def best(batches):
        held = None
        for batch in batches:
            for i in range(0, len(batch), 2_000):
                part = batch.iloc[i : i + 2_000]
                e = part["e"].to_numpy()
                scores = np.where(own[:, None] == e[None, :], -np.inf, trials @ pad(part["x"]).T)
                now = [scores, np.broadcast_to(e, scores.shape), far[:, part["list"].to_numpy()]]
                held = now if held is None else [np.concatenate(x, 1) for x in zip(held, now)]
                if held[0].shape[1] > most:
                    at = np.argpartition(-held[0], most - 1, axis=1)[:, :most]
                    held = [np.take_along_axis(x, at, 1) for x in held]
        if held is not None:
            t = np.repeat(np.arange(len(trials)), held[0].shape[1])
            yield pd.DataFrame({"t": t, "score": held[0].ravel(), "e": held[1].ravel(), "far": held[2].ravel()})

    hits = posts.select("x", "e", "list").mapInPandas(best, "t int, score double, e long, far double").where("score > double('-infinity')")
    hits = hits.groupBy("t", "e").agg(F.max("score").alias("score"), F.min("far").alias("far"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "e"))).where(F.col("r") <= k)
    ratio = hits.agg(F.percentile("far", F.lit(recall))).first()[0] or 1.0
    return float(ratio), int(np.ceil(1.1 * np.quantile((far <= ratio).sum(1), 0.9))) + 1


def nearest(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.95, replicas: int = 3, boundary: float = 1.02, list_size: int = LIST_SIZE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row where is_query, found among all other rows."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"), is_query.alias("asked"))
    v = v.where("id is not null and x is not null and not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(x, c -> c <> 0)")
    first = Window.partitionBy("x").orderBy("id")
    distinct = v.select("id", "x").withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    distinct = distinct.groupBy("x").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    distinct = written(distinct.withColumn("e", F.col("ids")[0]), "vectors")
    n, width, norm = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1)), F.sqrt(F.coalesce(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)), F.lit(0.0)))).first()
    asked = written(v.where("asked").select("id", "x").distinct(), "queries")
    queries = asked.groupBy("x").agg(F.min("id").alias("q"))
    # only rows under a hash bound that about twice the sample stays under are sorted, however many there are
    drawn = lambda key, some: distinct.where(F.shiftrightunsigned(key, 11) * F.lit(2.0**-53) <= min(1.0, 2.0 * some / max(1, n))).orderBy(F.shiftrightunsigned(key, 11), "e").limit(some)
    rows = drawn(F.xxhash64("e"), SAMPLE).select("x").collect()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pad = lambda xs: np.array([np.pad(np.asarray(x, float), (0, width - len(x))) for x in xs]).reshape(-1, width)
    sample = pad([r.x for r in rows])
    # drawn anew from all rows: as many of them as of the queries are among those that the centroids are trained on
    trials = drawn(F.xxhash64("e", F.lit(1)), TRIALS).select("x", "e").collect()
    trials, own = pad([r.x for r in trials]), np.array([r.e for r in trials])
    index = fit(sample, n, norm, list_size)  # at most MOST_LISTS centroids
    shared = spark.sparkContext.broadcast(index)

    def post(batches):
        idx = shared.value
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                near, d = idx.search(idx.lift(pad(part["x"])), replicas)
                r, c = np.nonzero(d <= boundary * d[:, :1] + 1e-12)
                yield part.iloc[r].assign(list=near[r, c])

    posts = written(distinct.mapInPandas(post, "x array<double>, ids array<long>, e long, list int"), "posts")
    held = np.zeros(len(index.centroids), np.int64)
    for r in posts.groupBy("list").count().collect():  # at most MOST_LISTS rows
        held[r[0]] = r[1]
    # so many lists, whichever they are, hold that many entries
    enough = int(np.searchsorted(np.cumsum(np.sort(held)), replicas * (k + 1))) + 1
    index.ratio, index.width = _calibrated(posts, index, trials, own, pad, k, recall)
    shared, sizes = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(held)
    sample = spark.sparkContext.broadcast(sample)  # at most SAMPLE rows

    def ask(batches):
        idx = shared.value
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                x = pad(part["x"])
                r, near, keep = idx.lists(idx.lift(x, True), enough)
                # whatever the ratio, the nearest lists that surely hold k + 1 different entries
                before = np.cumsum(sizes.value[near]) - sizes.value[near]
                first = before - before[np.searchsorted(r, np.arange(len(part)))][r] < replicas * (k + 1)
                keep |= first
                # the sample is part of all rows, and thrice as many of them reach this score as can be among the k nearest
                own, most = x @ sample.value.T, 3 * (k + 1)
                sure = np.partition(own, -most, axis=1)[:, -most] - 1e-9 if own.shape[1] >= most else np.full(len(part), -np.inf)
                yield part.iloc[r[keep]].assign(sure=np.where(first, -np.inf, sure[r])[keep], list=near[keep])

    # a number of partitions of its own, so that few queries are not one task
    asks = written(queries.repartition(partitions(spark)).mapInPandas(ask, "x array<double>, q long, sure double, list int"), "asks")
    # lists, and what is asked of a list, in parts of about PART rows: at most MOST_LISTS rows each
    parts = lambda t, name: t.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    shape = F.broadcast(parts(posts, "np").join(parts(asks, "nq"), "list"))
    ours = F.pmod(F.xxhash64("e"), F.col("np")).cast("int").alias("i")
    theirs = F.pmod(F.xxhash64("q"), F.col("nq")).cast("int").alias("j")
    posts = posts.join(shape, "list").select("list", "x", "ids", ours, F.explode(F.expr("sequence(0, nq - 1)")).alias("j"))
    asks = asks.join(shape, "list").select("list", "x", "q", "sure", F.explode(F.expr("sequence(0, np - 1)")).alias("i"), theirs)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            scores = pad(right["x"]) @ pad(left["x"]).T
            most = min(k + 1, len(left))
            firsts, ids = np.array([i[0] for i in left["ids"]]), left["ids"].tolist()
            floor = np.partition(scores, len(left) - most, axis=1)[:, len(left) - most]
            floor = np.maximum(floor, right["sure"].to_numpy())
            for q, row, least in zip(right["q"], scores, floor):
                at = np.flatnonzero(row >= least)
                at = at[np.lexsort((firsts[at], -row[at]))]
                best = sorted((-row[a], int(i)) for a in at for i in ids[a])[: k + 1]
                found += [(q, i, -s) for s, i in best]
        return pd.DataFrame(found, columns=["q", "id", "score"])

    keys = ("list", "i", "j")
    hits = asks.groupBy(*keys).cogroup(posts.groupBy(*keys)).applyInPandas(lambda a, p: compare(p, a), "q long, id long, score double")
    hits = hits.groupBy("q", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    hits = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("hits"))
    named = asked.join(queries.withColumnRenamed("x", "y"), F.col("x") == F.col("y")).select("id", "q").join(hits, "q")
    named = named.select(F.col("id").alias("query_id"), F.expr(f"slice(filter(hits, h -> h.id <> id), 1, {k})").alias("hits"))
    return named.select("query_id", F.posexplode("hits").alias("rank", "h")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), F.col("h.score").alias("score"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
