"""Packing pieces of documents into sequences by minimum bin slack.

Documents are cut into pieces of `capacity` tokens and a rest. Only the histogram of piece lengths, of at most
`capacity` rows whatever the corpus, reaches the driver. There a bitset subset-sum program picks, again and
again, the multiset of lengths that fills a window closest to capacity, with its longest piece fixed, and
uses it as often as the counts allow. The plan is a list of runs (length, first rank, last rank, first
sequence, offset); pieces take their rank within their length and look up their run.

Edge cases: null or empty text is one piece of the end id; repeated rows are documents of their own; an empty
table gives an empty result; a very long text is many full pieces and a rest; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._encode import CACHE_BYTES, encoder
from stormshift.llm._shared import partitions, utf8, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill_window(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many of each length fill a window closest to capacity, the longest one included.

    lengths: those with a count, longest first. Bit s of `reach` says that some multiset sums to s; each step
    adds one length 1, 2, 4, ... times, and its `reach` is kept to trace the counts back.
    """
    seed = lengths[0]
    room = capacity - seed
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        most, k = min(counts[n] - (n == seed), room // n), 1
        while most > 0:
            k = min(k, most)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            most, k = most - k, 2 * k
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken = defaultdict(int, {seed: 1})
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return taken


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, rank after the last, first sequence, offset): rank r lies in sequence first + r - first rank."""
    counts, used, runs, sequence = dict(histogram), defaultdict(int), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        taken = fill_window(counts, lengths, capacity)
        times, offset = min(counts[n] // k for n, k in taken.items()), 0
        for n in sorted(taken, reverse=True):
            for _ in range(taken[n]):
                runs.append((n, used[n], used[n] + times, sequence, offset))
                used[n] += times
                offset += n
            counts[n] -= taken[n] * times
        if any(not counts[n] for n in taken):
            lengths = [n for n in lengths if counts[n]]
        sequence += times
    return runs


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, by_chunk: bool = False, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Pieces of all documents: full ones of `capacity` ids and a rest. with_ids adds the ids (little-endian).

    cache_bytes bounds what a worker knows of chunks met before: less memory for more time, the same ids.
    """

    def pieces(batches):
        encode = encoder(tokenizer, by_chunk, cache_bytes)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(encode.ids(text) + end, encode.dtype).astype("<u4", copy=False)
                flat = memoryview(ids).cast("B")
                for start in range(0, len(ids), capacity):
                    own = flat[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(own) // 4, crc32(own), len(ids), *([bytes(own)] if with_ids else [])))
            columns = list(zip(*rows)) or [()] * (5 + with_ids)
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, start, length, ...), a table that is already written.

    Ranks within a length are numbered in two levels, (length, salt), so that a length that a third of all
    pieces share is no single group.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    by_length = defaultdict(list)
    for n, first, after, sequence, offset in plan_windows(histogram, capacity):
        by_length[n].append((first, sequence, offset))
    runs = spark.sparkContext.broadcast({n: np.array(sorted(r), np.int64).T for n, r in by_length.items()})  # its size depends on capacity alone
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(partitions(spark))))
    own = Window.partitionBy("length", "_salt")
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_row", F.row_number().over(own.orderBy("doc_id", "start", "ids_crc32"))).join(sizes, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, base, inside = runs.value[int(n)]
                i = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at], offset[at] = base[i] + ranks[at] - first[i], inside[i]
            kept = [c for c in range(batch.num_columns) if batch.schema.names[c] != "_rank"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[c] for c in kept), "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, by_chunk: bool = False, with_ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    return pack(written(cut(docs, tokenizer, end_id, capacity, by_chunk, with_ids, cache_bytes=cache_bytes), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), by_chunk=True)
