"""Blocks of documents with a local dictionary: a join of all words with a corpus-wide value per word.

A block holds some megabytes of text. Its payload (word numbers per document) is written once; its distinct
words, once each, are dealt into buckets by their checksum and joined there with what the corpus knows of each
word; the answers come back as one short array per block and bucket. So a word crosses the network once per
block and not once per document, and no dictionary is ever whole in one place.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormshift.llm._shared import partitions

#: bucket -1: the payload. Else a = words of the bucket, b = their counts in the block; extra: free.
BLOCKS = "block long, bucket int, a binary, b binary, extra long"
BLOCK_BYTES = 32_000_000


def squeeze(x: np.ndarray) -> bytes:
    """Small numbers: one plane per byte, compressed."""
    x = np.ascontiguousarray(x, "<u4")
    planes = x.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def join_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words))


def split_words(x: bytes) -> list[bytes]:
    x = zstandard.ZstdDecompressor().decompress(x)
    n = int(np.frombuffer(x, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(x, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [x[i:j] for i, j in zip(starts, ends.tolist())]


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    table = pa.table({"name": list(arrays), "data": [squeeze(v) for v in arrays.values()]}, schema=pa.schema([("name", pa.string()), ("data", pa.binary())]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_arrays(x: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(x).read_all()
    return {k: unsqueeze(v) for k, v in zip(table["name"].to_pylist(), table["data"].to_pylist())}


def make_blocks(docs: DataFrame, split: Callable[[bytes], list[bytes]], buckets: int, counted: bool = False, per_document: Callable | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of docs(doc_id, text as bytes, weight int): see BLOCKS. The order of rows is that of the input's splits.

    split: text -> words. counted: documents keep distinct words and their frequencies, else the sequence of
    words. b counts the words of documents with weight 1; extra of the payload is the sum of these counts.
    The payload's ids: position of a word in the order bucket, then place inside the bucket.
    """

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text, weight in zip(*(c.to_pylist() for c in batch.columns)):
                words = split(text)
                ids = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                held.append((doc, len(text), weight, ids))
                size += len(text) + 64
                if size >= block_bytes:
                    yield flush((task << 24) + made, held, number)
                    number.clear()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush((task << 24) + made, held, number)

    def flush(block: int, held: list[tuple], number: dict[bytes, int]) -> pa.RecordBatch:
        words = list(number)
        weighted = [ids for _, _, w, ids in held if w]
        counts = np.bincount(np.concatenate([np.zeros(0, np.uint32), *weighted]), minlength=len(words)).astype(np.uint32)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.uint32)  # of a word in the order of buckets
        place[order] = np.arange(len(words), dtype=np.uint32)
        rank = np.empty(len(words), np.uint32)  # by frequency, so that most numbers are small
        total = np.bincount(np.concatenate([np.zeros(0, np.uint32), *(ids for *_, ids in held)]), minlength=len(words))
        often = np.argsort(-total, kind="stable")
        rank[often] = np.arange(len(words), dtype=np.uint32)
        rows, freqs = [rank[ids] for *_, ids in held], None
        if counted:
            pairs = [np.unique(r, return_counts=True) for r in rows]
            rows, freqs = [p[0] for p in pairs], np.concatenate([p[1] for p in pairs])
        docs_ = np.array([d if d is not None else 0 for d, *_ in held], np.int64)
        payload = {
            "doc_low": docs_ & 0xFFFFFFFF, "doc_high": (docs_ >> 32) & 0xFFFFFFFF, "doc_null": np.array([d is None for d, *_ in held]),
            "bytes": np.array([n for _, n, *_ in held]), "weight": np.array([w for _, _, w, _ in held]),
            "lengths": np.array([len(r) for r in rows]), "ids": np.concatenate(rows), "places": place[often],
        }
        if counted:
            payload["freqs"] = freqs
        out = [(-1, pack_arrays(payload), b"", int(counts.sum()))]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            own = order[edges[b] : edges[b + 1]]
            out.append((int(b), join_words([words[i] for i in own]), squeeze(counts[own]), 0))
        bs, a, c, extra = zip(*out)
        return pa.record_batch([pa.array([block] * len(bs), pa.int64()), pa.array(bs, pa.int32()), pa.array(a, pa.binary()), pa.array(c, pa.binary()), pa.array(extra, pa.int64())], names=["block", "bucket", "a", "b", "extra"])

    return docs.mapInArrow(blocks, BLOCKS)


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets of words: four for each shuffle partition, and more where a bucket would hold more than the words of about 16 MB."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(4 * partitions(docs.sparkSession), -(-size // 16_000_000))


def opened(payload: bytes) -> dict[str, np.ndarray]:
    """A payload; its ids are turned into places in the order of buckets. doc: object array of ids or None."""
    x = unpack_arrays(payload)
    doc = (x.pop("doc_high").astype(np.int64) << 32) | x.pop("doc_low").astype(np.int64)
    x["doc"] = [None if null else int(d) for d, null in zip(doc.tolist(), x.pop("doc_null").tolist())]
    x["ids"] = x.pop("places")[x["ids"]]
    x["ends"] = np.cumsum(x["lengths"], dtype=np.int64)
    return x


def per_block(blocks: DataFrame, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
    """use(opened payload, answers joined in the order of buckets) for each block -> pandas frame.

    answers: block, bucket, value (squeezed numbers, one for each word of that block and bucket).
    """
    import pandas as pd

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        right = right.sort_values("bucket")
        for payload in left["a"]:
            values = [unsqueeze(v) for v in right["value"]]
            frames.append(use(opened(payload), np.concatenate(values) if values else np.zeros(0, np.uint32)))
        return pd.concat(frames) if frames else use(None, np.zeros(0, np.uint32))

    payloads = blocks.where("bucket = -1").select("block", "a")
    return payloads.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(one, schema)
