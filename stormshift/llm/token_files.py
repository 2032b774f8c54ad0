"""Token-ID files: Arrow IPC files whose record batches hold fixed-size lists of ids and masks.

A dataset is a folder with, per shard, `ids-NNNNN.arrow` (tokens: fixed_size_list<uint16 or uint32>[length],
mask: fixed_size_list<bool>[length], which Arrow keeps as bits) and `docs-NNNNN.arrow` (doc_id, start in the shard, n_tokens), and a
Parquet `manifest`. Shards follow each other in document order; each begins at a new sequence, and its last
one is filled up under a mask of 0. All sequences have one length, so sequence i of a shard is row
i - b*batch_rows of batch b = i // batch_rows of a memory-mapped file: no copy, no parsing.

Edge cases: null or empty text has the end id alone; a null doc_id sorts first; rows of one doc_id follow each
other by a hash of their text; a very long text is one row and runs on through sequences; an empty table gives a dataset without shards; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._encode import crc32, encoder
from stormshift.llm._shared import partitions, utf8, work_path

MANIFEST = "shard int, n_sequences long, n_tokens long, n_docs long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, sequence long"
BATCH_ROWS = 256
SHARD_BYTES = 64_000_000  # of text, about
#: What a row counts besides its text, so that empty ones fill shards, too.
ROW_BYTES = 64


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Sequences:
    """Cuts a stream of ids into rows of `length` and writes them in batches."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype, self.left, self.held, self.rows = length, dtype, [], 0, 0
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.left.append(ids)
        self.held += len(ids) // self.dtype.itemsize
        if self.held >= self.length * BATCH_ROWS:
            flat = np.frombuffer(b"".join(self.left), self.dtype)
            whole = len(flat) // (self.length * BATCH_ROWS) * self.length * BATCH_ROWS
            for i in range(0, whole, self.length * BATCH_ROWS):
                self._write(flat[i : i + self.length * BATCH_ROWS])
            self.left, self.held = [flat[whole:].tobytes()], len(flat) - whole

    def _write(self, flat: np.ndarray) -> None:
        real = len(flat)
        flat = np.concatenate([flat, np.zeros(-real % self.length, self.dtype)])
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.rows += len(flat) // self.length

    def close(self) -> int:
        if self.held:
            self._write(np.frombuffer(b"".join(self.left), self.dtype))
        self.writer.close()
        return self.rows


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int = 2048, by_chunk: bool = False, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes every text once and writes the dataset at `path`, a URI all executors share.

    One shuffle: texts are dealt by ranges of the id and sorted there; ids go straight to the files. A file is
    written under a name of its own attempt and then renamed, so that a task that is run again is harmless.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8, so that a mask begins at a byte")
    spark = docs.sparkSession

    def write(batches):
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        encode, index, tokens, seqs = encoder(tokenizer, by_chunk), [], 0, None
        end = np.array([end_id], encode.dtype).tobytes()
        names = {k: (f"{root}/_{k}-{shard:05d}-{attempt}", f"{root}/{k}-{shard:05d}.arrow") for k in ("ids", "docs")}
        sink = None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seqs is None:
                    sink = fs.open_output_stream(names["ids"][0])
                    seqs = _Sequences(sink, length, encode.dtype)
                ids = encode.ids(text) + end
                seqs.add(ids)
                n = len(ids) // encode.dtype.itemsize
                index.append((doc, tokens, n))
                tokens += n
        if seqs is None:
            return
        rows = seqs.close()
        sink.close()
        docs_table = pa.table([pa.array(c, pa.int64()) for c in zip(*index)], names=["doc_id", "start", "n_tokens"])
        with fs.open_output_stream(names["docs"][0]) as out, pa.ipc.new_file(out, docs_table.schema) as writer:
            writer.write_table(docs_table, max_chunksize=65_536)
        for temporary, final in names.values():
            fs.move(temporary, final)
        yield pa.record_batch([pa.array([shard], pa.int32()), *(pa.array([x], pa.int64()) for x in (rows, tokens, len(index)))], names=["shard", "n_sequences", "n_tokens", "n_docs"])

    dealt = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text"))
    size = 0 if shards else dealt.agg(F.coalesce(F.sum(F.octet_length("text") + ROW_BYTES), F.lit(0))).first()[0]
    n = shards or max(partitions(spark), math.ceil(size / SHARD_BYTES))
    order = ("doc_id", F.xxhash64("text"), "text")  # rows of one doc_id, or of none, may be many: they are split, too
    dealt = dealt.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: where it begins in the stream of all ids, its length and checksum."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # one row per shard, as many as there were tasks
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.select("shard", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n_tokens", "n_sequences")))

    def read(batches):
        fs, root = _open(path)
        for batch in batches:
            for shard, base, row in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{root}/docs-{shard:05d}.arrow") as f:
                    docs = pa.ipc.open_file(f).read_all()
                starts, lengths = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                with fs.open_input_file(f"{root}/ids-{shard:05d}.arrow") as f:
                    crcs, length = _checksums(pa.ipc.open_file(f), lengths)
                for i in range(0, len(docs), 50_000):
                    part = slice(i, i + 50_000)
                    yield pa.record_batch(
                        [docs.column("doc_id").slice(i, 50_000).combine_chunks(), *(pa.array(x, pa.int64()) for x in (starts[part] + base, lengths[part], crcs[part], starts[part] // length + row))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "sequence"],
                    )

    return manifest.repartition(partitions(spark)).mapInArrow(read, DOCUMENTS)


def _checksums(ids, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Walks a shard batch by batch; a document may lie across batches."""
    crcs, doc, need, crc = np.zeros(len(lengths), np.int64), 0, int(lengths[0]), 0
    length = ids.schema.field("tokens").type.list_size
    for b in range(ids.num_record_batches):
        batch = ids.get_batch(b)
        flat, mask = batch.column("tokens").values.to_numpy(), batch.column("mask").values.to_numpy(zero_copy_only=False)
        flat, at = flat[: int(mask.sum())], 0
        while at < len(flat):
            take = min(need, len(flat) - at)
            crc = crc32(flat[at : at + take], crc)
            at, need = at + take, need - take
            if not need:
                crcs[doc], crc, doc = crc, 0, doc + 1
                need = int(lengths[doc]) if doc < len(lengths) else 0
    return crcs, length


def read_sequence(path: str, shard: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a shard and the bits of its mask, first bit lowest: views of a memory-mapped file where the store is local.

    np.unpackbits(bits, bitorder="little") gives a byte for each token.
    """
    fs, root = _open(path)
    name = f"{root}/ids-{shard:05d}.arrow"
    source = pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name)
    batch = pa.ipc.open_file(source).get_batch(i // BATCH_ROWS)
    tokens = batch.column("tokens")[i % BATCH_ROWS].values.to_numpy()
    bits = np.frombuffer(batch.column("mask").values.buffers()[1], np.uint8)
    size = len(tokens) // 8
    return tokens, bits[i % BATCH_ROWS * size : (i % BATCH_ROWS + 1) * size]


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = work_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_chunk=True)
    return read_documents(spark, path)
