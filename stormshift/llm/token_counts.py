"""Token counts of whole texts without token ids.

A byte-level BPE splits a text into pre-tokens and encodes each alone. Texts are cut where the vocabulary's own
pattern always cuts: before a blank that stands next to a word. Each document keeps its pre-tokens' frequencies; each distinct
pre-token of the corpus is counted once, where its occurrences in all blocks of documents meet; the counts
go back to the documents and are summed with the frequencies.

Edge cases: null or empty text has 0 tokens; special strings are one token each, as the library has it;
repeated rows give repeated rows; a very long text is a block of its own, whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormshift.llm._blocks import bucket_count, make_blocks, per_block, split_words, squeeze
from stormshift.llm._encode import encoder
from stormshift.llm._shared import utf8, written

#: Unicode's white space.
_SPACE = "\\t-\\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: White space other than a single blank or line end between two words: cut by the slower pattern.
_AWKWARD = re.compile(rf"[{_SPACE}][{_SPACE}]|^[{_SPACE}]|[{_SPACE}]\Z")
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def pre_tokens(text: bytes, special: str = "<|endoftext|>") -> list[bytes]:
    """Chunks of a text whose token counts add up to the text's. A chunk is a word with the blank or line end before it."""
    s = text.decode("utf-8", "replace")
    if special in s:
        first, *rest = s.split(special)
        return pre_tokens(first.encode()) + [x for part in rest for x in (special.encode(), *pre_tokens(part.encode()))]
    if not s:
        return []
    if _AWKWARD.search(s):
        return [x.encode() for x in _CHUNK.findall(s)]
    # a word after a blank keeps it as "\x20word"; a line's first word keeps its line end
    words = s.replace("\n", " \n").encode().split(b" ")
    return [words[0], *[w if w[0] == 10 else b" " + w for w in words[1:]]]


def count_tokens(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs, for a byte-level BPE file of the tokenizers library."""
    rows = docs.select(F.col(id_column).cast("long"), utf8(text_column).alias("text"), F.lit(0))
    buckets = bucket_count(rows)
    blocks = written(make_blocks(rows, pre_tokens, buckets, counted=True), "token-count-blocks", "none")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        """One bucket: the same pre-tokens of all blocks; each is counted once."""
        words = [split_words(a) for a in group["a"]]
        distinct = list(set().union(*words))
        library, known = encoder(tokenizer, False).library, {}
        for i in range(0, len(distinct), 20_000):
            part = distinct[i : i + 20_000]
            known.update(zip(part, (len(e) for e in library.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False))))
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "value": [squeeze(np.array([known[w] for w in own])) for own in words]})

    def add_up(x: dict | None, counts: np.ndarray) -> pd.DataFrame:
        if x is None:
            return pd.DataFrame({"doc_id": [], "n_bytes": [], "n_tokens": []})
        before = np.concatenate([[0], np.cumsum(counts[x["ids"]].astype(np.int64) * x["freqs"])])
        ends = x["ends"]
        totals = before[ends] - before[ends - x["lengths"]]
        return pd.DataFrame({"doc_id": pd.array(x["doc"], "Int64"), "n_bytes": x["bytes"].astype(np.int64), "n_tokens": totals})

    answers = blocks.where("bucket >= 0").groupBy("bucket").applyInPandas(count, "block long, bucket int, value binary")
    return per_block(blocks, answers, add_up, COUNTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 1024)


