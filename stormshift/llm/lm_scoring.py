"""Log-probabilities of whole texts under a word n-gram model, by one walk of a weighted backoff automaton.

Unigrams: every distinct training token, add-one over the vocabulary and one unknown word. Longer n-grams:
those that occur `least` times, twice by default however large the corpus, with absolute discounting interpolated
with the shorter history; the end of a text is predicted like a word. All counts grow with the corpus and stay distributed: a block of documents asks for the words
and n-grams that occur in it, and the parts that hold their counts answer it (see _blocks and _merge).

A state is the longest kept n-gram that the text read so far ends with. Reading a word follows the state's
arc for it; where there is none, the failure arc leads to the next shorter history and adds its weight. A block
walks all its places at once, order by order (_Walk); Automaton is the same walk of a model that fits in memory.

All n-grams of one history are summed in one task, since its backoff weight needs them all; those of a history as common as
all words of a part are split by their last word, and a block adds up the sums that the parts give. What a task
holds uncompressed is the distinct n-grams of its part, not the blocks' requests. N-grams are numbered by 64 bits.

Edge cases: null or empty text is the end token alone; repeated rows give repeated rows; a very long text is a block of
its own, whole; an empty table or no
training rows give an empty result or the scores of an empty model (p = 1 for its only, unknown word).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormshift.llm._blocks import bucket_count, make_blocks, opened, split_words, squeeze, unsqueeze
from stormshift.llm._shared import utf8, written

END = b""
#: A history of fewer occurrences is not split, however small the parts.
LEAST_SPLIT = 4_000_000
BLOCK_BYTES = 12_000_000  # a walk holds some ten numbers for each place of its block
ANSWERS = "block long, level int, bucket int, value binary, n long"
ASKED = "block long, bucket int, keys binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, then the end."""
    return [*text.lower().split(), END]


class Automaton:
    """States are kept n-grams up to order - 1, numbered by history; 0 is the empty one.

    arcs[state * width + word] = (log10 p, next state); fail[state] = (log10 weight, shorter state).
    word: number of a word that occurs in kept n-grams, from 1; 0 any other.
    """

    def __init__(self, width: int):
        self.width, self.arcs, self.fail, self.first = width, {}, {}, {}

    def walk(self, words: list[int], root: list[float]) -> float:
        """words: their numbers; root: log10 p of each without history."""
        state, total, width, arcs, fail, first = 0, 0.0, self.width, self.arcs, self.fail, self.first
        for w, p in zip(words, root):
            if w:
                while state:
                    arc = arcs.get(state * width + w)
                    if arc:
                        total += arc[0]
                        state = arc[1]
                        break
                    weight, state = fail[state]
                    total += weight
                else:
                    total += p
                    state = first.get(w, 0)
            else:
                while state:
                    weight, state = fail[state]
                    total += weight
                total += p
        return total


def build(kept: dict[int, dict[tuple, int]], words: dict[int, int], n: int, v: int, discount: float) -> Automaton:
    """kept: order -> n-gram -> count; words: number -> count."""
    a = Automaton(max(words, default=0) + 1)
    histories = sorted({g[:-1] for grams in kept.values() for g in grams}, key=lambda g: (len(g), g))
    number = {(): 0} | {h: i for i, h in enumerate(histories, 1)}
    count = {(w,): c for w, c in words.items()} | {g: c for grams in kept.values() for g, c in grams.items()}
    longest = lambda g: next(number[g[i:]] for i in range(len(g) + 1) if g[i:] in number)
    left = dict.fromkeys(number, 1.0)
    for grams in kept.values():
        for g, c in grams.items():
            left[g[:-1]] -= (c - discount) / count[g[:-1]]

    def p(g: tuple) -> float:
        if len(g) == 1:
            return (count[g] + 1) / (n + v + 1)
        own = max(count[g] - discount, 0) / count[g[:-1]] if g in count else 0.0
        return own + left.get(g[:-1], 1.0) * p(g[1:])

    for order in sorted(kept):
        for g in kept[order]:
            a.arcs[number[g[:-1]] * a.width + g[-1]] = (math.log10(p(g)), longest(g if len(g) < max(kept) else g[1:]))
    for h in histories:
        a.fail[number[h]] = (math.log10(max(left[h], 1e-12)), longest(h[1:]))
    a.first = {h[0]: number[h] for h in histories if len(h) == 1}
    return a


def score(docs: DataFrame, weight: str, order: int = 3, least: int = 2, discount: float = 0.75, parts: int | None = None, split: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, dict]:
    """Scores of all rows of docs by a model of those whose `weight` (an SQL expression) is 1; the model's N and V.

    parts: of n-grams, by the number of blocks; split: occurrences of a history from which its n-grams lie in several parts.
    """
    rows = docs.select(F.col(id_column).cast("long"), utf8(text_column).alias("text"), F.expr(weight).cast("int"))
    buckets = bucket_count(rows)
    blocks = written(make_blocks(rows, tokens, buckets, block_bytes=BLOCK_BYTES), "lm-blocks", "none")
    n, made = blocks.where("bucket = -1").agg(F.coalesce(F.sum("extra"), F.lit(0)), F.count("*")).first()
    parts = parts or max(buckets, made // 2)  # so that a part stays about as large as two blocks
    split = split or max(LEAST_SPLIT, -(-n // parts))  # a history that occurs as often as a part has words has several

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        """One bucket of words of all blocks: corpus counts, and numbers of the words that are frequent enough for longer n-grams."""
        words, total = [split_words(a) for a in group["a"]], {}
        for own, counts in zip(words, group["b"]):
            for w, c in zip(own, unsqueeze(counts).tolist()):
                total[w] = total.get(w, 0) + c
        often = {w: i for i, w in enumerate(sorted(w for w, c in total.items() if c >= least))}
        bucket = int(group["bucket"].iloc[0])
        # counts, and numbers of the frequent words in their bucket, from 1, as two halves of 32 bits each
        column = lambda own, get: _halves(np.fromiter(map(get, own), np.int64, len(own)))
        value = [squeeze(np.concatenate([*column(own, total.__getitem__), *column(own, lambda w: often.get(w, -1) + 1)])) for own in words]
        out = pd.DataFrame({"block": group["block"], "level": 1, "bucket": group["bucket"], "value": value, "n": 0})
        return pd.concat([out, pd.DataFrame({"block": [-1], "level": [1], "bucket": [bucket], "value": [b""], "n": [sum(c > 0 for c in total.values())]})])

    answers = written(blocks.where("bucket >= 0").groupBy("bucket").applyInPandas(sum_up, ANSWERS), "lm-counts", "none")
    v = answers.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept: dict[int, int] = {}
    for level in range(2, order + 1):
        asked = _with_answers(blocks, answers, lambda x, values: _ask(x, values, level, buckets, parts, discount, split), ASKED)
        found = written(asked.groupBy("bucket").applyInPandas(lambda group: _merge(group, level, parts, least, level == order), ANSWERS), "lm-grams", "none")
        kept[level] = found.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not kept[level]:
            break
        answers = answers.unionByName(found)
    top = max((k for k, c in kept.items() if c), default=1)

    def use(x: dict | None, values: dict) -> pd.DataFrame:
        if x is None:
            return pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})
        walk = _Walk(x, values, buckets, parts, discount, split)
        walk.p = (walk.of + 1) / (n + v + 1)
        root, known, out = np.log10(walk.p), walk.of > 0, []
        for level in range(2, top + 1):
            walk.step(values.get(level, []))
        p = np.log10(walk.p)
        for doc, held, end, size in zip(x["doc"], x["weight"] == 0, x["ends"].tolist(), x["lengths"].tolist()):
            own = slice(end - size, end)
            out.append((doc, bool(held), size, int(known[own].sum()), math.fsum(root[own].tolist()), float(np.cumsum(p[own])[-1])))  # added up in the order of Automaton.walk
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])
        frame["doc_id"] = pd.array(x["doc"], "Int64")
        return frame

    return _with_answers(blocks, answers, use, SCORES), {"n": n, "v": v, "kept": kept}


def _with_answers(blocks: DataFrame, answers: DataFrame, use, schema: str) -> DataFrame:
    """use(opened payload, level -> [(bucket, answers)]) for each block."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["level", "bucket"])
        values: dict[int, list] = {}
        for level, bucket, value in zip(right["level"], right["bucket"], right["value"]):
            values.setdefault(int(level), []).append((int(bucket), unsqueeze(value)))
        frames = [use(opened(payload) | {"block": block}, values) for block, payload in zip(left["block"], left["a"])]
        return pd.concat(frames) if frames else use(None, values)

    payloads = blocks.where("bucket = -1").select("block", "a")
    return payloads.groupBy("block").cogroup(answers.where("block >= 0").select("block", "level", "bucket", "value").groupBy("block")).applyInPandas(one, schema)


_LOW, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(32)


def _small(*x: np.ndarray) -> bool:
    return all(not len(v) or v.max() <= _LOW for v in x)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits where that is enough; places of a block are many."""
    return x.astype(np.uint32) if _small(x) else x


def _numbers(index: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers from 1 of up to 64 bits that no two buckets share."""
    return _narrow(index.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1))


def _halves(x: np.ndarray) -> list[np.ndarray]:
    x = x.astype(np.uint64)
    return [x & _LOW, x >> _SHIFT]


def _whole(low: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    return low.astype(np.uint64) if high is None else low.astype(np.uint64) | high.astype(np.uint64) << _SHIFT


def _spread(x: np.ndarray) -> np.ndarray:
    """31 well-mixed bits of each number."""
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _packed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    keys = h.astype(np.uint64)
    keys <<= _SHIFT
    keys |= w.astype(np.uint64, copy=False)
    return keys


def _distinct(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs (h, w), which of the ordered are the first of their kind, and these; as one number where both halves fit into it."""
    first = np.ones(len(h), bool)
    if _small(h, w):
        keys = _packed(h, w)
        order = np.argsort(keys)
        keys = keys[order]
        first[1:] = keys[1:] != keys[:-1]
        keys = keys[first]
        return order, first, keys >> _SHIFT, keys & _LOW
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    first[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return order, first, h[first].astype(np.uint64), w[first].astype(np.uint64)


class _Pairs:
    """Sorted distinct pairs (h, w) that can be searched."""

    def __init__(self, h: np.ndarray, w: np.ndarray):
        self.small = _small(h, w)
        self.h, self.w = (None, None) if self.small else (np.unique(h), np.unique(w))
        self.keys = _packed(h, w) if self.small else self._dense(h, w)[0]

    def _dense(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pairs by the places of their halves, in the same order; and whether both halves are known."""
        i, in_h = _find(self.h, h)
        j, in_w = _find(self.w, w)
        return i.astype(np.uint64) * np.uint64(max(1, len(self.w))) + j.astype(np.uint64), in_h & in_w

    def find(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.small:
            keys, known = self._dense(h, w)
            at, hit = _find(self.keys, keys)
            return at, hit & known
        fits = (h <= _LOW) & (w <= _LOW)  # a wide pair is not in a table of small ones
        at, hit = _find(self.keys, _packed(h & _LOW, w & _LOW))
        return at, hit & fits


class _Walk:
    """All places of a block: p of their words after the longest kept history below the current order (where p is set).

    state: number of the kept n-gram, one word shorter than the next order, that ends at a place, or 0; of: its count.

    The n-grams of a history lie in one part; those of a history that occurs more than `split` times in several, by their word.
    A block that has such a history asks each of its parts, if only for the sums that its weight needs.
    """

    def __init__(self, x: dict, values: dict, buckets: int, parts: int, discount: float, split: int):
        counts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for bucket, value in values.get(1, []):
            four = value.reshape(4, -1)
            counts.append(_whole(*four[:2]).astype(np.int64))
            index = _whole(*four[2:])
            own = _numbers(np.maximum(index, np.uint64(1)) - np.uint64(1), bucket, buckets)
            numbers.append(np.where(index > 0, own, own.dtype.type(0)))
        self.parts, self.discount, self.split = parts, discount, split
        self.of = np.concatenate(counts)[x["ids"]]
        self.word = self.state = np.concatenate(numbers)[x["ids"]]
        self.p = None
        self.inside = np.ones(len(self.word), bool)  # not the first of a text
        self.inside[x["ends"] - x["lengths"]] = False

    def ask(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places with a history; the distinct keys (history, word or 0) in order of part, history and word, and their parts; the key of each place."""
        at = np.flatnonzero(self.inside[1:] & (self.state[:-1] > 0)) + 1
        order, first, h, w = _distinct(self.state[at - 1], self.word[at])
        back = np.empty(len(at), np.int32)
        back[order] = np.cumsum(first, dtype=np.int32) - 1
        of = self.of[at[order[first]] - 1]
        del order, first
        shares = np.minimum(-(-of // self.split), self.parts).astype(np.int64)
        part = _spread(h)
        if (shares > 1).any():
            part += np.where(shares > 1, _spread(w) % np.maximum(shares, 1), 0)
        part %= self.parts
        if (shares > 1).any():
            split, one = np.unique(h[shares > 1], return_index=True)
            n = shares[shares > 1][one]
            also = (np.repeat(_spread(split), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) % self.parts
            h, w, part = np.concatenate([h, np.repeat(split, n)]), np.concatenate([w, np.zeros(len(also), np.uint64)]), np.concatenate([part, also])
            order = np.lexsort((w, h, part))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(part[order]) != 0) | (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
            place = np.empty(len(order), np.int32)
            place[order] = np.cumsum(new, dtype=np.int32) - 1
            order = order[new]
        else:
            order = np.argsort(part, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
        return at, part[order], h[order], w[order], place[back]

    def step(self, values: list[tuple[int, np.ndarray]]) -> None:
        """To the next order. values: (part, answers) as _merge gives them."""
        at, part, h, w, back = self.ask()
        full, starts = np.unique(part, return_index=True)
        sizes = dict(zip(full.tolist(), np.diff(starts, append=len(part)).tolist()))
        count, number, total, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for p, value in values:
            k, body = 2 if value[0] else 1, value[1:]
            cut = 2 * k * sizes[p]
            own, sums = body[:cut].reshape(2, k, -1), body[cut:].reshape(k + 1, -1)
            count.append(_whole(*own[0]))
            number.append(_whole(*own[1]))
            total.append(_whole(*sums[:k]))
            kinds.append(sums[k])
        count, number = np.concatenate(count).astype(np.int64), _narrow(np.concatenate(number))
        if self.p is not None:
            # a history's sums from all its parts
            each = np.ones(len(h), bool)
            each[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
            names, history = np.unique(h, return_inverse=True)
            history = history.astype(np.int32)
            taken = np.bincount(history[each], np.concatenate(total).astype(np.int64) - self.discount * np.concatenate(kinds), len(names))
            of, c = self.of[at - 1], count[back]
            own = np.where(c > 0, np.maximum(c - self.discount, 0), 0) / of
            self.p[at] = own + np.maximum(1 - taken[history[back]] / of, 1e-12) * self.p[at]
        self.state = np.zeros(len(self.word), number.dtype)
        self.of = np.zeros_like(self.of)
        self.state[at], self.of[at] = number[back], count[back]
        self.word = np.where(self.state > 0, self.word, self.word.dtype.type(0))  # a longer n-gram ends with a kept one


def _ask(x: dict | None, values: dict, level: int, buckets: int, parts: int, discount: float, split: int) -> pd.DataFrame:
    """A block's distinct n-grams of one length by part, and how often they occur in its training texts."""
    if x is None:
        return pd.DataFrame({c.split()[0]: [] for c in ASKED.split(", ")})
    walk = _Walk(x, values, buckets, parts, discount, split)
    for k in range(2, level):
        walk.step(values.get(k, []))
    at, part, h, w, back = walk.ask()
    train = np.repeat(x["weight"] == 1, x["lengths"])[at]
    counts = np.bincount(back[train], minlength=len(h))
    full, starts = np.unique(part, return_index=True)
    cuts = [slice(i, j) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(part)])]
    return pd.DataFrame({"block": int(x["block"]), "bucket": full, "keys": [_pack_keys(h[c], w[c]) for c in cuts], "counts": [squeeze(counts[c]) for c in cuts]})


def _pack_keys(h: np.ndarray, w: np.ndarray) -> bytes:
    """Steps of the histories and words; the upper halves only where there are any."""
    steps = np.diff(h, prepend=np.uint64(0))
    wide = not _small(steps, w)
    return squeeze(np.concatenate([[np.uint64(wide)], *(half for x in (steps, w) for half in _halves(x)[: 1 + wide])]))


def _unpack_keys(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = unsqueeze(x)
    if x[0]:
        a, b, c, d = x[1:].reshape(4, -1)
        steps, w = _whole(a, b), _whole(c, d)
    else:
        steps, w = x[1:].reshape(2, -1).astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64), w


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _merge(group: pd.DataFrame, level: int, parts: int, least: int, last: bool) -> pd.DataFrame:
    """One part of the n-grams, of all blocks: each block's n-grams answered.

    An answer: whether numbers have upper halves; counts and numbers of the keys, 0 where not kept; then of each history the sum of
    the counts and the number of its kept n-grams in this part.
    """
    h, w, total = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size = [], 0

    def fold() -> None:
        nonlocal h, w, total
        h, w = (np.concatenate([x, *(k[i] for k in held)]) for i, x in enumerate((h, w)))
        order, first, h, w = _distinct(h, w)
        sums = np.concatenate([total, *(k[2] for k in held)])[order]
        total = np.add.reduceat(sums, np.flatnonzero(first)) if len(sums) else sums

    for packed, counts in zip(group["keys"], group["counts"]):
        (own_h, own_w), c = _unpack_keys(packed), unsqueeze(counts).astype(np.int64)
        ok = (c > 0) & (own_w > 0)
        held.append((own_h[ok], own_w[ok], c[ok]))
        size += int(ok.sum())
        if size > max(2_000_000, len(h)):
            fold()
            held, size = [], 0
    fold()
    part = int(group["bucket"].iloc[0])
    kept = total >= least
    h, w, total = h[kept], w[kept], total[kept]
    numbers = np.zeros(len(h), np.uint32) if last else _numbers(np.arange(len(h)), part, parts)
    histories, starts = np.unique(h, return_index=True)
    sums = np.add.reduceat(total, starts) if len(h) else total
    kinds = np.diff(starts, append=len(h))
    pick = lambda x, at, hit: np.where(hit, x[at], x.dtype.type(0)) if len(x) else np.zeros(len(at), x.dtype)
    table, values = _Pairs(h, w), []
    for packed in group["keys"]:
        own_h, own_w = _unpack_keys(packed)
        at, hit = table.find(own_h, own_w)
        k, there = _find(histories, np.unique(own_h))
        columns = pick(total, at, hit), pick(numbers, at, hit), pick(sums, k, there)
        wide = not _small(*columns)
        values.append(squeeze(np.concatenate([[np.uint64(wide)], *(half for x in columns for half in _halves(x)[: 1 + wide]), pick(kinds, k, there).astype(np.uint64)])))
    out = pd.DataFrame({"block": group["block"], "level": level, "bucket": part, "value": values, "n": 0})
    return pd.concat([out, pd.DataFrame({"block": [-1], "level": [level], "bucket": [part], "value": [b""], "n": [len(h)]})])


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores, model = score(docs, "case when crc32(cast(doc_id as string)) % 7 = 2 then 0 else 1 end")
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
