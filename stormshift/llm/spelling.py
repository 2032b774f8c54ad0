r"""Spelling variants: words at edit distance one, found by pairs of trie nodes.

Words and their reversals each make a trie. Its nodes are numbered: a node is a prefix (or a suffix) of some word, so the pair
(node of w[:i], node of w[j:]) stands for the string w[:i] + w[j:] cut at i, in two integers. Two words that share
(prefix, suffix) with one letter skipped in both differ by a replaced letter; a word's pair with a letter skipped that equals
another word's pair with none skipped is a deleted, or inserted, letter. So neighbours meet by equality of integer
pairs, are exact, and are never compared as strings.

No list of pairs of words is made: the words at one pair of nodes differ in one letter, so they are as many as the alphabet at most,
and each takes from them their number and the best one. Of the places where the same letter stands in a row only the first may be
deleted, so that a pair of words meets once.

Tries are numbered in order of their words: a word shares the nodes of its common prefix with the word before it, and adds
the rest. Words are dealt by ranges; where two ranges meet, the nodes that their border shares (a path of one word) get
names that both sides derive from it. Work and memory grow with the letters, not with their square.

Edge cases: null or empty text has no words; a null doc_id is an empty one in the damage's checksum; a word of any length
is one row of two integers a letter; of equal counts the smaller word wins; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._shared import partitions, table, written
from stormshift.llm._sql import crc32_table, crc32_text

LETTERS = "A-Za-zÀ-ÿ"
#: Code points from which a text is cut before its words are listed, so that no list of words is much larger.
PIECE = 1_000_000
#: Bits of a node's or a word's number below its range's.
BITS = 44
SHARED = 1 << (BITS - 1)


def runs(text: Column) -> Column:
    """Maximal runs of letters, as an array; for texts of at most a few PIECEs."""
    return F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+"), F.lit(0))


def pieces(text: Column) -> Column:
    """A long text in pieces that cut no run of letters."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}(?![{LETTERS}])|.+"), F.lit(0))
    return F.when(F.length(text) > PIECE, cut).otherwise(F.array(text))


def lower(word: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def damaged(doc: Column, word: Column, every: int = 97) -> Column:
    """The word, or one of `every` without a letter, by a checksum of document and word."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(docs: DataFrame, damage: int | None = None, least_length: int = 5, least: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: lower-cased runs of letters of at least least_length code points that occur `least` times."""
    parts = docs.select(F.col(id_column).alias("doc"), F.explode(pieces(F.col(text_column))).alias("part"))
    words = parts.select("doc", F.explode(runs(F.col("part"))).alias("word")).select("doc", lower(F.col("word")).alias("word"))
    word = damaged(F.col("doc"), F.col("word"), damage) if damage else F.col("word")
    words = words.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _dealt(df: DataFrame, name: str, *order) -> DataFrame:
    """df written in ranges of an order, with `_p`, the range, and `_r`, the place in it."""
    df = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return written(df.select("*", F.spark_partition_id().cast("long").alias("_p"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("_r")), name)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 32:  # halves, for long words
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    while a[low] == b[low]:
        low += 1
    return low


def borders(ends: list[tuple[int, str, str]]) -> dict[int, tuple[list[int], list[int]]]:
    """(range, first word, last word) -> range -> numbers of the nodes on the path that it shares with the range before, and after.

    A shared node belongs to the first range that has it, and is numbered there by its depth: of one range only the last
    word's path is shared with later ones.
    """
    ends = sorted(ends)
    before: dict[int, list[int]] = {}
    for k, (p, first, _) in enumerate(ends):
        q, own = ends[k - 1][0] if k else p, []
        if k:
            earlier, whole = before[q], _common(ends[k - 1][1], first)
            depth = _common(ends[k - 1][2], first)
            # what the range before shares with its own past, on this path, keeps its number
            own = [earlier[d] if d < min(len(earlier), whole) else (q << BITS) | SHARED | (d + 1) for d in range(depth)]
        before[p] = own
    after = {ends[k - 1][0]: before[p] for k, (p, *_) in enumerate(ends) if k}
    return {p: (before[p], after.get(p, [])) for p, *_ in ends}


def number_nodes(words: list[str], p: int, before: list[int], after: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of all prefixes of sorted distinct words, from the empty one (0) on, one word after another; and their numbers per word."""
    out, sizes = [], np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    last, previous, fresh = words[-1], None, p << BITS
    path = [0, *before]
    for w in words:
        keep = len(before) if previous is None else _common(previous, w)
        del path[keep + 1 :]
        if after and w[:1] == last[:1]:
            path.extend(after[keep : min(len(after), _common(w, last))])
        for _ in range(len(w) + 1 - len(path)):
            fresh += 1
            path.append(fresh)
        out.extend(path)
        previous = w
    return np.array(out, np.int64), sizes


def trie_nodes(words: DataFrame, column: str) -> DataFrame:
    """words(id, <column>), distinct -> id, nodes: the numbers of all prefixes of the column in the trie of all of them."""
    dealt = _dealt(words.select("id", F.col(column).alias("w")), "trie-ranges", "w")
    ends = dealt.groupBy("_p").agg(F.min("w"), F.max("w")).collect()  # two words for each range
    shared = borders([(r[0], r[1], r[2]) for r in ends])

    def number(group: pa.Table) -> pa.Table:
        group = group.sort_by("_r")
        p = group.column("_p")[0].as_py()
        nodes, sizes = number_nodes(group.column("w").to_pylist(), p, *shared[p])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.table({"id": group.column("id"), "nodes": pa.ListArray.from_arrays(offsets, nodes)})

    return dealt.groupBy("_p").applyInArrow(number, "id long, nodes array<long>")


def neighbours(words: DataFrame) -> DataFrame:
    """words(id, word), distinct, ids in order of preference -> id, n_near, best: how many words are at distance one, and the smallest id among them.

    best is given only where it is smaller than the word's own id; words without such a neighbour have null, those
    without any neighbour no row.
    """
    back = words.select("id", F.reverse("word").alias("back"))
    both = words.join(trie_nodes(words, "word").withColumnRenamed("nodes", "p"), "id").join(trie_nodes(back, "back").withColumnRenamed("nodes", "s"), "id")
    # kind 2: nothing skipped; 1: a letter skipped; 0: the same, but the letter repeats the one before
    keys = """explode(concat(
        transform(sequence(0, length(word)), i -> named_struct('p', p[i], 's', s[length(word) - i], 'kind', 2)),
        transform(sequence(0, length(word) - 1), i -> named_struct('p', p[i], 's', s[length(word) - i - 1],
            'kind', if(i > 0 and substr(word, i, 1) = substr(word, i + 1, 1), 0, 1)))))"""
    at = both.select("id", F.expr(keys).alias("k")).select("id", "k.*")
    w = Window.partitionBy("p", "s")  # as many words as there are letters at most, and one more
    skipped, first = F.col("kind") < 2, F.col("kind") == 1
    at = at.withColumns({
        "all": F.count("*").over(w), "skips": F.count_if(skipped).over(w), "firsts": F.count_if(first).over(w),
        "best_skip": F.min(F.when(skipped, F.col("id"))).over(w), "best_first": F.min(F.when(first, F.col("id"))).over(w), "whole": F.min(F.when(F.col("kind") == 2, F.col("id"))).over(w),
    }).where("all > 1")
    near = F.when(skipped, F.col("skips") - 1 + (first & F.col("whole").isNotNull()).cast("int")).otherwise(F.col("firsts"))
    best = F.when(skipped, F.least("best_skip", F.when(first, F.col("whole")))).otherwise(F.col("best_first"))
    found = at.select("id", near.alias("near"), F.when(best < F.col("id"), best).alias("best"))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).where("n_near > 0")


def roots(links: DataFrame) -> DataFrame:
    """links(id, to) without circles -> id, root: each pointer doubled until none moves, so rounds grow with the logarithm of the longest path."""
    links = written(links.select("id", F.col("to").alias("root")), "forms")
    while True:
        further = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if links.join(further, "root", "left_semi").isEmpty():
            return links
        links = written(links.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")


def variants(counts: DataFrame, times: int = 2) -> DataFrame:
    """counts(word, n) -> word, form, root, n, n_near, form_n. form: the near word of largest n if that is `times` the word's at least."""
    # ids in order of preference: larger counts first, then smaller words
    words = _dealt(counts.select("word", "n"), "spelling-words", F.desc("n"), F.asc("word"))
    words = written(words.select((F.col("_p") * 2**BITS + F.col("_r")).alias("id"), "word", "n"), "spelling-ids")
    near = written(neighbours(words.select("id", "word")), "spelling-near")
    at = lambda name, n: words.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"), *([F.col("n").alias("form_n")] if n else []))
    best = near.where("best is not null").join(words.select("id", "n"), "id").join(at("best", True), "best").where(F.col("form_n") >= times * F.col("n"))
    best = written(best.select("id", F.col("best").alias("to"), F.col("best_word").alias("form"), "form_n"), "spelling-forms")
    ends = roots(best).join(at("root", False), "root").select("id", F.col("root_word").alias("root"))
    out = words.join(near.select("id", "n_near"), "id", "left").join(best.drop("to"), "id", "left").join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(count_words(table(spark, sf_dir, "documents"), damage=97), "spelling-counts"))


ORACLE = f"""
WITH RECURSIVE {crc32_table()},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
keyed AS MATERIALIZED (SELECT w, {crc32_text("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs, crc_table),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word FROM keyed),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT word, n, a || b AS rest FROM cuts),
near AS (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON w.word = s.rest UNION ALL SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON w.word = s.rest),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk(word, root) AS (SELECT word, coalesce(form, word) FROM formed UNION SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT k.* FROM walk k JOIN formed e ON e.word = k.root WHERE e.form IS NULL) k ON k.word = f.word
"""
