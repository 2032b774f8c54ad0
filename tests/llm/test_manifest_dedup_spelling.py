"""Merkle manifest, exact duplicates and spelling variants against brute-force versions and their SQL, on odd tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stormshift.llm import exact_dedup, merkle, spelling
from stormshift.llm._shared import work_path
from stormshift.llm.registry import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, h long, word string"
LONG = "Wört nächste " + "sentence without an end " * 900 + "B" * 5000 + ". Then an end. " * 700
TEXTS = [
    None, "", " ", "\n\t", "That it.", "That  it.", "that it.", "a\x0b\x0cb", "a b", "é b", "É Éàß", LONG, LONG.replace("B" * 5000, "B" * 4999 + "C"), LONG,
    "colour color colors colour color colour colours coolour", "color color color abbbc abbbbc abbbc abbbbc abbbc abbbbc abbc", "×÷÷÷× ×÷÷÷×a ×÷÷÷×a ×÷÷÷× ×÷÷÷× ×÷÷÷×a",
]


def rows():
    """Null ids, repeated rows, a null source, a source of one document and one of several hundred."""
    out = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, i if i % 4 else None) for i, t in enumerate(TEXTS)]
    out += [(None, "That it.", None, "s", 3), (None, "That it.", None, "s", 3), (4, "That it.", "en", "s", 4), (900, None, None, "alone", None), (None, None, None, None, None)]
    out += [(1000 + i, f"Text {i % 7} of many", "de", "many", i) for i in range(600)]
    return [(*r, "d", "t", 1, "w") for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plain(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, folder, empty, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    got = plain(df.collect(), df.columns)
    assert got and got == plain(want.fetchall(), columns)
    assert QUERIES[name](spark, empty).isEmpty()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(digests, arity):
    """The top and the chain of (left, right) of each leaf."""
    chains, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, i in enumerate(at):
            run = digests[i // arity * arity : i // arity * arity + arity]
            chains[leaf].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
            at[leaf] = i // arity
        digests = [sha("".join(digests[i : i + arity])) for i in range(0, len(digests), arity)]
    return digests[0], chains


@pytest.mark.parametrize(("arity", "stride"), [(16, 2), (3, 2), (2, 3)])
def test_manifest_against_a_whole_tree(spark, arity, stride):
    docs = [(i, s) for s, n in (("b", 1), ("a", arity), (None, arity + 1), ("c", 83)) for i in range(n)]
    leaves = spark.createDataFrame([(i, s, sha(f"{s}{i}")) for i, s in docs], "doc_id long, source string, digest string").repartition(3)
    m = merkle.write_manifest(leaves, ("doc_id", "digest"), work_path(spark, "m"), arity, stride)
    names = [None, "a", "b", "c"]
    trees = {s: brute_tree([sha(f"{s}{i}") for i, t in docs if t == s], arity) for s in names}
    root, upper = brute_tree([trees[s][0] for s in names], arity)
    assert m.root == root
    want = {sha(f"{s}{i}"): (trees[s][0], [*trees[s][1][i], *upper[names.index(s)]]) for i, s in docs}
    found = m.proofs("doc_id").withColumn("again", merkle.fold(F.col("digest"), F.col("chain")))
    got = {r.digest: (r.subroot, [tuple(x) for x in r.chain], r.again) for r in found.collect()}
    assert {d: x[:2] for d, x in got.items()} == want and {x[2] for x in got.values()} == {root}
    one = m.proofs("doc_id", wanted="doc_id = 80").collect()
    assert [(r.doc_id, r.digest) for r in one] == [(80, sha("c80"))] and [tuple(x) for x in one[0].chain] == want[sha("c80")][1]
    # only every few levels are stored
    depth = max(len(c) for tree in trees.values() for c in tree[1])
    assert len(m.sources.levels) == -(-depth // stride) + 1


def test_damage_shows(spark):
    """A changed field of any kind breaks the proof of its document alone."""
    docs = spark.createDataFrame([(i, "s", "en", 3, f"T{i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    own = [F.col(c) for c in merkle.FIELDS]
    m = merkle.write_manifest(docs.select("doc_id", "source", merkle.leaf(*own).alias("digest")), ("doc_id", "digest"), work_path(spark, "m"))
    for column, value in (("lang", F.lit(None).cast("string")), ("n_chars", F.lit(4)), ("text", F.lower("text"))):
        now = docs.withColumn(column, F.when(F.col("doc_id") == 7, value).otherwise(F.col(column))).select("doc_id", merkle.leaf(*own).alias("now"))
        bad = m.proofs("doc_id").join(now, "doc_id").where(merkle.fold(F.col("now"), F.col("chain")) != m.root).collect()
        assert [r.doc_id for r in bad] == [7]


def brute_normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("collide", [False, True])
def test_exact_duplicates(spark, collide):
    """collide: a hash of five values, so that most chunks share their hash with others."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    how = {"hashed": lambda c: F.pmod(F.xxhash64(c), F.lit(5)), "least": 3, "most": 7} if collide else {}
    groups = collections.defaultdict(list)
    for r in rows():
        groups[brute_normal(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    got = exact_dedup.duplicates(docs, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    if collide:
        assert exact_dedup.recipes(docs, **how).where(F.exists("recipe", lambda x: x["k"] > 0)).count() > 100


def test_chunks_lose_nothing_and_follow_content(spark):
    body = "Some words here. And more of them! " * 400
    texts = [LONG, body, "x" * 10_000, "New start. " + body, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    for r in got:
        assert "".join(r.c) == r.text and all(0 < len(c) <= exact_dedup.MOST for c in r.c)
    by = {r.text: set(r.c) for r in got}
    assert len(by[texts[1]] & by[texts[3]]) >= len(by[texts[1]]) - 2  # cut alike after a shift


def brute_words(table, damage=97):
    counts = collections.Counter()
    for doc, text, *_ in table:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=2):
    near = {w: sorted((x for x in counts if distance_one(w, x)), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: near[w][0] if near[w] and counts[near[w][0]] >= times * counts[w] else None for w in counts}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_word_counts(spark):
    table = [(i, "".join(f" Wörter{chr(97 + k)}x,Łódź" for k in range(12)) * 9, 0) for i in range(30)] + rows()[: len(TEXTS)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in table], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(docs, damage=97).collect()} == brute_words(table)
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == brute_words(table, 0)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 40)
    text = "word " * 50 + "a" * 95 + " and " + "b" * 39 + "," + "longer words follow here " * 9
    got = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(F.explode(spelling.pieces(F.col("text"))).alias("p")).collect()
    assert "".join(r.p or "" for r in got) == text and len(got) > 8
    assert [w for r in got for w in re.findall("[A-Za-z]+", r.p or "")] == re.findall("[A-Za-z]+", text)


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=6), st.integers(3, 40), min_size=1, max_size=60))
def test_variants(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert set(map(tuple, spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(counts)


def test_variants_of_very_long_and_of_chained_words(spark):
    counts = {"a" * 3000: 3, "a" * 2999: 9, "a" * 1500 + "b" + "a" * 1499: 4, "b" * 3000: 3}
    counts |= {"x" * k + "yz": 3 * 2**k for k in range(1, 14)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = set(map(tuple, spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute_variants(counts) and len({r[2] for r in got}) < len(got)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab", max_size=7), min_size=1, max_size=40), st.data())
def test_nodes_are_prefixes_in_any_ranges(words, data):
    """Equal numbers just for equal prefixes, wherever the ranges are cut."""
    words = sorted(words)
    cuts = sorted(data.draw(st.sets(st.integers(1, len(words)), max_size=6)))
    ranges = {p: words[i:j] for p, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(words)])) if words[i:j]}
    shared = spelling.borders([(p, w[0], w[-1]) for p, w in ranges.items()])
    number = {}
    for p, own in ranges.items():
        nodes, sizes = spelling.number_nodes(own, p, *shared[p])
        at = 0
        for w, size in zip(own, sizes.tolist()):
            assert size == len(w) + 1
            for d in range(size):
                assert number.setdefault(w[:d], int(nodes[at + d])) == nodes[at + d]
            at += size
        assert at == len(nodes)
    assert len(set(number.values())) == len(number)
