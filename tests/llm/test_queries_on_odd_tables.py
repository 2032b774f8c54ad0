"""The registered queries themselves, their splits, folds and limits, and the pipeline's stages, on tables with nulls, ties, repeats and clashing names."""

import collections
import math
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from stormshift.llm import mixing  # noqa: E402
from stormshift.llm.registry import QUERIES  # noqa: E402
from test_training_data import BYTE, TEXTS, WORD, _encoder, brute_components, brute_scores, ids_of  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, copy int, _mix string"


def own_rows():
    out = [(i, t, "en" if i % 2 else "fr", ["s", None, "t"][i % 3], i) for i, t in enumerate(TEXTS)]
    out += [(100 + i, f"Words of the {i % 5}th kind, once more and again.", "en", "t", 3) for i in range(60)]
    out += [(300 + i, f"les mots numéro {i % 7} de la même façon où", "fr", "u", 3) for i in range(60)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, 1, 2, "m") for r in own_rows()], DOCUMENTS).repartition(4).write.parquet(f"{path}/documents.parquet")
    draw = np.random.default_rng(1)
    vectors = [(i, draw.normal(size=8).tolist()) for i in range(130)]
    vectors[7] = (7, vectors[20][1])  # equal vectors
    vectors += [(140, None), (160, [0.0] * 8), (180, [1.0, None] + [0.5] * 6), (200, [float("nan")] + [1.0] * 7), (220, [float("inf")] * 8), (None, [1.0] * 8)]
    spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, list string").write.parquet(f"{path}/embeddings.parquet")
    return path, dict(vectors[:130])


def result(spark, folder, name):
    return QUERIES[name](spark, folder[0]).collect()


def test_token_files_and_packing(spark, folder):
    tokens = {d: np.append(ids_of(WORD, t), 2).astype("<u4") for d, t, *_ in own_rows()}
    at = 0
    for r in sorted(result(spark, folder, "op2_token_files")):
        own = tokens[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert at == sum(map(len, tokens.values()))
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in result(spark, folder, "op4_packing"):
        own = tokens[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for own, most in [(pieces, None), (places, 4096)]:
        for key, spans in own.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at <= most if most else at == len(tokens[key])
    assert pieces.keys() == tokens.keys()


def test_token_counts(spark, folder):
    library = _encoder(BYTE, False).library
    got = {r.doc_id: r for r in result(spark, folder, "op5_token_counts")}
    for d, t, *_ in own_rows():
        n = len(library.encode(t or "", add_special_tokens=False))
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert any(r.over_limit for r in got.values())


def test_mixing(spark, folder):
    size = {d: len(_words(t)) for d, t, *_ in own_rows()}
    got = result(spark, folder, "op6_mixing")
    assert len(got) == len(own_rows()) and {r.doc_id for r in got} == {r[0] for r in own_rows()}
    by = collections.defaultdict(list)
    source = {d: s for d, _, _, s, _ in own_rows()}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        by[source[r.doc_id]].append(r)
    for s, own in by.items():
        assert {r.source_size for r in own} == {sum(r.size for r in own)} and len({r.target for r in own}) == 1
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sorted(map(tuple, got)) == sorted(map(tuple, result(spark, folder, "op6_mixing")))


def test_language_id_learns_from_other_folds_alone(spark, folder, tmp_path):
    first = {r.doc_id: r for r in result(spark, folder, "op8_language_id")}
    held = {d for d, *_ in own_rows() if zlib.crc32(str(d).encode()) % 5 == 0}
    assert {d for d, r in first.items() if r.held_out} == held and held
    assert all(r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1 for r in first.values())
    assert all(first[d].lang_pred == "und" for d, t, *_ in own_rows() if not any(map(str.isalpha, t or "")))
    assert all(first[d].lang_pred == ("en" if d < 300 else "fr") for d in first if d >= 100)
    # held-out labels, sources and ids' order change nothing
    rows = [(d, t, "zz" if d in held else lang, "other", n, 1, 2, "m") for d, t, lang, _, n in own_rows()]
    spark.createDataFrame(rows, DOCUMENTS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, str(tmp_path)).collect()}
    assert all(again[d].lang_pred == r.lang_pred and abs(again[d].score - r.score) < 1e-5 for d, r in first.items())


def test_lm_scores(spark, folder):
    rows = [(d, t) for d, t, *_ in own_rows()]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    want = brute_scores(rows, held)
    got = {r.doc_id: r for r in result(spark, folder, "op9_lm_scoring")}
    assert {d for d, r in got.items() if r.held_out} == held and held
    assert all(abs(got[d].score - want[d]) < 1e-6 for d in want) and got.keys() == want.keys()


def test_vector_search(spark, folder):
    vectors = folder[1]
    got = collections.defaultdict(list)
    for r in result(spark, folder, "op10_vector_search"):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:20]
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21)) and [i for _, i, _ in found] == [i for _, i in want]
        assert all(abs(s + w) < 1e-9 for (_, _, s), (w, _) in zip(found, want))


def test_pipeline_stages(spark, folder):
    """What each stage keeps, by brute force; columns of any name stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = [tuple(r) for r in kept.collect()]
        kept = stage(spark, kept, folder[0])
        assert kept.columns == docs.columns
        after = collections.Counter(tuple(r) for r in kept.collect())
        assert after.keys() <= set(before) <= set(rows)
        if name == "language_id":
            assert all(any(map(str.isalpha, r[1] or "")) for r in after) and sum(after.values()) >= 120
        if name == "near_dedup":
            want = brute_components([r[:2] for r in before], 80)
            assert {r[0] for r in after} == {d for d in want if want[d] == d}
        if name == "mixing":
            assert after == brute_mix(spark, before)
    from stormshift.llm._shared import written

    kept = written(kept, "kept")
    copies = collections.Counter(r.doc_id for r in kept.collect())
    total, places = collections.Counter(), collections.defaultdict(list)
    for r in corpus_pipeline.STAGES[3][1](spark, kept, folder[0]).collect():
        total[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    text = {r[0]: r[1] for r in rows}
    assert total == {d: n * (len(ids_of(WORD, text[d])) + 1) for d, n in copies.items()}
    for spans in places.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 4096
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).isEmpty()


def brute_mix(spark, rows):
    """Each row as often as targets, rates and seeded draws say."""
    size = lambda t: len(_words(t))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sizes = spark.createDataFrame([(s, sum(size(r[1]) for r in own)) for s, own in by.items()], "source string, source_size long")
    target = {r.source: r.target for r in mixing.targets(sizes).collect()}
    uniform = lambda d, k: (xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", d), 42)) >> 11) * 2.0**-53
    out = collections.Counter()
    for s, own in by.items():
        whole = sum(size(r[1]) for r in own)
        times, fraction = divmod(target[s] / whole if whole else 0.0, 1)
        seed = min(range(mixing.SEEDS), key=lambda k: (abs(target[s] - times * whole - sum(size(r[1]) for r in own if uniform(r[0], k) < fraction)), k))
        for r in own:
            if n := int(times) + (uniform(r[0], seed) < fraction):
                out[r] += n
    return out


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_base_scores_are_finite(spark, folder):
    assert all(math.isfinite(r.base_score) and r.n_tokens >= 1 for r in result(spark, folder, "op9_lm_scoring"))
