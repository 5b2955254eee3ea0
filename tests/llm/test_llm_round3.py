"""Codec, trie and clustering over awkward rows, against the library and plain Python."""

import hashlib
import random

import brute_round3 as brute
import numpy as np
import pytest
from cases import frame, messy
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.llm.orchard import Orchard, cluster_vectors, inertia
from touchline.llm.prefix_trie import PerfectHash, node_turns, ordered, prefix_trie, share_beginnings, turn_rows
from touchline.llm.sentencepiece_codec import Words, decode, decode_ids, encode, encode_text, load, remerge

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
WORDS = Words(load(MODEL))
COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# ---------------------------------------------------------------- codec


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\r▁abeinrst.,;()<>{}"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_codec_equals_the_library(text):
    ids = LIBRARY.encode(text, add_eos=True)
    assert encode_text(text, WORDS) == ids
    assert decode_ids(ids, WORDS.model) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert decode_ids(ids, WORDS.model) == LIBRARY.decode(ids)


def test_pieces_side_by_side():
    r = random.Random(5)
    pieces = list(WORDS.model.ids)
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 10))).replace("▁", " ")
        assert encode_text(text, WORDS, end=False) == LIBRARY.encode(text), text


def test_long_words_step_back_without_leaving_a_place_twice():
    for text in ("ab-" * 60_000, "a/" * 60_000, " " * 70_000, "1_" * 50_000, "aaaaab" * 20_000):
        assert encode_text(text, WORDS) == LIBRARY.encode(text, add_eos=True)


def test_backtracking_equals_merging():
    scores = {p: s for p, s in WORDS.model.scores.items() if len(p) <= 4}
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("thesinarto▁") for _ in range(r.randint(1, 30)))
        assert WORDS.split(text) == remerge(text, WORDS.model.scores)
        assert "".join(remerge(text, scores)) == text


def test_codec_on_awkward_documents(spark):
    docs = frame(spark).repartition(3)
    got = encode(docs, MODEL, decoded=True)
    want = sorted((repr(d), LIBRARY.encode(t or "", add_eos=True), LIBRARY.decode(LIBRARY.encode(t or ""))) for d, t, *_ in messy())
    assert sorted((repr(r.doc_id), r.ids, r.decoded) for r in got.collect()) == want
    again = decode(got, MODEL)
    assert sorted((repr(r.doc_id), r.text) for r in again.collect()) == sorted((d, t) for d, _, t in want)
    assert encode(docs.limit(0), MODEL).count() == 0 and decode(got.limit(0), MODEL).count() == 0
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), MODEL).where("text = ''").count() == 2
    assert {r.ids[-1] for r in encode(docs, MODEL, end=False).where(F.size("ids") > 0).collect()} != {2}


# ---------------------------------------------------------------- trie


def conversations(seed, n=60, long=0, copies=0):
    """Rows with shared beginnings, repeated rows, shared and null turn numbers, null and empty roles and texts."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 7)):
            rows.append((c, t if r.random() < 0.9 else r.choice([None, 2]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "ç漢", "", None, "x" * 50])))
            if r.random() < 0.1:
                rows.append(rows[-1])
    rows += [(n + 5, t, "user", f"t{t % 3}") for t in range(long)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(copies) for t in range(4)]
    return rows + [(None, 0, "user", "nobody"), (-7, 3, None, None)]


def conv_frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, conv long, digest string, bytes string, depth int, number int, part int, n int, shard int"
    return spark.createDataFrame([(*r, 1, "d", "b", 2, 3, 4, 5, 6) for r in rows], schema).repartition(5)


def trie_of(df, **more):
    turns, convs = share_beginnings(turn_rows(df), 5, 9)
    return sorted((tuple(r) for r in prefix_trie(turns, convs, **more).select(*COLS).collect()))


@pytest.mark.parametrize(("weight", "top"), [(None, 500_000), (1, 500_000), (6, 0), (10**6, 500_000)])
def test_trie_equals_brute_force(spark, weight, top):
    rows = conversations(1, long=150, copies=30)
    assert trie_of(conv_frame(spark, rows), weight=weight, top=top) == brute.trie(brute.rebuilt(rows))


def test_trie_without_sharing_and_its_texts(spark):
    rows = [r for r in conversations(2) if r[0] is not None]
    df = conv_frame(spark, rows)
    got = prefix_trie(turn_rows(df))
    assert got.agg(F.max("n_convs")).first()[0] == len({r[0] for r in rows})
    texts = node_turns(got, df).where("depth > 0").collect()
    known = {(r[0], r[2] or "", r[3] or "") for r in rows}
    assert texts and all((r.conv_id, r.role, r.text) in known for r in texts)


def test_empty_tries(spark):
    none = conv_frame(spark, [(1, 1, "a", "b")]).limit(0)
    assert trie_of(none) == []
    only = spark.createDataFrame([(4,), (9,), (None,), (4,)], "conv long")
    got = prefix_trie(turn_rows(none), only).select(*COLS).collect()
    assert [tuple(r) for r in got] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,9").hexdigest())]


def test_one_conversation_over_many_sort_partitions(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (1, 2) for t in range(400)] + [(3, 5, "user", "same")] * 300
    got = ordered(turn_rows(conv_frame(spark, rows).repartition(9)))
    by = {}
    for r in got.collect():
        by.setdefault(r.conv, []).append((r.number, r.s0, r.q0, r.s3))
    assert [len(by[c]) for c in (1, 2, 3)] == [400, 400, 300]
    assert sorted(by[1]) == sorted(by[2])
    for v in by.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and all(a[1] == b[2] for a, b in zip(v, v[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300), st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)))
def test_perfect_hash(keys, other):
    hi, lo = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    names = PerfectHash(hi, lo)
    assert sorted(names.slots(hi, lo).tolist()) == list(range(len(keys)))
    found = names.slots(np.array([other[0]], np.uint64), np.array([other[1]], np.uint64))[0]
    assert (found >= 0) == (other in keys)


def test_perfect_hash_refuses_equal_keys():
    same = np.array([7, 7], np.uint64)
    with pytest.raises(ValueError):
        PerfectHash(same, same)


# ---------------------------------------------------------------- clustering


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 40), st.integers(1, 3), st.integers(0, 2**31), st.integers(1, 5))
def test_orchard_finds_the_nearest_with_ties(k, n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    cents = rng.integers(-spread, spread + 1, (k, dims)).tolist()
    x = rng.integers(-spread, spread + 1, (n, dims))
    now, near = Orchard(cents).nearest(x)
    for v, j, d in zip(x.tolist(), now.tolist(), near.tolist(), strict=True):
        assert (d, j) == min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cents))


def vectors(seed, n, dims=4):
    r = random.Random(seed)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, r.gauss(0, 1)]) for _ in range(dims)]) for i in range(n)]
    rows += rows[:3] + [(None, [0.1] * dims), (None, None), (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1))]
    return rows + [(904, [float("nan")] * dims), (905, [float("inf")] + [0.0] * (dims - 1)), (906, [None] + [0.0] * (dims - 1)), (907, [-0.001] * dims)]


def run_clusters(spark, rows, k, rounds, kind="float"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, id int, cluster string").repartition(3)
    found, centroids = cluster_vectors(df, k=k, rounds=rounds, dims=4, scale=256, salt="2:")
    cols = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in inertia(found, centroids).select(*cols).collect()), key=repr)


@pytest.mark.parametrize(("n", "k", "rounds"), [(200, 7, 4), (5, 12, 3), (40, 1, 2), (30, 6, 0)])
def test_clusters_equal_brute_force(spark, n, k, rounds):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(n, n)]
    assert run_clusters(spark, rows, k, rounds) == brute.clusters(rows, k, rounds, 4)


def test_huge_components_and_empty_tables(spark):
    rows = [(1, [1e9, 0.0, 0.0, 0.0]), (2, [-1e9, 1.0, 0.0, 0.0]), (3, [1e300, 0.0, 0.0, 0.0]), (4, [1e9, 5.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0, 0.5])]
    want = [tuple(None if isinstance(x, int) and x > 2**63 - 1 else x for x in r) for r in brute.clusters(rows, 2, 3, 4)]
    assert run_clusters(spark, rows, 2, 3, "double") == want
    assert run_clusters(spark, vectors(1, 0)[-7:-2], 3, 2) == []
