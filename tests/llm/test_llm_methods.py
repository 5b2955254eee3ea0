"""The parts of the methods against plain answers."""

import bisect
import itertools
import random

import brute
import numpy as np
import pytest
from cases import frame, words
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm.components import components
from touchline.llm.decontamination import decontaminate
from touchline.llm.jaccard_join import Block, block_links, least_overlap, prefix_length
from touchline.llm.language_id import CLASSES, class_table, classes, language_id, phrases, suffix_automaton
from touchline.llm.license_scan import license_scan
from touchline.llm.packing import optimal_bounds
from touchline.llm.quality_classifier import Logistic, co_train
from touchline.llm.quality_rules import quality_rules
from touchline.llm.secret_scan import secret_scan
from touchline.llm.suffix_dedup import remove_repeats
from touchline.llm.suffix_merge import LoserTree, common_prefix, front_code, read_run
from touchline.llm.token_counts import count_piece, load_ranks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=6))
def test_loser_tree_merges_runs_and_knows_prefixes(sets):
    runs = [sorted(s) for s in sets]
    coded = [front_code(r, [[(i, j)] for j in range(len(r))]) for i, r in enumerate(runs)]
    got = list(LoserTree(read_run(b) for b in coded))
    assert [s for s, _, _ in got] == sorted(itertools.chain(*runs))
    for (a, _, _), (b, lcp, _) in itertools.pairwise(got):
        assert lcp == common_prefix(a, b, 0)
    assert sorted(o for _, _, own in got for o in own) == sorted((i, j) for i, r in enumerate(runs) for j in range(len(r)))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=2, max_size=14))
def test_t_occurrence_finds_all_and_only_similar_sets(sets):
    block = Block([np.array(sorted(s), np.uint64) for s in sets], 80)
    similar = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    for i, s in enumerate(sets):
        assert block.search(i, np.ones(len(sets), bool)) == [j for j, o in enumerate(sets) if j != i and similar(s, o)]
    assert parts(len(sets), block_links([np.array(sorted(s), np.uint64) for s in sets], 80)) == parts(len(sets), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if similar(sets[i], sets[j])])


def parts(n, links):
    comp = list(range(n))
    for i, j in links:
        comp = [comp[i] if c == comp[j] else c for c in comp]
    return {frozenset(k for k in range(n) if comp[k] == c) for c in comp}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 30), min_size=1), st.sets(st.integers(0, 30), min_size=1))
def test_similar_sets_share_a_prefix_token(a, b):
    if 100 * len(a & b) >= 80 * len(a | b):
        assert set(sorted(a)[: prefix_length(len(a), 80)]) & set(sorted(b)[: prefix_length(len(b), 80)])
        assert len(a & b) >= least_overlap(len(a), len(b), 80)


def test_components_of_a_path_and_of_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (None, 3)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}
    assert components(links.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), min_size=1, max_size=7), st.integers(1, 4))
def test_optimal_bounds_have_the_least_padding(histogram, k):
    def padding(bounds):
        return sum((bounds[bisect.bisect_left(bounds, x)] - x) * c for x, c in histogram.items())

    lengths = sorted(histogram)
    tops = itertools.chain.from_iterable(itertools.combinations(lengths[:-1], n) for n in range(min(k, len(lengths))))
    bounds = optimal_bounds(histogram, k)
    assert len(bounds) <= k and bounds[-1] == lengths[-1]
    assert padding(bounds) == min(padding([*t, lengths[-1]]) for t in tops)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=30), st.lists(st.integers(0, 4), min_size=1, max_size=40))
def test_cross_parsing_takes_longest_known_pieces(sample, text):
    model = {"flat": suffix_automaton(np.array(sample, np.uint8)).ravel(), "offsets": np.zeros((1, 1), np.int64)}
    joined = bytes(sample)
    n, i = 0, 0
    while i < len(text):
        size = 1
        while i + size < len(text) and bytes(text[i : i + size + 1]) in joined and bytes(text[i : i + 1]) in joined:
            size += 1
        n, i = n + 1, i + size
    assert phrases([np.array(text, np.uint8)], model)[0, 0] == n
    assert CLASSES > 4


def test_language_accuracy_on_held_out_rows(spark):
    r = random.Random(1)
    rows = [(i, words(r, 40, {"aa": "abcdeäö", "bb": "efghabé", "cc": "klmnab"}[lang]), lang, "s") for i in range(300) for lang in [r.choice(["aa", "bb", "cc"])]]
    truth = {d: lang for d, _, lang, _ in rows}
    got = [x for x in language_id(frame(spark, rows)).collect() if x.held_out]
    assert len(got) > 30 and sum(truth[x.doc_id] == x.lang_pred for x in got) >= 0.95 * len(got)


def test_languages_of_long_or_mostly_empty_texts_are_learned(spark):
    r = random.Random(6)
    alphabets = {"aa": "abcdefgh", "long": "klmnopqr", "gaps": "stuvwxyz"}
    rows = [(i, words(r, 40, alphabets["aa"]), "aa", "s") for i in range(60)]
    rows += [(100 + i, "7 " * 11_000 + words(r, 6_000, alphabets["long"]), "long", "s") for i in range(30)]
    rows += [(1000 + i, words(r, 40, alphabets["gaps"]) if i % 20 == 0 else ["", None, "12 ..."][i % 3], "gaps", "s") for i in range(600)]
    truth = {d: (t, lang) for d, t, lang, _ in rows}
    for x in language_id(frame(spark, rows)).collect():
        text, lang = truth[x.doc_id]
        assert x.lang_pred == (lang if any(map(str.isalpha, text or "")) else "und")


def test_letters_of_many_scripts_stay_apart(spark):
    r = random.Random(7)
    first = "".join(chr(0x4E00 + 32 * i) for i in range(40))
    alphabets = {"latin": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyril": "абвгдежзийклмнопрстуфхцчш", "one": first, "two": "".join(chr(ord(c) + 32 * 40) for c in first)}
    rows = [(i, words(r, 40, alphabets[lang]), lang, "s") for i in range(400) for lang in [r.choice(list(alphabets))]]
    truth = {d: lang for d, _, lang, _ in rows}
    table = class_table({lang: [a * 3] for lang, a in alphabets.items()})
    letters = "".join(alphabets.values())
    assert len({classes(c, table).tobytes() for c in letters}) == len(letters)
    assert all(x.lang_pred == truth[x.doc_id] for x in language_id(frame(spark, rows)).collect())


def test_counts_equal_the_tokenizer_library():
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    model, (rights, made, special) = tokenizers.Tokenizer.from_file(vocabulary), load_ranks(vocabulary)
    assert special == ["<|endoftext|>"]
    r = random.Random(5)
    for _ in range(400):
        word = "".join(r.choice("etaoinshrdluéß漢") for _ in range(r.randint(1, 40)))
        assert count_piece(word.encode(), rights, made) == len(model.encode(word).ids)


def test_random_repeats_equal_brute_force(spark):
    r = random.Random(8)
    pieces = ["".join(r.choice("ab") for _ in range(r.choice([150, 199, 200, 201, 260, 700]))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pieces) if r.random() < 0.6 else words(r, 20) for _ in range(r.randint(1, 6))), "aa", "s") for i in range(60)]
    rows += [(100, "z" * 1000, "aa", "s"), (101, "é" * 300, "aa", "s"), (102, rows[3][1][5:-5], "aa", "s")]
    got = sorted(tuple(x)[:5] for x in remove_repeats(frame(spark, rows)).drop("spans").collect())
    assert got == sorted(brute.repeats([(d, t) for d, t, *_ in rows]))


def test_borders_between_ranges_lose_nothing(spark, monkeypatch):
    from touchline.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PER_RANGE", 3)
    r = random.Random(9)
    shared = words(r, 60)
    rows = [(i, words(r, 10) + shared[: r.randint(210, len(shared))] + words(r, 10), "aa", "s") for i in range(50)]
    got = sorted(tuple(x)[:5] for x in remove_repeats(frame(spark, rows)).drop("spans").collect())
    assert got == sorted(brute.repeats([(d, t) for d, t, *_ in rows]))


def test_notices_add_labels_and_edits_are_tolerated(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3.", None, None), (2, "All rights reserved.", None, None), (3, "Permission is hereby granted, entirely free of charge, to any person obtaining a copy of this software", None, None)]
    got = {x.doc_id: x.labels for x in license_scan(frame(spark, rows)).collect()}
    assert got == {1: "gpl,gpl-3.0", 2: "all-rights-reserved", 3: "mit-text"}


def test_markov_models_find_random_tokens_and_spare_words(spark):
    r = random.Random(2)
    secret = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"{words(r, 40, 'etaoinshr')} password={secret(24)} interoperability-specification", "aa", "s") for i in range(60)]
    rows += [(100, f"here is {secret(32)} alone", "aa", "s"), (101, "an-ordinary-hyphenated-identifier-stays", "aa", "s")]
    got = {x.doc_id: x.n_markov for x in secret_scan(frame(spark, rows)).collect()}
    assert got[100] == 1 and got[101] == 0


def test_a_failing_host_is_rejected_and_copies_do_not_condemn_one(spark):
    r = random.Random(3)
    good = [(i, words(r, 80), "aa", "good") for i in range(40)]
    bad = [(100 + i, words(r, 5), "aa", "bad") for i in range(60)] + [(200, words(r, 80), "aa", "bad")]
    copies = [(300 + i, "short copy", "aa", "good") for i in range(300)]
    got = {x.doc_id: x.kept for x in quality_rules(frame(spark, good + bad + copies)).collect()}
    assert all(got[i] for i in range(40)) and not got[200] and not got[300]


def test_slots_must_stand_for_one_value_each(spark):
    item = "what is the total price when Alice buys 12 apples for 3 euros and Bob buys 12 pears for 7 euros each day of the week"
    rows = [
        (1, "Intro text. " + item.replace("12", "15").replace("Alice", "Carol") + " More.", "aa", "s"),
        (2, item.replace("12 apples", "15 apples"), "aa", "s"),  # 12 would stand for 15 and for 12
        (3, "nothing of the sort is written here and it has many words that go on", "aa", "s"),
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: x.contaminated for x in decontaminate(frame(spark, rows), bench).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_items_of_numbers_names_and_units_are_found(spark):
    items = [
        "John Smith met Mary Jones in Paris on 4 May 2020. How old was Mary Jones on 1 June 2021?", "What is 12 + 47 - 3 + 8 + 15 - 2 + 9?",
        "A train travels 120 km in 2 hours and 90 km in 1 hour. What is its speed in km h?", "WHO WAS THE FIRST KING OF THE OLD NORTHERN LANDS AND WHEN DID HE LIVE THERE",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"some words before it. {x} and some after", "aa", "s") for i, x in enumerate(items)]
    rows += [(10 + i, x.lower(), "aa", "s") for i, x in enumerate(items)]
    rows += [(20, items[2].replace("120", "240").replace("90", "70"), "aa", "s"), (30, "What is 1 + 2 - 3 + 4?", "aa", "s"), (31, "Anna Bell met Carl Dorn in Rome on 5 May 2021 and that was all", "aa", "s")]
    got = {x.doc_id: (x.contaminated, x.item) for x in decontaminate(frame(spark, rows), bench).collect()}
    assert got == {**{i: (True, i) for i in range(4)}, **{10 + i: (True, i) for i in range(4)}, 20: (True, 2), 30: (False, None), 31: (False, None)}


def test_one_inconsistent_slot_does_not_hide_the_rest(spark):
    long = "we ask how many red boxes are left on the old table after the boy takes 12 boxes and"
    item = f"{long} gives 12 of them to the girl who waits at the door of the house"
    rows = [(1, item.replace("gives 12", "gives 15"), "aa", "s")]
    got = decontaminate(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(x.contaminated, x.windows) for x in got] == [(True, 15)]


def test_co_training_beats_the_prior_with_few_labels():
    r = np.random.default_rng(0)
    y = (r.random(1200) < 0.6).astype(float)
    views = [y[:, None] * 2 + r.normal(size=(1200, 3)), y[:, None] * 2 + r.normal(size=(1200, 2))]
    models = co_train([v[:60] for v in views], y[:60], [v[60:1000] for v in views])
    odds = sum(cal.logit(m.logit(v[1000:])[:, None]) for (m, cal), v in zip(models, views, strict=True))
    assert ((odds > 0) == (y[1000:] > 0)).mean() > 0.9
    assert np.allclose(Logistic(views[0], y).logit(views[0][:1]).shape, (1,))


def test_families_of_several_blocks_lose_no_link(spark, monkeypatch):
    from touchline.llm import jaccard_join as J

    for name, value in (("BLOCK", 3), ("SHORT_LIST", 2), ("ROUNDS", 2)):
        monkeypatch.setattr(J, name, value)
    r = random.Random(4)
    base = [words(r, 100).split() for _ in range(3)]
    rows = []
    for i in range(45):
        own = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = f"w{i}x{r.random()}"
        rows.append((i, " ".join(own), "aa", "s"))
    want = brute.jaccard_components([(d, t) for d, t, *_ in rows])
    assert len({low for _, low in want.values()}) > 3
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_join(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("block", [3, 4096])
def test_every_document_counts_its_links(spark, monkeypatch, block):
    from touchline.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK", block)
    r = random.Random(11)
    base, rows = words(r, 90).split(), []
    for i in range(60):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = f"w{i}x{r.random()}"
        rows.append((i, " ".join(own), "aa", "s"))
    rows += [(100, rows[5][1], "aa", "s"), (101, rows[5][1].upper(), "aa", "s"), (102, "alone in here", "aa", "s"), (103, "", "aa", "s"), (104, None, "aa", "s")]
    sets = [brute.shingles(t) for _, t, *_ in rows]
    similar = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    want = {d: (sum(similar(sets[i], o) for j, o in enumerate(sets) if j != i), min(rows[j][0] for j, o in enumerate(sets) if j == i or (o and o == sets[i]))) for i, (d, *_) in enumerate(rows)}
    assert sum(n for n, _ in want.values()) > 200
    assert {x.doc_id: (x.n_links, x.class_id) for x in J.jaccard_join(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("unit", ["ab-", "a/", "1_", "A1", "k=v;", "# "])
def test_long_structured_tokens_break_no_operator(spark, unit):
    """A token of a million signs in many parts; every operator that uses patterns reads it whole."""
    from touchline.llm.language_id import language_id
    from touchline.llm.license_scan import license_scan
    from touchline.llm.packing import pack
    from touchline.llm.quality_rules import quality_rules

    long = unit * (1_000_000 // len(unit))
    docs = frame(spark, [(1, 'password = "abcdefgh12" ' + long, "aa", "s"), (2, long, "aa", "s"), (3, "plain words in a text", "aa", "s")])
    got = {r.doc_id: r for r in secret_scan(docs).collect()}
    assert got[1].n_assign == 1 and len(got) == 3
    for fn in (quality_rules, license_scan, language_id, pack):
        assert fn(docs).select("doc_id").distinct().count() == 3


def test_markov_spans_of_planted_tokens(spark):
    """Random tokens outside the patterns, planted into the given documents; documents without one stay clean."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    r = random.Random(8)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    planted = {}
    for i in range(0, len(rows), 10):
        d, text, lang, source = rows[i]
        token = "".join(r.choice(signs) for _ in range(r.randint(24, 40)))
        at = len(text or "")
        rows[i] = (d, f"{text or ''} {token} end", lang, source)
        planted[d] = f"markov:{at + 1}:{at + 1 + len(token)}"
    got = {x.doc_id: x.spans.split(",") if x.spans else [] for x in secret_scan(frame(spark, rows)).collect()}
    caught = sum(span in got[d] for d, span in planted.items())
    wrong = sum(s.startswith("markov") for d, spans in got.items() for s in spans if s != planted.get(d))
    assert caught >= 0.95 * len(planted), (caught, len(planted))
    assert wrong <= 0.02 * len(planted), wrong


def test_hosts_are_judged_by_every_rule(spark):
    """Documents that pass the base rule: one host of symbol spam, one of repeated lines, one of single signs, one clean."""
    r = random.Random(6)
    text = {
        "spam": lambda: " ".join(w + "##" for w in words(r, 60).split()),
        "lines": lambda: "\n".join([words(r, 30)] + [words(r, 30)] * 3 + ["the very same line"] * 6 + [words(r, 5)]),
        "signs": lambda: " ".join(r.choice("abcdefghijklmnop") for _ in range(70)),
        "clean": lambda: words(r, 80),
    }
    rows = [(i, text[host](), "aa", host) for i, host in enumerate(h for h in text for _ in range(40))]
    got = {}
    for x, (_, _, _, host) in zip(sorted(quality_rules(frame(spark, rows)).collect(), key=lambda x: x.doc_id), rows, strict=True):
        got.setdefault(host, set()).add((x.kept, x.host_rejected, x.worst_rule))
    assert got["clean"] == {(True, False, next(iter(got["clean"]))[2])}
    assert got["spam"] == {(False, True, "symbols")} and got["lines"] <= {(False, True, "repeated_lines"), (False, True, "base")}
    assert {(k, j) for k, j, _ in got["signs"]} == {(False, True)}


def test_a_benchmark_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    from cases import messy

    from touchline.llm import decontamination

    bench = spark.createDataFrame([(1, messy()[6][1]), (2, "eins zwei drei vier"), (3, None)], "item_id long, text string")
    docs = frame(spark)
    rows = lambda df: sorted(map(repr, df.collect()))
    small = rows(decontaminate(docs, bench))
    monkeypatch.setattr(decontamination, "SMALL", -1)
    assert rows(decontaminate(docs, bench)) == small and "contaminated=True" in "".join(small)
