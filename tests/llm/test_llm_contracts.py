"""Every operator over awkward rows and over an empty table, against plain Python where there is an answer."""

from collections import Counter

import brute
import pytest
from cases import frame, messy

from touchline.llm.decontamination import decontaminate
from touchline.llm.jaccard_join import jaccard_join
from touchline.llm.language_id import language_id
from touchline.llm.license_scan import license_scan
from touchline.llm.packing import pack
from touchline.llm.quality_classifier import quality_classifier
from touchline.llm.quality_rules import quality_rules
from touchline.llm.secret_scan import secret_scan
from touchline.llm.suffix_dedup import remove_repeats
from touchline.llm.token_counts import token_counts

tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 1, 0), (5, 1, 0), (12, 0, 0), (13, 0, 0), (19, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, messy()[6][1]), (2, None), (3, ""), (4, "two words"), (4, "two words")], "item_id long, text string")


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def expected(fn):
    return Counter((d, *fn(t)) for d, t, *_ in messy())


def test_license_scan(docs):
    assert rows_of(license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected(brute.licenses)


def test_quality_rules(docs):
    got = quality_rules(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected(brute.quality)
    assert got.where("base_failed and kept").count() == 0


def test_secret_scan(docs):
    assert rows_of(secret_scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == expected(brute.secrets)


def test_remove_repeats(docs):
    got = remove_repeats(docs)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.repeats([(d, t) for d, t, *_ in messy()]))


def test_jaccard_join(docs):
    numbered = [((d is not None, d, i), t) for i, (d, t, *_) in enumerate(messy())]
    want = brute.jaccard_components([(i, t) for i, (_, t) in enumerate(numbered)])
    ids = [d for d, *_ in messy()]
    groups = {}
    for i, (_, low) in want.items():
        groups.setdefault(low, []).append(ids[i])
    least = {low: min((x for x in g if x is not None), default=None) for low, g in groups.items()}
    assert rows_of(jaccard_join(docs), "doc_id", "n_shingles", "component_id") == Counter((ids[i], n, least[low]) for i, (n, low) in want.items())


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = Counter((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 64) for d, x, *_ in messy())
    assert rows_of(token_counts(docs, TOKENIZER, limit=64), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_language_id(docs):
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language_id(docs).collect()}
    assert {(7, "und"), (8, "und"), (9, "und"), (23, "und")} <= {x[:2] for x in got}
    assert all(0 <= r.score <= 1 for r in language_id(docs).collect())


def test_packing_loses_no_word(docs):
    got = pack(docs, max_len=100, n_buckets=3, budget=200).collect()
    by_id = Counter()
    for r in got:
        by_id[r.doc_id] += r.n_tokens
        assert r.bound is None or (r.padding == r.bound - r.n_tokens >= 0 and r.slot < 200 // r.bound)
    want = Counter()
    for d, t, *_ in messy():
        want[d] += len(brute.SPACED.findall(t or ""))
    assert +by_id == +want
    full = Counter((r.bound, r.batch) for r in got if r.bound)
    for bound in {b for b, _ in full}:
        sizes = [full[x] for x in sorted(k for k in full if k[0] == bound)]
        assert all(s == 200 // bound for s in sizes[:-1])


def test_decontamination(docs, bench):
    got = {(r.doc_id, r.contaminated) for r in decontaminate(docs, bench).collect()}
    assert {d for d, c in got if c} == {4, 5, 6}


def test_quality_classifier(docs, labels):
    got = quality_classifier(docs, labels).collect()
    assert len(got) == len(messy()) and all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark, docs, labels, bench):
    none = docs.limit(0)
    for df in (
        license_scan(none), quality_rules(none), secret_scan(none), remove_repeats(none), jaccard_join(none), token_counts(none, TOKENIZER), language_id(none),
        pack(none), decontaminate(none, bench), quality_classifier(none, labels),
    ):
        assert df.count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert quality_classifier(docs, labels.limit(0)).where("kept").count() == len(messy())
