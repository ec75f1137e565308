import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm.elias_fano import EliasFano, Trie
from lamina.llm.ngram_lm import op5_ngram_scores, score_texts
from lamina.llm.quality import FEATURES, AdditiveModel, features, fit_quality, label_sample, op8_quality, score_quality, text_features

from .conftest import SF


def expected_scores(docs, pull=30.0):
    """Base and bigram scores by the formulas, all in dictionaries."""
    cut = {n: [*(t or "").encode().lower().split(), None] for n, (_, t) in enumerate(docs)}
    held = {n: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for n, (i, _) in enumerate(docs)}
    c, pairs, begun = Counter(), Counter(), 0
    for n, words in cut.items():
        if not held[n]:
            begun += 1
            c.update(words)
            pairs.update(zip([b"<s>", *words], words))
    total, kinds = sum(c.values()), len(c)
    out = []
    for n, words in cut.items():
        p = {w: (c[w] + 0.1) / (total + 0.1 * (kinds + 1)) for w in words}
        model, last, size = 0.0, b"<s>", begun
        for w in words:
            model += math.log10((pairs[last, w] + pull * p[w]) / (size + pull))
            last, size = w, c[w]
        out.append((docs[n][0], held[n], len(words), sum(c[w] > 0 for w in words), total, sum(math.log10(p[w]) for w in words), model))
    return out


def compare(rows, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for got, want in zip(sorted(map(tuple, rows), key=key), sorted(expected_scores(docs), key=key), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5], rel=1e-9)
        assert got[6] == pytest.approx(want[6], abs=0.02 * want[2] + 1e-6)  # the codes' steps


def test_scores_of_whole_table(spark, sample):
    rows = op5_ngram_scores(spark, SF).collect()
    compare(rows, sample)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_in_small_blocks_and_shards(spark, odd, odd_texts, empty):
    compare(score_texts(odd, block_words=50, shard_tokens=200).collect(), odd_texts)
    assert score_texts(empty).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=300), st.integers(0, 40))
def test_elias_fano_finds_what_it_holds(values, shift):
    sorted_ = np.array(sorted(values), np.uint64) << np.uint64(shift)
    level = EliasFano(sorted_, 5001 << shift)
    asked = np.arange(5001, dtype=np.uint64) << np.uint64(shift)
    place = {v: i for i, v in enumerate(sorted(values))}
    assert level.find(asked).tolist() == [place.get(i, -1) for i in range(5001)]
    if len(sorted_):
        assert (level.get(np.arange(len(sorted_))) == sorted_).all()


def test_trie_looks_up_within_contexts():
    contexts = np.array([5, 9, 70], np.uint64)
    of, after = np.array([0, 0, 1, 2, 2, 2]), np.array([3, 8, 3, 0, 1, 99], np.uint64)
    values = np.log10(np.array([0.5, 0.25, 1.0, 0.1, 0.2, 0.3]))
    trie = Trie(contexts, of, after, 40, values).map_to()
    codes = trie.look_up(np.array([5, 9, 70, 71, 1], np.uint64), np.array([0, 0, 1, 1, 2, 3, 4]), np.array([8, 9, 3, 8, 99, 3, 3], np.uint64))
    assert [c > 0 for c in codes] == [True, False, True, False, True, False, False]
    assert trie.value(codes[[0, 2, 4]]) == pytest.approx(values[[1, 2, 5]], abs=0.01)
    assert [trie.children(i).tolist() for i in range(3)] == [[3, 8], [3], [0, 1, 99]]


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = op8_quality(spark, sf).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9


def test_fit_counts_a_repeated_id_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(AdditiveModel, "fit", lambda self, x, y: seen.append((x.tolist(), y.tolist())) or self)
    table = spark.createDataFrame([(1, [float(i % 3)]) for i in range(30)] + [(2, [5.0])], "doc_id bigint, x array<double>")
    sample = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id bigint, y double")
    for t in (table, table.orderBy("x")):
        fit_quality(t, sample)
    assert len(seen[0][0]) == 2 and seen[0] == seen[1] and seen[0][1] == [1.0, 0.0]


def test_quality_odd_rows(spark, odd, odd_texts, empty):
    table = text_features(odd)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (6, 7)], "doc_id bigint, quality int")
    rows = score_quality(table, fit_quality(table, label_sample(labels))).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in rows)
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in score_quality(table, fit_quality(table, label_sample(none))).collect()} == {0.5}
    assert score_quality(text_features(empty), fit_quality(table, label_sample(labels))).collect() == []


def plain_features(text):
    """The 22 numbers, byte by byte and word by word."""
    raw = text.encode()
    n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    w, seen = max(1, len(words)), Counter(words)
    among = lambda chars: sum(b in chars for b in raw)
    upper, lower = among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among(b"abcdefghijklmnopqrstuvwxyz")
    space, other = among(b"\t\n\x0b\x0c\r "), sum(b > 127 for b in raw)
    named = {
        "log_bytes": math.log(1 + len(raw)), "log_words": math.log(1 + len(words)), "word_length": (len(raw) - space) / w, "letters": (upper + lower + other) / n,
        "upper": upper / max(1, upper + lower), "digits": among(b"0123456789") / n, "marks": among(b"!\"'(),-./:;?") / n, "symbols": among(b"#$%&*+<=>@[\\]^_`{|}~") / n,
        "exclaims": among(b"!") / w, "bars": among(b"|") / w, "spaces": space / n, "lines": len(lines) / w, "line_length": math.log(1 + len(raw) / len(lines)),
        "distinct_words": len(seen) / w, "top_word": max(seen.values(), default=0) / w, "same_as_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        "distinct_lines": len(set(lines)) / len(lines), "one_letter": sum(len(x) == 1 for x in words) / w, "longest_word": math.log(1 + max(map(len, words), default=0)),
        "stops": among(b".") / w, "other_bytes": other / n, "capital_words": sum(x[:1] in [bytes([c]) for c in range(65, 91)] for x in words) / w,
    }
    return [named[k] for k in FEATURES]


def test_features_equal_a_plain_count(spark, sample, odd_texts):
    for _, text in sample[:60] + odd_texts:
        assert np.allclose(features(text or ""), plain_features(text or ""), rtol=1e-12)


def test_quality_of_odd_rows(spark, odd, odd_texts, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = text_features(odd)
    model = fit_quality(text_features(spark.read.parquet(f"{SF}/documents.parquet")), label_sample(labels))
    got = Counter((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in score_quality(table, model).collect())
    want = Counter()
    for i, text in odd_texts:
        s = float(model.score(np.array([plain_features(text or "")]))[0])
        want[i, round(s, 9), int(s >= 0.3)] += 1
    assert got == want
    assert score_quality(text_features(empty), model).collect() == []
