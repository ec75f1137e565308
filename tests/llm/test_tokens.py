import re
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm.common import scratch_path
from lamina.llm.packing import op2_best_fit, pack_documents, pack_lengths
from lamina.llm.token_files import TokenFile, op3_token_files, pack, read_tokens, token_digest, unpack, write_tokens
from lamina.llm.units import cut_units, encoder
from lamina.llm import files

from .conftest import SF

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@lru_cache
def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def whole(path, text, end):
    return [*library(path).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("aZé' \n\t.,!5²½Ⅷ_é\x1c\x85  ſſΣσİ<|>"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=40))
def test_units_equal_whole_texts(path, text):
    t = encoder(path)
    assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_units_of_sample(path, sample, odd_texts):
    for _, text in sample[:60] + odd_texts:
        assert np.frombuffer(encoder(path).encode([text or ""])[0], "<u4").tolist() == whole(path, text, 0)[:-1]


#: What the cut of many texts at once has to find: a unit with the white space before it, or apart.
BODY = r"[^\W\d_]+|(?:[^\w\s]|[\d_])+(?:(?<=')[^\W\d_]+)?"
PATTERNS = {BYTES: re.compile(rf"\s*(?:{BODY})|\s+"), WORDS: re.compile(rf"{BODY}|\s+")}


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZé' \n.5²_\x1c🙂日"), st.characters(exclude_categories=["Cs"])), max_size=12), max_size=5))
def test_cut_equals_pattern(path, texts):
    units, bounds = cut_units(texts, encoder(path).rule)
    assert [units[a:b].to_pylist() for a, b in zip(bounds, bounds[1:], strict=False)] == [PATTERNS[path].findall(t) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_texts_together_equal_texts_alone(path, odd_texts):
    texts = ["", *(t or "" for _, t in odd_texts), "x²y", "", "plain", "İ, İ", "plain", ""]
    assert encoder(path).encode(texts) == [np.array(whole(path, t, 0)[:-1], "<u4").tobytes() for t in texts]
    assert encoder(path).encode(["", ""]) == [b"", b""]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_known_units_cost_less_than_their_pattern(path, sample):
    texts = [" ".join(t or "" for _, t in sample[k:40] + sample[:k]) for k in range(20)]

    def seconds(f):
        at = time.process_time()
        f()
        return time.process_time() - at

    encoder(path).encode(texts)
    new = min(seconds(lambda: encoder(path).encode(texts)) for _ in range(3))
    assert new < min(seconds(lambda: [PATTERNS[path].findall(t) for t in texts]) for _ in range(3))


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-1003 // 64) * bits * 8
    assert (unpack(data, bits, 1003) == ids).all()


def expected_tokens(docs):
    at, out = 0, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array(whole(BYTES, text, 2), "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_of_whole_table(spark, sample):
    assert sorted(map(tuple, op3_token_files(spark, SF).collect())) == sorted(expected_tokens(sample))


def test_token_files_odd_rows_and_random_access(spark, odd, odd_texts, empty):
    path = scratch_path(spark, "test")
    write_tokens(odd, path, BYTES, end_id=2)
    got = {tuple(r) for r in token_digest(read_tokens(spark, path)).collect()}
    assert got == set(expected_tokens(odd_texts))
    flat = np.concatenate([whole(BYTES, t, 2) for _, t in sorted(odd_texts, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))])
    for f in files.manifest(path)["files"]:
        file, base = TokenFile(path, f["name"]), f["ids_before"]
        for a, b in ((0, 1), (5, f["ids"]), (f["ids"] // 2, f["ids"] // 2 + 3)):
            b = min(b, f["ids"])
            assert (file.ids(a, b) == flat[base + a : base + b]).all()
    path = scratch_path(spark, "test")
    write_tokens(empty, path, BYTES, end_id=2)
    assert read_tokens(spark, path).count() == 0


def test_token_files_of_ids_that_many_rows_share(spark):
    docs = [(None, f"null {i % 3}") for i in range(60)] + [(7, "the same")] * 80 + [(7, f"other {i}") for i in range(20)] + [(i, f"own {i}") for i in range(40)]
    path = scratch_path(spark, "test")
    write_tokens(spark.createDataFrame(docs, "doc_id bigint, text string"), path, BYTES, end_id=2)
    got = sorted(map(tuple, token_digest(read_tokens(spark, path)).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in expected_tokens(docs))
    assert len(files.manifest(path)["files"]) > 2


def check_packing(rows, docs, capacity):
    pieces = {}
    for i, text in docs:
        ids = whole(WORDS, text, 0)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            key = (i, k, at, len(part), zlib.crc32(part.tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    seen, bins = {}, {}
    for r in rows:
        key = tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
        seen[key] = seen.get(key, 0) + 1
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == pieces
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(n for b in bins.values() for _, n in b)


def test_packing_of_whole_table(spark, sample):
    n, total = check_packing(op2_best_fit(spark, SF).collect(), sample, 2048)
    assert n <= 1.02 * -(-total // 2048)


def test_packing_odd_rows(spark, odd, odd_texts, empty):
    check_packing(pack_documents(odd, WORDS, capacity=64).collect(), odd_texts, 64)
    assert pack_documents(empty, WORDS).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_bins_hold_every_piece_once(counts):
    bins, used = pack_lengths(counts, 40), {}
    for found, times in bins:
        assert 0 < sum(found) <= 40 and times > 0
        for s in found:
            used[s] = used.get(s, 0) + times
    assert used == counts
    if counts:  # never worse than twice the volume, the bound of any fit that leaves no two half-empty bins
        volume = sum(s * n for s, n in counts.items())
        assert sum(t for _, t in bins) <= 2 * -(-volume // 40)


@pytest.mark.parametrize("split", [1, 3, 1000])
def test_token_files_read_by_any_split(spark, odd, split):
    path = scratch_path(spark, "test")
    write_tokens(odd, path, BYTES, 2)
    whole = sorted(map(tuple, token_digest(read_tokens(spark, path)).collect()), key=str)
    assert sorted(map(tuple, token_digest(read_tokens(spark, path, splitDocs=split)).collect()), key=str) == whole
    for f in files.manifest(path)["files"]:
        every = TokenFile(path, f["name"])
        for first in range(every.docs):
            one = TokenFile(path, f["name"], first, first + 1)
            assert (one.keys[0], one.null[0]) == (every.keys[first], every.null[first])
            assert one.ids(*one.starts.tolist()).tolist() == every.ids(*every.starts[first : first + 2].tolist()).tolist()
