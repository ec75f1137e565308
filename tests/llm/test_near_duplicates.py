import itertools
import random

from lamina.llm import neardup
from lamina.llm.neardup import near_duplicates, op10_near_duplicates

from .conftest import SCHEMA, SF, rows


def shingles(text, k):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(docs, k, percent=80):
    """doc_id -> (set size, least reachable id), by all pairs."""
    sets = {i: shingles(t, k) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}


def test_whole_table_equals_all_pairs(spark, sample):
    out = op10_near_duplicates(spark, SF)
    assert got(out) == brute(sample, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_five_words_on_chains_of_edits(spark):
    rng = random.Random(5)
    docs = []
    for g in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(90)]
        for _ in range(25):
            docs.append((len(docs), " ".join(words)))
            for _ in range(rng.choice((0, 1, 1, 2))):
                words[rng.randrange(90)] = f"e{rng.randrange(999)}"
    rng.shuffle(docs)
    df = spark.createDataFrame(rows(docs), SCHEMA)
    assert got(near_duplicates(df, words=5)) == brute(docs, 5)


def test_prefix_join_on_repeated_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TURNS", 0)
    rng = random.Random(7)
    docs = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(100)]
        other = [f"g{g}v{i}" for i in range(100)]
        near = [" ".join(words[:100 - j] + [f"e{rng.random()}" for _ in range(j)]) for j in (9, 10)]
        docs += [(10 * g, " ".join(words)), (10 * g + 1, near[0]), (10 * g + 2, near[1]), (10 * g + 3, " ".join(other))]
    repeated = [d for i, d in enumerate(docs) for _ in range((1, 7, 1, 3)[i % 4])]
    rng.shuffle(repeated)
    out = near_duplicates(spark.createDataFrame(rows(repeated), SCHEMA), words=2)
    assert out.count() == len(repeated)
    assert got(out) == brute(docs, 2)
    assert {i: c for i, (_, c) in got(out).items()} == {i: i - i % 10 + (3 if i % 10 == 3 else 0) for i, _ in docs}
    # An id with two texts has two sets: what either is like is one component.
    two = docs + [(10 * g + 4, " ".join(f"g{g}{'wv'[k]}{i}" for i in range(99))) for g in range(12) for k in range(2)]
    both = near_duplicates(spark.createDataFrame(rows(two), SCHEMA), words=2)
    assert {r["doc_id"]: r["component_id"] for r in both.collect()} == {i: i - i % 10 for i, _ in two}


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    """With every key hot, in either way of linking, the links are those of all pairs."""
    rng = random.Random(11)
    docs = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(30):
            docs.append((len(docs), " ".join(w if rng.random() > 0.06 else f"e{rng.random()}" for w in words)))
    df = spark.createDataFrame(rows(docs), SCHEMA)
    want = brute(docs, 2)
    assert len({c for _, c in want.values()}) < len(docs)
    monkeypatch.setattr(neardup, "SPLIT", 1)
    monkeypatch.setattr(neardup, "CELL", 2)
    for turns in (2, 0):
        monkeypatch.setattr(neardup, "TURNS", turns)
        assert got(near_duplicates(df, words=2)) == want


def test_odd_rows(spark, odd, odd_texts):
    out = near_duplicates(odd, words=2)
    assert out.count() == len(odd_texts)
    assert got(out) == brute(odd_texts, 2)
    null = out.where("doc_id is null").first()
    assert null["component_id"] is None and null["kept"]


def test_empty_table(empty):
    assert near_duplicates(empty).collect() == []
