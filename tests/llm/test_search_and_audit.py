"""URL rules, ranked search and source divergence beside plain Python, on rows that are odd, tied, repeated or absent."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamina.llm import divergence, lexical, url_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- ranked search -------------------------------------------------------


def brute_ranks(docs, items, k):
    def terms(text):
        return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(f for f in found if f[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


def ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("pairs", [1 << 17, 8])  # with 8, long items are split and groups are many
def test_search_of_odd_rows(spark, odd, odd_texts, pairs):
    items = [(1, "THE cat's whiskers, one two"), (1, "one"), (2, None), (3, ""), (None, "日本語のテキスト emoji"), (4, " ".join(f"w{i}" for i in range(40))), (5, "nothing-matches-this zz"), (6, "é L'ÉTÉ été İ K")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, term string, n int")
    assert ranked(lexical.rank_documents(odd, table, 4, pairs=pairs)) == brute_ranks(odd_texts, items, 4)


def test_search_keeps_ties_in_order_and_empty_tables_empty(spark, odd, empty):
    docs = [(100 - i % 50, "same words here") for i in range(100)] + [(None, "same words here"), (7, "same")] + [(i + 1000, "filler") for i in range(50)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "words"), (2, "same here")], "item_id bigint, text string")
    assert ranked(lexical.rank_documents(table.repartition(7), items, 50)) == brute_ranks(docs, [(1, "words"), (2, "same here")], 50)
    assert ranked(lexical.rank_documents(table.repartition(3), items, 200)) == brute_ranks(docs, [(1, "words"), (2, "same here")], 200)
    assert lexical.rank_documents(empty, items).collect() == [] == lexical.rank_documents(odd, items.limit(0)).collect()


def test_long_terms_and_exact_sums(spark):
    long = "x" * 5000
    docs = [(1, f"{long} y"), (2, "x" * 5001), (3, long.upper() + " " + long), (4, "other text")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert ranked(lexical.rank_documents(table, spark.createDataFrame([(1, long)], "item_id bigint, text string"))) == brute_ranks(docs, [(1, long)], 50)
    rng = np.random.default_rng(1)
    n = 3 * lexical.TILE - 5
    terms, items, w = np.arange(n).repeat(3), np.tile(np.arange(3), n), rng.integers(30_000, 32_768, 3 * n).astype(float)
    impact = rng.integers(900_000, 1_000_000, n)
    got = lexical.Weights(terms, items, w, n, 3).scores(np.zeros(n, int), np.arange(n), impact, 1)
    assert got[:, 0].tolist() == [int((w[i::3].astype(object) * impact.astype(object)).sum()) for i in range(3)]


# ---- source divergence ---------------------------------------------------


def brute_divergence(rows, least, top):
    rows = [(la or "", s or "", [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for la, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, every, each = Counter(), Counter(), defaultdict(Counter)
        for la, s, t in rows:
            if la == lang:
                df.update(set(t)), every.update(t), each[s].update(t)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        q, p = shares(every), {s: shares(c) for s, c in each.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        flat = {s: np.array([p[s][t] for t in kept], np.int64) for s in p}
        for s in p:
            pairs = sorted(((-int(f(flat[s], flat[o]).sum()), o.encode(), o) for o in p if o != s))
            own = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if each[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", own)):
                out += [(lang, s, part, i, -value, r) for r, (value, _, i) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_of_odd_rows(spark, odd, empty):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    for least in (1, 2, 10):
        assert sorted(tuple(r) for r in divergence.divergence(odd, least, 3).collect()) == brute_divergence(rows, least, 3)
    assert divergence.divergence(empty).collect() == []


def test_divergence_of_more_groups_and_terms_than_a_block(spark):
    rng = np.random.default_rng(3)
    rows = [("en", f"s{i % (divergence.SIDE + 9)}", " ".join("w" + "abcdefghij"[n % 10] * (n // 10 + 1) for n in rng.zipf(1.4, 12) % 6000)) for i in range(1200)]
    rows += [(None, "a", "x y"), (None, None, None), ("de", "alone", "Ä ä ß")] + [("en", "s1", " ".join(f"t{'é' * (1 + i // 26)}{chr(97 + i % 26)}" for i in range(divergence.SIDE)))] * 2
    table = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.divergence(table, 1, 10)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, 1, 10)


def test_trees_skip_what_is_empty():
    rng = np.random.default_rng(2)
    side = divergence.SIDE
    dense = [np.where(rng.random((n, side)) < share, rng.integers(1, 10**9, (n, side)), 0) for n, share in ((20, 0.01), (side, 0.002))]
    absent = [rng.integers(1, 10**6, len(d)) for d in dense]
    trees = [divergence.K2Tree(*np.nonzero(d), d[np.nonzero(d)]) for d in dense]
    assert len(trees[0].leaves) < 20 * side / divergence.LEAF**2
    whole = [np.where(d > 0, d, a[:, None]) for d, a in zip(dense, absent, strict=True)]
    want = [[sum(divergence.price(x, y)) - side * divergence.price(p, q) for y, q in zip(whole[1][:40], absent[1], strict=False)] for x, p in zip(whole[0], absent[0], strict=True)]
    assert (divergence.differences(*trees, *absent)[:, :40] == want).all()
    nothing = divergence.K2Tree(*[np.zeros(0, np.int64)] * 3)
    assert not divergence.differences(nothing, nothing, absent[0], absent[0]).any()


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n = 40_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(5)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (3 * n + 10) and row["none"] is None


# ---- URL rules -----------------------------------------------------------


def judged(spark, urls, **more):
    table = spark.createDataFrame([(i, u, "<html>", "h", 1) for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, rule int")
    return {r["page_id"]: r for r in url_rules.judge_urls(table, **more).collect()}


def test_hosts_paths_and_fixed_rules(spark):
    cases = [
        (None, "", "", None), ("", "", "", None), ("no scheme/org/", "", "", None), ("http://", "", "", None), ("HTTP://WWW.Example.ORG/EN/1", "www.example.org", "/EN/1", "org/"),
        ("x://example.org/en/1?a#b", "example.org", "/en/1", "example.org/en/1"), ("x://example.org/en/2", "example.org", "/en/2", "org/"), ("x://badexample.org/es/", "badexample.org", "/es/", "org/"),
        ("x://a.example.org/es/://y", "a.example.org", "/es/://y", "example.org/es/"), ("x://org", "org", "", None), ("x://org?/q", "org", "", None), ("x://a.com/fr/#z", "a.com", "/fr/", "com/fr/"),
        ("x://com/de/", "com", "/de/", "com/de/"), ("x://acom/de/", "acom", "/de/", None), ("x://É.com/de/\n", "É.com", "/de/\n", "com/de/"), ("a" * 300_000 + "://b.org/" + "p/" * 300_000, "b.org", "/" + "p/" * 300_000, "org/"),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == ("block" if rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")


def test_mined_rules_carry_over(spark):
    urls = [f"http://h{i}.com/de/casino/{i}?ref=x" for i in range(30)] + [f"http://h{i}.org/news/{i}" for i in range(60)] + [f"http://h{i}.com/fr/casino/{i}" for i in range(3)]
    urls += ["http://other.net/casino/77?ref=y", "http://other.net/news/7", "http://other.net/nothing", "http://other.net/casino?ref=z&utm=1"] + ["http://same.net/casino?ref"] * 40
    got = judged(spark, urls)
    ask = {u: (got[i]["verdict"], got[i]["mined"]) for i, u in enumerate(urls) if ".net" in u}
    assert ask["http://other.net/casino/77?ref=y"][0] == ask["http://same.net/casino?ref"][0] == "block"
    assert "q:ref" in ask["http://other.net/casino/77?ref=y"][1]
    assert ask["http://other.net/news/7"] == ("allow", "p:news") and ask["http://other.net/nothing"] == ("allow", None)
    # Copies of one URL are one URL to the miner.
    again = judged(spark, urls + urls[:1] * 500)
    assert all(again[i]["verdict"] == got[i]["verdict"] and again[i]["mined"] == got[i]["mined"] for i in got)


def test_urls_of_many_common_tokens_stay_bounded(spark):
    urls = [f"http://x.com/de/{'/'.join(f'seg{c}' for c in 'abcdefghijklmnopqrstuvwxyz')}/{i}" for i in range(40)] + [f"http://y.org/{i}" for i in range(40)] + ["http://z.net/sega/segb"]
    assert judged(spark, urls)[80]["verdict"] == "block"


def test_no_labels_and_no_rows(spark):
    assert {r["verdict"] for r in judged(spark, ["http://a.net/x", None, "y"]).values()} == {"allow"}
    table = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.judge_urls(table).collect() == []


def test_rules_of_urls_with_many_common_tokens_are_whole(spark):
    import itertools

    rng = random.Random(8)
    rows = []
    for i in range(160):
        verdict = "block" if i % 3 else "allow"
        held = {t for t in "abcdefghijklmnop" if rng.random() < (0.85 if i % 2 else 0.3)} | ({"x"} if verdict == "block" and i % 2 else set())
        rows.append((sorted(held), verdict))
    table = spark.createDataFrame([r for r in rows if r[0]], "tokens array<string>, verdict string")
    got = {(tuple(r["tokens"]), r["verdict"]): (r["joint"], r["alone"]) for r in url_rules.mine(table, 0.2, 5, 0.7).collect()}
    n, want = table.count(), {}
    for size in (1, 2, 3):
        for tokens in itertools.combinations("abcdefghijklmnopx", size):
            met = [v for held, v in rows if set(tokens) <= set(held)]
            for verdict in set(met):
                if met.count(verdict) >= 0.2 * n and met.count(verdict) / len(met) >= 0.7:
                    want[tokens, verdict] = met.count(verdict), len(met)
    assert got == want and any("x" in t for t, _ in want)
