"""Source divergence audit: how far the sources of a language lie apart in their terms.

Counts of (language, source, term) are added up within tasks before they are
shuffled.  A language's matrix of groups by kept terms is dealt into square blocks;
each block is a k^2-tree (k = 2): a quadrant without a count is one bit, and small
dense leaves hold shares.  Trees of two blocks of groups over the same terms are
traversed together: a quadrant that is empty in both is priced by its groups' shares
of an absent term alone, all others are entered down to their leaves.  So a pair's
value is the price of V absent terms, and the sum of what leaves differ from it.

Defined results: null text, language and source are empty; a group without terms
takes part; a language without kept terms has values of 0; rows that repeat an id
count each; very long texts are counted whole; ties are in order of the item's UTF-8
bytes; an empty table gives no row; other columns are not read.  Shares and values
are exact 64-bit integers; products that may be longer are decimals.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.operators.ranking import ranks

from .common import stored
from .lexical import lower

#: Maximal runs of ASCII letters and of all characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Groups and terms of a block, and of a leaf; both powers of two.
SIDE, LEAF = 512, 8
LEVELS = (SIDE // LEAF).bit_length() - 1
#: (source, term) counts that a task gathers before it hands them on, some 120 bytes each.
HELD = 500_000
#: A gathered count holds times in its lower and documents in its upper bits.
ONE_DOC = 1 << 40
SCALE = 1_000_000_000


class K2Tree:
    """Shares of a block's counts by place (row, column); absent places are not stored.

    ``bits`` has four bits for each node of a level, in order of rows, then columns;
    a child's number is the number of set bits before its own.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shares: np.ndarray):
        codes = np.zeros(len(rows), np.int64)
        r, c = rows // LEAF, columns // LEAF
        for bit in range(LEVELS):
            codes |= ((r >> bit & 1) << (2 * bit + 1)) | ((c >> bit & 1) << (2 * bit))
        leaves, at = np.unique(codes, return_inverse=True)
        self.leaves = np.zeros((len(leaves), LEAF, LEAF), np.int64)
        self.leaves[at, rows % LEAF, columns % LEAF] = shares
        self.bits: list[np.ndarray] = []
        parents = np.zeros(min(1, len(leaves)), np.int64)
        for level in range(LEVELS):
            nodes = np.unique(leaves >> 2 * (LEVELS - 1 - level))
            bits = np.zeros(4 * len(parents), bool)
            bits[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            parents = nodes

    def children(self, level: int, nodes: np.ndarray, quadrant: int) -> np.ndarray:
        """The numbers of the nodes' children, -1 where the quadrant is empty."""
        out = np.full(len(nodes), -1)
        some = np.nonzero(nodes >= 0)[0]
        bits = self.bits[level]
        at = 4 * nodes[some] + quadrant
        before = np.cumsum(bits) - bits
        out[some] = np.where(bits[at], before[at], -1) if len(some) else -1
        return out


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def differences(a: K2Tree, b: K2Tree, absent_a: np.ndarray, absent_b: np.ndarray) -> np.ndarray:
    """[group of a, group of b]: the sum over terms of the price, less that of an absent term.

    Both trees are entered at once, level by level; of the pairs of quadrants over
    the same columns only those are kept in which one holds a count and both hold
    groups.  Of a block beside itself only pairs of ascending groups are summed.
    """
    high_a, high_b, itself = len(absent_a), len(absent_b), a is b
    absent_a, absent_b = (np.concatenate([x, np.ones(SIDE - len(x), np.int64)]) for x in (absent_a, absent_b))
    na, nb = (np.zeros(1, np.int64) if len(t.leaves) else np.full(1, -1) for t in (a, b))
    ra, rb = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(LEVELS):
        parts = []
        for half in (0, 1):
            ca = [a.children(level, na, 2 * i + half) for i in (0, 1)]
            cb = [b.children(level, nb, 2 * i + half) for i in (0, 1)]
            for i in (0, 1):
                for j in (0, 1):
                    xa, xb, side = 2 * ra + i, 2 * rb + j, SIDE >> level + 1
                    kept = ((ca[i] >= 0) | (cb[j] >= 0)) & (xa * side < high_a) & (xb * side < high_b)
                    if itself:
                        kept &= xa <= xb
                    parts.append((ca[i][kept], cb[j][kept], xa[kept], xb[kept]))
        na, nb, ra, rb = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = SIDE // LEAF
    out = np.zeros((n, n, LEAF, LEAF), np.int64)
    pa_, pb = absent_a.reshape(n, LEAF), absent_b.reshape(n, LEAF)
    none = np.zeros((1, LEAF, LEAF), np.int64)
    la, lb = np.concatenate([a.leaves, none]), np.concatenate([b.leaves, none])  # -1 is the empty leaf
    for s in range(0, len(na), 1024):
        e = slice(s, s + 1024)
        x, y, p0, q0 = la[na[e]], lb[nb[e]], pa_[ra[e]], pb[rb[e]]
        x, y = np.where(x > 0, x, p0[:, :, None]), np.where(y > 0, y, q0[:, :, None])
        each = price(x[:, :, None, :], y[:, None, :, :]).sum(axis=3) - LEAF * price(p0[:, :, None], q0[:, None, :])
        np.add.at(out, (ra[e], rb[e]), each)
    return out.transpose(0, 2, 1, 3).reshape(SIDE, SIDE)[:high_a, :high_b]


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): summed up within tasks; a null term marks a group that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[tuple[str, str], dict[str, int]] = {}
        held = 0

        def drain() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in gathered.items():
                both = np.fromiter(terms.values(), np.int64, len(terms))
                n = len(terms) + 1
                columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.array([*terms, None], pa.string()), pa.array(np.append(both % ONE_DOC, 0)), pa.array(np.append(both // ONE_DOC, 0))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])
            gathered.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                group = gathered.setdefault((lang, source), {})
                held -= len(group)
                for term, n in Counter(TERM.findall(lower(text.as_py()))).items():
                    group[term] = group.get(term, 0) + n + ONE_DOC
                held += len(group)
                if held >= HELD:
                    yield from drain()
                    held = 0
        yield from drain()

    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    return docs.select(*(e.alias(c) for c, e in text.items())).mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)); null where nothing is kept."""
    n, of = (count + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", n * F.lit(SCALE).cast("decimal(10,0)"), of))


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of a language's sources, and each source's own terms."""
    counts = stored(count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    kept = stored(ranks(kept, ("lang",), (F.col("df").desc(), F.col("term")), "place"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_total"))
    entries = stored(counts.join(kept.select("lang", "term", "all_n", (F.col("place") - 1).alias("column")), ["lang", "term"]), "entries")
    groups = ranks(counts.where("term is null").select("lang", "source"), ("lang",), ("source",), "place").withColumn("row", F.col("place") - 1).drop("place")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", "row", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total")
    groups = stored(groups.withColumn("absent", share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    priced = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    return _pairs(priced, groups).unionByName(_terms(priced, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def _terms(priced: DataFrame, top: int) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    own = priced.withColumn("q", share(F.col("all_n"), F.col("lang_total"), F.col("v"))).where((F.col("n") > 0) & (p > q))
    return _ranked(own.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value")), "term").where(F.col("rank") <= top)


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    block = lambda c: F.expr(f"`{c}` div {SIDE}")

    def plant(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = K2Tree(rows["row"].to_numpy() % SIDE, rows["column"].to_numpy() % SIDE, rows["p"].to_numpy(np.int64))
        return pd.DataFrame({"lang": [keys[0]], "terms": [keys[1]], "block": [keys[2]], "tree": [pickle.dumps(tree)]})

    trees = priced.select("lang", block("column").alias("terms"), block("row").alias("block"), "row", "column", "p").groupBy("lang", "terms", "block").applyInPandas(plant, "lang string, terms bigint, block bigint, tree binary")
    # Each block of groups, with an absent term's share of each, at each block of terms.
    blocks = groups.where("v > 0").groupBy("lang", block("row").alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "absent"))).alias("members"), F.max("v").alias("v"))
    laid = blocks.select("lang", "block", F.col("members.absent").alias("absent"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(v - 1) div {SIDE}"))).alias("terms"))
    laid = stored(laid.join(trees, ["lang", "terms", "block"], "left"), "trees")
    a, b = (laid.select("lang", "terms", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "absent", "tree"))) for s in "ab")
    met = a.join(b, ["lang", "terms"]).where("block_a <= block_b and (tree_a is not null or tree_b is not null)")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = np.zeros(0, np.int64)
        for part in parts:
            for lang, block_a, block_b, pa0, pb0, tree_a, tree_b in part[["lang", "block_a", "block_b", "absent_a", "absent_b", "tree_a", "tree_b"]].itertuples(index=False, name=None):
                ta, tb = (K2Tree(nothing, nothing, nothing) if t is None else pickle.loads(t) for t in (tree_a, tree_b))
                found = differences(ta, ta if block_a == block_b else tb, np.asarray(pa0, np.int64), np.asarray(pb0, np.int64))
                i, j = np.nonzero(found)
                one, two = block_a * SIDE + i, block_b * SIDE + j
                once = one < two
                yield pd.DataFrame({"lang": lang, "a": one[once], "b": two[once], "value": found[i, j][once]})

    differ = met.mapInPandas(compare, "lang string, a bigint, b bigint, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    left, right = (groups.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "row", "absent", "v"))) for s in "ab")
    pairs = left.join(right, "lang").where("row_a < row_b").join(differ.select("lang", F.col("a").alias("row_a"), F.col("b").alias("row_b"), "more"), ["lang", "row_a", "row_b"], "left")
    value = F.expr("coalesce(v_a * ((absent_a - absent_b) * (absent_a - absent_b) div (absent_a + absent_b)), 0) + coalesce(more, 0)")
    both = pairs.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("s"))
    return _ranked(both.select("lang", "s.source", "s.item", "value"), "pair")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with d as (
  select row_number() over () as place, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
t as (select place, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*) as all_n from t group by lang, term having count(distinct place) >= 10),
g as (select distinct lang, source from d),
l as (select lang, count(*) as v, cast(sum(all_n) as bigint) as lang_total from k group by lang),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
m as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, all_n, v, lang_total, cast(sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as bigint) as total
  from g join k using (lang) join l using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (
  select lang, source, term, n, cast(1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v) as bigint) as p, cast(1 + (1000000000::hugeint * (all_n + 2)) // (lang_total + 2 * v) as bigint) as q
  from m),
b as (
  select x.lang, x.source, 'pair' as part, y.source as item, cast(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as bigint) as value
  from p x join p y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by x.lang, x.source, y.source),
e as (
  select x.lang, x.source, 'pair' as part, y.source as item, coalesce(b.value, 0) as value
  from g x join g y on y.lang = x.lang and y.source <> x.source left join b on b.lang = x.lang and b.source = x.source and b.item = y.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from e)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
"""
