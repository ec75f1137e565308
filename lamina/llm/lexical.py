"""Ranked lexical search: dense tiles of items' weights times documents' impacts.

Items are dealt into groups of fewer than 2 * ``PAIRS`` (item, term) pairs and 2 *
``ITEMS`` items, whose terms are the group's compact vocabulary.  For each group a
pass over the documents counts its terms and stores them as numbers.  Then a task
lays its documents' impacts out as a dense block of rows by one tile of the
vocabulary, multiplies it by that tile's weights with BLAS, and adds the tiles up in
64-bit integers.

A product is below 2^35 (an impact is below 10^6, a weight below 2^15), so that the
sum over a tile of ``TILE`` terms stays below 2^53 and is exact as a double.

A task keeps each item's best rows by (score, doc_id), however many tie; what tasks
keep is merged by item in two steps, so that no task meets all of them.  An item of
more than ``PAIRS`` terms is cut into parts, whose scores of a document are added up
by a shuffle before they are ranked.

Defined results: a null or empty text has no terms and takes no part; a null doc_id
is a document like others and comes last among equal scores; rows that repeat an id
are documents of their own, and items that repeat one are asked for themselves; very
long texts are read whole; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

#: Maximal runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_CAPITALS = re.compile("[A-Z]+")
#: (item, term) pairs and items of half a group, terms of a tile, documents of a block.
PAIRS, ITEMS, TILE, BLOCK = 1 << 17, 512, 2048, 512
#: Bytes of dense weights that a task keeps instead of laying them out again for each block.
KEPT = 1 << 26
#: Characters of a term that are kept; a longer one is known by its digest.
LONGEST = 48
SALT = 64


def lower(text: str) -> str:
    """A-Z in lower case; no other letter changes."""
    return text.lower() if text.isascii() else _CAPITALS.sub(lambda m: m[0].lower(), text)


def key(term: str) -> str:
    """A term in lower case, or, if it is long, a digest that no term spells."""
    return term if len(term) <= LONGEST else " " + hashlib.sha256(term.encode("utf-8", "surrogatepass")).hexdigest()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, item_id, term): each item's terms once; the row tells items apart that repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({key(t) for t in TERM.findall(lower(text))}) for text in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            terms = pa.array([t for f in found for t in f], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("item_id").take(at), terms], ["row", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("item_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "row bigint, item_id bigint, term string")


def grouped(asked: DataFrame, pairs: int) -> tuple[DataFrame, int, bool]:
    """(asked with its group and whether its item is split, groups, whether any item is).

    A unit is an item, or a part of a large one; units are numbered up by a running
    sum of their sizes, in ranges of which the driver sees nothing.
    """
    sizes = asked.groupBy("row").agg(F.count(F.lit(1)).alias("size"))
    parts = F.when(F.col("size") <= pairs, 1).otherwise(F.ceil(2 * F.col("size") / pairs))
    cut = asked.join(sizes, "row").select("row", "item_id", "term", (F.col("size") > pairs).alias("split"), F.pmod(F.xxhash64("term"), parts).alias("part"))
    least = -(-pairs // ITEMS)
    units = stored(cut.groupBy("row", "part").agg(F.greatest(F.count(F.lit(1)), F.lit(least)).alias("size")).withColumn("range", F.spark_partition_id()), "units")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = units.groupBy("range").agg(F.sum("size").alias("size")).select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy("row", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.join(before, "range").select("row", "part", ((F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("before")) / pairs).cast("bigint").alias("group"))
    out = stored(cut.join(placed, ["row", "part"]), "groups")
    groups, split = out.agg(F.max("group"), F.max("split")).first()
    return out, 0 if groups is None else groups + 1, bool(split)


def count_terms(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(uid, doc_id, n, numbers, times): length in terms, and the counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, numbers, times = [], [], []
            for text in batch.column("text"):
                found = Counter(TERM.findall(lower(text.as_py())))
                mine = [(known[k], n) for k, n in ((key(t), n) for t, n in found.items()) if k in known]
                sizes.append(found.total())
                numbers.append([i for i, _ in mine])
                times.append([n for _, n in mine])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["uid", "doc_id", "n", "numbers", "times"])

    return docs.mapInArrow(run, "uid bigint, doc_id bigint, n bigint, numbers array<int>, times array<bigint>")


def impacts(times: np.ndarray, sizes: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The part of a term's score that its document decides; ``sizes`` beside each term."""
    if n_docs * int(sizes.max(initial=0)) * 50 < 1 << 62:
        m = 50 + (50 * sizes * n_docs) // total
    else:
        m = np.array([50 + 50 * int(n) * n_docs // total for n in sizes], np.int64)
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


class Weights:
    """A group's weights as triples (term, item, weight), laid out densely by tiles of terms."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, weights: np.ndarray, n_terms: int, n_items: int):
        order = np.argsort(terms, kind="stable")
        self.terms, self.items, self.weights = terms[order], items[order], weights[order]
        self.n_terms, self.n_items = n_terms, n_items
        self.starts = np.searchsorted(self.terms, np.arange(0, n_terms + TILE, TILE))
        self.kept: dict[int, np.ndarray] = {}

    def tile(self, t: int) -> np.ndarray:
        if t in self.kept:
            return self.kept[t]
        dense = np.zeros((min(TILE, self.n_terms - t * TILE), self.n_items))
        a, b = self.starts[t : t + 2]
        dense[self.terms[a:b] - t * TILE, self.items[a:b]] = self.weights[a:b]
        if (len(self.kept) + 1) * TILE * self.n_items * 8 <= KEPT:
            self.kept[t] = dense
        return dense

    def scores(self, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Items by documents, from (document, term, impact) triples."""
        out = np.zeros((n_docs, self.n_items), np.int64)
        order = np.argsort(terms // TILE, kind="stable")
        docs, terms, impact = docs[order], terms[order], impact[order]
        ends = np.searchsorted(terms // TILE, np.arange(-(-self.n_terms // TILE) + 1))
        for t, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                weights = self.tile(t)
                dense = np.zeros((n_docs, len(weights)))
                dense[docs[a:b], terms[a:b] - t * TILE] = impact[a:b]
                out += (dense @ weights).astype(np.int64)
        return out.T


class Best:
    """The k best (score, doc_id) of each item among the documents met so far; null ids come last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.scores = np.zeros((n_items, k), np.int64)
        self.ids = np.zeros((n_items, k), np.int64)
        self.null = np.ones((n_items, k), bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores`` is items by documents; 0 is none.  Scores that tie with the last place are kept in view."""
        who = np.nonzero(((scores >= self.scores[:, -1:]) & (scores > 0)).any(axis=1))[0]
        if not len(who):
            return
        scores = np.concatenate([self.scores[who], scores[who]], axis=1)
        ids = np.concatenate([self.ids[who], np.broadcast_to(ids, (len(who), len(ids)))], axis=1)
        null = np.concatenate([self.null[who], np.broadcast_to(null, (len(who), len(null)))], axis=1)
        best = np.lexsort((ids, null, -scores), axis=1)[:, : self.k]
        self.scores[who], self.ids[who], self.null[who] = (np.take_along_axis(a, best, 1) for a in (scores, ids, null))


#: What a search finds; uid is -1 where the document's whole score is known.
FOUND = "row bigint, item_id bigint, uid bigint, doc_id bigint, score bigint"


def _found(rows: np.ndarray, names: list, at: np.ndarray, uids: np.ndarray, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(rows[at]), pa.array([names[i] for i in at], pa.int64()), pa.array(uids), pa.array(ids, mask=null), pa.array(scores)]
    return pa.RecordBatch.from_arrays(columns, ["row", "item_id", "uid", "doc_id", "score"])


def _search(counted: DataFrame, rows: np.ndarray, names: list, split: np.ndarray, weights: Weights, n_docs: int, total: int, k: int) -> DataFrame:
    """Each task's best documents of whole items, and all documents of split ones."""
    shared = counted.sparkSession.sparkContext.broadcast((rows, names, split, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, split, weights = shared.value
        best = Best(len(rows), k)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                numbers, ids = part.column("numbers"), part.column("doc_id")
                lengths = np.diff(numbers.offsets.to_numpy())
                at = np.repeat(np.arange(part.num_rows), lengths)
                sizes = part.column("n").to_numpy()[at]
                impact = impacts(part.column("times").flatten().to_numpy(), sizes, n_docs, total)
                scores = weights.scores(at, numbers.flatten().to_numpy(), impact, part.num_rows)
                ids, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                best.offer(np.where(split[:, None], 0, scores), ids, null)
                if split.any():
                    who, which = np.nonzero((scores > 0) & split[:, None])
                    yield _found(rows, names, who, part.column("uid").to_numpy()[which], ids[which], null[which], scores[who, which])
        who, place = np.nonzero(best.scores > 0)
        yield _found(rows, names, who, np.full(len(who), -1), best.ids[who, place], best.null[who, place], best.scores[who, place])

    return counted.mapInArrow(run, FOUND)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, doc_id_col: str = "doc_id", item_id_col: str = "item_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    asked, groups, any_split = grouped(stored(item_terms(items, item_id_col, text_col), "asked"), pairs)
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    if any_split:
        texts = stored(texts, "texts")  # so that a document has one uid in all groups
    found, n_docs, total = [], None, None
    for group in range(groups):
        held = asked.where(F.col("group") == group).select("row", "item_id", "term", "split").toArrow()  # fewer than 2 * pairs rows
        terms = {t: i for i, t in enumerate(sorted(set(held.column("term").to_pylist())))}
        counted = stored(count_terms(texts, terms).where("n > 0"), "counted")
        if n_docs is None:
            n_docs, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        holding = dict(counted.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df")).collect())
        numbers = np.array([terms[t] for t in held.column("term").to_pylist()])
        rows, at = np.unique(held.column("row").to_numpy(), return_inverse=True)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(terms))], float)
        names, split = [None] * len(rows), np.zeros(len(rows), bool)
        for i, name, cut in zip(at, held.column("item_id").to_pylist(), held.column("split").to_pylist(), strict=True):
            names[i], split[i] = name, cut
        found.append(_search(counted, rows, names, split, Weights(numbers, at, weight[numbers], len(terms), len(rows)), n_docs, total, k))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = reduce(DataFrame.unionAll, found)
    if any_split:
        best = stored(best, "found")
        sums = best.where("uid >= 0").groupBy("row", "item_id", "uid").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score"))
        best = best.where("uid < 0").unionByName(sums)
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    some = best.withColumn("salt", F.spark_partition_id() % SALT).withColumn("place", F.row_number().over(Window.partitionBy("row", "salt").orderBy(*order))).where(F.col("place") <= k)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
with d as (
  select row_number() over () as place, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
i as (
  select row_number() over () as asked, item_id,
    list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms
  from benchmark where text is not null),
s as (select count(*) as total, cast(sum(len(terms)) as bigint) as held from d where len(terms) > 0),
t as (select place, doc_id, len(terms) as n, unnest(terms) as term from d),
f as (select place, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from t group by place, term),
w as (select term, cast(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) as bigint) as w from f, s group by term, total),
q as (select asked, item_id, unnest(terms) as term from i),
g as (
  select asked, any_value(item_id) as item_id, place, any_value(doc_id) as doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // held)))) as bigint) as score
  from q join w using (term) join f using (term), s group by asked, place),
r as (
  select item_id, cast(row_number() over (partition by asked order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
  from g where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""
