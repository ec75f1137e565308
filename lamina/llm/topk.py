"""Exact top-k by inner product: ball trees, branch and bound.

Rows are dealt to shards; each shard's task builds a ball tree of its vectors.
Queries travel in blocks.  First a block meets one shard, which gives each of its
queries a k-th score that holds everywhere; then blocks and trees meet by chunk of
blocks and group of shards, and a node is cut where its upper bound falls below
that score or a better one found since.  In a tree each query visits the child
with the larger bound first.  A group's best rows, k a query at most, are merged
by a shuffle of their own.

Both groups of shards and chunks of blocks are bounded in size, so a task holds
few trees, and what is sent grows as the table times the number of chunks, a
small fraction of all pairs.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors of unlike lengths are compared within their length only;
rows with a null id take no part; a repeated row is asked, and is a candidate, as
often as it occurs, only a query's own row is none; ties go to the smaller id;
an empty table gives no row; other columns are not read.  Scores are exact as
long as they fit a 64-bit integer; one that does not is an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

LEAF = 128


class BallTree:
    """Vectors of one shard, split by the direction of their two far ends."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # start, end, left, right
        centres, radii = [], []

        def grow(start: int, end: int) -> int:
            own = vectors[order[start:end]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append((start, end, -1, -1))
            centres.append(centre)
            radii.append(far.max())
            if end - start > LEAF and radii[me] > 0:
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                side = own @ (a - b)
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(side, half)]
                left = grow(start, start + half)
                self.nodes[me] = (start, end, left, grow(start + half, end))
            return me

        grow(0, len(ids))
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No inner product under the node is larger (rounding allowed for)."""
        far = norms * self.radii[node]
        near = queries @ self.centres[node]
        return near + far + 1e-6 * (1 + far + np.abs(near))


#: The score of a place that is not taken yet.
NONE = np.iinfo(np.int64).min
#: Integers below it are exact as doubles.
EXACT = float(1 << 53)


class Best:
    """The k best (score, id) found so far for each query of a block.

    ``floor`` holds scores that a query's k-th best reaches anyway.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.rows, self.own, self.queries, self.k = rows, ids, queries, k
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.floor = np.full(len(ids), NONE) if floor is None else floor
        self.scores = np.full((len(ids), k), NONE)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def least(self, who: np.ndarray) -> np.ndarray:
        """What a candidate must score to matter."""
        return np.maximum(self.scores[who, -1], self.floor[who])

    def offer(self, who: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = products(self.queries[who], vectors)
        scores[self.rows[who][:, None] == rows[None, :]] = NONE
        hit = ((scores >= self.least(who)[:, None]) & (scores > NONE)).any(axis=1)
        if not hit.any():
            return
        who, scores = who[hit], scores[hit]
        scores = np.concatenate([self.scores[who], scores], axis=1)
        names = np.concatenate([self.ids[who], np.broadcast_to(ids, (len(who), len(ids)))], axis=1)
        names = np.where(scores == NONE, np.iinfo(np.int64).max, names)
        best = np.lexsort((names, ~scores), axis=1)[:, : self.k]  # ~ turns the order round without overflow
        self.scores[who] = np.take_along_axis(scores, best, 1)
        self.ids[who] = np.take_along_axis(names, best, 1)

    def search(self, tree: BallTree) -> None:
        stack = [(0, np.arange(len(self.own)))]
        while stack:
            node, who = stack.pop()
            start, end, left, right = tree.nodes[node]
            who = who[tree.bound(node, self.queries[who], self.norms[who]) >= self.least(who)]
            if not len(who):
                continue
            if left < 0:
                for a in range(0, len(who), 2048):
                    self.offer(who[a : a + 2048], tree.rows[start:end], tree.ids[start:end], tree.vectors[start:end])
                continue
            q, norms = self.queries[who], self.norms[who]
            first = tree.bound(left, q, norms) >= tree.bound(right, q, norms)
            for near, far, own in ((left, right, who[first]), (right, left, who[~first])):
                if len(own):
                    stack += [(far, own), (near, own)]  # the last is visited first


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors given as doubles.

    Where doubles might round, 64-bit integers are multiplied: they wrap round on
    the way, but a result that fits is right.
    """
    scores = a @ b.T
    if np.sqrt((a**2).sum(axis=1)).max() * np.sqrt((b**2).sum(axis=1)).max() < EXACT:
        return scores.astype(np.int64)
    if np.abs(scores).max() >= float(1 << 63) * (1 - 1e-9):
        raise OverflowError("a score does not fit a 64-bit integer")
    return a.astype(np.int64) @ b.astype(np.int64).T


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim) of vectors without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def _integers(column: pd.Series, scale: int) -> np.ndarray:
    out = np.floor(np.array(column.to_list(), dtype=np.float64) * scale)
    if out.size and np.abs(out).max() >= float(1 << 63):
        raise OverflowError("a component does not fit a 64-bit integer")
    return out


#: Blocks of a chunk, and shards of a group at most.
CHUNK, GROUP = 32, 16


def top_k(table: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): rows whose id ``every`` divides are asked."""
    # The number tells rows apart that repeat an id; it is stored, so it stays.
    vectors = stored(whole_vectors(table, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = vectors.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // every // block_rows))
    wide = min(GROUP, max(1, shards // 256))  # few shards are a group each
    groups, chunks = -(-shards // wide), -(-blocks // CHUNK)

    def plant(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(rows["row"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), _integers(rows["v"], scale))
        return pd.DataFrame({"dim": [keys[0]], "shard": [keys[1]], "tree": [pickle.dumps(tree)]})

    def gather(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        body = rows["row"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), _integers(rows["v"], scale)
        return pd.DataFrame({"dim": [keys[0]], "block": [keys[1]], "body": [pickle.dumps(body)]})

    def seed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            floors = []
            for body, tree in zip(part["body"], part["tree"], strict=True):
                best = Best(*pickle.loads(body), k)
                if tree is not None:
                    best.search(pickle.loads(tree))
                floors.append(best.scores[:, -1].astype("<i8").tobytes())
            yield part[["dim", "block", "body"]].assign(floor=floors)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, trees = None, []
        for part in parts:
            for dim, group, chunk, body, floor in part[["dim", "group", "chunk", "body", "floor"]].itertuples(index=False, name=None):
                if (dim, group, chunk) != key:
                    key, trees = (dim, group, chunk), []
                if floor is None:
                    trees.append(pickle.loads(body))
                    continue
                best = Best(*pickle.loads(body), k, np.frombuffer(floor, "<i8"))
                for tree in trees:
                    best.search(tree)
                yield _rows(best)

    trees = vectors.groupBy("dim", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")).applyInPandas(plant, "dim int, shard bigint, tree binary")
    trees = stored(trees, "trees")
    asked = vectors.where(F.col("vec_id") % every == 0)
    asked = asked.groupBy("dim", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).alias("block")).applyInPandas(gather, "dim int, block bigint, body binary")
    asked = asked.withColumn("shard", F.col("block") % shards).join(trees, ["dim", "shard"], "left").mapInPandas(seed, "dim int, block bigint, body binary, floor binary")
    asked = stored(asked, "asked")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    sent = trees.select("dim", F.expr(f"shard div {wide}").alias("group"), each(chunks).alias("chunk"), F.lit(0).alias("turn"), F.col("tree").alias("body"), F.lit(None).cast("binary").alias("floor"))
    met = sent.union(asked.select("dim", each(groups).alias("group"), F.expr(f"block div {CHUNK}").alias("chunk"), F.lit(1).alias("turn"), "body", "floor"))
    met = met.repartition(min(groups * chunks, 20_000), "dim", "group", "chunk").sortWithinPartitions("dim", "group", "chunk", "turn")
    found = met.mapInPandas(search, "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(best: Best) -> pd.DataFrame:
    found = best.scores > NONE
    who, _ = np.nonzero(found)
    return pd.DataFrame({"row": best.rows[who], "query_id": best.own[who], "vec_id": best.ids[found], "score": best.scores[found]})


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
with v as (
  select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * 64)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.place, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on c.place <> q.place and len(c.v) = len(q.v)
  where q.vec_id % 20 = 0),
r as (
  select query_id, cast(row_number() over (partition by place order by score desc, vec_id) as integer) as rank, vec_id, score
  from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
