"""Hierarchical merging of segments, best pair first, from a queue of ``LEVELS`` levels.

Pairs are in order of their score's level, then of a tie-breaker of their own: a hash
of the pair they began as, and of two pairs that become one the greater.  No union
is better than its better part, so a pair that is the best of both its ends merges
whatever happens elsewhere, and all such pairs may merge at once.

A round deals the segments to blocks by ranges of their ids, which follow space, and
merges inside each block with a heap; a pair that leaves the block stops the segment
at its end.  Then the pairs that are each other's best across blocks merge by joins.
Blocks grow from round to round, so a chain of rising scores takes a number of rounds
that is logarithmic in its length; a graph of one block is done in one.  A segment of
more pairs than a block may hold is in no block and merges by the joins alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import cut, release

from .graph import boundary_pairs, merge_segments, relabel

BINS = LEVELS = 256
PAIR = ["sample", "lo", "hi"]


def _median_bin(hist: Column) -> Column:
    """Middle of the first bin, of sorted (bin, n), up to which half of all faces lie."""
    half = F.aggregate(hist, F.lit(0).cast("bigint"), lambda s, b: s + b["n"]) / 2
    start = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(None).cast("int").alias("bin"))
    found = F.aggregate(hist, start, lambda s, b: F.struct((s["run"] + b["n"]).alias("run"), F.when(s["bin"].isNull() & (s["run"] + b["n"] >= half), b["bin"]).otherwise(s["bin"]).alias("bin")))
    return (found["bin"] + 0.5) / BINS


def median_of(hist: dict[int, int]) -> float:
    """The same of a histogram in memory."""
    total, run = sum(hist.values()), 0
    for b in sorted(hist):
        run += hist[b]
        if 2 * run >= total:
            return (b + 0.5) / BINS
    raise ValueError("an empty histogram")


#: By name: whether a pair begins with its greatest affinity alone, its score as a column, and in memory.
SCORINGS: dict[str, tuple[bool, Callable[[], Column], Callable[[dict, float, float], float]]] = {
    "hist_quantile": (True, lambda: _median_bin(F.col("hist")), lambda hist, least, most: median_of(hist)),
    "hist_quantile_false": (False, lambda: _median_bin(F.col("hist")), lambda hist, least, most: median_of(hist)),
    "min": (False, lambda: F.col("least"), lambda hist, least, most: least),
    "max": (False, lambda: F.col("most"), lambda hist, least, most: most),
}


def pair_faces(vox: DataFrame, segment: str, begin_with_greatest: bool) -> DataFrame:
    """(sample, lo, hi, bin, n, least, most, tie): the histogram that each pair begins with."""
    faces = boundary_pairs(vox, segment)
    bin_of = lambda w: F.greatest(F.least(F.floor(w * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    tie = F.xxhash64("lo", "hi").alias("tie")
    if begin_with_greatest:
        top = faces.groupBy(*PAIR).agg(F.min("w").alias("least"), F.max("w").alias("most"))
        return top.select(*PAIR, bin_of(F.col("most")).alias("bin"), F.lit(1).cast("bigint").alias("n"), "least", "most", tie)
    return faces.groupBy(*PAIR, bin_of(F.col("w")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most")).withColumn("tie", tie)


def _scored(faces: DataFrame, scoring: str, least: float) -> DataFrame:
    """One row a pair, of BINS entries at most, with level and whether it passes."""
    pairs = faces.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("hist"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("tie").alias("tie"))
    pairs = pairs.withColumn("score", SCORINGS[scoring][1]())
    level = F.greatest(F.least(F.floor(F.col("score") * LEVELS), F.lit(LEVELS - 1)), F.lit(0)).cast("int")
    return pairs.withColumns({"level": level, "passes": F.col("score") >= least}).drop("score")


def merge_block(pairs: list[tuple], score: Callable[[dict, float, float], float], least: float) -> list[tuple]:
    """(sample, id, to) of all segments that merge away in what a block can decide alone.

    ``pairs``: (sample, lo, hi, histogram, least, most, tie, whether lo and hi are in
    the block).  A heap gives the pairs in order.  A pair that leaves the block, or one
    of whose ends is stopped, stops its ends: what is worse than it must wait for it.
    """
    sides: dict[tuple, dict[tuple, int]] = {}  # by segment: the other segment, the pair
    name: dict[tuple, int] = {}  # by segment: the least id merged into it
    data: list[list | None] = []
    heap: list[tuple] = []
    outside, stopped, into = set(), set(), {}

    def offer(i: int) -> None:
        (_, _, hist, low, high, tie) = data[i]
        s = score(hist, low, high)
        if s >= least:
            heapq.heappush(heap, (-min(max(int(s * LEVELS), 0), LEVELS - 1), tie, i, sum(hist.values())))

    for sample, lo, hi, hist, low, high, tie, lo_in, hi_in in pairs:
        a, b = (sample, lo), (sample, hi)
        data.append([a, b, dict(hist), low, high, tie])
        for s, inside in ((a, lo_in), (b, hi_in)):
            sides.setdefault(s, {})
            name[s] = s[1]
            if not inside:
                outside.add(s)
        sides[a][b] = sides[b][a] = len(data) - 1
        offer(len(data) - 1)
    while heap:
        _, _, i, faces = heapq.heappop(heap)
        pair = data[i]
        if pair is None or sum(pair[2].values()) != faces:
            continue  # gone, or grown since
        a, b = pair[:2]
        if a in outside or b in outside or a in stopped or b in stopped:
            stopped.update((a, b))
            continue
        if len(sides[a]) < len(sides[b]):
            a, b = b, a
        data[i] = None
        del sides[a][b], sides[b][a]
        for other, j in sides.pop(b).items():
            del sides[other][b]
            mine = sides[a].get(other)
            if mine is None:
                data[j][0], data[j][1] = a, other
                sides[a][other] = sides[other][a] = j
                continue
            hist, gone = data[mine][2], data[j]
            for bin_, n in gone[2].items():
                hist[bin_] = hist.get(bin_, 0) + n
            data[mine][3], data[mine][4], data[mine][5] = min(data[mine][3], gone[3]), max(data[mine][4], gone[4]), max(data[mine][5], gone[5])
            data[j] = None
            offer(mine)
        keep, lose = sorted((name[a], name[b]))
        into[a[0], lose] = name[a] = keep
    out = []
    for (sample, id_), to in into.items():
        while (sample, to) in into:
            to = into[sample, to]
        out.append((sample, id_, to))
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("sample", "level", "tie", "lo", "hi", F.explode(F.array("lo", "hi")).alias("id"))


def _inside_blocks(pairs: DataFrame, scoring: str, least: float, blocks: int, capacity: int) -> DataFrame:
    """(sample, id, to): what blocks merge by themselves."""
    degree = pairs.select("sample", F.explode(F.array("lo", "hi")).alias("id")).groupBy("sample", "id").agg(F.count(F.lit(1)).alias("n"))
    small = degree.where(F.col("n") <= capacity).select("sample", "id")
    dealt = cut((small.repartitionByRange(blocks, "sample", "id") if blocks > 1 else small.coalesce(1)).withColumn("block", F.spark_partition_id()))
    placed = pairs
    for end in ("lo", "hi"):
        placed = placed.join(dealt.select("sample", F.col("id").alias(end), F.col("block").alias(f"block_{end}")), ["sample", end], "left")
    sent = placed.withColumn("block", F.explode(F.array_distinct(F.array_compact(F.array("block_lo", "block_hi")))))
    flat = sent.select("block", *PAIR, F.col("hist.bin").alias("bins"), F.col("hist.n").alias("counts"), "least", "most", "tie", *(F.coalesce(F.col(f"block_{e}") == F.col("block"), F.lit(False)).alias(f"{e}_in") for e in ("lo", "hi")))
    plain = SCORINGS[scoring][2]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hists = (dict(zip(b, n, strict=True)) for b, n in zip(rows.pop("bins"), rows.pop("counts"), strict=True))
        named = zip(rows["sample"], rows["lo"], rows["hi"], hists, rows["least"], rows["most"], rows["tie"], rows["lo_in"], rows["hi_in"], strict=True)
        return pd.DataFrame(merge_block(list(named), plain, least), columns=["sample", "id", "to"])

    moves = cut(flat.groupBy("block").applyInPandas(run, "sample string, id bigint, to bigint"))
    release(dealt)
    return moves


def _across(pairs: DataFrame) -> DataFrame:
    """(sample, id, to) of the passing pairs that are the best of both their ends."""
    key = F.struct((-F.col("level")).alias("below"), "tie", "lo", "hi")
    best = _ends(pairs.where("passes")).groupBy("sample", "id").agg(F.min(key).alias("key"))
    return best.groupBy("sample", F.col("key.lo").alias("to"), F.col("key.hi").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("sample", "id", "to")


def _moved(pairs: DataFrame, moves: DataFrame) -> DataFrame:
    """Faces of the pairs after the merges, as rows by bin."""
    rows = pairs.select(*PAIR, "least", "most", "tie", F.explode("hist").alias("h")).select(*PAIR, "h.bin", "h.n", "least", "most", "tie")
    for end in ("lo", "hi"):
        rows = rows.join(moves.select("sample", F.col("id").alias(end), F.col("to").alias(f"to_{end}")), ["sample", end], "left")
    a, b = F.coalesce("to_lo", "lo"), F.coalesce("to_hi", "hi")
    rows = rows.where(a != b).select("sample", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "bin", "n", "least", "most", "tie")
    return rows.groupBy(*PAIR, "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("tie").alias("tie"))


def hierarchical_agglomeration(vox: DataFrame, segment: str, threshold: float, scoring: str = "hist_quantile", out: str = "segment", block: int = 20_000, most: int = 640_000, report: list | None = None) -> DataFrame:
    """Merge the pair of highest affinity first, while it is at least 1 - ``threshold``.

    ``hist_quantile`` begins each pair with its greatest affinity alone,
    ``hist_quantile_false`` with all its faces; from then on merged pairs add up their
    histograms, and the median bin is the score.  ``block`` pairs make a block in the
    first round, twice as many in each further one, ``most`` at the end.  ``report``
    is given the number of merges inside blocks of each round.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}")
    least = 1 - threshold
    faces, rounds, capacity = pair_faces(vox, segment, SCORINGS[scoring][0]), [], block
    while True:
        pairs = cut(_scored(faces, scoring, least))
        release(faces)
        # A segment without a pair that passes never merges again and leaves.
        live = _ends(pairs.where("passes")).select("sample", "id").distinct()
        alive = cut(reduce(lambda p, end: p.join(live.withColumnRenamed("id", end), ["sample", end], "left_semi"), ("lo", "hi"), pairs))
        release(pairs)
        n = alive.count()
        blocks = -(-n // capacity)
        if n == 0:
            break
        moves = _inside_blocks(alive, scoring, least, blocks, capacity)
        rounds.append(moves)
        if report is not None:
            report.append(moves.count())
        if blocks == 1:
            break
        rest = cut(_scored(_moved(alive, moves), scoring, least))
        crossed = cut(_across(rest))
        rounds.append(crossed)
        faces = cut(_moved(rest, crossed))
        release(alive, rest)
        capacity = min(2 * capacity, most)
    release(alive)
    if not rounds:
        return relabel(vox, segment, out)
    joins = (r.select("sample", F.col("to").alias("lo"), F.col("id").alias("hi")) for r in rounds)
    return merge_segments(vox, segment, reduce(DataFrame.unionAll, joins), out)
