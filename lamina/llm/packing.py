"""Best-fit packing of documents into sequences by minimum bin slack.

Only lengths matter to a bin, and there are at most ``capacity`` of them.  So
Spark counts the pieces of each length, the driver packs that table (at most
``capacity`` rows whatever the corpus) and Spark deals the bins out again by
each piece's rank among the pieces of its length.

A bin: the longest length left is placed, then a subset-sum bitset over the
lengths left finds the fullest feasible rest.  The bin found is the fullest
until one of its lengths runs out, so it is removed as often as the counts
allow at once; every such step ends a length, which bounds the steps.

Defined results: a null text is empty (its end id alone); a null id stays null
and its pieces are packed like any; a text of any length is cut into pieces;
repeated rows, and pieces of one length, are packed as often as they occur, in
any order among equals; other columns are not read, so their names do not
matter; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slim, stored, whole_text
from .units import encoder, slices

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids into pieces of at most ``capacity``."""
    schema = PIECES + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in slim(batches):
            rows = []
            encoded = (x for part in slices(batch.column(1).to_pylist()) for x in codec.encode(part))
            for key, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(cut, schema)


def _fill(counts: dict[int, int], room: int) -> list[int]:
    """Lengths whose sum is the largest possible up to ``room``; longest first.

    Bit s of ``reach[i]`` tells that the first i kinds of length can sum to s;
    a count is split into powers of two, so each kind takes few shifts.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = [1], []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, unit = min(counts[size], room // size), 1
        while left > 0:
            take = min(unit, left)
            steps.append((size, take))
            reach.append((reach[-1] | reach[-1] << (size * take)) & mask)
            left -= take
            unit *= 2
        if reach[-1] >> room & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(steps) - 1, -1, -1):
        if not reach[i] >> total & 1:
            size, take = steps[i]
            chosen += [size] * take
            total -= size * take
    return sorted(chosen, reverse=True)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times), by minimum bin slack over a table of counts."""
    counts = {s: n for s, n in counts.items() if n > 0}
    bins = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        if not counts[top]:
            del counts[top]
        found = [top, *_fill(counts, capacity - top)]
        counts[top] = counts.get(top, 0) + 1
        uses = {s: found.count(s) for s in set(found)}
        times = min(counts[s] // k for s, k in uses.items())
        for s, k in uses.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        bins.append((found, times))
    return bins


def slots(bins: list[tuple[list[int], int]]) -> list[tuple]:
    """For each length and bin pattern: the ranks it serves and the offsets.

    (length, first rank, uses in a bin, first bin, offsets).  Their number is
    bounded by the lengths' number and the capacity, not by the corpus.
    """
    rows, first_bin, served = [], 0, {}
    for found, times in bins:
        offsets, at = {}, 0
        for s in found:
            offsets.setdefault(s, []).append(at)
            at += s
        for s, places in offsets.items():
            rows.append((s, served.get(s, 0), len(places), first_bin, places))
            served[s] = served.get(s, 0) + len(places) * times
        first_bin += times
    return rows


#: Pieces that one part of a length should hold at most, about.
PART = 100_000


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    ``pieces`` is read twice: give a stored table.  A length's pieces are ranked
    in parts by the order columns' hash, and the parts grow in number with the
    table, so a length that a third of all pieces share is no single task's work.
    """
    spark = pieces.sparkSession
    parts = max(64, -(-pieces.count() // PART))
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    by_part = stored(dealt.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n")), "lengths")
    totals = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    if not totals:
        return pieces.withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint"))
    # A slot is one pattern's use of a length, for ranks from `first` up to the next slot's.
    plan = spark.createDataFrame(slots(pack_lengths(totals, capacity)), "length bigint, first long, uses int, bin long, places array<bigint>")
    plan = plan.withColumn("next", F.coalesce(F.lead("first").over(Window.partitionBy("length").orderBy("first")), F.lit((1 << 63) - 1)))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_part.select("length", "__part", "__n", F.coalesce(before, F.lit(0)).alias("__before"))
    # The slots that a part's ranks meet; the parts of a length follow one another, so there
    # are hardly more of these rows than parts and slots together.
    met = starts.join(plan, "length").where((F.col("first") < F.col("__before") + F.col("__n")) & (F.col("next") > F.col("__before")))
    slot = F.struct((F.col("first") - F.col("__before")).alias("at"), "uses", "bin", "places")
    met = met.groupBy("length", "__part").agg(F.sort_array(F.collect_list(slot)).alias("__slots"))
    rank = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*order)) - 1
    placed = dealt.withColumn("__rank", rank).join(met, ["length", "__part"])
    placed = placed.withColumn("__slot", F.element_at("__slots", _last_at_most(F.col("__rank"))))
    nth = F.col("__rank") - F.col("__slot.at")
    return placed.select(
        *(F.col(c) for c in pieces.columns),
        (F.col("__slot.bin") + F.floor(nth / F.col("__slot.uses"))).cast("bigint").alias("sequence_id"),
        F.element_at("__slot.places", (nth % F.col("__slot.uses") + 1).cast("int")).alias("offset"),
    )


def _last_at_most(rank: Column) -> Column:
    """Place, from 1, of the last slot that begins at ``rank`` or before: a binary search."""

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
        right = F.col("__slots")[middle - 1]["at"] <= rank
        return F.struct(F.when(right, middle).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle - 1).alias("high"))

    whole = F.struct(F.lit(1).alias("low"), F.size("__slots").alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("__slots").cast("double") + 1)).cast("int"))
    return F.aggregate(steps, whole, halve)["low"]


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    pieces = token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col)
    # The stored number spreads pieces whose id many rows share.
    return pack(stored(pieces.withColumn("turn", F.monotonically_increasing_id()), "pieces"), capacity, ("turn",)).drop("turn")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
