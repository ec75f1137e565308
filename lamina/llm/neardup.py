"""Near-duplicates: min-max hashing, banded candidates, links on full sets.

A signature keeps both the least and the greatest value of a document's shingle
hashes under each permutation: two values for one evaluation, each equal in two
documents with probability their Jaccard similarity.  40 bands of 5 values find
a pair at similarity 0.8 but for one in eight million.

Copies first fall together into classes by a digest of their shingle set; one
document stands for its class.  In two turns the members of a bucket are compared
with a few leaders of other components, and links on full sets join components.
What still shares a bucket with another component then goes through an exact
prefix-filter join.  So a bucket of thousands of near copies costs a few
comparisons each, and no pair that shares a bucket is left unless one component
holds both already or the filter proves the two unlike.

Joins by bucket or by shingle are salted: what was aggregated for a key goes to
those of its 64 salts that occur, and a shingle in many prefixes meets itself in
cells of a bounded number of rows, so a hot key is no task's work alone.

Defined results: a document without words has an empty set and is its own
component; rows with a null id are never linked (component null, kept true);
repeated rows share a class; texts of any length are shingled whole; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.components import connected_components

from .common import slim, stored, whole_text

PERMUTATIONS, ROWS = 100, 5
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x ^ (x >> _U(31))


def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


class Shingler:
    """Distinct hashes of a text's runs of ``size`` words."""

    LIMIT = 150_000  # words whose hash is remembered, about 20 MB

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space
        if not words:
            return np.zeros(0, _U)
        known, digest = self.words, xxhash.xxh3_64_intdigest
        if len(known) > self.LIMIT:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        ids = np.fromiter(map(known.__getitem__, words), _U, len(words))
        size = min(self.size, len(words))
        out = np.zeros(len(words) - size + 1, _U)
        for j in range(size):
            out = _mix(out + ids[j : j + len(out)] + _U(j + 1))
        return np.unique(out + _U(size))


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value under each permutation."""
    low, high = [], []
    step = max(1, (1 << 17) // len(shingles))
    for i in range(0, len(multipliers), step):
        seen = multipliers[i : i + step, None] * shingles[None, :]
        low.append(seen.min(axis=1))
        high.append(seen.max(axis=1))
    return np.concatenate(low), np.concatenate(high)


def band_keys(low: np.ndarray, high: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; a band's values are of one kind."""
    bands = np.concatenate([low, high]).reshape(-1, rows)
    key = np.arange(len(bands), dtype=_U)
    for j in range(rows):
        key = _mix(key + bands[:, j])
    return key.view(np.int64)


def _hashed(docs: DataFrame, words: int) -> DataFrame:
    multipliers = _multipliers(PERMUTATIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        for batch in slim(batches):
            sizes, digests, bands = [], [], []
            for text in batch.column(1):
                s = cut(text.as_py() or "")
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(*signature(s, multipliers)) if len(s) else None)
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


#: Rows that a task remembers as seen, about 15 MB; what comes again later goes in the shuffle.
REMEMBERED = 100_000


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, digest, items) of each row; of rows repeated close together, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Shingler(words), set()
        for batch in slim(batches):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = cut(t.as_py() or "").tobytes()
                key = i, hashlib.blake2b(s, digest_size=16).digest()
                if len(seen) > REMEMBERED:
                    seen.clear()
                if key not in seen:
                    seen.add(key)
                    rows.append((*key, s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "digest", "items"])

    return docs.mapInArrow(run, "id bigint, digest binary, items binary")


#: Leaders that a bucket's members meet in a turn, and turns before the exact join of what is left.
LEADERS, TURNS = 6, 2


#: Parts of a hot key in a join: as many as a 64-bit mask has bits.
SALTS = 64
#: Members from which a bucket is split, and rows of a shingle's cell in the join of prefixes.
SPLIT, CELL = 512, 1024


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _mask(salt):
    """Aggregate: the salts that occur, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), salt)).alias("mask")


def _each_salt():
    """A row for each salt of the mask: never more than the key has rows."""
    bits = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return F.explode(F.filter(bits, lambda i: F.call_function("getbit", F.col("mask"), i) == 1)).alias("salt")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds both sets, x of a and y of b, to the pairs.

    The set of a document in many pairs, as a leader is, goes to its salts, any other
    to one place.  Both ends are joined with the same table, so it is shuffled once.
    """
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    hot = ends.groupBy("id").agg(F.count(F.lit(1)).alias("c"), _mask(_salt("other"))).where(F.col("c") > SPLIT)
    hot = stored(hot.select("id", _each_salt()), "hot")
    if hot.isEmpty():
        sent = sets.select("id", F.lit(-1).alias("salt"), "items")
    else:
        sent = sets.select("id", F.lit(-1).alias("salt"), "items").unionByName(sets.join(hot, "id").select("id", "salt", "items"))
    for end, other in (("a", "b"), ("b", "a")):
        mine = hot.select(F.col("id").alias(end), F.col("salt").alias(f"salt_{end}"), F.lit(True).alias("hot"))
        pairs = pairs.withColumn(f"salt_{end}", _salt(other)).join(mine, [end, f"salt_{end}"], "left")
        pairs = pairs.withColumn(f"salt_{end}", F.when(F.col("hot"), F.col(f"salt_{end}")).otherwise(-1)).drop("hot")
    for end, name in (("b", "y"), ("a", "x")):
        pairs = pairs.join(sent.select(F.col("id").alias(end), F.col("salt").alias(f"salt_{end}"), F.col("items").alias(name)), [end, f"salt_{end}"])
    return pairs.select("p", "q", "x", "y")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(p, q) of the pairs (a, b, p, q) whose full sets are ``percent`` % alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                every = np.concatenate([s, t])
                every.sort(kind="stable")
                both = int((every[1:] == every[:-1]).sum())  # each set is distinct
                keep.append(100 * both >= percent * (len(every) - both))
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("q")], ["p", "q"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "p bigint, q bigint").distinct()


def _alike(n, m, percent: int):
    """Set sizes that allow the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _with_leaders(now: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member with its bucket's leaders of other components.

    A leader has the least hash of its bucket, so buckets that share most of
    their members share their leaders too, and a pair is met once.
    """
    leaders = [F.min(F.struct(F.xxhash64("id", F.lit(turn * LEADERS + j)), "id", "n", "part")).alias(f"l{j}") for j in range(LEADERS)]
    leads = now.groupBy("key").agg(_mask(F.col("salt")), *leaders).select("key", _each_salt(), F.array_distinct(F.array(*(F.struct(f"l{j}.id", f"l{j}.n", f"l{j}.part") for j in range(LEADERS)))).alias("leads"))
    both = now.join(leads, ["key", "salt"]).select("id", "part", F.explode(F.filter("leads", lambda x: (x["part"] != F.col("part")) & _alike(x["n"], F.col("n"), percent))).alias("x"))
    return _pairs(both, F.col("x.id"), F.col("x.part"))


def _by_prefixes(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What is left, exactly: pairs of components by the prefix filter.

    With each set's items from the rarest on, two sets that are alike share an
    item among the first n - ceil(p n) + 1 of both, and at the first they share
    enough items must follow.  Heavily edited copies of one text begin with their
    own edits, so they do not meet, however many they are.  ``sets`` has each
    set once; an id with several texts has several sets, each with its own size.
    """

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            lists = pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("items")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("which"), lists], ["id", "which", "items"])

    those = sets.join(left.select("id"), "id", "left_semi").select("id", F.xxhash64("digest").alias("which"), "items")
    each = those.mapInArrow(items, "id bigint, which bigint, items array<bigint>").select("id", "which", F.explode("items").alias("item"))
    each = stored(each, "items")
    each = each.withColumn("salt", _salt("id", "which"))
    often = each.groupBy("item").agg(F.count(F.lit(1)).alias("often"), _mask(F.col("salt"))).where("often > 1").select("item", "often", _each_salt())
    ordered = each.join(often, ["item", "salt"], "left").groupBy("id", "which").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "item"))).alias("items"))
    length = (F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1).cast("int")
    first = ordered.withColumn("n", F.size("items").cast("bigint")).join(left, "id").select("id", "n", "part", F.posexplode(F.slice("items", F.lit(1), length)).alias("at", "x"))
    # An item of many sets is cut into g x g cells: each row goes to the g cells of its side.
    first = first.where("x.often > 1").select("id", "n", "part", (F.col("at") + 1).alias("at"), F.col("x.item").alias("item"), F.expr(f"1 + x.often div {CELL}").alias("g"))
    first = first.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g"))).withColumn("yours", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1)))
    other = first.select("item", F.col("yours").alias("mine"), F.col("mine").alias("yours"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("part").alias("part2"), F.col("at").alias("at2"))
    enough = (1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))) * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    both = first.join(other, ["item", "mine", "yours"]).where((F.col("part") < F.col("part2")) & _alike(F.col("n"), F.col("n2"), percent) & enough)
    return _pairs(both, F.col("id2"), F.col("part2"))


def _pairs(both: DataFrame, id2, part2) -> DataFrame:
    first = F.col("id") < id2
    return both.select(F.least("id", id2).alias("a"), F.greatest("id", id2).alias("b"), F.when(first, F.col("part")).otherwise(part2).alias("p"), F.when(first, part2).otherwise(F.col("part")).alias("q")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = stored(_hashed(texts, words), "bands")
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")

    members = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), _mask(_salt("id"))).where("c > 1").select("key", "c", _each_salt())
    # (key, salt, id, n, c) of buckets with two members at least; from here only large ones have more than one salt
    buckets = members.join(shared.withColumnRenamed("key", "held"), (F.col("key") == F.col("held")) & (_salt("id") == F.col("salt")))
    buckets = buckets.select("key", F.when(F.col("c") > SPLIT, F.col("salt")).otherwise(0).alias("salt"), "id", "n", "c")
    buckets = stored(buckets, "buckets")

    ids = buckets.select("id").distinct()
    wanted = classes.join(ids, "id", "left_semi").select("id", "digest")
    sets = _sets(texts.join(ids, texts.doc_id == ids.id, "left_semi"), words)
    sets = stored(sets.join(wanted, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "sets")

    places = ids.select("id", F.col("id").alias("part"))  # each class's component so far
    now = buckets.join(places, "id")
    for turn in range(TURNS + 1):
        if turn < TURNS:
            tried = _with_leaders(now, turn, percent)
        else:
            left = now.select("id", "part").distinct()
            tried = _by_prefixes(left, sets, percent)
        links = stored(_linked(tried, sets, percent), "links")
        if not links.isEmpty():
            roots = connected_components(links, "p", "q").select(F.col("id").alias("part"), "component")
            places = stored(places.join(roots, "part", "left").select("id", F.coalesce("component", "part").alias("part")), "places")
        if turn < TURNS:  # what goes on: buckets of three members or more, in several components
            now = buckets.where("c > 2").join(places, "id")
            spread = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), _mask(F.col("salt"))).where("lo < hi")
            now = stored(now.join(spread.select("key", _each_salt()), ["key", "salt"], "left_semi"), "open")
            if now.isEmpty():
                break

    found = classes.select("digest", "id").join(places, "id", "left").select("digest", F.coalesce("part", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
