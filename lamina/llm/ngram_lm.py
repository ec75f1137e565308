"""Language-model scores from a bigram trie spread over shards.

Documents are cut once into blocks of word numbers, stored as a table.  A block
asks for what it needs in two exchanges, each by one packed row to each shard:

1. its distinct words with their training counts; the shards add them up and
   answer with whole-corpus counts;
2. its distinct bigrams with their training counts; a shard adds them up, builds
   an Elias-Fano trie of their quantised smoothed probabilities, maps it from a
   file and answers with the probability codes.

A bigram's probability is (c(vw) + m p(w)) / (c(v) + m), p(w) the base model's;
its first part, log10 of c(vw) / (c(v) + m), is what the trie keeps, in 8 bits.
Shards grow in number with the corpus, and a context that would outgrow one is
split over several, so no task holds a share of the corpus that grows with it.
Words are 64-bit hashes; successors are 32 bits of another hash within their
context's part, whose size is bounded.

Defined results: a null text is empty and is its end alone; a null id counts as
the empty text's crc, thus held out; repeated rows are learned from as often as
they occur; a text of any length is in one block, which it may make larger; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, whole_text
from .elias_fano import Trie

_U = np.uint64
BITS = 32
START, END = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # hashes of no word: the context of a first word, and the end
BLOCKS = "block bigint, ids array<bigint>, held array<boolean>, lengths array<bigint>, tokens binary, words binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def token_blocks(docs: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    """Rows of about ``block_words`` tokens, each a number of the block's words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, made = TaskContext.get().partitionId(), 0

        def block(ids, lengths, numbers, known):
            nonlocal made
            words = np.array([END, *(xxhash.xxh3_64_intdigest(w) for w in list(known)[1:])], _U)
            flat = np.concatenate(numbers)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words have small numbers
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            flat = rank[flat]
            body = zlib.compress(_pack(flat.astype(np.uint16), (flat >> 16).astype(np.uint16)), 1)
            row = [[part << 32 | made], [ids], [[held_out(i) for i in ids]], [lengths], [body], [words[order].tobytes()]]
            made += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        ids, lengths, numbers, known, size = [], [], [], {None: 0}, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().lower().split()  # bytes: A-Z only, ASCII white space
                for w in set(words):
                    if w not in known:
                        known[w] = len(known)
                ids.append(key)
                lengths.append(len(words) + 1)
                numbers.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                numbers.append(np.zeros(1, np.uint32))
                size += len(words) + 1
                if size >= block_words:
                    yield block(ids, lengths, numbers, known)
                    ids, lengths, numbers, known, size = [], [], [], {None: 0}, 0
        if ids:
            yield block(ids, lengths, numbers, known)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(cut, BLOCKS)


class Block:
    """A block's tokens, and the order in which it asks the shards."""

    def __init__(self, row: dict):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        low, high = _unpack(zlib.decompress(row["tokens"]))
        self.tokens = low.astype(np.int64) | high.astype(np.int64) << 16
        self.words = np.frombuffer(row["words"], _U)
        self.trained = np.repeat(~self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trained], minlength=len(self.words))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, word) numbers of distinct bigrams, their training counts, and each token's bigram."""
        n = len(self.words)
        before = np.concatenate([[n], self.tokens[:-1]])
        before[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = n  # a document's first word follows START
        kinds, which = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        return kinds // (n + 1), kinds % (n + 1), np.bincount(which[self.trained], minlength=len(kinds)), which


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(shard[part[0]]), part


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its length and type."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<i8").tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for length, width in sizes.tolist():
        out.append(np.frombuffer(data, f"<u{width}", length, at))
        at += length * width
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint32 if top < 1 << 32 else _U)


_ASK = "block bigint, shard bigint, body binary"


def _asked(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, shard, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(shard, pa.int64()), pa.array(body, pa.binary())], ["block", "shard", "body"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(words) % _U(shards)).astype(np.int64)


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds, which = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(kinds), np.int64)
    np.add.at(sums, which, counts)
    return kinds, sums, which


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's whole-corpus counts, for each block; the last row has its tokens and kinds."""
    asked = [_unpack(b) for b in rows["body"]]
    _, sums, which = _add_up(np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]).astype(np.int64))
    ends = np.cumsum([len(a[0]) for a in asked])[:-1]
    bodies = [_pack(_narrow(c)) for c in np.split(sums[which], ends)]
    none = [0] * len(rows)
    return pd.DataFrame({"block": [*rows["block"], -1], "shard": [*rows["shard"], int(rows["shard"].iloc[0])], "body": [*bodies, b""], "tokens": [*none, int(sums.sum())], "kinds": [*none, int((sums > 0).sum())]})


def _answer_bigrams(rows: pd.DataFrame, pull: float) -> pd.DataFrame:
    """Build the shard's trie from all blocks' counts, then answer each block."""
    asked = []
    for body in rows["body"]:
        contexts, totals, sizes, after, counts = _unpack(body)
        of = np.repeat(np.arange(len(contexts)), sizes.astype(np.int64))
        asked.append((contexts, totals, of, after.astype(_U), counts.astype(np.int64)))
    every = np.concatenate([c[o] for c, _, o, _, _ in asked])
    totals = np.concatenate([t.astype(np.float64)[o] for _, t, o, _, _ in asked])
    after = np.concatenate([s for *_, s, _ in asked])
    counts = np.concatenate([c for *_, c in asked])
    order = np.lexsort((after, every))
    a, b, t = every[order], after[order], totals[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    sums = np.add.reduceat(counts[order], first)
    first, sums = first[sums > 0], sums[sums > 0]
    contexts, of = np.unique(a[first], return_inverse=True)
    trie = Trie(contexts, of, b[first], BITS, np.log10(sums / (t[first] + pull))).map_to()
    bodies = [_pack(trie.look_up(c, o, s), np.array([trie.floor, trie.step]).view(_U)) for c, _, o, s, _ in asked]
    return pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "body": bodies})


def _replies(answers: DataFrame, name: str) -> DataFrame:
    """A block's answers as one map; no more than the block itself asked for."""
    return answers.where("block >= 0").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("shard", "body"))).alias(name))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pull: float = 30.0, block_words: int = 2_000_000, shard_tokens: int = 2_000_000) -> DataFrame:
    """Scores of all texts under models of those not held out.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).
    """
    blocks = stored(token_blocks(docs, id_col, text_col, block_words), "blocks")
    size = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    shards = max(8, -(-size // shard_tokens))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            counts = block.word_counts()
            yield _asked([(row["block"], s, _pack(block.words[i], _narrow(counts[i]))) for s, i in _groups(_word_shard(block.words, shards))])

    asked = blocks.mapInArrow(ask_words, _ASK)
    words = stored(asked.groupBy("shard").applyInPandas(_count_words, _ASK + ", tokens bigint, kinds bigint"), "words")
    total, kinds = (int(x or 0) for x in words.agg(F.sum("tokens"), F.sum("kinds")).first())
    known = blocks.join(_replies(words, "words_of"), "block")

    def whole_counts(block: Block, reply: dict) -> np.ndarray:
        counts = np.zeros(len(block.words), np.int64)
        for s, i in _groups(_word_shard(block.words, shards)):
            counts[i] = _unpack(reply[s])[0]
        return counts

    begun = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0  # training documents: START's count
    most = max(1, total // (4 * shards))

    def bigram_places(block: Block, counts: np.ndarray):
        """Distinct bigrams grouped by shard, those of one context side by side."""
        before, word, seen, which = block.bigrams()
        contexts, totals = np.append(block.words, _U(START)), np.append(counts, begun)
        after = _mix(block.words[word]) >> _U(64 - BITS)
        parts = (totals[before] // most + 1).astype(_U)  # a large context lies in several shards
        part = _mix(block.words[word] + _U(1)) % parts
        shard = (_mix(contexts[before] + part * _U(0x9E3779B97F4A7C15)) % _U(shards)).astype(np.int64)
        return before, word, seen, which, contexts, totals, after, shard

    def ask_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            before, _, seen, _, contexts, totals, after, shard = bigram_places(block, whole_counts(block, dict(row["words_of"])))
            rows = []
            for s, i in _groups(shard):  # in order of `before`, as the bigrams are
                of, sizes = np.unique(before[i], return_counts=True)
                rows.append((row["block"], s, _pack(contexts[of], _narrow(totals[of]), _narrow(sizes), after[i].astype(np.uint32), _narrow(seen[i]))))
            yield _asked(rows)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        return _answer_bigrams(rows, pull)

    codes = known.mapInArrow(ask_bigrams, _ASK).groupBy("shard").applyInPandas(answer, _ASK)
    both = known.join(_replies(codes, "codes_of"), "block")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            counts = whole_counts(block, dict(row["words_of"]))
            before, word, _, which, _, totals, _, shard = bigram_places(block, counts)
            replies, found = dict(row["codes_of"]), np.zeros(len(before))
            for s, i in _groups(shard):
                code, scale = _unpack(replies[s])
                floor, step = scale.view(np.float64)
                found[i] = np.where(code > 0, 10 ** (floor + (code.astype(np.float64) - 1) * step), 0.0)
            base = (counts + 0.1) / (total + 0.1 * (kinds + 1))
            smooth = np.log10(found + pull * base[word] / (totals[before] + pull))
            starts = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])
            tokens = [np.log10(base)[block.tokens], smooth[which], (counts > 0)[block.tokens].astype(np.int64)]
            b, s, k = (np.add.reduceat(t, starts) for t in tokens)
            arrays = [pa.array(block.ids, pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(k), pa.array(np.full(len(k), total)), pa.array(b), pa.array(s)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return both.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
