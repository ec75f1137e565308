"""Secrets: fixed patterns, and a token-efficiency test for random strings.

A string that a vocabulary spells with few characters per token was not written
by people.  Candidates are unbroken runs of 16 characters or more, and of a dotted run
each part of that length.  Known digests and identifiers are set aside: digests by
their lengths, UUIDs, times, and runs without a letter.  Of all others the ratio alone
decides, whatever their length, case and alphabet.

Defined results: a null text is empty and has no span; a null id stays null;
repeated rows give repeated results; texts of any length are scanned whole; spans
that begin together are in order of kind; an empty table gives no row; other
columns are not read, or kept as they are where texts are redacted.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slim, whole_text

KINDS = ("assign", "access", "hex", "random")

#: Key words in either ASCII case, spelled out so that no other letter folds in.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"(?:{_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
#: Runs for the efficiency test: key-like characters, 16 or more; a full stop ends a run.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Characters a token up to which a run counts as random.
MAX_RATIO = 2.0

_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_DIGEST = re.compile(r"[0-9a-fA-F]+\Z")
#: Times such as 20240115T102233Z, 2024-01-15T10-22-33 and 2024-01-15T10-22-33-0500.
_TIME = re.compile(r"[0-9]{4}[-/_]?[0-9]{2}[-/_]?[0-9]{2}[Tt_-]?[0-9]{2}[-_]?[0-9]{2}(?:[-_]?[0-9]{2})?(?:[Zz]|[+-][0-9]{2}-?[0-9]{2})?\Z")
_LETTER = re.compile("[A-Za-z]")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))


def excluded(run: str) -> bool:
    """Digests of known lengths, UUIDs, times, and runs without a letter."""
    return not _LETTER.search(run) or bool(_UUID.match(run) or _TIME.match(run) or _DIGEST.match(run) and len(run) in DIGEST_LENGTHS)


class Efficiency:
    """Characters per token under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / max(1, len(self.encoding.encode_ordinary(run)))


_LOADED: dict[tuple[str, str], Efficiency] = {}


def _efficiency(path: str, pattern: str) -> Efficiency:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Efficiency(path, pattern)
    return _LOADED[path, pattern]


_HINT = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr]|[Tt][Oo][Kk][Ee]|[Aa][Pp][Ii]_?[Kk]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; failing matches are dropped."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], test: Efficiency, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Runs of ``max_ratio`` characters a token or fewer, clear of base spans."""
    out = []
    for m in RUN.finditer(text):
        if excluded(m.group()) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if test.ratio(m.group()) <= max_ratio:
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(docs: DataFrame, vocabulary: str, pattern: str, max_ratio: float, give, schema, text_col: str = "text") -> DataFrame:
    """Scan each text; ``give(batch, row, text, base, spans)`` makes a result row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = to_arrow_schema(StructType.fromDDL(schema)) if isinstance(schema, str) else to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _efficiency(vocabulary, pattern)
        for batch in slim(batches):
            rows = []
            for i, text in enumerate(batch.column(text_col)):
                text = text.as_py() or ""
                base = base_spans(text)
                rows.append(give(batch, i, text, base, sorted(base + added_spans(text, base, test, max_ratio))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)

    return docs.mapInArrow(scan, schema)


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, counts of base kinds, base digest, all spans as text)."""

    def give(batch, i, text, base, spans):
        kinds = Counter(k for _, k, _ in base)
        return batch.column("doc_id")[i].as_py(), kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return _scan(rows, vocabulary, pattern, max_ratio, give, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start > at:
            out.append(text[at:start])
        if start >= at:
            out.append(mark)
        at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", mark: str = "[secret]", max_ratio: float = MAX_RATIO) -> DataFrame:
    """The same rows and columns, each secret in the text replaced by ``mark``.

    A text without secrets, or null, stays as it is.
    """
    at = docs.columns.index(text_col)

    def give(batch, i, text, base, spans):
        row = [c[i].as_py() for c in batch.columns]
        if spans:
            row[at] = redact(text, spans, mark)
        return row

    return _scan(docs, vocabulary, pattern, max_ratio, give, docs.schema, text_col)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
