"""Personal data by weak supervision, in DataFrame functions only.

Base patterns give spans that always stay.  Matches of them that fail their check,
and of wider patterns, are candidates where they overlap no base span; four
labelers (rule, gazetteer, context, edges) vote on each candidate and base span,
-1, 0 or 1.  Expectation-maximisation over the table of vote patterns (bounded by
kinds and votes, not by rows) estimates each labeler's reliability; its
posteriors train a logistic span classifier, which decides on the candidates.

Texts are scanned once; what later steps read is a small stored table of
candidates per document.  Patterns are possessive and anchored at run starts, so
each is linear in the text and keeps no stack of repetitions.

Defined results: a null text is empty and has no span; a null id stays null;
repeated rows give repeated results; texts of any length are scanned whole; equal
spans found twice count once; an empty table gives no row; other columns are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")

# Base patterns, rewritten without backtracking.  An address's first run, if it
# fails at its start, fails everywhere in the run; \G admits a run cut by the
# match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Forms that the base patterns don't know.
WIDER = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[(\[{<][aA][tT][)\]}>]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{<][dD][oO][tT][)\]}>])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])(?:[0-9]{4}[./_]){3}[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9](?:[\x20-]?[0-9]){7,11})(?![0-9.-])",
}
#: Substrings without which a pattern cannot match.
NEEDS = {("email", 0): ["@"], ("phone", 0): ["+"], ("email", 1): [o + a + c for o, c in ("()", "[]", "{}", "<>") for a in ("at", "AT", "At", "aT")]}

# Fixed word lists of the gazetteer and context labelers.
TOP_LEVEL = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|it|nl|eu|ch|at|pl|se|us|ca|au|jp|cn|in|br"
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel|write to|reach",
    "ip": "\\bip\\b|address|host|server|login from|adresse|direcci",
    "card": "card|visa|master|amex|credit|debit|karte|tarjeta|carte",
    "phone": "phone|\\btel|call|fax|mobile|telefon|t[eé]l[eé]phone|whatsapp|sms",
}
AGAINST = "version|serial|isbn|issn|doi|order|invoice|rev\\.|build|sku|part no"


def _spans(text: Column, pattern: str, needs: list[str] | None) -> Column:
    """(start, end, match, before, after) of leftmost matches, code points."""
    p = F.lit(pattern)
    nothing = F.lit(None).cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.split(text, pattern, -1)
    held = F.struct(found.alias("m"), parts.alias("p"))

    def place(x: Column) -> Column:
        m, parts = x["m"], x["p"]
        last = F.size(m) - 1
        # Ends of all matches so far, the newest last.
        ends = F.aggregate(
            F.sequence(F.lit(0), last),
            F.array().cast("array<int>"),
            lambda acc, i: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(F.get(parts, i)) + F.length(F.get(m, i)))),
        )
        return F.transform(
            ends,
            lambda e, i: F.struct(
                (e - F.length(F.get(m, i))).cast("int").alias("start"),
                e.cast("int").alias("end"),
                F.get(m, i).alias("found"),
                F.right(F.get(parts, i), F.lit(40)).alias("before"),
                F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
            ),
        )

    may = F.lit(True)
    if needs:
        may = F.contains(text, F.lit(needs[0]))
        for n in needs[1:]:
            may = may | F.contains(text, F.lit(n))
    # transform over one element binds the two arrays to one evaluation
    return F.when(may & F.regexp_like(text, p), F.flatten(F.transform(F.array(held), place))).otherwise(nothing)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d < 5, d * 2).otherwise(d * 2 - 9)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(found, F.lit(rf"\A{part}(?:\.{part}){{3}}\z"))
    d = _digits(found)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))
    return F.length(d).between(9, 15)


def _votes(kind: str, s: Column, wider: bool) -> list[Column]:
    found, before, after = s["found"], F.lower(s["before"]), s["after"]
    valid = _valid(kind, found)
    if wider:  # the rule labeler abstains, but for a card whose check digit fails
        rule = F.when(_luhn(_digits(found)), 0).otherwise(-1) if kind == "card" else F.lit(0)
    else:
        rule = F.when(valid, 1).otherwise(-1)
    known = {
        "email": F.regexp_like(F.lower(found), F.lit(rf"[.)\]]\x20?(?:{TOP_LEVEL})\z")),
        "ip": ~F.regexp_like(found, F.lit(r"\A(?:0|1|255)\.")),
        "card": F.regexp_like(found, F.lit(r"\A(?:3[47]|4|5[1-5]|6)")),
        "phone": F.regexp_like(found, F.lit(r"\A(?:\+[1-9]|\(?[0-9])")),
    }[kind]
    gazetteer = F.when(known, 1).otherwise(F.lit(-1 if kind != "email" else 0))
    context = F.when(F.regexp_like(before, F.lit(CONTEXT[kind])), 1).when(F.regexp_like(before, F.lit(AGAINST)), -1).otherwise(0)
    glued = F.regexp_like(F.right(before, F.lit(1)), F.lit(r"[\p{L}0-9_/.-]")) | F.regexp_like(after, F.lit(r"[\p{L}0-9_/-]"))
    return [v.cast("int") for v in (rule, gazetteer, context, F.when(glued, -1).otherwise(1))]


_CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,wider:boolean,v0:int,v1:int,v2:int,v3:int>>"


def _labeled(k: int, wider: bool):
    kind = KINDS[k]

    def label(s: Column) -> Column:
        base = F.lit(False) if wider else _valid(kind, s["found"])
        votes = _votes(kind, s, wider)
        return F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), F.lit(wider).alias("wider"), *(v.alias(f"v{i}") for i, v in enumerate(votes)))

    return label


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): all candidates of each document, with their votes."""
    out = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    sets = []
    for wider, patterns in ((False, BASE), (True, WIDER)):
        for k, kind in enumerate(KINDS):
            spans = _spans(F.col("text"), patterns[kind], NEEDS.get((kind, int(wider))))

            name = f"{kind}_{int(wider)}"
            sets.append(name)
            out = out.withColumn(name, F.transform(spans, _labeled(k, wider)).cast(_CANDIDATE))
    none = F.array().cast(_CANDIDATE)
    out = out.select("doc_id", F.concat(*(F.coalesce(F.col(c), none) for c in sets)).alias("found"))
    # Only what is decided on is learned from: no candidate that overlaps a base span.
    base = F.filter("found", lambda c: c["base"])
    free = F.filter("found", lambda c: ~c["base"] & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    return out.select("doc_id", F.concat(base, free).alias("found"))


Cell = tuple[int, ...]  # kind, wider, four votes


def estimate(cells: dict[Cell, int], rounds: int = 40) -> tuple[dict[Cell, float], dict]:
    """Posterior of each cell and each labeler's reliabilities, by EM.

    Votes are taken as independent given the truth, for each kind; pseudo-counts
    of votes that agree with the truth four times in five keep rare kinds tame.
    """
    posterior = {c: 1 / (1 + math.exp(-1.5 * sum(c[2:]))) for c in cells}
    tables: dict = {}
    for _ in range(rounds):
        for kind in {c[0] for c in cells}:
            own = [c for c in cells if c[0] == kind]
            for z in (0, 1):
                mass = {c: cells[c] * (posterior[c] if z else 1 - posterior[c]) for c in own}
                total = sum(mass.values())
                tables[kind, z] = (total + 5) / (sum(cells[c] for c in own) + 10)
                for j in range(4):
                    like = {1: 8.0 if z else 2.0, 0: 5.0, -1: 2.0 if z else 8.0}
                    for c in own:
                        like[c[2 + j]] += mass[c]
                    tables[kind, z, j] = {v: x / sum(like.values()) for v, x in like.items()}
        for c in cells:
            odds = math.log(tables[c[0], 1] / tables[c[0], 0]) + sum(math.log(tables[c[0], 1, j][v] / tables[c[0], 0, j][v]) for j, v in enumerate(c[2:]))
            posterior[c] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return posterior, tables


#: Weights that the classifier starts from and is drawn to: bias, wider, votes.  All votes
#: weigh the same; a candidate needs three more for it than against it.
PRIOR = (-1.5, 0.0, 1.0, 1.0, 1.0, 1.0)


def train(cells: dict[Cell, int], posterior: dict[Cell, float], steps: int = 300, rate: float = 0.5, hold: float = 0.02) -> list[tuple[float, ...]]:
    """Logistic weights for each kind, fitted to the posteriors."""
    weights = []
    for kind in range(len(KINDS)):
        w, own = list(PRIOR), [c for c in cells if c[0] == kind]
        total = sum(cells[c] for c in own) or 1
        for _ in range(steps if own else 0):
            grad = [hold * (a - b) for a, b in zip(w, PRIOR, strict=True)]
            for c in own:
                x = (1, c[1], *c[2:])
                z = max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True))))
                miss = (1 / (1 + math.exp(-z)) - posterior[c]) * cells[c] / total
                grad = [g + miss * v for g, v in zip(grad, x, strict=True)]
            w = [a - rate * g for a, g in zip(w, grad, strict=True)]
        weights.append(tuple(w))
    return weights


def vote_cells(found: DataFrame) -> dict[Cell, int]:
    """Counts of (kind, wider, votes): at most 4 * 2 * 81 cells."""
    c = found.select(F.explode("found").alias("c")).select("c.*")
    keys = ["kind", "wider", "v0", "v1", "v2", "v3"]
    return {tuple(int(r[k]) for k in keys): r["n"] for r in c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}


def _score(c: Column, weights: list[tuple[float, ...]]) -> Column:
    score = F.lit(0.0)
    for kind, w in reversed(list(enumerate(weights))):
        z = F.lit(w[0]) + F.when(c["wider"], w[1]).otherwise(0.0)
        for j in range(4):
            z = z + c[f"v{j}"] * F.lit(w[2 + j])
        score = F.when(c["kind"] == kind, z).otherwise(score)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) for each document.

    ``base`` holds the valid base spans; ``spans`` adds the candidates, none of
    which overlaps a base span, that the classifier accepts.
    """
    found = stored(candidates(docs, id_col, text_col), "pii")
    cells = vote_cells(found)
    posterior, _ = estimate(cells)
    weights = train(cells, posterior)

    def bare(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    base = F.transform(F.filter("found", lambda c: c["base"]), bare)
    out = found.withColumn("base", F.array_sort(base))
    more = F.filter("found", lambda c: ~c["base"] & (_score(c, weights) >= threshold))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.array_distinct(F.transform(more, bare)))).alias("spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def pii_digest(spans: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))
