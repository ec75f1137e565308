"""Mixing sources to target weights by Poisson replication.

A source with target rate r gives each of its documents a Poisson(r) number of
copies, found by inverting the distribution at a uniform number that is a hash
of the seed and the document's id: the draw needs no state, repeats exactly, and
every document counts once whatever its task.  Copies are then put in the order
of a second hash, a global shuffle.

Rows that share an id are numbered in the order of a hash of their content, and
from the second on the number is hashed with the id, so each draws for itself.

Defined results: a null source is a source of its own; null ids count as one id
that their rows share; of rows alike in all columns it does not matter which is
which; copies of equal order key are in any order; a text may be of any length; an empty table gives no row; columns named
like the two added ones are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.ranking import ranks

from .common import stored

#: A Poisson mean above it is drawn as a sum of equal parts.
LARGEST_MEAN = 64.0
#: Terms of a part's inversion: the tail beyond has less mass than 2**-53.
TERMS = 192


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """The least k whose cumulative probability is above ``u``."""
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.when(s["cdf"] > u, s).otherwise(F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), i.alias("k")))

    # Most draws are settled by the first terms.
    first = F.aggregate(F.sequence(F.lit(1), F.lit(8)), zero, step)
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step)
    return F.when(u < F.exp(-mean), F.lit(0)).when((mean < 2.0) & (u < 0.999), first["k"]).otherwise(whole["k"])


def target_rates(docs: DataFrame, weights: dict[str, float] | None, power: float, total: float | None, source_col: str) -> DataFrame:
    """(__source, __rate): copies that a document of each source should have.

    ``weights`` are shares of the mix; a source without weight gets none.  With
    no weights a source's share follows its count to ``power``.
    """
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source")).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    if weights is None:
        weight = F.sqrt("__n") if power == 0.5 else F.pow("__n", F.lit(power))
        shares = counts.withColumn("__w", weight)
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__source string, __w double")
        shares = counts.join(given, "__source", "left")
    whole = shares.agg(F.sum("__w").alias("w"), F.sum("__n").alias("n")).first()
    size = float(total or whole["n"] or 0)
    return shares.where("__w is not null").select("__source", (F.col("__w") / F.lit(float(whole["w"] or 1)) * F.lit(size) / F.col("__n")).alias("__rate"))


def _own_keys(docs: DataFrame, id_col: str) -> DataFrame:
    """Adds ``__key``: the id, and for rows that share it also their number."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    named = docs.withColumn("__key", name)
    shared = stored(named.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key", F.lit(True).alias("__shared")), "shared")
    if shared.isEmpty():
        return named
    marked = named.join(shared, "__key", "left")
    content = F.md5(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in docs.columns)).cast("binary"))
    # The last column of the order only spreads rows alike in all others.
    several = marked.where("__shared").withColumns({"__content": content, "__turn": F.monotonically_increasing_id()})
    placed = ranks(several, ("__key",), ("__content", "__turn"), "__at")
    own = F.when(F.col("__at") == 1, F.col("__key")).otherwise(F.concat_ws(":#", "__key", (F.col("__at") - 1).cast("string")))
    columns = [*docs.columns, "__key"]
    return marked.where("__shared is null").select(columns).unionAll(placed.withColumn("__key", own).select(columns))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy", key_col: str = "shuffle_key", ordered: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, in a global random order.

    ``copy`` counts a row's copies from 0; ``shuffle_key`` gives the order.
    """
    # Stored, so that Spark knows its size and broadcasts it if small.
    rates = stored(target_rates(docs, weights, power, total, source_col), "rates")
    docs = docs.drop(copy_col, key_col)
    keyed = _own_keys(docs, id_col).withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    key = F.col("__key")
    parts = F.greatest(F.ceil(F.col("__rate") / LARGEST_MEAN), F.lit(1))
    mean = F.col("__rate") / parts

    def draw(j: Column) -> Column:
        u = F.when(j == 0, uniform(F.lit(seed), key)).otherwise(uniform(F.lit(seed), key, j.cast("string")))
        return poisson(u, mean)

    copies = F.aggregate(F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), draw), F.lit(0), lambda a, x: a + x)
    drawn = keyed.join(rates, "__source").withColumn("__copies", copies).where("__copies > 0")
    out = drawn.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    out = out.withColumn(key_col, uniform(F.lit(seed + "/order"), key, F.col(copy_col).cast("string")))
    out = out.select(*docs.columns, copy_col, key_col)
    return out.orderBy(key_col) if ordered else out


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "copy", F.round("shuffle_key", 9).alias("shuffle_key"), "text")


OP6_SQL = """
with s as (
  select coalesce(source, '') as src, cast(count(*) as double) as n
  from documents group by 1),
r as (
  select src, sqrt(n) / (select sum(sqrt(n)) from s) * (select sum(n) from s) / n as rate from s),
o as (
  select doc_id, source, text, coalesce(cast(doc_id as varchar), 'null') as name,
    row_number() over (partition by doc_id order by md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), coalesce(source, ''), coalesce(text, '')))) as turn
  from documents),
d as (
  select doc_id, source, text, rate, case when turn = 1 then name else name || ':#' || (turn - 1) end as own,
    cast(('0x' || substr(md5('mix-1:' || own), 1, 13)) as bigint) / 4503599627370496.0::double as u
  from o join r on coalesce(source, '') = src),
t as (
  select i, ln_fact from (
    select i, sum(case when i = 0 then 0.0::double else ln(i) end) over (order by i) as ln_fact
    from range(0, 193) g(i))),
cdf as (
  select src, i, sum(exp(-rate + case when i = 0 then 0.0::double else i * ln(rate) end - ln_fact)) over (partition by src order by i) as c
  from r, t where rate > 0),
k as (
  select d.doc_id, d.source, d.text, d.own, cast(unnest(range(0, (select count(*) from cdf where cdf.src = coalesce(d.source, '') and cdf.c <= d.u))) as integer) as copy
  from d)
select doc_id, source, copy,
  round(cast(('0x' || substr(md5('mix-1/order:' || own || ':' || copy), 1, 13)) as bigint) / 4503599627370496.0::double, 9) as shuffle_key,
  text
from k
"""
