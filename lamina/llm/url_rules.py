"""URL filters: fixed host and path rules, and association rules for the URLs beyond them.

URLs that a fixed rule decides are the labels.  Spark's FP-growth mines them for
combinations of URL tokens (host labels, path segments, query keys) that go with one
verdict; combinations of enough support and confidence become rules.  They lie in an
inverted index, each under its rarest token, and a URL looks its own tokens up there.
Of the mined rules that a URL meets the most confident decides, then the longest,
then the best supported, then the last by its tokens' text; a URL that meets none is
allowed.  DataFrame and SQL functions only.

Every token of enough support is mined, in each URL that holds it; a distinct URL counts
once.  URLs of at most ``ITEMS`` such tokens go to FP-growth whole, so each holds fewer
than 2^(ITEMS + 1) combinations.  FP-growth knows no greatest length, so in longer URLs
combinations of up to ``LONGEST`` tokens are built up by joins, from those of enough
support one token shorter.  What has enough support in all URLs has it in one of the two
parts, so both parts' combinations are counted in all URLs, which is exact.  A URL supports
combinations of at most ``LONGEST`` of its tokens, and with each of them one verdict: with
k tokens fewer than k^3 / 3.

Defined results: a URL that is null or without ``://`` has an empty host and path and
is allowed; URLs of any length are read whole; rows that repeat are judged alike; an
empty table gives no row; without labelled URLs there are no mined rules; other
columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens of a URL that FP-growth mines whole, and of a rule at most.
ITEMS, LONGEST = 8, 3
#: Lists of the inverted index.
BUCKETS = 1024
#: The fixed rules: a verdict, and a host with the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def parsed(rows: DataFrame) -> DataFrame:
    """Adds host, path and tail (what follows the path) of ``url``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = rows.withColumn("tail", F.when(at > 0, F.substr(url, at + 3)).otherwise(""))
    found = rest.withColumn("host", F.regexp_extract("tail", "^[^/?#]*", 0)).withColumn("tail", F.substr("tail", F.length("host") + 1))
    found = found.withColumn("path", F.regexp_extract("tail", "^[^?#]*", 0)).withColumn("tail", F.substr("tail", F.length("path") + 1))
    return found.withColumn("host", F.translate("host", UPPER, LOWER))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, the first of equals; null if none does."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):  # what is wrapped last is asked first
        name, slash, start = rule.partition("/")
        own = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        fits = F.when(own, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def tokens(host: Column, path: Column, tail: Column) -> Column:
    """Host labels, path segments and query keys, each once."""

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(F.lit(kind), F.translate(t, UPPER, LOWER)))

    keys = F.transform(F.split(F.regexp_extract(tail, "^\\?([^#]*)", 1), "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    return F.array_distinct(F.concat(named("h:", F.split(host, "\\.")), named("p:", F.split(path, "[^0-9A-Za-z\\u0080-\\uffff]+")), named("q:", keys)))


def mine(labelled: DataFrame, support: float = 0.01, least: int = 5, confidence: float = 0.8) -> DataFrame:
    """(tokens, verdict, joint, alone): rules of labelled URLs (tokens, verdict), a row a distinct URL.

    A rule's tokens meet its verdict in at least ``support`` of the URLs, and at least
    ``least`` times; ``confidence`` is the least share of those with its tokens.
    """
    spark = labelled.sparkSession
    numbered = stored(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "labelled")
    n = numbered.count()
    if n == 0:
        return spark.createDataFrame([], "tokens array<string>, verdict string, joint bigint, alone bigint")
    share = max(support, (least - 0.5) / n)
    each = numbered.select("row", "verdict", F.explode("tokens").alias("token"))
    need = F.ceil(F.lit(share) * F.lit(n).cast("double"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select("token")
    # URLs without a chosen token count in the number of baskets.
    kept = held.select("token", F.col("token").alias("kept"))
    chosen = stored(each.join(kept, "token", "left").groupBy("row", "verdict").agg(F.array_sort(F.collect_list("kept")).alias("held")), "chosen")
    many = chosen.where(F.size("held") > ITEMS).count()
    if many < n:
        baskets = chosen.where(F.size("held") <= ITEMS).select(F.concat("held", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
        found = FPGrowth(minSupport=share * (1 - 1e-9) if many else share, minConfidence=1.0).fit(baskets).freqItemsets
        sets = stored(found.select(F.array_sort(F.filter("items", lambda t: ~F.startswith(t, F.lit("=")))).alias("tokens"), F.filter("items", lambda t: F.startswith(t, F.lit("="))).alias("verdict"), "freq"), "itemsets")
        sets = sets.where((F.size("tokens") > 0) & (F.size("tokens") <= LONGEST))
    if many:
        wide = _combinations(chosen.where(F.size("held") > ITEMS), share * (1 - 1e-9) * many)
        asked = wide if many == n else wide.union(sets.where(F.size("verdict") == 1).select("tokens")).distinct()
        alone = _counted(chosen, asked)
        joint = alone.groupBy("tokens", "verdict").agg(F.sum("n").alias("joint")).where(F.col("joint") >= need)
        rules = joint.join(alone.groupBy("tokens").agg(F.sum("n").alias("alone")), "tokens")
        return rules.where(F.col("joint") / F.col("alone") >= confidence)
    joint = sets.where(F.size("verdict") == 1).select("tokens", F.substr(F.col("verdict")[0], F.lit(2)).alias("verdict"), F.col("freq").alias("joint"))
    rules = joint.join(sets.where(F.size("verdict") == 0).select("tokens", F.col("freq").alias("alone")), "tokens")
    return rules.where(F.col("joint") / F.col("alone") >= confidence)


def _combinations(wide: DataFrame, least: float) -> DataFrame:
    """(tokens): combinations of up to ``LONGEST`` tokens that meet one verdict in ``least`` of the URLs (row, verdict, held)."""
    token = wide.select("row", "verdict", F.explode("held").alias("next"))
    rows, out = token.select("row", "verdict", F.array("next").alias("tokens")), None
    for size in range(1, LONGEST + 1):
        enough = rows.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("tokens", "verdict")
        rows = stored(rows.join(enough, ["tokens", "verdict"]).select("row", "verdict", "tokens"), f"combinations{size}")
        out = rows.select("tokens") if out is None else out.union(rows.select("tokens"))
        rows = rows.join(token, ["row", "verdict"]).where(F.col("next") > F.element_at("tokens", -1)).select("row", "verdict", F.array_append("tokens", F.col("next")).alias("tokens"))
    return out.distinct()


def _counted(chosen: DataFrame, asked: DataFrame) -> DataFrame:
    """(tokens, verdict, n): in how many URLs (row, verdict, held) all tokens of each combination meet a verdict."""
    pairs = chosen.select("row", "verdict", F.explode("held").alias("token"))
    ends = asked.select("tokens", F.explode("tokens").alias("token"))
    met = pairs.join(ends, "token").groupBy("row", "verdict", "tokens").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.size("tokens"))
    return stored(met.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n")), "counted")


ENTRY = "confidence double, size int, joint bigint, text string, verdict string"
INDEX = f"array<array<struct<best:struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>,tokens:array<string>>>>"


def inverted(rules: DataFrame, each: DataFrame) -> str:
    """The index as JSON: ``BUCKETS`` lists of rules, each under a hash of its rarest token in ``each``."""
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ends = rules.select("*", F.explode("tokens").alias("token")).join(held, "token")
    keyed = ends.groupBy("tokens", "verdict", "joint", "alone").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    best = F.struct((F.col("joint") / F.col("alone")).alias("confidence"), F.size("tokens").alias("size"), "joint", F.array_join("tokens", " ").alias("text"), "verdict")
    lists = keyed.groupBy(bucket(F.col("token")).alias("bucket")).agg(F.to_json(F.collect_list(F.struct(best.alias("best"), "tokens"))).alias("rules"))
    found = dict(lists.collect())  # rules are of enough support, so their number does not grow with the URLs
    return "[" + ",".join(found.get(b, "[]") for b in range(BUCKETS)) + "]"


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", support: float = 0.01, least: int = 5, confidence: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined): the fixed rule's verdict, else the mined rules'.

    ``mined`` is the text of the mined rule that decides, null where none does.
    """
    asked = parsed(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url")))
    asked = asked.select("page_id", "url", "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("fixed"), tokens(F.col("host"), F.col("path"), F.col("tail")).alias("tokens"))
    labelled = asked.where("fixed is not null").groupBy("url").agg(F.first("tokens").alias("tokens"), F.first("fixed")["verdict"].alias("verdict"))
    labelled = stored(labelled, "labelled")
    index = F.from_json(F.lit(inverted(mine(labelled, support, least, confidence), labelled.select(F.explode("tokens").alias("token")))), INDEX)
    near = F.flatten(F.transform("tokens", lambda t: index[bucket(t)]))
    met = F.filter(near, lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0)
    best = asked.withColumn("best", F.when(F.col("fixed").isNull(), F.array_max(F.transform(met, lambda r: r["best"]))))
    return best.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "best.verdict", F.lit("allow")).alias("verdict"), F.col("best.text").alias("mined"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP11_SQL = r"""
with a as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select *, regexp_extract(rest, '^[^/?#]*') as name from a),
c as (select *, substr(rest, length(name) + 1) as after from b),
d as (select page_id, url, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(after, '^[^?#]*') as path, after from c),
e as (
  select *,
    case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule,
    list_distinct(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda t: t <> ''), lambda t: 'h:' || t),
      list_transform(list_filter(string_split_regex(path, '[^0-9A-Za-z\x{80}-\x{ffff}]+'), lambda t: t <> ''), lambda t: 'p:' || translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
      list_transform(list_filter(list_transform(string_split(regexp_extract(substr(after, length(path) + 1), '^\?([^#]*)', 1), '&'), lambda t: regexp_extract(t, '^[^=]*')), lambda t: t <> ''),
        lambda t: 'q:' || translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) as tokens
  from d),
l as (select distinct url, tokens, case when rule in ('org/', 'com/fr/') then 'allow' else 'block' end as verdict from e where rule is not null and len(tokens) > 0),
n as (select count(*) as n, count(*) filter (verdict = 'block') as blocked, ceil(greatest(0.01::double, 4.5::double / count(*)) * count(*)) as least from l),
t as (select url, verdict, unnest(tokens) as token from l),
h as (select token, abs(count(*) filter (verdict = 'block') * n - count(*) * blocked) as far from t, n group by token, n, blocked, least having count(*) >= least),
k as (select url, verdict, token from t join h using (token) qualify row_number() over (partition by url order by far desc, token) <= 8),
s as (
  select url, verdict, [token] as tokens from k
  union all select x.url, x.verdict, [x.token, y.token] from k x join k y on y.url = x.url and y.token > x.token
  union all select x.url, x.verdict, [x.token, y.token, z.token] from k x join k y on y.url = x.url and y.token > x.token join k z on z.url = x.url and z.token > y.token),
j as (select tokens, verdict, count(*) as joint, sum(count(*)) over (partition by tokens) as alone from s group by tokens, verdict),
r as (select tokens, verdict, joint, joint / alone::double as confidence, array_to_string(tokens, ' ') as text from j, n where joint >= least and joint / alone::double >= 0.8),
u as (select distinct url, tokens from e where rule is null),
m as (
  select url, r.verdict, text from u join r on list_has_all(u.tokens, r.tokens)
  qualify row_number() over (partition by url order by confidence desc, len(r.tokens) desc, joint desc, text desc, r.verdict desc) = 1)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' else coalesce(m.verdict, 'allow') end as verdict, m.text as mined
from e left join m on rule is null and m.url is not distinct from e.url
"""
