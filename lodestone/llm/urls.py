"""URL filters: explicit rules, and host reputation by empirical-Bayes shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, fresh, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, rule), a rule being a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of two labels under which domains are registered; else the suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: A host is blocked if the lower bound of its posterior rate of bad pages (mean - Z * deviation) is above LIMIT.
LIMIT, Z = 0.5, 1.645
#: Least and largest strength (pseudo-pages) of a prior.
WEAKEST, STRONGEST = 1.0, 1000.0
#: So many blocked hosts may be broadcast; with more, they are joined by a shuffle.
BROADCAST_HOSTS = 500_000


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is the outermost condition
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; the host itself if it has no more."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(groups: DataFrame, inner: str, outer: str) -> DataFrame:
    """One row (strength): how strongly ``inner`` groups follow their ``outer`` group, by the method of moments.

    ``groups``: (inner, outer, n, k). With p of the outer group, the expected sum of n (k/n - p)^2 under a beta-binomial
    with correlation r is p (1 - p) (G - 1 + r (N - sum n^2 / N - G + 1)); strength = 1 / r - 1.
    """
    g = groups.groupBy(inner, outer).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    o = g.groupBy(outer).agg(F.sum("n").alias("pages"), F.sum("k").alias("bad"), F.count("*").alias("groups"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    p = F.col("bad") / F.col("pages")
    spread = g.join(o, outer).groupBy(outer).agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)).alias("spread"))
    t = o.join(spread, outer).where("groups > 1 and bad > 0 and bad < pages")
    free = F.col("pages") - F.col("squares") / F.col("pages") - (F.col("groups") - 1)
    weight = F.sum(F.when(free > 0, free))
    r = F.sum(F.col("spread") / (p * (1 - p)) - (F.col("groups") - 1)) / F.when(weight > 0, weight)
    r = F.when(r > 0, r)
    return t.agg(F.coalesce(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / r - 1)), F.lit(STRONGEST)).alias("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, rate, deviation, lower) from labelled outcomes (host, bad: 0 or 1).

    Outcomes are counted by host, registered domain and suffix. The rate of a suffix is shrunk towards the overall
    rate, that of a domain towards its suffix, that of a host towards its domain; each prior is a beta distribution
    whose strength the spread between groups tells. Counts are combined before each shuffle, so that a hot host is one
    row; the strengths are three numbers. Null outcomes and hosts are left out; without outcomes there are no rows.
    """
    known = outcomes.where("host is not null and bad is not null")
    hosts = known.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}).withColumn("all", F.lit("*"))
    hosts = durable(hosts, "hosts")
    levels = [("all", None), ("suffix", "all"), ("domain", "suffix"), ("host", "domain")]
    top = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0").first()
    if top is None:
        return hosts.select("host", F.lit(0.0).alias("rate"), F.lit(0.0).alias("deviation"), F.lit(0.0).alias("lower"))
    above, rate = None, F.lit((top.k + 0.5) / (top.n + 1.0))
    for inner, outer in levels[1:]:
        s = _strength(hosts, inner, outer).first().strength
        g = hosts.groupBy(inner, outer).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        g = g.join(above, outer) if above is not None else g.withColumn("prior", rate)
        a, b = F.lit(s) * F.col("prior") + F.col("k"), F.lit(s) * (1 - F.col("prior")) + F.col("n") - F.col("k")
        g = g.withColumns({"a": a, "b": b})
        above = g.select(inner, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return g.select("host", (F.col("a") / total).alias("rate"), deviation.alias("deviation")).withColumn("lower", F.col("rate") - Z * F.col("deviation"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules=RULES, limit: float = LIMIT) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict (allow or block).

    The verdict is the longest fitting rule's, else block where the host's posterior lower bound of bad pages
    exceeds ``limit``, else allow. ``outcomes``: (host, bad). A url that is null or has no '://' has an empty host and
    path and is allowed; hosts without outcomes are allowed. Repeated pages each get their verdict. Blocked hosts are
    counted, and broadcast up to BROADCAST_HOSTS of them.
    """
    names = [fresh(pages, c) for c in ("host", "path", "rule", "verdict")]
    host, path, rule, verdict = names
    rows = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    r, v = rule_of(F.col(host), F.col(path), rules)
    rows = rows.withColumns({rule: r, verdict: v})
    # only hosts that the bound blocks are joined, each once
    mark = fresh(rows, "blocked")
    bad = durable(host_reputation(outcomes).where(F.col("lower") > limit).select(F.col("host").alias(mark)), "blocked")
    rows = rows.join(small(bad, BROADCAST_HOSTS), F.col(host) == F.col(mark), "left")
    said = F.coalesce(F.col(verdict), F.when(F.col(mark).isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.withColumn(verdict, said).drop(mark)


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): pages whose path names a labelled document; bad if that is of low quality or toxic."""
    number = F.expr("try_cast(regexp_extract(_path, '^/[^/]*/([0-9]+)', 1) as bigint)")
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("_path")).withColumn("doc_id", number)
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return seen.where("doc_id is not null and host <> ''").select("host", "doc_id").join(marks, "doc_id").select("host", "bad")


def op2_urls(spark, sf_dir: str) -> DataFrame:
    """The operator over all pages; outcomes are the labels of the documents that page addresses name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_urls(pages, labelled_outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict")
