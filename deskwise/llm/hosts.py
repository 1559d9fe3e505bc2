"""URL filters: rules first, then the reputation of hosts by empirical Bayes.

Labelled page outcomes (bad or good) are shrunk through beta-binomial priors from the host to its registered domain to
its suffix. A host without labelled pages has the posterior of its domain, a domain without any that of its suffix.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.llm.common import salted, written


#: Suffixes of two labels under which domains are registered; others are the last label. A parameter of the operators.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII in lower case; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: list[tuple[str, str, str]], field: int | None = None) -> Column:
    """The longest rule (host, path, verdict) for columns ``host`` and ``path``: its text, or its given field; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == r[0]) | F.col("host").endswith(f".{r[0]}")) & F.col("path").startswith(r[1])
        out = F.when(fits, F.lit(r[0] + r[1] if field is None else r[field])).otherwise(out)
    return out


def strength(units: DataFrame, n: str, k: str) -> Column:
    """Aggregate: the prior's weight in pages, from the spread of the units' rates by moments; 1 to 1000."""
    m = F.try_divide(F.sum(k), F.sum(n))
    within = F.try_divide(F.sum(F.try_divide(F.col(k) * (F.col(n) - F.col(k)), F.col(n))), F.sum(n))  # mean p(1 - p) of the units
    return F.least(F.greatest(F.coalesce(F.try_divide(within, m * (1 - m) - within), F.lit(1000.0)), F.lit(1.0)), F.lit(1000.0))


def reputations(pages: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``host, n, bad, mean, bound`` of each host of pages (host, bad: 0, 1 or null where there is no label).

    The rate of bad pages of all hosts is the prior of their suffix, the suffix's posterior mean that of the registered
    domain (the suffix and one more label), and the domain's that of the host. Each level's weight comes from the spread
    among its units that have labels. ``bound``: the posterior mean less ``z`` standard deviations of the beta posterior.
    Pages are added up before any shuffle, so a host of many pages is one row from each task. Without any label the mean
    of every host is one half and no bound is above it.
    """
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    own = F.when(two.isin(*suffixes), two).otherwise(F.element_at(labels, -1))
    count = F.size(F.split("suffix", r"\.")) + 1
    hosts = pages.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    hosts = hosts.withColumn("suffix", own).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - count + 1, F.lit(1)), count), "."))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    tops = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    every = tops.agg(((F.coalesce(F.sum("sk"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("sn"), F.lit(0.0)) + 1)).alias("m0"), strength(tops, "sn", "sk").alias("w0"))
    w1 = domains.agg(strength(domains, "dn", "dk").alias("w1"))
    w2 = hosts.agg(strength(hosts, "n", "k").alias("w2"))
    priors = every.crossJoin(w1).crossJoin(w2)  # one row
    tops = tops.crossJoin(F.broadcast(priors)).withColumn("ms", F.expr("(sk + w0 * m0) / (sn + w0)"))
    domains = domains.join(tops, "suffix").select("domain", "w2", F.expr("(dk + w1 * ms) / (dn + w1)").alias("md"))
    found = hosts.join(domains, "domain").withColumns({"a": F.expr("k + w2 * md"), "b": F.expr("n - k + w2 * (1 - md)")})
    return found.select("host", "n", F.col("k").alias("bad"), F.expr("a / (a + b)").alias("mean"), F.expr(f"a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))").alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5, url: str = "url", labels: Column | None = None, z: float = 1.645) -> DataFrame:
    """Adds ``host, path, rule, verdict``; columns of these names are replaced, all others stay.

    A page's verdict is that of its longest rule. Others are blocked if the bound of their host's rate of bad pages is
    above ``limit``, else allowed, as are pages without a host (``host`` is empty) and with a null url. ``labels`` is a
    column of pages, 1 for a bad page, 0 for a good one and null for one that nobody judged. Where it isn't given, a
    page has the label of its rule (block is bad, allow is good), and none without a rule.
    """
    kept = pages.drop("host", "path", "rule", "verdict")
    own = F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("own")
    rows = pages.select(own, host(url).alias("host"), path(url).alias("path"), (F.lit(None).cast("int") if labels is None else labels.cast("int")).alias("label"))
    by_rule = rule(rules, 2)
    rows = rows.withColumns({"rule": rule(rules), "by_rule": by_rule})
    if labels is None:
        rows = rows.withColumn("label", F.when(by_rule == "block", 1).when(by_rule == "allow", 0))
    found = reputations(rows.select("host", F.col("label").alias("bad")).where("host <> ''"), z)
    bad = written(found.where(F.col("bound") > limit).select("host", F.lit(True).alias("bad")), "bad-hosts")
    # Hosts that reputation blocks; beyond a broadcast, the pages of a frequent host are dealt by salt.
    judged = rows.join(F.broadcast(bad), "host", "left") if bad.limit(1_000_001).count() <= 1_000_000 else salted(rows, bad, "host", "path", how="left")
    by_method = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select(*(F.col("own").getField(c).alias(c) for c in kept.columns), "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"))


ORACLE = """
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (select p.*, rh, rp, rv, row_number() over (partition by page_id, host, path order by length(rh || rp) desc nulls last) as k
  from p left join r on (host = rh or host like '%.' || rh) and starts_with(path, rp)),
j as (select page_id, host, path, rh || rp as rule, rv from f where k = 1),
h as (select host, count(rv)::double as n, count(*) filter (rv = 'block')::double as k,
  case when array_to_string(string_split(host, '.')[-2:], '.') in ({suffixes}) then array_to_string(string_split(host, '.')[-2:], '.') else string_split(host, '.')[-1] end as suffix,
  array_to_string(string_split(host, '.')[-(1 + len(string_split(suffix, '.'))):], '.') as domain from j where host <> '' group by host),
d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
s as (select suffix, sum(n) as n, sum(k) as k from d group by all),
w as (select least(greatest(coalesce(x / nullif(m * (1 - m) - x, 0), 1000.0), 1.0), 1000.0) as w, lvl from (
  select 0 as lvl, sum(k) / nullif(sum(n), 0) as m, sum(k * (n - k) / nullif(n, 0)) / nullif(sum(n), 0) as x from s union all
  select 1, sum(k) / nullif(sum(n), 0), sum(k * (n - k) / nullif(n, 0)) / nullif(sum(n), 0) from d union all
  select 2, sum(k) / nullif(sum(n), 0), sum(k * (n - k) / nullif(n, 0)) / nullif(sum(n), 0) from h)),
c as (select (select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) from s) as m0, (select w from w where lvl = 0) as w0, (select w from w where lvl = 1) as w1, (select w from w where lvl = 2) as w2),
ab as (select h.host, h.k + w2 * md as a, h.n - h.k + w2 * (1 - md) as b from h join (
  select domain, (d.k + w1 * ms) / (d.n + w1) as md, w2 from d join (select suffix, (k + w0 * m0) / (n + w0) as ms, w1, w2 from s, c) using (suffix)) using (domain)),
bad as (select host from ab where a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5)
select page_id, host, path, rule, coalesce(rv, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from j
""".replace("{suffixes}", ", ".join(f"'{x}'" for x in SUFFIXES))
