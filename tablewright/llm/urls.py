"""URL filter: rules first, then an empirical-Bayes reputation of the host; DataFrame functions only.

Labelled page outcomes (bad = 1, good = 0) are counted by host. A host's rate is shrunk through
beta-binomial priors: the suffix towards all pages, the registered domain towards its suffix, the
host towards its domain. How strongly is estimated from the data, for each level, by the method of
moments (the intra-class correlation of the counts, plus Z of its standard errors where groups do not
differ, so that a prior is no stronger than the number of labelled pages can show). A page is blocked if the lower bound of its
host's posterior is at least LIMIT; a host without outcomes has its domain's posterior, and so on up.

Defined results: a null url, or one without "://", has empty host and path, no rule, and is allowed
as nothing is known of it; repeated rows are pages of their own; no labelled outcome at all allows
every page that no rule fits; an empty table gives an empty result. Of rules of equal length the one
with the longer host wins, then the smaller string. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (host, path, verdict) of the driver's contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Standard deviations below the posterior mean, and the bad share at which a host is blocked.
Z, LIMIT = 1.645, 0.5
#: Least and most strength of a prior, in pages; the first is used where a level has too few groups to tell.
WEAK, STRONG = 2.0, 1000.0
#: Second-level names under a country's suffix that are part of the suffix, fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host are lower-cased; the path ends before "?" or "#"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; user part and port are left out, a bare suffix is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    suffix = F.regexp_extract(bare, rf"(?:^|\.)((?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*))$", 1)
    domain = F.regexp_extract(bare, rf"([^.]*\.)?(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*)$", 0)
    return domain, suffix


def strength(groups: DataFrame, parent_rate: str) -> float:
    """Pages that a prior of this level weighs: (1 - r) / r for the intra-class correlation r of the
    groups' counts about their parents' rates, at the upper end of what it may be: where groups do not
    differ, `between` is about `var` times a chi-square of m - 1 degrees. One row comes to the driver."""
    g = groups.where("n > 0").agg(
        F.count("*").alias("m"),
        F.sum("n").alias("all_n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col(parent_rate), 2)).alias("between"),
        F.sum(F.col("n") * F.col(parent_rate) * (1 - F.col(parent_rate))).alias("within"),
    ).first()
    if not g["m"] or g["m"] < 2 or not g["within"]:
        return WEAK
    var = g["within"] / g["all_n"]
    room = var * (g["all_n"] - g["n2"] / g["all_n"] - (g["m"] - 1))
    r = (g["between"] - var * (g["m"] - 1) + Z * var * sqrt(2 * (g["m"] - 1))) / room if room > 0 else 0.0
    return min(max((1 - r) / r, WEAK), STRONG) if r > 0 else STRONG


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, k, mean, lower) from rows (host, bad), bad being 1, 0 or null: the posterior of each
    host's bad share and its lower bound. Counting is partial before each shuffle."""
    domain, suffix = levels(F.col("host"))
    hosts = cut(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")).withColumns({"domain": domain, "suffix": suffix}))
    up = lambda df, key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains, suffixes = up(hosts, ["domain", "suffix"]), up(hosts, ["suffix"])
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = total["k"] / total["n"] if total["n"] else 0.0

    def shrunk(df: DataFrame, prior: str) -> DataFrame:
        m = strength(df.withColumn("parent", F.col(prior)), "parent")
        return df.withColumn("a", m * F.col(prior) + F.col("k")).withColumn("b", m * (1 - F.col(prior)) + F.col("n") - F.col("k")).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    s = shrunk(suffixes.withColumn("p", F.lit(float(rate))), "p").select("suffix", F.col("mean").alias("p"))
    d = cut(shrunk(domains.join(s, "suffix"), "p").select("domain", "suffix", F.col("mean").alias("p")))
    h = shrunk(hosts.join(d, ["domain", "suffix"]), "p")
    spread = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return h.select("host", "n", "k", "mean", (F.col("mean") - Z * spread).alias("lower"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, outcomes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. `outcomes` (host, bad) are the labelled pages; by default
    those that a rule decides. The join on the host has plain exchanges on both sides, so that a host
    with a large share of all pages is split."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("match", matched(F.col("host"), F.col("path"), rules))
    known = outcomes if outcomes is not None else rows.select("host", F.when(F.col("match.verdict") == "block", 1).when(F.col("match.verdict") == "allow", 0).alias("bad"))
    bad = cut(reputation(known.where("host != ''")).where(F.col("lower") >= LIMIT).select(F.col("host").alias("bad_host")))
    return rows.join(bad, F.col("host") == F.col("bad_host"), "left").select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict")
    )


ORACLE_SQL = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (select p.*, h || q as rule, v from p, r where (host = h or ends_with(host, '.' || h)) and starts_with(path, q)),
best as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from f group by all),
j as (select p.*, best.rule, best.v from p left join best on p.page_id is not distinct from best.page_id and p.host = best.host and p.path = best.path),
b as (select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') as bare, v from j where host <> ''),
c as (select host, regexp_extract(bare, '(?:^|\.)((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*))$', 1) as suffix,
             regexp_extract(bare, '([^.]*\.)?(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*)$', 0) as domain, v from b),
hosts as (select host, domain, suffix, count(v) as n, count(*) filter (v = 'block') as k from c group by all),
g as (select coalesce(sum(k) / nullif(sum(n), 0), 0)::double as p from hosts),
s0 as (select suffix, sum(n) as n, sum(k) as k, any_value(g.p) as p from hosts, g group by suffix),
sm as (select count(*) as m, sum(n) as al, sum(n::double * n) as n2, sum(n * (k / n - p) ** 2) as bt, sum(n * p * (1 - p)) as wi from s0 where n > 0),
s1 as (select case when m < 2 or coalesce(wi, 0) = 0 then 2.0 else (with x as (select wi / al as var),
        y as (select case when var * (al - n2 / al - (m - 1)) > 0 then (bt - var * (m - 1) + 1.645 * var * sqrt(2 * (m - 1))) / (var * (al - n2 / al - (m - 1))) else 0 end as r from x)
        select case when r > 0 then least(greatest((1 - r) / r, 2.0), 1000.0) else 1000.0 end from y) end as w from sm),
s as (select suffix, (w * p + k) / (w + n) as p from s0, s1),
d0 as (select domain, suffix, sum(n) as n, sum(k) as k, any_value(s.p) as p from hosts join s using (suffix) group by domain, suffix),
dm as (select count(*) as m, sum(n) as al, sum(n::double * n) as n2, sum(n * (k / n - p) ** 2) as bt, sum(n * p * (1 - p)) as wi from d0 where n > 0),
d1 as (select case when m < 2 or coalesce(wi, 0) = 0 then 2.0 else (with x as (select wi / al as var),
        y as (select case when var * (al - n2 / al - (m - 1)) > 0 then (bt - var * (m - 1) + 1.645 * var * sqrt(2 * (m - 1))) / (var * (al - n2 / al - (m - 1))) else 0 end as r from x)
        select case when r > 0 then least(greatest((1 - r) / r, 2.0), 1000.0) else 1000.0 end from y) end as w from dm),
d as (select domain, suffix, (w * p + k) / (w + n) as p from d0, d1),
h0 as (select hosts.*, d.p from hosts join d using (domain, suffix)),
hm as (select count(*) as m, sum(n) as al, sum(n::double * n) as n2, sum(n * (k / n - p) ** 2) as bt, sum(n * p * (1 - p)) as wi from h0 where n > 0),
h1 as (select case when m < 2 or coalesce(wi, 0) = 0 then 2.0 else (with x as (select wi / al as var),
        y as (select case when var * (al - n2 / al - (m - 1)) > 0 then (bt - var * (m - 1) + 1.645 * var * sqrt(2 * (m - 1))) / (var * (al - n2 / al - (m - 1))) else 0 end as r from x)
        select case when r > 0 then least(greatest((1 - r) / r, 2.0), 1000.0) else 1000.0 end from y) end as w from hm),
h as (select host, w * p + k as a, w * (1 - p) + n - k as b from h0, h1),
low as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) as lower from h)
select page_id, j.host, path, rule, coalesce(v, case when lower >= 0.5 then 'block' else 'allow' end) as verdict
from j left join low on j.host = low.host
"""
