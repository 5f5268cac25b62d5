"""URL filter: longest fitting rule, else the reputation of the host by empirical Bayes.

Labelled pages are trials, a bad page a success. Their counts are shrunk from the host to its registered domain to its suffix to all
pages: at each level the share of bad pages has a beta prior whose mean is the posterior mean one level up and whose strength
is estimated over the whole level by moments of the beta-binomial distribution. The priors of a level use the counts below them as well, as
usual with empirical Bayes. A host is blocked if its posterior says with probability `CONFIDENCE` at least that more than `LIMIT` of its
pages are bad, that is if the lower posterior bound lies above the limit. Hosts without labels have the prior of their domain.

The probability is the exact beta integral by the midpoint rule over the angle t with share = sin(t)^2, where the posterior
has nearly the same width everywhere, so that `STEPS` cells of a span of 12 standard deviations do for every count.

Everything is built-in expressions. Pages meet labels after counting per (page, host), and hosts after counting per host. Looking
up a host, domain or suffix is a merge join, but for those with more than one in `SHARE` of the rows: these are fewer than `SHARE` and
are broadcast under a digest, so their rows stay where they are.

Defined cases: a NULL url or one without `://` has an empty host and path, and the empty host has a reputation like any other.
Hosts keep ports and user names; domain and suffix leave them out. An address of digits is its own domain under the empty suffix.
A page labelled more than once is bad if one of its labels says so; labels without an outcome count as none. Repeated pages are trials each, NULL
page ids none. Of rules of equal length the one with the longer host wins, then the first. An empty table gives no rows; without any
label the prior is even, and nothing is blocked. Further columns are ignored.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import stored

#: Letters that a host folds, what a URL looks like, suffixes of two labels.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn", "gov.uk", "ne.jp", "net.au", "or.jp",
    "org.au", "org.uk",
)

LIMIT = 0.5
CONFIDENCE = 0.9
STEPS = 1000
WEAKEST, STRONGEST = 0.5, 0.001  # bounds of the correlation within a group: prior strengths of 1 and 999 pages
LEAST = 0.5  # of a posterior parameter
SHARE = 1000

Rule = tuple[str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a NULL url or one without `://`."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(known, URL, 1), UPPER, LOWER), F.regexp_extract(known, URL, 2)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")
    labels = F.split(name, r"\.")
    pair = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    width = F.when(pair.isin(*SUFFIXES), 2).otherwise(1)
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))
    address = name.rlike(r"^[0-9.]+$")
    return F.when(address, name).otherwise(last(width + 1)), F.when(address, "").otherwise(last(width))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest (verdict, `host/path`) rule that fits, as a struct, NULL if none does. The list is read once for each url."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0])))
    out = F.lit(None)
    for verdict, text in reversed(ordered):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(out)
    return out if ordered else F.lit(None).cast("struct<verdict:string,rule:string>")


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """`rows` with the columns of their key's row in `table` as the struct `_found`; `weight` tells how many rows have a key.

    Keys with more than one in `SHARE` rows are joined by broadcast, the others by merge, where rows of the former carry a salt.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    value = F.struct(*[F.col(c) for c in table.columns if c not in (key, weight)])
    hot = F.col(weight) * F.lit(SHARE) > F.lit(total)
    often = table.where(hot).select(F.sha2(key, 256).alias("_digest"), value.alias("_often"))
    seldom = table.where(~hot).select(F.col(key).alias("_key"), F.lit(0).alias("_salt"), value.alias("_seldom"))
    marked = rows.withColumn("_digest", F.sha2(key, 256)).join(F.broadcast(often), "_digest", "left").drop("_digest")
    known = F.col("_often").isNotNull()
    salt = F.when(known, F.lit(1) + F.abs(F.hash(*rows.columns) % F.lit(1 << 16))).otherwise(0)
    keyed = marked.withColumns({"_key": F.when(~known, F.col(key)), "_salt": salt})
    joined = keyed.join(seldom, ["_key", "_salt"], "left")
    return joined.withColumn("_found", F.coalesce("_often", "_seldom")).drop("_often", "_seldom", "_key", "_salt")


def _strength(level: DataFrame) -> float:
    """Prior strength, in pages, of groups with `n` trials, `k` bad ones and prior mean `mean`: moments of the beta-binomial."""
    spread = F.col("mean") * (1 - F.col("mean"))
    gap = F.col("k") - F.col("n") * F.col("mean")
    more, at_most = level.agg(F.sum(gap * gap - F.col("n") * spread), F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    within = more / at_most if at_most else STRONGEST
    return 1 / min(max(within, STRONGEST), WEAKEST) - 1


def _posterior(level: DataFrame) -> tuple[DataFrame, float]:
    strength = _strength(level)
    a = F.col("k") + F.lit(strength) * F.col("mean")
    return level.withColumn("mean", a / (F.col("n") + F.lit(strength))), strength


def tail(a: Column, b: Column, limit: float = LIMIT, steps: int = STEPS) -> Column:
    """Probability that a beta variable with parameters a, b >= 1/2 is over the limit."""
    center, reach = F.asin(F.sqrt(a / (a + b))), F.lit(3.0) / F.sqrt(a + b)
    low = F.greatest(center - reach, F.lit(0.0))
    step = (F.least(center + reach, F.lit(math.pi / 2)) - low) / F.lit(float(steps))
    log_density = lambda t: (2 * a - 1) * F.log(F.sin(t)) + (2 * b - 1) * F.log(F.cos(t))
    top = log_density(center)
    cells = F.sequence(F.lit(0), F.lit(steps - 1))
    weight = lambda i: F.exp(log_density(low + (i + F.lit(0.5)) * step) - top)
    above = lambda i: F.least(F.greatest((low + (i + 1) * step - F.lit(math.asin(math.sqrt(limit)))) / step, F.lit(0.0)), F.lit(1.0))
    add = lambda s, i: F.struct((s["all"] + weight(i)).alias("all"), (s["over"] + weight(i) * above(i)).alias("over"))
    start = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("over"))
    return F.aggregate(cells, start, add, lambda s: s["over"] / s["all"])


def host_reputations(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, confidence: float = CONFIDENCE) -> DataFrame:
    """(host, pages, n, k, bad_rate, bad_probability, blocked) of every host of `pages` (_id, host), from `outcomes` (_id, bad)."""
    known = outcomes.where("_id IS NOT NULL AND bad IS NOT NULL").groupBy("_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = pages.groupBy("_id", "host").agg(F.count(F.lit(1)).alias("pages"))
    counted = seen.join(known, "_id", "left").groupBy("host").agg(
        F.sum("pages").alias("pages"),
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("pages") * F.col("bad")), F.lit(0)).alias("k"),
    )
    domain, suffix = domain_parts(F.col("host"))
    hosts = stored(counted.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("hosts")), "domains")
    suffixes = domains.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("domains"))
    n, k = suffixes.agg(*sums).first()
    top = ((k or 0) + 0.5) / ((n or 0) + 1.0)
    suffixes, _ = _posterior(suffixes.withColumn("mean", F.lit(top)))
    of_suffix = suffixes.select("suffix", "domains", "mean")
    domains, _ = _posterior(lookup(domains, of_suffix, "suffix", "domains").withColumn("mean", F.col("_found.mean")))
    of_domain = domains.select("domain", "hosts", "mean")
    hosts = lookup(hosts, of_domain, "domain", "hosts").withColumn("mean", F.col("_found.mean")).drop("_found")
    hosts = stored(hosts, "priors")
    strength = _strength(hosts)
    a, b = F.lit(strength) * F.col("mean") + F.col("k"), F.lit(strength) * (1 - F.col("mean")) + F.col("n") - F.col("k")
    probability = F.round(tail(F.greatest(a, F.lit(LEAST)), F.greatest(b, F.lit(LEAST)), limit), 6)
    rated = hosts.withColumns({"bad_rate": F.round(a / (F.col("n") + F.lit(strength)), 6), "bad_probability": probability})
    names = ("host", "pages", "n", "k", "bad_rate", "bad_probability")
    return stored(rated.select(*names, (F.col("bad_probability") >= F.lit(confidence)).alias("blocked")), "reputations")


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), id_column: str = "page_id", url_column: str = "url",
    outcome_id: str = "page_id", bad: Column | None = None, limit: float = LIMIT, confidence: float = CONFIDENCE,
) -> DataFrame:
    """(id, host, path, rule, verdict, labelled, bad, bad_rate, bad_probability) of every page; the last four are the host's.

    `bad` is an expression over `outcomes`, by default its column of that name.
    """
    host, path = url_parts(F.col(f"`{url_column}`"))
    rows = pages.select(F.col(f"`{id_column}`").alias("_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col(f"`{outcome_id}`").alias("_id"), (F.col("bad") if bad is None else bad).alias("bad"))
    judged = lookup(rows, host_reputations(rows, known, limit, confidence), "host", "pages")
    ruled = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select(
        F.col("_id").alias(id_column), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_found.blocked"), "block").otherwise("allow")).alias("verdict"),
        F.col("_found.n").alias("labelled"), F.col("_found.k").alias("bad"), F.col("_found.bad_rate").alias("bad_rate"),
        F.col("_found.bad_probability").alias("bad_probability"),
    )


#: The rules of the query.
RULES: Sequence[Rule] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)

ORACLE_SQL = rf"""
WITH rows AS (
    SELECT page_id, translate(regexp_extract(u, '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(u, '{URL}', 2) AS path
    FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)
), known AS (
    SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), counted AS (
    SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM rows LEFT JOIN known USING (page_id) GROUP BY host
), named AS (
    SELECT *, string_split(name, '.') AS labels, regexp_matches(name, '^[0-9.]+$') AS address
    FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.+$', '') AS name FROM counted)
), hosts AS (
    SELECT host, n, k, CASE WHEN address THEN name ELSE array_to_string(labels[-(width + 1):], '.') END AS domain,
           CASE WHEN address THEN '' ELSE array_to_string(labels[-width:], '.') END AS suffix
    FROM (SELECT *, CASE WHEN array_to_string(labels[-2:], '.') IN {SUFFIXES} THEN 2 ELSE 1 END AS width FROM named)
), domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL
), s0 AS (
    SELECT *, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM suffixes) AS mean FROM suffixes
), s1 AS (
    SELECT suffix, (k + m * mean) / (n + m) AS mean FROM s0, (SELECT {{strength}} AS m FROM s0)
), d0 AS (
    SELECT domain, n, k, mean FROM domains JOIN s1 USING (suffix)
), d1 AS (
    SELECT domain, (k + m * mean) / (n + m) AS mean FROM d0, (SELECT {{strength}} AS m FROM d0)
), h0 AS (
    SELECT host, n, k, mean FROM hosts JOIN d1 USING (domain)
), h1 AS (
    SELECT host, n, k, (k + m * mean) / (n + m) AS rate, greatest(m * mean + k, {LEAST}) AS a, greatest(m * (1 - mean) + n - k, {LEAST}) AS b
    FROM h0, (SELECT {{strength}} AS m FROM h0)
), spans AS (
    SELECT *, greatest(asin(sqrt(a / (a + b))) - 3 / sqrt(a + b), 0) AS low,
           least(asin(sqrt(a / (a + b))) + 3 / sqrt(a + b), pi() / 2) AS high FROM h1
), cells AS (
    SELECT host, i, low + i * (high - low) / {STEPS} AS left_end, (high - low) / {STEPS} AS step, a, b FROM spans, range({STEPS}) AS r(i)
), weights AS (
    SELECT host, exp((2 * a - 1) * ln(sin(left_end + step / 2)) + (2 * b - 1) * ln(cos(left_end + step / 2))
                     - (2 * a - 1) * ln(sqrt(a / (a + b))) - (2 * b - 1) * ln(sqrt(b / (a + b)))) AS w,
           least(greatest((left_end + step - asin(sqrt({LIMIT}))) / step, 0), 1) AS above FROM cells
), tails AS (
    SELECT host, round(sum(w * above) / sum(w), 6) AS bad_probability FROM weights GROUP BY host
), rules AS (
    SELECT * FROM (VALUES {", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '{t[t.index('/'):]}')" for v, t in RULES)}) AS r(verdict, rule, rule_host, rule_path)
), fitting AS (
    SELECT page_id, url_host, url_path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM (SELECT DISTINCT page_id, host AS url_host, path AS url_path FROM rows)
    JOIN rules ON (url_host = rule_host OR ends_with(url_host, '.' || rule_host)) AND starts_with(url_path, rule_path) GROUP BY ALL
)
SELECT rows.page_id, host, path, rule, coalesce(verdict, CASE WHEN bad_probability >= {CONFIDENCE} THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS labelled, k::BIGINT AS bad, round(rate, 6) AS bad_rate, bad_probability
FROM rows JOIN h1 USING (host) JOIN tails USING (host)
LEFT JOIN fitting ON rows.page_id IS NOT DISTINCT FROM fitting.page_id AND host = url_host AND path = url_path
""".replace(
    "{strength}",
    f"1 / least(greatest(coalesce(sum((k - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), {STRONGEST}), {STRONGEST}), {WEAKEST}) - 1",
)
