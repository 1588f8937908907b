"""URL filter by empirical-Bayes host reputation, under hand-written rules.

Labelled page outcomes (good or bad; ``named_in`` makes them of the pages' own
text where nobody has labelled them) are counted by host and rolled up to the
registered domain, the suffix and the whole table. Each level's beta prior is
centred on its parent's shrunken mean, with a strength found by moments from
the spread of the level's children; a host's posterior gives bounds on its rate
of good pages, and a page is blocked where even the upper bound is too low.
Rules, where one fits, decide instead.

Everything is an aggregate on the host key. The hot host's rows meet in
map-side partial sums, and only the narrow (page_id, host, path) rows are
joined back, by a sort-merge join that adaptive execution can split.

Defined results: a null url, or one without ``://``, has an empty host and path,
and such pages are judged as one host; a host's domain leaves out its user, port
and last dot; an address in numbers is a domain of its own, under the suffix
``(address)``; hosts without outcomes take their
domain's, suffix's or table's prior; with no outcomes at all every page has
mean 0.5 and is allowed; repeated rows stay repeated; null outcomes count not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomshed.llm.common import ascii_lower, stored

# Labels that, under a country's two letters, are a suffix of two labels for names to be registered under.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
_TWO_LABELS = rf"^({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$"
_ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"

#: Rules are compiled into one expression; beyond this many, use a table of rules.
MOST_RULES = 500


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with all its subdomains, under a path prefix."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass(frozen=True)
class Policy:
    """Bounds are mean +- z standard deviations; a page is blocked if the upper bound is below ``least_good``.

    ``strength`` is a level's prior strength where moments cannot tell it (fewer
    than two children), and ``range_of_strength`` holds what they tell in bounds.
    """

    z: float = 1.64
    least_good: float = 0.8
    strength: float = 2.0
    range_of_strength: tuple[float, float] = (1.0, 1000.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    tail = F.coalesce(tail, F.lit(""))
    raw = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def registered(host: Column) -> tuple[Column, Column]:
    """(domain, suffix) of a host column."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    two = F.substring_index(name, ".", -2)
    number, double = name.rlike(_ADDRESS), two.rlike(_TWO_LABELS)
    suffix = F.when(number, "(address)").when(double, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(number, name).when(double, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def named_in(html: Column, words: list[str]) -> Column:
    """1 where a page names none of the ``words`` (whole words, any case) in its source, 0 where it does; null for no page."""
    return (~html.rlike(rf"(?i)\b({'|'.join(words)})\b")).cast("int")


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(text, verdict), else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are compiled into an expression")
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(found)  # the longest is outermost
    return found


def _shrink(children: DataFrame, parents: DataFrame | None, on: list[str], mean: float, policy: Policy) -> DataFrame:
    """Children (n, k) under their parents' means: adds prior strength, alpha, beta and the shrunken mean.

    One strength serves the whole level, so a child without siblings is shrunk
    as its peers are. It comes from moments: the spread of the children's rates
    about their parents' means, less binomial noise, against m(1-m).
    """
    joined = children.join(parents.select(*on, F.col("mean").alias("m")), on) if on else children.withColumn("m", F.lit(mean))
    noise = F.col("m") * (1 - F.col("m"))
    rate = F.col("k") / F.col("n")
    told = joined.filter(F.col("n") > 0).agg(
        F.sum(F.col("n") * (rate - F.col("m")) * (rate - F.col("m"))).alias("s2"),
        F.sum(noise).alias("v"),
        F.sum(F.col("n") * noise).alias("nv"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("c"),
    ).first()
    low, high = policy.range_of_strength
    if told["c"] < 2:
        strength = policy.strength
    else:
        between = (told["s2"] - told["v"]) / told["n"]
        strength = high if between <= 0 else min(high, max(low, told["nv"] / told["n"] / between - 1))
    return joined.withColumns(
        {"alpha": F.col("k") + strength * F.col("m"), "beta": F.col("n") - F.col("k") + strength * (1 - F.col("m"))}
    ).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def host_reputation(outcomes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Posterior (host, n, k, alpha, beta, mean) of every host in ``outcomes`` (host, good 0/1 or null).

    A host whose outcomes are all null has n = 0 and its domain's mean. Only
    three rows of sums, one a level, reach the driver.
    """
    good = F.when(F.col("good").isNotNull(), (F.col("good") > 0).cast("long"))
    domain, suffix = registered(F.col("host"))
    hosts = stored(
        outcomes.groupBy("host").agg(
            F.count(good).alias("n"), F.coalesce(F.sum(good), F.lit(0)).cast("long").alias("k")
        ).withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    s = _shrink(suffixes, None, [], (total["k"] + 1) / (total["n"] + 2), policy)
    d = _shrink(domains, s, ["suffix"], 0.0, policy)
    return _shrink(hosts, d, ["domain", "suffix"], 0.0, policy).select("host", "n", "k", "alpha", "beta", "mean")


def upper_bound(policy: Policy) -> Column:
    """Upper posterior bound of a host's rate of good pages."""
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("alpha") + F.col("beta") + 1))
    return F.least(F.lit(1.0), F.col("mean") + policy.z * spread)


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], policy: Policy = Policy()) -> DataFrame:
    """Every page (page_id, url) with host, path, the rule that fits, the host's posterior and a verdict.

    ``outcomes`` is (page_id, good), one row a page at most (more count as one,
    good only if all are).
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    one = outcomes.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("good").alias("good"))
    known = host_reputation(
        parts.select("page_id", "host").join(one, "page_id", "left"), policy
    ).withColumn("upper", upper_bound(policy))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return (
        parts.join(known, "host", "left")
        .withColumn("fits", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("fits.text").alias("rule"),
            F.coalesce(
                F.col("fits.verdict"), F.when(F.col("upper") < policy.least_good, "block").otherwise("allow")
            ).alias("verdict"),
            F.col("n").alias("host_outcomes"),
            F.round("mean", 6).alias("mean_good"),
            F.round("upper", 6).alias("upper_good"),
        )
    )
