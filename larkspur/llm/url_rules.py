"""URL filtering by mined association rules, under a fixed list of host and path rules.

Each url becomes a set of tokens (labels of its host, words of its path with their level, keys of its query).
Tokens that exactly the same labelled pages have are one bundle, so a template of many tokens doesn't double the
combinations with each of them. Spark's FP-growth mines the bundles of labelled pages, each with a token that says if
the page was bad; a rule is a combination that enough labelled pages have and are bad with (SUPPORT) and that is bad
often enough (CONFIDENCE), and is dropped if a part of it is already as confident. It names one token of each of its
bundles; a rule of one bundle is given for each of the bundle's tokens. A bundle that is always bad is a rule that no
longer one betters, one that too few bad pages have is in no rule, and one that all pages have changes no count: these are
left out before combinations are made. Where a page still has more than WIDTH bundles, FP-growth would list up to two to
the power of their number; there combinations grow by one bundle at a time instead, and one that is always bad or counts
no fewer pages than a part of it is not grown on, as nothing that holds it could be a rule. Both ways give the same rules.
Rules are matched through an inverted index: each is listed under its rarest token, and only pages with that token
compare the whole combination.

A fixed rule fits its host and all subdomains if the url's path starts with the rule's path; the longest wins
over shorter ones and over mined rules. Urls that are null or lack `://` have empty host and path, no tokens,
and the verdict `allow`. Verdicts depend on the url alone, so repeated rows agree. Labels for unknown pages and
pages without labels teach nothing; without labels only the fixed rules decide.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import materialize, plain, release

BAD = "label=bad"
SUPPORT = 0.001
CONFIDENCE = 0.8
WIDTH = 12
BROADCAST_ROWS = 100_000
FIXED = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a url; empty for a url without host and path."""
    labels = F.transform(F.filter(F.split(host(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.filter(F.split(F.regexp_replace(path(url), r"\d+", "0"), "/"), lambda x: x != "")
    steps = F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    query = F.regexp_extract(_after_scheme(url), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, none) for x in (labels, steps, keys)))))


def fixed_rule(url_host: Column, url_path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fixed rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((url_host == name) | url_host.endswith("." + name)) & url_path.startswith("/" + rest)
        then = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bundles(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(bundle, tokens, n): frequent tokens that exactly the same rows of (tokens, bad, row) have, named by the first one."""
    least = F.lit(max(1.0, support * labelled.count()))
    row = F.xxhash64("row").cast("decimal(20,0)")
    each = labelled.select(F.explode("tokens").alias("token"), row.alias("h")).groupBy("token")
    each = each.agg(F.count("*").alias("n"), F.sum("h").alias("of"))
    together = each.filter(F.col("n") >= least - 1e-9).groupBy("n", "of").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return together.select(F.col("tokens")[0].alias("bundle"), "tokens", "n")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, width: int = WIDTH) -> DataFrame:
    """rule_tokens, support, confidence, from rows of (tokens, bad, row); row tells different pages apart.

    width: with more bundles on a page, combinations are grown instead of listed; the rules are the same.
    """
    labelled = materialize(labelled, "labelled")
    total = labelled.count()
    least = max(1.0, support * total) - 1e-9
    found = materialize(bundles(labelled, support), "bundles")
    names = _small(found.select("bundle", F.col("bundle").alias("token")), found.count())
    has = labelled.select("row", "bad", F.explode("tokens").alias("token")).join(names, "token")
    alone = has.groupBy("bundle").agg(F.count_if("bad").alias("bad_freq"), F.count("*").alias("all_freq"))
    alone = materialize(alone.filter(F.col("bad_freq") >= least), "alone")
    grown = alone.filter((F.col("bad_freq") < F.col("all_freq")) & (F.col("all_freq") < total))
    pages = has.join(_small(grown.select("bundle"), found.count()), "bundle").groupBy("row", "bad")
    pages = materialize(pages.agg(F.array_sort(F.collect_list("bundle")).alias("b")).filter(F.size("b") > 1), "transactions")
    combine = _listed_sets if pages.filter(F.size("b") > width).isEmpty() else _grown_sets
    several = combine(pages, grown.select("bundle", "all_freq"), least)
    rules = alone.select(F.array("bundle").alias("rule"), "bad_freq", "all_freq").unionByName(several)
    rules = rules.select("rule", F.col("bad_freq").alias("support"), (F.col("bad_freq") / F.col("all_freq")).alias("confidence"))
    rules = materialize(rules.filter(F.col("confidence") >= confidence), "confident")
    # a rule is redundant if one of its parts, a bundle shorter, is as confident
    shorter = rules.select(F.col("rule").alias("part"), F.col("confidence").alias("part_confidence"))
    parts = rules.select("rule", "confidence", F.explode(F.transform("rule", lambda t: F.array_remove("rule", t))).alias("part"))
    redundant = parts.join(shorter, "part").filter(F.col("part_confidence") >= F.col("confidence")).select("rule").distinct()
    rules = rules.join(redundant, "rule", "left_anti")
    single = rules.filter(F.size("rule") == 1).withColumn("bundle", F.col("rule")[0]).join(found.select("bundle", "tokens"), "bundle")
    single = single.select(F.explode(F.transform("tokens", lambda t: F.array(t))).alias("rule_tokens"), "support", "confidence")
    several = rules.filter(F.size("rule") > 1).select(F.col("rule").alias("rule_tokens"), "support", "confidence")
    out = materialize(single.unionByName(several), "rules")
    release(labelled, found, alone, pages, rules)
    return out


SETS = "rule array<string>, bad_freq long, all_freq long"


def _listed_sets(pages: DataFrame, grown: DataFrame, least: float) -> DataFrame:
    """rule, bad_freq, all_freq of all combinations of two bundles and more that enough bad pages have, by FP-growth."""
    n = pages.count()
    if not n:
        return pages.sparkSession.createDataFrame([], SETS)
    items = pages.select(F.when(F.col("bad"), F.concat("b", F.array(F.lit(BAD)))).otherwise(F.col("b")).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=1.0).fit(items).freqItemsets
    labelled = F.array_contains("items", BAD)
    bad = frequent.filter(labelled).select(F.array_sort(F.array_remove("items", BAD)).alias("rule"), F.col("freq").alias("bad_freq"))
    every = frequent.filter(~labelled).select(F.array_sort("items").alias("rule"), F.col("freq").alias("all_freq"))
    return bad.filter(F.size("rule") > 1).join(every, "rule")


def _joined(batches):
    """Of a page's combinations of one size those of the next, all of whose parts are among them: (id, n, bad, rule, fewest)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for page, n, bad, sets in zip(*(c.to_pylist() for c in batch.columns)):
            counts = {tuple(s["rule"]): s["all_freq"] for s in sets}
            by_start: dict[tuple, list[str]] = {}
            for s in sorted(counts):
                by_start.setdefault(s[:-1], []).append(s[-1])
            for start, ends in by_start.items():
                for i, x in enumerate(ends):
                    for y in ends[i + 1 :]:
                        one = (*start, x, y)
                        parts = [counts.get(one[:k] + one[k + 1 :]) for k in range(len(one))]
                        if None not in parts:
                            for column, value in zip(out, (page, n, bad, list(one), min(parts))):
                                column.append(value)
                if len(out[0]) > 50_000:
                    yield _batch(out)
                    out = [[], [], [], [], []]
        yield _batch(out)


def _batch(columns: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "n", "bad", "rule", "fewest"])


def _grown_sets(pages: DataFrame, grown: DataFrame, least: float) -> DataFrame:
    """As _listed_sets(), but only combinations that may be rules or parts of rules: they grow by a bundle at a time."""
    alike = pages.groupBy("b").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    alike = materialize(alike.withColumn("id", F.monotonically_increasing_id()), "alike")
    sets = alike.select("id", "n", "bad", F.explode("b").alias("bundle")).join(_small(grown, grown.count()), "bundle")
    sets = sets.select("id", "n", "bad", F.struct(F.array("bundle").alias("rule"), "all_freq").alias("s"))
    out = []
    while True:
        sets = sets.groupBy("id", "n", "bad").agg(F.collect_list("s").alias("sets")).filter(F.size("sets") > 1)
        longer = materialize(sets.mapInArrow(_joined, "id long, n long, bad long, rule array<string>, fewest long"), "longer")
        counts = longer.groupBy("rule").agg(F.sum("bad").alias("bad_freq"), F.sum("n").alias("all_freq"), F.min("fewest").alias("fewest"))
        counts = materialize(counts.filter((F.col("bad_freq") >= least) & (F.col("all_freq") < F.col("fewest"))).drop("fewest"), "sets")
        out.append(counts)
        further = counts.filter(F.col("bad_freq") < F.col("all_freq")).select("rule", "all_freq")
        if (n := further.count()) < 2:
            return reduce(DataFrame.unionByName, out)
        sets = longer.join(_small(further, n), "rule").select("id", "n", "bad", F.struct("rule", "all_freq").alias("s"))


def _listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under its rarest token among urls: (token, rule_tokens) and the rule's other columns."""
    uses = rules.select(F.explode("rule_tokens").alias("token")).distinct()
    rows = rules.count()
    used = urls.select(F.explode("tokens").alias("token")).join(_small(uses, rows), "token").groupBy("token").count()
    rules = rules.withColumn("id", F.sha2(F.concat_ws("\n", "rule_tokens"), 256))
    by_token = rules.select("id", F.explode("rule_tokens").alias("token")).join(used, "token")
    rarest = by_token.groupBy("id").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    return _small(rules.join(rarest, "id").drop("id"), rows)


def _fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Every url with every rule whose tokens it has."""
    posted = urls.withColumn("token", F.explode("tokens")).join(_listed(urls, rules), "token")
    return posted.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence: the most confident mined rule of each url that any fits; urls has (url, tokens), distinct."""
    found = _fitting(urls, rules.select("rule_tokens", "confidence"))
    return found.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    fixed: Sequence[tuple[str, str]] = FIXED,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for every page; labels: (page_id, bad)."""
    rows = plain(pages, "page_id", "url")
    known = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    row = F.concat_ws(" ", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")).alias("row")
    labelled = rows.join(known, "page_id").select(tokens(F.col("url")).alias("tokens"), "bad", row).filter(F.size("tokens") > 0)
    distinct = rows.filter("url is not null").select("url").distinct()
    distinct = distinct.withColumn("tokens", tokens(F.col("url"))).filter(F.size("tokens") > 0)
    found = matches(distinct, mine(labelled, support, confidence))
    u = F.col("url")
    out = rows.join(found, "url", "left").select("page_id", host(u).alias("host"), path(u).alias("path"), "confidence")
    out = out.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "confidence")
