"""URL filter: listed rules first, then a ratio of two character language models.

Rules. A rule is a host, a path prefix and a verdict. It fits its host and all subdomains
if the URL's path starts with the rule's path; the longest fitting rule decides, of equally
long ones the first in order of text.

Models. One variable-order Markov model of accepted URLs, one of rejected ones. A
character's probability after a context is its count there, smoothed by ``strength`` times
its probability after the context that is one shorter; contexts seen fewer than ``least``
times fall back to the shorter one. The log ratio of the two models at a position therefore
is a sum, over the contexts kept, of what each adds to its shorter one, so that a URL is
scored by looking up its n-grams. The score is that sum over all positions, divided by
their number; the threshold is calibrated on labelled URLs that training did not see.

Labels. A URL is a rejected sample if a word of its host is in ``SEED_WORDS``, else an
accepted one. All URLs count, equal ones once; a quarter, by hash, is held out from training.

Scale. N-grams are counted in tasks before they are shuffled. Scoring needs no shuffle: the model has every n-gram
that the training URLs hold ``least`` times, comes as one scalar subquery, and each URL looks up its n-grams in its
own row. It grows with the different n-grams, not with the URLs. All of it is DataFrame functions. ``fit`` and ``judge`` run jobs while the plan is built.

Defined cases. A URL that is null or has no ``://`` has an empty host and path, no rule and
no score, and is allowed. Without samples of either kind nothing is blocked by the model.
Repeated rows are judged each. Of the input only the URL is read; for filtering, rows keep
all their columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.llm.common import bound, fresh
from tallyrank.session import write_through

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols after folding: letters, one digit, marks, start, anything else.
SYMBOLS = 26 + 1 + 9 + 1 + 1
#: Host words that mark a URL as a rejected sample.
SEED_WORDS = (
    "ads", "adult", "adserver", "banner", "bet", "bets", "betting", "bingo", "casino", "cheap", "clickbait",
    "darknet", "doubleclick", "escort", "gambling", "hentai", "jackpot", "keygen", "loans", "lottery", "malware",
    "payday", "phishing", "pills", "poker", "porn", "pharma", "popunder", "replica", "scam", "sex", "slots",
    "spam", "spyware", "telemetry", "torrent", "track", "tracker", "viagra", "warez", "xxx",
)
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct of text and verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        this = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host, path), this).otherwise(found)
    return found


def symbols(host: Column, path: Column) -> Column:
    """Folded characters of host and path as an array."""
    text = F.translate(F.concat(host, path), UPPER + "0123456789", LOWER + "0" * 10)
    return F.split(F.regexp_replace(text, r"[^a-z0./_~%=+,-]", "?"), "")


def grams(chars: Column, order: int) -> Column:
    """For every position the n-grams of 1 to ``order`` + 1 symbols that end there."""
    def within(padded: Column) -> Column:
        def at(end: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(end, F.lit(order + 1)))
            return F.transform(sizes, lambda n: F.array_join(F.slice(padded, end - n + 1, n), ""))

        ends = F.when(F.size(padded) > 1, F.sequence(F.lit(2), F.size(padded))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(ends, at))

    return bound(F.concat(F.array(F.lit("^")), chars), within)


@dataclass(frozen=True)
class UrlModel:
    """n-grams with what each adds to the log ratio, in ``buckets`` of a one-row table."""

    table: DataFrame
    buckets: int
    order: int
    threshold: float | None

    def score(self, df: DataFrame, host: Column, path: Column, out: str) -> DataFrame:
        """Adds the mean log ratio per character; null for an empty host.

        The model's column is used once, so that the optimizer puts its subquery in that
        place and no row ever holds a copy.
        """
        parts = fresh("model")
        chars = symbols(host, path)

        def adds(gram: Column) -> Column:
            bucket = F.col(parts)[F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")]
            return F.coalesce(bucket[gram], F.lit(0.0))

        total = F.aggregate(F.transform(grams(chars, self.order), adds), F.lit(0.0), lambda s, x: s + x)
        kept = [c for c in df.columns if c != out]
        return df.withColumn(parts, self.table.scalar()).select(
            *kept, F.when(host != "", total / F.size(chars)).alias(out)
        )


def _compiled(counts: DataFrame, order: int, least: int, strength: float) -> DataFrame:
    """n-grams with the difference they make to the log ratio of their suffix."""
    by_context = Window.partitionBy("n", "context")
    counted = (
        counts.withColumn("n", F.length("gram"))
        .withColumn("context", F.expr("substring(gram, 1, n - 1)"))
        .withColumn("suffix", F.expr("substring(gram, 2)"))
        .withColumn("all_bad", F.sum("bad").over(by_context))
        .withColumn("all_good", F.sum("good").over(by_context))
        .where(F.col("bad") + F.col("good") >= least)
    )
    counted = write_through(counted, "url-counts")
    chain = (
        counted.select("gram", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
        .withColumn("suffix", F.expr("right(gram, k)"))
        .join(counted.select(F.col("gram").alias("suffix"), "bad", "good", "all_bad", "all_good"), "suffix")
        .groupBy("gram")
        .agg(F.array_sort(F.collect_list(F.struct("k", "bad", "good", "all_bad", "all_good"))).alias("chain"))
    )

    def deeper(p: Column, at: Column) -> Column:
        bad = (at["bad"] + strength * p["bad"]) / (at["all_bad"] + strength)
        good = (at["good"] + strength * p["good"]) / (at["all_good"] + strength)
        return F.struct(bad.alias("bad"), good.alias("good"), F.log(bad / good).alias("ratio"), p["ratio"].alias("before"))

    none = F.lit(1.0 / SYMBOLS)
    start = F.struct(none.alias("bad"), none.alias("good"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("before"))
    end = F.aggregate("chain", start, deeper)
    return chain.withColumn("end", end).select("gram", (F.col("end")["ratio"] - F.col("end")["before"]).alias("adds"))


def fit(
    urls: DataFrame, url: str = "url", *, seeds: Sequence[str] = SEED_WORDS, order: int = 4,
    least: int = 3, strength: float = 2.0, wrong: float = 0.002,
) -> UrlModel:
    """Trains both models and calibrates the threshold.

    The threshold lies midway between the score that ``wrong`` of the accepted samples
    held out exceed and the score that ``wrong`` of the rejected ones stay below; if these
    overlap, it is the former.
    """
    text = F.col(url)
    labelled = urls.select(host_of(text).alias("host"), path_of(text).alias("path")).where("host != ''").withColumn(
        "bad", F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, seeds)))
    )
    chosen = write_through(labelled.distinct(), "url-labelled")
    held = F.pmod(F.xxhash64(F.lit("held"), "host", "path"), F.lit(4)) == 0
    counts = (
        chosen.where(~held).select("bad", F.explode(grams(symbols(F.col("host"), F.col("path")), order)).alias("gram"))
        .groupBy("gram").agg(
            F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good")
        )
    )
    compiled = write_through(_compiled(counts, order, least, strength), "url-grams")
    buckets = max(1, compiled.count() // 4)
    spread = (
        compiled.groupBy(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket"))
        .agg(F.collect_list(F.struct("gram", "adds")).alias("part"))
    )
    every = urls.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    empty = F.array().cast("array<struct<gram:string,adds:double>>")
    table = (
        every.join(spread, "bucket", "left")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("part", empty).alias("part")))).alias("parts"))
        .select(F.transform("parts", lambda x: F.map_from_entries(x["part"])).alias("parts"))
    )
    table = write_through(table, "url-model")
    model = UrlModel(table, buckets, order, None)
    scored = model.score(chosen.where(held).select("bad", "host", "path"), F.col("host"), F.col("path"), "s")
    tail = scored.groupBy("bad").agg(
        F.percentile_approx("s", 1 - wrong, 10_000).alias("high"), F.percentile_approx("s", wrong, 10_000).alias("low")
    )
    at = {r["bad"]: r for r in tail.collect()}
    if len(at) < 2:
        return model
    high, low = at[False]["high"], at[True]["low"]
    return UrlModel(table, buckets, order, (high + low) / 2 if low > high else high)


def judged(df: DataFrame, model: UrlModel, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and score; the input's columns of these names are replaced."""
    parts, found = fresh("parts"), fresh("rule")
    host, path = F.col(parts)["host"], F.col(parts)["path"]
    rows = df.withColumn(parts, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    rows = model.score(rows.withColumn(found, longest_rule(rules, host, path)), host, path, "score")
    blocked = F.lit(False) if model.threshold is None else F.coalesce(F.col("score") > model.threshold, F.lit(False))
    own = F.when(blocked, BLOCK).otherwise(ALLOW)
    return rows.withColumns({
        "host": host, "path": path, "rule": F.col(found)["text"],
        "verdict": F.coalesce(F.col(found)["verdict"], own),
    }).drop(parts, found)
