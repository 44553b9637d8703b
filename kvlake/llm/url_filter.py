"""URL filters: rules, and a ratio of character language models for the rest.

Host and path rules decide what they fit.  Of the URLs that they decide, all of them,
two variable-order Markov models over characters are counted, one for accepted and one
for rejected URLs: grams of 1 to ``ORDER`` characters, each order smoothed towards the
one below it.  A URL's score is the sum over its characters of the log-likelihood
difference in the longest context that has been seen with that character, over its
length.  The threshold is calibrated on the decided URLs of one fold in five, which the
models don't count.  All of it is DataFrame operations.

The model has a row for every gram, so it grows with the URLs.  It meets the distinct grams
of the URLs, and these all places; either join is a broadcast only up to ``BROADCAST_ROWS``
rows and a shuffle beyond, with the same results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, join_spread

ORDER = 4
#: Rows of (gram, ratio) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
SMOOTH = 2.0
ALPHABET = 256
FOLDS = 5


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def _after_scheme(url: str) -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[UrlRule, ...], field: str) -> Column:
    """``field`` of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def places(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, gram) of every place of the text, its end too: the ``ORDER`` characters up to there, marks before its
    beginning.  The text is cut into characters once a row, so the time grows with its length alone."""
    marked = F.concat(F.lit("\x02" * (ORDER - 1)), text, F.lit("\x03"))
    cut_up = rows.select(*keep, F.split(marked, "").alias("__chars"))
    at = F.sequence(F.lit(0), F.size("__chars") - ORDER)
    every = F.transform(at, lambda i: F.concat(*(F.get("__chars", i + j) for j in range(ORDER))))
    return cut_up.select(*keep, F.explode(every).alias("gram"))


def language_models(labelled: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """(k, gram, ratio): the smoothed log-likelihood difference of every gram's last character
    after the others, from ``labelled`` (text, accepted); all rows count."""
    longest = places(labelled, "text", "accepted").groupBy("gram").agg(
        F.sum(F.col("accepted").cast("bigint")).alias("a"), F.sum((~F.col("accepted")).cast("bigint")).alias("r")
    )
    ends = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("gram", F.lit(ORDER + 1 - k), F.lit(k)).alias("gram")) for k in range(1, ORDER + 1)))
    counts = cut(
        longest.select("a", "r", F.explode(ends).alias("g"))
        .groupBy("g.k", "g.gram")
        .agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        .withColumn("context", F.substring("gram", F.lit(1), F.col("k") - 1))
        .withColumn("shorter", F.substring("gram", F.lit(2), F.col("k")))
    )
    contexts = counts.groupBy("k", "context").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
    whole = cut(counts.join(contexts, ["k", "context"]))
    first = whole.where("k = 1")
    p = {c: (F.col(c) + smooth / ALPHABET) / (F.col("n" + c) + smooth) for c in "ar"}
    levels = [first.select("k", "gram", *(p[c].alias("p" + c) for c in "ar"), "a", "r")]
    for k in range(2, ORDER + 1):
        below = levels[-1].select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        p = {c: (F.col(c) + smooth * F.col("q" + c)) / (F.col("n" + c) + smooth) for c in "ar"}
        levels.append(whole.where(F.col("k") == k).join(below, "shorter").select("k", "gram", *(p[c].alias("p" + c) for c in "ar"), "a", "r"))
    table = levels[0]
    for level in levels[1:]:
        table = table.union(level)
    return table.select("k", "gram", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def score(urls: DataFrame, model: DataFrame, text: str, keep: list[str], bound: int = BROADCAST_ROWS) -> DataFrame:
    """``keep`` and ``score``: the mean log-likelihood difference of the characters, 0 where no gram was seen.
    Of ``model``, which is materialised, an order of up to ``bound`` grams is broadcast."""
    numbered = cut(urls.select(*dict.fromkeys([*keep, text])).withColumn("__row", F.monotonically_increasing_id()))
    at = places(numbered, text, "__row").withColumnRenamed("gram", "__gram")
    # The longest gram at a place has the shorter ones as its ends.
    seen = at.groupBy("__gram").agg(F.count("*").alias("__n"))
    sizes = {r["k"]: r["count"] for r in model.groupBy("k").count().collect()}
    for k in range(1, ORDER + 1):
        own = model.where(F.col("k") == k).select(F.col("gram").alias(f"__g{k}"), F.col("ratio").alias(f"__r{k}"))
        own = F.broadcast(own) if sizes.get(k, 0) <= bound else own
        seen = seen.withColumn(f"__g{k}", F.substring("__gram", F.lit(ORDER + 1 - k), F.lit(k))).join(own, f"__g{k}", "left")
    ratio = F.coalesce(*(F.col(f"__r{k}") for k in range(ORDER, 0, -1)), F.lit(0.0))
    seen = cut(seen.select("__gram", ratio.alias("__ratio"), "__n"))
    size = seen.agg(F.count("*").alias("grams"), F.coalesce(F.sum("__n"), F.lit(0)).alias("places")).first()
    if size["grams"] <= bound:
        found = at.join(F.broadcast(seen.drop("__n")), "__gram")
    else:
        found = join_spread(at, seen, "__gram", "__n", size["places"])
    # Sums of whole multiples of a fraction do not depend on their order.
    exact = F.round(F.col("__ratio") * F.lit(2.0**32)).cast("bigint")
    own = found.groupBy("__row").agg((F.sum(exact) / F.count("*") / F.lit(2.0**32)).alias("score"))
    return numbered.join(own, "__row").select(*keep, "score")


def calibrated(scored: DataFrame, bins: int = 400, reach: float = 4.0) -> float:
    """The threshold with the best mean of the two classes' shares that it gets right, over (accepted, score);
    read from a histogram of ``bins`` bins.  0 if a class is missing."""
    bin_of = F.floor((F.least(F.greatest(F.col("score"), F.lit(-reach)), F.lit(reach)) + reach) * (bins / (2 * reach)))
    rows = scored.groupBy(F.least(bin_of, F.lit(bins - 1)).cast("int").alias("b")).agg(
        F.sum(F.col("accepted").cast("bigint")).alias("a"), F.sum((~F.col("accepted")).cast("bigint")).alias("r")
    )
    got = {x["b"]: (x["a"], x["r"]) for x in rows.collect()}
    all_a, all_r = (sum(x[k] for x in got.values()) for k in (0, 1))
    if not all_a or not all_r:
        return 0.0
    best, threshold, below_a, below_r = -1.0, [], 0, 0
    for b in range(bins + 1):
        right = (all_a - below_a) / all_a + below_r / all_r
        if right > best + 1e-12:
            best, threshold = right, [b]
        elif right > best - 1e-12:
            threshold.append(b)
        a, r = got.get(b, (0, 0))
        below_a, below_r = below_a + a, below_r + r
    return threshold[len(threshold) // 2] * (2 * reach / bins) - reach


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    A null URL, or one without ``://``, has an empty host and path; no rule fits it, and
    as it has no characters to judge it is blocked.  Null ids and repeated rows are kept;
    other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    urls = urls.withColumn("rule", rule_of(rules, "name")).withColumn("ruled", rule_of(rules, "verdict"))
    urls = urls.withColumn("text", F.concat("host", "path"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS))
    labelled = urls.where(F.col("rule").isNotNull()).withColumn("accepted", F.col("ruled") == "allow")
    model = cut(language_models(labelled.where(fold != 0).select("text", "accepted")))
    scored = cut(score(urls, model, "text", ["id", "host", "path", "rule", "ruled"]))
    decided = scored.where(F.col("rule").isNotNull() & (F.pmod(F.xxhash64(F.concat("host", "path")), F.lit(FOLDS)) == 0))
    threshold = calibrated(decided.select((F.col("ruled") == "allow").alias("accepted"), "score"))
    method = F.when((F.col("score") >= threshold) & (F.concat("host", "path") != ""), "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
