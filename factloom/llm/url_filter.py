"""URL filtering by rules and a character language-model ratio, in DataFrame functions alone.

URLs that a rule decides train two variable-order Markov models over a small
alphabet, one for accepted and one for rejected URLs, smoothed by Witten-Bell
interpolation of all orders.  Other URLs are judged by the mean log-likelihood
difference over their symbols, against a threshold calibrated on ruled ones that
did not train the models.

Tables by n-gram have at most 41 ** (ORDER + 1) rows, some 2.8 million, whatever
the number of URLs.  The ratios are broadcast up to MOST_BROADCAST rows (about
100 bytes each in a task's memory) and joined by key beyond it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, wrapped

#: Symbols: these, 0 for any digit, ~ for any other character, ^ before the start, $ after the end.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.:-_?=&#%+~^$"
ORDER = 3
MOST_BROADCAST = 400_000
#: One in so many of the ruled URLs calibrates the threshold and trains nothing.
HELD = 4
#: (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and where there is no ``://``."""
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, _URL, 1)), F.regexp_extract(text, _URL, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    text = F.regexp_replace(lower_ascii(F.coalesce(url, F.lit(""))), r"(?s)^.*?://", "")
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), r"[^a-z0/.:\-_?=&#%+]", "~")


def _grams(urls: DataFrame, order: int, *names: str) -> DataFrame:
    """A row (names, gram) for each symbol and the end: the symbol after its ``order`` predecessors.

    One pass over the text makes all grams, so that a long URL costs as much a
    symbol as a short one.
    """
    padded = F.concat(F.lit("^" * order), F.col("sym"), F.lit("$"))
    return urls.select(*names, F.explode(F.regexp_extract_all(padded, F.lit(f"(?=(.{{{order + 1}}}))"), F.lit(1))).alias("gram"))


def _log_ratio(grams: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): ln P(rejected model) - ln P(accepted model) of each gram's last symbol.

    ``counts`` has (verdict, gram, n) of the training URLs at the full order;
    lower orders are sums of it.
    """
    out = grams
    for verdict in ("block", "allow"):
        own = counts.where(F.col("verdict") == verdict).drop("verdict")
        p = F.lit(1.0 / len(ALPHABET))
        for k in range(order + 1):
            at = own.groupBy(F.substring("gram", -(k + 1), k + 1).alias("g")).agg(F.sum("n").alias("n"))
            context = at.groupBy(F.expr(f"substring(g, 1, {k})").alias("h")).agg(F.sum("n").alias("nh"), F.count("*").alias("th"))
            out = out.join(at.select(F.col("g").alias("_g"), F.col("n").alias("_n")), F.substring("gram", -(k + 1), k + 1) == F.col("_g"), "left")
            out = out.join(context.select(F.col("h").alias("_h"), "nh", "th"), F.expr(f"substring(gram, {order + 1 - k}, {k})") == F.col("_h"), "left")
            seen = (F.coalesce("_n", F.lit(0)) + F.col("th") * p) / (F.col("nh") + F.col("th"))
            out = out.withColumn(f"_p{k}_{verdict}", F.when(F.col("nh").isNull(), p).otherwise(seen)).drop("_g", "_n", "_h", "nh", "th")
            p = F.col(f"_p{k}_{verdict}")
    return out.select("gram", (F.ln(f"_p{order}_block") - F.ln(f"_p{order}_allow")).alias("ratio"))


def calibrated_threshold(scored: DataFrame, width: float = 1 / 64, most: float = 8.0) -> float:
    """The bin edge with the least sum of both error rates over (verdict, score); the edge nearest zero of several.

    Scores are binned, so that what is gathered has a fixed size.
    """
    bins = math.ceil(most / width)
    at = F.greatest(F.lit(-bins), F.least(F.lit(bins - 1), F.floor(F.col("score") / width))).cast("int")
    sums = scored.groupBy(at.alias("bin")).agg(F.count_if(F.col("verdict") == "block").alias("b"), F.count_if(F.col("verdict") == "allow").alias("a"))
    found = {r["bin"]: (r["b"], r["a"]) for r in sums.collect()}
    blocks, allows = (sum(x[i] for x in found.values()) for i in (0, 1))
    if not blocks or not allows:
        return math.inf
    best, missed = (math.inf, 0.0, 0.0), 0
    kept = 0
    for edge in range(-bins, bins + 1):
        # block at or above the edge
        error = missed / blocks + (allows - kept) / allows
        best = min(best, (round(error, 12), abs(edge * width), edge * width))
        b, a = found.get(edge, (0, 0))
        missed, kept = missed + b, kept + a
    return best[2]


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (prefixed by an underscore;
    columns of those names, and _says, _sym and _of, are replaced).

    verdict is the rule's, else block where the score reaches the threshold.
    Without ruled URLs of both kinds every other URL is allowed; where the ones
    held out for the threshold lack a kind, all ruled ones calibrate it.  Null and
    empty URLs have empty parts, no rule, and are scored as the empty string.
    Equal symbol strings are scored once.  Rows and other columns pass through.
    """
    host, path = url_parts(F.col(url_col))
    ruled = pages.withColumn("_host", host).withColumn("_path", path)
    rule, says = matching_rule(F.col("_host"), F.col("_path"), rules)
    ruled = ruled.withColumn("_rule", rule).withColumn("_says", says).withColumn("_sym", symbols(F.col(url_col)))
    seen = ruled.groupBy(F.col("_sym").alias("sym"), F.col("_says").alias("verdict")).agg(F.count("*").alias("times"))
    # grams carry a hash of their URL, not the URL
    seen = materialise(seen.withColumn("of", F.md5("sym")).withColumn("held", F.pmod(F.xxhash64("sym"), F.lit(HELD)) == 0))
    all_grams = materialise(_grams(seen, order, "verdict", "held", "times").groupBy("verdict", "held", "gram").agg(F.sum("times").alias("n")))
    counts = all_grams.where("verdict is not null and not held").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    ratios = materialise(_log_ratio(all_grams.select("gram").distinct(), counts, order))
    few = ratios.count() <= MOST_BROADCAST
    each = _grams(seen.dropDuplicates(["sym"]), order, "of").join(F.broadcast(ratios) if few else ratios, "gram")
    scores = materialise(each.groupBy("of").agg(F.avg("ratio").alias("score")))
    labelled = seen.where("verdict is not null").join(scores, "of")
    threshold = calibrated_threshold(labelled.where("held"))
    if math.isinf(threshold):
        threshold = calibrated_threshold(labelled)
    joined = ruled.join(scores.select(F.col("of").alias("_of"), F.col("score").alias("_score")), F.md5("_sym") == F.col("_of"), "left")
    by_model = F.when(F.col("_score") >= F.lit(threshold), "block").otherwise("allow")
    return joined.withColumn("_verdict", F.coalesce("_says", by_model)).drop("_says", "_sym", "_of")


def allowed_pages(pages: DataFrame, url_col: str = "url", **how) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, all columns as they were."""
    out = judge_urls(wrapped(pages, url=url_col), "url", **how).where("_verdict = 'allow'")
    return out.select(*(F.col("row")[c].alias(c) for c in pages.columns))
