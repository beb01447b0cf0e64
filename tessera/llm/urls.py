"""URL filters: rules by host and path, and a ratio of character models for what no rule decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.store import saved

#: (verdict, host and path), as in the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Characters of the longest context.
ORDER = 4
#: Rules make one expression; more of them belong into a join.
MOST_RULES = 1000
#: Ratios that are broadcast; a row has a piece of at most ORDER + 1 characters and a number.
SMALL_RATIOS = 200_000
#: Log ratios are whole multiples of 1 / UNITS bits, so sums don't depend on their order.
UNITS = 1 << 20
#: Units in a step of the normalised ratio, and steps that are told apart on either side of 0.
STEP, STEPS = 1 << 12, 1 << 13
#: Probability of a character in no context at all: all of Unicode alike.
UNIFORM = 1 / 1_114_112

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without query and fragment; empty for null or without ``://``."""
    path = F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    A rule fits its host and all hosts below it, where the path starts with the rule's.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        of, slash, begin = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + begin))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def signs(url: Column, order: int = ORDER) -> Column:
    """The characters after the scheme (all of them without one) between start signs and an end sign."""
    text = F.coalesce(after_scheme(url), url, F.lit(""))
    own = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.concat(F.array_repeat(F.lit(START), order), own, F.array(F.lit(END)))


def pieces(chars: Column, order: int = ORDER) -> Column:
    """Every character but the start signs, after the ``order`` characters before it.

    ``chars`` must be a column that is there already: an expression would run again for every piece.
    """
    places = F.sequence(F.lit(0), F.size(chars) - order - 1)
    return F.transform(places, lambda i: F.concat(*[F.get(chars, i + j) for j in range(order + 1)]))


def last(piece: Column, n: int) -> Column:
    return F.substring(piece, -n, n)


def ratios(asked: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(model, piece, ratio): log2 p(accepted) / p(rejected) of a piece's last character after its context.

    ``asked`` has (model, piece), ``counts`` has (model, piece, allowed, blocked): how often each
    class has a piece. The models are Markov models of variable order, smoothed after Witten and Bell:
    p(c | context) = (n(context, c) + kinds(context) * p(c | shorter context)) / (n(context) +
    kinds(context)), where kinds counts the different characters seen after the context. A context that
    a class doesn't have passes on the probability of the shorter one; the shortest is UNIFORM.
    """
    shorter = None
    for k in range(order + 1):
        wanted = asked.select("model", last(F.col("piece"), k + 1).alias("piece")).distinct()
        seen = counts.groupBy("model", last(F.col("piece"), k + 1).alias("piece")).agg(
            F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")
        )
        context = F.substring(F.col("piece"), 1, k)
        contexts = seen.groupBy("model", context.alias("context")).agg(
            F.sum("allowed").alias("n_allowed"),
            F.count_if(F.col("allowed") > 0).alias("kinds_allowed"),
            F.sum("blocked").alias("n_blocked"),
            F.count_if(F.col("blocked") > 0).alias("kinds_blocked"),
        )
        rows = wanted.join(seen, ["model", "piece"], "left").withColumn("context", context)
        rows = rows.join(contexts, ["model", "context"], "left")
        if shorter is None:
            rows = rows.withColumns({"p_allowed": F.lit(UNIFORM), "p_blocked": F.lit(UNIFORM)})
        else:
            rows = rows.withColumn("end", last(F.col("piece"), k)).join(
                shorter.withColumnRenamed("piece", "end"), ["model", "end"]
            )

        def smoothed(kind: str) -> Column:
            n, kinds, p = (F.coalesce(F.col(f"{x}_{kind}"), F.lit(0)) for x in ("n", "kinds", "p"))
            mixed = (F.coalesce(F.col(kind), F.lit(0)) + kinds * p) / (n + kinds)
            return F.when(n > 0, mixed).otherwise(p).alias(f"p_{kind}")

        shorter = rows.select("model", "piece", smoothed("allowed"), smoothed("blocked"))
    ratio = F.round((F.log2("p_allowed") - F.log2("p_blocked")) * UNITS).cast("bigint")
    return shorter.select("model", "piece", ratio.alias("ratio"))


def threshold(steps: DataFrame) -> int:
    """The step from which a normalised ratio means allow: the best for rows whose verdict is known.

    ``steps`` has (verdict, step) with at most 2 * STEPS different steps. Best is the largest sum of
    both verdicts' shares on the right side; of equally good limits, also those between two steps that
    occur, the one nearest 0, then the smaller. 0 if one of the verdicts has no row.
    """
    bins = saved(
        steps.groupBy("step").agg(
            F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")
        ),
        "steps",
    )
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upward = Window.orderBy("step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    downward = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.lag("step").over(Window.orderBy("step")) + 1  # limits from here to the step judge alike
    judged = bins.select(
        F.greatest(gap, F.least("step", F.lit(0))).alias("step"),
        F.sum("allowed").over(upward).cast("decimal(19,0)").alias("allowed_above"),
        F.coalesce(F.sum("blocked").over(downward), F.lit(0)).cast("decimal(19,0)").alias("blocked_below"),
        F.sum("allowed").over(whole).cast("decimal(19,0)").alias("allowed"),
        F.sum("blocked").over(whole).cast("decimal(19,0)").alias("blocked"),
    ).filter("allowed > 0 and blocked > 0")
    right = F.col("allowed_above") * F.col("blocked") + F.col("blocked_below") * F.col("allowed")
    best = judged.orderBy(right.desc(), F.abs("step"), "step").first()
    return best["step"] if best else 0


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = ORDER,
) -> DataFrame:
    """Host, path, rule and verdict of every URL; where no rule fits, two character models decide.

    Returns ``page_id, host, path, rule, verdict, step``, one row per input row. ``step`` is the
    log-likelihood ratio per character in units of STEP / UNITS bits.

    - A null URL, or one without ``://``, has an empty host and path; no rule fits. The models read
      what follows the scheme, or all of a URL without it; of a null or empty one, the end sign.
    - Ids may repeat or be null. Any text may come, of any length. Equal URLs get equal verdicts.
    - Without URLs that a rule allows, or without any that one blocks, the limit is 0, and a class
      without URLs gives every character the same probability.
    - An empty table gives an empty result; other columns are ignored.

    Both models are learned from every URL that a rule decides: pieces of ORDER + 1 characters are
    counted where they are read, then per piece. The limit on the ratio is calibrated on the same
    URLs, each judged by models of the other half (halves by MD5 of the URL); all other URLs are
    judged by models of both halves. Rows keep a number written with them, so neither a hot host nor
    a hot URL is a key of rows. Ratios are broadcast while they are few, else joined by a shuffle.
    """
    url = pages[url_col]
    half = F.when(F.substring(F.md5(url.cast("binary")), 1, 1) < "8", F.lit(0)).otherwise(F.lit(1))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(
        pages[id_col].alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), half.alias("half")
    )
    rows = rows.select("*", rule.alias("rule"), verdict.alias("decided"))
    #: halves are judged by the other half's model; model 2 has both
    rows = rows.withColumn("model", F.when(F.col("decided").isNull(), 2).otherwise(F.col("half")))
    rows = saved(rows.drop("half").withColumn("row", F.monotonically_increasing_id()), "urls")

    found = rows.select("row", "model", "decided", signs(F.col("url"), order).alias("chars"))
    found = found.select("row", "model", "decided", F.explode(pieces(F.col("chars"), order)).alias("piece"))
    tally = saved(found.groupBy("model", "decided", "piece").agg(F.count("*").alias("n")), "pieces")
    known = tally.filter("decided is not null").select(
        F.explode(F.array(1 - F.col("model"), F.lit(2))).alias("model"), "decided", "piece", "n"
    )
    counts = saved(
        known.groupBy("model", "piece").agg(
            *[F.sum(F.when(F.col("decided") == d, F.col("n")).otherwise(0)).alias(n) for d, n in (("allow", "allowed"), ("block", "blocked"))]
        ),
        "counts",
    )
    asked = tally.select("model", "piece").distinct()
    known_ratios = saved(ratios(asked, counts, order), "ratios")
    few = known_ratios.limit(SMALL_RATIOS + 1).count() <= SMALL_RATIOS
    side = F.broadcast(known_ratios) if few else known_ratios.hint("merge")
    scores = found.join(side, ["model", "piece"]).groupBy("row").agg(F.sum("ratio").alias("ratio"), F.count("*").alias("n"))
    step = F.floor(F.col("ratio") / (F.col("n") * STEP))
    scored = saved(
        rows.join(scores, "row").select(
            "page_id", "host", "path", "rule", "decided", F.least(F.greatest(step, F.lit(-STEPS)), F.lit(STEPS - 1)).alias("step")
        ),
        "scored",
    )
    limit = threshold(scored.filter("decided is not null").select(F.col("decided").alias("verdict"), "step"))
    by_model = F.when(F.col("step") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"), "step")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
