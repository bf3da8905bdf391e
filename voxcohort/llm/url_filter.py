"""URL filter: address rules, and for what no rule decides the ratio of two character language models.

One model is trained on URLs that the rules allow, one on those they block. A model predicts each character from up to `ORDER` characters
before it. With n the count of a string, t the count of its context and s the string without its first character,

    P(string) = (n + PRIOR * P(s)) / (t + PRIOR),    P(nothing) = 1 / 256

so every context is smoothed by the next shorter one, and an unseen context counts as that: the order varies with what was seen. A URL's
score is the mean over its characters (and its end) of ln P(allowed) - ln P(blocked); the threshold is the one with the best balanced
accuracy on labelled URLs that were not trained on. All different URLs that a rule decides are used: 13 of 16 to count, 3 to calibrate.

Everything is built-in expressions. The models hold every string that was seen, in one table by length that is never broadcast whole or sent to
the driver. Written as a back-off model it needs only the longest known string that ends at each character: for that string's last character
the step `d`, and for the next one the back-off `b`, summed over all contexts it ends. So a URL is a sum of lookups, in any order, and sums
are integers (millionths): the same on every cluster. Each different window of the URLs is looked up once, length by length; the windows met
most often are broadcast to the URLs (fewer than `HOT`), the others are joined, so no window is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import running
from .common import freeze, passing

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 5
PRIOR = 2.0
HOT = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a URL; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def decided(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages with host, path, rule and the rule's verdict. Rules are (verdict, host, path); the longest that fits wins, of equals a block."""
    host, path = host_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ranked]
    first = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return out.withColumns({"rule": first([h + p for _, h, p in ranked]), "ruled": first([v for v, _, _ in ranked])})


def windows(text: Column, order: int) -> Column:
    """Each character of a text and its end, with the `order` characters before it."""
    padded = F.concat(F.lit(_START * order), text, F.lit(_END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))


def address(url: Column) -> Column:
    """What the models read: the URL after ://, or all of it where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url), F.lit(""))


def labelled(ruled: DataFrame) -> DataFrame:
    """All different URLs that rules allow or block: text, good (1 or 0) and fit (13 of 16 are, by md5)."""
    text = ruled.where("ruled is not null").select(address(F.col("url")).alias("text"), (F.col("ruled") == "allow").cast("int").alias("good")).distinct()
    return text.withColumn("fit", ~F.substring(F.md5(F.col("text").cast("binary")), 1, 1).isin("0", "1", "2"))


def most_frequent(counts: DataFrame, grams: int) -> DataFrame:
    """The `grams` rows (s, y, n) of largest y + n, of equals the shorter and then the least s. Only those that reach the last kept count are sorted."""
    total = F.col("y") + F.col("n")
    per = counts.groupBy(total.alias("t")).agg(F.count(F.lit(1)).alias("rows"))
    above = F.coalesce(F.sum("rows").over(Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = per.select("t", above.alias("above")).where(F.col("above") < grams).agg(F.min("t")).scalar()
    return counts.where(total >= least).orderBy(F.desc(total), F.length("s"), "s").limit(grams)


def train(texts: DataFrame, order: int = ORDER, prior: float = PRIOR, grams: int | None = None) -> DataFrame:
    """The model of all texts (text, good) as rows (s, k, d, b), k the length of s, all long but s: of all strings and their contexts, or of the `grams` most frequent
    strings and theirs. The row of the empty string has the step of an unknown character as d; that of `order` start marks the back-off before the first character as b.

    Lengths follow one another: a string needs the next shorter one that ends it and the one that starts it, both unique, so no join has a hot key."""
    seen = texts.select("good", F.explode(windows(F.col("text"), order)).alias("w")).groupBy("w").agg(F.sum("good").cast("long").alias("y"), F.sum(1 - F.col("good")).cast("long").alias("n"))
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substring("w", order + 2 - k, k))).alias("s")
    counts = seen.select(ends, "y", "n").groupBy("s").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    millionths = lambda x: F.floor(x * 1_000_000).cast("long")
    off = lambda c: F.log(F.lit(prior) / (F.coalesce(F.col(c), F.lit(0)) + F.lit(prior)))
    with passing(texts.sparkSession) as keep:
        if grams is not None:
            counts = keep(most_frequent(keep(counts), grams))
        # as a string y and n, null if it is none; as a context the totals ty and tn of what follows, null if nothing does
        none, head = F.lit(None).cast("long"), F.substring("s", F.lit(1), F.length("s") - 1)
        part = lambda *values: F.struct(*(v.alias(c) for v, c in zip(values, ("s", "y", "n", "ty", "tn"), strict=True)))
        parts = counts.select(F.explode(F.array(part(F.col("s"), F.col("y"), F.col("n"), none, none), part(head, none, none, F.col("y"), F.col("n")))).alias("p")).select("p.*")
        nodes = keep(parts.groupBy("s").agg(*(F.sum(c).alias(c) for c in ("y", "n", "ty", "tn"))))
        below = nodes.where("s = ''").select("s", "ty", "tn", millionths(off("ty") - off("tn")).alias("d"), F.lit(0).cast("long").alias("b"))
        levels = [freeze(below)]
        for k in range(1, order + 2):
            below = levels[-1]
            here = nodes.where(F.length("s") == k)
            here = here.join(below.select(F.col("s").alias("_h"), F.col("ty").alias("_ty"), F.col("tn").alias("_tn"), F.col("b").alias("_b")), F.substring("s", 1, k - 1) == F.col("_h"), "left")
            if k > 1:
                end = below.select(F.col("s").alias("_e"), *(F.col(c).alias(f"_{c}") for c in ("py", "pn", "offs")))
                here = here.join(end, F.substring("s", 2, k - 1) == F.col("_e"), "left")
            else:
                here = here.withColumns({"_py": F.lit(1.0) / F.lit(256.0), "_pn": F.lit(1.0) / F.lit(256.0), "_offs": F.array().cast("array<double>")})
            # probabilities after the shorter end's; a context's back-off with those of its ends, from the shortest
            here = here.withColumns({f"p{c}": (F.col(c) + F.lit(prior) * F.col(f"_p{c}")) / (F.col(f"_t{c}") + F.lit(prior)) for c in "yn"})
            here = here.withColumn("own", off("ty") - off("tn"))
            back = F.aggregate(F.coalesce("_offs", F.array().cast("array<double>")), F.col("own"), lambda t, x: t + x)
            levels.append(freeze(here.select(
                "s", "ty", "tn", "py", "pn", F.concat(F.coalesce("_offs", F.array().cast("array<double>")), F.array("own")).alias("offs"),
                F.when(F.col("y").isNotNull(), millionths(F.log("py") - F.log("pn")) - F.col("_b")).alias("d"), F.when(F.col("ty").isNotNull(), millionths(back)).alias("b"),
            )))
    return reduce(DataFrame.unionAll, (t.select("s", F.lit(k).alias("k"), "d", "b") for k, t in enumerate(levels)))


def _value(model: DataFrame, s: str, column: str) -> Column:
    """A long of the model's row for s; 0 if it has none."""
    return F.coalesce(model.where((F.col("k") == len(s)) & (F.col("s") == s)).select(column).scalar(), F.lit(0))


def look_up(asked: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """s, times and step of every different window in asked (s): the step of its longest known end and the back-off of its longest known context.

    Only what a length leaves open goes on to the next shorter one, each end once."""
    with passing(asked.sparkSession) as keep:
        need, met = asked.groupBy("s").agg(F.count(F.lit(1)).alias("times")), {}
        for k in range(order + 1, 0, -1):
            met[k] = keep(need.join(model.where(F.col("k") == k).select("s", "d", "b"), "s", "left"))
            need = met[k].where("d is null or b is null").select(F.substring("s", 2, k - 1).alias("s")).distinct()
        found = met[1].withColumns({"d": F.coalesce("d", _value(model, "", "d")), "b": F.coalesce("b", F.lit(0))})
        for k in range(2, order + 2):
            end = found.select(F.col("s").alias("_e"), F.col("d").alias("_d"), F.col("b").alias("_b"))
            found = met[k].join(end, F.substring("s", 2, k - 1) == F.col("_e"), "left").withColumns({"d": F.coalesce("d", "_d"), "b": F.coalesce("b", "_b")})
        return freeze(found.select("s", "times", (F.col("d") + F.col("b")).alias("step")))


def mean_steps(rows: DataFrame, text: Column, model: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """rows with `steps`: the floored mean of text's steps in millionths; null where text is null.

    Windows that make up more than one of `hot` are broadcast, fewer than `hot` of them; the others are joined by window, then added up by row number, so nothing is hot.
    """
    keyed = freeze(rows.withColumn("_t", text).withColumn("_rid", F.monotonically_increasing_id()))
    asked = keyed.where("_t is not null").select("_rid", F.explode(windows(F.col("_t"), order)).alias("s"))
    steps = look_up(asked.select("s"), model, order)
    often = F.col("times") * F.lit(hot) > F.coalesce(steps.agg(F.sum("times")).scalar(), F.lit(0))
    top, rest = F.broadcast(steps.where(often).select("s", "step")), steps.where(~often).select("s", "step")
    each = asked.join(top, "s").select("_rid", "step").unionAll(asked.join(top.select("s"), "s", "left_anti").join(rest, "s").select("_rid", "step"))
    mean = F.floor((F.sum("step") + _value(model, _START * order, "b")) / F.count("step")).cast("long")
    return keyed.join(freeze(each.groupBy("_rid").agg(mean.alias("steps"))), "_rid", "left").select(*rows.columns, "steps")


def threshold(scored: DataFrame) -> Column:
    """The score with the best balanced accuracy over scored rows (good, steps) if texts from it on are accepted; of equals the least.

    Summed per score, and running sums are taken slice by slice."""
    per = running(scored, [], ["steps"], {"y": F.col("good"), "n": 1 - F.col("good")})
    kept = F.col("y_all") - F.col("y_before")
    # both shares over one denominator, so that equal accuracies are equal numbers; decimals, as the product of counts may pass 64 bits
    wide = lambda c: F.greatest(c, F.lit(0)).cast("decimal(19,0)")
    quality = wide(kept) * wide(F.greatest("n_all", F.lit(1))) + wide(F.col("n_before")) * wide(F.greatest("y_all", F.lit(1)))
    best = per.agg(F.min(F.struct((-quality).alias("q"), "steps")).alias("best")).select("best.steps")
    return F.coalesce(best.scalar(), F.lit(0))


def judge(pages: DataFrame, rules: tuple = RULES, order: int = ORDER, prior: float = PRIOR, grams: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every row of pages (page_id, url).

    score is null where a rule decides. The models are fitted on all labelled URLs and hold all their strings, or the `grams` most frequent ones if that is given;
    every URL is judged whole. A null or empty URL that no rule fits has nothing to be accepted for and is blocked. If the rules
    decide nothing, or only one way, there are no two models: what no rule decides is allowed. Repeated rows are answered one by one.
    """
    ruled = decided(pages.select("page_id", "url"), rules)
    texts = freeze(labelled(ruled))
    both = texts.where("fit").select("good").distinct().count() == 2
    if not both:
        verdict = F.coalesce("ruled", F.when(F.coalesce("url", F.lit("")) == "", "block").otherwise("allow"))
        return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"))
    model = train(texts.where("fit").select("text", "good"), order, prior, grams)
    free = F.when(F.col("ruled").isNull() & (F.coalesce("url", F.lit("")) != ""), address(F.col("url")))
    columns = ["page_id", "host", "path", "rule", "ruled"]
    pages_, held = ruled.select(*columns, F.lit(None).cast("int").alias("good"), free.alias("text")), texts.where("not fit").select("good", "text")
    scored = mean_steps(pages_.unionByName(held, allowMissingColumns=True), F.col("text"), model, order)
    least = threshold(scored.where("good is not null").select("good", "steps"))
    verdict = F.when(F.col("steps") >= least, "allow").otherwise("block")
    return scored.where("good is null").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", verdict).alias("verdict"), (F.col("steps") / F.lit(1e6)).alias("score"), (least / F.lit(1e6)).alias("threshold")
    )


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
