"""URL filter: block / allow rules first, gradient-boosted trees for the rest.

The trees see lexical features only: lengths, path depth, digit ratio, character
entropy, parameter counts, and statistics of the host's suffix over all pages.
The labelled URLs are those that a rule decides.  A suffix has one label more
than the rule host that fits (two labels if none does), so it is below what the
rules name, and a labelled URL sees the block rate of the *other* hosts' labelled
URLs of its suffix only: neither its own label nor its host's is in its features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import ascii_lower, cut, lookup, written

TRAIN_ROWS = 20_000   # labelled URLs that the trees are fitted on at most
TREES = 15
DEPTH = 4
SMOOTHING = 20.0      # labelled URLs that a suffix's rate is pulled to the mean by
FOLDS = 5             # parts of the hosts; a labelled URL's suffix rate is that of the other parts


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, then ``/`` and the beginning of a path."""
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"),
         Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The last labels of ``host``, one more than the longest rule host that fits has (at least two)."""
    labels = F.lit(1)
    for r in sorted({r.host for r in rules}, key=lambda h: h.count(".")):
        labels = F.when((host == r) | host.endswith("." + r), r.count(".") + 1).otherwise(labels)
    return F.call_function("substring_index", host, F.lit("."), -(labels + 1))


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of ``text``."""
    n = F.length(text)
    share = F.transform(F.array_distinct(F.split(text, "")),
                        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(
        F.aggregate(share, F.lit(0.0), lambda s, p: F.when(p > 0, s - p * F.log2(p)).otherwise(s)))


LEXICAL = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens",
           "entropy", "host_entropy", "params", "query_length", "has_fragment", "secure")
SUFFIX = ("suffix_log_pages", "suffix_block_rate")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    n = F.length(url)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return {
        "url_length": n.cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "depth": _count(path, "/"),
        "host_labels": _count(host, ".") + 1.0, "digit_ratio": digits / F.greatest(n, F.lit(1)),
        "hyphens": _count(host, "-"), "entropy": _entropy(url), "host_entropy": _entropy(host),
        "params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0),
        "query_length": F.length(query).cast("double"),
        "has_fragment": (F.instr(url, "#") > 0).cast("double"),
        "secure": F.lower(F.substr(url, F.lit(1), F.lit(8))).eqNullSafe("https://").cast("double"),
    }


def with_suffix_statistics(base: DataFrame) -> tuple[DataFrame | None, int, int]:
    """``base(host, suffix, part, verdict, ...)`` with the ``SUFFIX`` columns, the
    number of labelled URLs and that of blocked ones; no table if they are of one
    verdict.  A labelled URL's rate is that of the other parts of its suffix."""
    blocked = (F.col("verdict") == "block").cast("int")
    labelled = F.col("verdict").isNotNull().cast("int")
    counts = base.groupBy("suffix", "part").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(labelled).alias("n"), F.coalesce(F.sum(blocked), F.lit(0)).alias("bad"))
    suffix = cut(counts.groupBy("suffix").agg(
        F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        *[F.coalesce(F.sum(F.when(F.col("part") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
          for c in ("n", "bad") for k in range(FOLDS)]))
    total = suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = total["n"] or 0, total["bad"] or 0
    if n == 0 or bad in (0, n):
        return None, n, bad
    rate = lambda bad_, n_: (bad_ + SMOOTHING * bad / n) / (n_ + SMOOTHING)
    stats = suffix.select(
        "suffix", F.log1p("pages").alias(SUFFIX[0]), rate(F.col("bad"), F.col("n")).alias("_all"),
        F.array(*[rate(F.col("bad") - F.col(f"bad{k}"), F.col("n") - F.col(f"n{k}")) for k in range(FOLDS)]).alias("_others"))
    rows = lookup(base, "suffix", stats)
    return rows.withColumn(SUFFIX[1], F.when(F.col("verdict").isNull(), F.col("_all")).otherwise(
        F.get("_others", F.col("part")))).drop("_all", "_others"), n, bad


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` for every row of
    ``pages(page_id, url, ...)``.

    The longest rule that fits decides; otherwise the trees do, ``block`` at a
    probability over one half.  The trees learn from at most ``train_rows``
    URLs that a rule decides, chosen by the hash of the URL; if these are of one
    verdict, that verdict stands for the rest, and without any the rest is
    allowed (p_block null in both cases).  A null url is an empty one: host and
    path empty, judged by the trees.  Null or repeated page_ids stay row by
    row; other columns are ignored; no rows give no rows."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    base = pages.select("page_id", url.alias("url")).withColumns({"host": host, "path": path})
    judged = base.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    base = written(judged.select("page_id", "url", "host", "path", "fit.rule", "fit.verdict")
                   .withColumns({"suffix": suffix_of(F.col("host"), rules),
                                 "part": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")}), "urls")
    rows, n, bad = with_suffix_statistics(base)
    if rows is None:
        rest = "block" if n and bad else "allow"
        return base.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(rest)).alias("verdict"),
                           F.lit(None).cast("double").alias("p_block"))
    rows = rows.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))
    vectors = VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="_features").transform(rows)
    train = (vectors.where("verdict is not null").withColumn("_label", (F.col("verdict") == "block").cast("double"))
             .orderBy(F.xxhash64("url"), "page_id").limit(train_rows).select("_features", "_label"))
    train = cut(train.repartition(4))
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, seed=7,
                          predictionCol="_llm_prediction")
    trees = trees.setRawPredictionCol("_llm_raw").setProbabilityCol("_llm_p").fit(train)
    scored = trees.transform(vectors).withColumn("p_block", vector_to_array("_llm_p")[1])
    own = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "p_block")
