"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs. DataFrame functions and Spark's own tree learner only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut, others

#: Labelled URLs that training reads at most, those of the lowest URL hash.
MAX_TRAIN = 20_000
#: Most rules that `judge_urls` compiles into one expression.
MAX_RULES = 1_000
#: Parts of the labelled URLs; a URL's label rates are those of the other parts, so that its own label is not among its features.
FOLDS = 5
#: Labels of the average kind that each rate has besides its own.
SMOOTHING = 20
FEATURES = ["length", "depth", "digit_ratio", "entropy", "n_params", "host_labels", "hyphens", "suffix_rate", "suffix_rows", "section_rate"]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z in lower case; empty for null or without ://."""
    raw = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of `rules` (like example.net/en/) that fits: its host or a subdomain, and a path that starts with its own. Null if none."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be one expression")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _entropy(s: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    share = lambda c: (F.length(s) - F.length(F.replace(s, c))) / n
    letters = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """`urls` with lexical features; null is as the empty string."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_of(url), path_of(url)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return urls.select(
        "*", F.length(url).cast("double").alias("length"), (F.size(F.split(path, "/")) - 1).cast("double").alias("depth"),
        (digits / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"), _entropy(url).alias("entropy"),
        F.size(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")).cast("double").alias("n_params"),
        F.size(F.split(host, r"\.")).cast("double").alias("host_labels"),
        (F.length(host) - F.length(F.replace(host, F.lit("-")))).cast("double").alias("hyphens"),
        F.element_at(F.split(host, r"\."), -1).alias("suffix"),
        F.concat_ws("/", F.element_at(F.split(host, r"\."), -1), F.regexp_extract(path, r"^/([^/]*)", 1)).alias("section"),
    )


class UrlModel:
    """Trees over lexical features and smoothed label rates of host suffixes. `fit` is null-safe and deterministic."""

    def __init__(self, prior: float, suffixes: DataFrame | None, sections: DataFrame | None, trees):
        self.prior, self.suffixes, self.sections, self.trees = prior, suffixes, sections, trees

    @classmethod
    def fit(cls, labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_train: int = MAX_TRAIN, seed: int = 17) -> UrlModel:
        """Learn from rows with a 0/1 label (1: block). At most `max_train` rows are read, by URL hash. With one class or no rows the verdict is that class, or allow."""
        rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"))
        rows = cut(lexical(rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_train)))
        n, ones = rows.agg(F.count("*"), F.sum("label")).first()
        if not n or ones in (0, n):
            return cls(ones / n if n else 0.0, None, None, None)
        prior = ones / n
        rows = rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)))
        rated = lambda k, ones, n: (((ones + SMOOTHING * prior) / (n + SMOOTHING)).alias(f"{k}_rate"), F.log1p(n.cast("double")).alias(f"{k}_rows"))
        rate = lambda k: rows.groupBy(k).agg(*rated(k, F.sum("label"), F.count("*")))

        def of_others(found: DataFrame, k: str) -> DataFrame:
            """`found` with the rates of column `k` over the folds that a row is not in."""
            own = rows.groupBy(k, "fold").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
            every = rows.groupBy(k).agg(F.sum("label").alias("all_ones"), F.count("*").alias("all_n"))
            return found.join(own, [k, "fold"]).join(every, k).select(*found.columns, *rated(k, F.col("all_ones") - F.col("ones"), F.col("all_n") - F.col("n")))

        model = cls(prior, rate("suffix"), rate("section").drop("section_rows"), None)
        training = of_others(of_others(rows, "suffix"), "section").drop("section_rows", "fold")
        gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.2, seed=seed)
        model.trees = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), gbt]).fit(training)
        return model

    def _known(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.suffixes, "suffix", "left").join(self.sections, "section", "left").fillna({"suffix_rate": self.prior, "suffix_rows": 0.0, "section_rate": self.prior})

    def predict(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """`urls` with p_block, the probability of label 1."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(float(self.prior)))
        own = F.struct(*[F.col(c) for c in urls.columns]).alias("_row")
        scored = self.trees.transform(self._known(lexical(urls.select(own, F.col(url_col).alias("_url")), "_url")))
        return scored.select("_row.*", vector_to_array("probability")[1].alias("p_block"))


def judge_urls(urls: DataFrame, rules: dict[str, str], url_col: str = "url", model: UrlModel | None = None) -> DataFrame:
    """`urls` with host, path, rule, p_block and verdict (block or allow).

    A rule's verdict holds where one fits; else the model's: block from p_block 0.5 on. Without a model, one is fitted to
    the URLs that the rules label. Null URLs: empty host and path, no rule, judged by the model as an empty string. Repeated rows are judged alike; an empty table gives an empty one. Columns of the results' names,
    in any case, are replaced, all others stay.
    """
    urls = urls.select(*[F.col(f"`{c}`") for c in others(urls.columns, ("host", "path", "rule", "p_block", "verdict"), (url_col,))])
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parsed = urls.select("*", host.alias("host"), path.alias("path"))
    parsed = parsed.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("rule"))
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    if model is None:
        model = UrlModel.fit(parsed.select(F.col(url_col).alias("url"), (ruled == "block").cast("int").alias("label")))
    return model.predict(parsed, url_col).select("*", F.coalesce(ruled, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"))
