"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for what no rule covers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words that commonly occur in the host names of unwanted sites: they label URLs where no labels are at hand.
UNWANTED_WORDS = (
    "ads", "adult", "bet", "bets", "bonus", "casino", "cheap", "dating", "farm", "free", "gambling", "loan", "lottery",
    "pharma", "pills", "poker", "porn", "prize", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of the labelled URLs; a row's suffix rate comes from the other parts.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, "host/path"), else nulls. A rule fits its host and all
    subdomains where the path begins as the rule's does. rules is a list that people keep, hence one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of the text's distinct characters."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(letters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def _share(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1))


FEATURES = {
    "url_length": lambda u, h, p: F.length(u),
    "host_length": lambda u, h, p: F.length(h),
    "path_length": lambda u, h, p: F.length(p),
    "depth": lambda u, h, p: F.size(F.filter(F.split(p, "/"), lambda x: x != "")),
    "labels": lambda u, h, p: F.size(F.split(h, r"\.")),
    "longest_label": lambda u, h, p: F.array_max(F.transform(F.split(h, r"\."), F.length)),
    "host_digits": lambda u, h, p: _share(h, "0123456789"),
    "url_digits": lambda u, h, p: _share(u, "0123456789"),
    "host_hyphens": lambda u, h, p: F.length(h) - F.length(F.translate(h, "-", "")),
    "host_vowels": lambda u, h, p: _share(h, "aeiou"),
    "host_entropy": lambda u, h, p: _entropy(h),
    "path_entropy": lambda u, h, p: _entropy(p),
    "parameters": lambda u, h, p: F.when(F.instr(u, "?") > 0, 1 + F.length(u) - F.length(F.translate(u, "&", ""))).otherwise(0),
    "fragment": lambda u, h, p: F.instr(u, "#") > 0,
    "secure": lambda u, h, p: F.startswith(u, F.lit("https:")),
    "escapes": lambda u, h, p: _share(u, "%@=_~"),
}


def lexical(urls: DataFrame) -> DataFrame:
    """urls (with url, host, path) plus a column for each of FEATURES, and suffix: the last two labels of the host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    made = {k: f(url, F.col("host"), F.col("path")).cast("double").alias(k) for k, f in FEATURES.items()}
    return urls.select("*", *made.values(), F.substring_index("host", ".", -2).alias("suffix"))


def weak_labels(urls: DataFrame) -> DataFrame:
    """(url, host, path, label): 1 where a word of the host is among UNWANTED_WORDS, else 0."""
    words = F.split("host", r"[^a-z]+")
    return urls.select("url", "host", "path", F.arrays_overlap(words, F.array(*map(F.lit, UNWANTED_WORDS))).cast("double").alias("label"))


class UrlModel:
    """Trees, and the rate of label 1 by suffix with the overall rate for others."""

    def __init__(self, trees: PipelineModel, suffixes: DataFrame, base: float):
        self.trees, self.suffixes, self.base = trees, suffixes, base

    def score(self, urls: DataFrame) -> DataFrame:
        """urls (with url, host, path) plus unwanted, from 0 to 1. The suffixes are those of a bounded sample, so at most
        as many as it has rows."""
        made = lexical(urls).join(F.broadcast(self.suffixes), "suffix", "left").fillna(self.base, ["suffix_rate"])
        scored = made if self.trees is None else self.trees.transform(made)
        unwanted = F.lit(self.base) if self.trees is None else vector_to_array("probability")[1]
        return scored.select(*[f"`{c}`" for c in urls.columns], unwanted.alias("unwanted"))


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 4) -> UrlModel:
    """Fits trees to labelled URLs (url, host, path, label 0 or 1).

    At most `sample` URLs of each label are used, the first in the order of a hash, so that a rare label is not lost.
    With no rows, or one label only, the model gives the overall rate to all. Suffix rates are drawn towards the
    overall rate by 20 rows' weight; a row that trains the trees has its suffix's rate over the FOLDS - 1 folds that it
    is not in, as its own label must not reach its features.
    """
    order = [F.xxhash64("url"), "url"]
    rare, rest = (labelled.where(F.col("label") == x).orderBy(*order).limit(sample) for x in (1, 0))
    chosen = stored(rare.unionByName(rest).coalesce(2))
    base, n, kinds = chosen.agg(F.coalesce(F.avg("label"), F.lit(0.0)), F.count("*"), F.count_distinct("label")).first()
    with_suffix = lexical(chosen).withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))
    counts = stored(with_suffix.groupBy("suffix", "fold").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).coalesce(1))
    totals = counts.groupBy("suffix").agg(F.sum("ones").alias("all_ones"), F.sum("n").alias("all_n"))
    rate = lambda ones, n: ((ones + 20 * base) / (n + 20)).alias("suffix_rate")
    suffixes = stored(totals.select("suffix", rate(F.col("all_ones"), F.col("all_n"))).coalesce(1))
    if kinds < 2:
        return UrlModel(None, suffixes, base)
    columns = [*FEATURES, "suffix_rate"]
    unseen = counts.join(totals, "suffix").select("suffix", "fold", rate(F.col("all_ones") - F.col("ones"), F.col("all_n") - F.col("n")))
    rows = with_suffix.join(F.broadcast(unseen), ["suffix", "fold"]).select(*columns, "label")
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    ready = assembler.transform(rows).select("features", "label").coalesce(2).persist()
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(ready)
    ready.unpersist()
    return UrlModel(PipelineModel([assembler, fitted]), suffixes, base)


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """One row (id, host, path, rule, verdict, unwanted) for each row of pages (id, url).

    The longest fitting rule decides; without one, block if the model's score is `threshold` or more. Null URLs and
    those without `://` have empty host and path and are left to the model. Repeated rows each get a row; other
    columns are ignored; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col), F.col("url").cast("string").alias("url")).select("*", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("unwanted") >= threshold, "block").otherwise("allow")
    return model.score(urls).select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "unwanted")
