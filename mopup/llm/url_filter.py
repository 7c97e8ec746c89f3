"""URL filters: allow and block rules first, then a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a rule is a host, then a path prefix from its first slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
#: Rows that the model is trained on at most (of each verdict half as many).
MAX_TRAINING_ROWS = 4000
FEATURES = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"(?s)^([^?#]*)", 1)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host; empty for a null url or one without ``://``."""
    return F.coalesce(F.translate(F.substring_index(_rest(url), "/", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.coalesce(F.substr(rest, F.length(F.substring_index(rest, "/", 1)) + 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a domain above it and starts the path; else null."""
    hit = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        hit = F.when(fits, F.lit(rule)).otherwise(hit)
    return hit


def _ngrams(text: Column, mark: str, sizes=(2, 3, 4)) -> Column:
    """Distinct character n-grams of a marked text.  The list grows with the text only."""
    text = F.concat(F.lit(f"{mark}^"), text, F.lit("$"))
    def run_of(n: int):
        return lambda i: F.substr(text, i, F.lit(n))

    out = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), run_of(n)) for n in sizes]
    return F.array_distinct(F.concat(*out))


def _features(urls: DataFrame, host: str, path: str, out: str) -> DataFrame:
    # digits stand for any number: page counters carry no verdict
    shape = F.regexp_replace(F.col(path), "[0-9]+", "0")
    grams = F.concat(F.transform(_ngrams(F.col(host), "h"), lambda g: F.concat(F.lit("h"), g)),
                     F.transform(_ngrams(shape, "p"), lambda g: F.concat(F.lit("p"), g)))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__mopup_grams", outputCol=out).transform(
        urls.withColumn("__mopup_grams", grams)).drop("__mopup_grams")


def training_sample(labelled: DataFrame, host: str, path: str, verdict: str,
                    max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``max_rows`` distinct labelled urls, half of each verdict, by hash."""
    half = max_rows // 2
    kinds = labelled.select(host, path, verdict).dropDuplicates()
    key = F.xxhash64(F.col(host), F.col(path))
    picks = [kinds.filter(F.col(verdict) == v).orderBy(key, host, path).limit(half) for v in ("allow", "block")]
    return picks[0].unionByName(picks[1])


def train(sample: DataFrame, host: str, path: str, verdict: str) -> LogisticRegressionModel | None:
    """P(block).  None without rows of both verdicts: then nothing is blocked by the model."""
    rows = _features(sample.withColumn("label", (F.col(verdict) == "block").cast("double")), host, path, "features")
    rows = rows.select("label", "features").coalesce(2).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(maxIter=40, regParam=0.01, standardization=False).fit(rows)
    finally:
        rows.unpersist()


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                labelled: DataFrame | None = None, max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, p_block) for each row of ``pages``.

    ``labelled`` (host, path, verdict) trains the model; without it, the urls that a rule
    decides are the labels.  The rule's verdict stands wherever a rule fits; else the model
    blocks from P(block) >= 0.5.  A null url and one without ``://`` have an empty host and
    path, fit no rule, and are judged by the model on these.  Where the labels hold only
    one verdict, the model gives way to ``allow`` with a null ``p_block``.  Repeated rows are
    judged alike, other columns are not read, an empty table gives an empty table.  The
    pages are not shuffled; only the bounded training sample is."""
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    judged = judged.withColumn("verdict", by_rule)
    known = labelled if labelled is not None else judged.filter(F.col("rule").isNotNull())
    model = train(training_sample(known, "host", "path", "verdict", max_training_rows), "host", "path", "verdict")
    if model is None:
        return judged.withColumns({"verdict": F.coalesce("verdict", F.lit("allow")),
                                   "p_block": F.lit(None).cast("double")})
    model.setFeaturesCol("__mopup_features").setProbabilityCol("__mopup_p")
    model.setRawPredictionCol("").setPredictionCol("")
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(_features(judged, "host", "path", "__mopup_features"))
    p = vector_to_array(F.col("__mopup_p"))[1]
    return scored.withColumn("p_block", p).select(
        id_col, "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
