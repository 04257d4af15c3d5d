"""URL verdicts: rules first, then gradient-boosted trees on lexical features that learn from the urls that rules decide."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.cuts import checked, cut

#: Labelled urls that the trees are trained on, at most (taken by a hash of the url).
TRAINING_ROWS = 20_000
ROUNDS, DEPTH = 12, 4
#: Weight of the overall block rate in a suffix's rate, in urls.
PRIOR = 20
#: Parts of the labelled urls, by a hash: an url's rates leave out its own part, and the first part never trains the trees.
FOLDS = 5

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: tuple[tuple[str, str], ...], value) -> Column:
    """``value(verdict, rule)`` of the longest rule that fits ``host`` and ``path``; null where none does. Rules are a short fixed list."""
    out = F
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(slash + rest))
        out = out.when(fits, F.lit(value(verdict, rule)))
    return F.lit(None).cast("string") if out is F else out


def suffixes() -> dict[str, Column]:
    """The suffixes whose block rates are features: the last label and the last two labels of the host, and the path's ending."""
    return {"tld": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "ending": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/|)$", 1)}


def lexical() -> dict[str, Column]:
    """Length, depth, digit ratio, entropy and counts, of columns ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    shares = F.transform(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "labels": F.regexp_count("host", F.lit(r"\.")).cast("double"),
        "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "digits": F.regexp_count(url, F.lit("[0-9]")) / n,
        "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
    }


def held_out(url: Column) -> Column:
    """Whether a labelled url is kept from the trees' training."""
    return _fold(url) == 0


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _rates(labelled: DataFrame, kind: str) -> DataFrame:
    """``<kind>, n, blocked, folds``: labelled urls with each suffix, in all and in each fold."""
    of = lambda f: F.struct(F.count_if(F.col("fold") == f).alias("n"), F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0.0)).alias("blocked"))
    return labelled.groupBy(kind).agg(F.count("label").alias("n"), F.sum("label").alias("blocked"), F.array(*map(of, range(FOLDS))).alias("folds"))


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every url.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; the longest one decides.
    The urls that rules decide are the labelled ones: at most ``TRAINING_ROWS`` of them, chosen by a hash, train the
    trees, which judge the others by lexical features and by the block rates of their suffixes among the labelled urls. A labelled url's rates leave out the
    part of the labelled urls that it belongs to, so that no feature holds its own label; ``held_out`` names those that never train, so their
    ``block_score`` shows what the trees make of urls they have not seen. Each kind of suffix is joined by itself: broadcast if its suffixes are
    few, else by a shuffle. Where rules decide nothing, the rest is allowed; where they all say the same, so does the rest.

    Null urls, and those without ``://``, have an empty host and path and are judged by the trees. Every row
    is judged by itself, so repeated ids and urls keep their rows, and urls of any length are read whole. No rows give no rows. Other columns,
    also ones named like those made here, are left out.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    urls = urls.withColumns({"rule": ruled(rules, lambda verdict, rule: rule), "ruled": ruled(rules, lambda verdict, rule: verdict)} | suffixes())
    urls = urls.withColumn("fold", F.when(F.col("ruled").isNotNull(), _fold(F.col("url"))))
    labelled = urls.filter("ruled IS NOT NULL").select("url", "host", "path", *suffixes(), "fold", (F.col("ruled") == "block").cast("double").alias("label"))
    n, blocked, n_training = labelled.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0)), F.count_if(F.col("fold") > 0)).first()
    judged = urls.select("page_id", "host", "path", "rule", "ruled", "url", "fold", *suffixes())
    train = labelled.filter("fold > 0")
    share = min(1.0, TRAINING_ROWS / max(1, n_training))
    train = train.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else train
    n_blocked, n_allowed = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n_blocked or not n_allowed:
        said = "block" if 2 * blocked > n else "allow"
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(said)).alias("verdict"), F.lit(float(said == "block")).alias("block_score"))

    overall = blocked / n
    rates = {k: checked(cut(_rates(labelled, k))) for k in suffixes()}

    def featured(df: DataFrame) -> DataFrame:
        for k, side in rates.items():
            df = df.join(side, k, "left")
            own = F.get("folds", F.col("fold"))
            without = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(own[c], F.lit(0))
            df = df.withColumn(f"{k}_rate", (without("blocked") + overall * PRIOR) / (without("n") + PRIOR)).drop("n", "blocked", "folds")
        return df.withColumns(lexical())

    names = [*lexical(), *(f"{k}_rate" for k in suffixes())]
    into = VectorAssembler(inputCols=names, outputCol="features")
    training = cut(featured(train).select("label", *names))
    model = GBTClassifier(labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=17, checkpointInterval=-1, cacheNodeIds=False).fit(into.transform(training).select("label", "features"))
    model = model.setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(into.transform(featured(judged)))
    chance = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"), chance.alias("block_score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
