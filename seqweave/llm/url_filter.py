"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for the rest, in DataFrame and ML operations only."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_names, sent, written

#: Lengths of n-grams, features that they are hashed to, strength of the penalty, and the score from which on a URL is blocked.
GRAMS, FEATURES, PENALTY, CUT = (3, 4, 5), 1 << 15, 0.0002, 0.5
#: Rules up to which they are one expression; more are joined. Rows of labelled URLs that fit() learns from at most, about.
FEW_RULES, FIT_ROWS = 64, 100_000

#: Parts of names of unwanted sites: gambling, pills, adult, advertising and tracking, spam, pirated and fraudulent goods.
UNWANTED = (
    "casino poker bet bets betting slots jackpot roulette lottery gamble win winner bingo pills viagra cialis pharmacy meds drugs dose diet adult porn xxx sex nude cam cams escort dating hookup "
    "ads ad adserver banner click clicks popup track tracker tracking pixel affiliate promo spam spammy farm linkfarm seo backlinks cheap free discount replica warez crack keygen torrent cracked loan loans payday credit scam phish malware prize gift "
    "money rich crypto forex bonus"
).split()
#: Parts of names of ordinary sites.
ORDINARY = (
    "news press times journal library museum archive school college university science physics math history art music garden kitchen recipe recipes travel weather river forest mountain city town village council health clinic hospital doctor "
    "book books author reader blog notes diary forum wiki docs guide manual help support code open data map maps photo photos film cinema theatre sport football cycling train transport bank shop store market home family kids teacher student "
    "winter window freedom tracking-parcel addition adventure advice bettys essex middlesex classics"
).split()
#: Syllables of made-up names, which ordinary sites have, too.
SYLLABLES = "ba be bo ca co da de di fa fi ga go ha he in is ka la le li lo ma me mi mo na ne no on or pa pe ra re ri ro sa se si so ta te th ti to un va ve vi wa za er an ing tion ther ble ly st sh ou".split()
#: Paths of either kind.
ORDINARY_PATHS = "about news article 2021/05 index.html en de fr es contact docs/intro page products help faq post".split()
UNWANTED_PATHS = "win-now bonus free-spins buy-cheap click track?id adult xxx promo offer".split()


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path begins with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without a host's place."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# --- rules ------------------------------------------------------------------------------------------------------------


def _in_order(rules: Iterable[Rule]) -> list[Rule]:
    """The longest first, of equal lengths the one of the longer host; of one text, block wins."""
    best: dict[str, Rule] = {}
    for r in rules:
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"{r.text}: allow or block, not {r.verdict}")
        if r.text not in best or r.verdict == "block":
            best[r.text] = r
    return sorted(best.values(), key=lambda r: (-len(r.text), -len(r.host)))


def _by_expression(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the first rule that fits, or null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, found) of the rows (row, host, path) that a rule fits: each host's suffixes with the path's beginnings of all lengths that rules have meet the rules' texts."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # lengths of paths
    label = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    rows = rows.where("host <> ''").select("row", "path", F.explode(suffix).alias("suffix"))
    begin = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull())
    keys = rows.select("row", "suffix", F.explode(begin).alias("begin"))
    found = keys.join(sent(rules.select(F.col("host").alias("suffix"), F.col("path").alias("begin"), "verdict")), ["suffix", "begin"])
    rule = F.struct(F.concat("suffix", "begin").alias("rule"), "verdict")
    return found.groupBy("row").agg(F.max_by(rule, F.struct(F.length(F.concat("suffix", "begin")), F.length("suffix"))).alias("found"))


# --- model ------------------------------------------------------------------------------------------------------------


def labelled_urls(spark: SparkSession, rows: int = 6000, seed: int = 29) -> DataFrame:
    """A small table (url, label: 1 unwanted, 0 ordinary) put together from words by rule. Stands in for URLs that people have labelled; fit() takes those in its place."""
    ids = spark.range(rows, numPartitions=1)
    pick = lambda k, options: F.element_at(F.array(*(F.lit(x) for x in options)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    some = lambda k: F.concat(pick(k + "1", SYLLABLES), pick(k + "2", SYLLABLES), pick(k + "3", [*SYLLABLES, ""]))
    bad = F.col("id") % 3 == 0
    form = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("form")), F.lit(4))
    sign = pick("sign", ["-", "", "-", "."])
    unwanted = F.concat(pick("a", UNWANTED), sign, F.when(form < 2, pick("b", UNWANTED)).when(form == 2, some("s")).otherwise(pick("c", ORDINARY)))
    ordinary = F.when(form == 0, F.concat(pick("d", ORDINARY), sign, pick("e", ORDINARY))).when(form == 1, F.concat(some("s"), sign, pick("e", ORDINARY))).otherwise(F.concat(some("s"), pick("j", ["", "-", ""]), pick("t", [*SYLLABLES, ""])))
    host = F.concat(pick("p", ["", "www.", "m.", "blog.", "cdn.", ""]), F.when(bad, unwanted).otherwise(ordinary), pick("tld", [".com", ".org", ".net", ".example.com", ".example.org", ".example.net", ".de", ".fr", ".co.uk"]))
    path = F.when(bad & (form == 0), pick("q", UNWANTED_PATHS)).otherwise(pick("r", ORDINARY_PATHS))
    number = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("number")), F.lit(10_000)).cast("string")
    return ids.select(F.concat(pick("z", ["http://", "https://"]), host, F.lit("/"), path, F.lit("/"), number, pick("n", ["", "/", ".html"])).alias("url"), bad.cast("int").alias("label"))


def _grams(host: Column, path: Column) -> Column:
    """The n-grams of host and path, told apart by a letter before; dots and marks at both ends tell where words begin, and all digits are alike."""
    alike = lambda c: F.translate(c, "123456789", "000000000")
    marked = [("h", F.concat(F.lit("."), alike(host), F.lit("."))), ("p", F.concat(alike(F.lower(path)), F.lit("/")))]
    own = lambda kind, c, n: F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda x: F.concat(F.lit(kind), x))
    return F.flatten(F.array(*(own(kind, c, n) for kind, c in marked for n in GRAMS)))


def _hashed(df: DataFrame, host: Column, path: Column, grams: str, out: str) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol=grams, outputCol=out).transform(df.withColumn(grams, _grams(host, path)))


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> LogisticRegressionModel:
    """Learns from labelled URLs (url, label 0 or 1), about `rows` of them at most; rows without a host or a label aren't learnt from."""
    known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")).where("host <> '' and label is not null")
    known = written(known, "urls")
    share = min(1.0, rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("host", "path"), F.lit(1_000_000)) < int(share * 1_000_000))
    table = written(_hashed(known, F.col("host"), F.col("path"), "grams", "features").select("features", "label"), "features")
    return LogisticRegression(regParam=PENALTY, maxIter=60, standardization=False).fit(table)


# --- filter -----------------------------------------------------------------------------------------------------------


def _marked(pages: DataFrame, rules: Iterable[Rule] | DataFrame, model: LogisticRegressionModel, url_col: str, cut: float) -> tuple[DataFrame, list[str]]:
    """pages with columns of host, path, rule, score and verdict, and what these are called."""
    host, path, rule, score, verdict, grams, features, found, row, raw, chance, predicted = free_names(pages, "host", "path", "rule", "score", "verdict", "grams", "features", "found", "row", "raw", "chance", "predicted")
    out = pages.withColumn(host, host_of(F.col(url_col))).withColumn(path, path_of(F.col(url_col)))
    if isinstance(rules, DataFrame):
        some = rules.select("verdict", "host", F.coalesce("path", F.lit("/")).alias("path")).where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        some = written(some, "rules")
        few = [Rule(**r.asDict()) for r in some.limit(FEW_RULES + 1).collect()]
    else:
        few = _in_order(rules)
        some = pages.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in few], "verdict string, host string, path string") if len(few) > FEW_RULES else None
    if len(few) <= FEW_RULES:
        out = out.withColumn(found, _by_expression(F.col(host), F.col(path), _in_order(few)))
    else:
        out = written(out.withColumn(row, F.monotonically_increasing_id()), "pages")
        hits = _by_join(out.select(F.col(row).alias("row"), F.col(host).alias("host"), F.col(path).alias("path")), some)
        out = out.join(hits.select(F.col("row").alias(row), F.col("found").alias(found)), row, "left")
    out = _hashed(out, F.col(host), F.col(path), grams, features)
    model = model.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(predicted)
    out = model.transform(out).withColumn(score, F.round(vector_to_array(chance)[1], 6)).withColumn(rule, F.col(found)["rule"])
    out = out.withColumn(verdict, F.coalesce(F.col(found)["verdict"], F.when(F.col(score) >= cut, "block").otherwise("allow")))
    return out, [host, path, rule, score, verdict]


def judged(pages: DataFrame, rules: Iterable[Rule] | DataFrame, model: LogisticRegressionModel, url_col: str = "url", cut: float = CUT) -> DataFrame:
    """pages, all columns, and url_host, url_path, url_rule, url_score, url_verdict (columns of these names are replaced): one row for each row.

    rules: Rule objects, or a table (verdict, host, path) of any size. A rule fits its host and all subdomains if the
    path begins with the rule's; the longest wins (of equal lengths, that of the longer host; of equal rules, block). Where none fits, a score of cut or more blocks.
    A null url, or one without ://, has an empty host and path, which no rule with a host fits. Rows that repeat are judged
    each; an empty table gives an empty result. Few rules are one expression, so nothing is shuffled; more are joined.
    """
    new = ["url_host", "url_path", "url_rule", "url_score", "url_verdict"]
    out, own = _marked(pages, rules, model, url_col, cut)
    return out.select(*(c for c in pages.columns if c.lower() not in new), *(F.col(a).alias(b) for a, b in zip(own, new, strict=True)))


def allowed(pages: DataFrame, rules: Iterable[Rule] | DataFrame, model: LogisticRegressionModel, url_col: str = "url", cut: float = CUT) -> DataFrame:
    """The rows of pages whose url is allowed, with their columns."""
    out, own = _marked(pages, rules, model, url_col, cut)
    return out.where(F.col(own[-1]) == "allow").select(pages.columns)
