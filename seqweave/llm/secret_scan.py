"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame and ML operations only."""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import written

#: Names whose values are candidates whatever they look like, and what may stand between a name and its value.
_NAME = r"(?i:passwords?|passwd|passphrase|passcode|pwd|pass|secrets?|secret_key|token|apikey|api[_-]key|key|auth|authorization|bearer|credentials?|private|access)"
_TO = r"[\"'`\]*]{0,2}\s{0,3}(?:=>|:=|[:=]{1,3})\s{0,3}"
#: Characters of a bare value, the first (no sign of assignment) and the last (no full stop and no colon, which end a sentence or a part of one).
_BARE, _FIRST, _LAST = r"[^\s\"'`,;&<>()\[\]{}]", r"[^\s\"'`,;&<>()\[\]{}:=]", r"[^\s\"'`,;&<>()\[\]{}.:]"
#: Characters of what follows Bearer or Basic; it has a digit, an equals sign, a capital behind a small letter, or 16 characters.
_TOKEN = r"[A-Za-z0-9._~+/-]"
#: What a candidate is, at each place the first of: the path of a Slack webhook; a token of dotted parts behind its issuer's
#: prefix; a quoted or bare value of a secret's name; what follows Bearer or Basic; password or user of a URL; 16 or more
#: characters of keys in a row, not inside a longer word (a part of a path or a dotted name counts for itself).
#: The forest rejects; the pattern leaves out only what has no such shape.
CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:(?<=hooks\.slack\.com/services/)[A-Za-z0-9/_-]++"
    r"|(?<![A-Za-z0-9])(?:eyJ[A-Za-z0-9_-]++|ya29|SG)(?:\.[A-Za-z0-9_-]++){1,8}+"
    + "".join(f"|(?<={q})(?<={_NAME}{_TO}{q})[^{q}\\r\\n]++" for q in ('"', "'", "`"))
    + rf"|(?<=[:=>]|[:=>\srRcC]\s)(?:(?<=[:=>]|[:=>]\s{{1,3}})(?<={_NAME}{_TO})(?!(?i:bearer|basic)\s){_FIRST}(?:{_BARE}*{_LAST})?"
    + rf"|(?<=[rRcC]\s{{1,3}})(?<=(?i:bearer|basic)\s{{1,3}})(?=[A-Za-z._~+/-]*+[0-9]|{_TOKEN}*+=|{_TOKEN}*?[a-z][A-Z]|{_TOKEN}{{16}}){_TOKEN}*[A-Za-z0-9_~+/-]={{0,2}}+)"
    r"|(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/@]++(?=@)|(?<=://)[^\s/:@]++(?=@)"
    r"|(?:(?<![A-Za-z0-9+/_.@-])(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{16,}+|(?<=[.@/])(?=[+_-]*+[A-Za-z0-9])[A-Za-z0-9+_-]{16,}+)={0,2}+)"
)
#: Characters before and after a candidate that features see; a finding counts from this score on; made-up training rows.
CONTEXT, CUT, EXAMPLES = 40, 0.5, 15_000
#: Marks around candidates, of which texts are rid first, and characters of the stretches that a text is cut into to be looked up by place.
_OPEN, _CLOSE, STRETCH = "\x01", "\x02", 4096
#: Elements whose sums are made at a time.
CHUNK = 256
TREES, DEPTH = 24, 7

#: Words that names of keys are followed by, and words of numbers and digests that are no secrets.
SECRET_WORDS = "password passwd pwd pass secret token apikey api_key api-key key auth authorization bearer credential credentials private access client_secret".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum digest hash etag uuid guid id image png jpeg jpg base64 isbn phone tel card iban order invoice version build revision ref example sample placeholder dummy".split()
#: Parts of identifiers and placeholders: they are in every dictionary, beside the corpus's words, and in made-up findings.
IDENTIFIERS = "the and for with this that from have test example sample dummy placeholder your here changeme default user name file path image content index page data value key secret token password string number list item array object class function method request response server client service config version update create delete insert select table column header footer button style script document template component module package release debug error message session cookie account profile address street country company product order price total count result report summary december november october september august july june april march february january monday tuesday wednesday thursday friday saturday sunday".split()
#: Words that a dictionary has at most, the most frequent of the corpus, and the bits of its filter (as a power of 2).
DICTIONARY, FILTER_BITS = 20_000, 19
#: Letters and the rest: rows and columns of the table of transitions.
LETTERS = 27

FEATURES = [
    "length", "digit_share", "upper_share", "lower_share", "sign_share", "hex", "digits_only", "transitions", "letter_digit", "case_change", "longest_run", "distinct_share",
    "dictionary", "vowel_share", "has_slash", "dashes", "after_slash", "after_scheme", "extension", "quoted", "assigned", "secret_word", "harmless_word", "prefix",
    "password_word", "user_info", "dots", "webhook", "blanks", "letter_model", "placeholder", "auth_scheme",
]
#: Beginnings that issuers of keys use.
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abp]-|AIza|ya29|SG\\.|eyJ|npm_|hf_"


@dataclass(frozen=True)
class Language:
    """What a corpus's words are like: a Bloom filter of the frequent ones, the log2 chance of each letter behind another, and some of the words."""

    filter: bytes
    transitions: tuple[float, ...]
    words: tuple[str, ...]


def _bits(word: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(word, F.lit(k)), F.lit(1 << FILTER_BITS)) for k in (1, 2)))


def learn(docs: DataFrame, text_col: str = "text") -> Language:
    """The language of all texts. Words are runs of 3 to 24 ASCII letters, lower-cased; longer runs are cut.

    The transitions are counted over all words as often as they occur, with one added to each. To the driver come a
    filter, a table and some words, whose sizes are fixed. Without any text only IDENTIFIERS are known.
    """
    spark = docs.sparkSession
    counts = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{3,24}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = written(counts, "words")
    common = written(counts.orderBy(F.desc("n"), "word").limit(DICTIONARY), "dictionary")
    known = common.select("word").union(spark.createDataFrame([(x,) for x in IDENTIFIERS], "word string"))
    bit = known.select(F.explode(_bits(F.col("word"))).alias("at"))
    held = bytearray(1 << FILTER_BITS - 3)
    for r in bit.groupBy(F.expr("at div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("bits")).collect():
        held[r["byte"]] = r["bits"]
    code = F.transform(F.split(F.concat(F.lit("{"), "word", F.lit("{")), ""), lambda x: F.ascii(x) - 97)  # { stands behind z
    pair = F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda x, y: x * LETTERS + y)
    table = [1.0] * LETTERS**2
    for r in counts.select(F.explode(pair).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r["pair"]] += r["n"]
    rows = [sum(table[k * LETTERS : (k + 1) * LETTERS]) for k in range(LETTERS)]
    words = tuple(r["word"] for r in common.orderBy(F.xxhash64("word"), "word").limit(200).collect())
    return Language(bytes(held), tuple(round(math.log2(n / rows[k // LETTERS]), 4) for k, n in enumerate(table)), words)


def _sums(x: Column) -> Column:
    """For each number of an array the sum of those before it; in chunks, since an array grows by copying."""
    grown = lambda y: F.aggregate(y, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    chunks = F.transform(F.sequence(F.lit(0), F.expr("int((size(sizes) - 1) div " + str(CHUNK) + ")")), lambda c: grown(F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))
    before = grown(F.transform(chunks, lambda y: F.element_at(y, -1)))
    return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(before) - 1), lambda y, b: F.transform(F.slice(y, F.lit(1), F.size(y) - 1), lambda v: v + b)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, candidate, before, after): every candidate of every text, start in characters from 0.

    One pass of the pattern sets marks around the candidates; the lengths of what lies between marks give the places.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = F.regexp_replace(F.translate("text", _OPEN + _CLOSE, "\x03\x03"), F.lit(CANDIDATE), F.lit(f"{_OPEN}$0{_CLOSE}"))
    found = base.withColumn("parts", F.split(marked, _OPEN))
    found = found.withColumn("sizes", F.transform("parts", lambda x: F.length(x).cast("long"))).withColumn("own", F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))))
    some = F.size("own") > 0
    found = found.withColumn("sums", F.when(some, F.slice(_sums(F.col("sizes")), F.lit(2), F.size("own"))))
    found = found.withColumn("stretches", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))
    # the sum before a part counts the closing marks of the parts before it
    place = F.transform("own", lambda x, k: F.struct((F.get("sums", k) - k).cast("int").alias("start"), (F.instr(x, _CLOSE) - 1).alias("size")))

    def near(x: Column) -> Column:
        first = F.greatest(x["start"] - CONTEXT, F.lit(0))
        low = F.floor(first / STRETCH).cast("int")
        wide = F.array_join(F.slice("stretches", low + 1, F.floor((x["start"] + x["size"] + CONTEXT) / STRETCH).cast("int") - low + 1), "")
        at = x["start"] - low * STRETCH
        return F.struct(x["start"].alias("start"), F.substring(wide, at + 1, x["size"]).alias("candidate"), F.substring(wide, first - low * STRETCH + 1, x["start"] - first).alias("before"), F.substring(wide, at + x["size"] + 1, F.lit(CONTEXT)).alias("after"))

    found = found.select("doc_id", F.explode(F.transform(place, near)).alias("x"))
    return found.select("doc_id", F.col("x.start").cast("long").alias("start"), "x.candidate", "x.before", "x.after")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _covered(c: Column, language: Language) -> Column:
    """Characters of those parts of a candidate (runs of small letters, perhaps behind a capital, or of capitals) that are words of the dictionary."""
    known = F.unbase64(F.lit(base64.b64encode(language.filter).decode()))
    byte = lambda at: F.conv(F.hex(F.substr(known, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = lambda at: F.get(F.array(*(byte(at).bitwiseAND(F.lit(1 << k)) for k in range(8))), (at % 8).cast("int")) > 0
    parts = F.filter(F.transform(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]{2,23}|[A-Z]{3,24}"), F.lit(0)), F.lower), lambda x: F.forall(_bits(x), has))
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(x))


def _letter_model(c: Column, language: Language) -> Column:
    """The mean log2 chance of a candidate's letters, each behind the character before it; -LETTERS of one without letters."""
    table = F.split(F.lit(",".join(map(str, language.transitions))), ",").cast("array<double>")
    code = F.transform(F.split(F.concat(F.lit("{"), F.lower(c), F.lit("{")), ""), lambda x: F.when(x.between("a", "z"), F.ascii(x) - 97).otherwise(LETTERS - 1))
    pair = F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda x, y: x * LETTERS + y)
    pair = F.filter(pair, lambda x: x < LETTERS**2 - 1)
    total = F.aggregate(pair, F.lit(0.0), lambda acc, x: acc + F.get(table, x))
    return F.when(F.size(pair) > 0, total / F.size(pair)).otherwise(F.lit(-float(LETTERS)))


def with_features(found: DataFrame, language: Language) -> DataFrame:
    """found with FEATURES of candidate, before and after."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    tail = lambda words: rf"(?i)(?:^|[^a-z])(?:{'|'.join(words)})[\s\"':=>,(\[{{]*$"
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    longest = lambda pattern: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.length)), F.lit(0))
    return found.withColumns(
        {
            "length": F.log1p(n),
            "digit_share": _count(c, "[0-9]") / n,
            "upper_share": _count(c, "[A-Z]") / n,
            "lower_share": _count(c, "[a-z]") / n,
            "sign_share": _count(c, "[^A-Za-z0-9]") / n,
            "hex": flag(c.rlike("^[0-9a-fA-F-]+$")),
            "digits_only": flag(c.rlike("^[0-9-]+$")),
            "transitions": _count(c, "(?<=[0-9])[^0-9]|(?<=[A-Z])[^A-Z]|(?<=[a-z])[^a-z]") / n,
            "letter_digit": _count(c, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]") / n,
            "case_change": _count(c, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / n,
            "longest_run": F.greatest(longest("[0-9]+"), longest("[A-Z]+"), longest("[a-z]+")) / n,
            "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
            "dictionary": _covered(c, language) / n,
            "vowel_share": _count(c, "[aeiouAEIOU]") / n,
            "has_slash": _count(c, "/") / n,
            "dashes": _count(c, "-") / n,
            "after_slash": flag(F.col("before").rlike(r"/$")),
            "after_scheme": flag(F.col("before").rlike(r"://\S*$")),
            "extension": flag(F.col("after").rlike(r"^\.[a-z]{2,4}\b")),
            "quoted": flag(F.col("before").rlike("[\"'`]$")),
            "assigned": flag(F.col("before").rlike("[=:]\\s*[\"'`]?$")),
            "secret_word": flag(F.col("before").rlike(tail(SECRET_WORDS))),
            "harmless_word": flag(F.col("before").rlike(tail(HARMLESS_WORDS))),
            "password_word": flag(F.col("before").rlike(r"(?i)(?:pass|passwords?|passwd|passphrase|passcode|pwd|secrets?)[\"'`\]]{0,2}\s*[:=>]+\s*[\"'`]?$")),
            "user_info": flag(F.col("before").rlike(r"://[^\s/@]*$") & F.col("after").startswith("@")),
            "dots": _count(c, r"\."),
            "webhook": flag(F.col("before").rlike(r"hooks\.slack\.com/services/$")),
            "blanks": _count(c, r"\s"),
            "letter_model": _letter_model(c, language),
            "placeholder": flag(c.rlike(r"(?i)your|example|changeme|placeholder|dummy|sample|insert|(?:^|[^a-z])(?:here|todo|test|fake|none|null)(?:$|[^a-z])|x{4}|\*{3}|\.{3}|^[$%<{]")),
            "auth_scheme": flag(F.col("before").rlike(r"(?i)(?:authorization\W{1,4}|^|[^a-z])(?:bearer|basic)\s+$")),
            "prefix": flag(c.rlike(f"^(?:{PREFIXES})")),
        }
    )


def made_up_findings(spark: SparkSession, words: tuple[str, ...] = (), rows: int = EXAMPLES, seed: int = 11) -> DataFrame:
    """Labelled findings (candidate, before, after, label) by rule: keys in their usual settings, and what looks like them.

    words: of the corpus, of which harmless candidates are made besides IDENTIFIERS. Stands in for findings that people
    have labelled; fit() takes those in its place.
    """
    common = [*IDENTIFIERS, *words]
    r = spark.range(rows, numPartitions=4)
    text = lambda k: F.sha2(F.concat_ws("|", F.lit(seed), "id", F.lit(k)).cast("binary"), 256)
    pick = lambda k, options: F.element_at(F.array(*(F.lit(x) for x in options)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    upper = F.translate(F.upper(F.base64(F.unhex(text("u")))), "+/=189", "QZ7XYK")
    mixed = F.translate(F.base64(F.unhex(text("m"))), "+/=", "aZ9")
    digits = F.translate(text("d"), "abcdef", "135790")
    phrases = ["thority estation of", "und der einer", "la que les", "it was then", "config for the", "note that"]
    prose = lambda k: F.concat(pick(k, phrases), F.lit(" "))
    named = F.concat(prose("p"), pick("s", SECRET_WORDS), pick("e", ["=", ": ", ' = "', "='", "=\"", " "]))
    harmless = F.concat(prose("p"), pick("h", HARMLESS_WORDS), pick("e", ["=", ": ", ' = "', " ", "/"]))
    assigned = F.concat(prose("p"), pick("f", ["", "", "db_", "DB_", "admin_"]), pick("s2", ["password", "passwd", "pwd", "secret", "pass", "passphrase", "PASSWORD"]), pick("e2", ["=", ": ", ' = "', "='", '="', '": "', " = '"]))
    parts = ["purple", "monkey", "dragon", "sunset", "tiger", "coffee", "river", "garden", "silver", "winter", "rocket", "pepper", "yellow", "forest", "bridge", "violin"]
    safe = F.translate(F.base64(F.unhex(text("j"))), "+/=", "-_x")
    size = lambda k, sizes: pick(k, sizes).cast("int")
    cut = lambda c, n: F.substring(c, F.lit(1), n)
    hosts = ["db.host", "mail.example.com", "10.0.0.4"]
    # (label, before, candidate) and, where it matters, what follows
    kinds = [
        (1, pick("jb", ["it was then ", "Authorization: Bearer ", "token=", "and "]), F.concat(F.lit("eyJ"), cut(safe, size("n", [17, 33])), F.lit(".eyJ"), cut(F.reverse(safe), size("n2", [20, 40])), F.lit("."), cut(F.translate(safe, "abcdef", "ZYXWVU"), size("n3", [27, 43])))),
        (1, prose("p"), F.concat(F.lit("SG."), cut(safe, F.lit(22)), F.lit("."), cut(F.reverse(safe), F.lit(43)))),
        (1, prose("p"), F.concat(F.lit("ya29."), cut(safe, size("n", [30, 43])))),
        (1, F.concat(prose("p"), F.lit("https://hooks.slack.com/services/")), F.concat(F.lit("T"), cut(upper, F.lit(8)), F.lit("/B"), cut(F.reverse(upper), F.lit(8)), F.lit("/"), cut(mixed, F.lit(24)))),
        (1, F.concat(prose("p"), pick("u", ["postgres", "mysql", "https", "redis", "amqp", "mongodb"]), F.lit("://"), pick("v", ["admin", "root", "app", "", "user"]), F.lit(":")), F.when(pick("y", ["0", "1"]) == "0", cut(mixed, size("n", [8, 12, 16, 24]))).otherwise(F.concat(pick("w5", parts), pick("w6", parts), cut(digits, size("n2", [1, 2, 4])))), F.concat(F.lit("@"), pick("o", hosts))),
        (1, F.concat(prose("p"), F.lit("https://")), F.concat(pick("g", ["ghp_", "glpat-", ""]), cut(mixed, size("n", [20, 30, 36]))), F.concat(F.lit("@"), pick("o", hosts))),
        (1, assigned, F.concat(pick("w5", parts), pick("w6", parts), pick("w7", [*parts, "", "", ""]))),
        (1, assigned, F.concat(pick("w5", parts), cut(digits, size("n", [1, 2, 3, 4])), pick("w6", [*parts, "", "", "!", "$"]))),
        (1, assigned, F.concat(F.translate(pick("w5", parts), "aeo", "@30"), pick("q", ["!", "#", "$", "%", "."]), F.initcap(pick("w6", parts)), cut(digits, size("n", [1, 2, 3])))),
        (1, assigned, cut(mixed, size("n", [8, 10, 12, 14]))),
        (1, assigned, F.concat_ws(" ", pick("w5", parts), pick("w6", parts), pick("w7", parts), pick("w8", parts))),
        (1, prose("p"), F.concat(F.lit("AKIA"), cut(upper, F.lit(16))), pick("a2", [".Next", ". And", ".", ".\n"])),
        (1, F.concat(prose("p"), pick("ab", ["Authorization: Bearer ", "authorization: bearer ", "Bearer ", "Authorization: Basic ", "-H 'Authorization: Bearer "])), F.when(pick("y", ["0", "1"]) == "0", cut(mixed, size("n", [10, 12, 16, 20, 24, 32]))).otherwise(cut(text("x"), size("n", [12, 16, 20, 24, 32])))),
        (0, F.concat(prose("p"), pick("ab", ["basic ", "Basic ", "a basic ", "the bearer "])), F.concat(pick("w1", common), pick("q5", ["-", "", "2", "3D"]), pick("w2", common), cut(digits, size("n", [1, 2])))),
        (0, F.concat(prose("p"), pick("u", ["https", "ftp", "ssh", "http"]), F.lit("://")), pick("v", ["git", "admin", "root", "user", "anonymous", "deploy"]), F.concat(F.lit("@"), pick("o", hosts))),
        (0, F.concat(prose("p"), pick("s3", SECRET_WORDS), pick("e3", [": ", "=", " = ", " := "])), pick("w9", ["the", "value", "true", "false", "null", "None", "undefined", "required", "string", "str", "is", "a", "see", "below", "public", "read", "1", "0", "$PASSWORD", "os.environ", "getenv", "process.env.TOKEN", "changeme", "example", "***", "xxxxxxxx", "your-password", "hidden", "not", "and"])),
        (0, F.concat(prose("p"), pick("s4", ["password", "token", "secret", "key", "pass"]), pick("e3", [": ", "=", ' = "', "='"])), F.concat(pick("w1", common), pick("q2", ["", "_", "-", " "]), pick("w2", common))),
        (0, prose("p"), F.concat(pick("w1", parts), pick("w2", common), pick("w3", [*parts, *common]), pick("w4", ["ungen", "keit", "ization", "ment"]))),
        (0, prose("p"), F.concat_ws("-", pick("w1", parts), pick("w2", common), pick("w3", parts))),
        (0, F.concat(prose("p"), pick("d", ["www.", "mail@", "docs/", "a.b."])), F.concat(pick("w1", parts), pick("q2", ["", "-", "_"]), pick("w2", common), pick("w3", parts)), pick("x2", [".com", ".org/", "@example.com", ".txt"])),
        (0, prose("p"), F.concat(pick("w1", common), F.initcap(pick("w2", parts)), F.initcap(pick("w3", common)))),
        (0, prose("p"), F.concat(F.lit("/"), pick("w1", common), F.lit("/"), pick("w2", parts), F.lit("/"), pick("w3", common))),
        (1, prose("p"), F.concat(F.lit("AKIA"), cut(upper, F.lit(16)))),
        (1, prose("p"), F.concat(pick("g", ["ghp_", "sk_live_", "glpat-", "AIza", "npm_", "hf_"]), cut(mixed, size("n", [24, 30, 35, 36])))),
        (1, named, cut(text("x"), size("n", [16, 18, 20, 24, 32, 40, 64]))),
        (1, named, cut(text("x"), size("n", [18, 40]))),
        (1, named, cut(mixed, size("n", [16, 20, 24, 32, 40]))),
        (1, named, F.concat(cut(mixed, F.lit(20)), F.lit("/"), cut(F.reverse(mixed), F.lit(19)))),
        (0, prose("p"), cut(digits, size("n", [16, 16, 18, 20]))),
        (0, harmless, cut(text("x"), size("n", [32, 40, 64]))),
        (0, harmless, cut(digits, size("n", [16, 18, 20]))),
        (0, prose("p"), F.concat_ws("-", cut(text("x"), F.lit(8)), F.substring(text("x"), 9, 4), F.substring(text("x"), 13, 4), F.substring(text("x"), 17, 4), F.substring(text("x"), 21, 12))),
        (0, F.concat(prose("p"), pick("l", ["https://host.example.com/static/", "/assets/js/", "src/main/", "http://cdn.example.org/img/"])), cut(text("x"), size("n", [16, 20, 32, 40]))),
        (0, F.concat(prose("p"), F.lit("data:image/png;base64,")), F.base64(F.unhex(F.concat(text("a"), text("b"))))),
        (0, prose("p"), F.concat(pick("w1", common), F.initcap(pick("w2", common)), F.initcap(pick("w3", common)), cut(digits, size("n", [1, 2, 4])))),
        (0, named, F.concat(pick("w4", ["your", "example", "changeme", "placeholder", "dummy"]), F.lit("_"), pick("w1", common), F.lit("_"), pick("w2", common), cut(digits, size("n", [1, 3])))),
        (0, prose("p"), F.concat(pick("w1", common), F.lit("-"), pick("w2", common), F.lit("-"), pick("w3", common), F.lit("-"), cut(digits, size("n", [2, 4, 8])))),
        (0, prose("p"), F.concat(pick("w1", common), pick("w2", common), pick("w3", common), pick("w4", common))),
        (0, prose("p"), F.concat(pick("w1", common), pick("q3", ["", "/", "_"]), F.initcap(pick("w2", common)), pick("w3", common), pick("q4", ["", "-"]), pick("w4", common))),
        (0, prose("p"), F.concat(cut(digits, F.lit(4)), F.lit("-01-02-"), pick("w1", common), F.lit("-"), pick("w2", common))),
    ]
    after = pick("a", [" and so on", '" of the', ".\n", " ", "';", "\n"])
    follow = F.when(F.col("before").endswith("/"), pick("x", [".js", ".png", ".html", "/"])).otherwise(after)
    out = None
    for k, (label, before, candidate, *ending) in enumerate(kinds):
        own = r.where(F.pmod(F.col("id"), F.lit(len(kinds))) == k).withColumn("before", before).select(candidate.alias("candidate"), "before", (ending[0] if ending else follow).alias("after"), F.lit(label).alias("label"))
        out = own if out is None else out.union(own)
    return written(out.coalesce(4), "examples")


@dataclass
class Scanner:
    """A fitted forest, and the language that its features are measured by."""

    forest: RandomForestClassificationModel
    language: Language


def fit(findings: DataFrame, language: Language, rows: int = 100_000) -> Scanner:
    """Learns from labelled findings (candidate, before, after, label 0 or 1), about `rows` of them at most; rows without a candidate or label aren't learnt from."""
    known = findings.where("candidate is not null and candidate <> '' and label is not null").select("candidate", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label"))
    share = min(1.0, rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("candidate", "before"), F.lit(1_000_000)) < int(share * 1_000_000))
    table = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(known, language)).select("features", "label"), "findings")
    return Scanner(RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=5).fit(table.coalesce(4)), language)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, start, length, masked, candidate_sha256, score, secret): one row for each candidate of each row of docs.

    start counts characters from 0; masked shows the first third, four characters at most. Null, empty and candidate-free texts
    have no rows; rows that repeat have theirs again. Other columns are not read. An empty table gives an empty result.
    """
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, id_col, text_col), scanner.language))
    out = scanner.forest.transform(table.select("doc_id", "start", "candidate", "features"))
    return out.select(
        "doc_id", "start", F.length("candidate").cast("long").alias("length"), F.concat(F.substring(F.col("candidate"), F.lit(1), F.least(F.lit(4), F.floor(F.length("candidate") / 3).cast("int"))), F.lit("***")).alias("masked"), F.sha2(F.col("candidate"), 256).alias("candidate_sha256"),
        F.round(vector_to_array("probability")[1], 6).alias("score"), (vector_to_array("probability")[1] >= cut).alias("secret"),
    )
