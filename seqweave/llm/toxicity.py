"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import blocks, held, raw, small_batches, tidy, without, written
from ._words import Hashes, edges, mix

#: Labelled rows that a model is fitted on, about (a bounded sample by hash of the id).
FIT_ROWS = 40_000
#: Entries of the lexicon at most, least count of toxic rows and least z-score of one.
LEXICON, LEAST_ROWS, LEAST_Z = 20_000, 4, 6.0
#: Trees, depth, step; predicted is 1 from this score on.
TREES, DEPTH, STEP, CUT = 20, 4, 0.2, 0.3
#: Words from which an insult is as far as "near a second person" allows.
NEAR = 5
#: Bytes of the word starts that the lexicon holds besides whole words.
PREFIXES = (4, 5, 6)

#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú tu ti te usted ustedes vosotros vuestro".split()

#: Bytes as letters for the lexicon: lower case, and digits and signs that stand for letters.
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
for _sign, _letter in zip("0134578@$", "oieastbas", strict=True):
    _LETTERS[ord(_sign)] = ord(_letter)

FEATURES = [
    "hit_rate", "weight_rate", "hits", "kinds", "max_weight", "sum_weight", "near_rate", "near_hits", "person_rate",
    "upper_rate", "shout_rate", "mark_rate", "punct_rate", "obfuscated_rate", "digit_rate", "repeat_rate", "log_words", "word_length",
]


class Units:
    """The words of a block, and the hashes of each word and of its starts (0 where the word isn't longer)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        norm = _LETTERS[data]
        self.starts, self.ends = edges(norm != 0, offsets)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.owner = np.searchsorted(offsets, self.starts, "right") - 1
        hasher = Hashes(norm)
        size = self.ends - self.starts
        self.hashes = [hasher.of(self.starts, self.ends)]
        for k in PREFIXES:
            h = hasher.of(self.starts, np.minimum(self.starts + k, self.ends))
            self.hashes.append(np.where(size > k, mix(h + np.uint64(k)), np.uint64(0)))


@dataclass
class Lexicon:
    """Sorted hashes of word units and their weights (log odds of toxic against other rows)."""

    units: np.ndarray
    weights: np.ndarray

    def of(self, units: Units) -> np.ndarray:
        """For each word the greatest weight of its units, 0 without any."""
        out = np.zeros(len(units.starts))
        if not len(self.units):
            return out
        seen = np.zeros(1 << 18, bool)
        seen[(self.units & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        for h in units.hashes:
            at = np.flatnonzero(seen[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.units, h[at]), len(self.units) - 1)
            ok = self.units[place] == h[at]
            out[at[ok]] = np.maximum(out[at[ok]], self.weights[place[ok]])
        return out


def _person() -> np.ndarray:
    data = " ".join(SECOND_PERSON).encode()
    return np.unique(Units(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes[0])


def features(data: np.ndarray, offsets: np.ndarray, lexicons: list[Lexicon], which: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; which: the lexicon that serves each text. Rates are by words or by characters; capitals are those of Latin-1."""
    n = len(offsets) - 1
    units = Units(data, offsets)
    weight = np.zeros(len(units.starts))
    for k, lexicon in enumerate(lexicons):
        mine = which[units.owner] == k
        if mine.any():
            weight = np.where(mine, lexicon.of(units), weight)
    total = lambda x: np.add.reduceat(np.append(x, 0.0), units.bounds[:-1]) * (units.bounds[1:] > units.bounds[:-1]) if len(x) else np.zeros(n)
    chars = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]).astype(float)
    hit = weight > 0
    person = np.isin(units.hashes[0], _person())
    near = np.zeros(len(hit), bool)
    for shift in range(1, NEAR + 1):
        if len(hit) > shift:
            same = units.owner[shift:] == units.owner[:-shift]
            near[shift:] |= person[:-shift] & same
            near[:-shift] |= person[shift:] & same
    near &= hit
    at = np.flatnonzero(hit)
    kinds, most = np.zeros(n), np.zeros(n)
    if len(at):
        np.maximum.at(most, units.owner[at], weight[at])
        pair = np.unique(np.stack([units.owner[at].astype(np.uint64), mix(weight[at].view(np.uint64))], 1), axis=0)
        kinds = np.bincount(pair[:, 0].astype(np.int64), minlength=n).astype(float)
    head = (data & 0xC0) != 0x80  # the first byte of each character
    upper = (data >= 0x41) & (data <= 0x5A)
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))  # capitals of Latin-1, two bytes each
    upper[accent] = upper[accent + 1] = True
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    digit = (data >= 0x30) & (data <= 0x39)
    punct = (data > 0x20) & (data < 0x7F) & ~letter & ~digit
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = letter[1:]
    ups, places = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(head)])
    length = places[units.ends] - places[units.starts]  # of words, in characters
    shout = (ups[units.ends] - ups[units.starts] == units.ends - units.starts) & (length > 2)
    again = np.zeros(len(data), bool)
    again[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 0x80) & letter[2:]
    words = np.maximum(np.diff(units.bounds), 1).astype(float)
    size = np.maximum(chars(head), 1)
    hits, near_hits, sum_weight = total(hit.astype(float)), total(near.astype(float)), total(weight)
    return np.stack(
        [
            hits / words, sum_weight / words, np.log1p(hits), kinds, most, np.log1p(sum_weight), near_hits / words, np.log1p(near_hits), total(person.astype(float)) / words,
            chars(upper & head) / size, total(shout.astype(float)) / words, chars((data == 0x21) | (data == 0x3F)) / size, chars(punct) / size, chars((digit | punct) & before & after) / size, chars(digit) / size, chars(again) / size, np.log1p(words), total(length.astype(float)) / words,
        ],
        axis=1,
    )


def _features(shared):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("words")
        lexicons = [Lexicon(*x) for x in shared.value]
        for batch in batches:
            for block in blocks(batch, "text"):
                data, offsets = raw(block.column("text"))
                table = features(data, offsets, lexicons, block.column("which").to_numpy())
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in block.schema.names if c not in ("text", "which")), *(pa.array(np.ascontiguousarray(x)) for x in table.T)], [c for c in block.schema.names if c not in ("text", "which")] + FEATURES)

    return kernel


def _counts(only: np.ndarray | None):
    """Rows that have each unit, by fold and label; only: the units that count."""

    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("words")
        keep = only.value if only is not None else None
        for batch in batches:
            for block in blocks(batch, "text"):
                data, offsets = raw(block.column("text"))
                units = Units(data, offsets)
                group = (block.column("fold").to_numpy() * 2 + block.column("toxic").to_numpy()).astype(np.int64)
                h, owner = np.concatenate(units.hashes), np.tile(units.owner, len(units.hashes))
                ok = h != 0
                if keep is not None:
                    ok &= np.isin(h, keep)
                h, owner = h[ok], owner[ok]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, owner = h[new], owner[new]
                unit, inverse = np.unique(h, return_inverse=True)
                table = np.bincount(inverse * 4 + group[owner], minlength=4 * len(unit)).reshape(-1, 4) if len(unit) else np.zeros((0, 4), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in table.T)], ["unit", "c0", "t0", "c1", "t1"])

    return kernel


@dataclass
class Model:
    """A fitted scorer; without both labels to learn from, base is every score."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


def _lexicon(unit: np.ndarray, clean: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> Lexicon:
    """clean, toxic: the rows without and with the label that have each unit; rows: all rows without and with it."""
    p = rows[1] / max(rows.sum(), 1)
    n = clean + toxic
    z = (toxic - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    weight = np.log((toxic + 0.5) / (rows[1] + 1)) - np.log((clean + 0.5) / (rows[0] + 1))
    ok = np.flatnonzero((toxic >= LEAST_ROWS) & (z >= LEAST_Z) & (weight > 1.5))
    ok = ok[np.argsort(-z[ok], kind="stable")[:LEXICON]]
    ok = ok[np.argsort(unit[ok].view(np.uint64))]
    return Lexicon(unit[ok].view(np.uint64), weight[ok])


def _table(df: DataFrame, lexicons: list[Lexicon], which: Column, keys: str) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast([(x.units, x.weights) for x in lexicons])  # LEXICON entries at most
    made = df.withColumn("which", which).mapInArrow(_features(shared), f"{keys}, " + ", ".join(f"{c} double" for c in FEATURES))
    return made


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learns from about `rows` labelled rows at most, among those where learn (a condition on the id) holds.

    The lexicon is made of words and word starts that toxic rows have far more often than others. Rows that the trees
    are fitted on are weighed with a lexicon from the other half of the rows, so that it is as good there as on new text;
    a fifth is kept from the trees for the calibration. Rows without text, label or id aren't learnt from; of several labels the greatest counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if learn is not None:
        marks = marks.where(learn)
    marks = marks.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    have = marks.count()
    share = min(1.0, rows / max(have, 1))
    draw = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(n))
    marks = marks.where(draw("fit", 1_000_000) < int(share * 1_000_000))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # about `rows` ids at most, so that texts aren't shuffled to find the labelled ones
    known = base.join(F.broadcast(marks), "doc_id").withColumn("fold", draw("fold", 2).cast("int")).withColumn("held", draw("held", 5) == 0)
    known = written(known.repartition(max(1, min(24, have // 500))), "labelled")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in known.groupBy("fold", "toxic").count().collect()}
    all_rows = np.array([[sizes.get((f, t), 0) for t in (0, 1)] for f in (0, 1)], float)
    toxic_rows, n = all_rows[:, 1].sum(), all_rows.sum()
    if not 0 < toxic_rows < n:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, float(toxic_rows / n) if n else 0.0)

    def counted(df: DataFrame, only) -> DataFrame:
        return df.mapInArrow(_counts(only), "unit long, c0 long, t0 long, c1 long, t1 long").groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))

    mine = counted(known.where("toxic = 1").select("text", "fold", "toxic"), None).where(f"t0 + t1 >= {LEAST_ROWS}").toPandas()  # bounded by the sample
    only = spark.sparkContext.broadcast(mine["unit"].to_numpy().view(np.uint64))
    rest = counted(known.where("toxic = 0").select("text", "fold", "toxic"), only).toPandas().set_index("unit").reindex(mine["unit"]).fillna(0)
    unit, t, c = mine["unit"].to_numpy(), mine[["t0", "t1"]].to_numpy(float), rest[["c0", "c1"]].to_numpy(float)
    halves = [_lexicon(unit, c[:, f], t[:, f], all_rows[f]) for f in (1, 0)]  # rows of fold 0 use fold 1's
    lexicon = _lexicon(unit, c.sum(1), t.sum(1), all_rows.sum(0))
    table = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_table(known.select("text", "toxic", "held", "fold"), halves, F.col("fold"), "toxic int, held boolean, fold int").drop("fold")).select("toxic", "held", "features"), "features")
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, subsamplingRate=0.8, seed=7, maxBins=64).fit(table.where("not held").withColumn("toxic", F.col("toxic").cast("double")).coalesce(6))
    out = trees.transform(table.where("held")).select(F.col("toxic").cast("double").alias("label"), vector_to_array("probability")[1].alias("p"))
    out = written(out, "held")
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(out) if out.agg(F.countDistinct("label")).first()[0] == 2 else None
    return Model(lexicon, trees, calibration, float(toxic_rows / n))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted), one row for each row of docs.

    score: the calibrated chance of the label; a thousandth of it is the trees' own chance, which orders rows of equal
    calibration. Null and empty texts are scored as texts without words. Rows that repeat are scored alike. Other columns
    are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model.trees is None:
        return base.select("doc_id", F.lit(model.base).alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
    table = _table(base, [model.lexicon], F.lit(0), f"doc_id {dict(base.dtypes)['doc_id']}")
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).select("doc_id", "features")
    table = model.trees.transform(table).select("doc_id", vector_to_array("probability")[1].alias("p"))
    if model.calibration is not None:
        table = model.calibration.transform(table).select("doc_id", (0.999 * F.col("prediction") + 0.001 * F.col("p")).alias("score"))
    else:
        table = table.select("doc_id", F.col("p").alias("score"))
    return table.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 4, is 2. Rows without an id have no label to hold out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns, each judged by its own text."""
    return without(docs, id_col, text_col, lambda keyed, key: scored(keyed, model, key, text_col, cut).where("predicted = 1").select(F.col("doc_id").alias(key)))
