"""Indexes of a bank: solid k-mers with abundances, and the reads that have each."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import saturated
from ..tables import sent, written
from . import superkmers
from .complexity import complex_reads
from .kmers import kmers
from .membership import Membership, membership


class NoSolidKmers(ValueError):
    """The bank has no k-mer of the abundance that is asked for."""


def kmer_counts(bank: DataFrame, k: int = 31, least: int = 1) -> DataFrame:
    """(kmer, count) over all reads of the bank, of the k-mers that occur so often at least."""
    return superkmers.kmer_counts(bank, k, least)


def kmer_spectrum(bank: DataFrame, k: int = 31) -> DataFrame:
    """(abundance, kmers): how many k-mers occur so often."""
    return superkmers.spectrum(bank, k)


def solid_kmers(bank: DataFrame, k: int = 31, abundance_min: int = 2) -> DataFrame:
    """(kmer, abundance): the k-mers that occur so often at least, the abundance up to 255."""
    return kmer_counts(bank, k, abundance_min).select("kmer", saturated(F.col("count")).alias("abundance"))


def _asked(bank: DataFrame, k: int, abundance_min: int, keep_low_complexity: bool, among: DataFrame) -> DataFrame:
    """The postings of the k-mers that the reads in `among` have: others are dropped where they are made, and their counts are not needed."""
    asked = written(kmers(among, k).where("kmer is not null").select("kmer").distinct(), "asked")
    known, wanted = membership(asked), sent(asked)

    def held(reads: DataFrame) -> DataFrame:
        found = kmers(reads, k, known).where("kmer is not null").join(wanted, "kmer", "left_semi")
        return found.groupBy("kmer", F.col("read_id").alias("target_id")).agg(F.count("*").alias("places"))

    every = written(held(bank), "held")
    kept = every if keep_low_complexity else held(complex_reads(bank, k))
    if abundance_min <= 1:
        return kept.select("kmer", "target_id")
    solid = written(every.groupBy("kmer").agg(F.sum("places").alias("count")).where(F.col("count") >= abundance_min).select("kmer"), "solid")
    return kept.join(sent(solid), "kmer", "left_semi").select("kmer", "target_id")


def postings(bank: DataFrame, k: int = 31, abundance_min: int = 2, keep_low_complexity: bool = False, among: DataFrame | None = None) -> DataFrame:
    """(kmer, target_id): the solid k-mers of each complex read of the bank. Solidity counts all reads. among: only k-mers that these reads have."""
    if among is not None:
        return _asked(bank, k, abundance_min, keep_low_complexity, among)
    kept = bank if keep_low_complexity else complex_reads(bank, k)
    out = kmers(kept, k).where("kmer is not null").select("kmer", F.col("read_id").alias("target_id")).distinct()
    return out if abundance_min <= 1 else out.join(solid_kmers(bank, k, abundance_min).select("kmer"), "kmer", "left_semi")


_ABOUT = "k int, abundance_min int, keep_low_complexity boolean, kind string, name string, buckets int, columns string, shards int, size int"


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


@dataclass
class Index:
    """A stored or planned index. known: a filter that tells most k-mers that the index lacks, if it has one."""

    table: DataFrame
    k: int
    abundance_min: int
    keep_low_complexity: bool
    kind: str
    known: Membership | None = None

    def save(self, path: str, buckets: int | None = None) -> None:
        """A table in buckets of k-mers (as many as the shuffle has partitions, if not given), sorted within, a membership filter unless it would be too large, and the parameters beside them.

        Queries of the stored index move only their own k-mers: the buckets are where the join needs them.
        """
        spark = self.table.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path, name = _qualified(spark, path), f"seqweave_{uuid.uuid4().hex}"
        dealt = self.table.repartition(buckets, "kmer")
        dealt.write.mode("overwrite").format("parquet").option("path", f"{path}/table").bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay; load_index names them again
        known = membership(spark.read.schema(self.table.schema).parquet(f"{path}/table").select("kmer").distinct(), path=f"{path}/filter-{name}")
        columns = ", ".join(f"{c} {t}" for c, t in self.table.dtypes)
        about = [(self.k, self.abundance_min, self.keep_low_complexity, self.kind, name, buckets, columns, known.shards if known else 0, known.size if known else 0)]
        spark.createDataFrame(about, _ABOUT).coalesce(1).write.mode("overwrite").json(f"{path}/about")

    def ready(self) -> Index:
        """Itself, as a table that is broadcast if it is small, and with a membership filter: for several queries, or for many reads."""
        table = written(self.table, "index")
        return replace(self, table=sent(table), known=membership(table.select("kmer")))

    def checked(self) -> Index:
        """Itself, if it has any k-mer."""
        if self.table.isEmpty():
            raise NoSolidKmers(f"no k-mer occurs {self.abundance_min} times")
        return self


def counter_index(bank: DataFrame, k: int = 31, abundance_min: int = 2, keep_low_complexity: bool = False) -> Index:
    """k-mer to abundance. Low complexity plays no part in what is counted."""
    return Index(solid_kmers(bank, k, abundance_min), k, abundance_min, keep_low_complexity, "counter")


def linker_index(bank: DataFrame, k: int = 31, abundance_min: int = 2, keep_low_complexity: bool = False, among: DataFrame | None = None) -> Index:
    """k-mer to reads. among: the only reads that the index will be asked for, if they are known; a large bank's other k-mers are then left out."""
    return Index(postings(bank, k, abundance_min, keep_low_complexity, among), k, abundance_min, keep_low_complexity, "linker")


def load_index(spark: SparkSession, path: str) -> Index:
    """A stored index; its buckets are made known to the session's catalog under the name that it was stored with."""
    path = _qualified(spark, path)
    about = spark.read.schema(_ABOUT).json(f"{path}/about").first()
    where = f"{path}/table".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {about['name']} ({about['columns']}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {about['buckets']} BUCKETS LOCATION '{where}'")
    known = Membership(f"{path}/filter-{about['name']}", about["shards"], about["size"]) if about["shards"] else None
    return Index(spark.table(about["name"]), about["k"], about["abundance_min"], about["keep_low_complexity"], about["kind"], known)
