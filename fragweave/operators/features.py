"""k-mer profiles, coverage vectors and mean profiles.

Profiles are long, (id, kmer, freq), while they are grouped, and dense arrays in the order of ``canonical_index`` for distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import floored
from ..functions.sequences import K, as_bases, canonical_index, kmer_at, positions, reverse_complement
from ..scratch import spread


def long_contigs(contigs: DataFrame, min_length: int) -> DataFrame:
    return contigs.filter(F.col("length") >= min_length)


def kmer_counts(sequences: DataFrame, id_col: str = "contig_id", seq: str = "seq", k: int = K) -> DataFrame:
    """(id, kmer, n). Counted before the shuffle, so at most as many rows as there are canonical k-mers leave each sequence."""
    bases = as_bases(F.col(seq))
    rows = spread(sequences).select(F.col(id_col), bases.cast("binary").alias("_f"), reverse_complement(bases).cast("binary").alias("_b"), positions(bases, k).alias("_at"))
    each = rows.select(id_col, "_f", "_b", F.explode("_at").alias("_p")).select(id_col, kmer_at(F.col("_f"), F.col("_b"), F.col("_p"), k).alias("_k"))
    return each.groupBy(id_col, "_k").agg(F.count(F.lit(1)).alias("n")).select(id_col, F.col("_k").cast("string").alias("kmer"), "n")


def kmer_frequencies(counts: DataFrame, id_col: str = "contig_id") -> DataFrame:
    """(id, kmer, freq): counts over their sum, or over 1 if there are none."""
    total = F.sum("n").over(Window.partitionBy(id_col))
    return counts.select(id_col, "kmer", (F.col("n") / F.greatest(total, F.lit(1))).alias("freq"))


def dense_profiles(sequences: DataFrame, id_col: str = "contig_id", seq: str = "seq", k: int = K) -> DataFrame:
    """(id, profile): one array for each sequence; all zero for one shorter than k."""
    freq = kmer_frequencies(kmer_counts(sequences, id_col, seq, k), id_col)
    maps = freq.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "freq"))).alias("by_kmer"))
    dense = F.transform(F.array(*[F.lit(m) for m in canonical_index(k)]), lambda m: F.coalesce(F.element_at("by_kmer", m), F.lit(0.0)))
    out = sequences.select(id_col).join(maps, id_col, "left")
    return out.select(id_col, F.when(F.col("by_kmer").isNull(), F.array_repeat(F.lit(0.0), len(canonical_index(k)))).otherwise(dense).alias("profile"))


def fingerprint(sequences: DataFrame, id_col: str = "contig_id", seq: str = "seq") -> str:
    """Of all ids and sequences, whatever their order."""
    row = sequences.select(F.xxhash64(id_col, seq).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1_000_003).alias("s")).first()
    return f"{row['n']:x}-{(row['x'] or 0) & (1 << 64) - 1:x}-{(row['s'] or 0) & (1 << 64) - 1:x}"


def cached_profiles(sequences: DataFrame, path: str, id_col: str = "contig_id", seq: str = "seq", k: int = K) -> DataFrame:
    """``dense_profiles``, written below ``path`` under the input's fingerprint and read from there the next time."""
    spark = sequences.sparkSession
    place = f"{path}/k{k}-{fingerprint(sequences, id_col, seq)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        dense_profiles(sequences, id_col, seq, k).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def coverage_vectors(abundance: DataFrame, contigs: DataFrame, min_length: int = 0) -> DataFrame:
    """(contig_id, name, coverage) of long contigs, floored; a repeated name's values follow one another.

    Every abundance row must name a contig.
    """
    known = contigs.select("contig_id", "name", "length")
    rows = abundance.join(known, "name", "left")
    unknown = F.raise_error(F.concat(F.lit("no contig is named "), F.coalesce("name", F.lit("null"))))
    rows = rows.filter(F.when(F.col("contig_id").isNull(), unknown.cast("boolean")).otherwise(F.col("length") >= min_length))
    each = F.transform("coverage", lambda x: floored(x))
    return rows.groupBy("contig_id", "name").agg(F.flatten(F.collect_list(each)).alias("coverage"))


def sample_count(coverage: DataFrame) -> int:
    """Samples of every contig; unequal numbers are an error."""
    row = coverage.agg(F.min(F.size("coverage")).alias("lo"), F.max(F.size("coverage")).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no contig is long enough")
    if row["lo"] != row["hi"]:
        raise ValueError(f"contigs have {row['lo']} to {row['hi']} coverage values")
    return row["lo"]


#: Parts of one that sums are exact in, and the largest number that is summed so: its parts are a long.
PARTS, LARGEST = 1 << 40, float(1 << 22)


def exact_mean(x: Column) -> Column:
    """The mean, whatever the order of the rows: groups of the same values have the same mean, where sums of doubles may differ in their last digits.

    Numbers are summed in whole parts of 1 / ``PARTS``; what is left of them is too small to be seen in the mean but for its last digit at most. Where a
    group has one that is not finite or above ``LARGEST``, the mean is the plain one.
    """
    parts = F.floor(x * F.lit(float(PARTS))).cast("decimal(38,0)")
    fine = F.abs(x) <= LARGEST
    rest = x * F.lit(float(PARTS)) - F.floor(x * F.lit(float(PARTS)))
    # the rest in the same way, again in whole parts
    small = F.floor(rest * F.lit(float(PARTS))).cast("decimal(38,0)")
    total = F.sum(F.when(fine, parts)).cast("double") / F.lit(float(PARTS)) + F.sum(F.when(fine, small)).cast("double") / F.lit(float(PARTS)) / F.lit(float(PARTS))
    return F.when(F.bool_and(fine), total / F.count(x)).otherwise(F.avg(x))


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): element-wise means, the same for the same values in any order."""
    each = rows.select(group, F.posexplode(vector).alias("_p", "_x")).groupBy(group, "_p").agg(exact_mean(F.col("_x").cast("double")).alias("_m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"])
    return each.groupBy(group).agg(ordered.alias(vector))


def bin_profiles(members: DataFrame, features: DataFrame) -> DataFrame:
    """(bin_id, profile, coverage): means over a bin's members. features: (contig_id, profile, coverage)."""
    rows = members.select("bin_id", "contig_id").join(features, "contig_id")
    return mean_vectors(rows, "bin_id", "profile").join(mean_vectors(rows, "bin_id", "coverage"), "bin_id")
