"""File pruning before a scan, over a table of file statistics.

The statistics have one row for each file; what remains is a list of paths for the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions.vectors import distance

WORD_BITS = 64


def by_geometry(files: DataFrame, query: Sequence[float], threshold: float = math.inf, metric: str = "euclidean", centroid: str = "centroid", radius: str = "radius") -> DataFrame:
    """Files that may hold a row within ``threshold``: distance to the centroid minus radius at most that.

    Files without a centroid or radius, or with another dimension, stay.  Only for the Euclidean distance is nothing lost; with others
    the bound is a heuristic.  An infinite threshold keeps all.
    """
    if math.isinf(threshold):
        return files
    d = distance(metric, centroid, query)
    keep = F.col(centroid).isNull() | F.col(radius).isNull() | (F.size(centroid) != len(query)) | (d - F.col(radius) <= threshold)
    return files.where(keep)


def by_partition(files: DataFrame, value: str | None, column: str = "partition_value") -> DataFrame:
    """Files of one partition value; None means no restriction."""
    return files if value is None else files.where(F.col(column) == value)


def _places(term: Column, hashes: int, words: Column) -> Column:
    """The bits of a term in a filter of ``words`` words: one seeded hash for each of ``hashes`` places."""
    return F.array(*[F.pmod(F.xxhash64(term, F.lit(i)), words * WORD_BITS) for i in range(hashes)])


def bloom_filters(terms: DataFrame, file: str, term: str = "term", rate: float = 0.01) -> DataFrame:
    """(file, bloom): one filter for each file from its distinct terms, an array of 64-bit words.

    The words are sized for the false-positive ``rate``; a term that is in a file is never missed.  Bits are set
    by a grouped ``bit_or``, which combines before its shuffle, so a file of any number of terms is no single task's.  Null terms
    and null files take no part.
    """
    hashes = hash_count(rate)
    each = terms.select(file, term).where(F.col(file).isNotNull() & F.col(term).isNotNull()).distinct()
    bits_per_term = -math.log(rate) / math.log(2) ** 2
    sizes = each.groupBy(file).agg(F.greatest(F.ceil(F.count(F.lit(1)) * bits_per_term / WORD_BITS), F.lit(1)).cast("long").alias("__words"))
    places = each.join(sizes, file).select(file, F.explode(_places(F.col(term), hashes, F.col("__words"))).alias("__at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("__at", F.lit(WORD_BITS)).cast("int"))
    words = places.select(file, F.floor(F.col("__at") / WORD_BITS).alias("__no"), bit.alias("__bits"))
    empty = sizes.select(file, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__words") - 1)).alias("__no"), F.lit(0).cast("long").alias("__bits"))
    words = words.unionByName(empty).groupBy(file, "__no").agg(F.bit_or("__bits").alias("__bits"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("__no", "__bits"))), lambda w: w["__bits"])
    return words.groupBy(file).agg(whole.alias("bloom"))


def hash_count(rate: float) -> int:
    """Places a term for the least filter of this false-positive rate."""
    return max(1, round(-math.log2(rate)))


def may_contain(bloom: Column | str, word: Column | str, rate: float = 0.01) -> Column:
    """Whether a filter of :func:`bloom_filters` with the same ``rate`` may hold a word; looked up in the JVM."""
    bloom = F.col(bloom) if isinstance(bloom, str) else bloom
    places = _places(word if isinstance(word, Column) else F.lit(word), hash_count(rate), F.size(bloom).cast("long"))

    def is_set(at: Column) -> Column:
        held = F.get(bloom, F.floor(at / WORD_BITS).cast("int"))
        return held.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(WORD_BITS)).cast("int"))) != 0

    return F.forall(places, is_set)


def by_bloom(files: DataFrame, words: Iterable[str], column: str = "bloom", rate: float = 0.01) -> DataFrame:
    """Files of which any word may be a term; files without a filter stay, without words none is ruled out."""
    may = F.col(column).isNull() | (F.size(column) == 0)
    wanted = sorted(set(words))
    for w in wanted:
        may = may | may_contain(column, w, rate)
    return files.where(may) if wanted else files
