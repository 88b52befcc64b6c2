"""Mixing sources to target weights, in the order of a curriculum.

Each source has a weight that may vary with the training time t in [0, 1], by any piecewise linear schedule, scaled so that
its integral over all of training is the source's share.  The integral up to t is the source's cumulative demand; the tokens of its documents, laid end to end, are placed where the
demand reaches them, which gives each copy of a document its position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.tokens import count_column
from lodevec.session import cut_lineage

MAX_TARGETS = 100_000
BUCKETS = 1024


def source_name(col: Column) -> Column:
    """One spelling of a source: lower case, trimmed, blanks and dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")


def sized_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(key, source, tokens): documents with a source and at least one token of the public vocabulary."""
    rows = documents.where(F.col(source).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key), source_name(F.col(source)).alias("source"), count_column(path).asNondeterministic()(F.col(text)).alias("tokens"))
    # a function called nondeterministic is not run a second time below the projection, for the filter
    return rows.where((F.col("tokens") > 0) & (F.col("source") != ""))


def lay_out(sized: DataFrame, key: str = "doc_id", seed: int = 11, buckets: int = BUCKETS) -> DataFrame:
    """Add ``before``: tokens of the source's documents that come before this one, in an order fixed by a hash of the key.

    The sum runs within buckets of the hash and over the buckets' sums (one row each), so that a source with a
    third of all documents is no single task's.
    """
    h = sized.withColumn("h", F.xxhash64(F.lit(seed), key)).withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    inside = Window.partitionBy("source", "b").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    sums = h.groupBy("source", "b").agg(F.sum("tokens").alias("t"))
    over = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "b", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("outer"))
    return h.join(sums, ["source", "b"]).select(key, "source", "tokens", (F.col("inner") + F.col("outer")).alias("before"))


def plan_demand(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Tokens wanted of each source of each mix: (mix_name, source, target_share, max_repeats, available, demand).

    Without ``total_tokens`` a mix is as large as all its sources can fill at their exact shares (shares of sources that
    are absent from the corpus go to the others in proportion).  With it, sources that cannot fill
    theirs give all they may, and the others make up for them in proportion.  The targets are a table of
    settings; more than 100,000 of them fail.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("long"))
    wanted = wanted.where((F.col("target_share") > 0) & F.col("mix_name").isNotNull() & F.col("source").isNotNull())
    wanted = wanted.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(have, "source", "left").orderBy("mix_name", "source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError("too many targets")
    out, mixes = [], {}
    for r in rows:
        mixes.setdefault(r["mix_name"], []).append(r)
    for mix, sources in mixes.items():
        can = {r["source"]: (r["available"] or 0) * max(r["max_repeats"] or 1, 0) for r in sources}
        share = {r["source"]: r["target_share"] for r in sources if can[r["source"]] > 0}
        demand = {r["source"]: 0.0 for r in sources}
        if share and total_tokens is None:
            unit = min(can[s] / w for s, w in share.items())
            demand |= {s: w * unit for s, w in share.items()}
        elif share:
            left, open_ = float(total_tokens), dict(share)
            while open_ and left > 0:
                unit = left / sum(open_.values())
                full = [s for s, w in open_.items() if w * unit >= can[s]]
                for s in full or list(open_):
                    demand[s] = min(open_.pop(s) * unit, can[s])
                    left -= demand[s] if full else 0
                if not full:
                    break
        for r in sources:
            s = r["source"]
            out.append((mix, s, r["target_share"], r["max_repeats"], r["available"] or 0, float(demand[s])))
    return sized.sparkSession.createDataFrame(out, "mix_name string, source string, target_share double, max_repeats long, available long, demand double")


def schedule_segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, length, weight at the start, weight at the end, demand before) of each piece of a schedule, scaled so that the demand of all training is 1.

    A schedule is a list of (time, weight) with times from 0 to 1 and weights of zero or more, linear between them and constant before the first and after the last.
    """
    points = sorted((float(t), float(w)) for t, w in schedule)
    if not points or any(not 0 <= t <= 1 or not 0 <= w < float("inf") for t, w in points):
        raise ValueError("a schedule needs (time, weight) with times from 0 to 1 and weights of zero or more")
    points = [(0.0, points[0][1]), *points, (1.0, points[-1][1])]
    pieces = [(a, b - a, v, w) for (a, v), (b, w) in zip(points, points[1:]) if b > a]
    whole = sum(h * (v + w) / 2 for _, h, v, w in pieces)
    if whole <= 0:
        raise ValueError("a schedule needs a weight above zero")
    out, before = [], 0.0
    for a, h, v, w in pieces:
        out.append((a, h, v / whole, w / whole, before))
        before += h * (v + w) / 2 / whole
    return out


def position(fill: Column, segments: Column) -> Column:
    """Time at which the cumulative demand reaches ``fill``: the integral of the weight, which is quadratic in each piece, inverted."""
    reached = F.filter(segments, lambda s: s["before"] <= fill)

    def inside(s: Column) -> Column:
        rest = F.greatest(fill - s["before"], F.lit(0.0))
        slope = (s["last"] - s["first"]) / s["length"]
        root = s["first"] + F.sqrt(F.greatest(s["first"] * s["first"] + 2 * slope * rest, F.lit(0.0)))
        return s["start"] + F.least(F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0)), s["length"])

    # the last piece that has begun, but one without any demand is only waited through
    return F.get(F.transform(F.slice(reached, -1, 1), inside), F.lit(0))


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    schedules: dict[str, Sequence[tuple[float, float]]] | None = None,
    total_tokens: int | None = None,
    key: str = "doc_id",
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The selection and the report.

    ``schedules`` gives sources a weight over the training time, see :func:`schedule_segments`; others have an even one.

    Selection: (mix_name, source, key, copy_no, tokens, position), a row for each copy, sorted by position over range
    partitions.  A document comes up to ``max_repeats`` times; all documents of a source come equally often, but for one
    time more for the first ones of its layout, cut where half the document at the edge is reached.  Report: (mix_name,
    source, target_share, actual_share, n_docs, n_copies, tokens, max_repeats), also for sources that are absent (zeros).
    """
    sized = cut_lineage(sized_documents(documents, key, path=path))
    demand = plan_demand(sized, targets, total_tokens)
    given = [(s, [tuple(x) for x in schedule_segments(v)]) for s, v in (schedules or {}).items()]
    pieces = "array<struct<start:double,length:double,first:double,last:double,before:double>>"
    even = F.array(F.struct(*[F.lit(x).alias(n) for n, x in zip(("start", "length", "first", "last", "before"), (0.0, 1.0, 1.0, 1.0, 0.0))]))
    times = documents.sparkSession.createDataFrame(given, f"source string, segments {pieces}")
    wanted = demand.where("demand > 0").join(F.broadcast(times), "source", "left").withColumn("segments", F.coalesce("segments", even))  # settings, as the targets
    laid = lay_out(sized, key)
    rows = laid.join(wanted, "source")
    middle = F.col("before") + F.col("tokens") / 2
    full = F.floor(F.col("demand") / F.col("available"))
    copies = F.least(full + (middle < F.col("demand") - full * F.col("available")).cast("long"), F.col("max_repeats"))
    rows = rows.withColumn("copies", copies).where("copies > 0")
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    fill = F.least(((F.col("copy_no") - 1) * F.col("available") + middle) / F.col("demand"), F.lit(1.0))
    rows = rows.withColumn("fill", fill)
    rows = rows.withColumn("position", position(F.col("fill"), F.col("segments")))
    chosen = rows.select("mix_name", "source", key, "copy_no", "tokens", "position")
    sums = chosen.groupBy("mix_name", "source").agg(F.sum((F.col("copy_no") == 1).cast("long")).alias("n_docs"), F.count(F.lit(1)).alias("n_copies"), F.sum("tokens").alias("t"))
    report = demand.join(sums, ["mix_name", "source"], "left").na.fill(0, ["n_docs", "n_copies", "t"])
    whole = F.sum("t").over(Window.partitionBy("mix_name"))
    report = report.select(
        "mix_name", "source", "target_share", F.when(whole > 0, F.col("t") / whole).otherwise(0.0).alias("actual_share"), "n_docs", "n_copies", F.col("t").alias("tokens"), "max_repeats"
    )
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chosen.repartitionByRange(n, "mix_name", "position").sortWithinPartitions("mix_name", "position", key, "copy_no"), report
