"""Moments, order statistics, similarity scoring, shrunken centroids and outliers.

Features come as long rows (id, f, x) or as arrays; whole-number features make every sum exact, so
results don't depend on the order in which tasks add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.session import ensure_checkpoint_dir

#: Labelled examples that are broadcast at once, and rows that meet them in one product.
EXAMPLES_EACH, ROWS_EACH = 16_384, 256
DELTA = 0.5
#: Equal widths that a key's values fall into before any are sorted.
VALUE_BINS = 256
OUTLIER_Z, OUTLIER_MIN_ROWS, MAD_SCALE = 3.5, 8, 1.4826


def long_features(rows: DataFrame, id_col: str, vector: Column) -> DataFrame:
    """(id, f, x), one row a feature."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(vector).alias("f", "x"))


def sample_sd(n: Column, s1: Column, s2: Column) -> Column:
    """Sample deviation from count, sum and sum of squares; 0 for one row."""
    return F.sqrt(F.greatest(F.lit(0.0), (n * s2 - s1 * s1).cast("double") / (n * F.greatest(F.lit(1), n - 1)).cast("double")))


def population_sd(n: Column, s1: Column, s2: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), (n * s2 - s1 * s1).cast("double") / (n * n).cast("double")))


def field_moments(features: DataFrame, *keys: str) -> DataFrame:
    """Count, mean and sample deviation by key; map-side sums, so hot features don't skew."""
    sums = features.groupBy(*keys).agg(F.count("x").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    return sums.select(*keys, "n", (s1.cast("double") / n).alias("mean"), sample_sd(n, s1, s2).alias("sd"))


def standardise(features: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Append z by the moments of the whole field; a constant feature has deviation 1."""
    m = field_moments(features, "f").select("f", "mean", F.when(F.col("sd") > floor, F.col("sd")).otherwise(F.lit(1.0)).alias("sd"))
    return features.join(m, "f").withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))


def order_statistic(rows: DataFrame, keys: list[str], value: str, **ranks: Column) -> DataFrame:
    """Exact elements of each key's sorted values: name -> rank from 0, as a Column of `n`. Rows with a null key or value take no part.

    Works on the histogram of values, which is pre-aggregated before the shuffle. Values fall into VALUE_BINS equal widths a key;
    counts of the bins tell which of them hold the ranks, and only those are sorted, each on its own, so few keys with very
    many values still spread.
    """
    known = F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    hist = rows.filter(known).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    reach = hist.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("__c").alias("n"))
    share = (F.col(value) - F.col("__lo")).cast("double") / (F.col("__hi") - F.col("__lo")).cast("double")
    bin_ = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor(share * VALUE_BINS), F.lit(VALUE_BINS - 1))).otherwise(F.lit(0).cast("long"))
    placed = hist.join(reach, keys).withColumn("__bin", bin_)
    bins = placed.groupBy(*keys, "__bin", "n").agg(F.sum("__c").alias("__b"))
    before = F.sum("__b").over(Window.partitionBy(*keys).orderBy("__bin")) - F.col("__b")  # at most VALUE_BINS rows a key
    held = [(F.col("__from") <= r) & (r < F.col("__from") + F.col("__b")) for r in ranks.values()]
    wanted = bins.withColumn("__from", before)
    some = held[0]
    for h in held[1:]:
        some = some | h
    wanted = wanted.filter(some).select(*keys, "__bin", "__from")
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__bin").orderBy(value)) + F.col("__from")
    found = placed.join(wanted, [*keys, "__bin"]).withColumn("__upto", upto)
    pick = [F.min(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__c") <= r), F.col(value))).alias(name) for name, r in ranks.items()]
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *pick)


def nearest_rank(q: float) -> Column:
    """round(q (n - 1)), half up."""
    return F.floor(F.lit(q) * (F.col("n") - 1) + 0.5)


def floor_rank(p: float) -> Column:
    """floor(n p), at most n - 1."""
    return F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)


def upper_median() -> Column:
    return F.floor(F.col("n") / 2)


def nearest_examples(rows: DataFrame, examples: DataFrame, vector: str, k: int, id_col: str, leave_out_self: bool) -> DataFrame:
    """Append `near`: the k closest examples as (d2, id, positive), ties to the smaller id.

    Examples are marks of an operator. They are broadcast in blocks of at most EXAMPLES_EACH rows, so any number works; a batch
    of rows meets a block as one product of matrices, and only the best k so far go on to the next block. Distances of
    whole numbers are exact.
    """
    spark = rows.sparkSession
    near = T.ArrayType(T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("positive", T.BooleanType())]))
    out = rows.withColumn("near", F.array().cast(near))
    ids = [f.name for f in rows.schema].index(id_col)
    at = [f.name for f in rows.schema].index(vector)

    names = out.columns

    def chained(df: DataFrame, block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, positive, matrix = block.value
            squares = (matrix * matrix).sum(axis=1)
            for whole in batches:
                for begin in range(0, whole.num_rows, ROWS_EACH):
                    batch = whole.slice(begin, ROWS_EACH)
                    v = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, -1)
                    d2 = np.maximum(0.0, (v * v).sum(axis=1)[:, None] + squares - 2 * (v @ matrix.T))
                    if leave_out_self:
                        d2[batch.column(ids).to_numpy()[:, None] == own] = np.inf
                    found = []
                    for row, before in zip(d2, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                        few = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                        best = [(float(row[i]), int(own[i]), bool(positive[i])) for i in few[np.isfinite(row[few])]]
                        best = sorted([(b["d2"], b["id"], b["positive"]) for b in before] + best)[:k]
                        found.append([{"d2": a, "id": b, "positive": c} for a, b, c in best])
                    kind = pa.list_(pa.struct([("d2", pa.float64()), ("id", pa.int64()), ("positive", pa.bool_())]))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=names)

        return df.mapInArrow(run, df.schema)

    def blocks() -> Iterator[list]:
        held = []
        for r in examples.select(id_col, "positive", vector).toLocalIterator():
            held.append(r)
            if len(held) == EXAMPLES_EACH:
                yield held
                held = []
        if held:
            yield held

    def shared(held: list):
        return spark.sparkContext.broadcast((np.array([r[0] for r in held]), np.array([r[1] for r in held]), np.array([list(r[2]) for r in held], float)))

    found = blocks()
    held, after = next(found, []), next(found, None)
    while after is not None:  # several blocks: each one's best are checkpointed before the next, so the plan doesn't grow
        ensure_checkpoint_dir(spark)
        block = shared(held)
        out = chained(out, block).checkpoint()
        block.destroy()
        held, after = after, next(found, None)
    return chained(out, shared(held)) if held else out


def knn_score(near: Column) -> Column:
    """Weighted share of positives, weights 1 / (d2 + 1e-6); 0 without neighbours."""
    w = F.transform(near, lambda e: 1 / (e["d2"] + F.lit(1e-6)))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    pos = F.aggregate(F.zip_with(near, w, lambda e, x: F.when(e["positive"], x).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, pos / total).otherwise(F.lit(0.0))


def centroid_fit(features: DataFrame, delta: float = DELTA) -> DataFrame:
    """(f, c0, c1, weight) of two classes from rows (id, f, x, cls): soft-thresholded relevance of each feature."""
    sums = features.groupBy("f", "cls").agg(F.count("x").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    side = lambda c, name: F.max(F.when(F.col("cls") == c, F.col(name)))
    wide = sums.groupBy("f").agg(*[side(c, k).alias(f"{k}_{c}") for c in (0, 1) for k in ("n", "s1", "s2")])
    n0, n1 = F.col("n_0"), F.col("n_1")
    sd = lambda c: sample_sd(F.col(f"n_{c}"), F.col(f"s1_{c}"), F.col(f"s2_{c}"))
    pooled = F.sqrt(F.greatest(F.lit(0.0), ((n0 - 1) * sd(0) * sd(0) + (n1 - 1) * sd(1) * sd(1)) / F.greatest(F.lit(1), n0 + n1 - 2)))
    fit = wide.select("f", (F.col("s1_0").cast("double") / n0).alias("c0"), (F.col("s1_1").cast("double") / n1).alias("c1"), pooled.alias("sd"))
    # One number from as many rows as there are features, a fixed few.
    s0 = fit.filter("sd > 0").agg(F.coalesce(F.median("sd"), F.lit(1e-6)).alias("s0"))
    t = F.abs(F.col("c1") - F.col("c0")) / (F.col("sd") + F.col("s0"))
    return fit.join(F.broadcast(s0)).select("f", "c0", "c1", F.greatest(F.lit(0.0), t - delta).alias("weight"))


def centroid_score(rows: DataFrame, fit: DataFrame, vector: str) -> DataFrame:
    """Append the distance ratio d0 / (d0 + d1); the model is one row of arrays, as wide as the features."""
    packed = fit.agg(F.array_sort(F.collect_list(F.struct("f", "c0", "c1", "weight"))).alias("m"))
    live = F.exists("m", lambda e: e["weight"] > 0)
    plus = lambda s, x: s + x

    def d(c: str) -> Column:
        part = F.zip_with(F.col(vector), F.col("m"), lambda x, e: F.when(F.col("live"), e["weight"]).otherwise(F.lit(1.0)) * (x - e[c]) * (x - e[c]))
        return F.sqrt(F.aggregate(part, F.lit(0.0), plus))

    scored = rows.join(F.broadcast(packed)).withColumn("live", live).withColumns({"d0": d("c0"), "d1": d("c1")})
    total = F.col("d0") + F.col("d1")
    return scored.withColumn("score", F.when(total < 1e-12, F.lit(0.5)).otherwise(F.col("d0") / total)).drop("m", "live", "d0", "d1")


def robust_baseline(features: DataFrame) -> DataFrame:
    """(f, n, med, mad) by upper medians, mad scaled to a normal deviation."""
    med = order_statistic(features, ["f"], "x", med=upper_median()).select("f", "n", "med")
    dev = features.join(F.broadcast(med.select("f", "med")), "f").select("f", F.abs(F.col("x") - F.col("med")).alias("d"))
    mad = order_statistic(dev, ["f"], "d", mad=upper_median()).select("f", (F.col("mad") * MAD_SCALE).alias("mad"))
    return med.join(mad, "f")


def outlier_scan(features: DataFrame, threshold: float = OUTLIER_Z) -> DataFrame:
    """(id, z, f) of rows whose largest robust z reaches the threshold; the first feature wins ties."""
    base = robust_baseline(features).filter((F.col("mad") >= 1e-9) & (F.col("n") >= OUTLIER_MIN_ROWS))
    z = features.join(F.broadcast(base), "f").select("id", "f", (F.abs(F.col("x") - F.col("med")) / F.col("mad")).alias("z"))
    best = z.groupBy("id").agg(F.max("z").alias("z"), F.max_by("f", F.struct("z", -F.col("f"))).alias("f"))
    return best.filter(F.col("z") >= threshold)


def centroid_loo(features: DataFrame, delta: float = DELTA) -> DataFrame:
    """(n, accuracy) of the centroid model with each row (id, f, x, cls) held out in turn.

    Holding a row out only takes its values from its class's sums, so no model is fitted anew: the work
    is one row for each mark and feature. A fold that loses a class counts half.
    """
    sums = features.groupBy("f", "cls").agg(F.count("x").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    side = lambda c, name: F.max(F.when(F.col("cls") == c, F.col(name)))
    wide = sums.groupBy("f").agg(*[F.coalesce(side(c, k), F.lit(0)).alias(f"{k}_{c}") for c in (0, 1) for k in ("n", "s1", "s2")])
    x = F.col("x")
    own = lambda c, v: F.when(F.col("cls") == c, v).otherwise(F.lit(0))
    left = {f"{k}{c}": F.col(f"{k}_{c}") - own(c, v) for c in (0, 1) for k, v in (("n", F.lit(1)), ("s1", x), ("s2", x * x))}
    rows = features.join(wide, "f").select("id", "f", "x", "cls", *[v.alias(k) for k, v in left.items()])
    n0, n1 = F.col("n0"), F.col("n1")
    var = lambda c: F.pow(sample_sd(F.col(f"n{c}"), F.col(f"s1{c}"), F.col(f"s2{c}")), F.lit(2))
    pooled = F.sqrt(F.greatest(F.lit(0.0), ((n0 - 1) * var(0) + (n1 - 1) * var(1)) / F.greatest(F.lit(1), n0 + n1 - 2)))
    whole = rows.filter((n0 > 0) & (n1 > 0)).select("id", "f", "x", "cls", (F.col("s10") / n0).alias("c0"), (F.col("s11") / n1).alias("c1"), pooled.alias("sd"))
    s0 = whole.groupBy("id").agg(F.coalesce(F.median(F.when(F.col("sd") > 0, F.col("sd"))), F.lit(1e-6)).alias("s0"))
    w = whole.join(s0, "id").withColumn("w", F.greatest(F.lit(0.0), F.abs(F.col("c1") - F.col("c0")) / (F.col("sd") + F.col("s0")) - delta))
    far = lambda c, weight: F.sqrt(F.sum(weight * (x - F.col(c)) * (x - F.col(c))))
    d = w.groupBy("id", "cls").agg(F.max("w").alias("top"), far("c0", F.col("w")).alias("a0"), far("c1", F.col("w")).alias("a1"), far("c0", F.lit(1.0)).alias("b0"), far("c1", F.lit(1.0)).alias("b1"))
    d0, d1 = F.when(F.col("top") > 0, F.col("a0")).otherwise(F.col("b0")), F.when(F.col("top") > 0, F.col("a1")).otherwise(F.col("b1"))
    score = F.when(d0 + d1 < 1e-12, F.lit(0.5)).otherwise(d0 / (d0 + d1))
    right = d.select(((score >= 0.5).cast("int") == F.col("cls")).cast("double").alias("right"))
    total = features.select("id").distinct().agg(F.count("*").alias("n"))
    hits = right.agg(F.coalesce(F.sum("right"), F.lit(0.0)).alias("hits"), F.count("*").alias("m"))
    accuracy = F.when(F.col("n") >= 3, (F.col("hits") + (F.col("n") - F.col("m")) * 0.5) / F.col("n")).otherwise(F.lit(0.0))
    return total.join(F.broadcast(hits)).select("n", accuracy.alias("accuracy"))


#: Marks a class needs before a vote means anything, the score from which a cell is like the wanted ones, and the versions
#: that scores are stored with. Fixed values.
MARKS_EACH, SIMILAR_FROM, NEIGHBOURS = 3, 0.65, 3
KNN_VERSION, MATCH_VERSION = "knn-1", "match-1"


def standard_rows(rows: DataFrame, usable: Column, vector: str = "v", floor: float = 1e-9) -> DataFrame:
    """The usable rows with their vector in deviations from the usable field's means; the model is one row as wide as the features."""
    kept = rows.filter(usable)
    m = field_moments(kept.select(F.posexplode(vector).alias("f", "x")), "f")
    packed = m.agg(F.array_sort(F.collect_list(F.struct("f", "mean", F.when(F.col("sd") > floor, F.col("sd")).otherwise(F.lit(1.0)).alias("sd")))).alias("__m"))
    z = F.zip_with(F.col(vector), F.col("__m"), lambda x, e: (x - e["mean"]) / e["sd"])
    return kept.join(F.broadcast(packed)).withColumn(vector, z).drop("__m")


def ready(rows: DataFrame, wanted: Column, unwanted: Column) -> DataFrame:
    """One row: marks of both kinds, whether they are enough, and what is missing."""
    n = rows.agg(F.count_if(wanted).alias("wanted"), F.count_if(unwanted).alias("unwanted"))
    w, u = F.greatest(F.lit(0), MARKS_EACH - F.col("wanted")), F.greatest(F.lit(0), MARKS_EACH - F.col("unwanted"))
    more = F.concat_ws(" and ", F.when(w > 0, F.concat(w.cast("string"), F.lit(" more wanted"))), F.when(u > 0, F.concat(u.cast("string"), F.lit(" more to leave"))))
    return n.select("wanted", "unwanted", ((w == 0) & (u == 0)).alias("ready"), more.alias("missing"))


def find_similar(rows: DataFrame, threshold: float = SIMILAR_FROM, k: int = NEIGHBOURS) -> DataFrame:
    """(id, score, candidate) of the undecided rows, from rows (id, v, usable, label: 1 wanted, 0 not, null undecided).

    Rows that couldn't be measured are left out and not counted as unlike; without MARKS_EACH marks of either kind, or without a
    measured example of either, there are no rows.
    """
    enough = rows.agg((F.count_if(F.col("label") == 1) >= MARKS_EACH).alias("a"), (F.count_if(F.col("label") == 0) >= MARKS_EACH).alias("b"),
                      F.count_if(F.col("usable") & (F.col("label") == 1)).alias("p"), F.count_if(F.col("usable") & (F.col("label") == 0)).alias("q")).first()
    z = standard_rows(rows, F.col("usable")).select("id", "v", "label")
    marked = z.filter("label IS NOT NULL").select("id", "v", (F.col("label") == 1).alias("positive"))
    open_rows = z.filter("label IS NULL")
    if not (enough.a and enough.b and enough.p and enough.q):
        open_rows, marked = open_rows.limit(0), marked.limit(0)
    near = nearest_examples(open_rows.select("id", "v"), marked, "v", k, "id", False)
    return near.select("id", knn_score(F.col("near")).alias("score")).withColumn("candidate", F.col("score") >= threshold)


def apply_scores(rows: DataFrame, scores: DataFrame, version: str, scored_at: Column, id_col: str = "id") -> DataFrame:
    """Rows with `detection` (score, version, time) of those that were scored; the others keep what they had."""
    found = F.struct(F.col("__score").alias("score"), F.lit(version).alias("model_version"), scored_at.alias("scored_at"))
    old = F.col("detection") if "detection" in rows.columns else F.lit(None)
    joined = rows.join(scores.select(F.col(id_col), F.col("score").alias("__score")), id_col, "left")
    return joined.withColumn("detection", F.when(F.col("__score").isNotNull(), found).otherwise(old)).drop("__score")


def fit_report(fit: DataFrame, loo: DataFrame) -> DataFrame:
    """One row: how many features count, the accuracy, the verdict (nothing counts: indistinguishable) and its message kind."""
    used = fit.agg(F.count("*").alias("features"), F.count_if(F.col("weight") > 0).alias("used"))
    j = used.join(F.broadcast(loo.select("n", "accuracy")))
    verdict = F.when(F.col("used") == 0, "indistinguishable").when(F.col("accuracy") >= 0.9, "clear").when(F.col("accuracy") >= 0.7, "weak").otherwise("indistinguishable")
    said = F.when(verdict == "clear", F.concat(F.lit("Separated by "), F.col("used").cast("string"), F.lit(" of "), F.col("features").cast("string"), F.lit(" measurements.")))
    said = said.when(verdict == "weak", "Separated in part only.").when(F.col("used") == 0, "The marked rows look alike.").otherwise("The two sets can't be told apart.")
    return j.select("n", "features", "used", "accuracy", verdict.alias("verdict"), said.alias("message"))


def ranked_features(fit: DataFrame) -> DataFrame:
    """Features that count, the heaviest first."""
    return fit.filter("weight > 0").select("f", "weight").orderBy(F.col("weight").desc(), "f")


def explain(rows: DataFrame, fit: DataFrame, vector: str = "v", limit: int = 3) -> DataFrame:
    """Append `drivers`: the heaviest features that count, with the row's value of each."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "f")))
    packed = fit.filter("weight > 0").agg(F.slice(best, 1, limit).alias("__best"))
    return rows.join(F.broadcast(packed)).withColumn("drivers", F.transform("__best", lambda e: F.struct(e["f"].alias("f"), F.get(F.col(vector), e["f"]).alias("value")))).drop("__best")
