"""Catalogue: statistics and similarity over embeddings, zonal statistics over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.rules import separability
from furrow.operators import learning as ln
from furrow.session import table


def _rows(spark, sf_dir):
    """Embeddings as whole thousandths, so that sums are exact."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"), "label")


def _features(spark, sf_dir):
    return ln.long_features(_rows(spark, sf_dir), "id", F.col("v"))


def field_moments(spark, sf_dir):
    return ln.field_moments(_features(spark, sf_dir), "f")


def zscore(spark, sf_dir):
    return ln.standardise(_features(spark, sf_dir)).select("id", "f", "z")


def _knn(spark, sf_dir, loo):
    rows = _rows(spark, sf_dir)
    marked = rows.filter("label < 2").withColumn("positive", F.col("label") == 1)
    target = marked if loo else rows.filter("label >= 2")
    return ln.nearest_examples(target, marked.select("id", "v", "positive"), "v", 3, "id", loo).withColumn("score", ln.knn_score(F.col("near")))


def knn_score(spark, sf_dir):
    return _knn(spark, sf_dir, False).select("id", F.round("score", 9).alias("score"))


def similar_candidates(spark, sf_dir):
    return _knn(spark, sf_dir, False).filter("score >= 0.65").select("id", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "id")


def knn_loo(spark, sf_dir):
    k = _knn(spark, sf_dir, True)
    acc = k.agg((F.count_if((F.col("score") >= 0.5) == (F.col("label") == 1)) / F.count("*")).alias("accuracy"), F.count("*").alias("n"))
    return acc.select("n", "accuracy", separability(F.col("accuracy")).alias("verdict"))


def _fit(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("label < 2")
    f = rows.select("id", F.col("label").alias("cls"), F.posexplode("v").alias("f", "x"))
    return ln.centroid_fit(f, 0.05)


def shrunken_weights(spark, sf_dir):
    return _fit(spark, sf_dir).select("f", "c0", "c1", F.round("weight", 9).alias("weight"))


def centroid_score(spark, sf_dir):
    return ln.centroid_score(_rows(spark, sf_dir), _fit(spark, sf_dir), "v").select("id", F.round("score", 9).alias("score"))


def centroid_loo(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("label < 2")
    f = rows.select("id", F.col("label").alias("cls"), F.posexplode("v").alias("f", "x"))
    loo = ln.centroid_loo(f, 0.05)
    return loo.select("n", "accuracy", separability(F.col("accuracy")).alias("verdict"))


def outlier_scan(spark, sf_dir):
    return ln.outlier_scan(_features(spark, sf_dir), 2.5).select("id", F.round("z", 9).alias("z"), "f")


def zonal_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("x"))
    m = li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"), (F.count_if(F.col("x") < 20) / F.count("*")).alias("stressed"))
    q = ln.order_statistic(li, ["l_suppkey"], "x", q10=ln.nearest_rank(0.1), q90=ln.nearest_rank(0.9), p10=ln.floor_rank(0.1), p90=ln.floor_rank(0.9), med=ln.upper_median()).drop("n")
    sd = ln.population_sd(F.col("n"), F.col("s1"), F.col("s2"))
    return m.join(q, "l_suppkey").select("l_suppkey", "n", (F.col("s1") / F.col("n")).alias("mean"), sd.alias("sd"), "stressed", "q10", "q90", "p10", "p90", "med", (F.col("n") >= 30).alias("usable"))


def drivers_by_feature(spark, sf_dir):
    """How often each feature drives an outlier, most frequent first."""
    return outlier_scan(spark, sf_dir).groupBy("f").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "f")


def _labelled(spark, sf_dir):
    """Embeddings as cells: every eleventh can't be measured; label 1 is wanted, 0 is not, others are undecided."""
    return _rows(spark, sf_dir).select("id", "v", (F.col("id") % 11 > 0).alias("usable"), F.when((F.col("label") < 2) & (F.col("id") % 3 == 0), F.col("label")).alias("label"))


def find_similar(spark, sf_dir):
    return ln.find_similar(_labelled(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "candidate")


def similar_ready(spark, sf_dir):
    """Whether labels hold enough marks, a label as the wanted one."""
    rows = _labelled(spark, sf_dir)
    return ln.ready(rows, F.col("label") == 1, (F.col("label") == 0) & (F.col("id") < 60))


def candidate_totals(spark, sf_dir):
    """Area and litres of all candidates, a cell of 36 square metres and more each."""
    c = ln.find_similar(_labelled(spark, sf_dir)).filter("candidate").select("id")
    cells = _rows(spark, sf_dir).select("id", (F.lit(36) + F.col("id") % 5).alias("area_m2")).join(c, "id", "left_semi")
    area = F.coalesce(F.sum("area_m2"), F.lit(0))
    return cells.agg(area.alias("area_m2"), (area / 10_000 * 12.5).alias("volume_l"), F.count("*").alias("count"))


def applied_scores(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    out = ln.apply_scores(rows.select("id"), ln.find_similar(rows), ln.KNN_VERSION, F.lit("2024-01-01T00:00:00Z"))
    return out.select("id", F.round("detection.score", 6).alias("score"), F.col("detection.model_version").alias("model_version"), F.col("detection.scored_at").alias("scored_at"))


def match_report(spark, sf_dir):
    return ln.fit_report(_fit(spark, sf_dir), centroid_loo(spark, sf_dir))


def match_preview(spark, sf_dir):
    """Each row's score by the fitted model; rows that can't be measured have none."""
    rows = _rows(spark, sf_dir).withColumn("usable", F.col("id") % 11 > 0)
    scored = ln.centroid_score(rows.filter("usable"), _fit(spark, sf_dir), "v").select("id", "score")
    return rows.select("id").join(scored, "id", "left").select("id", F.round("score", 9).alias("score"))


def ranked_features(spark, sf_dir):
    return ln.ranked_features(_fit(spark, sf_dir)).select("f", F.round("weight", 9).alias("weight"))


def top_drivers(spark, sf_dir):
    """The three heaviest features of the model, with each row's value."""
    d = ln.explain(_rows(spark, sf_dir).select("id", "v"), _fit(spark, sf_dir))
    return d.select("id", F.posexplode("drivers").alias("place", "d")).select("id", "place", "d.f", "d.value")


_V = "r AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings)"
_F = _V + ", feats AS (SELECT id, label, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS f, unnest(v) AS x FROM r)"
_SD = "sqrt(greatest(0, CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * greatest(1, n - 1) AS DOUBLE)))"
_M = f"moments AS (SELECT f, n, CAST(s1 AS DOUBLE) / n AS mean, {_SD} AS sd FROM (SELECT f, count(*) AS n, CAST(sum(x) AS BIGINT) AS s1, CAST(sum(x * x) AS BIGINT) AS s2 FROM feats GROUP BY f))"
_KNN = """p AS (SELECT a.id, a.label, b.label = 1 AS positive, b.id AS eid, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d2
 FROM r a JOIN r b ON b.label < 2 AND {cond}), t AS (SELECT *, 1 / (d2 + 1e-6::DOUBLE) AS w FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, eid) <= 3),
 k AS (SELECT id, any_value(label) AS label, sum(w) FILTER (positive) AS pos, sum(w) AS total FROM t GROUP BY id), s AS (SELECT id, label, coalesce(pos, 0) / total AS score FROM k)"""
_FIT = (
    f"""fs AS (SELECT f, label, {_SD} AS sd, n, CAST(s1 AS DOUBLE) / n AS mean FROM (SELECT f, label, count(*) AS n, CAST(sum(x) AS BIGINT) AS s1, CAST(sum(x * x) AS BIGINT) AS s2 FROM feats WHERE label < 2 GROUP BY f, label)),
 fp AS (SELECT a.f, a.mean AS c0, b.mean AS c1, sqrt(greatest(0, ((a.n - 1) * a.sd * a.sd + (b.n - 1) * b.sd * b.sd) / greatest(1, a.n + b.n - 2))) AS sd FROM fs a JOIN fs b ON a.f = b.f AND a.label = 0 AND b.label = 1),
 fit AS (SELECT f, c0, c1, greatest(0, abs(c1 - c0) / (sd + (SELECT coalesce(median(sd), 1e-6) FROM fp WHERE sd > 0)) - 0.05::DOUBLE) AS weight FROM fp)"""
)
_OUT = """med AS (SELECT f, list_sort(list(x))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med, count(*) AS n FROM feats GROUP BY f),
 mad AS (SELECT f, med, list_sort(list(abs(x - med)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] * 1.4826::DOUBLE AS mad FROM feats JOIN med USING (f) GROUP BY f, med),
 z AS (SELECT id, f, abs(x - med) / mad AS z FROM feats JOIN mad USING (f) WHERE mad >= 1e-9),
 o AS (SELECT id, round(z, 9) AS z, f FROM z WHERE z >= 2.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY z.z DESC, f) = 1)"""

_SIM = _F + """, lab AS (SELECT id, CASE WHEN label < 2 AND id % 3 = 0 THEN label END AS label FROM r WHERE id % 11 > 0), um AS (SELECT f, CAST(s1 AS DOUBLE) / n AS mean, sqrt(greatest(0, CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * greatest(1, n - 1) AS DOUBLE))) AS sd
 FROM (SELECT f, count(*) AS n, CAST(sum(x) AS BIGINT) AS s1, CAST(sum(x * x) AS BIGINT) AS s2 FROM feats WHERE id % 11 > 0 GROUP BY f)),
 zz AS (SELECT id, list((x - mean) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END ORDER BY f) AS z FROM feats JOIN um USING (f) WHERE id % 11 > 0 GROUP BY id), lz AS (SELECT * FROM zz JOIN lab USING (id)),
 pz AS (SELECT a.id, b.label = 1 AS positive, b.id AS eid, list_sum(list_transform(list_zip(a.z, b.z), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d2 FROM lz a JOIN lz b ON a.label IS NULL AND b.label IS NOT NULL),
 tz AS (SELECT *, 1 / (d2 + 1e-6::DOUBLE) AS w FROM pz QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, eid) <= 3), sim AS (SELECT id, coalesce(sum(w) FILTER (positive), 0) / sum(w) AS score FROM tz GROUP BY id)"""

QUERIES = {
    f.__name__: f
    for f in (field_moments, zscore, knn_score, similar_candidates, knn_loo, shrunken_weights, centroid_score, centroid_loo, outlier_scan, zonal_stats, drivers_by_feature, find_similar, similar_ready, candidate_totals, applied_scores, match_report, match_preview, ranked_features, top_drivers)
}
ORACLES = {
    "find_similar": f"WITH {_SIM} SELECT id, round(score, 6) AS score, score >= 0.65 AS candidate FROM sim",
    "similar_ready": """WITH l AS (SELECT vec_id AS id, CASE WHEN label < 2 AND vec_id % 3 = 0 THEN label END AS label FROM embeddings), n AS (SELECT count(*) FILTER (label = 1) AS wanted, count(*) FILTER (label = 0 AND id < 60) AS unwanted FROM l)
        SELECT wanted, unwanted, wanted >= 3 AND unwanted >= 3 AS ready, concat_ws(' and ', CASE WHEN wanted < 3 THEN (3 - wanted) || ' more wanted' END, CASE WHEN unwanted < 3 THEN (3 - unwanted) || ' more to leave' END) AS missing FROM n""",
    "candidate_totals": f"WITH {_SIM} SELECT CAST(coalesce(sum(36 + id % 5), 0) AS BIGINT) AS area_m2, coalesce(sum(36 + id % 5), 0) / 10000 * 12.5 AS volume_l, count(*) AS count FROM sim WHERE score >= 0.65",
    "applied_scores": f"WITH {_SIM} SELECT r.id, round(score, 6) AS score, CASE WHEN score IS NOT NULL THEN 'knn-1' END AS model_version, CASE WHEN score IS NOT NULL THEN '2024-01-01T00:00:00Z' END AS scored_at FROM r LEFT JOIN sim USING (id)",
    "ranked_features": f"WITH {_F}, {_FIT} SELECT f, round(weight, 9) AS weight FROM fit WHERE weight > 0",
    "top_drivers": f"WITH {_F}, {_FIT}, b AS (SELECT f, CAST(row_number() OVER (ORDER BY weight DESC, f) - 1 AS INTEGER) AS place FROM fit WHERE weight > 0) SELECT id, place, f, x AS value FROM feats JOIN b USING (f) WHERE place < 3",
    "field_moments": f"WITH {_F}, {_M} SELECT f, n, mean, sd FROM moments",
    "zscore": f"WITH {_F}, {_M} SELECT id, f, (x - mean) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END AS z FROM feats JOIN moments USING (f)",
    "knn_score": f"WITH {_V}, {_KNN.format(cond='a.label >= 2')} SELECT id, round(score, 9) AS score FROM s",
    "similar_candidates": f"WITH {_V}, {_KNN.format(cond='a.label >= 2')} SELECT id, round(score, 9) AS score FROM s WHERE score >= 0.65",
    "knn_loo": f"WITH {_V}, {_KNN.format(cond='a.label < 2 AND a.id <> b.id')}, g AS (SELECT count(*) AS n, CAST(count(*) FILTER ((score >= 0.5) = (label = 1)) AS DOUBLE) / count(*) AS accuracy FROM s) SELECT n, accuracy, CASE WHEN accuracy >= 0.9 THEN 'clear' WHEN accuracy >= 0.7 THEN 'weak' ELSE 'indistinguishable' END AS verdict FROM g",
    "shrunken_weights": f"WITH {_F}, {_FIT} SELECT f, c0, c1, round(weight, 9) AS weight FROM fit",
    "centroid_score": f"""WITH {_F}, {_FIT}, w AS (SELECT *, CASE WHEN (SELECT max(weight) FROM fit) > 0 THEN weight ELSE 1 END AS w FROM fit),
        d AS (SELECT id, sqrt(sum(w * (x - c0) * (x - c0))) AS d0, sqrt(sum(w * (x - c1) * (x - c1))) AS d1 FROM feats JOIN w USING (f) GROUP BY id)
        SELECT id, round(CASE WHEN d0 + d1 < 1e-12 THEN 0.5 ELSE d0 / (d0 + d1) END, 9) AS score FROM d""",
    "centroid_loo": f"""WITH {_F}, h AS (SELECT DISTINCT id AS held, label AS hl FROM r WHERE label < 2), q AS (SELECT held, hl, f, label, n, s1, s2, {_SD} AS sd FROM (SELECT held, hl, f, label, count(*) AS n, CAST(sum(x) AS BIGINT) AS s1, CAST(sum(x * x) AS BIGINT) AS s2
        FROM feats JOIN h ON feats.id <> h.held WHERE label < 2 GROUP BY ALL)), p AS (SELECT a.held, a.hl, a.f, CAST(a.s1 AS DOUBLE) / a.n AS c0, CAST(b.s1 AS DOUBLE) / b.n AS c1, sqrt(greatest(0, ((a.n - 1) * a.sd * a.sd + (b.n - 1) * b.sd * b.sd) / greatest(1, a.n + b.n - 2))) AS sd
        FROM q a JOIN q b ON a.held = b.held AND a.f = b.f AND a.label = 0 AND b.label = 1), m AS (SELECT held, coalesce(median(sd) FILTER (sd > 0), 1e-6) AS s0 FROM p GROUP BY held), w AS (SELECT p.*, greatest(0, abs(c1 - c0) / (sd + s0) - 0.05::DOUBLE) AS w FROM p JOIN m USING (held)),
        d AS (SELECT held, hl, sqrt(sum(w * (x - c0) * (x - c0))) AS d0, sqrt(sum(w * (x - c1) * (x - c1))) AS d1 FROM w JOIN feats ON feats.id = held AND feats.f = w.f GROUP BY held, hl),
        g AS (SELECT count(*) AS n, CAST(count(*) FILTER ((d0 / (d0 + d1) >= 0.5) = (hl = 1)) AS DOUBLE) / count(*) AS accuracy FROM d) SELECT n, accuracy, CASE WHEN accuracy >= 0.9 THEN 'clear' WHEN accuracy >= 0.7 THEN 'weak' ELSE 'indistinguishable' END AS verdict FROM g""",
    "outlier_scan": f"WITH {_F}, {_OUT} SELECT * FROM o",
    "drivers_by_feature": f"WITH {_F}, {_OUT} SELECT f, count(*) AS n FROM o GROUP BY f",
    "zonal_stats": """WITH l AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS x FROM lineitem), g AS (SELECT l_suppkey, count(*) AS n, CAST(sum(x) AS BIGINT) AS s1, CAST(sum(x * x) AS BIGINT) AS s2,
        CAST(count(*) FILTER (x < 20) AS DOUBLE) / count(*) AS stressed, list_sort(list(x)) AS v FROM l GROUP BY 1)
        SELECT l_suppkey, n, s1 / n AS mean, sqrt(greatest(0, CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * n AS DOUBLE))) AS sd, stressed,
        v[CAST(floor(0.1::DOUBLE * (n - 1) + 0.5) AS BIGINT) + 1] AS q10, v[CAST(floor(0.9::DOUBLE * (n - 1) + 0.5) AS BIGINT) + 1] AS q90,
        v[least(CAST(floor(n * 0.1::DOUBLE) AS BIGINT), n - 1) + 1] AS p10, v[least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1] AS p90,
        v[CAST(floor(n / 2) AS BIGINT) + 1] AS med, n >= 30 AS usable FROM g""",
}
ORACLES["match_preview"] = "SELECT e.vec_id AS id, s.score FROM embeddings e LEFT JOIN (" + ORACLES["centroid_score"] + ") s ON s.id = e.vec_id AND e.vec_id % 11 > 0"
ORACLES["match_report"] = (
    "SELECT l.n, w.features, w.used, l.accuracy, CASE WHEN used = 0 THEN 'indistinguishable' WHEN accuracy >= 0.9 THEN 'clear' WHEN accuracy >= 0.7 THEN 'weak' ELSE 'indistinguishable' END AS verdict,"
    " CASE WHEN used > 0 AND accuracy >= 0.9 THEN 'Separated by ' || used || ' of ' || features || ' measurements.' WHEN used > 0 AND accuracy >= 0.7 THEN 'Separated in part only.' WHEN used = 0 THEN 'The marked rows look alike.' ELSE 'The two sets can''t be told apart.' END AS message"
    " FROM (" + ORACLES["centroid_loo"] + ") l, (SELECT count(*) AS features, count(*) FILTER (weight > 0) AS used FROM (" + ORACLES["shrunken_weights"] + ")) w"
)
