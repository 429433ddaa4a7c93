"""Queries over frame tables: events in time order are the frames of a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupaudit.operators import signals as sg
from groupaudit.plans import fixtures as fx
from groupaudit.plans.q_metrics import r
from groupaudit.plans.registry import query

_ISLANDS = """f AS (SELECT user_id, event_id, value, value <= 0.10 * max(value) OVER (PARTITION BY user_id) AS s FROM events),
  g AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS ps FROM f),
  h AS (SELECT *, sum(CASE WHEN s AND NOT coalesce(ps, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g),
  k AS (SELECT user_id, run, count(*) AS len FROM h WHERE s GROUP BY ALL),
  kk AS (SELECT user_id, count(*) AS n, avg(len) AS mean, max(len) AS mx FROM k GROUP BY 1),
  b AS (SELECT user_id, count(*) AS n_frames, count(*) FILTER (s) AS sil, count(*) FILTER (s <> ps) AS ch FROM h GROUP BY 1)"""


@query(
    "w08_silence_runs",
    f"""WITH {_ISLANDS} SELECT user_id, n_frames, round(sil / n_frames, 6) AS silence_ratio, CAST(coalesce(n, 0) AS DOUBLE) AS n_pauses, round(coalesce(mean, 0) * 0.01::DOUBLE, 6) AS mean_pause_s,
      round(coalesce(mx, 0) * 0.01::DOUBLE, 6) AS max_pause_s, round(ln(1 + n_frames * 0.01::DOUBLE), 6) AS log_duration, round((n_frames - sil) * 0.01::DOUBLE, 6) AS speech_s, CAST(ch AS DOUBLE) AS n_transitions
    FROM b LEFT JOIN kk USING (user_id)""",
)
def w08(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id", "value")
    out = sg.silence_features(e, rec="user_id", frame="event_id", energy="value")
    return out.select("user_id", "n_frames", r("silence_ratio"), "n_pauses", r("mean_pause_s"), r("max_pause_s"), r("log_duration"), r("speech_s"), "n_transitions")


@query(
    "w09_jitter_shimmer",
    """WITH v AS (SELECT user_id, event_id, 1 / (60 + k) AS t, value AS a FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'click'),
      l AS (SELECT *, lag(t) OVER w AS pt, lag(a) OVER w AS pa FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      g AS (SELECT user_id, count(*) AS n, avg(abs(t - pt)) / avg(t) AS j, avg(abs(a - pa)) / avg(a) AS s FROM l GROUP BY 1)
    SELECT u.user_id, coalesce(n, 0) AS n_voiced, CASE WHEN n >= 3 THEN round(j, 6) END AS jitter, CASE WHEN n >= 3 THEN round(s, 6) END AS shimmer, coalesce(n, 0) < 3 AS too_few_voiced
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g USING (user_id)""",
)
def w09(spark, d):
    f = fx.recordings(spark, d).select(
        "speaker_id", "recording_id", (F.col("k") + 60).cast("double").alias("f0"), F.col("duration").alias("amp"), (F.col("task") == "click").alias("voiced")
    )
    out = sg.perturbation(f, rec="speaker_id", frame="recording_id", f0="f0", amp="amp", voiced="voiced")
    return out.select(F.col("speaker_id").alias("user_id"), "n_voiced", r("jitter"), r("shimmer"), "too_few_voiced")


@query(
    "w09_hnr",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(3 + vec_id % 9 AS BIGINT) AS lag FROM embeddings),
      c AS (SELECT vec_id, lag, list_transform(x, lambda v: v - list_avg(x)) AS x FROM a),
      q AS (SELECT vec_id, list_inner_product(x[1:64 - lag], x[lag + 1:64]) / list_inner_product(x, x) AS r FROM c),
      cl AS (SELECT vec_id, least(greatest(r, 1e-6), 1 - 1e-6::DOUBLE) AS r FROM q)
    SELECT vec_id, round(10 * log10(r / (1 - r)), 4) AS hnr_db FROM cl""",
)
def w09_hnr(spark, d):
    e = fx.table(spark, d, "embeddings")
    lag = (3 + F.col("vec_id") % 9).cast("int")
    return e.select("vec_id", F.round(sg.hnr_db("embedding", lag), 4).alias("hnr_db"))


@query(
    "w10_track_functionals",
    """WITH f AS (SELECT user_id, event_id, value AS v, event_type <> 'error' AS on_, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS dl FROM events)
    SELECT user_id, round(avg(v) FILTER (on_), 6) AS mean, round(stddev_pop(v) FILTER (on_), 6) AS std, round(count(*) FILTER (on_) / count(*), 6) AS voiced_fraction,
      round(avg(abs(dl)), 6) AS mean_abs_flux, round(sqrt(avg(v * v)), 6) AS rms, round(stddev_pop(dl), 6) AS delta_std,
      round(quantile_cont(v, 0.2) FILTER (on_), 6) AS p20, round(quantile_cont(v, 0.5) FILTER (on_), 6) AS p50, round(quantile_cont(v, 0.8) FILTER (on_), 6) AS p80 FROM f GROUP BY 1""",
)
def w10(spark, d):
    f = fx.table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") != "error").alias("voiced"))
    out = sg.track_functionals(f, rec="user_id", frame="event_id", value="value", voiced="voiced")
    return out.select("user_id", *[r(c) for c in ("mean", "std", "voiced_fraction", "mean_abs_flux", "rms", "delta_std", "p20", "p50", "p80")])


_SLOPE = " + ".join(f"{k} * (lead(e, {k}) OVER w - lag(e, {k}) OVER w)" for k in range(1, 5))


@query(
    "w10_coefficient_functionals",
    f"""WITH f AS (SELECT label AS rec, vec_id, unnest(embedding[1:13])::DOUBLE AS e, unnest(range(13)) AS dim FROM embeddings WHERE label IS NOT NULL),
      s AS (SELECT rec, dim, e, row_number() OVER w AS i, count(*) OVER (PARTITION BY rec, dim) AS n, ({_SLOPE}) / 60 AS slope FROM f WINDOW w AS (PARTITION BY rec, dim ORDER BY vec_id)),
      d AS (SELECT *, CASE WHEN i < 5 THEN max(slope) FILTER (i = 5) OVER p WHEN i > n - 4 THEN max(slope) FILTER (i = n - 4) OVER p ELSE slope END AS delta FROM s WINDOW p AS (PARTITION BY rec, dim))
    SELECT rec, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(CASE WHEN count(*) > 9 THEN stddev_pop(delta) ELSE 0 END, 6) AS delta_std FROM d GROUP BY ALL""",
)
def w10_coefficients(spark, d):
    f = fx.table(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("label").alias("rec"), "vec_id", F.slice("embedding", 1, 13).alias("x"))
    out = sg.coefficient_functionals(f, rec="rec", frame="vec_id", vector="x")
    long = out.select("rec", "n", F.posexplode("mean").alias("dim", "mean"), "std", "delta_std")
    at = lambda c: F.round(F.get(c, F.col("dim")), 6).alias(c)
    return long.select("rec", "dim", "n", r("mean"), at("std"), at("delta_std"))


@query(
    "w11_frame_pooling",
    f"""WITH {fx.FEATURES}, v AS (SELECT speaker_id, recording_id, x, sqrt(list_inner_product(x, x)) AS nrm FROM features WHERE recording_id % 7 <> 0),
      s AS (SELECT speaker_id, avg(nrm) AS m, sqrt(greatest(var_pop(nrm), 1e-10)) AS sd, max(nrm) AS top FROM v GROUP BY 1),
      w AS (SELECT v.speaker_id, x, exp((nrm - top) / sd) AS w FROM v JOIN s USING (speaker_id)),
      u AS (SELECT speaker_id, w, unnest(x) AS e, unnest(range(64)) AS dim FROM w)
    SELECT speaker_id, CAST(dim AS INTEGER) AS dim, round(avg(e), 6) AS mean, round(sqrt(greatest(var_pop(e), 1e-10)), 6) AS std, round(sum(w * e) / sum(w), 6) AS attention FROM u GROUP BY ALL""",
)
def w11(spark, d):
    f = fx.features(spark, d).withColumn("valid", F.col("recording_id") % 7 != 0)
    pool = lambda how: sg.pool_frames(f, rec="speaker_id", vector="x", valid="valid", pooling=how)
    both = pool("mean_std").join(pool("attention").withColumnRenamed("pooled", "att"), "speaker_id")
    long = both.select("speaker_id", F.posexplode(F.slice("pooled", 1, 64)).alias("dim", "mean"), "pooled", "att")
    return long.select(
        "speaker_id", "dim", r("mean"), F.round(F.get("pooled", F.col("dim") + 64), 6).alias("std"), F.round(F.get("att", F.col("dim")), 6).alias("attention")
    )
