"""Frame tables to recording features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupaudit.functions import arrays as arr
from groupaudit.operators.metrics import ratio
from groupaudit.operators.ranks import exact_percentiles, running_before


def silence_features(
    frames: DataFrame, *, rec: str, frame: str, energy: str, frame_s: float = 0.01, rel: float = 0.10, min_frames: int = 3
) -> DataFrame:
    """Seven pause statistics per recording from an energy track.

    A frame is silent at or below ``rel`` of its recording's own peak.  Recordings with too few
    frames keep their row with NULL features.
    """
    peak = frames.groupBy(rec).agg(F.max(energy).alias("_peak"), F.count("*").alias("n_frames"))
    f = frames.select(rec, frame, energy).join(peak, rec)
    f = f.withColumn("_s", (F.col(energy) <= rel * F.col("_peak")).cast("int"))
    f = running_before(f, part=[rec], order=frame, tie=frame, last={"_prev": "_s"})
    start = ((F.col("_s") == 1) & F.coalesce(F.col("_prev") == 0, F.lit(True))).cast("int")
    change = F.coalesce((F.col("_s") != F.col("_prev")).cast("int"), F.lit(0))
    f = f.withColumn("_start", start).withColumn("_change", change)
    f = running_before(f, part=[rec], order=frame, tie=frame, sums={"_run": "_start"})
    # frames of one silent run share the number of run starts up to and including themselves
    runs = (
        f.where("_s = 1")
        .groupBy(rec, (F.col("_run") + F.col("_start")).alias("_run"))
        .agg(F.count("*").alias("_len"))
        .groupBy(rec)
        .agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), F.max("_len").alias("_max"))
    )
    base = f.groupBy(rec, "n_frames").agg(F.sum("_s").alias("_sil"), F.sum("_change").alias("_changes"))
    ok = F.col("n_frames") >= min_frames
    val = lambda c: F.when(ok, c)
    zero = F.lit(0)
    return base.join(runs, rec, "left").select(
        rec,
        "n_frames",
        val(F.col("_sil") / F.col("n_frames")).alias("silence_ratio"),
        val(F.coalesce("_n", zero).cast("double")).alias("n_pauses"),
        val(F.coalesce(F.col("_mean"), zero) * frame_s).alias("mean_pause_s"),
        val(F.coalesce(F.col("_max"), zero) * frame_s).alias("max_pause_s"),
        val(F.log1p(F.col("n_frames") * frame_s)).alias("log_duration"),
        val((F.col("n_frames") - F.col("_sil")) * frame_s).alias("speech_s"),
        val(F.col("_changes").cast("double")).alias("n_transitions"),
    )


def perturbation(frames: DataFrame, *, rec: str, frame: str, f0: str, amp: str, voiced: str, min_voiced: int = 3) -> DataFrame:
    """Jitter and shimmer over consecutive voiced frames; NULL with a flag below ``min_voiced``.

    A missing measurement is not a perfectly steady voice, so it never becomes 0.
    """
    v = frames.where(F.col(voiced)).select(rec, frame, (1 / F.greatest(F.col(f0), F.lit(1e-6))).alias("_t"), F.col(amp).alias("_a"))
    v = running_before(v, part=[rec], order=frame, tie=frame, last={"_pt": "_t", "_pa": "_a"})
    g = v.groupBy(rec).agg(
        F.count("*").alias("n_voiced"),
        ratio(F.avg(F.abs(F.col("_t") - F.col("_pt"))), F.avg("_t")).alias("_jit"),
        ratio(F.avg(F.abs(F.col("_a") - F.col("_pa"))), F.avg("_a")).alias("_shi"),
    )
    ok = F.coalesce(F.col("n_voiced"), F.lit(0)) >= min_voiced
    return (
        frames.select(rec).distinct().join(g, rec, "left").select(
            rec,
            F.coalesce("n_voiced", F.lit(0)).alias("n_voiced"),
            F.when(ok, F.col("_jit")).alias("jitter"),
            F.when(ok, F.col("_shi")).alias("shimmer"),
            (~ok).alias("too_few_voiced"),
        )
    )


def hnr_db(segment: str | Column, lag: Column) -> Column:
    """Harmonics-to-noise ratio of one frame: autocorrelation of the centred samples at the F0 lag."""
    seg = F.col(segment) if isinstance(segment, str) else segment
    n = F.size(seg)
    x = F.transform(seg, lambda v: v.cast("double") - arr.mean(seg))
    energy = arr.dot(x, x)
    r = F.try_divide(arr.dot(F.slice(x, F.lit(1), n - lag), F.slice(x, lag + 1, n - lag)), energy)
    r = F.least(F.greatest(r, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when((lag > 0) & (lag < n) & (energy > 0), 10 * F.log10(r / (1 - r)))


def track_functionals(frames: DataFrame, *, rec: str, frame: str, value: str, voiced: str) -> DataFrame:
    """Mean, std, p20/p50/p80 over voiced frames, voiced fraction, mean |flux|, RMS, delta std."""
    on = frames.where(F.col(voiced))
    pct = exact_percentiles(on, by=[rec], value=value, qs={"p20": 0.2, "p50": 0.5, "p80": 0.8}).drop("n")
    seq = running_before(frames.select(rec, frame, value, voiced), part=[rec], order=frame, tie=frame, last={"_prev": value})
    v = F.when(F.col(voiced), F.col(value))
    delta = F.col(value) - F.col("_prev")
    g = seq.groupBy(rec).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.count_if(F.col(voiced)) / F.count("*")).alias("voiced_fraction"),
        F.avg(F.abs(delta)).alias("mean_abs_flux"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
        F.stddev_pop(delta).alias("delta_std"),
    )
    return g.join(pct, rec, "left")


def vector_functionals(frames: DataFrame, *, by: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """Per-group mean and population std of an array column, map-side combined."""
    vec = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    d = frames.select(*by, vec.alias("_v"), *([weight] if weight else []))
    stats = Summarizer.metrics("mean", "variance", "count")
    s = stats.summary(F.col("_v"), F.col(weight)) if weight else stats.summary(F.col("_v"))
    g = d.groupBy(*by).agg(s.alias("_s"))
    n = F.col("_s.count")
    var = vector_to_array("_s.variance")
    return g.select(
        *by,
        n.alias("n"),
        vector_to_array("_s.mean").alias("mean"),
        F.transform(var, lambda x: F.sqrt(x * (n - 1) / n)).alias("std"),
    )


DELTA_HALF = 4  # frames to either side of a slope's regression window
CELL = 4096  # frames of one recording in one task


def frame_slopes(frames: DataFrame, *, rec: str, frame: str, vector: str) -> DataFrame:
    """(rec, slope, repeats): regression slope of every coefficient over nine frames around each frame.

    The first and last window give the slopes of the four frames outside them, hence ``repeats``.
    Recordings of at most nine frames have none.  Positions come from prefix counts; cells of them share
    their border frames, so that a long recording spreads and no slope is lost between cells.
    """
    h = DELTA_HALF
    d = frames.select(F.col(rec).alias("_r"), F.col(frame).alias("_f"), F.transform(vector, lambda x: x.cast("double")).alias("_x"))
    # prefix counts need no vectors
    at = running_before(d.select("_r", "_f").withColumn("_one", F.lit(1)), part=["_r"], order="_f", tie="_f", sums={"_at": "_one"})
    sizes = d.groupBy("_r").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * h + 1)
    rows = d.join(at.select("_r", "_f", "_at"), ["_r", "_f"]).join(sizes, "_r")
    own = F.floor(F.col("_at") / CELL)
    cells = F.array_distinct(F.array(own, F.floor(F.greatest(F.col("_at") - h, F.lit(0)) / CELL), F.floor((F.col("_at") + h) / CELL)))
    spread = rows.select("*", own.alias("_own"), F.explode(cells).alias("_cell"))
    order = Window.partitionBy("_r", "_cell").orderBy("_at")
    weighted = lambda k: F.zip_with(F.lead("_x", k).over(order), F.lag("_x", k).over(order), lambda a, b: k * (a - b))
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [weighted(k) for k in range(1, h + 1)])
    scale = 2 * sum(k * k for k in range(1, h + 1))
    slopes = spread.select("_r", "_at", "_n", "_own", "_cell", F.transform(total, lambda x: x / scale).alias("slope"))
    inner = (F.col("_cell") == F.col("_own")) & F.col("_at").between(h, F.col("_n") - h - 1)
    edge = lambda c: F.when(c, h).otherwise(0)
    repeats = 1 + edge(F.col("_at") == h) + edge(F.col("_at") == F.col("_n") - h - 1)
    return slopes.where(inner).select(F.col("_r").alias(rec), "slope", repeats.alias("repeats"))


def coefficient_functionals(frames: DataFrame, *, rec: str, frame: str, vector: str) -> DataFrame:
    """(rec, n, mean, std, delta_std): per coefficient, over the frames of each recording."""
    level = vector_functionals(frames, by=[rec], vector=vector)
    slopes = frame_slopes(frames, rec=rec, frame=frame, vector=vector)
    every = slopes.select(rec, F.explode(F.array_repeat("slope", F.col("repeats"))).alias("slope"))
    spread = vector_functionals(every, by=[rec], vector="slope").select(rec, F.col("std").alias("delta_std"))
    none = F.transform("mean", lambda _: F.lit(0.0))  # too short for a regression window
    return level.join(spread, rec, "left").select(rec, "n", "mean", "std", F.coalesce("delta_std", none).alias("delta_std"))


def pool_frames(frames: DataFrame, *, rec: str, vector: str, valid: str, pooling: str) -> DataFrame:
    """Pool valid frames: ``mean``, ``mean_std`` (concatenated) or parameter-free ``attention``.

    Attention weights are a softmax of the z-scored frame norms, shifted by the largest z.
    """
    f = frames.where(F.col(valid)).select(rec, vector)
    if pooling in ("mean", "mean_std"):
        g = vector_functionals(f, by=[rec], vector=vector)
        std = F.transform("std", lambda x: F.sqrt(F.greatest(x * x, F.lit(1e-10))))
        return g.select(rec, F.col("mean").alias("pooled") if pooling == "mean" else F.concat("mean", std).alias("pooled"))
    if pooling != "attention":
        raise ValueError(f"unknown pooling {pooling!r}")
    f = f.withColumn("_norm", arr.l2_norm(vector))
    s = f.groupBy(rec).agg(
        F.avg("_norm").alias("_m"), F.greatest(F.var_pop("_norm"), F.lit(1e-10)).alias("_v"), F.max("_norm").alias("_top")
    )
    w = F.exp((F.col("_norm") - F.col("_top")) / F.sqrt("_v"))
    g = vector_functionals(f.join(s, rec).withColumn("_w", w), by=[rec], vector=vector, weight="_w")
    return g.select(rec, F.col("mean").alias("pooled"))
