"""Time: as-of joins, shifts, gaps, layers, fits and frame maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], seconds: str, tolerance: float, right_id: str) -> DataFrame:
    """Each left row with the right row of its keys nearest in time within the tolerance (closed), of equals the earlier, then the least id.

    Both sides have `seconds`; rows meet in buckets of the tolerance, so a key with many rows is never one group.
    """
    bucket = F.floor(F.col(seconds) / tolerance)
    # each left row is one of its own, though others may equal it
    own = left.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("__row"), *[F.col(k) for k in keys], F.col(seconds))
    spread = own.select("*", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    named = right.select(*[F.col(k) for k in keys], bucket.alias("__b"), F.col(seconds).alias("__t"), F.col(right_id).alias("__id"))
    gap = F.abs(F.col(seconds) - F.col("__t"))
    met = spread.join(named, [*keys, "__b"]).filter(gap <= tolerance)
    order = F.struct(gap.alias("gap"), F.col("__t").alias("t"), F.col("__id").alias("id"))
    found = met.groupBy("__row", "row").agg(F.min(order).alias("__m"))
    return found.select("row.*", F.col("__m.id").alias(right_id), F.col("__m.gap").alias("gap"))


def shifted(rows: DataFrame, keys: list[str], order: str, seconds: str, phase: float) -> DataFrame:
    """Times moved by a share of the interval to the next row; the last row uses the interval before it, a single row none."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.lead(seconds).over(w) - F.col(seconds), F.col(seconds) - F.lag(seconds).over(w), F.lit(0.0))
    return rows.withColumn("shifted", F.col(seconds) + phase * step)


def steps(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Difference to the row before, whether it goes back, and the number of backward steps so far."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("step", F.col(value) - F.lag(value).over(w))
    back = F.coalesce(F.col("step") < 0, F.lit(False))
    return out.withColumn("back", back).withColumn("backs", F.sum(F.col("back").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def layers(rows: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Sorted values of a key cut into layers where they rise by more than `gap`."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return rows.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("layer", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")


def line_fits(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of each key with the root mean square and the largest residual."""
    fits = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    off = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    rest = rows.join(fits, keys).groupBy(*keys).agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.max(F.abs(off)).alias("worst"))
    return fits.join(rest, keys)


def mapped_index(rows: DataFrame, frames: DataFrame, keys: list[str], direct: str) -> DataFrame:
    """Video index of each row from the frame map, else the direct one."""
    return rows.join(frames, keys, "left").withColumn("index", F.coalesce("video_idx", direct)).drop("video_idx")


def frame_number(seconds: Column, fps: float, frames: int) -> Column:
    """Half-even frame number of a time, held within the video."""
    return F.greatest(F.lit(0), F.least(F.lit(frames - 1), F.rint(seconds * fps).cast("long")))


def fitted(best: DataFrame, keys: list[str], x: str, y: str, spread: float = 3.0) -> DataFrame:
    """(keys, slope, intercept, used): a line through the best candidates of each group, fitted again without those far off the first one.

    Far off are residuals beyond `spread` times the median absolute one, and beyond 1. A group of one x has slope 1
    through its means.
    """

    def line(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("used"))
        slope = F.coalesce("slope", F.lit(1.0))
        return found.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), "used")

    off = F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    away = best.join(line(best), keys).withColumn("off", off)
    limit = away.groupBy(*keys).agg((spread * F.percentile("off", F.lit(0.5))).alias("limit"))
    return line(away.join(limit, keys).filter(F.col("off") <= F.greatest("limit", F.lit(1.0))).select(*best.columns))


#: Time models, in the order in which the first of equally good ones is chosen.
TIME_MODELS = ("direct", "rate", "compressed", "affine")


def time_models(candidates: DataFrame, poses: DataFrame, frames: int, rate: float = 10.0) -> DataFrame:
    """(frame_id, cam_id, model, predicted, distance, rank, loss, exact) of each probe under each model.

    Candidates (frame_id, cam_id, video_idx, score) belong to probes (frame_id, cam_id), poses (frame_id, ts) give
    times. A model predicts a video index: the frame itself, the time since the first probed frame at `rate`, that
    time stretched over the video's `frames`, or the camera's line (see fitted) through the best candidates, rounded half
    to even and held within the video. `distance` is that to the probe's nearest candidate, of equals the best, `rank`
    and `loss` are the latter's place by score and what its score falls short of the best.
    """
    probe = ["frame_id", "cam_id"]
    order = Window.partitionBy(*probe).orderBy(F.desc("score"), "video_idx")
    ranked = candidates.withColumns({"rank": F.row_number().over(order), "top": F.max("score").over(Window.partitionBy(*probe))})
    lines = fitted(ranked.filter("rank = 1").select(*probe, "video_idx"), ["cam_id"], "frame_id", "video_idx")
    probes = candidates.select(*probe).distinct().join(poses.select("frame_id", "ts"), "frame_id")
    span = probes.agg(F.min_by("ts", "frame_id").alias("first"), F.max_by("ts", "frame_id").alias("last"))
    # one row
    timed = probes.join(F.broadcast(span)).join(lines, "cam_id")
    since = F.col("ts") - F.col("first")
    raw = (F.col("frame_id").cast("double"), since * rate, since / F.greatest(F.col("last") - F.col("first"), F.lit(1e-9)) * (frames - 1), F.col("slope") * F.col("frame_id") + F.col("intercept"))
    held = [F.struct(F.lit(n).alias("model"), F.greatest(F.lit(0.0), F.least(F.lit(frames - 1.0), F.rint(v))).cast("long").alias("predicted")) for n, v in zip(TIME_MODELS, raw, strict=True)]
    spread = timed.select(*probe, F.explode(F.array(*held)).alias("m")).select(*probe, "m.model", "m.predicted")
    met = spread.join(ranked, probe)
    away = F.abs(F.col("video_idx") - F.col("predicted"))
    best = met.groupBy(*probe, "model", "predicted").agg(F.min(F.struct(away.alias("distance"), "rank", (F.col("top") - F.col("score")).alias("loss"))).alias("b"))
    return best.select(*probe, "model", "predicted", "b.distance", "b.rank", "b.loss", (F.col("b.distance") == 0).alias("exact"))


def chosen_models(judged: DataFrame, most_median: float, least_exact: float) -> DataFrame:
    """(cam_id, model, median, exact): of each camera the model of least median distance among those that pass both gates, of equals the first of TIME_MODELS; direct if none does."""
    found = judged.groupBy("cam_id", "model").agg(F.percentile("distance", F.lit(0.5)).alias("median"), F.avg(F.col("exact").cast("int")).alias("exact"))
    place = F.array_position(F.array(*map(F.lit, TIME_MODELS)), F.col("model"))
    passed = (F.col("median") <= most_median) & (F.col("exact") >= least_exact)
    named = found.withColumns({"fails": F.when(passed, 0).when(F.col("model") == "direct", 1).otherwise(2), "place": place})
    best = named.groupBy("cam_id").agg(F.min(F.struct("fails", F.when(F.col("fails") == 0, F.col("median")).alias("m"), "place", "model", "median", "exact")).alias("b"))
    return best.select("cam_id", "b.model", "b.median", "b.exact")


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Run-length encoding: (start, length) of each run of equal values along the order, numbered from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0)))
    grouped = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "run").agg(F.min(order).alias("start"), F.count("*").alias("length"), F.first(value).alias(value))


def quantile_of_sorted(values: Column, q: float) -> Column:
    """The value at index round-half-even((n - 1) q) of a group's sorted values."""
    held = F.array_sort(F.collect_list(values))
    return F.element_at(held, (F.rint((F.size(held) - 1) * F.lit(q)) + 1).cast("int"))


def bands(rows: DataFrame, keys: list[str], value: str, size: float, least: int) -> DataFrame:
    """`rows` with `band`: the first bin of the stretch of neighbouring bins, each of at least `least` rows, that holds the value; null elsewhere."""
    binned = rows.withColumn("bin", F.floor(F.col(value) / size))
    dense = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy("bin")
    first = F.when(F.coalesce(F.col("bin") - F.lag("bin").over(w), F.lit(2)) > 1, F.col("bin"))
    named = dense.withColumn("first", first).withColumn("band", F.last("first", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return binned.join(named.select(*keys, "bin", "band"), [*keys, "bin"], "left")
