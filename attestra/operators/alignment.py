"""Alignment of page pairs from descriptors, keypoints or sizes given as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attestra.functions.geometry import project
from attestra.functions.scores import clip
from attestra.sources.tables import bounded_batches, written

# Ratio of a match to the second best, least matches and inliers, largest error of an inlier, largest corner movement that snaps.
RATIO, MIN_GOOD, MIN_INLIERS, MAX_ERROR, SNAP = 0.76, 10, 8, 4.0, 0.75
#: Descriptors nearer than this have an equal band; keypoints of a page with one band up to which they meet over it.
SURE, CROWD = 16, 64
#: Keypoints of a candidate page up to which the reference's are held against all of them.
DIRECT = 128
#: Rounds in which a fit is weighted anew.
FIT_ROUNDS = 5
# Names of methods.
IDENTICAL, HOMOGRAPHY, SNAPPED, BY_SIZE = "exact_pixel_identity", "orb_homography", "orb_identity_snap", "page_dimension_fallback"


def matrix(*nine: Column | float) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in nine])


def identity() -> Column:
    return matrix(1, 0, 0, 0, 1, 0, 0, 0, 1)


def by_size(rw: Column, rh: Column, cw: Column, ch: Column) -> tuple[Column, Column]:
    """(matrix, quality) from page sizes alone."""
    a, b = rw / rh, cw / ch
    error = F.abs(a - b) / F.greatest(a, b)
    return matrix(cw / rw, 0, 0, 0, ch / rh, 0, 0, 0, 1), clip(0.65 - 2.5 * error, 0.25, 0.65)


def hamming(a: str, b: str) -> Column:
    """Bits in which the descriptors a.d0..d3 and b.d0..d3 differ."""
    each = [F.bit_count(F.col(f"{a}.d{i}").bitwiseXOR(F.col(f"{b}.d{i}"))) for i in range(4)]
    return each[0] + each[1] + each[2] + each[3]


def bands(points: DataFrame) -> DataFrame:
    """pair_id, kp_id, band, value and d: a row for each of a descriptor's sixteen parts of 16 bits."""
    parts = [F.shiftright(f"d{i}", 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(4) for k in range(4)]
    return points.select("pair_id", "kp_id", F.struct("d0", "d1", "d2", "d3").alias("d"), F.posexplode(F.array(*parts)).alias("band", "value"))


def band_candidates(reference: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, kp_r, kp_c, distance of keypoints with an equal band; pair_id, kp_r of those that share a crowded band and must be held
    against all). Two descriptors that differ in fewer than sixteen bits have an equal band."""
    of = bands(candidate)
    crowded = of.groupBy("pair_id", "band", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    own = bands(reference)
    many = own.join(crowded, ["pair_id", "band", "value"]).select("pair_id", F.col("kp_id").alias("kp_r")).distinct()
    free = own.withColumnRenamed("kp_id", "kp_r").join(many, ["pair_id", "kp_r"], "left_anti")
    key = ["pair_id", "band", "value"]
    met = free.alias("x").join(of.alias("y"), key).select("pair_id", "kp_r", F.col("y.kp_id").alias("kp_c"), F.col("x.d").alias("a"), F.col("y.d").alias("b"))
    return met.groupBy("pair_id", "kp_r", "kp_c").agg(F.any_value(hamming("a", "b")).alias("distance")), many


def _best_of_page(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """pair_id, kp_r, kp_c, distance of the best match that beats its second, each keypoint held against all of its page. On one partitioning by page."""
    order = Window.partitionBy("pair_id", "kp_r").orderBy("distance", "kp_c")
    met = reference.alias("r").join(candidate.alias("c"), "pair_id").select("pair_id", "kp_r", F.col("c.kp_id").alias("kp_c"), hamming("r", "c").alias("distance"))
    two = met.withColumns({"rank": F.row_number().over(order), "second": F.lead("distance").over(order)})
    return two.where((F.col("rank") == 1) & (F.col("distance") < RATIO * F.col("second"))).select("pair_id", "kp_r", "kp_c", "distance")


def ratio_matches(reference: DataFrame, candidate: DataFrame, direct: int = DIRECT) -> DataFrame:
    """pair_id, kp_r, kp_c, distance of each reference keypoint's best match that beats its second by the ratio.

    Both: pair_id, kp_id, d0..d3 (256 bits as four longs). On pages with up to `direct` candidate keypoints each meets all of them: a bounded number, and less than
    its bands have rows. On larger ones keypoints meet over equal bands of their bits, which finds all that are nearer than
    SURE bits. That settles a keypoint if its two nearest are, or if its nearest beats even a second at SURE bits; those it does
    not settle, and those with a band that more than CROWD keypoints of the page have, meet all of the page.
    """
    reference = reference.withColumnRenamed("kp_id", "kp_r")
    sized = candidate.withColumn("n", F.count("*").over(Window.partitionBy("pair_id")))
    found = _best_of_page(reference, sized.where(F.col("n") <= direct))
    large = written(sized.where(F.col("n") > direct), "large")
    if large.isEmpty():
        return found
    reference = reference.join(large.select("pair_id").distinct(), "pair_id", "left_semi")
    near, _ = band_candidates(reference.withColumnRenamed("kp_r", "kp_id"), large)
    order = Window.partitionBy("pair_id", "kp_r").orderBy("distance", "kp_c")
    size = large.select("pair_id", "n").distinct()
    first = near.withColumns({"rank": F.row_number().over(order), "second": F.lead("distance").over(order)}).where((F.col("rank") == 1) & (F.col("distance") < SURE)).join(size, "pair_id")
    known = F.coalesce(F.col("second") < SURE, F.lit(False))
    beats = F.col("distance") < RATIO * F.when(known, F.col("second")).otherwise(F.lit(SURE))
    settled = written(first.withColumn("beats", beats & (F.col("n") > 1)).where(known | beats | (F.col("n") == 1)).select("pair_id", "kp_r", "kp_c", "distance", "beats"), "settled")
    rest = reference.join(settled, ["pair_id", "kp_r"], "left_anti")
    return found.unionByName(settled.where("beats").select(found.columns)).unionByName(_best_of_page(rest, large))


def fitted(points: DataFrame, *keys: str) -> DataFrame:
    """points (keys, rx, ry, cx, cy) with `matrix`, the affine map from (rx, ry) to (cx, cy) of each key, by weighted least squares.

    The first weights favour points that move like the median; each round then weighs a point down by its distance from the last
    fit, so points that moved on their own lose their say. The normal equations are sums over a key's points: windows on
    one partitioning, no join. Points on one line only give a shift.
    """
    all_ = Window.partitionBy(*keys)
    weight = lambda square: f"1 / pow(1 + ({square}) / {MAX_ERROR**2}, 2)"
    out = points.withColumns({"_dx": F.percentile(F.col("cx") - F.col("rx"), F.lit(0.5)).over(all_), "_dy": F.percentile(F.col("cy") - F.col("ry"), F.lit(0.5)).over(all_)})
    out = out.withColumn("_w", F.expr(weight("pow(cx - rx - _dx, 2) + pow(cy - ry - _dy, 2)")))
    terms = {"_1": "1", "_x": "rx", "_y": "ry", "_u": "cx", "_v": "cy", "_xx": "rx * rx", "_xy": "rx * ry", "_yy": "ry * ry", "_xu": "rx * cx", "_yu": "ry * cx", "_xv": "rx * cy", "_yv": "ry * cy"}
    for _ in range(FIT_ROUNDS):
        out = out.withColumns({k: F.sum(F.expr(f"_w * ({v})")).over(all_) for k, v in terms.items()})
        # Moments about the mean, then the two unknowns of each side by Cramer's rule.
        out = out.withColumns({f"_c{a}{b}": F.expr(f"_{a}{b} / _1 - _{a} * _{b} / (_1 * _1)") for a, b in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")})
        out = out.withColumn("_det", F.expr("CASE WHEN _cxx * _cyy - _cxy * _cxy > 1e-9 * pow(_cxx + _cyy, 2) THEN _cxx * _cyy - _cxy * _cxy END"))
        solved = {"_a": ("_cxu * _cyy - _cyu * _cxy", 1), "_b": ("_cyu * _cxx - _cxu * _cxy", 0), "_d": ("_cxv * _cyy - _cyv * _cxy", 0), "_e": ("_cyv * _cxx - _cxv * _cxy", 1)}
        out = out.withColumns({k: F.expr(f"coalesce(({up}) / _det, {rest}D)") for k, (up, rest) in solved.items()})
        out = out.withColumns({"_c": F.expr("(_u - _a * _x - _b * _y) / _1"), "_f": F.expr("(_v - _d * _x - _e * _y) / _1")})
        out = out.withColumn("_w", F.expr(weight("pow(_a * rx + _b * ry + _c - cx, 2) + pow(_d * rx + _e * ry + _f - cy, 2)")))
    nine = [F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"), F.col("_e"), F.col("_f"), 0, 0, 1]
    return out.select(*points.columns, matrix(*nine).alias("matrix"))


def _medians(values: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of each group's values; of: each value's group, in order; n: values of each group (NaN where there are none)."""
    values, start = values[np.lexsort((values, of))], np.cumsum(n) - n
    some, out = n > 0, np.full(len(n), np.nan)
    out[some] = (values[(start + (n - 1) // 2)[some]] + values[(start + n // 2)[some]]) / 2
    return out


def _fits(rx: np.ndarray, ry: np.ndarray, cx: np.ndarray, cy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The six numbers of each page's affine map as fitted() fits it, its inliers and their median error (NaN without one). n: points of each page, which lie
    behind one another."""
    page, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    weight = lambda square: 1 / (1 + square / MAX_ERROR**2) ** 2
    w = weight(sum((v - _medians(v, page, n)[page]) ** 2 for v in (cx - rx, cy - ry)))
    for _ in range(FIT_ROUNDS):
        total = lambda *of: np.add.reduceat(np.prod((w, *of), axis=0), start)  # noqa: B023, E731
        one, x, y, u, v = total(), total(rx), total(ry), total(cx), total(cy)
        about = lambda p, q, a, b: total(p, q) / one - a * b / (one * one)  # noqa: B023, E731
        xx, xy, yy, xu, yu, xv, yv = about(rx, rx, x, x), about(rx, ry, x, y), about(ry, ry, y, y), about(rx, cx, x, u), about(ry, cx, y, u), about(rx, cy, x, v), about(ry, cy, y, v)
        det = xx * yy - xy * xy
        told = det > 1e-9 * (xx + yy) ** 2
        det = np.where(told, det, 1.0)
        a, b, d, e = (np.where(told, up / det, rest) for up, rest in ((xu * yy - yu * xy, 1.0), (yu * xx - xu * xy, 0.0), (xv * yy - yv * xy, 0.0), (yv * xx - xv * xy, 1.0)))
        six = a, b, (u - a * x - b * y) / one, d, e, (v - d * x - e * y) / one
        p = [k[page] for k in six]
        square = (p[0] * rx + p[1] * ry + p[2] - cx) ** 2 + (p[3] * rx + p[4] * ry + p[5] - cy) ** 2
        w = weight(square)
    error = np.sqrt(square)
    near = error <= MAX_ERROR
    inliers = np.bincount(page[near], minlength=len(n))
    return np.column_stack(six), inliers, _medians(error[near], page[near], inliers)


def fitted_pages(points: DataFrame, *keys: str) -> DataFrame:
    """keys, matrix and what reprojection() tells of it, a row for each page of points (keys, rx, ry, cx, cy): as reprojection() of fitted(), for pages, which
    have a bounded number of points. Each page's points come as one row, and the pages of a batch are fitted together."""
    return fitted_rows(points.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("rx", "ry", "cx", "cy")])).alias("points")), *keys)


def fitted_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """fitted_pages() of rows of keys and points (an array of rx, ry, cx, cy)."""
    bounded_batches(rows.sparkSession)
    added = T.StructType.fromDDL("matrix array<double>, match_count long, inliers long, inlier_ratio double, reprojection_error double")
    schema = T.StructType([*rows.schema.fields[:-1], *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(len(keys))
            each, n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
            six, inliers, error = _fits(*[each.field(c).to_numpy(zero_copy_only=False) for c in ("rx", "ry", "cx", "cy")], n)
            nine = np.column_stack((six, np.tile((0.0, 0.0, 1.0), (len(n), 1))))
            told = (list(nine), n, inliers, inliers / n, np.where(inliers > 0, error, MAX_ERROR))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(v, k) for v, k in zip(told, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def reprojection(points: DataFrame, *keys: str) -> DataFrame:
    """keys (pair_id), match_count, inliers, inlier_ratio, reprojection_error (median over inliers) of matched points.

    points: keys, rx, ry, cx, cy, matrix.
    """
    keys = keys or ("pair_id",)
    p = project(F.col("rx"), F.col("ry"), F.col("matrix"))
    error = F.sqrt(F.pow(p.x - F.col("cx"), 2) + F.pow(p.y - F.col("cy"), 2))
    each = points.withColumn("error", error).withColumn("inlier", F.col("error") <= MAX_ERROR)
    out = each.groupBy(*keys).agg(
        F.count("*").alias("match_count"), F.count_if("inlier").alias("inliers"), F.percentile(F.when(F.col("inlier"), F.col("error")), F.lit(0.5)).alias("median")
    )
    return out.select(*keys, "match_count", "inliers", (F.col("inliers") / F.col("match_count")).alias("inlier_ratio"), F.coalesce("median", F.lit(MAX_ERROR)).alias("reprojection_error"))


def passes_gates(match_count: Column, inliers: Column) -> Column:
    return (match_count >= MIN_GOOD) & (inliers >= MIN_INLIERS)


def corners(w: Column, h: Column, m: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(project(zero, zero, m), project(w, zero, m), project(w, h, m), project(zero, h, m))


def plausible(m: Column, rw: Column, rh: Column, cw: Column, ch: Column) -> Column:
    """Finite, not degenerate, corners within 15 % of the page, area within 0.65 to 1.35 of it."""
    finite = F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.abs(F.get(m, F.lit(8))) >= 1e-8)
    # Bound once by the transform of an array of one, as each corner is looked at several times.
    inside = lambda c: F.forall(c, lambda p: p.x.isNotNull() & p.y.isNotNull()) & (F.array_min(F.transform(c, lambda p: p.x)) >= -0.15 * cw) & (F.array_max(F.transform(c, lambda p: p.x)) <= 1.15 * cw) & (F.array_min(F.transform(c, lambda p: p.y)) >= -0.15 * ch) & (F.array_max(F.transform(c, lambda p: p.y)) <= 1.15 * ch)
    twice = lambda c: F.aggregate(F.zip_with(c, F.concat(F.slice(c, 2, 3), F.slice(c, 1, 1)), lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda s, v: s + v)
    fits = F.transform(F.array(corners(rw.cast("double"), rh.cast("double"), m)), lambda c: inside(c) & (F.abs(twice(c)) / 2 / F.greatest(cw * ch, F.lit(1.0))).between(0.65, 1.35))
    return finite & F.coalesce(F.get(fits, F.lit(0)), F.lit(False))


def corner_displacement(m: Column, w: Column, h: Column) -> Column:
    """The farthest that a page corner moves."""
    w, h, zero = w.cast("double"), h.cast("double"), F.lit(0.0)
    own = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])
    return F.array_max(F.zip_with(corners(w, h, m), own, lambda p, q: F.sqrt(F.pow(p.x - q.x, 2) + F.pow(p.y - q.y, 2))))


def match_quality(inlier_ratio: Column, match_count: Column, error: Column) -> Column:
    strength = F.least(F.lit(1.0), match_count / 100.0)
    return clip(0.30 + 0.40 * inlier_ratio + 0.15 * strength + 0.15 * F.greatest(F.lit(0.0), 1.0 - error / 8.0), 0.0, 1.0)


def align(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys (pair_id), matrix, method, quality, match_count, inlier_ratio, reprojection_error of each pair: identity, then matches, then sizes.

    pairs: keys, rw, rh, cw, ch, identical, and from matching (null if there was none) m, match_count, inliers, inlier_ratio, error.
    """
    rw, rh, cw, ch = (F.col(c).cast("double") for c in ("rw", "rh", "cw", "ch"))
    sized, size_quality = by_size(rw, rh, cw, ch)
    usable = F.col("m").isNotNull() & F.coalesce(passes_gates(F.col("match_count"), F.col("inliers")), F.lit(False)) & plausible(F.col("m"), rw, rh, cw, ch)
    snaps = (rw == cw) & (rh == ch) & (corner_displacement(F.col("m"), rw, rh) < SNAP)
    pairs = pairs.withColumns({"_usable": usable, "_snaps": F.coalesce(snaps, F.lit(False))})
    snaps = F.col("_snaps")
    pick = lambda same, matched, rest: F.when(F.col("identical"), same).when(F.col("_usable"), matched).otherwise(rest)
    return pairs.select(
        *(keys or ("pair_id",)),
        pick(identity(), F.when(snaps, identity()).otherwise(F.col("m")), sized).alias("matrix"),
        pick(F.lit(IDENTICAL), F.when(snaps, SNAPPED).otherwise(HOMOGRAPHY), F.lit(BY_SIZE)).alias("method"),
        pick(F.lit(1.0), match_quality(F.col("inlier_ratio"), F.col("match_count"), F.col("error")), size_quality).alias("quality"),
        pick(F.lit(0), F.col("match_count"), F.lit(0)).cast("long").alias("match_count"),
        pick(F.lit(1.0), F.col("inlier_ratio"), F.lit(0.0)).alias("inlier_ratio"),
        pick(F.lit(0.0), F.col("error"), F.lit(None).cast("double")).alias("reprojection_error"),
    )


def warp(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Reference cells in the candidate's frame, bilinear, white outside. frames: pair_id, width, height, inverse (matrix).

    cells: pair_id, x, y, gray. Every target cell asks for its four neighbours, an equi-join on the cell.
    """
    target = frames.select("pair_id", "inverse", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    target = target.select("pair_id", "inverse", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    at = target.withColumn("p", project(F.col("x").cast("double"), F.col("y").cast("double"), F.col("inverse")))
    fx, fy = F.floor("p.x"), F.floor("p.y")
    ax, ay = F.col("p.x") - fx, F.col("p.y") - fy
    four = [(fx, fy, (1 - ax) * (1 - ay)), (fx + 1, fy, ax * (1 - ay)), (fx, fy + 1, (1 - ax) * ay), (fx + 1, fy + 1, ax * ay)]
    asked = at.select("pair_id", "x", "y", F.explode(F.array(*[F.struct(a.cast("int").alias("sx"), b.cast("int").alias("sy"), w.alias("w")) for a, b, w in four])).alias("s"))
    asked = asked.select("pair_id", "x", "y", "s.sx", "s.sy", "s.w").where("w > 0")
    source = cells.select("pair_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "gray")
    met = asked.join(source, ["pair_id", "sx", "sy"], "left")
    return met.groupBy("pair_id", "x", "y").agg(F.floor(F.sum(F.col("w") * F.coalesce("gray", F.lit(255))) + 0.5).cast("int").alias("gray"))
