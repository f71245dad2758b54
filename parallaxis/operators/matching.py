"""Matching of camera lists: nearest and farthest views, pairwise costs, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from ..storage import kept
from . import small
from .assignment import assign
from .directions import widest_angles
from .neighbours import nearest
from .quantiles import quantiles


def viewpoints(cameras: DataFrame, polar: bool = False) -> DataFrame:
    """cam_idx and the camera's centre, or its unit direction against the view."""
    at = c.rotation()[2] if polar else c.position()
    return cameras.select("cam_idx", *[x.alias(n) for x, n in zip(at, "xyz", strict=True)])


def nearest_cameras(targets: DataFrame, sources: DataFrame, polar: bool = False) -> DataFrame:
    """For each target the nearest source; of equals the one with the smaller index. Sources may serve several targets."""
    t, s = (viewpoints(x, polar).withColumnRenamed("cam_idx", "id") for x in (targets, sources))
    return nearest(t, s, 1, digits=12).select(F.col("id").alias("cam_idx"), F.col("near_id").alias("source_idx"))


def farthest_cameras(cameras: DataFrame, k: int, polar: bool = False) -> DataFrame:
    """Farthest-point order: the first camera, then always the one farthest from those taken, of equals the smaller index.
    k turns of one aggregate each; k >= n gives all in order, k <= 0 still the first."""
    n = cameras.count()
    points = viewpoints(cameras, polar)
    if k >= n:
        return points.select("cam_idx", (F.row_number().over(_by_index()) - 1).alias("turn"))
    points = points.withColumn("gap", F.lit(float("inf")))
    last = points.agg(F.min(F.struct("cam_idx", "x", "y", "z"))).first()[0]
    taken = [last["cam_idx"]]
    while len(taken) < max(1, k):
        gap = v.sub(v.cols("x", "y", "z"), v.lit3(last["x"], last["y"], last["z"]))
        points = points.withColumn("gap", F.least("gap", F.round(v.dot(gap, gap), 12)))
        if len(taken) % 8 == 0:  # the plan would grow with every turn
            points = kept(points, "gaps")
        last = points.where(~F.col("cam_idx").isin(taken)).agg(F.max(F.struct("gap", (-F.col("cam_idx")).alias("order"), "x", "y", "z", "cam_idx"))).first()[0]
        taken.append(last["cam_idx"])
    return cameras.sparkSession.createDataFrame(list(zip(taken, range(len(taken)), strict=True)), "cam_idx int, turn int")


def _by_index():
    from pyspark.sql import Window

    return Window.orderBy("cam_idx")


def match_cost(candidates: DataFrame, references: DataFrame, radius: float, place_unit: float = 0.15, angle_unit: float = 15.0) -> DataFrame:
    """Cost of each pair: distance of the centres by the trajectory's radius, plus the larger of the view and up angles in
    degrees, each in units of what still counts as a match."""
    side = lambda df, p: df.select(F.col("cam_idx").alias(f"{p}_idx"), *[x.alias(f"{p}_{k}{n}") for k, t in (("p", c.position()), ("f", c.forward()), ("u", c.up())) for x, n in zip(t, "xyz", strict=True)])
    at = lambda p, k: v.cols(*[f"{p}_{k}{n}" for n in "xyz"])
    pairs = side(candidates, "c").join(small(side(references, "r")))
    angle = F.greatest(v.angle_deg(at("c", "f"), at("r", "f")), v.angle_deg(at("c", "u"), at("r", "u")))
    return pairs.select("c_idx", "r_idx", (v.norm(v.sub(at("c", "p"), at("r", "p"))) / max(radius, 1e-6) / max(place_unit, 1e-6) + angle / max(angle_unit, 1e-6)).alias("cost"), angle.alias("angle_deg"))


def max_view_angle(cameras: DataFrame) -> DataFrame:
    """Greatest angle between two views, 0 for fewer than two."""
    views = cameras.select(F.lit(0).alias("scene"), *[x.alias(n) for x, n in zip(c.forward(), "xyz", strict=True)])
    return widest_angles(views).agg(F.coalesce(F.max("angle_deg"), F.lit(0.0)).alias("angle_deg"))


def radii(cameras: DataFrame, scene: str = "scene") -> DataFrame:
    """(scene, radius): median distance of each scene's centres to their mean."""
    points = cameras.select(scene, *[x.alias(n) for x, n in zip(c.position(), "xyz", strict=True)])
    mean = points.groupBy(scene).agg(*[F.avg(n).alias(f"m{n}") for n in "xyz"])
    far = v.norm(v.sub(v.cols("x", "y", "z"), v.cols("mx", "my", "mz")))
    return quantiles(points.join(small(mean), scene).select(scene, far.alias("far")), [scene], "far", {"radius": 0.5})


def view_angles(cameras: DataFrame, scene: str = "scene") -> DataFrame:
    """(scene, spread): greatest angle between two views of a scene, 0 for fewer than two."""
    views = cameras.select(scene, *[x.alias(n) for x, n in zip(c.forward(), "xyz", strict=True)])
    return widest_angles(views, scene).withColumnRenamed("angle_deg", "spread")


def _sides(cameras: DataFrame, scene: str, p: str) -> DataFrame:
    return cameras.select(scene, F.col("cam_idx").alias(f"{p}_idx"), *[x.alias(f"{p}_{k}{n}") for k, t in (("p", c.position()), ("f", c.forward()), ("u", c.up())) for x, n in zip(t, "xyz", strict=True)])


def _aligned(rows: DataFrame, fits: DataFrame, scene: str) -> DataFrame:
    """Candidates' sides moved by their scene's affine fit, their directions turned by its rotation."""
    rows = rows.join(small(fits), scene)
    m = {"p": v.matrix("linear", 3), "f": v.matrix("rotation", 3), "u": v.matrix("rotation", 3)}
    moved = {f"c_{k}{n}": v.dot(tuple(m[k][i]), v.cols(*[f"c_{k}{a}" for a in "xyz"])) + (F.col("shift")[i] if k == "p" else F.lit(0.0)) for k in "pfu" for i, n in enumerate("xyz")}
    return rows.select(*[x for x in rows.columns if x not in (*moved, "linear", "shift", "rotation")], *[e.alias(n) for n, e in moved.items()])


def _turn_deg() -> "F.Column":
    at = lambda p, k: v.cols(*[f"{p}_{k}{n}" for n in "xyz"])
    return F.greatest(v.angle_deg(at("c", "f"), at("r", "f")), v.angle_deg(at("c", "u"), at("r", "u")))


def _gap() -> "F.Column":
    return v.norm(v.sub(v.cols(*[f"c_p{n}" for n in "xyz"]), v.cols(*[f"r_p{n}" for n in "xyz"])))


def match_lists(candidates: DataFrame, references: DataFrame, scene: str = "scene", rounds: int = 5, place_unit: float = 0.15, angle_unit: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Matches (scene, c_idx, r_idx) of equally long camera lists, and the affine fits (scene, linear, shift, rotation) that they
    give. First the lists are matched in order; then the candidates are fitted to their matches and assigned anew by
    cost, all scenes at once, until no match changes or for so many rounds. Pairs of one scene meet, never of two."""
    from pyspark.sql import Window

    from . import align

    numbered = lambda df, name: df.select(scene, F.col("cam_idx").alias(name), F.row_number().over(Window.partitionBy(scene).orderBy("cam_idx")).alias("n"))
    c_side, r_side = _sides(candidates, scene, "c"), _sides(references, scene, "r")
    unit = radii(references, scene)
    now = kept(numbered(candidates, "c_idx").join(numbered(references, "r_idx"), [scene, "n"]).drop("n"), "matches")

    def fit(matches: DataFrame) -> DataFrame:
        pairs = matches.join(c_side, [scene, "c_idx"]).join(r_side, [scene, "r_idx"])
        return kept(align.affine(pairs.select(scene, *[F.col(f"c_p{n}").alias(n) for n in "xyz"], *[F.col(f"r_p{n}").alias(f"t{n}") for n in "xyz"]), scene), "fits")

    for _ in range(rounds):
        pairs = _aligned(c_side, fit(now), scene).join(r_side, scene).join(small(unit), scene)
        costs = pairs.select(scene, "c_idx", "r_idx", (_gap() / F.greatest(F.col("radius"), F.lit(1e-6)) / max(place_unit, 1e-6) + _turn_deg() / max(angle_unit, 1e-6)).alias("cost"))
        after = kept(assign(costs, scene).select(scene, "c_idx", "r_idx"), "matches")
        same = after.join(now, [scene, "c_idx", "r_idx"], "left_anti").isEmpty()
        now = after
        if same:
            break
    return now, fit(now)


def upgrade_verdicts(
    candidates: DataFrame, references: DataFrame, scene: str = "scene", least: int = 3, place_median: float = 0.05, place_p95: float = 0.15, turn_median: float = 5.0, turn_p95: float = 15.0, turn_most: float = 90.0,
    radius_share: float = 0.05, spread_deg: float = 30.0, spread_share: float = 0.5,
) -> DataFrame:
    """(scene, place_median, place_p95, turn_median, turn_p95, turn_most, accepted): whether each scene's candidates may replace
    its references. They are as many and at least so many; have not collapsed (radius against the references'); do not all
    look one way where the references do not; and, once matched and fitted, stand and look near enough. Scenes that fail
    before the match have no residuals."""
    counts = lambda df, name: df.groupBy(scene).agg(F.count(F.lit(1)).alias(name))
    facts = counts(candidates, "n_c").join(counts(references, "n_r"), scene)
    for df, p in ((candidates, "c"), (references, "r")):
        facts = facts.join(radii(df, scene).withColumnRenamed("radius", f"radius_{p}"), scene).join(view_angles(df, scene).withColumnRenamed("spread", f"spread_{p}"), scene)
    uniform = (F.col("spread_c") < spread_deg) | (F.col("spread_c") < F.col("spread_r") * spread_share)
    fair = (F.col("n_c") >= least) & (F.col("n_c") == F.col("n_r")) & (F.col("radius_c") > 1e-8) & ((F.col("radius_r") <= 1e-8) | (F.col("radius_c") >= radius_share * F.col("radius_r"))) & ~((F.col("spread_r") >= spread_deg) & uniform)
    facts = kept(facts.withColumn("fair", fair), "facts")
    some = small(facts.where("fair").select(scene))
    matches, fits = match_lists(candidates.join(some, scene), references.join(some, scene), scene, place_unit=place_p95, angle_unit=turn_p95)
    pairs = _aligned(matches.join(_sides(candidates, scene, "c"), [scene, "c_idx"]), fits, scene).join(_sides(references, scene, "r"), [scene, "r_idx"]).join(small(facts.select(scene, "radius_r")), scene)
    rest = pairs.select(scene, (_gap() / F.greatest(F.col("radius_r"), F.lit(1e-6))).alias("place"), _turn_deg().alias("turn"))
    rest = kept(rest, "residuals")
    halves = [quantiles(rest, [scene], x, {f"{x}_median": 0.5, f"{x}_p95": 0.95}) for x in ("place", "turn")]
    residuals = halves[0].join(halves[1], scene).join(rest.groupBy(scene).agg(F.max("turn").alias("turn_most")), scene)
    limits = {"place_median": place_median, "place_p95": place_p95, "turn_median": turn_median, "turn_p95": turn_p95, "turn_most": turn_most}
    good = F.expr(" and ".join(f"{k} <= {float(x)!r}D" for k, x in limits.items()))
    return facts.select(scene).join(residuals, scene, "left").select(scene, *limits, F.coalesce(good, F.lit(False)).alias("accepted"))


def trajectory_radius(cameras: DataFrame) -> DataFrame:
    """Median distance of the centres to their mean, 0 without any."""
    points = viewpoints(cameras)
    mean = points.agg(*[F.avg(n).alias(f"m{n}") for n in "xyz"])
    far = v.norm(v.sub(v.cols("x", "y", "z"), v.cols("mx", "my", "mz")))
    found = quantiles(points.join(F.broadcast(mean)).select(F.lit(0).alias("all"), far.alias("far")), ["all"], "far", {"radius": 0.5})  # the mean is one row
    return found.agg(F.coalesce(F.max("radius"), F.lit(0.0)).alias("radius"))
