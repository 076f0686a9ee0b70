"""Findings about objects: every rule that holds is reported, and together they give a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.guards import Rule

#: Labels of ground subtypes, indoor areas, fine labels, and labels that geometry alone settles.
GROUNDS = {"ordinary_ground": "ground", "outdoor_ground": "ground", "parking_ground": "ground", "indoor_floor": "indoor_floor", "stair": "stair", "stairs": "stair", "grass": "grass", "roof": "roof", "rooftop": "roof"}
INDOORS = ("indoor_lobby", "indoor_corridor", "stairwell")
FINE = ("car", "railing", "pipe", "equipment", "person", "fine_candidate")
STEADY = ("wall", "ground", "grass", "roof", "indoor_floor", "stair")


@dataclass(frozen=True)
class Finding:
    """Where `when` holds (null: it doesn't), the reason is reported and asks for an action."""

    reason: str
    when: Column
    action: str
    severe: bool = False


def held(findings: Sequence[Finding]) -> Column:
    """The findings that hold, in their order: array of struct(reason, action, severe)."""
    each = [F.when(f.when, F.struct(F.lit(f.reason).alias("reason"), F.lit(f.action).alias("action"), F.lit(f.severe).alias("severe"))) for f in findings]
    return F.filter(F.array(*each), lambda f: f.isNotNull())


def reasons(found: Column) -> Column:
    return F.transform(found, lambda f: f["reason"])


def severity(found: Column) -> Column:
    """ok without findings, high if one is severe, else medium."""
    return F.when(F.size(found) == 0, "ok").when(F.exists(found, lambda f: f["severe"]), "high").otherwise("medium")


def last_action(found: Column, otherwise: str, firm: str | None = None, weak: str | None = None) -> Column:
    """The action of the last finding, but the action `weak` doesn't take the place of `firm`."""
    stays = lambda was, new: (was == F.lit(firm)) & (new == F.lit(weak))
    return F.aggregate(found, F.lit(otherwise), lambda was, f: F.when(stays(was, f["action"]), was).otherwise(f["action"]))


def asks(found: Column, *actions: str) -> Column:
    """Whether a finding asks for one of the actions."""
    return F.exists(found, lambda f: f["action"].isin(*actions))


@dataclass(frozen=True)
class Traits:
    """Columns of an object: `upright` is the absolute vertical part of its normal; regions and attachments with the share of the object that has them."""

    label: Column
    points: Column
    z: Column
    width: Column
    depth: Column
    rise: Column
    upright: Column
    planarity: Column
    linearity: Column
    thickness: Column
    region: Column
    region_share: Column
    attachment: Column
    attachment_share: Column
    rejected: Column

    @property
    def longest(self) -> Column:
        return F.greatest(self.width, self.depth, self.rise)

    @property
    def narrow(self) -> Column:
        return F.least(self.width, self.depth)


def surface_conflicts(t: Traits, flat: float = 0.85, steep: float = 0.35, even: float = 0.7, thick: float = 1.5, high_floor: float = 4.0, high_grass: float = 8.0, even_grass: float = 0.55) -> list[Finding]:
    """Where floors, walls and grass contradict their geometry."""
    floor, wall, grass = (t.label == n for n in ("floor", "wall", "grass"))
    level, oblique = t.upright >= flat, (t.upright < flat) & (t.upright > steep)
    return [
        Finding("floor is not level", floor & ~level, "split or relabel"),
        Finding("floor rises far", floor & (t.rise > high_floor), "split by height", severe=True),
        Finding("wall is level", wall & level, "split or relabel", severe=True),
        Finding("wall is oblique", wall & oblique, "review"),
        Finding("wall is uneven", wall & (t.planarity < even), "split mixed wall"),
        Finding("wall is thick", wall & (t.thickness > thick), "split mixed wall"),
        Finding("grass rises far", grass & (t.rise > high_grass), "split or relabel", severe=True),
        Finding("grass is uneven", grass & (t.planarity < even_grass), "review"),
    ]


def fine_conflicts(t: Traits, flat: float = 0.85, share: float = 0.9, off_ground: float = 2.5, high_car: float = 5.0, long_car: float = 12.0, low_car: float = 0.45, even: float = 0.8, linear: float = 0.82, broad: float = 1.2, thick: float = 0.16, long_railing: float = 18.0) -> list[Finding]:
    """Where cars and railings contradict their geometry, their structural region or what they are attached to."""
    car, railing, level = t.label == "car", t.label == "railing", t.upright >= flat
    raised = ~level & (t.z >= off_ground)
    on_wall = (t.region == "vertical") & (t.region_share >= share)
    hung = (t.attachment == "attached_object") & (t.attachment_share >= share) & (F.coalesce(t.region, F.lit("")) != "ground")
    return [
        Finding("car was rejected", car & t.rejected, "demote", severe=True),
        Finding("car lies in a wall's region", car & on_wall & raised, "car to wall", severe=True),
        Finding("car hangs on a surface", car & hung & raised, "car to wall"),
        Finding("car is high up", car & (t.z > high_car), "demote or review"),
        Finding("car is too long", car & (t.longest > long_car), "split"),
        Finding("car is too flat", car & (t.rise < low_car), "demote or review"),
        Finding("railing was rejected", railing & t.rejected, "demote", severe=True),
        Finding("railing is an even level surface", railing & level & (t.planarity >= even) & ((t.linearity < linear) | (t.narrow >= broad)), "split or relabel", severe=True),
        Finding("railing is like a level surface", railing & level & (t.thickness > thick), "split or demote"),
        Finding("railing is too long", railing & (t.longest > long_railing), "split"),
    ]


def with_fragments(found: Column, t: Traits, surfaces: Sequence[str], least: int = 500) -> Column:
    """Surfaces below `least` points without another finding are fragments."""
    tiny = held([Finding("surface is a fragment", t.label.isin(*surfaces) & (t.points < least), "merge or demote")])
    return F.when(F.size(found) == 0, tiny).otherwise(found)


def conflict_relabels(t: Traits, names: Column, low: str = "floor", high: str = "floor", above: float | None = None, even: float = 0.8, thin: float = 0.5) -> list[Rule]:
    """Careful new labels by the reasons found (`names`)."""
    has = lambda *some: F.arrays_overlap(names, F.array(*map(F.lit, some)))
    clean = (t.label == "wall") & has("wall is level") & (t.planarity >= even) & (t.thickness <= thin)
    upper = F.lit(False) if above is None else t.z >= above
    return [
        Rule("clean level wall, high", clean & upper, high),
        Rule("clean level wall", clean, low),
        Rule("wall in conflict", has("wall is level", "wall is uneven", "wall is thick", "wall is oblique"), "unknown"),
        Rule("grass in conflict", has("grass rises far", "grass is uneven"), "unknown"),
        Rule("car in conflict", has("car is high up", "car is too flat"), "unknown"),
        Rule("clean level railing", has("railing is an even level surface"), "floor"),
        Rule("railing like a surface", has("railing is like a level surface"), "unknown"),
        Rule("floor is not level", has("floor is not level"), "unknown"),
    ]


def weak_evidence(area_share: Column, projected: Column, missing: Column) -> list[Finding]:
    """What makes the image evidence of a candidate weak."""
    return [
        Finding("no image evidence", missing, "review"),
        Finding("huge image box", area_share > 0.7, "weak"),
        Finding("large image box", (area_share > 0.45) & (area_share <= 0.7), "weak"),
        Finding("weak projection", projected < 80, "weak"),
    ]


def car_candidates(t: Traits, upper: Column) -> list[Finding]:
    """Findings against a car; to `reject`, to `reject if weak` evidence joins, or to review."""
    return [
        Finding("car on an upper level", upper | (t.z > 5.0), "reject"),
        Finding("car is merged with others", (t.longest > 12.0) | (t.points > 15_000), "review"),
        Finding("car is too flat", t.rise < 0.45, "review"),
        Finding("car is a level panel", (t.planarity > 0.94) & (t.thickness < 0.08) & (t.upright > 0.65), "reject if weak"),
    ]


def railing_candidates(t: Traits) -> list[Finding]:
    """Findings against a railing."""
    return [
        Finding("railing is merged with others", (t.points > 12_000) | (t.longest > 18.0), "review"),
        Finding("railing is a level surface", (t.planarity > 0.88) & (t.upright > 0.82) & (t.thickness > 0.16), "reject if weak"),
        Finding("railing is a tall surface", (t.rise > 5.0) & (t.linearity < 0.55), "reject"),
        Finding("railing is too small", t.longest < 1.2, "review"),
    ]


def candidate_verdict(found: Column, plausible: Column) -> Column:
    """rejected, review or plausible."""
    rejected = asks(found, "reject") | (asks(found, "reject if weak") & asks(found, "weak"))
    return F.when(rejected, "rejected").when((F.size(found) == 0) & F.coalesce(plausible, F.lit(False)), "plausible").otherwise("review")


def car_sized(t: Traits) -> Column:
    return t.rise.between(1.0, 3.2) & t.longest.between(1.8, 9.0)


def equipment_findings(t: Traits) -> list[Finding]:
    """Accepted equipment that is rather a surface (demote) or is large (review)."""
    wide, aspect = F.greatest(t.width, t.depth), F.greatest(t.width, t.depth) / F.greatest(t.narrow, F.lit(1e-6))
    return [
        Finding("large span", t.longest >= 3.0, "demote"),
        Finding("long and linear", (wide >= 1.8) & (t.linearity >= 0.82), "demote"),
        Finding("large and planar", (wide >= 1.6) & (t.planarity >= 0.3), "demote"),
        Finding("stretched and linear", (aspect >= 4.0) & (t.linearity >= 0.82), "demote"),
        Finding("many points", t.points >= 350, "review"),
        Finding("wide", wide >= 1.15, "review"),
        Finding("tall", t.rise >= 1.5, "review"),
    ]


def equipment_verdict(found: Column) -> Column:
    return F.when(asks(found, "demote"), "demote").when(asks(found, "review"), "review").otherwise("keep")


@dataclass(frozen=True)
class Seen:
    """What is known of a patch: geometry type, votes as a map, scene area, ground subtype ('' if none) and colour `green` (g - max(r, b), of 1)."""

    kind: Column
    votes: Column
    area: Column
    subtype: Column
    green: Column


def _verdict(label: Column | str, confidence: Column | float, *conflicts: Column) -> Column:
    """struct(label, confidence, conflicts); conflicts are names or null."""
    value = lambda c: c if isinstance(c, Column) else F.lit(c)
    said = F.array_compact(F.array(*conflicts)) if conflicts else F.array().cast("array<string>")
    return F.struct(value(label).cast("string").alias("label"), value(confidence).cast("double").alias("confidence"), said.alias("conflicts"))


def classified(rows: DataFrame, t: Traits, s: Seen, flat: float = 0.86, steep: float = 0.42, sure: float = 0.55) -> DataFrame:
    """`rows` with `verdict`: struct(label, confidence, conflicts, status) of each patch.

    Surfaces take their label from their geometry and fine votes on them are conflicts. Other types are first
    taken for a surface where normal and votes agree, then for the object that enough votes name; cars also need
    an outdoor area and a car's size. Status: stable, or with a conflict or confidence below `sure` geometry_guarded
    for the labels of STEADY, else ambiguous_object. Null traits decide nothing. Shares are of one vote at least; of equal votes
    the first label by name wins.
    """
    # what many cases read is a column of its own, so that it is computed once
    entries = F.array_sort(F.transform(F.map_entries(s.votes), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("label"))))
    held = rows.withColumns({"__total": F.greatest(F.aggregate(F.map_values(s.votes), F.lit(0.0), lambda a, v: a + v), F.lit(1.0)), "__winner": F.when(F.size(s.votes) > 0, F.element_at(entries, 1)["label"]).otherwise("unknown")})
    of = lambda name: F.coalesce(F.element_at(s.votes, name), F.lit(0.0)) / F.col("__total")
    voted = sorted({*GROUNDS.values(), "wall", "building", "floor", "car", "railing", "equipment", "ceiling"})
    held = held.withColumns({f"__of_{name}": of(name) for name in voted} | {"__best": of(F.col("__winner"))})
    share = lambda name: F.col(f"__of_{name}")
    indoor = F.coalesce(s.area.isin(*INDOORS), F.lit(False))
    ground = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in GROUNDS.items() for x in pair]), s.subtype), F.lit("ground"))
    surface = F.when(t.region == "upper", F.when(s.area == "rooftop", "roof").otherwise("ceiling")).otherwise(ground)
    wall, floor = F.greatest(share("wall"), share("building")), share("ground") + share("floor")
    level, upright = t.upright >= flat, t.upright <= steep
    saved = (
        F.when(level & ((floor >= 0.35) | (s.subtype != "") | t.region.isin("ground", "upper")), _verdict(surface, F.greatest(floor, F.lit(0.62)), F.lit("level surface in other geometry")))
        .when(level & (wall >= 0.65) & indoor, _verdict(surface, F.greatest(wall, F.lit(0.58)), F.lit("level surface from wall votes")))
        .when(upright & (wall >= 0.65), _verdict("wall", F.greatest(wall, F.lit(0.7)), F.lit("wall in other geometry")))
    )
    no_car = F.when(indoor, "no car indoors").when(t.points < 800, "car has too few points").when((t.longest < 1.2) | (t.rise < 0.45), "car is too small")
    held = held.withColumns({"__saved": saved, "__no_car": no_car})
    saved, no_car = F.col("__saved"), F.col("__no_car")
    veto = lambda when, name: F.when(when, F.lit(name))
    grass = (share("grass") >= 0.25) | ((s.area == "grass_landscape") & (s.green >= 0.05))
    horizontal = F.when(grass, "grass").otherwise(ground)
    h_share = sum((F.when(horizontal == n, share(n)).otherwise(0.0) for n in sorted(set(GROUNDS.values()))), F.lit(0.0))
    any_vote = lambda *names: F.arrays_overlap(F.map_keys(s.votes), F.array(*map(F.lit, names)))
    roof = F.when((s.area == "rooftop") | s.subtype.isin("roof", "rooftop"), "roof").otherwise("ceiling")
    meadow = F.when((share("grass") >= 0.25) | (s.area == "grass_landscape"), "grass").otherwise("unknown")
    votes_car = share("car") >= 0.25
    refused = F.when(votes_car, no_car)
    # a car veto is added to the conflicts of what a bulky patch became instead
    bulky_saved = F.when(saved.isNotNull(), F.struct(saved["label"].alias("label"), saved["confidence"].alias("confidence"), F.array_compact(F.concat(saved["conflicts"], F.array(refused))).alias("conflicts")))
    bulky = F.coalesce(
        bulky_saved,
        F.when(votes_car & no_car.isNull(), _verdict("car", share("car"))).when(share("equipment") >= 0.35, _verdict("equipment", share("equipment"), refused)),
        _verdict("unknown", F.greatest(share("car"), share("equipment"), F.lit(0.25)), refused),
    )
    best = F.col("__best")
    named = F.when(best >= 0.75, F.col("__winner")).otherwise("unknown")
    rest = F.when((named == "car") & no_car.isNotNull(), _verdict("unknown", best, no_car)).otherwise(_verdict(named, best))
    out = (
        F.when(s.kind == "horizontal_surface", _verdict(horizontal, F.greatest(h_share, F.lit(0.65)), veto(any_vote(*FINE), "fine votes on a level surface")))
        .when(s.kind == "upper_surface", _verdict(roof, F.greatest(F.when(roof == "roof", share("roof")).otherwise(share("ceiling")), F.lit(0.6)), veto(any_vote("car", "railing"), "fine votes on an upper surface")))
        .when(s.kind == "vertical_surface", _verdict("wall", F.greatest(wall, F.lit(0.7)), veto(share("car") >= 0.15, "car votes on a wall"), veto(share("railing") >= 0.15, "railing votes on a wall")))
        .when(s.kind == "vegetation_like", F.coalesce(saved, _verdict(meadow, F.greatest(share("grass"), F.when(meadow == "grass", 0.45).otherwise(0.2)))))
        .when(s.kind == "linear_thin", F.when(share("railing") >= 0.2, _verdict("railing", F.greatest(share("railing"), F.lit(0.55)))).otherwise(F.coalesce(saved, _verdict("fine_candidate", 0.35))))
        .when(s.kind == "bulky_object", bulky)
        .when(s.kind == "mixed", _verdict("ambiguous", 0.0, F.lit("mixed geometry")))
        .otherwise(F.coalesce(saved, rest))
    )
    held = held.withColumn("__out", out)
    out = F.col("__out")
    unsure = (out["confidence"] < sure) | (F.size(out["conflicts"]) > 0)
    status = F.when(~unsure, "stable").when(out["label"].isin(*STEADY), "geometry_guarded").otherwise("ambiguous_object")
    return held.select(*rows.columns, F.struct(out["label"].alias("label"), out["confidence"].alias("confidence"), out["conflicts"].alias("conflicts"), status.alias("status")).alias("verdict"))
