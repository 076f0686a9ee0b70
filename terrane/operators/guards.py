"""Label guards and repairs: ordered rules whose first match gives a label and its reason, as one CASE."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Where `when` holds, the label becomes `to` (None: it stays) for the reason given."""

    reason: str
    when: Column
    to: str | None


def decided(rules: Sequence[Rule], label: Column, otherwise: str) -> Column:
    """struct(label, reason) of the first rule that holds."""
    out = None
    for rule in rules:
        value = F.struct((label if rule.to is None else F.lit(rule.to)).alias("label"), F.lit(rule.reason).alias("reason"))
        hit = F.coalesce(rule.when, F.lit(False))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    rest = F.struct(label.alias("label"), F.lit(otherwise).alias("reason"))
    return rest if out is None else out.otherwise(rest)


def surface_repairs(label: Column, upright: Column, rise: Column, reach: Column, planarity: Column, height: Column, flat: float = 0.85, steep: float = 0.3, thin: float = 0.25, wide: float = 0.8, even: float = 0.35, ceiling: float = 2.0, tall: float = 0.6) -> list[Rule]:
    """Surfaces that their geometry contradicts. `upright` is the absolute vertical part of the normal, `rise` and `reach` the vertical and horizontal extents."""
    lying = (upright >= flat) & (rise <= thin) & (reach >= wide) & (planarity >= even)
    standing = (upright <= steep) & (rise >= tall)
    return [
        Rule("flat wall overhead", (label == "wall") & lying & (height >= ceiling), "ceiling"),
        Rule("flat wall below", (label == "wall") & lying, "ground"),
        Rule("upright ground", (label == "ground") & standing & (planarity >= even), "wall"),
        Rule("upright ceiling", (label == "ceiling") & standing, "wall"),
        Rule("flat object", label.isin("car", "railing") & (upright >= flat) & (rise <= thin) & (planarity >= even), "unknown"),
    ]


def geometry_guards(label: Column, geometry: Column, count: Column, reach: Column, rise: Column, backed: Column, least: int = 80, wide: float = 0.8, thick: float = 0.6) -> list[Rule]:
    """Labels that a patch may keep; `backed` says that a confident teacher gave the label too."""
    small = (count < least) & (reach < wide)
    return [
        Rule("floor is not horizontal", (label == "floor") & (geometry != "horizontal"), "unknown"),
        Rule("floor is a fragment", (label == "floor") & small & ~backed, "unknown"),
        Rule("floor is too thick", (label == "floor") & (rise > thick) & ~backed, "unknown"),
        Rule("wall is a large horizontal surface", (label == "wall") & (geometry == "horizontal") & ~small, "floor"),
        Rule("wall is horizontal", (label == "wall") & (geometry == "horizontal"), "unknown"),
        Rule("wall is a fragment", (label == "wall") & (count < least) & ~backed, "unknown"),
        Rule("car is a fragment", (label == "car") & (count < least) & ~backed, "unknown"),
        Rule("railing is a surface", (label == "railing") & (geometry == "horizontal"), "unknown"),
    ]


def planar_relabels(label: Column, points: Column, first: Column, second: Column, upright: Column, planarity: Column, fine: Sequence[str], least: int = 500, long: float = 1.0, wide: float = 0.5, even: float = 0.5, flat: float = 0.8, steep: float = 0.35) -> list[Rule]:
    """Fine objects that are large planes; `first` and `second` are the longest two extents."""
    plane = label.isin(*fine) & (points >= least) & (first >= long) & (second >= wide) & (planarity >= even)
    return [Rule("large level plane", plane & (upright >= flat), "floor"), Rule("large upright plane", plane & (upright <= steep), "wall"), Rule("large sloping plane", plane, "building")]


def surface_attachments(region: Column, share: Column, label: Column, upright: Column, planarity: Column, linearity: Column, large: Column, fine: Sequence[str], supported: float = 0.5, agreed: float = 0.8, flat: float = 0.8, steep: float = 0.35, even: float = 0.45, thin: float = 0.6) -> list[Rule]:
    """What a target is to the structural region that most of its points lie in; the label of a rule is the status."""
    is_fine, even_surface = label.isin(*fine), planarity >= even
    level, wall = region.isin("ground", "upper"), region == "vertical"
    merge = "merge_to_region"
    return [
        Rule("little support, fine", (share < supported) & is_fine, "independent_object"),
        Rule("little support", share < supported, "unstructured"),
        Rule("label agrees", ~is_fine & (share >= agreed), merge),
        Rule("large level surface", level & (upright >= flat) & even_surface & large & ~is_fine, merge),
        Rule("large upright surface", wall & (upright <= steep) & even_surface & large & (linearity < thin), merge),
        Rule("fine shape inside", is_fine & (linearity >= thin), "attached_object"),
        Rule("even surface", even_surface & ~is_fine, merge),
    ]
