"""Scores, affinities and lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the seven terms of an edge score, in order of the arguments.
EDGE_WEIGHTS = (0.28, 0.16, 0.18, 0.14, 0.10, 0.07, 0.07)
#: Fixed value: the difference of roughness, planarity or linearity from which nothing is alike.
FAR_SHAPE = 0.35


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def edge_score(contact_color: Column, p90_color: Column, support: Column, normal: Column, roughness: Column, planarity: Column, linearity: Column, far_color: float, outside: Column | None = None, outside_weight: float = 0.0) -> Column:
    """Weighted likeness of two patches in contact: color distances out of `far_color`, shape differences out of FAR_SHAPE, blended with outside evidence where there is any.

    A color distance that is unknown counts as `far_color`, an unknown difference as 1, unknown support and normals as 0.
    """
    known = lambda x, other: F.coalesce(x, F.lit(other))
    terms = [1 - known(x, far_color) / far_color for x in (contact_color, p90_color)] + [known(support, 0.0), known(normal, 0.0)]
    terms += [1 - known(x, 1.0) / FAR_SHAPE for x in (roughness, planarity, linearity)]
    own = sum((w * unit(t) for w, t in zip(EDGE_WEIGHTS, terms, strict=True)), F.lit(0.0))
    return own if outside is None else F.coalesce((1 - outside_weight) * own + outside_weight * unit(outside), own)


#: Likeness of two geometry buckets that differ.
UNKNOWN_LIKENESS, LOOSE_LIKENESS, ROUGH_LIKENESS, OTHER_LIKENESS = 0.62, 0.78, 0.56, 0.09
LOOSE = ("rough_mixed", "thin_linear", "mixed")


def bucket_likeness(a: Column, b: Column) -> Column:
    """How well two geometry buckets go together: 1 if equal, else by the first case that holds; null counts as unknown."""
    a, b = F.coalesce(a, F.lit("unknown")), F.coalesce(b, F.lit("unknown"))
    surface = lambda x, y: x.isin("horizontal", "vertical") & (y == "rough_mixed")
    return (
        F.when(a == b, 1.0)
        .when((a == "unknown") | (b == "unknown"), UNKNOWN_LIKENESS)
        .when(a.isin(*LOOSE) & b.isin(*LOOSE), LOOSE_LIKENESS)
        .when(surface(a, b) | surface(b, a), ROUGH_LIKENESS)
        .otherwise(OTHER_LIKENESS)
    )


def structural_veto(a: Column, b: Column, a_size: Column, b_size: Column, least_share: float, least_size: int) -> Column:
    """Whether two patches of `least_size` or more are a horizontal and a vertical surface, by shares of cells in buckets (arrays in the buckets' order)."""
    share = lambda counts, k: F.element_at(counts, k) / F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(1))
    crossed = lambda x, y: (share(x, 2) >= least_share) & (share(y, 3) >= least_share)
    return (F.least(a_size, b_size) >= least_size) & (crossed(a, b) | crossed(b, a))


def color_affinity(distance: Column, sigma: float) -> Column:
    return F.exp(-(distance * distance) / (2.0 * sigma * sigma))


def contact_support(ratio: Column) -> Column:
    return F.sqrt(unit(ratio))


def lower_bound(values: Column, least_views: int) -> Column:
    """Mean less population deviation of a group, at least 0; 0 for fewer views than `least_views`."""
    return F.when(F.count(values) >= least_views, F.greatest(F.lit(0.0), F.avg(values) - F.stddev_pop(values))).otherwise(0.0)


def label_of(column: Column, aliases: dict[str, str], known: list[str], other: str = "unknown") -> Column:
    """A label of the closed vocabulary: by alias, by name, then the first known name it contains."""
    low = F.lower(F.trim(column))
    named = F.create_map(*[F.lit(x) for pair in (aliases | {k: k for k in known}).items() for x in pair])[low]
    within = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in known])
    return F.coalesce(named, within, F.lit(other))


def number(column: Column, default: float) -> Column:
    """A number where the text is one, else the default."""
    return F.coalesce(column.try_cast("double"), F.lit(float(default)))


def stable_color(key: Column, seed: int = 7) -> tuple[Column, Column, Column]:
    """Three bytes that depend on the key alone."""
    mixed = (key.cast("long") * 2654435761 + seed) % 4294967296
    return tuple(F.shiftright(mixed, s).bitwiseAND(F.lit(255)).cast("int") for s in (0, 8, 16))


def sky_like(r: Column, g: Column, b: Column, row: Column, height: int, upper: float = 0.72) -> Column:
    """Whether a pixel of the upper image looks like blue sky or bright haze, from hue (degrees), saturation and value out of 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    saturation = F.when(top > 0, 255.0 * spread / top).otherwise(0.0)
    turn = F.when(spread == 0, 0.0).when(top == r, (g - b) / spread).when(top == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    hue = F.pmod(turn * 60.0, F.lit(360.0))
    blue = hue.between(170, 260) & (saturation >= 25) & (top >= 95)
    return (row < height * upper) & (blue | ((saturation <= 65) & (top >= 185)))
