"""Graphs: connected components, clusterings that are components, and folds that are exact within a component."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.lineage import Scratch
from terrane.operators.patches import BUCKETS


#: Edges, of a few megabytes, up to which components are found in one task, without rounds.
FEW_EDGES = 200_000


def components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) with the least node of each connected component; edges are (a, b).

    Large-star and small-star steps alternate until the links no longer change, in a number of rounds that
    grows with the logarithm of a component's size; more than `most_rounds` raise an error. Each step is an aggregation
    with map-side combining and a join that adaptive execution may split. Up to `few` edges, which are counted
    first, are one task's work instead, with the same result. Nodes of `nodes` (node) without edges are their own component.
    """
    scratch = Scratch(edges.sparkSession, "graph")
    stars, path = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    was = None
    for _ in range(most_rounds):
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
        if was is None and now[0] <= few:
            stars = _settled(stars)
            break
        if now == was:
            break
        after, after_path = scratch.keep(_small_star(_large_star(stars)))
        scratch.drop(path)
        stars, path, was = after, after_path, now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    labels = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = labels.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return labels
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(stars: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least node that it touches."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _settled(stars: DataFrame) -> DataFrame:
    """Few edges as stars of their components: (u, v) from each node to the least of its component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets()
        for rows in batches:
            for u, v in zip(rows["u"].tolist(), rows["v"].tolist(), strict=True):
                u, v = sets.root(u), sets.root(v)
                sets.up[max(u, v)] = min(u, v)
        ends = [(x, sets.root(x)) for x in list(sets.up)]
        yield pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["u", "v"])

    return stars.coalesce(1).mapInPandas(run, stars.schema)


def _small_star(stars: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the least of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    hung = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def sized(labelled: DataFrame, least: int) -> DataFrame:
    """Components with their size and `piece`: their own name, or null for residual ones of fewer than `least` nodes."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    return labelled.join(sizes, "component").withColumn("piece", F.when(F.col("size") >= least, F.col("component")))


def split_inside(nodes: DataFrame, edges: DataFrame, patch: str, least: int) -> DataFrame:
    """Patches split where the edges left inside them fall apart: nodes (node, patch) get `part`, 0 for the largest piece and pieces below `least`."""
    own = nodes.select("node", F.col(patch).alias("patch"))
    inside = edges.join(own.select(F.col("node").alias("a"), F.col("patch").alias("pa")), "a").join(own.select(F.col("node").alias("b"), F.col("patch").alias("pb")), "b").filter("pa = pb").select("a", "b")
    pieces = components(inside, own.select("node")).join(own, "node")
    sizes = pieces.groupBy("patch", "component").agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("place", F.row_number().over(Window.partitionBy("patch").orderBy(F.desc("n"), "component")))
    part = F.when((F.col("place") > 1) & (F.col("n") >= least), F.col("place") - 1).otherwise(0)
    return pieces.join(ranked.withColumn("part", part), ["patch", "component"]).select("node", "patch", "part")


def by_component(edges: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, extra: DataFrame | None = None) -> DataFrame:
    """A fold over the edges of each component at a time: (a, b, ...) and, if given, `extra` (node, ...) as its own rows with a = b = node.

    Folds that only ever join the ends of an edge and read their two clusters give the same result
    component by component as over all edges at once.
    """
    labels = components(edges.select("a", "b"))
    rows = edges.join(labels.select(F.col("node").alias("a"), "component"), "a")
    if extra is not None:
        own = extra.join(labels, "node").withColumn("a", F.col("node")).withColumn("b", F.col("node")).drop("node")
        rows = rows.unionByName(own, allowMissingColumns=True)
    return rows.groupBy("component").applyInPandas(fold, schema)


def near_groups(rows: DataFrame, keys: Sequence[str], sizes: Mapping[str, float]) -> DataFrame:
    """`rows` with `near`: equal for all rows of equal keys that chains of steps of at most `sizes` in every column link.

    Rows are linked by the occupied cells, never in pairs, so a crowded place costs one cell. Cells are named by
    hashes; two that share a name only put more rows together. It's the exact key of folds whose rows can only join
    others within the sizes.
    """
    named = rows.withColumns({f"__c{k}": F.floor(F.col(c) / size) for k, (c, size) in enumerate(sizes.items())})
    places = [f"__c{k}" for k in range(len(sizes))]
    cells = named.select(*keys, *places).distinct().withColumn("node", F.xxhash64(*keys, *places))
    half = [s for s in product((-1, 0, 1), repeat=len(places)) if s > (0,) * len(places)]
    steps = F.array(*[F.array(*map(F.lit, s)) for s in half])
    moved = cells.withColumn("__s", F.explode(steps)).select("node", F.xxhash64(*keys, *[F.col(p) + F.col("__s")[k] for k, p in enumerate(places)]).alias("b"))
    edges = moved.join(cells.select(F.col("node").alias("b")).distinct(), "b").select(F.col("node").alias("a"), "b")
    labels = components(edges, cells.select("node").distinct()).withColumnRenamed("component", "near")
    return named.withColumn("node", F.xxhash64(*keys, *places)).drop(*places).join(labels, "node").drop("node")


class Sets:
    """Disjoint sets with what a fold keeps about each."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def greedy_union(edges: DataFrame, sizes: DataFrame, k: float, least_score: float, least_size: int = 1) -> DataFrame:
    """Clusters (node, cluster) of a scored edge table by one pass in order of score, shared and pair, all descending.

    Edges are (a, b, score, shared), `sizes` (node, size). Two clusters join if both have at least
    `least_size`, the score reaches `least_score` and, for k > 0, the dissimilarity 1 - score is at most each
    side's internal difference plus k over its size. The larger cluster's name stays, of equals the first's.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["a"] == rows["b"]
        sets, size = Sets(), dict(zip(rows.loc[own, "a"], rows.loc[own, "size"], strict=True))
        inner = dict.fromkeys(size, 0.0)
        for row in rows[~own].sort_values(["score", "shared", "a", "b"], ascending=False).itertuples():
            p, q = sets.root(row.a), sets.root(row.b)
            if p == q or min(size[p], size[q]) < least_size or row.score < least_score:
                continue
            apart = 1 - row.score
            if k > 0 and apart > min(inner[p] + k / size[p], inner[q] + k / size[q]):
                continue
            if size[q] > size[p]:
                p, q = q, p
            sets.up[q] = p
            size[p] += size[q]
            inner[p] = max(inner[p], apart)
        return pd.DataFrame({"node": list(inner), "cluster": [sets.root(n) for n in inner]})

    kind = sizes.schema["node"].dataType.simpleString()
    joined = by_component(edges.select("a", "b", "score", "shared"), fold, f"node {kind}, cluster {kind}", sizes)
    alone = sizes.join(joined, "node", "left_anti").select("node", F.col("node").alias("cluster"))
    return joined.unionByName(alone)


@dataclass(frozen=True)
class Gates:
    """Limits of superpoint clustering; a bridge lets an edge below `least_score` through."""

    least_score: float = 0.62
    least_size: int = 1
    #: Scale of the internal difference that a merge may pass, 0 for none.
    k: float = 0.0
    most_entropy: float = 2.0
    #: Horizontal and vertical shares from which two patches of `veto_size` each are never merged, None for no veto.
    veto_share: float | None = None
    veto_size: int = 0
    contact_support: float = 0.25
    contact_color: float = 65.0
    contact_p90: float = 80.0
    near_gap: float = 0.15
    near_color: float = 70.0
    near_normal: float = 0.65
    #: Contact points from which an uncertain fragment is taken by a stable surface, None for no such bridge.
    fragment_contacts: float | None = None
    fragment_color: float = 60.0
    fragment_gap: float = 0.2
    fragment_size: int = 1000
    surface_size: int = 1000


def dominant_bucket(counts: Sequence[float], share: float = 0.6) -> str:
    """The bucket with at least `share` of the counts, of equals the first, else mixed."""
    top = max(range(len(counts)), key=lambda k: (counts[k], -k))
    return BUCKETS[top] if counts[top] >= share * sum(counts) else "mixed"


def bits_of(counts: Sequence[float]) -> float:
    """Entropy in bits."""
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c > 0)


def superpoints(edges: DataFrame, nodes: DataFrame, gates: Gates) -> DataFrame:
    """Clusters (node, cluster) of patches by one pass over scored edges, gated by what the two clusters have become.

    Edges are (a, b, score, shared) with support, color, color_p90, normal, gap and contacts, null where there is
    no such evidence; `nodes` are (node, size, counts), counts being cells by geometry bucket. The pass goes in
    order of score, shared and pair, all descending. An edge passes if its score reaches the least, or by a bridge:
    two clusters of one definite geometry in firm contact of like color, or near each other with like color and
    normals, or a small uncertain fragment touching a large stable surface. Clusters too small (but for
    such fragments), too unlike inside, that would put a horizontal and a vertical surface together, or whose
    union's buckets have too much entropy stay apart. The larger one's name stays, of equals the first's.

    Edges that no gate can let through, whatever clusters come to be, are dropped first; what then hangs
    together is folded in one task.
    """
    color, near = F.coalesce("color", F.lit(math.inf)), F.coalesce("gap", F.lit(math.inf))
    bridge = (F.coalesce("support", F.lit(0.0)) >= gates.contact_support) & (color <= gates.contact_color) & (F.coalesce("color_p90", F.lit(math.inf)) <= gates.contact_p90)
    bridge = bridge | ((near <= gates.near_gap) & (color <= gates.near_color) & (F.coalesce("normal", F.lit(0.0)) >= gates.near_normal))
    if gates.fragment_contacts is not None:
        bridge = bridge | ((F.coalesce("contacts", F.lit(0.0)) >= gates.fragment_contacts) & (color <= gates.fragment_color) & (near <= gates.fragment_gap))
    able = edges.filter((F.col("score") >= gates.least_score) | bridge)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["a"] == rows["b"]
        held = rows[own]
        sets, size = Sets(), dict(zip(held["a"], held["size"], strict=True))
        counts = {n: list(c) for n, c in zip(held["a"], held["counts"], strict=True)}
        inner = dict.fromkeys(size, 0.0)
        known = lambda x, other: other if x is None or x != x else x
        for row in rows[~own].sort_values(["score", "shared", "a", "b"], ascending=False).itertuples():
            p, q = sets.root(row.a), sets.root(row.b)
            if p == q:
                continue
            kinds = dominant_bucket(counts[p]), dominant_bucket(counts[q])
            color, gap = known(row.color, math.inf), known(row.gap, math.inf)
            fragment = False
            for (s, one), (f, other) in (((p, kinds[0]), (q, kinds[1])), ((q, kinds[1]), (p, kinds[0]))):
                if gates.fragment_contacts is not None and one in ("horizontal", "vertical") and other in ("unknown", "mixed", "rough_mixed"):
                    fragment = size[s] >= gates.surface_size and size[f] <= gates.fragment_size and known(row.contacts, 0.0) >= gates.fragment_contacts and color <= gates.fragment_color and gap <= gates.fragment_gap
            if min(size[p], size[q]) < gates.least_size and not fragment:
                continue
            definite = kinds[0] == kinds[1] and kinds[0] not in ("unknown", "mixed")
            contact = definite and known(row.support, 0.0) >= gates.contact_support and color <= gates.contact_color and known(row.color_p90, math.inf) <= gates.contact_p90
            close = definite and gap <= gates.near_gap and color <= gates.near_color and known(row.normal, 0.0) >= gates.near_normal
            if row.score < gates.least_score and not (fragment or close or contact):
                continue
            apart = 1 - row.score
            if gates.k > 0 and apart > min(inner[p] + gates.k / size[p], inner[q] + gates.k / size[q]):
                continue
            if gates.veto_share is not None and min(size[p], size[q]) >= gates.veto_size:
                share = lambda n, name: counts[n][BUCKETS.index(name)] / max(sum(counts[n]), 1)
                if any(share(m, "horizontal") >= gates.veto_share and share(n, "vertical") >= gates.veto_share for m, n in ((p, q), (q, p))):
                    continue
            both = [x + y for x, y in zip(counts[p], counts[q], strict=True)]
            if bits_of(both) > gates.most_entropy:
                continue
            if size[q] > size[p]:
                p, q = q, p
            sets.up[q] = p
            size[p] += size[q]
            counts[p] = both
            inner[p] = max(inner[p], apart)
        return pd.DataFrame({"node": list(inner), "cluster": [sets.root(n) for n in inner]})

    kind = nodes.schema["node"].dataType.simpleString()
    read = able.select("a", "b", "score", "shared", *[F.col(c).cast("double").alias(c) for c in ("support", "color", "color_p90", "normal", "gap", "contacts")])
    joined = by_component(read, fold, f"node {kind}, cluster {kind}", nodes)
    alone = nodes.join(joined, "node", "left_anti").select("node", F.col("node").alias("cluster"))
    return joined.unionByName(alone)


def propagated(edges: DataFrame, anchors: DataFrame, most_hops: int, least: float, most_rounds: int = 200) -> DataFrame:
    """(node, label, score, hops): the best product of edge weights from an anchor, as best first settles it.

    Edges are (a, b, weight) with weights of at most 1, anchors (node, label, score). A node settled at `most_hops` goes no
    further, even if a weaker path to it is shorter; of equal scores the least label settles, then the fewest hops. Products
    below `least` are not passed on.

    Each round gives every node the best of its own anchor and what its neighbours' values of the round before pass on, until
    nothing changes. A node's settled value rests on nodes of higher ones alone, so those are right one after
    another, from the best on, and the values that don't change are the settled ones. A round is a join by node, which
    adaptive execution may split, and an aggregation with map-side combining; no task holds a component.
    """
    scratch = Scratch(edges.sparkSession, "propagated")
    both, _ = scratch.keep(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).filter("a <> b"))
    own, _ = scratch.keep(_best(anchors.select("node", "label", F.col("score").cast("double").alias("score"), F.lit(0).alias("hops"))))
    state, path, was = own, None, None
    for _ in range(most_rounds):
        offers = state.filter(F.col("hops") < most_hops).join(both, state["node"] == both["a"]).select(F.col("b").alias("node"), "label", (F.col("score") * F.col("weight")).alias("score"), (F.col("hops") + 1).alias("hops"))
        after, after_path = scratch.keep(_best(own.unionByName(offers.filter(F.col("score") >= least))))
        if path:
            scratch.drop(path)
        state, path = after, after_path
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "label", "score", "hops")), F.sum(F.xxhash64("node", "hops", "score", "label").cast("decimal(20,0)"))).first())
        if now == was:
            return state
        was = now
    raise RuntimeError(f"propagation did not settle in {most_rounds} rounds")


def _best(offers: DataFrame) -> DataFrame:
    """The best offer of each node: highest score, of equals the least label, then the fewest hops."""
    best = offers.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("loss"), "label", "hops")).alias("best"))
    return best.select("node", "best.label", (-F.col("best.loss")).alias("score"), "best.hops")


def grown(edges: DataFrame, cells: DataFrame, most_step: float) -> DataFrame:
    """(node, region): regions grown breadth-first from seeds in order of rank, value and node.

    Cells are (node, rank, value), edges (a, b). A neighbour joins while its value is within `most_step` of
    the region's running mean, which moves with every cell it takes; a cell turned away may be met again
    from another side. A region's name is its seed.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["a"] == rows["b"]
        cells_here = rows[own].sort_values(["rank", "value", "a"])
        value = dict(zip(cells_here["a"], cells_here["value"], strict=True))
        near: dict[int, list[int]] = {n: [] for n in value}
        for row in rows[~own].itertuples():
            near[row.a].append(row.b)
            near[row.b].append(row.a)
        region: dict[int, int] = {}
        for seed in cells_here["a"]:
            if seed in region:
                continue
            region[seed], total, count, queue = seed, value[seed], 1, [seed]
            for node in queue:
                for other in sorted(near[node]):
                    if other not in region and abs(value[other] - total / count) <= most_step:
                        region[other] = seed
                        total, count = total + value[other], count + 1
                        queue.append(other)
        return pd.DataFrame({"node": list(region), "region": list(region.values())})

    kind = cells.schema["node"].dataType.simpleString()
    inside = by_component(edges.select("a", "b"), fold, f"node {kind}, region {kind}", cells)
    return inside.unionByName(cells.join(inside, "node", "left_anti").select("node", F.col("node").alias("region")))


def seeds_by_uncovered(edges: DataFrame, nodes: DataFrame, covered: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first k nodes of each group by the uncovered weight within one and two hops; nodes are (node, weight, group columns)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    free = nodes.join(covered, "node", "left_anti")
    weight = free.select(F.col("node").alias("b"), F.col("weight").alias("w"))
    one = both.join(weight, "b").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("one"))
    two = both.join(one.select(F.col("node").alias("b"), "one"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("one").alias("two"))
    gained = free.join(one, "node", "left").join(two, "node", "left").fillna(0.0, ["one", "two"])
    gained = gained.withColumn("gain", F.col("weight") + F.col("one") + 0.5 * F.col("two"))
    ranked = gained.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("gain"), "node")))
    return ranked.filter(F.col("place") <= k).select(*group, "node", "gain", "place")




def chained(rows: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """(keys, value, node, low, high) of rows (keys, value, node): each key's values in chains of steps of at most `gap`, with the chain's ends and its least node.

    A row for each distinct value. Rows of a chain are one component, and two chains have values within the gap of each
    other exactly where their ends do.
    """
    spots = rows.groupBy(*keys, value).agg(F.min("node").alias("node"))
    along = Window.partitionBy(*keys).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(along) > gap).cast("int"), F.lit(1))
    named = spots.withColumn("__new", new).withColumn("__chain", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chains = named.groupBy(*keys, "__chain").agg(F.min("node").alias("node"), F.min(value).alias("low"), F.max(value).alias("high"))
    return named.drop("node", "__new").join(chains, [*keys, "__chain"]).drop("__chain")


def image_components(points: DataFrame, keys: list[str], radius: int, gap: float, least: int) -> DataFrame:
    """(node, piece): points of a mask that hang together in the image: pixels (u, v) within `radius`, depths z within `gap`.

    `points` has (node, keys, u, v, z). A pixel's depths fall
    into chains of steps within the gap, and chains, not points, meet by pixel cells of the radius; pieces of fewer than `least`
    points share the null piece.
    """
    scratch = Scratch(points.sparkSession, "image")
    place = [*keys, "u", "v"]
    known = points.dropna(subset=[*place, "z"]).filter(~F.isnan("z"))
    spots, _ = scratch.keep(chained(known, place, "z", gap))
    chains, _ = scratch.keep(spots.select(*place, "node", "low", "high").distinct())
    cell = chains.withColumns({"cu": F.floor(F.col("u") / radius), "cv": F.floor(F.col("v") / radius)})
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    moved = cell.withColumn("s", F.explode(near)).withColumns({"cu": F.col("cu") + F.col("s.a"), "cv": F.col("cv") + F.col("s.b")})
    other = cell.select(*keys, "cu", "cv", *[F.col(c).alias(f"n_{c}") for c in ("node", "u", "v", "low", "high")])
    met = moved.join(other, [*keys, "cu", "cv"])
    close = (F.abs(F.col("u") - F.col("n_u")) <= radius) & (F.abs(F.col("v") - F.col("n_v")) <= radius) & (F.col("n_low") - F.col("high") <= gap) & (F.col("low") - F.col("n_high") <= gap)
    edges = met.filter((F.col("node") < F.col("n_node")) & close).select(F.col("node").alias("a"), F.col("n_node").alias("b"))
    named = spots.join(components(edges, chains.select("node")), "node").select(*place, "z", "component")
    found = points.join(named, [*place, "z"], "left").select("node", F.coalesce("component", "node").alias("component"))
    return sized(found, least).select("node", "piece")
