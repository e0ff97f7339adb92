"""Label transfer down the region tree, and its sessions.

All nodes of a level are one plan keyed by node: their observations are embedded and clustered together, their
anchors are searched together, and one cross table assigns all their clusters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.assignment import adjust_one_sided, cross_table, novel_clusters, quantile_anchors, reassign_novel, side_ratio
from loomspark.operators.embedding import control_clusters, group_components, group_k_means, group_scaled
from loomspark.operators.neighbours import anchors, vote_references
from loomspark.operators.postprocess import refine_boundary
from loomspark.operators.raster import boundary_scores
from loomspark.sources.materialise import materialise

#: ``(node, child_1, child_2, regions of the first, regions of the second)``
Split = tuple[str, str, str, list[str], list[str]]
#: From the active observations ``(node, section, obs_id, vector)`` and the sides of their nodes to ``(node, branch, obs_id)``.
Detect = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class TransferSettings:
    """Parameters of every round. ``clusters``: ``auto``, ``legacy`` or a number."""

    neighbours: int = 5
    components: int = 10
    clusters: str | int = "auto"
    least_clusters: int = 2
    boundary_cluster: bool = False
    most_clusters: int | None = None
    least_cluster: int = 10
    least_percent: float = 5.0
    cutoff: float | None = None
    one_sided_ratio: float | None = 10.0
    ratio_mode: str = "pooled"
    least_node: int = 2
    least_share: float = 0.05
    max_missing: int = 1
    seeds: int = 10
    #: Whether novel clusters may stay, whether others go to their neighbours' branch, by how many.
    novel: bool | str = "auto"
    reassign: bool = False
    reassign_neighbours: int = 25
    least_novel_share: float = 0.1
    #: C11 in a round: options of ``refine_boundary``, with ``least`` and ``veto`` of the scores.
    boundary: dict | None = None


def split_paths(splits: list[Split]) -> dict[str, int]:
    """Depth of every node, the root 0."""
    below = {c for _, a, b, _, _ in splits for c in (a, b)}
    depth = {node: 0 for node, *_ in splits if node not in below}
    for _ in splits:
        for node, a, b, _, _ in splits:
            if node in depth:
                depth[a] = depth[b] = depth[node] + 1
    return depth


def tree_splits(merges: list[tuple[str, str, str, list[str]]]) -> list[Split]:
    """Splits, root first, from the merges of a built tree."""
    regions = {node: names for node, _, _, names in merges}
    return [(node, a, b, regions.get(a, [a]), regions.get(b, [b])) for node, a, b, _ in reversed(merges)]


def cluster_count(n_regions: int, n_obs: int, settings: TransferSettings) -> int:
    """Clusters of a node with so many regions: one more than regions (``auto``), twice as many (``legacy``), or fixed.

    A boundary cluster is one more for ``legacy``. At least ``least_clusters`` and two, at most the observations.
    """
    if settings.clusters == "auto":
        asked = max(n_regions + 1, settings.least_clusters)
    elif settings.clusters == "legacy":
        asked = 2 * n_regions + int(settings.boundary_cluster)
    else:
        asked = int(settings.clusters)
    return min(max(asked, 2), n_obs)


def novel_allowed(children_regions: tuple[list[str], list[str]], policy: bool | str = "auto") -> bool:
    """With ``auto`` a node may hold novel clusters if either child is one region."""
    return min(map(len, children_regions)) == 1 if policy == "auto" else bool(policy)


def node_vectors(members: DataFrame, expr: DataFrame, features: DataFrame) -> DataFrame:
    """``members(node, section, obs_id, ...)`` with the values of their node's own features as ``vector``.

    ``expr(section, obs_id, feature, value)``, absent values count 0; ``features(parent, feature, place)`` as F03
    and F04 give them, some tens to hundreds a node, each once in its order. Nodes without features have no rows.
    """
    once = features.groupBy(F.col("parent").alias("node"), "feature").agg(F.min("place").alias("place"))
    lists = if_small(once.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x["feature"]).alias("_features")))
    wanted = members.select("node", "section", "obs_id").distinct().join(expr.select("section", "obs_id", "feature", "value").join(if_small(once.select("feature").distinct()), "feature", "left_semi"), ["section", "obs_id"])
    held = wanted.join(if_small(once.select("node", "feature")), ["node", "feature"]).groupBy("node", "section", "obs_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_held"))
    filled = F.transform("_features", lambda f: F.coalesce(F.try_element_at("_held", f), F.lit(0.0)))
    return members.join(lists, "node").join(held, ["node", "section", "obs_id"], "left").withColumn("vector", filled).drop("_features", "_held")


def nearest_detector(reference: DataFrame, settings: TransferSettings, several: bool = False, expr: DataFrame | None = None, features: DataFrame | None = None, guide: DataFrame | None = None) -> Detect:
    """L01 (one reference) or L02 (``several``, by votes of sections): anchors by nearest neighbours of both sides at once.

    With ``expr`` and ``features`` each node is searched in its own features (``node_vectors``), else in the
    references' ``vector``. ``guide(parent, section)``, as F07 gives it, says which sections a node learns from.
    """

    def detect(active: DataFrame, sides: DataFrame) -> DataFrame:
        marked = reference.join(if_small(sides.select("node", "branch", "label")), "label")
        if guide is not None:
            marked = marked.join(if_small(guide.select(F.col("parent").alias("node"), "section").distinct()), ["node", "section"], "left_semi")
        if features is not None:
            marked = node_vectors(marked.select("node", "section", "obs_id", "branch"), expr, features)
        marked = materialise(marked.select("node", F.col("branch").alias("label"), "section", "obs_id", "vector"))
        if not several:
            hits = anchors(marked.withColumn("obs_id", F.xxhash64("section", "obs_id")).drop("section"), active.select("node", "obs_id", "vector"), settings.neighbours, ["node"])
            return hits.select("node", F.col("label").alias("branch"), "obs_id")
        asked = marked.select("node", "section").distinct()
        copies = active.select("node", "obs_id", "vector").join(if_small(asked), "node")  # a copy a reference section
        hits = anchors(marked, copies, settings.neighbours, ["node", "section"])
        voted = vote_references(hits, asked, settings.max_missing, ["node"])
        return voted.select("node", F.col("label").alias("branch"), "obs_id")

    return detect


def quantile_detector(reference: DataFrame, query: DataFrame, features: DataFrame, **bounds: float) -> Detect:
    """Anchors by quantile thresholds; ``features(parent, direction, feature)``, long matrices for both sides."""

    def detect(active: DataFrame, sides: DataFrame) -> DataFrame:
        named = sides.select(F.col("node").alias("parent"), F.col("branch").alias("child"), "direction", "label")
        found = quantile_anchors(reference, query, named, features, **bounds)
        hit = found.where("anchor = 1").select(F.col("parent").alias("node"), "branch", "obs_id")
        return hit.join(active.select("node", "obs_id"), ["node", "obs_id"], "left_semi")

    return detect


@dataclass
class Session:
    """Who is in which node, and what was done.

    ``query(section, obs_id, vector)``; ``reference(section, obs_id, label, vector)`` gives the sizes of sides.
    Membership is a table that is written at each commit, so plans stay as long as one level. With ``expr`` and
    ``features`` each node is embedded by its own features (``node_vectors``) instead of ``vector``, and one that has
    none is not split. ``image``,
    ``(section, obs_id, feature, value)``, is what a boundary cluster is known by where the settings ask for
    that; this and reassigning need ``x`` and ``y`` in ``query``.
    """

    query: DataFrame
    reference: DataFrame
    splits: list[Split]
    detect: Detect
    settings: TransferSettings = TransferSettings()
    expr: DataFrame | None = None
    features: DataFrame | None = None
    image: DataFrame | None = None
    membership: DataFrame = field(init=False)
    rounds: list[dict] = field(default_factory=list)
    ended: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.children = {node: (a, b) for node, a, b, _, _ in self.splits}
        self.sides_of = {node: (x, y) for node, _, _, x, y in self.splits}
        self.depth = split_paths(self.splits)
        self.root = self.splits[0][0] if self.splits else "root"
        self.membership = materialise(self.query.select("section", "obs_id", F.lit(self.root).alias("node")))
        self.total = self.membership.count()
        self.featured = None if self.features is None else {r.parent for r in self.features.select("parent").distinct().collect()}  # a row a node

    def _sizes(self) -> dict[str, int]:
        return {r.node: r["count"] for r in self.membership.groupBy("node").count().collect()}  # a row a node

    def pending(self) -> list[str]:
        """Nodes that can be split now; others that hold observations, or were reached empty, are ended with the reason."""
        sizes = self._sizes()
        out = []
        done = {r["node"] for r in self.rounds}
        reached = {self.root} | {c for n in done if n in self.children for c in self.children[n]}
        for node in sorted(reached, key=lambda n: (self.depth.get(n, 0), n)):
            if node in done or node in self.ended:
                continue
            n = sizes.get(node, 0)
            if node not in self.children:
                self.ended[node] = "leaf"
            elif not n:
                self.ended[node] = "empty"
            elif n < self.settings.least_node or n < self.settings.least_share * self.total:
                self.ended[node] = "too few observations"
            elif self.featured is not None and node not in self.featured:
                self.ended[node] = "no features"
            else:
                out.append(node)
        return out

    def sides(self, nodes: list[str]) -> DataFrame:
        """``(node, branch, ord, direction, label)`` of the nodes' children."""
        rows = []
        for node in nodes:
            (a, b), (x, y) = self.children[node], self.sides_of[node]
            rows += [(node, a, 0, f"{a}_vs_{b}", label) for label in x] + [(node, b, 1, f"{b}_vs_{a}", label) for label in y]
        return self.query.sparkSession.createDataFrame(rows, "node string, branch string, ord int, direction string, label string")

    def preview(self, nodes: list[str]) -> DataFrame:
        """The branch of every observation of the nodes, ``(node, section, obs_id, cluster, branch, percent)``.

        Null where its cluster is too small or novel. Nothing changes in the session.
        """
        s = self.settings
        sizes = self._sizes()
        members = self.membership.where(F.col("node").isin(nodes)).select("section", "obs_id", "node")
        active = self.query.join(members, ["section", "obs_id"])
        active = materialise(active if self.features is None else node_vectors(active.drop("vector"), self.expr, self.features))
        counts = {n: cluster_count(sum(map(len, self.sides_of[n])), sizes[n], s) for n in nodes}
        embedded = materialise(group_scaled(group_components(active, "node", s.components), "node", "pca"))
        found = group_k_means(embedded, "node", counts, "pca", s.seeds).withColumnRenamed("key", "node")
        clusters = embedded.join(found, ["node", "section", "obs_id"])
        if s.most_clusters is not None:
            clusters = control_clusters(clusters, 1, s.most_clusters, "pca", ["node"])
        clusters = materialise(clusters.select("node", "section", "obs_id", "cluster"))
        if s.boundary is not None and self.image is not None:
            clusters = materialise(self._refined(clusters))
        sides = self.sides(nodes)
        hits = materialise(self.detect(active, sides))
        table = materialise(cross_table(clusters.select("node", "obs_id", "cluster"), hits, sides.select("node", "branch", "ord").distinct(), ["node"]))
        sided = self.reference.join(if_small(sides.select("node", "label", F.when(F.col("ord") == 0, "first").otherwise("second").alias("side"))), "label")
        ratios = side_ratio(sided, "first", "second", s.ratio_mode, by=["node"])
        threshold = s.one_sided_ratio if s.one_sided_ratio is not None else float("inf")
        chosen = adjust_one_sided(table, ratios, threshold, s.cutoff, by=["node"], least_size=s.least_cluster, least_percent=s.least_percent)
        chosen = materialise(chosen.select("node", "cluster", "size", "branch", "percent"))
        placed = clusters.join(if_small(chosen.drop("size")), ["node", "cluster"], "left")
        if s.reassign:
            placed = self._reassigned(materialise(placed), chosen, nodes, sizes)
        return placed.withColumn("branch", F.when(F.col("branch") != "novel_cluster", F.col("branch")))

    def _refined(self, clusters: DataFrame) -> DataFrame:
        """The boundary cluster of each node and section is dealt to the others; all nodes at once."""
        own = F.concat_ws("\u0001", "node", "section")
        joint = clusters.join(self.query.select("section", "obs_id", "x", "y"), ["section", "obs_id"]).withColumn("section", own)
        options = dict(self.settings.boundary or {})
        seen = clusters.select("node", "section", "obs_id").join(self.image, ["section", "obs_id"]).withColumn("section", own).select("section", "obs_id", "feature", "value")
        scores = boundary_scores(joint.select("section", "obs_id", "cluster"), seen, options.pop("least", 10), options.pop("veto", 0.8))
        found = refine_boundary(joint.select("section", "obs_id", "x", "y", "cluster"), scores, **options)
        part = F.split("section", "\u0001")
        return found.select(part[0].alias("node"), part[1].alias("section"), "obs_id", F.col("refined").cast("int").alias("cluster"))

    def _reassigned(self, placed: DataFrame, chosen: DataFrame, nodes: list[str], sizes: dict[str, int]) -> DataFrame:
        """Novel clusters that must not stay, and those too large to be novel, go to their neighbours' branch."""
        s, out = self.settings, placed
        at = self.query.select("section", "obs_id", "x", "y")
        for node in nodes:
            wanted = novel_clusters(chosen.where(F.col("node") == node), sizes[node], novel_allowed(self.sides_of[node], s.novel), s.least_novel_share)
            if not wanted:
                continue
            own = out.where(F.col("node") == node)
            labelled = own.where("branch is not null").join(at, ["section", "obs_id"]).select("section", "obs_id", "x", "y", "cluster", F.col("branch").alias("label"))
            moved = reassign_novel(labelled, wanted, s.reassign_neighbours).select("section", "obs_id", F.lit(node).alias("node"), F.col("label").alias("_moved"))
            out = materialise(out.join(moved, ["node", "section", "obs_id"], "left").withColumn("branch", F.coalesce("_moved", "branch")).drop("_moved"))
        return out

    def commit(self, nodes: list[str], moved: DataFrame) -> None:
        """Put observations into children; what lay below the nodes from an earlier round goes back to them first."""
        under = {n: [d for d in self.depth if d != n and self._above(d, n)] for n in nodes}
        back = {d: n for n, below in under.items() for d in below}
        self.rounds = [r for r in self.rounds if r["node"] not in nodes and r["node"] not in back]
        self.ended = {n: why for n, why in self.ended.items() if n not in back and n not in nodes}
        if back:
            home = F.coalesce(*[F.when(F.col("node") == d, F.lit(n)) for d, n in back.items()], "node")
            self.membership = self.membership.withColumn("node", home)
        here = self.membership.join(moved.select("node", "section", "obs_id", "branch"), ["node", "section", "obs_id"], "left")
        self.membership = materialise(here.select("section", "obs_id", F.coalesce("branch", "node").alias("node")))
        sizes = self._sizes()
        for node in nodes:
            a, b = self.children[node]
            n = [sizes.get(x, 0) for x in (a, b, node)]
            self.rounds.append({"node": node, "child_1": a, "child_2": b, "n_obs": sum(n), "n_child_1": n[0], "n_child_2": n[1], "n_unresolved": n[2]})

    def _above(self, node: str, other: str) -> bool:
        parent = {c: n for n, pair in self.children.items() for c in pair}
        while node in parent:
            node = parent[node]
            if node == other:
                return True
        return False

    def run_round(self, nodes: list[str], override: DataFrame | None = None) -> DataFrame:
        """Compute a round, or take a given assignment ``(node, section, obs_id, branch)``, and commit it."""
        moved = materialise(override if override is not None else self.preview(nodes))
        self.commit(nodes, moved)
        return moved

    def run_auto(self) -> Session:
        """Level by level until no node is left to split."""
        while nodes := self.pending():
            self.run_round(nodes)
        return self

    def labels(self) -> DataFrame:
        """The label of every observation, the node it ended in: ``(section, obs_id, label)``."""
        return self.membership.select("section", "obs_id", F.col("node").alias("label"))

    def summary(self) -> DataFrame:
        """One row a round."""
        kinds = "node string, child_1 string, child_2 string, n_obs long, n_child_1 long, n_child_2 long, n_unresolved long"
        return self.query.sparkSession.createDataFrame([tuple(r.values()) for r in self.rounds], kinds)


def transfer_single(reference: DataFrame, query: DataFrame, splits: list[Split], settings: TransferSettings = TransferSettings(), expr: DataFrame | None = None, features: DataFrame | None = None, image: DataFrame | None = None) -> Session:
    """One reference, anchors by nearest neighbours, in each node's own features where these are given."""
    return Session(query, reference, splits, nearest_detector(reference, settings, False, expr, features), settings, expr, features, image)


def transfer_multi(reference: DataFrame, query: DataFrame, splits: list[Split], settings: TransferSettings = TransferSettings(), expr: DataFrame | None = None, features: DataFrame | None = None, guide: DataFrame | None = None, image: DataFrame | None = None) -> Session:
    """Several reference sections vote on anchors, those that the guide names for a node."""
    return Session(query, reference, splits, nearest_detector(reference, settings, True, expr, features, guide), settings, expr, features, image)


def transfer_quantile(reference: DataFrame, query: DataFrame, expr: DataFrame, features: DataFrame, splits: list[Split], settings: TransferSettings = TransferSettings(), **bounds: float) -> Session:
    """Anchors by quantile thresholds; ``expr`` is the long matrix of references and query."""
    own = expr.join(query.select("section", "obs_id"), ["section", "obs_id"], "left_semi").select("section", "obs_id", "feature", "value")
    others = expr.join(query.select("section", "obs_id"), ["section", "obs_id"], "left_anti").select("label", "feature", "value")
    return Session(query, reference, splits, quantile_detector(others, own, features, **bounds), settings)
