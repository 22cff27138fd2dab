"""Embedding near-duplicates: a forest of random-projection trees with spill, verified and joined.

Two vectors are linked if their cosine, in double precision, is at least ``COSINE``. Equal vectors are one
*node* with a number of copies. What is done with the nodes:

* **Cores.** A group of near copies may hold a third of all rows; no leaf could take it. Around centres found
  in a sample of ``SAMPLE`` nodes, all nodes within half the angle of the threshold form a core: by the triangle
  inequality any two of them are linked, so the core's links are counts, whatever its size. The centres (a few
  hundred at most) go to every task. A node outside is compared with each centre: by the core's measured radius
  it is linked with all its members, with none, or the core is *open* to it; then it is compared with the
  members themselves, in blocks.
* **Forest.** The other nodes go down ``TREES`` trees. Each level projects on a random direction and splits at
  the median; the ``SPILL`` share of nodes nearest to the median goes to both sides. The upper levels take
  their medians from the sample; leaves that are still larger than ``LEAF`` are split on by medians of all
  their rows, level by level. A leaf that cannot be split (its rows project alike) is compared in blocks.
* **Verify and union.** Each leaf compares its nodes exactly. A node brings all its leaves along, so a pair that
  meets in several leaves counts in the first one only. A leaf hands on one edge for each node to its
  component within the leaf; ``components`` joins these.

A pair at cosine 0.95 is missed if all trees cut it: with 64 dimensions and seven levels about one in a
thousand; nearer pairs far less. No pair below the threshold is linked. The limit of the method: a group of
more nodes than a leaf holds whose members lie further than half the angle from their centre (cosine 0.987), or
which is too rare for the sample, is cut by its own medians and loses some links between its members.

Defined cases: null, empty and zero vectors and those with null or non-finite entries link with nothing, as do
vectors of different lengths with each other. Rows with equal ids are vectors of their own that share the
component id; a null id is larger than all others (a component of null ids only has a null id and ``kept`` is
null). Other columns are not carried.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components

COSINE = 0.95
TREES, LEAF, SPILL = 6, 512, 0.06
#: Nodes the cores and the upper levels are learnt from, and the least of them in a leaf of the sample.
SAMPLE, LEAST = 16_384, 48
#: A core has at least this many sample nodes, and at least a leaf of all nodes.
CORE = 8
#: Nodes compared at a time where a core or a leaf is too large for one task.
BLOCK = 512
MOST_LEVELS = 60
NODE = "key binary, dim int, unit binary, copies long"
_ROUTED = "key binary, dim int, unit binary, copies long, tree int, leaf long, level int"


def _units(column):
    """Each vector divided by its length, or None where it has no direction."""
    out = []
    for v in column.to_pylist():
        x = None if v is None or None in v else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            out.append(x / np.sqrt(x @ x))
        else:
            out.append(None)
    return out


def _nodes(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, vector) with the ``key`` of the vector's direction, its ``unit`` and ``dim``."""
    def keyed(batches):
        for batch in batches:
            units = [None if u is None else (u + 0.0).tobytes() for u in _units(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units], pa.binary()),
                 pa.array([0 if u is None else len(u) // 8 for u in units], pa.int32()), pa.array(units, pa.binary())],
                names=["vec_id", "key", "dim", "unit"])
    return rows.mapInArrow(keyed, "vec_id long, key binary, dim int, unit binary")


def _matrix(column, dim=None):
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def _direction(tree: int, level: int, dim: int):
    return np.random.default_rng([tree, level, dim]).normal(size=dim)


def _leaves(tree, paths):
    """Numbers of leaves, from their tree and path."""
    x = paths.astype(np.uint64) + np.uint64(tree << 48)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _near() -> float:
    """The least cosine with its centre of a core's member: half the angle, and a little for rounding."""
    return float(np.cos(np.arccos(COSINE) / 2)) + 1e-12


class Plan:
    """What the sample of one dimension tells: centres of cores, and medians of the upper levels."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF):
        near = _near()
        least = max(CORE, leaf * len(sample) / max(rows, 1))
        self.centres = self._centres(sample, least, near)
        self.levels, outside = [], sample
        if len(self.centres):
            outside = sample[(sample @ self.centres.T).max(1) < near]
        want = max(0, int(np.ceil(np.log2(max(rows * len(outside) / max(len(sample), 1), 1) / leaf))))
        depth = min(want, int(np.log2(max(len(outside) / LEAST, 1))))
        self.trees = [self._tree(outside, t, depth) for t in range(TREES)] if depth else []
        self.depth = depth

    @staticmethod
    def _centres(sample, least, near):
        """Means of dense places, densest first; those of a place already taken are left out."""
        reach, degree = 2 * near * near - 1, np.zeros(len(sample), np.int64)    # the whole angle
        for at in range(0, len(sample), 2048):
            degree[at:at + 2048] = (sample[at:at + 2048] @ sample.T >= reach).sum(1)
        free, found = np.ones(len(sample), bool), []
        for i in np.argsort(-degree, kind="stable"):
            if degree[i] < least:
                break
            if not free[i]:
                continue
            close = free & (sample @ sample[i] >= reach)
            centre = sample[close].mean(0)
            centre /= np.sqrt(centre @ centre)
            inside = free & (sample @ centre >= near)
            free[i] = False
            if inside.sum() >= least:
                found.append(centre)
                free &= ~inside
        return np.array(found).reshape(-1, sample.shape[1] if sample.size else 0)

    @staticmethod
    def _tree(x, tree, depth):
        """Lower, middle and upper bound of each inner node, by path (root 1, children 2p and 2p + 1)."""
        bounds, of = np.zeros((1 << depth, 3)), {1: np.arange(len(x))}
        for level in range(depth):
            along = x @ _direction(tree, level, x.shape[1])
            for path in range(1 << level, 2 << level):
                here = of.pop(path)
                if len(here):
                    bounds[path] = low, mid, high = np.quantile(along[here], (0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2))
                    of[2 * path], of[2 * path + 1] = here[along[here] < mid], here[along[here] >= mid]
                else:
                    of[2 * path] = of[2 * path + 1] = here
        return bounds

    def paths(self, x, tree):
        """Every (row, leaf path) of a tree."""
        rows, paths = np.arange(len(x)), np.ones(len(x), np.int64)
        for level in range(self.depth):
            along = (x @ _direction(tree, level, x.shape[1]))[rows]
            low, _, high = self.trees[tree][paths].T
            left, right = along <= high, along >= low
            rows, paths = (np.concatenate((rows[left], rows[right])),
                           np.concatenate((2 * paths[left], 2 * paths[right] + 1)))
        return rows, paths


def _plans(nodes: DataFrame, leaf: int) -> dict[int, Plan]:
    """One plan for each dimension, from the nodes with the smallest keys (keys are hashes)."""
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "dim").head(64)}
    plans = {}
    for dim, rows in sizes.items():      # dimensions beyond the 64 most frequent go without a plan
        sample = nodes.where(F.col("dim") == dim).select("key", "unit").orderBy("key").head(SAMPLE)
        plans[dim] = Plan(np.frombuffer(b"".join(r["unit"] for r in sample)).reshape(len(sample), dim), rows, leaf)
    return plans


def _by_dim(batch, at=1):
    dims = batch.column(at).to_numpy()
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _placed(nodes: DataFrame, plans) -> DataFrame:
    """Nodes with their ``core`` (null: none) as dim << 32 | number, and the ``angle`` to its centre."""
    near = _near()

    def place(batches):
        for batch in batches:
            core, angle = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
            for dim, at in _by_dim(batch):
                if dim in plans and len(plans[dim].centres):
                    cos = _matrix(batch.column(2).take(pa.array(at))) @ plans[dim].centres.T
                    best = cos.argmax(1)
                    cos = cos[np.arange(len(at)), best]
                    core[at] = np.where(cos >= near, dim << 32 | best, -1)
                    angle[at] = np.arccos(np.clip(cos, -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(core, mask=core < 0), pa.array(angle)],
                names=["key", "dim", "unit", "copies", "core", "angle"])
    return nodes.mapInArrow(place, NODE + ", core long, angle double")


def _routed(nodes: DataFrame, plans) -> DataFrame:
    """A row for every leaf a node falls into by the sample's medians."""
    def route(batches):
        for batch in batches:
            for dim, at in _by_dim(batch):
                x = _matrix(batch.column(2).take(pa.array(at)))
                depth = plans[dim].depth if dim in plans else 0
                for tree in range(TREES):
                    rows, paths = plans[dim].paths(x, tree) if depth else (np.arange(len(at)), np.ones(len(at), np.int64))
                    taken = batch.take(pa.array(at[rows]))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(np.full(len(rows), tree, np.int32)), pa.array(_leaves(tree, paths)),
                         pa.array(np.full(len(rows), depth, np.int32))],
                        names=["key", "dim", "unit", "copies", "tree", "leaf", "level"])
    return nodes.select("key", "dim", "unit", "copies").mapInArrow(route, _ROUTED)


def _deepened(routed: DataFrame, leaf: int) -> DataFrame:
    """Leaves of more than ``leaf`` nodes (with spill, half more) split on by medians of all their rows."""
    settled, most = [], leaf * 1.5
    while True:
        routed = keep(routed, "routed")
        large = routed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("level").alias("deepest")).where(
            f"n > {most} and deepest < {MOST_LEVELS}").select("dim", "leaf")
        large = keep(large, "large")
        if large.isEmpty():
            settled.append(routed)
            break
        settled.append(routed.join(large, ["dim", "leaf"], "left_anti").select(routed.columns))

        def project(batches):
            for batch in batches:
                along = np.empty(batch.num_rows)
                keys = np.stack([batch.column(c).to_numpy() for c in (4, 6, 1)], 1)
                for key in np.unique(keys, axis=0):
                    at = np.flatnonzero((keys == key).all(1))
                    along[at] = _matrix(batch.column(2).take(pa.array(at))) @ _direction(*map(int, key))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], names=[*batch.schema.names, "along"])

        open_ = keep(routed.join(large, ["dim", "leaf"], "left_semi").select(routed.columns)
                     .mapInArrow(project, _ROUTED + ", along double"), "open")
        cuts = open_.groupBy("dim", "leaf").agg(F.percentile_approx(
            "along", [0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2], 2000).alias("cut"),
            F.min("along").alias("least"), F.max("along").alias("greatest"))
        # rows that project alike stay together: such a leaf is as deep as any and is compared in blocks
        same = F.col("least") >= F.col("cut")[1]
        side = F.when(same, F.array(F.lit(0))).otherwise(F.filter(F.array(
            F.when(F.col("along") <= F.col("cut")[2], 0), F.when(F.col("along") >= F.col("cut")[0], 1)),
            lambda s: s.isNotNull()))
        # a leaf whose halves both hold nearly all rows would go on for ever: levels are bounded
        routed = open_.join(cuts, ["dim", "leaf"]).select(
            "key", "dim", "unit", "copies", "tree", F.explode(side).alias("side"), "leaf",
            F.when(same, MOST_LEVELS).otherwise(F.col("level") + 1).cast("int").alias("level")).select(
            "key", "dim", "unit", "copies", "tree",
            F.when(F.col("level") == MOST_LEVELS, F.col("leaf")).otherwise(F.xxhash64("leaf", "side")).alias("leaf"), "level")
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def _local_labels(linked):
    """The smallest index each row is connected with, for a symmetric matrix of links."""
    labels = np.arange(len(linked))
    while True:
        least = np.where(linked, labels[None, :], len(linked)).min(1)
        least = np.minimum(labels, least)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


_FOUND = "key binary, peer binary, links long"


def _found(keys, peers, links):
    return pa.table({"key": pa.array(keys, pa.binary()), "peer": pa.array(peers, pa.binary()),
                     "links": pa.array(links, pa.int64())})


def _within(table: pa.Table) -> pa.Table:
    """The links of one cell of a leaf: among its rows, or between its two blocks (``side`` 0 and 1)."""
    keys, copies = table["key"].to_pylist(), table["copies"].to_numpy()
    x, side = _matrix(table["unit"].combine_chunks()), table["side"].to_numpy()
    linked = x @ x.T >= COSINE
    np.fill_diagonal(linked, False)
    if table["apart"][0].as_py():
        linked &= side[:, None] != side[None, :]
    here = table["leaf"][0].as_py()
    counted = linked.copy()
    one, two = np.nonzero(np.triu(linked))
    if len(one):
        # leaves before this one, padded by numbers that no other row has
        before = [ls[:ls.index(here)] for ls in table["leaves"].to_pylist()]
        width = max(map(len, before))
        if width:
            padded = np.repeat(-1 - np.arange(len(keys))[:, None], width, 1)
            for i, ls in enumerate(before):
                padded[i, :len(ls)] = ls
            for at in range(0, len(one), 1 << 16):
                i, j = one[at:at + (1 << 16)], two[at:at + (1 << 16)]
                met = np.zeros(len(i), bool)
                for c in range(width):
                    met |= (padded[i, c, None] == padded[j]).any(1)
                counted[i[met], j[met]] = counted[j[met], i[met]] = False
    links = counted @ copies
    labels = _local_labels(linked)
    shown = np.flatnonzero((labels != np.arange(len(keys))) | (links > 0))
    return _found([keys[i] for i in shown], [keys[labels[i]] for i in shown], links[shown])


def _forest_links(nodes: DataFrame, plans, leaf: int, block: int) -> DataFrame:
    """``key``, a ``peer`` it is connected with, and how many copies it is linked with, by cells of leaves."""
    routed = keep(_deepened(_routed(nodes, plans), leaf), "leaves")
    leaves = routed.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("tree", "leaf"))).alias("l")).select(
        F.col("key").alias("of"), F.col("l.leaf").alias("leaves"))
    sizes = routed.groupBy("dim", "leaf").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("dim").alias("d"), F.col("leaf").alias("in"), F.ceil(F.col("n") / (2 * block)).alias("blocks"))
    rows = routed.join(leaves, F.col("key") == F.col("of")).join(sizes, (F.col("leaf") == F.col("in")) & (F.col("dim") == F.col("d")))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks"))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("key", "dim", "unit", "copies", "leaf", "leaves", F.least("mine", "other").alias("low"),
                        F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"),
                        (F.col("mine") != F.col("other")).alias("apart"))
    return cells.groupBy("dim", "leaf", "low", "high").applyInArrow(_within, _FOUND)


def _core_links(placed: DataFrame, plans, block: int) -> DataFrame:
    """Links of cores: among their members, and of every other node with them."""
    angle = float(np.arccos(COSINE))
    cores = placed.where("core is not null").groupBy("core").agg(
        F.max("angle").alias("radius"), F.min("key").alias("least"), F.sum("copies").alias("copies"), F.count("*").alias("n"))
    known = {r["core"]: r for r in cores.head(sum(len(p.centres) for p in plans.values()))}

    def compare(batches):
        for batch in batches:
            keys, near, open_ = [], [], []
            own = batch.column(4).to_pylist()
            for dim, at in _by_dim(batch):
                centres = plans[dim].centres if dim in plans else ()
                if not len(centres):
                    continue
                angles = np.arccos(np.clip(_matrix(batch.column(2).take(pa.array(at))) @ centres.T, -1, 1))
                numbers = [dim << 32 | c for c in range(len(centres))]
                radius = np.array([known[c]["radius"] if c in known else -9.0 for c in numbers])
                for i, c in zip(*np.nonzero(angles <= angle + radius + 1e-9)):
                    if numbers[c] != own[at[i]]:
                        keys.append(at[i])
                        near.append(numbers[c])
                        open_.append(bool(angles[i, c] + radius[c] > angle - 1e-9))
            taken = batch.take(pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:5], pa.array(near, pa.int64()), pa.array(open_, pa.bool_())],
                                             names=["key", "dim", "unit", "copies", "core", "near", "open"])

    meets = keep(placed.mapInArrow(compare, NODE + ", core long, near long, open boolean"), "meets")
    per_core = cores.select(F.col("core").alias("near"), F.col("least").alias("peer"), F.col("copies").alias("all"), "n")
    # a core's own links; the node itself is no link (its other copies are counted with the rows)
    own = placed.join(per_core, F.col("core") == F.col("near")).select("key", "peer", (F.col("all") - F.col("copies")).alias("links"))
    sure = meets.where("not open").join(per_core, "near")
    forth = sure.select("key", "peer", F.col("all").alias("links"))
    # the members are told of nodes outside all cores; nodes of cores count for themselves
    told = sure.where("core is null").groupBy("near").agg(F.sum("copies").alias("more"))
    back = placed.join(told, F.col("core") == F.col("near")).select(
        "key", F.lit(None).cast("binary").alias("peer"), F.col("more").alias("links"))

    asked = meets.where("open").join(per_core, "near")
    askers = asked.groupBy("near").agg(F.count("*").alias("askers"))
    parts = F.ceil(F.col("n") / block)
    queries = asked.join(askers, "near").select(
        "key", "unit", "copies", F.col("core").isNull().alias("alone"), F.lit(True).alias("asks"), "near", "peer",
        F.pmod(F.xxhash64("key"), F.ceil(F.col("askers") / block)).alias("batch"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    members = placed.join(per_core, F.col("core") == F.col("near")).join(askers, "near").select(
        "key", "unit", "copies", F.lit(False).alias("alone"), F.lit(False).alias("asks"), "near", "peer",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("askers") / block) - 1)).alias("batch"),
        F.pmod(F.xxhash64("key"), parts).alias("part"))

    def between(table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist(), bool)
        keys, copies, alone = table["key"].to_pylist(), table["copies"].to_numpy(), np.array(table["alone"].to_pylist(), bool)
        x, peer = _matrix(table["unit"].combine_chunks()), table["peer"][0].as_py()
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        linked = x[a] @ x[b].T >= COSINE
        found = np.zeros(len(keys), np.int64)
        found[a] = linked @ copies[b]
        found[b] = (linked * (copies[a] * alone[a])[:, None]).sum(0)
        shown = np.flatnonzero(found)
        return _found([keys[i] for i in shown], [peer if asks[i] else None for i in shown], found[shown])

    opened = queries.union(members).groupBy("near", "batch", "part").applyInArrow(between, _FOUND)
    return own.union(forth).union(back).union(opened)


def link(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", leaf: int = LEAF,
         block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``embeddings``."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = keep(_nodes(rows), "vectors")
    nodes = keep(rows.where("key is not null").groupBy("key").agg(
        F.any_value("dim").alias("dim"), F.any_value("unit").alias("unit"), F.count("*").alias("copies")), "nodes")
    plans = _plans(nodes, leaf)
    placed = nodes.withColumn("core", F.lit(None).cast("long")).withColumn("angle", F.lit(0.0))
    found = None
    if any(len(p.centres) for p in plans.values()):
        placed = keep(_placed(nodes, plans), "placed")
        found = _core_links(placed, plans, block)
    forest = _forest_links(placed.where("core is null"), plans, leaf, block)
    found = keep(forest if found is None else forest.union(found), "found")
    labels = components(found.where("peer is not null and peer <> key").select(
        F.col("key").alias("u"), F.col("peer").alias("v")).distinct())
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    nodes = nodes.select("key", "copies").join(counts, "key", "left").join(
        labels.withColumnRenamed("node", "key"), "key", "left").select(
        F.col("key").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("label", "key").alias("label"))
    placed = rows.select("vec_id", "key").join(nodes, F.col("key") == F.col("of"), "left")
    least = placed.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("least")).select(
        F.col("label").alias("group"), "least")
    out = placed.join(least, F.col("label") == F.col("group"), "left")
    component = F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
