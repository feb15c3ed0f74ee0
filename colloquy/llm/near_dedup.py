"""Near-duplicate groups by MinHash with tensored banding.

A table key of banding needs ``2k`` MinHash values. Here ``m`` left halves and ``m`` right halves of
``k`` values each are computed once, and every pair (left i, right j) is a key of one of ``m * m``
tables: ``2 * m * k`` MinHash values do the work of ``2 * k * m * m``. Two texts of similarity s meet
in a table with probability ``(1 - (1 - s**k)**m) ** 2``; for the defaults and s = 0.85 all but about
6 in 100,000 pairs meet, for s = 0.9 all but 6 in 10 million.

Texts that meet form candidate clusters, found by contraction: the tables of left half i and right half i
first, then, of all tables, those in which two clusters meet. A cluster of up to ``BLOCK`` texts is
confirmed in one group: the sizes of all intersections of full shingle sets are one product of 0/1
matrices. In a larger one, members are first compared with their buckets' centres (the members whose
halves are shared most), so a group of g copies costs g comparisons. Where that leaves several components,
those that still meet in a table go on: as small clusters of their own, or in pairs of blocks of nodes.
No link between components is lost, and no pair of texts is ever a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from colloquy.functions.storage import checkpointed
from colloquy.llm.blocks import blocks, distinct_sets, mix, shingle_hashes, word_hashes

__all__ = ["connected_components", "contracted", "near_duplicates"]

SHINGLE_WORDS = 5
HALF_HASHES = 4
HALVES = 14
#: Rows of a partition of small tables, and partitions that they have at least.
FEW_ROWS, FEW = 1_000_000, 8
#: Nodes with their keys (at most 64 bytes each) are sent to all tasks up to this number, else joined by shuffle.
BROADCAST_NODES = 500_000
#: Two columns of numbers are sent to all tasks up to this number of rows.
BROADCAST_ROWS = 100_000
#: Numbers of a set, for a guess at how much pairs of sets are.
SET_NUMBERS = 256
#: Texts of a group that is confirmed at once.
BLOCK = 1024
_COLUMNS = 4096


def _sets_of(column: pa.Array, width: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    for block in blocks(column):
        words, doc = word_hashes(block)
        h, d = shingle_hashes(words, doc, len(block), width)
        yield (block.rows, *distinct_sets(h, d, len(block)))


def _set_keys(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes for each set, whatever the order of its values."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(0x51ED27)), dtype=np.uint64)])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)])
    both = np.stack([one[bounds[1:]] - one[bounds[:-1]], two[bounds[1:]] - two[bounds[:-1]]], axis=1)
    flat = np.ascontiguousarray(both).tobytes()
    return [flat[16 * i : 16 * i + 16] for i in range(len(bounds) - 1)]


def _halves(values: np.ndarray, bounds: np.ndarray, k: int, m: int, seed: int) -> np.ndarray:
    """The 2m half keys of each set: m left, then m right. Sets must not be empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, 2 * m * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, 2 * m * k, dtype=np.uint64)
    out = np.empty((len(bounds) - 1, 2 * m), np.uint64)
    for half in range(2 * m):
        key = np.full(len(bounds) - 1, half, np.uint64)
        for j in range(half * k, half * k + k):
            key = mix(key ^ np.minimum.reduceat(values * factors[j] + shifts[j], bounds[:-1]))
        out[:, half] = key
    return out


def _signatures(docs: DataFrame, width: int, k: int, m: int, seed: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, bounds in _sets_of(batch.column(1), width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                halves = np.zeros((len(rows), 2 * m), np.uint64)
                if len(full):
                    halves[full] = _halves(values, np.append(bounds[:-1][full], bounds[-1]), k, m, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(rows.start, len(rows)),
                        pa.array(sizes),
                        pa.array(_set_keys(values, bounds), pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(halves.view(np.int64).ravel()), 2 * m).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "halves"],
                )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, halves array<long>")


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows (text, set_key, ..) with the text's shingles in its place, where it is the text that has the key."""
    rest = [f for f in texts.schema.fields if f.name not in ("text", "set_key")]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for rows, values, bounds in _sets_of(batch.column(0), width):
                own = pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(rows.start, len(rows)) for c in batch.columns[2:]),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64))),
                    ],
                    names=[*(f.name for f in rest), "shingles"],
                )
                yield own.filter(pa.array([k == w for k, w in zip(_set_keys(values, bounds), wanted[rows.start : rows.stop], strict=True)]))

    kind = StructType([*rest, StructField("shingles", ArrayType(LongType()))])
    return texts.select("text", "set_key", *(f.name for f in rest)).mapInArrow(rows_of, kind)


def _near(n1: Column, n2: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _few(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in as many partitions as ``rows`` rows need, so that small tables don't become many tasks and files."""
    return df if rows is None else df.coalesce(max(FEW, -(-rows // FEW_ROWS)))


def _sent(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` for a join, of ``rows`` rows at most: sent to all tasks where these are few."""
    return df if rows is None or rows > BROADCAST_ROWS else F.broadcast(_few(df, rows))


def contracted(members: DataFrame, bucket: tuple[str, ...] = ("bucket",), rows: int | None = None) -> DataFrame:
    """Columns node, component (smallest node reachable) of the nodes that share a bucket with another.

    Each node gives way to the node of least hash in its buckets. A round costs a row for each (bucket,
    node) that is left, and buckets with one node are settled; as hashes stand in no order, the nodes
    that are left shrink by a factor each round. Each is written to the checkpoint folder. ``rows`` is a
    bound of the rows of ``members``, where one is known.
    """
    labels, n_labels = members.select("node", F.col("node").alias("component")).limit(0), 0
    for turn in itertools.count():
        least = members.groupBy(*bucket).agg(F.min_by("node", F.xxhash64("node")).alias("top"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        members = members.join(_sent(least.where("lo < hi").drop("lo", "hi"), rows), list(bucket)).select(*bucket, "node", "top")
        members = checkpointed(_few(members, rows))
        rows = members.count()
        if not rows:
            break
        parents = members.groupBy("node").agg(F.min_by("top", F.xxhash64("top")).alias("parent"))
        up = parents.select(F.col("node").alias("component"), "parent")
        if turn:
            labels = _few(labels.join(_sent(up, rows), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), n_labels)
        else:
            labels, n_labels = _few(up.select(F.col("component").alias("node"), F.col("parent").alias("component")), rows), rows
        members = _few(_few(members, rows).join(_sent(parents, rows), "node").select(*bucket, F.col("parent").alias("node")).distinct(), rows)
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return checkpointed(_few(labels.join(_sent(least, n_labels), "component").select("node", F.col("least").alias("component")), n_labels))


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Columns node, component (smallest node reachable) of the nodes in ``links`` (a, b).

    Nulls in ``links`` and links of a node with itself are ignored; no links give no rows. ``rows`` is a bound
    of the rows of ``links``, where one is known.
    """
    edges = links.where("a < b or b < a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return contracted(_few(edges, rows).select("a", "b", F.explode(F.array("a", "b")).alias("node")), ("a", "b"), rows and 2 * rows)


def _linked(nodes: np.ndarray, components: np.ndarray, flat: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A link for every two components of a group that have one, from all pairs of its full sets."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], owner[order]
    first = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(first) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    shared = np.zeros((len(sizes), len(sizes)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, [at, at + _COLUMNS])
        present = np.zeros((len(sizes), min(_COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        present[owner[low:high], column[low:high] - at] = 1
        shared += present @ present.T
    linked = shared.astype(np.float64) * 100 >= percent * (sizes[:, None] + sizes[None, :] - shared.astype(np.float64))
    i, j = np.nonzero(np.triu(linked, 1) & (components[:, None] != components[None, :]))
    if not len(i):
        return []
    two = np.sort(np.stack([components[i], components[j]], axis=1), axis=1)
    _, pick = np.unique(two, axis=0, return_index=True)
    return list(zip(nodes[i[pick]].tolist(), nodes[j[pick]].tolist(), strict=True))


def _group_links(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """The nodes of each cluster in a group, and its links."""
    table = table.sort_by([("cluster", "ascending"), ("node", "ascending")]).combine_chunks()
    clusters, nodes, components = (table[c].to_numpy() for c in ("cluster", "node", "component"))
    sets = table["shingles"].chunk(0) if table["shingles"].num_chunks else pa.array([], pa.list_(pa.int64()))
    bounds, flat = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
    first = np.flatnonzero(np.append(True, clusters[1:] != clusters[:-1])) if len(clusters) else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first, len(clusters))[1:], strict=True):
        own = bounds[a : b + 1]
        yield nodes[a:b], _linked(nodes[a:b], components[a:b], flat[own[0] : own[-1]], own - own[0], percent)


def _link_groups(percent: int):
    def groups(table: pa.Table) -> pa.Table:
        links = [x for _, found in _group_links(table, percent) for x in found]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return groups


def _component_groups(percent: int):
    """Components of clusters that stand in one group each, with the links of each node."""

    def groups(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        for nodes, links in _group_links(table, percent):
            parent, degree = {int(x): int(x) for x in nodes}, dict.fromkeys(nodes.tolist(), 0)

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for a, b in links:
                degree[a] += 1
                degree[b] += 1
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            out += [(x, root(x), n) for x, n in degree.items()]
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("node", "component", "n_links"))})

    return groups


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _centre_links(buckets: DataFrame, rows: int, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between each bucket's member of most weight and its other members."""
    top = F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node")))
    centres = _sent(buckets.groupBy("bucket").agg(top.alias("c")), rows)
    pairs = (
        buckets.join(centres, "bucket")
        .where((F.col("c.node") != F.col("node")) & _near(F.col("c.n"), F.col("n"), percent))
        .select(F.col("c.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    pairs = checkpointed(_few(pairs, rows))
    return checkpointed(_few(_verified(pairs, sets, percent), SET_NUMBERS * pairs.count()))


def _diagonal(nodes: DataFrame) -> DataFrame:
    """The tables of left half i and right half i: as many rows a node as there are left halves."""
    rows = nodes.select("node", "n", "weight", F.explode("left").alias("l"), F.col("right")[F.col("l.side")].alias("r"))
    return rows.where("r is not null").select(F.xxhash64("l.half", "r").alias("bucket"), "node", "n", "weight")


def _pairs(pruned: DataFrame, wide: int) -> DataFrame:
    """Rows (label, l, r): the pairs of halves that a label's nodes (node, label, left, right) have, few of them twice."""
    most = F.max_by(F.struct("node", "left", "right"), F.struct(F.size("left") * F.size("right"), -F.col("node")))
    both = pruned.join(_few(pruned.groupBy("label").agg(most.alias("most")), wide), "label")
    lacks = F.array_except("right", "most.right")
    both = both.select("label", "left", "right", (F.col("most.node") == F.col("node")).alias("own"), F.col("most.left").alias("named"), lacks.alias("lacks"))
    rest = F.when(~F.col("own") & F.array_contains("named", F.col("l")), F.col("lacks")).otherwise(F.col("right"))
    return _few(both, wide).withColumn("l", F.explode("left")).select("label", "l", F.explode(rest).alias("r"))


def _crossings(nodes: DataFrame, n: int, halves: int) -> DataFrame:
    """Distinct rows (bucket, node) with the labels that meet others in a table in the place of nodes.

    Halves that only one label has lead to no such table and are dropped before they are paired. The node of
    a label that has most pairs names all of its own; the label's other nodes name only what it lacks, so
    copies don't repeat the same pairs. ``n`` is a bound of the nodes, of which each has ``halves`` on a side.
    """
    flat = nodes.select("node", "label", F.transform("left", lambda x: x.half).alias("left"), F.map_values("right").alias("right"))
    wide = 2 * halves * n
    rows = flat.select("node", "label", F.explode(F.concat("left", "right")).alias("half"))
    live = rows.groupBy("half").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("half")
    kept = _few(_few(rows.join(_few(live, wide), "half"), wide).groupBy("node").agg(F.collect_set("half").alias("live")), wide)
    pruned = flat.join(kept, "node").select("node", "label", F.array_intersect("left", "live").alias("left"), F.array_intersect("right", "live").alias("right"))
    pruned = checkpointed(_few(pruned.where("size(left) > 0 and size(right) > 0"), wide))
    pairs = _pairs(pruned, wide).select(F.xxhash64("l", "r").alias("bucket"), F.col("label").alias("node"))
    return checkpointed(_few(pairs.distinct(), wide))


def _labelled(nodes: DataFrame, n: int, halves: int, labels: DataFrame) -> DataFrame:
    """``nodes`` with the component of ``labels`` as label, or with themselves."""
    named = labels.select("node", F.col("component").alias("found"))
    named = nodes.drop("label").join(_sent(named, n), "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")
    return checkpointed(_few(named, 2 * halves * n))


def _candidates(nodes: DataFrame, n: int, halves: int) -> DataFrame:
    """Columns node, cluster of the nodes that meet others in any table, transitively."""
    own = nodes.withColumn("label", F.col("node"))
    first = contracted(_diagonal(own).select("bucket", "node"), ("bucket",), halves * n)
    crossings = _crossings(_labelled(own, n, halves, first), n, halves)
    second = contracted(crossings, ("bucket",), crossings.count())
    both = first.select("node", "component").unionAll(second.join(_sent(first, n), "node", "left_anti").select("node", F.col("node").alias("component")))
    up = second.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    return both.join(_sent(up, n), "component", "left").select("node", F.coalesce("cluster", "component").alias("cluster"))


def _sized(clusters: DataFrame, n: int) -> DataFrame:
    clusters = checkpointed(_few(clusters, n))
    return checkpointed(_few(clusters.join(_sent(clusters.groupBy("cluster").agg(F.count("*").alias("n_nodes")), n), "cluster"), n))


def _packed(placed: DataFrame, sets_of, block: int) -> GroupedData:
    """The clusters in ``placed`` (node, cluster, n_nodes, component) of up to ``block`` nodes, in groups with their sets."""
    small = placed.where(F.col("n_nodes") <= block)
    n = small.count()
    packs = F.lit(max(1, -(-n // block)))
    small = small.select("node", "cluster", "component", F.pmod(F.xxhash64("cluster"), packs).alias("pack"))
    return sets_of(small, n).groupBy("pack")


def _block_links(placed: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of clusters of any size, by pairs of blocks of ``block / 2`` nodes."""
    rest = placed.select("node", "component", "cluster", F.ceil(F.col("n_nodes") * 2 / block).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = rest.select("node", "component", "cluster", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    return keyed.join(sets, "node").groupBy("cluster", "b1", "b2").applyInArrow(_link_groups(percent), "a long, b long")


def _confirmed(nodes: DataFrame, halves: int, sets_of, percent: int, block: int) -> DataFrame:
    """Columns node, component, n_links of the nodes that meet others: what similar texts connect.

    ``nodes`` has node, n, weight and its halves ``left`` and ``right``, up to ``halves`` each; ``sets_of`` adds
    full sets to a number of rows that name nodes.
    """
    n = nodes.count()
    placed = _sized(_candidates(nodes, n, halves), n).withColumn("component", F.col("node"))
    small = _packed(placed, sets_of, block).applyInArrow(_component_groups(percent), "node long, component long, n_links long")
    large = placed.where(F.col("n_nodes") > block)
    n = large.count()
    if not n:
        return small
    sets = checkpointed(sets_of(large.select("node"), n).select("node", "shingles"))
    inside = checkpointed(_few(nodes.join(_sent(large.select("node", "cluster"), n), "node"), 2 * halves * n))
    starred = _centre_links(_diagonal(inside), halves * n, sets, percent)
    inside = _labelled(inside, n, halves, connected_components(starred, starred.count()))
    counts = inside.groupBy("cluster").agg(F.count("*").alias("n_nodes"), F.count_distinct("label").alias("n_labels"))
    mixed = checkpointed(_few(inside.join(_sent(counts.where("n_labels > 1"), n), "cluster"), 2 * halves * n))
    # A table with one component has nothing left to connect. Where few components are left, the tables in
    # which they meet fall into parts; where most nodes are still alone, the part would be the cluster.
    joined = mixed.where("4 * n_labels < n_nodes")
    crossings = _crossings(joined, n, halves)
    parts = contracted(crossings, ("bucket",), crossings.count()).select(F.col("node").alias("label"), F.col("component").alias("part"))
    parts = _sized(joined.join(_sent(parts, n), "label").select("node", F.col("label").alias("component"), F.col("part").alias("cluster")), n)
    apart = mixed.where("4 * n_labels >= n_nodes").select("cluster", "node", F.col("label").alias("component"), "n_nodes")
    wide = parts.where(F.col("n_nodes") > block).unionByName(apart)
    inner = _packed(parts, sets_of, block).applyInArrow(_link_groups(percent), "a long, b long")
    added = checkpointed(inner.unionAll(_block_links(wide, sets, percent, block)).distinct())
    # What was added connects labels, each the least node of its component so far.
    named, n_added = inside.select("node", "label"), added.count()
    if n_added:
        ends = [named.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"]
        across = added.join(_sent(ends[0], n), "a").join(_sent(ends[1], n), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        up = connected_components(across, n_added).select(F.col("node").alias("label"), "component")
        named = named.join(_sent(up, n), "label", "left").select("node", F.coalesce("component", "label").alias("label"))
    links = starred.unionAll(added)
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    return small.unionByName(named.withColumnRenamed("label", "component").join(_sent(degrees, n), "node"))


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    shingle_words: int = SHINGLE_WORDS,
    half_hashes: int = HALF_HASHES,
    halves: int = HALVES,
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, n_links.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a document's set holds its
    distinct shingles of ``shingle_words`` words, or its whole word sequence where it is shorter. Texts
    with ``100 * intersection >= percent * union`` are linked; ``component_id`` is the smallest id
    reachable, ``kept`` whether that is the document itself, and ``n_links`` how many links with other
    texts were confirmed for its text (as many as connect its component; equal texts need none).

    Null and wordless texts have no shingles and are linked with nothing. A row with a null id keeps a
    null component unless another row has the same set, names no component, and is kept only when it
    has none. Repeated rows share one fate. Other columns are not read.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = checkpointed(_signatures(docs, shingle_words, half_hashes, halves, seed))
    wide = 2 * halves * signed.count()
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
    classes = classes.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
    classes = checkpointed(_few(classes, wide))
    half_rows = classes.select("node", "n", F.posexplode("halves").alias("side", "half"))
    common = checkpointed(_few(half_rows.groupBy("half").agg(F.count("*").alias("met")).where("met > 1"), wide))
    left = F.col("side") < halves
    met = (
        half_rows.join(_sent(common, common.count()), "half")
        .groupBy("node", "n")
        .agg(
            F.collect_list(F.when(left, F.struct("side", "half"))).alias("left"),
            F.map_from_entries(F.collect_list(F.when(~left, F.struct((F.col("side") - halves).alias("side"), "half")))).alias("right"),
            F.sum("met").alias("weight"),
        )
        .where("size(left) > 0 and size(right) > 0")
    )
    met = checkpointed(_few(met, wide))

    def sets_of(nodes: DataFrame, n: int) -> DataFrame:
        # The key tells the text that an id stands for from others under the same id.
        keyed = nodes.join(classes.select("node", "set_key"), "node")
        keyed = F.broadcast(keyed) if n <= BROADCAST_NODES else keyed
        return _full_sets(keyed.join(docs, F.col("node") == F.col("doc_id")).drop("doc_id"), shingle_words)

    components = _confirmed(met, halves, sets_of, percent, block)
    named = (
        classes.select("set_key", "node")
        .join(components, "node", "left")
        .select("set_key", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    named = checkpointed(_few(named, wide))
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").eqNullSafe(component)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
