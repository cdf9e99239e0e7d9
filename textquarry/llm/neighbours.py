"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search in it.

Equal vectors collapse into one node first. The graph has, for every node, the ``DEGREE`` nearest others found so far.

Building
1. Some nodes (smallest hashes, at most ``CENTRES``) are centres of cells, and every node joins the cells of the ``DEALS`` nearest
   centres, so that cells overlap; the nearest of a node's cells are its first neighbours. A cell of more than ``CROWD`` nodes
   is dealt at random into buckets of about half that. A row of a cell meets thousands of others by one matrix product, where
   a row of a later round meets some sixty: what the cells find saves rounds. The cell of a node's nearest centre brings it
   ``DEGREE`` neighbours, the others ``FEWER``, as cells overlap and most of their rows would be dropped.
2. In each round every node introduces its neighbours to each other: up to ``INTRODUCED`` new and as many old ones that it
   points to, as many that point to it, and itself, are joined with their vectors, and pairs of which one is new are compared
   by a matrix product. A task keeps the best of each node before anything is shuffled; candidates and present neighbours
   merge into the best ``DEGREE``. A neighbour that was introduced is old from then on; the rest are introduced in later rounds.
3. The rounds end when they change at most ``SETTLED`` of all edges, or after ``ROUNDS``.

Searching. A query compares with ``ENTRIES`` nodes (smallest hashes, a bounded broadcast), and one that equals a node enters there
as well. Its beam is the ``BEAM`` nearest nodes seen. Opening a node joins its neighbours, and the nodes that point to it (the
``DEGREE`` nearest of those), with their vectors, and they enter the beam. The first round opens the node that a query equals,
or else the ``OPENED`` nearest; the second opens the ``OPENED`` nearest, later ones all that are not open. A search ends when all
of its beam is open. What is left is measured again in double precision on the original vectors.

A round of either is a few equi-joins of rows of fixed width; no node has more than a fixed number of rows in them, whatever
its popularity. The graph is what the method bounds: a limit there costs recall (tests measure it), never rows of a result.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null
vec_id; vectors of different dimensions are never neighbours; identical rows count once; of different vectors under one vec_id
each is a query and a candidate, but none is a candidate for that vec_id; a query with fewer candidates than asked for gets all
that share its dimension; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Neighbours of a node in the graph, and how many of each kind (new, old) it introduces in a round.
DEGREE, INTRODUCED = 32, 16
#: Cells that a node joins, and neighbours that each but the nearest brings it.
DEALS, FEWER = 16, 16
#: Nodes for each centre, until there are CENTRES of a dimension, and most nodes that meet in a cell.
CELL, CENTRES, CROWD = 128, 4_096, 4_096
ROUNDS, SETTLED = 14, 0.02
ENTRIES, BEAM, OPENED = 1_024, 256, 64
#: Bytes of query vectors that a search may broadcast; beyond them they are shuffled.
SOUGHT_BYTES = 32 << 20
#: Rows of two ids that a round of a search may broadcast; the same joins shuffle more.
FEW = 200_000
#: Nearest results of a query, and rows with vectors that a task holds, about.
K, GROUP_ROWS = 10, 40_000
_SOUND = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the distinct rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(f"coalesce({_SOUND}, false)").distinct()


def _packed(rows: DataFrame, kind: str, scale: float) -> DataFrame:
    """``rows`` (node, ..., embedding last) with the embedding as packed numbers."""
    kept = rows.columns[:-1]

    def pack(batches):
        for batch in batches:
            blobs = [(np.array(v) * scale).astype(kind).tobytes() for v in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blobs, pa.binary())], names=[*kept, "unit"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(pack, f"{fields}, unit binary")


def nodes(vectors: DataFrame, held: int) -> DataFrame:
    """node, dim, ids (the ``held`` smallest vec_ids) and embedding of every distinct vector of ``sound`` rows."""
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.withColumn("r", first).where(f"r <= {held}").groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return common.stored(few.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "ids", "embedding"), "neighbours-nodes")[0]


def _best(node: np.ndarray, to: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` nearest distinct ``to`` of each node, by node and nearness."""
    order = np.lexsort((to, d, node))
    node, to = node[order], to[order]
    twin = np.concatenate([[False], (node[1:] == node[:-1]) & (to[1:] == to[:-1])]) if len(node) else np.zeros(0, bool)
    order, node = order[~twin], node[~twin]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    return order[place < most]


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``y``."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0.0)


def _dealt(units: DataFrame, n: int, degree: int) -> tuple[DataFrame, str]:
    """node, to and d of the nearest that each node of ``units`` meets in its cells (``degree`` in that of the nearest centre, ``FEWER``
    in others); where they are stored."""
    spark = units.sparkSession
    crowd = units.groupBy("dim").agg(F.count("*").alias("crowd"))  # a row for each dimension
    chance = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    centres = F.expr(f"if(crowd <= {DEALS * CELL}, 1, least({CENTRES}, crowd div {CELL}))")
    few = units.select("node", "dim").withColumn("r", chance).where(f"r <= {CENTRES}").join(F.broadcast(crowd), "dim").where(F.col("r") <= centres).select("node")
    shared = spark.sparkContext.broadcast(units.join(F.broadcast(few), "node").select("node", "unit").toArrow())  # CENTRES of each dimension

    def enter(batches):
        centre, blobs = shared.value["node"].to_numpy(), shared.value["unit"].to_pylist()
        sizes = np.array([len(x) for x in blobs], np.int64)
        held = {size: (at := np.flatnonzero(sizes == size), np.frombuffer(b"".join(blobs[k] for k in at), np.float32).reshape(len(at), -1).astype(float)) for size in np.unique(sizes).tolist()}
        for batch in batches:
            node, mine = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            length = np.array([len(x) for x in mine], np.int64)
            for size in np.unique(length).tolist():
                of, (at, y) = np.flatnonzero(length == size), held[size]
                for k in range(0, len(of), 256):
                    part = of[k : k + 256]
                    d = _products(np.frombuffer(b"".join(mine[i] for i in part), np.float32).reshape(len(part), -1).astype(float), y)
                    near = np.argpartition(d, DEALS - 1, axis=1)[:, :DEALS] if len(at) > DEALS else np.tile(np.arange(len(at)), (len(part), 1))
                    first = np.arange(near.shape[1]) == np.take_along_axis(d, near, 1).argmin(axis=1)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[part], near.shape[1])), pa.array(centre[at[near]].ravel()), pa.array(first.ravel())], names=["node", "cell", "first"])

    cells, path = common.stored(units.select("node", "unit").mapInArrow(enter, "node long, cell long, first boolean"), "neighbours-cells")
    buckets = F.when(F.col("size") <= CROWD, 1).otherwise(F.ceil(F.col("size") * 2 / CROWD))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).withColumn("buckets", buckets.cast("long")).select("cell", "buckets")
    members = cells.join(F.broadcast(sizes), "cell").select("node", "first", F.xxhash64("cell", F.pmod(F.xxhash64("node", "cell"), "buckets")).alias("v"))

    def meet(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["v"].to_numpy(), kind="stable")
        v, node, first, blobs = rows["v"].to_numpy()[order], rows["node"].to_numpy()[order], rows["first"].to_numpy()[order], rows["unit"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        out = ([], [], [])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x = np.frombuffer(b"".join(blobs[k] for k in order[a:b]), np.float32).reshape(b - a, -1).astype(float)
            for of, most in ((first[a:b], degree), (~first[a:b], min(FEWER, degree))):
                of, most = np.flatnonzero(of), min(most, b - a - 1)
                for k in range(0, len(of) if most else 0, 256):
                    part = of[k : k + 256]
                    d = _products(x[part], x)
                    d[np.arange(len(d)), part] = np.inf
                    near = np.argpartition(d, most - 1, axis=1)[:, :most]
                    for store, found in zip(out, (np.repeat(node[a + part], most), node[a + near].ravel(), np.take_along_axis(d, near, 1).ravel())):
                        store.append(found)
        u, w, d = (np.concatenate(x) if x else np.zeros(0) for x in out)
        keep = _best(u, w, d, degree)
        return pa.table({"node": u[keep].astype(np.int64), "to": w[keep].astype(np.int64), "d": d[keep].astype(float)})

    tasks = 1 + DEALS * n // GROUP_ROWS
    full = members.join(units.select("node", "unit"), "node").select(F.pmod(F.xxhash64("v"), F.lit(tasks)).alias("task"), "v", "node", "first", "unit")
    found, met_path = common.stored(full.groupBy("task").applyInArrow(meet, "node long, to long, d double"), "neighbours-dealt")
    common.drop_path(spark, path)
    return found, met_path


def _introduced(members: DataFrame, units: DataFrame, tasks: int, degree: int) -> DataFrame:
    """node, to and d of the pairs that meet at some v of ``members`` (v, node, fresh) and are near enough; units: node, worst, unit."""

    def meet(rows: pa.Table) -> pa.Table:
        v, node = rows["v"].to_numpy(), rows["node"].to_numpy()
        order = np.lexsort((node, v))
        v, node, fresh, worst = v[order], node[order], rows["fresh"].to_numpy()[order], rows["worst"].to_numpy()[order]
        blobs = rows["unit"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        out = ([], [], [])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2:
                continue
            x = np.frombuffer(b"".join(blobs[k] for k in order[a:b]), np.float32).reshape(b - a, -1).astype(float)
            sq = (x * x).sum(axis=1)
            d = np.maximum(sq[:, None] + sq - 2 * (x @ x.T), 0.0)
            near = (d < worst[a:b, None]) & (fresh[a:b, None] | fresh[a:b])
            np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            for store, found in zip(out, (node[a + i], node[a + j], d[i, j])):
                store.append(found)
        u, w, d = (np.concatenate(x) if x else np.zeros(0) for x in out)
        keep = _best(u, w, d, degree)
        return pa.table({"node": u[keep].astype(np.int64), "to": w[keep].astype(np.int64), "d": d[keep].astype(float)})

    full = members.join(units, "node").withColumn("task", F.pmod(F.xxhash64("v"), F.lit(tasks)))
    return full.select("task", "v", "node", "fresh", "worst", "unit").groupBy("task").applyInArrow(meet, "node long, to long, d double")


def _merged(edges: DataFrame | None, found: DataFrame, parts: int, degree: int) -> DataFrame:
    """node, to, d, fresh, turn (place among the fresh or old ones of the node), place and added of the best edges of each node."""

    def merge(rows: pa.Table) -> pa.Table:
        node, to, d, state = (rows[c].to_numpy() for c in ("node", "to", "d", "state"))
        order = np.lexsort((state, to, node))  # of a pair, the edge there is comes first
        node, to, d, state = node[order], to[order], d[order], state[order]
        single = np.concatenate([[True], (node[1:] != node[:-1]) | (to[1:] != to[:-1])])
        node, to, d, state = node[single], to[single], d[single], state[single]
        keep = _best(node, to, d, degree)
        node, to, d, state = node[keep], to[keep], d[keep], state[keep]
        first = np.concatenate([[True], node[1:] != node[:-1]])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(node)))
        place = np.arange(len(node)) - np.repeat(at, size)
        fresh = state > 0
        before = np.cumsum(fresh) - fresh
        news = before - np.repeat(before[at], size)
        return pa.table({"node": node, "to": to, "d": d, "fresh": fresh, "turn": np.where(fresh, news, place - news).astype(np.int32), "place": place.astype(np.int32), "added": state > 1})

    rows = found.select("node", "to", "d", F.lit(2).alias("state"))
    if edges is not None:
        rows = rows.unionByName(edges.select("node", "to", "d", F.when(F.col("fresh") & (F.col("turn") >= INTRODUCED), 1).otherwise(0).alias("state")))
    return rows.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")).applyInArrow(merge, "node long, to long, d double, fresh boolean, turn int, place int, added boolean")


def graph(units: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """node, to and d (squared distance) of the neighbour graph of ``units`` (node, dim, unit: packed floats)."""
    n = units.count()
    parts = max(1, n * degree // 200_000)
    found, dealt_path = _dealt(units, n, degree)
    edges, path = common.stored(_merged(None, found, parts, degree), "neighbours-graph")
    common.drop_path(units.sparkSession, dealt_path)
    for _ in range(rounds):
        chosen = edges.where(F.col("turn") < INTRODUCED).select("node", "to", "d", "fresh")
        nearest = F.row_number().over(Window.partitionBy("to", "fresh").orderBy("d", "node"))
        back = chosen.withColumn("r", nearest).where(f"r <= {INTRODUCED}").select(F.col("to").alias("v"), "node", "fresh")
        there = chosen.select(F.col("node").alias("v"), F.col("to").alias("node"), "fresh")
        members = there.unionByName(back).unionByName(units.select(F.col("node").alias("v"), "node", F.lit(False).alias("fresh")))
        members = members.groupBy("v", "node").agg(F.max("fresh").alias("fresh"))
        members, meet_path = common.stored(members.join(members.where("fresh").select("v").distinct(), "v", "left_semi"), "neighbours-members")
        worst = edges.where(F.col("place") == degree - 1).select("node", F.col("d").alias("worst"))
        known = units.join(worst, "node", "left").select("node", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "unit")
        found = _introduced(members, known, 1 + members.count() // GROUP_ROWS, degree)
        after, new = common.stored(_merged(edges, found, parts, degree), "neighbours-graph")
        added, total = after.agg(F.count_if("added"), F.count("*")).first()
        for old in (path, meet_path):
            common.drop_path(units.sparkSession, old)
        edges, path = after, new
        if added <= SETTLED * total:
            break
    return edges.select("node", "to", "d")


def _paths(edges: DataFrame, degree: int) -> DataFrame:
    """node and to (an array): the neighbours of a node and the ``degree`` nearest of those that have it as a neighbour."""
    nearest = F.row_number().over(Window.partitionBy("to").orderBy("d", "node"))
    back = edges.withColumn("r", nearest).where(f"r <= {degree}").select(F.col("to").alias("node"), F.col("node").alias("to"))
    return edges.select("node", "to").unionByName(back).groupBy("node").agg(F.collect_set("to").alias("to"))


def _measured(pairs: DataFrame, kind: str) -> DataFrame:
    """q, to and d of ``pairs`` (q, to, sought, unit): the squared distance of the two packed vectors."""

    def measure(batches):
        for batch in batches:
            d = np.zeros(batch.num_rows)
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes = np.array([len(x) for x in a], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x, y = (np.frombuffer(b"".join(side[k] for k in at), kind).reshape(len(at), -1).astype(float) for side in (a, b))
                d[at] = ((x - y) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["q", "to", "d"])

    return pairs.select("q", "to", "sought", "unit").mapInArrow(measure, "q long, to long, d double")


def _entered(sought: DataFrame, entries: pa.Table, beam: int) -> DataFrame:
    """q, to and d of the ``beam`` nearest entries of every query of ``sought`` (q, dim, sought)."""
    shared = sought.sparkSession.sparkContext.broadcast(entries)

    def enter(batches):
        node, blobs = shared.value["node"].to_numpy(), shared.value["unit"].to_pylist()
        sizes = np.array([len(x) for x in blobs], np.int64)
        for batch in batches:
            q, mine = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            length = np.array([len(x) for x in mine], np.int64)
            for size in np.unique(length).tolist():
                of, at = np.flatnonzero(length == size), np.flatnonzero(sizes == size)
                x, y = (np.frombuffer(b"".join(b[k] for k in w), np.float32).reshape(len(w), -1).astype(float) for b, w in ((mine, of), (blobs, at)))
                for k in range(0, len(of), 256):
                    d = np.maximum((x[k : k + 256] ** 2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (x[k : k + 256] @ y.T), 0.0)
                    best = np.argsort(d, axis=1, kind="stable")[:, :beam]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[of[k : k + 256]], best.shape[1])), pa.array(node[at[best]].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel())], names=["q", "to", "d"])

    return sought.select("q", "sought").mapInArrow(enter, "q long, to long, d double")


def _nearest_of(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest of ``rows`` (q, to, d, ...) of each query."""
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "to"))
    return rows.withColumn("r", place).where(f"r <= {most}").drop("r")


def greedy(sought: DataFrame, units: DataFrame, paths: DataFrame, beam: int = BEAM) -> DataFrame:
    """q and to of the beams of all queries of ``sought`` (q, own: the node that a query equals or null, sought: packed floats) at the
    end of their search. The first round opens a query's own node alone, if it has one, which leads to its neighbours at once."""
    spark = sought.sparkSession
    own = sought.where("own is not null").select("q", F.col("own").alias("to"), F.lit(0.0).alias("d"))
    asking = sought.select("q", "sought")
    if (sought.agg(F.sum(F.octet_length("sought") + 16)).first()[0] or 0) <= SOUGHT_BYTES:
        asking = F.broadcast(asking)
    chance = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("node"), "node"))
    entries = units.select("node", "dim", F.xxhash64("node").alias("h")).withColumn("r", chance).where(f"r <= {ENTRIES}").select("node")
    entries = units.join(F.broadcast(entries), "node").select("node", "unit").toArrow()  # ENTRIES of each dimension
    entered = _entered(sought, entries, beam).unionByName(own).groupBy("q", "to").agg(F.min("d").alias("d"))
    state, path = common.stored(_nearest_of(entered, beam).withColumn("open", F.lit(False)), "neighbours-beam")
    closed = own.select("q", "to").unionByName(_nearest_of(state.join(own.select("q"), "q", "left_anti"), OPENED).select("q", "to"))
    opening = OPENED
    while True:
        opened, opened_path = common.stored(closed, "neighbours-opened")
        count = opened.count()
        if not count:
            return state.select("q", "to")
        # What has left a beam is too far to enter it again, so only the beam itself has to be kept from being measured anew.
        few = opened.select("q", F.col("to").alias("node"))
        reached = (F.broadcast(few) if count <= FEW else few).join(paths, "node").select("q", F.explode("to").alias("to")).distinct().join(state.select("q", "to"), ["q", "to"], "left_anti")
        reached = F.broadcast(reached) if count * 2 * DEGREE <= FEW else reached
        fresh = _measured(reached.join(units.select(F.col("node").alias("to"), "unit"), "to").join(asking, "q"), "f4")
        before = state.join(opened.withColumn("now", F.lit(True)), ["q", "to"], "left").select("q", "to", "d", F.expr("open or now is not null").alias("open"))
        state, new = common.stored(_nearest_of(before.unionByName(fresh.withColumn("open", F.lit(False))), beam), "neighbours-beam")
        closed, opening = _nearest_of(state.where("not open"), opening).select("q", "to"), beam
        for old in (path, opened_path):
            common.drop_path(spark, old)
        path = new


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of ``vectors`` (vec_id, embedding) found for each row of
    ``queries`` (the same columns), rows of its own vec_id left out."""
    spark = vectors.sparkSession
    known = nodes(sound(vectors), k + 1)
    far = known.agg(F.max(F.expr("array_max(transform(embedding, x -> abs(x)))"))).first()[0] or 1.0
    scale = float(2.0 ** -np.ceil(np.log2(far)))  # floats of the graph neither overflow nor lose what doubles hold
    units, _ = common.stored(_packed(known.select("node", "dim", "embedding"), "f4", scale), "neighbours-units", "none")
    asked, _ = common.stored(sound(queries), "neighbours-asked")
    kinds, _ = common.stored(asked.select("embedding").distinct().select(F.monotonically_increasing_id().alias("q"), "embedding"), "neighbours-sought")
    of_node = kinds.join(known.select(F.col("node").alias("own"), "embedding"), "embedding", "left").select("q", "own", "embedding")
    sought, _ = common.stored(_packed(of_node, "f4", scale).withColumnRenamed("unit", "sought"), "neighbours-queries")
    paths, _ = common.stored(_paths(graph(units), DEGREE), "neighbours-paths")
    beams, _ = common.stored(greedy(sought, units, paths), "neighbours-beams")

    exact = beams.join(_packed(known.select(F.col("node").alias("to"), "embedding"), "f8", 1.0), "to").join(_packed(kinds, "f8", 1.0).withColumnRenamed("unit", "sought"), "q")
    exact, _ = common.stored(_measured(exact, "f8"), "neighbours-measured")
    closest = exact.withColumn("r", F.dense_rank().over(Window.partitionBy("q").orderBy("d"))).where(f"r <= {k + 1}").select("q", "to", F.sqrt("d").alias("score"))
    closest = closest.join(known.select(F.col("node").alias("to"), "ids"), "to").select("q", "score", F.explode("ids").alias("vec_id"))
    of = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(kinds, "embedding").select("query_id", "q")
    order = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    ranked = of.join(closest, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose vec_id is divisible by 100."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
