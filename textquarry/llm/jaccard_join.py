"""N-gram Jaccard join: grouped prefix join over five-word shingles.

Words are the runs of bytes other than ASCII white space, with A-Z as a-z; a document's set holds its distinct five-word
shingles as 64-bit hashes (with fewer words, the whole sequence as one shingle; without words, nothing). Two documents
link when ``100 * |A & B| >= 80 * |A | B|``; a component is what links reach.

Method
1. Shingles are counted over all documents; those that many documents hold come last in the global order, so that a
   passage that many share is seldom part of a prefix. The order steers cost only: any order gives the same links.
2. Documents with equal sets collapse into one class, classes with an equal prefix and size into one group.
3. Each group sends its prefix once, and within a shingle's bucket every group meets the bucket's leader (the one that has
   the shingle earliest). The bucket of a shingle that very many documents hold is dealt into ``SALT`` parts, each with a
   leader of its own, and these meet the first of them. Group pairs that pass the size and position bounds are expanded and
   verified on the sets.
4. Members that share a bucket but are not yet connected are the only further pairs; they pass the same bounds and are
   verified too. A pair inside one component needs no comparison, so a group of copies costs a number of pairs linear in
   its size, and no link between different components is lost. A bucket's members are dealt into blocks of ``SIDE``, about,
   and two blocks meet at a time, so that a large bucket is many small joins.

Defined results: doc_id names a text; null and empty texts have an empty set and link with nothing; a null doc_id links with nothing and has a
null component; repeated rows are rows of one node; an empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: From this many documents on a shingle comes late in the order.
OFTEN = 4
#: Shingle keys that a task holds before it sends their counts.
HELD = 6_000_000
#: The most frequent shingles that the order knows: 12 bytes each in a broadcast. It bounds cost, not results.
FREQUENT = 1_000_000
#: Documents with a shingle from which on its bucket is dealt into so many parts, and members of a bucket on one side of a join.
HOT, SALT, SIDE = 20_000, 256, 2_048


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit keys of frequent shingles and their counts.

    A task adds up to ``HELD`` keys itself and sends them sorted and packed to the tasks that add up all: a few bytes for each
    shingle, in one piece for each part. Keys are cut to 32 bits, which the order may be: shingles that share a key share its
    count.
    """
    parts, often, most, most_held = common.partitions(docs), OFTEN, FREQUENT, HELD

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
        rows = [(p, _pack(keys[a:b]), _packed(np.minimum(n[a:b], 65535).astype(np.uint16))) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["p", "keys", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, offs in common.passes(batch.column(0)):
                for s in common.shingle_sets(data, offs, width):
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    size += len(s)
                if size >= most_held:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def add(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(x) for x in rows["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint16) for x in rows["n"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n, keys = np.add.reduceat(n, first), keys[first]
        keep = np.flatnonzero(n >= often)
        keep = keep[np.argsort(-n[keep], kind="stable")][: 2 * most // parts + 1]  # keys are even, so few of the top are lost
        return pa.table({"shingle": keys[keep].astype(np.int64), "n": n[keep]})

    top = docs.select("text").mapInArrow(count, "p int, keys binary, n binary").groupBy("p").applyInArrow(add, "shingle long, n long")
    rows = top.orderBy(F.desc("n"), "shingle").limit(most).toArrow().sort_by("shingle")
    return rows["shingle"].to_numpy().astype(np.uint32), rows["n"].to_numpy()


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as compressed differences."""
    return _packed(np.diff(keys, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.copy())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(planes.T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def _ordered(keys: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``keys`` (sorted) with frequent ones last, these by count."""
    if not len(known) or not len(keys):
        return keys
    short = (keys >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
    often = np.where(known[at] == short, times[at], 0)
    return keys[np.argsort(often, kind="stable")]


def _bitmap(s: np.ndarray) -> bytes:
    """The set hashed into at least two bits an element, a power of two: larger maps fold onto smaller ones by OR."""
    size = max(256, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s >> np.uint64(7)) & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _most_shared(n1: int, x: np.ndarray, n2: int, y: np.ndarray) -> float:
    """An upper bound of the intersection: an element outside it sets a bit that the maps can only share by chance, so
    ``|A| + |B| - 2 |A & B|`` is at least the number of bits in which the maps differ."""
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return (n1 + n2 - int(np.bitwise_count(x ^ y).sum())) / 2


def signatures(docs: DataFrame, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n (set size), set_key, prefix_key (digests), bits, and prefix (packed 64-bit hashes in the global order)."""
    shared, ordered = docs.sparkSession.sparkContext.broadcast(frequent), _ordered

    def sign(batches):
        known, times = shared.value
        for batch in batches:
            ids = batch.column(0)
            for at, data, offs in common.passes(batch.column(1)):
                sizes, out = [], ([], [], [], [])
                for s in common.shingle_sets(data, offs, width):
                    n = len(s)
                    need = -(-percent * n // 100)
                    prefix = ordered(s, known, times)[: n - need + 1 if n else 0].tobytes()
                    sizes.append(n)
                    for store, v in zip(out, (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), hashlib.blake2b(prefix, digest_size=16).digest(), _bitmap(s), prefix)):
                        store.append(v)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], names=["doc_id", "n", "set_key", "prefix_key", "bits", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, set_key binary, prefix_key binary, bits binary, prefix binary")


def _unpacked(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """One row for each shingle of a group's prefix: shingle, salt (0 unless its key is in ``hot``), gid, n, pos."""
    shared, parts = rows.sparkSession.sparkContext.broadcast(np.sort(hot)), SALT

    def unpack(batches):
        for batch in batches:
            gid, n, blobs = (batch.column(k) for k in range(3))
            lens = np.array([len(b) // 8 for b in blobs.to_pylist()], np.int64)
            flat = np.frombuffer(b"".join(blobs.to_pylist()), np.int64)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            owner, salt = np.repeat(gid.to_numpy(), lens), np.zeros(len(flat), np.int32)
            if len(shared.value):
                often = np.isin((flat.view(np.uint64) >> np.uint64(32)).astype(np.uint32), shared.value)
                salt[often] = 1 + (common.mix(owner[often].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
            out = [flat, salt, owner, np.repeat(n.to_numpy(), lens).astype(np.int32), pos.astype(np.int32)]
            for k in range(0, len(flat), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 200_000]) for x in out], names=["shingle", "salt", "gid", "n", "pos"])

    return rows.select("gid", "n", "prefix").mapInArrow(unpack, "shingle long, salt int, gid long, n int, pos int")


def _bounds(percent: int, n1: str, p1: str, n2: str, p2: str) -> str:
    """Whether sizes and positions allow the similarity if this shingle is the first that both have.

    Nothing before it is shared, so the intersection is at most what follows it in either. Of a similar pair the row of its
    first shared shingle passes; the pair's other rows need not.
    """
    size = f"100L * least({n1}, {n2}) >= {percent}L * greatest({n1}, {n2})"
    return f"({size} and {100 + percent}L * least({n1} - {p1}, {n2} - {p2}) >= {percent}L * ({n1} + {n2}))"


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The packed sets of the documents named in ``ids`` (sid)."""
    picked = docs.select(F.col("doc_id").alias("sid"), "text").join(common.sized(ids), "sid", "left_semi")

    def build(batches):
        for batch in batches:
            for at, data, offs in common.passes(batch.column(1)):
                blobs = [s.tobytes() for s in common.shingle_sets(data, offs, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(blobs)), pa.array(blobs, pa.binary())], names=["sid", "shingles"])

    return picked.mapInArrow(build, "sid long, shingles binary").distinct()


def _with_both(pairs: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    for k, name in enumerate(("a", "b")):
        pairs = pairs.join(side.select(F.col("sid").alias(name), *(F.col(c).alias(f"{c}{k}") for c in columns)), name)
    return pairs.select("a", "b", *(f"{c}{k}" for k in (0, 1) for c in columns))


def _apart(rows: DataFrame, key: str, bounds: str = "true") -> DataFrame:
    """Pairs (a, b) of ``rows`` (sid, comp, ...) with one ``key`` and different comps that pass ``bounds``, block by block."""
    blocks = rows.groupBy(key).agg(F.expr(f"CAST(ceil(count(*) / {SIDE}) AS INT)").alias("blocks"))
    dealt = rows.join(blocks, key).withColumn("block", F.expr("CAST(pmod(xxhash64(sid), blocks) AS INT)")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    left = dealt.where("o >= block").withColumnsRenamed({"block": "bi", "o": "bj"})
    right = dealt.where("o <= block").withColumnsRenamed({"block": "bj", "o": "bi"} | {c: f"{c}2" for c in rows.columns if c != key})
    met = left.join(right, [key, "bi", "bj"]).where(f"(bi < bj or sid < sid2) and comp <> comp2 and {bounds}")
    return met.select(F.col("sid").alias("a"), F.col("sid2").alias("b"))


def _verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are as similar as asked: by the bound of their bitmaps, then by the sets."""

    def bound(batches):
        for batch in batches:
            keep = []
            for n1, x, n2, y in zip(*(batch.column(k) for k in range(2, 6))):
                n1, n2 = n1.as_py(), n2.as_py()
                most = _most_shared(n1, np.frombuffer(x.as_buffer(), np.uint8), n2, np.frombuffer(y.as_buffer(), np.uint8))
                keep.append((100 + percent) * most >= percent * (n1 + n2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    likely, _ = common.stored(_with_both(pairs, heads, "n", "bits").mapInArrow(bound, "a long, b long"), "jaccard-likely")
    sets = _sets(docs, likely.select(F.col("a").alias("sid")).union(likely.select("b")).distinct(), width)
    return _with_both(likely, sets, "shingles").mapInArrow(check, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    docs = common.in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = _frequent(docs, width)
    signed, _ = common.stored(signatures(docs, width, percent, frequent), "jaccard-signed")

    usable = signed.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("set_key", "n").agg(F.min("doc_id").alias("sid"), F.first("prefix_key").alias("prefix_key"), F.first("bits").alias("bits"))
    classes, _ = common.stored(classes, "jaccard-classes")
    groups = classes.groupBy("prefix_key", "n").agg(F.min("sid").alias("gid"))
    members, _ = common.stored(classes.select("set_key", "prefix_key", "n", "sid").join(groups, ["prefix_key", "n"]).select("set_key", "n", "sid", "gid"), "jaccard-members")

    heads = usable.join(members.where("sid = gid").select(F.col("set_key"), F.col("gid").alias("doc_id")), ["set_key", "doc_id"])
    heads = heads.select(F.col("doc_id").alias("gid"), "n", "prefix").dropDuplicates(["gid"])
    bucket = Window.partitionBy("shingle", "salt").orderBy("pos", "gid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known, times = frequent
    met = _unpacked(heads, known[times >= HOT]).withColumns({"lead": F.first(F.struct("gid", "n", "pos")).over(bucket), "many": F.count("*").over(bucket)})
    met, _ = common.stored(met.where("many > 1 or salt > 0").select("shingle", "salt", "gid", "n", "pos", F.col("lead.gid").alias("lg"), F.col("lead.n").alias("ln"), F.col("lead.pos").alias("lp")), "jaccard-buckets")
    crowd = members.groupBy("gid").agg(F.count("*").alias("size")).where("size > 1").select("gid")
    cast = members.join(met.select("gid").union(crowd).distinct(), "gid").select("sid", "gid")

    chiefs = met.where("salt > 0 and gid = lg").select("shingle", "gid", "n", "pos")  # at most SALT of a shingle
    over = Window.partitionBy("shingle").orderBy("pos", "gid")
    chiefs = chiefs.withColumn("lead", F.first(F.struct("gid", "n", "pos")).over(over)).select("shingle", "gid", "n", "pos", F.col("lead.gid").alias("lg"), F.col("lead.n").alias("ln"), F.col("lead.pos").alias("lp"))
    led = met.drop("salt").unionByName(chiefs).where(f"gid <> lg and {_bounds(percent, 'n', 'pos', 'ln', 'lp')}").select(F.col("gid").alias("a"), F.col("lg").alias("b"))
    within = members.where("sid <> gid").select(F.col("sid").alias("a"), F.col("gid").alias("b"))
    first, _ = common.stored(_verified(led.unionByName(within), classes, docs, width, percent), "jaccard-links")
    joined, _ = common.stored(common.components(first, "jaccard-first"), "jaccard-joined")

    labelled = cast.join(joined, cast.sid == joined.node, "left").select("sid", "gid", F.coalesce("component", "sid").alias("comp"))
    labelled, _ = common.stored(labelled, "jaccard-labelled")
    spread = labelled.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_ones = met.select("shingle", "gid", "n", "pos").join(spread, "gid")
    mixed = open_ones.groupBy("shingle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("shingle")
    rows = open_ones.select("shingle", "gid", "n", "pos").join(mixed, "shingle").join(labelled, "gid").select("shingle", "sid", "comp", "n", "pos")
    rows, _ = common.stored(rows, "jaccard-open")
    across = _apart(rows, "shingle", _bounds(percent, "n", "pos", "n2", "pos2"))
    inside, _ = common.stored(labelled.join(spread.where("lo <> hi").join(crowd, "gid").select("gid"), "gid"), "jaccard-inside")
    pairs = across.unionByName(_apart(inside, "gid"))
    linked = common.components(first.unionByName(_verified(pairs, classes, docs, width, percent)), "jaccard-components")

    by_set = members.join(linked, members.sid == linked.node, "left").select("set_key", F.coalesce("component", "sid").alias("component_id"))
    out = signed.select("doc_id", "n", "set_key").join(by_set, "set_key", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (of repeated rows, one)."""
    found, _ = common.stored(jaccard_components(docs), "jaccard-result")
    kept = common.without(docs, found.where("doc_id <> component_id").select("doc_id"))
    again, _ = common.stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-repeated")
    if again.isEmpty():
        return kept
    once = kept.join(common.sized(again), "doc_id", "left_semi").select(common.columns(docs)).dropDuplicates(["doc_id"])
    return common.without(kept, again).unionByName(once)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
rare AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM (SELECT e.* FROM e JOIN rare USING (g)) a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
r(node, comp) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(r.comp) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""
