"""LM scoring by cross-entropy difference of two matched bigram models.

A target and a background model share one vocabulary (every word of both corpora; a caller may ask for the most frequent
ones, the rest being one unknown word), the order, the smoothing (interpolated absolute discounting over add-one unigrams)
and its discount. A document's score is the mean over its words of (target loss - background loss), in nats: lower is more
like the target. The background of a document is all other documents: its own counts are taken out first, else each
document would predict itself. Counts cover every row of both corpora. Words are compared by 48-bit hashes.

Dataflow. Texts become chunks of some millions of words, each with its own sorted word table, which are stored. Every chunk
sends the sorted distinct bigrams it has, packed, to the tasks that count them; such a task adds them up, answers each chunk
in the same order, and sends on how many followers each context has. The words of a chunk go the same way: the task of a
range of hashes adds up their counts, as words and as contexts, and their followers, and answers. So a chunk gets exactly the
counts that its documents need; only a few sums reach the driver. There are as many parts as keep each at ``PART_WORDS``
words, whatever the number of tasks. A very common pair of words is one entry a chunk, and a very common context is spread
over ``SPREAD`` parts or one in eight of all parts.

Defined results: null and empty texts have 0 tokens and a score of 0; repeated rows count and are scored as often as they
occur; with an empty target, or as the only
document, the loss is that of the uniform unigram; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Stand-ins for hashes: the start of a text, and all words outside an asked vocabulary. Those of words are larger.
START, UNKNOWN = np.uint64(0), np.uint64(1)
DISCOUNT = 0.75
SPREAD = 16
#: Bits of a word's hash.
BITS = 48
#: Words that a task holds before it sends their counts, and words of a stored row, about.
HELD, CHUNK_WORDS = 3_000_000, 1_500_000
#: Words whose counts one part adds up, at most.
PART_WORDS = 4_000_000


def _zip(x: np.ndarray) -> bytes:
    """Bytes of equal weight lie together, so small numbers cost little."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.copy().tobytes(), 1) if len(x) else b""


def _unzip(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1).T.copy().view(kind).ravel() if blob else np.zeros(0, kind)


def _sum_by(keys: np.ndarray, *values: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.maximum(common.word_hashes(data, starts, ends) >> np.uint64(64 - BITS), UNKNOWN + np.uint64(1))


def _cuts(keys: np.ndarray, parts: int) -> list[int]:
    """Bounds of the equal ranges of hashes in sorted ``keys``."""
    return np.searchsorted(keys, np.array([(k << BITS) // parts for k in range(parts)], np.uint64)).tolist() + [len(keys)]


def vocabulary(texts: list[DataFrame], size: int) -> np.ndarray:
    """Sorted word hashes of the most frequent words of all ``texts`` (text)."""
    parts, most_held = common.partitions(texts[0]), HELD

    def emit(held) -> pa.RecordBatch:
        keys, n = _sum_by(*(np.concatenate(x) for x in zip(*held)))
        cut = _cuts(keys, parts)
        rows = [(p, keys[a:b].tobytes(), _zip(n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["p", "keys", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, offs in common.passes(batch.column(0)):
                starts, ends, _ = common.word_spans(data, offs)
                held.append(np.unique(_hashes(data, starts, ends), return_counts=True))
                size += len(held[-1][0])
                if size >= most_held:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def add(rows: pa.Table) -> pa.Table:
        keys, n = _sum_by(np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint64), np.concatenate([_unzip(x, np.uint32) for x in rows["n"].to_pylist()]).astype(np.int64))
        top = np.lexsort((keys, -n))[:size]
        return pa.table({"word": keys[top].view(np.int64), "n": n[top]})

    counts = [common.in_batches(t).select("text").mapInArrow(count, "p int, keys binary, n binary") for t in texts]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    rows = every.groupBy("p").applyInArrow(add, "word long, n long").orderBy(F.desc("n"), "word").limit(size).toArrow()
    return np.sort(rows["word"].to_numpy().view(np.uint64))


def _tokenised(docs: DataFrame, words, target: bool) -> DataFrame:
    """chunk, ids, lens, table (sorted hashes, ``START`` first) and words (places in the table) of ``docs`` (doc_id, text).

    A row has ``CHUNK_WORDS`` or a document more. ``words`` is a broadcast vocabulary, or None for all words.
    """

    most = CHUNK_WORDS

    def cut(batches):
        seq = TaskContext.get().partitionId() << 32
        names, lens, held, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            table, at = np.unique(np.concatenate([np.array([START]), *held]), return_inverse=True)
            packed = [pa.array([_zip(np.diff(table, prepend=START))], pa.binary()), pa.array([_zip(at[1:].astype(np.uint32))], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([names], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), *packed], names=["chunk", "ids", "lens", "table", "words"])

        for batch in batches:
            for at, data, offs in common.passes(batch.column(1)):
                starts, ends, first = common.word_spans(data, offs)
                h = _hashes(data, starts, ends)
                if words is not None:
                    h = np.where(np.isin(h, words.value), h, UNKNOWN)
                held.append(h)
                names += batch.column(0).slice(at, len(offs) - 1).to_pylist()
                lens += np.diff(first).tolist()
                size += len(h)
                if size >= most:
                    yield emit()
                    seq += 1
                    names, lens, held, size = [], [], [], 0
        if names:
            yield emit()

    out = common.in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "chunk long, ids array<long>, lens array<long>, table binary, words binary")
    return out.withColumn("target", F.lit(target))


def _sorted(blob: bytes) -> np.ndarray:
    """Sorted hashes that were packed as differences."""
    return np.cumsum(_unzip(blob, np.uint64), dtype=np.uint64)


def _contexts(words: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The place in the table of what stands before every word."""
    before = np.empty(len(words), np.uint32)
    before[1:] = words[:-1]
    starts = np.cumsum(lens) - lens
    before[starts[lens > 0]] = 0
    return before


def _pieces(keys: np.ndarray, table: np.ndarray, parts: int):
    """Sorted bigrams (context << 32 | word, places in ``table``) by part: the order, each one's hashes, and the parts' bounds."""
    context, word = table[keys >> np.uint64(32)], table[keys & np.uint64(0xFFFFFFFF)]
    spread = np.uint64(max(SPREAD, parts // 8))
    part = (common.mix(context + (word % spread) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, context[order], word[order], np.searchsorted(part[order], np.arange(parts + 1)).tolist()


_PIECE = "p int, chunk long, target boolean, contexts binary, words binary, n binary"
_SHARE = "p int, chunk long, target boolean, keys binary, n binary, more binary"


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def _bigrams(chunks: DataFrame, parts: int) -> DataFrame:
    """The distinct bigrams of each chunk and their counts, by part."""

    def count(batches):
        for batch in batches:
            for chunk, lens, table, words, target in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words, table = _unzip(words, np.uint32), _sorted(table)
                keys, n = np.unique((_contexts(words, np.array(lens, np.int64)).astype(np.uint64) << np.uint64(32)) | words, return_counts=True)
                order, context, word, cut = _pieces(keys, table, parts)
                n = n[order].astype(np.uint32)
                rows = [{"p": p, "chunk": chunk, "target": target, "contexts": _zip(np.diff(context[a:b], prepend=START)), "words": _zip(word[a:b]), "n": _zip(n[a:b])} for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                yield from _table(_PIECE, rows).to_batches()

    return chunks.select("chunk", "lens", "table", "words", "target").mapInArrow(count, _PIECE)


def _shares(chunks: DataFrame, parts: int) -> DataFrame:
    """The words of each chunk and their counts as words and as contexts, by range of hashes."""

    def count(batches):
        for batch in batches:
            for chunk, lens, table, words, target in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words, table = _unzip(words, np.uint32), _sorted(table)
                n, more = (np.bincount(x, minlength=len(table)).astype(np.uint32) for x in (words, _contexts(words, np.array(lens, np.int64))))
                cut = _cuts(table, parts)
                rows = [{"p": p, "chunk": chunk, "target": target, "keys": _zip(np.diff(table[a:b], prepend=START)), "n": _zip(n[a:b]), "more": _zip(more[a:b])} for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                yield from _table(_SHARE, rows).to_batches()

    return chunks.select("chunk", "lens", "table", "words", "target").mapInArrow(count, _SHARE)


def _counted(pieces: DataFrame, parts: int) -> DataFrame:
    """For each piece of a background chunk its counts in both models; and (no chunk) the followers of contexts."""

    def answer(rows: pa.Table) -> pa.Table:
        p, target = rows["p"][0].as_py(), rows["target"].to_pylist()
        context = [_sorted(x) for x in rows["contexts"].to_pylist()]
        ends = np.cumsum([len(x) for x in context]).tolist()
        context, word = np.concatenate(context), np.concatenate([_unzip(x, np.uint64) for x in rows["words"].to_pylist()])
        n = [_unzip(x, np.uint32).astype(np.int64) for x in rows["n"].to_pylist()]
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(new)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        cb, ct = (np.add.reduceat(np.concatenate([x * (t == m) for x, t in zip(n, target)])[order], first) for m in (False, True))
        out = []
        for chunk, a, b, t in zip(rows["chunk"].to_pylist(), [0, *ends], ends, target):
            if not t:
                out.append({"p": p, "chunk": chunk, "n": _zip(cb[at[a:b]]), "more": _zip(ct[at[a:b]])})
        keys, kb, kt = _sum_by(context[first], (cb > 0).astype(np.int64), (ct > 0).astype(np.int64))
        cut = _cuts(keys, parts)
        out += [{"p": q, "keys": _zip(np.diff(keys[a:b], prepend=START)), "n": _zip(kb[a:b].astype(np.uint32)), "more": _zip(kt[a:b].astype(np.uint32))} for q, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return _table(_SHARE, out)

    return pieces.groupBy("p").applyInArrow(answer, _SHARE)


_SUMS = "p int, chunk long, sums binary, words long, background long, target long"


def _summed(shares: DataFrame) -> DataFrame:
    """For each share of a background chunk the sums of its words; and (no chunk) how many words there are, and their counts."""

    def answer(rows: pa.Table) -> pa.Table:
        p, chunks, target = rows["p"][0].as_py(), rows["chunk"].to_pylist(), rows["target"].to_pylist()
        keys = [_sorted(x) for x in rows["keys"].to_pylist()]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums, a = np.zeros((6, len(every)), np.int64), 0
        own = []
        for chunk, t, k, n, more in zip(chunks, target, keys, rows["n"].to_pylist(), rows["more"].to_pylist()):
            i, n, more = at[a : a + len(k)], _unzip(n, np.uint32), _unzip(more, np.uint32)
            a += len(k)
            if chunk is None:
                sums[4, i] += n
                sums[5, i] += more
            else:
                sums[int(t), i] += n
                sums[2 + int(t), i] += more
                own += [] if t else [(chunk, i)]
        out = [{"p": p, "chunk": chunk, "sums": _zip(sums[:, i].ravel())} for chunk, i in own]
        out.append({"p": p, "words": int((every > UNKNOWN).sum()), "background": int(sums[0].sum()), "target": int(sums[1].sum())})
        return _table(_SUMS, out)

    return shares.groupBy("p").applyInArrow(answer, _SUMS)


def _own(doc: np.ndarray, place: np.ndarray, context: np.ndarray, counts: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """What a document itself adds to the counts at each of its words: to the pair, the context, its followers, and the word.

    ``place`` names each word's bigram among the chunk's sorted ones, whose contexts and background counts are given.
    """
    both, at, n = np.unique(doc * np.int64(max(1, len(context))) + place, return_inverse=True, return_counts=True)
    pair = both % max(1, len(context))
    owner, behind = both // max(1, len(context)), context[pair]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (behind[1:] != behind[:-1])])) if len(both) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(first, append=len(both)))
    held, alone = (np.add.reduceat(x, first) if len(first) else n for x in (n, (counts[pair] == n).astype(np.int64)))
    top = np.int64(words.max() + 1 if len(words) else 1)
    _, word, m = np.unique(doc * top + words, return_inverse=True, return_counts=True)
    return [n[at], held[group[at]], alone[group[at]], m[word]]


def probability(pair: np.ndarray, word: np.ndarray, context: np.ndarray, kinds: np.ndarray, total, size: int, discount: float = DISCOUNT) -> np.ndarray:
    """Interpolated absolute discounting: counts of the pair, the word, the context, and its distinct followers."""
    single = (word + 1.0) / (total + size)
    seen = np.maximum(context, 1)
    return np.where(context > 0, np.maximum(pair - discount, 0) / seen + discount * kinds / seen * single, single)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background and ce_diff of every row of ``docs`` (doc_id, text); ``target`` has text.

    With a ``size``, only so many words, the most frequent ones, are told apart.
    """
    spark = docs.sparkSession
    shared = None if size is None else spark.sparkContext.broadcast(vocabulary([docs, target], size))
    chunks, _ = common.stored(_tokenised(docs, shared, False).unionByName(_tokenised(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), shared, True)), "lm-words", "none")
    words = chunks.agg(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)"))).first()[0] or 0
    parts = max(common.partitions(docs), -(-words // PART_WORDS))
    pairs, _ = common.stored(_counted(_bigrams(chunks, parts), parts), "lm-pairs", "none")
    sums, _ = common.stored(_summed(_shares(chunks, parts).unionByName(pairs.where("chunk is null"))), "lm-sums", "none")
    distinct, *totals = (x or 0 for x in sums.agg(F.sum("words"), F.sum("background"), F.sum("target")).first())
    size = distinct + 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("p").select(["n", "more", "sums"]).to_pylist()
        pair = [np.concatenate([_unzip(r[c], np.int64) for r in right if r["sums"] is None] or [np.zeros(0, np.int64)]) for c in ("n", "more")]
        per = np.concatenate([_unzip(r["sums"], np.int64).reshape(6, -1) for r in right if r["sums"] is not None], axis=1)
        uni, ctx, kinds = per[:2], per[2:4], per[4:]
        out = ([], [], [], [])
        for ids, lens, table, words in zip(*(left[c].to_pylist() for c in ("ids", "lens", "table", "words"))):
            lens, w = np.array(lens, np.int64), _unzip(words, np.uint32)
            h = _contexts(w, lens)
            every, place = np.unique((h.astype(np.uint64) << np.uint64(32)) | w, return_inverse=True)
            order = _pieces(every, _sorted(table), parts)[0]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at = rank[place]
            doc = np.repeat(np.arange(len(lens)), lens)
            own = _own(doc, place, (every >> np.uint64(32)).astype(np.int64), pair[0][rank], w)
            loss = np.zeros((2, len(w)))
            for a in range(0, len(w), 1 << 18):
                part = slice(a, a + (1 << 18))
                p, v, c = at[part], w[part], h[part]
                less = [x[part] for x in own]
                loss[0, part] = -np.log(probability(pair[0][p] - less[0], uni[0][v] - less[3], ctx[0][c] - less[1], kinds[0][c] - less[2], totals[0] - lens[doc[part]], size))
                loss[1, part] = -np.log(probability(pair[1][p], uni[1][v], ctx[1][c], kinds[1][c], totals[1], size))
            means = [np.bincount(doc, loss[m], len(lens)) / np.maximum(lens, 1) for m in (1, 0)]
            for store, v in zip(out, (ids, lens.tolist(), means[0].tolist(), means[1].tolist())):
                store += v
        ids, lens, ce_t, ce_b = out
        t, b = np.round(np.array(ce_t, float), 9), np.round(np.array(ce_b, float), 9)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(lens, pa.int64()), "ce_target": t, "ce_background": b, "ce_diff": np.round(t - b, 9)})

    answers = pairs.where("chunk is not null").select("chunk", "p", "n", "more", F.lit(None).cast("binary").alias("sums"))
    answers = answers.unionByName(sums.where("chunk is not null").select("chunk", "p", F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("more"), "sums"))
    own = chunks.where("not target").select("chunk", "ids", "lens", "table", "words").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return own.applyInArrow(score, "doc_id long, n_tokens long, ce_target double, ce_background double, ce_diff double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how much better the assistant turns of the conversations predict them than the documents do."""
    turns = common.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return cross_entropy_difference(common.table(spark, sf_dir, "documents"), turns)
