"""Token counts: totals by source, language and tokenizer version, kept by signed deltas.

A change is an insert (+ count), a delete (- count) or a revision (- old count, + new count). A batch of changes is combined
to signed sums before and after one shuffle and committed under its id: the sums are written under a name of their own, and
one rename that cannot replace anything puts the marker of the id in place. So a repeated, restarted or concurrent commit of
an id changes nothing, and a commit that died leaves only sums that nothing names. Totals are the sums over committed
batches; ``compact`` folds those that one look has found into one set of sums that names the batches it holds.

Token counters are versions: ``words-1`` counts runs without ASCII white space, ``words-2`` runs of letters and digits, and
``byte_bpe_50k`` the tokens of a public byte-level vocabulary, whose path is a parameter.

Defined results: null and empty texts have 0 tokens and count as documents; null sources and languages are groups of their
own; repeated rows count as often as they occur; groups whose documents and tokens both sum to 0 are dropped; an empty batch
commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ("source", "lang", "tokenizer")
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def _bpe(text: str, path: str) -> int:
    return len(_encoder(path).encode_ordinary(text))


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def counted(docs: DataFrame, versions: tuple[str, ...], vocabulary: str = VOCABULARY) -> DataFrame:
    """source, lang, tokenizer, n_docs and n_tokens of each pass over ``docs``: sums of what a task has just read."""

    def count(batches):
        for batch in batches:
            source, lang = (batch.column(k).to_pylist() for k in (1, 2))
            for at, data, offs in common.passes(batch.column(0)):
                rows = len(offs) - 1
                sums: dict[tuple, list[int]] = {}
                for version in versions:
                    if version.startswith("words-"):
                        gap = common.SPACE if version == "words-1" else ~_ALNUM
                        n = np.diff(common.word_spans(data, offs, gap)[2]).tolist()
                    else:
                        raw = data.tobytes()
                        n = [_bpe(raw[a:b].decode("utf-8", "replace"), vocabulary) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                    for k in range(rows):
                        have = sums.setdefault((source[at + k], lang[at + k], version), [0, 0])
                        have[0] += 1
                        have[1] += n[k]
                keys = list(zip(*sums)) or [()] * 3
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in keys), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=[*KEYS, "n_docs", "n_tokens"])

    return common.in_batches(docs).select("text", "source", "lang").mapInArrow(count, "source string, lang string, tokenizer string, n_docs long, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, "n_docs", "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in the folder ``root`` of a file system with atomic renames, such as HDFS.

    ``data`` holds sums under names of their own. A batch counts once its marker, which names its sums, is in ``batches``; a
    compaction counts once its numbered marker is in ``compact``. Markers appear by a rename that fails where one is already.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        path = hadoop.Path(self.root)
        self._fs, self._files = path.getFileSystem(conf), hadoop.FileContext.getFileContext(path.toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _marked(self, folder: str) -> dict[str, str]:
        """The markers in ``folder`` and what they name."""
        if not self._fs.exists(self._path(folder)):
            return {}
        rows = self.spark.read.text(f"{self.root}/{folder}").select("_metadata.file_name", "value").collect()
        return {r["file_name"].removeprefix("m-"): r["value"] for r in rows}

    def _mark(self, folder: str, name: str, value: str) -> bool:
        """Whether this call has put the marker ``name`` in place; then it is there as a whole, else another was there first."""
        self._fs.mkdirs(self._path(folder))
        draft = self._path(f"staging/{name}-{common.uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.writeBytes(value)
        out.close()
        try:
            self._files.rename(draft, self._path(f"{folder}/m-{name}"), self._plain)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _state(self) -> tuple[int, str | None, set[str], dict[str, str]]:
        """The newest compaction: its number, its sums and the batches in them; and the other batches' sums.

        Batches are listed first: one that is gone by then is in a compaction that is seen afterwards.
        """
        batches, compacted = self._marked("batches"), self._marked("compact")
        if not compacted:
            return -1, None, set(), batches
        number, where = max((int(k), v) for k, v in compacted.items())
        inside = {r["value"] for r in self.spark.read.text(f"{self.root}/{where}/batches").collect()}
        return number, where, inside, {k: v for k, v in batches.items() if k not in inside}

    def committed(self) -> list[str]:
        """Ids of the batches that count, compacted ones too."""
        _, _, inside, others = self._state()
        return sorted(inside | set(others))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Whether the batch was new; a batch that is committed already leaves everything as it is."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch_id!r}")
        if batch_id in self.committed():
            return False
        sums = f"data/{batch_id}-{common.uuid.uuid4().hex}"
        _summed(deltas).where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.root}/{sums}")
        if self._mark("batches", batch_id, sums):
            return True
        self._fs.delete(self._path(sums), True)
        return False

    def _totals(self, where: str | None, others: dict[str, str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        paths = [f"{self.root}/{x}" for x in ([f"{where}/sums"] if where else []) + sorted(others.values())]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return _summed(rows).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        _, where, _, others = self._state()
        return self._totals(where, others)

    def compact(self) -> None:
        """Fold what one look finds committed into one set of sums. What it replaces stays for those who read it: ``clean``."""
        number, where, inside, others = self._state()
        new = f"data/compact-{common.uuid.uuid4().hex}"
        self._totals(where, others).write.parquet(f"{self.root}/{new}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(inside | set(others))], "value string").coalesce(1).write.text(f"{self.root}/{new}/batches")
        if not self._mark("compact", f"{number + 1:012d}", new):
            self._fs.delete(self._path(new), True)
            raise RuntimeError("another compaction has just been published")

    def clean(self) -> None:
        """Drop what the newest compaction has replaced, once nobody reads totals that are older."""
        number, where, inside, _ = self._state()
        for folder, gone in (("batches", lambda k: k in inside), ("compact", lambda k: int(k) < number)):
            for name, sums in self._marked(folder).items():
                if gone(name):
                    self._fs.delete(self._path(f"{folder}/m-{name}"), False)
                    self._fs.delete(self._path(sums), True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads every document under two tokenizers, revises one of them for every document, replays the load, and takes the
    documents of one language out and back in, with a compaction in between."""
    docs = common.table(spark, sf_dir, "documents")
    rollup = Rollup(spark, common.new_path(spark, "token-rollup"))
    counts, _ = common.stored(counted(docs, ("words-1", "words-2", "byte_bpe_50k")), "token-counts")
    load = counts.where("tokenizer <> 'words-2'")
    rollup.commit("load", inserts(load))
    rollup.commit("words-2", revisions(counts.where("tokenizer = 'words-1'"), counts.where("tokenizer = 'words-2'")))
    moved = counts.where("tokenizer <> 'words-1' and lang = 'en'")
    rollup.commit("out", deletes(moved))
    rollup.compact()
    rollup.commit("load", inserts(load))
    rollup.commit("back", inserts(moved))
    return rollup.totals()
