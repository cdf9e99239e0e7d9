"""Secret scans: base patterns, and dictionary-primed zstandard novelty for what they miss.

Base spans are the matches of three patterns (assignment, access key, hex run), leftmost and non-overlapping for each kind.
The method adds spans: a candidate is a run of key characters that mixes letters and digits and stands in a sensitive
context: a keyword in the ``NEAR`` = 48 characters before it or earlier in its line or statement, or an adjoining line in such a context. Its
novelty is the number of compressed bytes that it adds to its surrounding text, the compressor being primed with a
dictionary of the corpus's own identifiers (``identifiers``: the words that most of its texts hold, without
digits, so that no secret is among them) and with that surrounding text (``AROUND`` = 2048 characters on either side), from which other copies of the candidate are blanked, so that a
repeated secret is as novel as a single one; a candidate that adds about the bytes that random text of its characters would
is incompressible and is reported as kind ``novel``. Adjoining lines of one key are one span, and so is the body of a private
key block. Spans are code-point offsets,
end exclusive, of the whole match. Scanning happens within a row; only the dictionary's words are counted over rows.

Defined results: null and empty texts have no spans; repeated rows give equal results; other columns are carried through
by ``redacted`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of at least the asked length is found just as by matching all runs and dropping the shorter ones.
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
_SENSITIVE = re.compile(r"pass(word|wd|phrase)?|secret|token|bearer|authori[sz]ation|api.?key|credential|private.?key|access.?key|auth", re.IGNORECASE)
KINDS = ("assign", "access", "hex", "novel")

#: Where a statement ends: at a line's end, unless an open value or an indented list goes on, at a brace, after a sentence.
_BREAK = re.compile(r"(?<![:=(\[\\|>+\s])[ \t\r]*\n(?![ \t])|(?<![:=(\[\\|>+,;\s])[ \t\r]*\n|\n[ \t\r]*\n|[{}]|[.!?](?=\s)")
#: What may stand between two lines of one key, besides one or two line ends or their escapes: quotes and marks around them.
_MARKS = re.compile(r"""[\s"'`,;+>|\#*()&\\-]*""")
#: A shorter last line of a wrapped key.
_TAIL = re.compile(r"""["'`,+\\ \t]*(?:\r?\n|\\n|n(?<=\\n))[ \t"'`>|#*]*([A-Za-z0-9+/_=~-]{1,15})(?=["'`,;\\)\s]*(?:\n|\\|$))""")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[nr])*")

#: Share of a candidate's length that it must add to the compressed text, and of what random text of its characters would add.
NOVELTY, RANDOM = 0.7, 0.9
#: Characters before a candidate in which a keyword always makes its context sensitive, and on either side that prime the compressor.
NEAR, AROUND = 48, 2048

#: Distinct texts that must hold a word of the dictionary, and the dictionary's bytes.
LEAST_TEXTS, DICTIONARY = 3, 4_096
#: A word of a dictionary: no part of a longer run of key characters, and without digits.
_WORD = r"(?<![A-Za-z0-9_+/=~.-])[A-Za-z_]{3,24}(?![A-Za-z0-9_+/=~-])"
#: Runs that stand for placeholders, in front of every dictionary.
_RUNS = " ".join([string.ascii_lowercase, string.ascii_uppercase, string.digits, *(c * 16 for c in "aAxX0")]).encode()


def identifiers(docs: DataFrame) -> bytes:
    """The words that most of the distinct texts hold, rarest first, as the dictionary of ``docs`` (text)."""
    texts = docs.select("text").where("text is not null").distinct()  # copies are one text
    found = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("word")).groupBy("word").count()
    best = found.where(F.col("count") >= LEAST_TEXTS).orderBy(F.desc("count"), "word").limit(DICTIONARY // 4).collect()
    words, size = [], 0
    for r in best:
        size += len(r["word"]) + 1
        if size <= DICTIONARY:
            words.append(r["word"])
    return b" ".join([_RUNS, *(w.encode() for w in reversed(words)), b""]) if words else _RUNS


def _size(raw: bytes, primer: bytes) -> int:
    used = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=0, write_checksum=0, write_dict_id=0)
    return len(zstandard.ZstdCompressor(dict_data=used, compression_params=options).compress(raw))


def novelty(candidate: str, before: str, after: str, dictionary: bytes = _RUNS) -> float:
    """Compressed bytes that ``candidate`` adds, as a share of its own bytes."""
    primer = dictionary + before.encode() + after.encode()
    tail = before[-32:].encode()
    raw = candidate.encode()
    return (_size(tail + raw, primer) - _size(tail, primer)) / max(1, len(raw))


def _surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands around a candidate, other copies of it (or of a value in it) blanked; a copy cut by the bounds is, too."""
    raw = text[a:b]
    cores = {raw.strip("+/_=~.-"), *(x.strip("+/_=~.-") for x in raw.split("="))}
    cores = sorted((x for x in cores if len(x) >= 12), key=len, reverse=True)
    before, after = text[max(0, a - AROUND - len(raw)) : a], text[b : b + AROUND + len(raw)]
    for core in cores:
        before, after = before.replace(core, " " * len(core)), after.replace(core, " " * len(core))
    return before[-AROUND:], after[:AROUND]


def _needed(raw: str) -> float:
    """The novelty from which ``raw`` is incompressible: a long text of few characters takes fewer bits for each."""
    return min(NOVELTY, RANDOM * (math.log2(max(2, len(set(raw)))) / 8 + 16 / len(raw)))


def _private_keys(text: str, dictionary: bytes) -> list[tuple[int, int]]:
    """Bodies of private key blocks that have an end."""
    out = []
    for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
        end = text.find("-----", m.end())
        if end < 0 or not text.startswith("-----END", end):
            continue
        body = re.sub(r"(?:\s|\\[nr])+$", "", text[m.end() : end])
        key = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", body)
        if len(key) >= 16 and novelty(key, *_surroundings(text, m.end(), m.end() + len(body)), dictionary) >= _needed(key):
            out.append((m.end(), m.end() + len(body)))
    return out


def _merged(found) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that ``found`` covers, in order."""
    starts, ends = [], []
    for a, b in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _overlaps(ranges: tuple[list[int], list[int]], a: int, b: int) -> bool:
    k = bisect_right(ranges[1], a)
    return k < len(ranges[0]) and ranges[0][k] < b


def spans(text: str, dictionary: bytes = _RUNS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in that order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = _merged((a, b) for a, _, b in found)
    private = _private_keys(text, dictionary)
    keys = _merged(private)
    found += [(a, 3, b) for a, b in private]
    words = breaks = None
    at, context, span, width, lines = 0, False, None, 0, 0  # of the candidate before: end, context, span, length, lines of its key
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        raw = m[0]
        if _overlaps(keys, a, b):
            at, context, span = b, False, None
            continue
        goes_on = context and 0 < text.count("\n", at, a) + text.count("\\", at, a) <= 2 and _MARKS.fullmatch(text, at, a) is not None
        mixed = any(c.isdigit() for c in raw) and any(c.isalpha() for c in raw)
        sensitive = goes_on or _SENSITIVE.search(text, max(0, a - NEAR), a) is not None
        if not sensitive and mixed:
            if words is None:
                words, breaks = [x.end() for x in _SENSITIVE.finditer(text)], [x.end() for x in _BREAK.finditer(text)] if _SENSITIVE.search(text) else []
            k = bisect_right(words, a)
            j = bisect_right(breaks, a)
            sensitive = k > 0 and words[k - 1] > (breaks[j - 1] if j else 0)
        before = span if goes_on else None
        at, context, span = b, sensitive, None
        # a line of a wrapped key may have no digit
        if not sensitive or not (mixed or before is not None and len(raw) == width) or _overlaps(base, a, b):
            lines = 0
            continue
        if novelty(raw, *_surroundings(text, a, b), dictionary) < _needed(raw):
            lines = 0
            continue
        span, lines = (a if before is None else before), (lines + 1 if before is not None and len(raw) == width else 1)
        if before is not None:
            found.pop()
        width = len(raw)
        end = b
        if lines > 1 and (tail := _TAIL.match(text, b)):
            end = tail.end(1)
        found.append((span, 3, end))
    return sorted(found)


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    dictionary = identifiers(docs)

    def find(batches):
        for batch in batches:
            rows = [spans(t, dictionary) if t else [] for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in range(3)]
            digests = [hashlib.sha256(_joined(x for x in r if x[1] < 3).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(_joined, rows), pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_batches(docs).select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, found, mask: str = "[redacted]") -> str:
    """``text`` with every span, overlapping ones merged, replaced by ``mask``."""
    out, at, done = [], 0, 0
    for a, _, b in found:
        if a >= done:
            out += [text[at:a], mask]
        done = at = max(done, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked, and ``n_chars``, where there is one, brought up to date."""
    where, dictionary = docs.columns.index("text"), identifiers(docs)
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            hits = [spans(t, dictionary) if t else [] for t in texts]
            new = [redact(t, h) if h else t for t, h in zip(texts, hits)]
            columns = list(batch.columns)
            columns[where] = pa.array(new, batch.schema.field(where).type)
            if size is not None:
                columns[size] = pa.array([len(t) if h else n for t, h, n in zip(new, hits, columns[size].to_pylist())], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return common.mapped(common.in_batches(docs), mask)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))

