"""From files to a bundle: rank, cut, read, count, index, select, factor, render."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from xml.sax.saxutils import escape, quoteattr

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry import work
from textquarry.functions import columns as C
from textquarry.functions import tokens as T
from textquarry.operators import blocks, graph, outline, ranking, selection
from textquarry.operators.selection import Budget


@dataclass
class Bundle:
    root: str
    budget: Budget
    mode: str
    files: list[dict] = field(default_factory=list)
    index: list[dict] = field(default_factory=list)
    index_text: str = ""
    index_tokens: int = 0
    duplicates: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    shared: list[blocks.Block] = field(default_factory=list)
    discovered: int = 0
    scanned: int = 0
    unscanned: int = 0
    ignored: int = 0
    method: str = "heuristic"
    calibration: float = 1.0

    @property
    def content_tokens(self) -> int:
        return sum(f["tokens"] for f in self.files)

    @property
    def accounted(self) -> int:
        return self.content_tokens + self.index_tokens + self.budget.header

    @property
    def over_budget(self) -> int:
        return max(0, self.accounted - self.budget.total)


def index_lines(entries: list[dict], mode: str) -> list[str]:
    return [f"  {e['path']}" if mode == "paths" else f"  {e['tokens']:>9,}  {e['size']:>10,}  {e['path']}" for e in entries]


def trimmed_index(entries: list[dict], cap: int, mode: str, count=T.estimate, total: int = 0) -> tuple[str, int, int]:
    """The longest leading part of the index that fits ``cap``, found by bisection; its tokens, and those of all ``entries``.

    ``entries`` may be the first ones of ``total``, if they are more than fit.
    """
    if mode == "none" or not entries:
        return "", 0, 0
    lines = index_lines(entries, mode)
    total = max(total, len(lines))

    def leading(n: int) -> str:
        return "\n".join(lines[:n] + ([f"  ... and {total - n:,} more files (not listed)"] if n < total else []))

    whole = count(leading(len(lines)))
    if whole <= cap:
        return leading(len(lines)), whole, whole
    fits = bisect_right(range(1, len(lines)), cap, key=lambda n: count(leading(n)))
    return (leading(fits), count(leading(fits)), whole) if fits else ("", 0, whole)


def pack(
    files: DataFrame,
    budget: Budget,
    mode: str = "balanced",
    root: str = "",
    read: Callable[[DataFrame], DataFrame] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    reach_weight: float = 0.0,
    calibration: float = 1.0,
    factor_shared: bool = False,
    shared_min_lines: int = 4,
    shared_min_occurrences: int = 3,
    ignored: int = 0,
    progress: Callable[[str], None] | None = None,
) -> Bundle:
    """``files`` has path, size, ext, dirname, and text or whatever ``read`` makes text of.

    Ranking and the cut to ``max_scan`` use metadata only; at most ``max_scan`` texts reach the driver's selection.
    ``depth`` is the same as ``balanced``.
    """
    if mode not in ("balanced", "coverage", "depth"):
        raise ValueError(f"unknown mode {mode!r}; choose balanced, coverage or depth")
    scored = rerank(files) if rerank else ranking.scored(files)
    if reach_weight:
        source = read(files) if read else files
        _, _, hops = graph.analysed(source.select("path", "text"))
        scored = ranking.boosted(scored, hops, reach_weight)
    meta = ranking.scan_cut(scored.drop("text", "signals"), budget.max_scan) if budget.max_scan else scored.drop("text", "signals").withColumn("considered", F.lit(True))
    meta = work.stored(meta, "pack-ranked")
    picked = meta.where("considered")
    texts = read(picked) if read else picked.join(files.select("path", "text"), "path")
    texts = transform(texts) if transform else texts
    counted = C.with_tokens(texts.where("text is not null"), calibration=calibration)
    rows = []
    for r in counted.select("path", "size", "ext", "dirname", "score", "text", "tokens").orderBy(F.desc("score"), "path").toLocalIterator():
        rows.append(r.asDict() | {"lines": r["text"].count("\n") + 1 if r["text"] else 0})
        if progress and len(rows) % 500 == 0:
            progress(f"priced {len(rows):,} files")
    considered, total = picked.count(), meta.count()
    rest = meta.where("not considered").select("path", "size", C.size_tokens(F.col("size")).alias("tokens")).orderBy(F.desc("score"), "path")
    entries = [{"path": r["path"], "tokens": r["tokens"], "size": r["size"], "estimated": False} for r in rows]
    entries += [{"path": r["path"], "tokens": r["tokens"], "size": r["size"], "estimated": True} for r in rest.toLocalIterator()]
    made = assembled(rows, entries, total, considered, budget, mode, root, ignored, calibration)
    return factored(files.sparkSession, made, shared_min_lines, shared_min_occurrences) if factor_shared else made


def assembled(rows: list[dict], entries: list[dict], total: int, considered: int, budget: Budget, mode: str = "balanced", root: str = "", ignored: int = 0, calibration: float = 1.0) -> Bundle:
    """One bundle of the texts that were read (``rows``, by rank), the index ``entries`` and the number of all files."""
    notes: list[str] = []
    count = lambda text: T.estimate(text, calibration)
    listed = total - (considered - len(rows))
    text, index_tokens, whole = trimmed_index(entries, budget.index_cap, budget.manifest, count, listed)
    if total > considered:
        notes.append(f"contents of the top {considered:,} of {total:,} files by rank were read; the rest are in the index only")
    if whole > budget.manifest_cap:
        notes.append(f"index trimmed from {whole:,}{' or more' if listed > len(entries) else ''} to {budget.index_cap:,} tokens")
    if mode == "coverage":
        turn: Counter = Counter()
        for r in rows:
            r["turn"] = turn[r["dirname"]]
            turn[r["dirname"]] += 1
        rows.sort(key=lambda r: (r["turn"], r["dirname"]))
    room = budget.total - index_tokens - budget.header
    verdicts = selection.choose(rows, budget, room, calibration)
    chosen = [d for d in verdicts if d["verdict"] == "selected"]
    copies = [d for d in verdicts if d["verdict"] == "duplicate"]
    if room <= 0:
        notes.append("the budget leaves no room for any file")
    unused = room - sum(d["tokens"] for d in chosen)
    if unused > budget.total * 0.15:
        why = Counter("near-duplicate" if d["verdict"] == "duplicate" else d["verdict"] for d in verdicts if d["verdict"] != "selected")
        top = max(why.items(), key=lambda kv: kv[1], default=None)
        notes.append(f"about {unused:,} tokens unused; " + (f"most were kept out by: {top[0]} ({top[1]:,} files)" if top else "there was nothing more to add"))
    out = len(verdicts) - len(chosen) - len(copies)
    for n, said in ((out, "files left out by budget and limits"), (len(copies), f"near-duplicates left out (similarity {budget.dedupe_threshold:.0%} or more)"), (considered - len(rows), "files unreadable or not text"), (total - considered, "files below the scan cutoff")):
        if n:
            notes.append(f"{n:,} {said}")
    return Bundle(root, budget, mode, chosen, entries, text, index_tokens, copies, notes, [], total, len(rows), total - considered, ignored, "heuristic", calibration)


_BUNDLE = "bundle string, value string, n_files long, n_index long, n_duplicates long, discovered long, content_tokens long, accounted long"


def bundled(files: DataFrame, budget: Budget, mode: str = "balanced", form: str = "markdown", calibration: float = 1.0) -> DataFrame:
    """A rendered bundle for every value of ``bundle`` in ``files`` (bundle, path, text, size, ext, dirname), each in one task.

    Files are ranked by metadata; a task gets the first ``max_scan`` texts of its bundle and as many index rows as can fit,
    a token being spent on each at least, whatever the number of files. Paths are distinct within a bundle. The index holds
    these rows only. Blocks are not factored.
    """
    if mode not in ("balanced", "coverage", "depth"):
        raise ValueError(f"unknown mode {mode!r}; choose balanced, coverage or depth")
    if form not in SINKS:
        raise ValueError(f"unknown format {form!r}; choose one of {', '.join(SINKS)}")
    if not budget.max_scan:
        raise ValueError("bundles need max_scan, the number of texts that one task may hold")
    first = budget.max_scan + budget.index_cap + 1
    meta = ranking.scored(files.select("bundle", "path", "size", "ext", "dirname")).drop("signals")
    order = Window.partitionBy("bundle").orderBy(F.desc("score"), "path")
    ranked = meta.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= first)
    totals = meta.groupBy("bundle").agg(F.count("*").alias("total"))
    wanted = ranked.where(F.col("ord") <= budget.max_scan)
    read = C.with_tokens(files.select("bundle", "path", "text").join(wanted.select("bundle", "path"), ["bundle", "path"]).where("text is not null"), calibration=calibration)
    rows = ranked.join(read.select("bundle", "path", "text", "tokens"), ["bundle", "path"], "left").join(totals, "bundle")
    rows = rows.withColumn("priced", C.size_tokens(F.col("size")))

    def kernel(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        name, total = pdf["bundle"].iloc[0], int(pdf["total"].iloc[0])
        top, rest = pdf[pdf["ord"] <= budget.max_scan], pdf[pdf["ord"] > budget.max_scan]
        texts = top[top["text"].notna()]
        docs = [
            {"path": r.path, "size": int(r.size), "ext": r.ext, "dirname": r.dirname, "score": float(r.score), "text": r.text, "tokens": int(r.tokens), "lines": r.text.count("\n") + 1 if r.text else 0}
            for r in texts.astype(object).itertuples()
        ]
        entries = [{"path": d["path"], "tokens": d["tokens"], "size": d["size"], "estimated": False} for d in docs]
        entries += [{"path": r.path, "tokens": int(r.priced), "size": int(r.size), "estimated": True} for r in rest.astype(object).itertuples()]
        made = assembled(docs, entries, total, len(top), budget, mode, name, 0, calibration)
        return pd.DataFrame([(name, render(made, form), len(made.files), len(entries), len(made.duplicates), total, made.content_tokens, made.accounted)], columns=[c.split()[0] for c in _BUNDLE.split(", ")])

    return rows.groupBy("bundle").applyInPandas(kernel, _BUNDLE)


def write_bundles(bundles: DataFrame, path: str) -> None:
    """The texts (``value``) of ``bundles`` below ``path``, a folder for each bundle, in any store that Spark writes."""
    bundles.select("bundle", F.regexp_replace("value", "\\n\\z", "").alias("value")).write.partitionBy("bundle").text(path)


def factored(spark, bundle: Bundle, min_lines: int = 4, min_occurrences: int = 3) -> Bundle:
    """``bundle`` with repeated blocks moved to one section, unless that costs more than it saves."""
    texts = {f["path"]: f["text"] for f in bundle.files}
    if len(texts) < 2:
        return bundle
    found = blocks.find_blocks(spark.createDataFrame(list(texts.items()), "path string, text string"), min_lines)
    new, used = blocks.factor(texts, found, min_occurrences)
    report = blocks.savings(texts, new, used)
    net = report.saved - sum(b.tokens for b in used)
    if not used or net <= 0:
        return bundle
    files = [dict(f, text=new[f["path"]], tokens=T.estimate(new[f["path"]], bundle.calibration) if new[f["path"]] != f["text"] else f["tokens"]) for f in bundle.files]
    return replace(bundle, files=files, shared=used, notes=[*bundle.notes, f"{len(used):,} repeated blocks shared, saving about {net:,} tokens"])


def outlined(min_ratio: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    """A transform: outlines in place of the texts that shrink at least ``min_ratio`` times."""

    def apply(files: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def shrink(path, text):
            import pandas as pd

            def one(p, t):
                if t is None or not p.lower().endswith((*outline.PYTHON, *outline.SCRIPT)) or outline.ratio(t, p) < min_ratio:
                    return t
                return outline.render(outline.outline(t, p))

            return pd.Series([one(p, t) for p, t in zip(path, text)])

        return files.withColumn("text", shrink("path", "text"))

    return apply


# sinks ------------------------------------------------------------------------------------------------------------------


def _language(path: str) -> str:
    m = re.search(r"\.[^.]*$", path, re.DOTALL)
    return selection.LANGUAGES.get(m[0].lower(), "") if m else ""


def _common_language(paths) -> str:
    """That of the most frequent extension, of equally frequent ones the first in order."""
    counts = Counter(m[0].lower() if (m := re.search(r"\.[^.]*$", p, re.DOTALL)) else "" for p in paths)
    best = min(counts, key=lambda ext: (-counts[ext], ext), default="")
    return selection.LANGUAGES.get(best, "")


def fence(text: str, language: str = "") -> str:
    longest = max((len(m) for m in re.findall("`{3,}", text)), default=2)
    ticks = "`" * max(3, longest + 1)
    return f"{ticks}{language}\n{text}\n{ticks}"


def _safe(text: str) -> str:
    return re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", text)


def _cdata(text: str) -> str:
    return f"<![CDATA[{_safe(text).replace(']]>', ']]]]><![CDATA[>')}]]>"


def _attr(text: str) -> str:
    return quoteattr(_safe(text))


def _label(path: str) -> str:
    return path.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n").replace("`", "'")


def summary(b: Bundle) -> list[str]:
    out = [f"index: {len(b.index):,} entries, {b.index_tokens:,} tokens"]
    if b.duplicates:
        out.append(f"{len(b.duplicates):,} near-duplicates left out (up to {max(d['similarity'] for d in b.duplicates):.0%} similar)")
    if cut := [f for f in b.files if f["truncated"]]:
        out.append(f"{len(cut):,} files cut short, about {sum(max(0, f['original_tokens'] - f['tokens']) for f in cut):,} tokens saved")
    return out


def stats_line(b: Bundle) -> str:
    return f"budget {b.budget.total:,} tokens, {len(b.files):,} of {b.discovered:,} files, {b.mode}, {b.method} counts"


def _ids(b: Bundle) -> list[tuple[str, blocks.Block]]:
    ids = blocks.block_ids(b.shared)
    return sorted(((ids[x.text], x) for x in b.shared), key=lambda p: int(p[0][1:]))


def markdown(b: Bundle) -> str:
    parts = ["# Bundle", f"`{_label(b.root)}`", stats_line(b), "\n".join([f"- {x}" for x in summary(b)] + [f"- note: {x}" for x in b.notes])]
    if b.index_text:
        parts += ["## Index", fence(b.index_text)]
    if b.files:
        parts.append("## Files")
    for k, f in enumerate(b.files, 1):
        parts += [f"### {k}. `{_label(f['path'])}`" + (" *(cut short)*" if f["truncated"] else ""), f"{f['tokens']:,} tokens, {f['lines']:,} lines", fence(f["text"].rstrip("\n"), _language(f["path"]))]
    if b.shared:
        parts += ["## Shared blocks", "> Repeated blocks stand here once; files refer to them. The bundle is for reading, not for compiling."]
        for name, x in _ids(b):
            parts += [f"### {name}: {x.lines} lines", fence(x.text.rstrip("\n"), _common_language(x.files))]
    return "\n\n".join(parts) + "\n"


def tree(b: Bundle) -> str:
    parts = [f"root: {b.root}", stats_line(b), *summary(b)]
    if b.shared:
        parts.append(f"shared blocks: {len(b.shared)}")
    return "\n".join([*parts, *(["", b.index_text] if b.index_text else [])]) + "\n"


def xml(b: Bundle) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<bundle root={_attr(b.root)} budget="{b.budget.total}" used="{b.accounted}" files="{len(b.files)}" discovered="{b.discovered}" method={_attr(b.method)} mode={_attr(b.mode)}>']
    out.append(f"  <summary>{escape(_safe('; '.join(summary(b))))}</summary>")
    if b.index_text:
        out.append("  <index>")
        out += [f'    <entry path={_attr(e["path"])} tokens="{e["tokens"]}" bytes="{e["size"]}"' + (' estimated="true"' if e["estimated"] else "") + "/>" for e in b.index]
        out.append("  </index>")
    out.append("  <files>")
    for f in b.files:
        cut = ' truncated="true"' if f["truncated"] else ""
        out += [f'    <file path={_attr(f["path"])} tokens="{f["tokens"]}" lines="{f["lines"]}" language={_attr(_language(f["path"]))}{cut}>', _cdata(f["text"]), "    </file>"]
    out.append("  </files>")
    if b.shared:
        out.append("  <shared>")
        for name, x in _ids(b):
            out += [f'    <block id={_attr(name)} lines="{x.lines}" occurrences="{x.occurrences}">', _cdata(x.text), "    </block>"]
        out.append("  </shared>")
    return "\n".join([*out, "</bundle>"]) + "\n"


def as_json(b: Bundle) -> str:
    data = {
        "root": b.root, "budget": b.budget.total, "accounted": b.accounted, "method": b.method, "calibration": b.calibration, "mode": b.mode, "discovered": b.discovered, "scanned": b.scanned,
        "unscanned": b.unscanned, "ignored": b.ignored, "summary": summary(b), "notes": b.notes,
        "index": [{"path": e["path"], "tokens": e["tokens"], "bytes": e["size"], "estimated": e["estimated"]} for e in b.index],
        "shared_blocks": [{"id": n, "lines": x.lines, "occurrences": x.occurrences, "text": x.text} for n, x in _ids(b)],
        "files": [{"path": f["path"], "tokens": f["tokens"], "lines": f["lines"], "bytes": f["size"], "language": _language(f["path"]), "truncated": f["truncated"], "original_tokens": f["original_tokens"], "score": f["score"], "content": f["text"]} for f in b.files],
    }
    return json.dumps(data, indent=2, ensure_ascii=False) + "\n"


SINKS = {"markdown": markdown, "xml": xml, "json": as_json, "tree": tree}


def render(bundle: Bundle, form: str = "markdown") -> str:
    if form not in SINKS:
        raise ValueError(f"unknown format {form!r}; choose one of {', '.join(SINKS)}")
    return SINKS[form](bundle)
