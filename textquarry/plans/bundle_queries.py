"""More registered queries: what surrounds a bundle - signals, indexes, accounts, blocks, resolution, windows over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry import work
from textquarry.functions import columns as C
from textquarry.functions import fixed as V
from textquarry.operators import blocks, factoring, graph, ordered, outline, ranking, selection
from textquarry.plans.queries import _LINES, _LINKS, _STRIP, _TOP, _WS, FILES, ORACLES, PARTS, SCORED, _in, _links, _meta, query, token_sql
from textquarry.sources import corpus


@query(
    f"""WITH {PARTS} SELECT path, array_to_string(list_filter([
  CASE WHEN starts_with(stem, 'readme') THEN 'readme' WHEN stem IN {_in(V.ANCHOR_STEMS)} THEN 'anchor' WHEN regexp_matches(stem, '({"|".join(V.ANCHOR_ENDINGS)})$') THEN 'anchor-suffix' END,
  CASE WHEN {_TOP} IN {_in(V.ROOT_MARKERS)} THEN 'source-root' END,
  CASE WHEN ext IN {_in(V.SOURCE_EXTS)} THEN 'source' WHEN ext IN {_in(V.DOC_EXTS)} THEN 'docs' WHEN ext IN {_in(V.CONFIG_EXTS)} THEN 'config' END,
  CASE WHEN depth = 0 THEN 'top-level' WHEN depth <= 2 THEN 'shallow' END,
  CASE WHEN regexp_matches(stem, '({"|".join(V.STRUCTURAL_ENDINGS)})$') AND ext IN {_in(V.SOURCE_EXTS + V.CONFIG_EXTS)} THEN 'structural' END,
  CASE WHEN stem IN {_in(V.NOISE_STEMS)} THEN 'boilerplate-doc' END,
  CASE WHEN {" OR ".join(f"contains(path, '{m}')" for m in V.GENERATED_MARKERS)} THEN 'generated' END,
  CASE WHEN list_has_any(segs, [{", ".join(f"'{v}'" for v in V.VENDOR_DIRS)}]) THEN 'vendored' END,
  CASE WHEN {_TOP} IN {_in(V.LOW_VALUE_DIRS)} THEN 'low-value-dir' END,
  CASE WHEN size > 300000 THEN 'huge' WHEN size > 80000 THEN 'large' WHEN size < 2000 THEN 'small' END,
  CASE WHEN depth > 2 THEN 'depth' END], lambda x: x IS NOT NULL), ',') AS signals FROM parts"""
)
def score_signals(spark, sf_dir):
    rows = ranking.scored(_meta(spark, sf_dir))
    return rows.select("path", F.array_join(F.transform("signals", lambda s: s["key"]), ",").alias("signals"))


_SHOWN = {"readme": 7.0, "anchor": 2.4, "anchor-suffix": 1.3, "source-root": 1.9, "source": 1.5, "docs": 1.0, "config": 0.7, "top-level": 1.2, "shallow": 0.6, "structural": 1.4, "boilerplate-doc": -4.0, "generated": -3.5, "vendored": -3.0, "low-value-dir": -1.5, "huge": -2.5, "large": -1.2, "small": 0.4}


def _explain_sql() -> str:
    """The signals of every path with their weights, as the report shows them."""
    sql = ORACLES["score_signals"]
    for key, weight in _SHOWN.items():
        sql = sql.replace(f"THEN '{key}'", f"THEN '{key} {weight:+.1f}'")
    sql = sql.replace("THEN 'depth'", "THEN 'depth ' || printf('%+.1f', -0.45 * least(depth - 2, 6))").replace("IS NOT NULL), ',')", "IS NOT NULL), ', ')")
    return f"WITH {SCORED}, said AS ({sql}) SELECT path, printf('%6.2f', score) || '  ' || path || '  ' || signals AS line FROM scored JOIN said USING (path)"


@query(_explain_sql())
def explain_scores(spark, sf_dir):
    """The whole explain line of every file."""
    return ranking.explained(ranking.scored(_meta(spark, sf_dir))).select("path", "line")


@query(f"WITH {FILES}, {_LINES}, g AS (SELECT path, unnest(g) AS ok, unnest(range(len(g))) AS line FROM good) SELECT path, line::INT AS line, sum(ok) OVER (PARTITION BY path ORDER BY line)::BIGINT AS before_next FROM g")
def substantive_prefix(spark, sf_dir):
    """An empty text has one empty line here; equal lines of files of one path count together, as the SQL's frame has them."""
    lines = C.bound(corpus.documents(spark, sf_dir).select("path", "text"), ls=C.lines_lf(F.col("text")))
    rows = lines.select("path", F.posexplode(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.col("ls"))).alias("line", "x"))
    order = Window.partitionBy("path").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("path", "line", F.sum(C.substantive(F.col("x")).cast("long")).over(order).alias("before_next"))


@query(f"SELECT item_id, md5(regexp_replace(text || ' ' || chr(9) || chr(160), '[{_WS}]+$', '')) AS digest FROM benchmark")
def rstrip_unicode(spark, sf_dir):
    rows = corpus.read(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.md5(C.rstrip(F.concat("text", F.lit(" \t\u00a0")))).alias("digest"))


@query(f"SELECT page_id, CASE WHEN len(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 57)) || '...' END AS short FROM (SELECT page_id, {_STRIP.replace('(x,', '(x1,')} AS f FROM (SELECT page_id, regexp_replace(html, '[{_WS}]+', ' ', 'g') AS x1 FROM pages))")
def clipped_text(spark, sf_dir):
    rows = corpus.read(spark, sf_dir, "pages")
    return rows.select("page_id", C.clip(F.col("html"), 60).alias("short"))


@query(f"WITH {PARTS}, st(ext, opener, closer) AS (VALUES {', '.join(f'({e!r}, {o!r}, {c!r})' for e, (o, c) in blocks.STYLE.items())}) SELECT path, coalesce(opener, '#') AS opener, coalesce(closer, '') AS closer, coalesce(opener, '#') || ' [shared B' || size || ': 12 lines, listed under Shared blocks]' || coalesce(closer, '') AS marker FROM parts LEFT JOIN st ON st.ext = lower(regexp_extract(path, '\\.[^.]*$'))")
def comment_styles(spark, sf_dir):
    path, name = F.col("path"), F.concat(F.lit("B"), F.col("size"))
    return _meta(spark, sf_dir).select("path", C.comment_opener(path).alias("opener"), C.comment_closer(path).alias("closer"), C.marker(path, name, F.lit(12)).alias("marker"))


@query(f"WITH {PARTS}, n AS (SELECT lang, ext, count(*) AS n FROM parts GROUP BY ALL) SELECT lang, first(ext ORDER BY n DESC, ext) AS ext FROM n GROUP BY lang")
def dominant_extension(spark, sf_dir):
    rows = corpus.with_parts(corpus.documents(spark, sf_dir).select("path", "lang")).groupBy("lang", "ext").agg(F.count("*").alias("n"))
    return rows.groupBy("lang").agg(F.min(F.struct((-F.col("n")).alias("n"), "ext")).alias("x")).select("lang", "x.ext")


@query("SELECT page_id, contains(CASE WHEN page_id % 3 = 0 THEN chr(0) || html ELSE html END, chr(0)) AS is_binary, CASE page_id % 3 WHEN 1 THEN len(html) + 2 WHEN 2 THEN len(html) END::VARCHAR AS chars FROM pages")
def binary_sniff(spark, sf_dir):
    """Of three pages, one begins with a zero byte, one ends in a byte that is no UTF-8 and a bracket, one is left as it is."""
    html = F.col("html").cast("binary")
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(b"\x00"), html)).when(F.col("page_id") % 3 == 1, F.concat(html, F.lit(b"\xc3("))).otherwise(html)
    rows = corpus.read(spark, sf_dir, "pages").select("page_id", content.alias("content"))
    return rows.select("page_id", C.binary(F.col("content")).alias("is_binary"), F.length(C.decoded(F.col("content"))).cast("string").alias("chars"))


@query(f"WITH {SCORED}, {token_sql('files', 'doc_id')}, o AS (SELECT s.path, s.size, t.tokens, row_number() OVER (ORDER BY score DESC, s.path) AS k FROM scored s JOIN tok t USING (doc_id)) SELECT path, size, CASE WHEN k <= 100 THEN tokens ELSE greatest(1, ceil(size / 3.4))::BIGINT END AS tokens, k > 100 AS estimated FROM o")
def manifest_entries(spark, sf_dir):
    cut = ranking.scan_cut(ranking.scored(_meta(spark, sf_dir)).drop("signals"), 100)
    texts = corpus.documents(spark, sf_dir).select("doc_id", "text").join(cut.where("considered").select("doc_id", "path", "size"), "doc_id")
    return selection.manifest(C.with_tokens(texts), cut.where("not considered")).select("path", "size", "tokens", "estimated")


_ENTRIES = f"""{SCORED}, o AS (SELECT path, size, greatest(1, ceil(size / 3.4))::BIGINT AS tokens, row_number() OVER (ORDER BY score DESC, path) AS k, count(*) OVER () AS total FROM scored),
line AS (SELECT 2 * k AS id, CASE WHEN k > 1 THEN chr(10) ELSE '' END || format('  {{:>9}}  {{:>10}}  {{}}', format('{{:,}}', tokens), format('{{:,}}', size), path) AS text FROM o
  UNION ALL SELECT 2 * k + 1, CASE WHEN k < total THEN chr(10) || '  ... and ' || format('{{:,}}', total - k) || ' more files (not listed)' ELSE '' END FROM o),
{token_sql('line', 'id')}, spent AS (SELECT id, coalesce(cost, 0) AS c FROM line LEFT JOIN cost USING (id)),
part AS (SELECT o.*, ceil(round(sum(a.c) OVER (ORDER BY k) + b.c, 6))::BIGINT AS used FROM o JOIN spent a ON a.id = 2 * k JOIN spent b ON b.id = 2 * k + 1)"""


@query(f"WITH {_ENTRIES} SELECT path, k AS n, used FROM part WHERE used <= 2000")
def manifest_trim(spark, sf_dir):
    """The leading part of the index of all files that fits 2,000 tokens."""
    files = ranking.scored(_meta(spark, sf_dir)).select("path", "size", "score", C.size_tokens(F.col("size")).alias("tokens"))
    return selection.trimmed(files, [F.desc("score"), F.col("path")], 2_000, files.count()).select("path", "n", "used")


_HEADS = f"""{FILES}, cut AS (SELECT doc_id, path, text, string_split(text, chr(10)) AS l FROM files WHERE text IS NOT NULL AND contains(text, chr(10))),
upto AS (SELECT doc_id, path, unnest(range(1, len(l) + (l[-1] <> '')::INT)) AS k, l, len(l) AS total FROM cut),
head AS (SELECT doc_id * 1000000 + k AS id, doc_id, path, k, array_to_string(l[1:k], chr(10)) || chr(10) || chr(10) || '... [' || format('{{:,}}', total - k) || ' of ' || format('{{:,}}', total) || ' lines left out]' || chr(10) AS text FROM upto WHERE k < len(l)),
{token_sql('head', 'id')}, fit AS (SELECT doc_id, path, k, text, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY (tokens <= 200) DESC, CASE WHEN tokens <= 200 THEN -k ELSE k END) AS r FROM head JOIN tok USING (id))"""


@query(f"WITH {_HEADS} SELECT path, k::INT AS lines, tokens, md5(text) AS digest FROM fit WHERE r = 1")
def truncated_texts(spark, sf_dir):
    """Every text of several lines cut to 200 tokens with its note."""
    return selection.cut(corpus.documents(spark, sf_dir).where("contains(text, '\n')").select("path", "text"), 200).select("path", "lines", "tokens", F.md5("text").alias("digest"))


_CHOSEN = f"""{SCORED}, {token_sql('files', 'doc_id')}, o AS (SELECT lang, path, ext, dirname, tokens, row_number() OVER (PARTITION BY lang ORDER BY score DESC, path) AS k FROM scored JOIN tok USING (doc_id)),
r AS (SELECT lang, path, ext, dirname, tokens, k, tokens <= 20000 AS chosen, CASE WHEN tokens <= 20000 THEN tokens ELSE 0 END AS used FROM o WHERE k = 1
  UNION ALL SELECT o.lang, o.path, o.ext, o.dirname, o.tokens, o.k, r.used + o.tokens <= 20000, r.used + CASE WHEN r.used + o.tokens <= 20000 THEN o.tokens ELSE 0 END FROM r JOIN o ON o.lang = r.lang AND o.k = r.k + 1)"""


def _chosen(spark, sf_dir):
    files = ranking.scored(corpus.with_parts(C.with_tokens(corpus.documents(spark, sf_dir)).withColumn("bundle", F.col("lang")))).drop("signals", "text")
    files = work.stored(files.select("bundle", "path", "ext", "dirname", "score", "tokens"), "priced-files")  # texts are read once
    return files.join(selection.by_budget(files, 20_000), ["bundle", "path"])


@query(f"WITH RECURSIVE {_CHOSEN} SELECT lang AS bundle, ext, sum(tokens)::BIGINT AS spent, count(*) AS files FROM r WHERE chosen GROUP BY ALL")
def extension_spend(spark, sf_dir):
    return _chosen(spark, sf_dir).groupBy("bundle", "ext").agg(F.sum("tokens").alias("spent"), F.count("*").alias("files"))


@query(f"WITH RECURSIVE {_CHOSEN} SELECT lang AS bundle, dirname, sum(tokens)::BIGINT AS spent, count(*) AS files FROM r WHERE chosen GROUP BY ALL")
def directory_spend(spark, sf_dir):
    return _chosen(spark, sf_dir).groupBy("bundle", "dirname").agg(F.sum("tokens").alias("spent"), F.count("*").alias("files"))


@query(f"WITH RECURSIVE {_CHOSEN} SELECT lang AS bundle, sum(tokens)::BIGINT AS content, sum(tokens)::BIGINT + 600 AS accounted, greatest(0, sum(tokens)::BIGINT + 600 - 20600) AS over_budget, 20000 - sum(tokens) > 0.15 * 20000 AS headroom FROM r WHERE chosen GROUP BY lang")
def bundle_accounts(spark, sf_dir):
    content = F.sum("tokens")
    sums = _chosen(spark, sf_dir).groupBy("bundle").agg(content.alias("content"))
    header = selection.Budget(20_000).header
    accounted = F.col("content") + header
    return sums.select("bundle", "content", accounted.alias("accounted"), F.greatest(F.lit(0).cast("long"), accounted - 20_600).alias("over_budget"), (20_000 - F.col("content") > 3_000).alias("headroom"))


@query(f"WITH {PARTS}, o AS (SELECT lang, size, row_number() OVER (PARTITION BY lang ORDER BY size) AS k, count(*) OVER (PARTITION BY lang) AS n FROM parts) SELECT lang, size AS upper_median FROM o WHERE k = n // 2 + 1")
def upper_median(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).select("lang", F.col("size").alias("value"))
    middle = rows.groupBy("lang").agg(F.expr("count(*) div 2").alias("rank")).select("lang", F.lit("median").alias("want"), "rank")
    return ordered.order_statistics(rows, middle, ["lang"]).select("lang", F.col("value").cast("long").alias("upper_median"))


@query(f"WITH RECURSIVE {_LINKS}, r(node) AS (SELECT 'p1' UNION SELECT dst FROM r JOIN capped ON src = node) SELECT count(*) AS reached FROM r")
def reached_count(spark, sf_dir):
    return graph.reachable(_links(spark, sf_dir), spark.createDataFrame([("p1",)], "path string")).agg(F.count("*").alias("reached"))


@query(f"WITH {FILES}, {_LINES}, grp AS (SELECT \"window\" AS x, count(*) AS spots FROM w GROUP BY 1 HAVING count(DISTINCT path) >= 2) SELECT md5(x) AS digest, 'B' || row_number() OVER (ORDER BY (spots - 1) * len(x) DESC, x) AS id FROM grp".replace("AS window", 'AS "window"'))
def block_ids(spark, sf_dir):
    """All repeated windows, numbered from the one that saves most; no partition holds them all."""
    found = blocks.shared_windows(corpus.documents(spark, sf_dir), 2)
    order = [F.desc((F.col("n_spots") - 1) * F.length("window")), F.col("window")]
    numbered = ordered.running(found, order, k=F.lit(1))
    return numbered.select(F.md5("window").alias("digest"), F.concat(F.lit("B"), F.col("k").cast("string")).alias("id"))


@query(f"WITH {FILES}, {_LINES}, s AS (SELECT path, start, row_number() OVER (PARTITION BY path ORDER BY start) AS k FROM w) SELECT a.path, a.start::INT AS start, count(*) AS overlaps FROM s a JOIN s b ON a.path = b.path AND a.start <> b.start AND a.start < b.start + 2 AND b.start < a.start + 2 GROUP BY ALL")
def interval_overlaps(spark, sf_dir):
    """Runs of one file that overlap: those that start less than a width away, counted by a range frame."""
    runs = blocks.windows(corpus.documents(spark, sf_dir), 2).select("path", "start")
    near = Window.partitionBy("path").orderBy("start").rangeBetween(-1, 1)
    return runs.withColumn("overlaps", F.count("*").over(near) - 1).where("overlaps > 0")


_BLOCKS = f"""{FILES}, {_LINES}, many AS (SELECT w.path, w.start, ls.l, first_value(w.start) OVER g AS s1, first_value(ls.l) OVER g AS l1, w."window" AS x FROM w JOIN ls USING (path)
  WHERE w."window" IN (SELECT "window" FROM w GROUP BY 1 HAVING count(DISTINCT path) >= 2) WINDOW g AS (PARTITION BY w."window" ORDER BY w.path, w.start)),
far AS (SELECT *, coalesce(list_min([i FOR i IN range(least(200, len(l) - start, len(l1) - s1)) IF l[start + 1 + i] <> l1[s1 + 1 + i]]), least(200, len(l) - start, len(l1) - s1)) AS reach FROM many),
block AS (SELECT x, min(reach) AS n, count(*) AS spots, first(l1[s1 + 1:s1 + min_reach]) AS content FROM (SELECT *, min(reach) OVER (PARTITION BY x) AS min_reach FROM far) GROUP BY x)""".replace("AS window", 'AS "window"')


@query(f'WITH {_BLOCKS} SELECT md5(x) AS block, path, start::INT AS start FROM block JOIN w ON w."window" = x JOIN ls USING (path) WHERE l[start + 1:start + n] = content')
def block_locations(spark, sf_dir):
    """Where the repeated runs of all documents occur, wherever they were found."""
    files = corpus.documents(spark, sf_dir)
    runs = work.stored(blocks.runs(files, 2), "located-runs")
    return factoring.located(files, factoring.contents(files, runs))


_CLAIMS = f"""{_BLOCKS}, o AS (SELECT path, start, n, x, row_number() OVER (PARTITION BY path ORDER BY n * spots DESC, content, start) AS k FROM block JOIN w ON w."window" = x),
r AS (SELECT DISTINCT path, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT)[] AS taken, false AS own, NULL::VARCHAR AS x, NULL::BIGINT AS start FROM o
  UNION ALL SELECT path, k, CASE WHEN ok THEN list_append(taken, {{'s': start, 'e': start + n}}) ELSE taken END, ok, x, start FROM (SELECT o.path, o.k, r.taken, o.x, o.start, o.n, len([t FOR t IN r.taken IF t.s < o.start + o.n AND o.start < t.e]) = 0 AS ok FROM r JOIN o ON o.path = r.path AND o.k = r.k + 1))"""


@query(f"WITH RECURSIVE {_CLAIMS} SELECT md5(x) AS block, path, start::INT AS start FROM r WHERE own")
def block_claims(spark, sf_dir):
    """Which spots the repeated runs take, those of most lines times spots first."""
    files = corpus.documents(spark, sf_dir)
    runs = work.stored(blocks.runs(files, 2), "claimed-runs")
    order = work.stored(factoring.ranked(factoring.contents(files, runs).select("block", "lines", "spots")).select("block", "rank"), "claimed-order")
    spots = runs.join(order.withColumnRenamed("block", "window"), "window").select("rank", "path", "start", F.col("length").alias("n"))
    return factoring.claims(spots).join(order, "rank").select("block", "path", "start")


@query(
    f"""WITH RECURSIVE {_CLAIMS}, rawls AS (SELECT path, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS rl FROM files),
bfirst AS (SELECT x, n, min({{'p': path, 's': start}}) AS head FROM block JOIN w ON w."window" = x GROUP BY ALL), btext AS (SELECT md5(x) AS block, n, array_to_string(rl[head.s + 1:head.s + n], chr(10)) AS text FROM bfirst JOIN rawls ON path = head.p),
{token_sql('btext', 'block')}, own AS (SELECT md5(x) AS block, count(*) AS occurrences FROM r WHERE own GROUP BY ALL)
SELECT block, n AS lines, occurrences, tokens, (occurrences - 1) * tokens AS saved, md5(text) AS digest FROM own JOIN btext USING (block) JOIN tok USING (block)"""
)
def block_savings(spark, sf_dir):
    """The repeated runs that hold their spots, and the tokens that each would save if it stood once."""
    found = factoring.found_blocks(corpus.documents(spark, sf_dir), 2)
    saved = (F.col("occurrences") - 1) * F.col("tokens")
    return found.select("block", F.size("lines").cast("long").alias("lines"), "occurrences", "tokens", saved.alias("saved"), F.md5("text").alias("digest"))


#: Documents with marks in place of some letter pairs, so that brackets and strings open and close in prose.
_MARKS = (("ou", "("), ("er", ")"), ("en", ")"), ("qu", '"""'), ("ck", "'''"), ("\nD", "\n#D"), ("\nL", "\n\n  L"), ("\nT", "\n\n"))
_MARKED = "text"
for _old, _new in _MARKS:
    _MARKED = "replace({}, {}, {})".format(_MARKED, *("'" + m.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for m in (_old, _new)))


@query(
    f"""WITH RECURSIVE {_BLOCKS.replace("text, lang, source FROM", f"{_MARKED} AS text, lang, source FROM")},
spot AS (SELECT path, start, n FROM block JOIN w ON w."window" = x), line AS (SELECT path, unnest(range(len(l) + 1)) AS k, unnest(list_append(l, '')) AS x FROM ls WHERE path IN (SELECT path FROM spot)),
fact AS (SELECT *, regexp_matches(x, '^[{_WS}]*(#|//|/\\*|\\*|--|;|%|<!--|@|$)') AS alone, contains(x, '\"\"\"') AS d, contains(x, '''''''') AS s, trim(x, ' ' || chr(9)) AS t FROM line),
r AS (SELECT DISTINCT path, 0::BIGINT AS k, '' AS open, 0::BIGINT AS depth FROM fact
  UNION ALL SELECT path, k + 1, CASE WHEN alone THEN open WHEN open <> '' THEN CASE WHEN contains(x, open) THEN '' ELSE open END ELSE CASE WHEN len(x) - len(replace(x, q, '')) = 3 THEN q ELSE '' END END,
    CASE WHEN open <> '' OR alone OR d OR s THEN depth ELSE greatest(0, depth + len(regexp_replace(x, '[)\\]}}]', '', 'g')) - len(regexp_replace(x, '[(\\[{{]', '', 'g'))) END
  FROM (SELECT r.*, fact.* EXCLUDE (path, k), CASE WHEN d THEN '\"\"\"' ELSE '''''''' END AS q FROM r JOIN fact ON fact.path = r.path AND fact.k = r.k)),
f AS (SELECT fact.*, open, depth FROM fact JOIN r USING (path, k)),
run AS (SELECT path, start, n, list(f ORDER BY k) AS a FROM spot JOIN f USING (path) WHERE k BETWEEN start - 1 AND start + n GROUP BY ALL),
cut AS (SELECT path, start, n, CASE WHEN start = 0 THEN NULL ELSE a[1] END AS b, a[-1] AS e, a[-2] AS z, a[CASE WHEN start = 0 THEN 1 ELSE 2 END] AS h, a[CASE WHEN start = 0 THEN 2 ELSE 3 END] AS h2,
  len(list_filter(a[CASE WHEN start = 0 THEN 1 ELSE 2 END:-2], lambda y: regexp_matches(y.x, '^[ \t]'))) AS tabs FROM run)
SELECT path, start::INT AS start, n::INT AS length, coalesce(b.alone, true) AND h.depth = 0 AND e.depth = 0 AND NOT (h.open <> '' AND h2.open <> '') AND NOT (z.open <> '' AND e.open <> '') AND NOT (h.d OR h.s OR z.d OR z.s)
  AND (e.alone OR (z.alone AND z.t <> '') OR (tabs = 0 AND (z.t = '' OR CASE WHEN z.t[1] IN ('{{', '[') THEN z.t[-1] IN ('}}', ']') AND len(z.t) > 1 ELSE z.t[-1] IN (':', '}}', ';', ']') END))) AS replaceable FROM cut"""
)
def replaceable_runs(spark, sf_dir):
    """Which spots of the repeated runs can go without breaking what surrounds them."""
    text = F.col("text")
    for old, new in _MARKS:
        text = F.replace(text, F.lit(old), F.lit(new))
    files = work.stored(corpus.documents(spark, sf_dir).select("path", text.alias("text")), "marked-texts")
    spots = work.stored(blocks.runs(files, 2).select("path", "start", F.col("length").alias("n")), "marked-runs")
    return factoring.replaceable(files, spots).select("path", "start", F.col("n").alias("length"), "replaceable")


@query(None)
def factored_texts(spark, sf_dir):
    """All documents with their repeated blocks replaced by markers; held against the driver's factoring of a bundle in tests."""
    files = corpus.documents(spark, sf_dir).select("path", "text")
    texts, _ = factoring.factored(files, work.stored(factoring.found_blocks(files, 2), "factored-found"))
    return texts


def _commented(mark: str):
    """The whole text of a document as comment lines."""
    return F.concat(F.lit(f"\n{mark} "), F.regexp_replace(F.translate("text", "\x00", ""), "[\r\n]", f"\n{mark} "))


@query(
    f"""WITH {FILES}, ts AS (SELECT * FROM files WHERE path LIKE '%.ts'), types AS (SELECT path, row_number() OVER (ORDER BY path) AS k FROM ts WHERE path LIKE '%/types.ts'),
own AS (SELECT a.path AS src, b.path AS dst FROM ts a JOIN files b ON b.path = 'lib/t' || a.doc_id % 50 || '/types.ts'),
e AS (SELECT a.path AS src, b.path AS dst FROM files a JOIN files b ON b.path = 'core/' || a.lang || '/x' || (a.doc_id + 8) || '_server.py' WHERE a.path LIKE '%.py'
  UNION SELECT a.path, b.path FROM ts a JOIN files b ON b.path = 'src/' || a.lang || '/w' || (a.doc_id + 16) || '/index.ts' WHERE a.path LIKE 'src/%'
  UNION SELECT * FROM own UNION SELECT ts.path, types.path FROM ts, types WHERE types.k <= 8 AND ts.path NOT IN (SELECT src FROM own))
SELECT src, dst FROM e WHERE src <> dst"""
)
def import_edges(spark, sf_dir):
    """The whole graph: each index.ts imports a neighbour by its runtime name, each module names its package; texts follow as comments."""
    docs = corpus.documents(spark, sf_dir).where("path like '%.ts' or path like '%.py'")
    script = F.concat(F.expr("concat('import a from \\'../w', doc_id + 16, '/index.js\\'\\nimport b from \\'t', doc_id % 50, '/types\\'')"), _commented("//"))
    python = F.concat(F.expr("concat('from lib import x\\nimport core.', lang, '.x', doc_id + 8, '_server')"), _commented("#"))
    return graph.edges(docs.select("path", F.when(F.col("path").endswith(".ts"), script).otherwise(python).alias("text")))


@query(
    f"""WITH {FILES} SELECT path, 'class C' || doc_id || '(Base)' || chr(10) || CASE WHEN path LIKE '%.py' THEN '  run(self, a = 1)' ELSE '  run(a: number): void' END AS outline
FROM files WHERE (path LIKE '%.py' OR path LIKE '%.ts') AND text IS NOT NULL"""
)
def outline_nodes(spark, sf_dir):
    """Classes of every source file, with its whole text as the comment of a method."""
    files = corpus.documents(spark, sf_dir).where("path like '%.py' or path like '%.ts'")
    python = F.concat(F.expr("concat('class C', doc_id, '(Base):\\n    def run(self, a=1):\\n        return a')"), _commented("#"), F.lit("\n"))
    script = F.concat(F.expr("concat('export class C', doc_id, ' extends Base {\\n  run(a: number): void {')"), _commented("//"), F.lit("\n  }\n}\n"))
    return outline.rendered(outline.nodes(files.select("path", F.when(F.col("path").endswith(".py"), python).otherwise(script).alias("text"))))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS "begin", event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark, sf_dir):
    """Extension: the batch form of the windowed stream."""
    rows = corpus.read(spark, sf_dir, "events")
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("begin"), "event_type", "n")


@query(f"WITH pg AS (SELECT page_id, html AS text FROM pages), {token_sql('pg', 'page_id')} SELECT page_id, tokens FROM tok")
def count_tokens_pages(spark, sf_dir):
    return C.with_tokens(corpus.read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))).select("page_id", "tokens")
