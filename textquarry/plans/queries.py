"""Registered queries over the shared tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import columns as C
from textquarry.functions import fixed as V
from textquarry.functions import patterns
from textquarry.operators import accuracy, blocks, changes, duplicates, filters, graph, ranking, selection
from textquarry.sources import corpus

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.metadata(spark, sf_dir)


# SQL building blocks ----------------------------------------------------------------------------------------------------

PATH = corpus.DOCUMENT_PATH
FILES = f"files AS (SELECT doc_id, {PATH} AS path, CAST(strlen(text) AS BIGINT) AS size, text, lang, source FROM documents)"
PARTS = f"""{FILES}, named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, len(path) - len(replace(path, '/', '')) AS depth,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS dirname FROM files),
parts AS (SELECT *, lower(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext,
  lower(CASE WHEN regexp_matches(name, '^\\.*[^.].*\\.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END) AS stem,
  string_split(lower(path), '/')[1:-2] AS segs FROM named)"""
_TOP = "coalesce(segs[1], '')"
SCORED = f"""{PARTS}, scored AS (SELECT *, round(
  CASE WHEN starts_with(stem, 'readme') THEN 7.0 WHEN stem IN {_in(V.ANCHOR_STEMS)} THEN 2.4 WHEN regexp_matches(stem, '({"|".join(V.ANCHOR_ENDINGS)})$') THEN 1.3 ELSE 0 END
  + CASE WHEN {_TOP} IN {_in(V.ROOT_MARKERS)} THEN 1.9 ELSE 0 END
  + CASE WHEN ext IN {_in(V.SOURCE_EXTS)} THEN 1.5 WHEN ext IN {_in(V.DOC_EXTS)} THEN 1.0 WHEN ext IN {_in(V.CONFIG_EXTS)} THEN 0.7 ELSE 0 END
  + CASE WHEN depth = 0 THEN 1.2 WHEN depth <= 2 THEN 0.6 ELSE 0 END
  + CASE WHEN regexp_matches(stem, '({"|".join(V.STRUCTURAL_ENDINGS)})$') AND ext IN {_in(V.SOURCE_EXTS + V.CONFIG_EXTS)} THEN 1.4 ELSE 0 END
  + CASE WHEN stem IN {_in(V.NOISE_STEMS)} THEN -4.0 ELSE 0 END
  + CASE WHEN {" OR ".join(f"contains(path, '{m}')" for m in V.GENERATED_MARKERS)} THEN -3.5 ELSE 0 END
  + CASE WHEN list_has_any(segs, [{", ".join(f"'{v}'" for v in V.VENDOR_DIRS)}]) THEN -3.0 ELSE 0 END
  + CASE WHEN {_TOP} IN {_in(V.LOW_VALUE_DIRS)} THEN -1.5 ELSE 0 END
  + CASE WHEN size > 300000 THEN -2.5 WHEN size > 80000 THEN -1.2 WHEN size < 2000 THEN 0.4 ELSE 0 END
  + CASE WHEN depth > 2 THEN -0.45 * least(depth - 2, 6) ELSE 0 END, 4)::DOUBLE AS score FROM parts)"""
_WS = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_PIECES = f"''(?:[sdmt]|ll|ve|re)| ?[\\p{{L}}\\p{{Nl}}\\p{{No}}]+| ?\\p{{Nd}}+| ?[^{_WS}\\p{{L}}\\p{{N}}_]+|_+|[{_WS}]+"
_CLASS = """CASE WHEN strlen(p) <> len(p) THEN 'nonascii' WHEN p IN ('''s', '''d', '''m', '''t', '''ll', '''ve', '''re') THEN 'mixed'
  WHEN p[-1] = '_' THEN 'underscore' WHEN regexp_matches(p, '[A-Za-z]$') THEN 'letters' WHEN regexp_matches(p, '[0-9]$') THEN 'digits'
  WHEN regexp_matches(p, '[\\t-\\r\\x1c-\\x20]$') THEN 'ws' ELSE 'punct' END"""


def token_sql(source: str, key: str, calibration: float = 1.0) -> str:
    """CTEs that end in tok(key, tokens) for the texts of ``source``."""
    sums = " + ".join(f"coalesce(sum(n - {p}) FILTER (c = '{c}' AND n > {p}), 0) / {r}" for c, (r, p) in V.TOKEN_COSTS.items())
    free = " OR ".join(f"(c = '{c}' AND n <= {p})" for c, (_, p) in V.TOKEN_COSTS.items())
    return f"""pc AS (SELECT {key}, unnest(regexp_extract_all(text, '{_PIECES}')) AS p FROM {source}),
cl AS (SELECT {key}, {_CLASS} AS c, CAST(len(p) AS DOUBLE) AS n FROM pc),
cost AS (SELECT {key}, count(*) FILTER ({free}) + {sums} AS cost FROM cl GROUP BY ALL),
tok AS (SELECT s.{key}, CAST(CASE WHEN s.text = '' THEN 0 ELSE greatest(1, ceil(coalesce(cost, 0) * {calibration})) END AS BIGINT) AS tokens FROM {source} s LEFT JOIN cost USING ({key}))"""


# scans, filters ---------------------------------------------------------------------------------------------------------


@query(f"WITH {PARTS} SELECT path, size, ext, name, CAST(depth AS INT) AS depth, dirname, stem FROM parts")
def files_parts(spark, sf_dir):
    return corpus.with_parts(_meta(spark, sf_dir)).select("path", "size", "ext", "name", "depth", "dirname", C.stem(F.col("path")).alias("stem"))


def _rule_sql(rules) -> str:
    out = "false"
    for rule in rules:
        out = f"CASE WHEN regexp_matches(p, '{rule.regex.replace(chr(39), chr(39) * 2)}') THEN {str(not rule.negated).lower()} ELSE {out} END"
    return out


_EXTRA = patterns.ignore_rules("*.md\n!README.md\n/lib/\ndeep_[0-4]*.go\ncmd/**/main.go\n!cmd/m?/main.go\n# note\n")


@query(
    f"""WITH {FILES}, rules AS (SELECT * FROM (VALUES {", ".join(f"(0, {k}, '{r.regex.replace(chr(39), chr(39) * 2)}', {r.negated})" for k, (_, _, r) in enumerate(filters.default_rules()))},
  {", ".join(f"(1, {k}, '{r.regex}', {r.negated})" for k, r in enumerate(_EXTRA))}) t(layer, ord, regex, negated)),
up AS (SELECT path, array_to_string(string_split(path, '/')[1:i], '/') AS p FROM files, range(1, 12) t(i) WHERE i <= len(string_split(path, '/'))),
hit AS (SELECT path, p, arg_max(NOT negated, layer * 1000 + ord) AS v FROM up JOIN rules ON regexp_matches(p, regex) GROUP BY ALL)
SELECT path, coalesce(bool_or(v), false) AS is_ignored FROM files LEFT JOIN hit USING (path) GROUP BY path"""
)
def ignore_rules(spark, sf_dir):
    rules = filters.default_rules() + [("", 1000 + k, r) for k, r in enumerate(_EXTRA)]
    return filters.ignored(_meta(spark, sf_dir).select("path"), rules)


@query(
    f"""WITH {FILES}, rules AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{r.regex}', {r.negated})" for k, r in enumerate(_EXTRA))}) t(ord, regex, negated)),
hit AS (SELECT path, arg_max(NOT negated, ord) AS v FROM files JOIN rules ON regexp_matches(path, regex) GROUP BY path)
SELECT path, coalesce(v, false) AS is_ignored FROM files LEFT JOIN hit USING (path)"""
)
def ignore_last_match(spark, sf_dir):
    rules = spark.createDataFrame([(0, k, "", r.regex, r.negated) for k, r in enumerate(_EXTRA)], "layer int, ord int, base string, regex string, negated boolean")
    return filters.last_match(_meta(spark, sf_dir).select("path"), rules)


@query(
    f"""WITH {FILES}, rules AS (SELECT doc_id AS ord, CASE doc_id % 4 WHEN 0 THEN '^(?:.*/)?w' || doc_id + 2 || '(?:/.*)?$' WHEN 1 THEN '^src/' || lang || '/' || source || '/mod_' || doc_id || '[^/]*(?:/.*)?$'
  WHEN 2 THEN '^(?:.*/)?' || source || '/(?:.*/)?[^/]*_' || doc_id + 3 || '\\.min\\.js(?:/.*)?$' ELSE '^(?:.*/)?t' || doc_id || '/[^/]*\\.ts(?:/.*)?$' END AS regex, doc_id % 5 = 0 AS negated FROM documents),
near AS MATERIALIZED (SELECT path, ord, regex, negated FROM files JOIN rules ON contains(path, ord::VARCHAR) OR contains(path, (ord + 2)::VARCHAR) OR contains(path, (ord + 3)::VARCHAR)),
hit AS (SELECT path, arg_max(NOT negated, ord) AS v FROM near WHERE regexp_matches(path, regex) GROUP BY path)
SELECT path, coalesce(v, false) AS is_ignored FROM files LEFT JOIN hit USING (path)"""
)
def rules_as_data(spark, sf_dir):
    """A rule from every document, each tried only on the paths that hold its literal."""
    regex = """CASE doc_id % 4 WHEN 0 THEN concat('^(?:.*/)?w', doc_id + 2, '(?:/.*)?$') WHEN 1 THEN concat('^src/', lang, '/', source, '/mod_', doc_id, '[^/]*(?:/.*)?$')
      WHEN 2 THEN concat('^(?:.*/)?', source, '/(?:.*/)?[^/]*_', doc_id + 3, '\\\\.min\\\\.js(?:/.*)?$') ELSE concat('^(?:.*/)?t', doc_id, '/[^/]*\\\\.ts(?:/.*)?$') END"""
    docs = corpus.documents(spark, sf_dir)
    rules = docs.select(F.lit(0).alias("layer"), F.col("doc_id").alias("ord"), F.lit("").alias("base"), F.expr(regex).alias("regex"), (F.col("doc_id") % 5 == 0).alias("negated"))
    return filters.last_match(docs.select("path"), rules)


@query(f"WITH {FILES} SELECT path FROM files WHERE len(list_intersect(string_split(path, '/'), [{', '.join(repr(x) for x in V.HARD_SKIP_DIRS)}])) = 0 AND NOT contains(path, '/vendor/')")
def skip_directories(spark, sf_dir):
    files = _meta(spark, sf_dir)
    return files.where(~filters.hard_skipped(F.col("path")) & ~F.arrays_overlap(C.segments(F.col("path")), F.array(F.lit("vendor")))).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE (path LIKE '%.py' OR path LIKE 'docs/%' OR path LIKE '%/docs/%') AND NOT (path LIKE 'tests/%' OR path LIKE '%/tests/%' OR regexp_matches(path, '(^|/)mod_.*7\\.py$'))")
def include_exclude(spark, sf_dir):
    files = _meta(spark, sf_dir)
    return files.where(filters.globbed(F.col("path"), ["*.py", "./docs/*"], ["tests/*", "mod_*7.py"])).select("path")


@query(f"WITH {FILES} SELECT path, size FROM files WHERE size <= 4000")
def max_size(spark, sf_dir):
    return _meta(spark, sf_dir).where("size <= 4000").select("path", "size")


_CHANGED = "SELECT path, CASE doc_id % 9 WHEN 0 THEN 'M' WHEN 1 THEN 'D' END AS status FROM files WHERE doc_id % 9 < 2"


def _changed(spark, sf_dir):
    files = _meta(spark, sf_dir)
    entries = files.where("doc_id % 9 < 2").select("path", F.when(F.col("doc_id") % 9 == 0, "M").otherwise("D").alias("status"), "doc_id")
    return files, entries, files.where("doc_id % 9 = 2 or doc_id % 27 = 0").select("path", "doc_id")


@query(f"WITH {FILES} SELECT path, size FROM files WHERE doc_id % 9 IN (0, 2) OR doc_id % 27 = 0")
def changed_semi_join(spark, sf_dir):
    files, entries, fresh = _changed(spark, sf_dir)
    return filters.restricted(files, filters.changed_paths(entries, fresh)).select("path", "size")


@query(f"WITH {FILES} SELECT count(*) AS n FROM files WHERE doc_id % 9 IN (0, 2) OR doc_id % 27 = 0")
def changed_count(spark, sf_dir):
    _, entries, fresh = _changed(spark, sf_dir)
    return filters.changed_paths(entries, fresh).agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 9 < 2 THEN doc_id % 13 ELSE 0 END AS added, CASE WHEN doc_id % 9 < 2 THEN doc_id % 7 ELSE 0 END AS removed FROM files WHERE doc_id % 9 < 3 OR doc_id % 27 = 0")
def diffstat_anti_union(spark, sf_dir):
    _, entries, fresh = _changed(spark, sf_dir)
    rows = entries.select("path", (F.col("doc_id") % 13).alias("added"), (F.col("doc_id") % 7).alias("removed"), F.lit(1).alias("ord"))
    older = entries.select("path", F.lit(999).cast("long").alias("added"), F.lit(999).cast("long").alias("removed"), F.lit(0).alias("ord"))
    return filters.diffstat(rows.unionByName(older), fresh)


@query(f"WITH {FILES} SELECT substr(path, 5) AS path, min(doc_id) AS ord FROM files WHERE starts_with(path, 'src/') GROUP BY 1")
def relative_paths(spark, sf_dir):
    return filters.relative(_meta(spark, sf_dir).select(F.col("doc_id").alias("ord"), "path"), "/src/").select("path", "ord")


@query(
    f"""WITH {FILES}, up AS (SELECT *, string_split(path, '/') AS parts, [array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')) + 1)] AS ps FROM files),
cut AS (SELECT *, list_filter(ps, lambda p: regexp_matches(p, '(^|/)(vendor|tests)(/|$)') OR (regexp_matches(p, '\\.min\\.js$') AND NOT regexp_matches(p, '3\\.min\\.js$'))
  OR regexp_matches(p, '^docs/en(/|$)') OR (p <> path AND string_split(p, '/')[-1] IN {_in(V.HARD_SKIP_DIRS)}))[1] AS top FROM up),
kinds AS (SELECT *, CASE WHEN top IS NOT NULL THEN 'pruned' WHEN path LIKE 'cmd/%' OR path LIKE '%/cmd/%' THEN 'unwanted' WHEN size > 4000 THEN 'too_large' WHEN doc_id % 40 = 9 THEN 'binary' ELSE 'file' END AS kind FROM cut),
dirs AS (SELECT DISTINCT d FROM (SELECT top, unnest(ps[:-2]) AS d FROM kinds) WHERE top IS NULL OR (d <> top AND NOT starts_with(d, top || '/')))
SELECT count(*) FILTER (kind = 'file') AS files, CAST(coalesce(sum(size) FILTER (kind = 'file'), 0) AS BIGINT) AS total_bytes, count(DISTINCT top) + count(*) FILTER (kind = 'unwanted') AS ignored,
  count(*) FILTER (kind = 'too_large') AS too_large, count(*) FILTER (kind = 'binary') AS binary, (SELECT count(*) FROM dirs) + 1 AS directories FROM kinds"""
)
def scan_counters(spark, sf_dir):
    """What a walk over all paths counts; some files begin with a zero byte."""
    files = corpus.documents(spark, sf_dir, even=False)
    content = F.when(F.col("doc_id") % 40 == 9, F.concat(F.lit(b"\x00"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    rows = files.select("path", "size", C.binary(content).alias("is_binary"))
    rules = [("", k, patterns.ignore_rule(line)) for k, line in enumerate(("vendor/", "tests/", "*.min.js", "!*3.min.js", "/docs/en"))]
    return filters.scan_counts(rows, rules, exclude=["cmd/*"], max_size=4000)


# ranking ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {SCORED} SELECT path, size, score FROM scored")
def score(spark, sf_dir):
    return ranking.scored(_meta(spark, sf_dir)).select("path", "size", "score")


@query(f"WITH {SCORED.replace('CAST(strlen(text) AS BIGINT) AS size', 'CAST(strlen(text) * 20 AS BIGINT) AS size')} SELECT path, score FROM scored")
def score_large_files(spark, sf_dir):
    return ranking.scored(_meta(spark, sf_dir).withColumn("size", F.col("size") * 20)).select("path", "score")


@query(f"WITH {SCORED} SELECT path, score FROM scored ORDER BY score DESC, path LIMIT 40")
def rank_topk(spark, sf_dir):
    return ranking.top(_meta(spark, sf_dir), 40).select("path", "score")


@query(f"WITH {SCORED} SELECT path, row_number() OVER (ORDER BY score DESC, path) <= 100 AS considered FROM scored")
def scan_cutoff(spark, sf_dir):
    return ranking.scan_cut(ranking.scored(_meta(spark, sf_dir)), 100).select("path", "considered")


@query(f"WITH {SCORED} SELECT path, row_number() OVER (PARTITION BY dirname ORDER BY score DESC, path) - 1 AS turn FROM scored")
def coverage_round_robin(spark, sf_dir):
    return ranking.round_robin(ranking.scored(corpus.with_parts(_meta(spark, sf_dir)))).select("path", F.col("turn").cast("long").alias("turn"))


@query(
    f"""WITH {SCORED} SELECT path, round(score + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE round(5 * power(0.6, doc_id % 6), 4) END, 4) AS score,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 6 AS VARCHAR) END AS hops FROM scored"""
)
def reach_boost(spark, sf_dir):
    files = ranking.scored(_meta(spark, sf_dir))
    hops = _meta(spark, sf_dir).where("doc_id % 3 <> 0").select("path", (F.col("doc_id") % 6).cast("int").alias("hops"))
    return ranking.boosted(files, hops, 5.0).select("path", "score", F.col("hops").cast("string").alias("hops"))


# tokens -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {FILES}, {token_sql('files', 'doc_id')} SELECT path, len(text) AS chars, tokens, CASE WHEN tokens > 0 THEN round(len(text) / tokens, 2) ELSE 0 END AS chars_per_token FROM files JOIN tok USING (doc_id)")
def count_tokens(spark, sf_dir):
    files = C.with_tokens(corpus.documents(spark, sf_dir))
    chars = F.length("text").cast("long")
    return files.select("path", chars.alias("chars"), "tokens", C.chars_per_token(chars, F.col("tokens")).alias("chars_per_token"))


@query(f"WITH {FILES}, {token_sql('files', 'doc_id')} SELECT lang, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files FROM files JOIN tok USING (doc_id) GROUP BY lang")
def tokens_by_lang(spark, sf_dir):
    return C.with_tokens(corpus.documents(spark, sf_dir)).groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("files"))


@query(f"WITH src AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations), {token_sql('src', 'k', 1.25)} SELECT k, tokens FROM tok")
def tokens_calibrated(spark, sf_dir):
    rows = corpus.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return C.with_tokens(rows, calibration=1.25).select("k", "tokens")


@query(f"WITH {FILES}, pc AS (SELECT unnest(regexp_extract_all(text, '{_PIECES}')) AS p FROM files) SELECT {_CLASS} AS cls, CAST(len(p) AS INT) AS len, count(*) AS n FROM pc GROUP BY ALL")
def piece_histogram(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).select(F.explode(C.pieces(F.col("text"))).alias("p"))
    return rows.groupBy(C.piece_class(F.col("p")).alias("cls"), F.length("p").alias("len")).agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT path, CAST(greatest(1, ceil(size / 3.4)) AS BIGINT) AS tokens FROM files")
def size_priced_tokens(spark, sf_dir):
    return _meta(spark, sf_dir).select("path", C.size_tokens(F.col("size")).alias("tokens"))


@query(f"WITH {SCORED}, firsts AS (SELECT doc_id, path, score, text FROM scored ORDER BY score DESC, path LIMIT 40), {token_sql('firsts', 'doc_id')} SELECT path, score, tokens, CAST(sum(tokens) OVER () AS BIGINT) AS shown FROM firsts JOIN tok USING (doc_id)")
def count_report(spark, sf_dir):
    """The limit applies to metadata; only the rows shown have their texts read and counted."""
    firsts = ranking.top(_meta(spark, sf_dir), 40).select("doc_id", "path", "score")
    files = corpus.documents(spark, sf_dir).select("doc_id", "text").join(F.broadcast(firsts), "doc_id")
    shown = C.with_tokens(files).select("path", "score", "tokens")
    return shown.withColumn("shown", F.sum("tokens").over(Window.partitionBy()))


_PAIRS = f"WITH {PARTS}, {token_sql('parts', 'doc_id')}, pairs AS (SELECT ext, tokens AS estimate, CAST(len(text) // 4 AS BIGINT) AS truth FROM parts JOIN tok USING (doc_id))"


def _pairs(spark, sf_dir):
    files = corpus.with_parts(C.with_tokens(corpus.documents(spark, sf_dir)))
    return files.select("ext", F.col("tokens").alias("estimate"), F.expr("CAST(length(text) div 4 AS BIGINT)").alias("truth"), "path")


@query(f"{_PAIRS} SELECT round(sum(estimate * truth::DOUBLE) / sum(estimate::DOUBLE * estimate), 9) AS factor, count(*) AS n FROM pairs")
def calibration_factor(spark, sf_dir):
    return accuracy.factor(_pairs(spark, sf_dir)).withColumn("factor", F.round("factor", 9))


@query(f"{_PAIRS} SELECT round(sum(CASE WHEN truth <> 0 THEN abs(estimate - truth) / truth ELSE 0 END) / count(*), 9) AS mape FROM pairs")
def mape(spark, sf_dir):
    return accuracy.error(_pairs(spark, sf_dir)).withColumn("mape", F.round("mape", 9))


@query(
    f"""{_PAIRS}, ok AS (SELECT *, abs(estimate - truth) / truth AS err FROM pairs WHERE truth > 0 AND ext IN (SELECT ext FROM pairs WHERE truth > 0 GROUP BY ext HAVING count(*) >= 5))
SELECT ext, count(*) AS n, round(avg(err), 5) AS mape, round(sum(abs(estimate - truth)) / sum(truth), 5) AS weighted, round(list_sort(list(err))[least(floor(0.9 * count(*)), count(*) - 1)::INT + 1], 5) AS p90,
  round(max(err), 5) AS worst, round(avg((estimate > truth)::INT), 4) AS over, round_even(median(truth), 0)::BIGINT AS median_truth FROM ok GROUP BY GROUPING SETS ((ext), ())"""
)
def accuracy_grouping_sets(spark, sf_dir):
    return accuracy.by_group(_pairs(spark, sf_dir))


@query(f"WITH {PARTS}, o AS (SELECT path, ext, row_number() OVER (PARTITION BY ext ORDER BY md5('0' || path), path) AS k FROM parts) SELECT path, ext FROM o WHERE k <= 20")
def stratified_sample(spark, sf_dir):
    return accuracy.sampled(corpus.with_parts(_meta(spark, sf_dir)), 20).select("path", "ext")


# texts ------------------------------------------------------------------------------------------------------------------

_STRIP = f"regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_SIG = f"""sig AS (SELECT doc_id, path, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_STRIP}), lambda x: len(x) >= 12 AND regexp_matches(x, '[A-Za-z0-9]')) AS ls FROM files),
su AS (SELECT doc_id, path, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM sig), sd AS (SELECT doc_id, path, line, min(k) AS k FROM su GROUP BY ALL),
sn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM sd), slines AS (SELECT doc_id, path, line FROM sn WHERE rn <= 400)"""


@query(f"WITH {FILES}, {_SIG} SELECT path, count(*) AS n, md5(string_agg(line, '|' ORDER BY line)) AS digest FROM slines GROUP BY path")
def signature_lines(spark, sf_dir):
    rows = C.bound(corpus.documents(spark, sf_dir).select("path", "text"), sig=C.signature(F.col("text"))).where("size(sig) > 0")
    return rows.select("path", F.size("sig").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("sig"), "|")).alias("digest"))


_JACCARD = f"""WITH {FILES}, {_SIG}, cnt AS (SELECT doc_id, path, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM slines GROUP BY 1, 2 HAVING count(*) >= 2),
member AS (SELECT doc_id, path, n, min(path) OVER (PARTITION BY digest) AS rep FROM cnt),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM slines a JOIN slines b ON a.line = b.line AND a.path < b.path GROUP BY 1, 2),
pairs AS (SELECT f.path AS a, g.path AS b, f.doc_id AS da, g.doc_id AS db, c / (f.n + g.n - c) AS similarity, f.path = f.rep AND g.path = g.rep AS heads FROM i JOIN member f ON f.doc_id = x JOIN member g ON g.doc_id = y WHERE c / (f.n + g.n - c) >= 0.5)"""


@query(f"{_JACCARD} SELECT a, b, round(similarity, 9) AS similarity FROM pairs WHERE heads UNION ALL SELECT rep, path, 1.0::DOUBLE FROM member WHERE path <> rep")
def jaccard_pairs(spark, sf_dir):
    """Similar pairs of the first files of all classes, and each class's first file with every other member."""
    pairs, members = duplicates.similar_pairs(corpus.documents(spark, sf_dir), 0.5, 2)
    copies = members.where("path <> rep").select(F.col("rep").alias("a"), F.col("path").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.withColumn("similarity", F.round("similarity", 9)).unionByName(copies)


@query(f"{_JACCARD} SELECT path, rep FROM member")
def duplicate_classes(spark, sf_dir):
    return duplicates.classes(corpus.documents(spark, sf_dir), 2)[0]


@query(
    f"""{_JACCARD}, sides AS (SELECT a AS path, b AS of_path, da AS mine, db AS theirs, similarity FROM pairs UNION ALL SELECT b, a, db, da, similarity FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, theirs) AS k FROM sides WHERE theirs < mine) SELECT path, of_path, round(similarity, 9) AS similarity FROM r WHERE k = 1"""
)
def duplicate_of(spark, sf_dir):
    files = corpus.documents(spark, sf_dir)
    out = duplicates.best_match(files.select("path", F.col("doc_id").alias("ord")), *duplicates.similar_pairs(files, 0.5, 2))
    return out.withColumn("similarity", F.round("similarity", 9))


_LINES = f"""ls AS (SELECT path, list_transform(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '[{_WS}]+$', '')) AS l FROM files),
good AS (SELECT path, l, list_transform(l, lambda x: (len({_STRIP}) >= 5 AND regexp_matches(x, '[\\p{{L}}\\p{{Nl}}\\p{{No}}\\p{{Nd}}_]'))::INT) AS g FROM ls),
win AS (SELECT path, l, g, unnest(range(0, len(l) - 1)) AS start FROM good WHERE len(l) >= 2),
w AS (SELECT path, start, array_to_string(l[start + 1:start + 2], chr(10)) AS window FROM win WHERE list_sum(g[start + 1:start + 2]) >= 1)"""


@query(f"WITH {FILES}, {_LINES} SELECT md5(\"window\") AS digest, count(DISTINCT path) AS n_files, count(*) AS n_spots FROM w GROUP BY \"window\" HAVING count(DISTINCT path) >= 2".replace("AS window", 'AS "window"'))
def window_groups(spark, sf_dir):
    return blocks.shared_windows(corpus.documents(spark, sf_dir), 2).select(F.md5("window").alias("digest"), "n_files", "n_spots")


@query(
    f"""WITH {FILES}, {_LINES}, many AS (SELECT w.path, w.start, ls.l, first_value(w.start) OVER g AS s1, first_value(ls.l) OVER g AS l1, w."window" AS x FROM w JOIN ls USING (path)
  WHERE w."window" IN (SELECT "window" FROM w GROUP BY 1 HAVING count(DISTINCT path) >= 2) WINDOW g AS (PARTITION BY w."window" ORDER BY w.path, w.start)),
met AS (SELECT *, least(200, len(l) - start, len(l1) - s1) AS m FROM many),
far AS (SELECT *, coalesce(list_min([i FOR i IN range(m) IF l[start + 1 + i] <> l1[s1 + 1 + i]]), m) AS reach FROM met)
SELECT path, start::INT AS start, (min(reach) OVER (PARTITION BY x))::INT AS length FROM far""".replace("AS window", 'AS "window"')
)
def shared_block_runs(spark, sf_dir):
    return blocks.runs(corpus.documents(spark, sf_dir), 2).select("path", "start", "length")


@query(f"WITH {FILES} SELECT path, CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END::INT AS lines FROM files")
def line_counts(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("path", C.line_count(F.col("text")).alias("lines"))


_ODD = "SELECT page_id, replace(html, '<', '```<') || repeat('`', (page_id % 7)::INT) || ']]>' || chr(1) AS t FROM pages"


def _odd(spark, sf_dir):
    rows = corpus.read(spark, sf_dir, "pages")
    text = F.concat(F.replace("html", F.lit("<"), F.lit("```<")), F.expr("repeat('`', CAST(page_id % 7 AS INT))"), F.lit("]]>"), F.lit("\x01"))
    return rows.select("page_id", "url", text.alias("t"))


@query(f"WITH o AS ({_ODD}) SELECT page_id, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`{{3,}}'), lambda x: len(x))), 0) + 1)::INT AS ticks FROM o")
def fence_ticks(spark, sf_dir):
    return _odd(spark, sf_dir).select("page_id", C.fence_ticks(F.col("t")).alias("ticks"))


@query(f"WITH o AS ({_ODD}) SELECT page_id, md5('<![CDATA[' || replace(regexp_replace(t, '[^\\t\\n\\r\\x20-\\x{{d7ff}}\\x{{e000}}-\\x{{fffd}}\\x{{10000}}-\\x{{10ffff}}]', '', 'g'), ']]>', ']]]]><![CDATA[>') || ']]>') AS digest FROM o")
def xml_cdata(spark, sf_dir):
    return _odd(spark, sf_dir).select("page_id", F.md5(C.cdata(F.col("t"))).alias("digest"))


@query(
    """SELECT page_id, replace(replace(replace(url || '\\`' || chr(10), '\\', '\\\\'), chr(10), '\\n'), '`', '''') AS label,
  '"' || replace(replace(replace(url || '&<', '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '"' AS attribute FROM pages"""
)
def label_attribute(spark, sf_dir):
    rows = corpus.read(spark, sf_dir, "pages")
    return rows.select("page_id", C.label(F.concat("url", F.lit("\\`\n"))).alias("label"), C.attribute(F.concat("url", F.lit("&<"))).alias("attribute"))


@query(f"WITH {PARTS}, lang(ext, language) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in selection.LANGUAGES.items())}) SELECT path, coalesce(language, '') AS language FROM parts LEFT JOIN lang USING (ext)")
def language_lookup(spark, sf_dir):
    return _meta(spark, sf_dir).select("path", selection.language(F.col("path")).alias("language"))


@query(f"WITH {FILES} SELECT path, '  ' || printf('%9s', format('{{:,}}', greatest(1, ceil(size / 3.4))::BIGINT)) || '  ' || printf('%10s', format('{{:,}}', size)) || '  ' || path AS line FROM files")
def manifest_rows(spark, sf_dir):
    return _meta(spark, sf_dir).select("path", C.manifest_row(C.size_tokens(F.col("size")), F.col("size"), F.col("path")).alias("line"))


# graph ------------------------------------------------------------------------------------------------------------------

_LINKS = """e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
capped AS (SELECT a AS src, b AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS k FROM e) WHERE k <= 8)"""


def _links(spark, sf_dir):
    rows = corpus.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return graph.capped(both.select(F.col("a").alias("path"), F.lit("").alias("spec"), F.col("b").alias("dst"))).select(F.col("path").alias("src"), "dst")


@query(f"WITH {_LINKS} SELECT src, dst FROM capped")
def fanout_cap(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"WITH RECURSIVE {_LINKS}, r(node, hops) AS (SELECT 'p1', 0 UNION SELECT dst, hops + 1 FROM r JOIN capped ON src = node WHERE hops < 40) SELECT node AS path, min(hops)::INT AS hops FROM r GROUP BY node")
def hop_distance(spark, sf_dir):
    return graph.hop_distance(_links(spark, sf_dir), spark.createDataFrame([("p1",)], "path string"))


@query(f"WITH {FILES} SELECT path, array_to_string(string_split(path, '/')[i:], '/') AS key FROM files, range(1, 12) t(i) WHERE i <= greatest(1, len(string_split(path, '/')) - 1)")
def suffix_index(spark, sf_dir):
    return graph.suffix_index(_meta(spark, sf_dir)).select(F.col("dst").alias("path"), "key")


@query(f"WITH {FILES} SELECT path, unnest(['./x' || doc_id % 5, 'lib/y', 'z' || doc_id % 3, 'dyn', 'side', '../m']) AS spec FROM files WHERE (path LIKE '%.ts' OR path LIKE '%.js') AND text IS NOT NULL")
def import_specs_js(spark, sf_dir):
    """Imports of every form before each whole text, and the same forms in comments and strings, which import nothing."""
    before = [
        F.expr("concat('import a from \\'./x', doc_id % 5, '\\'')"), F.lit('export * from "lib/y"'), F.expr("concat('const z = require(\\'z', doc_id % 3, '\\')')"), F.lit("import('dyn').then(f)"),
        F.lit("import 'side'; import type {\n  B as b, /* of 'no' */\n  c,\n} from \"../m\""), F.lit("// import d from 'no1'"), F.lit("/* require('no2')\nimport e from 'no3' */"), F.lit("const s = \"import('no4')\" + 'it\\'s from \"no5\"' + `\nimport 'no6'\n`"),
    ]
    docs = corpus.documents(spark, sf_dir).where("(path like '%.ts' or path like '%.js') and text is not null")
    return docs.select("path", F.explode(graph.js_imports(F.concat_ws("\n", *before, "text"))).alias("spec"))


@query(f"WITH {PARTS} SELECT path FROM parts WHERE ext NOT IN {_in(V.DOC_EXTS + V.CONFIG_EXTS)} AND lower(regexp_replace(name, '(.)\\.[^.]*$', '\\1')) IN {_in(V.ENTRY_STEMS)}")
def entry_points(spark, sf_dir):
    return graph.entry_points(_meta(spark, sf_dir))


# changes ----------------------------------------------------------------------------------------------------------------

#: Microseconds of a time without zone, whatever the session's zone is.
_MICROS_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"

_SNAP = """ev AS (SELECT user_id, event_id, epoch_us(ts) AS t, round(value * 100)::BIGINT AS v FROM events), mid AS (SELECT (min(t) + max(t)) // 2 AS m FROM ev),
s2 AS (SELECT user_id, max(struct_pack(t := t, v := v)) AS x FROM ev GROUP BY 1), s1 AS (SELECT user_id, max(struct_pack(t := t, v := v)) AS x FROM ev, mid WHERE t < m GROUP BY 1)"""


def _events(spark, sf_dir):
    ev = corpus.read(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("path"), F.expr(_MICROS_SQL).alias("mtime_ns"), F.round(F.col("value") * 100).cast("long").alias("size"), "event_id")


@query(
    f"""WITH {_SNAP}, a AS (SELECT * FROM s1 WHERE x.v >= 2000), b AS (SELECT * FROM s2 WHERE x.v >= 2000)
SELECT user_id::VARCHAR AS path, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM a FULL JOIN b USING (user_id) WHERE a.x IS DISTINCT FROM b.x"""
)
def snapshot_diff(spark, sf_dir):
    """A path is there while its last event has a value of 20 at least."""
    ev = _events(spark, sf_dir)
    middle = ev.agg(F.expr("(min(mtime_ns) + max(mtime_ns)) div 2").alias("m")).first()["m"]
    return changes.diff(*(s.where("size >= 2000") for s in changes.snapshots(ev, middle)))


@query(
    """WITH ev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600 THEN 0 ELSE 1 END AS f FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id AS key, burst::BIGINT AS burst, min(t) AS "begin", max(t) AS "end", count(*) AS n FROM b GROUP BY 1, 2"""
)
def debounce_sessions(spark, sf_dir):
    ev = corpus.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.expr(_MICROS_SQL) / 1e6).alias("t"))
    return changes.bursts(ev, 3600)


@query(
    """WITH RECURSIVE ev AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
r AS (SELECT key, k, t AS first, least(t + 3600, t + 7200) AS due, 1 AS n FROM ev WHERE k = 1
  UNION ALL SELECT r.key, ev.k, CASE WHEN ev.t > r.due THEN ev.t ELSE r.first END, least(ev.t + 3600, CASE WHEN ev.t > r.due THEN ev.t ELSE r.first END + 7200), CASE WHEN ev.t > r.due THEN 1 ELSE r.n + 1 END FROM r JOIN ev ON ev.key = r.key AND ev.k = r.k + 1),
o AS (SELECT *, lead(n) OVER (PARTITION BY key ORDER BY k) AS following FROM r) SELECT key, due AS at, n::BIGINT AS n FROM o WHERE coalesce(following, 1) = 1"""
)
def rebuild_times(spark, sf_dir):
    ev = corpus.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.expr(_MICROS_SQL) / 1e6).alias("t"))
    return changes.rebuilds(ev, 3600.0, 7200.0)


# selection --------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {SCORED}, {token_sql('files', 'doc_id')},
o AS (SELECT lang, path, tokens, row_number() OVER (PARTITION BY lang ORDER BY score DESC, path) AS k FROM scored JOIN tok USING (doc_id)),
r AS (SELECT lang, path, k, tokens <= 20000 AS chosen, CASE WHEN tokens <= 20000 THEN tokens ELSE 0 END AS used FROM o WHERE k = 1
  UNION ALL SELECT o.lang, o.path, o.k, r.used + o.tokens <= 20000, r.used + CASE WHEN r.used + o.tokens <= 20000 THEN o.tokens ELSE 0 END FROM r JOIN o ON o.lang = r.lang AND o.k = r.k + 1)
SELECT lang AS bundle, path FROM r WHERE chosen"""
)
def budget_prefix(spark, sf_dir):
    """Greedy by rank under a token budget alone, one bundle for each language."""
    files = ranking.scored(C.with_tokens(corpus.documents(spark, sf_dir)).select("path", "size", "tokens", F.col("lang").alias("bundle")))
    return selection.by_budget(files, 20_000)


@query(None)
def pack_by_lang(spark, sf_dir):
    """The whole greedy selection, caps and near-duplicates included, one bundle for each language."""
    files = ranking.scored(corpus.with_parts(C.with_tokens(corpus.documents(spark, sf_dir))).withColumn("bundle", F.col("lang")))
    return selection.select(files, selection.Budget(32_000)).select("bundle", "path", "ord", "tokens", "verdict", "truncated")


@query(
    f"""WITH RECURSIVE {SCORED}, {token_sql('files', 'doc_id')}, {_SIG}, sz AS (SELECT doc_id, count(*) AS n FROM slines GROUP BY 1),
o AS (SELECT lang, path, ext, dirname, tokens, doc_id, row_number() OVER (PARTITION BY lang ORDER BY score DESC, path) AS k FROM scored JOIN tok USING (doc_id)),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM slines x JOIN slines y USING (line) JOIN o p ON p.doc_id = x.doc_id JOIN o q ON q.doc_id = y.doc_id AND q.lang = p.lang AND q.k < p.k GROUP BY 1, 2),
near AS (SELECT a, list(b) AS bs FROM met JOIN sz u ON u.doc_id = a JOIN sz v ON v.doc_id = b WHERE met.n::DOUBLE / (u.n + v.n - met.n) >= 0.85 GROUP BY a),
oo AS (SELECT o.*, coalesce(bs, []) AS bs FROM o LEFT JOIN near ON a = doc_id WHERE k <= 3000),
r AS (SELECT lang, 0::BIGINT AS k, ''::VARCHAR AS path, 0::BIGINT AS tokens, ''::VARCHAR AS verdict, []::STRUCT(e VARCHAR, d VARCHAR, t BIGINT, i BIGINT)[] AS got FROM o GROUP BY lang
  UNION ALL SELECT lang, k, path, tokens, verdict, CASE WHEN verdict = 'selected' THEN list_append(got, struct_pack(e := ext, d := dirname, t := tokens, i := doc_id::BIGINT)) ELSE got END FROM (
    SELECT o.lang, o.k, o.path, o.tokens, o.ext, o.dirname, o.doc_id, r.got, CASE WHEN o.tokens > 14400 THEN 'larger than a file may be'
      WHEN coalesce(list_sum([g.t FOR g IN r.got]), 0) + o.tokens > 103600 THEN 'no budget left'
      WHEN len([g.t FOR g IN r.got IF g.d = o.dirname]) >= 8 THEN 'file limit of ' || coalesce(nullif(o.dirname, ''), '.')
      WHEN len(r.got) > 0 AND coalesce(list_sum([g.t FOR g IN r.got IF g.e = o.ext]), 0) + o.tokens > 66000 THEN 'share of ' || o.ext
      WHEN len(r.got) > 0 AND coalesce(list_sum([g.t FOR g IN r.got IF g.d = o.dirname]), 0) + o.tokens > 48000 THEN 'share of ' || coalesce(nullif(o.dirname, ''), '.')
      WHEN list_has_any([g.i FOR g IN r.got], o.bs) THEN 'duplicate' ELSE 'selected' END AS verdict
    FROM r JOIN oo o ON o.lang = r.lang AND o.k = r.k + 1))
SELECT lang AS bundle, path, k::INT AS ord, tokens, verdict FROM r WHERE k > 0"""
)
def select_by_lang(spark, sf_dir):
    """Greedy selection under all caps, whole files only, near-duplicates of any size left out."""
    files = ranking.scored(corpus.with_parts(C.with_tokens(corpus.documents(spark, sf_dir))).withColumn("bundle", F.col("lang")))
    return selection.select(files, selection.Budget(120_000, truncate=False, dedupe_min_lines=1)).select("bundle", "path", "ord", "tokens", "verdict")


FLAGSHIP = count_report
