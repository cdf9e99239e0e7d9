"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import DATA, plain

from textquarry.plans import bundle_queries, queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = [r.asDict() for r in df.collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    columns, want = oracle(queries.ORACLES[name])
    assert sorted(df.columns) == columns
    assert plain(rows, columns) == plain(want, columns)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_partitioning_does_not_matter(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {n: sorted(map(str, queries.QUERIES[n](spark, f"{DATA}/sf0.001").collect())) for n in ("duplicate_of", "pack_by_lang", "window_groups", "fanout_cap")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {n: sorted(map(str, queries.QUERIES[n](spark, f"{DATA}/sf0.001").collect())) for n in got}


def test_jaccard_pairs_lose_no_link(spark, oracle):
    """Pairs of classes and their members give every pair of files that is similar, copies included."""
    rows = queries.QUERIES["jaccard_pairs"](spark, f"{DATA}/sf0.01").collect()
    classes = {r["path"]: r["rep"] for r in queries.QUERIES["duplicate_classes"](spark, f"{DATA}/sf0.01").collect()}
    assert {(classes[p], p) for p in classes if classes[p] != p} <= {(r["a"], r["b"]) for r in rows}
    of = {}
    for r in rows:
        if classes[r["b"]] == r["a"]:
            of.setdefault(r["a"], {r["a"]}).add(r["b"])
    met = {tuple(sorted((x, y))) for r in rows for x in of.get(r["a"], {r["a"]}) for y in of.get(r["b"], {r["b"]}) if x != y}
    met |= {tuple(sorted((x, y))) for group in of.values() for x in group for y in group if x != y}
    _, want = oracle(f"{queries._JACCARD} SELECT a, b FROM pairs", "sf0.01")
    assert met == {(r["a"], r["b"]) for r in want}


@pytest.mark.parametrize(
    "rows",
    [
        [(0, ""), (1, "\n"), (2, None), (3, "a line\r\n\r\nanother\n"), (4, "")],
        [(0, "one line\n}\nanother\nlast line"), (0, "a line\n\nlonger"), (1, "a line"), (None, "no path"), (None, "nor here\nnor there")],
        [(0, "!!!!\u0870\n!!!!\u0ad0\n!!!!\U000323af\n!!!!\U000323b0"), (1, "!!!!\U0001d2c0\n!!!!\U00016ac9\n!!!!!")],
    ],
    ids=["empty texts", "a path twice", "letters of Unicode 15"],
)
def test_substantive_prefix_of_odd_texts(spark, tmp_path, rows):
    import duckdb

    rows = [(k, text, "en", "src0", len(text or "")) for k, text in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT path, line, before_next FROM ({queries.ORACLES['substantive_prefix']})").fetchall()
    got = queries.QUERIES["substantive_prefix"](spark, str(tmp_path)).select("path", "line", "before_next").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and want


def test_entry():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
