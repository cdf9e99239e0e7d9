import json
import os
import random
import re
import subprocess
import time
import xml.etree.ElementTree as ET
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry import cli, work
from textquarry.functions import columns as C
from textquarry.functions import tokens as T
from textquarry.operators import accuracy, blocks, changes, duplicates, factoring, filters, graph, ordered, outline, ranking, selection
from textquarry.operators.blocks import Claims
from textquarry.operators.selection import Budget
from textquarry.plans import config, pack
from textquarry.sources import git, tree
from textquarry.streaming import watch


@pytest.fixture
def project(tmp_path):
    files = {
        "README.md": "# Title\n\nText about it.\n", "CHANGELOG.md": "\n".join(f"- change {k}" for k in range(60)), ".gitignore": "build/\n*.log\n!keep.log\n", "debug.log": "x", "keep.log": "kept",
        "build/out.js": "x", "src/app/main.py": "import os\nfrom src.app import types\n\n\ndef main():\n    return 1\n", "src/app/index.ts": "import { a } from './types.js'\nexport const x = 1\n",
        "src/app/types.py": "class A:\n    pass\n", "src/app/types.ts": "export type A = 1\n", "src/app/big.py": "".join(f"def f{k}():\n    return {k}\n" for k in range(400)),
        "locales/en.py": "".join(f"LABEL_NUMBER_{k} = 'a long enough line {k}'\n" for k in range(40)), "locales/fr.py": "".join(f"LABEL_NUMBER_{k} = 'a long enough line {k}'\n" for k in range(40)),
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "logo.png").write_bytes(b"\x89PNG\x00")
    (tmp_path / "pic").write_bytes(b"a\x00b")
    deep = tmp_path / "a" / "deep"
    deep.mkdir(parents=True)
    (deep / ".gitignore").write_text("secret.md\n")
    (deep / "secret.md").write_text("s")
    (deep / "visible.md").write_text("v")
    return tmp_path


def test_walk(project):
    scan = tree.walk(str(project))
    paths = [f[0] for f in scan.files]
    assert paths == sorted(paths) and {"keep.log", "a/deep/visible.md", "src/app/main.py"} <= set(paths)
    assert not {"debug.log", "build/out.js", "a/deep/secret.md", "logo.png", "pic"} & set(paths)
    assert scan.binary == 1 and scan.total_bytes > 0
    assert [f[0] for f in tree.walk(str(project / "debug.log")).files] == ["debug.log"]
    assert tree.walk(str(project), max_size=10).too_large > 0
    assert {f[0] for f in tree.walk(str(project), include=["*.ts"]).files} == {"src/app/index.ts", "src/app/types.ts"}
    with pytest.raises(ValueError):
        tree.walk(str(project / "nothing"))


def test_links_and_counts_of_a_walk(project):
    before = tree.walk(str(project))
    os.symlink(project / "src", project / "linked")
    os.symlink(project / "src", project / "build" / "inner")
    os.symlink(project / "src", project / "node_modules")
    os.symlink("keep.log", project / "also.md")
    scan = tree.walk(str(project))
    assert (scan.symlinks, scan.ignored) == (before.symlinks + 1, before.ignored + 1)
    assert dict((f[0], f[2]) for f in scan.files)["also.md"] == len("keep.log")
    assert scan.directories == before.directories == 1 + len({"a", "a/deep", "src", "src/app", "locales"})


def test_fence_language_of_a_block():
    assert pack._common_language(("a.ts", "b.py", "c.PY")) == "python" and pack._common_language(("b.ts", "a.py")) == "python"
    assert pack._common_language(("Makefile", "x.unknown")) == "" and pack._common_language(()) == ""


def test_scan_counts_of_a_listing(spark, project):
    rules = [("", k, r) for k, r in enumerate(filters.patterns.ignore_rules("build/\n*.log\n!keep.log\n"))]
    listing = [(os.path.relpath(os.path.join(d, f), project), os.path.getsize(os.path.join(d, f)), f in ("pic", "logo.png")) for d, _, fs in os.walk(project) for f in fs]
    listing.append((".git/objects/x", 3, False))
    files = spark.createDataFrame(listing, "path string, size long, is_binary boolean")
    got = filters.scan_counts(files, rules, exclude=["CHANGELOG*"], max_size=3_000).first().asDict()
    kept = [r for r in listing if not r[0].startswith(("build/", ".git/")) and r[0] not in ("debug.log", "CHANGELOG.md")]
    small = [r for r in kept if r[1] <= 3_000]
    assert got == {
        "files": sum(not r[2] for r in small), "total_bytes": sum(r[1] for r in small if not r[2]), "ignored": 4, "too_large": len(kept) - len(small), "binary": 2, "directories": 6,
    }
    assert filters.scan_counts(files.limit(0), rules).first().asDict() == {"files": 0, "total_bytes": 0, "ignored": 0, "too_large": 0, "binary": 0, "directories": 1}


def test_bundles_in_tasks_are_those_of_the_driver(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(f"repo{k % 3}", f"src/{words[k % 8]}/m{k}.py", "".join(f"value_{j}_{k if k % 7 else 0} = {words[(j + k) % 8]!r}\n" for j in range(5 + k))) for k in range(90)]
    rows += [("repo0", "gone.bin", None), ("lone", "a.md", "")]
    files = tree.corpus.with_parts(spark.createDataFrame(rows, "bundle string, path string, text string").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(9)).cast("long")))
    for mode, budget in (("balanced", Budget(4_000)), ("coverage", Budget(3_000, max_scan=12, manifest="paths"))):
        got = {r["bundle"]: r for r in pack.bundled(files, budget, mode).collect()}
        assert set(got) == {"repo0", "repo1", "repo2", "lone"}
        assert "more files" not in got["repo0"]["value"].split("## Files")[0] or budget.max_scan == 12
        for name in ("repo0", "lone"):
            r = got[name]
            want = pack.pack(files.where(F.col("bundle") == name).drop("bundle"), budget, mode, name)
            assert r["value"] == pack.render(want) and (r["n_files"], r["discovered"], r["accounted"]) == (len(want.files), want.discovered, want.accounted)
    pack.write_bundles(pack.bundled(files, Budget(4_000), form="json"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("bundle=*")) == ["bundle=lone", "bundle=repo0", "bundle=repo1", "bundle=repo2"]
    (part,) = (tmp_path / "out" / "bundle=repo1").glob("*.txt")
    assert json.loads(part.read_text())["root"] == "repo1"
    assert pack.bundled(files.limit(0), Budget(4_000)).count() == 0
    cut, tokens, _ = pack.trimmed_index([{"path": f"a{k}", "tokens": 1, "size": 1} for k in range(50)], 60, "paths", total=1_000)
    assert tokens <= 60 and f"and {1_000 - cut.count('  a'):,} more files" in cut


def test_texts_and_decoding(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    (tmp_path / "ok.txt").write_text("h\u00e9")
    got = {r["path"]: r["text"] for r in tree.texts(tree.relation(spark, tree.walk(str(tmp_path)))).collect()}
    assert got == {"bad.txt": "a\ufffdb", "ok.txt": "h\u00e9"}
    assert {r["path"] for r in tree.stored_files(spark, f"file://{tmp_path}").collect()} == set(got)


def test_rank_and_explain(spark):
    rows = [("README.md", 100), ("src/main.py", 100), ("docs/x/y/z/w.md", 100), ("a.min.js", 100), ("vendor/x.py", 400_000), (".env", 10)]
    got = ranking.scored(spark.createDataFrame(rows, "path string, size long"))
    scores = {r["path"]: r for r in got.collect()}
    assert scores["README.md"]["score"] == 7.0 + 1.0 + 1.2 + 0.4
    assert scores["src/main.py"]["score"] == round(2.4 + 1.9 + 1.5 + 0.6 + 0.4, 4)
    assert scores["docs/x/y/z/w.md"]["score"] == round(1.0 - 1.5 + 0.4 - 0.9, 4)
    assert all(abs(sum(s["weight"] for s in r["signals"]) - r["score"]) < 1e-9 for r in scores.values())
    assert "readme +7.0" in ranking.explained(got).where("path = 'README.md'").first()["line"]


def test_tokens_agree(spark):
    texts = ["", "hello world", "it's 12345 __init__ ;;; \n\n\t x", "\u00dcn\u00ef \u4e2d\u6587 \U0001f600", "a" * 50, "def f(a):\n    return a\n" * 30]
    rows = C.with_tokens(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r["tokens"] for r in rows] == [T.estimate(t) for t in texts]
    assert T.cost(Counter({("letters", 5): 2})) == pytest.approx(2 / 3.615) and T.cost(Counter({("letters", 4): 1})) == 1.0


def test_fit_does_not_get_worse():
    samples = [(T.histogram(t), len(t) // 4) for t in ("some words to count " * 20, "x = 1; y = [2, 3]\n" * 20, "\u00e9t\u00e9 " * 40)]
    _, error = T.fit(samples, 3)
    start = sum(abs(T.cost(h) - t) / t for h, t in samples) / 3
    assert error <= start


def test_hops_end_with_the_graph(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)] + [("n6", "n0")], "src string, dst string")
    starts = spark.createDataFrame([("n0",)], "path string")
    with pytest.raises(ValueError):
        graph.hop_distance(edges, starts, most=3)
    monkeypatch.setattr(graph, "FOLD", 2)
    for most in (None, 7):
        assert {(r["path"], r["hops"]) for r in graph.hop_distance(edges, starts, most).collect()} == {(f"n{k}", k) for k in range(7)}


def test_graph(spark):
    files = [
        ("main.py", "import pkg.a\nfrom pkg import b\n"), ("pkg/__init__.py", ""), ("pkg/a.py", "from . import c\n"), ("pkg/b.py", "from .sub.d import x"), ("pkg/c.py", ""), ("pkg/sub/__init__.py", ""), ("pkg/sub/d.py", "def broken(:"),
        ("orphan.py", ""), ("web/index.ts", "import {x} from './util.js'\nexport * from \"components/Button\"\n"), ("web/util.ts", ""), ("lib/components/Button.tsx", ""), ("README.md", "import x"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    edges, starts, hops = graph.analysed(df)
    got = {(r["src"], r["dst"]) for r in edges.collect()}
    assert {("main.py", "pkg/a.py"), ("main.py", "pkg/b.py"), ("main.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/c.py"), ("pkg/b.py", "pkg/sub/d.py"), ("web/index.ts", "web/util.ts"), ("web/index.ts", "lib/components/Button.tsx")} <= got
    assert not any("orphan.py" in e or "README.md" in e for e in got)
    distance = {r["path"]: r["hops"] for r in hops.collect()}
    assert distance["main.py"] == 0 and distance["pkg/a.py"] == 1 and distance["web/util.ts"] == 1 and "orphan.py" not in distance
    assert {r["path"] for r in starts.collect()} == {"main.py", "pkg/__init__.py", "pkg/sub/__init__.py", "web/index.ts"}


def test_candidates():
    assert graph.js_candidates("./types.js", "src/a.ts") == ["src/types.js", "src/types.ts", "src/types.tsx", "src/types.d.ts"]
    assert graph.js_candidates("../../x", "a/b.ts") == [] and "src/x/index.ts" in graph.js_candidates("./x", "src/a.ts")
    assert graph.python_candidates("...x", "a/b.py") == [] and graph.python_candidates("a..b", "x.py") == []
    assert graph.python_candidates("..c", "a/b/m.py") == ["a/c.py", "a/c.pyi", "a/c/__init__.py", "a/__init__.py"]
    assert graph.python_imports("from . import a\nimport b.c as d\nfrom e.f import *") == {".", ".a", "b.c", "e.f"}


def _docs(n, tokens=100, ext=".py", folder="d", text="x"):
    return [{"path": f"{folder}/{k}{ext}", "ext": ext, "dirname": folder, "text": text, "tokens": tokens} for k in range(n)]


def test_selection_limits():
    out = selection.choose(_docs(12), Budget(10_000), 9_000)
    assert Counter(d["verdict"] for d in out) == {"selected": 8, "file limit of d": 4}
    out = selection.choose(_docs(3, 1000), Budget(10_000, max_per_dir=99), 1500)
    assert [d["verdict"] for d in out] == ["selected", "no budget left", "no budget left"]
    out = selection.choose(_docs(5, 1000), Budget(10_000, per_dir_frac=0.2), 9_000)
    assert Counter(d["verdict"] for d in out) == {"selected": 2, "share of d": 3}
    text = "\n".join(f"a long distinct line number {k}" for k in range(30))
    out = selection.choose(_docs(2, 100, text=text), Budget(10_000), 9_000)
    assert [d["verdict"] for d in out] == ["selected", "duplicate"] and out[1]["of_path"] == "d/0.py" and out[1]["similarity"] == 1.0
    assert selection.choose(_docs(1, 5000), Budget(10_000, truncate=False), 9_000)[0]["verdict"] == "larger than a file may be"


def test_truncation():
    text = "".join(f"line number {k} of a long file\n" for k in range(1000))
    cut, tokens, lines = selection.truncated(text, 300)
    assert tokens <= 300 and "lines left out" in cut and text.startswith(cut.split("\n...")[0]) and 0 < lines < 1000
    assert selection.truncated("a" * 5000, 10)[0].startswith("a" * 5000)


def test_budget_rules():
    b = Budget(400)
    assert b.header == 100 and b.index_cap == 300 and b.per_file == 200
    for bad in ({"total": 0}, {"total": 5, "manifest": "x"}, {"total": 5, "dedupe_threshold": 0}):
        with pytest.raises(ValueError):
            Budget(**bad)


@pytest.mark.parametrize("total", [400, 2_000, 10_000, 60_000])
@pytest.mark.parametrize("mode", ["balanced", "coverage"])
def test_pack_stays_within_budget(spark, project, total, mode):
    files = tree.relation(spark, tree.walk(str(project)))
    b = pack.pack(files, Budget(total), mode, str(project), read=tree.texts)
    assert b.accounted <= total and len({f["path"] for f in b.files}) == len(b.files) and b.over_budget == 0
    if total >= 10_000:
        assert b.files[0]["path"] == "README.md" and {d["path"] for d in b.duplicates} == {"locales/fr.py"}


def test_scan_cutoff(spark, project):
    files = tree.relation(spark, tree.walk(str(project)))
    b = pack.pack(files, Budget(20_000, max_scan=3), "balanced", "r", read=tree.texts, reach_weight=2.0)
    assert b.scanned == 3 and b.unscanned == b.discovered - 3 and sum(e["estimated"] for e in b.index) == b.unscanned


HOSTILE = [("a`b\n#.md", "```\n````\nx"), ("x]]>.xml", "]]>\x00\x01\ufffe"), ("t.py", ""), ("\u00e9.txt", "\U0001f600\r\n"), ('q"\'.json', "{}")]


def test_sinks_parse_back(spark):
    rows = [(p, len(t.encode()), t, ".x", "") for p, t in HOSTILE]
    b = pack.pack(spark.createDataFrame(rows, "path string, size long, text string, ext string, dirname string"), Budget(20_000), root="r")
    assert len(b.files) == len(HOSTILE)
    root = ET.fromstring(pack.render(b, "xml"))
    assert len(root.find("files")) == len(HOSTILE) and len(root.find("index")) == len(HOSTILE)
    data = json.loads(pack.render(b, "json"))
    assert {f["path"]: f["content"] for f in data["files"]} == dict(HOSTILE)
    text = pack.render(b, "markdown")
    assert "`````" in text and text.count("\n### ") == len(HOSTILE) and pack.render(b, "tree").startswith("root: r")
    with pytest.raises(ValueError):
        pack.render(b, "pdf")


HEADER = "".join(f"# clause {k} of the licence text\n" for k in range(11)) + "\n"


def test_blocks(spark):
    texts = {f"src/m{k}.py": HEADER + f"def only_{k}():\n    return {k}\n" for k in range(8)}
    found = blocks.find_blocks(spark.createDataFrame(list(texts.items()), "path string, text string"))
    assert found[0].lines >= 11 and found[0].occurrences == 8 and len(found[0].files) == 8
    new, used = blocks.factor(texts, found)
    assert len(used) == 1 and all("[shared B1:" in t and f"def only_{k}" in t for k, t in enumerate(new.values()))
    report = blocks.savings(texts, new, used)
    assert report.saved > 0 and len(report.changed) == 8 and "B1" in blocks.shared_section(used)
    for t in new.values():
        compile(t, "x", "exec")
    assert blocks.factor(new, found)[0] == new


def test_blocks_inside_something_stay():
    run = '"k1": 1,\n"k2": 2,\n"k3": 3,\n}'
    texts = {f"m{k}.py": f"# c\nclient_{k} = {{\n# c\n{run}\nx = {k}\n" for k in range(4)}
    new, used = blocks.factor(texts, [blocks.Block(run, 4, tuple(texts), 4, 20)])
    assert new == texts and not used
    windows = {k: t.replace("\n", "\r\n") for k, t in {f"w{k}.py": HEADER + f"x = {k}" for k in range(3)}.items()}
    new, used = blocks.factor(windows, [blocks.Block(HEADER.rstrip("\n"), 11, tuple(windows), 3, 50)])
    assert used and all("\r\n" in t and not t.endswith("\n") for t in new.values())


def test_claims():
    c = blocks.Claims()
    assert c.free([("a", 0), ("a", 2), ("a", 4)], 4) == [("a", 0), ("a", 4)]
    c.take([("a", 0)], 4)
    assert c.free([("a", 3), ("a", 4), ("b", 0)], 2) == [("a", 4), ("b", 0)]


PY = '"""Lead."""\nimport os, sys\nX: int = 3\n@dataclass\nclass A(B):\n    """Doc."""\n    y: int = 1\n    @property\n    def f(self, a, *, b="x=y") -> str:\n        def g(): pass\n        return 1\nasync def h(): ...\nif TYPE_CHECKING:\n    import q\n'
TS = "import x from 'y'\n/** Doc. */\nexport class A extends B {\n  static z = 1;\n  async run(a: string): Promise<void> { if (a) { b(); } }\n}\nexport const f = async (a) => { const no = 1; }\n// const dead = 1\ninterface I {\n  id: string;\n}\nexport type T = 1 | 2;\nenum E {\n  Red,\n}\n"


def test_outline():
    nodes = outline.python_outline(PY)
    a = next(n for n in nodes if n.name == "A")
    assert a.line == 5 and a.doc == "Doc." and [c.name for c in a.children] == ["y", "f"] and a.find("g").kind == "function"
    assert a.find("f").detail == "(self, a, *, b = 'x=y') -> str" and "property" in a.find("f").flags
    assert [n.kind for n in nodes] == ["other", "import", "const", "class", "function", "section"]
    nodes = outline.script_outline(TS)
    assert [(n.kind, n.name, n.line) for n in nodes] == [("import", "import x from 'y'", 1), ("class", "A", 3), ("function", "f", 7), ("interface", "I", 9), ("type", "T", 12), ("enum", "E", 13)]
    assert [c.name for c in nodes[1].children] == ["z", "run"] and nodes[1].doc == "Doc." and [c.name for c in nodes[3].children] == ["id"]
    assert "dead" not in outline.render(nodes) and "no" not in [n.name for n in nodes]


@pytest.mark.parametrize("text", ["", "   ", "# only", "def f(:\n  x", "\x00", "{" * 5000, "class A {" * 300, "export", "'''", "def f(" * 50])
def test_outline_never_fails(text):
    for path in ("a.py", "a.ts", "a.md", ""):
        assert outline.outline(text, path) and isinstance(outline.ratio(text, path), float)


def test_outline_rows_render_alike(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.ts", TS), ("c.md", "x")], "path string, text string")
    got = {r["path"]: r["outline"] for r in outline.rendered(outline.nodes(files)).collect()}
    assert got == {p: outline.render(outline.outline(t, p)) for p, t in (("a.py", PY), ("b.ts", TS), ("c.md", "x"))}
    big = spark.createDataFrame([("a.py", "".join(f"def f{k}(a):\n    b = a\n    return b * 2\n" for k in range(50)))], "path string, text string")
    assert "return" not in pack.outlined()(big).first()["text"]


def test_changes(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, mtime_ns long, size long")
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("w", 1, 1)], "path string, mtime_ns long, size long")
    assert [tuple(r) for r in changes.ordered(changes.diff(a, b)).collect()] == [("w", "added"), ("y", "modified"), ("z", "deleted")]
    ev = spark.createDataFrame([("k", k, float(t)) for k, t in enumerate([0, 1, 2, 3, 4, 5, 20])], "key string, id int, t double")
    assert [(r["begin"], r["n"]) for r in changes.bursts(ev, 2).orderBy("begin").collect()] == [(0.0, 6), (20.0, 1)]
    assert [(r["at"], r["n"]) for r in changes.rebuilds(ev, 2.0, 3.0).orderBy("at").collect()] == [(3.0, 4), (7.0, 2), (22.0, 1)]


def test_watch_loop():
    state, now, built = {"a": (1, 1)}, [0.0], []

    def sleep(s):
        now[0] += s
        if round(now[0], 1) in (1.0, 1.2, 1.4):
            state["a"] = (int(now[0] * 10), 1)

    assert watch.run(lambda: dict(state), built.append, 0.2, 0.4, clock=lambda: now[0], sleep=sleep, rounds=20) == 1
    assert built == [[("a", "modified")]]
    assert watch.interval(0.001) == 0.05 and watch.interval(99) == 60.0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema("path string, mtime_ns long, size long").json(str(src))
    q = watch.stream_changes(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 1)], [("b", 3, -1)]]):
            (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("path", "mtime_ns", "size"), r))) for r in rows))
            q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("moves").collect()) == [("a", "added"), ("a", "modified"), ("b", "added"), ("b", "deleted")]


def test_accuracy(spark):
    pairs = spark.createDataFrame([(10, 20), (5, 10), (3, 0)], "estimate long, truth long")
    assert accuracy.factor(pairs).first()["factor"] == pytest.approx((200 + 50) / (100 + 25 + 9))
    assert accuracy.error(pairs).first()["mape"] == pytest.approx((0.5 + 0.5) / 3)
    assert accuracy.factor(pairs.limit(0)).first()["factor"] == 1.0


def test_ignore_layers(spark):
    from textquarry.functions import patterns as P

    rules = [("", 0, P.ignore_rule("*.md")), ("a", 0, P.ignore_rule("!keep.md")), ("", 1, P.ignore_rule("out/"))]
    files = spark.createDataFrame([("x.md",), ("a/keep.md",), ("keep.md",), ("out/y.py",), ("a/z.py",)], "path string")
    got = {r["path"]: r["is_ignored"] for r in filters.ignored(files, rules).collect()}
    assert got == {"x.md": True, "a/keep.md": False, "keep.md": True, "out/y.py": True, "a/z.py": False}


@pytest.fixture
def repo(tmp_path):
    def sh(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)

    sh("init", "-q", "-b", "main")
    for name in ("keep.py", "gone.py", "old.py"):
        (tmp_path / name).write_text(f"# {name}\n" * 20)
    sh("add", ".")
    sh("commit", "-qm", "one")
    (tmp_path / "keep.py").write_text("changed\n")
    (tmp_path / "gone.py").unlink()
    sh("mv", "old.py", "new.py")
    (tmp_path / "fresh.py").write_text("x = 1\n")
    return tmp_path, sh


def test_git(spark, repo):
    root, sh = repo
    assert git.is_repository(str(root)) and not git.is_repository("/")
    got = {r["path"] for r in git.changes(spark, str(root), include_untracked=True).collect()}
    assert got == {"keep.py", "new.py", "fresh.py"}
    stat = {r["path"]: (r["added"], r["removed"]) for r in git.diffstat(spark, str(root), include_untracked=True).collect()}
    assert stat["keep.py"] == (1, 20) and stat["fresh.py"] == (0, 0) and stat["gone.py"] == (0, 20)
    sh("add", "-A")
    sh("commit", "-qm", "two")
    assert {r["path"] for r in git.changes(spark, str(root), "HEAD~1..HEAD").collect()} == got
    assert {r["path"] for r in git.changes(spark, str(root), "HEAD~1...HEAD").collect()} == got


def test_git_parsers():
    assert list(git.name_status("M\0a\0R100\0b\0c\0D\0d\0")) == [("a", "M", None), ("c", "R", "b"), ("d", "D", None)]
    assert list(git.numstat("1\t2\ta b\0-\t-\tbin\0003\t4\t\0old\0new\0")) == [("a b", 1, 2), ("bin", 0, 0), ("new", 3, 4)]
    assert git.parse_revisions("a...b") == git.Revisions("a", "b", True) and git.parse_revisions("") == git.Revisions() and git.parse_revisions("a..") == git.Revisions("a", "HEAD")
    for bad in ("..", "-x", "a b..c"):
        with pytest.raises(git.GitError):
            git.parse_revisions(bad)
    assert git.relative(["src/a.py", "b.py", "src/a.py"], "/r", "/r/src") == ["a.py"]


def test_settings(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "textquarry.toml").write_text('budget = 5000\nexclude = ["*.log"]\nmax_size = "2k"\nbudgt = 1\n')
    sub = tmp_path / "a"
    sub.mkdir()
    found = config.find(str(sub))
    s = config.load(found)
    assert s.values == {"budget": 5000, "exclude": ["*.log"], "max_size": 2000} and "did you mean 'budget'" in s.hints()[0]
    merged = config.merge({"budget": 1, "exclude": ["x"], "mode": "balanced"}, s, {"exclude": ["y"], "budget": 7})
    assert merged == {"budget": 7, "exclude": ["x", "*.log", "y"], "mode": "balanced", "max_size": 2000}
    for bad in ("budget = 'x'", "budget = 0", "mode = 'z'", "dedupe = 1", "include = [1]", "budget = true"):
        (tmp_path / "textquarry.toml").write_text(bad)
        with pytest.raises(config.SettingsError):
            config.load(found)


def test_command_line(spark, project, capsys):
    assert cli.main([str(project), "-b", "8000", "--no-config", "-f", "json", "-x", "*.ts"], spark) == 0
    data = json.loads(capsys.readouterr().out)
    assert data["accounted"] <= 8000 and data["files"][0]["path"] == "README.md" and not any(f["path"].endswith(".ts") for f in data["files"])
    assert cli.main(["count", str(project), "--json", "-n", "3"], spark) == 0
    data = json.loads(capsys.readouterr().out)
    assert len(data["files"]) == 3 and data["total_tokens"] == sum(f["tokens"] for f in data["files"])
    assert cli.main(["explain", str(project), "-p", "*.md"], spark) == 0 and "readme +7.0" in capsys.readouterr().out
    assert cli.main(["pack", str(project / "none")], spark) == 2 and cli.main(["pack", "-b", "x"], spark) == 2


def test_calibration_file(tmp_path, monkeypatch):
    monkeypatch.setenv("TEXTQUARRY_CALIBRATION", str(tmp_path / "c.json"))
    assert T.load_calibration() == 1.0
    T.save_calibration(0.98, 10, 0.05)
    assert T.load_calibration() == 0.98
    (tmp_path / "c.json").write_text('{"factor": -1}')
    assert T.load_calibration() == 1.0


def test_corpus_object(spark, project):
    from textquarry.api import Corpus

    c = Corpus.tree(spark, str(project))
    assert c.ranked(1).first()["path"] == "README.md" and c.counted(3).count() == 3
    assert {r["path"] for r in c.where(include=["*.ts"]).files.collect()} == {"src/app/index.ts", "src/app/types.ts"}
    pairs, classes = c.near_duplicates()
    assert pairs.count() == 0 and {("locales/en.py", "locales/en.py"), ("locales/fr.py", "locales/en.py")} <= {tuple(r) for r in classes.collect()}
    texts, found = c.factored()
    assert texts.count() == c.texts().where("text is not null").count() and {"id", "text", "lines", "occurrences", "tokens"} == set(found.columns)
    edges, _, _ = c.imports()
    assert ("src/app/main.py", "src/app/types.py") in {tuple(r) for r in edges.collect()}
    seen = []
    assert c.pack(5_000, progress=seen.append).accounted <= 5_000 and not seen
    rows = spark.createDataFrame([("a.py", "x = 1"), ("node_modules/b.js", "y")], "path string, text string")
    t = Corpus.table(rows)
    assert {r["path"] for r in t.without_ignored().files.collect()} == {"a.py"} and t.outlines().count() == 2


def test_exact_tokens(spark, tmp_path):
    import base64

    vocabulary = tmp_path / "v"
    vocabulary.write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256)))
    rows = C.with_exact_tokens(spark.createDataFrame([("hé",), ("",), (None,)], "text string"), str(vocabulary)).collect()
    assert [r["tokens"] for r in rows] == [3, 0, None] and T.TokenCounter("exact", str(vocabulary))("ab") == 2
    with pytest.raises(ValueError):
        T.TokenCounter("exact")
    assert watch.mtime(str(tmp_path / "none")) == -1.0


def test_grid_and_integrity(spark):
    from textquarry.plans import shapes

    rows = shapes.grid(spark, (2_000, 10_000), ("balanced",), ("identical", "long_name", "mixed"))
    table = shapes.packing_table(rows)
    got = {r["shape"]: r for r in table.collect()}
    assert all(r["max_over"] <= 0 for r in got.values()) and set(got) == {"identical", "long_name", "mixed"}
    assert [r["duplicates"] for r in rows.where("shape = 'identical' and budget = 10000").collect()] == [199]
    assert shapes.regressions(table, table).isEmpty()
    assert shapes.integrity_problems(spark) == []


def test_fit_from_files(spark, tmp_path):
    import base64

    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256)))
    files = spark.createDataFrame([(f"f{k}.py", "some words = 12\n" * (k + 1)) for k in range(10)], "path string, text string")
    model, error, held = accuracy.fitted(files, str(tmp_path / "v"))
    start = sum(abs(T.cost(T.histogram("some words = 12\n" * (k + 1))) - 16 * (k + 1)) / (16 * (k + 1)) for k in range(10)) / 10
    assert error < start and held < start and set(model) == set(T.fixed.TOKEN_COSTS)


def test_the_distributed_fit_is_that_of_its_samples(spark):
    rng = random.Random(9)
    texts = {f"f{k:02}": " ".join(rng.choice(["word", "a_long_name", "12345", "x == y;", "été", "\n\n    ", "it's"]) for _ in range(rng.randint(5, 60))) for k in range(12)}
    truth = {p: max(1, round(len(t) / rng.uniform(2.5, 4.5))) for p, t in texts.items()}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    pieces = work.stored(accuracy.piece_counts(files).join(spark.createDataFrame(list(truth.items()), "path string, truth long"), "path"), "test-pieces")
    want, least = T.fit([(T.histogram(texts[p]), truth[p]) for p in sorted(texts)], 1)
    got, error = accuracy.descended(pieces, 1)
    assert error == pytest.approx(least, abs=1e-9) and {c: pytest.approx(v, abs=1e-9) for c, v in want.items()} == got
    assert accuracy.descended(pieces.limit(0), 1)[0] == T.fixed.TOKEN_COSTS


def test_windowed_streams_and_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stamp = lambda minute: f"2024-01-01T00:{minute:02d}:00"
    for k, minutes in enumerate([[0, 1, 2, 20], [21, 59], [1, 58]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"ts": stamp(m), "key": "k", "event_type": "e", "value": 1.0}) for m in minutes))
        os.utime(src / f"{k}.json", (1_700_000_000 + k * 60,) * 2)  # a source takes the oldest file first
    read = lambda: spark.readStream.schema("ts timestamp, key string, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(src))
    queries = {"bursts": watch.stream_bursts(read(), "5 minutes", "10 minutes"), "counts": watch.stream_counts(read(), "10 minutes", late="10 minutes")}
    for name, df in queries.items():
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r["begin"].minute, r["n"]) for r in spark.table("bursts").orderBy("begin").collect()] == [(0, 3), (20, 2)]
    assert [(r["begin"].minute, r["n"]) for r in spark.table("counts").orderBy("begin").collect()] == [(0, 3), (20, 2)]
    seen, failed = [], []

    def rebuild(batch, number):
        seen.append(batch.count())
        if number == 1:
            raise ValueError("once")

    q = watch.each_batch(read(), rebuild, str(tmp_path / "each"), failed.append).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [4, 2, 2] and len(failed) == 1


# orders over a whole corpus


def test_running_totals_need_no_single_partition(spark):
    rows = spark.range(500).selectExpr("(id * 7919) % 500 as k", "id % 11 as v", "id as other").repartition(5)
    out = ordered.running(rows, [F.desc("k")], n=F.lit(1), total=F.col("v"))
    assert "Exchange SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    total = 0
    for n, r in enumerate(sorted(out.collect(), key=lambda r: -r["k"]), 1):
        total += r["v"]
        assert (r["n"], r["total"]) == (n, total)
    assert ordered.running(rows.limit(0), [F.col("k")], n=F.lit(1)).count() == 0


@pytest.mark.parametrize("digit", [ordered.DIGIT, 2, 3])
def test_order_statistics(spark, monkeypatch, digit):
    """Ties, very large and very small values, nulls and NaN, groups of one and a null group."""
    monkeypatch.setattr(ordered, "DIGIT", digit)
    rng = random.Random(2)
    groups = {"a": [rng.choice([0.5, 0.25, 3.0]) for _ in range(60)], "b": [1.0], None: [rng.gauss(0, 1) for _ in range(40)], "c": [-1e300, 1e-300, 0.0, 1e300, -2.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)]
    ranks = [(g, str(r), r) for g, vs in groups.items() for r in {0, len(vs) // 2, len(vs) - 1, len(vs)}]
    values = spark.createDataFrame(rows, "g string, value double")
    out = ordered.order_statistics(values, spark.createDataFrame(ranks, "g string, want string, rank long"), ["g"])
    got = {(r["g"], int(r["want"])): r["value"] for r in out.collect()}
    assert got == {(g, r): sorted(groups[g])[r] for g, _, r in ranks if r < len(groups[g])}


def test_accuracy_collects_no_group(spark):
    pairs = spark.createDataFrame([("a" if k % 3 else "b", float(k), float(k % 7 + 1)) for k in range(60)], "ext string, estimate double, truth double")
    plan = accuracy.by_group(pairs)._jdf.queryExecution().toString()
    assert not re.search("collect_list|percentile|sort_array", plan)


# factoring as relations


def tangled(n=40):
    """Files with shared blocks that overlap, nest, repeat within a file and stand inside brackets."""
    rng = random.Random(5)
    shared = ["".join(f"# clause {b} {k} of the text\n" for k in range(rng.randint(4, 9))) for b in range(5)]
    shared.append("x = [\n" + "".join(f'    "item {k} of the list",\n' for k in range(6)) + "]\n")
    shared.append("".join("# the same line again\n" for _ in range(9)))
    shared.append(shared[0] + shared[1])
    texts = {}
    for k in range(n):
        parts = [rng.choice(shared) for _ in range(rng.randint(1, 4))]
        own = [f"def only_{k}_{j}():\n    return {j}\n" for j in range(len(parts))]
        texts[f"src/m{k:02}.py"] = ("\r\n" if k % 9 == 0 else "\n").join("".join(a + b for a, b in zip(parts, own)).split("\n"))
    return texts


def test_factoring_as_relations_is_that_of_a_bundle(spark):
    texts = tangled()
    files = spark.createDataFrame([*texts.items(), ("empty.py", ""), ("none.py", None)], "path string, text string")
    found = blocks.find_blocks(files.where("text is not null"))
    ours = work.stored(factoring.found_blocks(files.where("text is not null")), "test-found")
    assert sorted((r["text"], r["occurrences"], r["tokens"]) for r in ours.collect()) == sorted((b.text, b.occurrences, b.tokens) for b in found)
    want, used = blocks.factor(texts, found)
    new, table = factoring.factored(files, ours)
    assert {r["path"]: r["text"] for r in new.collect()} == want | {"empty.py": "", "none.py": None}
    ids = blocks.block_ids(used)
    gain = blocks.savings(texts, want, used)
    (row,) = factoring.savings(files, new, table).collect()
    assert (row["before"], row["after"], row["saved"], row["changed"], row["blocks"], row["projected"]) == (gain.before, gain.after, gain.saved, len(gain.changed), gain.blocks, gain.projected)
    (row,) = factoring.savings(files.limit(0), new.limit(0), table.limit(0)).collect()
    assert set(row.asDict().values()) == {0}
    assert used and {r["id"]: (r["text"], r["lines"], r["occurrences"]) for r in table.collect()} == {ids[b.text]: (b.text, b.lines, b.occurrences) for b in used}


def test_blocks_are_located_wherever_they_are(spark):
    rng = random.Random(3)
    texts = {f"f{k}": [rng.choice("abc") for _ in range(rng.randint(0, 60))] for k in range(30)}
    runs = [texts[f"f{k}"][s : s + n] for k, s, n in ((1, 0, 1), (2, 3, 2), (3, 1, 3), (4, 2, 5), (5, 0, 7), (6, 0, 8), (7, 1, 13))] + [["a"] * 3, ["zz"], []]
    files = spark.createDataFrame([(p, "\n".join(x)) for p, x in texts.items()], "path string, text string")
    blocks_ = spark.createDataFrame(list(enumerate(runs)), "block int, lines array<string>")
    got = sorted(tuple(r) for r in factoring.located(files, blocks_).collect())
    assert got == sorted((b, p, k) for b, run in enumerate(runs) if run for p, x in texts.items() for k in range(len(x)) if x[k : k + len(run)] == run)
    assert factoring.located(files, blocks_.limit(0)).count() == 0


def test_located_runs_shuffle_no_text_to_blocks(spark, monkeypatch):
    """Runs of 200 lines that overlap are told apart by digests: what is stored for the search does not grow with run times length."""
    text = [f"line {k} of a long text that two files share" for k in range(400)]
    files = spark.createDataFrame([("a", "\n".join(text)), ("b", "\n".join(["own line"] + text))], "path string, text string")
    found = spark.createDataFrame([(k, text[k : k + 200 - k % 7]) for k in range(200)], "block int, lines array<string>")
    kept, keep = {}, work.stored
    monkeypatch.setattr(work, "stored", lambda df, name: kept.setdefault(name, df.columns) and keep(df, name))
    out = factoring.located(files, found)
    assert sorted(map(tuple, out.collect())) == sorted((k, p, k + o) for k in range(200) for p, o in (("a", 0), ("b", 1)))
    assert "digest" in kept["located-heads"] and "ls" not in kept["located-heads"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("located-blocks") == 0 and "sha2" in out._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_of_a_running_total_may_be_coarser(spark):
    rows = spark.createDataFrame([(k % 3, f"{'x' * 100}{k * 7 % 50:03}") for k in range(50)], "n int, text string")
    got = ordered.running(rows, [F.desc("n"), F.col("text")], [F.desc("n"), F.left("text", F.lit(64))], k=F.lit(1)).collect()
    assert [(r["n"], r["text"]) for r in sorted(got, key=lambda r: r["k"])] == sorted(((r["n"], r["text"]) for r in got), key=lambda r: (-r[0], r[1])) and sorted(r["k"] for r in got) == list(range(1, 51))


def test_replaceable_runs_as_columns(spark):
    rng = random.Random(11)
    some = ["# c", "", "x = [", "]", "  y", "f(", ")", "}}", '"""', "'''", '"""a"""', "\"\"\"'''", "'''b''' '''", "# '''", "z = 1", "{a}", "{", "if a:", "\ttab", "@d", "a;", "[]"]
    texts = {f"f{k}": [rng.choice(some if k % 2 else some[:5] + some[14:]) for _ in range(rng.randint(1, 40))] for k in range(60)}
    spots = [(p, s, n) for p, x in texts.items() for s in range(len(x)) for n in (1, 2, 3, 5) if s + n <= len(x)]
    files = spark.createDataFrame([(p, "\n".join(x) + "\n") for p, x in texts.items()] + [("none", None), ("empty", "")], "path string, text string")
    got = {tuple(r)[:3]: r["replaceable"] for r in factoring.replaceable(files, spark.createDataFrame(spots, "path string, start int, n int")).collect()}
    want = {(p, s, n): blocks.replaceable(texts[p], s, n) for p, s, n in spots}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_replaceable_runs_of_one_very_long_file(spark):
    rng = random.Random(2)
    text = [rng.choice(['"""', "'''", "x = (", ")", "# c", "", "y = 1;"]) for _ in range(50_000)]
    spots = [("one", s, 2) for s in range(0, 49_000, 7)]
    files = spark.createDataFrame([("one", "\n".join(text) + "\n")], "path string, text string")
    got = {r["start"]: r["replaceable"] for r in factoring.replaceable(files, spark.createDataFrame(spots, "path string, start int, n int")).collect()}
    frame = blocks.Frame.of(text)
    want = {s: blocks.replaceable(text, s, 2, frame) for _, s, _ in spots}
    assert got == want and any(want.values())


def test_claims_of_very_many_files(spark):
    """A file is no group of its own: what a file costs is its claims."""
    rows = spark.range(60_000).selectExpr("1 + id % 3 as rank", "concat('f', id div 3) as path", "cast(id % 3 as int) as start", "2 as n")
    out = factoring.claims(rows)
    assert sorted({(r["rank"], r["start"]) for r in out.collect()}) == [(1, 0), (3, 2)] and out.count() == 40_000 and factoring.claims(rows.limit(0)).count() == 0
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_claims_of_one_file_with_very_many_spots(spark):
    rng = random.Random(1)
    few = [(rng.randint(1, 9), f"f{rng.randint(0, 3)}", rng.randint(0, 40)) for _ in range(200)]
    length = {r: rng.randint(1, 6) for r in range(1, 10)}
    order, want, taken = Claims(), [], sorted(set(few))
    for rank in length:
        mine = order.free([(p, s) for r, p, s in taken if r == rank], length[rank])
        order.take(mine, length[rank])
        want += [(rank, p, s) for p, s in mine]
    rows = spark.createDataFrame([(r, p, s, length[r]) for r, p, s in sorted(set(few), key=lambda _: rng.random())], "rank long, path string, start int, n int")
    assert sorted(map(tuple, factoring.claims(rows).collect())) == sorted(want)
    many = spark.range(100_000).selectExpr("id % 7 + 1 as rank", "'one' as path", "cast(id as int) as start", "cast(id % 7 + 2 as int) as n")
    at = time.monotonic()
    got = sorted((r["start"], r["start"] + r["rank"] + 1) for r in factoring.claims(many).collect())
    assert len(got) > 10_000 and all(a[1] <= b[0] for a, b in zip(got, got[1:])) and time.monotonic() - at < 60


def test_run_lengths_take_two_passes(spark, monkeypatch):
    """how far the spots of a window agree takes two rounds of joins, not one for each power of two."""
    common = [f"shared line {k}" for k in range(70)]
    texts = {"a": common, "b": ["other text"] + common[:50] + ["something else"], "c": common[10:] + ["at the end"], "d": [f"mine alone {k}" for k in range(9)]}
    files = spark.createDataFrame([(p, "\n".join(x)) for p, x in texts.items()], "path string, text string")
    names, stored = [], work.stored
    monkeypatch.setattr(work, "stored", lambda df, name: names.append(name) or stored(df, name))
    for width, longest in ((2, 200), (2, 37), (4, 20), (3, 4), (2, 2)):
        names.clear()
        got = {(r["path"], r["start"]): r["length"] for r in blocks.runs(files, width, longest).collect()}
        spots = {}
        for p, x in texts.items():
            for k in range(len(x) - width + 1):
                spots.setdefault(tuple(x[k : k + width]), []).append((p, k))
        want = {}
        for group in (g for g in spots.values() if len({p for p, _ in g}) > 1):
            n = width
            while n < longest and len({texts[p][k + n] if k + n < len(texts[p]) else (p, k) for p, k in group}) == 1:
                n += 1
            want |= dict.fromkeys(group, n)
        assert got == want and names.count("run-lengths") <= 2


def test_runs_of_very_long_files(spark):
    """Windows are made within a file's row and texts read once: no line costs a copy of its file."""
    rng = random.Random(4)
    text = [f"a line of the text number {k} with {rng.random()}" for k in range(30_000)]
    files = spark.createDataFrame([("a", "\n".join(text) + "\n"), ("b", "\n".join(["first line here", *text, "# the last line"])), ("c", "\n".join(text[:7] + ["other line"]))], "path string, text string")
    at = time.monotonic()
    got = {(r["path"], r["start"]): r["length"] for r in blocks.runs(files, 2).collect()}
    want = {(p, k + o): min(200, 30_000 - k) for p, o in (("a", 0), ("b", 1)) for k in range(6, 29_999)}
    want |= {(p, k + o): 7 - k for p, o in (("a", 0), ("b", 1), ("c", 0)) for k in range(6)}
    assert got == want and time.monotonic() - at < 60


def test_blocks_are_found_without_broadcasts(spark):
    """What grows with the corpus reaches no driver: joins of spots, windows and lines are merges."""
    files = spark.createDataFrame([(p, f"{x}\nthe same line\nthe same again\n{x}") for p, x in (("a", "# one"), ("b", "# two"))], "path string, text string")
    seen, keep = [], work.stored

    def stored(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    work.stored = stored
    try:
        spots = factoring.replaceable(files, blocks.runs(files, 2).withColumnRenamed("length", "n"))
        assert sorted((r["path"], r["start"], r["n"], r["replaceable"]) for r in spots.collect()) == [("a", 1, 2, True), ("b", 1, 2, True)]
        seen.append(spots._jdf.queryExecution().executedPlan().toString())
    finally:
        work.stored = keep
    assert any("SortMergeJoin" in x for x in seen) and not any("Broadcast" in x for x in seen)


# similar files


def test_copies_are_a_class_and_never_pairs(spark):
    text = "\n".join(f"a line of the text number {k}" for k in range(20))
    near = text.replace("number 3", "number 99")
    files = spark.range(3_000).select(F.format_string("c%05d", "id").alias("path"), F.when(F.col("id") % 1_000 == 7, near).otherwise(text).alias("text"), F.col("id").alias("ord"))
    pairs, members = duplicates.similar_pairs(files)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [("c00000", "c00007")] and members.count() == 3_000 and members.select("rep").distinct().count() == 2
    best = {r["path"]: (r["of_path"], r["similarity"]) for r in duplicates.best_match(files, pairs, members).collect()}
    assert len(best) == 2_999 and best["c00007"][0] == "c00000" and best["c00007"][1] < 1 and best["c01007"] == ("c00007", 1.0) and best["c02999"] == ("c00000", 1.0)


# imports and cuts


def test_script_imports_by_token(spark):
    cases = {
        "import a from 'x'": ["x"], "import 'x'; import b from \"y\"": ["x", "y"], "export {\n a,\n b as c\n} from './z'": ["./z"], "export * as n from 'n'": ["n"], "import type {T} from 't'": ["t"],
        "const q = require( 'r' )": ["r"], "await import(\n'dyn')": ["dyn"], "import x = require('eq')": ["eq"], "// import a from 'no'": [], "/* require('no') */ f()": [], "s = \"import('no')\"": [],
        "`import a from 'no'`": [], "from 'no'": [], "export const a = from('no')": [], "x.from('no')": [], "export default 'no'": [], "import {a /* 'no' */, b} from 'yes'": ["yes"], "import a from 'x'\nimport a from 'x'": ["x"],
        "'a\\'b' + require('esc')": ["esc"], "": [], "/* open require('no')": [], "import '": [], "import ''": [],
    }
    rows = spark.createDataFrame(list(cases.items()), "text string, want array<string>").withColumn("got", graph.js_imports(F.col("text"))).collect()
    assert {r["text"]: r["got"] for r in rows} == cases
    long = spark.createDataFrame([("'" + "x\\'" * 20_000 + "' + require('a')" + "\n/* " + "y" * 100_000 + "*/ import('b')",)], "text string").select(graph.js_imports(F.col("text")).alias("got"))
    assert long.first()["got"] == ["a", "b"]


def test_popular_stems_meet_no_specifier_more_than_the_fan_out(spark):
    files = spark.createDataFrame([(f"lib/d{k:03}/types.ts", "") for k in range(300)] + [("src/a.ts", "import x from 'types'")], "path string, text string")
    assert [(r["src"], r["dst"]) for r in graph.edges(files).orderBy("dst").collect()] == [("src/a.ts", f"lib/d{k:03}/types.ts") for k in range(8)]


@pytest.mark.parametrize("seed", range(6))
def test_truncation_keeps_as_many_lines_as_fit(seed):
    rng = random.Random(seed)
    text = "".join("".join(rng.choice(["word ", "12 ", "  ", "it's ", "é", "__", "…\t", "x=y;", "\x0c"]) for _ in range(rng.randint(0, 9))) + rng.choice(["\n", "\r\n", "\n\n", "\n    "]) for _ in range(80))
    lines = text.splitlines(keepends=True)
    for limit in (20, 60, 200):
        cut, tokens, kept = selection.truncated(text, limit)
        whole = [T.estimate("".join(lines[:k]) + selection._note(text.count("\n") + 1 - k, text.count("\n") + 1)) for k in range(1, len(lines))]
        assert tokens == T.estimate(cut) == whole[kept - 1] and cut.startswith("".join(lines[:kept]))
        assert (tokens <= limit or kept == 1) and (kept == len(whole) or whole[kept] > limit)  # costs may fall by one, where white space joins


def test_candidate_files_are_verified_on_numbers(spark):
    """Texts of lines are shuffled once, as digests; pairs join rows of bounded width."""
    text = "\n".join(f"a line that is number {k} of many" for k in range(30))
    files = spark.createDataFrame([("a", text), ("b", text + "\none more line at its end"), ("c", "another file\nof two lines only")], "path string, text string")
    assert duplicates.classes(files)[1].schema["sig"].dataType.simpleString() == "array<binary>"
    pairs, _ = duplicates.similar_pairs(files)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 30 / 31)] and "sig" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_the_greedy_kernel_sees_a_bounded_part(spark):
    files = spark.range(60_000).selectExpr("'b' as bundle", "concat('p', id) as path", "cast(id * 7919 % 1009 as double) as score", "case when id % 1000 = 0 then 0 when id % 7 = 0 then 700 else id % 90 + 11 end as tokens")
    rows = sorted(files.collect(), key=lambda r: (-r["score"], r["path"]))
    used, want = 0, set()
    for r in rows:
        if used + r["tokens"] <= 1_000:
            used, want = used + r["tokens"], want | {r["path"]}
    assert {r["path"] for r in selection.by_budget(files, 1_000).collect()} == want
    assert selection.affordable(files, 1_000).count() <= sum(1_000 // t for t in {r["tokens"] for r in rows if r["tokens"]})


# rules as data


def test_literal_keys():
    from textquarry.functions import patterns as P

    cases = {"*.md": "e:.md", "build/": "s:build", "/lib/": "s:lib", "a/**/main.go": "s:main.go", "deep_[0-4]*.go": "e:.go", "*": "*", "**/x": "s:x", "a**/b.c": "e:.c", "*.tar.gz": "e:.gz", "docs/*.txt": "s:docs", "f?o": "*", "a\\*b": "s:a*b", "[.]x": "*"}
    assert {g: P.literal_key(P.ignore_rule(g).regex) for g in cases} == cases
    assert P.literal_key("^(?:.*/)?[^/]*(?:/.*)?$", "a/bcd") == "s:bcd" and P.literal_key("(a|b)+") == "*" and P.literal_key("^x+y$") == "*"


def test_very_many_rules_meet_only_their_paths(spark):
    from textquarry.functions import patterns as P

    rng = random.Random(4)
    globs = ["*.md", "!keep.md", "d1/", "/d2/*.py", "d?/x*", "**/deep/*.go", "!d3/**/k.py", "[ab]*", "d4/**", "*.min.js", "x.y.z"]
    rows = [(0, k, rng.choice(["", "", "d1", "d1/d2"]), P.ignore_rule(rng.choice(globs))) for k in range(60)]
    paths = ["/".join([*(f"d{rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))), *(["deep"] if rng.random() < 0.2 else []), rng.choice(["a.md", "keep.md", "k.py", "m.go", "x1", "q.min.js", "x.y.z", "b"])]) for _ in range(300)]
    files = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    schema = "layer int, ord long, base string, regex string, negated boolean"
    one = [(layer, k, base, r.regex, r.negated) for layer, k, base, r in rows]
    got = {r["path"]: r["is_ignored"] for r in filters.last_match(files, spark.createDataFrame(one, schema)).collect()}
    want = dict.fromkeys(got, False)
    for p in want:
        for _, _, base, r in rows:
            if (not base or p.startswith(base + "/")) and re.search(r.regex, p[len(base) + 1 :] if base else p):
                want[p] = not r.negated
    assert got == want
    many = spark.range(100_000).selectExpr("0 as layer", "id as ord", "'' as base", "concat('^(?:.*/)?n', id, '(?:/.*)?$') as regex", "id % 2 = 0 as negated")
    far = spark.range(2_000).selectExpr("concat('top/n', id * 100 + 1, '/f.py') as path")
    out = filters.last_match(far, many)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("is_ignored").count() == 1_000
    with pytest.raises(ValueError):
        filters.last_match(far, spark.range(10_001).selectExpr("0 as layer", "id as ord", "'' as base", "'^(?:.*/)?[^/]*(?:/.*)?$' as regex", "false as negated"))


def test_rules_of_one_directory_meet_their_own_paths(spark):
    from textquarry.functions import patterns as P

    assert P.literal_keys(P.ignore_rule("/src/a/**/x_[0-9]*_7.py").regex, "b") == ["p:x_", "s:a", "s:b", "s:src", "z:_7.py"]
    assert P.literal_keys("(a|b)+") == [] and P.literal_keys(P.ignore_rule("*").regex) == []
    files = spark.range(2_000).selectExpr("concat('src/en/mod_', id, if(id % 2 = 0, '_x.py', '.min.js')) as path")
    regex = "if(id % 2 = 0, concat('^src/en/mod_', id, '_[^/]*(?:/.*)?$'), concat('^(?:.*/)?en/(?:.*/)?[^/]*_', id, '\\\\.min\\\\.js(?:/.*)?$'))"
    rules = spark.range(4_000).selectExpr("0 as layer", "id as ord", "'' as base", f"{regex} as regex", "false as negated")
    keyed = rules.withColumn("rule", F.col("ord")).withColumn("keys", F.udf(P.literal_keys, "array<string>")("regex", "base"))
    assert filters.candidates(files, keyed).count() == 2_000  # by the directory that all share they were 8,000,000
    assert filters.last_match(files, rules).where("is_ignored").count() == 2_000


# streams


def test_stream_of_rebuilds_agrees_with_the_batch(spark, tmp_path):
    """Several batches, out-of-order and late rows, and a restart from the checkpoint."""
    rng = random.Random(7)
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()
    begin, batches, t = 1_700_000_000, [], 0.0
    for _ in range(5):
        rows = []
        for _ in range(40):
            t += rng.choice([0.1, 0.3, 0.5, 3.0])
            rows.append((round(t - rng.choice([0, 0, 1.5]), 1), f"k{rng.randint(0, 2)}"))
        batches.append(rows)
    batches[3].append((0.2, "k0"))  # far behind the watermark: dropped
    batches.append([(t + 1_000, "end")])
    batches.append([(t + 2_000, "end")])
    late = (0.2, "k0")

    def run():
        stream = spark.readStream.schema("ts timestamp, key string").option("maxFilesPerTrigger", 1).json(str(src))
        q = watch.stream_rebuilds(stream, 0.4, 2.0, "5 seconds").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(mark)).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    for k, rows in enumerate(batches):
        stamp = lambda s: time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(begin + int(s * 10) // 10)) + f".{int(round(s * 10)) % 10}Z"
        (src / f"{k}.json").write_text("\n".join(json.dumps({"ts": stamp(s), "key": key}) for s, key in rows))
        os.utime(src / f"{k}.json", (begin + k, begin + k))
        if k in (2, 6):
            run()
    kept = [(round(begin + s, 1), key) for rows in batches for s, key in rows if (s, key) != late]
    batch = changes.rebuilds(spark.createDataFrame(kept, "t double, key string").withColumn("id", F.lit(0)), 0.4, 2.0)
    want = sorted((r["key"], round(r["at"], 3), r["n"]) for r in batch.collect() if r["key"] != "end")
    got = sorted((r["key"], round(r["at"], 3), r["n"]) for r in spark.read.parquet(str(out)).collect() if r["key"] != "end")
    assert got == want and len(want) > 20


def test_a_watched_folder_tells_new_changed_and_deleted_files(spark, tmp_path):
    root, seen = tmp_path / "root", []
    (root / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.txt", "c.log"):
        (root / name).write_text("one")

    def run(until):
        rebuild = lambda moved, _: seen.append(sorted((r["path"].rsplit("/", 1)[1], r["kind"]) for r in moved.collect()))
        q = watch.watch_folder(spark, str(root), f"file://{tmp_path}/mark", rebuild, lambda rows: rows.where("path not like '%.log'"), "200 milliseconds").start()
        try:
            until(q)
        finally:
            q.stop()

    def waited(q, n):
        at = time.monotonic()
        while len(seen) < n and time.monotonic() - at < 60:
            time.sleep(0.1)
        assert q.exception() is None

    def first(q):
        while not (q.lastProgress and q.lastProgress["batchId"] >= 1):
            time.sleep(0.1)
        (root / "new.txt").write_text("two")
        (root / "d.log").write_text("never watched")
        waited(q, 1)
        (root / "a.txt").write_text("changed")
        (root / "sub/b.txt").unlink()
        waited(q, 2)

    run(first)
    (root / "new.txt").unlink()  # while nobody looks
    run(lambda q: waited(q, 3))
    assert sum(seen[:1], []) == [("new.txt", "added")] and sorted(sum(seen[1:-1], [])) == [("a.txt", "modified"), ("b.txt", "deleted")] and seen[-1] == [("new.txt", "deleted")]
