import re
import time

import pytest

from textquarry.functions import patterns as P


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("*.log", "a.log", True), ("*.log", "x/y/a.log", True), ("*.log", "a.log.txt", False), ("build/", "build/x/y.js", True), ("build/", "src/build/x", True),
        ("/build", "src/build/x", False), ("/build", "build/x", True), ("a/b", "a/b/c", True), ("a/b", "x/a/b", False), ("a/*.py", "a/x.py", True), ("a/*.py", "a/b/x.py", False),
        ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("**/b", "x/y/b", True), ("a/**", "a/x/y", True), ("f?o", "foo", True), ("f?o", "f/o", False),
        ("[ab].c", "a.c", True), ("[!ab].c", "a.c", False), ("[!ab].c", "z.c", True), ("[a-c]x", "bx", True), ("[z-a]", "[z-a]", True), ("[a", "[a", True), (r"\#x", "#x", True), (r"a\*b", "a*b", True),
        (r"a\*b", "axb", False), ("a.b", "axb", False), ("f+(o)", "f+(o)", True), ("trail  ", "trail", True),
    ],
)
def test_ignore_patterns(glob, path, hit):
    assert bool(re.search(P.ignore_rule(glob).regex, path)) is hit


def test_comments_blanks_negation():
    assert P.ignore_rule("# x") is None and P.ignore_rule("  ") is None and P.ignore_rule("/") is None
    rule = P.ignore_rule("!keep.log/")
    assert rule.negated and rule.dir_only and len(P.ignore_rules("a\n\n#b\n!c\n")) == 2


@pytest.mark.parametrize("glob", ["*a*a*a*a*b", "*" * 40 + "a" + "*" * 40 + "b*c", "[" * 50, "\\", "[]", "[!]", "a[b-", "*?" * 30])
def test_hostile_patterns_are_quick(glob):
    rule = P.ignore_rule(glob)
    at = time.time()
    if rule:
        re.search(rule.regex, "a" * 200 + "\nb")
    re.search(P.filter_regex(glob[:6]), "a" * 100)
    assert time.time() - at < 1


@pytest.mark.parametrize("glob, path, hit", [("*.py", "a/b.py", True), ("src/*", "src/a/b.py", True), ("b.py", "a/b.py", True), ("./.github/*", "github/x", True), ("*.py", "a.pyc", False), ("B.py", "a/b.py", False), ("", "x", True), ("[ab].py", "x/a.py", True)])
def test_filter_globs(glob, path, hit):
    assert bool(re.search(P.filter_regex(glob), path)) is hit
