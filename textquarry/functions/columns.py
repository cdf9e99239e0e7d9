"""Column expressions over paths and texts; none of them needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

#: White space of the tokenizer, in the spelling of Java's regular expressions.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters in a row, for the trimming functions: a regular expression looks at every character of a text.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LETTERS = r"\p{L}\p{Nl}\p{No}"
#: Letters and numbers of Unicode 14 and 15, which the classes of Java 17 lack; later ones have them.
_RANGES = (
    "870-887 889-88e 8b5-8b5 8c8-8c9 c5d-c5d cdd-cdd 170d-170d 171f-171f 1b4c-1b4c 2c2f-2c2f 2c5f-2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3-a7d3 a7d5-a7d9 "
    "a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba "
    "10f70-10f81 11071-11072 11075-11075 1123f-11240 11740-11746 11ab0-11abf 11f02-11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f-1342f "
    "13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132-1b132 1b155-1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a "
    "1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
NEWER = "".join("-".join(rf"\x{{{c}}}" for c in r.split("-")) for r in _RANGES.split())
PIECES = rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?\p{{Nd}}+| ?[^{WS}\p{{L}}\p{{N}}_]+|_+|[{WS}]+"
#: Line ends of str.splitlines().
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with generated columns: each is computed once a row, however many expressions (or lambdas) use it."""
    for name, value in values.items():
        df = df.select("*", F.explode_outer(F.array(value)).alias(name))
    return df


# paths


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)[^/]*$", 0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    base = name(path)
    return F.lower(F.when(base.rlike(r"(?s)^\.*[^.].*\."), F.regexp_replace(base, r"(?s)\.[^.]*$", "")).otherwise(base))


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def segments(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def suffix_keys(path: Column) -> Column:
    """The path, and every left-trimmed suffix that keeps a directory."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parts) - 2)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))


# texts


def lines_lf(text: Column) -> Column:
    """Lines by LF or CRLF; a final line end adds no line."""
    flat = F.when(F.contains(text, F.lit("\r\n")), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    parts = F.split(flat, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines_all(text: Column) -> Column:
    """Lines by every line end of str.splitlines()."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def substantive(line: Column) -> Column:
    """At least five characters without the surrounding space, one of them a word character."""
    return (F.length(strip(line)) >= 5) & line.rlike(rf"[{LETTERS}\p{{Nd}}_]|[{NEWER}]")


def signature(text: Column, most: int = 400) -> Column:
    """The first ``most`` distinct stripped lines that have twelve characters and an ASCII letter or digit."""
    kept = F.filter(F.transform(lines_all(text), strip), lambda x: (F.length(x) >= 12) & x.rlike("[A-Za-z0-9]"))
    return F.slice(F.array_distinct(kept), 1, most)


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def decoded(content: Column) -> Column:
    """UTF-8 text with replacement characters; null for binary content."""
    return F.when(~binary(content), F.make_valid_utf8(content.cast("string")))


def binary(content: Column) -> Column:
    return F.position(F.lit(b"\x00"), F.substring(content, 1, fixed.SNIFF_BYTES)) > 0


# tokens


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def _piece_code(piece: Column, code: dict[str, int]) -> Column:
    """A piece's class by its last character: the splitter joins characters of one kind, after one space at most."""
    last = F.ascii(F.right(piece, F.lit(1)))
    short = piece.isin("'s", "'d", "'m", "'t", "'ll", "'ve", "'re")
    return (
        F.when(F.octet_length(piece) != F.length(piece), code["nonascii"])
        .when(last.between(97, 122), F.when(short, code["mixed"]).otherwise(code["letters"]))
        .when(last.between(65, 90), code["letters"])
        .when(last.between(9, 13) | last.between(28, 32), code["ws"])
        .when(last.between(48, 57), code["digits"])
        .when(last == 95, code["underscore"])
        .otherwise(code["punct"])
    )


def piece_class(piece: Column) -> Column:
    names = list(fixed.TOKEN_COSTS)
    return F.get(F.array(*map(F.lit, names)), _piece_code(piece, {c: k for k, c in enumerate(names)}))


def raw_cost(pieces_name: str, costs: dict[str, tuple[float, float]] = fixed.TOKEN_COSTS) -> Column:
    """Cost of the pieces in a (bound) column: short pieces cost 1, others their length beyond the free part by the ratio.

    Spans are summed by class before they are divided, in a fixed order, so engines agree to the last digit that matters.
    """
    which = list(costs)
    code = {c: k for k, c in enumerate(which)}
    kinds = F.transform(F.col(pieces_name), lambda x: F.struct(_piece_code(x, code).alias("c"), F.length(x).cast("double").alias("n")))
    free_part = F.array(*(F.lit(costs[c][1]) for c in which))
    spans = F.transform(kinds, lambda x: F.struct(x["c"].alias("c"), (x["n"] - F.get(free_part, x["c"])).alias("s")))
    start = F.struct(F.lit(0).cast("long").alias("f"), *(F.lit(0).cast("double").alias(f"s{k}") for k in code.values()))

    def add(acc: Column, x: Column) -> Column:
        more = x["s"] > 0
        sums = (F.when(more & (x["c"] == k), acc[f"s{k}"] + x["s"]).otherwise(acc[f"s{k}"]).alias(f"s{k}") for k in code.values())
        return F.struct(F.when(more, acc["f"]).otherwise(acc["f"] + 1).alias("f"), *sums)

    def total(acc: Column) -> Column:
        out = acc["f"].cast("double")
        for c, k in code.items():
            out = out + acc[f"s{k}"] / costs[c][0]
        return out

    return F.aggregate(spans, start, add, total)


def with_tokens(df: DataFrame, text: str = "text", calibration: float = 1.0, out: str = "tokens", costs: dict[str, tuple[float, float]] = fixed.TOKEN_COSTS) -> DataFrame:
    """``df`` with its estimated token count."""
    df = bound(df, _pieces=pieces(F.col(text)))
    cost = raw_cost("_pieces", costs) * calibration
    return df.withColumn(out, F.when(F.col(text) == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(cost))).cast("long")).drop("_pieces")


def with_exact_tokens(df: DataFrame, vocabulary: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with its token count by a vocabulary file that every executor can read; each worker loads it once."""

    @F.pandas_udf("long")
    def count(texts):
        from textquarry.functions.tokens import encoding

        return texts.map(lambda t: None if t is None else len(encoding(vocabulary).encode_ordinary(t)))

    return df.withColumn(out, count(F.col(text)))


def size_tokens(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / fixed.SIZE_CHARS_PER_TOKEN)).cast("long")


def chars_per_token(chars: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.round(chars / tokens, 2)).otherwise(0.0)


# rendering


def fence_ticks(text: Column) -> Column:
    """One tick more than the longest run of at least three, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`{3,}"), F.lit(0)), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1).cast("int")


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\x{10000}-\x{10FFFF}]", "")


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(xml_safe(text), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def label(path: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("`", "'")):
        path = F.replace(path, F.lit(raw), F.lit(safe))
    return path


def attribute(text: Column) -> Column:
    """A quoted XML attribute value: single quotes where the text has double ones only."""
    text = xml_safe(text)
    for raw, safe in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    double, single = F.contains(text, F.lit('"')), F.contains(text, F.lit("'"))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(double & ~single, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(quoted)


def grouped(number: Column) -> Column:
    return F.format_number(number.cast("long"), 0)


def left_pad(text: Column, width: int) -> Column:
    """Padding that never cuts."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def manifest_row(tokens: Column, size: Column, path: Column) -> Column:
    return F.concat(F.lit("  "), left_pad(grouped(tokens), 9), F.lit("  "), left_pad(grouped(size), 10), F.lit("  "), path)


def clip(text: Column, limit: int) -> Column:
    """White space as single spaces, and three dots where the text is longer than ``limit``."""
    flat = strip(F.regexp_replace(text, f"[{WS}]+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def _comment_mark(path: Column, part: int, default: str) -> Column:
    from textquarry.operators.blocks import STYLE

    table = F.create_map(*(F.lit(x) for ext, marks in STYLE.items() for x in (ext, marks[part])))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(?s)\.[^.]*$", 0))), F.lit(default))


def comment_opener(path: Column) -> Column:
    """How a line comment begins in a file of this name."""
    return _comment_mark(path, 0, "#")


def comment_closer(path: Column) -> Column:
    """How it ends: mostly with nothing."""
    return _comment_mark(path, 1, "")


def marker(path: Column, block: Column, lines: Column) -> Column:
    """The line that stands for a shared block, as a comment of the file's language."""
    return F.concat(comment_opener(path), F.lit(" [shared "), block, F.lit(": "), lines.cast("string"), F.lit(" lines, listed under Shared blocks]"), comment_closer(path))
