"""Top-level declarations of source files, and chunks cut along them.

Files are rows (path, language, content) and stay distributed: a file is the unit of parsing and cutting, as chunks depend on
the lines around them, so nothing is shuffled. Python and TypeScript need nothing but patterns on lines: their declarations
(``declared_lines``) and chunks (``chunk_lines``) are plain columns. JavaScript needs its scanner and goes to Python; ``parse``
and ``cut`` are the same for one file, by which tests hold the columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.digests import CHUNK_TAG, chunk_id
from tessera.model import InvalidChunk, InvalidReference, UnsupportedLanguage, valid_path
from tessera.operators.javascript import NAME, RESERVED, Scanner, sound_declaration, sound_initializer

_S = r"[\t\n\f\r ]"

# Fixed values: (kind, pattern) by language; the first that fits a line names its declaration.
PATTERNS = {
    "python": (
        ("function", rf"^(?:async{_S}+)?def{_S}+([A-Za-z_][A-Za-z0-9_]*)"),
        ("class", rf"^class{_S}+([A-Za-z_][A-Za-z0-9_]*)"),
    ),
    "typescript": (
        ("function", rf"^(?:(?:export|default|declare|async){_S}+)*function{_S}+({NAME})"),
        ("class", rf"^(?:(?:export|default|declare|abstract){_S}+)*class{_S}+({NAME})"),
        ("interface", rf"^(?:(?:export|declare){_S}+)*interface{_S}+({NAME})"),
        ("type", rf"^(?:(?:export|declare){_S}+)*type{_S}+({NAME})"),
        ("enum", rf"^(?:(?:export|declare|const){_S}+)*enum{_S}+({NAME})"),
    ),
    "javascript": (
        ("function", rf"^(?:export{_S}+(?:default{_S}+)?)?(?:async{_S}+)?function(?:{_S}*\*{_S}*|{_S}+)({NAME}){_S}*\("),
        ("class", rf"^(?:export{_S}+(?:default{_S}+)?)?class{_S}+({NAME})(?:{_S}+extends{_S}+{NAME}(?:\.{NAME})*)?{_S}*\{{"),
        ("function", rf"^(?:export{_S}+)?(?:const|let|var){_S}+({NAME}){_S}*={_S}*(?:async{_S}+)?(?:function(?:{_S}*\*)?(?:{_S}+{NAME})?{_S}*\(|(?:{NAME}|\([^)]*\)){_S}*=>)"),
    ),
}
#: Languages whose declarations patterns on lines settle.
LINE_LANGUAGES = ("python", "typescript")
#: Further tests of JavaScript lines, pattern by pattern.
_SOUND = (sound_declaration, lambda line: True, sound_initializer)
_COMPILED = {lang: [(kind, re.compile(p)) for kind, p in rows] for lang, rows in PATTERNS.items()}


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    signature: str
    line: int


def parse(language: str, text: str, first_line: int = 1, path: str | None = None) -> list[Symbol]:
    """The declarations that stand unindented at a file's top level, one per line at most."""
    if path is not None and not valid_path(path) or first_line < 1:
        raise InvalidReference("invalid file reference")
    if language not in _COMPILED:
        raise UnsupportedLanguage("unsupported language")
    script, scanner, found = language == "javascript", Scanner(), []
    for number, raw in enumerate(text.split("\n"), first_line):
        line = raw.removesuffix("\r")
        top = True
        if script:
            top = scanner.at_top
            scanner.line(line)
            top = top and not scanner.lost
        if not top or not line or line[0] in " \t":
            continue
        for i, (kind, pattern) in enumerate(_COMPILED[language]):
            name = pattern.search(line)
            if name and (not script or name[1] not in RESERVED and _SOUND[i](line)):
                found.append(Symbol(name[1], kind, line.strip(), number))
                break
    return found


# --- chunks -------------------------------------------------------------------------------------


def content_lines(text: str) -> list[str]:
    lines = text.replace("\r\n", "\n").split("\n")
    return lines[:-1] if len(lines) > 1 and not lines[-1] else lines


def documented_from(lines: list[str], declaration: int, least: int) -> int:
    """Where the comments and decorators that lead up to a declaration begin; all are indexes of lines."""
    begin, above = declaration, declaration - 1
    while above >= least and lines[above].strip():
        if lines[above].startswith(("#", "//", "@")):
            begin = above
        elif lines[above].strip().endswith("*/"):
            opening = next((i for i in range(above, least - 1, -1) if lines[i].strip().startswith("/*")), None)
            if opening is None or lines[opening][:1] in (" ", "\t"):
                break
            begin = opening
        else:
            break
        above = begin - 1
    return begin


def _last_written(lines: list[str], begin: int, end: int) -> int:
    """The last line of begin..end that isn't blank; before begin if all are."""
    return next((i for i in range(end, begin - 1, -1) if lines[i].strip()), begin - 1)


def cut(text: str, symbols: list[Symbol], first_line: int = 1) -> list[tuple[str, int, int, str]]:
    """(symbol, start line, end line, text) per declaration; without one, the whole file as one chunk without a symbol."""
    lines = content_lines(text)
    at = [s.line - first_line for s in symbols]
    if any(not s.name for s in symbols) or any(b <= a for a, b in zip([-1, *at], at)) or (at and at[-1] >= len(lines)):
        raise InvalidChunk("invalid or unordered symbols")
    if not symbols:
        begin = next((i for i, line in enumerate(lines) if line.strip()), None)
        spans = [] if begin is None else [("", begin, _last_written(lines, begin, len(lines) - 1))]
    else:
        begins = [documented_from(lines, a, 0 if i == 0 else at[i - 1] + 1) for i, a in enumerate(at)]
        spans = [(s.name, b, _last_written(lines, b, end - 1)) for s, b, end in zip(symbols, begins, [*begins[1:], len(lines)])]
    if any(end < begin or not lines[begin].strip() for _, begin, end in spans):
        raise InvalidChunk("a symbol starts outside the content")
    return [(name, begin + first_line, end + first_line, "\n".join(lines[begin : end + 1])) for name, begin, end in spans]


def id_of(path: str, start: int, end: int, language: str, symbol: str, text: str, tag: str = CHUNK_TAG) -> str:
    return hashlib.sha256("\0".join((tag, path, str(start), str(end), language, symbol, text)).encode()).hexdigest()


#: White space as ``str.strip`` has it.
_WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, rf"^[{_WHITE}]+|[{_WHITE}]+\z", "")


def _first(language: Column, line: Column, use) -> Column:
    """``use`` of the first pattern that fits a line, by language; null without one."""
    rows = [(lang, kind, p) for lang in LINE_LANGUAGES for kind, p in PATTERNS[lang]]
    return F.coalesce(*(F.when((language == lang) & line.rlike(p), use(kind, p)) for lang, kind, p in rows))


def _code(line: Column) -> Column:
    """One letter for what a line means to a declaration below it.

    A space: blank. c: a comment or decorator. o: a whole block comment. e: the end of one, s: its beginning. x, t: like o and s, but
    indented, so that the block belongs to something else. A dot: anything else.
    """
    bare = _stripped(line)
    begins, ends, indented = bare.startswith("/*"), bare.endswith("*/"), line.rlike(r"^[ \t]")
    code = F.when(bare == "", " ").when(line.rlike("^(?:#|//|@)"), "c").when(begins & ends, F.when(indented, "x").otherwise("o"))
    return code.when(begins, F.when(indented, "t").otherwise("s")).when(ends, "e").otherwise(".")


#: The lines that lead up to a declaration, from the nearest one upward.
_LEADING = "^(?:[co]|e[ce. ]*+[os])*+"


def chunk_lines(files: DataFrame, tag: str = CHUNK_TAG) -> DataFrame:
    """``chunk_files`` for Python and TypeScript, in columns only.

    A file's lines are an array, and a string has a letter for what each means (``_code``). So what leads up to a declaration is a
    pattern on the letters above it, read upward, and the blank lines that a chunk drops are the string's own spaces.
    """
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n")
    rows = files.where(F.col("language").isin(*LINE_LANGUAGES)).select("path", "language", F.split(text, "\n").alias("lines"))
    ended = (F.size("lines") > 1) & (F.element_at("lines", -1) == "")
    rows = rows.withColumn("lines", F.when(ended, F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines")))
    code = F.array_join(F.transform("lines", _code), "")
    name = lambda line: F.when(~line.rlike(r"^[ \t]"), _first(F.col("language"), line, lambda kind, p: F.regexp_extract(line, p, 1)))
    kind = lambda line: _first(F.col("language"), line, lambda kind, p: F.lit(kind))
    declared = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), name(line).alias("name"), kind(line).alias("kind"))), lambda d: d["name"].isNotNull())
    rows = rows.select("path", "language", "lines", code.alias("code"), declared.alias("declared"))

    def begin(d: Column, j: Column) -> Column:
        """Where a declaration's chunk begins: after the one before, with the lines that lead up to it."""
        least = F.when(j > 0, F.get("declared", j - 1)["at"] + 1).otherwise(0)
        above = F.reverse(F.substring(F.col("code"), least + 1, d["at"] - least))
        return d["at"] - F.length(F.regexp_extract(above, _LEADING, 0))

    rows = rows.withColumn("begins", F.transform("declared", begin))
    n = F.length("code")
    # up to the next chunk, without the blank lines at its end
    last = lambda b, until: b + F.length(F.rtrim(F.substring(F.col("code"), b + 1, until - b))) - 1
    span = lambda name, kind, b, e: F.struct(name.alias("name"), kind.alias("kind"), b.cast("int").alias("begin"), e.cast("int").alias("end"))
    named = F.transform("declared", lambda d, j: span(d["name"], d["kind"], F.get("begins", j), last(F.get("begins", j), F.coalesce(F.get("begins", j + 1), n))))
    whole = F.array(span(F.lit(""), F.lit(""), n - F.length(F.ltrim("code")), F.length(F.rtrim("code")) - 1))
    spans = F.when(F.size("declared") > 0, named).when(F.trim("code") != "", whole).otherwise(F.array().cast(_SPANS))
    cut_out = rows.select("path", "language", "lines", F.explode(spans).alias("s")).select(
        F.array_join(F.slice("lines", F.col("s.begin") + 1, F.col("s.end") - F.col("s.begin") + 1), "\n").alias("text"), "language", F.col("s.name").alias("symbol_name"), "path",
        (F.col("s.begin") + 1).alias("start_line"), (F.col("s.end") + 1).alias("end_line"), F.col("s.kind").alias("kind"))
    own = chunk_id(*(F.col(c) for c in ("path", "start_line", "end_line", "language", "symbol_name", "text")), tag)
    return cut_out.withColumn("chunk_id", own).select(*_CHUNK_COLUMNS)


_SPANS = "array<struct<name:string,kind:string,begin:int,end:int>>"


def chunk_files(files: DataFrame, tag: str = CHUNK_TAG) -> DataFrame:
    """files (path, language, content) -> (chunk_id, text, language, symbol_name, path, start_line, end_line, kind)."""
    return chunk_lines(files, tag).unionByName(chunk_scanned(files.where(~F.col("language").isin(*LINE_LANGUAGES)), tag))


def chunk_scanned(files: DataFrame, tag: str = CHUNK_TAG) -> DataFrame:
    """``chunk_files`` by ``parse`` and ``cut``, a file at a time; what JavaScript needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, language, content in zip(rows["path"], rows["language"], rows["content"]):
                text = bytes(content).decode()
                symbols = parse(language, text, path=path)
                kinds = {s.line: s.kind for s in symbols}
                for (name, start, end, body), line in zip(cut(text, symbols), [s.line for s in symbols] or [0]):
                    out.append((id_of(path, start, end, language, name, body, tag), body, language, name, path, start, end, kinds.get(line, "")))
            yield pd.DataFrame(out, columns=_CHUNK_COLUMNS)

    return files.select("path", "language", "content").mapInPandas(run, _CHUNK_SCHEMA)


_CHUNK_COLUMNS = ["chunk_id", "text", "language", "symbol_name", "path", "start_line", "end_line", "kind"]
_CHUNK_SCHEMA = "chunk_id string, text string, language string, symbol_name string, path string, start_line int, end_line int, kind string"


def parse_files(files: DataFrame) -> DataFrame:
    """(path, name, kind, signature, line) of every declaration."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(path, s.name, s.kind, s.signature, s.line) for path, language, content in zip(rows["path"], rows["language"], rows["content"]) for s in parse(language, bytes(content).decode(), path=path)]
            yield pd.DataFrame(out, columns=["path", "name", "kind", "signature", "line"])

    scanned = files.where(~F.col("language").isin(*LINE_LANGUAGES)).select("path", "language", "content")
    return declared_lines(files).unionByName(scanned.mapInPandas(run, "path string, name string, kind string, signature string, line int"))


def declared_lines(files: DataFrame) -> DataFrame:
    """``parse_files`` for Python and TypeScript, in columns only."""
    rows = files.where(F.col("language").isin(*LINE_LANGUAGES))
    lines = rows.select("path", "language", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("at", "raw"))
    lines = lines.select("path", "language", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", "\r\\z", "").alias("text")).where(~F.col("text").rlike(r"^[ \t]|^\z"))
    language, text = F.col("language"), F.col("text")
    named = lines.withColumns({"name": _first(language, text, lambda kind, p: F.regexp_extract(text, p, 1)), "kind": _first(language, text, lambda kind, p: F.lit(kind))})
    return named.where("name IS NOT NULL").select("path", "name", "kind", _stripped(text).alias("signature"), "line")


def next_starts(symbols: DataFrame) -> DataFrame:
    """Symbols (path, line, ..) with the line of the next one in the file, null for the last."""
    from pyspark.sql import Window

    return symbols.withColumn("next_line", F.lead("line").over(Window.partitionBy("path").orderBy("line")))
