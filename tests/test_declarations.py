import random

import pytest

from tessera import model as m
from tessera.functions.digests import CHUNK_TAG
from tessera.operators import declarations as d


def named(language, *lines, first=1):
    return [(s.name, s.kind, s.line) for s in d.parse(language, "\n".join(lines), first)]


def test_python_and_typescript():
    assert named("python", "import x", "", "async  def load_data(a):", "  def inner(): pass", "class Repo(Base):", "definitely = 1", "def\trun():\r") == [("load_data", "function", 3), ("Repo", "class", 5), ("run", "function", 7)]
    assert named("typescript", "export default async function f() {", "export abstract class A {", "interface I {", "export type T = {", "declare const enum E {", "const g = () => 1", " class B {}") == [
        ("f", "function", 1), ("A", "class", 2), ("I", "interface", 3), ("T", "type", 4), ("E", "enum", 5)]
    with pytest.raises(m.UnsupportedLanguage):
        d.parse("go", "")
    with pytest.raises(m.InvalidReference):
        d.parse("python", "", path="../x.py")


def test_javascript_forms():
    lines = [
        "export async function load() {}", "function* walk() {}", "export default class Store {}", "export const View = (props) => <main />", "const help = function (value) { return value }",
        "let refresh = async value => value", "var series = async function* own() {}", "const n = 42", "export default function () {}", "  function nested() {}", "const broken = (v) = v", "// function gone() {}", "function default() {}",
    ]
    assert [n for n, _, _ in named("javascript", *(x + "\r" for x in lines), first=7)] == ["load", "walk", "Store", "View", "help", "refresh", "series"]


@pytest.mark.parametrize("line", [
    "function half-name() {}", "class A.b {}", "const p = (return) => 1", "const p = (a,,b) => 1", "function f(a, a) {}", "function f(a = 1) {}", "const f = (...rest, a) => 1", "function f()", "const f = function()",
    "const f = () =>", "const f = () => // later", "const f = () => /* later */", "const f = a => => a", "const f = () => yield", "const f = () => await x", "const f = () => return", "const f = () => typeof", "const f = () => in x",
    "function interface() {}", "const f = (eval) => 0", "const f = () => class return {}", "const f = () => function interface() {}", "const f = () => <a", "const f = () => 'open", "const f = () => )",
])
def test_unsound_declarations(line):
    assert named("javascript", line) == []


@pytest.mark.parametrize("line", ["const f = (...a) => a.length", "const f = async () => await x", "const f = () => !await2", "const f = () => new Map()", "const f = () => class A extends B.C { }", "const f = () => ({ a: 1 })", "const f = async => async", "const f = () => /a[/]b/.test(x)", "const f = () => `t${x}`"])
def test_sound_arrows(line):
    assert named("javascript", line) == [("f", "function", 1)]


def test_only_the_top_level_counts():
    assert named(
        "javascript", "if (ready) {", "function hidden() {}", "}", "function outer() {", "function inner() {}", "}", "const o = { f: () => ({ v: 1 }) }", "const q = a / b", "const s = '{'", "const t = `{`", "/* {", "function c() {}", "*/",
        "if (/[{]/.test(v)) {", "function r() {}", "}", "export const V = () => <a b={{ c: '}' }}>{d} } text</a>", "export const W = () => <><b /></>", "const x = `", "function y() {}", "${ { a: 1 }.a } `", "function last() {}",
    ) == [("outer", "function", 4), ("V", "function", 17), ("W", "function", 18), ("last", "function", 22)]


@pytest.mark.parametrize("line", ["}", "const a = 'open", "const r = /open", "const t = `a${`b`}`", "a(]", "if (a) b = c\nd(e) {} / 2 / f", "const v = () => <a>{<b/>}</a>", "(" * 300])
def test_doubt_silences_the_rest(line):
    assert named("javascript", "function before() {}", line, "function after() {}")[1:] == []


def test_carried_strings_and_division():
    assert named("javascript", "const a = 'x\\", "function in_string() {}'", "const b = (1) / 2; const c = [1] / 2", "function f() {}") == [("f", "function", 4)]
    assert named("javascript", "while (x) /re{/.test(y)", "do {", "} while (z)", "function g() {}") == [("g", "function", 4)]


def cut(language, text):
    return d.cut(text, d.parse(language, text))


def test_chunks():
    text = "import x\n\n# doc\n@deco\ndef a():\n  pass\n\n\n/* block\n more */\nclass B:\n  x = 1\r\n\n"
    assert [(n, s, e) for n, s, e, _ in cut("python", text)] == [("a", 3, 6), ("B", 9, 12)]
    assert cut("python", text)[1][3] == "/* block\n more */\nclass B:\n  x = 1"
    assert [(n, s, e) for n, s, e, _ in cut("python", "def a():\n  # inside\n# of a?\ndef b(): 1")] == [("a", 1, 2), ("b", 3, 4)]
    assert [(n, s, e) for n, s, e, _ in cut("python", "  /* far\n*/\ndef a(): 1")] == [("a", 3, 3)]
    assert cut("javascript", "\n\nexport const answer = 42\n\n") == [("", 3, 3, "export const answer = 42")]
    assert cut("python", " \n\n") == [] and cut("python", "") == []
    for symbols in ([d.Symbol("", "function", "", 1)], [d.Symbol("a", "function", "", 2), d.Symbol("b", "function", "", 2)], [d.Symbol("a", "function", "", 9)], [d.Symbol("a", "function", "", 1)]):
        with pytest.raises(m.InvalidChunk):
            d.cut("\nx\n", symbols)


def test_files(spark):
    files = spark.createDataFrame([("a/x.py", "python", bytearray(b"def a():\n  1\nclass B: 2\n")), ("v.ts", "typescript", bytearray(b"enum E {}\n")), ("n.js", "javascript", bytearray(b"42\n")), ("e.py", "python", bytearray(b"\n"))], m.FILE)
    rows = sorted(map(tuple, d.chunk_files(files).select("path", "symbol_name", "start_line", "end_line", "kind").collect()))
    assert rows == [("a/x.py", "B", 3, 3, "class"), ("a/x.py", "a", 1, 2, "function"), ("n.js", "", 1, 1, ""), ("v.ts", "E", 1, 1, "enum")]
    both = [sorted(map(tuple, f(files.where("language <> 'javascript'")).select("path", "name", "kind", "signature", "line").collect())) for f in (d.parse_files, d.declared_lines)]
    assert both[0] == both[1] and len(both[0]) == 3
    assert {r.name: r.next_line for r in d.next_starts(d.parse_files(files)).collect()} == {"a": 3, "B": None, "E": None}
    one = d.chunk_files(files).where("path = 'v.ts'").first()
    assert one.chunk_id == d.id_of("v.ts", 1, 1, "typescript", "E", "enum E {}", CHUNK_TAG)


PIECES = [
    "", "", "  ", " \t", "# c", "// c", "@deco", "/* one */", "/* open", "  /* open", "  /* one */", "more */", "end */ x", "*/", "x = 1", "  y", "def f{}():", "class B{}: pass", "export class C{} {", "function g{}() {", " ", "\x1c", "#end */",
    "/*/", "interface I{} {", "def", "async def q{}(a):\r", "\r", "\u3000", "é",
]


def test_columns_equal_the_plain_reading(spark):
    rng = random.Random(6)
    files = []
    for i in range(4000):
        lines = [rng.choice(PIECES).replace("{}", str(j)) for j in range(rng.randrange(0, 14))]
        files.append((f"p/{i}", rng.choice(d.LINE_LANGUAGES), bytearray((rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n", "\n\n"])).encode())))
    files.append(("p/long", "python", bytearray(b"# c\n" * 20_000 + b"def a(): 1\n" + b"x\n" * 9 + b"/* a\n" + b"b\n" * 20_000 + b"*/\ndef b(): 2\n")))
    df = spark.createDataFrame(files, m.FILE).repartition(4)
    chunks, symbols = d.chunk_lines(df), d.declared_lines(df)
    for frame in (chunks, symbols):
        assert not any(x in frame._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow", "MapIn"))
    assert "Exchange" not in d.chunk_lines(spark.createDataFrame(files[:2], m.FILE))._jdf.queryExecution().executedPlan().toString()
    got, named = {}, {}
    for r in chunks.collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.symbol_name, r.text, r.kind, r.chunk_id))
    for r in symbols.collect():
        named.setdefault(r.path, []).append(d.Symbol(r.name, r.kind, r.signature, r.line))
    for path, language, content in files:
        text = bytes(content).decode()
        found = d.parse(language, text)
        kinds = [s.kind for s in found] or [""]
        want = [(a, b, n, body, kind, d.id_of(path, a, b, language, n, body)) for (n, a, b, body), kind in zip(d.cut(text, found), kinds)]
        assert sorted(got.get(path, [])) == sorted(want) and sorted(named.get(path, []), key=lambda s: s.line) == found, text


def test_other_languages_are_refused(spark):
    with pytest.raises(Exception, match="unsupported language"):
        d.chunk_files(spark.createDataFrame([("a.go", "go", bytearray(b"x"))], m.FILE)).collect()
