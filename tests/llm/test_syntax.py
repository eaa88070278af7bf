"""Syntax checkers: hand-picked cases of each language, independent parsers
from the standard library, and the diagnosis operator."""

import ast
import json
import random
import time
import warnings
import xml.parsers.expat as expat

import pytest

from orrery.llm import source_syntax as S

GOOD = {
    "java": [
        "", "// only a comment", ";;class A{};", "package a.b; import static a.b.C.*; import d.*; class A { int x = 1, y[] = {1,2,}; static { } { } A() { this(1); } A(int... a) { super(); } <T> T f(T[] a, final List<? extends T> b) throws E, F { return null; } }",
        "module a.b { requires transitive x.y; exports a.b to c.d, e; uses X; provides A with B; }",
        "class A { Object o = (Runnable & Serializable) () -> {}; int q = (int) +x; int w = (Integer) (y); boolean b = a < c && d > e; boolean t = a instanceof String s && s.isEmpty(); int sh = a >> 2 >>> 3 << 4; }",
        "class A { int f(int k) { return switch (k) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new X(); }; } }",
        "sealed interface S permits A, B {} record R<T>(int a, @X T... b) implements S { R { if (a < 0) throw new E(); } static int z; } non-sealed class C implements S {} enum E { A(1) { void f() {} }, B, ; int x; E(int a) {} }",
        "@interface X { int a() default 1; String[] b() default {}; } @X(a = 1, b = {\"x\"}) @Y class Z<@A T extends @B Foo & Bar> {}",
        "class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) ; for (;;) break; for (final var x : xs) continue; label: while (true) { continue label; } do x++; while (x < 3); try (var a = b; c) { } catch (A | B e) { } finally { } } }",
        'class A { String s = """\n  hi "x" \\"""\n  """; char c = \'{\'; }', "class A { List<List<String>> a = new B<C<D>>(); Map<String, List<Map<A,B>>> x; boolean y = a >>> 1 > 2; int[] z = new int[]{1}; int[][] w = new int[3][]; }",
        "class A { int record = 1; void record() { record = 2; var var = 3; x.<String>foo().bar(); Supplier<A> s = A::new; f(int[]::new, List<String>::new); } }",
        "class A { int x = 1_000; double d = 1e10, e = .5, f = 1.f, g = 0x1.8p3; long l = 0xFFL; char c = '\\u0041'; }",
    ],
    "javascript": [
        "", "'use strict'\nvar a = 1\nvar b = 2", "return 5", "#!/usr/bin/env node\nx()", "x = a\n(b)", "let x = async () => { await y; }", "for (const [a,b] of c) {}\nfor (let i in o) x", "x = /a[/]b/g.test(y); z = a / b / c", "`a${`b${c}`}d` + 1",
        "x = {a, b: 1, [c]: 2, get d() { return 1 }, set d(v) {}, async e() {}, *f() { yield 1 }, ...g, 'h': 1, 3: 4, if: 5}", "class A extends B { static x = 1; #y = 2; static { } get z() { return this.#y } async *w() {} constructor() { super() } }",
        "const {a, b: {c = 1}, ...d} = e; const [f,,g=2,...h] = i", "a ?? b; a?.b?.[c]?.(d); a ** b; new A.B(c).d", "a\n++\nb", "if (a) b\nelse c", "do x++\nwhile (y) z", "a = [\n  /x/,\n /y/i\n]", "({a} = b); [a, b] = [b, a]", "x = y => ({z})\nw = async q => q", "label: for (;;) { continue label }",
    ],
    "c": [
        "", "/* only */", "#include <stdio.h>\n#define X(a) \\\n  (a)\nstatic int f(const char *s, ...) { if (s) return 1; else { for (int i = 0; i < 3; i++) ; } do { } while (0); return (int)*s; }", "struct S { int a : 3; union { int b; }; struct S *next; } s = { .a = 1, .b = 2 }; enum E { A = 1, B, };",
        "typedef int (*fn)(int, char *[]); fn table[3] = { [0] = f, g, };", "int f(a, b) int a; char *b; { return a; }", "#ifdef A\nint f(void) {\n#else\nint f(int x) {\n#endif\n  return 0;\n}", "extern \"C\" {\nint f(void);\n}", "void f(void) { foo_t x = 1, *y; a * b; size_t n = sizeof(struct S) + sizeof x; goto end; end: ; switch (n) { case 1: case 2: break; default: ; } }",
        "MODULE_LICENSE(\"GPL\")\nint x;", "const char *s = \"a\" \"b\" FMT \"c\";", "void f(void) { int *p = (int *)q; x = (struct S){1, 2}; x = a ? b : c; p->q.r[1](2)++; }",
    ],
    "json": ["{}", "[1, -0.5e3, true, null, \"\\u00e9\\n\"]", "5", " \"x\" ", "{\"a\": {\"b\": [[], {}]}, \"a\": 1}"],
    "xml": ["<a/>", "<?xml version='1.0' encoding='UTF-8'?>\n<!DOCTYPE a [<!ENTITY x \"y\">]>\n<a b='1' c:d=\"2\"><!-- - --><?p q?><![CDATA[<<]]>&x;&amp;&#65;</a>\n", "\ufeff<a>\n</a>"],
    "python": [
        "", "# only", "\ufeffx = 1\n", "if a:\n    b\nelif c: d\nelse:\n  e\n", "match x:\n  case [1, *_] | {'a': b, **c} if d: pass\n  case A(b=1, c=-2) as d:\n    pass\nmatch = case = type = 1\n", "type X[T: int = str, *U, **V] = list[T]\n", "with (a as b, c as d,): pass\nwith (a): pass\nwith (a, b) as c: pass\n",
        "def f(a, /, b=1, *c, d, **e) -> int: return (yield a)\n", "x = [i async for i in y if z if w]; {**a, 'b': 1}; {*a, b}; f(*a, b=1, **c); a[1:2, ::3, *d]\n", "try:\n  a\nexcept* B as c: pass\n", "x = f'{a!r:>{w}} {{}} {b=} {c[\"d\"]}' 'z'\n", "f(x for x in y)\nprint(*a, sep='')\n", "lambda *a, b=1: a if b else c\n", "@a.b(c)\n@d\nasync def f(): await g()\n",
        "x = 1 if y else 2; z: int = 3; a = b = c; del a, b[0]\n", "def f():\n\tif a:\n\t\tb\n\treturn c\n", "x = (\n  1,\n# c\n\n    2)\n", "from . import a\nfrom .b import (c as d, e,)\nfrom ... import f\n", "while x := f(): pass\nelse: pass\n", "global_ = 0xFF + 1_000 + 1e5j + .5\n", "class A[T](B, metaclass=C): x: int\n",
    ],
}
BAD = {
    "java": ["class A {", "class A { void f() { x; } }", "class A { void f() { int a b; } }", "class A { void f() { if (x) int y = 1; } }", "class A { int f( { } }", "class A { void f() { foo(a, ); } }", "class A { void f() { else { } } }", "package a; import b.C; class D { } }", "class A { int x = 1_; }", "class A { public void f(); abstract int g() }",
             "class A { void f() { int i = a[]; } }", "class A { void f() { try { } } }", "class A { String s = \"\\q\"; }", "class A { String s = \"a; }", "/* open", "<<<<<<< HEAD\nclass A {}", "Just some prose.", "class A { int a = 08; char c = ''; }", "class A { @Override public }", "#include <a.h>"],
    "javascript": ["var a = {", "foo(", "a b", "1 + ", "x = \"abc", "import x from 'y'", "export default 1", "throw\nx", "try { }", "}", "{ \"a\": 1 }", "x = a ? b", "const a", "f(,)", "foo() { }", "const f = () => {} const g = 1", "a = /(/", "a = /x/gg", "1 = 2", "(a + b) = 1", "-a ** b", "await x", "<<<<<<< ours\nx", "x = `a${b`", "if (a) const b = 1", "() => {}\n()"],
    "c": ["int f(void) {", "int x = ;", "int x", "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b\n", "#ifdef A\nint x;\n", "#endif\n", "int f(void) { return 1 }", "package a.b;\nclass C { }", "int f(void) { char *s = \"abc; }", "struct S { int a }", "int a[3;", "/* open", "int f(int x { }", "#foo\nint x;"],
    "json": ["", " ", "{", "{\"a\": 1,}", "[1 2]", "{'a': 1}", "{\"a\": 01}", "nul", "NaN", "\"a\tb\"", "{} {}", "[1,", "{\"a\" 1}", "// x\n{}", "\"\\x\"", "[}", "-"],
    "xml": ["", "x", "<a>", "<a></b>", "<a b=1/>", "<a b='1' b='2'/>", "<a>&nbsp;</a>", "<a/><b/>", "<a>]]></a>", "<a><!-- -- --></a>", " <?xml version='1.0'?><a/>", "<a>\x01</a>", "<a b='<'/>", "<a>&#0;</a>", "<a>x < y</a>", "<!DOCTYPE a>"],
    "python": ["if a:\nb\n", "def f(:\n  pass\n", "x = (1,\n", "  x = 1\n", "if a:\n    b\n  c\n", "try:\n  a\n", "f(a=1, 2)\n", "a + b = c\n", "x = 'abc\n", "x = \"\"\"abc\n", "print x\n", "else: pass\n", "x = 01\n", "f() = 1\n", "def f(a=1, b): pass\n", "class A\n  pass\n", "<<<<<<< HEAD\nx\n", "x = f'{a'\n", "x = f'{}'\n", "import a.b as c.d\n", "x = [1, 2\ny = 3\n", "x = b'é'\n", "for x in y\n  z\n", "except A: pass\n",
               "return = 1\n", "a = 1 +\n", "if x = 1: pass\n", "lambda: (yield\n", "x = '\\x4'\n", "with a as f(): pass\n", "public class A {}\n", "x = 1; if y: z\n", "@a\nx = 1\n", "match x:\n  y\n"],
}


@pytest.mark.parametrize("language,text", [(g, t) for g, ts in GOOD.items() for t in ts])
def test_well_formed(language, text):
    assert S.diagnose(text, language) == []


@pytest.mark.parametrize("language,text", [(g, t) for g, ts in BAD.items() for t in ts])
def test_malformed(language, text):
    found = S.diagnose(text, language)
    lines = [n for n, _ in found]
    assert lines and lines == sorted(lines) and lines[0] >= 1


@pytest.mark.parametrize("text", GOOD["python"] + BAD["python"])
def test_python_cases_agree_with_the_interpreter(text):
    """The recursive-descent parser alone, without the exact check behind it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("\ufeff"))
        valid = True
    except SyntaxError:
        valid = False
    assert (S.parser("python").check(text) == []) == valid


def mutated(text, r):
    k = r.randrange(len(text))
    return r.choice([text[:k], text[:k] + text[k + 1:], text[:k] + r.choice("(){}[]:;,.'\"#@=* \n") + text[k:], text[:k] + text[k:k + 9] + text[k:]])


def test_mutations_agree_with_independent_parsers():
    """Random damage, judged by ast, json and expat."""
    r = random.Random(7)
    wrong = []
    for _ in range(3000):
        t = mutated(r.choice(GOOD["python"][3:]), r)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(t)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        if (S.diagnose(t, "python") == []) != valid:
            wrong.append(t)
    assert len(wrong) <= 15, wrong  # corners such as numbers glued to words
    for _ in range(2000):
        t = mutated(r.choice(GOOD["json"]) or "0", r)
        try:
            json.loads(t, parse_constant=lambda x: 1 / 0)
            valid = True
        except (ValueError, ZeroDivisionError):
            valid = False
        assert (S.diagnose(t, "json") == []) == valid, t
    for _ in range(2000):
        t = mutated(r.choice(GOOD["xml"][:2]), r)
        try:
            expat.ParserCreate("utf-8").Parse(t.encode(), True)
            valid = True
        except expat.ExpatError:
            valid = False
        if (S.diagnose(t, "xml") == []) != valid:
            wrong.append(t)
    assert len(wrong) <= 30, wrong


def test_recovery_finds_later_errors():
    found = S.diagnose("class A {\n void f() { int a b; }\n void g() { x = ; }\n int ok;\n void h() { return 1 }\n}\n", "java")
    assert [n for n, _ in found] == [2, 3, 5]
    assert [n for n, _ in S.diagnose("x = = 1\ny = 2\nz = )\n", "python")] == [1, 3]


def test_memo_does_not_leak_between_contexts():
    for _ in range(2):
        assert S.diagnose("class A { void f() { if (a) { b(); } } }", "java") == []
        assert S.diagnose("class A { void f() { if (a) { b(); } else } }", "java") != []
        assert S.diagnose("class A { void f() { else { b(); } } }", "java") != []


def test_very_long_and_deep_texts():
    assert S.diagnose("class A {" + " int f() { return 1; }" * 50_000 + "}", "java") == []
    assert S.diagnose("[" * 3000 + "]" * 3000, "json") == []
    assert S.diagnose("<a>" * 50_000 + "</a>" * 50_000, "xml") == []
    assert S.diagnose("[" * 200_000, "json") != []
    assert S.diagnose("[" * 200_000 + "]" * 200_000, "json") == []


DEEP = {
    "javascript": ("x=" + "(" * 10_000 + "a" + ")" * 10_000, "{" * 10_000 + "}" * 10_000, "x=" + "a?b:" * 10_000 + "1"),
    "c": ("int x=" + "(" * 10_000 + "1" + ")" * 10_000 + ";", "int f(void){" + "{" * 10_000 + "}" * 10_000 + "}", "int f(void){" + "if(x)" * 10_000 + ";}"),
    "java": ("class A{int x=" + "(" * 10_000 + "1" + ")" * 10_000 + ";}", "class A{void f(){" + "{" * 10_000 + "}" * 10_000 + "}}"),
    "python": ("x=" + "(" * 10_000 + "a" + ")" * 10_000 + "\n", "".join(" " * k + "if x:\n" for k in range(300)) + " " * 300 + "y\n"),
}


@pytest.mark.parametrize("language,text", [(g, t) for g, ts in DEEP.items() for t in ts])
def test_depth_is_not_bounded_and_linear(language, text):
    S.diagnose("", language)
    began = time.time()
    assert S.diagnose(text, language) == []
    assert time.time() - began < 3
    assert S.diagnose(text[:-2], language) != [] or language == "python"


BRANCHES = [
    (True, "#ifdef A\nint f(void){\n#else\nint f(int x) {\n#endif\n return 0;}\n"),
    (False, "#ifdef A\nint x;\n#else\nint = ;\n#endif\n"),
    (False, "#ifdef A\nint f(void){return 0;}\n#else\nint f(void){\n#endif\n"),
    (False, "#ifdef A\nint x;\n#else\nstruct S { int a\n#endif\n"),
    (False, "#ifdef A\nint = ;\n#else\nint x;\n#endif\n"),
    (False, "#ifdef A\n#ifdef B\nint f(void){\n#else\nint g(int {\n#endif\n#else\nint h(void){\n#endif\n }\n"),
    # a condition has one truth in a variant
    (True, "void f(void){\n#ifdef A\n if (x) {\n#else\n#endif\n y();\n#if defined(A)\n }\n#endif\n}\n"),
    (True, "void f(void){\n#if defined(A)\n if (x) {\n#elif defined(B)\n while (y) {{\n#else\n {{{ \n#endif\n y();\n#ifdef A\n }\n#elif defined B\n }}\n#else\n }}}\n#endif\n}\n"),
    (True, "#ifndef A\nint f(void){\n#else\nint g(void) {\n#endif\n#ifdef A\n x; }\n#else\n y; }\n#endif\n"),
    (True, "#if A\nvoid f(int x) {\n#else\nint f(void) {\n#endif\n ;\n#ifdef B\n int z;\n#elif C\n int q;\n#else\n#endif\n}\n"),
]


@pytest.mark.parametrize("valid,text", BRANCHES)
def test_every_branch_of_a_conditional_is_parsed(valid, text):
    assert (S.diagnose(text, "c") == []) == valid


FORMATS = ['x = f"{a["b"]}"\n', "x = f'{a['b']!r:>{w['z']}}' 'y'\n", 'x = f"{f"{f"{1}"}"}"\n', 'f"""{\n a # c\n}"""\n', 'x = f"{a[\n"b"]}"\n', 'x = f"{"a" "b" ,}"\n', 'x = f"{a["b"}"\n', 'x=f"{a["b"]}" y\n', 'x = rf"\\{a["b"]}"\n', "s = 'f\"{' + \"x\"\n",
           'print(f"{x}", "a")\nz = f"{d["k"]:{"w"}}"\n', 'x = f"{a["b"]"\n', "x = f'{'\n'}'\n", 'x = f"{\'a\' + "b" + c(d="e")}" + f"{"}"}"\n']


@pytest.mark.parametrize("text", FORMATS)
def test_nested_format_strings_agree_with_the_interpreter(text):
    try:
        ast.parse(text)
        valid = True
    except SyntaxError:
        valid = False
    assert (S.diagnose(text, "python") == []) == valid


ROWS = [(1, "class A {", "java", "r", 9, "a/A.JAVA"), (2, None, None, "r", None, "a/B.java"), (3, "", None, "r", 0, "a/C.java"), (4, "x", "en", None, 1, "d.txt"), (5, "{}", "java", None, 2, "noext"), (6, " ", None, "q", 1, "e.json"), (7, "x = 1", "java", "q", 5, "f.Py"), (8, "\n", None, "q", 1, "g.c")]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, path string"


def test_operator(spark):
    df = spark.createDataFrame(ROWS, DOCS).selectExpr("*", "1 as language", "2 as errors")
    assert {r["doc_id"] for r in S.malformed(df).collect()} == {1, 6}
    got = S.diagnose_sources(df)
    assert {r["doc_id"]: r["well_formed"] for r in got.collect()} == {1: False, 6: False, 7: True, 8: True}
    rates = {(r["source"], r["language"]): r["malformed_rate"] for r in S.rates(got).collect()}
    assert rates == {("r", "java"): 1.0, ("q", "json"): 1.0, ("q", "python"): 0.0, ("q", "c"): 0.0}
    assert S.malformed(df.limit(0)).count() == 0
    outcomes = spark.createDataFrame([(1, "DECODED", "P", None, None, None), (1, "INVALID", "N", None, [("a", "b")], None), (None, "INVALID", "N", None, None, None)],
                                     "doc_id bigint, status string, state string, observed_at timestamp, problems array<struct<reason:string,requirement:string>>, diagnostics array<struct<severity:string,code:string,message:string,line:int>>")
    row = S.against_outcomes(got, outcomes).where("doc_id = 1").first()
    assert row["status"] == "INVALID" and row["reported"]
