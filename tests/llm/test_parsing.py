import ast
import warnings

import pytest

from auditlake.llm import parsing as P

GOOD = {
    "py": ["x = 1", "def f(a, /, b=2, *c, d: int = 3, **e) -> int:\n    return a if b else c\n", "match x:\n    case {'a': [1, *_], **rest} if rest:\n        pass\n    case Point(x=0) | None as p:\n        pass\n", "async def f():\n    async with a as b, c:\n        return [y async for y in z if await y]\n", "f'{x!r:>{w}} {a[\"b\"]} {{}}'", "type X[T: int] = list[T]", "try:\n    a()\nexcept* (E, F) as g:\n    pass\nelse:\n    pass\nfinally:\n    pass\n", "x = (yield)\n", "@d(1)\nclass A[T](B, metaclass=C): pass\n", "lambda *a, b=1: (a, b)\n", "if x:\n\ty = 1\n", "print(*a, sep='')\n", "d = {**a, 'b': 1}; s = {*a, 2}\n", "'''doc\n<<<<<<< HEAD\n'''\n", "with (open(a) as b, open(c) as d):\n    pass\n", "x: int\na.b[c]: str = 'd'\nx, *y = z = 1, 2\n", "if (n := 10) > 5: pass", "a[1:2, ::3, ...]\n", "assert x, 'm'\nraise E from None\nglobal q\ndel a[0], b\n", "# only a comment", "x = not -1 ** 2 if a is not b else c not in d\n"],
    "go": ["package a\n", 'package a\nimport (\n\t"fmt"\n\tx "y"\n)\nfunc f[T any](a, b int, c ...string) (x T, err error) {\n\tfor i, v := range m {\n\t\tif v, ok := s[i]; ok && v > 1 {\n\t\t\treturn\n\t\t}\n\t}\n\tswitch t := x.(type) {\n\tcase int, *string:\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\n}\n', 'package a\ntype S struct {\n\tA, B int `json:"a"`\n\t*T\n}\ntype I interface {\n\tM(int) error\n\t~int | string\n}\nvar m = map[string][]int{"a": {1, 2}, "b": nil}\nconst (\n\tA = iota\n\tB\n)\nvar x = []S{{A: 1}, {B: 2}}\nfunc (s *S) F() { defer func() {}(); L: for { break L } }\n'],
    "java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B & C> extends D<T> implements E {\n  private final int[] x = {1, 2};\n  static { y(); }\n  A() { this(1); }\n  <R> R m(List<? super T> l, int... z) throws X { for (int i = 0; i < 3; i++) { if (i > 1) continue; } return (R) l.get(0); }\n}\n", "record P(int a, String b) { P { if (a < 0) throw new E(\"x\"); } }\nsealed interface S permits P, Q {}\nenum G { A(1) { void f() {} }, B; int v; }\n", "class A { int f(Object o) { return switch (o) { case P(int a, var b) when a > 1 -> a; case String s -> { yield 1; } case null, default -> 0; }; } void g() { Runnable r = () -> {}; list.stream().map(A::new).toList(); var t = \"\"\"\n x\n\"\"\"; int[][] q = new int[3][]; try (var z = open()) { } catch (A | B e) { } finally { } } }"],
    "js": ["const {a, b: [c], ...d} = e ?? {};\n", "class A extends B { #x = 1; static y; get z() { return this.#x } async *g() { yield* h() } static { } }", "for (const [k, v] of m) if (k) continue; else break\nlabel: for (;;) { break label }", "export default async (x) => ({...x, y: x?.z?.[0]?.()})", "import a, {b as c} from 'd'\nexport * as e from 'f'\nexport {c as default}", "const t = `a${b ? `c${d}` : 'e'}f`", "x = y / 2 / z; r = /a[/]b/g.test(s)", "a\n  .b()\n  .c\nlet d = 1", "switch (x) { case 1: { y() } default: z() }", "try { a } catch { b } finally { c }", "async function f() { for await (const x of y) await x }", "var f = function* () {}, g = class {}", "if (a) { b } else if (c) d; else { e }", "new A(...b).c; new (d())()", "({ get a() { return 1 }, set a(v) {}, async b() {}, [c]: 1, 'd': 2, 3: 4, e })"],
    "jsx": ["const a = <div className='x' {...p}>{b.map((c) => <p key={c}>text {c} more</p>)}<br/></div>", "const f = () => (<>\n  <A.B c={1}>it is text, 2 of it</A.B>\n</>)"],
    "ts": ["interface A<T = {}> extends B { readonly a?: string; [k: string]: unknown; m<U>(x: U): void; new (): A }", "type M = { [K in keyof T as `x${K}`]?: T[K] extends (infer U)[] ? U : never } & (() => void)", "export abstract class A<T> implements B { constructor(private readonly x: number = 1, public y?: string) { super() } abstract f(): Promise<T>; declare z: any }", "function f(this: A, x?: number, ...y: string[]): x is string { return y as unknown as boolean }", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nnamespace N.O { }", "import type { A } from 'b'; import { type C, D } from 'e'; export type { A }", "let x = a!.b satisfies C; const y = <T,>(z: T): T => z; let w = <any>v", "function g(a: string): void;\nfunction g(a: any) {}", "const m: Map<string, Array<{ a: number }>> = new Map<string, Array<{ a: number }>>();"],
    "tsx": ["export const A = ({ a }: { a: string }) => <p className='x'>{a as string}</p>;"],
}
BAD = {
    "py": ["def f(:\n    pass", "if x\n    y", "print 'a'", "except ValueError, e:\n  pass", "x = 'a", "  x = 1\n y = 2", "(a", "a = = b", "f'{a'", "<<<<<<< HEAD\nx = 1", "def f():\n", "class A:\npass", "404: Not Found", "f() = 1", "if a:\n\tb\n        c\n", "x = 1_", "import { a } from 'b';", "try:\n    a\n"],
    "go": ["func f() {}", "package a\nfunc f( {\n}\n", "package a\nvar x = []int{1\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "@@ -1,2 +3,4 @@\n", "package a\nimport \"b\"\nclass A {}\n"],
    "java": ["class A {", "class A { int f() { return 1 } }", "class A { void f() { x + 1; } }", "404: Not Found", "class A { void f( { } }", "def f():\n    pass", "class A { String s = \"a; }"],
    "js": ["const x;", "function f( { }", "const a = {b: 1", "x = `a${b`", "let a: string = 1", "<html></html>", "import a from", "if (a { }", "=======", "class A { b c }", "return => 1", "a b"],
    "jsx": ["const a = <div><p></div>", "const a = <div>{b</div>"],
    "ts": ["const a = <div>x</div>;\nconst b = <p/>;", "interface A { a: }", "let x: Array<string = 1"],
    "tsx": ["const a = <div>"],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert P.valid(text, ext)
    assert P.valid(text.replace("\n", "\r\n"), ext)


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(ext, text):
    assert not P.valid(text, ext)
    line, cause = P.failure(text, ext)
    assert 1 <= line <= text.count("\n") + 1 and cause


def test_python_against_the_interpreter():
    warnings.simplefilter("ignore")
    import glob
    import os

    names = sorted(glob.glob(os.path.join(os.path.dirname(os.__file__), "*.py")))[:120]
    for name in names:
        text = open(name, encoding="utf-8", errors="replace").read()
        try:
            ast.parse(text, feature_version=(3, 12))
            ok = True
        except SyntaxError:
            ok = False
        assert P.valid(text, "py") == ok, name
        # A file cut in the middle of a bracket or block.
        half = text[: len(text) // 2]
        try:
            ast.parse(half, feature_version=(3, 12))
            ok = True
        except SyntaxError:
            ok = False
        assert P.valid(half, "py") == ok, name


def test_positions():
    assert P.failure("package a\n\nfunc f() {\n\tx := (1\n}\n", "go")[0] in (4, 5)
    assert P.failure("x = 1\ny = (\nz = 2\n", "py")[1] in ("truncated", "syntax")
    assert P.failure("const a = 1;\n<<<<<<< HEAD\nconst b = 2;\n=======\n>>>>>>> x\n", "ts") == (2, "conflict")
    assert P.failure("def f():\n    pass\n", "js")[1] == "language"
    assert P.failure("@@ -1,2 +3,4 @@\n a\n", "java")[1] == "patch"


def test_deep_nesting():
    assert P.valid("x = " + "(" * 150 + "1" + ")" * 150, "py")
    assert P.valid("x = " + "[" * 9000 + "]" * 9000, "js")  # deeper than Python's own limit of calls
    assert P.valid("var x = " + "{a:" * 2000 + "1" + "}" * 2000, "js")


def test_frame(spark):
    rows = [("r", 1, "a.py", "x = 1", "clash"), ("r", 2, "A.PY", "x = (", "c"), ("r", 2, "A.PY", "x = (", "c"), ("r", 3, "a.txt", "x = (", "c"), ("r", 4, None, "(", "c"), ("r", 5, "a.py", None, "c"), ("r", 6, "a.go", "", "c"), (None, None, "a.js", "(", "c")]
    df = spark.createDataFrame(rows, "review_id string, file_seq int, path string, content string, language string")
    assert sorted((r.review_id or "", r.file_seq or 0) for r in P.invalid_files(df).collect()) == [("", 0), ("r", 2)]
    assert P.invalid_files(df.limit(0)).count() == 0
    rates = P.rates(df, spark.createDataFrame([("r", "repo")], "review_id string, repo string")).collect()
    assert {(r.repo, r.language, r.n_files, r.n_invalid) for r in rates} == {("repo", "python", 2, 1), (None, "javascript", 1, 1)}


def test_forms_that_python_refuses():
    for bad in ("f(x for x in y, 1)", "f(x for x in y,)", "class A(x for x in y): pass", "def f(*): pass", "def f(*, **k): pass", "lambda *: 1", "0777", "'a' b'c'", "a = b := 1", "x := 1"):
        assert not P.valid(bad + "\n", "py"), bad
    for good in ("f(x for x in y)", "f((x for x in y), 1)", "class A(B, metaclass=C): pass", "def f(*, a, **k): pass", "lambda *, a: 1", "00 + 0_0 + 0777.5 + 0777e1 + 07j", "b'a' rb'c' Rb''", "'a' r'c' f'{x}'", "print(a := 1, b)", "[y := 1, y**2]", "{y := 1}", "(y := 1)", "x[y := 1]", "f'{(x := 1)!r}'", "if (n := 10) > 5: pass", "while chunk := f(): pass"):
        assert P.valid(good + "\n", "py"), good


def test_failures_of_large_files_are_found_in_one_pass():
    import time

    py = "\n".join(f"def f{i}():\n    if x:\n        return {i}" for i in range(15_000)) + "\nelse:\n    pass\n" + "x = 1\n" * 100
    go = "package a\n" + "\n".join(f"func f{i}() int {{ if x {{ return {i} }}; return 0 }}" for i in range(15_000)) + "\nfunc ( {\n"
    for text, ext, line in ((py, "py", 45_001), (go, "go", 15_002)):
        P.valid(text, ext)
        t = time.time()
        found = P.failure(text, ext)
        assert found[0] == line and time.time() - t < 20, (ext, found, time.time() - t)


def test_deep_nesting_is_followed():
    n = 3000
    assert P.valid("x = " + "[" * 150 + "]" * 150 + "\n", "py")
    assert P.valid("let x = " + "(" * n + "1" + ")" * n + ";", "js")
    assert P.valid("class A { int f() { return " + "(" * n + "1" + ")" * n + "; } }", "java")
    assert not P.valid("let x = " + "(" * n + "1" + ")" * (n - 1) + ";", "js")
