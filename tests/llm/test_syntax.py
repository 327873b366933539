import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import syntax as S
from corpusloom.llm.gll import Grammar

VALID = {
    "go": ["package a\n", "// c\npackage a\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tf func(int) (string, error)\n}\n\ntype I interface {\n\tM(a int) error\n\t~int | ~string\n}\n\nfunc (t *T) F(xs ...int) (n int, err error) {\n\tfor i, x := range xs {\n\t\tif v, ok := m[x]; ok && v > 2 {\n\t\t\tcontinue\n\t\t} else if x == 'a' {\n\t\t\tbreak\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\t\treturn\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-c:\n\t\t_ = v\n\t}\n\tgo func() { defer close(c) }()\n\ta := map[string][]int{\"x\": {1, 2}, `y`: nil}\n\tb := []T{{A: 1}, {}}\n\tx, y = y, x\n\tt.A++\nL:\n\tfor ; ; {\n\t\tgoto L\n\t}\n\treturn G[int](a[1:2], b...)\n}\n\nfunc G[K comparable, V any](k K) V { var v V; return v }\n", "package a\nconst (\n\tA = iota\n\tB\n)\nvar x, y = 1.5e3, 0x1F\n"],
    "rust": ["", "#![allow(x)]\nuse a::{b, c::*, self};\n\n/// d\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> where T: X { pub a: &'a [T], b: Option<Vec<u8>> }\nstruct U(u8, pub T);\nenum E { A, B(u8), C { x: i32 } = 3 }\nimpl<'a, T> Tr<T> for S<'a, T> where T: Fn(u8) -> u8 { type O = u8; const N: usize = 1;\n    fn f(&mut self, x: impl Into<String>) -> Result<(), Box<dyn Error + 'static>> {\n        let mut v = vec![1, 2];\n        let S { a, .. } = s else { return Ok(()) };\n        if let Some(x @ 1..=5) = y { z() } else if a < b && c > d { }\n        match e { E::A | E::B(_) if q => 1, E::C { x, .. } => { 2 } _ => unreachable!(), };\n        let c = move |a: u8, _| -> u8 { a };\n        'o: loop { break 'o; }\n        for i in (0..10).rev() { v[i] = !v[i] as u8 >> 2; }\n        let s = r#\"a \" b\"#; let ch = '\\''; let b = b\"x\\\"\";\n        x.iter().map(|x| x * 2).collect::<Vec<_>>()?;\n        unsafe { *p = 1 };\n        Ok(())\n    }\n}\nmacro_rules! m { ($($x:expr),*) => { $(f($x);)* }; }\nasync fn g() -> u8 { h().await?; 0 }\npub(crate) trait Q: A + B { fn x(&self); }\nmod z;\nstatic X: &str = \"a\n b\";\n/* a /* nested */ b */\n"],
    "typescript": ["", "import a, { type B, c as d } from \"x\";\nexport * from './y';\nexport type T<A extends keyof B = never> = { readonly [K in A]?: B[K] } | (string & {})[];\nexport interface I<T> extends J<T> { a?: number; m<X>(x: X): void; [k: string]: any; new (x: T): I<T>; }\nexport abstract class C<T> extends D<T> implements I, K {\n  private readonly x: Map<string, Array<number>> = new Map<string, Array<number>>();\n  static #p = 1;\n  constructor(public a: string, b?: number) { super(); }\n  get v(): number { return this.#p!; }\n  async *gen<T>(this: C<T>): AsyncGenerator<T> { yield* other(); }\n  @dec() method(): asserts x is string {}\n}\nenum E { A = 1, B = \"x\" }\ndeclare module \"m\" { export const z: number; }\nnamespace N.M { }\nconst f = async <T,>(x: T, ...r: any[]): Promise<T> => { for await (const y of x) { } return x as unknown as T; };\nlet y = x satisfies Y, z = <const V>(v: V) => v;\nfunction over(a: string): void;\nfunction over(a: any) {}\nlabel: for (let i = 0, n = a.length; i < n; i++) { if (a[i] >> 2 >= 3) continue label }\nconst t = `a ${b ? `c ${d}` : '}'} e`;\nconst re = /[/\\]]+(?<n>x)/gi.test(s) ? a?.[0]?.b ?? c : d!;\nexport default class {}\n"],
    "javascript": ["", "'use strict'\nvar a = 1\nvar assert = require('assert')\nlet { b, c: [d = 2, ...e], ...f } = g\nconst h = async x => await x, i = ({ a, [b]: c, get d() { return 1 }, async *e() {}, 'f': 1, ...g })\nif (a) b; else c\nfor (const k in o) ;\nfor (;;) break\ndo x++; while (x < 5)\nswitch (a) { case 1: case 2: b(); break; default: }\ntry { } catch { } finally { }\nclass A extends (B, C) { static { } x = 1; 'y'; static async *[z]() { super.z() } #p; get() {} }\nnew.target\nnew (foo())(1, ...a)\na ||= b ** c\nx = a ? b : c ? d : e\nreturnValue = function* () { yield }\nimport('x').then(({ default: y }) => y)\nlabel: { break label }\nvar re = a / b / c, s = /=/g\n`${a}${`${b}`}`\nexport { a as b, c as default }\nexport default function () {}\nimport def, * as ns from 'y'\n#!x".replace("\n#!x", ""), "#!/usr/bin/env node\nasync function f() { for await (const x of y) { } }\n"],
    "php": ["", "<html><?php if ($a): ?>\n<b><?= $x ?></b>\n<?php endif; ?>", "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\nuse function g\\h;\n#[Attr(1)]\nfinal class X extends Y implements Z, W {\n    use T { a as protected b; }\n    public const A = 1, B = self::A . 'x';\n    private ?int $x = null;\n    public function __construct(private readonly string|int $a = 'b', &...$rest) { parent::__construct(...$rest); }\n    abstract protected static function f(): static;\n}\nenum S: string { case A = 'a'; public static function g(): self { return self::A; } }\n$f = fn($x) => $x ** 2;\n$g = static function (array $a) use (&$b): ?array { yield $k => $v; };\n[$a, 'k' => [$b]] = $c;\nforeach ($a as $k => &$v) { continue 2; }\n$r = match(true) { $x > 1, $y => 'a', default => throw new E() };\necho \"a {$b->c[1]} $d\", <<<EOT\n  x {$y}\n  EOT, PHP_EOL;\n$o?->p->{$q}()::R;\n$x = (int) $y ?: $z ?? $w;\nswitch ($a) { case 1: break; default: }\ntry { } catch (A|B $e) { } finally { }\n$c = new class(1) extends D { };\nstatic $n = 0; global $m;\nwhile (true): break; endwhile;\n// end ?>"],
    "python": ["", "\n\n# c\n", "import a.b as c, d\nfrom .. import (e, f as g,)\n@dec(1)\nasync def f(a, /, b: int = 1, *args, c, **kw) -> 'x':\n\t\"\"\"d\"\"\"\n\tasync with a as b, c: pass\n\treturn [x async for x in y if x], {**a, 'b': 1}, {*a}, (yield)\nclass A(B, metaclass=C):\n    x: int = 1\n    def g(self): return lambda *a, k=1: a[1:2, ::3, ...]\nif (n := 10) > 5 and not a in b: pass\nelif x is not None: y = z = 1; del y\nelse:\n    raise E from None\ntry:\n    x += 1\nexcept* (A, B) as e: ...\nmatch x:\n    case {'a': [1, *r], **k} if r: pass\n    case A(b=1) | None as q: pass\n    case _: pass\nprint(f'a {b!r:>{w}}', r'\\d' \"x\" b'y', 0x_f, 1_000.5e-3j)\nx = a if b else c\nfor i, in y: break\nelse: continue_ = 1\ntype X[T: int] = list[T]\nassert (a,\n  b), \\\n  c\n"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    g = S.grammar(language)
    assert g.recognise(S._LEX[language](text, g)) == -1
    assert S.is_valid("\ufeff" + text.replace("\n", "\r\n"), language)


INVALID = {
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f() {\n", "def f(): pass", "package a\nfunc f() { x := \"abc\n}\n", "package a\n<<<<<<< ours\n", "import \"x\"\n", ""],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "fn f() {", "import x", "fn f() -> { }", "struct S { a: }", "fn f() { a b }", "<<<<<<< a\n", "fn f() { \"abc }"],
    "typescript": ["function f( {}", "const x = ;", "export class A {", "<?php echo 1;", "let x: = 1", "function {{ x }}() {}", "if (a { }", "<!DOCTYPE html>\n<html></html>", "=======\n"],
    "javascript": ["function f(a: number) {}", "interface A { b: string }", "const x = 'abc", "a b", "f(1", "export interface X {}", "`a ${b`", "a: b: {", "x = /abc\n"],
    "php": ["<?php function f( {}", "<?php $x = ;", "<?php class A {", "<?php echo 'abc", "<?php if ($a) {", "<?php foo bar;", "<?php\n<<<<<<< HEAD\n"],
    "python": ["def f(:\n  pass", "x = ", "if a:\nb", "  x = 1", "def f():\n    a\n  b\n", "print 'x'", "<?php", "a = (1", "'abc", "<<<<<<< a", "x y"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert not S.is_valid(text, language)


@pytest.mark.parametrize("language", ["go", "rust", "typescript", "javascript", "python"])
def test_truncations_are_invalid(language):
    text = max(VALID[language], key=len)
    assert sum(not S.is_valid(text[: len(text) * k // 40], language) for k in range(5, 39)) >= 20


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar("S = S S | 'a' | ; ", ["S"])
    assert [g.recognise([g.kinds["a"]] * n) for n in (0, 1, 7, 30)] == [-1] * 4
    e = Grammar("E = E '+' E | E '*' E | '(' E ')' | 'n' ; ", ["E"])
    k = e.kinds
    assert e.recognise([k[c] for c in "n+n*(n+n)"]) == -1 and e.recognise([k[c] for c in "n+*n"]) >= 0


@given(st.lists(st.sampled_from("ab()"), max_size=12))
@settings(max_examples=300, deadline=None)
def test_remembering_changes_nothing(word):
    text = "S = T* ; T = 'a' | 'a' 'b' | '(' T* ')' | T2 'b' ; T2 = 'a' 'a' | '(' ')' ; "
    plain, memo = Grammar(text, ["S"]), Grammar(text, ["S"], ["T", "T2"])
    w = [plain.kinds[c] for c in word]
    for _ in range(2):
        assert (plain.recognise(w) < 0) == (memo.recognise(w) < 0)


def test_deep_nesting():
    assert S.is_valid("x = " + "(" * 3000 + "1" + ")" * 3000 + ";", "javascript")
    assert not S.is_valid("{" * 5000, "javascript")
    assert S.is_valid("{" * 1000 + "}" * 1000, "javascript")


def test_rows(spark):
    df = spark.createDataFrame([("p", "a.py", "x = 1", 1), ("p", "b.py", "x = ", 1), ("p", "c.go", None, 1), ("p", "d.md", "(", 1), ("p", "e.js", "a(", 2), ("p", "e.js", "a()", 1), ("p", "f.ts", "", None), (None, "g.py", "x =", 1), ("q", "h", "(", 1)], "project_id string, path string, content string, updated_at long")
    assert rows(S.invalid(df)) == [("p", "b.py"), ("p", "c.go"), ("p", "e.js")]
    r = {(x.project_id, x.language): (x.files, x.invalid, x.rate) for x in S.rates(df).collect()}
    assert r["p", "python"] == (2, 1, 0.5) and r["p", "typescript"] == (1, 0, 0.0)
    assert S.invalid(df.limit(0)).count() == 0
