import pytest

from shelfmark.llm.syntax import errors_of

GOOD = {
    "python": ["@a.b(1)\nasync def f(x: int = 1, /, *y, z=2, **k) -> int:\n    '''doc'''\n    if (n := len(y)) > 1: return n\n    with a as b, c: pass\n    return [i async for i in x if i] or {**k, 'a': lambda q: q}\n", "match x:\n    case [1, *_]:\n        pass\n", "x = f'{a!r:>{w}}'\nprint(x, end='')\ntry:\n    pass\nexcept* E as e:\n    raise X from e\nfor a, *b in c: ...\nd: int\n", "def f():\n\tif x:\n\t\treturn (1,\n2)\n"],
    "javascript": ["import a, { b as c } from './x';\nexport default class A extends B { static #p = 1; get x() { return this.#p } async *g() { yield* h() } }\n", "const f = async ({ a = 1, ...r }, [b]) => ({ a, [b]: `${a + `${r}`}` })\nlet q = a / b / c, re = /[/]\\/x/g.test(s)\nfor (const [k, v] of m) if (k) break; else continue\nlabel: while (1) { x?.y?.[0]?.(1) ?? z }\n", "var o = { get a() { return 1 }, async b() {}, 'c': 1, d }\nx = y\n++z\ndo x++; while (x < 5)\n"],
    "typescript": ["interface A<T extends B = C> extends D<T> { readonly [k: string]: T; f?(x: number): void; new (): A }\ntype F<T> = T extends (infer U)[] ? U : keyof T;\nabstract class X<T> implements Y { constructor(private readonly a: string, b?: T) { super() } protected abstract m(): void; p!: Map<string, Array<number>> }\nfunction f<T,>(x: T, ...y: T[]): x is string { return <any>x as unknown as string }\nenum E { A = 1, B }\nconst g = <T>(x: T): T => x;\ndeclare module 'x' { export const y: number }\nlet z = a!.b satisfies C;\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class X<T extends Y & Z> extends W<T[]> implements V {\n  static { int[] a = {1, 2,}; }\n  enum E { A(1) { void f() {} }, B; E(int... x) {} }\n  record P(int x, String y) {}\n  <U> U f(final List<Map<String, ? super U>> l) throws E1, E2 {\n    for (int i = 0, j = 1; i < 3 && j >> 1 > 0; i++, j--) { l.stream().map(x -> x.<U>g()).forEach(System.out::println); }\n    String s = \"\"\"\n      text \"quoted\"\n      \"\"\";\n    int r = switch (x) { case 1, 2 -> 3; default -> { yield 4; } };\n    try (var a = b(); c) { } catch (A | B e) { } finally { }\n    if (o instanceof String t && !t.isEmpty()) return (U) new Object() { int y; }.y;\n    label: do { break label; } while (true);\n    int[][] q = new int[3][]; return (a < b) ? (U) c : d[0];\n  }\n}\n"],
    "c#": ["using System;\nusing X = Y.Z<int>;\nnamespace A.B;\n[Serializable] public partial class C<T> : D<T>, IE where T : class, new()\n{\n  public int P { get; private set; } = 1;\n  public string Q => $\"{P:N2} {{x}}\" + @\"a\"\"b\";\n  public static C<T> operator +(C<T> a, C<T> b) => a;\n  public C(int x) : base(x) { }\n  async Task<int?> F(out int y, params string[] z) {\n    var q = from a in z where a != null orderby a descending select new { a, N = a.Length };\n    if (o is string { Length: > 3 } s and not null) return x switch { 1 => 2, > 5 and < 9 => 3, _ => throw new E() };\n    foreach (var (k, v) in d) yield return k;\n    await using var f = G(); int[] r = { 1, 2 }; (int a, string b) t = (1, \"x\"); t.a++;\n    list?.ForEach(static x => { }); h[^1] = y ?? z![0..2]; d.TryGetValue(k, out var w); lock (m) { } goto end; end: return default;\n  }\n  public event EventHandler E; delegate void G(int x); enum H : byte { A = 1, B }\n}\n"],
    "c": ["#include <x.h>\n#define M(a) \\\n  do { a; } while (0)\ntypedef struct s { int a : 3; union { char *b; }; } T;\nstatic const T *f(int (*g)(void), T x[static 2], ...);\nint main(int argc, char **argv) {\n  T t = { .a = 1, [2] = 3 }, *p = &(T){0};\n  for (size_t i = 0; i < sizeof(T) / sizeof *p; ++i) { p->a ^= ~(unsigned)i << 2; }\n  switch (x) { case 'a': case 1 ... 3: break; default: goto end; }\n  do ; while (a ? b : c);\nend:\n  return printf(\"a\" \"b\" PRIu64, (long)x), 0;\n}\nint old(a, b) int a; char b; { return a; }\n"],
    "go": ["package a\n\nimport (\n\t\"x\"\n\t. \"y\"\n)\n\ntype T[K comparable, V any] struct {\n\t*E\n\tA, B map[string][]func(int) (x int, err error) `json:\"a\"`\n}\n\ntype I interface {\n\tM(...int) <-chan T[int, string]\n\t~int | string\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (n int, err error) {\n\tif x, ok := m[k]; !ok {\n\t\treturn\n\t} else if y == (T{}) {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i, v := range []int{1, 2,\n\t} {\n\t\tselect {\n\t\tcase v, ok := <-ch:\n\t\tdefault:\n\t\t}\n\t\tswitch t := v.(type) {\n\t\tcase int, []string:\n\t\t\tfallthrough\n\t\tcase nil:\n\t\t}\n\t\ta[i], b = b[1:2:3], &T{A: map[string]int{\"a\": 1}}\n\t\tdefer f(x...)\n\t}\nL:\n\tfor {\n\t\tbreak L\n\t}\n}\n"],
    "ruby": ["# c\nrequire 'x'\nmodule A\n  class B < C::D\n    attr_accessor :a, :b\n    X = %w[a b].freeze\n    def f(a, b = 1, *c, d:, e: 2, **g, &h)\n      @a ||= a.map { |x, (y, z)| x + y }.select(&:ok?)\n      puts \"#{a[\"k\"]} #{b}\" if a && !b\n      return nil unless h\n      case a\n      when 1, 2 then x = 3\n      else y\n      end\n      while i < 3 do i += 1 end\n      z = a ? b : c\n      t = <<~EOS\n        text end if\n      EOS\n    rescue E, F => e\n      raise\n    ensure\n      close\n    end\n    def self.g = 1\n    private def h? = true\n  end\nend\nfoo.each do |x|\n  yield x, key: 1\nend\n[1, 2].inject(0) { |s, x| s + x } .to_s =~ /a\\/b/\n->(x) { x }.call 1\n"],
    "json": ['{"a": [1, -2.5e3, true, null, {"b": "\\u00e9\\n"}]}', "[]", ' "x" '],
}
BAD = {
    "python": ["def f(x)\n    pass\n", "print 'x', 1\n", "x = (1,\n", "<<<<<<< HEAD\na = 1\n=======\n", "if x:\ny = 1\n", "a = &quot;x&quot;\n", "class A:\n    def f(self):\n        '''doc"],
    "javascript": ["function f( { \n", "const x = ;\n", "if (a &lt; b) { }\n", "class A { f() { }\n", "let s = 'abc\n", "a b c\n", "=======\n", "function f(x: number) { }\n"],
    "typescript": ["let x: = 1;\n", "interface A { x: number\n", "function f(a: string { }\n", "import { a } frm './b';\n"],
    "java": ["class A { void f() { int x = 1 } }\n", "class A { void f() { x + 1; } }\n", "def f(): pass\n", "class A { int f( { return 1; } }\n", "class A { } }\n", "class A { String s = \"x; }\n"],
    "c#": ["class A { void F() { int x = 1 } }\n", "class A { void F() { G(; } }\n", "class A { public int { get; } }\n", "namespace A { class B { }\n"],
    "c": ["int f(void) { return 1 }\n", "int f(void) { if (x { } }\n", "from x import y\n", "int f(void) {\n", "int x = \"a;\n"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nvar x = []int{1, 2\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nx := 1\n"],
    "ruby": ["def f\n  1\n", "class A\nend\nend\n", "foo(1, 2\n", "x = [1, 2\n", "if a\n  b\n", "<<<<<<< ours\nx = 1\n=======\n"],
    "json": ["{'a': 1}", '{"a": 1,}', '{"a" 1}', '{"a": 1 "b": 2}', "{} {}", '{"a": NaN}', "// c\n{}"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert errors_of(language, text) == []
    assert errors_of(language, text.replace("\n", "\r\n")) == []


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(language, text):
    assert errors_of(language, text)


def test_all_errors_first_cause_first():
    e = errors_of("java", "class A {\n  void f() {\n    int x = 1 int;\n    y();\n    z(;\n  }\n}\n")
    assert [n for n, _ in e] == [3, 5]


def test_blank_unknown_and_long():
    assert errors_of("python", " \n") == errors_of("cobol", "x x x") == []
    assert errors_of("python", "x = 1\n" * 20_000) == []


@pytest.mark.parametrize(
    "language,text",
    [("javascript", "x = " + "(" * 300 + "1" + ")" * 300 + ";\nvar ) = ;\n"), ("c", "int f(void) " + "{" * 400 + "x = ;" + "}" * 400), ("json", "[" * 5000 + "]" * 4999), ("java", "class A { void f() " + "{" * 300 + "}" * 300 + " int ) }")],
)
def test_errors_behind_deep_nesting(language, text):
    assert errors_of(language, text)


def test_too_deep_is_no_verdict(spark):
    from shelfmark.llm.syntax import rates, verdicts

    deep = "x = " + "(" * 20_000 + "1" + ")" * 20_000 + ";\nvar ) = ;\n"
    assert errors_of("javascript", "f(" * 400 + ")" * 400) == errors_of("json", "[" * 5000 + "]" * 5000) == []
    assert errors_of("javascript", deep) is None
    f = spark.createDataFrame([(1, "r", "/a.js", "JavaScript", deep), (2, "r", "/b.js", "JavaScript", "x = 1"), (3, "r", "/c.js", "JavaScript", "x = ;")], "file_id long, repo_id string, path string, language string, content string")
    assert {r.file_id: r.n_errors for r in verdicts(f).collect()} == {1: None, 2: 0, 3: 1}
    assert [(r.files, r.invalid, r.unknown, r.accepted) for r in rates(f).collect()] == [(3, 1, 1, 0.5)]
