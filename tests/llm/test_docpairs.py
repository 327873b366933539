import pytest
from conftest import rows

from corpusloom.llm import docpairs as D

CASES = [
    ("go", "// Load reads the whole cache from disk.\nfunc (s *T) Load(a int) error {\n\treturn nil\n}", "Load", True),
    ("go", "// Load reads the whole cache from disk.\n\nfunc Load() {}", "Load", False),
    ("go", "//nolint:funlen,gocyclo\nfunc Load() {}", "Load", False),
    ("rs", "/// Gives up silently after 7 tries.\n#[inline]\n#[cfg(feature = \"x\")]\npub fn load<'a>(x: &'a str) -> u8 { 1 }", "load", True),
    ("rs", "// let x = match y {\n//     Some(z) => z.go(1),\n// };\npub fn load() {}", "load", False),
    ("py", '@cached\nasync def load(a,\n    b=")"):\n    """Reads the cache from the disk.\n\n    Args:\n        a: the words in here do not count.\n    """\n', "load", True),
    ("py", 'def load(a):\n    """Load.\n\n    Args:\n        a: the words in here do not count at all.\n    """\n', "load", False),
    ("py", "# keeps the order of all the rows\n@retry(3)\ndef load(a): pass", "load", True),
    ("py", "# pylint: disable=too-many-locals\ndef load(a): pass", "load", False),
    ("js", "/**\n * Reads the cache from the disk.\n * @param a the words\n */\nexport const load = async (a) => {};", "load", True),
    ("js", "/**\n * @param a the words in here do not count\n * @param b nor do these words count\n */\nexport async function load(a, b) {}", "load", False),
    ("ts", "// eslint-disable-next-line no-unused-vars\nasync load(a: string) {}", "load", False),
    ("php", "    /** This method does load user cache. */\n    public function loadUserCache($a)\n    {\n    }", "loadUserCache", False),
    ("php", "    /** Callers own whatever comes back. */\n    #[Pure]\n    public static function load() {}", "load", True),
    ("go", "// Missing documentation, please fill in.\nfunc Load() {}", "Load", False),
    ("go", "// TODO: write what this does with the cache\nfunc Load() {}", "Load", False),
    ("go", "// Documentation to be written later.\nfunc Load() {}", "Load", False),
    ("go", "func Load() {}", "Load", False),
    ("py", "# pull = [record.clone(x) for x in target if x]\n# rest = [digest.render(x) for x in pull if x]\ndef load(a): pass", "load", False),
    ("py", "# keeps all rows of the table in order (x = y)\ndef load(a): pass", "load", True),
]


@pytest.mark.parametrize("ext, text, name, telling", CASES)
def test_functions(ext, text, name, telling):
    f = D.first_function(text, ext)
    assert f is not None and f.name == name
    assert D.is_telling(D.description(f.doc), (name,)) is telling


def test_bodies_are_balanced():
    text = '// doc\nfunc A(s string) {\n\tx := "}" + `{` // {\n\tif x { y() }\n}\n\nfunc B() {}\n'
    assert D.function_code(text, "go") == text[: text.index("\n\nfunc B")]
    assert D.function_code("fn a<'x>(b: &'x str) { let c = '}'; }\nfn b() {}", "rs") == "fn a<'x>(b: &'x str) { let c = '}'; }"


def test_water_only():
    assert D.first_function("just text\n\n{ } ( \" unbalanced", "go") is None and D.first_function("", "py") is None


def test_rows(spark):
    good, bad = "// Reads the cache from the disk.\nfunc load() {}", "func load() {}"
    nodes = spark.createDataFrame([("a", "load", "function_declaration", None), ("b", "load", "function_declaration", "Keeps the order of all rows"), ("c", None, "function_declaration", "load"), ("d", "load", "class_declaration", "Keeps the order of all rows"), ("e", "x", "function_item", "Keeps the order of all rows"), ("a", "load", "function_declaration", None), (None, "x", "function_item", "Keeps the order of all rows")], "id string, name string, node_type string, docstring string")
    chunks = spark.createDataFrame([("a", "a.go", good, "n"), ("a", "a.go", good, "n"), ("b", "b.go", bad, "n"), ("c", "c.go", bad, "n"), ("d", "d.go", bad, "n"), ("z", "z.go", None, "n"), ("f", "f.txt", None, "n")], "id string, path string, content string, name string")
    assert rows(D.documented(nodes, chunks)) == [("a",), ("b",)]
    got = {r.id: r for r in D.pairs(nodes, chunks).collect()}
    assert got["a"].description == "Reads the cache from the disk." and got["b"].code == bad and got["a"].name == "load"
    assert D.documented(nodes.limit(0), chunks).count() == 0 and D.documented(nodes, chunks.limit(0)).count() == 0


def test_very_long(spark):
    text = "x" * 300_000 + "\n// Reads the cache from the disk.\nfunc load() {" + "{}" * 50_000 + "}"
    f = D.first_function(text, "go")
    assert f.name == "load" and len(D.function_code(text, "go")) > 100_000
