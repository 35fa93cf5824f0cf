"""Long comments, strings and headings, and deep brackets, in every language."""

import pytest

from graphweft.extract import extract

LONG = 100_000
LINES = "// note\n" * 6_000
DEEP = "a = g(h(i(j(k(1)))))"

FILES = {
    "block.rs": "/* " + "x" * LONG + " */\nfn after() { call(); }\n",
    "lines.rs": LINES + "fn after() {}\n" + "#[attr(x)]\n" * 5_000 + "struct Last { a: Foo }\n",
    "string.rs": 'const A: &str = "' + "y" * LONG + '";\nfn after() {}\n',
    "block.c": "/* " + "x\n" * (LONG // 2) + " */\nint after(void) { return call(); }\n",
    "lead.cpp": "class A {\n" + "public:\n" * 5_000 + LINES + "  void m() {}\n};\nint after() { return 0; }\n",
    "head.cpp": "class B : public A { void m(" + "int a, " * 5_000 + "int z) const { call(); } };\n",
    "lines.py": "def f():\n" + "    # note\n" * 6_000 + '    """Doc."""\n    call()\n',
    "doc.py": 'def f():\n    """' + "d" * LONG + '"""\n    call()\n',
    "deep.py": f"def f({DEEP}): return call()\n",
    "block.js": "/* " + "x" * LONG + " */\nfunction after() { call(); }\n",
    "deep.js": f"function f({DEEP}) {{ call(); }}\nclass C {{ m({DEEP}) {{}} }}\nconst g = ({DEEP}) => 1;\n",
    "tabs.js": "let a = 1" + "\t" * 200 + "\nlet b = 2" + " " * 200 + "\nconst c = 3\n",
    "deep.ts": f"function f({DEEP}): Out {{ return 1; }}\n",
    "attr.html": '<section id="x" title="' + "t" * LONG + '"><form id="y">z</form></section>',
    "long.css": "/* " + "x" * LONG + " */\n.a { color: red; }\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, source string").repartition(8)
    entities, _ = extract(files)
    return {(e["file_path"], e["name"]): e for e in entities.collect()}


def test_all_files_survive(found):
    for path in FILES:
        assert (path, path) in found


@pytest.mark.parametrize("path", ["block.rs", "lines.rs", "string.rs", "block.c", "lead.cpp", "block.js"])
def test_what_follows_is_found(found, path):
    assert found[path, "after"]["kind"] == "Function"


def test_the_rest(found):
    assert found["lines.rs", "Last"]["kind"] == "Struct"
    assert found["lead.cpp", "m"]["kind"] == "Method" and found["head.cpp", "m"]["kind"] == "Method"
    assert found["lines.py", "f"]["doc_comment"] == '"""Doc."""' and len(found["doc.py", "f"]["doc_comment"]) == LONG + 6
    assert {"a", "b", "c"} <= {name for path, name in found if path == "tabs.js"}
    assert any(p == "long.css" and e["kind"] == "CssRule" for (p, _), e in found.items())
    assert sum(p == "attr.html" and e["kind"] == "HtmlElement" for (p, _), e in found.items()) == 2


def test_lists_of_any_depth(found):
    assert found["deep.js", "f"]["signature"] == f"function f({DEEP})"
    assert found["deep.js", "m"]["signature"] == f"m({DEEP})"
    assert found["deep.js", "g"]["signature"] == f"const g = ({DEEP})"
    assert found["deep.ts", "f"]["signature"] == f"function f({DEEP}): Out"
    assert found["deep.py", "f"]["signature"] == f"def f({DEEP})"
