"""Facts that each language's extraction must show, on snippets of our own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphweft.extract import braces, core, corpus, extract, rust
from graphweft.plans.extract_queries import style_blocks

FILES = {
    "src/m.rs": '''//! crate doc
use crate::{a::B,
   c};
pub use x::y;

/// Adds one.
/// Second line }
pub(crate) async fn add(a: [u8; 4], b: &'a str) -> Result<T> {
    let x = foo(1); // call bar(
    obj.method("str } {", 'c').other();
    a::b::<T>(2); path::to(3);
    println!("x");
}
/// gone
#[derive(Debug)]
pub struct P<T> {
    pub a: u32,
    b: Foo,
    c: HashMap<K, V>,
}
pub struct U(u32);
enum E { A, B(u32, String), C { x: u8, y: Z } }
trait Shape: Base + Clone { fn area(&self) -> f64; fn d(&self) { self.area(); } }
impl std::fmt::Display for P { fn fmt(&self) -> R { write(1) } }
impl<T> P<T> { fn skipped() {} }
impl P { pub fn new() -> Self { P { a: 1 } } }
type Al = Vec<u8>;
macro_rules! mac { () => { fn no() {} }; }
mod inner {
    /** Block doc */
    fn deep() { inner_call(); }
    const K: u32 = 3;
}
static mut S: Foo = Foo { a: 1 };
''',
    "a.c": '''#include <stdio.h>
#include "a.h"
#define MAX 10
/* int no(void) { } */
int add(int a, int b) {
    printf("x {", a); return obj.f(a) + p->g(b);
}
static char *dup(const char *s) { return s; }
void proto(int x);
char *pp(int);
static const int K = 3;
int g, arr[3];
struct Point { int x; struct Foo *p; double y; };
struct Fwd;
enum Color { RED, GREEN = 2, BLUE };
typedef struct { int a; } Anon;
typedef unsigned int u32;
union U { int i; float f; };
''',
    "b.cpp": '''#include <vector>
namespace geo {
class Shape { public: virtual double area() const = 0; virtual ~Shape() {} int id; };
class Circle : public Shape, private ns::Base {
 public:
  Circle(double r) : r_(r) { init(); }
  double area() const override { return std::sqrt(r_); }
 private:
  double r_;
};
namespace { int hidden = 1; }
}
template <typename T> T twice(T x) { return x; }
extern "C" { int cfun(void) { return 1; } }
enum class E : int { A, B };
''',
    "c.js": '''import React, { useState } from 'react';
import './side.css';
export default class App extends Base {
  count = 0;
  #secret = 1
  static async load(x) { await fetch(x); }
  constructor(a) { super(a); this.init(a); }
  #hid() { return 1 }
  get v() { return this.x }
}
async function go(a, b = foo(1)) { run(a); new Thing(b); obj.m.n(); }
const add = (a, b) => a + plus(b);
const run = async (x) => { await go(x); };
let counter = 0
var old = function (q) { return q; };
export const K = { a: 1, b: 2 };
if (x) { const inner = 1; }
const { d } = K;
var one = f(1, 2), two = [3, 4],
  three = (a, b) => { go(a); }, four;
''',
    "d.ts": '''interface Shape extends Base, Other { area(): number; name: string; cb: (a: number) => void }
export interface Two { readonly x?: number }
type ID = string | number;
enum Color { Red, Green = 'g', Blue }
class Impl extends Base implements Shape { private z: number = 1; area(): number { return calc(this.z); } }
export function f(x: number): Promise<void> { return g(x); }
''',
    "p/e.py": '''"""Module doc
def no(): pass
"""
import os, sys as system
from pathlib import Path
from typing import (List,
    Optional as Opt)
from . import sibling
MAX_N = 3
value2: int = 4
if True:
    inner = 1

class Animal(Base, pkg.Other, metaclass=Meta):
    """Doc"""
    kind = "x"

    def __init__(self, name: str = "a)"):
        self.name = name

    @property
    @app.route("/x", 1)
    def _speak(self) -> str:
        # comment
        \'\'\'Say it.
        More: here
        \'\'\'
        def inner(): return helper(1)
        return self.make(f(2), [
            g(3)])

    def __hidden(self): return 1


async def fetch(url,
                n=(1, 2)) -> dict:
    """Fetch."""
    await get(url)


x += 1
a, b = 1, 2
''',
    "i.html": '''<!DOCTYPE html>
<html>
<head>
  <meta charset="utf-8">
  <link rel="stylesheet" href="s.css">
  <script src="app.js" id="s1"></script>
  <script>var t="</p><main>";</script>
</head>
<body>
 <!-- <nav> hidden
 -->
 <main id="top"><div><section>hi
 </section></div></main>
</body>
</html>
''',
    "s.css": '''@import "base.css";
@import url('theme.css');
/* c { } */
body { margin: 0; }
h1, .a > b,
  :is(p, q) { color: red }
@media (max-width: 600px) {
  .x { a: b }
}
@keyframes spin { from { a: b } to { c: d } }
@supports (display: grid) { .g { display: grid } }
''',
    "notes.txt": "fn not_routed() {}",
}


@pytest.fixture(scope="module")
def graph(spark):
    entities, relationships = extract(spark.createDataFrame(list(FILES.items()), "path string, source string"))
    return {e.qualified_name: e for e in entities.collect()}, relationships.collect()


def targets(graph, rel_type, from_qn):
    return sorted(r.to_qn for r in graph[1] if r.rel_type == rel_type and r.from_qn == from_qn)


def kinds(graph, path):
    return {qn[len(path) + 2 :]: e.kind for qn, e in graph[0].items() if e.file_path == path and e.kind != "File"}


def test_unrouted_file_gives_nothing(graph):
    assert not [e for e in graph[0].values() if e.file_path == "notes.txt"]


def test_rust_kinds(graph):
    assert kinds(graph, "src/m.rs") == {
        "add": "Function",
        "P": "Struct",
        "U": "Struct",
        "E": "Enum",
        "Shape": "Trait",
        "Shape::d": "Method",
        "impl Display for P": "Impl",
        "P::fmt": "Method",
        "impl P": "Impl",
        "P::new": "Method",
        "Al": "TypeAlias",
        "mac": "Macro",
        "inner": "Module",
        "inner::deep": "Function",
        "inner::K": "Constant",
        "S": "Static",
    }


def test_rust_function(graph):
    add = graph[0]["src/m.rs::add"]
    assert (add.visibility, add.is_async, add.line_start, add.line_end) == ("pub(crate)", True, 8, 13)
    assert add.doc_comment == "Adds one.\nSecond line }"
    assert add.signature == "pub(crate) async fn add(a: [u8; 4], b: &'a str) -> Result<T>"
    assert targets(graph, "CALLS", "src/m.rs::add") == ["foo", "method", "other", "path::to"]


def test_rust_doc_stops_at_attribute_and_block_doc_counts(graph):
    assert graph[0]["src/m.rs::P"].doc_comment is None
    assert graph[0]["src/m.rs::inner::deep"].doc_comment == "Block doc"


def test_rust_edges(graph):
    assert targets(graph, "HAS_FIELD", "src/m.rs::P") == ["Foo"]
    assert targets(graph, "HAS_VARIANT", "src/m.rs::E") == [f"src/m.rs::E::{v}" for v in "ABC"]
    assert targets(graph, "EXTENDS", "src/m.rs::Shape") == ["Base", "Clone"]
    assert targets(graph, "IMPLEMENTS", "src/m.rs::impl Display for P") == ["Display"]
    assert targets(graph, "IMPL_FOR", "src/m.rs::impl P") == ["P"]
    assert targets(graph, "IMPORTS", "src/m.rs") == ["crate::{a::B,\n   c}", "pub use x::y"]
    # A method hangs under its type, not under the implementation.
    assert targets(graph, "CONTAINS", "src/m.rs::P") == ["src/m.rs::P::fmt", "src/m.rs::P::new"]


def test_rust_statement_keeps_its_semicolon(graph):
    assert graph[0]["src/m.rs::S"].source_text == "static mut S: Foo = Foo { a: 1 };"


def test_c_kinds(graph):
    assert kinds(graph, "a.c") == {
        "MAX": "Preprocessor",
        "add": "Function",
        "*dup(const char *s)": "Function",
        "proto": "Function",
        "K": "Constant",
        "g": "Variable",
        "Point": "Struct",
        "Fwd": "Struct",
        "Color": "Enum",
        "Anon": "Typedef",
        "u32": "Typedef",
        "U": "Union",
    }


def test_c_edges(graph):
    assert targets(graph, "IMPORTS", "a.c") == ['"a.h"', "<stdio.h>"]
    assert targets(graph, "CALLS", "a.c::add") == ["obj.f", "p->g", "printf"]
    assert targets(graph, "HAS_VARIANT", "a.c::Color") == ["a.c::Color::BLUE", "a.c::Color::GREEN", "a.c::Color::RED"]
    assert targets(graph, "HAS_FIELD", "a.c::Point") == ["double", "int"]


def test_cpp_classes_and_namespaces(graph):
    assert kinds(graph, "b.cpp") == {
        "geo": "Namespace",
        "geo::Shape": "Class",
        "geo::Shape::area": "Method",
        "geo::Shape::~Shape": "Method",
        "geo::Circle": "Class",
        "geo::Circle::Circle": "Method",
        "geo::Circle::area": "Method",
        "geo::anonymous": "Namespace",
        "geo::anonymous::hidden": "Variable",
        "twice": "Function",
        "cfun": "Function",
        "E": "Enum",
    }
    assert targets(graph, "EXTENDS", "b.cpp::geo::Circle") == ["Shape", "ns::Base"]
    assert targets(graph, "CALLS", "b.cpp::geo::Circle::area") == ["std::sqrt"]


def test_js_kinds(graph):
    assert kinds(graph, "c.js") == {
        "App": "Class",
        "App::count": "Property",
        "App::#secret": "Property",
        "App::load": "Method",
        "App::constructor": "Constructor",
        "App::#hid": "Method",
        "App::v": "Method",
        "go": "Function",
        "add": "Function",
        "run": "Function",
        "counter": "Variable",
        "old": "Function",
        "K": "Constant",
        "inner": "Constant",
        "one": "Variable",
        "two": "Variable",
        "three": "Function",
        "four": "Variable",
    }


def test_js_declarators(graph):
    texts = {n: (graph[0][f"c.js::{n}"].source_text, graph[0][f"c.js::{n}"].line_start) for n in ("one", "two", "three", "four")}
    assert texts == {"one": ("one = f(1, 2)", 19), "two": ("two = [3, 4]", 19), "three": ("three = (a, b) => { go(a); }", 20), "four": ("four", 20)}
    assert targets(graph, "CALLS", "c.js::three") == ["go"]


def test_js_details(graph):
    assert graph[0]["c.js::go"].is_async and graph[0]["c.js::run"].is_async and graph[0]["c.js::App::load"].is_async
    assert graph[0]["c.js::App::#hid"].visibility == "private"
    assert graph[0]["c.js::add"].signature == "const add = (a, b)"
    assert graph[0]["c.js::go"].signature == "function go(a, b = foo(1))"
    assert targets(graph, "IMPORTS", "c.js") == ["./side.css", "react"]
    assert targets(graph, "EXTENDS", "c.js::App") == ["Base"]
    assert targets(graph, "CALLS", "c.js::go") == ["obj.m.n", "run"]
    assert targets(graph, "CALLS", "c.js::add") == ["plus"]


def test_ts(graph):
    found = kinds(graph, "d.ts")
    assert {n for n, k in found.items() if k == "Interface"} == {"Shape", "Two"}
    assert found["Shape::area"] == "Method" and found["Shape::name"] == found["Shape::cb"] == "Property"
    assert (found["ID"], found["Color"], found["Impl::z"]) == ("TypeAlias", "Enum", "Property")
    assert targets(graph, "EXTENDS", "d.ts::Shape") == ["Base", "Other"]
    # The heading of a typed class wraps its base, so it gives no edge.
    assert targets(graph, "EXTENDS", "d.ts::Impl") == []
    assert graph[0]["d.ts::f"].signature == "function f(x: number): Promise<void>"


def test_python_kinds(graph):
    assert kinds(graph, "p/e.py") == {
        "MAX_N": "Constant",
        "value2": "Variable",
        "inner": "Variable",
        "Animal": "Class",
        "Animal::kind": "Variable",
        "Animal::__init__": "Constructor",
        "Animal::_speak": "Method",
        "Animal::__hidden": "Method",
        "fetch": "Function",
    }


def test_python_details(graph):
    entities = graph[0]
    assert (entities["p/e.py::Animal"].line_start, entities["p/e.py::Animal"].line_end) == (14, 32)
    assert entities["p/e.py::Animal::__init__"].visibility == "pub(crate)"
    assert entities["p/e.py::Animal::__hidden"].visibility == "private"
    assert entities["p/e.py::Animal::_speak"].doc_comment.startswith("'''Say it.")
    assert entities["p/e.py::Animal::_speak"].signature == "def _speak(self) -> str"
    assert entities["p/e.py::fetch"].is_async
    assert targets(graph, "EXTENDS", "p/e.py::Animal") == ["Base", "pkg.Other"]
    assert targets(graph, "USES_TYPE", "p/e.py::Animal::_speak") == ['app.route("/x", 1)', "property"]
    assert targets(graph, "CALLS", "p/e.py::Animal::_speak") == ["f", "g", "helper", "self.make"]
    assert targets(graph, "IMPORTS", "p/e.py") == ["List", "Optional", "Path", "os", "pathlib", "sibling", "sys", "typing"]


def test_html(graph):
    names = {e.name for e in graph[0].values() if e.kind == "HtmlElement"}
    assert names == {
        "<html>@L2",
        "<head>@L3",
        "<meta>@L4",
        "<link>@L5",
        "<script>@L6",
        "<script>@L7",
        "<body>@L9",
        "<main#top>",
        "<section>@L12",
    }
    top = "i.html::<html>@L2"
    assert targets(graph, "CONTAINS", f"{top}::<body>@L9::<main#top>") == [f"{top}::<body>@L9::<main#top>::<section>@L12"]
    assert sorted(r.to_qn for r in graph[1] if r.rel_type == "IMPORTS" and r.from_qn.startswith("i.html")) == ["app.js", "s.css"]
    section = graph[0][f"{top}::<body>@L9::<main#top>::<section>@L12"]
    assert section.source_text == "<section>hi\n </section>" and section.line_end == 13


def test_css(graph):
    found = kinds(graph, "s.css")
    rules = {n for n, k in found.items() if k == "CssRule"}
    assert rules == {"body", "h1, .a > b,\n  :is(p, q)", "@media@L7", "@media@L7::.x", "@keyframes spin", ".g"}
    selectors = {n.split("::", 1)[1] for n, k in found.items() if k == "CssSelector"}
    assert selectors == {"h1", ".a > b", ":is(p, q)"}
    assert targets(graph, "IMPORTS", "s.css") == ["base.css", "theme.css"]


def test_long_file_folds_in_chunks(spark):
    text = "".join(f"fn f{i}() {{ g{i}(); }}\n" for i in range(1500))
    entities, relationships = extract(spark.createDataFrame([("big.rs", text)], "path string, source string"), ("rust",))
    assert entities.where("kind = 'Function'").count() == 1500
    last = entities.where("name = 'f1499'").first()
    assert last.line_start == 1500
    assert relationships.where("rel_type = 'CALLS'").count() == 1500


def nested_mask(text):
    """A character-wise lexer for Rust: hidden text as blanks."""
    out, i, n = [], 0, len(text)

    def hide(j):
        nonlocal i
        out.append(re.sub(r"[^\n]", " ", text[i:j]))
        i = j

    while i < n:
        if text.startswith("//", i):
            j = text.find("\n", i)
            hide(n if j < 0 else j)
        elif text.startswith("/*", i):
            depth, j = 0, i
            while j < n:
                step = text[j : j + 2]
                depth += (step == "/*") - (step == "*/")
                j += 2 if step in ("/*", "*/") else 1
                if not depth:
                    break
            hide(j)
        elif m := re.compile(r'\br(#*)"').match(text, i):
            j = text.find('"' + m[1], m.end())
            hide(n if j < 0 else j + 1 + len(m[1]))
        elif m := re.compile(r'(?s)"(?:[^"\\]|\\.)*"?').match(text, i):
            hide(m.end())
        elif m := re.compile(r"'(?:\\[^'\n]*|[^'\\\n])'").match(text, i):
            hide(m.end())
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


NESTED = [
    "/* a /* b */ c */ fn after() {}",
    "/*/* x */*/y /* z */",
    '/* "open /* \' */ \\*/ // */ still\n*/ w',
    "/* //* deep */ */ v /* a /**/ b */ u",
    'let s = "/* no /* comment"; /* /* yes */ */ t',
    "let s = r#\"/* \" /* \"#; 'a' '\\'' &'a x // /* /* \n/* 1 /* 2 /* 3 */ */ */ end",
    'r"\\" /* /* */ */ "a\\"/*" b "\\\\" /* /**/',
    "a / b /* /* */ */ * c // d \\\n e /* /* */ */ f",
    "/* never /* closed */ fn gone() {}",
]


def test_nested_comments(spark):
    rng = random.Random(2)
    parts = ["/*", "*/", "//", "\n", '"', "\\", "'", "x", " ", "r#\"", '"#', "/", "*", "'a'", "fn"]
    texts = NESTED + ["/* " + "".join(rng.choices(parts[:2] + ["x", "\n", " ", "'", "\\"], k=12)) + " /* y" for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "source string").select("source", core.mask_nested(F.col("source")).alias("masked")).collect()
    assert {r.source: r.masked for r in rows} == {t: nested_mask(t) for t in texts}
    nests = spark.createDataFrame([(t,) for t in ["/* a */ /* b */", "/* a", "x */ /*", "/***/ y", *NESTED[:4]]], "t string")
    assert [r[0] for r in nests.select(F.col("t").rlike(core.NESTS)).collect()] == [False] * 4 + [True] * 4


FORMS = {
    "nest.rs": "/* a /* b */ c */\nfn after() {}\nfn more() { after(); }\n",
    "re.js": "const a = /[{\"]/;\nfunction f(x) { return /'{/.test(x) && x / 2 / g(x); }\nlet d = h / i / j;\nconst k = [1, /}/g, (/\\/{/)];\nfunction last() {}\n",
    "op.cpp": "struct V {\n  V& operator+=(const V& o) { return add(o); }\n  int operator()(int x) const { return call(x); }\n  V* operator->();\n  void* operator new(size_t n);\n};\nbool V::operator==(const V& o) { return eq(o); }\n",
    "dir.cpp": "#define TOP 1\nnamespace a {\nnamespace b {\n#define IN 2\n#include <x>\n}\n#define MID 3\n}\n#define END 4\nnamespace {\n#define ANON 5\n}\n",
    "dir.c": "int namespace_like;\n#define ONE 1\n",
}


def test_forms(spark):
    entities, edges = corpus.extract(spark.createDataFrame(list(FORMS.items()), "path string, source string"))
    names = {r.qualified_name: r.kind for r in entities.collect()}
    calls = {(r.from_qn, r.to_qn) for r in edges.where("rel_type = 'CALLS'").collect()}
    assert names["nest.rs::after"] == "Function" and ("nest.rs::more", "after") in calls
    assert {n for n in names if n.startswith("re.js::")} == {f"re.js::{n}" for n in ("a", "f", "d", "k", "last")}
    assert ("re.js::f", "g") in calls
    for name in ("operator+=", "operator()"):
        assert names[f"op.cpp::V::{name}"] == "Method"
    assert ("op.cpp::V::operator+=", "add") in calls and ("op.cpp::V::operator()", "call") in calls
    assert names["op.cpp::V::operator=="] == "Function"
    assert {n for n, k in names.items() if k == "Preprocessor"} == {"dir.cpp::TOP", "dir.cpp::a::b::IN", "dir.cpp::a::MID", "dir.cpp::END", "dir.cpp::anonymous::ANON", "dir.c::ONE"}
    contained = {(r.from_qn, r.to_qn) for r in edges.where("rel_type = 'CONTAINS'").collect()}
    assert ("dir.cpp::a::b", "dir.cpp::a::b::IN") in contained
    assert {(r.from_qn, r.to_qn) for r in edges.where("rel_type = 'IMPORTS'").collect()} == {("dir.cpp::a::b", "<x>")}


def test_all_style_blocks(spark):
    page = "<style>a{}</style><p><style media=x>\n.b{}\n</style>"
    rows = style_blocks(spark.createDataFrame([("p.html", page), ("q.html", "none"), ("r.html", None)], "path string, source string")).collect()
    assert sorted(map(tuple, rows)) == [("p.css", "a{}"), ("p_2.css", "\n.b{}\n")]


def test_lead_of_a_piece_is_matched_once(spark):
    rows = spark.createDataFrame([("p", "a")], "path string, masked string")
    plan = rows.select(braces.scan(F.col("masked"), F.col("path"), rust.RULES, rust.LEAD).alias("found"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(rust.LEAD) == 1


def test_first_rule_that_fits_the_end_of_a_piece_counts(spark):
    """A head that two rules name: the first one that may end as the piece does; an empty head names nothing."""
    rules = [braces.Rule("Block", r"^(\w+)"), braces.Rule("Bare", r"^(\w+)", block=False, bare=True), braces.Rule("Late", r"^(\w+)", bare=True)]
    rows = spark.createDataFrame([("p", "a { } b; ; { }")], "path string, masked string")
    found = rows.select(F.inline(braces.scan(F.col("masked"), F.col("path"), rules, r"^\s*+"))).collect()
    assert [(r.kind, r.name) for r in found] == [("Block", "a"), ("Bare", "b")]
