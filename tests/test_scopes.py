"""Symbols of brace languages."""

import random

import pytest

from larkspur.operators import graph, indexing, scopes

SOURCES = {}
SOURCES["javascript"] = """import { load } from './lib1';
import def, * as all from "pkg/two";
import './side';
const fs = require('fs');
// function hidden() {}
/* class Hidden2 { } */
class Box extends ns.Base {
  #x = 1;
  static make(a, b = {}) {
    return new Box(`t ${load('}', a)} }`);
  }
  handle = async (e) => { this.go(e); };
  get size() { return 1; }
}
const go = async (a) => {
  await save(a);
  if (/[/(]{/.test(a)) { return "}"; }
};
const one = x => twice(x);
function* gen() { function inner() { deep(); } yield* inner(); }
export default function main() { go(); }
var old = function () { legacy(); };
"""
SOURCES["typescript"] = """import type { A } from './types';
export { B } from './b';
interface User extends Base<Id>, Other { id: string; greet(name: string): void; }
enum Kind { A, B }
export abstract class Repo<T extends Entity> extends BaseRepo<T> implements IRepo, Closable {
  constructor(private readonly db: Db) { super(); this.init(); }
  public async find(id: string): Promise<T | undefined> {
    return this.db.get<T>(id);
  }
  abstract close(): void;
}
export const handler: Handler = async (event: Event): Promise<{ ok: boolean }> => {
  return respond(event);
};
function verifyToken(token: string): boolean { return jwt.verify(token, SECRET); }
"""
SOURCES["go"] = """package auth
import (
	"fmt"
	log "example.com/log"
)
import "os"
type Store struct {
	Base
	*pkg.Other
	name string
	f func(int) error
}
type Reader interface {
	io.Reader
	Read(p []byte) (n int, err error)
}
type ID int
type (
	A struct{}
	B = string
)
func (s *Store) Get(id int) (string, error) {
	// call hidden()
	x := `raw } "`
	r := '}'
	go func() { s.work(r) }()
	return fmt.Sprint(x), nil
}
func Map[T any](xs []T, f func(T) T) []T {
	return apply(xs, f)
}
func main() { Get(1) }
"""
SOURCES["rust"] = """use std::collections::{HashMap, HashSet};
use crate::util;
mod net;
/* outer /* inner } */ still */
pub struct Store<'a> { name: &'a str, c: char }
struct Pair(i32, i32);
pub trait Shape: Debug + Clone { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
enum Kind { A, B }
impl<'a> Shape for Store<'a> {
    fn area(&self) -> f64 {
        let q = '}'; let s = r#"}"{"#;
        compute::<f64>(self.name, q)
    }
}
impl Store<'_> { pub fn new() -> Self { helper() } }
pub async fn run<T: Into<String>>(x: T) -> Result<(), E> where T: Send {
    println!("{}", x); util::log(x.into());
}
"""
SOURCES["java"] = """package a.b;
import java.util.List;
import static org.junit.Assert.*;
@Entity
public class Repo<T> extends Base<T> implements Closeable, Comparable<Repo> {
    private final Map<String, Integer> m = make();
    public Repo(int a) { super(a); init(); }
    @Override
    public List<String> find(String q) throws IOException, SqlException {
        String s = "}"; char c = '}';
        if (q.isEmpty()) { return empty(); }
        return this.db.query(q);
    }
    abstract void close();
    interface Inner { void go(); }
    enum Kind { A, B; Kind next() { return step(); } }
}
record Point(int x, int y) implements Shape { }
"""
SOURCES["cpp"] = """#include <vector>
#include "local/thing.h"
#define MAX(a, b) \\
  ((a) > (b) ? (a) : (b))
namespace app {
class Store : public Base<int>, private Other {
 public:
  Store(int a) : Base(a), x_{a} { init(); }
  ~Store();
  int get(int k) const override { return lookup(k); }
  virtual void run() = 0;
};
struct Point { int x, y; };
enum class Color { Red, Green };
template <typename T>
T twice(T x) { return add(x, x); }
int Store::size() const noexcept {
  const char* s = R"(})";
  char c = '}';
  for (auto& i : items()) { use(i); }
  return count();
}
}  // namespace app
int main(int argc, char** argv) { app::run(argc); return 0; }
"""

WANT = {
    "javascript": (["./lib1", "pkg/two", "./side", "fs"], [
        ("CLASS", "Box", 7, 14, "", "Base"), ("FUNCTION", "make", 9, 11, "Box load", ""), ("FUNCTION", "handle", 12, 12, "go", ""), ("FUNCTION", "size", 13, 13, "", ""), ("FUNCTION", "go", 15, 18, "save test", ""),
        ("FUNCTION", "one", 19, 19, "twice", ""), ("FUNCTION", "gen", 20, 20, "deep inner", ""), ("FUNCTION", "inner", 20, 20, "deep", ""), ("FUNCTION", "main", 21, 21, "go", ""), ("FUNCTION", "old", 22, 22, "legacy", ""),
    ]),
    "typescript": (["./types", "./b"], [
        ("CLASS", "User", 3, 3, "", "Base Other"), ("CLASS", "Kind", 4, 4, "", ""), ("CLASS", "Repo", 5, 11, "", "BaseRepo IRepo Closable"), ("FUNCTION", "constructor", 6, 6, "init", ""), ("FUNCTION", "find", 7, 9, "get", ""),
        ("FUNCTION", "handler", 12, 14, "respond", ""), ("FUNCTION", "verifyToken", 15, 15, "verify", ""),
    ]),
    "go": (["fmt", "example.com/log", "os"], [
        ("CLASS", "Store", 7, 12, "", "Base Other"), ("CLASS", "Reader", 13, 16, "", "Reader"), ("CLASS", "ID", 17, 17, "", ""), ("CLASS", "A", 19, 19, "", ""), ("CLASS", "B", 20, 20, "", ""),
        ("FUNCTION", "Get", 22, 28, "work Sprint", ""), ("FUNCTION", "Map", 29, 31, "apply", ""), ("FUNCTION", "main", 32, 32, "Get", ""),
    ]),
    "rust": (["std::collections", "crate::util", "net"], [
        ("CLASS", "Store", 5, 5, "", "Shape"), ("CLASS", "Pair", 6, 6, "", ""), ("CLASS", "Shape", 7, 7, "", "Debug Clone"), ("FUNCTION", "area", 7, 7, "", ""), ("FUNCTION", "twice", 7, 7, "area", ""), ("CLASS", "Kind", 8, 8, "", ""),
        ("FUNCTION", "area", 10, 13, "compute", ""), ("FUNCTION", "new", 15, 15, "helper", ""), ("FUNCTION", "run", 16, 18, "log into", ""),
    ]),
    "java": (["java.util.List", "org.junit.Assert.*"], [
        ("CLASS", "Repo", 5, 17, "", "Base Closeable Comparable"), ("FUNCTION", "Repo", 7, 7, "init", ""), ("FUNCTION", "find", 9, 13, "isEmpty empty query", ""), ("CLASS", "Inner", 15, 15, "", ""), ("CLASS", "Kind", 16, 16, "", ""),
        ("FUNCTION", "next", 16, 16, "step", ""), ("CLASS", "Point", 18, 18, "", "Shape"),
    ]),
    "cpp": (["vector", "local/thing.h"], [
        ("CLASS", "Store", 6, 12, "", "Base Other"), ("FUNCTION", "Store", 8, 8, "init", ""), ("FUNCTION", "get", 10, 10, "lookup", ""), ("CLASS", "Point", 13, 13, "", ""), ("CLASS", "Color", 14, 14, "", ""),
        ("FUNCTION", "twice", 16, 16, "add", ""), ("FUNCTION", "size", 17, 22, "items use count", ""), ("FUNCTION", "main", 24, 24, "run", ""),
    ]),
}


@pytest.mark.parametrize("language", sorted(WANT))
def test_symbols(language):
    symbols, imports = scopes.parse(SOURCES[language], language)
    assert (imports, [(x["type"], x["name"], x["start_line"], x["end_line"], " ".join(x["calls"]), " ".join(x["bases"])) for x in symbols]) == WANT[language]


@pytest.mark.parametrize("language", sorted(scopes.LANGUAGES))
def test_damaged_sources(language):
    draw = random.Random(6)
    for source in ["", "class", "}}}((( function x( {", "`${`${", "/*", '"', "'", "#define", "func (", "impl for", "import {", "type ("]:
        scopes.parse(source, language)
    source = "".join(SOURCES.values())
    for _ in range(150):
        a, b = sorted(draw.choices(range(len(source)), k=2))
        for x in scopes.parse(source[:a] + source[b:], language)[0]:
            assert 1 <= x["start_line"] <= x["end_line"]
    tokens = draw.choices(["class A", "{", "}", "(", ")", "f", "<", ">", "=>", "=", "func", "fn", "\n", "`", "${", "'", ",", ";", "type", "struct", "import", ":", "impl", "for"], k=20_000)
    scopes.parse(" ".join(tokens), language)


def test_edges_of_other_languages(spark):
    files = spark.createDataFrame([("a.go", "go", bytearray(SOURCES["go"].encode())), ("b.java", "java", bytearray(SOURCES["java"].encode())), ("c.sh", "bash", bytearray(b"go() {\n}\n"))], "path string, language string, content binary")
    parsed = indexing.parse(files)
    symbols = indexing.symbols(parsed)
    edges = {(r["src"], r["dst"], r["rel"]) for r in graph.symbol_edges(symbols).collect()}
    assert {("a.go::Map", "symbol::apply", "CALLS"), ("symbol::Sprint", "a.go::Get", "CALLED_BY"), ("b.java::Repo", "symbol::Base", "INHERITS"), ("a.go::Store", "symbol::Other", "INHERITS")} <= edges
    assert {r["name"] for r in symbols.where("file = 'c.sh'").collect()} == {"go"}
    assert {r["path"]: r["imports"] for r in parsed.collect()}["b.java"] == ["java.util.List", "org.junit.Assert.*"]
