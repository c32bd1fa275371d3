from quillgraph.sources.grammars import parse


def rows(path, source, tag):
    return [r for r in parse(path, source) if r["tag"] == tag]


def ids(path, source):
    return {r["id"].partition("#")[2]: r["type"] for r in rows(path, source, "node") if "#" in r["id"]}


PYTHON = '''import os, a.b as c
from ..core import thing
from . import near
LIMIT, OTHER = 1, 2
class Base: pass
class Service(Base):
    name: str = "x"
    @cached
    def run(self) -> int:
        def inner():
            return helper(1)
        with open("f") as f:
            return Repo.load().save(inner())
async def top():
    await Service().run()
'''


def test_python():
    path = "pkg/auth/service.py"
    got = ids(path, PYTHON)
    assert got["Service"] == "Class" and got["Service.run"] == "Method" and got["Service.run.inner"] == "Function" and got["top"] == "Function"
    assert got["LIMIT"] == got["OTHER"] == "Constant" and got["Service.name"] == "Field"
    assert {k for k in got if k.startswith("import:")} == {"import:os", "import:a.b", "import:pkg.core.thing", "import:pkg.auth.near"}
    node = next(r for r in rows(path, PYTHON, "node") if r["id"].endswith("#Service.run"))
    assert node["fqn"] == "pkg.auth.service.Service.run" and node["returns"] == "int" and node["line"] == 9
    calls = {(r["src"].partition("#")[2], r["label"], r["receiver_type"], r["receiver_call"]) for r in rows(path, PYTHON, "ref")}
    assert {("Service.run.inner", "helper", None, None), ("Service.run", "load", "Repo", None), ("Service.run", "save", None, "load"), ("top", "run", None, "Service"), ("Service.run", "open", None, None)} <= calls


def test_broken_python_keeps_what_comes_before():
    got = parse("a.py", "def ok():\n    pass\n\ndef broken(:\n")
    assert any(r["tag"] == "diagnostic" for r in got) and any((r["id"] or "").endswith("#ok") for r in got)


JAVA = '''package app.auth;
import java.util.List;
public class UserService extends Base implements Api<User>, Other {
    private final Repo repo; int a, b = 2;
    public UserService(Repo repo) { this.repo = repo; }
    public User find(String id, List<User> all) { // find(x) {
        User u = repo.load("}").name();
        return helper(u);
    }
    static class Inner { void go() { Tools.run(); this.stop(); } }
    enum Kind { A, B }
}
'''


def test_java():
    path = "src/UserService.java"
    got = ids(path, JAVA)
    assert got["UserService"] == "Class" and got["UserService.find(String,List)"] == "Method" and got["UserService.<init>(Repo)"] == "Method"
    assert got["UserService.Inner.go()"] == "Method" and got["UserService.Kind"] == "Enum" and got["import:java.util.List"] == "Module"
    assert got["UserService.repo"] == got["UserService.a"] == got["UserService.b"] == "Field"
    node = next(r for r in rows(path, JAVA, "node") if r["id"].endswith("#UserService"))
    assert node["supertypes"] == ["Base", "Api", "Other"] and node["fqn"] == "app.auth.UserService" and node["line"] == 3
    calls = {(r["src"].partition("#")[2], r["label"], r["receiver_type"]) for r in rows(path, JAVA, "ref")}
    assert ("UserService.find(String,List)", "load", "Repo") in calls and ("UserService.Inner.go()", "run", "Tools") in calls
    assert ("UserService.Inner.go()", "stop", "Inner") in calls and ("UserService.find(String,List)", "helper", None) in calls
    assert not any(label == "find" for _, label, _ in calls)


def test_other_languages():
    ts = "import { a } from './a';\nexport default class Box extends Thing { open(x: number): string { return make(x); } }\nexport const View = () => { return <div>{use()}</div>; };\nfunction plain() {}\ninterface Shape {}\n"
    got = ids("src/box.tsx", ts)
    assert got["Box"] == "Class" and got["Box.open()"] == "Method" and got["View"] == "Component" and got["Shape"] == "Interface" and got["import:./a"] == "Module"
    kt = 'package p\nimport p.q.R\nclass A(val n: Int) : Base() {\n  fun String.shout(): String { return loud(this) }\n  val x = 1\n  companion object { fun of(n: Int) = A(n) }\n}\nfun top(a: Int): A { return A.of(a) }\n'
    got = ids("A.kt", kt)
    assert got["A"] == "Class" and got["A.String.shout()"] == "Method" and got["top(Int)"] == "Function" and got["A.x"] == "Property"
    swift = "import UIKit\nstruct S: Codable { let n: Int\n func go(a: Int) -> Bool { return run(a) } }\nextension S { func more() {} }\nprotocol P {}\n"
    got = ids("S.swift", swift)
    assert got["S"] == "Struct" and got["S.go(Int)"] == "Method" and got["P"] == "Protocol" and any(k.startswith("S+ext@4") for k in got)
    objc = '#import "Foo.h"\n@interface Foo : Bar\n- (void)doIt:(int)a with:(int)b;\n@end\n@implementation Foo\n- (void)doIt:(int)a with:(int)b {\n  [self run:a];\n  [Other go];\n}\n@end\n'
    got = ids("Foo.m", objc)
    assert got["Foo"] == "Class" and got["Foo.doIt:with:"] == "Method"
    assert {(r["label"], r["receiver_type"]) for r in rows("Foo.m", objc, "ref")} == {("run:", None), ("go", "Other")}
    assert len(parse("main.go", "func main() {}")) == 1 and parse("x.java", "class { }}")[-1]["tag"] == "diagnostic"


def test_constants_aliases_and_heads():
    assert ids("A.java", "enum Kind { A(1), B { int x() { return 1; } }, C; private int q; Kind(int i) {} }") == {"Kind": "Enum", "Kind.A": "Field", "Kind.B": "Field", "Kind.C": "Field", "Kind.x()": "Method", "Kind.<init>(int)": "Method", "Kind.q": "Field"}
    kotlin = "import a.b\ninterface Api\nenum class Kind(val n: Int) { A(1), B(2);\n fun f() = 1 }\nclass Two(\n  val x: Int,\n) :\n  Base(1), Api {\n  fun g() {}\n}\ntypealias T = Int\n"
    assert ids("A.kt", kotlin) == {"import:a.b": "Module", "Api": "Interface", "Kind": "Enum", "Kind.n": "Property", "Kind.A": "Property", "Kind.B": "Property", "Kind.f()": "Method", "Two": "Class", "Two.x": "Property", "Two.g()": "Method", "T": "TypeAlias"}
    assert {r["label"]: r["supertypes"] for r in rows("A.kt", kotlin, "node") if r["supertypes"] is not None} == {"Api": [], "Kind": [], "Two": ["Base", "Api"]}
    swift = "import Lib\nimport class Other.Thing\nprotocol P {}\nenum Kind: String, P { case a, b(Int)\n case c = \"x\" }\ntypealias T = Int\n"
    assert ids("A.swift", swift) == {"import:Lib": "Module", "import:Other.Thing": "Module", "P": "Protocol", "Kind": "Enum", "Kind.a": "Field", "Kind.b": "Field", "Kind.c": "Field", "T": "TypeAlias"}
    objc = "@interface P7 : Base <One, Two>\n@property (nonatomic) NSString *name;\n- (int)run:(int)a with:(int)b;\n@end\n"
    assert ids("A.m", objc) == {"P7": "Class", "P7.name": "Property", "P7.run:with:": "Method"}
    assert next(r for r in rows("A.m", objc, "node") if r["label"] == "P7")["supertypes"] == ["Base", "One", "Two"]
    ts = "export interface Api { go(a: string): void; name: string }\nexport type Alias<T> = T[];\nfunction f() { go(1); }\n"
    assert ids("a.ts", ts) == {"Api": "Interface", "Api.go()": "Method", "Alias": "TypeAlias", "f()": "Function"}
    assert [(r["src"], r["label"]) for r in rows("a.ts", ts, "ref")] == [("a.ts#f()", "go")]
