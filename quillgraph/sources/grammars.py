"""Declarations, imports and call sites of source files.

Python goes through the standard library's ``ast``. Java, Kotlin, Swift, Objective-C, JavaScript and TypeScript (with
JSX) go through one scanner for languages with braces: comments and strings are blanked, then declarations, imports
and calls are found by each language's patterns and placed by brace depth. It knows no types of expressions beyond
declared fields, parameters and locals (Java), and skips what the patterns do not name.

``extract`` runs a parser over each file where it lies and returns tagged rows; ``split`` takes these apart.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL, IMPORT = 0.98, 0.98
#: Extensions of each language.
EXTENSIONS = {"java": ["java"], "python": ["py"], "javascript": ["js", "jsx"], "typescript": ["ts"], "tsx": ["tsx"], "kotlin": ["kt"], "swift": ["swift"], "objc": ["m", "h"]}
LANGUAGE = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts}
if len(LANGUAGE) != sum(map(len, EXTENSIONS.values())):
    raise ValueError("two languages claim one extension")

ROW = "tag string, id string, type string, label string, src string, dst string, fqn string, kind string, supertypes array<string>, returns string, line int, line_end int, receiver_type string, receiver_call string, path string, message string"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


class Sink:
    """Rows of one file."""

    def __init__(self, path: str, language: str | None):
        self.path, self.rows, self.seen = path, [], set()
        self.add(tag="node", id=path, type="File", label=path.rsplit("/", 1)[-1], kind=language, line=1)

    def add(self, **row) -> None:
        self.rows.append({c: None for c in _COLUMNS} | {"path": self.path} | row)

    def declare(self, scope: list[str], name: str, kind: str, line: int, fqn: str, **more) -> str:
        """A node below the last scope; a second declaration of an id is dropped."""
        ident = f"{self.path}#{'.'.join([*scope, name])}"
        if ident not in self.seen:
            self.seen.add(ident)
            self.add(tag="node", id=ident, type=kind, label=re.sub(r"\(.*", "", name), line=line, fqn=fqn, kind=kind.lower(), **more)
            parent = f"{self.path}#{'.'.join(scope)}" if scope else self.path
            self.add(tag="edge", id=f"contains:{parent}:{ident}", type="contains", src=parent, dst=ident)
        return ident

    def imports(self, target: str, line: int) -> None:
        ident = f"{self.path}#import:{target}"
        if ident not in self.seen:
            self.seen.add(ident)
            self.add(tag="node", id=ident, type="Module", label=target, line=line, fqn=target)
            self.add(tag="edge", id=f"imports:{self.path}:{ident}", type="imports", src=self.path, dst=ident)

    def call(self, referrer: str, name: str, line: int, receiver_type: str | None = None, receiver_call: str | None = None) -> None:
        self.add(tag="ref", label=name, src=referrer, line=line, receiver_type=receiver_type, receiver_call=receiver_call)

    def warn(self, message: str) -> None:
        self.add(tag="diagnostic", type="WARNING", message=message)


def python(sink: Sink, source: str) -> None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        sink.warn(f"syntax error: {e}")
        # what stands before the error is still read
        lines = source.split("\n")
        end = (getattr(e, "lineno", None) or 1) - 1
        while end > 0:
            try:
                tree = ast.parse("\n".join(lines[:end]))
                break
            except (SyntaxError, ValueError):
                end -= 1
        else:
            return
    module = re.sub(r"(^|\.)__init__$", "", sink.path.removesuffix(".py").replace("/", "."))
    package = module if sink.path.endswith("__init__.py") else module.rpartition(".")[0]

    def visit(body: list[ast.stmt], scope: list[str], inside: str, in_class: bool) -> None:
        for node in body:
            fq = ".".join(p for p in [module, *scope, getattr(node, "name", "")] if p)
            if isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b).rpartition(".")[2] for b in node.bases if isinstance(b, ast.Name | ast.Attribute)]
                ident = sink.declare(scope, node.name, "Class", node.lineno, fq, supertypes=bases, line_end=node.end_lineno)
                calls(node.decorator_list, inside)
                visit(node.body, [*scope, node.name], ident, True)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                returns = ast.unparse(node.returns) if node.returns is not None else None
                ident = sink.declare(scope, node.name, "Method" if in_class else "Function", node.lineno, fq, returns=returns, line_end=node.end_lineno)
                calls(node.decorator_list, inside)
                visit(node.body, [*scope, node.name], ident, False)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    sink.imports(a.name, node.lineno)
            elif isinstance(node, ast.ImportFrom):
                base = node.module or ""
                if node.level:
                    up = package.split(".") if package else []
                    up = up[: len(up) - node.level + 1]
                    base = ".".join([*up, *([base] if base else [])])
                for a in node.names:
                    sink.imports(".".join(p for p in (base, a.name) if p and p != "*"), node.lineno)
            else:
                if isinstance(node, ast.Assign | ast.AnnAssign) and (in_class or not scope):
                    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                    for t in targets:
                        for name in t.elts if isinstance(t, ast.Tuple | ast.List) else [t]:
                            if isinstance(name, ast.Name) and (in_class or name.id.isupper()):
                                sink.declare(scope, name.id, "Field" if in_class else "Constant", node.lineno, f"{fq}.{name.id}".lstrip("."))
                blocks = [b for f in ("body", "orelse", "finalbody", "handlers", "cases") for b in getattr(node, f, [])]
                if blocks:
                    calls([c for c in ast.iter_child_nodes(node) if isinstance(c, ast.expr | ast.withitem)], inside)
                    for b in blocks:
                        visit(b.body if isinstance(b, ast.ExceptHandler | ast.match_case) else [b], scope, inside, in_class)
                else:
                    calls([node], inside)

    def calls(nodes: list[ast.AST], inside: str) -> None:
        for top in nodes:
            for n in ast.walk(top):
                if isinstance(n, ast.Call):
                    f = n.func
                    if isinstance(f, ast.Name):
                        sink.call(inside, f.id, n.lineno)
                    elif isinstance(f, ast.Attribute):
                        owner = f.value.id if isinstance(f.value, ast.Name) and f.value.id[:1].isupper() else None
                        chain = f.value.func if isinstance(f.value, ast.Call) else None
                        name = chain.id if isinstance(chain, ast.Name) else chain.attr if isinstance(chain, ast.Attribute) else None
                        sink.call(inside, f.attr, f.end_lineno or n.lineno, owner, name)

    visit(tree.body, [], sink.path, False)


_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_WORD = r"[A-Za-z_$][\w$]*"
_KEYWORDS = set("if for while switch catch return new throw super this synchronized else do try when guard in is as await typeof sizeof function fun func init constructor".split())

#: Per language: imports, type declarations (kind word to node type), callables, fields. Group n is the name.
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|export|default|declare|async|data|inner|inline|suspend|fileprivate|mutating|required|convenience|lazy|weak|const|native|synchronized|readonly|companion|value|annotation|operator|tailrec|default)\s+)*"
_TYPE_WORDS = {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Record", "object": "Class", "struct": "Struct", "protocol": "Protocol", "actor": "Actor", "extension": "Extension", "@interface": "Class", "@implementation": "Class", "@protocol": "Protocol"}


class Braces:
    """One pass over a file whose strings and comments are blanked."""

    IMPORTS = {
        "java": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
        "kotlin": r"^\s*import\s+([\w.]+(?:\.\*)?)",
        "swift": r"^[ \t]*(?:@testable[ \t]+)?import[ \t]+(?:(?:class|struct|enum|protocol|func|let|var|typealias)[ \t]+)?([\w.]+)",
        "objc": r"^\s*(?:#import|@import)\s+[<\"]?([\w./+-]+)",
        "ts": r"^\s*(?:import|export)\b[^;\n]*?\bfrom\s*['\"]([^'\"]+)['\"]|^\s*import\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)",
    }
    CALLABLES = {
        "java": rf"(?:^|[;{{}}\s])((?:@\w+\s+)*{_MODS}(?:<[^>]*>\s*)?(?:([\w.][\w.<>\[\],?\s]*?)\s+)?)({_WORD})\s*\(([^()]*)\)\s*(?:throws\s+[\w.,\s]+)?\{{",
        "kotlin": rf"\bfun\s+(?:<[^>]*>\s*)?((?:[\w.<>?]+\.)?)({_WORD})\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*:\s*([\w.<>?]+))?",
        "swift": rf"\bfunc\s+()({_WORD})\s*(?:<[^>]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*(?:throws|async|rethrows)\b)*(?:\s*->\s*([\w.<>?\[\]]+))?",
        "ts": rf"\bfunction\s*\*?\s*()({_WORD})\s*(?:<[^>]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*:\s*([\w.<>\[\]|]+))?",
    }

    def __init__(self, sink: Sink, source: str, language: str):
        self.sink, self.language = sink, language
        self.family = "ts" if language in ("javascript", "typescript", "tsx") else language
        self.source = source
        self.text = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.blocks: list[tuple[int, int]] = []
        stack = []
        for m in re.finditer(r"[{}]", self.text):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.blocks.append((stack.pop(), m.start()))
            else:
                sink.warn(f"unmatched brace in line {self.line(m.start())}")
        if stack:
            sink.warn(f"unclosed brace in line {self.line(stack[-1])}")
            self.blocks += [(s, len(self.text)) for s in stack]
        self.ends = dict(self.blocks)
        self.given: list[tuple[int, int, str]] = []  # properties that a head declares: of which type, where, name

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.lines, at)

    def body(self, at: int) -> tuple[int, int] | None:
        """The block that begins after ``at`` before the next statement. In languages without semicolons a line's end is one, unless the head goes on."""
        head = r"(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[^{};\n()]|\n(?=\s*(?:[:{,]|where\b|throws\b|->))|(?<=[:,>=])[ \t]*\n)*\{" if self.family in ("kotlin", "swift") else r"[^{};]*\{"
        m = re.compile(head).match(self.text, at)
        return (m.end() - 1, self.ends.get(m.end() - 1, len(self.text))) if m else None

    def run(self) -> None:
        text, family = self.text, self.family
        package = re.search(r"^\s*package\s+([\w.]+)", text, re.M)
        prefix = package[1] if package else ""
        for m in re.finditer(self.IMPORTS[family], self.source if family in ("ts", "objc") else text, re.M):
            self.sink.imports(next(g for g in m.groups() if g), self.line(m.start(m.lastindex)))
        decls: list[tuple[int, int, int, str, str, dict]] = []  # name position, body, name, type, more
        objc = family == "objc"
        words = r"@interface|@implementation|@protocol" if objc else r"class|interface|enum(?:\s+class)?|record|object|struct|protocol|actor|extension"
        for m in re.finditer(rf"(?<![\w.])(?<!import )({words})\s+({_WORD})", text):
            kind = _TYPE_WORDS[m[1].split()[0]]
            if objc:
                end = text.find("@end", m.end())
                span = (m.end(), end if end >= 0 else len(text))
            else:
                span = self.body(m.end())
            head = text[m.end() : span[0] if span else m.end()]
            if objc:  # a superclass and protocols stand on the line itself, a category's name in brackets
                of = re.compile(rf"[ \t]*(?:\([^()\n]*\))?[ \t]*(?::[ \t]*({_WORD}))?[ \t]*(?:<([^<>\n]*)>)?").match(text, m.end())
                head = f": {of[1]}" if of[1] else ""
                head += "".join(f", {p.strip()}" for p in (of[2] or "").split(",") if p.strip())
            elif span is None and family in ("kotlin", "swift"):
                head = re.compile(r"(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[^;\n()])*").match(text, m.end())[0]
            supers = re.findall(rf"(?:extends|implements|:|,)\s*(?:[\w.]+\.)?({_WORD})", re.sub(r"<[^<>]*>|\([^()]*\)", "", head))
            name = f"{m[2]}+ext@{self.line(m.start(2))}" if kind == "Extension" else m[2]
            decls.append((m.start(2), *(span or (m.end(), m.end())), name, kind, {"supertypes": [s for s in supers if s not in _KEYWORDS]}))
        if objc:
            for m in re.finditer(r"^\s*[-+]\s*\(([^()]*)\)\s*([^;{]*)[;{]", text, re.M):
                parts = re.findall(r"(\w+)\s*:", m[2])
                selector = "".join(p + ":" for p in parts) or re.match(r"\w*", m[2])[0]
                if selector:
                    span = (m.end() - 1, self.ends.get(m.end() - 1, m.end())) if m[0].endswith("{") else (m.end(), m.end())
                    decls.append((m.start(2), *span, selector, "Method", {"returns": m[1].strip(" *")}))
        else:
            for m in re.finditer(self.CALLABLES[family], text):
                java = family == "java"
                name, params, returns = (m[3], m[4], m[2]) if java else (m[2], m[3], m[4])
                if name in _KEYWORDS or (java and (m[2] or "").strip() in ("new", "return", "else", "throw")):
                    continue
                at = m.start(3 if java else 2)
                span = (m.end() - 1, self.ends.get(m.end() - 1, len(text))) if java else self.body(m.end()) or (m.end(), m.end())
                types = []
                for p in re.split(r",(?![^<]*>)", params):
                    p = re.sub(r"@\w+\s*|\bfinal\b|=.*", "", p).strip()
                    if p:
                        types.append(re.sub(r"<.*>", "", p.rsplit(None, 1)[0] if java and " " in p else p.partition(":")[2] if ":" in p else p).strip())
                owner = (None if java else m[1].rstrip(".")) or None
                returns = returns.strip() if returns and returns.strip() != "void" else None
                shown = re.sub(r"<.*>", "", returns) if returns else None
                decls.append((at, *span, f"{'<init>' if java and not (m[2] or '').strip() else name}({','.join(types)})", "Method", {"returns": shown, "owner": owner}))
            if family == "ts":
                for m in re.finditer(rf"\b(?:const|let|var)\s+({_WORD})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_WORD})\s*(?::[^=\n]+)?=>", text):
                    decls.append((m.start(1), *(self.body(m.end()) or (m.end(), text.find("\n", m.end()) % (len(text) + 1))), m[1], "Function", {}))
                for m in re.finditer(rf"(?:^|[{{}};])\s*(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*({_WORD})\s*\(([^()]*)\)\s*(?::[^{{;\n]+)?\{{", text, re.M):
                    if m[1] not in _KEYWORDS and self.enclosing_type(m.start(1), decls):
                        decls.append((m.start(1), m.end() - 1, self.ends.get(m.end() - 1, len(text)), f"{m[1]}()", "Method", {}))
                for at, a, b, _, kind, _ in [d for d in decls if d[4] == "Interface"]:  # signatures without a body
                    for m in re.compile(rf"(?<=[{{;,\n])\s*(?:readonly\s+)?({_WORD})\??\s*(?:<[^<>]*>)?\(([^()]*)\)\s*(?::\s*[^;,{{}}\n]+)?(?=[;,\n}}])").finditer(text, a, b + 1):
                        decls.append((m.start(1), m.end(), m.end(), f"{m[1]}()", "Method", {}))
        for at, a, b, _, kind, _ in [d for d in decls if d[4] == "Enum"]:
            for start, name in self.entries(a + 1, b):
                decls.append((start, start, start, name, "Property" if family == "kotlin" else "Field", {}))
        alias = {"kotlin": rf"\btypealias\s+({_WORD})", "swift": rf"\btypealias\s+({_WORD})", "ts": rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({_WORD})\s*(?:<[^=]*>)?\s*="}.get(family)
        for m in re.finditer(alias, text, re.M) if alias else ():
            decls.append((m.start(1), m.end(), m.end(), m[1], "TypeAlias", {}))
        for m in re.finditer(rf"@property\s*(?:\([^()]*\))?[^;]*?({_WORD})\s*;", text) if objc else ():
            decls.append((m.start(1), m.end(), m.end(), m[1], "Property", {}))
        if family == "kotlin":
            for at, _, _, _, kind, _ in [d for d in decls if d[4] in ("Class", "Enum")]:
                params = re.compile(rf"{_WORD}\s*(?:<[^<>]*>)?\s*(?:{_MODS}constructor\s*)?\(([^()]*(?:\([^()]*\)[^()]*)*)\)").match(text, at)
                for m in re.finditer(rf"\b(?:val|var)\s+({_WORD})", params[1] if params else ""):
                    self.given.append((at, params.start(1) + m.start(1), m[1]))
        fields = {"java": rf"(?:^|(?<=;))[ \t]*{_MODS}([\w.<>\[\],?]+)\s+({_WORD}(?:\s*=[^,;]*)?(?:\s*,\s*{_WORD}(?:\s*=[^,;]*)?)*)\s*;", "kotlin": rf"\b(?:val|var)\s+(){_WORD}", "swift": rf"\b(?:let|var)\s+(){_WORD}"}
        decls.sort()
        scopes: list[tuple[int, int, list[str], str]] = []
        types = {}
        for at, a, b, name, kind, more in decls:
            holding = [s for s in scopes if s[0] < at < s[1]]
            scope = holding[-1][2] if holding else []
            owner = more.pop("owner", None)
            scope = [*scope, owner] if owner else scope
            if kind == "Method" and family in ("kotlin", "swift", "ts") and not scope:
                kind = "Function"
            plain = [re.sub(r"\(.*|\+ext@\d+", "", s) for s in (*scope, name)]
            component = family == "ts" and kind == "Function" and plain[-1][:1].isupper() and re.search(r"<[A-Za-z>]", text[a:b])
            ident = self.sink.declare(scope, name, "Component" if component else kind, self.line(at), ".".join([*([prefix] if prefix else []), *plain]), line_end=max(self.line(at), self.line(min(b, len(self.text)))), **more)
            scopes.append((a, b, [*scope, name], ident))
            types[ident] = plain
            for _, where, prop in [x for x in self.given if x[0] == at]:
                self.sink.declare([*scope, name], prop, "Property", self.line(where), ".".join([*([prefix] if prefix else []), *plain, prop]))
        env = self.fields(scopes, fields.get(family), prefix)
        self.calls(scopes, {at for at, *_ in decls}, env)

    def entries(self, a: int, b: int) -> list[tuple[int, str]]:
        """Constants of the enumeration whose body is between ``a`` and ``b``: cases, or names between commas before the first semicolon."""
        if self.family == "swift":
            one = rf"{_WORD}(?:\([^()]*\))?(?:\s*=[^,\n;}}]*)?"
            found = re.compile(rf"\bcase\s+({one}(?:\s*,\s*{one})*)").finditer(self.text, a, b)
            bare = [(m.start(1), re.sub(r"\([^()]*\)|=[^,\n]*", lambda x: " " * len(x[0]), m[1])) for m in found]
            return [(at + n.start(1), n[1]) for at, text in bare for n in re.finditer(rf"(?:^|,)\s*({_WORD})", text)]
        if self.family == "ts" or self.family == "objc":
            return []
        out, depth, start = [], 0, True
        for i in range(a, b):
            c = self.text[i]
            if c in "({":
                depth += 1
            elif c in ")}":
                depth -= 1
            elif depth == 0 and c == ";":
                break
            elif depth == 0 and c == ",":
                start = True
            elif depth == 0 and start and (c.isalpha() or c == "_"):
                name = re.compile(_WORD).match(self.text, i)[0]
                if name in ("fun", "val", "var", "override", "companion"):
                    break
                out.append((i, name))
                start = False
        return out

    def enclosing_type(self, at: int, decls: list) -> bool:
        return any(a < at < b and kind in ("Class", "Interface") for _, a, b, _, kind, _ in decls)

    def fields(self, scopes: list, pattern: str | None, prefix: str) -> dict[str, str]:
        """Declares fields of types and returns declared types of Java names, later ones first."""
        env: dict[str, str] = {}
        if pattern is None:
            return env
        for m in re.finditer(pattern, self.text, re.M):
            names = [m[2]] if self.family == "java" else [m[0].split()[-1]]
            holding = [s for s in scopes if s[0] < m.start() < s[1]]
            depth = sum(a < m.start() < b for a, b in self.blocks)
            if self.family == "java":
                if m[1] in _KEYWORDS or m[1] in ("package", "import"):
                    continue
                names = [re.match(r"\s*(\w+)", n)[1] for n in re.split(r",(?![^<]*>)", m[2]) if re.match(r"\s*\w+", n)]
                env |= dict.fromkeys(names, re.sub(r"<.*>|\[\]", "", m[1])) if m[1] != "var" else {}
            if holding and holding[-1][3].rpartition(".")[2].find("(") < 0 and depth == sum(a <= holding[-1][0] <= b for a, b in self.blocks):
                for n in names:
                    scope = holding[-1][2]
                    self.sink.declare(scope, n, "Field" if self.family == "java" else "Property", self.line(m.start()), ".".join([*([prefix] if prefix else []), *scope, n]))
        if self.family == "java":
            for m in re.finditer(rf"[(,]\s*(?:final\s+)?([A-Z]\w*)(?:<[^>]*>)?\s+({_WORD})(?=\s*[,)])", self.text):
                env[m[2]] = m[1]
        return env

    def calls(self, scopes: list, names: set[int], env: dict[str, str]) -> None:
        def inside(at: int) -> str:
            holding = [s for s in scopes if s[0] < at < s[1]]
            return holding[-1][3] if holding else self.sink.path

        if self.family == "objc":
            for m in re.finditer(r"\[\s*([\w.]+|\[[^\[\]]*\])\s+((?:\w+\s*:\s*[^\[\]:]*)+|\w+)\s*\]", self.text):
                parts = re.findall(r"(\w+)\s*:", m[2])
                self.sink.call(inside(m.start()), "".join(p + ":" for p in parts) or m[2].strip(), self.line(m.start(2)), m[1] if m[1][:1].isupper() else None)
            return
        for m in re.finditer(rf"(?:({_WORD})(\([^()]*\))?\s*[?!]?\.\s*)?(?:\bnew\s+)?(?<![\w$@])({_WORD})\s*(?:<[\w\s,.<>]*>)?\(", self.text):
            if m.start(3) in names or m[3] in _KEYWORDS:
                continue
            owner = m[1]
            kind = None
            if self.family == "java" and owner and not m[2]:
                within = [s for s in scopes if s[0] < m.start() < s[1]]
                kind = env.get(owner) or (owner if owner[:1].isupper() else None)
                if owner == "this" and within:
                    kind = next((s[2][-1] for s in reversed(within) if "(" not in s[2][-1]), None)
            self.sink.call(inside(m.start(3)), m[3], self.line(m.start(3)), kind, owner if self.family == "java" and m[2] else None)


def parse(path: str, source: str) -> list[dict]:
    """Rows of one file; of a file in no known language, the file alone."""
    language = LANGUAGE.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    sink = Sink(path, language)
    try:
        if language == "python":
            python(sink, source or "")
        elif language:
            Braces(sink, source or "", language).run()
    except Exception as e:  # one file that no grammar can read does not stop the run; it is counted as failed
        sink.add(tag="diagnostic", type="ERROR", message=f"{type(e).__name__}: {e}")
    return sink.rows


def extract(files: DataFrame) -> DataFrame:
    """Tagged rows of files(path, content): nodes, edges, refs, diagnostics."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, c in zip(f["path"], f["content"], strict=True) for r in parse(p, c)]
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS).astype({"line": "Int32", "line_end": "Int32"})

    return files.select("path", "content").mapInPandas(run, ROW)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges, references, diagnostics."""
    nodes = rows.where("tag = 'node'").select("id", "type", "label", F.lit(SYMBOL).alias("confidence"), "fqn", "kind", "supertypes", "returns", "path", "line", "line_end")
    edges = rows.where("tag = 'edge'").select("id", "src", "dst", "type", F.lit(SYMBOL).alias("confidence"))
    refs = rows.where("tag = 'ref'").select(F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 7, "0"), "src", "label").alias("ref_id"), F.col("label").alias("name"), F.col("src").alias("referrer"), "path", "line", "receiver_type", "receiver_call").dropDuplicates(["ref_id"])
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["id"]), refs, rows.where("tag = 'diagnostic'").select("path", F.col("type").alias("severity"), "message")
