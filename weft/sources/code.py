"""Source code and package manifests: Python by its syntax tree, other languages by declaration patterns."""

from __future__ import annotations

import ast
import configparser
import json
import re
import tomllib
import xml.etree.ElementTree as ET

from weft.sources.prose import _edge, _node, _record, file_stem, html, markdown, plain, restructured

RATIONALE = re.compile(r"(?:#|//|--|/\*|\*)\s*(NOTE|WHY|HACK|IMPORTANT|TODO|FIXME)\b[: ]*(.*)")
IDENTIFIER = re.compile(r"""["']([A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)+)["']""")
SECRETS = re.compile(r"(?i)(sk-|ghp_|gho_|github_pat_|glpat-|xox|akia|asia|eyj|password|secret)")
#: String references of a file, at most.
REFERENCES = 40
#: Calls that bind to nothing in a graph.
BUILTINS = frozenset(dir(__builtins__) if not isinstance(__builtins__, dict) else __builtins__)


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.stem = path, file_stem(path)
        self.nodes = [_node(self.stem, path.rsplit("/", 1)[-1], path, 1, "file", ast.get_docstring(ast.parse(text)), None)]
        self.edges: list[dict] = []
        self.scope = [(self.stem, "file")]
        self.used: dict[str, int] = {}

    def declare(self, node, kind: str, signature: str | None) -> None:
        owner = self.scope[-1][0]
        base = f"{owner}::{node.name}"
        self.used[base] = self.used.get(base, 0) + 1
        ident = base if self.used[base] == 1 else f"{base}__{self.used[base]}"
        kind = "test" if kind == "function" and node.name.startswith("test_") else kind
        label = node.name if kind == "class" else f"{node.name}()"
        self.nodes.append(_node(ident, label, self.path, node.lineno, kind, ast.get_docstring(node), signature))
        self.edges.append(_edge(owner, ident, "contains", self.path, node.lineno))
        self.scope.append((ident, kind))
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        at = f"{self.scope[-1][0]}::{node.name}"
        for base in node.bases:
            self.edges.append(_edge(at, ast.unparse(base), "inherits", self.path, node.lineno, "INFERRED", 0.7))
        self.declare(node, "class", None)

    def visit_FunctionDef(self, node) -> None:
        self.declare(node, "function", f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else ""))

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.edges.append(_edge(self.stem, alias.name, "imports", self.path, node.lineno))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.edges.append(_edge(self.stem, "." * node.level + (node.module or ""), "imports", self.path, node.lineno))

    def visit_Call(self, node: ast.Call) -> None:
        target, owner = None, self.scope[-1][0]
        if isinstance(node.func, ast.Name) and node.func.id not in BUILTINS:
            target = node.func.id
        elif isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
            holder = next((i for i, kind in reversed(self.scope) if kind == "class"), None)
            own = node.func.value.id in ("self", "cls") and holder
            target = f"{holder}::{node.func.attr}" if own else f"receiver::{owner}::{node.func.value.id}.{node.func.attr}"
        if target:
            self.edges.append(_edge(owner, target, "calls", self.path, node.lineno, "INFERRED", 0.7))
        self.generic_visit(node)


def python(path: str, text: str) -> dict:
    try:
        tree = ast.parse(text)
    except SyntaxError as error:
        return _record(path, "python", [_node(file_stem(path), path.rsplit("/", 1)[-1], path, 1, "file", None, None)], [], "partial", [f"line {error.lineno}: {error.msg}"])
    walk = _Walk(path, text)
    walk.visit(tree)
    return _finish(path, "python", text, walk.nodes, walk.edges)


#: Declarations by language, as (kind, pattern whose first group is the name), and imports.
_C_LIKE = (("class", r"^\s*(?:[\w:<>,*&\s]+\s)?(?:class|struct|enum|union)\s+(\w+)"), ("function", r"^[A-Za-z_][\w:<>,*&\s]*?[\s*&](\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{"))
PROFILES = {
    "javascript": ((("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")), r"""(?:from|require\()\s*["']([^"']+)["']"""),
    "rust": ((("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union|mod)\s+(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"), ("macro", r"^\s*macro_rules!\s+(\w+)")), r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "go": ((("class", r"^type\s+(\w+)\s+(?:struct|interface)"), ("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)")), r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$"""),
    "java": ((("class", r"^\s*(?:[\w@]+\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("function", r"^\s+(?:[\w@<>\[\],.?]+\s+)+(\w+)\s*\([^;{}]*\)\s*(?:throws [\w., ]+)?\{")), r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    "c": (_C_LIKE, r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]"""),
    "ruby": ((("class", r"^\s*(?:class|module)\s+([\w:]+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")), r"""^\s*require(?:_relative)?\s+["']([^"']+)"""),
    "php": ((("class", r"^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+(\w+)"), ("function", r"^\s*(?:\w+\s+)*function\s+&?(\w+)")), r"^\s*use\s+([\w\\]+)"),
    "shell": ((("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"),), r"^\s*(?:source|\.)\s+(\S+)"),
    "sql": ((("class", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)")), r"(?i)\breferences\s+([\w.]+)"),
    "kotlin": ((("class", r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)"), ("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)")), r"^\s*import\s+([\w.]+)"),
    "swift": ((("class", r"^\s*(?:\w+\s+)*(?:class|struct|enum|protocol|extension|actor)\s+(\w+)"), ("function", r"^\s*(?:\w+\s+)*func\s+(\w+)")), r"^\s*import\s+(\w+)"),
    "scala": ((("class", r"^\s*(?:\w+\s+)*(?:class|trait|object|enum)\s+(\w+)"), ("function", r"^\s*(?:\w+\s+)*def\s+(\w+)")), r"^\s*import\s+([\w.]+)"),
    "lua": ((("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"),), r"""require\s*\(?["']([^"']+)"""),
    "elixir": ((("class", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+[?!]?)")), r"^\s*(?:import|alias|use)\s+([\w.]+)"),
    "haskell": ((("class", r"^(?:data|newtype|class|type)\s+(\w+)"), ("function", r"^(\w+)\s*::")), r"^import\s+(?:qualified\s+)?([\w.]+)"),
    "r": ((("function", r"^\s*(\w[\w.]*)\s*(?:<-|=)\s*function"),), r"^\s*(?:library|require)\((\w+)\)"),
    "julia": ((("class", r"^\s*(?:mutable\s+)?(?:struct|module)\s+(\w+)"), ("function", r"^\s*function\s+(\w+)")), r"^\s*(?:using|import)\s+([\w.]+)"),
    "perl": ((("class", r"^\s*package\s+([\w:]+)"), ("function", r"^\s*sub\s+(\w+)")), r"^\s*use\s+([\w:]+)"),
}
CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
KEYWORDS = frozenset("if for while switch return catch function fn def func sizeof match and or not in print elif else new await".split())


def by_profile(language: str):
    """A reader of declarations, imports and calls by line; a line belongs to the last declaration before it."""
    kinds, imports = PROFILES[language]
    kinds, imports = [(k, re.compile(p)) for k, p in kinds], re.compile(imports)

    def read(path: str, text: str) -> dict:
        stem = file_stem(path)
        nodes, edges, used = [_node(stem, path.rsplit("/", 1)[-1], path, 1, "file", None, None)], [], {}
        owner, names = stem, {}
        for number, line in enumerate(text.split("\n"), 1):
            if found := imports.search(line):
                edges.append(_edge(stem, found[1], "imports", path, number))
                continue
            hit = next(((k, m[1]) for k, p in kinds if (m := p.match(line)) and m[1] not in KEYWORDS), None)
            if hit:
                kind, name = hit
                base = f"{stem}::{name}"
                used[base] = used.get(base, 0) + 1
                owner = base if used[base] == 1 else f"{base}__{used[base]}"
                nodes.append(_node(owner, name if kind == "class" else f"{name}()", path, number, kind, None, line.strip()[:256]))
                edges.append(_edge(stem, owner, "contains", path, number))
                names.setdefault(name, owner)
                continue
            for name in CALL.findall(line):
                if name not in KEYWORDS:
                    edges.append(_edge(owner, name, "calls", path, number, "INFERRED", 0.7))
        for edge in edges:
            if edge["relation"] == "calls" and edge["target"] in names:
                edge["target"] = names[edge["target"]]
        return _finish(path, language, text, nodes, edges)

    return read


def _finish(path: str, language: str, text: str, nodes: list, edges: list) -> dict:
    """Rationale comments and string references added, each with the nearest declaration above."""
    starts = sorted((n["source_line"], n["id"]) for n in nodes)

    def owner(line: int) -> str:
        return next((i for at, i in reversed(starts) if at < line), nodes[0]["id"])

    strings: dict[str, int] = {}
    for number, line in enumerate(text.split("\n"), 1):
        if note := RATIONALE.search(line):
            ident = f"{nodes[0]['id']}::rationale_{number}"
            nodes.append(_node(ident, f"{note[1]}: {note[2].strip()}", path, number, "rationale", None, None))
            edges.append(_edge(ident, owner(number), "rationale_for", path, number))
        for literal in IDENTIFIER.findall(line):
            if len(strings) < REFERENCES and not SECRETS.match(literal):
                strings.setdefault(literal, number)
    for literal, number in strings.items():
        nodes.append(_node(f"str::{literal}", literal, "", None, "reference", None, None))
        edges.append(_edge(owner(number), f"str::{literal}", "references", path, number))
    return _record(path, language, nodes, edges)


def manifest(path: str, text: str) -> dict:
    """The package, what it depends on, and, of tool configurations, commands and the names of their variables."""
    name = path.rsplit("/", 1)[-1]
    package, needs, environment = name, [], []
    if name == "package.json":
        data = json.loads(text)
        package = data.get("name", name)
        needs = [d for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for d in data.get(k, {})]
    elif name == "pyproject.toml":
        data = tomllib.loads(text)
        project = data.get("project", {})
        package = project.get("name", name)
        listed = [*project.get("dependencies", []), *(d for v in project.get("optional-dependencies", {}).values() for d in v)]
        needs = [re.match(r"[A-Za-z0-9_.-]+", d)[0] for d in listed if re.match(r"[A-Za-z0-9_.-]+", d)]
    elif name == "Cargo.toml":
        data = tomllib.loads(text)
        package = data.get("package", {}).get("name", name)
        needs = [d for k in ("dependencies", "dev-dependencies", "build-dependencies") for d in data.get(k, {})]
    elif name == "go.mod":
        package = (re.search(r"^module\s+(\S+)", text, re.M) or [None, name])[1]
        needs = re.findall(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v\S+", text, re.M)
    elif name == "pom.xml":
        root = ET.fromstring(text)
        space = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
        package = root.findtext(f"{space}artifactId", name)
        needs = [d.findtext(f"{space}artifactId", "") for d in root.iter(f"{space}dependency")]
    elif name == "setup.cfg":
        parser = configparser.ConfigParser()
        parser.read_string(text)
        package = parser.get("metadata", "name", fallback=name)
        needs = [x.strip() for x in parser.get("options", "install_requires", fallback="").split("\n") if x.strip()]
    else:
        for server, spec in json.loads(text).get("mcpServers", {}).items():
            needs.append(spec.get("command", server))
            environment += list(spec.get("env", {}))
    stem, own = file_stem(path), f"package::{package}"
    nodes = [_node(stem, name, path, 1, "file", None, None), _node(own, package, path, 1, "package", None, None)]
    edges = [_edge(stem, own, "contains", path, 1)] + [_edge(own, f"package::{d}", "depends_on", path, 1) for d in dict.fromkeys(needs) if d]
    for variable in dict.fromkeys(environment):
        nodes.append(_node(f"env::{variable}", variable, "", None, "env_var", None, None))
        edges.append(_edge(own, f"env::{variable}", "requires_env", path, 1))
    return _record(path, "manifest", nodes, edges)


MANIFESTS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "setup.cfg", ".mcp.json", "mcp.json")
#: Languages by extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "javascript",
    "tsx": "javascript", "vue": "javascript", "svelte": "javascript", "rs": "rust", "go": "go", "java": "java", "cs": "java", "c": "c",
    "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "cxx": "c", "m": "c", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell",
    "zsh": "shell", "sql": "sql", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "lua": "lua", "ex": "elixir",
    "exs": "elixir", "hs": "haskell", "r": "r", "jl": "julia", "pl": "perl", "pm": "perl", "md": "markdown", "markdown": "markdown",
    "mdx": "markdown", "rst": "rst", "txt": "text", "html": "html", "htm": "html",
}
READERS = {"python": python, "markdown": markdown, "rst": restructured, "text": plain, "html": html}
READERS |= {language: by_profile(language) for language in PROFILES}


def language_of(path: str, first_line: str = "") -> str | None:
    """By the extension, or else by the interpreter that the first line names (through env, with a version or not)."""
    name = path.rsplit("/", 1)[-1]
    if "." in name.lstrip(".") and (found := EXTENSIONS.get(name.rsplit(".", 1)[-1].lower())):
        return found
    if first_line.startswith("#!"):
        words = [w for w in first_line[2:].split() if not w.startswith("-") and "=" not in w]
        words = [w.rsplit("/", 1)[-1] for w in words]
        if words and words[0] == "env":
            words = words[1:]
        known = {"python": "python", "bash": "shell", "sh": "shell", "zsh": "shell", "node": "javascript", "deno": "javascript", "ruby": "ruby", "perl": "perl", "php": "php", "lua": "lua"}
        return known.get(re.sub(r"[\d.]+$", "", words[0])) if words else None
    return None


def reader_of(path: str):
    name = path.rsplit("/", 1)[-1]
    return manifest if name in MANIFESTS else READERS.get(language_of(path) or "")
