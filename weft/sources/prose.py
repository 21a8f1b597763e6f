"""Markdown, reStructuredText, plain text and HTML as sections and chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weft.plans.runtime import ship

#: Characters of a chunk, and of the tail of the one before that it repeats.
CHUNK, OVERLAP = 1200, 180
#: Characters of texts whose nodes and edges are handed on at once.
SLICE = 1 << 18
HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
LINK = re.compile(r"(?<!!)\[[^\]]*\]\(([^)\s#]+)[^)]*\)")
RULES = re.compile(r"^([=\-`:.'\"~^_*+#])\1{2,}\s*$")


def file_stem(path: str) -> str:
    """The path on one level, and 12 hex digits of its SHA-256."""
    return f"{re.sub(r'[^A-Za-z0-9]+', '_', path).strip('_')}_{hashlib.sha256(path.encode()).hexdigest()[:12]}"


def chunks(text: str, most: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(first line, text): paragraphs packed to ``most`` characters; longer ones are cut at lines, then anywhere.

    A chunk begins with whole lines of the end of the one before, up to ``overlap`` characters.
    """
    pieces: list[tuple[int, str]] = []
    number = 1
    for part in re.split(r"(\n[ \t]*(?:\n[ \t]*)+)", text):
        if part.strip():
            lead = len(part) - len(part.lstrip("\n"))
            pieces += _fit(part.strip("\n"), number + lead, most)
        number += part.count("\n")
    packed: list[tuple[int, str]] = []
    for line, piece in pieces:
        if packed and len(packed[-1][1]) + 2 + len(piece) <= most:
            packed[-1] = (packed[-1][0], f"{packed[-1][1]}\n\n{piece}")
        else:
            packed.append((line, piece))
    out = packed[:1]
    for line, piece in packed[1:]:
        tail = out[-1][1][-overlap:]
        if len(out[-1][1]) > overlap:
            tail = tail.partition("\n")[2] or tail
        out.append((line, f"{tail}\n{piece}"))
    return out


def _fit(paragraph: str, number: int, most: int) -> Iterator[tuple[int, str]]:
    held, first = "", number
    for k, line in enumerate(paragraph.split("\n")):
        while len(line) > most:
            if held:
                yield first, held
                held = ""
            yield number + k, line[:most]
            line = line[most:]
        if held and len(held) + 1 + len(line) > most:
            yield first, held
            held = ""
        if not held:
            first = number + k
        held = f"{held}\n{line}" if held else line
    if held.strip():
        yield first, held


def frontmatter(text: str) -> tuple[dict, int]:
    """Key and value of simple front matter, and how many lines it takes."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, 0
    for k, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            pairs = (x.partition(":") for x in lines[1:k] if ":" in x)
            return {a.strip(): b.strip().strip("\"'") for a, _, b in pairs}, k + 1
    return {}, 0


def markdown(path: str, text: str) -> dict:
    """Nodes and edges of one Markdown file: the document, its sections by a stack of headings, their chunks, links."""
    stem = file_stem(path)
    front, skip = frontmatter(text)
    state = ";".join(f"{k}={front[k]}" for k in ("status", "superseded_by", "resolution") if k in front) or None
    nodes = [_node(stem, path.rsplit("/", 1)[-1], path, 1, "document", None, state)]
    edges: list[dict] = []
    stack, body, fence, seen = [(0, stem)], [], None, {}
    lines = text.split("\n")

    def flush() -> None:
        content = "\n".join(x for _, x in body)
        if content.strip():
            owner = stack[-1][1]
            for k, (line, piece) in enumerate(chunks(content)):
                ident = f"{owner}::chunk_{k}"
                nodes.append(_node(ident, piece.strip().split("\n")[0], path, body[0][0] + line - 1, "chunk", piece, state))
                edges.append(_edge(owner, ident, "contains", path, body[0][0] + line - 1))
        body.clear()

    for number, line in enumerate(lines[skip:], skip + 1):
        mark = FENCE.match(line)
        if mark and (fence is None or (mark[1][0] == fence[0] and len(mark[1]) >= len(fence))):
            fence = mark[1] if fence is None else None
        heading = HEADING.match(line) if fence is None and not mark else None
        if heading:
            flush()
            level, title = len(heading[1]), heading[2]
            while stack[-1][0] >= level:
                stack.pop()
            base = f"{stack[-1][1]}::{re.sub(r'[^0-9a-z]+', '_', title.lower()).strip('_')}"
            seen[base] = seen.get(base, 0) + 1
            ident = base if seen[base] == 1 else f"{base}__{seen[base]}"
            nodes.append(_node(ident, title, path, number, "section", None, state))
            edges.append(_edge(stack[-1][1], ident, "contains", path, number))
            stack.append((level, ident))
            continue
        if fence is None:
            for target in LINK.findall(line):
                if "://" not in target and not target.startswith(("mailto:", "/")):
                    edges.append(_edge(stack[-1][1], _resolve(path, target), "references", path, number))
        body.append((number, line))
    flush()
    return _record(path, "markdown", nodes, edges)


def restructured(path: str, text: str) -> dict:
    """As ``markdown``, for titles that are underlined; levels are in order of the underlines' first use."""
    lines, out, order = text.split("\n"), [], []
    k = 0
    while k < len(lines):
        title, rule = lines[k], lines[k + 1] if k + 1 < len(lines) else ""
        if title.strip() and not RULES.match(title) and RULES.match(rule) and len(rule.rstrip()) >= len(title.rstrip()):
            if rule[0] not in order:
                order.append(rule[0])
            out += ["#" * min(6, order.index(rule[0]) + 1) + " " + title.strip(), ""]
            k += 2
            continue
        out.append("" if RULES.match(title) else title if not title.startswith("#") else "\\" + title)
        k += 1
    return markdown(path, "\n".join(out)) | {"language": "rst"}


def plain(path: str, text: str) -> dict:
    """The document and a chunk node for each chunk."""
    stem = file_stem(path)
    nodes = [_node(stem, path.rsplit("/", 1)[-1], path, 1, "document", None, None)]
    edges = []
    for k, (line, piece) in enumerate(chunks(text)):
        ident = f"{stem}::chunk_{k}"
        nodes.append(_node(ident, piece.strip().split("\n")[0], path, line, "chunk", piece, None))
        edges.append(_edge(stem, ident, "contains", path, line))
    return _record(path, "text", nodes, edges)


def html(path: str, text: str) -> dict:
    text = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ", text)
    text = re.sub(r"(?i)</(p|div|li|h[1-6]|tr)\s*>|<br\b[^>]*>", "\n\n", text)
    return plain(path, re.sub(r"(?s)<[^>]*>", " ", text)) | {"language": "html"}


def csv_table(text: str) -> str:
    """CSV as a Markdown table; cells lose line breaks, and bars are escaped."""
    import csv
    import io

    rows = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _resolve(path: str, target: str) -> str:
    parts = path.split("/")[:-1]
    for step in target.split("/"):
        if step == "..":
            parts = parts[:-1]
        elif step not in ("", "."):
            parts.append(step)
    return file_stem("/".join(parts))


def _node(ident, label, path, line, kind, docstring, signature) -> dict:
    return {"id": ident, "label": label[:256] or ident, "source_file": path, "source_line": line, "docstring": docstring, "node_type": kind, "signature": signature}


def _edge(source, target, relation, path, line, confidence="EXTRACTED", score=None) -> dict:
    return {"source": source, "target": target, "relation": relation, "confidence": confidence, "confidence_score": score, "source_file": path, "source_line": line}


def _record(path, language, nodes, edges, status="complete", notes=()) -> dict:
    return {"file_path": path, "language": language, "status": status, "notes": list(notes), "nodes": nodes, "edges": edges}


EXTRACTION = (
    "file_path string, language string, status string, notes array<string>, "
    "nodes array<struct<id:string,label:string,source_file:string,source_line:int,docstring:string,node_type:string,signature:string>>, "
    "edges array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_file:string,source_line:int>>"
)


def extract(files: DataFrame) -> DataFrame:
    """One record a row of (path, text): the file's nodes and edges, and how far it was understood.

    The reader is chosen by the path's extension; what no reader knows is "unsupported", never silently empty.
    """
    from weft.sources.code import reader_of

    ship(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for path, text in zip(batch["path"], batch["text"], strict=True):
                reader = reader_of(path)
                try:
                    rows.append(reader(path, text or "") if reader else _record(path, "unknown", [], [], "unsupported", ["no reader"]))
                except (ValueError, SyntaxError, RecursionError) as error:
                    rows.append(_record(path, "unknown", [], [], "partial", [f"{type(error).__name__}: {error}"[:200]]))
                size += len(text or "")
                # Nodes and edges are in memory several times until they are handed on.
                if size >= SLICE:
                    yield pd.DataFrame(rows)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "text").mapInPandas(read, EXTRACTION)
