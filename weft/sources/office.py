"""Word and Excel files as Markdown, and compiler indexes in JSON as graphs; the standard library only."""

from __future__ import annotations

import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile

from weft.sources.prose import _edge, _node, _record, markdown

#: Bytes that a part of an archive may unpack to, and cells of a sheet.
MOST_BYTES, MOST_CELLS = 50 << 20, 200_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _part(archive: zipfile.ZipFile, name: str) -> ET.Element:
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} unpacks to over {MOST_BYTES} bytes")
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise ValueError(f"{name} declares a document type")
    return ET.fromstring(raw)


def docx(path: str, content: bytes) -> dict:
    """Paragraphs, headings by their style, and tables row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _part(archive, "word/document.xml").find(f"{WORD}body")
    lines = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    for block in body if body is not None else ():
        if block.tag == f"{WORD}p":
            style = block.find(f"{WORD}pPr/{WORD}pStyle")
            level = re.match(r"[Hh]eading\s*(\d)", style.get(f"{WORD}val", "")) if style is not None else None
            lines += [("#" * int(level[1]) + " " if level else "") + text(block), ""]
        elif block.tag == f"{WORD}tbl":
            lines += ["| " + " | ".join(text(c) for c in row.iter(f"{WORD}tc")) + " |" for row in block.iter(f"{WORD}tr")] + [""]
    return markdown(path, "\n".join(lines)) | {"language": "docx"}


def xlsx(path: str, content: bytes) -> dict:
    """Each sheet as a section with its rows; shared strings are looked up."""
    lines, cells = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = ["".join(t.text or "" for t in e.iter(f"{SHEET}t")) for e in _part(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)):
            lines += [f"## {name.rsplit('/', 1)[-1][:-4]}", ""]
            for row in _part(archive, name).iter(f"{SHEET}row"):
                values = []
                for cell in row.iter(f"{SHEET}c"):
                    cells += 1
                    raw = cell.findtext(f"{SHEET}v", "") or "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                    values.append(shared[int(raw)] if cell.get("t") == "s" and raw else raw)
                if cells > MOST_CELLS:
                    raise ValueError(f"over {MOST_CELLS} cells")
                lines.append("| " + " | ".join(values) + " |")
            lines.append("")
    return markdown(path, "\n".join(lines)) | {"language": "xlsx"}


def scip(path: str, text: str) -> dict:
    """A compiler index in JSON: documents and symbols as nodes; definitions, references and relationships as edges."""
    nodes, edges = [], []
    for document in json.loads(text).get("documents", []):
        place = document.get("relative_path", "")
        if not place or place.startswith("/") or ".." in place.split("/"):
            raise ValueError(f"bad path in the index: {place!r}")
        own = "scip_document_" + hashlib.sha256(place.encode()).hexdigest()[:16]
        nodes.append(_node(own, place.rsplit("/", 1)[-1], place, 1, "file", None, None))
        for symbol in document.get("symbols", []):
            name = symbol["symbol"]
            label = symbol.get("display_name") or re.split(r"[/#.`]", name.rstrip("#./()`"))[-1]
            nodes.append(_node(name, label, place, None, "function" if name.endswith("().") else "class", "\n".join(symbol.get("documentation", [])) or None, None))
            for link in symbol.get("relationships", []):
                relation = "scip_impl" if link.get("is_implementation") else "scip_typed" if link.get("is_type_definition") else "scip_ref"
                edges.append(_edge(name, link["symbol"], relation, place, None, "EXTRACTED", 1.0))
        for seen in document.get("occurrences", []):
            relation = "scip_def" if seen.get("symbol_roles", 0) & 1 else "scip_ref"
            edges.append(_edge(own, seen["symbol"], relation, place, seen["range"][0] + 1, "EXTRACTED", 1.0))
    return _record(path, "scip", nodes, edges)
