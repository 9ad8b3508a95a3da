"""Files to paragraphs: plain text, Markdown, HTML and DOCX, with section breadcrumbs.

Files are listed and read by Spark's binary source in path order; each is parsed whole inside an
Arrow batch.  A file that cannot be parsed yields one row with its error instead of failing the scan.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Paragraph = tuple[str, int, list[str]]
SCHEMA = "path string, document_name string, paragraph_index int, page int, section_path array<string>, text string, error string"


def heading(line: str) -> str | None:
    """'capital' or 'title' for a line that looks like a heading, else None."""
    t = line.strip()
    if not t or len(t) > 80 or t[-1] in ".,;:?!":
        return None
    if t.upper() == t and re.search("[A-Z]", t) and len(t) > 3:
        return "capital"
    parts = t.split()
    if re.fullmatch(r"[A-Z][A-Za-z0-9 &/\-]{2,80}", t) and sum(w[0].isupper() for w in parts) >= 0.6 * len(parts):
        return "title"
    return None


def text_paragraphs(text: str, page: int = 1, path: list[str] | None = None) -> tuple[list[Paragraph], list[str]]:
    """Blank-line blocks with breadcrumbs, and the breadcrumb at the end (for the next page)."""
    stack, out = list(path or []), []
    for block in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in block.splitlines() if x.strip()]
        if not lines:
            continue
        kind = heading(lines[0])
        if kind == "capital":
            stack = [lines[0]]
        elif kind == "title":
            stack = [*stack[:1], lines[0]]
        body = lines[1:] if kind else lines
        if body:
            out.append((" ".join(body), page, list(stack)))
    return out, stack


class _Html(HTMLParser):
    """Paragraph texts below a stack of h1 to h4."""

    BLOCKS = {"p", "li", "blockquote", "pre", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[int, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.out: list[Paragraph] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.open.append((tag, []))

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for _, parts in self.open:
                parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open:
                t, parts = self.open.pop()
                text = re.sub(r"\s+", " ", "".join(parts)).strip()
                if text and re.fullmatch("h[1-4]", t):
                    level = int(t[1])
                    self.stack = [*[s for s in self.stack if s[0] < level], (level, text)]
                elif text:
                    self.out.append((text, 1, [s for _, s in self.stack]))
                if t == tag:
                    break


def html_paragraphs(text: str) -> list[Paragraph]:
    p = _Html()
    p.feed(text)
    p.close()
    return p.out


def markdown_paragraphs(text: str) -> list[Paragraph]:
    """Headings of level 1 to 4 set the breadcrumb; paragraphs, items, quotes, table rows and fenced code are paragraphs."""
    stack: list[tuple[int, str]] = []
    out: list[Paragraph] = []
    held: list[str] = []
    fence = False

    def flush() -> None:
        if held:
            out.append((re.sub(r"\s+", " ", " ".join(held)).strip(), 1, [s for _, s in stack]))
            held.clear()

    plain = lambda s: re.sub(r"(\*\*|__|`)", "", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)).strip()
    for line in [*text.splitlines(), ""]:
        if line.strip().startswith(("```", "~~~")):
            flush()
            fence = not fence
            continue
        mark = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        item = re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line)
        if fence:
            held.append(line)
        elif mark:
            flush()
            level = len(mark.group(1))
            if level <= 4:
                stack[:] = [*[s for s in stack if s[0] < level], (level, plain(mark.group(2)))]
            else:
                held.append(plain(mark.group(2)))
                flush()
        elif not line.strip() or re.fullmatch(r"[\s|:\-]+", line):
            flush()
        elif item or line.lstrip().startswith("|"):
            flush()
            held.append(plain(item.group(1) if item else re.sub(r"\s*\|\s*", " ", line)))
            if not item:
                flush()
        else:
            held.append(plain(line.lstrip("> ")))
    flush()
    return [p for p in out if p[0]]


def docx_paragraphs(data: bytes) -> list[Paragraph]:
    """Body paragraphs with a breadcrumb by heading style, table cells after the body; a paragraph without style is body."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{ns}body")
    stack: list[tuple[int, str]] = []
    out: list[Paragraph] = []
    text = lambda p: "".join(t.text or "" for t in p.iter(f"{ns}t")).strip()
    for p in body.findall(f"{ns}p"):
        style = p.find(f"{ns}pPr/{ns}pStyle")
        level = re.fullmatch(r"heading\s*(\d+)", (style.get(f"{ns}val") or "").lower()) if style is not None else None
        said = text(p)
        if said and level:
            n = int(level.group(1))
            stack = [*[s for s in stack if s[0] < n], (n, said)]
        elif said:
            out.append((said, 1, [s for _, s in stack]))
    for table in body.findall(f"{ns}tbl"):
        out += [(said, 1, [s for _, s in stack]) for p in table.iter(f"{ns}p") if (said := text(p))]
    return out


def pdf_paragraphs(data: bytes) -> list[Paragraph]:
    """Pages in order with the breadcrumb carried over; a page that fails is skipped.  Needs a PDF reader to be installed."""
    import pypdf

    out: list[Paragraph] = []
    path: list[str] = []
    for i, page in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1):
        try:
            found, path = text_paragraphs(page.extract_text() or "", i, path)
        except Exception:  # noqa: BLE001, S112
            continue
        out += found
    return out


PARSERS: dict[str, Callable[[bytes], list[Paragraph]]] = {
    ".txt": lambda b: text_paragraphs(b.decode("utf-8", "replace"))[0], ".md": lambda b: markdown_paragraphs(b.decode("utf-8", "replace")),
    ".markdown": lambda b: markdown_paragraphs(b.decode("utf-8", "replace")), ".html": lambda b: html_paragraphs(b.decode("utf-8", "replace")), ".docx": docx_paragraphs, ".pdf": pdf_paragraphs,
}


def read_paragraphs(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], list[Paragraph]]] | None = None) -> DataFrame:
    """Paragraphs of all files below a folder whose extension has a parser; see SCHEMA.

    paragraph_index counts from 0 in a file.  A broken file gives one row with ``error`` and no text; an empty one gives none.
    """
    known = parsers or PARSERS
    pattern = "(?i)(" + "|".join(re.escape(e) for e in known) + r")\z"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(pattern)).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    found = known["." + name.rsplit(".", 1)[-1].lower()](bytes(data))
                    rows += [(path, name, i, page, crumbs, text, None) for i, (text, page, crumbs) in enumerate(found)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, name, 0, 1, [], None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "document_name", "paragraph_index", "page", "section_path", "text", "error"])

    return files.mapInPandas(parse, SCHEMA)
