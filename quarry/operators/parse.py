"""Markdown and HTML documents to blocks, anchors, links, metas, title, summary.

One scanner takes both: at the beginning of a line it looks for Markdown's block forms, elsewhere for
links, tags, entities and text. It is a state machine over a document, which DataFrame functions
cannot express, so it runs over Arrow batches; documents are parsed once and all tables derive from
that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.links import normalize_link
from quarry.functions.text import path_title, slug
from quarry.session import small_batches

# Tags that end a block, named entities, limits.
BLOCK_TAGS = frozenset(
    "p div li ul ol pre blockquote section article table tr td th thead tbody tfoot header footer main nav aside figure figcaption dl dt dd hgroup hr h1 h2 h3 h4 h5 h6".split()
)
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "...", "mdash": "-", "ndash": "-", "lsquo": "'", "rsquo": "'",
    "ldquo": '"', "rdquo": '"', "copy": "©", "reg": "®", "trade": "™", "deg": "°", "plusmn": "±", "times": "×", "middot": "·", "bull": "•", "laquo": "«", "raquo": "»",
}
META_PREFIX, LIST_METAS = "kb-", ("tags", "caps")
MAX_METAS, MAX_META_VALUE, MAX_LINKS, SUMMARY_BYTES = 256, 1024, 4096, 512
#: Characters and documents that a worker holds parsed before it hands them on.
PORTION_CHARS, PORTION_ROWS = 1 << 20, 256

_FENCE = re.compile(r"[ \t]{0,3}(`{3,}(?=[^`\n]*(?:\n|\Z))|~{3,})([^\n]*)(?:\n|\Z)")
_HEADING = re.compile(r"[ \t]{0,3}(#+)(?:[ \t]+([^\n]*)|)(?:\n|\Z)")
_UNDERLINE = re.compile(r"[ \t]{0,3}(?:(=+)|-+)[ \t\r]*(?:\n|\Z)")
_BLANK = re.compile(r"[ \t\r]*(?:\n|\Z)")
_SKIP = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)")
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,7})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]*));")
_WIKI = re.compile(r"\[\[([^\n]*?)\]\]")
_LINK_TEXT = re.compile(r"\[([^\[\]\n]*)\]\(")
_PLAIN = re.compile(r"[^\s<&\[]+|\s+|.", re.S)
_SPACE = re.compile(r"[ \t\r\n\f\v]+")


@dataclass
class Parsed:
    title: str = ""
    blocks: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    metas: list[dict] = field(default_factory=list)
    anchors: list[str] = field(default_factory=list)


def decode_entities(text: str) -> str:
    """Unknown entities stay as they are."""

    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


def _attributes(text: str) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for m in _ATTRIBUTE.finditer(text):
        out[(m[1] or m[5]).lower()] = next((v for v in m.group(2, 3, 4) if v is not None), None) if m[1] else None
    return out


class _Scanner:
    def __init__(self, text: str, path: str):
        self.text, self.path, self.out = text, path, Parsed()
        self.words: list[str] = []  # text of the open block
        self.start, self.level, self.name, self.code = 0, 0, None, False
        self.anchor: tuple[dict | None, list[str]] | None = None
        self.heading_title = self.tag_title = self.prose_title = None
        self.in_title: list[str] | None = None
        self.codes = 0

    # -- blocks

    def put(self, text: str, at: int) -> None:
        if not self.words:
            text = text.lstrip(" \t\r\n\f\v")
            if not text:
                return
            self.start = at
        self.words.append(text)
        if self.in_title is not None:
            self.in_title.append(text)
        if self.anchor is not None:
            self.anchor[1].append(text)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip(" ")
        if text:
            name = self.name or (slug(text) if self.level else "") or f"b{len(self.out.blocks)}"
            self.out.blocks.append({"id": name, "text": text, "heading_level": self.level, "offset": len(self.text[: self.start].encode("utf-8", "surrogatepass"))})
            if self.level == 1 and self.heading_title is None:
                self.heading_title = text
            if not self.level and not self.code and self.prose_title is None:
                self.prose_title = text
            if self.level or self.code or self.name:
                self.add_anchor(name)
        self.words, self.level, self.name, self.code = [], 0, None, False

    def add_anchor(self, name: str) -> None:
        if name and name not in self.out.anchors:
            self.out.anchors.append(name)

    def line(self, at: int) -> int:
        """Take a block form that begins here; the place after it, or ``at`` if there is none."""
        text = self.text
        if m := _BLANK.match(text, at):
            self.flush()
            return m.end()
        if m := _FENCE.match(text, at):
            return self.fence(m)
        if m := _HEADING.match(text, at):
            marks, words = len(m[1]), (m[2] or "").strip()
            self.flush()
            if marks <= 6:
                words = words.rstrip("#").rstrip()
                self.level = marks
            self.put(decode_entities(words), at)
            if marks > 6:
                self.name = slug(words) or None
            if self.words:
                self.words.append(" ")
            return m.end()
        if (m := _UNDERLINE.match(text, at)) and self.words and not self.level and not self.code and "".join(self.words).strip():
            self.level = 1 if m[1] else 2
            self.flush()
            return m.end()
        return at

    def fence(self, m: re.Match) -> int:
        self.flush()
        self.codes += 1
        lang = (m[2].split() or [""])[0].lower()[:31]
        end = re.compile(rf"^[ \t]{{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", re.M).search(self.text, m.end())
        body = self.text[m.end() : end.start() if end else len(self.text)]
        self.put(body, m.start())
        self.start, self.name, self.code = m.start(), f"code-{lang}-{self.codes}" if lang else f"code-{self.codes}", True
        self.flush()
        return min(end.end() + 1, len(self.text)) if end else len(self.text)

    # -- within a line

    def add_link(self, target: str, text: str) -> dict | None:
        path = normalize_link(self.path, target)
        if path is None or len(self.out.links) >= MAX_LINKS:
            return None
        self.out.links.append(link := {"target": path, "text": text})
        return link

    def bracket(self, at: int) -> int:
        """A wikilink or Markdown link; an image's text is kept, but it is no link."""
        text, image = self.text, at > 0 and self.text[at - 1] == "!"
        if m := _WIKI.match(text, at):
            target, bar, shown = m[1].partition("|")
            target, shown = target.strip(), (shown.strip() if bar else target.strip())
            if target and shown:
                if not image:
                    self.add_link(target, shown)
                self.put(decode_entities(shown), at)
                return m.end()
        if m := _LINK_TEXT.match(text, at):
            end = self.target_end(m.end())
            if end is not None:
                inner = text[m.end() : end].strip()
                if inner.startswith("<") and ">" in inner:
                    target = inner[1 : inner.index(">")]
                else:
                    target = (inner.split() or [""])[0].removesuffix("\\")
                if not image:
                    self.add_link(target, m[1])
                self.put(decode_entities(m[1]), at)
                return end + 1
        self.put("[", at)
        return at + 1

    def target_end(self, at: int) -> int | None:
        """Where the parenthesis that is open closes on its line, outside quotes."""
        depth, quote = 1, ""
        for i in range(at, len(self.text)):
            c = self.text[i]
            if c == "\n":
                return None
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if not depth:
                    return i
        return None

    def tag(self, at: int) -> int:
        if m := _SKIP.match(self.text, at):
            return m.end()
        m = _TAG.match(self.text, at)
        if not m:
            self.put("<", at)
            return at + 1
        closing, name, rest = bool(m[1]), m[2].lower(), m[3]
        single = rest.rstrip().endswith("/")
        attributes = _attributes(rest) if rest.strip() else {}
        if attributes.get("id"):
            self.add_anchor(decode_entities(attributes["id"]))
        if name == "a":
            if self.anchor is not None and self.anchor[0] is not None and closing:
                self.anchor[0]["text"] = _SPACE.sub(" ", "".join(self.anchor[1])).strip()
            self.anchor = None if closing else (self.add_link(decode_entities(attributes.get("href") or ""), ""), [])
        elif name in ("script", "style") and not closing and not single:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(self.text, m.end())
            return end.end() if end else len(self.text)
        elif name == "title":
            if closing:
                if self.in_title is not None and self.tag_title is None:
                    self.tag_title = _SPACE.sub(" ", "".join(self.in_title)).strip() or None
                self.in_title = None
            else:
                self.flush()
                self.in_title = []
        elif name == "br":
            self.put(" ", at)
        elif name in BLOCK_TAGS:
            self.flush()
            if not closing and not single and len(name) == 2 and name[0] == "h" and name[1].isdigit():
                self.level = int(name[1])
        return m.end()

    def run(self) -> Parsed:
        text, at = self.text, 0
        while at < len(text):
            if at == 0 or text[at - 1] == "\n":
                after = self.line(at)
                if after > at:
                    at = after
                    continue
            c = text[at]
            if c == "[":
                at = self.bracket(at)
            elif c == "<":
                at = self.tag(at)
            elif c == "&" and (m := _ENTITY.match(text, at)):
                self.put(decode_entities(m[0]), at)
                at = m.end()
            else:
                m = _PLAIN.match(text, at)
                end = m.end()
                if (line := text.find("\n", at, end)) >= 0:
                    end = line + 1
                self.put(text[at:end], at)
                at = end
        self.flush()
        self.out.title = self.heading_title or self.tag_title or self.prose_title or path_title(self.path)
        return self.out


def _add_meta(out: list[dict], key: str, value: str) -> None:
    value = value.encode()[:MAX_META_VALUE].decode("utf-8", "ignore")
    values = [v.strip() for v in value.split(",")] if key in LIST_METAS else [value.strip()]
    out += [{"key": key, "value": v} for v in values if v or key not in LIST_METAS][: MAX_METAS - len(out)]


def front_matter(text: str) -> tuple[str | None, str]:
    """The lines between a first line ``---`` and the next ``---`` or ``...``, and what follows."""
    m = re.match(r"---[ \t\r]*\n((?s:.*?))^[ \t]*(?:---|\.\.\.)[ \t\r]*(?:\n|\Z)", text, re.M)
    return (m[1], text[m.end() :]) if m else (None, text)


def _scalar(text: str) -> str:
    text = text.strip()
    if text[:1] in ("'", '"'):
        return text[1:].partition(text[0])[0]
    return text.partition("#")[0].strip()


def front_matter_metas(block: str) -> list[dict]:
    out: list[dict] = []
    listed = None
    for line in block.split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if re.match(r"-\s", line):
            if listed:
                _add_meta(out, listed, _scalar(line[1:]))
            continue
        key, colon, value = line.partition(":")
        key = key.strip().lower()
        if not colon:
            continue
        listed = None
        if key.startswith(META_PREFIX) and len(key) > len(META_PREFIX):
            key, value = key.removeprefix(META_PREFIX), _scalar(value)
            if value.startswith("[") and value.endswith("]"):
                value = value[1:-1]
            _add_meta(out, key, value)
            listed = key if not value else None
    return out


def html_metas(text: str) -> list[dict]:
    out: list[dict] = []
    for m in re.finditer(r"""<meta(?=[\s/>])((?:"[^"]*"|'[^']*'|[^>"'])*)>""", text, re.I):
        found = _attributes(m[1])
        name = (found.get("name") or "").lower()
        if name.startswith(META_PREFIX) and len(name) > len(META_PREFIX):
            _add_meta(out, name.removeprefix(META_PREFIX), found.get("content") or "")
    return out


def parse_document(text: str, path: str, index_front_matter: bool = False) -> Parsed:
    """``index_front_matter``: scan front matter as prose too."""
    block, body = front_matter(text)
    scanner = _Scanner(text if index_front_matter or block is None else body, path)
    out = scanner.run()
    out.metas = ((front_matter_metas(block) if block is not None else []) + html_metas(text))[:MAX_METAS]
    return out


def summary_of(blocks: list[dict]) -> str:
    first = next((b["text"] for b in blocks if not b["heading_level"]), "")
    return first.encode()[:SUMMARY_BYTES].decode("utf-8", "ignore").strip()


def limits_reached(f: Parsed) -> list[str]:
    """Names of the limits that a document has reached; what lies beyond them is left out."""
    values = any(len(m["value"].encode()) >= MAX_META_VALUE for m in f.metas)
    return [name for name, hit in (("links", len(f.links) >= MAX_LINKS), ("metas", len(f.metas) >= MAX_METAS), ("values", values)) if hit]


_SCHEMA = (
    "title string, blocks array<struct<id:string,text:string,heading_level:int,offset:long>>, links array<struct<target:string,text:string>>, "
    "metas array<struct<key:string,value:string>>, anchors array<string>, summary string, at_limit array<string>"
)


def _portions(texts: pd.Series, paths: pd.Series) -> Iterator[list[Parsed]]:
    """What is found in a batch, in portions of few bytes of text: parsed, a text takes many times its size."""
    out, size = [], 0
    for t, p in zip(texts, paths, strict=True):
        t = "" if t is None else t
        if out and (size + len(t) > PORTION_CHARS or len(out) == PORTION_ROWS):
            yield out
            out, size = [], 0
        out.append(parse_document(t, p or ""))
        size += len(t)
    yield out


def _frame(found: list[Parsed]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "title": [f.title for f in found],
            "blocks": [f.blocks for f in found],
            "links": [f.links for f in found],
            "metas": [f.metas for f in found],
            "anchors": [f.anchors for f in found],
            "summary": [summary_of(f.blocks) for f in found],
            "at_limit": [limits_reached(f) for f in found],
        }
    )


def parsed(text: str = "source", path: str = "path") -> Column:
    """A struct of all that ``parse_document`` finds; null for a null text."""

    @F.pandas_udf(_SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, paths in batches:
            yield from map(_frame, _portions(texts, paths))

    # else Spark copies it into filters on what it finds, and each task parses twice, in two workers
    return run.asNondeterministic()(F.col(text), F.col(path))


def parse_table(documents: DataFrame) -> DataFrame:
    """corpus, path, source, ... with title, blocks, links, metas, anchors, summary added."""
    small_batches(documents.sparkSession)
    rows = documents.withColumn("_p", parsed())
    return rows.select(*documents.columns, "_p.*").withColumn("heading_count", F.size(F.filter("blocks", lambda b: b["heading_level"] > 0)))


def chunks(parsed_docs: DataFrame) -> DataFrame:
    return parsed_docs.select("id", F.posexplode("blocks").alias("ord", "b")).select(F.col("id").alias("doc_id"), "ord", F.col("b.text").alias("text"))


def metas(parsed_docs: DataFrame) -> DataFrame:
    return parsed_docs.select("corpus", "path", F.explode("metas").alias("m")).select("corpus", "path", "m.key", "m.value").distinct()


def links(parsed_docs: DataFrame) -> DataFrame:
    return parsed_docs.select("corpus", F.col("path").alias("src_path"), F.explode("links").alias("l")).select("corpus", "src_path", F.col("l.target").alias("dst_path")).distinct()


def searchable_text(title: Column, blocks: Column) -> Column:
    """Title twice, then every block."""
    return F.concat_ws(" ", title, title, F.transform(blocks, lambda b: b["text"]))
