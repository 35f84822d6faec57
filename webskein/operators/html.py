"""HTML pages to clean blocks and to structured fields.

Built on the standard library's tokenizer with a small tree builder that recovers as browsers do where pages leave tags open: a block start closes an open paragraph, items, cells and
rows close their like, an end tag closes what is open within it, void elements have no content, and everything is closed at the end. This is the only row-wise Python of the engine; each
page is read once and both extractors share the tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset((*HEADINGS, "code", "ol", "p", "pre", "table", "ul"))
INLINE = frozenset("strong em b i u s small mark span a code kbd samp var sub sup q cite abbr time data del ins bdo bdi".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section summary table ul".split()) | set(HEADINGS)
#: A start tag closes these, if open within the nearest of the listed scopes.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
for _part in ("thead", "tbody", "tfoot"):
    CLOSES[_part] = ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})
NAV_TAGS = {"nav", "footer"}
NAV_ROLES = {"menu", "menubar", "navigation"}
NAV_NAMES = {f"{a}-{b}" for a in ("main", "primary", "site") for b in ("menu", "nav")} | {"footer", "menu", "nav", "navbar", "navigation", "site-footer"}


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def named(self, *names: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.name in names)

    def own(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name in names]

    def above(self, *names: str) -> Node | None:
        n = self.parent
        while n is not None and n.name not in names:
            n = n.parent
        return n

    def strings(self) -> Iterator[tuple[str, Node]]:
        """Text pieces with the element that holds them."""
        stack: list = [(self, iter(self.children))]
        while stack:
            node, rest = stack[-1]
            for c in rest:
                if isinstance(c, str):
                    yield c, node
                else:
                    stack.append((c, iter(c.children)))
                    break
            else:
                stack.pop()

    def text(self, gap: str = "") -> str:
        pieces = [s for s, _ in self.strings()]
        return gap.join(x for x in (p.strip() for p in pieces) if x) if gap else "".join(pieces)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.at = self.root

    def _open(self, name: str) -> Node | None:
        n = self.at
        while n is not None and n.name != name:
            n = n.parent
        return n

    def _close_to(self, names: set[str], scopes: set[str]) -> None:
        n, found = self.at, None
        while n is not None and n.name not in scopes:
            if n.name in names:
                found = n
            n = n.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head") and self._open(tag) is not None:
            return
        if tag == "body" and (head := self._open("head")) is not None:
            self.at = head.parent
        if tag in CLOSES_P:
            self._close_to({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        if tag in HEADINGS and self.at.name in HEADINGS:
            self.at = self.at.parent
        if tag == "a" and self._open("a") is not None:
            self._close_to({"a"}, {"table", "td", "th"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "p" and self._open("p") is None:
            return
        found = self._open(tag)
        if found is None or found is self.root:
            return
        if tag not in ("table", "tr", "tbody", "thead", "tfoot"):  # an end tag doesn't reach out of a cell
            cell = self.at
            while cell is not found and cell.name not in ("td", "th"):
                cell = cell.parent
            if cell is not found:
                return
        self.at = found.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def one_line(s: str) -> str:
    return " ".join(s.split())


def http_url(value: str, base: str | None = None) -> str | None:
    """An absolute http(s) url without fragment, or None."""
    try:
        whole = urldefrag(urljoin(base, value.strip()) if base else value.strip())[0]
        parts = urlsplit(whole)
        bad = parts.scheme.lower() not in ("http", "https") or not parts.hostname or re.search(r"\s", whole) or "\\" in parts.netloc
        parts.port  # noqa: B018 - a bad port raises
    except ValueError:
        return None
    return None if bad or not value.strip() else whole


def origin(url: str) -> tuple[str, str | None, int]:
    p = urlsplit(url)
    return p.scheme.lower(), p.hostname, p.port or (443 if p.scheme.lower() == "https" else 80)


def _is_navigation(n: Node) -> bool:
    names = {n.attrs.get("id", "").strip().casefold(), *n.attrs.get("class", "").casefold().split()}
    return n.name in NAV_TAGS or n.attrs.get("role", "").strip().casefold() in NAV_ROLES or bool(names & NAV_NAMES)


def prune(n: Node, drop: Callable[[Node], bool]) -> None:
    stack = [n]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not drop(c)]
        stack += [c for c in x.children if isinstance(c, Node)]


class Cleaner:
    """Ordered blocks of a pruned tree. Rendering returns pairs (plain, markdown)."""

    def __init__(self, base: str | None):
        self.base, self.blocks, self.path = base, [], []

    def emit(self, kind: str, plain: str, markdown: str) -> None:
        if plain:
            self.blocks.append({"pos": len(self.blocks), "kind": kind, "text": plain, "markdown": markdown, "heading_path": [t for _, t in self.path]})

    def decorated(self, n: Node, plain: str, markdown: str) -> str:
        if n.name == "code" and one_line(plain):
            tick = "`" * (1 + max([0, *map(len, re.findall("`+", plain))]))
            return tick + one_line(plain) + tick
        if n.name == "a" and self.base and "href" in n.attrs:
            to = http_url(n.attrs["href"], self.base)
            return f"[{one_line(markdown)}]({to})" if to and one_line(markdown) else markdown
        return markdown

    def inline(self, n: Node) -> tuple[str, str]:
        plain, markdown = [], []
        for c in n.children:
            if isinstance(c, str):
                p = m = c
            elif c.name == "br":
                p = m = "\n"
            else:
                p, m = self.inline(c)
                m = self.decorated(c, p, m)
                if c.name not in INLINE:
                    p, m = f" {p} ", f" {m} "
            plain.append(p)
            markdown.append(m)
        return one_line("".join(plain)), one_line("".join(markdown))

    def list_lines(self, n: Node, depth: int = 0) -> list[tuple[str, str]]:
        lines = []
        for i, item in enumerate(n.own("li"), 1):
            parts = []
            for c in item.children:
                if isinstance(c, str):
                    parts.append((c, c))
                elif c.name not in ("ul", "ol"):
                    p, m = self.inline(c)
                    parts.append((p, self.decorated(c, p, m)))
            lead = "  " * depth + (f"{i}. " if n.name == "ol" else "- ")
            plain, markdown = (one_line(" ".join(x)) for x in (zip(*parts) if parts else ((), ())))
            if plain:
                lines.append((lead + plain, lead + markdown))
            for inner in item.named("ul", "ol"):
                if inner.above("ul", "ol") is n:
                    lines += self.list_lines(inner, depth + 1)
        return lines

    def table(self, n: Node) -> tuple[str, str]:
        rows = [[self.inline(c) for c in r.own("td", "th")] for r in n.named("tr") if r.above("table") is n]
        rows = [r for r in rows if r]
        if not rows:
            return "", ""
        wide = max(map(len, rows))
        rows = [r + [("", "")] * (wide - len(r)) for r in rows]
        pipe = lambda cells: f"| {' | '.join(cells)} |"
        shown = [pipe([m.replace("|", "\\|") for _, m in r]) for r in rows]
        return "\n".join(" | ".join(p for p, _ in r) for r in rows), "\n".join([shown[0], pipe(["---"] * wide), *shown[1:]])

    def block(self, n: Node) -> None:
        if n.name in HEADINGS:
            plain, markdown = self.inline(n)
            if plain:
                level = HEADINGS.index(n.name) + 1
                self.path = [*((k, t) for k, t in self.path if k < level), (level, plain)]
                self.emit("heading", plain, f"{'#' * level} {markdown}")
        elif n.name == "p":
            self.emit("paragraph", *self.inline(n))
        elif n.name in ("ul", "ol"):
            lines = self.list_lines(n)
            self.emit("list", "\n".join(p for p, _ in lines), "\n".join(m for _, m in lines))
        elif n.name == "table":
            self.emit("table", *self.table(n))
        else:
            lines = [x.rstrip() for x in n.text().splitlines()]
            code = re.sub(r"\A\n+|\n+\Z", "", "\n".join(lines))
            if code.strip():
                fence = "`" * max(3, 1 + max([0, *map(len, re.findall("`+", code))]))
                self.emit("code", code, f"{fence}\n{code}\n{fence}")

    def flow(self, n: Node) -> None:
        pending: list[tuple[str, str]] = []

        def flush() -> None:
            if pending:
                self.emit("paragraph", *(one_line(" ".join(x)) for x in zip(*pending)))
                pending.clear()

        for c in n.children:
            if isinstance(c, str):
                if one_line(c):
                    pending.append((one_line(c),) * 2)
            elif c.name in BLOCKS:
                flush()
                self.block(c)
            elif any(x.name in BLOCKS for x in c.walk()):
                flush()
                self.flow(c)
            else:
                plain, markdown = self.inline(c)
                pair = (plain, self.decorated(c, plain, markdown))
                if c.name in INLINE:
                    pending += [pair] if plain else []
                else:
                    flush()
                    self.emit("paragraph", *pair)
        flush()


def _title(root: Node) -> str:
    found = next(root.named("title"), None)
    return one_line(found.text(" ")) if found else ""


def clean(html: str, url: str, final_url: str | None = None) -> dict:
    """effective_url, canonical_url, title, blocks."""
    root = tree(html)
    base = http_url(final_url or "") or http_url(url or "")
    canonical = base or ""
    for link in root.named("link"):
        to = http_url(link.attrs.get("href", ""), base) if base and "canonical" in link.attrs.get("rel", "").casefold().split() else None
        if to and origin(to) == origin(base):
            canonical = to
            break
    title = _title(root)
    prune(root, lambda n: n.name in DROPPED or _is_navigation(n))
    body = next(root.named("body"), root)
    if not title and (h1 := next(body.named("h1"), None)):
        title = one_line(h1.text(" "))
    c = Cleaner(base)
    c.flow(body)
    return {"effective_url": base, "canonical_url": canonical, "title": title, "blocks": c.blocks}


def visible(n: Node, scope: tuple[str, ...] = ()) -> str:
    """One line of the text below, without that of dropped elements and, with ``scope``, of other tables or lists within."""
    out = []
    for s, holder in n.strings():
        inside: Node | None = holder
        hidden = False
        while inside is not None:
            hidden |= inside.name in DROPPED or inside.name == "head" and n.name != "head"
            inside = inside.parent
        if not hidden and (not scope or (holder if holder.name in scope else holder.above(*scope)) is n.above(*scope)):
            out.append(one_line(s))
    return " ".join(x for x in out if x)


def structured(html: str, url: str) -> dict:
    """title, text, links, metadata, images, headings, tables, lists; a field that can't be read is empty."""
    root = tree(html)

    def safe(read, default):
        try:
            return read()
        except Exception:  # noqa: BLE001 - one field never costs the others
            return default

    body = next(root.named("body"), root)
    meta = {"title": one_line(_title(root)), "description": "", "keywords": ""}
    for m in root.named("meta"):
        key = m.attrs.get("name", "").strip().casefold()
        if key in ("description", "keywords") and "content" in m.attrs:
            meta[key] = one_line(m.attrs["content"])
    return {
        "title": meta["title"],
        "text": safe(lambda: visible(body), ""),
        "links": safe(lambda: list(dict.fromkeys(u for a in root.named("a") if (u := http_url(a.attrs.get("href", ""), url)))), []),
        "metadata": meta,
        "images": safe(lambda: [{"src": u, "alt": one_line(i.attrs.get("alt", ""))} for i in root.named("img") if (u := http_url(i.attrs.get("src", ""), url))], []),
        "headings": safe(lambda: [{"level": int(h.name[1]), "text": h.text(" ")} for h in root.named("h1", "h2", "h3")], []),
        "tables": safe(lambda: [[[visible(c, ("table",)) for c in r.own("td", "th")] for r in t.named("tr") if r.above("table") is t and r.own("td", "th")] for t in root.named("table")], []),
        "lists": safe(lambda: [{"type": x.name, "items": [visible(i, ("ul", "ol")) for i in x.own("li")]} for x in root.named("ul", "ol")], []),
    }


BLOCK_TYPE = "array<struct<pos:int,kind:string,text:string,markdown:string,heading_path:array<string>>>"
_block = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("markdown", pa.string()), ("heading_path", pa.list_(pa.string()))])
CLEAN_SCHEMA = f"page_id long, url string, effective_url string, canonical_url string, title string, blocks {BLOCK_TYPE}"
PARSED_SCHEMA = (
    "page_id long, url string, title string, text string, links array<string>, metadata struct<title:string,description:string,keywords:string>, images array<struct<src:string,alt:string>>, "
    "headings array<struct<level:int,text:string>>, tables array<array<array<string>>>, lists array<struct<type:string,items:array<string>>>"
)
_pair = lambda *names: pa.struct([(n, pa.string()) for n in names])
_CLEAN = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("url", "effective_url", "canonical_url", "title")), ("blocks", pa.list_(_block))])
_PARSED = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("metadata", _pair("title", "description", "keywords")), ("images", pa.list_(_pair("src", "alt"))),
        ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("lists", pa.list_(pa.struct([("type", pa.string()), ("items", pa.list_(pa.string()))]))),
    ]
)


def _rows(pages: DataFrame, read: Callable[[str, str], dict], arrow: pa.Schema, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [{"page_id": i, "url": u} | read(h or "", u or "") for i, u, h in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)


def clean_pages(pages: DataFrame) -> DataFrame:
    """CLEAN_SCHEMA, one row per page."""
    return _rows(pages, clean, _CLEAN, CLEAN_SCHEMA)


def parse_pages(pages: DataFrame) -> DataFrame:
    """PARSED_SCHEMA, one row per page."""
    return _rows(pages, structured, _PARSED, PARSED_SCHEMA)


def source_documents(cleaned: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """document_id, url, canonical_url, title, text, markdown, content_hash, cleaned_bytes, cleaned_tokens, blocks: native columns over cleaned pages."""
    part = lambda f: F.array_join(F.transform("blocks", lambda b: b[f]), "\n\n")
    d = cleaned.select("*", part("text").alias("text"), part("markdown").alias("markdown"))
    nul = F.lit("\0")
    return d.select(
        F.sha2(F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.coalesce("url", F.lit(""))), 256).alias("document_id"), "page_id", "url", "canonical_url", "title", "text", F.when(F.col("markdown") != "", F.col("markdown")).alias("markdown"),
        F.sha2(F.concat("title", nul, "text", nul, "markdown"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("cleaned_bytes"), F.floor((F.length("text") + 3) / 4).cast("long").alias("cleaned_tokens"), "blocks",
    )
