"""HTML by the standard parser: titles, links, Markdown; only what patterns cannot say runs in Python, in Arrow batches."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_VOID = {"br", "hr", "img", "meta", "link", "input"}
_SKIPPED = {"script", "style", "nav", "footer", "noscript", "iframe"}
_SKIPPED_CLASSES = {"ad", "breadcrumb", "menu"}
_BLOCKS = {"p", "div", "article", "section", "ul", "ol", "table", "tr"}


class _Markdown(HTMLParser):
    """Headings with #, bullets with -, links and emphasis; boilerplate tags and classes are passed over.

    Elements that follow each other without any text between are kept apart by
    a space; the paragraphs of an introduction are emphasised one by one.
    """

    def __init__(self, known: dict[str, str] | None = None, here: str = "", host: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.host, self.ended, self.intro = host, False, 0
        self.out: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.title: list[str] = []
        self.href: list[str | None] = []
        self.known, self.here = known or {}, here

    @property
    def off(self) -> bool:
        return any(skip for _, skip in self.stack)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        skip = tag in _SKIPPED or bool(_SKIPPED_CLASSES & set((a.get("class") or "").split()))
        if tag == "br" and not self.off:
            self.out.append("\n")
        if tag in _VOID:
            return
        after, self.ended = self.ended, False
        self.stack.append((tag, skip))
        if self.off:
            return
        if after and tag not in _BLOCKS and tag != "li" and self.out and not self.out[-1].endswith(("\n", " ")):
            self.out.append(" ")
        if "section-intro" in (a.get("class") or "").split():
            self.intro = len(self.stack)
        if tag in {"h1", "h2", "h3", "h4", "h5", "h6"}:
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in _BLOCKS:
            self.out.append("\n\n")
        elif tag in {"b", "strong"}:
            self.out.append("**")
        elif tag in {"i", "em"}:
            self.out.append("*")
        elif tag == "a":
            self.href.append(self._target(a.get("href")))
            self.out.append("[")
        if self.intro and len(self.stack) == self.intro + 1:
            self.out.append("*")

    def _target(self, href: str | None) -> str | None:
        if not href:
            return None
        path, mark, fragment = href.partition("#")
        own = path.removeprefix(self.host) if self.host and path.startswith(self.host + "/") else path
        if own in self.known:
            path = own
            return posixpath.relpath(self.known[path], posixpath.dirname(self.here) or ".") + mark + fragment
        return self.host + href if self.host and href.startswith("/") else href

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack[-1]
            if not self.off:
                if t in {"b", "strong"}:
                    self.out.append("**")
                elif t in {"i", "em"}:
                    self.out.append("*")
                elif t == "a" and self.href:
                    self.out.append(f"]({self.href.pop() or ''})")
                elif t in {"h1", "h2", "h3", "h4", "h5", "h6"}:
                    self.out.append("\n\n")
                if self.intro and len(self.stack) == self.intro + 1:
                    self.out.append("*")
            self.stack.pop()
            self.ended = True
            if len(self.stack) < self.intro:
                self.intro = 0
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.off:
            return
        self.ended = False
        tags = [t for t, _ in self.stack]
        if tags and tags[-1] == "h1":
            self.title.append(data)
        if "title" not in tags:
            words = " ".join(data.split())
            lead = " " if words and data[0].isspace() and self.out and not self.out[-1].endswith(("\n", " ")) else ""
            self.out.append(lead + words + (" " if data[-1:].isspace() else ""))


def to_markdown(html: str | None, known: dict[str, str] | None = None, here: str = "", host: str = "") -> str:
    parser = _Markdown(known, here, host)
    parser.feed((html or "").replace(" ", " "))
    parser.close()
    lines = [x.rstrip() for x in "".join(parser.out).split("\n")]
    kept = [x for x, before in zip(lines, ["", *lines]) if x or before]
    return "\n".join(kept).strip()


def heading(html: str | None) -> str:
    """Text directly in the first-level headings."""
    parser = _Markdown()
    parser.feed(html or "")
    return " ".join("".join(parser.title).split())


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)


@F.pandas_udf(StringType())
def title(html: pd.Series) -> pd.Series:
    return html.map(heading)


def next_data(html: Column) -> Column:
    """The page's embedded JSON, or null."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script\s+id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def links(html: Column) -> Column:
    """Targets of links but for fragments, mail, scripts and PDF files."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), 1)
    bare = F.transform(found, lambda u: F.regexp_replace(u, r"""^["']|["']$""", ""))
    return F.filter(bare, lambda u: ~u.rlike(r"(?i)^(#|mailto:|javascript:)|\.pdf$") & (u != ""))


def front_matter(title_: Column, source: Column, kind: Column) -> Column:
    from loomgraph.functions.text import yaml_scalar

    return F.concat(F.lit("---\ntitle: "), yaml_scalar(title_), F.lit("\nsource: "), yaml_scalar(source), F.lit("\nkind: "), yaml_scalar(kind), F.lit("\n---\n"))


class _Tree(HTMLParser):
    """The page as nested lists [tag, attributes, children], texts as strings."""

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _below(node: list, tag: str | None = None, cls: str | None = None, href: str | None = None) -> list[list]:
    """All elements below of a tag, a class and a link prefix, in document order."""
    out = []
    for child in node[2]:
        if isinstance(child, str):
            continue
        hit = (tag is None or child[0] == tag) and (cls is None or cls in (child[1].get("class") or "").split()) and (href is None or (child[1].get("href") or "").startswith(href))
        out += [child] if hit else []
        out += _below(child, tag, cls, href)
    return out


def _texts(node: list) -> list[str]:
    return [t for c in node[2] for t in ([c.strip()] if isinstance(c, str) else _texts(c)) if t]


def _profile(root: list) -> dict:
    """Range, strength, armour piercing and rules of the first row of a weapon's table; nothing where a part is missing."""
    none = {"range": None, "strength": None, "ap": None, "special_rules": []}
    tables = _below(root, "table", "profile-table--weapon")
    rows = [r for t in tables[:1] for b in _below(t, "tbody") for r in _below(b, "tr")]
    cells = _below(rows[0], "td") if rows else []
    if len(cells) < 4:
        return none
    said = ["".join(_texts(c)) for c in cells[:3]]
    rules = [a[1]["href"].rstrip("/").split("/")[-1] for a in _below(cells[3], "a", href="/special-rules/")]
    return dict(zip(none, [*[None if v in ("-", "–", "—", "") else v for v in said], rules]))


def _spell_type(root: list) -> str | None:
    for block in _below(root, "div", "spell")[:1]:
        for row in (r for t in _below(block, "table") for r in _below(t, "tr")):
            cells = _below(row, "td")
            if len(cells) > 1 and "".join(_texts(cells[0])) == "Type":
                link = _below(cells[1], "a", href="/magic/")
                return "".join(_texts(link[0])) or None if link else None
    return None


def _breadcrumb(root: list) -> dict:
    """Section path, book and page, and the date of the last update."""
    out: dict = {"path": [], "book": None, "page": None, "updated": None}
    lists = [u for w in _below(root, None, "breadcrumb__wrapper")[:1] for u in _below(w, "ul", "breadcrumb")]
    if lists:
        out["path"] = ["".join(_texts(x)) for x in _below(lists[0], "li", "breadcrumb-link")]
    if len(lists) > 1:
        for x in _below(lists[1], "li", "update-timestamp")[:1]:
            out["updated"] = " ".join(_texts(x)).removeprefix("Last update:").strip()
        for x in _below(lists[1], "li", "page-reference")[:1]:
            book, mark, page = " ".join(_texts(x)).rpartition(", p.")
            out["book"], out["page"] = (book.strip(), page.strip()) if mark else (page, None)
    return out


_PROFILE = StructType().add("range", StringType()).add("strength", StringType()).add("ap", StringType()).add("special_rules", ArrayType(StringType()))
_CRUMBS = StructType().add("path", ArrayType(StringType())).add("book", StringType()).add("page", StringType()).add("updated", StringType())


@F.pandas_udf(_PROFILE)
def weapon_profile(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_profile(_Tree(h).root) for h in html], columns=["range", "strength", "ap", "special_rules"])


@F.pandas_udf(StringType())
def spell_type(html: pd.Series) -> pd.Series:
    return html.map(lambda h: _spell_type(_Tree(h).root))


@F.pandas_udf(_CRUMBS)
def breadcrumb(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_breadcrumb(_Tree(h).root) for h in html], columns=["path", "book", "page", "updated"])


@F.pandas_udf(StructType().add("weapon", _PROFILE).add("spell", StringType()).add("crumbs", _CRUMBS))
def page_fields(html: pd.Series) -> pd.DataFrame:
    """What ``weapon_profile``, ``spell_type`` and ``breadcrumb`` say, of a page that is parsed once."""
    roots = [_Tree(h).root for h in html]
    return pd.DataFrame({"weapon": [_profile(r) for r in roots], "spell": [_spell_type(r) for r in roots], "crumbs": [_breadcrumb(r) for r in roots]})


def rewritten(known: dict[str, str], host: str) -> Callable[[Column, Column], Column]:
    """Markdown whose links to known paths are relative files (``here``: the page's own file), those to other pages of the host absolute."""

    @F.pandas_udf(StringType())
    def run(html: pd.Series, here: pd.Series) -> pd.Series:
        return pd.Series([to_markdown(h, known, at, host) for h, at in zip(html, here)])

    return run
