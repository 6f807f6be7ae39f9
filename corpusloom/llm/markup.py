"""Markup residue in text documents (problem 5): layout-aware rendering.

The dialect of a text (Markdown with HTML, MediaWiki, LaTeX, HTML) is taken from its marks, with the language as a prior.
Every dialect is read into the same tree: headings, lists of items, code blocks, formulas, tables and paragraphs. The HTML
reader builds the tree with implied end tags (li, p, td, ...) and visibility rules (script, style, template, hidden, display
none, comments). The renderer emits all visible text with block spacing, indented lists and aligned table cells; the
elements are the tree's headings, items, code blocks and formulas.

Defined results: null and empty texts have no elements and render to null and to an empty text; a code block that the
chunk's end cuts off is a code block up to there; equal elements of a chunk are one row of elements().
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.tokenize import text_slices
from corpusloom.session import spread

#: A node is (kind, text, depth); kinds: heading, list_item, code_block, formula, paragraph, row.
Node = tuple[str, str, int]

_blank = re.compile(r"\s+")
_tag = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*\s*/?>")
# HTML element names by role.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nowiki q ref s samp small source span strike strong sub sup time tt u var wbr".split())
HIDDEN = set("script style template head noscript title iframe object svg".split())
VOID = set("area base br col embed hr img input link meta param track wbr".split())


def squeeze(s: str) -> str:
    return _blank.sub(" ", s).strip()


def plain_tags(s: str) -> str:
    """Known tags out of a line; others are text (Map<String, X>)."""
    return _tag.sub(lambda m: " " if re.match(r"(?i)<br\b", m.group()) else "" if re.match(r"</?([A-Za-z0-9]+)", m.group())[1].lower() in BLOCK | INLINE | HIDDEN else m.group(), s)


# ---- formulas inside prose ------------------------------------------------------------------------------------------

_tex_inline = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
_dollar = re.compile(r"(?<![\\$\w])\$\$(.+?)\$\$|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$])", re.S)


def take_formulas(s: str, out: list[Node], dollars: bool) -> str:
    """Formulas of a line of prose into OUT; their inner text stays."""

    def keep(m: re.Match) -> str:
        inner = next(g for g in m.groups() if g is not None)
        if m.re is _dollar and m.group(2) is not None and re.fullmatch(r"\d[\d.,]*(?:\s+\D*)?", inner):
            return m.group()
        out.append(("formula", inner, 0))
        return HOLD + str(len(out) - 1) + HOLD

    s = _tex_inline.sub(keep, s)
    return _dollar.sub(keep, s) if dollars else s


HOLD = "\ue000"


def give_back(s: str, out: list[Node]) -> str:
    return re.sub(HOLD + r"(\d+)" + HOLD, lambda m: out[int(m.group(1))][1], s)


# ---- HTML -----------------------------------------------------------------------------------------------------------


class Tree(HTMLParser):
    """Tree builder with implied end tags; emits nodes."""

    # what a start tag closes if it is open, up to the barrier
    CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.stack: list[list] = []  # [tag, hidden, text parts]
        self.loose: list[str] = []
        self.rows: list[tuple[int, list[list[str]]]] = []  # open table rows: depth of their table, cells

    def tables(self) -> int:
        return sum(1 for x in self.stack if x[0] == "table")

    def open_row(self) -> list[list[str]]:
        """The row of the innermost table; one is implied where no tr began it."""
        if not self.rows or self.rows[-1][0] != self.tables():
            self.rows.append((self.tables(), []))
        return self.rows[-1][1]

    def close_row(self) -> None:
        if self.rows and self.rows[-1][0] == self.tables():
            cells = self.rows.pop()[1]
            if any(cells):
                self.nodes.append(("row", "\t".join(" ".join(c) for c in cells), 0))

    def depth(self) -> int:
        return sum(1 for x in self.stack if x[0] in ("ul", "ol", "menu"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "br":
            self.text("\n" if self.inside("pre") else " ")
            return
        if tag == "img":
            self.text(a.get("alt") or "")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in BLOCK and tag not in INLINE and tag not in HIDDEN and tag not in ("input", "select", "option", "button"):
            self.text(self.get_starttag_text() or "")
            return
        if tag in self.CLOSES:
            ends, barrier = self.CLOSES[tag]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in barrier:
                    break
                if self.stack[i][0] in ends:
                    self.close_to(i)
                    break
        elif tag in BLOCK:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p" or (self.stack[i][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and tag[0] == "h" and len(tag) == 2):
                    self.close_to(i)
                    break
                if self.stack[i][0] in BLOCK:
                    break
        if tag in BLOCK:
            self.flush()
        if tag == "tr":
            self.close_row()
        elif tag in ("td", "th"):
            self.open_row().append([])
        hidden = tag in HIDDEN or "hidden" in a or "display:none" in re.sub(r"\s", "", a.get("style") or "").lower() or bool(self.stack and self.stack[-1][1])
        self.stack.append([tag, hidden, []])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.close_to(i)
                return

    def inside(self, tag: str) -> bool:
        return any(x[0] == tag for x in self.stack)

    def text(self, s: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        for x in reversed(self.stack):
            if x[0] in BLOCK or x[0] == "math":
                x[2].append(s)
                return
        self.loose.append(s)

    handle_data = text

    def emit(self, kind: str, parts: list[str]) -> None:
        s = "".join(parts)
        parts.clear()
        if kind == "code_block":
            if s.strip():
                self.nodes.append((kind, s.strip("\r\n"), 0))
            return
        found: list[Node] = []
        s = squeeze(give_back(take_formulas(s, found, False), found))
        if s and not (kind == "paragraph" and len(found) == 1 and squeeze(found[0][1]) == s):
            if kind in ("cell", "paragraph") and self.rows and self.rows[-1][0] == self.tables() and self.rows[-1][1] and (self.inside("td") or self.inside("th")):
                self.rows[-1][1][-1].append(s)
            else:
                self.nodes.append(("paragraph" if kind == "cell" else kind, s, max(0, self.depth() - 1)))
        self.nodes += found

    def kind(self, tag: str) -> str:
        return "code_block" if tag == "pre" else "heading" if re.fullmatch("h[1-6]", tag) else "list_item" if tag == "li" else "cell" if tag in ("td", "th") else "paragraph"

    def flush(self) -> None:
        """Text before a block start is a block of its own."""
        if self.loose:
            self.emit("paragraph", self.loose)
        for x in self.stack:
            if x[2] and x[0] != "math":
                self.emit(self.kind(x[0]), x[2])

    def close_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag, _, parts = self.stack[-1]
            if tag == "math":
                self.stack.pop()
                s = "".join(parts)
                self.nodes.append(("formula", s, 0))
                continue
            if parts:
                self.emit(self.kind(tag), parts)
            if tag in ("tr", "table"):
                self.close_row()
            self.stack.pop()

    def done(self) -> list[Node]:
        self.close()
        self.close_to(0)
        if self.loose:
            self.emit("paragraph", self.loose)
        return self.nodes


def read_html(s: str) -> list[Node]:
    tree = Tree()
    # a sign that opens no tag is text
    tree.feed(re.sub(r"<(?![A-Za-z/!?])", "&lt;", s))
    return tree.done()


# ---- Markdown -------------------------------------------------------------------------------------------------------

_fence = re.compile(r"^ {0,12}(`{3,}|~{3,})[ \t]*([^`\n]*)$")
_atx = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_item = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?$")
_rule = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_html_block = re.compile(r"(?i)^\s*<(/?)(%s|style|script|template|head|noscript|!--)\b" % "|".join(sorted(BLOCK, key=len, reverse=True)))
_escape = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|<>~$&\"'/:;=?@^,%])")
_span = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_image = re.compile(r"!\[([^\]]*)\]\([^()\s]*(?:\([^()]*\)[^()\s]*)*(?:\s+[\"'(][^\n]*?[\"')])?\)")
_link = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*<?[^()\s>]*(?:\([^()]*\)[^()\s]*)*>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_ref = re.compile(r"\[([^\[\]]+)\]\[[^\[\]]*\]")
_auto = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")


def _emphasis(s: str) -> str:
    for rx in (
        r"(?<![\w*\\])\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*(?![\w*])", r"(?<!\\)\*\*(?=[^\s*])(.+?)(?<=[^\s])\*\*", r"(?<![\w_\\])__(?=[^\s_])(.+?)(?<=\S)__(?![\w])",
        r"(?<![*\\])\*(?=[^\s*])([^*]*?[^\s*])\*(?!\*)", r"(?<![\w\\])_(?=[^\s_])((?:[^_]|(?<=\w)_(?=\w))*?)(?<=[^\s_])_(?!\w)", r"~~(?=\S)(.+?)(?<=\S)~~",
    ):
        s = re.sub(rx, r"\1", s)
    return s


def md_inline(s: str, out: list[Node]) -> str:
    kept: list[str] = []

    def hold(text: str) -> str:
        kept.append(text)
        return "\ue001%d\ue001" % (len(kept) - 1)

    s = _span.sub(lambda m: hold(squeeze(m.group(2))), s)
    s = take_formulas(s, out, True)
    s = _escape.sub(lambda m: hold(m.group(1)), s)
    s = _image.sub(r"\1", s)
    for _ in range(2):
        s = _link.sub(r"\1", s)
    s = _auto.sub(r"\1", _ref.sub(r"\1", s))
    s = re.sub(r"<!--.*?-->", "", s, flags=re.S)
    s = html.unescape(plain_tags(s)) if "<" in s or "&" in s else s
    s = _emphasis(s)
    s = give_back(s, out)
    s = re.sub("\ue001(\\d+)\ue001", lambda m: kept[int(m.group(1))], s)
    return squeeze(re.sub("\ue001(\\d+)\ue001", lambda m: kept[int(m.group(1))], s))


def read_markdown(text: str) -> list[Node]:
    lines, nodes = text.split("\n"), []
    para: list[str] = []
    item: list | None = None  # [depth, lines]
    indents: list[int] = []

    def close_para() -> None:
        if para:
            found: list[Node] = []
            s = md_inline("\n".join(para), found)
            if s:
                nodes.append(("paragraph", s, 0))
            nodes.extend(found)
            para.clear()

    def close_item() -> None:
        nonlocal item
        if item:
            found: list[Node] = []
            s = md_inline(re.sub(r"^\[[ xX]\][ \t]+", "", "\n".join(item[1])), found)
            if s:
                nodes.append(("list_item", s, item[0]))
            nodes.extend(found)
            item = None

    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        m = _fence.match(line)
        if m and not (m.group(1)[0] == "~" and False):
            bare, nxt = not m.group(2).strip(), lines[i + 1] if i + 1 < n else ""
            # a chunk may begin inside a code block: its first fence then only closes
            if bare and not nxt.strip() and para and not any(k == "code_block" for k, _, _ in nodes) and not nodes and item is None:
                nodes.append(("code_block", "\n".join(para), 0))
                para.clear()
                i += 1
                continue
            close_para()
            close_item()
            mark, body = m.group(1), []
            i += 1
            while i < n and not re.match(r"^\s*%s{%d,}\s*$" % (re.escape(mark[0]), len(mark)), lines[i]):
                body.append(lines[i])
                i += 1
            if any(x.strip() for x in body):
                nodes.append(("code_block", "\n".join(body), 0))
            i += 1
            continue
        if not line.strip():
            close_para()
            if item and not (i + 1 < n and re.match(r"^\s{2,}\S", lines[i + 1]) and not _item.match(lines[i + 1])):
                close_item()
            i += 1
            continue
        m = re.match(r"^\s*(\$\$|\\\[)\s*(.*)$", line)
        if m:
            end = "$$" if m.group(1) == "$$" else "\\]"
            body, rest, j = [], m.group(2), i
            while end not in rest and j + 1 < n:
                body.append(rest)
                j += 1
                rest = lines[j]
            if end in rest:
                close_para()
                close_item()
                body.append(rest[: rest.index(end)])
                if any(x.strip() for x in body):
                    nodes.append(("formula", "\n".join(body), 0))
                tail = rest[rest.index(end) + len(end) :]
                i = j + 1
                if tail.strip() and squeeze(tail) not in (".", ","):
                    para.append(tail)
                continue
        m = _atx.match(line)
        if m and (m.group(2) or "").strip():
            close_para()
            close_item()
            found: list[Node] = []
            nodes.append(("heading", md_inline(m.group(2), found), len(m.group(1))))
            nodes.extend(found)
            i += 1
            continue
        if para and item is None and re.match(r"^ {0,3}(=+|-+)[ \t]*$", line) and len(line.strip()) >= 2:
            found = []
            title = md_inline("\n".join(para), found)
            para.clear()
            nodes.append(("heading", title, 1 if "=" in line else 2))
            nodes.extend(found)
            i += 1
            continue
        if _rule.match(line):
            close_para()
            close_item()
            i += 1
            continue
        m = _html_block.match(line)
        if m:
            close_para()
            close_item()
            tag, body = m.group(2).lower(), []
            end = {"pre": "</pre", "script": "</script", "style": "</style", "!--": "-->"}.get(tag)
            while i < n:
                body.append(lines[i])
                i += 1
                if end:
                    if end in body[-1].lower():
                        break
                elif i < n and (not lines[i].strip() or _fence.match(lines[i])):
                    break
            if not end:
                # open pre blocks may hold blank lines
                joined = "\n".join(body).lower()
                while joined.count("<pre") > joined.count("</pre") and i < n:
                    body.append(lines[i])
                    joined += "\n" + lines[i].lower()
                    i += 1
            nodes.extend(read_html("\n".join(body)))
            continue
        m = _item.match(line)
        if m and (m.group(3) or "").strip() and not (para and m.group(2)[0].isdigit() and m.group(2)[:-1] != "1"):
            close_para()
            close_item()
            width = len(m.group(1).expandtabs(4))
            while indents and indents[-1] > width:
                indents.pop()
            if not indents or indents[-1] < width:
                indents.append(width)
            item = [len(indents) - 1, [m.group(3)]]
            i += 1
            continue
        if re.match(r"^\s*(?:\[\[_TOC_\]\]|\[TOC\])\s*$", line, re.I) or re.match(r"^ {0,3}\[[^\]]+\]:\s*\S+", line):
            i += 1
            continue
        if "|" in line and i + 1 < n and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]) and "|" in lines[i + 1]:
            close_para()
            close_item()
            rows = [line]
            i += 2
            while i < n and "|" in lines[i]:
                rows.append(lines[i])
                i += 1
            for r in rows:
                found = []
                nodes.append(("row", "\t".join(md_inline(c, found) for c in r.strip().strip("|").split("|")), 0))
                nodes.extend(found)
            continue
        stripped = re.sub(r"^\s*(?:>\s?)+", "", line)
        if item is not None:
            item[1].append(stripped.strip())
        else:
            para.append(stripped)
        i += 1
    close_para()
    close_item()
    return nodes


# ---- MediaWiki ------------------------------------------------------------------------------------------------------

_wiki_code = re.compile(r"(?is)<(source|syntaxhighlight|pre)\b[^>]*>(.*?)(?:</\1\s*>|\Z)")
_wiki_math = re.compile(r"(?is)<(math|chem)\b[^>]*>(.*?)</\1\s*>")


def wiki_inline(s: str, out: list[Node]) -> str:
    s = re.sub(r"(?is)<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref>|<!--.*?-->", "", s)
    s = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei):[^\]]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[\[([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?|ftp|mailto):\S+?\s+([^\]]*)\]", r"\1", s, flags=re.I)
    s = re.sub(r"\[((?:https?|ftp)://[^\s\]]+)\]", r"\1", s, flags=re.I)
    s = take_formulas(s, out, False) if "\\" in s else s
    s = html.unescape(plain_tags(s))
    s = re.sub(r"'{2,5}", "", s)
    return squeeze(give_back(s, out))


def read_wiki(text: str) -> list[Node]:
    kept: list[Node] = []

    def hold(kind: str, body: str) -> str:
        kept.append((kind, html.unescape(body).strip("\r\n") if kind == "code_block" else body, 0))
        return "\ue002%d\ue002" % (len(kept) - 1)

    text = _wiki_code.sub(lambda m: "\n" + hold("code_block", re.sub(r"(?is)^\s*<code[^>]*>|</code>\s*$", "", m.group(2)) if m.group(1).lower() == "pre" else m.group(2)) + "\n", text)
    text = _wiki_math.sub(lambda m: hold("formula", m.group(2)), text)
    for _ in range(3):
        text = re.sub(r"(?s)\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"__[A-Z]+__", "", text)
    nodes: list[Node] = []
    para: list[str] = []

    def add(kind: str, s: str, depth: int = 0) -> None:
        found: list[Node] = []
        marks = [int(x) for x in re.findall("\ue002(\\d+)\ue002", s)]
        s = wiki_inline(re.sub("\ue002(\\d+)\ue002", lambda m: kept[int(m.group(1))][1] if kept[int(m.group(1))][0] == "formula" and kind != "paragraph" else "", s), found)
        if s:
            nodes.append((kind, s, depth))
        nodes.extend(kept[k] for k in marks)
        nodes.extend(found)

    def close() -> None:
        if para:
            add("paragraph", "\n".join(para))
            para.clear()

    row: list[str] = []  # cells up to the next row mark; a line may hold one cell or all

    def close_row() -> None:
        if row:
            found: list[Node] = []
            held = [int(x) for x in re.findall("\ue002(\\d+)\ue002", "".join(row))]
            cells = [wiki_inline(re.sub("\ue002(\\d+)\ue002", lambda m: kept[int(m.group(1))][1] if kept[int(m.group(1))][0] == "formula" else "", c), found) for c in row]
            if any(cells):
                nodes.append(("row", "\t".join(cells), 0))
            nodes.extend(kept[k] for k in held)
            nodes.extend(found)
            row.clear()

    for line in text.split("\n"):
        m = re.match(r"^\s*(={1,6})\s*(.+?)\s*\1\s*$", line)
        k = re.match(r"^\s{0,3}([*#]+[*#:;]*)\s*(.+)$", line)
        if m:
            close()
            close_row()
            add("heading", m.group(2), len(m.group(1)))
        elif k:
            close()
            close_row()
            add("list_item", k.group(2), len(k.group(1)) - 1)
        elif not line.strip() or re.match(r"^-{4,}\s*$", line) or re.match(r"^\s*(\{\||\|\}|\|-)", line):
            close()
            if line.strip():
                close_row()
        elif re.match(r"^\s*\|\+", line):
            close()
            add("paragraph", line.strip()[2:])
        elif re.match(r"^\s*[|!]", line):
            close()
            # attributes of a cell stand in front of a single bar
            row.extend(re.sub(r"^[^|\[\]{}]*=[^|\[\]{}]*\|(?!\|)", "", c) for c in re.split(r"\|\||!!", line.strip()[1:]))
        elif _html_block.match(line) and not re.match(r"(?i)\s*<(?:br|hr)", line):
            close()
            nodes.extend(read_html(re.sub(r"'{2,5}", "", line)))
        else:
            para.append(re.sub(r"^\s*[:;]+\s*", "", line))
    close()
    close_row()
    return nodes


# ---- LaTeX ----------------------------------------------------------------------------------------------------------

_tex_block = re.compile(
    r"(?is)\\begin\{(verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)(?:\\end\{\1\}|\Z)"
    r"|\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\3\}"
    r"|\\\[(.+?)\\\]|(?<!\\)\$\$(.+?)\$\$|\\\((.+?)\\\)|(?<!\\)\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?!\d)"
)
_tex_escape = {"textless": "<", "textgreater": ">", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textbar": "|", "ldots": "...", "dots": "...", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": " ", "newline": " ", "par": " ", "textunderscore": "_", "textdollar": "$", "textquotesingle": "'", "S": "§", "ss": "ß"}
_tex_drop = {"label", "ref", "cite", "index", "vspace", "hspace", "pagestyle", "usepackage", "documentclass", "includegraphics", "input", "bibliography", "bibliographystyle", "setlength", "todo", "pageref", "eqref"}


def _argument(s: str, i: int) -> tuple[str | None, int]:
    """The balanced {...} at I."""
    while i < len(s) and s[i] in " \t":
        i += 1
    if i >= len(s) or s[i] != "{":
        return None, i
    depth, j = 0, i
    while j < len(s):
        if s[j] == "\\":
            j += 1
        elif s[j] == "{":
            depth += 1
        elif s[j] == "}":
            depth -= 1
            if not depth:
                return s[i + 1 : j], j + 1
        j += 1
    return s[i + 1 :], len(s)


def tex_inline(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c == "\\":
            m = re.compile(r"\\([A-Za-z]+)\*?").match(s, i)
            if not m:
                nxt = s[i + 1 : i + 2]
                out.append(" " if nxt in "\\ ,;:!" else nxt)
                i += 2
                continue
            name, i = m.group(1), m.end()
            low = name if name in _tex_escape else name.lower()
            if low in _tex_escape:
                out.append(_tex_escape[low])
                if s[i : i + 2] == "{}":
                    i += 2
                elif i < len(s) and s[i] == " " and re.match(r"[a-z]", low):
                    i += 1
                continue
            while i < len(s) and s[i] == "[":
                end = s.find("]", i)
                i = end + 1 if end >= 0 else len(s)
            arg, i2 = _argument(s, i)
            if low == "href":
                label, i = _argument(s, i2)
                out.append(tex_inline(label or ""))
            elif low in _tex_drop:
                i = i2
            elif arg is not None:
                out.append(tex_inline(arg))
                i = i2
            continue
        if c == "%" and (i == 0 or s[i - 1] != "\\"):
            end = s.find("\n", i)
            i = end if end >= 0 else len(s)
            continue
        out.append(" " if c == "~" else "" if c in "{}" else c)
        i += 1
    return "".join(out)


def read_latex(text: str) -> list[Node]:
    kept: list[Node] = []

    def hold(m: re.Match) -> str:
        if m.group(1):
            kept.append(("code_block", html.unescape(m.group(2)).strip("\r\n"), 0))
            return "\n\n\ue002%d\ue002\n\n" % (len(kept) - 1)
        inner = next(g for g in m.groups()[3:] if g is not None)
        kept.append(("formula", re.sub(r"\\label\{[^}]*\}", "", inner), 0))
        return "\ue002%d\ue002" % (len(kept) - 1)

    text = _tex_block.sub(hold, text)
    text = re.sub(r"(?m)(?<!\\)%.*$", "", text)
    nodes: list[Node] = []
    depth = 0

    def add(kind: str, s: str, d: int = 0) -> None:
        marks = [int(x) for x in re.findall("\ue002(\\d+)\ue002", s)]
        s = re.sub("\ue002(\\d+)\ue002", lambda m: "\ue003" + m.group(1) + "\ue003" if kept[int(m.group(1))][0] == "formula" and kind != "paragraph" else "", s)
        s = re.sub("\ue003(\\d+)\ue003", lambda m: kept[int(m.group(1))][1], squeeze(tex_inline(s)))
        if s:
            nodes.append((kind, squeeze(s), d))
        nodes.extend(kept[k] for k in marks)

    mark = re.compile(r"(?i)\\(?:(chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?(?:\[[^\]]*\])?(?=\s*\{)|(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]]*\])?|(item)(?![A-Za-z_])(?:\[([^\]]*)\])?)|(\n[ \t]*\n)")
    at, kind = 0, "paragraph"
    for m in iter(lambda: mark.search(text, at), None):
        add(kind, text[at : m.start()], max(0, depth - 1))
        at = m.end()
        if m.group(1):
            arg, at = _argument(text, at)
            add("heading", arg or "")
            kind = "paragraph"
        elif m.group(2):
            if m.group(3).lower() in ("itemize", "enumerate", "description"):
                depth += 1 if m.group(2).lower() == "begin" else -1
            kind = "paragraph"
        elif m.group(4):
            kind = "list_item"
        else:
            kind = "paragraph"
    add(kind, text[at:], max(0, depth - 1))
    return nodes


# ---- all ------------------------------------------------------------------------------------------------------------

_signs = {
    "latex": re.compile(r"(?i)\\(?:(?:sub)*section|chapter|begin|end|textbf|textit|texttt|emph|href|textless|label)\*?\s*[{\[]|(?m:^\s*\\item\s)"),
    "wiki": re.compile(r"(?im)^={2,6}[^=\n].*?={2,6}\s*$|'''|(?<!')''(?!')[^'\n]|\[\[(?!_TOC_)[^\]\n]+\]\]|<(?:source|syntaxhighlight|math|nowiki|ref)\b|\{\{[^{}\n]+\}\}|__(?:NO)?TOC__|\[https?://[^\s\]]+ [^\]\n]*\]|^\*{2,}\s|^##? ?.*\n# "),
    "markdown": re.compile(r"(?m)^\s*(?:```|~~~)|\*\*\S|\]\(|`[^`\n]+`|^\s*[-+] |^\s*\d+\. |^\$\$\s*$|^#{1,6} .*\n\s*\n|^#{1,6} .*#\s*$|^(?:=+|-+)\s*$|(?<!\w)_\w[^_\n]*_(?!\w)|(?<!\w)__\w[^_\n]*__(?!\w)|\[\[_TOC_\]\]"),
    "html": re.compile(r"(?i)<(?:p|h[1-6]|ul|ol|li|pre|div|table)\b[^>]*>"),
}


def dialect(text: str, language: str | None) -> str:
    score = {k: len(rx.findall(text)) for k, rx in _signs.items()}
    prior = {"tex": "latex", "latex": "latex", "wiki": "wiki", "mediawiki": "wiki", "html": "html", "htm": "html", "xhtml": "html"}.get((language or "").lower())
    if prior:
        score[prior] = score[prior] * 2 + 2
    if score["latex"] and score["latex"] >= max(score["wiki"], score["html"]):
        return "latex"
    if score["wiki"] > max(score["html"], 0) and score["wiki"] >= score["markdown"] * (0.5 if prior == "wiki" else 1):
        return "wiki"
    if prior == "html" and score["html"] >= score["markdown"] or score["html"] and not score["markdown"]:
        return "html"
    return "markdown"


def tree(text: str, language: str | None = None) -> list[Node]:
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    kind = dialect(text, language)
    return {"latex": read_latex, "wiki": read_wiki, "html": read_html, "markdown": read_markdown}[kind](text)


def elements_of(text: str | None, language: str | None = None) -> list[tuple[str, str]]:
    """Distinct (element, content) pairs in order."""
    if not text:
        return []
    rows = ((k, squeeze(s)) for k, s, _ in tree(text, language) if k in ("heading", "list_item", "code_block", "formula"))
    return list(dict.fromkeys(x for x in rows if x[1]))


def render(text: str | None, language: str | None = None) -> str | None:
    """Clean text that keeps the structure visible."""
    if text is None:
        return None
    out: list[str] = []
    last = ""
    nodes = tree(text, language)
    for i, (kind, s, depth) in enumerate(nodes):
        if kind == "row":
            if last != "row":
                rows = []
                while i < len(nodes) and nodes[i][0] == "row":
                    rows.append(nodes[i][1].split("\t"))
                    i += 1
                widths = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows)))]
                out += ["", *("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows)]
        elif kind == "list_item":
            out += [""] * (last != kind) + ["  " * depth + "- " + squeeze(s)]
        elif kind == "code_block":
            out += ["", "```", s, "```"]
        elif kind == "formula":
            if not (last and squeeze(s) in squeeze(out[-1])):
                out += ["", "$$ " + squeeze(s) + " $$"]
        else:
            out += ["", ("#" * min(max(depth, 1), 6) + " " if kind == "heading" else "") + squeeze(s)]
        last = kind
    return "\n".join(out).strip("\n")


def _marked(chunks: DataFrame) -> DataFrame:
    return spread(chunks.where("content_type in ('wiki', 'pr') and id is not null").select("id", "language", "text"))


def elements(chunks: DataFrame) -> DataFrame:
    """id, element, content of wiki and pr chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            rows = [(i, *e) for i, lang, text in zip(*(c.to_pylist() for c in batch.columns)) for e in elements_of(text, lang)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["id", "element", "content"])

    return _marked(chunks).mapInArrow(run, "id string, element string, content string").distinct()


def clean_texts(chunks: DataFrame) -> DataFrame:
    """id, clean of wiki and pr chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            ids, langs, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([render(x, y) for x, y in zip(texts, langs)], pa.string())], names=["id", "clean"])

    return _marked(chunks).mapInArrow(run, "id string, clean string").distinct()
