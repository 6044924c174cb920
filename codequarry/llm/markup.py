"""Markup residue in texts: found, and rendered to clean text that keeps its structure.

HTML goes through a tree builder with implied tags and visibility rules; a layout pass emits
all visible text with block spacing, lists and aligned table cells. Markdown, wiki and LaTeX
lines are read as blocks, then their inline marks are taken off. In the result headings open
with ``#``, list items with ``-`` or a number, code blocks stand between ``` fences, and
formulas between dollar signs.

What the tree builder and the block and inline readers meet while they render is counted; a
text in which they meet nothing holds no markup. What they met is then checked against one
strict pattern of each kind, since a lone dash or asterisk is not yet markup.

No text can fail or take long: nesting is walked with a stack of its own, open elements are
found by name, and patterns don't go over the same characters again and again.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, as in the public standard, and of wiki markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i iframe ins kbd label map mark math meter noscript nowiki object option output q ref s samp script select small span strike strong style sub sup svg syntaxhighlight template textarea time tt u var video audio canvas picture progress ruby rt rp".split())
HIDDEN = frozenset("head script style template noscript title svg iframe object select".split())
RAW = frozenset("script style".split())
CODE = frozenset("pre syntaxhighlight source".split())
NAMES = VOID | BLOCKS | INLINE
#: Open elements that a start tag ends: own kind -> those it closes, up to a scope element.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "thead": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}

_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<(?P<end>/?)(?P<name>{_NAME})(?P<attrs>(?:\s[^<>]*|/)?)>", re.I | re.S)
#: Also start tags that are never closed by a bracket.
TORN = re.compile(rf"(?:</?(?:{_NAME})(?:\s+[a-z-]+\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?))++|</(?:{_NAME})(?![\w-]))(?![^<>]*>)", re.I)
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,8}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
ATTR = re.compile(r"([\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_DOLLAR = re.compile(r"\$(?=[^\s$])(?=[^$\n]*[\\^_{=+])[^$\n]*?[^\s$\\]\$(?!\d)")
_OPENER = re.compile(r"\$\$?|\\[(\[]")
_CLOSER = {"$$": "$$", "\\(": "\\)", "\\[": "\\]"}
LATEX = re.compile(r"(?<![\w:/\\.\])])\\(?:begin|end)\{[A-Za-z*]+\}|(?<![\w:/\\.\])])\\(?:item|maketitle|tableofcontents|par|noindent|newline|hline|centering|ldots|dots|LaTeX|TeX)\b|(?<![\w:/\\])\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?\{")


def formulas(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of formulas between ``$``, ``$$``, ``\\(`` or ``\\[`` and their closers, in order."""
    at, gone = 0, set()
    while m := _OPENER.search(text, at):
        at = m.start() + 1
        mark = m.group()
        if mark == "$":
            if d := _DOLLAR.match(text, m.start()):
                at = d.end()
                yield d.start(), at
        elif mark not in gone:
            rest = text[m.end() : m.end() + 1]
            end = text.find(_CLOSER[mark], m.end() + 1) if rest and (mark != "\\(" or not rest.isspace()) else -2
            if end == -1:
                gone.add(mark)
            elif end > 0:
                at = end + 2
                yield m.start(), at


#: One piece of markup of each kind; how often a kind is found is counted.
KINDS: dict[str, re.Pattern] = {
    "html_tag": TAG,
    "html_torn": TORN,
    "html_entity": ENTITY,
    "md_heading": re.compile(r"^ {0,3}#{1,6}[ \t]+\S", re.M),
    "md_underlined": re.compile(r"^[^\s|].*\r?\n(?:={3,}|-{3,})[ \t]*\r?$", re.M),
    "md_fence": FENCE,
    "md_link": re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|(?<=\w\])\((?:https?://|#|\w+\.(?:md|html?|png|jpe?g|gif|svg)\b)[^()\n]*"),
    "md_strong": re.compile(r"(?<!\*)\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?!\*)|(?<!\w)__(?=[^\s_])[^_\n]*[^\s_]__(?!\w)|(?<!\S)\*\*(?=[A-Za-z])|(?<=[A-Za-z])\*\*(?!\S)"),
    "md_emphasis": re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]{0,200}?[^\s*]\*(?![\w*])|(?<![\w\\])_(?=[^\s_])[^_\n]{0,200}?[^\s_]_(?!\w)"),
    "md_strike": re.compile(r"~~(?=\S)[^~\n]*\S~~"),
    "md_code": re.compile(r"`[^`\n]+`|(?<!\w)`(?=\w)|(?<=\w)`(?!\w)"),
    "md_table": re.compile(r"^[ \t]*+\|?[ \t]*+:?-{3,}:?[ \t]*+(?:\|[ \t]*+:?-{3,}:?[ \t]*+)+\|?[ \t]*+\r?$|^[ \t]*\|(?![-}|]).*\|[ \t]*\r?$", re.M),
    "md_list": re.compile(r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\S.*\r?\n[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\S", re.M),
    "md_quote": re.compile(r"^>[ \t]+\S", re.M),
    "wiki_heading": re.compile(r"^(={2,6})[ \t]*+[^=\s][^\n]*?\1[ \t]*+\r?$|^={2,6}[ \t]+[A-Za-z][^=\n]*$", re.M),
    "wiki_link": re.compile(r"\[\[[^\[\]\n]+(?:\]\])?|\[https?://[^\[\]\n]+\]"),
    "wiki_template": re.compile(r"\{\{[^{}\n]*(?:\}\})?"),
    "wiki_table": re.compile(r"^\{\||^\|\}|^\|-", re.M),
    "wiki_quote": re.compile(r"(?<!')(?:'''''|'''|'')(?=[^\s'])[^'\n]*[^\s'](?:'''''|'''|'')(?!')"),
    "wiki_list": re.compile(r"^\*{2,}[ \t]+\S|^;[^:\n]+:", re.M),
    "latex": LATEX,
}


def kinds_of(text: str) -> dict[str, int]:
    """How many pieces of each kind a text holds."""
    found = {}
    for kind, p in KINDS.items():
        n = sum(1 for _ in p.finditer(text))
        if n:
            found[kind] = n
    if n := sum(1 for _ in formulas(text)):
        found["math"] = n
    return found


class Met(dict):
    """How often each kind of markup was met."""

    def add(self, kind: str, n: int = 1) -> None:
        if n:
            self[kind] = self.get(kind, 0) + n

    def sub(self, kind: str, p: re.Pattern, to, text: str) -> str:
        text, n = p.subn(to, text)
        self.add(kind, n)
        return text


def walked(steps: Generator):
    """Runs a generator whose yielded generators are its calls; nesting takes no stack of Python's."""
    stack, value = [steps], None
    while stack:
        try:
            step = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(step)
            value = None
    return value


#: Lists, tables, quotes and definitions nested deeper than this are laid out like plain blocks.
DEEP = 40


# ---------------------------------------------------------------- HTML


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attr(self, name: str) -> str | None:
        for m in ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return m[2] or m[3] or m[4] or ""
        return None

    def hidden(self) -> bool:
        if self.tag in HIDDEN:
            return True
        if not self.attrs:
            return False
        style = (self.attr("style") or "").replace(" ", "").lower()
        return self.attr("hidden") is not None or self.attr("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def tree(text: str, met: Met | None = None) -> Node:
    """Nodes and strings; unknown closing tags are dropped, open elements end with their parent."""
    root = Node("#root")
    stack, at = [root], 0
    where: dict[str, list[int]] = {}  # levels of the open elements of each name

    def top(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    def cut(level: int) -> None:
        while len(stack) > level:
            where[stack.pop().tag].pop()

    def push(node: Node) -> None:
        stack[-1].kids.append(node)
        where.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def close(upto: set[str], scope: set[str]) -> None:
        """Ends the outermost element of ``upto`` inside the innermost one of ``scope``."""
        edge = top(scope)
        levels = [own[k] for x in upto if (own := where.get(x)) and (k := bisect_right(own, edge)) < len(own)]
        if levels:
            cut(min(levels))

    for m in TAG.finditer(text):
        if m.start() < at:
            continue
        if met is not None:
            met.add("html_tag")
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag:
            continue
        if tag == "source" and not m["attrs"].strip(" /"):
            tag = "syntaxhighlight"
        if m["end"]:
            level = top((tag,))
            if level and not (tag in ("p", "li", "div", "span", "b", "i") and top(("table", "td", "th")) > level):
                cut(level)
            continue
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE.get(tag, set()))
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr"))
        elif tag in BLOCKS and tag not in ("html", "body", "head", "title"):
            close({"p"}, {"li", "td", "th", "div", "blockquote", "table", "body", "section", "article"})
        elif tag == "body":
            close({"head", "title"}, set())
        node = Node(tag, m["attrs"] or "")
        if tag in RAW:
            stack[-1].kids.append(node)
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            push(node)
        else:
            stack[-1].kids.append(node)
    stack[-1].kids.append(text[at:])
    return root


def _plain(node: Node) -> str:
    """Text of a node as it stands, for code."""
    out, todo = [], [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        elif k is node or not k.hidden() or k.tag == "title":
            todo.extend(reversed(k.kids))
    return "".join(out)


def _formula(node: Node) -> Generator:
    out = []
    for k in node.kids:
        if isinstance(k, str):
            text = html.unescape(k)
            out.append((yield _formula(tree(text))) if text != k and TAG.search(text) else text)
        elif k.tag in ("sup", "sub"):
            out.append(("^{" if k.tag == "sup" else "_{") + (yield _formula(k)) + "}")
        elif not k.hidden():
            out.append((yield _formula(k)))
    return "".join(out)


def formula(node: Node) -> str:
    """Text of a formula, with raised and lowered parts as in LaTeX; escaped elements count as such."""
    return walked(_formula(node))


def fence(code: str, lang: str = "") -> str:
    code = code.strip("\r\n")
    return f"```{lang}\n{code}\n```"


def aligned(rows: list[list[str]]) -> str:
    """Table cells under one another."""
    rows = [[" ".join(c.split()) for c in r] for r in rows if any(c.strip() for c in r)]
    width: list[int] = []
    for r in rows:
        width.extend([0] * (len(r) - len(width)))
        for i, c in enumerate(r):
            if len(c) > width[i]:
                width[i] = len(c)
    if sum(width) * len(rows) > 20 * (sum(len(c) for r in rows for c in r) + 1000):  # one long cell would pad all others
        width = [0] * len(width)
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows)


class Layout:
    """Emits blocks of visible text."""

    def __init__(self, deep: int = 0) -> None:
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.deep = deep  # open lists, tables, quotes and definitions

    def flush(self, prefix: str = "") -> None:
        text = "".join(self.line)
        self.line = []
        lines = [re.sub(r"[ \t\u00a0]+", " ", x).strip() for x in text.split("\n")]
        text = "\n".join(lines).strip("\n")
        if text.strip():
            self.blocks.append(prefix + text)

    def walk(self, node: Node, keep: bool = True) -> Generator:
        for k in node.kids:
            if isinstance(k, str):
                self.line.append(k if keep else re.sub(r"\s+", " ", k))
            elif not k.hidden():
                yield self.element(k, keep)

    def element(self, e: Node, keep: bool) -> Generator:
        t = e.tag
        if t == "br":
            self.line.append("\n")
        elif t == "hr":
            self.flush()
        elif t == "img":
            self.line.append(e.attr("alt") or "")
        elif t == "math" or e.attrs and t not in BLOCKS and "math" in (e.attr("class") or "").lower().split():
            self.line.append("$" + formula(e).strip() + "$")
        elif t in CODE:
            self.flush()
            self.blocks.append(fence(html.unescape(_plain(e)), e.attr("lang") or ""))
        elif t[0] == "h" and t[1:].isdigit():
            self.flush()
            yield self.walk(e, False)
            self.line = [" ".join("".join(self.line).split())]
            self.flush("#" * int(t[1:]) + " ")
        elif t in ("ul", "ol") and self.deep < DEEP:
            self.flush()
            self.deep += 1
            at, n, items = len(self.blocks), 0, []
            for k in e.kids:
                if isinstance(k, str):
                    if not k.strip():
                        continue
                    k, text = Node("li"), k
                    k.kids.append(text)
                if k.tag in ("ul", "ol"):
                    yield self.element(k, False)
                elif not k.hidden():
                    n += 1
                    yield self.walk(k, False)
                    self.flush()
                    own = self.blocks[at:]
                    del self.blocks[at:]
                    if own:
                        mark = "- " if t == "ul" else f"{n}. "
                        body = "\n".join(own).split("\n")
                        items.append("\n".join([mark + body[0], *("  " + x for x in body[1:])]))
                    continue
                own = self.blocks[at:]
                del self.blocks[at:]
                items.extend("  " + x for b in own for x in b.split("\n"))
            if items:
                self.blocks.append("\n".join(items))
            self.deep -= 1
        elif t == "table" and self.deep < DEEP:
            self.flush()
            rows: list[list[str]] = []
            yield self.rows(e, rows)
            table = aligned(rows)
            if table:
                self.blocks.append(table)
        elif t in BLOCKS:
            self.flush()
            at, inside = len(self.blocks), t in ("dd", "blockquote") and self.deep < DEEP
            self.deep += inside
            yield self.walk(e, t in ("html", "body", "div") and keep)
            self.flush()
            self.deep -= inside
            if not inside:
                pass
            elif t == "dd":
                self.blocks[at:] = ["  " + b.replace("\n", "\n  ") for b in self.blocks[at:]]
            elif t == "blockquote":
                self.blocks[at:] = ["> " + b.replace("\n", "\n> ") for b in self.blocks[at:]]
        else:
            yield self.walk(e, keep)

    def rows(self, node: Node, rows: list[list[str]]) -> Generator:
        """Rows of cells; text outside of cells is visible, too, as a cell or row of its own."""
        for k in node.kids:
            if isinstance(k, str):
                if k.strip():
                    rows.append([k])
            elif k.hidden():
                continue
            elif k.tag == "tr":
                row = []
                for c in k.kids:
                    if isinstance(c, str):
                        if c.strip():
                            row.append(c)
                    elif not c.hidden():
                        cell = Layout(self.deep + 1)
                        yield cell.walk(c, False)
                        cell.flush()
                        row.append(" ".join(cell.blocks))
                rows.append(row)
            else:
                yield self.rows(k, rows)


def from_html(text: str, met: Met | None = None) -> str:
    lay = Layout()
    walked(lay.walk(tree(text, met)))
    lay.flush()
    return "\n\n".join(lay.blocks)


# ---------------------------------------------------------------- Markdown, wiki and LaTeX

SECTION = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
ENV_CODE = re.compile(r"\\begin\{(lstlisting|verbatim|minted|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?[ \t]*\r?\n?(.*?)(?:\\end\{\1\}|\Z)", re.S)
ENV_MATH = re.compile(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)(\*?)\}(.*?)(?:\\end\{\1\2\}|\Z)", re.S)
ENV_TABLE = re.compile(r"\\begin\{(tabular[x*]?|longtable|array)\}(?:\{[^}\n]*\})*(.*?)(?:\\end\{\1\}|\Z)", re.S)
ENV = re.compile(r"\\(begin|end)\{([A-Za-z*]+)\}(?:\[[^\]\n]*\])?")
WIKI_TABLE = re.compile(r"^\{\|(.*?)(?:^\|\}|\Z)", re.S | re.M)
FENCED = re.compile(r"^[ \t]*(```|~~~)[ \t]*([\w+-]*)[^\n]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
MD_TABLE = re.compile(r"(?:^[ \t]*\|.*\|?[ \t]*$\n?){1,}", re.M)
HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*)$|^(={2,6})[ \t]*([^=\n].*)$|^[ \t]*\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\[\]\n]*\])?\{(.*)\}[ \t]*$", re.M)
UNDER = re.compile(r"^([^\s|#>-].*)\n(={3,}|-{3,})[ \t]*$", re.M)
LATEX_ITEM = re.compile(r"[ \t]*\\item\b(?:\[([^\[\]\n]*)\])?[ \t]*(.*)")
QUOTE = re.compile(r"^((?:>[ \t]?)+)")
ITEM = re.compile(r"^([ \t]*)(?:([-*+]|[*#]{2,}|[*#](?=[ \t]))|(\d{1,3})[.)])[ \t]+(.*)$")
#: What an inline mark is, its pattern, and what stays of it.
INLINE_RULES = [
    ("md_link", re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)?"), r"\1"),
    ("md_link", re.compile(r"\[([^\[\]\n]+)\]\([^()\n]*\)?"), r"\1"),
    ("wiki_link", re.compile(r"\[\[(?:File|Image|Category):[^\[\]\n]*(?:\]\]|$)", re.I | re.M), ""),
    ("wiki_link", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)(?:\]\])?"), r"\1"),
    ("wiki_link", re.compile(r"\[https?://[^\s\[\]]+[ \t]+([^\[\]\n]+)\]"), r"\1"),
    ("wiki_link", re.compile(r"\[(https?://[^\[\]\s]+)\]"), r"\1"),
    ("wiki_template", re.compile(r"\{\{[^{}\n]*(?:\}\})?|\}\}"), ""),
    ("wiki_quote", re.compile(r"(?<!')'''''(?=\S)|'''(?=\S)|(?<=\S)'''''(?!')|(?<=\S)'''(?!')"), ""),
    ("wiki_quote", re.compile(r"(?<!')''(?=[^\s'])([^'\n]*[^\s'])''(?!')"), r"\1"),
    ("md_strong", re.compile(r"(?<!\*)\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*(?!\*)"), r"\1"),
    ("md_strong", re.compile(r"(?<!\w)__(?=[^\s_])([^_\n]*[^\s_])__(?!\w)"), r"\1"),
    ("md_strong", re.compile(r"(?<!\S)\*\*(?=[A-Za-z])|(?<=[A-Za-z])\*\*(?!\S)"), ""),
    ("md_emphasis", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]{0,200}?[^\s*])\*(?![\w*])"), r"\1"),
    ("md_emphasis", re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]{0,200}?[^\s_])_(?!\w)"), r"\1"),
    ("md_strike", re.compile(r"~~(?=\S)([^~\n]*\S)~~"), r"\1"),
    ("md_code", re.compile(r"`([^`\n]+)`"), r"\1"),
    ("md_code", re.compile(r"(?<!\w)`(?=\w)|(?<=\w)`(?!\w)"), ""),
    ("latex", re.compile(r"(?<![\w:/\\])\\(?:href)\{[^{}\n]*\}\{([^{}\n]*)\}"), r"\1"),
    ("latex", re.compile(r"(?<![\w:/\\])\\(?:label|ref|cite|pageref|index|vspace|hspace|includegraphics|usepackage|documentclass|input)\*?(?:\[[^\[\]\n]*\])?\{[^{}\n]*\}"), ""),
    ("latex", re.compile(r"(?<![\w:/\\])\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?\{([^{}\n]*)\}"), r"\1"),
    ("latex", re.compile(r"(?<![\w:/\\])\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?\{"), ""),
    ("latex", re.compile(r"(?<![\w:/\\.\])])\\(?:maketitle|tableofcontents|par|noindent|newline|hline|centering)\b[ \t]*"), ""),
    ("latex", re.compile(r"(?<![\w:/\\.\])])\\(?:ldots|dots)\b"), "..."),
    ("", re.compile(r"\\([#$%&_{}])"), r"\1"),
]


def inline(text: str, met: Met) -> str:
    """Takes inline marks off, but for formulas, which come out between dollar signs."""
    out, at = [], 0
    for lo, hi in formulas(text):
        met.add("math")
        out.append(_unmarked(text[at:lo], met))
        body = text[lo:hi]
        out.append(body if body[0] == "$" else "$" + body[2:-2].strip() + "$")
        at = hi
    out.append(_unmarked(text[at:], met))
    return "".join(out)


def _unmarked(text: str, met: Met) -> str:
    for _ in range(2):  # marks within marks
        before = text
        for kind, p, to in INLINE_RULES:
            text, n = p.subn(to, text)
            if n and kind:
                met.add(kind, n)
        if text == before:
            break
    return text


def _heading(m: re.Match, met: Met) -> str:
    if m[1]:
        met.add("md_heading")
        return "#" * len(m[1]) + " " + inline(m[2].strip().rstrip("#").strip(), met)
    if m[3]:
        met.add("wiki_heading")
        return "#" * max(1, len(m[3]) - 1) + " " + inline(m[4].strip().rstrip("=").strip(), met)
    met.add("latex")
    return "#" * SECTION.get(m[5], 1) + " " + inline(m[6].strip(), met)


def from_lines(text: str, met: Met) -> str:
    """Markdown, wiki and LaTeX blocks to clean text."""
    kept: list[str] = []

    def keep(block: str, kind: str) -> str:
        met.add(kind)
        kept.append(block)
        return f"\n\n\x00{len(kept) - 1}\x00\n\n"

    text = text.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
    text = ENV_MATH.sub(lambda m: keep("$$" + " ".join(m[3].split()) + "$$", "latex"), text)
    text = ENV_TABLE.sub(lambda m: keep(aligned([[inline(c, met) for c in r.replace("\\hline", "").split("&")] for r in m[2].split("\\\\")]), "latex"), text)

    def wiki(m: re.Match) -> str:
        rows: list[list[str]] = [[]]
        for line in m[1].split("\n")[1:]:
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line[:1] in "|!" and line:
                rows[-1].extend(inline(c, met) for c in re.split(r"\|\||!!", line[1:]))
        return keep(aligned(rows), "wiki_table")

    text = WIKI_TABLE.sub(wiki, text)

    def table(m: re.Match) -> str:
        lines = [x.strip() for x in m.group().strip().split("\n")]
        rows = [[inline(c, met) for c in x.strip("|").split("|")] for x in lines if not re.fullmatch(r"[|\s:-]+", x)]
        return keep(aligned(rows), "md_table") if rows else "\n"

    text = MD_TABLE.sub(table, text)
    text = UNDER.sub(lambda m: keep(("# " if m[2][0] == "=" else "## ") + inline(m[1].strip(), met), "md_underlined"), text)
    text = HEAD.sub(lambda m: keep(_heading(m, met), "heading"), text)
    numbered: list[list] = []
    lines = []
    for line in text.split("\n"):
        if "\x00" in line:
            lines.append(line)
            continue
        for m in ENV.finditer(line):
            if m[1] == "begin":
                numbered.append([m[2], 0])
            elif numbered:
                numbered.pop()
        line2 = met.sub("latex", ENV, "", line)
        if line2 != line and not line2.strip():
            continue
        m = LATEX_ITEM.match(line2)
        if m:
            met.add("latex")
            if numbered:
                numbered[-1][1] += 1
            mark = f"{numbered[-1][1]}. " if numbered and numbered[-1][0] == "enumerate" else "- "
            lines.append("  " * max(0, min(len(numbered), DEEP) - 1) + mark + (inline(m[1], met) + " " if m[1] else "") + inline(m[2], met))
            continue
        m = ITEM.match(line2)
        if m:
            met.add("list")
            deep = "  " * (len(m[2]) - 1) if m[2] and len(m[2]) > 1 else m[1]
            lines.append(f"{deep}{m[3] + '.' if m[3] else '-'} {inline(m[4], met)}")
            continue
        line2 = met.sub("md_quote", QUOTE, "", line2)
        lines.append(inline(line2, met).rstrip())
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


def rendered(text: str) -> tuple[str, dict[str, int]]:
    """Clean text, and what was met on the way. Code blocks are set aside before anything else is read as markup."""
    kept: list[str] = []
    met = Met()

    def hold(block: str, kind: str) -> str:
        met.add(kind)
        kept.append(block)
        return f"\n\n\x01{len(kept) - 1}\x01\n\n"

    fenced = lambda t: FENCED.sub(lambda m: hold(fence(m[3], m[2]), "md_fence"), t)
    text = fenced(text.replace("\x01", "").replace("\r\n", "\n"))
    text = ENV_CODE.sub(lambda m: hold(fence(m[2]), "latex"), text)
    if TAG.search(text):
        text = fenced(from_html(text, met))
    text = re.sub(r"\n{3,}", "\n\n", _unescaped(from_lines(text, met), met)).strip("\n")
    return re.sub("\x01(\\d+)\x01", lambda m: kept[int(m[1])], text), met


def render(text: str) -> str:
    return rendered(text)[0]


def _unescaped(text: str, met: Met) -> str:
    text = met.sub("html_torn", TORN, "", text)
    for _ in range(3):  # escaped more than once
        if not ENTITY.search(text):
            break
        text = met.sub("html_entity", ENTITY, lambda m: html.unescape(m.group()), text)
        if TAG.search(text):
            text = TAG.sub("", text)
    return re.sub(r"(?<=\S)  (?=\S)", " ", text.replace("\u00a0", " "))


CODE_FILE = r"\.(pas|inc|js)$"


def clean(symbols: DataFrame) -> DataFrame:
    """(id, n_pieces, kinds, text) of rows outside code files.

    A text is markup if rendering meets any and a strict pattern confirms it. ``n_pieces`` counts
    its pieces, ``kinds`` names them with their counts. NULL content gives NULL text and no
    pieces; a text without markup comes out unchanged. ``content_type`` is not looked at.
    Repeated rows stay repeated.
    """
    rows = symbols.where(~F.coalesce(F.lower(F.col("file_path")).rlike(CODE_FILE), F.lit(False))).select("id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kinds, texts = [], [], []
            for t in b.column("content").to_pylist():
                clear, met = rendered(t) if t else (t, {})
                found = kinds_of(t) if met else {}
                n.append(sum(found.values()))
                kinds.append(list(found.items()))
                texts.append(clear if found else t)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32()), pa.array(kinds, pa.map_(pa.string(), pa.int32())), pa.array(texts, pa.string())], ["id", "n_pieces", "kinds", "text"])

    # texts stand together in a few files of a table; rendering is spread over all tasks
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return spread.mapInArrow(run, "id long, n_pieces int, kinds map<string,int>, text string")
