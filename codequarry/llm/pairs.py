"""Pascal routines paired with their documentation.

A lexer that knows strings, comments and directives finds routine headings; begin/end
matching delimits the routine; the comment directly above the heading is its documentation,
and for a row that is one routine also the row's ``comments``. Pairs whose documentation
says nothing of its own are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a statement of the documentation must have.
LEAST_WORDS = 5

LEX = re.compile(
    r"""
    (?P<string>'(?:[^'\r\n]|'')*'?)
  | (?P<directive>\{\$[^}]*\}?|\(\*\$.*?(?:\*\)|\Z))
  | (?P<brace>\{[^}]*\}?)
  | (?P<paren>\(\*.*?(?:\*\)|\Z))
  | (?P<line>//[^\r\n]*)
  | (?P<head>(?<![\w.&])(?:class[ \t\r\n]+)?(?:function|procedure|constructor|destructor)[ \t\r\n]+(?P<name>[A-Za-z_]\w*(?:<[\w,; ]*>)?(?:[ \t]*\.[ \t]*[A-Za-z_]\w*(?:<[\w,; ]*>)?)*))
    """,
    re.I | re.S | re.X,
)
BLOCK = re.compile(r"(?P<skip>'(?:[^'\r\n]|'')*'?|\{[^}]*\}?|\(\*.*?(?:\*\)|\Z)|//[^\r\n]*)|(?<![\w.&])(?P<word>begin|case|try|asm|record|end|function|procedure|constructor|destructor|forward|external|implementation|initialization|finalization)(?!\w)|(?P<sign>[;()])", re.I | re.S)
START = re.compile(r"\s*(?:class\s+)?(?:function|procedure|constructor|destructor)\s", re.I)
COMMENT = re.compile(r"\s*(?:\{[^}]*\}?|\(\*.*?(?:\*\)|\Z)|//[^\r\n]*)", re.S)
ONE_BREAK = re.compile(r"[ \t]*+(?:\r\n|\n|\r)?[ \t]*+\Z")
LOCAL = re.compile(r"(?<!\w)(?:var|const|type|label)(?!\w)", re.I)
DIRECTIVES = re.compile(r"\s*+(?:\w+\s*+;\s*+)*+\Z")
CALLING = re.compile(r"\s*(?:(?:virtual|override|overload|abstract|static|cdecl|stdcall|inline|reintroduce|dynamic)\s*;\s*)*\Z", re.I)
TAIL = re.compile(r"\s*[;.]?")
EDGE = re.compile(r"^[ \t]*(?:///?|\{|\(\*|\*(?!\*))?|(?:\}|\*\))[ \t]*$", re.M)
TAG = re.compile(r"</?[A-Za-z][^<>]*>|(?<!\w)[@\\](?:inheritdoc|param|returns?|see|brief|author|version|since|raises|exception|deprecated|link)\b")
TODO = re.compile(r"(?<!\w)(?:TODO|FIXME|TBD|XXX|HACK|UNDONE)\b[ \t]*(?:\([^)]*\))?[ \t]*[:\-]?", re.I)
STAMP = re.compile(r"\$\w+(?::[^$\n]*)?\$|(?<!\d)\d{1,4}[./-]\d{1,2}[./-]\d{2,4}(?!\d)(?:[ \t]*\d{1,2}:\d{2})?(?:[ \t]+[A-Za-z]{2,3}[ \t]*$)?", re.M)
CODE = re.compile(
    r"^[^\n]*:=[^\n]*$"
    r"|^[ \t]*(?://[ \t]*)?[A-Za-z_][\w.\[\]^]*[ \t]*+(?:\([^\n]*\)[ \t]*+)?;[ \t]*+$"
    r"|^[ \t]*(?:if|for|while|with|case|repeat|until|raise|inherited|var|const|uses|procedure|function|begin|end|try|except|finally|else|exit)\b[^\n]*(?:;|\bdo|\bthen|\bof|\bbegin)[ \t]*$"
    r"|^[ \t]*(?:begin|end|try|except|finally|repeat|else)[ \t]*[;.]?[ \t]*$",
    re.M,
)
STATEMENT = re.compile(r"(?<=[.!?])\s+|\n[ \t]*\n")
WORD = re.compile(r"[^\W\d_]\w*")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def described(comment: str, name: str) -> str:
    """What a comment says of its own, or '' if no statement of it has enough words."""
    t = comment.replace("\r\n", "\n").replace("\r", "\n")
    t = EDGE.sub("", t)
    t = re.sub(r"\{\$[^}]*\}?|^[ \t]*\$(?:REGION|ENDREGION|IF\w*|ENDIF|ELSE)\b[^\n]*$", " ", t, flags=re.M)
    t = CODE.sub(" ", EDGE.sub("", t))
    t = STAMP.sub(" ", TODO.sub(" ", TAG.sub(" ", t)))
    own = set()
    for part in re.split(r"\s*\.\s*", re.sub(r"<[^>]*>", "", name)):
        own.add(re.escape(part))
        pieces = CAMEL.findall(part)
        if len(pieces) > 1:
            own.add(r"\s+".join(map(re.escape, pieces)))
    bare = re.sub(r"(?<!\w)(?:" + "|".join(sorted(own, key=len, reverse=True)) + r")(?!\w)", " ", t, flags=re.I)
    if any(len(WORD.findall(s)) >= LEAST_WORDS for s in STATEMENT.split(bare)):
        return re.sub(r"[ \t]*\n[ \t\n]*", "\n", re.sub(r"[ \t]+", " ", t)).strip()
    return ""


class Blocks:
    """The words of a text that open and close blocks, read once; ``match`` leads from an opening word to its end."""

    def __init__(self, text: str):
        self.text, self.words, self.starts, self.ends, self.match, self.heads = text, [], [], [], {}, []
        open_ = []
        for m in BLOCK.finditer(text):
            if m.group("skip") is not None:
                continue
            w = m.group("sign") or m.group("word").lower()
            i = len(self.words)
            self.words.append(w)
            self.starts.append(m.start())
            self.ends.append(m.end())
            if w in ("begin", "case", "try", "asm", "record"):
                open_.append(i)
            elif w == "end" and open_:
                self.match[open_.pop()] = i
            elif w in ("function", "procedure", "constructor", "destructor"):
                self.heads.append(m.start())

    def routine_end(self, at: int) -> int:
        """End of the routine whose heading ends at ``at``: after its body, or after the heading if it has none.

        A body that is never closed ends where the next heading opens.
        """
        text, words, n = self.text, self.words, len(self.words)
        i, parens = bisect_left(self.starts, at), 0
        while i < n and (words[i] != ";" or parens > 0):
            parens += (words[i] == "(") - (words[i] == ")")
            i += 1
        if i == n:
            return len(text)
        head_end, opened, nested, inner = self.ends[i], False, 0, False
        while (i := i + 1) < n:
            w = words[i]
            if w in ("forward", "external") and not opened:
                semi = text.find(";", self.ends[i])
                return semi + 1 if semi >= 0 else len(text)
            if w in ("begin", "case", "try", "asm", "record"):
                opened = True
                if i not in self.match:
                    k = bisect_left(self.heads, self.ends[i])
                    return self.heads[k] if k < len(self.heads) else len(text)
                i = self.match[i]
                if not nested:
                    return TAIL.match(text, self.ends[i]).end()
                nested, opened = nested - 1, False
            elif w in ("end", "implementation", "initialization", "finalization"):  # the end of the class or unit around a bare heading
                return head_end
            elif w in ("function", "procedure", "constructor", "destructor"):
                if "." in text[self.ends[i] : self.ends[i] + 120].split("(")[0].split(";")[0]:
                    return head_end
                if not inner:  # only what stands between the heading and the first inner routine tells
                    between = text[head_end : self.starts[i]]
                    if CALLING.match(between) or not LOCAL.search(between) and not DIRECTIVES.match(between):
                        return head_end
                nested, inner = nested + 1, True
        return len(text) if opened else head_end


def routine_end(text: str, at: int) -> int:
    return Blocks(text).routine_end(at)


def routines(content: str, comments: str | None) -> Iterator[tuple[str, int, str]]:
    """(name, offset, documentation) of the documented routines in a row."""
    doc, doc_end, heads = [], 0, []
    at = 0
    while m := LEX.search(content, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "name" else "head"
        if kind in ("brace", "paren", "line"):
            near = doc and ONE_BREAK.match(content, doc_end, m.start()) and kind == "line" == doc[-1][0]
            if not near:
                doc = []
            doc.append((kind, m.group()))
            doc_end = m.end()
        elif kind == "directive":
            if doc and not content[doc_end : m.start()].strip():
                doc_end = m.end()
        elif kind == "head":
            gap = content[doc_end : m.start()] if doc else "x"
            above = "\n".join(x[1] for x in doc) if doc and not gap.strip() and gap.count("\n") <= 1 else ""
            heads.append((m.group("name"), m.start(), above))
            doc = []
    if not heads:
        return
    alone = 0
    while (c := COMMENT.match(content, alone)) is not None:
        alone = c.end()
    single = START.match(content, alone) is not None and content[alone : heads[0][1]].strip() == ""
    for k, (name, start, above) in enumerate(heads):
        got = described(above, name) if above else ""
        if not got and k == 0 and single and comments:
            got = described(comments, name)
        if got:
            yield name, start, got


def function_pairs(symbols: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(id, func_name, code, description) of every documented routine in ``.pas`` and ``.inc`` rows.

    Rows count each for itself; a class or a whole unit can give several. NULL content gives
    none; names are spelled as in the heading. Unclosed strings end at the line's end, unclosed
    comments at the text's end. Whole texts are read; rows without any comment are passed over.
    """
    c, m = F.col("content"), F.col("comments")
    some = F.coalesce(F.trim(m) != "", F.lit(False)) | c.contains("//") | c.contains("{") | c.contains("(*")
    rows = symbols.where(F.lower(F.col("file_path")).rlike(r"\.(pas|inc)$") & c.isNotNull() & some).select("id", "content", "comments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, codes, docs = [], [], [], []
            for i, text, com in zip(b.column("id"), b.column("content"), b.column("comments")):
                text, blocks = text.as_py(), None
                for name, start, doc in routines(text, com.as_py()):
                    blocks = blocks or Blocks(text)
                    ids.append(i.as_py())
                    names.append(name)
                    codes.append(text[start : blocks.routine_end(start + len(name))])
                    docs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(codes, pa.string()), pa.array(docs, pa.string())], ["id", "func_name", "code", "description"])

    return rows.mapInArrow(run, "id long, func_name string, code string, description string")
