"""Declarations of Pascal units, as rows.

A lexer that knows strings, comments and directives feeds a declaration parser: it reads the
heads of types, their members with visibility, constants, variables and routines, and passes
over bodies by matching begin and end. Conditional code is resolved first. Units that can't
be read give one row with their status.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Symbols that count as defined and as not defined; all others are unknown.
DEFINED = frozenset("MSWINDOWS OSWINDOWS WINDOWS WIN32 WIN64 DELPHI CONDITIONALEXPRESSIONS UNICODE CPUX64 CPUX86 CPU64 CPU32 CPU386 GENERICS HASINTEGER64 HASINLINE PUREPASCAL USERECORDWITHMETHODS HASCODEPAGE ISDELPHI".split())
UNDEFINED = frozenset("OSPOSIX OSDARWIN OSLINUX OSBSD OSANDROID OSIOS FPC FPCSOURCES FPC_DELPHI FPC_HAS_CPSTRING LINUX DARWIN BSD ANDROID IOS CPUARM CPUAARCH64 CPUPOWERPC CPUMIPS OSFREEBSD".split())

LEX = re.compile(
    r"(?P<ws>\s+)|(?P<directive>\{\$[^}]*\}|\(\*\$.*?\*\))|(?P<comment>\{[^}]*\}|\(\*.*?\*\)|//[^\r\n]*)|(?P<string>'''.*?'''|(?:'(?:[^'\r\n]|'')*'|\#\$?[0-9A-Fa-f]+)+)|(?P<number>\$[0-9A-Fa-f]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<ident>&?[A-Za-z_À-￿][\w]*)|(?P<symbol>:=|\.\.|<>|<=|>=|[-+*/=<>()\[\]{}.,:;^@$])|(?P<other>.)",
    re.S,
)
DIRECTIVE = re.compile(r"\{\$\s*(\w+)\s*([^}]*)\}|\(\*\$\s*(\w+)\s*(.*?)\*\)", re.S)
ROUTINES = frozenset(("function", "procedure", "constructor", "destructor", "operator"))
SECTIONS = frozenset(("type", "const", "var", "resourcestring", "threadvar", "label", "exports"))
VISIBILITY = frozenset(("private", "protected", "public", "published", "automated"))
MODIFIERS = frozenset("virtual override overload abstract static cdecl stdcall register pascal safecall inline reintroduce dynamic message deprecated platform library experimental external forward final assembler varargs export name index dispid delayed near far local unsafe winapi".split())
COMMENT_LINES = 5


CONDITIONAL = re.compile(r"'(?:[^'\r\n]|'')*'|//[^\r\n]*|\{\$[^}]*\}|\(\*\$.*?\*\)|\{[^}]*\}|\(\*.*?\*\)", re.S)


def resolve_conditionals(text: str) -> str:
    """Blanks out branches of conditional code that aren't taken; offsets and lines stay as they are.

    Only the fixed symbols decide. For unknown symbols, compiler options and expressions the
    first branch is taken, whether it asks for a symbol or for its absence. Symbols that a text
    defines itself stay unknown.
    """
    out, at, stack, dead = [], 0, [], 0  # dead: open levels whose branch isn't taken

    def put(upto: int) -> None:
        part = text[at:upto]
        out.append(re.sub(r"[^\r\n]", " ", part) if dead else part)

    for m in CONDITIONAL.finditer(text):
        d = DIRECTIVE.match(m.group())
        if not d:
            continue
        word, arg = (d[1] or d[3]).upper(), (d[2] or d[4] or "").strip()
        if word not in ("IFDEF", "IFNDEF", "IF", "IFOPT", "ELSE", "ELSEIF", "ENDIF", "IFEND", "DEFINE", "UNDEF"):
            continue
        put(m.start())
        out.append(re.sub(r"[^\r\n]", " ", m.group()))
        at = m.end()
        if word in ("IFDEF", "IFNDEF", "IF", "IFOPT"):
            name = arg.upper() if word in ("IFDEF", "IFNDEF") else ""
            take = not ((name in UNDEFINED and word == "IFDEF") or (name in DEFINED and word == "IFNDEF"))
            stack.append([take, take])
            dead += not take
        elif word in ("ELSE", "ELSEIF") and stack:
            was, (now, taken) = stack[-1][0], (not stack[-1][1], True)
            stack[-1] = [now, taken]
            dead += was - now
        elif word in ("ENDIF", "IFEND") and stack:
            dead -= not stack.pop()[0]
    put(len(text))
    return "".join(out)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    low: str = ""


@dataclass
class Row:
    name: str
    full_name: str
    type: str
    container: str | None = None
    ancestor: str | None = None
    interfaces: list[str] = field(default_factory=list)
    visibility: str | None = None
    start: int = 0
    end: int = 0
    section: str = "interface"
    is_declaration: bool = True
    comments: str = ""


class Unreadable(ValueError):
    pass


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens: list[Token] = []
        self.notes: list[tuple[int, int, str]] = []
        self.lines = [0] + [m.end() for m in re.finditer(r"\r\n|\n|\r", text)]
        for m in LEX.finditer(text):
            k = m.lastgroup
            if k in ("ident", "symbol", "string", "number", "other"):
                self.tokens.append(Token(k, m.group(), m.start(), m.group().lower() if k == "ident" else m.group()))
            elif k == "comment":
                self.notes.append((m.start(), m.end(), m.group()))
        self.i = 0
        self.rows: list[Row] = []
        self.uses: list[str] = []
        self.unit = ""
        self.section = "interface"

    # -- tokens
    def low(self, k: int = 0) -> str:
        return self.tokens[self.i + k].low if self.i + k < len(self.tokens) else ""

    def take(self) -> Token:
        if self.i >= len(self.tokens):
            raise Unreadable("the unit ends too early")
        self.i += 1
        return self.tokens[self.i - 1]

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def end_of_last(self) -> int:
        t = self.tokens[min(self.i, len(self.tokens)) - 1]
        return t.start + len(t.text)

    def until(self, *ends: str) -> None:
        """Moves to one of the ends outside brackets; doesn't take it."""
        depth = 0
        while self.i < len(self.tokens):
            w = self.low()
            if depth == 0 and w in ends:
                return
            if w in "([" and w:
                depth += 1
            elif w in (")", "]"):
                depth -= 1
                if depth < 0:
                    return
            self.i += 1

    def bracket(self) -> None:
        """Passes over an attribute or an interface id."""
        depth = 0
        while self.i < len(self.tokens):
            w = self.take().low
            depth += (w == "[") - (w == "]")
            if depth == 0:
                return

    def angle(self) -> str:
        """Generic parameters after a name, or ''."""
        if self.low() != "<":
            return ""
        start, depth = self.tokens[self.i].start, 0
        while self.i < len(self.tokens):
            w = self.take().low
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if depth == 0:
                    return re.sub(r"\s+", "", self.text[start : self.end_of_last()])
            elif w == ";" and depth == 1 and self.low() not in ("t", "u", "v") and not re.match(r"[a-z]\w*$", self.low()):
                break
        return ""

    # -- comments
    def above(self, at: int) -> str:
        """Comments that end within five lines above an offset with nothing but comments between, without their marks."""
        first = self.line(at)
        got = []
        edge = at
        for s, e, t in reversed([n for n in self.notes if n[1] <= at][-12:]):
            if self.text[e:edge].strip() or first - self.line(s) > COMMENT_LINES + t.count("\n"):
                break
            got.append(re.sub(r"^\s*(?:///?|\{|\(\*)\s?|\s*(?:\}|\*\))\s*$", "", t, flags=re.M).strip())
            edge = s
        return "\n".join(reversed([g for g in got if g]))

    def add(self, row: Row) -> None:
        row.section = self.section
        row.comments = self.above(row.start)
        self.rows.append(row)

    # -- grammar
    def run(self) -> list[Row]:
        if self.low() in ("unit", "program", "library", "package"):
            kind = self.take().low
            self.unit = self.dotted()
            self.until(";")
            self.section = "interface" if kind == "unit" else "implementation"
        while self.i < len(self.tokens):
            w = self.low()
            if w in ("interface", "implementation"):
                self.section = self.take().low
            elif w == "uses":
                self.take()
                self.read_uses()
            elif w in SECTIONS:
                self.take()
                self.declarations(w)
            elif w in ROUTINES or w == "class" and self.low(1) in ROUTINES:
                self.routine(None, None)
            elif w in ("initialization", "finalization"):
                break
            elif w == "begin":
                self.body()
            else:
                self.i += 1
        return self.rows

    def dotted(self) -> str:
        parts = [self.take().text + self.angle()]
        while self.low() == ".":
            self.take()
            parts.append(self.take().text + self.angle())
        return ".".join(parts)

    def read_uses(self) -> None:
        while self.i < len(self.tokens) and self.low() != ";":
            if self.tokens[self.i].kind == "ident" and self.low() != "in":
                self.uses.append(self.dotted())
            else:
                self.i += 1

    def declarations(self, kind: str) -> None:
        while self.i < len(self.tokens):
            w = self.low()
            if w in SECTIONS or w in ROUTINES or w in ("implementation", "interface", "initialization", "finalization", "begin", "uses", "end", "") or w == "class" and self.low(1) in ROUTINES:
                return
            if w == "[":  # an attribute
                self.bracket()
                continue
            if self.tokens[self.i].kind != "ident":
                self.i += 1
                continue
            if kind == "type":
                self.type_declaration()
            elif kind in ("const", "resourcestring"):
                start = self.tokens[self.i].start
                name = self.take().text
                self.until(";")
                self.i += 1
                if self.section == "interface":
                    self.add(Row(name, name, "const", start=start, end=self.end_of_last()))
            elif kind in ("var", "threadvar"):
                names, start = [], self.tokens[self.i].start
                while self.i < len(self.tokens):
                    names.append(self.take().text)
                    if self.low() != ",":
                        break
                    self.take()
                self.until(";")
                self.i += 1
                if self.section == "interface":
                    for n in names:  # one row for each name, with the shared type
                        self.add(Row(n, n, "var", start=start, end=self.end_of_last()))
            else:
                self.until(";")
                self.i += 1

    def type_declaration(self, outer: str | None = None, visibility: str | None = None) -> None:
        start = self.tokens[self.i].start
        name = self.take().text + self.angle()
        if self.low() != "=":
            self.until(";")
            self.i += 1
            return
        self.take()
        while self.low() == "[":
            self.bracket()
        if self.low() in ("packed", "type"):
            self.take()
        kind = self.low()
        full = f"{outer}.{name}" if outer else name
        row = Row(name, full, "type", container=outer, visibility=visibility, start=start)
        place = len(self.rows)
        if kind in ("class", "interface", "dispinterface", "record", "object"):
            self.take()
            row.type = {"dispinterface": "interface", "object": "class"}.get(kind, kind)
            if kind == "class" and self.low() == "of":
                row.type = "type"
                self.until(";")
            elif self.low() == ";":  # a forward declaration
                self.i += 1
                return
            else:
                while self.low() in ("abstract", "sealed", "helper"):
                    self.take()
                if self.low() == "(":
                    self.take()
                    names = []
                    while self.low() not in (")", ""):
                        if self.tokens[self.i].kind == "ident":
                            names.append(self.dotted())
                        else:
                            self.i += 1
                    self.take()
                    own = row.type == "class"
                    row.ancestor = names[0] if names and (own and not re.match(r"I[A-Z]", names[0]) or row.type == "interface") else None
                    row.interfaces = [n for n in names[1 if row.ancestor else 0 :] if re.match(r"I[A-Z]", n)]
                if self.low() == "for":
                    self.take()
                    row.ancestor = self.dotted()
                if self.low() != ";":
                    self.members(full, "public")
                    if self.low() == "end":
                        self.take()
                    else:
                        raise Unreadable(f"{name} has no end")
                self.until(";")
        else:
            self.until(";")
        self.i += 1
        row.end = self.end_of_last() if self.i <= len(self.tokens) else len(self.text)
        if self.section == "interface" or row.type in ("class", "interface", "record"):
            self.add(row)
            self.rows.insert(place, self.rows.pop())

    def members(self, outer: str, visibility: str) -> None:
        while self.i < len(self.tokens):
            w = self.low()
            if w == "end":
                return
            if w == "strict" and self.low(1) in VISIBILITY:
                self.take()
            elif w in VISIBILITY and self.low(1) not in (":", ",", "="):
                visibility = self.take().low
            elif w == "[":
                self.bracket()
            elif w in ROUTINES and self.low(1) not in (":", ",", "=") or w == "class" and self.low(1) in ROUTINES:
                self.routine(outer, visibility)
            elif w == "property" or w == "class" and self.low(1) == "property":
                start = self.tokens[self.i].start
                if w == "class":
                    self.take()
                self.take()
                name = self.take().text
                self.until(";")
                self.i += 1
                if self.low() == "default" and self.low(1) == ";":
                    self.i += 2
                self.add(Row(name, f"{outer}.{name}", "property", container=outer, visibility=visibility, start=start, end=self.end_of_last()))
            elif w == "type" and self.low(1) not in (":", ",", "="):
                self.take()
                stop = VISIBILITY | ROUTINES | {"end", "property", "strict", "class", "const", "var", "type"}
                while self.i < len(self.tokens) and self.tokens[self.i].kind == "ident" and self.low() not in stop:
                    self.type_declaration(outer, visibility)
            elif w == "case":  # the variant part of a record ends with the record
                depth = 0
                while self.i < len(self.tokens):
                    x = self.low()
                    if x in ("(", "record"):
                        depth += 1
                    elif x == ")":
                        depth -= 1
                    elif x == "end":
                        if depth <= 0:
                            return
                        depth -= 1
                    self.i += 1
            elif w == "":
                return
            else:  # a field, a class variable or a constant
                depth = 0
                while self.i < len(self.tokens):
                    x = self.low()
                    if x in ("(", "["):
                        depth += 1
                    elif x in (")", "]"):
                        depth -= 1
                    elif x == "record":
                        self.take()
                        self.members(outer, visibility)
                    elif x == ";" and depth <= 0:
                        self.i += 1
                        break
                    elif x == "end" and depth <= 0:
                        return
                    self.i += 1

    def routine(self, outer: str | None, visibility: str | None) -> None:
        start = self.tokens[self.i].start
        if self.low() == "class":
            self.take()
        kind = self.take().low
        if self.i >= len(self.tokens) or self.tokens[self.i].kind != "ident":
            self.until(";")
            self.i += 1
            return
        name = self.dotted()
        if self.low() == "=":  # a method resolution
            self.until(";")
            self.i += 1
            return
        self.until(";")
        self.i += 1
        end = self.end_of_last()
        bodiless = outer is not None or self.section == "interface"
        while self.low() in MODIFIERS:
            if self.low() in ("forward", "external"):
                bodiless = True
            self.until(";")
            self.i += 1
            end = self.end_of_last()
        container = outer or (name.rpartition(".")[0] or None)
        short = name.rpartition(".")[2]
        row = Row(short, f"{outer}.{name}" if outer else name, kind if kind != "operator" else "function", container=container, visibility=visibility, start=start, end=end, is_declaration=bodiless)
        if not bodiless:
            place = len(self.rows)
            section = self.section
            self.body()
            del self.rows[place:]  # nested routines belong to the body
            self.section = section
            row.end = self.end_of_last()
        self.add(row)

    def body(self) -> None:
        """Passes over local declarations and the block that ends a routine."""
        while self.i < len(self.tokens):
            w = self.low()
            if w in ("begin", "asm"):
                depth = 0
                while self.i < len(self.tokens):
                    x = self.take().low
                    if x in ("begin", "case", "try", "asm", "record") and not (x == "record" and depth == 0):
                        depth += 1
                    elif x == "end":
                        depth -= 1
                        if depth == 0:
                            if self.low() in (";", "."):
                                self.take()
                            return
                raise Unreadable("a block has no end")
            if w in ROUTINES:
                self.routine(None, None)
            elif w in SECTIONS:
                self.take()
                while self.i < len(self.tokens) and self.low() not in SECTIONS | ROUTINES | {"begin", "asm"}:
                    if self.low() == "record":
                        self.take()
                        self.members("", "public")
                    self.i += 1
            elif w in ("implementation", "initialization", "finalization"):
                return
            else:
                self.i += 1


def parse(text: str) -> tuple[str, list[Row], list[str], str]:
    """(status, rows, uses, unit): ``parsed``, ``preprocessed`` if only the text with resolved conditionals could be read, or ``failed``."""
    if not text.strip():
        return "failed", [], [], ""
    for status, source in (("parsed", text if "$IF" not in text.upper() else None), ("preprocessed", resolve_conditionals(text))):
        if source is None:
            continue
        p = Parser(source)
        try:
            rows = p.run()
        except (Unreadable, RecursionError):
            continue
        return status if "$IF" not in text.upper() else "preprocessed", rows, p.uses, p.unit
    return "failed", [], [], ""


def signature(content: str) -> str:
    """A routine's heading: up to its first semicolon outside parentheses, or to local declarations or the body; short texts as they are.

    A text without such an end is given whole; one that opens with its body gives its first 300 characters.
    """
    if len(content) < 300:
        return content
    depth = 0
    for m in re.finditer(r"'(?:[^'\r\n]|'')*'|\{[^}]*\}|\(\*.*?\*\)|//[^\r\n]*|[();]|\b(?:var|const|begin|asm)\b", content, re.I | re.S):
        t = m.group().lower()
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif depth == 0 and t in ("var", "const", "begin", "asm"):
            return content[: m.start()].rstrip() or content[:300]
        elif depth == 0 and t == ";":
            return content[: m.end()]
    return content.rstrip()


SCHEMA = "file_path string, unit string, parse_status string, name string, full_name string, type string, container string, ancestor string, parent_class string, implemented_interfaces array<string>, visibility string, section string, is_declaration boolean, start_line int, end_line int, content string, comments string, fts_content string, uses array<string>"


def parse_units(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Rows of declarations from (path, text). A unit that fails gives one row with its status and no name.

    Implementations keep only their signature for full-text search. Visibility is ``public``
    unless a marker says otherwise. NULL and blank texts count as failed.
    """
    src = files.select(files[path_col].alias("path"), files[text_col].alias("text"))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
        types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]
        for b in batches:
            out = [[] for _ in names]
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                status, rows, uses, unit = parse(text or "")
                starts = [0] + [m.end() for m in re.finditer(r"\r\n|\n|\r", text or "")]
                line = lambda at, starts=starts: bisect_right(starts, at)
                if not rows:
                    values = [path, unit or None, status] + [None] * (len(names) - 4) + [uses]
                    for x, v in zip(out, values):
                        x.append(v)
                for r in rows:
                    content = text[r.start : r.end]
                    method = r.type in ("function", "procedure", "constructor", "destructor")
                    values = [path, unit, status, r.name, r.full_name, r.type, r.container, r.ancestor, r.container or r.ancestor, r.interfaces, r.visibility or "public", r.section, r.is_declaration, line(r.start), line(max(r.start, r.end - 1)), content, r.comments, signature(content) if method and not r.is_declaration else content, uses]
                    for x, v in zip(out, values):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return src.mapInArrow(run, SCHEMA)


def parse_report(parsed: DataFrame, shown: int = 10) -> DataFrame:
    """(parse_status, files, first_files): files of each status, and the first ones by path."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    one = parsed.select("file_path", "parse_status").distinct().withColumn("n", F.row_number().over(Window.partitionBy("parse_status").orderBy("file_path")))
    counts = parsed.select("file_path", "parse_status").distinct().groupBy("parse_status").agg(F.count("*").alias("files"))
    first = one.where(F.col("n") <= shown).groupBy("parse_status").agg(F.array_sort(F.collect_list("file_path")).alias("first_files"))
    return counts.join(first, "parse_status", "left")


def package_clauses(text: str) -> tuple[list[str], list[tuple[str, str | None]], str | None]:
    """(requires, contains with paths, framework tag) of a package source."""
    tag = re.search(r"//\s*FRAMEWORK:\s*(VCL|FMX|RTL)\b", "\n".join(text.splitlines()[:10]), re.I)
    bare = re.sub(r"\{[^}]*\}|\(\*.*?\*\)|//[^\r\n]*", " ", text, flags=re.S)
    req = re.search(r"(?<![\w.])requires\s+([^;]*);", bare, re.I)
    con = re.search(r"(?<![\w.])contains\s+([^;]*);", bare, re.I)
    requires = [x.strip() for x in req[1].split(",") if x.strip()] if req else []
    contains = []
    for x in con[1].split(",") if con else []:
        m = re.match(r"\s*([\w.]+)(?:\s+in\s+'([^']*)')?", x)
        if m:
            contains.append((m[1], m[2]))
    return requires, contains, tag[1].upper() if tag else None


def identifier_at(line: str, character: int) -> tuple[str, int, int, str]:
    """(identifier, start, end, qualified name) under a 0-based position of a line; '' if there is none."""
    ok = lambda c: c.isalnum() or c == "_"
    n = len(line)
    if character < 0 or character > n:
        return "", character, character, ""
    at = character if character < n and ok(line[character]) else character - 1
    if at < 0 or at >= n or not ok(line[at]):
        return "", character, character, ""
    lo = hi = at
    while lo > 0 and ok(line[lo - 1]):
        lo -= 1
    while hi + 1 < n and ok(line[hi + 1]):
        hi += 1
    if line[lo].isdigit():
        return "", character, character, ""
    q = lo
    while q > 0 and (ok(line[q - 1]) or line[q - 1] == "."):
        q -= 1
    return line[lo : hi + 1], lo, hi + 1, line[q : hi + 1].strip(".")
