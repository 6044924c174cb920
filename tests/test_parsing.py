import time

from codequarry.operators import documents as d
from codequarry.operators.parser import identifier_at, package_clauses, parse, parse_units, resolve_conditionals, signature
from codequarry.sources.files import interface_part

UNIT = """unit Demo.Main;
interface
uses System.SysUtils, Classes in 'lib\\Classes.pas';
type
  /// A shape
  TShape<T: class> = class(TBase, IDrawable)
  private
    FA, FB: Integer;
  strict protected
    procedure Draw(const A: string = ';'); virtual; abstract;
  public
    constructor Create; overload;
    constructor Create(A: Integer); overload;
    class function Make: TShape<T>; static;
    property Name: string read FA write FB; default;
  end;
  [Attr('x')]
  IFoo = interface(IBar)
    ['{AAA}']
    function Go: Boolean;
  end;
  TRec = record
    case Integer of
      0: (A: Integer);
  end;
  TCb = reference to procedure(A: Integer);
const
  { The answer }
  cA: Integer = 42;
var
  g1, g2: Integer;
implementation
constructor TShape<T>.Create;
  procedure Nested;
  begin
  end;
begin
  case I of 0: begin end; end;
  try finally end; // end;
  S := 'end;';
end;
end.
"""


def test_declarations():
    status, rows, uses, unit = parse(UNIT)
    assert (status, uses, unit) == ("parsed", ["System.SysUtils", "Classes"], "Demo.Main")
    by = {(r.full_name, r.is_declaration): r for r in rows}
    shape = by["TShape<T:class>", True]
    assert (shape.type, shape.ancestor, shape.interfaces, shape.comments) == ("class", "TBase", ["IDrawable"], "A shape")
    assert by["TShape<T:class>.Draw", True].visibility == "protected" and by["IFoo", True].ancestor == "IBar"
    assert sum(r.name == "Create" for r in rows) == 3 and by["TShape<T>.Create", False].container == "TShape<T>"
    assert {r.name: r.type for r in rows}["TRec"] == "record" and by["cA", True].comments == "The answer"
    assert [r.name for r in rows if r.type == "var"] == ["g1", "g2"] and "Nested" not in {r.name for r in rows}
    assert UNIT[by["TShape<T>.Create", False].start : by["TShape<T>.Create", False].end].endswith("'end;';\nend;")


def test_conditionals():
    t = "{$IFDEF LINUX}uses A;{$ELSE}uses B;{$ENDIF}{$IFNDEF X1}c{$ELSE}d{$ENDIF}{$DEFINE Q}{$IFDEF Q}e{$ENDIF}'{$IFDEF LINUX}'"
    got = resolve_conditionals(t)
    assert len(got) == len(t) and got.split() == ["uses", "B;", "c", "e", "'{$IFDEF", "LINUX}'"]


def test_symbols_that_count_as_defined():
    both = lambda word, name: resolve_conditionals(f"{{${word} {name}}}a{{$ELSE}}b{{$ENDIF}}").split()
    for name in ("WIN64", "CPUX64", "delphi", "PUREPASCAL", "HASINLINE"):
        assert both("IFDEF", name) == ["a"] and both("IFNDEF", name) == ["b"]
    for name in ("FPC", "OSPOSIX", "darwin", "CPUMIPS"):
        assert both("IFDEF", name) == ["b"] and both("IFNDEF", name) == ["a"]
    for name in ("DEBUG", "MACOS", "ANYTHING"):  # unknown: the first branch
        assert both("IFDEF", name) == ["a"] and both("IFNDEF", name) == ["a"] and both("IF", f"Defined({name})") == ["a"]
    nested = "{$IFDEF FPC}x{$IFDEF WIN32}y{$ELSE}z{$ENDIF}{$ELSE}k{$IFNDEF UNICODE}l{$ELSEIF X}m{$ENDIF}n{$ENDIF}o"
    assert resolve_conditionals(nested).split() == ["k", "m", "n", "o"]
    began = time.time()
    deep = "{$IFDEF FPC}" * 30000 + "x" + "{$ENDIF}" * 30000 + "y"
    assert resolve_conditionals(deep).split() == ["y"] and time.time() - began < 5


def test_failures_and_rows(spark):
    df = spark.createDataFrame([("a", UNIT), ("b", "unit b; implementation procedure X; begin if"), ("c", None), ("d", "")], "path string, text string")
    got = parse_units(df).collect()
    assert {r["file_path"]: r["parse_status"] for r in got} == {"a": "parsed", "b": "failed", "c": "failed", "d": "failed"}
    one = next(r for r in got if r["full_name"] == "TShape<T:class>.Draw")
    assert (one["start_line"], one["end_line"], one["visibility"], one["parent_class"]) == (10, 10, "protected", "TShape<T:class>")


def test_small_parsers():
    assert signature("procedure X(a: string = ';'; b: Integer); var q: Integer; begin " + "x;" * 300) == "procedure X(a: string = ';'; b: Integer);"
    assert identifier_at("  Foo.Bar(x)", 7) == ("Bar", 6, 9, "Foo.Bar") and identifier_at("  ", 1)[0] == "" and identifier_at("ab", 99)[0] == ""
    assert package_clauses("// FRAMEWORK: vcl\npackage P; requires rtl, vcl { x }; contains A in 'a.pas', B;") == (["rtl", "vcl"], [("A", "a.pas"), ("B", None)], "VCL")
    assert interface_part("unit a; {$IFDEF X} implementation {$ENDIF} b // implementation\nimplementation c") == "unit a; {$IFDEF X} implementation {$ENDIF} b // implementation\n"


def test_help_pages(spark):
    long = "INTRO\n" + "word " * 1200 + "\n2 More\n" + "text\n" * 5
    rows = [(1, "<title>Vcl.Forms.TForm Class - RAD Studio</title><body>a&nbsp;&lt;b&gt;<script>x</script></body>", "x/p1.htm"), (2, "<h1>Example</h1><div class='q'>z</div><div class=\"main content\">in <b>side</b></div>", "p2.htm"), (3, "just", "C:\\h\\p3.v2.htm"), (4, "", "p4.htm"), (5, None, None), (6, f"<title>x</title>{long}", "p6")]
    p = d.pages(spark.createDataFrame(rows, "id long, html string, path string"), "html", "path")
    got = {r["id"]: r for r in p.collect()}
    assert set(got) == {1, 2, 3, 6}
    assert (got[1]["title"], got[1]["text"], got[1]["doc_type"], got[1]["framework"], got[1]["unit_name"], got[1]["short_name"]) == ("Vcl.Forms.TForm Class", "a <b>", "class", "VCL", "Vcl", "TForm Class")
    assert (got[2]["title"], got[2]["text"]) == ("Example", "in side") and got[3]["title"] == "p3.v2"
    s = d.sections(spark.createDataFrame([(1, "A\nb\n2 c\r\nd"), (2, ""), (3, None)], "id long, t string"), "id", "t").collect()
    assert {(r["id"], r["section"], r["content"]) for r in s} == {(1, 0, "A\nb"), (1, 1, "2 c\nd"), (2, 0, "")}
    assert {r["id"] for r in d.chunks(p, "id").collect()} == {1, 2, 3, 6}
