from codequarry.llm.handwritten import look

TEMPLATE, STEM = 7, 8


def test_templates_are_of_whole_texts():
    opening = "procedure Same;\nbegin\n" + "  Call(1);\n" * 300
    a, b, c = (look("procedure", opening + end, "")[TEMPLATE] for end in ("  if a then Exit;\nend;", "  while b do Next(c);\nend;", "  while q do Other(r);\nend;"))
    assert len(opening) > 2000 and a != b and b == c


def test_stems_behind_opening_comments():
    stem = lambda t: look("function", t, "")[STEM]
    plain = stem("function GetField001: Integer;")
    assert plain is not None
    for head in ("{ Version 25 of what the row has in its field, at some length to pass sixty characters }\n", "// of build 7\n// two lines\n", "(* " + "x " * 150 + "*)\r\n"):
        assert stem(head + "function GetField002: Integer;") == plain
    assert stem("{ field 3 }\nprocedure Run;") is None
