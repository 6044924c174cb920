import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import contamination, markup, pairs, repetition, splitting

DOCS = "doc_id long, text string, lang string, source string, share double, n_words int, _text string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, None, None, 9.0, 1, "clash") for i, t in enumerate(texts)], DOCS)


def brute_share(text, n=5):
    words = repetition.words_of(text or "")
    seen, mark = set(), [False] * len(words)
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            mark[i : i + n] = [True] * n
        seen.add(g)
    return sum(mark) / len(words) if words else 0.0


# ---------------------------------------------------------------- repetition


@given(st.lists(st.sampled_from("a b c d é".split()), max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeated_words_brute_force(words):
    got = repetition.repeated_words(words, 5)
    assert got == round(brute_share(" ".join(words)) * len(words))


def test_words_are_letters():
    assert repetition.words_of("Don't x² ½y İZ a1b _c_ ÀÉ\u0301") == ["don", "t", "x", "y", "i\u0307z", "a", "b", "c", "àé"]


def test_repetition_edges(spark):
    same = "one two three four five six " * 400_0
    d = docs(spark, None, "", "  ", "1 2 3", "a b c d", same, same).union(docs(spark, same))
    got = repetition.repetition(d, "doc_id", "text").collect()
    assert len(got) == 8 and [r["share"] for r in got if r["doc_id"] < 5 and r["n_words"] < 9] == [0.0] * 5
    assert all(r["share"] > 0.99 for r in got if r["n_words"] > 9)
    assert repetition.repetition(d.limit(0), "doc_id", "text").count() == 0


def test_adaptive_cutoffs(spark):
    rng = random.Random(4)
    rows = [(i, "EN" if i % 2 else "en ", "a-b" if i % 3 else "A_B", rng.random() / 10) for i in range(900)] + [(1000 + i, None, None, 0.5 + rng.random() / 2) for i in range(900)] + [(5000, "fr", "x", 0.06)]
    s = spark.createDataFrame(rows, "doc_id long, lang string, source string, share double")
    got = {r["doc_id"]: r for r in repetition.flag_repetitive(s, quantile=0.9).collect()}
    assert len(got) == len(rows)
    low = [r for i, r in got.items() if i < 900]
    assert len({r["cutoff"] for r in low}) == 1 and 0.085 < low[0]["cutoff"] < 0.095  # spellings fall together
    assert 0.07 < sum(r["repetitive"] for r in low) / 900 < 0.13
    assert got[5000]["cutoff"] > 0.5  # too small a group: everything's
    assert all(r["cutoff"] <= 0.3 for r in repetition.flag_repetitive(s, ceiling=0.3).collect())
    assert repetition.flag_repetitive(s.limit(0)).count() == 0


def test_target_cutoffs_lose_nothing(spark):
    rng = random.Random(9)
    rows = [(i, "en", f"s{i % 5}", round(rng.random() ** (1 + 3 * (i % 5)), 3)) for i in range(4000)]
    rows += [(5000 + i, "de", "all_high", 0.5 + i / 1000) for i in range(300)] + [(6000 + i, "fr", "few", 0.1 * i) for i in range(9)] + [(7000 + i, "es", "low", i / 10_000) for i in range(400)]
    s = spark.createDataFrame(rows, "doc_id long, lang string, source string, share double")
    got = repetition.flag_repetitive(s, target=0.3).collect()
    want = {r[0] for r in rows if r[3] >= 0.3}
    kept = {r["doc_id"] for r in got if r["repetitive"]}
    assert want <= kept and len(kept - want) < 0.05 * len(rows)  # few are left for the exact check
    cutoffs = {r["source"]: r["cutoff"] for r in got}
    assert cutoffs["low"] < 0.04 and cutoffs["all_high"] == 0.5 and len(set(cutoffs.values())) > 4


# ---------------------------------------------------------------- contamination

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil an enormous kettle of green soup beside the frozen lake near Müller house until somebody finally rings the bronze bell again"


def leak(spark, *texts, items=((7, ITEM),), **kw):
    it = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((r["doc_id"], r["item_id"]) for r in contamination.contamination(docs(spark, *texts), it, **kw).collect())


def test_leaks(spark):
    w = ITEM.split()
    edit = [*w]
    edit[10], edit[20] = "xxx", "yyy"
    del edit[28]
    far = " ".join(x if i % 4 else "zzz" for i, x in enumerate(w))
    texts = [
        "before " + ITEM + " after",
        "> " + ITEM.upper().replace("MÜLLER", "mu\u0308ller").replace(" ", "\n// ", 3) + "!",
        "<b>" + " ".join(w[:12]) + "</b> &nbsp; **" + " ".join(w[12:27]) + "**",
        " ".join(w[:24]),
        " ".join(w[5:30]),
        " ".join(edit),
        far,
        None,
        "",
        " ".join(w[:20]) + " something else entirely stands between these two " + " ".join(w[20:]),
        ITEM + " x " + ITEM,
    ]
    assert leak(spark, *texts) == [(i, 7) for i in (0, 1, 2, 4, 5, 10)]


def test_leak_blocks_and_edges(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(12)] + [(99, None), (None, ITEM), (98, "short one")]
    texts = [items[3][1], items[5][1] + " " + items[8][1], "short one"]
    want = [(0, 3), (1, 5), (1, 8)]
    assert leak(spark, *texts, items=items) == want
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 300)
    assert leak(spark, *texts, items=items) == want
    assert leak(spark, *texts, items=[]) == [] and leak(spark, items=items) == []


def leaks_by_alignment(doc, item, least=25, most=contamination.MAX_EDITS):
    """Whether any run of item words stands in the text with few edits, by full alignments."""
    for i in range(len(item) - least + 1):
        prev = [0] * (len(doc) + 1)
        for s in range(1, min(len(item) - i, 2 * least) + 1):
            cur = [s]
            for j, w in enumerate(doc, 1):
                cur.append(min(prev[j - 1] + (w != item[i + s - 1]), prev[j] + 1, cur[-1] + 1))
            prev = cur
            if s >= least and min(cur) <= most * s:
                return True
    return False


def ids_of(index, words):
    return [index.vocabulary.get(x, -1) for x in words]


def test_planted_leaks_by_brute_force():
    """Random edits: what has 25 words in a row with few edits is found, and nothing else."""
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    seen = set()
    for _ in range(150):
        item = [rng.choice(vocab) for _ in range(50)]
        index = contamination.Index([(1, " ".join(item))])
        n, lo = rng.randrange(22, 46), rng.randrange(5)
        part = item[lo : lo + n]
        for _ in range(rng.randrange(0, 6)):
            i = rng.randrange(1, len(part) - 1)
            part[i : i + 1] = rng.choice([["new"], [], [part[i], "new"]])
        doc = ids_of(index, [rng.choice(vocab) for _ in range(8)] + part + [rng.choice(vocab) for _ in range(8)])
        want = leaks_by_alignment(doc, index.items[1])
        assert bool(contamination.leaks(doc, index)) == want
        seen.add(want)
    assert seen == {True, False}


@pytest.mark.parametrize(("n", "altered"), [(28, (8, 12, 16)), (39, (12, 16, 20, 24)), (60, (8, 16, 24, 32, 40, 48))])
def test_edits_close_together(n, altered):
    item = [f"a{i}" for i in range(n)]
    index = contamination.Index([(1, " ".join(item))])
    doc = ids_of(index, ["zz" if i in altered else w for i, w in enumerate(item)])
    assert contamination.leaks(doc, index) == [(1, 0, n, n, len(altered))]
    twice = contamination.leaks(doc + [-1] * 30 + doc, index, every=True)
    assert [x[1:3] for x in twice] == [(0, n), (n + 30, 2 * n + 30)]


def test_repeated_phrases_take_linear_time():
    phrase = "the report shows that all of the values are fine "
    index = contamination.Index([(1, phrase * 8 + " ".join(f"q{i}" for i in range(40)))])
    for text in (phrase + "other ", phrase):
        doc = ids_of(index, (text * 4000).split())
        began = time.time()
        contamination.leaks(doc, index)
        assert time.time() - began < 10


def test_remove(spark):
    it = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination.remove_leaks(docs(spark, "keep this, <i>" + ITEM + "</i> and that", ITEM, "clean", None), it).collect()}
    assert got[0]["text"] == "keep this, <i></i> and that" and not got[2]["dropped"] and got[1]["dropped"] and got[1]["text"] == ""
    assert got[2]["text"] == "clean" and got[3]["text"] is None and got[2]["n_cut"] == 0


# ---------------------------------------------------------------- markup


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h2>T</h2><p>a <b>b</b>&nbsp;c<p>d<br>e", "## T\n\na b c\n\nd\ne"),
        ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n  1. z"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
        ("<table>x<caption>c</caption><tr>y<td>a<td>b</table>", "x\nc\ny | a | b"),
        ("<script>var a='<b>';</script><div style='display: none'>no</div><p hidden>no</p>yes<style>p{}</style>", "yes"),
        ("<pre><code>if a &lt; b then\n  c;</code></pre>", "```\nif a < b then\n  c;\n```"),
        ("x &amp;lt;i&amp;gt; y", "x <i> y".replace("<i>", "").replace("  ", "  ")),
        ("# A #\n\nsee **b** and _c_ `d` ~~e~~ [f](g.md) ![h](i.png)", "# A\n\nsee b and c d e f h"),
        ("T\n===\n\n| a | b |\n|---|---|\n| cc | d |", "# T\n\na  | b\ncc | d"),
        ("```pascal\na := '<b>';\n```", "```pascal\na := '<b>';\n```"),
        ("== H ==\n* [[P|q]] '''r''' {{s}}\n{|\n| a || b\n|-\n| c || d\n|}", "# H\n\n- q r \n\na | b\nc | d"),
        ("\\section{S}\n\\begin{itemize}\n\\item a \\emph{b}\n\\end{itemize}\n\\begin{verbatim}\nx{1}\n\\end{verbatim}\n$\\frac{1}{2}$ \\(c^2\\)", "# S\n\n- a b\n\n```\nx{1}\n```\n\n$\\frac{1}{2}$ $c^2$"),
        ('<span class="math">O(n&lt;sup&gt;8&lt;/sup&gt; \\log_{5} n)</span>', "$O(n^{8} \\log_{5} n)$"),
    ],
)
def test_rendering(text, want):
    got = "\n".join(x.rstrip() for x in markup.render(text).split("\n"))
    want = "\n".join(x.rstrip() for x in want.split("\n"))
    assert got == want or got.replace("  ", " ") == want.replace("  ", " ")


PLAIN = ["Holds while Low < Mid and Mid > High.", "Declare TList<Integer> or TDictionary<string, TObject>.", "Area is 2 * Width * Height, so W * H.", "Use $0F or $FF, at $40 steps. Cost is 5$ to 7$.", "max_row_count and min_row_count", "R&D builds write to C:\\textures\\out and D:\\begin.", "A[I] (see B) and C^ work. Items[0] equals Items[I - 1].", "Text is #13#10 separated, version 2_1 <> 2_2.", "A { braced } remark and a (starred) one.", "'like this' or 'like' + 'that'", ""]
MARKED = ["a </p b", "x <br> y", "&nbsp;", "&#8211;", "<!-- x -->", "\n## Notes\n", "== Notes ==", "**note**", "~~old~~", "`code`", "[more](#top)", "![](p.png)", "[[Setup|setup]]", "{{stub}}", "'''new'''", "$\\alpha_1$", "\\textit{see}", "\\begin{itemize}", "| a | b |\n|---|---|"]


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert markup.kinds_of(f"Some words. {text} More words.") == {}


@pytest.mark.parametrize("text", MARKED)
def test_markup(text):
    assert markup.kinds_of(f"words {text} words" if "\n" not in text and "==" not in text else f"words\n{text}\nwords")


@given(st.text(alphabet="<>/abphtdrliu&;*_`#|-=[](){}\\$ \n'~!", max_size=120))
@settings(max_examples=300, deadline=None)
def test_rendering_never_fails(text):
    markup.render(text)
    markup.kinds_of(text)


LONG = {
    "div": "<div>" * 100_000 + "deep" + "</div>" * 50_000,
    "list": "<ul><li>x" * 50_000 + "deep",
    "quote": "<blockquote>x" * 60_000 + "deep",
    "table": "<table><tr><td>x" * 40_000 + "deep",
    "formula": '<span class="math">' + "<sup>" * 60_000 + "deep",
    "code": "<pre>" + "<b>" * 100_000 + "deep",
    "closing": "<b>" * 40_000 + "<p>" + "</i></table>" * 40_000 + "deep",
    "blocked": "<p><table>" + "<b>" * 40_000 + "</p>" * 40_000 + "deep",
    "paragraphs": "<b>" * 40_000 + "<p>" * 40_000 + "deep",
    "options": "<b><option>" * 40_000 + "deep",
    "attributes": "<a " + 'x="1" ' * 60_000 + ">deep</a>",
    "math": "\\(x " * 100_000 + "deep",
    "brackets": "\\[x " * 50_000 + "$$ y " * 51 + "$ \\ab[" * 50_000 + "deep",
    "links": "[http://a " * 40_000 + "[http://b" * 40_000 + "[[c|" * 40_000 + "deep",
    "heading": "# a" + " " * 200_000 + "b\n== c" + " " * 200_000 + "d\ndeep",
    "blanks": "x" + " " * 300_000 + "deep &amp;\n" + " " * 200_000 + "\n",
    "marks": "**a " * 40_000 + "__b " * 40_000 + "''c " * 40_000 + "~~d `e {{f " * 20_000 + "\ndeep",
    "rows": "| a " * 100_000 + "\n" + "| b |\n" * 10_000 + "deep",
    "items": "\\begin{enumerate}\\item x\n" * 20_000 + "deep",
    "cells": "<table><tr><td>" + "w " * 100_000 + "<tr><td>a<td>b" * 2_000 + "</table>deep",
}


@pytest.mark.parametrize("kind", LONG)
def test_hostile_texts_take_little_time(kind):
    began = time.time()
    got, met = markup.rendered(LONG[kind])
    markup.kinds_of(LONG[kind])
    assert time.time() - began < 20 and "deep" in got


def test_what_rendering_meets():
    for text in PLAIN:
        assert not set(markup.rendered(f"Some words. {text} More words.")[1]) - {"list"}
    for text in MARKED:
        assert markup.rendered(f"words {text} words" if "\n" not in text and "==" not in text else f"words\n{text}\nwords")[1]


def test_clean_edges(spark):
    s = spark.createDataFrame([(1, "<b>x</b>", "a.htm", "code"), (2, "<b>x</b>", "A.PAS", "help"), (3, None, None, None), (4, "", "b.md", ""), (5, "plain", None, None), (5, "plain", None, None), (6, "<p>" * 20000 + "deep", "c.htm", "")], "id long, content string, file_path string, n_pieces string")
    got = sorted((r["id"], r["n_pieces"], r["text"]) for r in markup.clean(s.where("id <> 3")).collect())
    assert got[:4] == [(1, 2, "x"), (4, 0, ""), (5, 0, "plain"), (5, 0, "plain")] and got[4][2].strip() == "deep"
    assert markup.clean(s.where("id = 3")).first()["text"] is None and markup.clean(s.limit(0)).count() == 0


# ---------------------------------------------------------------- pairs


def names(content, comments=None):
    return [(n, d) for n, _, d in pairs.routines(content, comments)]


DOC = "Opens the first file of the list."


@pytest.mark.parametrize("mark", ["{ %s }", "(* %s *)", "// %s", "/// <summary>\n/// %s\n/// </summary>\n/// <param name=\"A\"></param>", "{\n  %s\n}"])
def test_documented(mark):
    assert names((mark % DOC) + "\nPROCEDURE TFoo.Bar(A: Integer);\nbegin\nend;") == [("TFoo.Bar", DOC)]


@pytest.mark.parametrize("doc", ["", "...", "TODO: document this", "FIXME", "n/a see above", "*** Bar ***", "TFoo.Bar", "Open File", "{$REGION 'a b c d e f'}", "<summary></summary>", "@inheritdoc", "--------------", "12.03.2014 rk", "Result := FA;", "for I := 0 to FA.Count - 1 do Call(FA[I], 12);", "//Bar(AValue);"])
def test_trivial(doc):
    assert names("// " + doc + "\nprocedure TFoo.OpenFile;\nbegin\nend;", doc) == []


def test_where_documentation_counts():
    body = f"procedure A;\nbegin\n  // {DOC}\n  S := 'procedure B; {{ {DOC} }}';\nend;"
    assert names(body) == [] and names(body, DOC) == [("A", DOC)]
    cls = f"TX = class\n  // {DOC}\n  procedure M;\n  // ------\n  function N: Integer;\n  FOn: procedure(A: Integer) of object;\nend;"
    assert names(cls, DOC) == [("M", DOC)]
    assert names(f"unit U;\n// {DOC}\n\n\nprocedure A;\nbegin\nend;") == []
    assert names(f"{{ {DOC}") == [] and names("") == []
    two = f"// {DOC}\n// Then it closes the other one too.\nclass function TX<T>.Go: T;\nbegin\nend;"
    assert names(two)[0][0] == "TX<T>.Go" and "other one" in names(two)[0][1]


def test_routine_ends():
    src = "procedure A(X: Integer = 1; const S: string = ';');\nvar I: Integer;\n  procedure In_;\n  begin\n  end;\nbegin\n  case I of 1: begin end; end;\n  S := 'end;';\n  try except end; // end;\nend;\nprocedure B; begin end;"
    assert src[: pairs.routine_end(src, 11)].endswith("// end;\nend;")
    assert pairs.routine_end("procedure A; forward; procedure B;", 11) == 21
    cls = "procedure M; virtual;\n procedure N;\nend;"
    assert pairs.routine_end(cls, 11) == 12


def test_routine_ends_of_hostile_texts():
    inner = "procedure A;\nvar I: Integer;\n" + "  procedure N;\n  begin\n  end;\n" * 3 + "begin\n  X;\nend;\n"
    assert pairs.routine_end(inner + "procedure B;\nbegin\nend;", 11) == len(inner) - 1
    assert pairs.routine_end("procedure A;\nbegin\n  X;\nprocedure T.B;\nbegin\nend;", 11) == 24
    doc = f"// {DOC}\n"
    for text in (
        doc + "procedure A(" + "(" * 60_000 + ";",
        doc + "procedure A;\nvar x: Integer;\n" + "procedure N; begin end;\n" * 10_000,
        (doc + "procedure A;\nbegin\n") * 8_000,
        (doc + "procedure A;\n") * 8_000,
        doc + " " * 200_000 + "// x\n" + " " * 200_000 + "procedure A;",
        "// F" + " " * 200_000 + "x;\nprocedure A;",
    ):
        began = time.time()
        blocks = pairs.Blocks(text)
        total = sum(blocks.routine_end(start + len(name)) - start for name, start, _ in pairs.routines(text, None))
        assert time.time() - began < 15 and total <= 2 * len(text)


def test_pairs_edges(spark):
    s = spark.createDataFrame([(1, f"// {DOC}\nprocedure A;\nbegin\nend;", None, "x.PAS", "c"), (1, f"// {DOC}\nprocedure A;\nbegin\nend;", None, "x.PAS", "c"), (2, None, DOC, "y.pas", ""), (3, f"// {DOC}\nprocedure A;", None, "z.js", ""), (4, f"// {DOC}\nprocedure A;", None, None, "")], "id long, content string, comments string, file_path string, code string")
    got = pairs.function_pairs(s).collect()
    assert [(r["id"], r["func_name"], r["description"]) for r in got] == [(1, "A", DOC)] * 2 and got[0]["code"].endswith("end;")
    assert pairs.function_pairs(s.limit(0)).count() == 0


# ---------------------------------------------------------------- splitting


@given(st.text(alphabet="ab .\r\n;é\U0001f600", max_size=400), st.integers(5, 60), st.integers(0, 4), st.sampled_from(["chars", "words"]))
@settings(max_examples=400, deadline=None)
def test_pieces_cover_and_fit(text, limit, overlap, unit):
    got = splitting.pieces(text, limit, overlap, unit)
    size = (lambda t: len(t)) if unit == "chars" else (lambda t: sum(not x.isspace() for x in splitting.TOKEN.findall(t)))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (x, y) in zip(got, got[1:]):
        assert a < x <= b < y
        assert size(text[x:b]) <= overlap
    assert all(size(text[a:b]) <= limit for a, b in got)


@given(st.text(alphabet="ab ._\r\n;é", max_size=80), st.sampled_from(["chars", "words"]), st.integers(1, 30))
@settings(max_examples=300, deadline=None)
def test_prefix_sums(text, unit, limit):
    sizes = splitting.Sizes(text, unit)
    size = (lambda t: len(t)) if unit == "chars" else (lambda t: sum(not x.isspace() for x in splitting.TOKEN.findall(t)))
    edges = range(len(text) + 1) if unit == "chars" else sizes.ends
    for a in edges:
        assert sizes.farthest(a, limit) == max(b for b in edges if b >= a and size(text[a:b]) <= limit)
        assert sizes.back(a, limit) == min(b for b in edges if b <= a and size(text[b:a]) <= limit)


def test_split_by_words(spark):
    text = " ".join(f"w{i}" for i in range(50))
    s = spark.createDataFrame([(1, text), (2, "a b c"), (3, None), (4, "x" * 99)], "id long, content string").selectExpr("*", "1 start_line", "1 end_line")
    got = sorted((r["piece"], r["content"].split()) for r in splitting.split_oversized(s, 20, 3, "words").collect())
    assert [len(w) for _, w in got] == [20, 20, 16] and got[1][1][:3] == got[0][1][-3:]


def test_split_rows(spark):
    text = "".join(f"line {i} of the text;\r\n" for i in range(400))
    rows = [(1, text, 11, 410, "z"), (2, "x" * 4000, 1, 1, "z"), (3, "y" * 9001, None, None, "z"), (4, None, 1, 1, "z"), (5, "\U0001f600" * 4001, None, 7, "z"), (6, "", 1, 1, "z")]
    s = spark.createDataFrame(rows, "id long, content string, start_line int, end_line int, piece string")
    got = splitting.split_oversized(s).collect()
    assert {r["id"] for r in got} == {1, 3, 5}
    one = sorted((r for r in got if r["id"] == 1), key=lambda r: r["piece"])
    assert one[0]["start_line"] == 11 and one[-1]["end_line"] == 410 and all(r["range_fits"] for r in one)
    assert all(r["content"].startswith("line") and r["content"].endswith("\r\n") and 0 < r["overlap"] <= 200 for r in one[1:])
    back = one[0]["content"] + "".join(r["content"][r["overlap"] :] for r in one[1:])
    assert back == text
    lines = text.split("\r\n")
    assert all(lines[r["start_line"] - 11] == r["content"].split("\r\n")[0] for r in one)
    assert all(len(r["content"]) <= 4000 for r in got) and splitting.split_oversized(s.limit(0)).count() == 0
    assert sorted(len(r["content"]) for r in got if r["id"] == 5)[-1] == 4000 and not any(r["range_fits"] for r in got if r["id"] == 3)
