import pytest

from marginalia.sources import islands as I


def units(spark, *lines, head=("\\documentclass{article}", "\\begin{document}"), tail=("\\end{document}", "")):
    text = "\n".join([*head, *lines, *tail])
    rows = I.units(spark.createDataFrame([(1, text)], "path long, text string")).collect()
    data = text.encode()
    return [(r["kind"], data[r["start"] : r["end"]].decode()) for r in sorted(rows, key=lambda r: r["start"])]


def test_paragraphs_and_islands(spark):
    found = units(
        spark, "Safe plain paragraph across", "two source lines.", "", "Mixed formula $x=1$ makes this whole paragraph unsafe.", "This suffix stays an island.", "",
        "\\label{unsafe}", "", "\\begin{equation}", "x = 2", "\\end{equation}",
    )
    assert found == [
        ("paragraph", "Safe plain paragraph across\ntwo source lines."), ("island", "Mixed formula"), ("island", "makes this whole paragraph unsafe."), ("island", "This suffix stays an island."),
    ]


def test_commands_that_set_text_and_those_that_hide_it(spark):
    found = units(spark, "Début \\emph{critical wording} before \\cite[p. 2]{private-key}, then ünï \\href{url}{shown} end -- last")
    assert [t for _, t in found] == ["Début", "critical wording", "before", ", then ünï", "end", "last"]


@pytest.mark.parametrize(
    "line",
    ["Safe prefix \\unknowncommand{opaque} rest", "text $unclosed", "a } b", "x \\) y", "\\end{quote}", "\\begin{quote}", "\\href{only one} two", "\\textbf{open"],
)
def test_what_is_not_proven_disables_the_islands_of_its_file(spark, line):
    assert units(spark, "Plain paragraph.", "", "Mixed $x$ line", "", line) == [("paragraph", "Plain paragraph.")]


@pytest.mark.parametrize("payload", [r"\unknowncommand{opaque}", r"\'{e}", r"\begin{quote}opaque"])
def test_an_odd_argument_spoils_its_line_only(spark, payload):
    found = units(spark, "Plain before.", "", rf"\emph{{{payload}}} Token", "", "Mixed $x$ tail")
    assert found == [("paragraph", "Plain before."), ("island", "Mixed"), ("island", "tail")]


def test_arguments_over_lines_and_comments(spark):
    found = units(spark, "\\affiliation{organization={A},", "country={France}}", "\\maketitle", "Visible \\figref{fig} at 2.0\\% % \\unknown", "Shown \\ref{a} 5\\% more", "", "Last one.", "")
    assert found == [("island", "Shown"), ("island", "more"), ("paragraph", "Last one.")]


def test_nothing_outside_the_document_and_nothing_after_its_end(spark):
    assert units(spark, "Inside.", "", head=("Before.", "", "\\begin{document}"), tail=("\\end{document}", "", "After.")) == [("paragraph", "Inside.")]
    assert units(spark, "Inside.", "\\endinput", "Never read.", "") == []
    assert units(spark, "Inside.", "", "\\endinput", "Never read.") == [("paragraph", "Inside.")]


def test_parts_of_a_project_have_no_document_of_their_own(spark):
    df = spark.createDataFrame([(1, "A part.\r\n\r\nWith $x$ math\r\n"), (2, None), (3, "")], "path long, text string")
    assert sorted(map(tuple, I.units(df, whole=False).collect())) == [(1, 0, 7, "paragraph"), (1, 11, 15, "island"), (1, 20, 24, "island")]


def test_texts_are_read_once_and_only_places_are_moved(spark):
    """Paragraphs and islands come of one pass: one scan in Python and one shuffle, which holds no text."""
    texts = spark.createDataFrame([(1, "Plain.\n\nMixed $x$ line\n")], "path long, text string")
    plan = I.units(texts, whole=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert plan.count("Exchange") == 1
