import pytest

from marginalia.sources import discovery


def test_a_tree_from_its_main_file(spark, tmp_path):
    for name, text in {
        "main.tex": "\\documentclass{article}\\usepackage{own,other}\n\\input{a} % \\input{unread}\n\\include{parts/b.tex}\\bibliography{refs, gone}\n\\input{\\jobname}\\input{../up}",
        "a.tex": "\\includegraphics[width=1cm]{pic}\\includegraphics{two}\n100\\% \\input{main}",
        "parts/b.tex": "\\input{./a}",
        "own.sty": "\\input{deep}",
        "deep.tex": "end",
        "refs.bib": "@book{k}",
        "unread.tex": "\\input{deep}",
        "pic.png": "p", "two.png": "2", "two.pdf": "2",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    project, files = discovery.discover_tree(spark, str(tmp_path), "main.tex")
    seen = {r["file"]: (r["length"], r["sha256"][:7]) for r in files.collect()}
    assert sorted(seen) == ["a.tex", "deep.tex", "main.tex", "own.sty", "parts/b.tex", "pic.png", "refs.bib"]
    assert seen["deep.tex"] == (3, "sha256:")
    assert {(r["file"], r["target"], r["kind"]) for r in project.edges.collect()} == {
        ("main.tex", "own.sty", "package"), ("main.tex", "a.tex", "input"), ("main.tex", "parts/b.tex", "include"), ("main.tex", "refs.bib", "bibliography"),
        ("a.tex", "pic.png", "graphic"), ("a.tex", "main.tex", "input"), ("parts/b.tex", "a.tex", "input"), ("own.sty", "deep.tex", "input"),
    }
    assert {(r["file"], r["name"], r["reason"]) for r in project.external.collect()} == {
        ("main.tex", "gone", "missing"), ("main.tex", "\\jobname", "dynamic"), ("main.tex", "../up", "rejected"), ("a.tex", "two", "ambiguous"),
    }
    before = discovery.tree_hash(files).first()[0]
    (tmp_path / "unread.tex").write_text("changed")
    assert discovery.tree_hash(discovery.discover_tree(spark, str(tmp_path), "main.tex")[1]).first()[0] == before
    (tmp_path / "deep.tex").write_text("changed")
    assert discovery.tree_hash(discovery.discover_tree(spark, str(tmp_path), "main.tex")[1]).first()[0] != before


def test_bounds_and_a_missing_main_file(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k}.tex").write_text(f"\\input{{f{k + 1}}}")
    with pytest.raises(ValueError, match="more than 3"):
        discovery.discover_tree(spark, str(tmp_path), "f0.tex", most_files=3)
    with pytest.raises(ValueError, match="no main.tex"):
        discovery.discover_tree(spark, str(tmp_path), "main.tex")
