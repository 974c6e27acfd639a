import pytest

from lexaspan.__main__ import parser, run


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "2.fa").write_text(">ABC\nACGTacgt\n>DEF\nacgtACGT\n")
    out = str(d / "2.index")
    assert run(spark, parser().parse_args(["create", str(d / "2.fa"), "--output", out, "--dna", "--max-query-len", "12"])) == 0
    return out


def said(spark, capsys, *args):
    capsys.readouterr()
    code = run(spark, parser().parse_args(list(args)))
    got = capsys.readouterr()
    return code, got.out, got.err


def test_searches(spark, index, capsys, tmp_path):
    assert said(spark, capsys, "count", index, "AC", "X") == (0, "AC 4\nX 0\n", "")
    assert said(spark, capsys, "lo", index, "AC", "GT", "X") == (0, "AC\nABC 0,4\nDEF 0,4\n//\nGT\nABC 2,6\nDEF 2,6\n//\n", "X not found\n")
    assert said(spark, capsys, "locate", index, "AC", "GT", "--absolute")[1] == "AC 13 4 9 0\nGT 15 6 11 2\n"
    out = tmp_path / "o.fa"
    assert said(spark, capsys, "extract", index, "GTAC", "--suffix-len", "3", "--prefix-len", "1", "--output", str(out))[0] == 0
    assert out.read_text() == ">DEF:1-5 GTAC 1\nCGTA\n>ABC:1-5 GTAC 1\nCGTA\n"


def test_listing(spark, index, capsys):
    assert said(spark, capsys, "ls", index, "0-1,99", "--rank", "--suffix", "--lcp", "--len", "4") == (0, " 0 17  0 $\n 1 13  0 ACGT\n", "Invalid rank: 99\n")
    assert "Len Suffixes     17" in said(spark, capsys, "summarize", index)[1]
    assert said(spark, capsys, "check", index)[:2] == (0, "sorted\n")


def test_sampled_and_facts(spark, index, capsys):
    assert said(spark, capsys, "count", index, "ACGTA", "X", "--max-query-len", "2", "--sampled")[1] == "ACGTA 4\nX 0\n"
    assert said(spark, capsys, "lo", index, "AC", "--max-query-len", "2", "--sampled")[1] == "AC\nABC 0,4\nDEF 0,4\n//\n"
    facts = said(spark, capsys, "summarize", index)[1]
    assert "File Size" in facts and "Modified" in facts and "ABC, DEF" in facts
