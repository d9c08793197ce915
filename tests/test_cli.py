import pytest

from lamplight.__main__ import main
from lamplight.functions import execution


def test_from_folders_to_scores(spark, tmp_path, capsys):
    solutions = {"py": "class Solution:\n    def solve(self, a: int) -> int:\n        return a + 1\n", "java": "class Solution { public int solve(int a) { return a + 1; } }"}
    for k in (1, 2, 3):
        (at := tmp_path / "tree" / f"{k}. Number {k}").mkdir(parents=True)
        for ext, text in solutions.items():
            (at / f"{k}.{ext}").write_text(text if k != 3 else text.replace("+ 1", "+ 2"))
    main(["base", str(tmp_path / "tree"), str(tmp_path / "base")])
    assert "| java | 3 |" in capsys.readouterr().out
    main(["instruct", str(tmp_path / "base"), str(tmp_path / "instruct")])
    test, train = (spark.read.parquet(str(tmp_path / "instruct" / x)) for x in ("test", "train"))
    assert test.count() == 2 and train.count() == 4 and "parallel_id" not in train.columns
    tests = spark.read.parquet(str(tmp_path / "base")).selectExpr("*", "'assert solve(a = 4) == 5' AS test", "'Solution().solve' AS entry_point")
    tests.write.parquet(str(tmp_path / "tests"))
    (tmp_path / "out.json").write_text('[{"parallel_id": 2, "target_language": "java"}]')
    main(["evaluation", str(tmp_path / "tests"), str(tmp_path / "evaluation"), "--exclusions", str(tmp_path / "out.json")])
    assert spark.read.parquet(str(tmp_path / "evaluation")).count() == 5
    if not execution.available("java"):
        pytest.skip("no javac")
    capsys.readouterr()
    main(["score", str(tmp_path / "evaluation"), str(tmp_path / "scores"), "--tasks", "3"])
    got = {(r.parallel_id, r.target_language): r.outcome for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    assert got == {(1, "java"): "passed", (1, "python"): "passed", (2, "python"): "passed", (3, "java"): "wrong_output", (3, "python"): "wrong_output"}
    assert "| java | python | 3 | 1.000 | 0.667 | 0.667 |" in capsys.readouterr().out
    main(["query", "markdown_report", "/root/testdata/sf0.001", str(tmp_path / "report")])
    assert "r_regionkey" in capsys.readouterr().out
