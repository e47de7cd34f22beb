import json

from lodestone import cli
from tests.fixtures import build, water


def test_exit_codes_and_output(spark, tmp_path, capsys):
    (tmp_path / "l").mkdir()
    (tmp_path / "r").mkdir()
    (tmp_path / "l/a.arc").write_bytes(build(water()))
    other = water()
    other["sections"][0]["charge"] = 2
    (tmp_path / "r/a.arc").write_bytes(build(other))
    run = lambda *a: cli.main(list(a), spark)
    assert run("info", str(tmp_path / "l")) == 0
    assert [json.loads(x)["role"] for x in capsys.readouterr().out.splitlines()] == ["structure", "bonds", "grid", "data", "spectrum", "log", "files"]
    assert run("diff", str(tmp_path / "l"), str(tmp_path / "l")) == 0
    assert run("diff", str(tmp_path / "l"), str(tmp_path / "r")) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["difference_count"] == 1
    assert run("scrub", str(tmp_path / "l"), "--pattern", "host.") == 0 and "redact" in capsys.readouterr().out
    assert run("cat", str(tmp_path / "l"), "--role", "bonds") == 0 and "pairs" in capsys.readouterr().out
    assert run("nonsense") == 2
