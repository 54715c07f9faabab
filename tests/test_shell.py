import io

from waypost import shell
from waypost.store import EndpointStore


def test_command_line(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "s"), "--format", "json"]
    assert shell.main([*at, "set", "users.u1.age", "30"]) == 0
    assert shell.main([*at, "query", '{ users.u1.name = "al"; return users.u1 }']) == 0
    assert capsys.readouterr().out == '{\n  "age": 30,\n  "name": "al"\n}\n'
    assert shell.main([*at, "list"]) == 0 and shell.main([*at, "compact"]) == 0
    assert capsys.readouterr().out == '[\n  "users.u1.age",\n  "users.u1.name"\n]\n'
    assert shell.main([*at, "query", "{ return users where their.age >= 30 }"]) == 0
    assert '"name": "al"' in capsys.readouterr().out
    assert shell.main([*at, "get", "no.such"]) == 1
    assert "error" in capsys.readouterr().out


def test_shell(spark, tmp_path):
    out = io.StringIO()
    history = shell.History(str(tmp_path / "history"), most=3)
    told = shell.Shell(spark, EndpointStore.in_memory(spark, {"a.b": 1}), history=history, stdout=out)
    for line in ("{ return a.b }", "{ return a.b }", "{ return a.* }", ".list", ".format json", ".nothing", "{ return"):
        assert not told.onecmd(line)
    assert told.onecmd(".exit")
    assert out.getvalue().startswith("1\n1\na.b = 1\na.b\n") and out.getvalue().count('"error"') == 2
    history.save()
    again = shell.History(history.path)
    again.load()
    assert again.commands == [".nothing", "{ return", ".exit"] and again.search("return") == ["{ return"]
