import json

import pytest

from tessera import cli


@pytest.fixture
def tree(tmp_path, monkeypatch):
    for name in cli.ENVIRONMENT.values():
        monkeypatch.delenv(name, raising=False)
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/user.py").write_text("import x\n\ndef load_user():\n    return user\n")
    (root / "src/view.JSX").write_text("export const View = (p) => <main />\n// synthetic widget token\n")
    (root / ".env").write_text("CANARY=canary_one\n")
    (root / "leak.py").write_text("password = 'canary_two'\n")
    return str(root), str(tmp_path / "store")


def run(spark, capsys, *args):
    code = cli.main(list(args), spark)
    out = capsys.readouterr()
    assert "canary" not in out.out + out.err
    return code, out.out, out.err


def test_snapshot_round_trip(spark, tree, capsys):
    root, store = tree
    assert run(spark, capsys, "search", "--store", store, root, "load")[0] == 1
    assert run(spark, capsys, "index", "--store", store, root)[:2] == (0, "status=indexed chunks=2\n")
    assert run(spark, capsys, "search", "--store", store, root, "load", "user")[1] == "0.950 src/user.py:3-4 load_user\ndef load_user():\n    return user\n"
    code, out, _ = run(spark, capsys, "search", "--store", store, root, "synthetic widget token")
    assert code == 0 and out.startswith("0.600 src/view.JSX:1-2 View\n")
    assert run(spark, capsys, "search", "--store", store, root, "nothinghere")[:2] == (0, "no results\n")
    assert run(spark, capsys, "search", "--store", store, "--language", "python", root, "widget")[1] == "no results\n"
    assert run(spark, capsys, "search", "--store", store, "--path-prefix", "../x", root, "widget")[0] == 2
    assert run(spark, capsys, "search", "--store", store, "--limit", "0", root, "widget")[0] == 2
    assert run(spark, capsys, "nonsense")[0] == 2 and run(spark, capsys, "--version")[0] == 0


def test_semantic_round_trip(spark, tree, capsys):
    root, store = tree
    semantic = ("--semantic", "required", "--embedding-base-url", "hash:")
    code, out, _ = run(spark, capsys, "index", "--store", store, *semantic, root)
    assert (code, out) == (0, "status=indexed vectors=2 requests=1 tokens=0\n")
    code, out, _ = run(spark, capsys, "search", "--store", store, *semantic, "--path-prefix", "src", root, "def load_user(): return user")
    assert code == 0 and "src/user.py:3-4 load_user" in out.split("\n")[0]
    assert run(spark, capsys, "search", "--store", store, "--index-backend", "snapshot", root, "load")[0] == 0
    assert run(spark, capsys, "search", "--store", store, "--index-backend", "auto", root, "load")[0] == 0
    assert run(spark, capsys, "index", "--store", store, "--semantic", "required", "--index-backend", "snapshot", root)[0] == 2
    assert run(spark, capsys, "index", "--store", store, "--semantic", "required", root)[0] == 2
    assert run(spark, capsys, "index", "--store", store, root)[0] == 0
    assert run(spark, capsys, "search", "--store", store, "--index-backend", "snapshot", root, "load")[0] == 1


def test_inventory(spark, tree, capsys, tmp_path):
    from tests.test_evaluation import checklist

    root, _ = tree
    out = tmp_path / "out"
    out.mkdir(mode=0o700)
    (tmp_path / "checklist.json").write_text(json.dumps(checklist()))
    args = ["eval", "inventory", "--root", root, "--checklist", str(tmp_path / "checklist.json"), "--output", str(out / "r.json"), "--repository", "repo-ab"]
    assert run(spark, capsys, *args)[:2] == (0, "decision=go\n")
    assert "canary" not in (out / "r.json").read_text()
    assert run(spark, capsys, *args)[0] == 1


def test_terminal_escapes():
    assert cli.safe("a\x1b[0m‎é\n\U000e0001") == "a\\x1b[0m\\u200eé\n\\U000e0001"
