"""The command line drives the same jobs and prints JSON rows."""

import json
import os

from dqlens.__main__ import main


def test_cli_profile_and_ingest(spark, tmp_text_dir, capsys):
    path = os.path.join(tmp_text_dir, "t.csv")
    with open(path, "w") as fh:
        fh.write("a,b,c\n1,x,\n2,,\n3,nan,\n")
    assert main(["profile", path]) == 0
    rep = json.loads(capsys.readouterr().out.strip())
    assert rep["null_counts"] == {"a": 0, "b": 2, "c": 3}
    assert rep["constant_columns"] == ["c"]
    store = os.path.join(tmp_text_dir, "store")
    assert main(["ingest", store, path, "d1", "u1", "--name", " Test "]) == 0
    capsys.readouterr()
    assert main(["list", store, "u1"]) == 0
    row = json.loads(capsys.readouterr().out.strip())
    assert (row["name"], row["status"], row["row_count"]) == ("Test", "done", 3)
    assert main(["archive", store, "d1", "u1"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["archived"] is True
    assert main(["list", store, "u1"]) == 0
    assert capsys.readouterr().out.strip() == ""
