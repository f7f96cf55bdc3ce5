import os

import pytest

from loomtext.plans import cohesion, composite_queries
from loomtext.sources import io
from tests.test_against_sql import both
from tests.test_keywords import ROWS


def files(folder):
    return [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names if name[0] not in "._"]


def test_texts_go_group_by_group_and_tokens_are_compressed(spark, tmp_path, monkeypatch):
    seen, remove = [], io.remove_spread
    monkeypatch.setattr(composite_queries, "fresh_dir", lambda session, kind: f"{tmp_path}/{kind}")
    monkeypatch.setattr(cohesion, "fresh_dir", lambda session, kind: f"{tmp_path}/{kind}")
    monkeypatch.setattr(composite_queries, "SPREAD", 5)
    monkeypatch.setattr(composite_queries, "GROUPS", 3)
    monkeypatch.setattr(io, "remove_spread", lambda *a: (remove(*a), seen.append(len(files(f"{tmp_path}/texts")))))
    got, want = both(spark, tmp_path, "q_run_folder", documents=ROWS.replace("SELECT 5, NULL", "SELECT 5 + i, NULL FROM range(9) AS r(i)"))
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want] and len(got) == 14
    assert len(seen) == 3 and seen[0] > seen[1] > seen[2] == 0
    tagged = files(f"{tmp_path}/indices/tagged")
    assert tagged and all(f.endswith(".csv.gz") for f in tagged) and spark.read.csv(f"{tmp_path}/indices/counts", header=True).count() == 14


def test_groups_give_what_one_gives(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i}.txt", f"The dogs ran {'on ' * i}. A cat, \"it\" slept.\nThe end") for i in range(11)], "name string, text string")
    io.write_files(docs, "name", "text", f"{tmp_path}/in", 4)
    found = {}
    for groups, compression in ((1, None), (3, "gzip"), (9, None)):
        out = f"{tmp_path}/out{groups}"
        rows = cohesion.run_folder(spark, f"{tmp_path}/in", out, families=("diversity",), tagged=True, counts=True, spread=4, groups=groups, compression=compression)
        tables = [rows, *[spark.read.csv(f"{out}/{t}", header=True) for t in ("tagged", "counts")]]
        found[groups] = [sorted(map(str, t.collect())) for t in tables]
    assert found[1] == found[3] == found[9] and [len(x) for x in found[1]][::2] == [11, 11] and len(files(f"{tmp_path}/in")) == 11
    with pytest.raises(ValueError):
        cohesion.run_folder(spark, f"{tmp_path}/in", consume=True)
