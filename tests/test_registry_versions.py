"""Registry versions: a save that ends badly changes nothing, whatever it was doing."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import registry as rg

T0, T1 = "2024-01-01 00:00:00", "2024-02-02 00:00:00"


def projects(spark, names):
    return spark.createDataFrame([(n, f"/ws/{n}") for n in names], "name string, project_path string")


def names(spark, path):
    return sorted(r.name for r in rg.load_registry(spark, path).collect())


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "registry")
    rg.save_registry(rg.upsert_projects(rg.load_registry(spark, path), projects(spark, ["a", "b"]), T0), path)
    return path


def test_saves_over_its_own_source(spark, path):
    first = rg.load_registry(spark, path)
    rg.save_registry(rg.upsert_projects(first, projects(spark, ["b", "c"]), T1), path)
    assert names(spark, path) == ["a", "b", "c"]
    assert sorted(r.name for r in first.collect()) == ["a", "b"]  # a loaded version stays readable
    created = {r.name: (str(r.created_at), str(r.updated_at)) for r in rg.load_registry(spark, path).collect()}
    assert created["b"] == (T0, T1) and created["a"] == (T0, T0)


def test_a_write_that_is_killed_half_way_leaves_the_version_before(spark, path):
    before = rg.current_version(spark, path)
    more = rg.upsert_projects(rg.load_registry(spark, path), projects(spark, [f"n{k}" for k in range(500)]), T1)
    broken = more.repartition(8).withColumn("project_path", F.when(
        F.col("name") == "n321", F.raise_error(F.lit("killed"))).otherwise(F.col("project_path")))
    with pytest.raises(Exception, match="killed"):
        rg.save_registry(broken, path)
    assert len([d for d in os.listdir(path) if d.startswith("version-")]) == 2  # what the failed save left
    assert rg.current_version(spark, path) == before and names(spark, path) == ["a", "b"]
    rg.save_registry(more, path)
    assert len(names(spark, path)) == 502


@pytest.mark.parametrize("step", ["create", "rename"])
def test_a_save_killed_at_its_pointer_leaves_the_version_before(spark, path, monkeypatch, step):
    def killed(spark, path, version):
        if step == "rename":  # the new pointer lies beside the old one
            with open(f"{path}/.{version}.pointer", "w") as file:
                file.write(version)
        raise KeyboardInterrupt

    monkeypatch.setattr(rg, "_point", killed)
    with pytest.raises(KeyboardInterrupt):
        rg.save_registry(projects(spark, ["x"]).selectExpr(
            "name", "project_path", "name index_name", "now() created_at", "now() updated_at", "now() last_indexed_at",
            "1L last_indexed_chunk_count"), path)
    monkeypatch.undo()
    assert names(spark, path) == ["a", "b"]


def test_a_first_save_that_did_not_end_is_an_empty_registry(spark, tmp_path):
    path = str(tmp_path / "new")
    os.makedirs(f"{path}/version-1234")
    assert names(spark, path) == [] and rg.current_version(spark, path) is None
    assert rg.drop_old_versions(spark, path) == 0


def test_a_plain_table_is_still_read_and_damage_is_raised(spark, path, tmp_path):
    plain = str(tmp_path / "plain")
    rg.load_registry(spark, path).write.parquet(plain)
    assert names(spark, plain) == ["a", "b"]
    with open(f"{path}/{rg.POINTER}", "w") as file:
        file.write("version-absent")
    os.remove(f"{path}/.{rg.POINTER}.crc") if os.path.exists(f"{path}/.{rg.POINTER}.crc") else None
    with pytest.raises(Exception, match="(?i)path"):
        rg.load_registry(spark, path)


def test_old_versions_go_and_the_current_one_stays(spark, path):
    for k in range(4):
        rg.save_registry(rg.upsert_projects(rg.load_registry(spark, path), projects(spark, [f"m{k}"]), T1), path)
    assert rg.drop_old_versions(spark, path, keep=1) == 3
    assert len([d for d in os.listdir(path) if d.startswith("version-")]) == 2
    assert names(spark, path) == ["a", "b", "m0", "m1", "m2", "m3"]


def test_json_files_are_parsed_each_for_itself(spark, tmp_path):
    files = {"good": '{"projects": {"k": {"name": "n", "project_path": "/p", "created_at": "2024-01-01T00:00:00+00:00", '
                     '"last_indexed_chunk_count": 7}, "odd": 5, "bare": {}}, "more": [1]}',
             "cut": '{"projects": {"lost": {"name": "lost"', "list": '{"projects": [1]}', "top": "[]", "none": "",
             "null": '{"projects": null}', "other": '{"x": 1}'}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = {r.name: r for r in rg.load_registry_json(spark, str(tmp_path)).collect()}
    assert set(rows) == {"n", "odd", "bare"}
    assert (rows["n"].project_path, rows["n"].last_indexed_chunk_count, str(rows["n"].created_at)) == ("/p", 7, T0)
    assert rows["odd"].project_path is None and rows["bare"].last_indexed_chunk_count == 0
    saved = str(tmp_path / "registry")
    rg.save_registry(rg.load_registry_json(spark, str(tmp_path / "*.json")), saved)
    assert names(spark, saved) == ["bare", "n", "odd"]
