from catlas.operators import reading
from catlas.plans import trees


def tree(folder, rows):
    folder.mkdir(parents=True)
    (folder / "databases.tsv").write_text("\n".join(["connection\tdatabase\tengine\ttables\tviews\tprocedures\tfunctions\tsynonyms\tbuilt", *rows]) + "\n")
    return folder


def test_trees(spark, tmp_path):
    near = tree(tmp_path / "a" / "index", ["stage\tcore\tpostgres\t3\t1\t0\t0\t0\t2026-03-01T00:00:00Z", "stage\told\tpostgres\t2\t0\t0\t0\t0\t2025-11-02T00:00:00Z"])
    far = tree(tmp_path / "index", ["prod\tcore\tpostgres\t1"])
    (tmp_path / "a" / "b").mkdir()
    assert trees.discover(tmp_path / "a" / "b") == near and trees.discover(tmp_path) == far and trees.discover("/proc") is None
    rows = {r["name"]: r for r in trees.inspect(spark, [("near", near, False), ("far", far, True), ("gone", tmp_path / "x", False)], "2026-03-05 00:00:00").collect()}
    assert (rows["near"]["databases"], rows["near"]["objects"], rows["near"]["database"], rows["near"]["age"]) == (2, 6.0, "old", "123 days")
    assert rows["far"]["present"] and rows["far"]["hours"] is None and not rows["gone"]["present"]
    listed = trees.inspect(spark, [("near", near, False), ("far", far, True)], "2026-03-05 00:00:00")
    assert reading.reminder(listed, 24) == "stage/old was last indexed 123 days ago (2025-11-02)"
    lost = trees.inspect(spark, [("gone", tmp_path / "x", True)], "2026-03-05 00:00:00")
    assert reading.reminder(lost, 24) == "the gone index has not been fetched yet"


def test_reading_a_tree(spark, tmp_path):
    home = tree(tmp_path / "index", []) / "stage" / "core"
    (home / "bodies").mkdir(parents=True)
    (home / "bodies" / "dbo.Get.sql").write_text("-- dbo.Get @f\n\nUPDATE dbo.Orders SET a = 1\n")
    (home / "views.tsv").write_text("name\tcols\tmodified\tfingerprint\tdescription\ndbo.V\t2\t\tff\tShows.\n")
    assert [r.asDict() for r in trees.read_catalog(spark, tmp_path / "index", "stage", "core", "view").collect()] == [{"name": "dbo.V", "cols": "2", "modified": "", "fingerprint": "ff", "description": "Shows."}]
    assert trees.read_catalog(spark, tmp_path / "index", "stage", "core", "table").count() == 0
    bodies = trees.read_bodies(spark, tmp_path / "index", "stage", "core")
    assert [r["key"] for r in reading.writers(bodies, "dbo.Orders").collect()] == ["dbo.Get"]
    assert trees.read_bodies(spark, tmp_path / "index", "stage", "none").count() == 0
