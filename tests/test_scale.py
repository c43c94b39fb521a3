"""Parts of a build that run on the executors: the tree, the samples, the describing, batches, the store, signals, mentions."""

import hashlib
import json
import os
import random
import re
import shutil
import sys
import threading
import time

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_build import Fake, options, teller

from catlas.app import cache
from catlas.operators import describing, fetching, health, reading, structure
from catlas.plans import build as B
from catlas.sources import tree
from catlas.sources.tables import Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get what is defined here by value


def files(spark, rows):
    return spark.createDataFrame(rows, tree.FILES)


# The tree


def test_tree_is_written_by_tasks(spark, tmp_path):
    rows = [(["bodies", f"a.b{k}.sql"], 0, f"text {k}\r\né\n") for k in range(2000)]
    rows += [(["t.tsv"], k, f"line {k}\n") for k in (3, 1, 2)] + [(["odd", "../x/%\n"], 0, ""), (["gone"], 0, None), (["never", "there"], 0, None)]
    (tmp_path / "gone").write_text("old")
    (tmp_path / "t.tsv").write_text("old")
    tree.write(files(spark, rows).repartition(7), tmp_path)
    assert (tmp_path / "t.tsv").read_text() == "line 1\nline 2\nline 3\n"
    assert all((tmp_path / "bodies" / f"a.b{k}.sql").read_bytes() == f"text {k}\r\né\n".encode() for k in range(2000))
    assert sorted(os.listdir(tmp_path)) == ["bodies", "odd", "t.tsv"] and os.listdir(tmp_path / "odd") == ["%2E.%2Fx%2F%25%0A"]


def test_tasks_put_files_in_place_and_read_them_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "A_TASK", 100)
    root, listed = tmp_path / "a [b]{c,d} *", str(tmp_path / "listed")
    rows = [(["bodies", f"b{k}.sql"], 0, f"text {k} é\n") for k in range(1000)] + [(["t.tsv"], k, f"line {k}\n") for k in (3, 1, 2)] + [(["bodies", "gone.sql"], 0, None)]
    tree.write(files(spark, rows).repartition(5), root, listed)
    there = {str(p.relative_to(root)): hashlib.md5(p.read_bytes()).hexdigest() for p in root.rglob("*") if p.is_file()}
    got = tree.digests(spark, root, listed)
    assert len(there) == 1001 and dict(got.collect()) == there and got.count() == 1001
    tasks = spark.read.parquet(listed).groupBy(F.input_file_name()).count().collect()
    assert len(tasks) >= 9 and max(r["count"] for r in tasks) < 200  # not the driver, nor one task


def test_putting_in_place_again_ends_with_the_same_files(tmp_path):
    work, root = tmp_path / "work", tmp_path / "root"
    (work / "w").mkdir(parents=True)
    root.mkdir()
    for k, text in enumerate(["new", "one", "two", "first", "last"]):
        (work / "w" / str(k)).write_text(text)
    for name in ("old", "goes"):
        (root / name).write_text("old")
    rows = pd.DataFrame([("goes", 0, 0, 9, None), ("old", 0, 0, 0, "w"), ("pieces", 2, 0, 2, "w"), ("pieces", 1, 1, 1, "w"), ("sub/twice", 0, 0, 3, "w"), ("sub/twice", 0, 0, 4, "w")], columns=["target", "part", "task", "row", "own"])
    place = tree._placing(str(root), str(work))
    for _ in range(2):  # as when a task is lost at its end and tried again; the frames cut a file's rows apart
        out = pd.concat(place(iter([rows[:3], rows[3:]])))
        assert list(out["target"]) == ["old", "pieces", "sub/twice"]
        assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == {"old": "new", "pieces": "onetwo", "sub/twice": "last"}
    with pytest.raises(FileNotFoundError):
        list(place(iter([pd.DataFrame([("lost", 0, 0, 7, "w")], columns=rows.columns)])))


def test_a_failed_task_leaves_the_old_tree_whole(spark, tmp_path):
    tree.write(files(spark, [(["a"], 0, "old"), (["b"], 0, "old")]), tmp_path)
    rows = files(spark, [(["a"], 0, "new"), (["c"], 0, "new"), (["b"], 0, None)]).repartition(3)
    broken = rows.withColumn("text", F.when(F.col("path")[0] == "c", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        tree.write(broken, tmp_path)
    assert {p: (tmp_path / p).read_text() for p in os.listdir(tmp_path)} == {"a": "old", "b": "old"}


def test_names_stay_below_the_tree(spark, tmp_path):
    s = B.build(spark, Fake(spark), teller([]), options(tmp_path, connection="..", database="../../x"))
    assert s.described == 4 and sorted(os.listdir(tmp_path)) == ["tree"]
    assert (tmp_path / "tree" / "%2E." / "%2E.%2F..%2Fx" / "tables.tsv").exists()
    assert ".." not in B.store_path(spark, options(tmp_path, connection="..", database=".."))[len(str(tmp_path)) :]
    again = B.build(spark, Fake(spark), teller([]), options(tmp_path, connection="..", database="../../x"))
    assert (again.refetch, again.described, again.unchanged) == (0, 0, 4)


def test_trees_lie_in_mounted_folders(tmp_path):
    assert tree.local_path(f"file://{tmp_path}") == tree.local_path(tmp_path) == str(tmp_path)
    for root in ("hdfs://host/x", "s3a://bucket/x", "file://elsewhere/x"):
        with pytest.raises(ValueError, match="mounted"):
            tree.local_path(root)


# Batches


def plain_batches(costs, max_bytes, max_objects):
    out, batch, spent, held = [], 0, 0, 0
    for cost in costs:
        if held and (spent + cost > max_bytes or held >= max_objects):
            batch, spent, held = batch + 1, 0, 0
        spent, held = spent + cost, held + 1
        out.append(batch)
    return out


@pytest.mark.parametrize(("n", "chunk", "most"), [(0, 16, 12), (1, 16, 12), (15, 16, 4), (700, 16, 12), (333, 12, 12), (64, 16, 1)])
def test_batches_equal_the_sequential_rule(spark, n, chunk, most):
    rng = random.Random(n + chunk)
    costs = [rng.choice([0, 1, 5, 30, 99, 100, 101, 250]) for _ in range(n)]
    rows = [(i, f"k{i}", c) for i, c in enumerate(costs)]
    rng.shuffle(rows)
    items = spark.createDataFrame(rows, "ord long, key string, cost long")
    got = describing.batches(items, 100, most, chunk=chunk)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 2 and "repartition(1" not in plan  # one row per range is all that one task sums
    assert [r["batch"] for r in sorted(got.collect(), key=lambda r: r["ord"])] == plain_batches(costs, 100, most)


# The store


def test_damaged_entries_are_read_anew(spark, tmp_path):
    store = tmp_path / "store"
    args = dict(store=str(store))
    B.build(spark, Fake(spark), teller([]), options(tmp_path, **args))
    kept = fetching.Store(spark, str(store / "stage" / "core"))
    whole = sorted(kept.read().drop("counts").collect())
    folder = store / "stage" / "core" / "pull-00000001"
    part = max(folder.glob("part-*.parquet"), key=lambda p: p.stat().st_size)
    part.write_bytes(b"not parquet at all")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    left = kept.read().count()
    assert left < len(whole)
    s = B.build(spark, Fake(spark), teller([]), options(tmp_path, **args))
    assert (s.read, s.reused) == (len(whole) - left, left) and s.refetch == 0
    assert sorted(kept.read().drop("counts").collect()) == whole


def test_an_entry_under_anothers_key_is_none(spark, tmp_path):
    kept = fetching.Store(spark, str(tmp_path / "s"))
    B.build(spark, Fake(spark), teller([]), options(tmp_path, store=str(tmp_path / "b")))
    entries = fetching.Store(spark, str(tmp_path / "b" / "stage" / "core")).read().withColumnRenamed("signal", "modified")
    kept.add(entries)
    assert kept.read().count() == 5
    rows = spark.read.parquet(str(tmp_path / "s" / "pull-00000001"))
    forged = rows.withColumn("pull", F.lit(2).cast("bigint")).withColumn("key", F.when(F.col("key") == "dbo.Orders", F.lit("dbo.OrderStatuses")).otherwise(F.col("key")))
    forged = forged.withColumn("signal", F.when(F.col("key") == "dbo.OrderGet", F.lit("later")).otherwise(F.col("signal")))
    forged.write.parquet(str(tmp_path / "s" / "pull-00000002"))
    got = {r["key"]: r for r in kept.read().collect()}
    assert len(got) == 5 and got["dbo.OrderGet"]["signal"] == "2024-01-01" and [c["name"] for c in got["dbo.OrderStatuses"]["structure"]["columns"]] == ["StatusID", "Label"]
    shutil.rmtree(tmp_path / "s" / "pull-00000002")
    assert kept.read().count() == 5


# Structures


def test_folds_gather_values_made_before_the_shuffle(spark):
    columns = spark.createDataFrame([("k", 2, "b", "int", "", False, False, True), ("k", 1, "a", "int", "", True, True, False), ("j", 1, None, "int", "", True, False, False)], "key string, ord long, name string, type string, length string, nullable boolean, identity boolean, computed boolean")
    folded = structure.fold_columns(columns)
    assert {r["key"]: [c["name"] for c in r["columns"]] for r in folded.collect()} == {"k": ["a", "b"], "j": [None]} and folded.schema["columns"].dataType.elementType.names == columns.columns[2:]
    indexes = spark.createDataFrame([("k", 1, "i", True, True, "c")], "key string, ord long, index string, primary boolean, unique boolean, column string")
    for rows in (folded, structure.fold_indexes(indexes)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(row" in plan and "collect_list(struct" not in plan and "collect_list(named_struct" not in plan


# Samples


class Many(Fake):
    """Twelve tables whose samples take a while."""

    def __init__(self, spark, wait=0.4, broken=(), sick_after=99):
        super().__init__(spark)
        self.wait, self.broken, self.sick_after, self.open, self.most, self.turn = wait, broken, sick_after, 0, 0, threading.Lock()

    def manifest(self):
        rows = [("dbo", f"T{k:02d}", "table", 10 + k, 8, 0, "1") for k in range(12)]
        return self._df(rows, B.Source.__annotations__.get("x", "schema string, name string, kind string, rows bigint, kb bigint, triggers int, modified string")).withColumn("key", F.concat_ws(".", "schema", "name"))

    def columns(self):
        return self._df([(f"dbo.T{k:02d}", 0, "Label", "int", "", False, False, False) for k in range(12)], "key string, ord long, name string, type string, length string, nullable boolean, identity boolean, computed boolean")

    def health(self):
        return self._df([(False, 0.0, "primary", False, 99 if len(self.sampled) > self.sick_after else 0)], health.READING)

    def sample(self, key, columns, n):
        with self.turn:
            self.open += 1
            self.most = max(self.most, self.open)
        self.sampled.append(key)
        try:
            time.sleep(self.wait)
            if key in self.broken:
                raise RuntimeError("gone")
            return [[key]]
        finally:
            with self.turn:
                self.open -= 1


def todo(spark, source):
    rows = [(r["key"], "table", r["rows"]) for r in source.manifest().collect()]
    cols = source.columns().groupBy("key").agg(F.collect_list(F.struct(*[c for c in source.columns().columns if c not in ("key", "ord")])).alias("columns"))
    return spark.createDataFrame(rows, "key string, kind string, rows long").join(cols, "key").withColumn("structure", F.struct("columns"))


def test_samples_are_taken_side_by_side(spark, tmp_path):
    source = Many(spark, broken=("dbo.T03",))
    began = time.time()
    got = B.take_samples(source, todo(spark, source), options(tmp_path))
    assert list(got) == [f"dbo.T{k:02d}" for k in range(12) if k != 3] and source.most == 4
    assert source.sampled == [f"dbo.T{k:02d}" for k in range(12)]
    assert "dbo.T05" in got["dbo.T05"] and time.time() - began < 60


def test_a_sick_source_is_not_asked_further(spark, tmp_path):
    source = Many(spark, wait=0.1, broken=("dbo.T04",), sick_after=3)
    with pytest.raises(health.Unhealthy):
        B.take_samples(source, todo(spark, source), options(tmp_path))
    assert 5 <= len(source.sampled) <= 10  # those under way when it turned sick, none after


# Describing


def test_describing_on_executors_pays_once(spark, tmp_path):
    log = tmp_path / "calls"

    def tell(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        keys = re.findall(r"=== OBJECT \d+: (\S+) ===", prompt)
        return {"reply": json.dumps({"objects": [{"name": k, "sentence": f"Describes {k}."} for k in keys]}), "tokens": 7}

    args = dict(answers=str(tmp_path / "answers"))
    s = B.build(spark, Fake(spark), tell, options(tmp_path, **args))
    assert (s.described, s.missing, s.failed, s.usage) == (4, [], [], {"tokens": 7.0}) and log.read_text() == "x\n"
    forced = B.build(spark, Fake(spark), tell, options(tmp_path, force=True, **args))
    assert (forced.described, forced.usage) == (4, {}) and log.read_text() == "x\n"
    assert len(os.listdir(tmp_path / "answers")) == 1


def test_a_task_killed_after_its_reply_makes_no_second_call(spark, tmp_path):
    log, mark = tmp_path / "calls", tmp_path / "mark"
    prompts = spark.createDataFrame([(k, f"question {k}") for k in range(6)], "batch long, prompt string")

    def tell(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt.endswith("4"):
            raise RuntimeError("no answer")
        if prompt.endswith("5"):
            return {"reply": "not json"}
        return {"reply": "{}", "tokens": 1}

    told = {r["batch"]: r for r in describing.ask(prompts, tell, str(tmp_path / "a"), 3).collect()}
    assert [told[k]["reply"] for k in range(6)] == ["{}"] * 4 + [None] * 2 and "no answer" in told[4]["error"] and told[5]["error"]
    # What a task had paid for before it died is in the folder: the next attempt takes it from there.
    again = {r["batch"]: r for r in describing.ask(prompts.filter("batch < 4"), tell, str(tmp_path / "a"), 2).collect()}
    assert [again[k]["reply"] for k in range(4)] == ["{}"] * 4 and all(not again[k]["usage"] for k in range(4))
    assert sorted(log.read_text().split("\n")[:-1]) == [f"question {k}" for k in range(6)] and not mark.exists()
    place, key = cache._place(tmp_path / "a", "question 1")
    place.write_text(place.read_text()[:-5])
    assert cache.kept_answer(tmp_path / "a", "question 1") is None and key


# Folders of Parquet


def test_unchanged_folders_are_not_read_again(spark, tmp_path):
    root = tmp_path / "data"
    spark.range(5).toDF("id").write.parquet(str(root / "a.parquet"))
    spark.range(7).toDF("id").repartition(3).write.parquet(str(root / "b.parquet"))
    spark.range(0).toDF("id").write.parquet(str(root / "none.parquet"))
    make = lambda: Tables(spark, str(root), views={"v": "SELECT id FROM a"})
    first = make()
    assert first.counts() == {"a": 5, "b": 7, "none": 0}
    B.build(spark, first, teller([]), options(tmp_path))
    quiet = make()
    for part in ("columns", "sample", "modules"):
        setattr(quiet, part, lambda *_, part=part: pytest.fail(f"asked for {part}"))
    s = B.build(spark, quiet, teller([]), options(tmp_path))
    assert (s.read, s.reused, s.refetch) == (0, 4, 0)
    spark.range(9).toDF("id").write.mode("append").parquet(str(root / "b.parquet"))
    moved = B.build(spark, make(), teller([]), options(tmp_path))
    assert (moved.read, moved.reused) == (2, 2)  # the table and the view, which may read it


# Mentions


def test_mentions_of_all_keys_equal_each_keys_scan(spark):
    texts = {
        "x.1": "insert into app.Items values (1); select * from app.items2\nUPDATE\nMyapp.items", "x.2": "delete from [app].[items]; app.it", "x.3": "merge " + "y" * 50 + " app.items",
        "x.4": "update app.İtems set a = 1 -- app.order lines\nselect 1; app.order linesmen", "x.5": "", "x.6": "INSERT INTO core.app.items; -- é.ü\ninsert é.Ü", "x.7": "select a.b from straße.haus\nupdate STRASSE.HAUS", "x.8": "app..items update app..Items",
    }
    keys = ["app.items", "app.it", "app.order lines", "app.]items", "é.ü", "core.app.items", "straße.haus", "p.items", "app..items", "absent.one", "app.items"]
    bodies = spark.createDataFrame(list(texts.items()), "key string, text string")
    asked = spark.createDataFrame([(k,) for k in [*keys, ".-"]], "key string")
    for every, one in ((reading.all_mentions, reading.mentions), (reading.all_writers, reading.writers)):
        want = sorted((k, r["key"]) for k in set(keys) for r in one(bodies, k).collect())
        assert want and sorted(tuple(r) for r in every(bodies, asked).select("key", "body").collect()) == want
    assert reading.all_mentions(bodies, asked.limit(0)).count() == 0 and reading.all_writers(bodies.limit(0), asked).count() == 0
