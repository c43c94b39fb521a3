"""A tree of text files written by tasks in two phases: all of it is there, or none of it.

Tasks write files into a folder of their own inside the tree and list them in a
table there. Only when all of them are done do other tasks move the files to
their places, each at once, and remove the files that go; if a task fails for
good before that, the folder goes and the tree is as it was. No file and no name
of one passes through the driver.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from itertools import batched, count, groupby
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: path: its segments; part: 0 for a whole file, from 1 on for pieces that are joined in order; text: null if the file goes.
FILES = "path array<string>, part bigint, text string"
#: target: path below the tree; task and row: where the file stood in FILES; own: the folder of the attempt that wrote it as `row`, null if the file goes.
WROTE = "target string, part bigint, task int, row bigint, own string"
#: Hidden folders of writers at work.
AT_WORK = ".parts-"
#: Files that one task puts in place or reads.
A_TASK = 10_000


def segment(name: str) -> str:
    """A name as one path segment: separators, control characters, the escape itself and a leading dot as %XX."""
    out = re.sub(r"[/\\%\x00-\x1f]|^\.", lambda m: f"%{ord(m[0]):02X}", name)
    return out or "%00"


def _putting(work: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """FILES, text as bytes, to WROTE: every text becomes a file in a folder of the attempt's own."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, own, row = TaskContext.get().partitionId(), uuid.uuid4().hex, count()  # another folder when the task is tried again
        os.makedirs(f"{work}/{own}")
        for frame in frames:
            out = []
            for path, part, text, n in zip(frame["path"], frame["part"], frame["text"], row):
                if text is not None:
                    with open(f"{work}/{own}/{n}", "wb") as f:
                        f.write(text)
                out.append(("/".join(map(segment, path)), part, task, n, own if text is not None else None))
            yield pd.DataFrame(out, columns=["target", "part", "task", "row", "own"])

    return put


def _placing(root: str, work: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """WROTE, sorted by target, task and row, to the targets that are now there. A task that is tried again ends with the same files."""
    written = lambda r: f"{work}/{r.own}/{r.row}"

    def move(file: str, target: str) -> None:
        """By a link where nothing is to be replaced: renames into one folder wait for each other, and for those into any other."""
        try:
            os.link(file, target)
            os.unlink(file)
        except FileNotFoundError:  # an earlier attempt has moved it
            if not os.path.exists(target):
                raise
        except OSError:  # an old file is there, or no links are to be had
            os.replace(file, target)

    def put_in_place(target: str, rows: list) -> bool:
        """Pieces are joined; without any, the last row tells."""
        pieces = sorted((r for r in rows if r.own is not None and r.part), key=lambda r: r.part)
        if pieces:
            joined = f"{work}/{pieces[0].own}/{uuid.uuid4().hex}"
            with open(joined, "wb") as out:
                for r in pieces:
                    with open(written(r), "rb") as f:
                        shutil.copyfileobj(f, out)
            move(joined, target)
        elif rows[-1].own is not None:
            move(written(rows[-1]), target)
        else:
            Path(target).unlink(missing_ok=True)
        return bool(pieces) or rows[-1].own is not None

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folders = set()

        def there() -> Iterator[str]:
            for target, group in groupby((r for frame in frames for r in frame.itertuples(index=False)), key=lambda r: r.target):
                rows, full = list(group), os.path.join(root, target)
                if (folder := os.path.dirname(full)) not in folders and any(r.own is not None for r in rows):
                    os.makedirs(folder, exist_ok=True)
                    folders.add(folder)
                if put_in_place(full, rows):
                    yield target

        for targets in batched(there(), A_TASK):
            yield pd.DataFrame({"target": targets})

    return place


def _digesting(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def md5(target: str) -> str:
        sum_ = hashlib.md5()
        with open(f"{root}/{target}", "rb", buffering=0) as f:
            while piece := f.read(1 << 16):
                sum_.update(piece)
        return sum_.hexdigest()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["target"], "file_md5": [md5(t) for t in frame["target"]]})

    return digest


def _dealt(rows: DataFrame) -> DataFrame:
    """All rows of a target in one task, of about A_TASK rows: so short that Spark, going by bytes, would make few tasks."""
    return rows.repartition(max(1, math.ceil(rows.count() / A_TASK)), "target")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder by its very name, which may have signs of patterns in it."""
    return spark.read.schema(schema).parquet(re.sub(r"([\\{}\[\]*?])", r"\\\1", path))


def local_path(root: str | Path) -> str:
    """`root` as a path of this machine's file system; a tree isn't written to a store that only Spark reads."""
    parts = urlsplit(str(root))
    if parts.scheme not in ("", "file") or parts.netloc not in ("", "localhost"):
        raise ValueError(f"a tree needs a folder that driver and executors have mounted, not {root}")
    return os.path.abspath(parts.path if parts.scheme else str(root))


def write(files: DataFrame, root: str | Path, listed: str | None = None) -> None:
    """Bring the files of `files` (FILES) below `root`, a folder that driver and executors share.

    `listed`: a new folder for the table of the files now there, as `digests` takes it.
    """
    spark, root = files.sparkSession, local_path(root)
    work = os.path.join(root, AT_WORK + uuid.uuid4().hex)
    try:
        rows = files.select("path", "part", F.col("text").cast("binary").alias("text"))
        rows.mapInPandas(_putting(work), WROTE).write.parquet(f"file://{work}/wrote")
        wrote = _dealt(_table(spark, f"file://{work}/wrote", WROTE)).sortWithinPartitions("target", "task", "row")
        placed = wrote.mapInPandas(_placing(root, work), "target string").write
        placed.parquet(listed) if listed else placed.format("noop").mode("overwrite").save()
    finally:
        shutil.rmtree(work, ignore_errors=True)


def digests(spark: SparkSession, root: str | Path, listed: str) -> DataFrame:
    """(path below the tree, file_md5) of every file that `write` has listed, read from the tree by tasks."""
    return _dealt(_table(spark, listed, "target string")).mapInPandas(_digesting(local_path(root)), "path string, file_md5 string")
