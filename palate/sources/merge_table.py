"""A keyed table that is written in small pieces: a log of sorted runs, merged by size.

Every write adds a run that holds its own rows alone, so what is written follows the write and not the table. Runs are
merged when the newer ones together come to half of the one before them: the sizes of what stays fall geometrically, a
table of N writes has about log(N) runs, and a row is written again about log(N) times. A run counts once its marker
stands; the marker also tells how far each source has been written, so a write that comes again changes nothing. There
is one writer at a time. Runs that a merge replaced stay until the write after it, for readers that still hold them.

A table of two keys can be written in grids: a run with a row for every pair of some values of the first key and some of
the second. What an older run has in a later grid is told by the grid's sides, so grids are not folded, sorted or shuffled,
neither when they are written nor when they are read or merged; up to FAN of them stay beside each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_committed"
#: Grids of like size that are merged at once.
FAN = 8


def _sides(path: str) -> str:
    """Where the sides of the grid under ``path`` stand: (side, grid, id), ids of key 0 and key 1 by the grid's name."""
    folder, _, name = path.rpartition("/run-")
    return f"{folder}/sides-{name}"


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    path: str
    size: int
    sources: dict[str, int]
    grid: bool = False

    @property
    def sides(self) -> str:
        return _sides(self.path)

    def within(self, other: Run) -> bool:
        return other is not self and other.first <= self.first and self.last <= other.last


class MergeTable:
    """The table under ``path``, one row for each value of ``keys``.

    ``fold`` gives the table's rows from rows of several runs: it gets them with ``__run``, a number that grows with the
    time of writing, and returns them without it. Folding what has been folded must give the same as folding all at once.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.keys, self.fold = spark, path.rstrip("/"), keys, fold

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _all(self) -> list[Run]:
        fs, where = self._fs(self.path)
        out = []
        for status in fs.listStatus(where) if fs.exists(where) else []:
            path, name = status.getPath().toString(), status.getPath().getName()
            fs, marker = self._fs(f"{path}/{MARKER}")
            if name.startswith("run-") and fs.exists(marker):
                stream = fs.open(marker)
                said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
                _, first, last = name.split("-")
                out.append(Run(int(first), int(last), path, said["size"], said["sources"], said.get("grid", False)))
        return sorted(out, key=lambda r: (r.first, -r.last))

    def runs(self) -> list[Run]:
        """The runs that make the table, oldest first."""
        every = self._all()
        return [r for r in every if not any(r.within(x) for x in every)]

    def _put(self, rows: DataFrame, first: int, last: int, sources: dict[str, int], sides: DataFrame | None = None) -> None:
        path = f"{self.path}/run-{first:09d}-{last:09d}"
        rows.write.mode("overwrite").parquet(path)
        if sides is not None:
            sides.write.mode("overwrite").parquet(_sides(path))
        fs, where = self._fs(path)
        said = json.dumps({"size": fs.getContentSummary(where).getLength(), "sources": sources, "grid": sides is not None})
        stream = fs.create(self._fs(f"{path}/{MARKER}")[1], True)
        stream.write(bytearray(said.encode()))
        stream.close()

    def _rows(self, runs: list[Run]) -> list[DataFrame]:
        """The rows of each run that stand in no later grid."""
        out = []
        for i, run in enumerate(runs):
            rows = self.spark.read.parquet(run.path)
            columns, later = rows.columns, [r for r in runs[i + 1 :] if r.grid]
            if later:
                sides = self._all_sides(later)
                for k, key in enumerate(self.keys):
                    own = sides.where(F.col("side") == k).groupBy(F.col("id").alias(key)).agg(F.collect_set("grid").alias(f"__{k}"))
                    rows = rows.join(own, key, "left")
                rows = rows.where(~F.coalesce(F.arrays_overlap("__0", "__1"), F.lit(False))).select(*columns)
            out.append(rows)
        return out

    def _all_sides(self, runs: list[Run]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(r.sides) for r in runs]).distinct()

    def write(self, rows: DataFrame, source: str = "", number: int | None = None, grid: tuple[DataFrame, DataFrame] | None = None) -> bool:
        """Add ``rows``. With ``number``, writes of one ``source`` are numbered upwards, and one that has been made already
        is left out; False then. ``grid`` has the values of the first and of the second key, one column each, where
        ``rows`` are all pairs of them, each once; the fold must be one that keeps what is written last."""
        every = self._all()
        runs = [r for r in every if not any(r.within(x) for x in every)]
        if number is not None and any(r.sources.get(source, -1) >= number for r in runs):
            return False
        for r in every:
            if any(r.within(x) for x in runs):
                for path in (r.path, r.sides):
                    fs, where = self._fs(path)
                    fs.delete(where, True)
        at = max((r.last for r in runs), default=-1) + 1
        sources = {} if number is None else {source: number}
        if grid is None:
            self._put(self.fold(rows.withColumn("__run", F.lit(at).cast("long"))), at, at, sources)
        else:
            self._put(rows, at, at, sources, self._named(*grid))
        self.compact()
        return True

    def _named(self, *grid: DataFrame) -> DataFrame:
        """The sides of a grid. Its name is a fingerprint of the first key's values, so that grids over the same ones, as
        batches for the same users are, are one grid when their sides are put together."""
        ids = [df.toDF("id") for df in grid]
        seeds = [F.bit_xor(F.xxhash64("id", F.lit(seed))) for seed in (1, 2)]
        name = F.lit("-".join(map(str, ids[0].agg(F.count("*"), *seeds).first())))
        return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("side"), name.alias("grid"), "id") for k, df in enumerate(ids)])

    def compact(self) -> None:
        """Merge the newest runs for as long as they come to half of the run before them."""
        runs = self.runs()
        start, total = len(runs) - 1, runs[-1].size if runs else 0
        while start > 0 and runs[start - 1].size <= 2 * total:
            start -= 1
            total += runs[start].size
        some = runs[start:]
        grids = all(r.grid for r in some[1:])
        if len(some) > 1 and not (grids and len(some) < FAN):
            sources: dict[str, int] = {}
            for r in some:
                sources |= {k: max(v, sources.get(k, -1)) for k, v in r.sources.items()}
            rows = reduce(DataFrame.unionByName, self._rows(some)) if grids else self.fold(self._numbered(some))
            self._put(rows, some[0].first, some[-1].last, sources, self._all_sides(some) if grids and some[0].grid else None)

    def _numbered(self, runs: list[Run]) -> DataFrame:
        some = [rows.withColumn("__run", F.lit(r.last).cast("long")) for r, rows in zip(runs, self._rows(runs), strict=True)]
        return reduce(DataFrame.unionByName, some)

    def read(self, only: DataFrame | None = None) -> DataFrame | None:
        """The table's rows, or those whose keys stand in ``only``; None before the first write. Rows of the oldest run
        that no later run touches are not folded, and not shuffled where the later keys are few enough to be sent to
        the tasks."""
        runs = self.runs()
        if not runs:
            return None
        some = lambda df: df if only is None else df.join(only.select(*self.keys).distinct(), self.keys, "left_semi")
        parts = self._rows(runs)
        if all(r.grid for r in runs[1:]):
            return reduce(DataFrame.unionByName, map(some, parts))
        base, later = some(parts[0]), some(self._numbered(runs[1:]))
        touched = later.select(*self.keys).distinct()
        old = base.join(touched, self.keys, "left_semi").withColumn("__run", F.lit(runs[0].last).cast("long"))
        folded = self.fold(old.unionByName(later))
        return base.join(touched, self.keys, "left_anti").unionByName(folded.select(*base.columns))


def newest(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """A fold: of each key the row written last; of rows of one write the one that is largest by ``order``."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "__run")]
        last = F.max_by(F.struct(*rest), F.struct("__run", order, *(c for c in rest if c != order)))
        return rows.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")

    return fold
