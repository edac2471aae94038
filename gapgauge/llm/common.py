"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.session import shared_folder

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def opened(folder: str):
    """File system and path of a folder named by URI or plain path."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and is read several times; a lost executor costs nothing
    that was already written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_unit(*columns: Column) -> Column:
    """A repeatable number in [0, 1) from the values of ``columns``."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def slices(batch: pd.DataFrame, column: str, limit: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Cut a batch into runs of at most ``limit`` characters (one row at least)."""
    sizes = batch[column].str.len().fillna(0).to_numpy(dtype=np.int64)
    if len(batch):
        group = np.cumsum(sizes) // limit
        for begin, end in zip(*runs(group), strict=True):
            yield batch.iloc[begin:end]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of equal neighbours."""
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.r_[0, edge], np.r_[edge, len(values)]


def words_of(text: str | None) -> list[str]:
    """Lower-case words of the whole text; none for NULL."""
    return WORD.findall(text.lower()) if text else []


def hashed(values: Iterable[str]) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    codes, unique = pd.factorize(np.fromiter(values, dtype=object))
    return mixed(pd.util.hash_array(unique, categorize=False).astype(np.uint64))[codes] if len(unique) else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit factors, each of which orders hashes in another way."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the folder can be set by TOKENIZER_DIR."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


CELLS = 8192


def ordered_shards(df: DataFrame, key: str, weight: Column, target: int) -> tuple[Column, int]:
    """Expression that numbers shards along ``key`` (a long), and their count.

    The range of the key is cut into at most CELLS cells, the weights are added
    up for each cell, and cells are joined into shards of about ``target``. Only
    the cell sums come to the driver, so the same rows always give the same
    shards. NULL keys belong to shard 0. A cell heavier than the target is a
    shard of its own.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return F.lit(0), 1
    width = max(1, -(-(high - low + 1) // CELLS))
    cell = F.expr(f"cast((cast({key} as decimal(20,0)) - {low}) div {width} as int)") if high - low >= 1 << 62 else F.expr(f"cast(({key} - {low}) div {width} as int)")
    sums = df.filter(F.col(key).isNotNull()).groupBy(cell.alias("cell")).agg(F.sum(weight).alias("weight"))
    totals = {row["cell"]: int(row["weight"] or 0) for row in sums.toLocalIterator()}
    shard, filled, of_cell = 0, 0, []
    for at in range((high - low) // width + 1):
        size = totals.get(at, 0)
        if filled and filled + size > target:
            shard, filled = shard + 1, 0
        filled += size
        of_cell.append(shard)
    return F.coalesce(F.element_at(F.lit(of_cell), cell + 1), F.lit(0)), shard + 1
