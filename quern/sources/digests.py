"""Digests of files by blocks: blocks are hashed where there is room, and a file's digest is the hash of its blocks' hashes in order.

It means the same at any size, costs no task more than a block, and is not the hash of the whole contents. The function goes to Python
workers by value, so the package need not be installed there; workers open files through the store of their path.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block; a digest depends on it.
BLOCK = 64 << 20
#: Bytes that a worker holds at once.
PIECE = 4 << 20


def opened(path: str):
    """A file by the path that Spark gives, which isn't encoded as a URI."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    authority, _, place = rest.removeprefix("//").partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store.open_input_file(f"{base.rstrip('/')}/{place}")


def hashed_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for batch in batches:
        out = []
        for path, at, size in zip(batch["path"], batch["at"], batch["size"]):
            start, end, h = at, min(at + BLOCK, size), hashlib.sha256()
            with opened(path) as f:
                f.seek(int(start))
                while start < end:
                    got = f.read(int(min(PIECE, end - start)))
                    if not got:
                        raise OSError(f"{path} has become shorter")
                    h.update(got)
                    start += len(got)
            out.append(h.digest())
        yield batch[["path", "at"]].assign(digest=out)


def digested(files: DataFrame) -> DataFrame:
    """`files` (path, size, ...) with `etag`. A block is a row, dealt out at random, so a large file is no task's alone; its hashes are 32 bytes a block."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = files.sparkSession
    last = F.greatest((F.col("size") - 1).cast("long"), F.lit(0))
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(BLOCK).cast("long"))).alias("at"), "size")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.repartition(tasks, F.xxhash64("path", "at"))
    hashes = dealt.mapInPandas(hashed_blocks, "path string, at long, digest binary")
    ordered = F.array_sort(F.collect_list(F.struct("at", "digest")))
    etags = hashes.groupBy("path").agg(F.sha2(F.aggregate(ordered, F.lit(b"").cast("binary"), lambda all_, b: F.concat(all_, b["digest"])), 256).alias("etag"))
    return files.join(etags, "path")
