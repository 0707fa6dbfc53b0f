"""Archives (SRC-17, SRC-18): validity and packers of zip files, by their own directory."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cograph.functions import constants as C


def read_archives(spark: SparkSession, path: str, glob: str = "*.apk") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def _state(data: bytes) -> tuple[bool, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = archive.namelist()
            vendors = sorted(C.PACKERS[n] for n in (x.rsplit("/", 1)[-1] for x in names) if n in C.PACKERS)
            packer = vendors[0] if vendors else None if "classes.dex" in names else C.MISSING_DEX
            valid = archive.testzip() is None and "AndroidManifest.xml" in names
            return valid, packer
    except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError):
        return False, None


def inspect(archives: DataFrame) -> DataFrame:
    """path, length, valid, packer; of several packers the first by name. One file is in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_state(x) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "valid": [v for v, _ in found], "packer": [p for _, p in found]})

    return archives.select("path", "length", "content").mapInPandas(run, "path string, length long, valid boolean, packer string")
