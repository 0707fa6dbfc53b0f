"""From keys to slice files (SRC-17..20, JOIN-6, INC-1, SNK-15): what is missing is fetched, checked and sliced.

Fetching and decoding are interfaces; one archive is in memory at a time, and what fails becomes a row that says where.
"""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from cograph.operators.joins import not_done
from cograph.sources.archives import _state


class Fetcher(Protocol):
    def fetch(self, key: str) -> bytes: ...


class Decoder(Protocol):
    def slices(self, key: str, data: bytes) -> str: ...


class HttpFetcher:
    """Archives over HTTP, read in chunks; `key` and what else the service wants go into the query.

    What is not a complete archive counts as a failed try, as services answer errors with pages of their own.
    """

    def __init__(self, address: str, parameters: dict[str, str] | None = None, name: str = "sha256", timeout: float = 300, chunk: int = 1 << 16, most: int = 1 << 30):
        self.address, self.parameters, self.name, self.timeout, self.chunk, self.most = address, parameters or {}, name, timeout, chunk, most

    def fetch(self, key: str) -> bytes:
        query = urllib.parse.urlencode({**self.parameters, self.name: key})
        out = bytearray()
        with urllib.request.urlopen(f"{self.address}?{query}", timeout=self.timeout) as answer:
            while piece := answer.read(self.chunk):
                out += piece
                if len(out) > self.most:
                    raise ValueError(f"more than {self.most} bytes")
        if not _state(bytes(out))[0]:
            raise OSError("not a complete archive")
        return bytes(out)


def or_extracted(work: DataFrame, files: DataFrame, fetcher: Fetcher, decoder: Decoder, key: str = "sha256", **options) -> tuple[DataFrame, DataFrame]:
    """(key and content of every app of the work list that has one, the outcomes of the others): files first, else on demand."""
    have = work.select(key).join(files.select(key, "content"), key)
    fresh = extract(work, files, fetcher, decoder, key=key, **options)
    return have.unionByName(fresh.filter("outcome = 'ok'").select(key, "content")), fresh.filter("outcome <> 'ok'")


def _fetched(fetcher: Fetcher, key: str, tries: int, wait: float) -> bytes:
    for left in range(tries - 1, -1, -1):
        try:
            return fetcher.fetch(key)
        except OSError:
            if not left:
                raise
            time.sleep(wait)
    raise OSError("no try was allowed")


def extract(work: DataFrame, done: DataFrame, fetcher: Fetcher, decoder: Decoder, tries: int = 3, wait: float = 0.0, key: str = "sha256") -> DataFrame:
    """key, outcome (ok, download, invalid, packed, slicer), content, detail, seconds for each key that is not done."""

    def one(name: str) -> tuple[str, str | None, str | None]:
        try:
            data = _fetched(fetcher, name, tries, wait)
        except Exception as error:
            return "download", None, str(error)
        valid, packer = _state(data)
        if not valid:
            return "invalid", None, "not a complete archive"
        if packer:
            return "packed", None, packer
        try:
            return "ok", decoder.slices(name, data), None
        except Exception as error:
            return "slicer", None, str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch[key]:
                began = time.time()
                outcome, content, detail = one(name)
                yield pd.DataFrame({key: [name], "outcome": [outcome], "content": [content], "detail": [detail], "seconds": [time.time() - began]})

    return not_done(work, done, key).select(key).mapInPandas(run, f"{key} string, outcome string, content string, detail string, seconds double")
