"""A paged REST source as a Spark data source: pages follow the cursor the service returns.

Projection and town filter are pushed to the service. ``fetch`` is any function url -> page; for tests a folder of
page files serves ("file:" option), since a page is just JSON with ``results`` and ``next``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType


def town_query(codes: Sequence[str], field: str = "code_insee_ban") -> str:
    """The service's filter text; no codes is an error, as it would ask for everything."""
    if not codes:
        raise ValueError("at least one town code is needed")
    return " OR ".join(f"{field}:{c}" for c in codes)


def first_url(base: str, codes: Sequence[str], page_size: int = 2000, select: Sequence[str] | None = None) -> str:
    """Address of the first page; no or empty ``select`` asks for all fields."""
    params = {"qs": town_query(codes), "size": page_size}
    if select:
        params["select"] = ",".join(select)
    return f"{base}?{urlencode(params)}"


def pages(fetch: Callable[[str], dict], url: str | None) -> Iterator[dict]:
    """The records of all pages; the last page has no ``next``."""
    while url:
        page = fetch(url)
        yield from page.get("results") or []
        url = page.get("next")


def file_fetch(folder: str) -> Callable[[str], dict]:
    """Pages from a folder: the first is 0.json, ``next`` names the others."""

    def fetch(url: str) -> dict:
        name = url.rsplit("/", 1)[-1] if url.endswith(".json") else "0.json"
        return json.loads(Path(folder, name).read_text(encoding="utf-8"))

    return fetch


class _Town(InputPartition):
    def __init__(self, codes: list[str]):
        self.codes = codes


class PagedReader(DataSourceReader):
    """One partition per group of towns, so pages of different towns are fetched in parallel."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.codes = [c for c in options.get("codes", "").split(",") if c]
        self.field = options.get("field", "code_insee_ban")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.field,):
                self.codes = [f.value]
            elif isinstance(f, In) and f.attribute == (self.field,):
                self.codes = list(f.value)
            yield f  # the service's match is checked again

    def partitions(self):
        town_query(self.codes)
        return [_Town([c]) for c in self.codes]

    def read(self, partition: _Town):
        names = [f.name for f in self.schema.fields]
        url = first_url(self.options.get("base", ""), partition.codes, int(self.options.get("size", 2000)), names)
        fetch = file_fetch(self.options["folder"]) if "folder" in self.options else _http
        for r in pages(fetch, url):
            if str(r.get(self.field)) in partition.codes:
                yield tuple(None if r.get(n) is None else str(r[n]) for n in names)


def _http(url: str) -> dict:
    from urllib.request import urlopen

    with urlopen(url, timeout=300) as answer:
        return json.load(answer)


class PagedSource(DataSource):
    """register(spark); spark.read.format("terroir_pages").schema(...).option("codes", "96007,96048")."""

    @classmethod
    def name(cls) -> str:
        return "terroir_pages"

    def schema(self) -> str:
        return "numero_dpe string, code_insee_ban string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def register(spark) -> None:
    """Makes ``spark.read.format("terroir_pages")`` known, with its filters pushed to the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
