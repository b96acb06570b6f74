"""A paged feature service as a data source: object ids are dealt to partitions, each task asks for its pages and tries again.

``spark.dataSource.register(PagedFeatures)`` and then ``spark.read.format("paged_features").schema(...)``. Options: url,
where, page (ids a request), ids (comma-separated; asked for if not given), attempts, pause.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Statuses worth another try.
RETRY = {429, 500, 502, 503, 504}


def ask(url: str, query: dict, attempts: int = 5, pause: float = 1.0, opener: Callable = urllib.request.urlopen) -> dict:
    """The service's JSON answer; a passing failure is tried again after a pause that doubles, any other raises."""
    full = f"{url}?{urllib.parse.urlencode({'f': 'json', **query})}"
    for n in range(attempts):
        try:
            with opener(full, timeout=60) as answer:
                got = json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or n + 1 == attempts:
                raise
        except (urllib.error.URLError, TimeoutError):
            if n + 1 == attempts:
                raise
        else:
            if "error" not in got:
                return got
            if got["error"].get("code") not in RETRY or n + 1 == attempts:
                raise RuntimeError(f"{url}: {got['error']}")
        time.sleep(pause * 2**n)
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, ids: list[int]):
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.o = schema, dict(options)

    def _ask(self, query: dict) -> dict:
        return ask(self.o["url"], query, int(self.o.get("attempts", 5)), float(self.o.get("pause", 1.0)))

    def partitions(self) -> list[_Page]:
        if self.o.get("ids"):
            ids = [int(x) for x in self.o["ids"].split(",")]
        else:
            ids = self._ask({"where": self.o.get("where", "1=1"), "returnIdsOnly": "true"}).get("objectIds") or []
        ids, n = sorted(set(ids)), int(self.o.get("page", 500))
        return [_Page(ids[k : k + n]) for k in range(0, len(ids), n)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        got = self._ask({"objectIds": ",".join(map(str, partition.ids)), "outFields": "*", "returnGeometry": "true"})
        for f in got.get("features", []):
            row = {k.lower(): v for k, v in {**f.get("attributes", {}), **{k: v for k, v in (f.get("geometry") or {}).items() if k in ("x", "y")}}.items()}
            row["geometry"] = json.dumps(f.get("geometry"))
            yield tuple(row.get(c.name.lower()) for c in self.schema)


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "objectid long, geometry string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_config(path: str) -> dict:
    """A configuration file: JSON, or YAML where a parser for it is installed."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("no YAML parser is installed; give the configuration as JSON") from e
    return yaml.safe_load(text)
