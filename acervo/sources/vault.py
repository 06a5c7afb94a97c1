"""A document vault behind a REST interface as a Spark data source, read one class and page a task."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "mfiles_id bigint, mfiles_version int, class_id int, title string, last_modified_utc string, properties map<string,string>"


class _Page(InputPartition):
    def __init__(self, class_id: str):
        self.class_id = class_id


def fetch(url: str, token: str, tries: int = 5, wait: float = 0.5) -> dict:
    """JSON of an address; waits longer after each refusal (429, 5xx) and transport error, gives up after `tries`."""
    for attempt in range(tries):
        try:
            request = urllib.request.Request(url, headers={"X-Authentication": token} if token else {})
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500 or attempt == tries - 1:
                raise
        except urllib.error.URLError:
            if attempt == tries - 1:
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError


def flat_properties(properties: list[dict], names: dict[str, str]) -> dict[str, str]:
    """Shown values by property name, p<id> where the name is not known; empty ones are left out."""
    shown = ((str(p.get("PropertyDef")), (p.get("TypedValue") or {}).get("DisplayValue")) for p in properties or ())
    return {names.get(k, f"p{k}"): v for k, v in shown if v}


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.token = options["url"].rstrip("/"), options.get("token", "")
        self.classes = [c for c in options.get("classes", "").split(",") if c]
        self.limit = int(options.get("limit", 100_000))

    def partitions(self):
        return [_Page(c) for c in self.classes]

    def read(self, partition):
        names = {str(p["ID"]): p["Name"] for p in fetch(f"{self.base}/structure/properties.json", self.token).get("Items", [])}
        answer = fetch(f"{self.base}/objects/{partition.class_id}.json?limit={self.limit}", self.token)
        if answer.get("MoreResults") or len(answer.get("Items", [])) >= self.limit:
            raise RuntimeError(f"class {partition.class_id} has more than {self.limit} documents: raise the limit, none is left out")
        for x in answer.get("Items", []):
            if not x.get("Deleted"):
                yield (x["ID"], x.get("Version"), int(partition.class_id), x.get("Title"), x.get("LastModifiedUtc"), flat_properties(x.get("Properties"), names))


class VaultSource(DataSource):
    """spark.dataSource.register(VaultSource); spark.read.format("vault").option("url", ...).option("classes", "10,11").load()"""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options)
