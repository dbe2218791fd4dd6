"""A wiki's REST pages (version 2, cursor pages of 100) as a Python data source, with an injectable fetch."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsieve.sources.vault import documents

API = "/wiki/api/v2"
PAGE = "key string, title string, uri string, storage string, labels array<string>, space_id string, status string, author_id string, version string, created_at string"
CONTROLLED = ("controlled", "policy", "standard")


def http_fetch(url: str, headers: dict) -> dict:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers), timeout=60) as r:
        return json.load(r)


class Wiki:
    def __init__(self, base_url: str, email: str, token: str, fetch: Callable[[str, dict], dict] = http_fetch):
        self.base, self.fetch = base_url.rstrip("/"), fetch
        self.missing = [n for n, v in (("base_url", base_url), ("email", email), ("token", token)) if not v]
        self.headers = {"Authorization": "Basic " + base64.b64encode(f"{email}:{token}".encode()).decode(), "Accept": "application/json"}

    def get(self, url: str) -> dict:
        if self.missing:
            raise ValueError(f"not configured: missing {', '.join(self.missing)}")
        return self.fetch(url if url.startswith("http") else self.base + url, self.headers)

    def space_ids(self, keys: list[str]) -> list[str]:
        found = self.get(f"{API}/spaces?{urlencode([('keys', k) for k in keys])}") if keys else {}
        return [str(s["id"]) for s in found.get("results", [])]

    def pages(self, space_ids: list[str]) -> Iterator[tuple]:
        url = f"{API}/pages?{urlencode([('limit', '100'), ('body-format', 'storage'), *(('space-id', i) for i in space_ids)])}"
        while url:
            data = self.get(url)
            for p in data.get("results", []):
                labels = [str(x.get("name", "")).lower() for x in self.get(f"{API}/pages/{p['id']}/labels").get("results", [])]
                version, web = p.get("version") or {}, (p.get("_links") or {}).get("webui")
                text = lambda x: None if x is None else str(x)
                yield (str(p["id"]), p.get("title"), f"{self.base}/wiki{web}" if web else None, ((p.get("body") or {}).get("storage") or {}).get("value") or "", [x for x in labels if x],
                       text(p.get("spaceId")), p.get("status"), p.get("authorId") or version.get("authorId"), text(version.get("number")), version.get("createdAt"))
            url = (data.get("_links") or {}).get("next")


class WikiSource(DataSource):
    """spark.read.format("wiki"): options base_url, email, token, space_keys (comma-separated); a partition for each space."""

    fetch: Callable = staticmethod(http_fetch)

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return WikiReader(dict(self.options), type(self).fetch)


class WikiReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable):
        self.options, self.fetch = options, fetch

    def _wiki(self) -> Wiki:
        return Wiki(self.options.get("base_url", ""), self.options.get("email", ""), self.options.get("token", ""), self.fetch)

    def partitions(self) -> list[InputPartition]:
        ids = self._wiki().space_ids([k for k in self.options.get("space_keys", "").split(",") if k])
        return [InputPartition(i) for i in ids] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._wiki().pages([partition.value] if partition.value else [])


def source_with(fetch: Callable[[str, dict], dict]) -> type[WikiSource]:
    """The data source with another way to fetch, such as recorded answers."""
    return type("RecordedWikiSource", (WikiSource,), {"fetch": staticmethod(fetch)})


class WikiConnector:
    def __init__(self, spark: SparkSession, fetch: Callable = http_fetch, controlled: tuple = CONTROLLED, now_ms: int = 0, **options: str):
        self.spark, self.options, self.fetch, self.controlled, self.now_ms = spark, options, fetch, controlled, now_ms

    def documents(self) -> DataFrame:
        from docsieve.sources.extract import storage_text
        from docsieve.functions.parse import links_of

        if missing := Wiki(*(self.options.get(k, "") for k in ("base_url", "email", "token"))).missing:
            raise ValueError(f"not configured: missing {', '.join(missing)}")
        self.spark.dataSource.register(source_with(self.fetch))
        pages = self.spark.read.format("wiki").options(**self.options).load().withColumn("body", storage_text("storage"))
        held = F.arrays_overlap("labels", F.array(*map(F.lit, self.controlled)))
        meta = F.create_map(F.lit("spaceId"), "space_id", F.lit("status"), "status", F.lit("authorId"), "author_id", F.lit("labels"), F.array_join("labels", ","))
        rows = pages.select("key", "title", "uri", "body", meta.alias("metadata"), F.col("labels").alias("tags"), links_of(F.col("body")).alias("links"), held.alias("controlled"), F.when(held, "controlled").alias("authority"), "version", F.unix_millis(F.try_to_timestamp("created_at")).alias("updated_at"))
        return documents(rows, "confluence", self.now_ms)

    def healthcheck(self) -> dict:
        try:
            Wiki(*(self.options.get(k, "") for k in ("base_url", "email", "token")), self.fetch).get(f"{API}/pages?limit=1")
            return {"ok": True, "detail": f"authenticated to {self.options['base_url']}"}
        except Exception as e:  # noqa: BLE001
            return {"ok": False, "detail": str(e)[:200]}
