"""A paged source of change-sets: one page of a directory of JSON pages to a partition.

Pages stand in files page-<n>.json, each {"items": [...], "next": n or null}. Reading follows the numbers on disk; a page that
leads back to one already read is an error, as with a remote source whose cursor runs in a circle.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "provider string, repository string, number int, title string, state string"


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Page]:
        names = {int(m[1]): n for n in os.listdir(self.folder) if (m := re.fullmatch(r"page-(\d+)\.json", n))}
        order: list[int] = []
        at = min(names, default=None)
        while at is not None:
            if at in order:
                raise ValueError(f"page {at} comes twice")
            order.append(at)
            with open(os.path.join(self.folder, names[at])) as f:
                at = json.load(f).get("next")
        return [Page(os.path.join(self.folder, names[k])) for k in order]

    def read(self, partition: Page) -> Iterator[tuple]:
        with open(partition.path) as f:
            for x in json.load(f)["items"]:
                yield x.get("provider"), x.get("repository"), x.get("number"), x.get("title"), x.get("state")


class ChangeSetPages(DataSource):
    """spark.read.format("change_set_pages").load(folder), after spark.dataSource.register(ChangeSetPages)."""

    @classmethod
    def name(cls) -> str:
        return "change_set_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])
