"""A data source of annotated folders, for spark.read and SQL: {path}/{top}/{sub}/{sub}-schema.json with pdf+gold/{stem}.pdf beside
{stem}.gold.json.

    spark.dataSource.register(AnnotatedFolders)
    spark.read.format("annotated_folders").option("path", path).load().where("domain = 'law/lease'")

Listing goes through pyarrow's file systems (a path with a scheme, or a local one that all machines share). A filter on the
domain is taken over by the reader, so that folders of other domains are not listed; what is listed is cut to partitions
of a few files each, and files are read on executors. Text is made of content by collections.read_files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PDF, GOLD, SCHEMA = ".pdf", ".gold.json", "-schema.json"


@dataclass
class Files(InputPartition):
    domain: str
    schema_files: list[str]
    stems: list[str]


class AnnotatedFolders(DataSource):
    """Options: path; files (a partition's documents, default 64)."""

    @classmethod
    def name(cls) -> str:
        return "annotated_folders"

    def schema(self) -> str:
        return "domain string, stem string, source_path string, content binary, gold string, schema string"

    def reader(self, schema) -> FolderReader:
        if "path" not in self.options:
            raise ValueError("the option path is missing")
        return FolderReader(self.options["path"], int(self.options.get("files", 64)))


class FolderReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files, self.domains = path, files, None

    def pushFilters(self, filters):
        """Takes over domain = and in; all others are Spark's."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("domain",) else set(f.value) if isinstance(f, In) and f.attribute == ("domain",) else None
            if wanted is None:
                yield f
            else:
                self.domains = wanted if self.domains is None else self.domains & wanted

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _list(self, system, at: str, folders: bool = False) -> list[str]:
        from pyarrow import fs

        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in found if (f.type == fs.FileType.Directory) == folders)

    def partitions(self) -> list[Files]:
        """Domains with a schema and a folder of files; documents with both of their files, in lots."""
        system, root = self._open()
        root, out = root.rstrip("/"), []
        names = sorted(self.domains) if self.domains is not None else [f"{top}/{sub}" for top in self._list(system, root, True) for sub in self._list(system, f"{root}/{top}", True)]
        for domain in names:
            schemas = [f for f in self._list(system, f"{root}/{domain}") if f.endswith(SCHEMA)]
            held = self._list(system, f"{root}/{domain}/pdf+gold") if schemas else []
            gold = {f.removesuffix(GOLD) for f in held if f.endswith(GOLD)}
            stems = [s for f in held if f.endswith(PDF) and (s := f.removesuffix(PDF)) in gold]
            out += [Files(domain, schemas, stems[i : i + self.files]) for i in range(0, len(stems), self.files)]
        return out or [Files("", [], [])]

    def read(self, partition: Files):
        from veritrail.sources.collections import unwrapped_schema

        if not partition.stems:
            return
        if len(partition.schema_files) != 1:
            raise ValueError(f"{partition.domain} has {len(partition.schema_files)} schemas")
        system, root = self._open()
        at = f"{root.rstrip('/')}/{partition.domain}"

        def content(path: str) -> bytes:
            with system.open_input_stream(path) as f:
                return f.read()

        schema = json.dumps(unwrapped_schema(content(f"{at}/{partition.schema_files[0]}").decode()))
        for stem in partition.stems:
            yield partition.domain, stem, f"{at}/pdf+gold/{stem}{PDF}", content(f"{at}/pdf+gold/{stem}{PDF}"), content(f"{at}/pdf+gold/{stem}{GOLD}").decode(), schema
