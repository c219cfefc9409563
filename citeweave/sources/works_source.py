"""A data source over stored answer pages of a works index, which evaluates the index's own predicates.

``spark.read.format("works")`` reads a folder of JSON-lines files, one page of
answers each, as one partition a page.  Predicates on ``type``,
``publication_year`` and ``is_oa`` are answered by the reader, as the index
answers them, and not repeated by Spark; all others stay with Spark.  A schema
given to ``schema(...)`` names the columns to read; ``payload`` is the whole
answer as text, for ``payloads.parse_openalex``.

A line that is no JSON object is skipped; a field of another type is null; a
folder without pages gives no rows.  Predicates never hold for a null.
"""

from __future__ import annotations

import io
import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "id string, type string, publication_year int, is_oa boolean, payload string"
#: What the index can be asked for.
ASKED = ("type", "publication_year", "is_oa")
# The kinds of works that a search takes, and the bounds of a page.
TYPES = ("article", "preprint", "book-chapter")
LEAST_PAGE, MOST_PAGE = 1, 200
#: Spark offers predicates to Python data sources only with this setting.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_KIND = {"string": str, "int": int, "bigint": int, "boolean": bool}


@dataclass
class Page(InputPartition):
    path: str


def _fields(line: str, kinds: dict[str, str]) -> dict | None:
    """The typed fields of one answer."""
    try:
        work = json.loads(line)
    except ValueError:
        return None
    if not isinstance(work, dict):
        return None
    access = work.get("open_access")
    work["is_oa"] = access.get("is_oa") if isinstance(access, dict) else None
    found = {c: v if type(v := work.get(c)) is _KIND.get(kind) else None for c, kind in kinds.items()}
    return found | ({"payload": line} if "payload" in kinds else {})


class WorksReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path, self.asked = schema, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (*_COMPARE, In, IsNotNull)) else None
            if column not in ASKED:
                yield f
            elif type(f) in _COMPARE:
                self.asked.append((column, _COMPARE[type(f)], f.value))
            elif isinstance(f, In):
                self.asked.append((column, lambda value, among: value in among, tuple(v for v in f.value if v is not None)))
            else:
                self.asked.append((column, operator.is_not, None))

    def partitions(self) -> list[Page]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Page(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._"]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without pages
            return
        schema = to_arrow_schema(self.schema)
        kinds = {f.name: f.dataType.simpleString() for f in self.schema} | {"type": "string", "publication_year": "int", "is_oa": "boolean"}
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(partition.path) as stream:
            held: list[dict] = []
            for raw in io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", errors="replace", newline="\n"):
                row = _fields(raw, kinds)
                if row is not None and all(row[c] is not None and holds(row[c], value) for c, holds, value in self.asked):
                    held.append(row)
                if len(held) >= MOST_PAGE:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


class WorksSource(DataSource):
    """``option("path", folder)``: see the module."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WorksReader:
        return WorksReader(schema, self.options["path"])


def works(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The answers below ``path`` with the given columns; registers the source and lets Spark offer it predicates."""
    spark.dataSource.register(WorksSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("works").schema(columns).load(path)


def search_works(spark: SparkSession, path: str, min_year: int = 0, oa_only: bool = False, columns: str = SCHEMA) -> DataFrame:
    """Answers of the kinds that a search takes, from ``min_year`` on (0: any), open ones only if so asked."""
    found = works(spark, path, columns).filter(F.col("type").isin(*TYPES))
    if min_year:
        found = found.filter(F.col("publication_year") > min_year - 1)
    return found.filter(F.col("is_oa") == F.lit(True)) if oa_only else found


def page_size(asked: int) -> int:
    """The answers of a page that the index grants."""
    return max(LEAST_PAGE, min(asked, MOST_PAGE))
