"""Data sources over HTTP: fetched documents (one partition each) and tables of a REST service, with filters and columns pushed to it.

A request that fails is a row that says so, never a failed job. Register with `register(spark)`.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGENT = "Mozilla/5.0 (compatible; vigil)"
FETCHED = "name string, url string, status string, detail string, content binary"


def get(url: str, timeout: float, headers: dict[str, str] | None = None) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as r:  # follows redirects
        return r.read()


class _Request(D.InputPartition):
    def __init__(self, name: str, url: str):
        super().__init__(None)
        self.name, self.url = name, url


class _FetchReader(D.DataSourceReader):
    def __init__(self, options):
        self.requests = json.loads(options["requests"])
        self.timeout = float(options.get("timeout", "20"))

    def partitions(self):
        return [_Request(r["name"], r["url"]) for r in self.requests]

    def read(self, partition) -> Iterator[tuple]:
        try:
            body = get(partition.url, self.timeout)
        except (urllib.error.URLError, OSError, ValueError) as e:
            yield partition.name, partition.url, "blocked", f"fetch failed: {e}"[:300], None
        else:
            yield partition.name, partition.url, "ok", "", body


class FetchSource(D.DataSource):
    """format("vigil_fetch"), option requests: a JSON list of {name, url}; (name, url, status, detail, content), a row of each request."""

    @classmethod
    def name(cls):
        return "vigil_fetch"

    def schema(self):
        return FETCHED

    def reader(self, schema):
        return _FetchReader(self.options)


_OPERATORS = {"EqualTo": "eq", "GreaterThan": "gt", "GreaterThanOrEqual": "gte", "LessThan": "lt", "LessThanOrEqual": "lte"}


def _value(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def parameter(f: D.Filter) -> tuple[str, str] | None:
    """The service's parameter for a filter, or None if it has none."""
    kind = type(f).__name__
    if kind == "Not":
        inner = parameter(f.child)
        return inner and (inner[0], f"not.{inner[1]}")
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = f.attribute[0]
    if kind in _OPERATORS and f.value is not None:
        return column, f"{_OPERATORS[kind]}.{_value(f.value)}"
    if kind == "In" and all(v is not None and not set(_value(v)) & set(',()"') for v in f.value):
        return column, f"in.({','.join(map(_value, f.value))})"
    if kind == "IsNull":
        return column, "is.null"
    if kind == "IsNotNull":
        return column, "not.is.null"
    if kind == "StringStartsWith" and not set(f.value) & set("*%_\\"):
        return column, f"like.{f.value}*"
    return None


class _Pages(D.InputPartition):
    def __init__(self, at: int):
        super().__init__(at)


class _RestReader(D.DataSourceReader):
    """Pages of `pagesize` rows in the order given are dealt to `readers` tasks in turn; a task stops at the first page that is not full."""

    def __init__(self, schema: T.StructType, options):
        self.schema_, self.options = schema, dict(options)
        self.filters: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            p = parameter(f)
            if p is None:
                yield f
            else:
                self.filters.append(p)

    def partitions(self):
        return [_Pages(i) for i in range(int(self.options.get("readers", "1")))]

    def read(self, partition) -> Iterator[tuple]:
        size, readers = int(self.options.get("pagesize", "1000")), int(self.options.get("readers", "1"))
        most = int(self.options.get("limit", "0"))
        page = partition.value
        while not most or page * size < most:
            rows = rest_rows(self.options, self.schema_.names, self.filters, page * size, min(size, most - page * size) if most else size)
            for r in rows:
                yield tuple(_typed(r.get(f.name), f.dataType) for f in self.schema_)
            if len(rows) < size:
                return
            page += readers


def _typed(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else json.dumps(v)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(v)
    return v


def rest_rows(options: dict, columns: list[str], filters: list[tuple[str, str]], offset: int, limit: int) -> list[dict]:
    asked = [("select", ",".join(columns)), *filters, *([("order", options["order"])] if options.get("order") else []), ("limit", str(limit)), ("offset", str(offset))]
    headers = {"apikey": options["key"], "Authorization": f"Bearer {options['key']}"} if options.get("key") else {}
    return json.loads(get(f"{options['url'].rstrip('/')}/{options['table']}?{urllib.parse.urlencode(asked)}", float(options.get("timeout", "30")), headers))


class RestSource(D.DataSource):
    """format("vigil_rest"), options url, table, order (of a distinct key), and key, limit, pagesize, readers; the columns asked for are those of the schema."""

    @classmethod
    def name(cls):
        return "vigil_rest"

    def schema(self):
        raise ValueError("vigil_rest needs a schema: its columns are the ones asked for")

    def reader(self, schema):
        return _RestReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FetchSource)
    spark.dataSource.register(RestSource)


def fetch(spark: SparkSession, requests: list[tuple[str, str]], timeout: float = 20) -> DataFrame:
    register(spark)
    body = json.dumps([{"name": n, "url": u} for n, u in requests])
    return spark.read.format("vigil_fetch").option("requests", body).option("timeout", str(timeout)).load() if requests else spark.createDataFrame([], FETCHED)


def rest_table(spark: SparkSession, options: dict[str, str], wanted: dict[str, str], fallbacks: list[list[str]] | None = None) -> DataFrame:
    """The wanted columns (name: type) of a service's table.

    A service that refuses the columns (status 400: one isn't there yet) is asked for each of the shorter lists in turn, and columns left out are null. One
    that can't be reached, or refuses all, gives no rows. The trial is one request of one row for each list.
    """
    register(spark)
    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(t)) for c, t in wanted.items()])
    for columns in [list(wanted), *(fallbacks or [])]:
        try:
            rest_rows(options, columns, [], 0, 1)
        except urllib.error.HTTPError as e:
            if e.code == 400:
                continue
            break
        except (urllib.error.URLError, OSError, ValueError):
            break
        here = T.StructType([f for f in schema if f.name in columns])
        rows = spark.read.format("vigil_rest").options(**options).schema(here).load()
        return rows.select(*[F.col(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    return spark.createDataFrame([], schema)
