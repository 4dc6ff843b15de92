"""Reading and writing: CSV, paged JSON, HTML fields, rows in memory, zipped CSV, generated points, fitted objects."""

from __future__ import annotations

import dataclasses
import json
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """With a header and a told schema; a byte-order mark before the header does no harm, as names come from the schema."""
    return spark.read.schema(schema).option("enforceSchema", True).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_paged_json(spark: SparkSession, path, record: T.StructType | str, field: str = "result") -> DataFrame:
    """All pages' records (an array in `field` of each page) as rows."""
    kind = T.StructType.fromDDL(record) if isinstance(record, str) else record
    page = T.StructType([T.StructField(field, T.ArrayType(kind))])
    return spark.read.schema(page).option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def rows(spark: SparkSession, data: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(data), schema)


def html_fields(df: DataFrame, html: str, fields: dict[str, str], required: Sequence[str] = (), keep: Sequence[str] = (), references: Sequence[str] | None = None) -> DataFrame:
    """The text of the first element that each field asks for ('tag', 'tag.class' or 'tag@attribute'), NULL where there is none.

    Rows without a required field go. Parsed by the standard library's parser, so broken markup is no error. Character
    references are decoded as HTML has it; with `references` (names like "amp") only those, closed by a semicolon and in text.
    """
    names = list(fields)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.StringType()) for n in names])

    def run(batches):
        for pdf in batches:
            out = pdf[list(keep)].copy()
            found = [parse_fields(x, fields, references) for x in pdf["_html"]]
            for n in names:
                out[n] = [f[n] for f in found]
            yield out

    parsed = df.select(*keep, F.col(html).alias("_html")).mapInPandas(run, schema)
    return parsed.dropna(subset=list(required)) if required else parsed


def parse_fields(html: str | None, fields: dict[str, str], references: Sequence[str] | None = None) -> dict[str, str | None]:
    import re
    from html import unescape
    from html.parser import HTMLParser

    wants = {n: (w.split("@")[0].split(".")[0], w.split(".")[1] if "." in w else None, w.split("@")[1] if "@" in w else None) for n, w in fields.items()}
    out: dict[str, str | None] = dict.fromkeys(fields)
    empty = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    # with told references every ampersand is masked from the parser, which gives markup's text as written
    masked = references is not None
    known = re.compile(f"&({'|'.join(map(re.escape, references))});") if references else None

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, list[str], list[str]]] = []

        def handle_starttag(self, tag, attrs):
            held = dict(attrs)
            mine = []
            for n, (t, cls, attr) in wants.items():
                if t == tag and out[n] is None and (cls is None or cls in (held.get("class") or "").split()):
                    if attr:
                        out[n] = held.get(attr)
                    else:
                        mine.append(n)
                        out[n] = ""
            if tag not in empty:
                self.open.append((tag, mine, []))

        def handle_data(self, data):
            if masked and self.cdata_elem in self.CDATA_CONTENT_ELEMENTS:  # scripts and styles have no references
                data = data.replace("&amp;", "&")
            elif known:
                data = known.sub(lambda m: unescape(m.group()), data)
            for _, mine, text in self.open:
                if mine:
                    text.append(data)

        def handle_endtag(self, tag):
            while self.open and any(t == tag for t, _, _ in self.open):
                t, mine, text = self.open.pop()
                for n in mine:
                    out[n] = "".join(text).strip()
                if t == tag:
                    break

        def close(self):
            super().close()
            for _, mine, text in self.open:
                for n in mine:
                    out[n] = "".join(text).strip()

    reader = Reader()
    reader.feed((html or "").replace("&", "&amp;") if masked else html or "")
    reader.close()
    return out


def read_zipped_csv(spark: SparkSession, path: str, schema: T.StructType | str, number: int = 0, to: str = "") -> DataFrame:
    """The n-th CSV file, by name, of a zip file on the driver's disk, unpacked to `to`, a folder that executors can see too."""
    if not to:
        raise ValueError("name a folder that the driver and all executors share")
    with zipfile.ZipFile(path) as z:
        names = sorted(n for n in z.namelist() if n.endswith(".csv"))
        if not 0 <= number < len(names):
            raise ValueError(f"{path} has {len(names)} CSV files")
        z.extract(names[number], to)
    return read_csv(spark, f"file://{to}/{names[number]}", schema)


def read_archives(spark: SparkSession, path, schema: T.StructType | str, member: str = "*.csv", header: bool = True) -> DataFrame:
    """archive, member and the columns of all CSV members whose names match, of all zip files at a path.

    Archives are read through Spark's own file systems, one a task, and unpacked member by member in memory. Values that
    a column's type can't hold are NULL, as are those that a short record lacks; archives of up to 2 GB.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        import csv
        import io
        from fnmatch import fnmatch

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for inner in sorted(n for n in z.namelist() if fnmatch(n, member)):
                        with z.open(inner) as f:
                            records = csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                            if header:
                                next(records, None)
                            held = []
                            for record in records:
                                if record:
                                    held.append([x if x != "" else None for x in record])
                                if len(held) >= 10_000:
                                    yield pa.RecordBatch.from_pydict({"archive": [name] * len(held), "member": [inner] * len(held), "record": held})
                                    held = []
                            if held:
                                yield pa.RecordBatch.from_pydict({"archive": [name] * len(held), "member": [inner] * len(held), "record": held})

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, record array<string>")
    return found.select("archive", "member", *(F.get("record", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(kind)))


def read_pages(spark: SparkSession, fetch: Callable[[int], str | None], pages: int, record: T.StructType | str, field: str = "result", attempts: int = 3, pages_per_task: int = 1) -> DataFrame:
    """page and the records of pages 0, 1, ... of a paged service, each page fetched by a task of its own.

    fetch(page) gives a page's JSON text, or None for a page that isn't there; it is called again after an OSError, `attempts`
    times in all. Records are an array in `field`.
    """
    kind = T.StructType.fromDDL(record) if isinstance(record, str) else record
    page = T.StructType([T.StructField(field, T.ArrayType(kind))])

    class Part(InputPartition):
        def __init__(self, first: int, last: int):
            self.first, self.last = first, last

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(i, min(i + pages_per_task, pages)) for i in range(0, pages, pages_per_task)] or [Part(0, 0)]

        def read(self, partition):
            for number in range(partition.first, partition.last):
                for attempt in range(attempts):
                    try:
                        body = fetch(number)
                        break
                    except OSError:
                        if attempt + 1 == attempts:
                            raise
                if body is not None:
                    yield number, body

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "tabulon_pages"

        def schema(self):
            return "page int, body string"

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Pages)
    bodies = spark.read.format("tabulon_pages").load()
    return bodies.select("page", F.explode(F.from_json("body", page)[field]).alias("r")).select("page", "r.*")


def unit_series(df: DataFrame, unit: str, order: Sequence[str], cols: Sequence[str], which=None, span: float | None = None) -> DataFrame:
    """unit, t and the columns of one unit or all, with missing values as 0 (raw_* keeps them); `span` is that of with_step."""
    from tabulon.operators.timeseries import with_step

    held = df if which is None else df.filter(F.col(unit) == which)
    stepped = with_step(held, unit, order, span=span)
    return stepped.select(unit, "t", *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(c) for c in cols), *(F.col(c).alias(f"raw_{c}") for c in cols))


def blobs(spark: SparkSession, n: int, centers: Sequence[Sequence[float]], sd: float = 1.0, seed: int = 0) -> DataFrame:
    """id, label, x0, x1, ...: normal points around centres in turn."""
    df = spark.range(n).withColumn("label", (F.col("id") % len(centers)).cast("int"))
    for j in range(len(centers[0])):
        at = F.get(F.array(*(F.lit(float(c[j])) for c in centers)), F.col("label"))
        df = df.withColumn(f"x{j}", at + F.randn(seed + j) * sd)
    return df


def linear_points(spark: SparkSession, n: int, weights: Sequence[float], intercept: float = 0.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """id, x0, x1, ..., y: normal features, and their weighted sum with normal noise."""
    df = spark.range(n)
    for j in range(len(weights)):
        df = df.withColumn(f"x{j}", F.randn(seed + j))
    exact = sum((F.col(f"x{j}") * w for j, w in enumerate(weights)), F.lit(float(intercept)))
    return df.withColumn("y", exact + F.randn(seed + len(weights)) * noise)


def save_fitted(model, path: str) -> None:
    """A fitted object and the tables it holds, in a folder of any file system that Spark writes to."""
    spark = SparkSession.active()
    for name, table in model.tables().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_fitted(path: str):
    from tabulon.ml import bayes, clusters, ensembles, linear, preprocess, trees  # noqa: F401  their classes register by being defined

    spark = SparkSession.active()
    text = spark.read.text(f"{path}/model").first()[0]
    kind = preprocess.Fitted.kinds()[json.loads(text)["kind"]]
    names = [f.name for f in dataclasses.fields(kind) if f.type in ("DataFrame", DataFrame)]
    return preprocess.Fitted.from_json(text, **{n: spark.read.parquet(f"{path}/{n}") for n in names})
