"""Pages to records on the executors: Arrow batches in, one struct a page out."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema

#: Pages, and bytes of HTML, of which the records are in memory at the same time.
BATCH, BATCH_BYTES = 64, 8_000_000
#: Bytes of stored input for a task; pages are stored compressed, so this is some hundred pages.
TASK_BYTES = 1_000_000
#: Tasks at most, and the estimate from which on it tells nothing: of a plan without statistics, or of a join.
MOST_TASKS, UNKNOWN_BYTES = 4096, 1 << 40


def cuts(sizes: list[int]) -> list[int]:
    """Where batches end: after BATCH pages or BATCH_BYTES, whichever comes first."""
    ends, pages, held = [], 0, 0
    for i, size in enumerate(sizes):
        if pages and (pages >= BATCH or held + size > BATCH_BYTES):
            ends.append(i)
            pages = held = 0
        pages, held = pages + 1, held + size
    return [*ends, len(sizes)] if sizes else []


def dealt_out(pages: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows over tasks of bounded size, whatever files they lie in: parsing is the costly part, and a stored file may be one task of any size.

    The plan's own estimate of its size decides how many, and without one rows stay where they lie; nothing is run for it. Rows are dealt by
    their hash, so none are sorted.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    size = int(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        return pages
    known = [f.name for f in pages.schema if isinstance(f.dataType, (T.StringType, T.IntegralType))]
    return pages.repartition(max(2 * cores, min(MOST_TASKS, -(-size // task_bytes))), F.xxhash64(*(F.col(f"`{n}`") for n in known)))


def page_data(pages: DataFrame, last_year: int | None = None, fields: tuple[str, ...] | None = None, dealt: bool = False) -> DataFrame:
    """All columns of pages but html, and the record's columns. pages: url, html and whatever else.

    fields: the record's columns that are asked for, all if not given; the others are null. dealt: whether pages lie in small parts already.

    Null html is an empty page. Each page is parsed once, whatever is asked of it afterwards. last_year: dates in
    text are not later; the next year if not given. Spark bounds the bytes of what comes to Python at a time, and here
    they are cut further, so a worker holds the records of few megabytes of HTML.
    """
    if not pages.isStreaming and not dealt:
        pages = dealt_out(pages)
    year = date.today().year + 1 if last_year is None else last_year
    kept = [f for f in pages.schema if f.name != "html"]
    whole = T._parse_datatype_string(schema.PAGE_RECORD)
    record = whole if fields is None else T.StructType([f for f in whole if f.name in fields])
    out = T.StructType([*kept, *record])
    arrow = to_arrow_schema(record, timestamp_utc=True)
    names, wanted = [f.name for f in kept], record.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .extract import Page

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_pylist()
            at = 0
            for end in cuts(sizes):
                part = batch.slice(at, end - at)
                at = end
                rows = [Page(html.as_py(), url.as_py() or "", year).record(wanted) for html, url in zip(part.column("html"), part.column("url"))]
                made = pa.Table.from_pylist(rows, schema=arrow).combine_chunks()
                columns = [part.column(n) for n in names] + [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in made.columns]
                yield pa.RecordBatch.from_arrays(columns, names + made.schema.names)

    made = pages.select(*names, "html").mapInArrow(run, out)
    return made.select(*names, *(f.name if f.name in wanted else F.lit(None).cast(f.dataType).alias(f.name) for f in whole))
