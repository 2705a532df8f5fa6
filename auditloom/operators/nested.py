"""Deeply nested records to related flat tables.

One depth-first pass over each record emits every nested object or value as one tagged row
``(tag, key, parent key, payload)``. Written partitioned by tag, each partition becomes a table
of its own when the tag's schema is applied to the payloads.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import map_arrow, scratch

EMITTED = "crawl_id long, site string, kind string, pos int, sub int, item_key string, pk string, parent_pk string, payload string"

#: Schema of the payload of each tag.
TAG_SCHEMAS = {
    "page": "url string, status_code int, content_type string, depth int, fetched_at string, fetch_duration bigint, in_sitemap boolean",
    "link": "value string",
    "redirect": "value string",
    "header": "name string, value string",
    "issue": "check_name string, severity string, message string, url string, detail string",
    "lighthouse": "url string, performance_score double, accessibility_score double, best_practices_score double, seo_score double, fetched_at string, source string",
}
_NESTED_IN_PAGE = ("links", "redirect_chain", "headers")


def latest_payloads(records: DataFrame) -> DataFrame:
    """The row of each ``crawl_id`` received last; of equal times, the one with the greatest payload.

    A maximum of a struct is aggregated before the shuffle, so records delivered again and again
    do not gather in one task. Rows without ``crawl_id`` yield nothing; a null time counts as oldest.
    """
    return (
        records.where(F.col("crawl_id").isNotNull())
        .groupBy("crawl_id")
        .agg(F.max(F.struct(F.col("received_at"), F.col("payload"), F.col("site"))).alias("m"))
        .select("crawl_id", F.col("m.site").alias("site"), F.col("m.payload").alias("payload"))
    )


def _clean(s: str) -> str:
    """The text with lone surrogates, which no UTF-8 holds, replaced."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def _text(v) -> str:
    if v is None:
        return ""
    return _clean(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))


def _items(v) -> list:
    """A lone value stands for a list of one; null for none."""
    if v is None:
        return []
    return v if isinstance(v, list) else [v]


def _no_constant(name: str):
    raise ValueError(name)


def visit(payload: str | None):
    """Yield ``(kind, pos, sub, item_key, pk, parent_pk, payload)`` for one record, depth first.

    Text that is not valid JSON, or is no object, yields nothing. Members of ``pages``,
    ``issues`` and ``lighthouse`` that are no objects yield nothing and keep their index.
    """
    if payload is None:
        return
    try:
        record = json.loads(payload, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return
    if not isinstance(record, dict):
        return
    if isinstance(record.get("result"), dict):
        record = record["result"]
    for pos, page in enumerate(_items(record.get("pages"))):
        if not isinstance(page, dict):
            continue
        pk = f"page/{pos}"
        flat = {k: v for k, v in page.items() if k not in _NESTED_IN_PAGE}
        yield "page", pos, -1, _text(page.get("url")), pk, "", flat
        for kind, field in (("link", "links"), ("redirect", "redirect_chain")):
            for sub, v in enumerate(_items(page.get(field))):
                if v is not None:
                    yield kind, pos, sub, _text(v), f"{pk}/{kind}/{sub}", pk, {"value": _text(v)}
        headers = page.get("headers")
        if isinstance(headers, dict):
            for n, (name, values) in enumerate(headers.items()):
                for sub, v in enumerate(_items(values)):
                    if v is not None:
                        yield "header", pos, sub, _clean(name), f"{pk}/header/{n}/{sub}", pk, {"name": name, "value": _text(v)}
    for kind, field, key in (("issue", "issues", "check_name"), ("lighthouse", "lighthouse", "url")):
        for pos, item in enumerate(_items(record.get(field))):
            if isinstance(item, dict):
                yield kind, pos, -1, _text(item.get(key)), f"{kind}/{pos}", "", item


def _emit(with_payload: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["crawl_id", "site", "kind", "pos", "sub", "item_key", "pk", "parent_pk", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        schema = pa.schema(list(zip(names, types)))

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            for cid, site, payload in zip(*(batch.column(n).to_pylist() for n in ("crawl_id", "site", "payload"))):
                for kind, pos, sub, key, pk, parent, flat in visit(payload):
                    rows.append((cid, site, kind, pos, sub, key, pk, parent, _clean(json.dumps(flat, ensure_ascii=False)) if with_payload else None))
                    if len(rows) >= 20_000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    return run


def flatten(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """All tagged rows of the latest, valid records.

    ``pk`` and ``parent_pk`` hold within a ``crawl_id``; an empty ``parent_pk`` names the record.
    Extra columns of the input are ignored; an empty input gives an empty result.
    """
    src = latest_payloads(records.select("crawl_id", "site", "received_at", "payload"))
    return map_arrow(src, _emit(with_payload), EMITTED)


def write_tables(emitted: DataFrame, path: str) -> DataFrame:
    """Write the tagged rows once, partitioned by tag, and read them back."""
    emitted.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)
    return emitted.sparkSession.read.schema(emitted.schema).parquet(path)


_WRITTEN: dict[tuple, DataFrame] = {}


def written_once(records: DataFrame) -> DataFrame:
    """``flatten`` written by ``write_tables``, once an application for the same files; a table that changes gets new ones."""
    spark = records.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = []
    for f in sorted(records.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        at.append((f, s.getLen(), s.getModificationTime()))
    key = (spark.sparkContext.applicationId, *at)
    if not at or key not in _WRITTEN:
        _WRITTEN[key] = write_tables(flatten(records), scratch(spark))
    return _WRITTEN[key]


def flat_table(emitted: DataFrame, kind: str) -> DataFrame:
    """The table of one tag: ids, parent ids and the payload's columns; unreadable values are null.

    Read from a folder of ``write_tables``, the filter on ``kind`` prunes to the one partition.
    """
    if kind not in TAG_SCHEMAS:
        raise ValueError(f"unknown kind {kind!r}")
    t = emitted.where(F.col("kind") == kind)
    names = [c.split()[0] for c in TAG_SCHEMAS[kind].split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in TAG_SCHEMAS[kind].split(", ")}
    raw = F.from_json("payload", ", ".join(f"{n} string" for n in names))
    t = t.withColumn("p", raw)
    cast = [F.expr(f"try_cast(p.`{n}` AS {kinds[n]})").alias(n) for n in names]
    return t.select("crawl_id", "site", "pos", "sub", "pk", "parent_pk", *cast)
