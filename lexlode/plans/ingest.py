"""Queries over ingestion, sources and streams, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.operators.ingest import Stats, ingest, new_documents
from lexlode.plans.chunking import _CHUNK, documents
from lexlode.session import shared_dir
from lexlode.sources.files import KINDS, extension, load_files, scan
from lexlode.sources.markup import read_html
from lexlode.sources.tables import table
from lexlode.streaming.streams import hourly_counts, read_stream, sessions

STORED, CFG = "doc_id % 3 = 0", Settings()


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(STORED).select(F.col("doc_key").alias("doc_id"))


def new_docs_anti(spark, sf_dir):
    return new_documents(documents(spark, sf_dir), _stored(spark, sf_dir)).select("doc_id", "source")


def _runs(spark: SparkSession, sf_dir: str) -> list[Stats]:
    """Counters of three runs into one store: every third document, all of them, and all of them again."""
    docs, base = documents(spark, sf_dir), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    part = docs.join(_stored(spark, sf_dir), "doc_id", "left_semi")
    return [ingest(x, base, CFG) for x in (part, docs, docs)]


def ingest_stats(spark, sf_dir):
    """Counters of each run: what is stored is skipped, and nothing is stored twice."""
    rows = [r.row(spark).withColumn("run", F.lit(i + 1)) for i, r in enumerate(_runs(spark, sf_dir))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    cols = ["documents_processed", "documents_skipped", "chunks_created", "chunks_stored", "bm25_indexed"]
    return every.select("run", *cols, ((F.col("graph_entities") > 0) == (F.col("run") < 3)).alias("entities_added"), F.size("errors").cast("long").alias("n_errors"))


def html_main_text(spark, sf_dir):
    """Main text of pages whose markup is made from the html documents' lines, with furniture that must go."""
    d = table(spark, sf_dir, "documents").where("doc_type = 'html'")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split(safe, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><head><title> Page </title><style>p {}</style></head><body><nav>Home</nav><main>"), body, F.lit("<script>x()</script></main><footer>Imprint</footer></body></html>"))
    return d.select(F.col("doc_id").cast("string").alias("path"), page.cast("binary").alias("content")).mapInArrow(read_html, "path string, text string, title string").select(F.col("path").cast("long").alias("doc_id"), "text", "title")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of their kinds: path, content, doc_type."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_type") == "text", ".MD").otherwise(F.concat(F.lit("."), "doc_type")))
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.when(F.col("doc_type") == "html", F.concat(F.lit("<html><title>Page</title><main>"), safe, F.lit("</main></html>"))).when((F.col("doc_type") == "pdf") & (F.col("doc_id") % 7 == 0), F.lit("broken")).otherwise(F.col("text"))
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[extension(F.col("path"))]
    return d.select(name.alias("path"), body.cast("binary").alias("content")).withColumn("doc_type", kind)


def _read_pdf(content: bytes) -> list[str]:
    """Stand-in for a PDF library: the text itself, and an error for broken files."""
    if content == b"broken":
        raise ValueError("not a PDF")
    return [content.decode()]


def file_dispatch(spark, sf_dir):
    """Files of three kinds through their readers: documents and errors of each."""
    docs, errors = load_files(_files(spark, sf_dir), _read_pdf)
    each = docs.select("doc_type", F.lit(None).cast("string").alias("error"), "title").unionByName(errors.select(extension(F.col("source")).alias("doc_type"), "error", F.lit(None).cast("string").alias("title")))
    return each.groupBy("doc_type").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), F.sum((F.col("title") == "Page").cast("long")).alias("n_titled"))


def upload_merge(spark, sf_dir):
    """Uploads of three files, one of an unknown kind and one sent twice, loaded, ingested file by file, and their counters merged with the documents'."""
    from lexlode.sources.files import save_uploads

    folder, base = f"{shared_dir(spark)}/uploads-{uuid.uuid4().hex}", f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    sent = [("../a note.md", b"The first upload. It has two sentences."), ("page.html", b"<title>P</title><main>The second upload.</main>"), ("page.html", b"<title>P</title><main>The second upload.</main>"), ("x.exe", b"no")]
    saved, refused = save_uploads(sent, folder, spark)
    docs, errors = load_files(scan(spark, folder))
    total = Stats(errors=refused)
    for path in saved:
        total = total.merge(ingest(docs.where(F.endswith("source", F.lit(path.rsplit("/", 1)[-1]))), base, CFG))
    total = total.merge(ingest(docs.unionByName(documents(spark, sf_dir).select(docs.columns)), base, CFG))
    return total.row(spark).select("documents_processed", "documents_skipped", F.size("errors").cast("long").alias("n_errors"))


def event_hours(spark, sf_dir):
    return hourly_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


def event_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"))


def stream_hourly(spark, sf_dir):
    """The hours of the events again, from a stream over the same file; each batch replaces the table of the hours."""
    src = table(spark, sf_dir, "events")
    at = f"{shared_dir(spark)}/hours-{uuid.uuid4().hex}"
    out = hourly_counts(read_stream(spark, f"{sf_dir}/events.parq[u]et", src.schema))
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/table")
    q = out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/table").withColumns({"hour": F.col("hour").cast("timestamp_ntz"), "total": F.round("total", 6)})


QUERIES = {f.__name__: f for f in (new_docs_anti, ingest_stats, html_main_text, file_dispatch, upload_merge, event_hours, event_sessions, stream_hourly)}

_HOURS = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
ORACLE = {
    "new_docs_anti": f"SELECT doc_key AS doc_id, source FROM documents WHERE NOT ({STORED})",
    "ingest_stats": _CHUNK + f""", d AS (SELECT doc_key, {STORED} AS third FROM documents), n AS (SELECT count(*) AS every, count(*) FILTER (third) AS third FROM d),
        k AS (SELECT count(*) AS every, count(*) FILTER (third) AS third FROM c JOIN d ON doc_key = doc_id)
        SELECT run, CASE run WHEN 1 THEN n.third WHEN 2 THEN n.every - n.third ELSE 0 END AS documents_processed, CASE run WHEN 1 THEN 0 WHEN 2 THEN n.third ELSE n.every END AS documents_skipped,
        CASE run WHEN 1 THEN k.third WHEN 2 THEN k.every - k.third ELSE 0 END AS chunks_created, CASE run WHEN 1 THEN k.third WHEN 2 THEN k.every - k.third ELSE 0 END AS chunks_stored,
        CASE run WHEN 1 THEN k.third WHEN 2 THEN k.every - k.third ELSE 0 END AS bm25_indexed, true AS entities_added, 0 AS n_errors FROM n, k, (VALUES (1), (2), (3)) r(run)""",
    "html_main_text": r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\t-\r\x{1C}-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r\x{1C}-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text, 'Page' AS title FROM documents WHERE doc_type = 'html'""",
    "file_dispatch": "SELECT doc_type, count(*) AS n, count(*) FILTER (doc_type = 'pdf' AND doc_id % 7 = 0) AS n_errors, count(*) FILTER (doc_type = 'html') + CASE WHEN count(*) FILTER (doc_type <> 'pdf' OR doc_id % 7 <> 0) = 0 THEN NULL ELSE 0 END AS n_titled FROM documents GROUP BY 1",
    "upload_merge": "SELECT count(*) + 2 AS documents_processed, 2::BIGINT AS documents_skipped, 1::BIGINT AS n_errors FROM documents",
    "event_hours": _HOURS,
    "stream_hourly": _HOURS,
    "event_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
        g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
}
