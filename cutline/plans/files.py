"""Readers, writers and stores over the driver's tables: each query writes what it needs to the shared folder and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import objects
from cutline.operators import confirm, embedding
from cutline.sources import manifest, places, readers, writers
from cutline.streaming import landing

from .registry import Tables, query


def _folder(t: Tables, name: str) -> str:
    return places.register(t.spark, places.new_path(t.spark, name))


@query("""
WITH s AS (SELECT n_name AS row, 'F' || f AS label, min(CAST(s_acctbal AS DECIMAL(12,2))) AS z FROM nation JOIN supplier ON s_nationkey = n_nationkey, range(0, 4) r(f) WHERE s_suppkey % 4 = f GROUP BY 1, 2)
SELECT 2024 AS period, n_name AS row, 'F' || f AS label, CAST(z AS VARCHAR) AS raw FROM nation CROSS JOIN range(0, 4) r(f) LEFT JOIN s ON s.row = n_name AND s.label = 'F' || f
""")
def wide_csv_cells(t: Tables) -> DataFrame:
    """A wide CSV with rows and columns in their order, written and read back as cells; blank cells are null."""
    joined = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    cells = joined.groupBy(F.col("n_name").alias("row"), F.concat(F.lit("F"), (F.col("s_suppkey") % 4).cast("string")).alias("label")).agg(F.min(F.col("s_acctbal").cast("decimal(12,2)")).alias("z"))
    path = _folder(t, "wide")
    writers.write_csv(writers.wide_matrix(cells, "row", "label", "z", t.nation.select(F.col("n_name").alias("row"), F.col("n_nationkey").alias("nth")), ["F0", "F1", "F2", "F3"]), path)
    return readers.wide_csv(t.spark, path, 2024).select("period", "row", "label", F.nullif("raw", F.lit("")).alias("raw"))


@query("""
SELECT o_custkey, max(o_orderkey) AS last, min(o_orderkey) AS first FROM orders GROUP BY 1
""")
def keyed_csv_rows(t: Tables) -> DataFrame:
    """Of a CSV's rows of one key the first or the last in the file stays."""
    path, schema = _folder(t, "keyed"), "o_custkey long, o_orderkey long"
    t.orders.select("o_custkey", "o_orderkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    last = readers.keyed_csv(t.spark, path, schema, "o_custkey", "last").select("o_custkey", F.col("o_orderkey").alias("last"))
    return last.join(readers.keyed_csv(t.spark, path, schema, "o_custkey", "first").select("o_custkey", F.col("o_orderkey").alias("first")), "o_custkey")


@query("""
SELECT 'k' || n_nationkey AS column_key, unnest(['name', 'region']) AS row, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS raw FROM nation
""")
def artifact_cells(t: Tables) -> DataFrame:
    """A JSON artifact of a run put into the store, loaded by its schema and read as cells."""
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    column = F.struct(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("column_key"), F.col("n_name").alias("raw_label"), values.alias("values"))
    store = _folder(t, "store")
    writers.put_artifact(t.nation.agg(F.collect_list(column).alias("columns")), store, "run", "grid")  # the columns of one book
    found = writers.load_artifact(t.spark, store, "run", "grid", readers.GRID)
    return readers.artifact_cells(found.select(F.explode("columns").alias("column")))


@query("""
SELECT 'archived' AS what, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'kept', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'P'
""")
def archived_run(t: Tables) -> DataFrame:
    """A run's artifacts copied to the archive, loaded from there and deleted in the store."""
    store, archive = _folder(t, "store"), _folder(t, "archive")
    writers.put_artifact(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), store, "run", "csv")
    written = writers.archive_run(t.spark, store, "run", archive, 2024, "t1", ["pdf", "csv"])
    kept = places.stash(writers.load_artifact(t.spark, store, "run", "csv", "o_orderkey long"), "kept")
    gone = writers.delete_artifact(t.spark, store, "run", "csv") and not writers.artifact_exists(t.spark, store, "run", "csv")
    if written != ["2024/csv_2024_t1"] or not gone:
        raise ValueError(f"archived {written}, deleted {gone}")
    total = lambda df, what: df.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total")).select(F.lit(what).alias("what"), "n", "total")
    return total(t.spark.read.schema("o_orderkey long").json(f"{archive}/{written[0]}"), "archived").unionByName(total(kept, "kept"))


@query("""
SELECT l_orderkey % 20 AS page, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1
""")
def rotated_glyphs(t: Tables) -> DataFrame:
    """The rotated glyphs of a glyph table, which the scan picks by their flag."""
    path = _folder(t, "glyphs")
    _glyphs(t).write.parquet(path)
    return readers.rotated(readers.table(t.spark, path, readers.GLYPHS)).groupBy(F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"))


def _glyphs(t: Tables) -> DataFrame:
    """Lines of orders as glyphs: names, values and letters in places that their keys give."""
    n = F.col("l_linenumber")
    text = F.when((F.col("l_orderkey") % 20 < 12) & (n % 3 == 1), F.concat(F.lit(" N"), (F.col("l_suppkey") % 25).cast("string"), F.lit(" "))).when(F.col("l_orderkey") % 20 % 2 == 0, F.concat(F.lit(" 1."), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0"), F.lit(" "))).otherwise("x")
    x = F.col("l_orderkey").cast("double")
    return t.lineitem.select((F.col("l_orderkey") % 20).cast("int").alias("page"), text.alias("text"), x.alias("x0"), (x + 1).alias("x1"), n.cast("double").alias("top"), (n % 3 == 0).alias("upright"), F.lit(1.0).alias("mx"))


@query("""
WITH g AS (SELECT CAST(l_orderkey % 20 AS INT) AS page, CASE WHEN l_orderkey % 20 < 12 AND l_linenumber % 3 = 1 THEN ' N' || (l_suppkey % 25) || ' ' WHEN l_orderkey % 20 % 2 = 0 THEN ' 1.' || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') || ' ' ELSE 'x' END AS text FROM lineitem WHERE l_linenumber % 3 <> 0),
s AS (SELECT page, count(*) AS n, (SELECT count(*) FROM range(0, 25) r(i) WHERE list_contains(list(DISTINCT text), ' N' || i || ' ')) AS named, count(*) FILTER (regexp_matches(text, '1\\.[0-9]{4}')) AS n_values FROM g GROUP BY page)
SELECT page FROM s WHERE n >= 50 AND named >= 5 AND n_values >= 20
""")
def grid_page_numbers(t: Tables) -> DataFrame:
    """Pages that look like a grid: many rotated glyphs, enough names and enough values."""
    return readers.grid_pages(_glyphs(t), [f" N{i} " for i in range(25)], least_glyphs=50, least_names=5, least_values=20)


@query("""
SELECT name, count(*) AS n FROM (SELECT 'filled' AS name FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'open' FROM orders WHERE o_orderstatus = 'O') GROUP BY 1
""")
def snapshots(t: Tables) -> DataFrame:
    """Tables that have rows are written out before they are overwritten."""
    folder = _folder(t, "snapshot")
    o = t.orders.select("o_orderkey", "o_orderstatus")
    done = writers.snapshot({"filled": o.where("o_orderstatus = 'F'"), "open": o.where("o_orderstatus = 'O'"), "none": o.where("o_orderstatus = 'Z'")}, folder)
    parts = [t.spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in done]
    return parts[0].unionByName(parts[1])


@query("""
SELECT sha256(event_id || '|' || event_type || '|' || user_id) AS request_hash, event_id, event_type FROM events
""")
def audited_requests(t: Tables) -> DataFrame:
    """Requests appended to an audit with their hash and a JSON-safe payload, and read by schema."""
    path = _folder(t, "audit")
    events = t.events.select("event_id", "event_type", "user_id", "ts", "value")
    for part in (0, 1):
        if not writers.append_audit(events.where(F.col("event_id") % 2 == part), path, ["event_id", "event_type", "user_id"]):
            raise ValueError("the audit could not be written")
    payload = F.from_json("payload", "event_id long, event_type string")
    return t.spark.read.schema("request_hash string, payload string").parquet(path).select("request_hash", payload["event_id"].alias("event_id"), payload["event_type"].alias("event_type"))


@query("""
SELECT 1::BIGINT AS version, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 3, count(*) FROM customer
""")
def committed_versions(t: Tables) -> DataFrame:
    """Tables that become valid together; an earlier version stays readable, what a commit doesn't name stays as it is."""
    root, o = _folder(t, "commits"), t.orders.select("o_orderkey", "o_orderstatus")
    manifest.commit(t.spark, root, {"orders": o.where("o_orderstatus = 'F'"), "customers": t.customer.select("c_custkey")})
    manifest.commit(t.spark, root, {"orders": o.where("o_orderstatus <> 'F'")})
    row = lambda df, v: df.agg(F.count("*").alias("n")).select(F.lit(v).cast("long").alias("version"), "n")
    return row(manifest.read(t.spark, root, "orders", 1), 1).unionByName(row(manifest.read(t.spark, root, "orders"), 2)).unionByName(row(manifest.read(t.spark, root, "customers"), 3))


_RUN = """
c AS (SELECT p_brand AS k, max(p_type) AS raw_label, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'unmapped_kept' WHEN p_brand LIKE 'Brand#2%' THEN 'ignored' ELSE 'confirmed' END AS status, p_brand LIKE 'Brand#3%' AS split FROM part GROUP BY 1),
g AS (SELECT p_brand AS k, 'r' || p_size % 5 AS row, min(CAST(p_retailprice AS DECIMAL(12,2))) AS z, min(CAST(p_retailprice AS DECIMAL(12,2))) + max(p_size % 2) AS was FROM part GROUP BY 1, 2),
used AS (SELECT * FROM c WHERE status = 'confirmed'),
n AS (SELECT used.k, row, z, was FROM used JOIN g ON g.k = used.k WHERE NOT split),
changed AS (SELECT k FROM n WHERE k NOT LIKE 'Brand#5%' AND abs(z - was) >= 0.0001 GROUP BY k)
"""


@query(f"""
WITH {_RUN}
SELECT 'aliases' AS what, count(*) AS n FROM used UNION ALL SELECT 'cells', (SELECT count(*) FROM used) * (SELECT count(DISTINCT row) FROM g) UNION ALL SELECT 'filled', count(*) FROM n
UNION ALL SELECT 'overrides', count(*) FROM used WHERE split UNION ALL SELECT 'unmapped', count(*) FROM c WHERE status = 'unmapped_kept' UNION ALL SELECT 'changed', count(*) FROM changed
UNION ALL SELECT 'added', count(*) FROM used WHERE k LIKE 'Brand#5%' UNION ALL SELECT 'removed', count(*) FROM c WHERE status <> 'confirmed' AND k <> 'Brand#21'
""")
def confirmed_run(t: Tables) -> DataFrame:
    """A run confirmed as one commit, and what its tables hold when they are read back."""
    brand = F.col("p_brand")
    status = F.when(brand.startswith("Brand#1"), "unmapped_kept").when(brand.startswith("Brand#2"), "ignored").otherwise("confirmed")
    streams = F.when(brand.startswith("Brand#3"), F.array(F.lit("S1")))
    columns = t.part.groupBy("p_brand").agg(F.min("p_size").alias("page"), F.max("p_type").alias("raw_label")).select(brand.alias("column_key"), "page", "raw_label", F.when(status != "unmapped_kept", brand).alias("code"), status.alias("status"), streams.alias("streams"))
    price, row = F.col("p_retailprice").cast("decimal(12,2)"), F.concat(F.lit("r"), (F.col("p_size") % 5).cast("string"))
    cells = t.part.groupBy(brand.alias("code"), row.alias("row")).agg(F.min(price).alias("z"), F.max(F.col("p_size") % 2).alias("more"))
    grid = cells.groupBy(F.col("code").alias("column_key")).agg(F.map_from_entries(F.collect_list(F.struct("row", F.col("z").cast("string")))).alias("values"))  # the rows of one table
    aliases = t.spark.createDataFrame([], "alias_text string, course_code string, source string, confidence double")
    catalog = t.part.where(~brand.startswith("Brand#5")).select(brand.alias("code"), F.lit(True).alias("is_active")).distinct()
    before = cells.select("code", "row", (F.col("z") + F.col("more")).cast("double").alias("value"))
    root = _folder(t, "confirmed")
    confirm.confirm(root, columns, grid, aliases, catalog, before, "confirmed", t.part.where("p_brand = 'Brand#21'").select(brand.alias("code")).distinct())
    held = {name: manifest.read(t.spark, root, name) for name in ("aliases", "cells", "overrides", "unmapped", "changes")}
    held["filled"] = held["cells"].where("value IS NOT NULL")
    held |= {kind: held["changes"].where(F.col("kind") == kind) for kind in ("changed", "added", "removed")}
    counts = [held[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name in held if name != "changes"]
    return reduce(DataFrame.unionByName, counts)


@query("""
SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1
""")
def landed_rows(t: Tables) -> DataFrame:
    """Files that land in a folder are handed over once each and merged, also when a batch comes again."""
    folder, table, checkpoint = (_folder(t, x) for x in ("landing", "landed", "checkpoint"))
    events = t.events.select("event_id", "event_type")

    def merge(batch: DataFrame, number: int) -> None:
        for _ in range(2):  # as if the first try had been lost after it had written
            batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(folder)
        landing.drain(t.spark, folder, "event_id long, event_type string", checkpoint, merge).awaitTermination()
    return t.spark.read.schema("event_id long, event_type string, batch int").parquet(table).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


_PATCH = """CASE event_id % 4 WHEN 0 THEN '{"seen":{"type":"' || event_type || '","n":1}}' WHEN 1 THEN '{"k":null,"user":' || user_id || '}' WHEN 2 THEN '{"k":{"of":' || user_id || '}}' END"""


@query(f"""
WITH m AS (SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CASE WHEN {_PATCH} IS NULL THEN CAST(props AS JSON) ELSE json_merge_patch(CAST(props AS JSON), CAST({_PATCH} AS JSON)) END AS j FROM events)
SELECT event_id, k, TRY_CAST(j ->> '$.k' AS BIGINT) AS k_now, j ->> '$.seen.type' AS seen, TRY_CAST(j ->> '$.k.of' AS BIGINT) AS k_of, len(json_keys(j)) AS n_members FROM m
""")
def json_objects(t: Tables) -> DataFrame:
    """2.9-22: JSON objects read by type and patched at depth."""
    rows = t.events.select("event_id", "props", objects.merged("props", F.expr(_PATCH)).alias("j"))
    return rows.select(
        "event_id", objects.typed(F.col("props"), "$.k", "bigint").alias("k"), F.when(objects.kind_of(F.col("j"), "$.k") == "BIGINT", objects.typed(F.col("j"), "$.k", "bigint")).alias("k_now"),
        objects.typed(F.col("j"), "$.seen.type", "string").alias("seen"), objects.typed(F.col("j"), "$.k.of", "bigint").alias("k_of"), F.size(F.json_object_keys("j")).cast("long").alias("n_members"),
    )


def _counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: characters, line feeds and commas."""
    return [[float(len(x)), float(x.count("\n")), float(x.count(","))] for x in texts]


@query("""
SELECT doc_id, sha256(text) AS content_hash, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines, CAST(length(text) - length(replace(text, ',', '')) AS BIGINT) AS commas FROM documents WHERE text <> ''
""")
def embedded_texts(t: Tables) -> DataFrame:
    """A callable over the texts of all rows, once for each different text, with its vectors stored by hash."""
    found = embedding.embed(t.documents.select("doc_id", "text"), "doc_id", "text", _counts, _folder(t, "vectors"), batch=64, parallel=8)
    part = lambda i, name: F.get("embedding", F.lit(i)).cast("long").alias(name)
    return found.where("content_hash IS NOT NULL").select("doc_id", "content_hash", part(0, "chars"), part(1, "lines"), part(2, "commas"))


@query("""
WITH o AS (SELECT c_custkey AS k, c_nationkey AS g, CASE WHEN c_custkey % 3 = 0 THEN 'old' END AS content FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey AS k, c_nationkey AS g, CASE WHEN c_custkey % 5 <> 0 THEN 'new' END AS content FROM customer WHERE c_custkey % 3 = 0)
SELECT g, k, content FROM n UNION ALL SELECT g, k, content FROM o WHERE k NOT IN (SELECT k FROM n)
""")
def upserted_files(t: Tables) -> DataFrame:
    """A table of files that an upsert writes again by partition only."""
    path = _folder(t, "upserts")
    k = F.col("c_custkey")
    rows = t.customer.select(F.col("c_nationkey").alias("g"), k.alias("k"), F.when(k % 3 == 0, "old").alias("content"), F.when(k % 5 != 0, "new").alias("fresh"))
    writers.write_upsert(rows.where("k % 2 = 0").select("g", "k", "content"), path, ["g", "k"], "g")
    writers.write_upsert(rows.where("k % 3 = 0").select("g", "k", F.col("fresh").alias("content")), path, ["g", "k"], "g")
    return t.spark.read.schema("k long, content string, g int").parquet(path).select("g", "k", "content")
