"""All queries of the library, by name, and the DuckDB SQL that each is checked against.

Inputs are derived from the driver's tables by SQL that both engines read (`VIEWS`); what is checked is the operator.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import scalars as sc
from ..operators import cdc
from ..operators import chunks as ch
from ..operators import ingest as ig
from ..operators import intervals as iv
from ..operators import lookups as lk
from ..operators import objects as ob
from ..operators import paths as pt
from ..operators import placement as pl
from ..operators import reading as rd
from ..operators import stats as st
from ..streaming import rates as sr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark", "embeddings")
CHUNK = 512

#: Views in the SQL that Spark and DuckDB share; {x} is a table or an earlier view.
VIEWS = {
    "runs": """SELECT image, CAST((sum(q) OVER w) - q AS BIGINT) AS s, CAST((sum(q) OVER w) AS BIGINT) AS e, kind, chunk, rn FROM (
        SELECT l_orderkey AS image, CAST(l_quantity AS BIGINT) * 512 AS q, l_partkey AS chunk,
               CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_partkey % 4 = 0 THEN 1 ELSE 2 END AS kind,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn
        FROM {lineitem}) t WINDOW w AS (PARTITION BY image ORDER BY rn ROWS UNBOUNDED PRECEDING)""",
    "images": "SELECT image, max(e) AS size FROM {runs} GROUP BY image",
    "holes": "SELECT r.image, r.s, r.e, i.size FROM {runs} r JOIN {images} i ON r.image = i.image WHERE r.kind <> 2",
    "points": "SELECT DISTINCT l_orderkey AS image, CAST(l_suppkey * 3997 % 120000 AS BIGINT) AS off FROM {lineitem}",
    "layers": """SELECT image - image % 3 AS image, image % 3 AS layer, s, e, kind, chunk FROM {runs}""",
    "objects": "SELECT CAST(o_custkey AS VARCHAR(20)) AS k, CAST(o_orderkey % 5 AS BIGINT) AS ord, max(o_orderkey) AS size FROM {orders} GROUP BY CAST(o_custkey AS VARCHAR(20)), CAST(o_orderkey % 5 AS BIGINT)",
    "probes": """SELECT event_id, CAST(t AS INT) AS tier, CASE (event_id * 7 + t * 3) % 8 WHEN 0 THEN 'hit' WHEN 1 THEN 'hit_miss' WHEN 2 THEN 'error' ELSE 'miss' END AS outcome
        FROM {events} e JOIN (SELECT 0 AS t UNION ALL SELECT 1 UNION ALL SELECT 2) x ON 1 = 1""",
    "access": "SELECT event_id, ts, user_id, event_type, CAST(floor(value * 100000) AS BIGINT) AS ns, event_id % 3 = 0 AS hit, CAST(floor(value * 10) AS BIGINT) AS bytes FROM {events}",
    "files": "SELECT CAST(p_partkey AS BIGINT) AS id, replace(lower(p_type), ' ', '/') || '/' || lower(p_brand) || '/f' || CAST(p_partkey AS VARCHAR(20)) AS path, p_size FROM {part}",
    "answers": """SELECT l_orderkey AS k, CAST(l_suppkey AS BIGINT) AS peer, CAST(l_linenumber - 1 AS BIGINT) AS idx,
        CASE WHEN l_linenumber % 4 = 0 THEN 'miss' ELSE 'shard' END AS outcome FROM {lineitem}""",
}


class Inputs:
    """Tables and views of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.have = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        """A table, or a view with the columns of its SQL."""
        if name not in self.have:
            if name in VIEWS:
                used = {t: self.raw(t) for t in (*TABLES, *VIEWS) if "{" + t + "}" in VIEWS[name]}
                self.have[name] = self.spark.sql(VIEWS[name], **used)
            else:
                self.have[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.have[name]

    def __getitem__(self, name: str) -> DataFrame:
        df = self.raw(name)
        return df.withColumnsRenamed({a: b for a, b in (("s", "start"), ("e", "end")) if a in df.columns})

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self[t] for t in TABLES if "{" + t + "}" in text})


def _views(sql: str) -> str:
    """DuckDB SQL with the views it uses in front, in the order they are defined."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if "{" + v + "}" in text and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    names = {t: t for t in (*TABLES, *VIEWS)}
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**names)})" for v in need)
    body = sql.format(**names)
    if not ctes:
        return body
    if body.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body.lstrip()[15:]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, {body.lstrip()[5:]}"
    return f"WITH {ctes} {body}"


def query(oracle: str | None = None):
    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = _views(oracle)
        return f

    return add


# --- chunks, hashes, manifests ---------------------------------------------------------------------------------------

C = f"""WITH c AS (SELECT image, source, lang, CAST(off // {CHUNK} AS BIGINT) AS ordinal, blob[off + 1:off + {CHUNK}] AS data, sha256(blob[off + 1:off + {CHUNK}]) AS key,
    CAST(octet_length(blob[off + 1:off + {CHUNK}]) AS BIGINT) AS size FROM (SELECT doc_id AS image, source, lang, encode(text) AS blob, unnest(range(0, octet_length(encode(text)), {CHUNK})) AS off FROM documents)) """


Z = C.replace("encode(text)", "CASE WHEN doc_id % 3 = 0 THEN repeat('\\x00'::BLOB, 1100) || encode(text) ELSE encode(text) END").replace("AS size FROM", "AS size, blob[off + 1:off + 512] = repeat('\\x00'::BLOB, octet_length(blob[off + 1:off + 512])) AS zero FROM")


def _zeros(x: Inputs) -> DataFrame:
    """Chunks of texts of which every third stands behind 1100 zero bytes."""
    t = F.encode("text", "utf-8")
    d = x["documents"].select("doc_id", "source", "lang", "text")
    return ch.fixed(d, "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.repeat(F.lit("00"), F.lit(1100))), t)).otherwise(t), CHUNK).drop("text")


def _chunks(x: Inputs) -> DataFrame:
    d = x["documents"].select("doc_id", "source", "lang", "text")
    return ch.fixed(d, "doc_id", F.encode("text", "utf-8"), CHUNK).drop("text")


@query(C + "SELECT image, ordinal, size, key FROM c")
def chunk_fixed(x):
    return _chunks(x).select("image", F.col("ordinal").cast("long"), "size", "key")


REPORT = "CAST(sum(n) AS BIGINT) AS raw_chunks, count(*) AS unique_chunks, CAST(sum(b) AS BIGINT) AS raw_bytes, CAST(sum(s) AS BIGINT) AS unique_bytes, CAST(sum(b) * 1000 // sum(s) AS BIGINT) AS ratio_milli"


@query(C + f""", g AS (SELECT source, key, count(*) AS n, sum(size) AS b, min(size) AS s FROM c GROUP BY source, key), t AS (SELECT key, count(*) AS n, sum(size) AS b, min(size) AS s FROM c GROUP BY key)
    SELECT source, {REPORT} FROM g GROUP BY source UNION ALL SELECT NULL AS source, {REPORT} FROM t""")
def dedup_report_rollup(x):
    return ch.dedup_report(_chunks(x), "source")


@query(Z + "SELECT source, count(*) AS chunks, count(*) FILTER (zero) AS zero_chunks, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) // count(*) AS BIGINT) AS avg_chunk FROM c GROUP BY source")
def manifest_info(x):
    return ch.info(_zeros(x), "source")


PCT = {"min_size": 0.0, "p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max_size": 1.0}


@query(C + ", r AS (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM c) SELECT source, " + ", ".join(f"max(size) FILTER (i = CAST(floor({p} * (n - 1)) AS BIGINT)) AS {k}" for k, p in PCT.items()) + " FROM r GROUP BY source")
def size_distribution(x):
    return ch.percentiles(_chunks(x), ["source"], "size", {k: F.floor(F.lit(p) * (F.col("n") - 1)) for k, p in PCT.items()})


@query(C + f"SELECT source, count(*) FILTER (size = {CHUNK}) AS forced, round(count(*) FILTER (size = {CHUNK}) * 100.0 / count(*), 4) AS forced_pct FROM c GROUP BY source")
def forced_cuts(x):
    return _chunks(x).groupBy("source").agg(F.count_if(F.col("size") == CHUNK).alias("forced")).join(_chunks(x).groupBy("source").count(), "source").select("source", "forced", F.round(F.col("forced") * 100.0 / F.col("count"), 4).alias("forced_pct"))


@query(Z + "SELECT count(DISTINCT key) FILTER (NOT zero) AS stored, count(*) FILTER (NOT zero) - count(DISTINCT key) FILTER (NOT zero) AS dedup, count(*) FILTER (zero) AS zero, CAST(sum(size) AS BIGINT) AS logical_bytes, (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT min(size) AS s FROM c WHERE NOT zero GROUP BY key)) AS stored_bytes FROM c")
def ingest_result(x):
    return ch.ingest_result(_zeros(x))


@query(C + """, a AS (SELECT key, min(size) AS s FROM c WHERE lang = 'en' GROUP BY key), b AS (SELECT key, min(size) AS s FROM c WHERE lang <> 'en' GROUP BY key),
    j AS (SELECT a.key AS ka, b.key AS kb, coalesce(a.s, b.s) AS s FROM a FULL JOIN b ON a.key = b.key)
    SELECT count(*) FILTER (ka = kb) AS shared, CAST(coalesce(sum(s) FILTER (ka = kb), 0) AS BIGINT) AS shared_bytes, count(*) FILTER (kb IS NULL) AS only_a, CAST(coalesce(sum(s) FILTER (kb IS NULL), 0) AS BIGINT) AS only_a_bytes,
    count(*) FILTER (ka IS NULL) AS only_b, CAST(coalesce(sum(s) FILTER (ka IS NULL), 0) AS BIGINT) AS only_b_bytes,
    round(count(*) FILTER (ka = kb) * 1.0 / (2 * count(*) FILTER (ka = kb) + count(*) FILTER (kb IS NULL) + count(*) FILTER (ka IS NULL)), 6) AS dedup_ratio FROM j""")
def manifest_diff(x):
    c = _chunks(x)
    return ch.diff(c.where("lang = 'en'"), c.where("lang <> 'en'"))


@query(C + """, k AS (SELECT DISTINCT source AS g, key FROM c), n AS (SELECT g, count(*) AS n FROM k GROUP BY g)
    SELECT a.g AS i, b.g AS j, count(*) AS shared, count(*) * 100 // least(min(na.n), min(nb.n)) AS pct_of_smaller, round(count(*) * 1.0 / (min(na.n) + min(nb.n) - count(*)), 6) AS jaccard
    FROM k a JOIN k b ON a.key = b.key AND a.g < b.g JOIN n na ON na.g = a.g JOIN n nb ON nb.g = b.g GROUP BY a.g, b.g""")
def pairwise_matrix(x):
    return ch.pairwise(_chunks(x), "source")


@query(C + ", a AS (SELECT DISTINCT key FROM c WHERE lang = 'en'), b AS (SELECT DISTINCT key FROM c WHERE lang <> 'en') SELECT count(*) AS keys, count(*) FILTER (key IN (SELECT key FROM b)) AS kept, count(*) FILTER (key IN (SELECT key FROM b)) * 100 // count(*) AS kept_pct FROM a")
def kept_pct(x):
    c = _chunks(x)
    a = c.where("lang = 'en'").select("key").distinct()
    kept = a.join(c.where("lang <> 'en'").select(F.col("key"), F.lit(1).alias("k")).distinct(), "key", "left")
    return kept.agg(F.count("*").alias("keys"), F.count("k").alias("kept"), F.expr("count(k) * 100 div count(*)").alias("kept_pct"))


@query(C + """, k AS (SELECT DISTINCT source AS g, key FROM c), o AS (SELECT g, key, min(g) OVER (PARTITION BY key) AS f FROM k), s AS (SELECT g, count(*) AS keys, count(*) FILTER (f = g) AS new_keys FROM o GROUP BY g)
    SELECT g, keys, new_keys, CAST(sum(new_keys) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative, new_keys * 100 // keys AS marginal_pct FROM s""")
def incremental_cost(x):
    return ch.incremental(_chunks(x), "source")


@query(Z + ", o AS (SELECT DISTINCT key FROM c WHERE ordinal % 7 <> 0) SELECT count(*) FILTER (NOT zero AND key IN (SELECT key FROM o)) AS verified, count(*) FILTER (zero) AS skipped, count(*) FILTER (NOT zero AND key NOT IN (SELECT key FROM o)) AS failed, count(*) AS total FROM c")
def verify(x):
    c = _zeros(x)
    return lk.verify_objects(c.select("key", "is_zero"), c.where("ordinal % 7 <> 0").select("key", F.sha2("data", 256).alias("content_key")))


@query(C + ", r AS (SELECT DISTINCT key FROM c WHERE lang <> 'de'), h AS (SELECT DISTINCT key FROM c WHERE lang <> 'fr') SELECT coalesce(r.key, h.key) AS key, CASE WHEN h.key IS NULL THEN 'missing' ELSE 'unreferenced' END AS problem FROM r FULL JOIN h ON r.key = h.key WHERE r.key IS NULL OR h.key IS NULL")
def closure_check(x):
    c = _chunks(x)
    return lk.closure(c.where("lang <> 'de'").select("key", "size"), c.where("lang <> 'fr'").select("key", "size").dropDuplicates(["key"]))


@query(C + ", s AS (SELECT DISTINCT key FROM c WHERE lang = 'en') SELECT DISTINCT key, size FROM c WHERE lang = 'fr' AND key NOT IN (SELECT key FROM s)")
def dedup_antijoin(x):
    c = _chunks(x)
    return lk.store_new(c.where("lang = 'fr'").select("key", "size"), c.where("lang = 'en'"), ["key"])


@query(C + f""", p AS (SELECT image AS path, ordinal, sha256(data || repeat('\\x00'::BLOB, {CHUNK} - size)) AS key FROM c), f AS (SELECT key, min(path * 1000000 + ordinal) AS pos FROM p GROUP BY key),
    n AS (SELECT key, row_number() OVER (ORDER BY pos) - 1 AS physical FROM f) SELECT path, ordinal, physical FROM p JOIN n ON p.key = n.key""")
def block_dedup_plan(x):
    b = _chunks(x).select(F.col("image").alias("path"), F.col("ordinal").cast("long").alias("ordinal"), F.sha2(F.concat("data", F.unhex(F.repeat(F.lit("00"), (CHUNK - F.col("size")).cast("int")))), 256).alias("key"))
    return ch.block_plan(b)


@query("SELECT doc_id, sha256(encode(text)) AS key, sha256(encode(text))[1:2] || '/' || sha256(encode(text))[3:4] || '/' || sha256(encode(text)) AS object_path, regexp_matches(sha256(encode(text)), '^[0-9a-f]{{64}}$') AS ok FROM documents")
def content_key(x):
    k = F.sha2(F.encode("text", "utf-8"), 256)
    return x["documents"].select("doc_id", k.alias("key"), sc.object_path(k).alias("object_path"), sc.is_hex_key(k).alias("ok"))


@query("SELECT doc_id, sha256(encode(source) || encode(text)) AS key, sha256(encode('salt:' || source)) AS salt, CASE WHEN lang = 'en' THEN sha256(encode(source)) ELSE sha256(unhex(sha256(encode(source))) || encode(lang)) END AS mixed FROM documents")
def convergent_key(x):
    src, base = F.encode("source", "utf-8"), F.unhex(F.sha2(F.encode("source", "utf-8"), 256))
    extra = F.encode(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), "utf-8")
    return x["documents"].select("doc_id", ch.convergent_key(src, F.encode("text", "utf-8")).alias("key"), F.sha2(F.encode(F.concat(F.lit("salt:"), "source"), "utf-8"), 256).alias("salt"), F.lower(F.hex(ch.extra_salt(base, extra))).alias("mixed"))


@query("SELECT doc_id, sha256(encode('payload') || unhex(lpad(hex(n_chars), 16, '0')) || encode(text)) AS digest FROM documents")
def digest_identity(x):
    return x["documents"].select("doc_id", F.sha2(F.concat(F.encode(F.lit("payload"), "utf-8"), ch.be64(F.col("n_chars")), F.encode("text", "utf-8")), 256).alias("digest"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS raw, CAST(o_custkey * 37 AS BIGINT) AS enc, floor(o_totalprice) - o_custkey * 37 >= 4096 AND o_custkey * 37 <= floor(o_totalprice) * 0.75 AS beneficial FROM orders")
def compression_beneficial(x):
    o = x["orders"].select("o_orderkey", F.floor("o_totalprice").alias("raw"), (F.col("o_custkey") * 37).alias("enc"))
    return o.withColumn("beneficial", ch.beneficial(F.col("raw"), F.col("enc")))


HEX_KEY = "rpad(sha256(encode(source)), 128, '0')"


def _pad(n: int) -> str:
    return f"unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(CAST('0x' || substr({HEX_KEY}, CAST(2 * i + 1 AS INT), 2) AS INTEGER), {n}))), ''))"


CRC_STEP = "xor(h >> 1, (h & 1) * 3988292384)"


@query("WITH t AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda h, k: " + CRC_STEP + f""") AS c FROM (SELECT unnest(range(256)) AS i) b) x)
    SELECT doc_id, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(text)))) AS mac, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(text)) + 1), lambda i: CAST('0x' || hex(encode(text)[i:i]) AS BIGINT))),
    lambda h, b: xor(h >> 8, crcs[(xor(h, b) & 255) + 1])), 4294967295) AS crc FROM documents, t""")
def hmac_digest(x):
    d = F.encode("text", "utf-8")
    return x["documents"].select("doc_id", ch.hmac_sha256(F.unhex(F.sha2(F.encode("source", "utf-8"), 256)), d).alias("mac"), F.crc32(d).alias("crc"))


# --- intervals -------------------------------------------------------------------------------------------------------

ISLANDS = 'SELECT image, min(s) AS "start", max(e) AS "end"{more} FROM (SELECT *, sum(new) OVER (PARTITION BY image{more} ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY image{more} ORDER BY s) = s THEN 0 ELSE 1 END AS new FROM {src}) a) b GROUP BY image{more}, g'


@query(ISLANDS.replace("{more}", "").replace("{src}", "{holes}"))
def normalize_holes(x):
    return iv.normalize_holes(x["holes"])


@query(ISLANDS.replace("{more}", ", kind").replace("{src}", "{runs}"))
def runs_coalesce(x):
    return iv.coalesce_runs(x["runs"], "kind")


@query('SELECT p.image, p.off AS "offset", h.s AS "start", h.e AS "end" FROM {points} p LEFT JOIN {holes} h ON p.image = h.image AND p.off >= h.s AND p.off < h.e')
def hole_at(x):
    return iv.hole_at(x["points"].withColumnRenamed("off", "offset"), x["holes"], 1 << 14)


@query('SELECT p.image, p.off AS "offset", least(p.off + 50000, coalesce(min(h.s), p.off + 50000)) AS next_start FROM {points} p LEFT JOIN {holes} h ON p.image = h.image AND h.s >= p.off GROUP BY p.image, p.off')
def next_hole_start(x):
    return iv.next_hole_start(x["points"].select("image", F.col("off").alias("offset"), (F.col("off") + 50000).alias("limit")), x["holes"])


@query('SELECT p.image, p.off AS "offset", r.kind, r.chunk, least(r.e, p.off + 3000, i.size) AS run_end FROM {points} p JOIN {runs} r ON p.image = r.image AND p.off >= r.s AND p.off < r.e JOIN {images} i ON i.image = p.image')
def run_at(x):
    r = iv.lookup_runs(x["points"].withColumnRenamed("off", "offset"), x["runs"], 1 << 14).where("start is not null").join(x["images"], "image")
    return r.select("image", "offset", "kind", "chunk", iv.run_end(F.col("offset"), F.lit(3000), F.col("size"), F.col("end")).alias("run_end"))


@query("WITH k AS (SELECT * FROM {runs} WHERE NOT (image % 5 = 0 AND rn = 2)), g AS (SELECT image, s, e, lag(e) OVER (PARTITION BY image ORDER BY s) AS p FROM k) SELECT image, count(*) FILTER (s <> coalesce(p, 0)) AS problems FROM g GROUP BY image HAVING count(*) FILTER (s <> coalesce(p, 0)) > 0")
def tile_validate(x):
    kept = x["runs"].where("not (image % 5 = 0 and rn = 2)")
    last = kept.groupBy("image").agg(F.max("end").alias("size"))
    return iv.tile_violations(kept, last)


@query('WITH d AS (SELECT * FROM {runs} WHERE kind = 2), g AS (SELECT image, coalesce(lag(e) OVER (PARTITION BY image ORDER BY s), 0) AS a, s AS b FROM d UNION ALL SELECT i.image, coalesce(max(d.e), 0), i.size FROM {images} i LEFT JOIN d ON d.image = i.image GROUP BY i.image, i.size) SELECT image, a AS "start", b AS "end" FROM g WHERE b > a')
def complement(x):
    return iv.complement(x["runs"].where("kind = 2"), x["images"])


@query("""WITH cuts AS (SELECT image, s AS pos FROM {layers} UNION SELECT image, e FROM {layers}), atoms AS (SELECT image, pos, lead(pos) OVER (PARTITION BY image ORDER BY pos) AS e FROM cuts),
    seen AS (SELECT a.image, a.pos, a.e, l.layer, l.kind, l.chunk, row_number() OVER (PARTITION BY a.image, a.pos ORDER BY l.layer) AS k FROM atoms a JOIN {layers} l ON l.image = a.image AND l.s <= a.pos AND l.e >= a.e AND l.kind <> 0 WHERE a.e IS NOT NULL),
    vis AS (SELECT a.image, a.pos AS s, a.e, coalesce(v.kind, 0) AS kind, CASE WHEN v.kind = 2 THEN v.layer ELSE -1 END AS layer, CASE WHEN v.kind = 2 THEN v.chunk ELSE -1 END AS chunk
        FROM atoms a LEFT JOIN seen v ON v.image = a.image AND v.pos = a.pos AND v.k = 1 WHERE a.e IS NOT NULL),
    m AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY image, kind, layer, chunk ORDER BY s) = s THEN 0 ELSE 1 END AS new FROM vis),
    g AS (SELECT *, sum(new) OVER (PARTITION BY image, kind, layer, chunk ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT image, min(s) AS "start", max(e) AS "end", kind, layer, chunk FROM g GROUP BY image, kind, layer, chunk, g""")
def overlay(x):
    return iv.overlay(x["layers"])


@query('SELECT image, greatest(s, 4096) - 4096 AS "start", least(e, 69632) - 4096 AS "end", kind, chunk FROM {runs} WHERE greatest(s, 4096) < least(e, 69632)')
def window_clip(x):
    return iv.clip(x["runs"], F.lit(4096), F.lit(65536)).select("image", "start", "end", "kind", "chunk")


@query('SELECT image, s AS "start", e AS "end", kind FROM {runs} UNION ALL SELECT r.image, r.s + i.size, r.e + i.size, r.kind FROM {runs} r JOIN {images} i ON r.image = i.image WHERE r.rn <= 2')
def append_tail(x):
    r = x["runs"].select("image", "start", "end", "kind")
    return iv.append(r, x["runs"].where("rn <= 2").select("image", "start", "end", "kind"), x["images"])


@query("SELECT DISTINCT image, unnest(generate_series(s // 4096, (e - 1) // 4096)) AS page FROM {runs} WHERE kind = 2")
def presence_pages(x):
    return iv.presence_pages(x["runs"])


@query("""WITH p AS (SELECT image, s // 4096 AS a, (e - 1) // 4096 AS b FROM {runs} WHERE kind = 2), m AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY image ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM p),
    g AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT image, min(a) AS "first", max(b) AS "last" FROM g GROUP BY image, g""")
def presence_runs(x):
    return iv.presence_runs(x["runs"])


@query("SELECT h.image, count(*) FILTER (h.s % 4096 <> 0 OR (h.e % 4096 <> 0 AND h.e <> h.size)) AS unaligned, bool_and(h.size <= 1099511627776) AS in_limit FROM {holes} h GROUP BY h.image")
def presence_plan(x):
    return x["holes"].groupBy("image").agg(F.count_if(F.expr("start % 4096 <> 0 or (`end` % 4096 <> 0 and `end` <> size)")).alias("unaligned"), F.bool_and(F.col("size") <= (1 << 40)).alias("in_limit"))


@query("WITH p AS (SELECT DISTINCT image, unnest(generate_series(s // 4096, (e - 1) // 4096)) AS page FROM {runs} WHERE kind = 2), h AS (SELECT DISTINCT image, unnest(generate_series(s // 4096, (e - 1) // 4096)) AS page FROM {runs} WHERE kind = 2 AND rn % 2 = 1) SELECT * FROM p EXCEPT SELECT * FROM h")
def presence_missing(x):
    return iv.presence_pages(x["runs"]).join(iv.presence_pages(x["runs"].where("rn % 2 = 1")), ["image", "page"], "left_anti")


@query("SELECT image, CAST(sum(CASE WHEN kind = 2 THEN e - s ELSE 0 END) AS BIGINT) AS packed_bytes, count(*) FILTER (kind = 2) AS extents, max(e) FILTER (kind = 2) = max(e) AS dense_tail FROM {runs} GROUP BY image")
def extent_stats(x):
    return iv.extent_stats(x["runs"])


@query('SELECT image, s AS "start", e AS "end", chunk FROM {runs} WHERE kind = 2')
def prefetch_plan(x):
    return x["runs"].where(F.col("kind") == iv.DATA).select("image", "start", "end", "chunk")


@query("""WITH m AS (SELECT image, pos, sum(a) AS a, sum(b) AS b FROM (SELECT image, s AS pos, 1 AS a, 0 AS b FROM {runs} UNION ALL SELECT image, e, -1, 0 FROM {runs} UNION ALL SELECT image, s, 0, 1 FROM {holes} UNION ALL SELECT image, e, 0, -1 FROM {holes}) u GROUP BY image, pos),
    t AS (SELECT image, pos AS s, lead(pos) OVER w AS e, sum(a) OVER w AS ia, sum(b) OVER w AS ib FROM m WINDOW w AS (PARTITION BY image ORDER BY pos)), k AS (SELECT image, s, e FROM t WHERE ia > 0 AND ib = 0 AND e > s) """ + ISLANDS.replace("{more}", "").replace("{src}", "k"))
def interval_difference(x):
    return iv.subtract(x["runs"], x["holes"])


# --- look-ups, store, retention --------------------------------------------------------------------------------------


@query("SELECT k AS key, 'g' || CAST(max(ord) AS VARCHAR) AS generation, max(ord) AS ord, arg_max(size, ord) AS size FROM {objects} GROUP BY k")
def generation_lookup(x):
    return lk.generation_lookup(_objects(x))


@query("SELECT l_orderkey AS key, max(l_linenumber) FILTER (l_partkey % 4 <> 0) AS ord, coalesce(arg_max(CASE l_partkey % 4 WHEN 1 THEN 'hit' WHEN 2 THEN 'error' ELSE 'hit' END, l_linenumber * 1000000 + l_partkey) FILTER (l_partkey % 4 <> 0), 'miss') AS outcome FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) t GROUP BY l_orderkey")
def generation_search(x):
    a = x["lineitem"].groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ord")).agg((F.max("l_partkey") % 4).alias("k"))
    outcome = F.when(F.col("k") == 0, "miss").when(F.col("k") == 2, "error").otherwise("hit")
    return lk.generation_search(a.select("key", "ord", outcome.alias("outcome")))


def _objects(x):
    return x["objects"].select(F.col("k").alias("key"), F.concat(F.lit("g"), F.col("ord").cast("string")).alias("generation"), "ord", "size")


@query("SELECT ord, count(*) FILTER (size % 2 = 0) AS chunks, count(*) FILTER (size % 2 = 1) AS manifests FROM {objects} GROUP BY ord")
def generation_stats_pivot(x):
    part = F.when(F.col("size") % 2 == 0, "chunks").otherwise("manifests")
    return x["objects"].withColumn("p", part).groupBy("ord").pivot("p", ["chunks", "manifests"]).count().select("ord", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "manifests")))


@query("SELECT k AS key, ord FROM {objects} WHERE ord <> 2")
def purge_generation(x):
    return lk.purge(_objects(x), F.lit("g2")).select("key", "ord")


CASCADE = "SELECT event_id AS lookup, min(tier) FILTER (outcome <> 'miss') AS tier, coalesce(arg_min(outcome, tier) FILTER (outcome <> 'miss'), 'miss') AS outcome FROM {probes} GROUP BY event_id"


@query(f"SELECT *, CAST(CASE outcome WHEN 'hit' THEN tier WHEN 'miss' THEN 3 ELSE 0 END AS BIGINT) AS fills FROM ({CASCADE}) c")
def tier_cascade(x):
    return lk.tier_cascade(x["probes"].withColumnRenamed("event_id", "lookup"))


@query(f"SELECT lookup, CAST(unnest(range(CASE outcome WHEN 'hit' THEN tier WHEN 'miss' THEN 3 ELSE 0 END)) AS INT) AS fill_tier FROM ({CASCADE}) c")
def fill_set(x):
    return lk.fill_set(lk.tier_cascade(x["probes"].withColumnRenamed("event_id", "lookup")))


STATE = "CASE outcome WHEN 'hit' THEN 'ok' WHEN 'error' THEN 'malformed' ELSE 'unavailable' END"


@query(f"SELECT event_id AS root, min(tier) FILTER ({STATE} <> 'unavailable') AS ord, coalesce(arg_min({STATE}, tier) FILTER ({STATE} <> 'unavailable'), 'missing') AS state FROM {{probes}} GROUP BY event_id")
def source_select(x):
    return lk.source_select(x["probes"].select(F.col("event_id").alias("root"), F.col("tier").alias("ord"), F.expr(STATE).alias("state")))


NOW = "TIMESTAMP '1998-01-01 00:00:00'"


@query(f"""SELECT o_custkey, imported, digest FROM (SELECT o_custkey, o_orderdate AS imported, o_orderkey AS digest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
    FROM orders WHERE o_orderdate <= {NOW} AND (o_orderkey % 3 <> 0 OR {NOW} < o_orderdate + INTERVAL 400 DAY)) t WHERE k = 1""")
def referrer_top1(x):
    r = x["orders"].select("o_custkey", F.col("o_orderdate").alias("imported"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 400 day")).alias("expires"), F.col("o_orderkey").alias("digest"))
    return lk.latest_valid(r, ["o_custkey"], F.expr(NOW).cast(r.schema["imported"].dataType)).select("o_custkey", "imported", "digest")


@query(f"""WITH t AS (SELECT o_custkey AS g, o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS mtime, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey) AS total FROM orders),
    e AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY g ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE mtime <= {NOW} - INTERVAL 5 MINUTE)
    SELECT g, path, size FROM e WHERE total - before > 500000""")
def lru_evict(x):
    b = x["orders"].select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"))
    return lk.lru_evict(b, "g", F.expr(NOW).cast(b.schema["mtime"].dataType), F.lit(500000)).select("g", "path", "size")


@query("SELECT s_suppkey AS id, 'added' AS change FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'removed' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0")
def membership_diff(x):
    s = x["supplier"].select(F.col("s_suppkey").alias("id"))
    return lk.membership_diff(s.where("id % 3 = 0"), s.where("id % 5 = 0"))


@query("WITH e AS (SELECT image, rn, kind, chunk FROM {runs}), z AS (SELECT image, rn, row_number() OVER (PARTITION BY image ORDER BY rn) AS n FROM e WHERE kind = 2) SELECT e.image, e.rn, e.kind, CASE WHEN z.n IS NOT NULL THEN z.n * 10 END AS key_no FROM e LEFT JOIN z ON e.image = z.image AND e.rn = z.rn")
def entry_key_zip(x):
    """The i-th entry that is not zero takes the i-th key of the image's key table."""
    nth = F.when(F.col("kind") == iv.DATA, F.sum((F.col("kind") == iv.DATA).cast("long")).over(Window.partitionBy("image").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    e = x["runs"].select("image", "rn", "kind", nth.alias("n"))
    keys = e.where("n is not null").select("image", "n", (F.col("n") * 10).alias("key_no"))
    return e.join(keys, ["image", "n"], "left").select("image", "rn", "kind", "key_no")


# --- statistics ------------------------------------------------------------------------------------------------------

BUCKET = "CASE " + " ".join(f"WHEN greatest(ns, 0) <= {b} THEN {i}" for i, b in enumerate(st.BOUNDS)) + f" ELSE {len(st.BOUNDS)} END"
HIST = f"SELECT event_type, {BUCKET} AS bucket, count(*) AS n, max(greatest(ns, 0)) AS top FROM {{access}} GROUP BY event_type, {BUCKET}"


@query(HIST)
def latency_hist(x):
    return st.histogram(x["access"], ["event_type"], "ns")


@query(f"""WITH h AS ({HIST}), w AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY event_type) AS total, max(top) OVER (PARTITION BY event_type) AS peak FROM h),
    t AS (SELECT *, greatest(total * 990 // 1000, 1) AS target FROM w), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS k FROM t WHERE cum >= target),
    b AS (SELECT *, {[0, *st.BOUNDS]}[bucket + 1] AS lo, CASE WHEN bucket < {len(st.BOUNDS)} THEN {st.BOUNDS}[bucket + 1] ELSE peak END AS hi FROM f WHERE k = 1)
    SELECT event_type, CAST(least(lo + (hi - lo) * (target - (cum - n)) // n, peak) AS BIGINT) AS value FROM b""")
def hist_percentile(x):
    return st.histogram_percentile(st.histogram(x["access"], ["event_type"], "ns"), ["event_type"], 990)


@query("WITH s AS (SELECT user_id, event_id, sum(bytes) OVER w AS c, ns FROM {access} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), d AS (SELECT user_id, event_id, c - lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS c, ns FROM s) SELECT user_id, event_id, CAST(c AS BIGINT) AS c, ns FROM d WHERE c IS NOT NULL")
def counter_delta(x):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = x["access"].select("user_id", "event_id", F.sum("bytes").over(w).alias("c"), "ns")
    return st.counter_deltas(s, ["user_id"], "event_id", ["c"], ["ns"])


RATES = "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS ops, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) * 1000 // count(*) AS hit_milli, CAST(sum(bytes) AS BIGINT) AS bytes, round(count(*) / 3600, 6) AS ops_per_s FROM {access} GROUP BY 1"


@query(RATES)
def windowed_rates(x):
    return st.window_rates(x["access"], "ts", "1 hour", 3600)


@query("WITH g AS (SELECT event_type AS tier, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM {access} GROUP BY event_type) SELECT tier, hits, CAST(hits * 1000000 // sum(hits) OVER () AS BIGINT) AS share_ppm FROM g")
def hit_share(x):
    return st.hit_share(x["access"].select(F.col("event_type").alias("tier"), F.col("hit").cast("int").alias("h")), "tier", "h")


BENCH = {"p50": "n * 50 // 100", "p99": "n * 99 // 100", "p999": "n * 999 // 1000"}


@query("WITH r AS (SELECT event_type, ns, row_number() OVER (PARTITION BY event_type ORDER BY ns) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {access}) SELECT event_type, " + ", ".join(f"max(ns) FILTER (i = {e}) // 1000 AS {k}" for k, e in BENCH.items()) + " FROM r GROUP BY event_type")
def bench_percentiles(x):
    p = ch.percentiles(x["access"], ["event_type"], "ns", {k: F.expr(e.replace("//", "div")) for k, e in BENCH.items()})
    return p.select("event_type", *(F.expr(f"{k} div 1000").alias(k) for k in BENCH))


@query("SELECT event_type, round(median(ns), 3) AS median_ns FROM {access} GROUP BY event_type")
def trial_medians(x):
    """The mean of the two middle values (one twice if their number is odd), by counts of equal values."""
    m = ch.percentiles(x["access"], ["event_type"], "ns", {"a": F.expr("(n - 1) div 2"), "b": F.expr("n div 2")})
    return m.select("event_type", F.round((F.col("a") + F.col("b")) / 2, 3).alias("median_ns"))


@query("SELECT user_id, count(*) FILTER (event_id % 5 = 0) AS hits, count(*) FILTER (event_id % 5 = 1) AS misses, count(*) FILTER (event_id % 5 = 2) AS errors, count(*) FILTER (event_id % 5 = 3) AS fills, count(*) FILTER (event_id % 5 = 4) AS cancelled FROM {access} GROUP BY user_id")
def peer_stats(x):
    kinds = ["hits", "misses", "errors", "fills", "cancelled"]
    k = F.element_at(F.lit(kinds), (F.col("event_id") % 5 + 1).cast("int"))
    return x["access"].withColumn("k", k).groupBy("user_id").pivot("k", kinds).count().select("user_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in kinds))


KEYS = "event_type || ':' || CAST(event_id % 211 AS VARCHAR(9))"
WIDTH = 1 << 16
SEEDS = ", ".join(str(st.BASIS_LOW ^ x) for x in st.SEEDS)
CMS = f"""WITH t AS (SELECT {KEYS} AS k FROM {{access}}), d AS (SELECT DISTINCT k FROM t), c AS (SELECT k, r, list_reduce(list_prepend(CAST([{SEEDS}][r + 1] AS BIGINT),
    list_transform(string_split(k, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, x: (xor(h, x) * {st.PRIME_LOW}) % 4294967296) % {WIDTH} AS idx FROM d, (SELECT unnest(range(4)) AS r) n),
    s AS (SELECT r, idx, least(count(*), 15) AS n FROM c JOIN t USING (k) GROUP BY r, idx), e AS (SELECT k, min(n) AS estimate FROM c JOIN s USING (r, idx) GROUP BY k) """


def _estimates(x):
    a = x["access"].select(F.expr(KEYS.replace("VARCHAR(9)", "STRING")).alias("k"))
    return st.cms_estimate(a.distinct(), "k", st.cms_counts(a, "k", 4, WIDTH, st.sketch_cell), 4, WIDTH, st.sketch_cell)


@query(CMS + "SELECT k, estimate FROM e")
def cms_exact(x):
    return _estimates(x)


@query(CMS + "SELECT k FROM e WHERE estimate <= 10")
def should_evict(x):
    return _estimates(x).where("estimate <= 10").select("k")


@query("""WITH RECURSIVE t AS (SELECT event_type, user_id, bytes, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM {access}),
    g AS (SELECT event_type, user_id, i, CAST(0 AS BIGINT) AS gen, CAST(1 AS BIGINT) AS n, bytes AS b FROM t WHERE i = 1
        UNION ALL SELECT t.event_type, t.user_id, t.i, g.gen + CASE WHEN g.n >= 40 OR g.b >= 3000 THEN 1 ELSE 0 END, CASE WHEN g.n >= 40 OR g.b >= 3000 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n >= 40 OR g.b >= 3000 THEN t.bytes ELSE g.b + t.bytes END
        FROM g JOIN t ON t.event_type = g.event_type AND t.i = g.i + 1),
    a AS (SELECT event_type, max(gen) + max(CASE WHEN n >= 40 OR b >= 3000 THEN 1 ELSE 0 END) AS act FROM g x WHERE i = (SELECT max(i) FROM g y WHERE y.event_type = x.event_type) GROUP BY event_type)
    SELECT event_type, user_id, least(count(*) FILTER (gen = act), 15) + least(count(*) FILTER (gen = act - 1), 15) // 2 AS estimate FROM g JOIN a USING (event_type) GROUP BY event_type, user_id""")
def sketch_turnover(x):
    return st.turnover_estimate(x["access"], "event_type", "user_id", "event_id", "bytes", 40, 3000)


@query("WITH r AS (SELECT user_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS gen FROM {access}), a AS (SELECT count(*) // 300 AS act FROM {access}) SELECT user_id, least(count(*) FILTER (gen = act), 15) + least(count(*) FILTER (gen = act - 1), 15) // 2 AS estimate FROM r, a GROUP BY user_id")
def sketch_rotation(x):
    return st.rotated_estimate(x["access"], "user_id", "event_id", 300)


@query("WITH c AS (SELECT event_type, ts, sum(bytes) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM {access}), d AS (SELECT event_type, c - lag(c) OVER w AS d, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS t FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, c)) SELECT event_type, round(avg(d / t), 6) AS mean_rate, round(max(d / t), 6) AS peak_rate FROM d WHERE t > 0 GROUP BY event_type")
def proc_rates(x):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    a = x["access"].select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.sum("bytes").over(w).alias("c"))
    return st.rates_from_counters(a, ["event_type"], "ts", "c")


# --- paths -----------------------------------------------------------------------------------------------------------

RULES = "SELECT DISTINCT split_part(path, '/', 1) AS pattern, true AS is_dir, 1 AS ord FROM {files} UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), true, 2 FROM {files} WHERE p_size % 2 = 0 UNION ALL SELECT path, false, 3 FROM {files} WHERE p_size = 7 UNION ALL SELECT '', true, 4"


def _rules(x):
    f = x["files"]
    top, second = F.split_part("path", F.lit("/"), F.lit(1)), F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2)))
    rows = [f.select(top.alias("pattern"), F.lit(True).alias("is_dir"), F.lit(1).alias("ord")).distinct(), f.where("p_size % 2 = 0").select(second.alias("pattern"), F.lit(True).alias("is_dir"), F.lit(2).alias("ord")).distinct()]
    rows += [f.where("p_size = 7").select(F.col("path").alias("pattern"), F.lit(False).alias("is_dir"), F.lit(3).alias("ord")), f.sparkSession.sql("SELECT '' AS pattern, true AS is_dir, 4 AS ord")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"""WITH r AS ({RULES}), j AS (SELECT f.path, r.pattern, r.ord, row_number() OVER (PARTITION BY f.path ORDER BY NOT is_dir DESC, length(pattern) DESC, ord) AS k
    FROM {{files}} f JOIN r ON (r.is_dir AND (r.pattern = '' OR f.path = r.pattern OR starts_with(f.path, r.pattern || '/'))) OR f.path = r.pattern) SELECT path, pattern, ord FROM j WHERE k = 1""")
def rule_match(x):
    return pt.match_rules(x["files"], _rules(x))


@query("WITH x AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS p FROM {files} WHERE p_size = 3) SELECT path FROM {files} f WHERE NOT EXISTS (SELECT 1 FROM x WHERE f.path = x.p OR starts_with(f.path, x.p || '/'))")
def ancestor_exclude(x):
    gone = x["files"].where("p_size = 3").select(F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))).alias("path")).distinct()
    return pt.exclude(x["files"].select("path"), gone)


@query("SELECT 'd' || CAST(l_partkey % 40 AS VARCHAR) || '/p' || CAST(l_partkey AS VARCHAR) AS path, l_orderkey % 7 AS image, max(l_linenumber) AS layer FROM lineitem GROUP BY 1, 2 HAVING NOT (max(l_linenumber) < 4 AND min(l_orderkey % 7) < 3 AND min(l_partkey % 40) = 1)")
def layer_last_wins(x):
    """Later layers replace; layer 4 of images 0 to 2 has a whiteout of the folder d1."""
    e = x["lineitem"].select((F.col("l_orderkey") % 7).alias("image"), F.col("l_linenumber").alias("layer"), F.format_string("d%d/p%d", F.col("l_partkey") % 40, "l_partkey").alias("path")).distinct()
    marks = e.sparkSession.sql("SELECT explode(array(0L, 1L, 2L)) AS image, 4 AS layer, '.wh.d1' AS path")
    return pt.apply_layers(e.unionByName(marks)).select("path", "image", "layer")


@query("SELECT path, min(path) OVER (PARTITION BY p_size, id % 11) AS canonical, path <> min(path) OVER (PARTITION BY p_size, id % 11) AS is_link FROM {files}")
def hardlink_canonical(x):
    return pt.hard_links(x["files"].select("path", F.col("p_size").alias("dev"), (F.col("id") % 11).alias("ino")))


@query("SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+:', ''), '/'), lambda p: p <> '' AND p <> '.'), '/') AS path FROM pages")
def normalize_path(x):
    return x["pages"].select("page_id", pt.normalize_path(F.regexp_replace("url", "^[a-z]+:", "")).alias("path"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_keys(props)[1] AS first_key FROM events")
def json_project(x):
    return x["events"].select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.element_at(F.json_object_keys("props"), 1).alias("first_key"))


# --- placement -------------------------------------------------------------------------------------------------------


@query()
def placement_locate(x):
    """Three places of each part among all suppliers; the table has a fixed size and is made once."""
    members = [r[0] for r in x["supplier"].select("s_name").collect()]
    by_slot, names = pl.places_by_slot(pl.placement_table(members), min(3, len(members))), np.array(sorted(members), object)

    @F.pandas_udf("array<string>")
    def places(keys: pd.Series) -> pd.Series:
        return pd.Series(list(names[by_slot[(pl.fnv1a_column(keys) % np.uint64(pl.SLOTS)).astype("int64")]]))

    return x["part"].select("p_partkey", places("p_name").alias("places"))


@query("SELECT p_partkey, text AS restored FROM part JOIN documents ON p_partkey = doc_id")
def rs_roundtrip(x):
    """Texts through four data shards and one of parity, with one lost."""
    @F.pandas_udf("string")
    def back(texts: pd.Series) -> pd.Series:
        out = []
        for i, t in enumerate(texts):
            shards = dict(enumerate(pl.rs_encode(t.encode())))
            del shards[i % 5]
            out.append(pl.rs_decode(shards).decode())
        return pd.Series(out)

    return x["part"].join(x["documents"], F.col("p_partkey") == F.col("doc_id")).select("p_partkey", back("text").alias("restored"))


CLASS = "SELECT k, peer, idx, CASE WHEN outcome = 'miss' THEN 'miss' WHEN idx >= 5 THEN 'invalid' WHEN row_number() OVER (PARTITION BY k, idx, outcome = 'shard' AND idx < 5 ORDER BY peer) > 1 THEN 'duplicate' ELSE 'valid' END AS kind FROM {answers}"


@query(f"SELECT kind, count(*) AS n FROM ({CLASS}) c GROUP BY kind")
def shard_classify(x):
    return pl.classify_shards(x["answers"].withColumnRenamed("k", "key"), F.lit(5)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({CLASS}), m AS (SELECT k, i AS idx, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM (SELECT DISTINCT k FROM c) a, (SELECT unnest(range(5)) AS i) r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = a.k AND c.idx = i AND c.kind = 'valid')),
    p AS (SELECT k, peer, row_number() OVER (PARTITION BY k ORDER BY peer) AS n FROM (SELECT DISTINCT k, peer FROM c WHERE kind = 'miss') d), ok AS (SELECT k FROM (SELECT k, max(n) AS a FROM m GROUP BY k) x JOIN (SELECT k, max(n) AS b FROM p GROUP BY k) y USING (k) WHERE a = b)
    SELECT m.k AS key, CAST(m.idx AS INT) AS idx, p.peer FROM m JOIN p ON m.k = p.k AND m.n = p.n WHERE m.k IN (SELECT k FROM ok)""")
def repair_plan(x):
    return pl.repair_plan(pl.classify_shards(x["answers"].withColumnRenamed("k", "key"), F.lit(5)), 5)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id % 97 AS epoch, max(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) e WHERE top IS NULL OR epoch > top")
def epoch_monotonic(x):
    """Membership updates that are taken: those with a higher epoch than all before."""
    before = F.max("epoch").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = x["events"].select("user_id", "event_id", (F.col("event_id") % 97).alias("epoch")).withColumn("top", before)
    return e.where("top is null or epoch > top").select("user_id", "event_id")


# --- scalars ---------------------------------------------------------------------------------------------------------

SIZES = "CAST(p_size AS VARCHAR(9)) || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'KiB' WHEN 2 THEN 'MB' WHEN 3 THEN 'g' ELSE ' TiB' END"


@query(f"SELECT p_partkey, {SIZES} AS s, CAST(p_size * pow(1024, p_partkey % 5) AS BIGINT) AS n FROM part")
def parse_size(x):
    s = F.expr(SIZES.replace("VARCHAR(9)", "STRING"))
    return x["part"].select("p_partkey", s.alias("s"), sc.parse_size(s).alias("n"))


@query("SELECT o_orderkey, CASE WHEN v >= 1048576 THEN printf('%.1f MiB', v / 1048576.0) WHEN v >= 1024 THEN printf('%.1f KiB', v / 1024.0) ELSE CAST(v AS VARCHAR) || ' B' END AS s FROM (SELECT o_orderkey, o_orderkey * 37 AS v FROM orders) t")
def format_size(x):
    return x["orders"].select("o_orderkey", sc.format_size(F.col("o_orderkey") * 37).alias("s"))


REF = "CASE o_orderkey % 4 WHEN 0 THEN 'manifest://' || repeat('ab', 32) WHEN 1 THEN 'file:///var/x.' || CAST(o_orderkey AS VARCHAR(20)) WHEN 2 THEN 'file://b@digest:' || repeat('0f', 32) || '@location:n.' || CAST(o_custkey AS VARCHAR(20)) ELSE 'plain' END"


@query(f"SELECT o_orderkey, nullif(regexp_extract(r, '^(manifest|file)://', 1), '') AS scheme, CASE WHEN r LIKE '%://%' THEN regexp_extract(r, '://([^@]*)', 1) END AS path, nullif(regexp_extract(r, '@location:(.*)$', 1), '') AS location, CASE WHEN r LIKE '%://%' THEN r LIKE 'manifest%' OR r LIKE '%@location:%' END AS portable FROM (SELECT o_orderkey, {REF} AS r FROM orders) t")
def parse_ref(x):
    r = x["orders"].select("o_orderkey", sc.parse_ref(F.expr(REF.replace("VARCHAR(20)", "STRING"))).alias("r"))
    return r.select("o_orderkey", *(F.col(f"r.{c}").alias(c) for c in ("scheme", "path", "location", "portable")))


@query("SELECT p_partkey, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS pow2, p_partkey * 100 - CASE WHEN p_partkey * 100 - (p_partkey * 100) % 4096 < 8192 THEN 0 ELSE (p_partkey * 100) % 4096 END AS aligned, 250 * CAST(pow(2, p_size % 6) AS BIGINT) AS delay_ms, (p_size // 10) * 8 + p_size % 8 AS mode FROM part")
def small_numbers(x):
    p = F.col("p_partkey")
    mode = sc.parse_mode(F.concat(F.expr("p_size div 10").cast("string"), (F.col("p_size") % 8).cast("string")))
    octal = F.expr("p_size div 10") * 8 + F.col("p_size") % 8
    return x["part"].select("p_partkey", sc.next_pow2(F.col("p_size")).alias("pow2"), sc.align_down(p * 100, 8192).alias("aligned"), sc.retry_delay_ms(F.col("p_size") % 6 + 1).alias("delay_ms"), F.coalesce(mode, octal).alias("mode"))


@query("SELECT event_id, CASE WHEN v >= 1000000 THEN printf('%.1fms', v / 1000000.0) WHEN v >= 1000 THEN printf('%.1fus', v / 1000.0) ELSE CAST(v AS VARCHAR) || 'ns' END AS t, CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1000000.0) WHEN v >= 1000 THEN printf('%.1fk', v / 1000.0) ELSE CAST(v AS VARCHAR) END AS n, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS lasting FROM (SELECT *, (event_id * 2026 + 1) % 900000001 AS v FROM {access}) a")
def format_times(x):
    v = (F.col("event_id") * 2026 + 1) % 900000001
    return x["access"].select("event_id", sc.format_ns(v).alias("t"), sc.format_count(v).alias("n"), fm.is_permanent(F.element_at(F.lit(["not_found", "timeout", "eof", "corrupt", "not_found", "eof"]), (F.col("event_id") % 6 + 1).cast("int")), F.when(F.col("event_id") % 6 == 1, False).when(F.col("event_id") % 6 == 4, True)).alias("lasting"))


# --- content-defined chunks, physical forms, reads -------------------------------------------------------------------

CDC_SIZES = (4096, 16384, 65536)


def _segments(x: Inputs) -> DataFrame:
    """Images of the texts of 64 neighbouring documents each, as one segment."""
    d = x["documents"].select(F.expr("doc_id div 64").alias("image"), "doc_id", F.encode("text", "utf-8").alias("t"))
    return d.groupBy("image").agg(F.expr("listagg(t) WITHIN GROUP (ORDER BY doc_id)").alias("data")).select("image", F.lit(0).alias("segment"), F.lit(0).cast("long").alias("start"), "data")


@query()
def chunk_cdc(x):
    return cdc.content_defined(_segments(x), CDC_SIZES).select("image", "ordinal", "start", "size", "key")


@query("SELECT doc_id // 64 AS image, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size FROM {documents} GROUP BY doc_id // 64")
def cdc_tiles(x):
    """Content-defined chunks follow each other without gaps: the sum of their sizes, where each starts at the sum before."""
    c = cdc.content_defined(_segments(x), CDC_SIZES)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("image").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("ok", F.col("start") == before).where("ok").groupBy("image").agg(F.sum("size").alias("size"))


@query()
def cdc_quality(x):
    c = cdc.content_defined(_segments(x), CDC_SIZES)
    return cdc.quality(c.withColumn("parity", F.col("image") % 2), "parity", CDC_SIZES)


@query("SELECT doc_id, sha256(encode(text)) AS restored, sha256(encode('salt') || encode(text)) AS chunk_key FROM {documents} WHERE octet_length(encode(text)) > 0")
def chunk_objects(x):
    """Texts through the physical form of chunks and back."""
    d = x["documents"].select("doc_id", F.encode("text", "utf-8").alias("data")).where("octet_length(data) > 0").withColumn("size", F.octet_length("data").cast("long"))
    back = ob.decode_chunks(ob.encode_chunks(d, F.lit(b"salt")).drop("data"))
    return back.select("doc_id", F.sha2("data", 256).alias("restored"), F.lower(F.hex("chunk_key")).alias("chunk_key"))


@query("SELECT doc_id, sha256(encode(text)) AS restored FROM {documents}")
def key_table_seal(x):
    """Texts sealed under a key of their source, with their language as what they belong to, and back."""
    key, d, a = F.unhex(F.sha2(F.encode("source", "utf-8"), 256)), F.encode("text", "utf-8"), F.encode("lang", "utf-8")
    s = x["documents"].select("doc_id", key.alias("k"), a.alias("a"), ob.seal(key, d, a).alias("s"))
    return s.select("doc_id", F.sha2(ob.unseal(F.col("k"), F.col("s"), F.col("a")), 256).alias("restored"))


@query(C + """SELECT image, CASE WHEN ordinal % 5 = 3 THEN 'hole' WHEN ordinal % 5 = 1 THEN 'zero' ELSE 'data' END AS kind, ordinal * 512 AS "start", size, CASE WHEN ordinal % 5 NOT IN (1, 3) THEN key END AS object_key FROM c""")
def manifest_codec(x):
    """Manifests of the fixed chunks of documents, some of them zero and some holes, in their binary form and back."""
    c = _chunks(x).select("image", F.col("start").cast("long").alias("start"), "size", (F.col("ordinal") % 5 == 1).alias("is_zero"), (F.col("ordinal") % 5 == 3).alias("hole"), F.col("key").alias("object_key"))
    images = c.groupBy("image").agg(F.lit(2).alias("mode"), F.sum("size").alias("size"), F.lit(CHUNK).alias("least"), F.lit(CHUNK).alias("largest"))
    holes = c.where("hole").select("image", "start", (F.col("start") + F.col("size")).alias("end"))
    m = ob.decode_manifests(ob.encode_manifests(images, c.where("not hole").drop("hole"), holes))
    e = m.select("image", F.explode("m.entries").alias("e")).select("image", F.when(F.col("e.is_zero"), "zero").otherwise("data").alias("kind"), "e.start", "e.size", "e.object_key")
    h = m.select("image", F.explode("m.holes").alias("h")).select("image", F.lit("hole").alias("kind"), "h.start", (F.col("h.end") - F.col("h.start")).alias("size"), F.lit(None).cast("string").alias("object_key"))
    return e.unionByName(h)


@query(C + """, q AS (SELECT doc_id AS request, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id * 37 % 1500 AS a, doc_id * 37 % 1500 + 700 AS b FROM documents),
    p AS (SELECT q.request, greatest(c.ordinal * 512, q.a) AS s, least(c.ordinal * 512 + c.size, q.b) AS e, c.ordinal, c.data FROM q JOIN c ON c.image = q.request AND c.ordinal * 512 < q.b AND c.ordinal * 512 + c.size > q.a),
    h AS (SELECT request, sum(e - s) AS n, string_agg(CASE WHEN ordinal % 3 = 1 THEN repeat('00', CAST(e - s AS INT)) ELSE hex(data[s - ordinal * 512 + 1:e - ordinal * 512]) END, '' ORDER BY s) AS h FROM p GROUP BY request)
    SELECT q.request, CAST(coalesce(h.n, 0) AS BIGINT) AS n, coalesce(h.h, '') AS h FROM q LEFT JOIN h ON h.request = q.request""")
def read_ranges(x):
    """Reads of 700 bytes of each document, of whose chunks every third is a hole."""
    c = _chunks(x).withColumn("chunk", F.concat_ws(":", "image", "ordinal"))
    runs = c.select("image", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).alias("end"), F.when(F.col("ordinal") % 3 == 1, iv.HOLE).otherwise(iv.DATA).alias("kind"), "chunk", F.col("start").cast("long").alias("chunk_start"))
    d = x["documents"].select(F.col("doc_id").alias("image"), F.octet_length(F.encode("text", "utf-8")).cast("long").alias("size"))
    q = d.select(F.col("image").alias("request"), "image", (F.col("image") * 37 % 1500).alias("offset"), F.lit(700).cast("long").alias("length"))
    r = rd.read_at(q, runs, d, c.select("chunk", "data"), 4096)
    return r.select("request", "n", F.hex("data").alias("h"))


@query("""WITH a AS (SELECT DISTINCT image - image % 3 AS image, off FROM {points}), t AS (SELECT a.image, a.off, l.layer, l.kind, l.s, l.e, row_number() OVER (PARTITION BY a.image, a.off ORDER BY l.layer) AS k
    FROM a JOIN {layers} l ON l.image = a.image AND l.s <= a.off AND l.e > a.off AND l.kind <> 0), d AS (SELECT * FROM t WHERE k = 1 AND kind = 2)
    SELECT d.image, d.off AS "offset", d.layer, d.s AS chunk, CASE WHEN d.e - d.s > 16384 THEN d.off ELSE greatest(d.s, coalesce(max(u.e) FILTER (u.e <= d.off), 0)) END AS "start", least(d.e, coalesce(min(u.s) FILTER (u.s > d.off), d.e)) AS "end"
    FROM d LEFT JOIN {layers} u ON u.image = d.image AND u.layer < d.layer AND u.kind <> 0 GROUP BY d.image, d.off, d.layer, d.s, d.e""")
def chunk_window(x):
    l = x["layers"].withColumn("chunk", F.col("start"))
    anchors = x["points"].select((F.col("image") - F.col("image") % 3).alias("image"), F.col("off").alias("offset")).distinct()
    chunks = l.where(F.col("kind") == iv.DATA).select("image", "layer", "chunk", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"))
    return rd.chunk_windows(anchors, iv.overlay(l), chunks, 16384, 1 << 14)


@query("SELECT image, s AS \"start\", CASE WHEN kind = 2 THEN 'data' WHEN kind = 0 AND e - s >= 4096 THEN 'skip' ELSE 'zeros' END AS write FROM {runs}")
def hole_fill(x):
    return rd.fill_holes(x["runs"], punch=True).select("image", "start", "write")


@query(RATES)
def windowed_rates_stream(x):
    """`windowed_rates` as a stream over the same file, run until it is drained."""
    s = x.spark.readStream.schema(x["events"].schema).option("pathGlobFilter", "events*.parquet").parquet(x.dir)
    a = s.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0).alias("hit"), F.floor(F.col("value") * 10).cast("long").alias("bytes"))
    return sr.drain(x.spark, sr.rates(a, "ts", "1 hour", 3600, "1 hour")).withColumn("window_start", F.col("window_start").cast(x["events"].schema["ts"].dataType))


@query("SELECT l.event_id, max(r.event_id) FILTER (r.ts = l.m) AS matched FROM (SELECT a.event_id, a.user_id, max(b.ts) AS m FROM {access} a LEFT JOIN {access} b ON b.user_id = a.user_id AND b.event_id % 2 = 1 AND b.ts <= a.ts WHERE a.event_id % 2 = 0 GROUP BY a.event_id, a.user_id) l LEFT JOIN {access} r ON r.user_id = l.user_id AND r.event_id % 2 = 1 AND r.ts = l.m GROUP BY l.event_id")
def as_of_join(x):
    a = x["access"].select("event_id", "user_id", "ts")
    return lk.as_of(a.where("event_id % 2 = 0"), a.where("event_id % 2 = 1"), ["user_id"], "ts", "event_id").select("event_id", "matched")


@query("SELECT o_orderkey AS request, CASE WHEN o_orderkey % 7 = 5 THEN NULL WHEN o_orderkey % 7 = 6 THEN 'g4' ELSE 'g' || CAST(o_orderkey % 7 AS VARCHAR) END AS admitted, o_orderkey % 7 = 5 AS refused FROM {orders}")
def admit_write(x):
    g = x["objects"].select(F.concat(F.lit("g"), F.col("ord").cast("string")).alias("generation"), "ord").distinct()
    name = F.when(F.col("o_orderkey") % 7 == 6, "").otherwise(F.concat(F.lit("g"), (F.col("o_orderkey") % 7).cast("string")))
    return lk.admit(x["orders"].select(F.col("o_orderkey").alias("request"), name.alias("generation")), g)


@query("SELECT DISTINCT 'g' || CAST(ord AS VARCHAR) AS generation, ord FROM {objects} UNION ALL SELECT 'next', max(ord) + 1 FROM {objects}")
def generation_append(x):
    g = x["objects"].select(F.concat(F.lit("g"), F.col("ord").cast("string")).alias("generation"), "ord").distinct()
    return lk.append_generation(g, "next")


# --- small formats ---------------------------------------------------------------------------------------------------


def _pick(n: str, items: list) -> str:
    """SQL of the n-th of some strings, in both engines."""
    return "CASE " + n + " " + " ".join(f"WHEN {i} THEN {x!r}" for i, x in enumerate(items)) + " END"


RULES_OF = ["a/b.txt", "a:b", "a:-", "d/", "/d/:o/", "d/:", ":o/", "a/b:", "./d/:o/x/", "../x", "d/:-", ":x", "a:b/", "/"]
PARSED = [("a/b.txt", "a/b.txt", False), ("a", "b", False), ("a", "-", False), ("d", "d", True), ("d", "o", True), ("d", ".", True), ("", "o", True), ("a/b", "b", False), ("d", "o/x", True)] + [(None, None, None)] * 5


@query("SELECT p_partkey, rule, tar, fs, prefix FROM (SELECT p_partkey, p_partkey % 14 AS i FROM part) p JOIN (VALUES " + ", ".join(f"({i}, '{r}', {'NULL' if t is None else repr(t)}, {'NULL' if f is None else repr(f)}, {'NULL' if p is None else p})" for i, (r, (t, f, p)) in enumerate(zip(RULES_OF, PARSED))) + ") r(i, rule, tar, fs, prefix) USING (i)")
def parse_rule(x):
    r = x["part"].select("p_partkey", F.expr(_pick("p_partkey % 14", RULES_OF)).alias("rule"))
    return r.withColumn("r", fm.parse_rule(F.col("rule"))).select("p_partkey", "rule", "r.tar", "r.fs", "r.prefix")


OWNERS = ["1000", "7:8", "web", "web:adm", "db:db", "db:nobody", "x", ":5", "-3", "9:web"]


@query("SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 1000 WHEN 1 THEN 7 WHEN 2 THEN 33 WHEN 3 THEN 33 WHEN 4 THEN 70 END AS uid, CASE p_partkey % 10 WHEN 0 THEN 1000 WHEN 1 THEN 8 WHEN 2 THEN 34 WHEN 3 THEN 4 WHEN 4 THEN 71 END AS gid FROM part")
def parse_owner(x):
    o = fm.parse_owner(F.expr(_pick("p_partkey % 10", OWNERS)), {"web": (33, 34), "db": (70, 71)}, {"adm": 4})
    return x["part"].select("p_partkey", o.alias("o")).select("p_partkey", "o.uid", "o.gid")


@query("SELECT event_id, CAST(CASE WHEN a + b < 18446744073709551616 THEN a + b END AS VARCHAR) AS total, CAST(CASE WHEN a * b < 18446744073709551616 THEN a * b END AS VARCHAR) AS product FROM (SELECT event_id, CAST(9223372036854775807 AS HUGEINT) + event_id AS a, CAST(event_id % 3 AS HUGEINT) * 9223372036854775000 + event_id % 5 AS b0, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS HUGEINT) ELSE CAST(event_id % 3 AS HUGEINT) * 922337203685477500 + event_id % 5 END AS b FROM events) e")
def checked_arithmetic(x):
    e = x["events"].select("event_id", (F.lit(2**63 - 1).cast("decimal(20,0)") + F.col("event_id")).cast("decimal(20,0)").alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 3).otherwise((F.col("event_id") % 3) * 922337203685477500 + F.col("event_id") % 5).alias("b"))
    return e.select("event_id", fm.checked_add(F.col("a"), F.col("b")).cast("string").alias("total"), fm.checked_mul(F.col("a"), F.col("b")).cast("string").alias("product"))


@query("SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN 'fifo' WHEN 2 THEN 'char' WHEN 4 THEN 'dir' WHEN 6 THEN 'block' WHEN 8 THEN 'file' END AS kind, CAST((p_partkey % 300) % 256 + p_size * 256 + ((p_partkey % 300) // 256) * 1048576 AS BIGINT) AS device FROM part")
def node_kinds(x):
    mode = F.shiftleft((F.col("p_partkey") % 9).cast("int"), 12) + F.lit(0o644)
    return x["part"].select("p_partkey", fm.node_type(mode).alias("kind"), fm.device_number(F.col("p_size"), F.col("p_partkey") % 300).alias("device"))


KINDS = ["http", "dns_timeout", "timeout", "eof", "cancelled", "connection"]


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'http_503' WHEN event_id % 4 = 2 THEN NULL END WHEN 1 THEN 'dns_timeout' WHEN 2 THEN 'network_timeout' WHEN 3 THEN 'unexpected_eof' WHEN 5 THEN 'connection_error' END AS reason, (event_id % 5 + 1) * 5000 AS delay_ms FROM events")
def retry_reasons(x):
    kind, status = F.expr(_pick("event_id % 6", KINDS)), F.when(F.col("event_id") % 4 == 0, 503).otherwise(404)
    return x["events"].select("event_id", fm.retry_reason(kind, status).alias("reason"), fm.layer_retry_delay_ms(F.col("event_id") % 5 + 1).alias("delay_ms"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate <= {NOW} AND (o_orderkey % 3 <> 0 OR {NOW} < o_orderdate + INTERVAL 400 DAY) AND o_orderkey % 7 <> 0 THEN o_orderdate END AS imported FROM orders")
def valid_at(x):
    o = x["orders"].withColumn("t", F.col("o_orderdate").cast("timestamp"))
    text = fm.format_valid_at(F.col("t"), F.when(F.col("o_orderkey") % 3 == 0, 400))
    text = F.when(F.col("o_orderkey") % 3 == 0, text).otherwise(fm.format_valid_at(F.col("t")))
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    return o.select("o_orderkey", fm.parse_valid_at(text, F.expr(NOW).cast("timestamp")).cast(o.schema["o_orderdate"].dataType).alias("imported"))


@query("SELECT page_id, page_id % 4 < 2 AS readable, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'a/' || page_id || chr(10) || 'b' || chr(10) END AS encoded, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 2 END AS n FROM pages")
def reference_lists(x):
    refs = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("b"), F.lit("b"))).otherwise(F.array(F.concat(F.lit("a/"), "page_id"), F.lit("b")))
    kind = F.expr(_pick("page_id % 4", [fm.LAYER_TYPES[0], fm.LAYER_TYPES[7], "text/plain", "application/json"]))
    p = x["pages"].select("page_id", fm.readable_layer(kind).alias("readable"), fm.encode_refs(refs).alias("encoded"))
    return p.withColumn("n", F.size(fm.parse_refs(F.col("encoded")))).withColumn("n", F.when(F.col("encoded").isNotNull(), F.col("n")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE '01' || CASE doc_id % 4 WHEN 0 THEN '01' WHEN 1 THEN '02' ELSE '03' END || CASE WHEN doc_id % 2 = 0 THEN '02' ELSE '01' END || sha256(encode(text)) END AS cache_key, 39 + octet_length(encode(text)) AS frame_size, sha256(encode(text)) AS value_key, doc_id % 3 AS status FROM documents WHERE octet_length(encode(text)) < 4000000")
def wire_frames(x):
    """Cache keys, and texts through request and response frames and back."""
    d = x["documents"].select("doc_id", F.encode("text", "utf-8").alias("v")).where("octet_length(v) < 4000000").withColumn("k", F.unhex(F.sha2("v", 256)))
    d = d.withColumn("q", fm.encode_request(F.lit(2), F.lit(1), F.lit(0), F.col("k"), F.col("v"))).withColumn("r", fm.decode_request(F.col("q")))
    d = d.withColumn("s", fm.decode_response(fm.encode_response(F.col("doc_id") % 3, F.lit("né"), F.col("r.value"))))
    key = fm.cache_key(F.expr(_pick("doc_id % 4", ["chunk", "manifest", "blob", "other"])), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1), F.lower(F.hex("r.key")))
    return d.select("doc_id", F.lower(F.hex(key)).alias("cache_key"), F.octet_length("q").alias("frame_size"), F.sha2("s.value", 256).alias("value_key"), F.col("s.status").alias("status"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/abs/f' WHEN 1 THEN '/work/rel' WHEN 2 THEN '/srv/a/img' END AS file, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE sha256(encode('salt-v1g' || (o_orderkey % 5))) END AS salt FROM orders")
def resolve_files(x):
    ref = sc.parse_ref(F.expr(_pick("o_orderkey % 4", ["file:///abs/f", "file://rel", "file://img@location:one", "file://img@location:gone"])))
    name = F.when(F.col("o_orderkey") % 5 == 0, "../x").otherwise(F.concat(F.lit("g"), (F.col("o_orderkey") % 5).cast("string")))
    return x["orders"].select("o_orderkey", fm.resolve_file(ref, F.create_map(F.lit("one"), F.lit("/srv/a/")), F.lit("/work")).alias("file"), F.lower(F.hex(fm.generation_salt(name, "salt-v1"))).alias("salt"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 11 = 0) THEN 'unsafe: ..' WHEN count(DISTINCT o_orderkey % 7) < count(*) THEN 'repeated' END AS problem FROM orders GROUP BY o_custkey")
def generations_check(x):
    name = F.when(F.col("o_orderkey") % 11 == 0, "..").otherwise(F.concat(F.lit("g"), (F.col("o_orderkey") % 7).cast("string")))
    g = x["orders"].groupBy("o_custkey").agg(F.collect_list(name).alias("n"))
    return g.select("o_custkey", fm.generations_problem(F.col("n")).alias("problem"))


@query()
def bench_keys(x):
    e = x["events"].select("event_id")
    return e.select("event_id", *(fm.bench_key(F.col("event_id"), 500, 50, a, 100).alias(a) for a in ("seq", "uniform", "zipf")))


# --- ingest, containers, contracts -----------------------------------------------------------------------------------


PAYLOAD = "CASE kind WHEN 2 THEN repeat(chr(CAST(65 + chunk % 26 AS INT)), CAST(e - s AS INT)) END"
SEGMENTS = """s AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY image ORDER BY s) = s THEN 0 ELSE 1 END AS new FROM {runs} WHERE kind <> 0), g AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM s),
    b AS (SELECT image, min(s) AS s, string_agg(CASE kind WHEN 2 THEN repeat(chr(CAST(65 + chunk % 26 AS INT)), CAST(e - s AS INT)) ELSE repeat('0', CAST(e - s AS INT)) END, '' ORDER BY s) AS t FROM g GROUP BY image, g),
    c AS (SELECT image, s + off AS s, t[off + 1:off + 4096] AS t FROM (SELECT image, s, t, unnest(range(0, length(t), 4096)) AS off FROM b) u)"""


def _stored_runs(x):
    r = x["runs"]
    return r.withColumn("data", F.when(F.col("kind") == iv.DATA, F.encode(F.repeat(F.char(65 + F.col("chunk") % 26), (F.col("end") - F.col("start")).cast("int")), "utf-8")))


@query(f"WITH {SEGMENTS} SELECT image, row_number() OVER (PARTITION BY image ORDER BY s) - 1 AS ordinal, s AS \"start\", length(t) AS size, t = repeat('0', length(t)) AS is_zero FROM c")
def ingest_entries(x):
    """Entries of images that are ingested run by run: segments between holes in chunks of 4096 bytes."""
    e, _ = ig.ingest(_stored_runs(x), F.lit(b"salt"), 4096)
    return e.select("image", "ordinal", "start", "size", "is_zero")


@query(f"WITH {SEGMENTS} SELECT count(DISTINCT t) AS objects, CAST(sum(length(t)) FILTER (k = 1) AS BIGINT) AS bytes FROM (SELECT t, row_number() OVER (PARTITION BY t ORDER BY s) AS k FROM c WHERE t <> repeat('0', length(t))) d")
def ingest_objects(x):
    """The objects that the same images need: one of each different chunk that is not all zeros."""
    _, o = ig.ingest(_stored_runs(x), F.lit(b"salt"), 4096)
    return o.agg(F.countDistinct("object_key").alias("objects"), F.sum("size").alias("bytes"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'exists' WHEN doc_id % 5 = 1 THEN 'bad size' WHEN doc_id % 5 = 2 THEN 'bad digest' ELSE 'stored' END AS state FROM documents")
def put_states(x):
    v = F.encode("text", "utf-8")
    key = F.when(F.col("doc_id") % 5 == 2, F.sha2(F.concat(v, F.lit(b"x")), 256)).otherwise(F.sha2(v, 256))
    o = x["documents"].select("doc_id", F.concat(F.lit("g"), "doc_id").alias("generation"), key.alias("key"), v.alias("data"), (F.octet_length(v) + F.when(F.col("doc_id") % 5 == 1, 1).otherwise(0)).alias("size"))
    return ig.checked_put(o, o.where("doc_id % 5 = 0")).select("doc_id", "state")


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 4")
def manifest_keys(x):
    v = F.encode("text", "utf-8")
    return ig.bad_manifests(x["documents"].select("doc_id", v.alias("manifest"), F.when(F.col("doc_id") % 9 == 4, F.sha2(F.concat(v, F.lit(b"!")), 256)).otherwise(F.sha2(v, 256)).alias("key"))).select("doc_id")


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
    SELECT k AS key, CASE k % 8 WHEN 1 THEN 'not in the index' WHEN 2 THEN 'not in the directory' WHEN 3 THEN 'no payload' WHEN 4 THEN 'places differ' WHEN 5 THEN 'size differs' WHEN 6 THEN 'checksum differs' END AS problem FROM p WHERE k % 8 BETWEEN 1 AND 6
    UNION ALL SELECT k, 'gap before' FROM p WHERE k % 8 = 3 AND k > 2""")
def container_check(x):
    from ..operators.ranking import global_rank

    p = global_rank(x["part"].select(F.col("p_partkey").alias("key"), F.lit(100).cast("bigint").alias("size")), "key", "i")
    p = p.withColumn("start", F.col("i") * 100).withColumn("crc", F.col("key") * 7)
    k = F.col("key") % 8
    index = p.where(k != 1).withColumn("start", F.when(k == 4, F.col("start") + 1).otherwise(F.col("start")))
    return ig.cross_check(index, p.where(k != 2), p.where(k != 3).withColumns({"size": F.when(k == 5, F.col("size") + 1).otherwise(F.col("size")), "crc": F.when(k == 6, F.col("crc") + 1).otherwise(F.col("crc"))}))


@query("""WITH r AS (SELECT l_orderkey AS image, l_linenumber AS seq, CAST(l_partkey % 50 * 100 AS BIGINT) AS off, least(CAST(l_partkey % 50 * 100 + 300 AS BIGINT), 4500) AS stop FROM lineitem),
    b AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY image ORDER BY seq, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
    SELECT image, seq, off AS "offset", CASE WHEN off < before THEN 'backward' WHEN stop > 4400 THEN 'early end' ELSE 'ok' END AS state, CASE WHEN off >= before AND stop <= 4400 THEN greatest(stop - off, 0) END AS n FROM b""")
def dense_reads(x):
    r = x["lineitem"].select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 50 * 100).alias("offset"), F.lit(300).cast("bigint").alias("length"))
    r = r.withColumn("seq", F.struct("line", "offset"))
    return ig.dense_reads(r, F.lit(4500).cast("bigint"), F.lit(4400)).select("image", F.col("line").alias("seq"), "offset", "state", "n")


@query("SELECT source, count(*) AS records, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CASE WHEN count(*) > 40 THEN 'records' WHEN sum(octet_length(encode(text))) > 100000 THEN 'bytes' END AS exceeds FROM documents GROUP BY source")
def archive_limits(x):
    return ig.within_limits(x["documents"].withColumn("n", F.octet_length(F.encode("text", "utf-8")).cast("bigint")), "source", "n", 40, 100000)


@query("""WITH e AS (SELECT image, rn - 1 AS ordinal, s, e, kind FROM {runs}), m AS (SELECT *, CASE WHEN kind = 1 AND lag(kind) OVER w = 1 AND lag(e) OVER w = s THEN 0 ELSE 1 END AS new FROM e WHERE kind <> 0 WINDOW w AS (PARTITION BY image ORDER BY s)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT image, min(s) AS "start", max(e) AS "end", min(kind) AS kind, min(CASE WHEN kind = 2 THEN ordinal END) AS ordinal FROM g GROUP BY image, g UNION ALL SELECT image, s, e, 0, NULL FROM e WHERE kind = 0""")
def manifest_run(x):
    r = x["runs"]
    e = r.where(F.col("kind") != iv.HOLE).select("image", (F.col("rn") - 1).cast("bigint").alias("ordinal"), "start", (F.col("end") - F.col("start")).alias("size"), (F.col("kind") == iv.ZERO).alias("is_zero"))
    return ig.manifest_runs(e, r.where(F.col("kind") == iv.HOLE))


@query('SELECT r.image, s AS "start", least(e, i.size - 1000) AS "end", kind, 5 AS "from", CASE WHEN i.size % 2048 = 0 THEN least(1029, i.size) ELSE i.size END AS "to" FROM {runs} r JOIN {images} i ON r.image = i.image WHERE s < i.size - 1000')
def strip_and_window(x):
    r = ig.strip_tail(x["runs"].select("image", "start", "end", "kind"), x["images"], F.col("size") - 1000)
    w = ig.window_of(x["images"], F.lit(5), F.when(F.col("size") % 2048 == 0, 1024).otherwise(0)).select("image", "from", "to")
    return r.join(w, "image")


@query(f"""WITH a AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM {{access}}), h AS (SELECT w, {BUCKET} AS bucket, count(*) AS n, max(greatest(ns, 0)) AS top FROM a GROUP BY w, {BUCKET}),
    c AS (SELECT *, sum(n) OVER (PARTITION BY w ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY w) AS total, max(top) OVER (PARTITION BY w) AS peak FROM h),
    q AS (SELECT c.*, m, greatest(total * m // 1000, 1) AS target FROM c, (SELECT unnest([500, 990]) AS m) x), f AS (SELECT *, row_number() OVER (PARTITION BY w, m ORDER BY bucket) AS k FROM q WHERE cum >= target),
    b AS (SELECT *, {[0, *st.BOUNDS]}[bucket + 1] AS lo, CASE WHEN bucket < {len(st.BOUNDS)} THEN {st.BOUNDS}[bucket + 1] ELSE peak END AS hi FROM f WHERE k = 1),
    v AS (SELECT w, m, CAST(least(lo + (hi - lo) * (target - (cum - n)) // n, peak) AS BIGINT) AS value, peak FROM b)
    SELECT a.w AS window_start, count(*) AS ops, round(count(*) / 3600, 6) AS ops_per_s, round(sum(bytes) / 3600, 6) AS bytes_per_s, count(*) FILTER (event_id % 4 = 0) * 1000 // count(*) AS dedup_milli,
    min(v1.value) AS p50, min(v2.value) AS p99, min(v1.peak) AS top FROM a JOIN v v1 ON v1.w = a.w AND v1.m = 500 JOIN v v2 ON v2.w = a.w AND v2.m = 990 GROUP BY a.w""")
def window_latency(x):
    return st.window_latency(x["access"].withColumn("dedup", F.col("event_id") % 4 == 0), "ts", "1 hour", "ns", 3600)


@query("SELECT event_type, round(count(*) / 10.0, 6) AS ops_per_s, round(sum(bytes) / (10.0 * 1048576), 9) AS mib_per_s FROM {access} GROUP BY event_type")
def bench_throughput(x):
    return st.throughput(x["access"], "event_type", "bytes", 10.0)


@query("SELECT user_id, event_id, CAST(sum(bytes) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {access}")
def metric_points(x):
    return st.cumulative_points(x["access"], ["user_id"], "event_id", "bytes").select("user_id", "event_id", "total")


# --- the relational surface: extensions beyond the operators above ---------------------------------------------------


def _both(name: str, sql: str) -> None:
    """A query whose SQL both engines read."""
    QUERIES[name] = lambda spark, sf_dir: Inputs(spark, sf_dir).sql(sql)
    ORACLE_SQL[name] = sql.format(**{t: t for t in TABLES})


_both("join_inner", "SELECT n_name, count(*) AS customers FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n_name")
_both("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c_custkey")
_both("join_full", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS k, count(c.c_custkey) AS c, count(s.s_suppkey) AS s FROM {customer} c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey GROUP BY coalesce(c.c_nationkey, s.s_nationkey)")
_both("join_semi", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
_both("join_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
_both("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
_both("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS c FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_both("win_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}")
_both("set_ops", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1")
_both("topk_per_group", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM {lineitem}) t WHERE k <= 2")
_both("join_range", "SELECT p_partkey, s_suppkey FROM {part} p JOIN {supplier} s ON p.p_size = s.s_nationkey AND s.s_suppkey BETWEEN p.p_partkey - 40 AND p.p_partkey + 40")
_both("agg_hash", "SELECT l_returnflag, count(*) AS n, min(l_partkey) AS lo, max(l_partkey) AS hi FROM {lineitem} GROUP BY l_returnflag")
_both("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM {orders} GROUP BY o_orderpriority")
_both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_both("win_running", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM {orders}")
_both("win_frame", "SELECT event_id, max(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM {events}")
_both("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
_both("topk_global", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_both("fn_string", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_type, 2, 3) AS s, replace(p_brand, '#', '-') AS r, trim(concat('  ', p_brand)) AS t FROM {part}")
_both("fn_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q FROM {orders}")
_both("fn_math", "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(floor(sqrt(p_size)) AS BIGINT) AS r, greatest(p_size, 10) AS g FROM {part}")
