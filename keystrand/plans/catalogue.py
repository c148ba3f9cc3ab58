"""The queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.config import Settings
from keystrand.functions import keys
from keystrand.functions.hashing import hamming, hex64, pack64, seed_bytes, unpack64, word64
from keystrand.operators import bloom, cms, compaction, hll, instances, log, merkle, read, simhash, token_bucket
from keystrand.operators.store import Store
from keystrand.plans.numbering import numbered
from keystrand.plans.shipping import ship
from keystrand.plans.storage import fresh_path, put_bytes
from keystrand.sources import generators, legacy
from keystrand.sources.runs import RunStore, record_bytes
from keystrand.streaming import ingest
from keystrand.streaming.admission import admit_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as mutations: a user's row is the key's new value, an error its deletion."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return log.as_log(e, F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("event_id"), F.col("event_type") == "error")


def table_log(spark: SparkSession, sf_dir: str, name: str, key: str, value: str, seq: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return log.as_log(t, F.col(key), F.col(value), F.timestamp_seconds(F.lit(0)), F.col(seq), F.lit(False))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("value").cast("string").alias("value"), "ts", "seq")


NEWEST = """newest AS (SELECT * FROM (SELECT user_id::VARCHAR AS key, event_type AS value, ts, event_id AS seq, event_type = 'error' AS tombstone,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1),
    live AS (SELECT key, value, ts, seq FROM newest WHERE NOT tombstone)"""


@query(f"WITH {NEWEST} SELECT key, value, ts, seq, tombstone FROM newest")
def latest_per_key(spark, sf_dir):
    return log.latest(events_log(spark, sf_dir)).select("key", F.col("value").cast("string").alias("value"), "ts", "seq", "tombstone")


@query(f"WITH {NEWEST} SELECT * FROM live")
def live_snapshot(spark, sf_dir):
    return shown(log.live(events_log(spark, sf_dir)))


@query(f"WITH {NEWEST} SELECT DISTINCT user_id::VARCHAR AS key FROM events WHERE user_id::VARCHAR NOT IN (SELECT key FROM live)")
def delete_hides_key(spark, sf_dir):
    rows = events_log(spark, sf_dir)
    return rows.select("key").distinct().join(log.live(rows), "key", "left_anti")


@query(f"WITH {NEWEST} SELECT * FROM live WHERE key = '42'")
def get_point(spark, sf_dir):
    return shown(read.get(events_log(spark, sf_dir), "42"))


@query(f"WITH {NEWEST} SELECT DISTINCT c_custkey::VARCHAR AS key, value, ts, seq FROM customer LEFT JOIN live ON c_custkey::VARCHAR = key")
def multi_get(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return shown(read.multi_get(events_log(spark, sf_dir), asked))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE lower(c_name) LIKE 'customer#0000001%' ORDER BY c_name LIMIT 10 OFFSET 20")
def prefix_scan_page(spark, sf_dir):
    rows = read.prefix_scan(table_log(spark, sf_dir, "customer", "c_name", "c_mktsegment", "c_custkey"), "Customer#0000001")
    return read.page(rows, 3, 10).select("key", F.col("value").cast("string").alias("value"))


@query(f"WITH {NEWEST} SELECT key, value, seq FROM live WHERE key BETWEEN '1' AND '4' ORDER BY key LIMIT 10")
def range_scan_page(spark, sf_dir):
    return read.page(read.range_scan(events_log(spark, sf_dir), "1", "4"), 1, 10).select("key", F.col("value").cast("string").alias("value"), "seq")


@query("SELECT c_name AS key FROM customer WHERE lower(c_name) BETWEEN 'customer#000000010' AND 'customer#000000099' ORDER BY c_name LIMIT 7 OFFSET 7")
def range_scan_folded_page(spark, sf_dir):
    rows = read.range_scan(table_log(spark, sf_dir, "customer", "c_name", "c_mktsegment", "c_custkey"), "CUSTOMER#000000010", "customer#000000099")
    return read.page(rows, 2, 7).select("key")


@query("""SELECT key, (row_number() OVER (ORDER BY key))::BIGINT AS step FROM
    (SELECT DISTINCT p_name AS key FROM part WHERE starts_with(lower(p_name), lower((SELECT min(p_name) FROM part)[1:4])))""")
def prefix_iterator(spark, sf_dir):
    """The steps that an iterator over a prefix takes, as rows."""
    rows = table_log(spark, sf_dir, "part", "p_name", "p_brand", "p_partkey")
    prefix = rows.agg(F.min("key")).first()[0][:4]
    found = read.prefix_scan(rows, prefix)
    return numbered(found.select("key"), ["key"], "step", 1)


RESERVED_KEYS = """SELECT (CASE p_partkey % 7 WHEN 0 THEN 'bf_' WHEN 1 THEN 'cms_' WHEN 2 THEN 'hll_' WHEN 3 THEN 'sh_' WHEN 4 THEN 'tb_' WHEN 5 THEN 'shx' ELSE '' END) || p_name AS key FROM part"""


def reserved_keys(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    heads = F.element_at(F.array(*map(F.lit, ["bf_", "cms_", "hll_", "sh_", "tb_", "shx", ""])), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select(F.concat(heads, "p_name").alias("key"))


@query(f"SELECT key FROM ({RESERVED_KEYS}) WHERE NOT regexp_matches(key, '^(bf|cms|hll|sh|tb)_')")
def reserved_key_filter(spark, sf_dir):
    return reserved_keys(spark, sf_dir).where(~keys.is_reserved())


@query(f"""SELECT CASE regexp_extract(key, '^(bf|cms|hll|sh|tb)_', 1) WHEN 'bf' THEN 'bloom' WHEN 'cms' THEN 'cms' WHEN 'hll' THEN 'hll' WHEN 'sh' THEN 'simhash'
    WHEN 'tb' THEN 'token_bucket' ELSE 'user' END AS kind, count(*) AS n FROM ({RESERVED_KEYS}) GROUP BY 1""")
def key_kinds(spark, sf_dir):
    return reserved_keys(spark, sf_dir).groupBy(keys.kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lower(p_name[1:5]) AS head FROM part")
def key_heads(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(keys.key_head("p_name", 5).alias("head")).distinct()


@query(f"WITH {NEWEST} SELECT * FROM live")
def compaction_merge(spark, sf_dir):
    """Three runs of the log, merged; their order and number change nothing."""
    rows = events_log(spark, sf_dir)
    runs = [rows.where(F.col("seq") % 3 == k) for k in range(3)]
    return shown(compaction.merged(runs[0].unionByName(runs[1]).unionByName(runs[2]), drop_tombstones=True))


@query("""SELECT level, runs, bytes, level < 5 AND runs >= 2 AND bytes >= 512 * level AS due FROM
    (SELECT (event_id % 6 + 1)::INT AS level, count(DISTINCT event_id % 60) AS runs, sum(event_id % 97)::BIGINT AS bytes FROM events GROUP BY 1)""")
def compaction_trigger(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 6 + 1).cast("int").alias("level"), (F.col("event_id") % 60).alias("run"), (F.col("event_id") % 97).alias("bytes"))
    runs = e.groupBy("level", "run").agg(F.sum("bytes").alias("bytes"))
    return compaction.due(compaction.level_sizes(runs), Settings())


@query("SELECT (row_number() OVER (ORDER BY first) - 1)::BIGINT AS id, key FROM (SELECT event_type AS key, min(event_id) AS first FROM events GROUP BY 1)")
def key_dictionary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return log.dictionary(e.select(F.col("event_type").alias("key"), F.col("event_id").alias("seq")))


@query("SELECT event_id AS seq, event_type AS key FROM events")
def dictionary_round_trip(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"))
    ids = log.dictionary_of_json(log.dictionary_json(log.dictionary(e)))
    return log.decode_keys(log.encode_keys(e, ids), ids).select("seq", "key")


def hll_sql(element: str, table: str, p: int, by: str = "") -> str:
    head = f"{by}, " if by else ""
    return f"""SELECT {head}(h >> {64 - p})::INT AS bucket, max(CASE WHEN h = 0 THEN 65 ELSE bit_count(((h & ((~h) + 1::UBIGINT)) - 1)::UBIGINT) + 1 END)::INT AS rank
        FROM (SELECT {head}('0x' || substr(md5({element}), 1, 16))::UBIGINT AS h FROM {table}) GROUP BY ALL"""


def estimate_sql(registers: str, p: int, by: str = "") -> str:
    m, head = 1 << p, f"{by}, " if by else ""
    return f"""SELECT {head}round(CASE WHEN e <= {2.5 * m} AND empty > 0 THEN {m} * ln({m}::DOUBLE / empty) WHEN e > {2**32 / 30} THEN -{2.0**32} * ln(1 - e / {2.0**32}) ELSE e END, 6) AS estimate
        FROM (SELECT {head}{m} - count(*) AS empty, {0.7213 / (1 + 1.079 / m) * m * m}::DOUBLE / (sum(pow(2.0, -rank)) + {m} - count(*)) AS e FROM ({registers}) GROUP BY ALL)"""


@query(hll_sql("user_id::VARCHAR", "events", 6))
def hll_registers(spark, sf_dir):
    return hll.registers(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id").cast("string"), 6)


@query(estimate_sql(hll_sql("user_id::VARCHAR", "events", 10), 10))
def hll_estimate(spark, sf_dir):
    sketch = hll.registers(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id").cast("string"), 10)
    return hll.estimate(sketch, 10).select(F.round("estimate", 6).alias("estimate"))


@query(estimate_sql(hll_sql("l_partkey::VARCHAR", "lineitem", 12, "l_returnflag"), 12, "l_returnflag"))
def hll_by_group(spark, sf_dir):
    sketch = hll.registers(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_partkey").cast("string"), 12, ("l_returnflag",))
    return hll.estimate(sketch, 12, ("l_returnflag",)).select("l_returnflag", F.round("estimate", 6).alias("estimate"))


@query(hll_sql("l_partkey::VARCHAR", "lineitem", 10))
def hll_merge(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").cast("string").alias("e"))
    return hll.merge(*[hll.registers(parts.where(F.col("l_orderkey") % 2 == k), "e", 10) for k in range(2)])


def seed_sql(i: int) -> str:
    return f"unhex('{(1000 + i).to_bytes(4, 'big').hex()}{'00' * 28}')"


def place_sql(element: str, m: int, i: int) -> str:
    return f"(('0x' || substr(md5(encode({element}) || {seed_sql(i)}), 1, 16))::UBIGINT % {m})::INT"


CMS_M, CMS_K = cms.checked(0.1, 0.1)
CMS_CELLS = "SELECT row, col, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {i} AS row, {place_sql('event_type', CMS_M, i)} AS col FROM events" for i in range(CMS_K)) + ") GROUP BY ALL"


@query(CMS_CELLS)
def cms_cells(spark, sf_dir):
    return cms.cells(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", 0.1, 0.1)


@query(f"""WITH c AS ({CMS_CELLS}), q AS ({" UNION ALL ".join(f"SELECT DISTINCT event_type, {i} AS row, {place_sql('event_type', CMS_M, i)} AS col FROM events" for i in range(CMS_K))})
    SELECT event_type, min(n) AS least, max(n) AS most FROM q JOIN c USING (row, col) GROUP BY 1""")
def cms_estimate(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return cms.estimate(cms.cells(e, "event_type", 0.1, 0.1), e, "event_type", 0.1, 0.1)


BLOOM_M, BLOOM_K = bloom.sized(10_000, 0.01)
BLOOM_BITS = "SELECT DISTINCT bit FROM (" + " UNION ALL ".join(f"SELECT {place_sql('o_custkey::VARCHAR', BLOOM_M, i)} AS bit FROM orders" for i in range(BLOOM_K)) + ")"


@query(BLOOM_BITS)
def bloom_bits(spark, sf_dir):
    return bloom.bits(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("e")), "e", BLOOM_M, BLOOM_K)


@query(f"""WITH b AS ({BLOOM_BITS}), q AS ({" UNION ".join(f"SELECT c_custkey::VARCHAR AS key, {place_sql('c_custkey::VARCHAR', BLOOM_M, i)} AS bit FROM customer" for i in range(BLOOM_K))})
    SELECT key, bool_and(b.bit IS NOT NULL) AS maybe FROM q LEFT JOIN b USING (bit) GROUP BY 1""")
def bloom_membership(spark, sf_dir):
    added = bloom_bits(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return bloom.membership(added, asked, "key", BLOOM_M, BLOOM_K)


STOP_SQL = ", ".join(f"'{w}'" for w in simhash.STOP_WORDS)
SIMHASH_WORDS = f"""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(translate(text, '{simhash.PUNCTUATION}', '')), '\\s+')) AS word FROM documents)
    WHERE word <> '' AND word NOT IN ({STOP_SQL}) GROUP BY ALL"""
SIMHASH_PRINTS = f"""w AS ({SIMHASH_WORDS}), h AS (SELECT doc_id, n, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h FROM w),
    v AS (SELECT doc_id, i, sum(n * (2 * ((h >> (63 - i)) & 1)::BIGINT - 1)) AS v FROM h, range(64) t(i) GROUP BY ALL),
    p AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << (63 - i) ELSE 0::UBIGINT END) AS fp FROM v GROUP BY 1),
    prints AS (SELECT d.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN p USING (doc_id))"""


@query(SIMHASH_WORDS)
def simhash_words(spark, sf_dir):
    return simhash.word_weights(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query(f"WITH {SIMHASH_PRINTS} SELECT doc_id, format('{{:016x}}', fp) AS fingerprint FROM prints")
def simhash_fingerprint(spark, sf_dir):
    """Through the stored eight bytes and back."""
    prints = simhash.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return prints.select("doc_id", hex64(unpack64(pack64("fp"))).alias("fingerprint"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, bit_count(xor(('0x' || substr(md5(a.n_name), 1, 16))::UBIGINT, ('0x' || substr(md5(b.n_name), 1, 16))::UBIGINT))::INT AS distance
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def hamming_pairs(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", word64("n_name").alias("fp"))
    a, b = n.alias("a"), n.alias("b")
    met = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return met.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), hamming("a.fp", "b.fp").alias("distance"))


@query(f"""WITH {SIMHASH_PRINTS}, r AS (SELECT min(doc_id) AS id, fp FROM prints GROUP BY fp)
    SELECT a.id AS a, b.id AS b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM r a JOIN r b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 3""")
def near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(simhash.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@query(f"WITH {SIMHASH_PRINTS} SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS representative FROM prints")
def near_duplicate_classes(spark, sf_dir):
    return simhash.classes(simhash.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def tree_sql(leaf: str, name: str = "l", levels: int = 6) -> str:
    """Common table expressions {name}0 .. of a tree's levels; levels above the root are empty."""
    out = [f"{name}0 AS MATERIALIZED ({leaf})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT a.idx // 2 AS idx, sha1(unhex(a.digest || coalesce(b.digest, a.digest))) AS digest
            FROM {name}{k} a LEFT JOIN {name}{k} b ON b.idx = a.idx + 1 WHERE a.idx % 2 = 0 AND (SELECT count(*) FROM {name}{k}) > 1)""")
    return ", ".join(out)


def levels_sql(name: str, levels: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS level, idx, digest FROM {name}{k}" for k in range(levels + 1))


NATION_LEAVES = "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS idx, sha1(n_name) AS digest FROM nation"
CUSTOMER_LEAVES = "SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS idx, sha1(c_name || c_mktsegment) AS digest FROM customer"
CHANGED_LEAVES = "SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS idx, sha1(CASE WHEN c_custkey = 7 THEN 'changed' ELSE c_name || c_mktsegment END) AS digest FROM customer"
#: Levels that the SQL's trees over customers may have.
TALL = 24


def customer_tree(spark: SparkSession, sf_dir: str, changed: int | None = None) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.when(F.col("c_custkey") == changed, F.lit("changed")).otherwise(F.concat("c_name", "c_mktsegment"))
    return merkle.tree(merkle.leaves(c, F.sha1(text), ["c_custkey"]))


@query(f"WITH {tree_sql(CUSTOMER_LEAVES, 'l', TALL)} SELECT digest AS root, (level + 1)::INT AS levels FROM ({levels_sql('l', TALL)}) ORDER BY level DESC LIMIT 1")
def merkle_root(spark, sf_dir):
    return merkle.roots(customer_tree(spark, sf_dir)).select("root", "levels")


@query(f"""WITH {tree_sql(CUSTOMER_LEAVES, 'l', TALL)}, {tree_sql(CHANGED_LEAVES, 'c', TALL)}
    SELECT level, idx, a.digest AS left_digest, b.digest AS right_digest FROM ({levels_sql('l', TALL)}) a FULL JOIN ({levels_sql('c', TALL)}) b USING (level, idx) WHERE a.digest IS DISTINCT FROM b.digest""")
def merkle_diff(spark, sf_dir):
    return merkle.diff(customer_tree(spark, sf_dir), customer_tree(spark, sf_dir, 7)).select("level", "idx", "left_digest", "right_digest")


#: CRC-32 in SQL: the table of the reflected polynomial 0xEDB88320, made by its rule, then a byte at a time.
CRC_SQL = """t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_resize([0::UBIGINT], 8, 0::UBIGINT)),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    h AS (SELECT event_id AS seq, lpad(to_hex(epoch_us(ts) // 1000000), 16, '0') || CASE WHEN event_type = 'error' THEN '01' ELSE '00' END || lpad(to_hex(strlen(user_id::VARCHAR)), 16, '0')
        || lpad(to_hex(strlen(event_type)), 16, '0') || hex(user_id::VARCHAR) || hex(event_type) AS h FROM events),
    b AS (SELECT seq, list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::UBIGINT) AS b FROM h)"""


@query(f"""WITH {CRC_SQL} SELECT seq, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, tab[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc FROM b, t""")
def crc32_rows(spark, sf_dir):
    """Checksums of the log's rows, and whether each holds after it was stored."""
    return log.valid(events_log(spark, sf_dir)).select("seq", "crc")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT key, seq, n, true AS admitted, 2::BIGINT AS tokens, us AS last FROM e WHERE n = 1
        UNION ALL
        SELECT key, seq, n, before > 0, CASE WHEN before > 0 THEN before - 1 ELSE 0 END, CASE WHEN more > 0 THEN us ELSE last END FROM
            (SELECT e.key, e.seq, e.n, e.us, s.last, (e.us - s.last) // 86400000000 AS more, least(3, s.tokens + (e.us - s.last) // 86400000000) AS before FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))
    SELECT key, seq, admitted, tokens FROM s""")
def token_bucket_admission(spark, sf_dir):
    ship(spark)
    admitted = token_bucket.admit(events_log(spark, sf_dir), capacity=3, rate=1, unit_seconds=86_400)
    return admitted.select("key", "seq", "admitted", "tokens")


@query(f"WITH {NEWEST} SELECT * FROM live")
def stream_upsert(spark, sf_dir):
    stream = ingest.source(spark, f"{sf_dir}/events.parquet")
    mutations = log.as_log(stream, F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("event_id"), F.col("event_type") == "error")
    out = fresh_path(spark, "stream-upsert")
    ingest.upsert(mutations, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return shown(log.visible(ingest.upserted(spark, f"{out}/rows")))


@query(hll_sql("user_id::VARCHAR", "events", 8))
def stream_hll(spark, sf_dir):
    stream = ingest.source(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("e"))
    out = fresh_path(spark, "stream-hll")
    ingest.hll_sketch(stream, "e", 8, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return ingest.hll_registers(spark, f"{out}/rows")


@query(CMS_CELLS)
def stream_cms(spark, sf_dir):
    out = fresh_path(spark, "stream-cms")
    ingest.cms_sketch(ingest.source(spark, f"{sf_dir}/events.parquet"), "event_type", 0.1, 0.1, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return ingest.cms_cells(spark, f"{out}/rows")


def store_of(spark: SparkSession, settings: Settings, *parts: DataFrame) -> Store:
    """A store of our own with the parts appended in turn."""
    store = Store(spark, fresh_path(spark, "store"), settings)
    for p in parts:
        store.append(p)
    return store


def thirds(rows: DataFrame) -> list[DataFrame]:
    return [rows.where(F.col("seq") % 3 == k) for k in range(3)]


def by_time(rows: DataFrame) -> list[DataFrame]:
    """Three parts, each later than the one before, as mutations come."""
    early, late = rows.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [1 / 3, 2 / 3]).alias("q")).first()["q"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return [rows.where(at <= early), rows.where((at > early) & (at <= late)), rows.where(at > late)]


def runs_of(spark: SparkSession, *parts: tuple[DataFrame, int]) -> RunStore:
    runs = RunStore(spark, fresh_path(spark, "runs"))
    for rows, level in parts:
        runs.add(rows, level)
    return runs


def content(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("value").cast("string").alias("value"), "seq")


@query(f"WITH {NEWEST} SELECT key, value, seq FROM live")
def store_live(spark, sf_dir):
    """A store that flushed and compacted on its way, as two thirds of it lie in runs."""
    return content(store_of(spark, Settings(MaxSize=20, NumberOfMemtables=5), *by_time(events_log(spark, sf_dir))).live())


@query("SELECT 2::BIGINT AS batches, 0::BIGINT AS runs, 'small' AS store UNION ALL SELECT 0, 1, 'full'")
def store_flush(spark, sf_dir):
    """What flushing by the settings leaves: a log of two batches, or one run after the second batch filled it."""
    a, b, _ = thirds(events_log(spark, sf_dir))
    users = a.unionByName(b).select("key").distinct().count()
    first = a.select("key").distinct().count()
    small, full = (store_of(spark, Settings(MaxSize=n, NumberOfMemtables=1), *parts) for n, parts in ((users + 1, (a, b)), (max(users, first), (a.unionByName(b),))))
    return spark.createDataFrame([(len(s.batches()), len(s.runs.manifest()), name) for s, name in ((small, "small"), (full, "full"))], "batches long, runs long, store string")


@query(f"WITH {NEWEST} SELECT key, value, seq FROM live WHERE starts_with(key, '1')")
def store_prefix_scan(spark, sf_dir):
    return content(store_of(spark, Settings(MaxSize=20), *by_time(events_log(spark, sf_dir))).prefix_scan("1"))


@query(f"""WITH {NEWEST} SELECT key, value FROM live WHERE key NOT IN ('1', '2', '3') UNION ALL SELECT '1', 'put' UNION ALL SELECT '3', 'put again'""")
def put_and_delete(spark, sf_dir):
    """Puts of three keys, a strict deletion of one, a deletion and a put of another."""
    at = F.timestamp_seconds(F.lit(4_000_000_000))
    keyed = lambda *names: spark.createDataFrame([(n,) for n in names], "key string").withColumn("ts", at)
    rows = events_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = log.put(rows, keyed("1", "2", "3").withColumn("value", F.lit("put")))
    rows = log.delete(rows, keyed("2", "3"), strict=True)
    rows = log.put(rows, keyed("3").withColumn("value", F.lit("put again")))
    return content(log.live(rows)).select("key", "value")


@query("SELECT user_id::VARCHAR AS key, event_type AS value, event_id AS seq, event_type = 'error' AS tombstone, 1 AS level FROM events")
def run_round_trip(spark, sf_dir):
    rows = runs_of(spark, (events_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), 1)).read()
    return rows.select("key", F.col("value").cast("string").alias("value"), "seq", "tombstone", "level")


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_log(spark, sf_dir, "customer", "c_name", "c_mktsegment", "c_custkey")
    return runs_of(spark, (rows.where(F.col("seq") % 2 == 0), 2), (rows.where(F.col("seq") % 2 == 1), 1)).read().drop("level", "run_id")


@query("SELECT c_name AS key, c_mktsegment AS value, c_custkey AS seq FROM customer WHERE c_custkey = 17")
def run_get(spark, sf_dir):
    return content(read.get(customer_runs(spark, sf_dir), "Customer#000000017"))


@query("SELECT c_name AS key, c_mktsegment AS value, c_custkey AS seq FROM customer WHERE lower(c_name) LIKE 'customer#00000001%'")
def run_prefix_scan(spark, sf_dir):
    return content(read.prefix_scan(customer_runs(spark, sf_dir), "CUSTOMER#00000001", folded="key_lc"))


@query("SELECT c_name AS key, c_mktsegment AS value, c_custkey AS seq FROM customer WHERE c_name BETWEEN 'Customer#000000020' AND 'Customer#000000080'")
def run_range_scan(spark, sf_dir):
    return content(read.range_scan(customer_runs(spark, sf_dir), "Customer#000000020", "Customer#000000080", case_sensitive=True))


@query("SELECT c_name AS key, c_mktsegment AS value, c_custkey AS seq FROM customer WHERE c_custkey % 5 = 0")
def run_multi_get(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % 5 == 0).select(F.col("c_name").alias("key"))
    return content(read.multi_get(customer_runs(spark, sf_dir), asked))


def compacted(spark: SparkSession, sf_dir: str, kind: str, *levels: int) -> RunStore:
    """A run for each level given, of equal shares of the events, after compaction."""
    rows = events_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    runs = runs_of(spark, *[(rows.where(F.col("seq") % len(levels) == k), level) for k, level in enumerate(levels)])
    compaction.compact(runs, Settings(CompactType=kind, CompactBy="amount", MaxTables=1))
    return runs


@query(f"WITH {NEWEST} SELECT key, value, seq, 2 AS level FROM live")
def size_tiered_compaction(spark, sf_dir):
    rows = compacted(spark, sf_dir, "size_tiered", 1, 1, 1).read()
    return rows.select("key", F.col("value").cast("string").alias("value"), "seq", "level")


@query("""SELECT key, seq, tombstone, 2 AS level FROM (SELECT user_id::VARCHAR AS key, event_id AS seq, event_type = 'error' AS tombstone,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 3 <> 2) WHERE n = 1
    UNION ALL SELECT user_id::VARCHAR, event_id, event_type = 'error', 3 FROM events WHERE event_id % 3 = 2""")
def compaction_keeps_tombstones(spark, sf_dir):
    """A merge above a deeper run keeps tombstones."""
    return compacted(spark, sf_dir, "size_tiered", 1, 1, 3).read().select("key", "seq", "tombstone", "level")


@query(f"WITH {NEWEST} SELECT key, value, seq, 2 AS level FROM live")
def levelled_compaction(spark, sf_dir):
    """The next level's overlapping run is merged in as well."""
    rows = compacted(spark, sf_dir, "level", 1, 1, 2).read()
    return rows.select("key", F.col("value").cast("string").alias("value"), "seq", "level")


@query("SELECT 2::INT AS run_id")
def altered_runs(spark, sf_dir):
    """Of three runs, the one whose rows are not those of the known root."""
    rows = events_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    runs = runs_of(spark, *[(p, 1) for p in thirds(rows)])
    known = merkle.roots(runs.tree()).select("run_id", F.when(F.col("run_id") == 2, F.lit("another")).otherwise(F.col("root")).alias("root"))
    return runs.altered(known)


@query("SELECT count(*) AS records, sum(29 + strlen(user_id::VARCHAR) + strlen(event_type))::BIGINT AS bytes FROM events")
def record_sizes(spark, sf_dir):
    """The binary form of the log's rows: a header of 29 bytes, key and value."""
    rows = events_log(spark, sf_dir).select(F.octet_length(record_bytes()).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("bytes"))


def legacy_rows(spark: SparkSession, sf_dir: str) -> list[tuple[bytes, bytes, int, bool]]:
    """The nations as binary records' parts; a table of some bytes a row on the driver, as the format's writers have it."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    return [(r["n_name"].encode(), str(r["n_regionkey"]).encode(), r["n_nationkey"], r["n_nationkey"] % 4 == 0) for r in n.toLocalIterator()]


LEGACY = "SELECT n_name AS key, n_regionkey::VARCHAR AS value, n_nationkey::BIGINT AS ts, n_nationkey % 4 = 0 AS tombstone FROM nation"


@query(LEGACY)
def legacy_log_round_trip(spark, sf_dir):
    """Log segments of 100 bytes, which cut records."""
    ship(spark)
    whole, path = b"".join(legacy.log_record(*r) for r in legacy_rows(spark, sf_dir)), fresh_path(spark, "legacy-log")
    for k in range(0, len(whole), 100):
        put_bytes(spark, f"{path}/wal_{k // 100:03d}.log", whole[k : k + 100])
    return legacy.read_log(spark, path).select("key", F.col("value").cast("string").alias("value"), "ts", "tombstone")


@query(f"SELECT key, CASE WHEN tombstone THEN '' ELSE value END AS value, ts, tombstone FROM ({LEGACY})")
def legacy_table_round_trip(spark, sf_dir):
    """Table files; a tombstone's record holds no value."""
    ship(spark)
    path = fresh_path(spark, "legacy-table")
    put_bytes(spark, f"{path}/table.db", b"".join(legacy.table_record(*r) for r in legacy_rows(spark, sf_dir)))
    return legacy.read_tables(spark, path).select("key", F.col("value").cast("string").alias("value"), "ts", "tombstone")


@query(f"SELECT key, CASE WHEN tombstone THEN '' ELSE value END AS value, ts, tombstone FROM ({LEGACY})")
def legacy_compressed_round_trip(spark, sf_dir):
    """Table files whose keys are numbers of a dictionary."""
    ship(spark)
    path, rows = fresh_path(spark, "legacy-compressed"), legacy_rows(spark, sf_dir)
    put_bytes(spark, f"{path}/table.db", b"".join(legacy.table_record(*r, key_id=k) for k, r in enumerate(rows)))
    names = json.dumps({str(k): r[0].decode() for k, r in enumerate(rows)})
    return legacy.read_tables(spark, path, names).select("key", F.col("value").cast("string").alias("value"), "ts", "tombstone")


def preorder_sql(name: str, levels: int = 6) -> str:
    return f"SELECT string_agg(digest, '|' ORDER BY idx << level, -level) AS text FROM ({levels_sql(name, levels)})"


@query(f"WITH {tree_sql(NATION_LEAVES)} {preorder_sql('l')}")
def merkle_serialised(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return merkle.serialised(merkle.tree(merkle.leaves(n, F.sha1("n_name"), ["n_nationkey"]))).select("text")


@query(f"WITH {tree_sql(NATION_LEAVES)} {levels_sql('l')}")
def merkle_parsed(spark, sf_dir):
    """Nodes read back from the serialised form."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = merkle.serialised(merkle.tree(merkle.leaves(n, F.sha1("n_name"), ["n_nationkey"]))).first()["text"]
    return spark.createDataFrame(merkle.parsed(text, n.count()), "level int, idx long, digest string")


def hex_sql(cells: str, size: int, width: int) -> str:
    """Cells (place, n) as hexadecimal text of ``width`` digits each."""
    return f"SELECT string_agg(lpad(to_hex(coalesce(n, 0)), {width}, '0'), '' ORDER BY i) FROM range({size}) t(i) LEFT JOIN ({cells}) ON place = i"


def seeds_hex(k: int) -> str:
    return "".join(seed_bytes(1000 + i).hex() for i in range(k))


SMALL_M, SMALL_K = bloom.sized(50, 0.01)
SMALL_BITS = " UNION ".join(f"SELECT {place_sql('event_type', SMALL_M, i)} AS place, 1 AS n FROM events" for i in range(SMALL_K))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("e"), "event_id")


def hexed(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower(F.hex("payload")).alias("payload"))


@query(f"SELECT '{SMALL_M:08x}' || lower(({hex_sql(SMALL_BITS, SMALL_M, 2)})) || '{SMALL_K:08x}{seeds_hex(SMALL_K)}' AS payload")
def bloom_payload(spark, sf_dir):
    return hexed(bloom.payload(bloom.bits(event_types(spark, sf_dir), "e", SMALL_M, SMALL_K), SMALL_M, SMALL_K))


@query(f"SELECT '{CMS_M:08x}{CMS_K:08x}{seeds_hex(CMS_K)}' || lower(({hex_sql(f'SELECT row * {CMS_M} + col AS place, n FROM ({CMS_CELLS})', CMS_M * CMS_K, 8)})) AS payload")
def cms_payload(spark, sf_dir):
    return hexed(cms.payload(cms.cells(event_types(spark, sf_dir), "e", 0.1, 0.1), 0.1, 0.1))


@query(f"SELECT '{64:016x}06' || lower(({hex_sql('SELECT bucket AS place, rank AS n FROM (' + hll_sql('user_id::VARCHAR', 'events', 6) + ')', 64, 2)})) AS payload")
def hll_payload(spark, sf_dir):
    return hexed(hll.payload(hll_registers(spark, sf_dir), 6))


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, value binary, ts timestamp, seq long, tombstone boolean, crc long")


def seconds(n: int):
    return datetime.fromtimestamp(n, UTC)


@query(f"""WITH b AS (SELECT place AS bit FROM ({SMALL_BITS}) UNION {" UNION ".join(f"SELECT {place_sql('c_mktsegment', SMALL_M, i)} FROM customer" for i in range(SMALL_K))}),
    q AS ({" UNION ".join(f"SELECT n_name AS e, {place_sql('n_name', SMALL_M, i)} AS bit FROM nation UNION SELECT c_mktsegment, {place_sql('c_mktsegment', SMALL_M, i)} FROM customer" for i in range(SMALL_K))})
    SELECT e, bool_and(b.bit IS NOT NULL) AS maybe FROM q LEFT JOIN b USING (bit) GROUP BY 1""")
def bloom_instance(spark, sf_dir):
    """A filter stored under its name, added to and checked."""
    segments = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("e"))
    made = bloom.payload(bloom.bits(event_types(spark, sf_dir), "e", SMALL_M, SMALL_K), SMALL_M, SMALL_K)
    rows = instances.store(empty_log(spark), "bloom", "seen", made, seconds(1))
    rows = instances.bloom_add(rows, "seen", segments, "e", seconds(2))
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("e")).unionByName(segments)
    return instances.bloom_check(rows, "seen", asked, "e")


@query(f"""WITH c AS (SELECT row, col, 2 * n AS n FROM ({CMS_CELLS})), q AS ({" UNION ALL ".join(f"SELECT DISTINCT event_type AS e, {i} AS row, {place_sql('event_type', CMS_M, i)} AS col FROM events" for i in range(CMS_K))})
    SELECT e, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM q JOIN c USING (row, col) GROUP BY 1""")
def cms_instance(spark, sf_dir):
    """A sketch stored under its name, added to and asked."""
    e = event_types(spark, sf_dir)
    rows = instances.store(empty_log(spark), "cms", "often", cms.payload(cms.cells(e, "e", 0.1, 0.1), 0.1, 0.1), seconds(1))
    return instances.cms_frequency(instances.cms_add(rows, "often", e, "e", seconds(2)), "often", e, "e")


@query(estimate_sql("SELECT bucket, max(rank) AS rank FROM (" + hll_sql("user_id::VARCHAR", "events", 10) + " UNION ALL " + hll_sql("c_name", "customer", 10) + ") GROUP BY 1", 10))
def hll_instance(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("e"))
    rows = instances.store(empty_log(spark), "hll", "users", hll.payload(hll.registers(e, "e", 10), 10), seconds(1))
    rows = instances.hll_add(rows, "users", spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("e")), "e", seconds(2))
    return instances.hll_cardinality(rows, "users").select(F.round("estimate", 6).alias("estimate"))


@query("SELECT 'often' AS dropped, 0::BIGINT AS found, true AS raised")
def instance_delete(spark, sf_dir):
    """An instance deleted twice: it is gone, and the second deletion raises."""
    e = event_types(spark, sf_dir)
    rows = instances.store(empty_log(spark), "cms", "often", cms.payload(cms.cells(e, "e", 0.1, 0.1), 0.1, 0.1), seconds(1))
    rows = instances.drop(rows, "cms", "often", seconds(2))
    try:
        instances.drop(rows, "cms", "often", seconds(3))
        raised = False
    except KeyError:
        raised = True
    return spark.createDataFrame([("often", instances.fetch(rows, "cms", "often").count(), raised)], "dropped string, found long, raised boolean")


@query(f"WITH {SIMHASH_PRINTS} SELECT bit_count(xor((SELECT fp FROM prints WHERE doc_id = 0), (SELECT fp FROM prints WHERE doc_id = 1)))::INT AS distance")
def simhash_instance(spark, sf_dir):
    """Two stored fingerprints and their distance."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id in (0, 1)").select("doc_id", "text").collect()}
    rows = empty_log(spark)
    for k in (0, 1):
        rows = instances.store_fingerprint(rows, f"d{k}", texts[k], seconds(k + 1))
    return spark.createDataFrame([(instances.fingerprint_distance(rows, "d0", "d1"),)], "distance int")


@query("SELECT (i + 1)::VARCHAR AS key, 1000::BIGINT AS n FROM range(100) t(i)")
def load_generator(spark, sf_dir):
    """How often the shuffled load of a hundred keys puts each."""
    return generators.load_100(spark).groupBy("key").agg(F.count_distinct("seq").alias("n"))


@query("SELECT c_name AS key, (row_number() OVER (ORDER BY c_name) - 1) // 10 AS batch FROM customer WHERE c_name LIKE 'Customer#00000000%'")
def iterator_batches(spark, sf_dir):
    """The batches that an iterator hands out, as rows."""
    found = read.prefix_scan(table_log(spark, sf_dir, "customer", "c_name", "c_mktsegment", "c_custkey"), "Customer#00000000")
    rows = [(r["key"], n) for n, batch in enumerate(read.iterate_steps(found, 10)) for r in batch]
    return spark.createDataFrame(rows, "key string, batch long")


@query("SELECT 2::BIGINT AS dropped, 2::BIGINT AS kept, count(*) AS rows FROM events")
def log_truncation(spark, sf_dir):
    """A log of four batches, cut below the third; a run holds what went."""
    out, events = fresh_path(spark, "truncated"), spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4, "event_id").write.parquet(f"{out}/events")
    stream = ingest.source(spark, f"{out}/events", files_a_batch=1)
    mutations = log.as_log(stream, F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("event_id"), F.col("event_type") == "error")
    ingest.ingest(mutations, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    old = spark.read.parquet(*[f"{out}/log/batch={k}" for k in range(2)])
    runs = runs_of(spark, (old.withColumn("ts", F.col("ts").cast("timestamp")), 1))
    dropped = ingest.truncate(spark, f"{out}/log", 2)
    left = spark.read.parquet(f"{out}/log")
    whole = runs.read().select("seq").unionByName(left.select("seq"))
    return whole.agg(F.lit(dropped).cast("long").alias("dropped"), F.lit(left.select("batch").distinct().count()).alias("kept"), F.count_distinct("seq").alias("rows"))


@query(ORACLES["token_bucket_admission"])
def stream_admission(spark, sf_dir):
    """The batch query's admissions, by a stream with a state for each key."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = fresh_path(spark, "stream-admission")
    e = ingest.source(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts")
    ingest.start(admit_stream(e, 3, 1, 86_400), lambda rows: rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("key", "seq", "admitted", "tokens")
