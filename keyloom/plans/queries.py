"""All queries of the keyed operators on the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as gf
from ..functions import text as tx
from ..operators import geo, hashes, jsondoc, keyspace, lists, search, sets, sketches, streams, strings, timeseries, vectors, zsets
from ..sources import log as logs
from ..sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _add(name: str, f: Query, sql: str | None = None) -> None:
    query(name, sql)(f)


# --- key space -------------------------------------------------------------


def _now() -> Column:
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


_SPACE = """(select c_name as key, 'zset' as type, case when c_custkey % 3 = 0 then timestamp '2024-01-10 00:00:00' + to_hours((c_custkey % 480)::int) end as expire_at from customer
    union all select s_name, 'set', null from supplier)"""


def _space(s: SparkSession, d: str) -> DataFrame:
    c = src.table(s, d, "customer")
    at = F.when(F.col("c_custkey") % 3 == 0, F.timestamp_millis(F.lit(1704844800000) + (F.col("c_custkey") % 480) * 3_600_000))
    return keyspace.key_space({"zset": c.select(F.col("c_name").alias("key"), at.alias("expire_at")), "set": src.table(s, d, "supplier").select(F.col("s_name").alias("key"))})


def _names(s: SparkSession, d: str) -> DataFrame:
    """Names asked for: suppliers and the names of parts, repeated ones too."""
    return src.table(s, d, "lineitem").select(F.format_string("Supplier#%09d", F.col("l_suppkey") * 2).alias("key"))


_ASKED = "(select format('Supplier#{:09d}', l_suppkey * 2) as key from lineitem)"

_add("keys_glob", lambda s, d: keyspace.keys(_space(s, d), "*[13579]?", _now()), f"select key from {_SPACE} where (expire_at is null or expire_at > timestamp '2024-01-20') and regexp_matches(key, '^.*[13579].$', 's')")
_add("scan_page", lambda s, d: keyspace.scan(_space(s, d), after="Customer#000000050", pattern="Customer*", count=20, kind="zset"), f"select key, type from {_SPACE} where key like 'Customer%' and key > 'Customer#000000050' and type = 'zset' order by 1, 2 limit 20")
_add("exists_count", lambda s, d: keyspace.exists(_space(s, d), _names(s, d)), f"select count(*) as n from {_ASKED} a where a.key in (select key from {_SPACE})")
_add("exist_in", lambda s, d: keyspace.exist_in(_space(s, d), _names(s, d)), f"select distinct key from {_ASKED} a where a.key in (select key from {_SPACE})")
_add("type_of", lambda s, d: keyspace.type_of(_space(s, d), _names(s, d).distinct()), f"select a.key, coalesce(k.type, 'none') as type from (select distinct key from {_ASKED}) a left join {_SPACE} k on a.key = k.key")
_add("object_encoding", lambda s, d: keyspace.encoding_of(_space(s, d)), f"select key, case type when 'zset' then 'skiplist' else 'hashtable' end as encoding, 1 as refcount, 0 as idletime, 0 as freq from {_SPACE}")
_add("del_keys", lambda s, d: keyspace.delete(_space(s, d), _names(s, d)).select("key", "type"), f"select key, type from {_SPACE} where key not in (select key from {_ASKED})")
_add("rename", lambda s, d: keyspace.rename(_space(s, d), "Customer#000000001", "Customer#000000002").groupBy("key").agg(F.count("*").alias("n")), f"select key, count(*) as n from (select case when key = 'Customer#000000001' then 'Customer#000000002' else key end as key from {_SPACE} where key <> 'Customer#000000002') group by 1")
_add("renamenx", lambda s, d: keyspace.rename_nx(keyspace.rename_nx(_space(s, d), "Customer#000000001", "Customer#000000002"), "Customer#000000003", "Fresh").select("key"), f"select case when key = 'Customer#000000003' then 'Fresh' else key end as key from {_SPACE}")
_add("copy_key", lambda s, d: keyspace.copy(src.zset(s, d), "1", "copy").select("key", "member", "score"), "select c_nationkey::varchar as key, c_name as member, c_acctbal as score from customer union all select 'copy', c_name, c_acctbal from customer where c_nationkey = 1")
_add("ttl", lambda s, d: keyspace.deadlines(_space(s, d), _space(s, d).select("key").union(s.range(1).select(F.lit("absent"))), _now()), f"""
    select key, case when expire_at is null then -1 else round((epoch_us(expire_at) - epoch_us(timestamp '2024-01-20')) / 1e6) end::bigint as ttl,
        case when expire_at is null then -1 else epoch_ms(expire_at) - epoch_ms(timestamp '2024-01-20') end::bigint as pttl,
        case when expire_at is null then -1 else epoch_ms(expire_at) // 1000 end::bigint as expiretime, case when expire_at is null then -1 else epoch_ms(expire_at) end::bigint as pexpiretime from {_SPACE}
    union all select 'absent', -2, -2, -2, -2""")
_add("expire", lambda s, d: keyspace.expire(_space(s, d), _names(s, d), _now(), 60_000).select("key", F.coalesce(F.unix_millis("expire_at"), F.lit(-1)).alias("at")), f"select key, case when key in (select key from {_ASKED}) then epoch_ms(timestamp '2024-01-20') + 60000 else coalesce(epoch_ms(expire_at), -1) end as at from {_SPACE}")
_add("persist", lambda s, d: keyspace.persist(_space(s, d), _space(s, d).where(F.col("key").endswith("5"))).agg(F.count("expire_at").alias("n")), f"select count(expire_at) as n from {_SPACE} where key not like '%5'")
_add("dbsize", lambda s, d: keyspace.size(_space(s, d)), f"select count(distinct key) as n from {_SPACE}")
_add("getver", lambda s, d: keyspace.versions(src.order_log(s, d)), "select o_custkey::varchar as key, count(*) as version from orders group by 1")
_add("move_db", lambda s, d: keyspace.swap(keyspace.move(src.zset(s, d).withColumn("db", F.lit(0)), "3", 0, 1), 0, 2).groupBy("db").agg(F.count("*").alias("n")), "select case when c_nationkey = 3 then 1 else 2 end as db, count(*) as n from customer group by 1")
_add("sort_by_get", lambda s, d: keyspace.sort(
    src.table(s, d, "customer").select(F.col("c_custkey").alias("value")),
    by=src.table(s, d, "customer").select(F.col("c_custkey").alias("value"), F.col("c_acctbal").alias("weight")),
    get=src.table(s, d, "customer").select(F.col("c_custkey").alias("value"), F.col("c_name").alias("result")), descending=True, offset=5, limit=10),
    "select c_custkey as value, c_acctbal as weight, c_name as result from customer order by c_acctbal desc, c_custkey desc limit 10 offset 5")
_add("dump_restore", lambda s, d: keyspace.restore(keyspace.dump(strings.last_write(src.order_log(s, d), "key").withColumn("expire_at", F.lit(None).cast("timestamp")), _now())).select("key", F.col("value").cast("string").alias("value")), "select o_custkey::varchar as key, arg_max(o_orderstatus, o_orderkey) as value from orders group by 1")

# --- strings, counters, bits -------------------------------------------------

_add("set_lww", lambda s, d: strings.last_write(src.order_log(s, d), "key").select("key", "value", "cents", "seq"), "select o_custkey::varchar as key, arg_max(o_orderstatus, o_orderkey) as value, arg_max(round(o_totalprice * 100)::bigint, o_orderkey) as cents, max(o_orderkey) as seq from orders group by 1")
_add("set_nx", lambda s, d: strings.first_write(src.order_log(s, d), "key").select("key", "value", "seq"), "select o_custkey::varchar as key, arg_min(o_orderstatus, o_orderkey) as value, min(o_orderkey) as seq from orders group by 1")
_add("mget", lambda s, d: strings.mget(strings.last_write(src.order_log(s, d), "key"), ["7", "1", "none", "7"]), """
    select a.pos, a.key, v.value from (values (0, '7'), (1, '1'), (2, 'none'), (3, '7')) a(pos, key)
    left join (select o_custkey::varchar as key, arg_max(o_orderstatus, o_orderkey) as value from orders group by 1) v on a.key = v.key""")
_add("getset_lag", lambda s, d: strings.getset(src.order_log(s, d)).select("key", "seq", "value", "old"), "select o_custkey::varchar as key, o_orderkey as seq, o_orderstatus as value, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as old from orders")
_add("append_agg", lambda s, d: strings.append(src.order_log(s, d)), "select o_custkey::varchar as key, string_agg(o_orderstatus, '' order by o_orderkey) as value, count(*) as length from orders group by 1")
_add("strlen", lambda s, d: strings.strlen(src.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))), "select p_partkey as key, strlen(p_name) as length from part")
_add("getrange", lambda s, d: strings.getrange(src.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")), 2, -3), "select p_partkey as key, case when len(p_name) > 2 and 2 <= len(p_name) - 2 then substr(p_name, 3, len(p_name) - 4) end as part from part")
_add("setrange", lambda s, d: strings.setrange(src.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")), 3, "XY").select("key", F.col("value").cast("string").alias("value")), "select p_partkey as key, substr(p_name, 1, 3) || 'XY' || substr(p_name, 6) as value from part")
_add("incr_counter", lambda s, d: strings.counters(src.series(s, d).select("key", F.lit(1).alias("delta"))), "select user_id as key, count(*) as value from events group by 1")
_add("incrby", lambda s, d: strings.counters(src.order_log(s, d).select("key", F.col("cents").alias("delta"))), "select o_custkey::varchar as key, sum(round(o_totalprice * 100)::bigint)::bigint as value from orders group by 1")
_add("decrby", lambda s, d: strings.counters(src.order_log(s, d).select("key", (-F.col("cents")).alias("delta"))), "select o_custkey::varchar as key, -sum(round(o_totalprice * 100)::bigint)::bigint as value from orders group by 1")
_add("incrbyfloat", lambda s, d: strings.counters(src.series(s, d).select("key", F.col("value").alias("delta"))).select("key", F.round("value", 4).alias("value")), "select user_id as key, round(sum(value), 4) as value from events group by 1")


def _offsets(s: SparkSession, d: str) -> DataFrame:
    return src.table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("off")).distinct()


_add("bitcount", lambda s, d: strings.bitmap(_offsets(s, d)).groupBy("key").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n")), "select event_type as key, count(distinct user_id)::bigint as n from events group by 1")
_add("bitop_and", lambda s, d: strings.bitop(_offsets(s, d), "and", ["click", "view", "purchase"]), "select user_id as off from events where event_type in ('click', 'view', 'purchase') group by 1 having count(distinct event_type) = 3")
_add("bitpos", lambda s, d: strings.bitmap_pos(_offsets(s, d)), "select event_type as key, min(user_id) as pos from events group by 1")
_add("getbit", lambda s, d: strings.getbit(src.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")), 9), "select p_partkey as key, case when len(p_name) > 1 then (ascii(substr(p_name, 2, 1)) >> 1) & 1 else 0 end::int as bit from part")
_add("setbit", lambda s, d: strings.setbit(src.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")), 0, 1).select("key", "old", F.col("value").cast("string").alias("value")), "select p_partkey as key, (ascii(p_brand) & 1)::int as old, chr(ascii(p_brand) | 1) || substr(p_brand, 2) as value from part")
_add("bitcount_bytes", lambda s, d: strings.bitcount(src.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")), 0, 2), "select p_partkey as key, (bit_count(ascii(p_brand)) + bit_count(ascii(substr(p_brand, 2, 1))) + bit_count(ascii(substr(p_brand, 3, 1))))::bigint as n from part")
_add("lcs", lambda s, d: strings.lcs(src.table(s, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))).select("p_partkey", "lcs", "length"))

# --- hashes --------------------------------------------------------------------

_HASH = "(select o_custkey::varchar as key, o_orderpriority as field, arg_max(o_orderstatus, o_orderkey) as value from orders group by 1, 2)"


def _hash(s: SparkSession, d: str) -> DataFrame:
    return hashes.hset(src.order_log(s, d)).select("key", "field", "value")


_add("hset_lww", _hash, f"select * from {_HASH}")
_add("hsetnx", lambda s, d: hashes.hsetnx(src.order_log(s, d)).select("key", "field", "value"), "select o_custkey::varchar as key, o_orderpriority as field, arg_min(o_orderstatus, o_orderkey) as value from orders group by 1, 2")
_add("hget", lambda s, d: hashes.hget(_hash(s, d), "7", "1-URGENT"), f"select value from {_HASH} where key = '7' and field = '1-URGENT'")
_add("hmget", lambda s, d: hashes.hmget(_hash(s, d), ["1-URGENT", "none", "5-LOW"]).select("key", F.array_join("values", ",", "-").alias("values")), f"select key, coalesce(max(case when field = '1-URGENT' then value end), '-') || ',-,' || coalesce(max(case when field = '5-LOW' then value end), '-') as values from {_HASH} group by 1")
_add("hgetall", lambda s, d: hashes.hgetall(_hash(s, d)).select("key", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields")), f"select key, string_agg(field || '=' || value, ',' order by field) as fields from {_HASH} group by 1")
_add("hkeys", lambda s, d: hashes.hkeys(_hash(s, d)).select("key", F.array_join("fields", ",").alias("fields")), f"select key, string_agg(field, ',' order by field) as fields from {_HASH} group by 1")
_add("hvals", lambda s, d: hashes.hvals(_hash(s, d)).select("key", F.array_join("values", ",").alias("values")), f"select key, string_agg(value, ',' order by field) as values from {_HASH} group by 1")
_add("hlen", lambda s, d: hashes.hlen(_hash(s, d)), f"select key, count(*) as n from {_HASH} group by 1")
_add("hexists", lambda s, d: hashes.hexists(_hash(s, d), "5-LOW"), f"select key, max((field = '5-LOW')::int) as found from {_HASH} group by 1")
_add("hstrlen", lambda s, d: hashes.hstrlen(_hash(s, d)), f"select key, field, strlen(value) as length from {_HASH}")
_add("hdel", lambda s, d: hashes.hdel(_hash(s, d), _hash(s, d).where(F.col("value") == "F")), f"select * from {_HASH} where value <> 'F'")
_add("hincrby", lambda s, d: hashes.hincrby(src.order_log(s, d), "cents"), "select o_custkey::varchar as key, o_orderpriority as field, sum(round(o_totalprice * 100)::bigint)::bigint as value from orders group by 1, 2")
_add("hincrbyfloat", lambda s, d: hashes.hincrby(src.series(s, d).select("key", F.col("event_type").alias("field"), F.col("value").alias("delta"))).select("key", "field", F.round("value", 4).alias("value")), "select user_id as key, event_type as field, round(sum(value), 4) as value from events group by 1, 2")
_add("hscan", lambda s, d: hashes.hscan(_hash(s, d), "[1-2]-*"), f"select * from {_HASH} where regexp_matches(field, '^[1-2]-')")
_add("hrandfield", lambda s, d: hashes.hrandfield(_hash(s, d), 2, 7).groupBy("key").agg(F.count_distinct("field").alias("n")), f"select key, least(count(*), 2) as n from {_HASH} group by 1")
_add("httl", lambda s, d: hashes.httl(hashes.hexpire(_hash(s, d).withColumn("field_expire_at", F.lit(None).cast("timestamp")), _hash(s, d).where(F.col("field") == "5-LOW"), F.timestamp_millis(F.unix_millis(_now()) + 61_500)), _hash(s, d), _now()), f"select key, field, case when field = '5-LOW' then 61 else -1 end::bigint as ttl, case when field = '5-LOW' then 61500 else -1 end::bigint as pttl from {_HASH}")

# --- lists -----------------------------------------------------------------------

_LIST = """(select l_orderkey as key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos, l_partkey as value from lineitem)"""
_NUMBERED = f"(select *, row_number() over (partition by key order by pos) - 1 as i, count(*) over (partition by key) as n from {_LIST})"
_L = src.lists


def _order_pushes(s: SparkSession, d: str) -> DataFrame:
    """Two values for the list of each order."""
    o = src.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    return o.select("key", F.posexplode(F.array("o_custkey", -F.col("o_custkey"))).alias("seq", "value"))


_ENDS = f"(select o_orderkey as key, o_custkey as c, n, hi from orders left join (select key, count(*) as n, max(pos) as hi from {_LIST} group by 1) e on o_orderkey = e.key)"
_add("rpush", lambda s, d: lists.push(_L(s, d), _order_pushes(s, d)), f"select key, pos, value from {_LIST} union all select key, coalesce(hi, -1) + 1, c from {_ENDS} union all select key, coalesce(hi, -1) + 2, -c from {_ENDS}")
_add("lpush", lambda s, d: lists.indexed(lists.push(_L(s, d), _order_pushes(s, d), left=True)).select("key", "i", "n", "value"), f"select key, 0 as i, coalesce(n, 0) + 2 as n, -c as value from {_ENDS} union all select key, 1, coalesce(n, 0) + 2, c from {_ENDS} union all select l.key, i + 2, l.n + case when e.key is null then 0 else 2 end, value from {_NUMBERED} l left join {_ENDS} e on l.key = e.key")
_add("llen", lambda s, d: lists.llen(_L(s, d)), "select l_orderkey as key, count(*) as n from lineitem group by 1")
_add("lindex", lambda s, d: lists.lindex(_L(s, d), -2), f"select key, value from {_NUMBERED} where i = n - 2")
_add("lrange", lambda s, d: lists.lrange(_L(s, d), 1, -2).select("key", "i", "value"), f"select key, i, value from {_NUMBERED} where i >= 1 and i <= n - 2")
_add("ltrim", lambda s, d: lists.ltrim(_L(s, d), -3, 1), f"select key, pos, value from {_NUMBERED} where i >= greatest(n - 3, 0) and i <= 1")
_add("lpop_n", lambda s, d: lists.pop(_L(s, d), 2)[0].select("key", "rank", "value"), f"select key, (i + 1)::int as rank, value from {_NUMBERED} where i < 2")
_add("rpop_n", lambda s, d: lists.pop(_L(s, d), 2, right=True)[0].select("key", "rank", "value"), f"select key, (n - i)::int as rank, value from {_NUMBERED} where i >= n - 2")
_add("lset", lambda s, d: lists.lset(_L(s, d), 1, 77).select("key", "pos", F.col("value").cast("long").alias("value")), f"select key, pos, case when i = 1 then 77 else value end as value from {_NUMBERED}")
_add("lrem", lambda s, d: lists.lrem(_L(s, d).withColumn("value", F.col("value") % 3), -1, 1), f"select key, pos, v as value from (select *, value % 3 as v, row_number() over (partition by key, value % 3 = 1 order by pos desc) as k from {_LIST}) where not (v = 1 and k <= 1)")
_add("linsert", lambda s, d: lists.linsert(_L(s, d).withColumn("value", F.col("value") % 3), 1, 9), f"""
    with l as (select key, i, value % 3 as v from {_NUMBERED}), p as (select key, min(i) as place from l where v = 1 group by 1)
    select l.key, case when p.place is null or l.i < p.place then l.i else l.i + 1 end as i, l.v as value from l left join p on l.key = p.key union all select key, place, 9 from p""")
_add("lmpop", lambda s, d: lists.lmpop(_L(s, d).withColumn("key", F.col("key").cast("string")), ["-5", "3", "1"], 2), f"select key::varchar as key, (i + 1)::int as rank, value from {_NUMBERED} where i < 2 and key = coalesce((select max(key) from {_LIST} where key = 3), 1)")
_add("rpoplpush", lambda s, d: lists.llen(lists.rpoplpush(_L(s, d).withColumn("key", F.col("key").cast("string")), "1", "moved")), f"select key::varchar as key, count(*) - (key = 1)::int as n from {_LIST} group by key having count(*) - (key = 1)::int > 0 union all select 'moved', 1")
_add("list_array", lambda s, d: lists.as_array(_L(s, d)).select("key", F.array_join("items", ",").alias("items")), f"select key, string_agg(value, ',' order by pos) as items from {_LIST} group by 1")

# --- sets ------------------------------------------------------------------------

_SET = "(select distinct o_orderstatus as key, o_custkey as member from orders)"
_S = src.sets
_add("sinter", lambda s, d: sets.sinter(_S(s, d), ["F", "O"]), "select o_custkey as member from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
_add("sinter_n", lambda s, d: sets.sinter(_S(s, d), ["F", "O", "P"]), f"select member from {_SET} where key in ('F', 'O', 'P') group by 1 having count(*) = 3")
_add("sunion", lambda s, d: sets.sunion(_S(s, d), ["F", "P"]), "select o_custkey as member from orders where o_orderstatus = 'F' union select o_custkey from orders where o_orderstatus = 'P'")
_add("sdiff", lambda s, d: sets.sdiff(_S(s, d), ["O", "P", "F"]), "select o_custkey as member from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderstatus in ('P', 'F')")
_add("sintercard", lambda s, d: sets.sintercard(_S(s, d), ["F", "O"], 50), f"select least(count(*), 50) as n from (select member from {_SET} where key in ('F', 'O') group by 1 having count(*) = 2)")
_add("scard", lambda s, d: sets.scard(_S(s, d)), f"select key, count(*) as n from {_SET} group by 1")
_add("smismember", lambda s, d: sets.smismember(_S(s, d), "P", src.table(s, d, "customer").select(F.col("c_custkey").alias("member"))), f"select c_custkey as member, (c_custkey in (select member from {_SET} where key = 'P'))::int as found from customer")
_add("smembers", lambda s, d: sets.smembers(_S(s, d), "P"), f"select member from {_SET} where key = 'P'")
_add("sadd", lambda s, d: sets.scard(sets.sadd(_S(s, d), src.table(s, d, "customer").select(F.lit("P").alias("key"), F.col("c_custkey").alias("member")))), f"select key, count(*) as n from (select * from {_SET} union select 'P', c_custkey from customer) group by 1")
_add("srem", lambda s, d: sets.srem(_S(s, d), _S(s, d).where(F.col("member") % 2 == 0)), f"select * from {_SET} where member % 2 <> 0")
_add("sstore", lambda s, d: sets.scard(sets.stored(_S(s, d), "P", sets.sdiff(_S(s, d), ["F", "O"]))), f"select key, count(*) as n from (select * from {_SET} where key <> 'P' union all (select 'P', member from {_SET} where key = 'F' except select 'P', member from {_SET} where key = 'O')) group by 1")
_add("sscan", lambda s, d: sets.sscan(_S(s, d), "1?"), f"select key, member from {_SET} where member between 10 and 19")
_add("spop", lambda s, d: sets.scard(sets.spop(_S(s, d), 3, 5)[1]), f"select key, count(*) - 3 as n from {_SET} group by 1 having count(*) > 3")
_add("srandmember", lambda s, d: sets.srandmember(_S(s, d), -7, 5).groupBy("key").agg(F.count("*").alias("n")), f"select key, 7 as n from {_SET} group by 1")
_add("smove", lambda s, d: sets.smove(_S(s, d), "F", "Q", 1).groupBy("key").agg(F.sum("member").alias("total")), f"select key, sum(member)::bigint as total from (select distinct case when key = 'F' and member = 1 then 'Q' else key end as key, member from {_SET}) group by 1")

# --- scored sets -------------------------------------------------------------------

_Z = "(select c_nationkey::varchar as key, c_name as member, c_acctbal as score from customer)"
_UP = f"(select *, row_number() over (partition by key order by score, member) - 1 as rank, count(*) over (partition by key) as n from {_Z})"
_DOWN = f"(select *, row_number() over (partition by key order by score desc, member desc) - 1 as rank from {_Z})"
_T = "(select o_orderstatus as key, o_custkey::varchar as member, sum(round(o_totalprice * 100)::bigint)::double as score from orders group by 1, 2)"
_add("zrange", lambda s, d: zsets.zrange(src.zset(s, d), 1, -3), f"select key, member, score, rank from {_UP} where rank between 1 and n - 3")
_add("zrevrange", lambda s, d: zsets.zrange(src.zset(s, d), 0, 4, reverse=True), f"select * from {_DOWN} where rank <= 4")
_add("zrank", lambda s, d: zsets.ranked(src.zset(s, d)), f"select key, member, score, rank from {_UP}")
_add("zrevrank", lambda s, d: zsets.ranked(src.zset(s, d), reverse=True), f"select * from {_DOWN}")
_add("zcount", lambda s, d: zsets.zcount(src.zset(s, d), "(0", "5000"), f"select key, count(*) filter (score > 0 and score <= 5000) as n from {_Z} group by 1")
_add("zcard", lambda s, d: zsets.zcard(src.zset(s, d)), f"select key, count(*) as n from {_Z} group by 1")
_add("zlexcount", lambda s, d: zsets.zlexcount(src.zset(s, d), "[Customer#000000100", "+"), f"select key, count(*) filter (member >= 'Customer#000000100') as n from {_Z} group by 1")
_add("zrangebyscore", lambda s, d: zsets.zrangebyscore(src.zset(s, d), "1000", "+inf", offset=1, limit=3), f"select * from (select key, member, score, row_number() over (partition by key order by score, member) - 1 as rank from {_Z} where score >= 1000) where rank between 1 and 3")
_add("zrevrangebyscore", lambda s, d: zsets.zrangebyscore(src.zset(s, d), "-inf", "(1000", reverse=True, limit=2), f"select * from (select key, member, score, row_number() over (partition by key order by score desc, member desc) - 1 as rank from {_Z} where score < 1000) where rank < 2")
_add("zrangebylex", lambda s, d: zsets.zrangebylex(src.zset(s, d), "(Customer#000000050", "[Customer#000000100").select("key", "member", "score"), f"select * from {_Z} where member > 'Customer#000000050' and member <= 'Customer#000000100'")
_add("zpopmin", lambda s, d: zsets.zpop(src.zset(s, d), 2)[0], f"select key, member, score, rank from {_UP} where rank < 2")
_add("zpopmax", lambda s, d: zsets.zpop(src.zset(s, d), 2, largest=True)[0], f"select * from {_DOWN} where rank < 2")
_add("zmpop", lambda s, d: zsets.zmpop(src.zset(s, d), ["none", "4", "2"], 3, largest=True), f"select * from {_DOWN} where key = '4' and rank < 3")
_add("zincrby", lambda s, d: zsets.zincrby(src.order_log(s, d).select(F.col("value").alias("key"), F.col("key").alias("member"), F.col("cents").alias("delta"))), "select o_orderstatus as key, o_custkey::varchar as member, sum(round(o_totalprice * 100)::bigint)::bigint as score from orders group by 1, 2")
_add("zadd", lambda s, d: zsets.zadd(src.order_log(s, d).select(F.col("value").alias("key"), F.col("key").alias("member"), F.col("cents").alias("score"), "seq")), "select o_orderstatus as key, o_custkey::varchar as member, arg_max(round(o_totalprice * 100)::bigint, o_orderkey) as score from orders group by 1, 2")
_add("zmscore", lambda s, d: zsets.zmscore(src.zset(s, d), "4", src.table(s, d, "customer").select(F.col("c_name").alias("member"))), f"select c_name as member, z.score from customer left join (select * from {_Z} where key = '4') z on c_name = z.member")
_add("zrem", lambda s, d: zsets.zrem(src.zset(s, d), src.zset(s, d).where(F.col("score") < 0)), f"select * from {_Z} where score >= 0")
_add("zremrangebyscore", lambda s, d: zsets.zremrangebyscore(src.zset(s, d), "0", "(2000"), f"select * from {_Z} where not (score >= 0 and score < 2000)")
_add("zremrangebyrank", lambda s, d: zsets.zremrangebyrank(src.zset(s, d), 0, 2), f"select key, member, score from {_UP} where rank > 2")
_add("zremrangebylex", lambda s, d: zsets.zremrangebylex(src.zset(s, d), "-", "[Customer#000000100"), f"select * from {_Z} where member > 'Customer#000000100'")
_add("zscan", lambda s, d: zsets.zscan(src.zset(s, d), "*7"), f"select key, member, printf('%.10f', score) as score from {_Z} where member like '%7'")
for _agg in ("sum", "min", "max"):
    _add(f"zunion_{_agg}", lambda s, d, a=_agg: zsets.zunion(src.order_totals(s, d), ["F", "O"], [2.0, 3.0], a), f"select member, {_agg}(score * case key when 'F' then 2 else 3 end) as score from {_T} where key in ('F', 'O') group by 1")
    _add(f"zinter_{_agg}", lambda s, d, a=_agg: zsets.zinter(src.order_totals(s, d), ["F", "O"], None, a), f"select member, {_agg}(score) as score from {_T} where key in ('F', 'O') group by 1 having count(*) = 2")
_add("zdiff", lambda s, d: zsets.zdiff(src.order_totals(s, d), ["F", "P"]), f"select member, score from {_T} where key = 'F' and member not in (select member from {_T} where key = 'P')")
_add("zstore", lambda s, d: zsets.zcard(zsets.stored(src.order_totals(s, d), "U", zsets.zunion(src.order_totals(s, d), ["F", "O"]))), f"select key, count(*) as n from {_T} group by 1 union all select 'U', count(distinct member) from {_T} where key in ('F', 'O')")

# --- places ------------------------------------------------------------------------

_P = "(select event_type as key, event_id::varchar as member, (event_id * 7919 % 36000) / 100.0::double - 180 as lon, (event_id * 104729 % 17000) / 100.0::double - 85 as lat from events)"


def _sql_distance(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(asin(sqrt(least(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2), 1.0))) * {2 * gf.RADIUS!r})"


_add("geoadd_cell", lambda s, d: geo.geoadd(src.places(s, d)).select("key", "member", "cell"), f"""
    with c as (select key, member, least(floor((lon + 180) / 360 * 67108864), 67108863)::bigint as x, least(floor((lat + 90) / 180 * 67108864), 67108863)::bigint as y from {_P})
    select key, member, list_sum(list_transform(range(26), lambda i: (((x >> (25 - i)) & 1) * 2 + ((y >> (25 - i)) & 1)) << (2 * (25 - i))))::bigint as cell from c""")
_add("geohash", lambda s, d: geo.geohash(src.places(s, d)), f"""
    with c as (select key, member, least(floor((lon + 180) / 360 * 4294967296), 4294967295)::bigint as x, least(floor((lat + 90) / 180 * 4294967296), 4294967295)::bigint as y from {_P}),
    e as (select key, member,
        list_sum(list_transform(range(16), lambda i: (((x >> (31 - i)) & 1) * 2 + ((y >> (31 - i)) & 1)) << (2 * (15 - i))))::double * 4294967296.0::double
        + list_sum(list_transform(range(16), lambda i: (((x >> (15 - i)) & 1) * 2 + ((y >> (15 - i)) & 1)) << (2 * (15 - i))))::double as score from c),
    h as (select key, member, floor(score / 4294967296.0::double)::bigint as hi, score from e),
    g as (select key, member, hi, (score - hi::double * 4294967296.0::double)::bigint as lo from h),
    b as (select key, member, list_concat(list_transform(range(32), lambda i: (hi >> (31 - i)) & 1), list_transform(range(32), lambda i: (lo >> (31 - i)) & 1), [0]) as v from g)
    select key, member, array_to_string(list_transform(range(13), lambda k: substr('{gf.DIGITS}', (v[5 * k + 1] * 16 + v[5 * k + 2] * 8 + v[5 * k + 3] * 4 + v[5 * k + 4] * 2 + v[5 * k + 5] + 1)::bigint, 1)), '') as hash from b""")
_add("geopos", lambda s, d: geo.geopos(src.places(s, d)).select("key", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), f"select key, member, round((least(floor((lon + 180) / 360 * 4294967296), 4294967295) + 0.5) * (360 / 4294967296.0::double) - 180, 6) as lon, round((least(floor((lat + 90) / 180 * 4294967296), 4294967295) + 0.5) * (180 / 4294967296.0::double) - 90, 6) as lat from {_P}")
_add("geodist", lambda s, d: geo.geodist(src.places(s, d).withColumn("member", (F.col("member").cast("long") % 50).cast("string")).groupBy("key", "member").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat")), "1", "2", "km").select("key", F.round("distance", 4).alias("distance")), f"""
    with p as (select key, member::bigint % 50 as member, min(lon) as lon, min(lat) as lat from {_P} group by 1, 2)
    select a.key, round({_sql_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 4) as distance from p a join p b on a.key = b.key and a.member = 1 and b.member = 2""")
_add("geo_search_radius", lambda s, d: geo.search(src.places(s, d), 15.0, 37.0, radius=2000, unit="km").select("key", "member", F.round("distance", 4).alias("distance")), f"select key, member, round({_sql_distance('15.0', '37.0', 'lon', 'lat')} / 1000, 4) as distance from {_P} where {_sql_distance('15.0', '37.0', 'lon', 'lat')} / 1000 <= 2000")
_add("geo_search_box", lambda s, d: geo.search(src.places(s, d), 15.0, 37.0, box=(3000, 2000), unit="km").select("key", "member"), f"select key, member from {_P} where {_sql_distance('15.0', 'lat', 'lon', 'lat')} / 1000 <= 1500 and {_sql_distance('15.0', '37.0', '15.0', 'lat')} / 1000 <= 1000")
_add("geo_search_nearest", lambda s, d: geo.search(src.places(s, d), 15.0, 37.0, radius=9000, unit="km", count=7).select("key", "member"), f"select key, member from {_P} order by {_sql_distance('15.0', '37.0', 'lon', 'lat')}, key, member limit 7")
_add("geo_near_join", lambda s, d: geo.near(src.places(s, d), src.places(s, d).where("key = 'purchase'").select(F.col("member").alias("id"), "lon", "lat"), 20_000.0).select("id", "key", "member"), f"select a.member as id, b.key, b.member from {_P} a join {_P} b on a.key = 'purchase' and abs(a.lat - b.lat) < 0.3 and {_sql_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 20000")

# --- sketches ------------------------------------------------------------------------


def _items(s: SparkSession, d: str) -> DataFrame:
    return src.table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("item"))


def _within(got: DataFrame, exact: DataFrame, share: float) -> DataFrame:
    """Whether estimates are near exact counts, as an answer that SQL can check."""
    j = got.join(exact.withColumnRenamed("n", "exact"), "key")
    return j.select("key", (F.abs(F.col("n") - F.col("exact")) <= F.greatest(F.col("exact") * share, F.lit(3))).alias("near"))


_add("pfcount", lambda s, d: _within(sketches.pfcount(sketches.pfadd(_items(s, d))), _items(s, d).groupBy("key").agg(F.count_distinct("item").alias("n")), 0.03), "select event_type as key, true as near from events group by 1")
_add("pfmerge", lambda s, d: _within(sketches.pfcount(sketches.pfmerge(sketches.pfadd(_items(s, d)), ["click", "view"], "all")), _items(s, d).where("key in ('click', 'view')").agg(F.count_distinct("item").alias("n")).withColumn("key", F.lit("all")), 0.03), "select 'all' as key, true as near")


def _room(rows: DataFrame) -> tuple[int, int]:
    """Bits and hashes for a filter of one error in a hundred with room for the items of every key."""
    most = rows.groupBy("key").agg(F.count_distinct("item").alias("n")).agg(F.max("n")).first()[0]
    return sketches.bloom_size(0.01, max(1, most or 0))


def _bloom(s: SparkSession, d: str) -> DataFrame:
    """Of each key: how many even items were added, how many of them are missed, and whether few others seem to be there."""
    added = _items(s, d).where("item % 2 = 0")
    room = _room(added)
    got = sketches.bf_exists(sketches.bf_add(added, *room), _items(s, d), *room)
    even = F.col("item") % 2 == 0
    return got.groupBy("key").agg(
        F.count(F.when(even, 1)).alias("added"),
        F.count(F.when(even & (F.col("maybe") == 0), 1)).alias("missed"),
        (F.count(F.when(~even & (F.col("maybe") == 1), 1)) <= 3 + 0.03 * F.count(F.when(~even, 1))).alias("few_false"),
    )


_add("bf_exists", _bloom, "select event_type as key, count(distinct user_id) filter (user_id % 2 = 0) as added, 0 as missed, true as few_false from events group by 1")
_add("cf_count", lambda s, d: sketches.multiset(src.table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("item"), F.when(F.col("event_id") % 4 == 0, -1).otherwise(1).alias("delta"))), "select event_type as key, user_id as item, sum(case when event_id % 4 = 0 then -1 else 1 end)::bigint as n from events group by 1, 2 having sum(case when event_id % 4 = 0 then -1 else 1 end) > 0")
_add("cf_exists", lambda s, d: sketches.cf_exists(sketches.multiset(_items(s, d).where("key = 'click'").withColumn("delta", F.lit(1))), _items(s, d).distinct()), "select k.key, k.item, coalesce(c.n, 0) as n from (select distinct event_type as key, user_id as item from events) k left join (select event_type as key, user_id as item, count(*) as n from events where event_type = 'click' group by 1, 2) c using (key, item)")


def _cms(s: SparkSession, d: str) -> DataFrame:
    width, depth = sketches.cms_size(0.0005, 0.999)
    got = sketches.cms_query(sketches.cms_add(_items(s, d), width, depth), _items(s, d), width, depth)
    exact = _items(s, d).groupBy("key", "item").agg(F.count("*").alias("exact"))
    total = _items(s, d).groupBy("key").agg(F.count("*").alias("total"))
    near = (F.col("n") >= F.col("exact")) & (F.col("n") <= F.col("exact") + F.ceil(F.col("total") * 0.0005))
    return got.join(exact, ["key", "item"]).join(total, "key").groupBy("key").agg((F.sum((F.col("n") < F.col("exact")).cast("int")) == 0).alias("enough"), (F.avg(near.cast("int")) >= 0.999).alias("near"))


_add("cms_query", _cms, "select distinct event_type as key, true as enough, true as near from events")
_add("topk_list", lambda s, d: sketches.topk(_items(s, d), 5), "select * from (select key, item, n, row_number() over (partition by key order by n desc, item)::int as rank from (select event_type as key, user_id as item, count(*) as n from events group by 1, 2)) where rank <= 5")
_add("topk_query", lambda s, d: sketches.topk_query(sketches.topk(_items(s, d), 5), _items(s, d).distinct()), "select key, item, (row_number() over (partition by key order by n desc, item) <= 5)::int as found from (select event_type as key, user_id as item, count(*) as n from events group by 1, 2)")
_V = "(select event_type as key, value from events)"


def _values(s: SparkSession, d: str) -> DataFrame:
    return src.table(s, d, "events").select(F.col("event_type").alias("key"), "value")


QUANTILES = [0.01, 0.25, 0.5, 0.99]


def _digest_near(s: SparkSession, d: str) -> DataFrame:
    """Whether each quantile of the digest has a share of the values at or below it that is near what it should be."""
    found = sketches.digest_quantile(sketches.digest(_values(s, d)), QUANTILES)
    each = _values(s, d).join(found, "key")
    shares = [(F.avg((F.col("value") < F.col(f"q{i}")).cast("double")) - 0.015 <= q) & (F.avg((F.col("value") <= F.col(f"q{i}")).cast("double")) + 0.015 >= q) for i, q in enumerate(QUANTILES)]
    return each.groupBy("key").agg(F.count("*").alias("n"), *[x.alias(f"near{i}") for i, x in enumerate(shares)])


_add("tdigest_quantile", _digest_near, f"select key, count(*) as n, true as near0, true as near1, true as near2, true as near3 from {_V} group by 1")
_add("quantile_exact", lambda s, d: sketches.quantiles(_values(s, d), [0.25, 0.5, 0.99], exact=True).select("key", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(3)]), f"select key, round(quantile_cont(value, 0.25), 6) as q0, round(quantile_cont(value, 0.5), 6) as q1, round(quantile_cont(value, 0.99), 6) as q2 from {_V} group by 1")
_add("tdigest_cdf", lambda s, d: sketches.cdf(_values(s, d), 100.0).select("key", F.round("cdf", 6).alias("cdf")), f"select key, round(avg((value <= 100)::int), 6) as cdf from {_V} group by 1")
_add("tdigest_info", lambda s, d: sketches.digest_info(_values(s, d)).select("key", "n", "min", "max", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev")), f"select key, count(*) as n, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as stddev from {_V} group by 1")
_add("tdigest_trimmed", lambda s, d: sketches.trimmed_mean(_values(s, d), 0.1, 0.9).select("key", F.round("mean", 6).alias("mean")), f"select e.key, round(avg(value), 6) as mean from {_V} e join (select key, quantile_cont(value, 0.1) as a, quantile_cont(value, 0.9) as b from {_V} group by 1) q on e.key = q.key and value between a and b group by 1")

# --- time series -----------------------------------------------------------------------

_TS = "(select user_id as key, epoch_ns(ts) // 1000000 as ts, value, event_id as seq, event_type from events)"
_LATEST = f"(select key, ts, arg_max(value, seq) as value from {_TS} group by 1, 2)"
_DAY = 86_400_000
_SQL_AGG = {
    "avg": "avg(value)", "sum": "sum(value)", "count": "count(*)::double", "min": "min(value)", "max": "max(value)", "first": "arg_min(value, ts)", "last": "arg_max(value, ts)",
    "range": "max(value) - min(value)", "std.p": "stddev_pop(value)", "std.s": "coalesce(stddev_samp(value), 0)", "var.p": "var_pop(value)", "var.s": "coalesce(var_samp(value), 0)",
}
for _name in timeseries.AGGREGATIONS:
    _add(f"ts_range_{_name.replace('.', '_')}", lambda s, d, a=_name: timeseries.ts_range(timeseries.latest(src.series(s, d)), 1704400000000, 1706000000000, a, _DAY).select("key", "ts", F.round(F.col("value") + 1e-7, 4).alias("value")), f"select key, ts // {_DAY} * {_DAY} as ts, round({_SQL_AGG[_name]} + 1e-7::double, 4) as value from {_LATEST} where ts between 1704400000000 and 1706000000000 group by 1, 2")
_add("ts_get", lambda s, d: timeseries.ts_get(timeseries.latest(src.series(s, d))), f"select key, max(ts) as ts, arg_max(value, ts) as value from {_LATEST} group by 1")
_add("ts_revrange", lambda s, d: timeseries.ts_range(timeseries.latest(src.series(s, d)), count=3, reverse=True), f"select * from (select *, row_number() over (partition by key order by ts desc)::int as rank from {_LATEST}) where rank <= 3")
_META = """(select key, event_type as type, (key % 4)::varchar as shard from (select user_id as key, event_type, row_number() over (partition by user_id order by count(*) desc, event_type desc) as k from events group by 1, 2) where k = 1)"""
_add("ts_queryindex", lambda s, d: timeseries.query_index(src.series_meta(s, d), ["shard=1", "type!=click"]), f"select key from {_META} where shard = '1' and type <> 'click'")
_add("ts_mrange_filter", lambda s, d: timeseries.mrange(timeseries.latest(src.series(s, d)), src.series_meta(s, d), ["shard=2"], aggregation="sum", width=_DAY).select("key", "ts", F.round("value", 4).alias("value")), f"select key, ts // {_DAY} * {_DAY} as ts, round(sum(value), 4) as value from {_LATEST} where key in (select key from {_META} where shard = '2') group by 1, 2")
_add("ts_mget", lambda s, d: timeseries.mget(timeseries.latest(src.series(s, d)), src.series_meta(s, d), ["shard!=0"]), f"select key, max(ts) as ts, arg_max(value, ts) as value from {_LATEST} where key in (select key from {_META} where shard <> '0') group by 1")
_add("ts_incrby", lambda s, d: timeseries.incrby(src.series(s, d).select("key", "ts", "seq", F.round(F.col("value") * 100).cast("long").alias("delta"))), f"select key, ts, seq, sum(round(value * 100)::bigint) over (partition by key order by ts, seq rows unbounded preceding)::bigint as value from {_TS}")
_add("ts_del", lambda s, d: timeseries.ts_del(timeseries.latest(src.series(s, d)), 1704400000000, 1706000000000), f"select * from {_LATEST} where not ts between 1704400000000 and 1706000000000")
_add("ts_retention", lambda s, d: timeseries.retain(timeseries.latest(src.series(s, d)), src.series_meta(s, d), 1706000000000), f"select * from {_LATEST} where ts >= 1706000000000 - 604800000")
_add("ts_info", lambda s, d: timeseries.info(timeseries.latest(src.series(s, d))), f"select key, count(*) as samples, min(ts) as first_ts, max(ts) as last_ts, ceil(count(*) / 256)::bigint as chunks from {_LATEST} group by 1")
_add("ts_downsample", lambda s, d: timeseries.downsample(timeseries.latest(src.series(s, d)), "max", _DAY, ":max").select("key", "ts", "value"), f"select key::varchar || ':max' as key, ts // {_DAY} * {_DAY} as ts, max(value) as value from {_LATEST} group by 1, 2")

# --- streams ----------------------------------------------------------------------------

_X = "(select event_type as key, epoch_ns(ts) // 1000000 as ms, row_number() over (partition by event_type, epoch_ns(ts) // 1000000 order by event_id) - 1 as seq, user_id, value, event_id from events)"
_add("xadd_ids", lambda s, d: streams.xadd(src.table(s, d, "events").select(F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("n"))), f"select key, ms, event_id as n, seq from {_X}")
_add("xadd_accepted", lambda s, d: streams.accepted(src.stream(s, d).select("key", "ms", "seq", F.col("event_id").alias("n"))), f"select key, ms, seq, event_id as n from (select *, max(ms * 100000 + seq) over (partition by key order by event_id rows between unbounded preceding and 1 preceding) as top from {_X}) where top is null or ms * 100000 + seq > top")
_add("xlen", lambda s, d: streams.xlen(src.stream(s, d)), f"select key, count(*) as n from {_X} group by 1")
_add("xrange", lambda s, d: streams.xrange(src.stream(s, d), "1704400000000", "1706000000000", 5).select("key", "ms", "seq", "rank"), f"select key, ms, seq, rank from (select *, row_number() over (partition by key order by ms, seq)::int as rank from {_X} where ms between 1704400000000 and 1706000000000) where rank <= 5")
_add("xrevrange", lambda s, d: streams.xrange(src.stream(s, d), "-", "+", 4, reverse=True).select("key", "ms", "seq", "rank"), f"select key, ms, seq, rank from (select *, row_number() over (partition by key order by ms desc, seq desc)::int as rank from {_X}) where rank <= 4")
_add("xdel", lambda s, d: streams.xlen(streams.xdel(src.stream(s, d), src.stream(s, d).where("user_id % 2 = 0"))), f"select key, count(*) as n from {_X} where user_id % 2 <> 0 group by 1")
_add("xtrim_maxlen", lambda s, d: streams.xtrim_maxlen(src.stream(s, d), 6).select("key", "ms", "seq"), f"select key, ms, seq from (select *, row_number() over (partition by key order by ms desc, seq desc) as k from {_X}) where k <= 6")
_add("xtrim_minid", lambda s, d: streams.xtrim_minid(src.stream(s, d), "1706000000000-0").select("key", "ms", "seq"), f"select key, ms, seq from {_X} where ms >= 1706000000000")


def _groups(s: SparkSession, d: str) -> DataFrame:
    return src.stream(s, d).groupBy("key").agg(F.lit("g").alias("grp"), F.lit(1705000000000).cast("long").alias("last_ms"), F.lit(0).cast("long").alias("last_seq"))


_NEW = f"(select *, row_number() over (partition by key order by ms, seq) as rank from {_X} where ms > 1705000000000 or (ms = 1705000000000 and seq > 0))"
_add("xread_after", lambda s, d: streams.xread(src.stream(s, d), _groups(s, d), 10).select("key", "ms", "seq"), f"select key, ms, seq from {_NEW} where rank <= 10")
_add("xreadgroup", lambda s, d: streams.xreadgroup(src.stream(s, d), _groups(s, d), "c", _now(), 10)[2], f"select key, 'g' as grp, max(ms) as last_ms, arg_max(seq, ms * 100000 + seq) as last_seq from {_NEW} where rank <= 10 group by 1")


def _pending(s: SparkSession, d: str) -> DataFrame:
    return src.stream(s, d).select("key", F.lit("g").alias("grp"), "ms", "seq", (F.col("user_id") % 3).cast("string").alias("consumer"), F.timestamp_millis("ms").alias("delivered_at"), F.lit(1).alias("deliveries"))


_add("xpending_summary", lambda s, d: streams.xpending(_pending(s, d)).select("key", "consumer", "n", "min_ms", "max_ms"), f"select key, (user_id % 3)::varchar as consumer, count(*) as n, min(ms) as min_ms, max(ms) as max_ms from {_X} group by 1, 2")
_add("xack", lambda s, d: streams.xpending(streams.xack(_pending(s, d), _pending(s, d).where("consumer = '1'"))).select("key", "consumer", "n"), f"select key, (user_id % 3)::varchar as consumer, count(*) as n from {_X} where user_id % 3 <> 1 group by 1, 2")
_add("xclaim", lambda s, d: streams.xclaim(_pending(s, d), "9", 86_400_000, _now()).groupBy("key", "consumer").agg(F.count("*").alias("n"), F.sum("deliveries").alias("deliveries")), f"select key, case when epoch_ms(timestamp '2024-01-20') - ms >= 86400000 then '9' else (user_id % 3)::varchar end as consumer, count(*) as n, sum(case when epoch_ms(timestamp '2024-01-20') - ms >= 86400000 then 2 else 1 end)::bigint as deliveries from {_X} group by 1, 2")
_add("xinfo_groups", lambda s, d: streams.info_groups(_groups(s, d), _pending(s, d)), f"select key, 'g' as grp, 1705000000000 as last_ms, 0 as last_seq, count(distinct user_id % 3) as consumers, count(*) as pending from {_X} group by 1")

# --- JSON -----------------------------------------------------------------------------

_J = src.json_events
_add("json_get", lambda s, d: jsondoc.get(_J(s, d), "$.k"), "select event_id as key, json_extract(props, '$.k')::varchar as value from events")
_add("json_type", lambda s, d: jsondoc.type_of(_J(s, d), "$.k"), "select event_id as key, 'number' as type from events")
_add("json_numincrby", lambda s, d: jsondoc.number_at(_J(s, d), "$.k", add=2.5), "select event_id as key, json_extract(props, '$.k')::double + 2.5 as value from events")
_add("json_nummultby", lambda s, d: jsondoc.number_at(_J(s, d), "k", times=3.0), "select event_id as key, json_extract(props, '$.k')::double * 3 as value from events")
_add("json_objkeys", lambda s, d: jsondoc.objkeys(_J(s, d), "$").select("key", F.array_join("names", ",").alias("names")), "select event_id as key, array_to_string(list_sort(json_keys(props)), ',') as names from events")
_add("json_objlen", lambda s, d: jsondoc.objlen(_J(s, d), "$"), "select event_id as key, len(json_keys(props))::bigint as n from events")


def _talks(s: SparkSession, d: str) -> DataFrame:
    """Roles of each conversation as a JSON array."""
    c = src.table(s, d, "conversations")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return c.groupBy(F.col("conv_id").alias("key")).agg(F.to_json(F.struct(roles.alias("roles"))).alias("doc"))


_add("json_arrlen", lambda s, d: jsondoc.arrlen(_talks(s, d), "$.roles"), "select conv_id as key, count(*) as n from conversations group by 1")
_add("json_arrindex", lambda s, d: jsondoc.arrindex(_talks(s, d), "$.roles", "assistant"), "select conv_id as key, coalesce(list_position(list(role order by turn), 'assistant'), 0) - 1 as index from conversations group by 1")
_add("json_strlen", lambda s, d: jsondoc.strlen(_talks(s, d), "$.roles[0]"), "select conv_id as key, strlen(arg_min(role, turn)) as length from conversations group by 1")
_add("json_set", lambda s, d: jsondoc.get(jsondoc.set_path(_J(s, d), "$.a.b", 5), "$.a.b"), "select event_id as key, '5' as value from events")
_add("json_arrappend", lambda s, d: jsondoc.arrlen(jsondoc.arr_append(_talks(s, d), "$.roles", "x", "y"), "$.roles"), "select conv_id as key, count(*) + 2 as n from conversations group by 1")
_add("json_arrpop", lambda s, d: jsondoc.arrlen(jsondoc.arr_pop(_talks(s, d), "$.roles"), "$.roles"), "select conv_id as key, count(*) - 1 as n from conversations group by 1")
_add("json_arrtrim", lambda s, d: jsondoc.arrlen(jsondoc.arr_trim(_talks(s, d), "$.roles", 1, 2), "$.roles"), "select conv_id as key, greatest(least(count(*) - 1, 2), 0) as n from conversations group by 1")
_add("json_del", lambda s, d: jsondoc.objlen(jsondoc.delete(_J(s, d), "$.k"), "$"), "select event_id as key, 0 as n from events")

# --- vectors ----------------------------------------------------------------------------

_VEC = "(select vec_id as id, embedding::double[] as v from embeddings)"
QUERY_VECTOR = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::double" for x in QUERY_VECTOR) + "]"
_SQL_SCORE = {"cosine": "list_cosine_similarity({a}, {b})", "dot": "list_dot_product({a}, {b})", "euclidean": "-list_distance({a}, {b})"}
for _m, _f in _SQL_SCORE.items():
    _add(f"vs_search_{_m}", lambda s, d, m=_m: vectors.vssearch(src.vectors(s, d), QUERY_VECTOR, 10, m).select("id", F.round("score", 6).alias("score")), f"select id, round({_f.format(a='v', b=_Q)}, 6) as score from {_VEC} order by {_f.format(a='v', b=_Q)} desc, id limit 10")
_add("vs_query", lambda s, d: vectors.vsquery(src.vectors(s, d), [1, 2, 3], 5).select("query_id", "id", "rank", F.round("score", 6).alias("score")), f"select * from (select q.id as query_id, v.id, row_number() over (partition by q.id order by list_cosine_similarity(v.v, q.v) desc, v.id)::int as rank, round(list_cosine_similarity(v.v, q.v), 6) as score from {_VEC} v join {_VEC} q on q.id in (1, 2, 3) and v.id <> q.id) where rank <= 5")
_add("vs_range", lambda s, d: vectors.vsrange(src.vectors(s, d), QUERY_VECTOR, "cosine", 0.05).select("id", F.round("score", 6).alias("score")), f"select id, round(list_cosine_similarity(v, {_Q}), 6) as score from {_VEC} where list_cosine_similarity(v, {_Q}) >= 0.05")
_add("vs_centroid", lambda s, d: vectors.centroid(src.vectors(s, d), "label").select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")), "select label, i - 1 as i, round(avg(embedding[i]::double), 6) as x from embeddings, range(1, 65) r(i) group by 1, 2")
_add("vs_card", lambda s, d: vectors.vscard(src.vectors(s, d)), "select count(*) as n from embeddings")

# --- search -----------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_WORDS = f"(select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' and x not in ({_STOP}))) as term from documents)"
_POST = f"(select term, doc_id, count(*) as tf from {_WORDS} group by 1, 2)"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return src.table(s, d, "documents")


def _post(s: SparkSession, d: str) -> DataFrame:
    """Postings of all texts, a plan: what is asked of them is filtered where the texts are split."""
    return search.postings(_docs(s, d), "text").select("term", "doc_id", "tf")


def _counts(s: SparkSession, d: str, total: bool = False) -> DataFrame:
    return search.term_counts(_docs(s, d), "text", total=total)


def _tags(s: SparkSession, d: str) -> DataFrame:
    return search.tag_postings(_docs(s, d), "lang").withColumn("field", F.lit("lang"))


def _found(sql: str) -> str:
    return f"select doc_id from documents where {sql}"


def _has(term: str, op: str = "=") -> str:
    return f"doc_id in (select doc_id from {_POST} where term {op} '{term}')"


_add("ft_terms", lambda s, d: _counts(s, d, total=True), f"select term, count(*) as df, sum(tf)::bigint as tf from {_POST} group by 1")
_add("ft_tags", lambda s, d: search.tag_postings(_docs(s, d), "lang").groupBy("tag").agg(F.count("*").alias("n")), "select lower(trim(lang)) as tag, count(*) as n from documents where lang is not null group by 1")
_add("ft_search_and", lambda s, d: search.matching(_docs(s, d), _post(s, d), "license released"), _found(_has("license") + " and " + _has("released")))
_add("ft_search_or", lambda s, d: search.matching(_docs(s, d), _post(s, d), "(token | rights) -que"), _found(f"({_has('token')} or {_has('rights')}) and not {_has('que')}"))
_add("ft_search_not", lambda s, d: search.matching(_docs(s, d), _post(s, d), "-la"), _found(f"not {_has('la')}"))
_add("ft_search_prefix", lambda s, d: search.matching(_docs(s, d), _post(s, d), "lic*"), _found(_has("lic%", "like")))
_add("ft_search_tag", lambda s, d: search.matching(_docs(s, d), _post(s, d), "@lang:{en} license", _tags(s, d)), _found("lang = 'en' and " + _has("license")))
_SCORE = f"""
    with n as (select count(*) as n from documents), p as (select * from {_POST} where term in ('license', 'token')), df as (select term, count(*) as df from p group by 1),
    hit as (select distinct doc_id from p)
    select doc_id, round(sum(tf * ln((n.n - df + 0.5) / (df + 0.5) + 1)), 6) as score from p join df using (term), n group by 1"""
_add("ft_score", lambda s, d: search.search(_docs(s, d), _post(s, d), "license | token").select("doc_id", F.round("score", 6).alias("score")), _SCORE)
_add("ft_search_top", lambda s, d: search.search(_docs(s, d), _post(s, d), "license | token", offset=2, limit=5).select("doc_id", F.round("score", 6).alias("score")), f"select * from ({_SCORE}) order by score desc, doc_id limit 5 offset 2")
for _r, _sql in {"count": "count(*)", "sum": "sum(n_chars)::bigint", "min": "min(n_chars)", "max": "max(n_chars)", "avg": "avg(n_chars)"}.items():
    _add(f"ft_aggregate_{_r}", lambda s, d, r=_r: search.aggregate(_docs(s, d), None, ["lang", "source"], [(r, "n_chars", "x")]).withColumn("x", F.round("x", 6) if r == "avg" else F.col("x")), f"select lang, source, {'round(' + _sql + ', 6)' if _r == 'avg' else _sql} as x from documents group by 1, 2")
_add("ft_aggregate_tolist", lambda s, d: search.aggregate(_docs(s, d), None, ["source"], [("tolist", "lang", "x")]).select("source", F.array_join("x", ",").alias("x")), "select source, string_agg(lang, ',' order by lang) as x from documents group by 1")
_add("ft_aggregate_query", lambda s, d: search.aggregate(_docs(s, d), search.matching(_docs(s, d), _post(s, d), "license"), ["lang"], [("count", "lang", "n"), ("max", "n_chars", "longest")], sort="n", descending=True, limit=3), f"select lang, count(*) as n, max(n_chars) as longest from documents where {_has('license')} group by 1 order by 2 desc, 1 limit 3")
_add("ft_sugget", lambda s, d: search.suggest(_post(s, d), "th", 8), f"select distinct term from {_POST} where starts_with(term, 'th') order by 1 limit 8")
_add("ft_spellcheck", lambda s, d: search.spell_check(_counts(s, d), ["licence", "tokn", "zzzzzzzz"], 1).select("word", "rank", "term"), f"""
    select word, rank, term from (select word, term, row_number() over (partition by word order by levenshtein(word, term), df desc, term)::int as rank from
    (select term, count(*) as df from {_POST} group by 1) t, (values ('licence'), ('tokn'), ('zzzzzzzz')) w(word) where levenshtein(word, term) <= 1 and word not in (select term from {_POST})) where rank <= 5""")
_add("ft_info", lambda s, d: search.info(_docs(s, d), _counts(s, d)), f"select (select count(*) from documents) as docs, count(distinct term) as terms, count(*) as records from {_POST}")


def _synonyms(s: SparkSession, d: str) -> DataFrame:
    p = src.table(s, d, "part")
    return p.select(F.col("p_brand").alias("grp"), F.lower("p_type").alias("term")).distinct()


_add("ft_syn_expand", lambda s, d: search.syn_expand(search.syn_update(_synonyms(s, d), "own", ["license", "licence"]), ["license"]), "select unnest(['license', 'licence']) as term")
_add("ft_dict", lambda s, d: search.dict_dump(search.dict_del(search.dict_add(_synonyms(s, d).select(F.col("grp").alias("dict"), "term"), "mine", ["a", "b"]), "mine", ["a"]), "mine"), "select 'b' as term")
_STEM = " ".join(f"when ends_with(w, '{x}') and strlen(left(w, len(w) - {len(x)}) || '{y}') >= 2 then left(w, len(w) - {len(x)}) || '{y}'" for x, y in tx.SUFFIXES)
_add("stem", lambda s, d: src.table(s, d, "part").select(F.explode(tx.tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("licences studies happily national")))).alias("word")).distinct().select("word", tx.stem(F.col("word")).alias("stem")), f"select w as word, case {_STEM} else w end as stem from (select distinct unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' licences studies happily national'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as w from part)")
_add("char_ngrams", lambda s, d: src.table(s, d, "part").select("p_partkey", F.explode(tx.char_ngrams(F.col("p_name"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "select substr(lower(p_name), i, 3) as gram, count(*) as n from part, range(1, 200) r(i) where i <= greatest(len(p_name) - 2, 1) group by 1")

# --- log ----------------------------------------------------------------------------------


def _command_log(s: SparkSession, d: str) -> DataFrame:
    """Events as commands on a key for each user: mostly INCRBY, some SET, SETNX and DEL, in transactions of ten."""
    e = src.table(s, d, "events")
    cmd = F.when(F.col("event_id") % 11 == 0, "set").when(F.col("event_id") % 13 == 0, "setnx").when(F.col("event_id") % 17 == 0, "del").otherwise("incrby")
    return e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("txn"), (F.col("event_id") % 97 != 5).alias("ok"), cmd.alias("cmd"), F.col("user_id").cast("string").alias("key"), F.floor("value").cast("string").alias("arg"))


_CMD = """(select event_id as seq, event_id // 10 as txn, event_id % 97 <> 5 as ok, case when event_id % 11 = 0 then 'set' when event_id % 13 = 0 then 'setnx' when event_id % 17 = 0 then 'del' else 'incrby' end as cmd, user_id::varchar as key, floor(value)::bigint as arg from events)"""
_add("log_fold", lambda s, d: logs.fold_strings(_command_log(s, d)), f"""
    with a as (select *, lag(cmd) over (partition by key order by seq) as prev from {_CMD}),
    b as (select *, sum((cmd in ('set', 'del') or (cmd = 'setnx' and coalesce(prev, 'del') = 'del'))::int) over (partition by key order by seq rows unbounded preceding) as epoch,
        case when cmd = 'set' or (cmd = 'setnx' and coalesce(prev, 'del') = 'del') then arg end as base from a),
    c as (select key, epoch, max(base) as base, sum(arg) filter (cmd = 'incrby') as delta, bool_or(cmd <> 'del') as made from b group by 1, 2)
    select key, (coalesce(base, 0) + coalesce(delta, 0))::bigint::varchar as value from c where made and (key, epoch) in (select key, max(epoch) from c group by 1)""")
_add("txn_fold", lambda s, d: logs.committed(_command_log(s, d)).groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last")), f"select key, count(*) as n, max(seq) as last from {_CMD} where txn not in (select txn from {_CMD} where not ok) group by 1")
_add("txn_watch", lambda s, d: logs.watched(_command_log(s, d), src.table(s, d, "events").where("event_id % 50 = 0").select(F.col("event_id").alias("txn"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("watch_seq"), (F.col("event_id") + 100).alias("exec_seq"))), "select event_id as txn from events w where event_id % 50 = 0 and not exists (select 1 from events e where e.user_id = w.user_id and e.event_id > w.event_id and e.event_id < w.event_id + 100)")
_add("log_resp", lambda s, d: logs.encode_resp(_command_log(s, d).select("seq", F.array("cmd", "key", "arg").alias("args"))).select("seq", "resp"), f"select seq, '*3' || chr(13) || chr(10) || '$' || len(cmd) || chr(13) || chr(10) || cmd || chr(13) || chr(10) || '$' || len(key) || chr(13) || chr(10) || key || chr(13) || chr(10) || '$' || len(arg::varchar) || chr(13) || chr(10) || arg || chr(13) || chr(10) as resp from {_CMD}")
_add("key_slot", lambda s, d: _space(s, d).select("key", keyspace.slot(F.col("key")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")))

# --- streaming ----------------------------------------------------------------------------


@query("stream_tumble", "select event_type, count(*) as n from events group by 1")
def stream_tumble(s: SparkSession, d: str) -> DataFrame:
    """Daily counts by a live query, added up."""
    from ..streaming import live

    e = live.read(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    w = live.tumble(e, "ts", "1 day", "1 day", ["event_type"], F.count("*").alias("n"))
    return live.run_available(w, "complete").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("stream_groups", f"select key, (k % 3)::bigint as consumer, count(*) as given from (select key, row_number() over (partition by key order by ms, seq) - 1 as k from {_X}) group by 1, 2")
def stream_groups(s: SparkSession, d: str) -> DataFrame:
    """Entries of each stream dealt to three consumers by a live query."""
    from ..streaming import live

    e = live.read(s, f"{d}/events.parquet").select(F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"))
    return live.run_available(live.consumer_groups(e, 3)).groupBy("key", "consumer").agg(F.sum("given").alias("given"))


@query("stream_subscribe", "select event_type as channel, count(*) as n from events where event_type in ('click', 'purchase') group by 1")
def stream_subscribe(s: SparkSession, d: str) -> DataFrame:
    from ..streaming import live

    e = live.read(s, f"{d}/events.parquet").select(F.col("event_type").alias("channel"), "value")
    return live.run_available(live.subscribe(e, ["click", "purchase"])).groupBy("channel").agg(F.count("*").alias("n"))


from . import more  # noqa: E402, F401
