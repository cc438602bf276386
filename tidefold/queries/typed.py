"""Queries of typed collections: two key types in one log, asked for one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import bigval
from tidefold.operators.lists import ranked
from tidefold.operators.typed import TypedDeque, TypedList, TypedMap, decoded, from_bytes, to_bytes, type_id
from tidefold.plans.oplog import ATOMIC_LIST_OPS, BIG_OPS, DEQUE_OPS, LIST_OPS, MAP_OPS, from_events
from tidefold.queries.queues import deque_sql
from tidefold.queries.registry import fold_sql, log_sql, query, table



def struct_key(column: str = "item") -> list[Column]:
    return [F.col(column) % 50, F.concat(F.lit("k"), (F.col(column) % 7).cast("string"))]


KINDS = ("bigint", "string")
STRUCTS, INTS = TypedMap(900), TypedMap(type_id("i64"))
PARTS = "item % 50 as a, 'k' || (item % 7) as b"


def struct_sql(ops: dict[str, str]) -> str:
    return f"select seq, op, {PARTS}, val from ({log_sql(ops)})"


LOG = struct_sql(MAP_OPS)


def map_log(spark: SparkSession, sf_dir: str, ops: dict[str, str] = MAP_OPS) -> DataFrame:
    """Struct keys and, with other values, plain integer keys."""
    events = from_events(table(spark, sf_dir, "events"), ops)
    own = STRUCTS.log(events, F.col("seq"), F.col("op"), struct_key(), F.col("val"))
    return own.unionByName(INTS.log(events, F.col("seq"), F.col("op"), [F.col("item")], -F.col("val")))


def named(df: DataFrame) -> DataFrame:
    """The decoded key as columns in place of the encoded one."""
    key = STRUCTS.parts(KINDS)
    return df.select(key["_0"].alias("a"), key["_1"].alias("b"), *[c for c in df.columns if c != "item"])


WANTED = "(select distinct c_custkey % 60 as a, 'k' || (c_custkey % 7) as b from customer) w"


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((key % 60).alias("a"), F.concat(F.lit("k"), (key % 7).cast("string")).alias("b")).distinct()


@query(fold_sql(LOG, "select a, b, val from live", "a, b"))
def typed_map_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(STRUCTS.live(map_log(spark, sf_dir)))


@query(fold_sql(LOG, f"select w.a, w.b from {WANTED} join live l on l.a = w.a and l.b = w.b", "a, b"))
def typed_map_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys asked for are in columns of other names than the stored ones."""
    return STRUCTS.contains(map_log(spark, sf_dir), wanted(spark, sf_dir), [F.col("a"), F.col("b")])


@query(fold_sql(LOG, f"select w.a, w.b, l.val from {WANTED} left join live l on l.a = w.a and l.b = w.b", "a, b"))
def typed_map_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STRUCTS.get(map_log(spark, sf_dir), wanted(spark, sf_dir), [F.col("a"), F.col("b")])


@query(fold_sql(LOG, "select seq, a, b, prev as result from f where op = 'set'", "a, b"))
def typed_map_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(STRUCTS.set(map_log(spark, sf_dir)))


@query(fold_sql(LOG, "select seq, a, b, case when status = 'PrevValue' then prev end as result from f where op = 'replace'", "a, b"))
def typed_map_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(STRUCTS.replace(map_log(spark, sf_dir)))


@query(fold_sql(LOG, "select seq, a, b, cur as result from f where op = 'get_or_create'", "a, b"))
def typed_map_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(STRUCTS.get_or_create(map_log(spark, sf_dir)))


@query(fold_sql(LOG, "select seq, a, b, prev as result from f where op = 'remove'", "a, b"))
def typed_map_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(STRUCTS.remove(map_log(spark, sf_dir)))


@query(f"select seq, a, b, op, coalesce(lag(op) over (partition by a, b order by seq) = 'set_big', false) as existed from ({struct_sql(BIG_OPS)})")
def typed_big_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(STRUCTS.big(map_log(spark, sf_dir, BIG_OPS)))


@query("select p.page_id, d.doc_id is not null as found, md5(d.text) as digest from pages p left join (select * from documents where strlen(text) > 0) d on d.doc_id = p.page_id")
def typed_big_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as big values by a typed key; pages ask for those of their own numbers."""
    docs = table(spark, sf_dir, "documents").select(INTS.key(F.col("doc_id")).alias("item"), F.encode("text", "UTF-8").alias("v"))
    parts = bigval.chunks(docs, "item", F.col("v"))
    got = INTS.get_big(parts, table(spark, sf_dir, "pages").select("page_id"), [F.col("page_id")])
    return got.select("page_id", F.col("value").isNotNull().alias("found"), F.md5("value").alias("digest"))


LISTS, OTHER_LISTS = TypedList(900), TypedList(type_id("i64"))
LIST_LOG, ATOMIC_LOG = (f"select seq, op, item % 5 as coll, item, val from ({log_sql(ops)})" for ops in (LIST_OPS, ATOMIC_LIST_OPS))
LIST_FOLD = "coll, item"
RANK = "row_number() over (partition by coll order by born{}) - 1"


def list_log(spark: SparkSession, sf_dir: str, ops: dict[str, str] = LIST_OPS) -> DataFrame:
    events = from_events(table(spark, sf_dir, "events"), ops)
    item = [F.col("item"), F.col("item") % 3]
    own = LISTS.log(events, F.col("seq"), F.col("op"), [F.col("item") % 5, F.lit("x")], item, F.col("val"))
    return own.unionByName(OTHER_LISTS.log(events, F.col("seq"), F.col("op"), [F.col("item") % 5], item, -F.col("val")))


def opened(df: DataFrame) -> DataFrame:
    """``coll`` and ``item`` as the numbers that their keys hold."""
    out = df.withColumn("coll", LISTS.parts(KINDS)["_0"])
    return out.withColumn("item", decoded(F.col("item"), ("bigint", "bigint"))["_0"]) if "item" in df.columns else out


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("of"), F.col("c_custkey").alias("who"))


def asked_keys() -> tuple[list[Column], list[Column]]:
    return [F.col("of"), F.lit("x")], [F.col("who"), F.col("who") % 3]


@query(fold_sql(LIST_LOG, "select c_custkey % 5 as of, c_custkey as who, val from customer left join live on live.coll = c_custkey % 5 and live.item = c_custkey", LIST_FOLD))
def typed_list_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LISTS.get(list_log(spark, sf_dir), asked(spark, sf_dir), *asked_keys())


@query(fold_sql(LIST_LOG, "select c_custkey % 5 as of, c_custkey as who from customer join live on live.coll = c_custkey % 5 and live.item = c_custkey", LIST_FOLD))
def typed_list_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LISTS.contains(list_log(spark, sf_dir), asked(spark, sf_dir), *asked_keys())


@query(fold_sql(LIST_LOG, "select seq, coll, item, op, status, prev from f where rn > 0 and op <> 'get'", LIST_FOLD))
def typed_list_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set, promoting set, get-or-create and removal."""
    return opened(LISTS.calls(list_log(spark, sf_dir)))


@query(fold_sql(ATOMIC_LOG, "select seq, coll, item, case when status = 'PrevValue' then prev end as result from f where op = 'replace'", LIST_FOLD))
def typed_list_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(LISTS.replace(list_log(spark, sf_dir, ATOMIC_LIST_OPS)))


@query(fold_sql(LIST_LOG, f"select coll, {RANK.format('')} as pos, item, val from live", LIST_FOLD))
def typed_list_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(LISTS.iter(list_log(spark, sf_dir)).select("coll", F.col("pos").cast("bigint").alias("pos"), "item", "val"))


@query(fold_sql(LIST_LOG, f"select coll, {RANK.format(' desc')} as pos, item, val from live", LIST_FOLD))
def typed_list_iter_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(LISTS.iter_backwards(list_log(spark, sf_dir)).select("coll", F.col("pos").cast("bigint").alias("pos"), "item", "val"))


@query(fold_sql(LIST_LOG, "select coll, arg_min(item, born) as head, arg_max(item, born) as tail from live group by coll", LIST_FOLD))
def typed_list_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = list_log(spark, sf_dir)
    head, tail = (opened(LISTS.peek(log, end)).select("coll", F.col("item").alias(end)) for end in ("head", "tail"))
    return head.join(tail, "coll")


@query(fold_sql(LIST_LOG, f"select coll, pos, item, pos < 2 as popped from (select coll, {RANK.format(' desc')} as pos, item from live)", LIST_FOLD))
def typed_list_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items popped from each tail, and what is left, counted on."""
    popped, rest = LISTS.pop(list_log(spark, sf_dir), "tail", 2)
    both = popped.select("coll", "pos", "item", F.lit(True).alias("popped"))
    left = LISTS.iter_backwards(list_log(spark, sf_dir)).join(rest.select("coll", "item"), ["coll", "item"], "left_semi")
    return opened(both.unionByName(left.select("coll", "pos", "item", F.lit(False).alias("popped"))).withColumn("pos", F.col("pos").cast("bigint")))


@query(fold_sql(LIST_LOG, "select coll, count(*) as n from live group by coll", LIST_FOLD))
def typed_list_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(LISTS.len(list_log(spark, sf_dir))).where("n > 0")


@query(fold_sql(LIST_LOG, "select coll, item, val from live where coll <> 2", LIST_FOLD))
def typed_list_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = LISTS.discard(list_log(spark, sf_dir), LISTS.parts(KINDS)["_0"] == 2)[1]
    return opened(rest.select("coll", "item", "val"))


@query(fold_sql(LIST_LOG, f"select coll, {RANK.format('')} as pos, item from live", LIST_FOLD))
def typed_list_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction moves indices; the order that it leaves is that of the items."""
    moved = LISTS.compact_if_needed(list_log(spark, sf_dir), 10, 0.1)
    return opened(ranked(moved.select("coll", "item", "new_idx"), "new_idx").select("coll", F.col("pos").cast("bigint").alias("pos"), "item"))


DEQUES, OTHER_DEQUES = TypedDeque(900), TypedDeque(type_id("i64"))
LEFT = ", e as (select coll, arg_max(q, rn) as q from f group by coll), u as (select coll, unnest(q) as s, unnest(range(len(q))) as pos, len(q) as n from e) "


def deque_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = from_events(table(spark, sf_dir, "events"), DEQUE_OPS)
    own = DEQUES.log(events, F.col("seq"), F.col("op"), [F.col("item"), F.lit("q")], F.col("val"))
    return own.unionByName(OTHER_DEQUES.log(events, F.col("seq"), F.col("op"), [F.col("item")], -F.col("val")))


def queue(df: DataFrame) -> DataFrame:
    return df.withColumn("coll", DEQUES.parts(KINDS)["_0"])


@query(deque_sql(DEQUE_OPS, "select f.seq, f.coll, f.op, e.value as val from f left join events e on e.event_id = f.got where f.op like 'pop%'"))
def typed_deque_pops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(DEQUES.pops(deque_log(spark, sf_dir)).select("seq", "coll", "op", "val"))


@query(deque_sql(DEQUE_OPS, LEFT + "select u.coll, u.pos, v.value as val from u join events v on v.event_id = u.s"))
def typed_deque_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(DEQUES.iter(deque_log(spark, sf_dir)).select("coll", F.col("pos").cast("bigint").alias("pos"), "val"))


@query(deque_sql(DEQUE_OPS, LEFT + "select u.coll, u.n - 1 - u.pos as pos, v.value as val from u join events v on v.event_id = u.s"))
def typed_deque_iter_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(DEQUES.iter_backwards(deque_log(spark, sf_dir)).select("coll", F.col("pos").cast("bigint").alias("pos"), "val"))


@query(deque_sql(DEQUE_OPS, LEFT + "select u.coll, max(v.value) filter (u.pos = 0) as head, max(v.value) filter (u.pos = u.n - 1) as tail from u join events v on v.event_id = u.s group by u.coll"))
def typed_deque_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = deque_log(spark, sf_dir)
    head, tail = (queue(DEQUES.peek(log, end)).select("coll", F.col("val").alias(end)) for end in ("head", "tail"))
    return head.join(tail, "coll")


@query(deque_sql(DEQUE_OPS, LEFT + "select coll, len(q)::bigint as n, (len(q) > 0) as some from e"))
def typed_deque_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every queue that the log names, empty ones too."""
    return queue(DEQUES.range(deque_log(spark, sf_dir))).select("coll", "n", (F.col("tail") > F.col("head")).alias("some"))


@query("select c_custkey, c_custkey as i64, -c_custkey as i32, c_custkey as u64, c_custkey % 2 = 1 as flag, hex(chr((c_custkey % 256)::int)) is not null as sized from customer")
def typed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to little-endian bytes and back."""
    key = F.col("c_custkey")
    back = lambda value, kind: from_bytes(to_bytes(value, kind), kind)
    rows = table(spark, sf_dir, "customer")
    sized = F.octet_length(to_bytes(key, "u32")) == 4
    return rows.select("c_custkey", back(key, "i64").alias("i64"), back(-key, "i32").cast("bigint").alias("i32"), back(key, "u64").cast("bigint").alias("u64"), back(key % 2 == 1, "bool").alias("flag"), sized.alias("sized"))
