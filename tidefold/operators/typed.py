"""Typed collections: a struct key and a type id, several types in one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators import bigval, kv, lists, queues

#: Type ids of built-in key types, with the Spark type that holds them.
TYPE_IDS = {
    "u8": (1, "smallint"),
    "u16": (2, "int"),
    "u32": (3, "bigint"),
    "u64": (4, "decimal(20,0)"),
    "u128": (5, "binary"),
    "i8": (6, "tinyint"),
    "i16": (7, "smallint"),
    "i32": (8, "int"),
    "i64": (9, "bigint"),
    "i128": (10, "binary"),
    "bool": (11, "boolean"),
    "usize": (12, "decimal(20,0)"),
    "isize": (13, "bigint"),
    "char": (14, "string"),
    "string": (15, "string"),
    "bytes": (16, "binary"),
    "uuid": (17, "string"),
}


#: Bytes of the built-in types of a fixed size.
SIZES = {"u8": 1, "i8": 1, "bool": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "char": 4, "u64": 8, "i64": 8, "usize": 8, "isize": 8}


def type_id(kind: str) -> int:
    """The id of a built-in key type."""
    return TYPE_IDS[kind][0]


def encoded(*key: Column) -> Column:
    """A key as text: its parts by place, whatever their columns are called; null parts count."""
    return F.to_json(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(key)]), {"ignoreNullFields": "false"})


def decoded(text: Column, kinds: Sequence[str], strict: bool = False) -> Column:
    """A struct ``_0, _1, ...`` of an encoded key; of what is no such key the parts are null or, if ``strict``, it is an error."""
    return F.from_json(text, ", ".join(f"_{i} {k}" for i, k in enumerate(kinds)), {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def _turned(data: Column) -> Column:
    """Bytes in the other order: each is one character of Latin-1."""
    return F.encode(F.reverse(F.decode(data, "ISO-8859-1")), "ISO-8859-1")


def to_bytes(value: Column, kind: str) -> Column:
    """The little-endian bytes of a built-in type of a fixed size."""
    number = F.ascii(value) if kind == "char" else value.cast("int") if kind == "bool" else value
    digits = F.hex(number.cast("bigint")) if kind not in ("u64", "usize") else F.conv(number.cast("string"), 10, 16)
    return _turned(F.unhex(F.substring(F.lpad(digits, 16, "0"), -2 * SIZES[kind], 2 * SIZES[kind])))


def from_bytes(data: Column, kind: str) -> Column:
    """The value of little-endian bytes; an error where there are too few or too many, or no such value.

    No step names what it is built on twice, or Spark would work that out as
    often: the number is shifted down from the top of 64 bits, with its sign or
    without.
    """
    size, spark_type = SIZES[kind], TYPE_IDS[kind][1]
    wrong = F.raise_error(F.format_string(f"%d bytes are no {kind}", F.octet_length(data)))
    if kind == "bool":
        right, value = F.coalesce(F.hex(data), F.lit("00")).isin("00", "01"), F.hex(data) == "01"
    else:
        right = F.coalesce(F.octet_length(data), F.lit(size)) == size
        digits, free = F.rpad(F.hex(_turned(data)), 16, "0"), 64 - 8 * size
        top = F.conv(digits, 16, -10).cast("bigint")
        if spark_type == "decimal(20,0)":
            value = F.conv(digits, 16, 10)
        elif kind.startswith("i"):
            value = F.shiftright(top, free)
        else:
            value = F.shiftrightunsigned(top, free)
        value = F.char(value) if kind == "char" else value.cast(spark_type)
    return F.when(right, value).otherwise(wrong.cast(spark_type))


@dataclass(frozen=True)
class TypedCollection:
    """A view of one key type in a table ``(type_id, key, value)``."""

    type_id: int

    def rows(self, df: DataFrame, key: list[Column], value: Column) -> DataFrame:
        return df.select(F.lit(self.type_id).cast("bigint").alias("type_id"), encoded(*key).alias("key"), value.alias("value"))

    def select(self, table: DataFrame) -> DataFrame:
        return table.where(F.col("type_id") == self.type_id)

    def get(self, table: DataFrame, keys: DataFrame, key: list[Column]) -> DataFrame:
        wanted = keys.select(*key, encoded(*key).alias("key"))
        return wanted.join(self.select(table).select("key", "value"), "key", "left")

    def contains(self, table: DataFrame, keys: DataFrame, key: list[Column]) -> DataFrame:
        wanted = keys.select(*key, encoded(*key).alias("key"))
        return wanted.join(self.select(table).select("key"), "key", "left_semi").drop("key")


@dataclass(frozen=True)
class _TypedLog:
    """A view of one key type in a log shared by several; the encoded key is led by the type id."""

    type_id: int
    column = "coll"

    def key(self, *key: Column) -> Column:
        return F.concat(F.lit(f"{self.type_id}:"), encoded(*key))

    def parts(self, kinds: Sequence[str], column: str | None = None) -> Column:
        """The decoded key."""
        return decoded(F.substring(column or self.column, len(str(self.type_id)) + 2, 1 << 30), kinds)

    def own(self, log: DataFrame) -> DataFrame:
        return log.where(F.col(self.column).startswith(f"{self.type_id}:"))


class TypedMap(_TypedLog):
    """The flat map with struct keys, over a log ``(seq, op, coll, item, val)``; ``coll`` is null."""

    column = "item"

    def log(self, df: DataFrame, seq: Column, op: Column, key: list[Column], val: Column) -> DataFrame:
        return df.select(seq.alias("seq"), op.alias("op"), F.lit(None).cast("string").alias("coll"), self.key(*key).alias("item"), val.alias("val"))

    def live(self, log: DataFrame) -> DataFrame:
        return kv.state(self.own(log))

    def get(self, log: DataFrame, wanted: DataFrame, key: list[Column]) -> DataFrame:
        asked = wanted.select(*wanted.columns, self.key(*key).alias("item"))
        return asked.join(self.live(log), "item", "left").drop("item")

    def contains(self, log: DataFrame, wanted: DataFrame, key: list[Column]) -> DataFrame:
        asked = wanted.select(*wanted.columns, self.key(*key).alias("item"))
        return asked.join(self.live(log).select("item"), "item", "left_semi").drop("item")

    def _calls(self, log: DataFrame, op: str, result: Column) -> DataFrame:
        return kv.replay(self.own(log)).where(F.col("op") == op).select("seq", "item", result.alias("result"))

    def set(self, log: DataFrame) -> DataFrame:
        """``(seq, item, result)`` of each set: the value before."""
        return self._calls(log, "set", F.col("prev"))

    def replace(self, log: DataFrame) -> DataFrame:
        return self._calls(log, "replace", replaced())

    def get_or_create(self, log: DataFrame) -> DataFrame:
        return self._calls(log, "get_or_create", F.when(F.col("exists_before"), F.col("prev")).otherwise(F.col("val")))

    def remove(self, log: DataFrame) -> DataFrame:
        return self._calls(log, "remove", F.col("prev"))

    def big(self, log: DataFrame) -> DataFrame:
        """``(seq, item, op, existed)`` of set_big and remove_big."""
        return bigval.statuses(self.own(log))

    def get_big(self, parts: DataFrame, wanted: DataFrame, key: list[Column]) -> DataFrame:
        """The joined ``value`` of wanted keys from ``parts(item, chunk_no, chunk)``, null where there is none."""
        asked = wanted.select(*wanted.columns, self.key(*key).alias("item"))
        chosen = self.own(parts).join(asked.select("item").distinct(), "item", "left_semi")
        return asked.join(bigval.joined(chosen, "item"), "item", "left").drop("item")


class TypedList(_TypedLog):
    """Lists with struct keys and items: the list operators over ``(seq, op, coll, item, val)``."""

    def log(self, df: DataFrame, seq: Column, op: Column, key: list[Column], item: list[Column], val: Column) -> DataFrame:
        return df.select(seq.alias("seq"), op.alias("op"), self.key(*key).alias("coll"), encoded(*item).alias("item"), val.alias("val"))

    def live(self, log: DataFrame) -> DataFrame:
        return lists.items(self.own(log))

    def _asked(self, log: DataFrame, wanted: DataFrame, key: list[Column], item: list[Column], how: str) -> DataFrame:
        asked = wanted.select(*wanted.columns, self.key(*key).alias("coll"), encoded(*item).alias("item"))
        live = self.live(log).select("coll", "item", *["val"] * (how == "left"))
        return asked.join(live, ["coll", "item"], how).drop("coll", "item")

    def get(self, log: DataFrame, wanted: DataFrame, key: list[Column], item: list[Column]) -> DataFrame:
        return self._asked(log, wanted, key, item, "left")

    def contains(self, log: DataFrame, wanted: DataFrame, key: list[Column], item: list[Column]) -> DataFrame:
        return self._asked(log, wanted, key, item, "left_semi")

    def calls(self, log: DataFrame) -> DataFrame:
        """``(seq, coll, item, op, status, prev)`` of every set, promoting set, get-or-create, replace and removal."""
        done = kv.replay(self.own(log), ("coll", "item")).where("op <> 'get'")
        return done.select("seq", "coll", "item", "op", "status", F.when(F.col("op") != "promote", F.col("prev")).alias("prev"))

    def replace(self, log: DataFrame) -> DataFrame:
        """``(seq, coll, item, result)``: the value before, null where nothing was replaced; takes ``expected`` where the log has it."""
        own = self.own(log)
        if "expected" not in own.columns:
            return self.calls(log).where("op = 'replace'").select("seq", "coll", "item", replaced().alias("result"))
        done = kv.replay_cas(own, ("coll", "item")).where("op = 'replace'")
        return done.select("seq", "coll", "item", replaced(prev="result").alias("result"))

    def iter(self, log: DataFrame) -> DataFrame:
        return lists.ranked(self.live(log))

    def iter_backwards(self, log: DataFrame) -> DataFrame:
        return lists.from_tail(self.live(log))

    def peek(self, log: DataFrame, end: str) -> DataFrame:
        return lists.peek(self.live(log), end)

    def pop(self, log: DataFrame, end: str, n: int = 1) -> tuple[DataFrame, DataFrame]:
        return lists.pop(self.live(log), end, n)

    def len(self, log: DataFrame) -> DataFrame:
        return lists.lengths(self.live(log), self.own(log))

    def discard(self, log: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
        return lists.discard(self.live(log), gone)

    def compact_if_needed(self, log: DataFrame, min_length: int = 100, min_holes_ratio: float = 0.25) -> DataFrame:
        """Live items with the index that the log gave them and their ``new_idx``."""
        return lists.compacted(lists.exact(self.own(log)), min_length, min_holes_ratio)


class TypedDeque(_TypedLog):
    """Double-ended queues with struct keys; pushes drop the index they get."""

    def log(self, df: DataFrame, seq: Column, op: Column, key: list[Column], val: Column) -> DataFrame:
        return df.select(seq.alias("seq"), op.alias("op"), self.key(*key).alias("coll"), val.alias("val"))

    def pops(self, log: DataFrame) -> DataFrame:
        return queues.deque_pops(self.own(log))

    def iter(self, log: DataFrame) -> DataFrame:
        """``(coll, idx, val, pos)``, counted from the head."""
        return lists.ranked(queues.deque_rest(self.own(log)), "idx")

    def iter_backwards(self, log: DataFrame) -> DataFrame:
        return lists.from_tail(queues.deque_rest(self.own(log)), "idx")

    def peek(self, log: DataFrame, end: str) -> DataFrame:
        return queues.peek(queues.deque_rest(self.own(log)), end)

    def range(self, log: DataFrame) -> DataFrame:
        return queues.bounds(queues.deque_rest(self.own(log)), self.own(log))


def replaced(status: str = "status", prev: str = "prev") -> Column:
    """A typed replace gives the previous value, and null where nothing was replaced for either reason."""
    return F.when(F.col(status) == "PrevValue", F.col(prev))


def sortable_u128(high: Column, low: Column) -> Column:
    """16 big-endian bytes of an unsigned 128-bit number from two 64-bit halves; byte order is number order."""
    return F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))
