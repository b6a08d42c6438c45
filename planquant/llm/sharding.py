"""Sharding along a Hilbert curve: files that hold neighbours in several metadata columns at once, so that a filter on any of them
skips most files.

Each dimension becomes an order-preserving key of 16 bits or so (numbers: bit length and the bits behind the leading one; strings: the two
bytes behind what all values begin with), and the key a coordinate of `bits` bits with about as many rows behind each (by exact
counts; these tables have at most 65,538 keys a dimension, which is why they may be broadcast). The coordinates give a cell's
index on the curve. Rows are sorted by (index, size, checksum, id), and the sorted rows are cut into runs: law `rows`, counts at most
one apart. Equal texts with equal metadata are neighbours.

Ranks come from one range shuffle: a row's place in its partition, and the running sum of partition sizes (one row for each
partition). The last key, a row's number in the scan, lets the shuffle split rows that are alike in all other keys, whatever
their share. Places are written to the shared folder before sizes are counted, so a lost executor can't change one without the other.

Nulls come before all values of a dimension; a null text has no bytes, and the checksum of an empty one. Rows that are alike in all
keys are interchangeable, so results don't depend on how rows are dealt out. An empty table gives no rows. Other columns of
`docs` are only read if `columns` names them; they come as one struct `row`, so that names never clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from planquant.functions.arrays import let
from planquant.llm.common import PARTS_PER_CORE, parts_for, shared_table

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5
SHARDS = 24
#: Rows that a partition of the range shuffle has at most, about.
PART_ROWS = 2_000_000
#: Characters of a string that are looked at for what all values begin with.
PREFIX_CHARS = 64


def _xor(values: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), values)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve (long) of a point with as many coordinates of `bits` bits.

    Bit by bit from the highest: an axis whose bit is set reflects the lower bits of the first axis, another exchanges them
    with it; then Gray code over the axes, and interleaving."""
    n = len(coordinates)

    def step(x: Column, s: Column) -> Column:
        low, own = s["bit"] - 1, F.get(x, s["axis"])
        change = lambda which, by: F.transform(x, lambda v, j: F.when(which(j), v.bitwiseXOR(by)).otherwise(v))
        exchanged = let(F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low), lambda t: change(lambda j: (j == 0) != (j == s["axis"]), t))
        return F.when(own.bitwiseAND(s["bit"]) != 0, change(lambda j: j == 0, low)).otherwise(exchanged)

    def interleaved(g: Column) -> Column:
        last = F.get(g, F.lit(n - 1))
        by = _xor([_long(0), *[F.when(last.bitwiseAND(_long(1 << b)) != 0, _long((1 << b) - 1)).otherwise(_long(0)) for b in range(bits - 1, 0, -1)]])
        return let(by, lambda t: reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(F.get(g, F.lit(k)).bitwiseXOR(t), b).bitwiseAND(_long(1)), b * n + n - 1 - k) for b in range(bits) for k in range(n)]))

    point = F.array(*[c.cast("long") for c in coordinates])
    steps = [F.struct(F.lit(k).alias("axis"), _long(1 << b).alias("bit")) for b in range(bits - 1, 0, -1) for k in range(n)]
    turned = F.aggregate(F.array(*steps), point, step) if steps else point
    gray = let(turned, lambda x: F.array(*[_xor([F.get(x, F.lit(j)) for j in range(k + 1)]) for k in range(n)]))
    return let(gray, interleaved)


def number_key(x: Column) -> Column:
    """0 for null, 1 for what is negative or no number of 63 bits; else the bit length and the ten bits behind the leading one."""

    def leading(v: Column) -> Column:
        length = F.length(F.bin(v))
        shift = lambda name, by: F.call_function(name, v, by.cast("int"))
        return 2 + length * 1024 + F.when(length > 11, shift("shiftright", length - 11)).otherwise(shift("shiftleft", 11 - length)).bitwiseAND(_long(1023))

    return F.when(x.isNull(), 0).otherwise(let(F.coalesce(x.try_cast("long"), _long(-1)), lambda v: F.when(v < 0, 1).otherwise(leading(v)))).cast("int")


def string_key(x: Column, begins: str) -> Column:
    """0 for null, else one more than the two bytes behind `begins`, with which all values begin."""
    two = F.hex(F.substring(F.encode(F.substring(x, len(begins) + 1, 2), "UTF-8"), 1, 2))
    return F.when(x.isNull(), 0).otherwise(F.conv(F.rpad(two, 4, "0"), 16, 10).cast("int") + 1)


def dimension_keys(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> list[Column]:
    """The key of each dimension. Strings take a look at all values first (the least and the greatest)."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    strings = [d for d in dimensions if isinstance(kinds[d], T.StringType)]
    begins = {}
    if strings:
        short = {d: F.substring(d, 1, PREFIX_CHARS) for d in strings}
        ends = docs.agg(*[f(short[d]).alias(f"{at}{k}") for k, d in enumerate(strings) for at, f in (("lo", F.min), ("hi", F.max))]).head()
        for k, d in enumerate(strings):
            lo, hi = ends[f"lo{k}"] or "", ends[f"hi{k}"] or ""
            same = next((j for j, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
            begins[d] = lo[:same]
    plain = {T.DateType: F.unix_date, T.TimestampType: F.unix_micros}
    return [string_key(F.col(d), begins[d]) if d in begins else number_key(plain.get(type(kinds[d]), lambda c: c)(F.col(d))) for d in dimensions]


def _coordinates(keyed: DataFrame, n: int, bits: int) -> DataFrame:
    """(axis, key, at): the coordinate of every key, by the share of rows before it and half of its own."""
    each = keyed.select(F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"key{k}").alias("key")) for k in range(n)])).alias("k"))
    counts = each.groupBy("k.axis", "k.key").agg(F.count(F.lit(1)).alias("rows"))
    upto, of = Window.partitionBy("axis").orderBy("key").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("axis")
    twice = 2 * F.sum("rows").over(upto) - F.col("rows")
    return counts.select("axis", "key", F.floor(F.lit(1 << bits) * (twice / (2 * F.sum("rows").over(of)))).cast("int").alias("at"))


def shards(docs: DataFrame, n_shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """doc_id, size (bytes of the text and 8), text_crc32, law, shard, slot (gapless in a shard), grown_shard (null: the law isn't `key`), curve (index
    of the row's cell), and with `columns` these of docs as the struct `row`."""
    n = len(dimensions)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[k.alias(f"key{j}") for j, k in enumerate(dimension_keys(docs, dimensions))],
        F.monotonically_increasing_id().alias("number"),
        *([F.struct(*columns).alias("row")] if columns else []),
    )
    at = _coordinates(keyed, n, bits)
    for k in range(n):
        one = at.filter(F.col("axis") == k).select(F.col("key").alias(f"key{k}"), F.col("at").alias(f"at{k}"))
        keyed = keyed.join(F.broadcast(one), f"key{k}")
    curve = hilbert_index([F.col(f"at{k}") for k in range(n)], bits).alias("curve")
    rest = ["row"] if columns else []
    cells = keyed.select("doc_id", "size", "text_crc32", curve, "number", *rest)
    total = docs.count()
    parts = max(PARTS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_ROWS), parts_for(docs.select(*columns)) if columns else 0)
    order = ["curve", "size", "text_crc32", "doc_id", "number"]
    place = F.monotonically_increasing_id()
    placed = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "curve", *rest, F.shiftright(place, 33).alias("part"), place.bitwiseAND(_long((1 << 33) - 1)).alias("place"))
    placed = shared_table(placed, "shards")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    short, longer = divmod(total, n_shards)  # `longer` shards have one row more
    rank = F.col("before") + F.col("place")
    in_long = rank < longer * (short + 1)
    past = rank - longer * (short + 1)
    shard = F.when(in_long, F.floor(rank / (short + 1))).otherwise(longer + F.floor(past / max(short, 1))).cast("int")
    slot = F.when(in_long, F.pmod(rank, _long(short + 1))).otherwise(F.pmod(past, _long(max(short, 1))))
    own = [F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return placed.join(F.broadcast(before), "part").select("doc_id", "size", "text_crc32", *own, "curve", *rest)


def write_shards(sharded: DataFrame, path: str) -> None:
    """The struct `row` of every row as Parquet, a folder for each shard. Rows come in order of the curve, so a task writes to few folders, and
    row groups keep narrow ranges of every dimension."""
    sharded.select("shard", "row.*").write.partitionBy("shard").parquet(path)


def manifest(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Rows and bytes of each shard, and for each dimension the least and the greatest value and whether there are nulls."""
    ends = [f(F.col(f"row.{d}")).alias(f"{at}_{d}") for d in dimensions for at, f in (("least", F.min), ("greatest", F.max), ("nulls", lambda c: F.count_if(c.isNull())))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ends)


def shards_to_read(known: DataFrame, **ranges: tuple) -> DataFrame:
    """Shards of a manifest that can hold a row whose dimensions lie within these (least, greatest), both included; None leaves an end open."""
    for d, (least, greatest) in ranges.items():
        if least is not None:
            known = known.filter(F.col(f"greatest_{d}") >= F.lit(least))
        if greatest is not None:
            known = known.filter(F.col(f"least_{d}") <= F.lit(greatest))
    return known.select("shard")
