"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata columns are quantised into cells that hold about equally many rows, a row's cells give its
place on a Hilbert curve, rows are ordered by that place, and the order is cut into runs.  Rows of a run are
close in every column at once, so a reader that keeps each shard's least and greatest values (``manifest``)
skips most shards for a range of any of the columns (``pruned``).

* Cells: a value's code among 2,048 (the mean of its linear and its logarithmic place between the column's least and
  greatest value; strings by the six bytes after what all of them share) is counted over all rows, and the
  codes are cut where the counts say.  What reaches the driver is two values and at most 2,049 counts a column.
* Order: curve place, CRC of the text, id, size.  One range shuffle of narrow rows, so rows that agree in all columns
  (a group of copies, say) are spread over tasks by what follows; ranks are a number within each sorted range plus
  the sizes of the ranges before it.  Copies with equal cells lie next to each other.
* Laws: ``rows`` (counts of shards differ by one at most) or ``bytes`` (a row goes where the middle of its bytes falls,
  so shards differ by less than the largest row).

A null or NaN value has a cell below all others; infinite values count as the least or greatest finite one.  A null text
has no bytes; every row counts 16 bytes besides.  Null and repeated ids are rows like all others; rows that agree in
everything may change places among themselves.  More shards than rows leave shards empty, an empty table gives no
rows, and extra columns of any name are not looked at.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resampla.llm.common import materialize, partitions

CODES, BITS, ROW_BYTES = 2048, 8, 16
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date", "timestamp")

# ---------------------------------------------------------------- the curve


def turn_left(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of each state of the curve in ``n`` dimensions and corner of its cube, at state * 2**n + corner.

    A state is a cube's entry corner and direction (entry * n + direction); sub-cubes are visited in Gray code order.
    """
    digits, states = [], []
    for state in range(n << n):
        entry, direction = divmod(state, n)
        for corner in range(1 << n):
            gray = turn_left(corner ^ entry, -(direction + 1), n)
            w = gray
            for s in range(1, n):
                w ^= gray >> s
            low = 2 * ((w - 1) // 2) if w else 0  # the sub-cube's own entry is the Gray code of this
            ones = (w if w % 2 else max(0, w - 1)) + 1  # its direction: the trailing ones of w, or of w - 1
            own = (ones & -ones).bit_length() - 1 if w else 0
            digits.append(w)
            states.append((entry ^ turn_left(low ^ (low >> 1), direction + 1, n)) * n + (direction + own + 1) % n)
    return digits, states


def lookup(values: list[int], at: Column) -> Column:
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at)


def curve_place(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of integer cells 0 .. 2**bits - 1, the highest bits first."""
    n = len(cells)
    digits, states = curve_tables(n)
    corners = F.array(*[sum((F.shiftright(c, i).bitwiseAND(F.lit(1)) * (1 << j) for j, c in enumerate(cells)), F.lit(0)) for i in reversed(range(bits))])

    def step(held: Column, corner: Column) -> Column:
        at = held["state"] * (1 << n) + corner
        return F.struct((held["place"] * (1 << n) + lookup(digits, at)).alias("place"), lookup(states, at).alias("state"))

    return F.aggregate(corners, F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("state")), step, lambda held: held["place"])


# ---------------------------------------------------------------- cells


def numeric(df: DataFrame, dims: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Each column as a double that keeps its order."""
    kinds = dict(df.dtypes)
    words = [c for c in dims if kinds[c] == "string"]
    for c in dims:
        if c not in words and kinds[c].split("(")[0].removesuffix("_ntz") not in NUMBERS:
            raise ValueError(f"{c}: a {kinds[c]} has no order to be cut by")
    ends = df.agg(F.lit(0), *[f(F.encode(F.col(c), "utf-8")) for c in words for f in (F.min, F.max)]).first()[1:] if words else ()
    out = {}
    for c in dims:
        if c in words:
            i = words.index(c)
            low, high = (bytes(x or b"") for x in ends[2 * i : 2 * i + 2])
            shared = len(os.path.commonprefix([low, high]))
            six = F.hex(F.substring(F.encode(F.col(c), "utf-8"), shared + 1, 6))
            out[c] = F.conv(F.rpad(six, 12, "0"), 16, 10).cast("double")
        elif kinds[c] == "date":
            out[c] = F.unix_date(c).cast("double")
        else:
            x = F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kinds[c].startswith("timestamp") else F.col(c).cast("double")
            out[c] = F.when(~F.isnan(x), x)
    return df, out


def codes(df: DataFrame, dims: list[str]) -> list[Column]:
    """0 for null, else 1 .. CODES, never falling as the value rises."""
    df, value = numeric(df, dims)
    finite = {c: F.when(F.abs(x) < float("inf"), x) for c, x in value.items()}
    ends = df.agg(*[f(finite[c]) for c in dims for f in (F.min, F.max)]).first()
    out = []
    for i, c in enumerate(dims):
        low, high = (ends[2 * i] or 0.0), (ends[2 * i + 1] or 0.0)
        if high <= low:
            out.append(F.when(value[c].isNull(), 0).otherwise(1))
            continue
        x = F.least(F.greatest(value[c], F.lit(low)), F.lit(high)) - F.lit(low)
        place = (x / F.lit(high - low) + F.log1p(x) / F.log1p(F.lit(high - low))) / 2
        out.append(F.when(value[c].isNull(), 0).otherwise(F.least(F.lit(CODES), F.floor(place * CODES).cast("int") + 1)))
    return out


def cells(df: DataFrame, dims: list[str], bits: int = BITS) -> tuple[DataFrame, list[Column]]:
    """(``df`` with codes _c0, _c1, ..., cell columns over them): equally filled cells 0 .. 2**bits - 1 of each column."""
    coded = df.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(codes(df, dims))])
    marks = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"_c{i}").alias("code")) for i in range(len(dims))])).alias("x")
    counts = {(r["dim"], r["code"]): r["n"] for r in coded.select(marks).groupBy("x.dim", "x.code").agg(F.count("*").alias("n")).collect()}
    out = []
    for i in range(len(dims)):
        total, before, table = max(1, sum(n for (d, _), n in counts.items() if d == i)), 0, []
        for code in range(CODES + 1):
            n = counts.get((i, code), 0)
            table.append((2 * before + n << bits) // (2 * total))
            before += n
        out.append(lookup([min(t, (1 << bits) - 1) for t in table], F.col(f"_c{i}")))
    return coded, out


# ---------------------------------------------------------------- shards


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int, law: str = "rows", bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, place) of every row, and with ``rows`` the whole row as ``_row``."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    if not 1 <= len(dims) <= 5 or len(dims) * bits > 60:
        raise ValueError("one to five columns, with 60 bits in all at most")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(docs[f"`{text_col}`"], F.lit("")), "utf-8")
    whole = [F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("_row")] if rows else []
    base = docs.select(docs[f"`{id_col}`"].alias("_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *[docs[f"`{c}`"].alias(f"_d{i}") for i, c in enumerate(dims)], *whole)
    base = materialize(base, "metadata")
    coded, at = cells(base, [f"_d{i}" for i in range(len(dims))], bits)
    keys = ["place", "text_crc32", "_id", "size"]
    placed = coded.select(curve_place(at, bits).alias("place"), "text_crc32", "_id", "size", *(["_row"] if rows else []))
    ordered = placed.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    # the number within its range is written down with the row: a task that runs again reads it, never draws it anew
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    within, part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_at", 33)
    counted = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ahead = counted.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_ahead_bytes"))
    totals = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b")).first()
    n, total = totals["n"], totals["b"]
    ranked = ordered.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn("_rank", F.col("_ahead") + within)
    if law == "rows":
        shard = F.floor(F.expr(f"_rank * {shards} div {max(1, n)}"))
        out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}"))
    else:
        running = F.coalesce(F.sum("size").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        middle = ranked.withColumn("_middle", 2 * (F.col("_ahead_bytes") + running) + F.col("size"))
        cut = middle.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"_middle * {shards} div {2 * max(1, total)}").cast("int")))
        first = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row a shard
        out = cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "place", *(["_row"] if rows else []))


def write_shards(docs: DataFrame, path: str, dims: list[str], shards: int, law: str = "rows", shard_col: str = "shard", **options) -> DataFrame:
    """Write whole rows into a folder a shard, in curve order, and return the shards' ``manifest``."""
    if shard_col in docs.columns:
        raise ValueError(f"the rows have a column {shard_col}: choose another shard_col")
    placed = hilbert_shards(docs, dims, shards, law, rows=True, **options)
    rows = placed.select("_row.*", F.col("shard").alias(shard_col), F.col("slot").alias("_slot"))
    # runs of a shard: no task holds a whole shard unless shards are fewer than partitions
    rows.repartitionByRange(partitions(docs.sparkSession), shard_col, "_slot").sortWithinPartitions(shard_col, "_slot").drop("_slot").write.partitionBy(shard_col).parquet(path)
    return manifest(docs.sparkSession.read.parquet(path), dims, shard_col)


def manifest(rows: DataFrame, dims: list[str], shard_col: str = "shard") -> DataFrame:
    """One row a shard: its rows, and of each column the least and greatest value and the number of nulls."""
    return rows.groupBy(shard_col).agg(F.count("*").alias("n_rows"), *[f for c in dims for f in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))])


def pruned(shards: DataFrame, shard_col: str = "shard", **ranges: tuple) -> DataFrame:
    """Shards of a manifest that can hold rows within all of the ranges (least, greatest), either end None for open."""
    keep = F.lit(True)
    for c, (low, high) in ranges.items():
        if low is not None:
            keep = keep & (F.col(f"{c}_max") >= F.lit(low))
        if high is not None:
            keep = keep & (F.col(f"{c}_min") <= F.lit(high))
    return shards.where(keep).select(shard_col)
