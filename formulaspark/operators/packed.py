"""Pixel tables as packed chunks: some thousand pixels of a picture in a row of bytes.

Pixels that follow each other are packed where they are read, so that an exchange, a sort or a
join by picture moves a few bytes a pixel and one row a chunk.  Chunks have ``image_id, h, w``
(bottom and right of what they hold) and ``y, x, v``: numbers in the narrowest type that fits,
compressed, so that a task that is dealt so many bytes holds about as many.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a task gathers before it sends them on.
ROWS = 50_000
PIXELS = "y int, x int, v int"
CHUNK = "h int, w int, y binary, x binary, v binary"


def as_bytes(a: np.ndarray) -> bytes:
    low, high = (a.min(), a.max()) if len(a) else (0, 0)
    kind = next(k for k in ("u1", "u2", "i4") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind.encode() + zlib.compress(a.astype(kind).tobytes(), 1)


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[2:]), data[:2].decode())


def chunk(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple:
    """The columns of one chunk, each with one value."""
    return [int(y.max()) + 1], [int(x.max()) + 1], [as_bytes(y)], [as_bytes(x)], [as_bytes(v)]


def chunks_of(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple:
    """The columns of chunks of ``ROWS`` pixels at most."""
    parts = [chunk(y[a : a + ROWS], x[a : a + ROWS], v[a : a + ROWS]) for a in range(0, len(y), ROWS)]
    return tuple([p[0] for p in column] for column in zip(*parts, strict=True))


def weight(made: tuple) -> int:
    """How many rows columns count as: lists of bytes by their length."""
    last = made[-1]
    return len(last) + sum(len(d) for d in last if isinstance(d, bytes)) // 8

def id_kind(table: DataFrame, key: str = "image_id") -> str:
    return f"{key} {table.schema[key].dataType.simpleString()}"


def is_packed(table: DataFrame) -> bool:
    return table.schema["v"].dataType.simpleString() == "binary"


def packed(pixels: DataFrame) -> DataFrame:
    """Chunks of a pixel table (chunks stay as they are)."""
    if is_packed(pixels):
        return pixels

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("image_id")
            code = ids.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            y, x, v = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
            order = None if (np.diff(code) >= 0).all() else np.argsort(code, kind="stable")
            if order is not None:
                code, y, x, v = code[order], y[order], x[order], v[order]
            starts = np.flatnonzero(np.r_[True, np.diff(code) != 0])
            parts = [chunk(y[a:b], x[a:b], v[a:b]) for a, b in zip(starts, [*starts[1:], len(code)], strict=True)]
            own = ids.take(pa.array(starts if order is None else order[starts]))
            h, w, *data = ([p[0] for p in column] for column in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([own, pa.array(h, pa.int32()), pa.array(w, pa.int32()), *[pa.array(d, pa.binary()) for d in data]], ["image_id", "h", "w", "y", "x", "v"])

    return pixels.select("image_id", "y", "x", "v").mapInArrow(pack, f"{id_kind(pixels)}, {CHUNK}")


def sent(names: list[str], types: list[pa.DataType], rows: list[tuple], keys: list) -> pa.RecordBatch:
    """Rows of many pictures, each with its key."""
    counts = [len(r[0]) for r in rows]
    own = pa.array(keys, types[0]).take(pa.array(np.repeat(np.arange(len(keys)), counts)))
    join = lambda parts, t: pa.array(np.concatenate(parts), t) if isinstance(parts[0], np.ndarray) else pa.array([x for p in parts for x in p], t)
    return pa.RecordBatch.from_arrays([own, *[join(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)]], names)


def each(chunks: DataFrame, change: Callable, kind: str, by: tuple[str, ...] = ("image_id",), more: tuple[str, ...] = (), dealt: bool = True) -> DataFrame:
    """``image_id`` and the columns ``kind`` of what ``change`` makes of each picture, or of each group ``by``.

    ``change`` gets the key, the arrays ``y, x, v`` and the values of the columns ``more``; it gives
    a tuple of columns, or None for nothing.  Where ``dealt`` is false, chunks are taken one by one
    as they lie.
    """
    key = by[0]
    kind = f"{id_kind(chunks, key)}, {kind}"
    schema = to_arrow_schema(chunks.sparkSession.createDataFrame([], kind).schema)
    names, types = schema.names, schema.types

    def run(batches):
        held, parts, values = None, [], ()
        rows, keys, n = [], [], 0

        def done():
            y, x, v = (np.concatenate(p).astype(np.int32) for p in zip(*parts, strict=True))
            return change(held, y, x, v, *values)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*by, *more, "y", "x", "v"))
            for row in zip(*columns, strict=True):
                own, extra, data = row[: len(by)], row[len(by) : -3], tuple(map(numbers, row[-3:]))
                if dealt and parts and own == held:
                    parts.append(data)
                    continue
                if parts and (made := done()) is not None and len(made[0]):
                    rows.append(made)
                    keys.append(held[0])
                    n += weight(made)
                    if n >= ROWS:
                        yield sent(names, types, rows, keys)
                        rows, keys, n = [], [], 0
                held, parts, values = own, [data], extra
        if parts and (made := done()) is not None and len(made[0]):
            rows.append(made)
            keys.append(held[0])
        if rows:
            yield sent(names, types, rows, keys)

    own = chunks.select(*by, *more, "y", "x", "v")
    return (own.repartition(*by).sortWithinPartitions(*by) if dealt else own).mapInArrow(run, kind)


def pictures(pixels: DataFrame, change: Callable, kind: str = PIXELS) -> DataFrame:
    """``each`` picture of a table of pixels or chunks; ``kind`` ``CHUNK`` makes chunks of what ``change`` gives."""
    if kind != CHUNK:
        return each(packed(pixels), change, kind)
    return each(packed(pixels), lambda *picture: chunks_of(*made) if (made := change(*picture)) is not None else None, kind)


def unpacked(chunks: DataFrame) -> DataFrame:
    """The pixels of chunks."""
    return each(chunks, lambda key, y, x, v: (y, x, v), PIXELS, dealt=False) if is_packed(chunks) else chunks


def by_tiles(chunks: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """Chunks cut at tiles: with ``ty, tx``; a pixel goes to its own tile and to those it borders by ``halo``."""

    def near(at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a tile for each pixel and whether it counts, each tile of a pixel once."""
        own = at // tile
        if not halo:
            return [(own, np.ones(len(at), bool))]
        low, high = np.maximum((at - halo) // tile, 0), (at + halo) // tile
        return [(own, np.ones(len(at), bool)), (low, low != own), (high, (high != own) & (high != low))]

    def cut(key, y, x, v):
        found = []
        for ty, of_y in near(y):
            for tx, of_x in near(x):
                on = np.flatnonzero(of_y & of_x)
                place = ty[on].astype(np.int64) << 32 | tx[on]
                for one in np.unique(place):
                    at = on[place == one]
                    found.append(([int(one >> 32)], [int(one & 0xFFFFFFFF)], *chunk(y[at], x[at], v[at])))
        return tuple([p[0] for p in column] for column in zip(*found, strict=True))

    return each(chunks, cut, f"ty int, tx int, {CHUNK}", dealt=False)


def beside(chunks: DataFrame, things: DataFrame, tile: int, how: str = "inner") -> DataFrame:
    """Chunks cut at tiles with the list ``things`` of what lies in their tile; ``things`` has ``image_id``,
    a column ``thing`` and its box ``x, y, w, h``."""
    spot = lambda lo, size: F.explode(F.expr(f"sequence(cast({lo} div {tile} as int), cast(({lo} + {size} - 1) div {tile} as int))"))
    own = things.withColumn("ty", spot("y", "h")).withColumn("tx", spot("x", "w"))
    lists = own.groupBy("image_id", "ty", "tx").agg(F.collect_list("thing").alias("things"))
    # lists of all pictures together may be large, whatever their source was
    return by_tiles(chunks, tile).join(lists.hint("merge"), ["image_id", "ty", "tx"], how)
