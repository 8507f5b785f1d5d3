"""A rateless code: packets are XORs of blocks whose number follows the ideal soliton distribution.

Seeds decide the block sets by integer arithmetic, so a packet can be made again anywhere.  Encoding is an
equi-join of packets with blocks and a ``bit_xor`` per word; decoding peels one object per group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 1 << 20
WORD_BYTES = 4
PRIME = (1 << 31) - 1
#: The number that stands for the packet itself when its degree is drawn.
OWN_DRAW = 1_000_003


def soliton_cdf(k: Column, blocks: Column) -> Column:
    """The share of packets with at most k blocks: 1/K for one, then 1/(k(k-1)) each."""
    return 1 / blocks + 1 - 1 / k


def draw(seed: Column, block: Column) -> Column:
    """A number for a packet and a block; squares modulo a prime, so that near seeds have unlike orders."""
    u = (seed * 48271 + (block + 1) * 69621) % PRIME
    v = (u * u + seed) % PRIME
    return (v * v + block) % PRIME


def degree(seed: Column, blocks: Column) -> Column:
    """How many blocks the packet of a seed joins: the least k whose share reaches the seed's draw."""
    u = draw(seed.cast("long"), F.lit(OWN_DRAW).cast("long")) % GRID / F.lit(float(GRID))
    return F.when(u < 1 / blocks, 1).otherwise(F.least(F.ceil(1 / (1 + 1 / blocks - u)), blocks)).cast("int")


def block_set(seed: Column, blocks: Column) -> Column:
    """The packet's blocks: those that come first in an order drawn from the seed."""
    numbers = F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)
    drawn = F.transform(numbers, lambda b: F.struct(draw(seed.cast("long"), b).alias("r"), b.cast("int").alias("b")))
    return F.slice(F.transform(F.array_sort(drawn), lambda x: x["b"]), 1, degree(seed, blocks))


def packet_count(blocks: Column, multiple: float) -> Column:
    """How many packets are stored of an object."""
    return F.floor(blocks * multiple + 1).cast("int")


def to_blocks(objects: DataFrame, block_size: int) -> DataFrame:
    """(root, n_bytes, block_count, block, word, value) of ``objects(root, data)``: data in blocks of words, zeros at the end."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_size)).cast("int")
    rows = objects.select("root", "data", F.octet_length("data").alias("n_bytes"), count.alias("block_count"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block_count") - 1)))
    piece = F.rpad(F.hex(F.substring(F.col("data"), F.col("block") * block_size + 1, F.lit(block_size))), 2 * block_size, "0")
    words = -(-block_size // WORD_BYTES)
    values = F.array(*[F.conv(F.rpad(F.substring(piece, 8 * w + 1, 8), 8, "0"), 16, 10).cast("long") for w in range(words)])
    return rows.select("root", "n_bytes", "block_count", "block", F.posexplode(values).alias("word", "value"))


def packets_of(objects: DataFrame, block_size: int, multiple: float) -> DataFrame:
    """(root, chunk_index, seed, n_bytes, block_count): what packets an object has, before their data."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_size)).cast("int")
    rows = objects.select("root", F.octet_length("data").alias("n_bytes"), count.alias("block_count"))
    index = F.explode(F.sequence(F.lit(0), packet_count(F.col("block_count"), multiple) - 1)).alias("chunk_index")
    return rows.select("root", "n_bytes", "block_count", index).withColumn("seed", F.col("root").cast("long") * 1000 + F.col("chunk_index"))


def encode(objects: DataFrame, packets: DataFrame, block_size: int) -> DataFrame:
    """``packets`` with ``blocks`` and ``words``: the XOR of their blocks."""
    sets = packets.withColumn("blocks", block_set(F.col("seed"), F.col("block_count")))
    wide = sets.select("root", "chunk_index", F.explode("blocks").alias("block")).join(to_blocks(objects, block_size).select("root", "block", "word", "value"), ["root", "block"])
    words = wide.groupBy("root", "chunk_index", "word").agg(F.bit_xor("value").alias("value"))
    words = words.groupBy("root", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("words"))
    return sets.join(words, ["root", "chunk_index"])


class Peeler:
    """Takes packets one by one: a packet with one open block gives it, and is XORed out of the others."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.solved: dict[int, list[int]] = {}
        self.holders: dict[int, list[tuple[set, list]]] = {}

    def add(self, names: list[int], words: list[int]) -> bool:
        """Whether all blocks are known now."""
        own, left = set(names), list(words)
        for b in names:
            if b in self.solved:
                own.discard(b)
                left = [x ^ y for x, y in zip(left, self.solved[b])]
        packet = (own, left)
        for b in own:
            self.holders.setdefault(b, []).append(packet)
        ready = [packet]
        while ready:
            own, words = ready.pop()
            if len(own) != 1:
                continue
            b = next(iter(own))
            if b in self.solved:
                continue
            self.solved[b] = list(words)
            for other in self.holders.pop(b):
                other[0].discard(b)
                if other[0]:
                    other[1][:] = [x ^ y for x, y in zip(other[1], self.solved[b])]
                    ready.append(other)
        return len(self.solved) == self.blocks

    def data(self, block_size: int, n_bytes: int) -> bytes | None:
        if len(self.solved) < self.blocks:
            return None
        parts = (b"".join(w.to_bytes(WORD_BYTES, "big") for w in self.solved[b])[:block_size] for b in range(self.blocks))
        return b"".join(parts)[:n_bytes]


def fetch(packets: DataFrame, block_size: int, most_misses: int = 100) -> DataFrame:
    """(root, complete, gave_up, fetched, solved, data): packets of an object read in the order of their index until it can be
    decoded; more than ``most_misses`` missing ones end the reading."""

    def read(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk_index").to_pylist(), table.column("blocks").to_pylist(), table.column("words").to_pylist()))
        peeler = Peeler(table.column("block_count")[0].as_py())
        done, fetched, next_, misses, gave_up = False, 0, 0, 0, False
        for index, names, words in rows:
            misses += index - next_
            next_ = index + 1
            if misses > most_misses:
                gave_up = True
                break
            fetched += 1
            done = peeler.add(names, words)
            if done:
                break
        data = peeler.data(block_size, table.column("n_bytes")[0].as_py())
        root = table.column("root")[0].as_py()
        return pa.table({"root": pa.array([root], pa.int64()), "complete": [done], "gave_up": [gave_up], "fetched": pa.array([fetched], pa.int32()),
                         "solved": pa.array([len(peeler.solved)], pa.int32()), "data": pa.array([data], pa.binary())})

    rows = packets.select(F.col("root").cast("long").alias("root"), "chunk_index", "blocks", "words", "block_count", "n_bytes")
    return rows.groupBy("root").applyInArrow(read, "root long, complete boolean, gave_up boolean, fetched int, solved int, data binary")


def decode(packets: DataFrame, block_size: int) -> DataFrame:
    """(root, complete, solved, data) by peeling, of whatever packets there are."""
    return fetch(packets, block_size, 1 << 60).select("root", "complete", "solved", "data")


def missing(expected: DataFrame, present: DataFrame) -> DataFrame:
    """The packets of ``expected`` that are not there: what a repair makes again."""
    return expected.join(present.select("root", "chunk_index"), ["root", "chunk_index"], "left_anti")


def progress(packets: DataFrame) -> DataFrame:
    """(root, chunk_index, block, done): a block is done once packets up to this one name it."""
    seen = packets.select("root", F.explode("blocks").alias("block"), "chunk_index").groupBy("root", "block").agg(F.min("chunk_index").alias("first"))
    every = packets.select("root", "chunk_index", F.explode(F.sequence(F.lit(0), F.col("block_count") - 1)).alias("block"))
    return every.join(seen, ["root", "block"], "left").select("root", "chunk_index", "block", F.coalesce(F.col("first") <= F.col("chunk_index"), F.lit(False)).alias("done"))
