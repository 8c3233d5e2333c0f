"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Fingerprints at 2 or fewer differing bits agree in at least two of four blocks of 16 bits,
so close pairs meet under one of six keys of two blocks each; there they are joined and
their Hamming distance is verified. Only distinct fingerprints are keyed, so exact copies
cost nothing. Keys that more than HOT_BUCKET fingerprints share get no pairs: their members
are listed under each of the 65 values within one bit of them instead. Fingerprints at 2 or
fewer bits share such a value, at most 65 fingerprints share any, and those that share one
are linked to the smallest of them, which loses no link between components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import components
from .frames import written

SHINGLE = 3
SEED = 42
#: Differing bits at which fingerprints link; the keys and the values around a fingerprint hold for this number.
DISTANCE = 2
BLOCKS = 4
#: Above so many fingerprints under one key, no pairs are made.
HOT_BUCKET = 16

_SHIFTS = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_block(text: blocks.Raw, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text of a block."""
    from xxhash import xxh64_intdigest

    data, starts, ends, bounds = blocks.normal(text, blocks.SPACED)
    found = np.zeros(len(bounds) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a == b:
            continue
        size = min(shingle, b - a)
        hashes = np.array([xxh64_intdigest(data[s:e], seed) for s, e in zip(starts[a : b - size + 1].tolist(), ends[a + size - 1 : b].tolist())], np.uint64)
        cells = hashes.view(np.uint8).reshape(-1, 8) + _SHIFTS
        counts = np.einsum("ij,jk->ik", np.bincount(cells.ravel(), minlength=2048).reshape(8, 256), _BITS)
        found[i] = np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view(np.uint64)[0]
    return found


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the 64 bits as a signed long) for each row; texts without words, null ones too, have 0."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.blocks(batches, "text"):
            found = fingerprint_block(blocks.raw(block.column("text")), shingle, seed)
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(found.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def links(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """u < v: links between distinct fingerprints (column fp) whose components are those of all links."""
    fps = prints.select("fp").distinct()
    width = 64 // BLOCKS
    part = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    keys = [part[a].bitwiseOR(F.shiftleft(part[b], width)).bitwiseOR(F.lit(n << 2 * width)) for n, (a, b) in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(met, "key")
    cold = keyed.where(F.col("n") <= hot_bucket).select("key", "fp")
    other = cold.select("key", F.col("fp").alias("v"))
    pairs = cold.withColumnRenamed("fp", "u").join(other, "key").where(F.col("u") < F.col("v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select("u", "v")
    hot = keyed.where(F.col("n") > hot_bucket).select("fp").distinct()
    around = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    centres = hot.select("fp", F.explode(F.transform(around, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("centre"))
    # At most 65 distinct fingerprints lie within one bit of a centre.
    stars = centres.groupBy("centre").agg(F.collect_set("fp").alias("own")).where(F.size("own") > 1)
    stars = stars.select(F.array_min("own").alias("u"), F.explode("own").alias("v")).where("u <> v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: one row for each row of ``docs``.

    component_id is the smallest key that links lead to, itself included (null keys aside).
    Null and empty texts have fingerprint zero and link like others; repeated rows share their
    fingerprint; empty ``docs`` give no rows; columns besides key and text are not read.
    """
    prints = written(fingerprints(docs, shingle, seed, key, text), "prints")
    named = components(links(prints))
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    classes = least.join(named.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(heads, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
