"""Template residue, filler, error pages and script notices in a corpus.

The units are the sentences of a text (a line without sentence end is one), compared without
case, punctuation, accents and the digits of numbers. Every unit gets a SimHash of its five-word
shingles; equal fingerprints are one unit from there on, so copies cost nothing further.

Labels start from few units that are trusted: the known texts of ``residue_seeds``, which are
units of the graph like any other, and units in one of the open forms of ``residue_rules``. They
spread to near-duplicates. Fingerprints are kept in partitioned tables, keyed by two, three
or four of their eight bytes, more the more units there are, so that a place in a table holds
few units at any size. Fingerprints within the Hamming radius that meet in a table are candidates;
pairs that the tables miss share one of the least shingles of both, as many of a unit as the
similarity asked for makes certain (the prefix filter), so no pair is lost. Candidates
are verified by the exact Jaccard similarity of their shingles. Newly labelled units are the
next front, until a round brings none: this walks the connected components that hold a trusted
label, and only those. A label that rests on an unfilled slot does not spread: a near-duplicate
without the slot is the template filled in, and one with it has a label of its own.

Only the occupied places of the front, bitmaps of fixed size whatever the corpus, are ever
gathered on the driver. Tables between rounds are written to the executors' shared folder. Texts
are never shuffled: to verify, the documents that hold a candidate are read again in place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.written import dropped, written
from .bitmaps import bitmap, held
from .residue_rules import MARK, SLOT, SLOTTED, SPREADS, trusted
from .residue_seeds import known_residue
from .words import WordHashes, mixed, words

SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")
WIDTH = 5
#: Bits of a key or fingerprint by which its place in a bitmap is told, and of a document's place.
PLACE_BITS, DOCUMENT_BITS = 26, 20
GO = 1_000_000
#: Bits that a shingle leaves to the number of its unit among those handled in one go.
SPARE_BITS = 20
SHINGLE = np.uint64(2**64 - 2**SPARE_BITS)
_SLOTTED = f" {SLOTTED.decode()} "
_STEPS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(WIDTH)], dtype=np.uint64)


_words = WordHashes(same_numbers=True)


def units(text: str | None) -> list[tuple[str, list[bytes]]]:
    """The sentences of a text with their words; slots of templates are words, units without words are none."""
    if not text:
        return []
    marked = any(c in text for c in "{<[@#_%$")
    found = []
    for line in text.splitlines():
        for s in SENTENCE.split(line):
            t = words(SLOT.sub(_SLOTTED, s) if marked and MARK.search(s) else s)
            if t:
                found.append((s, t))
    return found


def shingles(tokens: list[bytes]) -> np.ndarray:
    """Hashes of the five-word shingles of a unit, 44 bits followed by zeros; a shorter unit is one shingle."""
    h = _words.of(tokens)
    k = min(WIDTH, len(h))
    total = sum((h[i : len(h) - k + 1 + i] * _STEPS[i] for i in range(k)), np.zeros(len(h) - k + 1, np.uint64))
    return mixed(total) & SHINGLE


def hashed(units_tokens: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of all units at once, where each unit's begin and how many it has; the same as ``shingles``."""
    lengths = np.array([len(t) for t in units_tokens])
    h = _words.of(chain.from_iterable(units_tokens))
    padded = np.concatenate((h, np.zeros(WIDTH, np.uint64)))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = np.zeros(len(h), np.uint64)
    for k in range(WIDTH):
        total += padded[k : len(h) + k] * _STEPS[k]
    short = np.flatnonzero(lengths < WIDTH)
    for k in range(1, WIDTH):  # a shorter unit's shingle must not reach into the next unit
        some = short[lengths[short] == k]
        total[starts[some]] = sum((h[starts[some] + i] * _STEPS[i] for i in range(k)), np.zeros(len(some), np.uint64))
    return mixed(total) & SHINGLE, starts, np.maximum(lengths - WIDTH + 1, 1)


def fingerprints(units_tokens: list[list[bytes]]) -> np.ndarray:
    """The SimHash of each unit, all units at once; the majority of 64 bits made of each of its different ``shingles``."""
    return _majorities(*different(*hashed(units_tokens)))


def different(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each unit in order, one list after another, and how many there are of each."""
    unit = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    h = hashes[np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)]
    if len(n) <= 1 << SPARE_BITS:  # unit and hash are one number, which sorts fast
        key = unit << np.uint64(64 - SPARE_BITS) | h >> np.uint64(SPARE_BITS)
        key.sort()
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        key = key[fresh]
        return key << np.uint64(SPARE_BITS), np.bincount((key >> np.uint64(64 - SPARE_BITS)).astype(np.int64), minlength=len(n))
    h = h[np.lexsort((h, unit))]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
    return h[fresh], np.bincount(unit[fresh].astype(np.int64), minlength=len(n))


def prefixes(h: np.ndarray, m: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The least of each unit's different shingles, one list after another, and how many there are of each.

    There are as many as make sure that two units of this similarity or more share one.
    """
    rank = np.arange(len(h)) - np.repeat(np.cumsum(m) - m, m)
    many = m - np.ceil(similarity * m - 1e-9).astype(np.int64) + 1
    return h[rank < np.repeat(many, m)], many


def _majorities(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    starts = np.cumsum(n) - n
    bits = np.unpackbits(np.append(mixed(hashes), np.uint64(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = np.stack((starts, starts + n), axis=1).ravel()
    count = np.add.reduceat(bits, edges, axis=0, dtype=np.uint8)[::2].astype(np.int32)  # bytes add up fast
    for i in np.flatnonzero(n > 255):  # where they would overflow
        count[i] = bits[starts[i] : starts[i] + n[i]].sum(axis=0, dtype=np.int32)
    return np.packbits(count * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _scan(similarity: float):  # noqa: ANN202
    """doc, print, trusted, and the number of different shingles with the least of them: of each text its different fingerprints once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column(1), 0
            while lo < len(texts):
                hi, size, at, listed, sure = lo, 0, [], [], []
                while hi < len(texts) and size < GO:
                    text = texts[hi].as_py()
                    size += len(text or "")
                    for s, t in units(text):
                        at.append(hi)
                        listed.append(t)
                        sure.append(trusted(s, t))
                    hi += 1
                lo = hi
                if not listed:
                    continue
                at, sure = np.array(at), np.array(sure, dtype=np.int8)
                prints, m, least = _described(listed, similarity)
                order = np.lexsort((-sure, prints, at))
                first = np.ones(len(order), bool)
                first[1:] = (at[order][1:] != at[order][:-1]) | (prints[order][1:] != prints[order][:-1])
                keep = order[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at[keep])), pa.array(prints[keep]), pa.array(sure[keep]), pa.array(m[keep]), least.take(pa.array(keep))],
                    names=["__id", "print", "trusted", "m", "least"],
                )

    return make


def _described(listed: list[list[bytes]], similarity: float) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Fingerprint, number of different shingles and the least of them, of each unit."""
    h, m = different(*hashed(listed))
    least, many = prefixes(h, m, similarity)
    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(many)).astype(np.int32), least.view(np.int64))
    return _majorities(h, m).view(np.int64), m.astype(np.int32), lists


def tables(n_units: int) -> tuple[tuple[int, ...], ...]:
    """The bytes of a fingerprint that key each table: as many as give a place to each unit or so."""
    return tuple(combinations(range(8), 2 if n_units <= 1 << 16 else 3 if n_units <= 1 << 24 else 4))


def _entries(bytes_of: tuple[tuple[int, ...], ...], similarity: float, occupied: np.ndarray | None):  # noqa: ANN202
    """(key, print, m, rank) of every unit in every table (rank -1) and of its least shingles, or of those in places that are occupied.

    Units with so few different shingles that all must be shared have none: their fingerprints would be equal.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                some = batch.slice(lo, 20_000)
                m = some.column(1).to_numpy()
                some = some.filter(pa.array(m >= similarity * (m + 1) - 1e-9))
                prints, m, lists = some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2)
                b = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8).astype(np.uint64)
                keys, row, rank = [], [], []
                for t, chosen in enumerate(bytes_of):
                    key = np.full(len(b), t, np.uint64)
                    for c in chosen:
                        key = key << np.uint64(8) | b[:, c]
                    keys.append(mixed(key))
                    row.append(np.arange(len(b)))
                    rank.append(np.full(len(b), -1, np.int32))
                many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                keys.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                row.append(np.repeat(np.arange(len(many)), many))
                rank.append((np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32))
                keys, row, rank = map(np.concatenate, (keys, row, rank))
                if occupied is not None:
                    kept = np.flatnonzero(held(occupied, keys >> np.uint64(64 - PLACE_BITS)))
                    keys, row, rank = keys[kept], row[kept], rank[kept]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints[row]), pa.array(m[row]), pa.array(rank)], names=["key", "print", "m", "rank"])

    return make


def _sets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """print and the shingles of a unit with that fingerprint. ``asked``: print and ``at``, a document that holds it."""
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - DOCUMENT_BITS).cast("int")
    holding = asked.select(place("at").alias("__p")).distinct()  # places, not documents: 2^20 at most
    wanted = bitmap(asked.select(F.shiftrightunsigned("print", 64 - PLACE_BITS).cast("int")), PLACE_BITS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                listed = [t for _, t in units(text)]
                if not listed:
                    continue
                prints = fingerprints(listed)
                some = np.flatnonzero(held(wanted, prints >> np.uint64(64 - PLACE_BITS)))
                sets = [np.unique(shingles(listed[k])).view(np.int64).tolist() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(prints[some].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["print", "shingles"])

    holders = rows.withColumn("__p", place("__id")).join(F.broadcast(holding), "__p", "left_semi").select("__text")
    return holders.mapInArrow(cut, "print bigint, shingles array<bigint>").groupBy("print").agg(F.min("shingles").alias("shingles"))


def _seed_units(spark: SparkSession, seeds: Sequence[str], similarity: float) -> DataFrame:
    """The units of the seeds; as many rows as the stated list gives."""
    listed = [t for s in seeds for _, t in units(s)]
    kind = "print bigint, m int, least array<bigint>, shingles array<bigint>"
    if not listed:
        return spark.createDataFrame([], kind)
    prints, m, least = _described(listed, similarity)
    rows = {int(p): (int(p), int(k), x, np.unique(shingles(t)).view(np.int64).tolist()) for p, k, x, t in zip(prints, m, least.to_pylist(), listed, strict=True)}
    return spark.createDataFrame(list(rows.values()), kind)


def residue_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    radius: int = 12,
    seeds: Sequence[str] | None = None,
) -> DataFrame:
    """The documents that hold residue: doc_id, n_units (its different units with a label) and step.

    ``step`` tells how a label reached the document first: 0 by an open form, 1 as a copy of a
    seed, k + 1 in the k-th round over near-duplicates. ``seeds`` are known texts of residue, a
    list of bounded size. Null, empty and blank texts hold none. ``doc_id`` is unique.
    ``radius`` bounds the Hamming distance of the tables' candidates, the prefix filter gives the
    others, ``similarity`` decides. Rounds go on until one brings nothing new. Work starts with the call:
    tables between rounds are written before the result is asked for.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("__id"), docs[text].alias("__text")).where(F.col("__text").isNotNull())
    known = _seed_units(spark, known_residue() if seeds is None else seeds, similarity)
    scanned = written(rows.mapInArrow(_scan(similarity), f"__id {kind}, print bigint, trusted tinyint, m int, least array<bigint>"))
    prints = written(scanned.groupBy("print").agg(F.max("trusted").alias("trusted"), F.min("__id").alias("at")))
    bytes_of = tables(prints.count())
    copies = prints.where("trusted = 0").join(F.broadcast(known.select("print")), "print", "left_semi")
    ruled = prints.where("trusted > 0")
    labelled = ruled.select("print", F.lit(0).alias("step")).unionByName(copies.select("print", F.lit(1).alias("step")))
    front = scanned.join(prints.where(F.col("trusted") == SPREADS), "print", "left_semi").select("print", "m", "least").unionByName(known.select("print", "m", "least"))
    entry = "key bigint, print bigint, m int, rank int"
    step = 1
    while True:
        theirs = written(front.mapInArrow(_entries(bytes_of, similarity, None), entry).distinct())
        occupied = bitmap(theirs.select(F.shiftrightunsigned("key", 64 - PLACE_BITS).cast("int")), PLACE_BITS)
        if not occupied.any():
            break
        # The least shingle that two units share leaves them as many more as follow it in both.
        m, their_m = F.col("m"), F.col("their_m")
        left = F.least(m - F.col("rank"), their_m - F.col("their_rank"))
        sharing = (F.col("rank") >= 0) & (F.col("their_rank") >= 0) & (left + 1e-6 >= (m + their_m) * (similarity / (1 + similarity)))
        meeting = (F.col("rank") < 0) & (F.col("their_rank") < 0) & (F.bit_count(F.col("print").bitwiseXOR(F.col("known"))) <= radius)
        near = written(
            scanned.select("print", "m", "least")
            .mapInArrow(_entries(bytes_of, similarity, occupied), entry)
            .distinct()
            .join(theirs.select("key", F.col("print").alias("known"), F.col("m").alias("their_m"), F.col("rank").alias("their_rank")), "key")
            .where((sharing | meeting) & (F.least(m, their_m) + 1e-6 >= F.lit(similarity) * F.greatest(m, their_m)) & (F.col("print") != F.col("known")))
            .select("print", "known")
            .distinct()
            .join(labelled, "print", "left_anti")
        )
        dropped(theirs)
        if near.isEmpty():
            break
        asked = near.select("print").union(near.select("known")).distinct()
        sets = written(_sets(rows, prints.join(asked, "print").select("print", "at")).unionByName(known.select("print", "shingles")).dropDuplicates(["print"]))
        a, b = sets, sets.select(F.col("print").alias("known"), F.col("shingles").alias("theirs"))
        shared = F.size(F.array_intersect("shingles", "theirs"))
        alike = shared >= F.lit(similarity) * (F.size("shingles") + F.size("theirs") - shared)
        fresh = written(near.join(a, "print").join(b, "known").where(alike).select("print").distinct())
        dropped(near, sets)
        if fresh.isEmpty():
            break
        step += 1
        front = scanned.join(fresh, "print", "left_semi").select("print", "m", "least")
        labelled = written(labelled.unionByName(fresh.select("print", F.lit(step).alias("step"))))
    return scanned.join(labelled, "print").groupBy(F.col("__id").alias(doc_id)).agg(F.count(F.lit(1)).alias("n_units"), F.min("step").alias("step"))
