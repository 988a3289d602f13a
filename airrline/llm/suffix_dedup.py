"""Removal of byte strings that repeat across documents, by suffix intervals.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller id. Strings are told apart exactly; two steps bring
those that can be equal together.

Anchors: a string's anchor is the smallest hash of the short grams in it, so
equal strings have equal anchors, and neighbouring strings mostly share one.
Anchors found in one text only are done with. For the others, the stretch of
text whose strings have the anchor is cut out, equal stretches are merged, and
stretches of one anchor meet in one block. Where those are more than a block may
hold, they are cut again, by anchors of longer grams, at last of whole strings.

Blocks: the Burrows-Wheeler transform of a block's stretches is expanded breadth
first, from the interval of all suffixes, by one byte in front at a time. An
interval that ends where no boundary is known yet sets one: suffixes on its two
sides share less than the current length. Common prefix lengths so come out by
increasing value, and at LENGTH expansion stops: suffixes with no boundary
between them start with the same string.

Anchors, texts and stretches are named by 64-bit hashes; two texts of one name
are told apart by their ids, two stretches of one name only meet within an anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airrline.llm.common import as_bytes, bit_filter, map_arrow, may_hold, sliced, store

LENGTH = 50
GRAM = 20  # bytes hashed for an anchor
LONGER = 35  # bytes hashed for the anchors of stretches that are too many for one block
_BATCH = 512 << 10  # small, so a batch's arrays stay in the processor's cache
_BLOCK = 256 << 10  # bytes of stretches in a block; one anchor's stay together
_CROWD = 2 << 20  # bytes of an anchor's different stretches, beyond which they are cut again
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0xBF58476D1CE4E5B9], np.uint64)


def stretches(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of consecutive strings with one anchor: text, anchor, first string's place, number of strings."""
    none = np.zeros(0, np.int64)
    if raw.size < length:
        return none, none, none, none
    gram = min(gram, length)
    n = raw.size - gram + 1
    # grams are hashed eight bytes at a time, from words that begin at every byte
    words = np.ndarray((raw.size + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    offsets = [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 and gram > 8 else [])]
    least = np.zeros(n, np.uint64)
    for k, factor in zip(offsets or [0], _FACTORS, strict=False):
        piece = words[k : k + n] if gram >= 8 else words[:n] << np.uint64(64 - 8 * gram)
        least += (piece ^ (piece >> np.uint64(31))) * factor
    least ^= least >> np.uint64(29)
    least *= _FACTORS[-1]
    want, have = length - gram + 1, 1
    while have * 2 <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < want:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    new = np.empty(len(least) + length, bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1 : len(least)])
    new[len(least) :] = False
    new[at[:-1]] = True
    new[np.maximum(at[1:] - length + 1, at[:-1])] = True  # where strings would run past their text
    start = np.flatnonzero(new)
    text = np.searchsorted(at, start, "right") - 1
    sizes = np.diff(np.append(start, len(new)))
    fits = (text < len(at) - 1) & (start + length <= at[np.minimum(text + 1, len(at) - 1)])
    start, text, sizes = start[fits], text[fits], sizes[fits]
    return text, least[start].astype(np.int64), start - at[text], sizes


def _digest(data) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "big", signed=True)


def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or more, by doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | padded[k : k + n]
    have = 8
    while True:
        values, rank = np.unique(rank, return_inverse=True)
        if have >= depth or len(values) == n:
            return np.argsort(rank, kind="stable")
        ahead = np.concatenate([rank[have:] + 1, np.zeros(min(have, n), rank.dtype)])[:n]
        rank = (rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        have *= 2


def equal_prefixes(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it whether a group of suffixes with the same first ``length`` bytes begins there.

    ``text`` holds bytes as 1 to 256 and 0 between stretches. Breadth-first
    backward extension on the transform, vectorised over the intervals of one
    length.
    """
    n = len(text)
    order = _suffixes(text, length)
    before = text[order - 1]  # the transform; the text begins with 0, so its cyclic first is a separator
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where a suffix goes when its preceding byte is put in front
    step[by_symbol] = np.arange(n)
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = hi - lo
        inside = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        parent = np.repeat(np.arange(len(lo)), sizes)
        ranked = np.argsort(before[inside], kind="stable")  # the order of their new places
        inside, parent = inside[ranked], parent[ranked]
        to, symbol = step[inside], before[inside]
        starts = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (parent[1:] != parent[:-1])]))
        ends = np.concatenate([starts[1:], [len(to)]])
        lo, hi = to[starts], to[ends - 1] + 1
        fresh = ~bound[hi] | (hi == n)
        lo, hi = lo[fresh], hi[fresh]
        bound[hi] = True
        if not len(lo):
            break
    return order, bound[:n]


def first_owners(parts: list[bytes], owners: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each part and each string of ``length`` bytes in it: the smallest owner of a part that holds it."""
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"\0" + b"\0".join(parts) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes
    text = raw.astype(np.uint16) + 1
    text[np.concatenate([[0], starts + sizes])] = 0
    order, begins = equal_prefixes(text, length)
    count = sizes - length + 1
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    owner = np.full(len(text), np.iinfo(np.int64).max)
    owner[place] = np.repeat(np.array(owners, np.int64), count)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(begins))
    out = np.empty(len(text), np.int64)
    out[order] = least[np.cumsum(begins) - 1]
    return [out[s : s + c] for s, c in zip(starts, count, strict=True)]


def _may_share(parts: list[bytes], length: int) -> np.ndarray:
    """Which parts have a string whose hash another place has too; the others need no sorting."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    power = np.full(raw.size + 1, _FACTORS[0])
    power[0] = 1
    back = np.full(raw.size + 1, np.uint64(pow(int(_FACTORS[0]), -1, 1 << 64)))
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(power, dtype=np.uint64)[:-1], dtype=np.uint64)])
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(parts)), count)
    place = np.repeat(ends - sizes - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    hashes = (sums[place + length] - sums[place]) * np.cumprod(back, dtype=np.uint64)[place]
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(parts), bool)
    out[owner[order[1:][same]]] = True
    out[owner[order[:-1][same]]] = True
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _anchors(docs: DataFrame, length: int, wanted=None) -> DataFrame:
    """``anchor, digest`` of every stretch; with ``wanted``, a broadcast set of bits, only those that may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, _BATCH):
            raw, at = as_bytes(batch.column(0))
            text, anchor, _, _ = stretches(raw, at, length)
            if wanted is not None:
                some = may_hold(wanted.value, anchor)
                text, anchor = text[some], anchor[some]
            whole = memoryview(np.ascontiguousarray(raw))
            digests = np.array([_digest(whole[a:b]) if b - a >= length else 0 for a, b in pairwise(at)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digests[text] if len(text) else text)], names=["anchor", "digest"])

    return docs.select("text").transform(map_arrow, run, "anchor long, digest long")


def _candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the first documents that have shared anchors, with those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, _BATCH):
            raw, at = as_bytes(batch.column(1))
            whole = memoryview(np.ascontiguousarray(raw))
            digests = [_digest(whole[a:b]) for a, b in pairwise(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), batch.column(1)], names=["id", "digest", "text"])

    keyed = docs.transform(map_arrow, run, "id long, digest long, text string")
    return keyed.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"])


def _cut_out(candidates: DataFrame, length: int) -> DataFrame:
    """Stretches of shared anchors: ``anchor, part, id, digest, start, strings``."""
    kinds = [("anchor", pa.int64()), ("part", pa.binary()), ("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("strings", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, _BATCH):
            raw, at = as_bytes(batch.column(2))
            text, anchor, start, strings = stretches(raw, at, length)
            shared = batch.column(3)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            keep = np.concatenate([np.isin(anchor[a:b], shared[i].values.to_numpy(zero_copy_only=False)) for i, (a, b) in enumerate(pairwise(cut))]) if batch.num_rows else np.zeros(0, bool)
            text, anchor, start, strings = text[keep], anchor[keep], start[keep], strings[keep]
            whole = raw.tobytes()
            a = at[text] + start
            parts = [whole[x:y] for x, y in zip(a.tolist(), (a + strings + length - 1).tolist(), strict=True)]
            ids, digests = batch.column(0).to_numpy(zero_copy_only=False)[text], batch.column(1).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((anchor, parts, ids, digests, start, strings), kinds, strict=True)], names=[n for n, _ in kinds])

    return candidates.select("id", "digest", "text", "anchors").transform(map_arrow, run, "anchor long, part binary, id long, digest long, start long, strings long")


def _cut_again(cut: DataFrame, length: int, gram: int) -> DataFrame:
    """The strings of stretches as stretches of anchors of longer grams. Those of whole strings repeat one, which is kept once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, _BATCH):
            raw, at = as_bytes(batch.column(0))
            of, anchor, first, strings = stretches(raw, at, length, gram)
            whole, a = raw.tobytes(), at[of] + first
            ends = a + length - 1 + (strings if gram < length else 1)
            parts = [whole[x:y] for x, y in zip(a.tolist(), ends.tolist(), strict=True)]
            ids, digests, start = (batch.column(i).to_numpy(zero_copy_only=False)[of] for i in (1, 2, 3))
            columns = [pa.array(anchor, pa.int64()), pa.array(parts, pa.binary()), *(pa.array(x, pa.int64()) for x in (ids, digests, start + first, strings))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "part", "id", "digest", "start", "strings"])

    return cut.select("part", "id", "digest", "start").transform(map_arrow, run, "anchor long, part binary, id long, digest long, start long, strings long")


def _covered(parts: DataFrame, length: int) -> DataFrame:
    """``anchor, hash, owner, runs``: for each different stretch, its first owner and the strings that an earlier one has.

    ``parts`` holds ``anchor, part, owner``, sorted by anchor within partitions that keep an anchor whole.
    """
    runs_kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[int], list[int], list[bytes], list[int]] = ([], [], [], [])

        def flush(upto: int) -> pa.RecordBatch:
            anchor, hashes, part, owner = (x[:upto] for x in held)
            for x in held:
                del x[:upto]
            alone = np.ones(upto, bool)
            same = np.array(anchor)[1:] == np.array(anchor)[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            found: list[list[dict]] = [[] for _ in anchor]
            several = np.flatnonzero(~alone)
            several = several[_may_share([part[i] for i in several], length)].tolist() if len(several) else []
            if several:
                first = first_owners([part[i] for i in several], [owner[i] for i in several], length)
                for i, least in zip(several, first, strict=True):
                    found[i] = [{"first": a, "end": b} for a, b in _runs(least < owner[i])]
            return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(hashes, pa.int64()), pa.array(owner, pa.int64()), pa.array(found, runs_kind)], names=["anchor", "hash", "owner", "runs"])

        size = 0
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in range(4)]
            for row in zip(*rows, strict=True):
                if size >= _BLOCK and row[0] != held[0][-1]:
                    yield flush(len(held[0]))
                    size = 0
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                size += len(row[2])
        if held[0]:
            yield flush(len(held[0]))

    return parts.select("anchor", "hash", "part", "owner").transform(map_arrow, run, "anchor long, hash long, owner long, runs array<struct<first: long, end: long>>")


def _crowded(cut: DataFrame, most: int, length: int, shared: DataFrame | None) -> DataFrame | None:
    """Anchors whose different stretches have more than ``most`` bytes; None if there are none.

    ``shared`` has the ``places`` of each anchor, if known: few places of short
    stretches are no crowd, which saves adding up all.
    """
    size = F.sum(F.octet_length("part").cast("long")).alias("size")
    if shared is None:
        many = cut.groupBy("anchor").agg(size).filter(F.col("size") > most).select("anchor")
    else:
        many = shared.filter(F.col("places") * 2 * length > most).select("anchor").union(cut.filter(F.col("strings") > length).select("anchor")).distinct()
    many = store(many)
    if many.isEmpty():
        return None
    different = cut.join(many, "anchor", "left_semi").select("anchor", "part").distinct()
    crowded = store(different.groupBy("anchor").agg(size).filter(F.col("size") > most).select("anchor"))
    return None if crowded.isEmpty() else crowded


def _met(cut: DataFrame, length: int, whole_strings: bool = False) -> DataFrame:
    """``id, digest, start, run``: runs of strings, from ``start`` on, that an earlier document has."""
    named = F.xxhash64("part").alias("hash")  # of a stretch, among those of its anchor
    parts = cut.groupBy("anchor", "part").agg(F.min("id").alias("owner"))
    if whole_strings:  # a stretch is one string, so its first owner is all there is to know
        covered = parts.select("anchor", named, "owner", F.array().cast("array<struct<first: bigint, end: bigint>>").alias("runs"))
    else:
        covered = _covered(parts.repartition("anchor").sortWithinPartitions("anchor").select("anchor", named, "part", "owner"), length)
    met = cut.select("anchor", named, "id", "digest", "start", "strings").join(store(covered), ["anchor", "hash"])
    every = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("strings").alias("end")))
    return met.select("id", "digest", "start", F.explode(F.when(F.col("id") > F.col("owner"), every).otherwise(F.col("runs"))).alias("run"))


def _kept(candidates: DataFrame, removed: DataFrame, length: int) -> DataFrame:
    """``id, digest, n_removed, n_spans, kept`` of documents that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            texts, spans = batch.column(2), batch.column(3)
            n_removed, n_spans, kept = [], [], []
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode("utf-8", "replace")
                edge = np.zeros(len(data) + 1, np.int32)
                pairs = spans[i].values
                np.add.at(edge, pairs.field(0).to_numpy(), 1)
                np.add.at(edge, pairs.field(1).to_numpy(), -1)
                gone = np.cumsum(edge)[:-1] > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(len(_runs(gone)))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", "digest", "n_removed", "n_spans", "kept"])

    spans = removed.groupBy("id", "digest").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    both = candidates.join(spans, ["id", "digest"]).select("id", "digest", "text", "spans")
    return both.transform(map_arrow, run, "id long, digest long, n_removed long, n_spans long, kept binary")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = _CROWD) -> DataFrame:
    """One row for each document: ``id_col, n_bytes, n_removed, n_spans, kept, kept_sha256``.

    Texts are UTF-8 bytes, NULL is empty. Strings are judged on the input, so
    overlapping ones all count; a string that repeats within a document, or in
    documents of the same id only, stays. ``kept`` holds the bytes that remain,
    or NULL where that is the whole text; ``n_spans`` counts maximal removed
    runs. Ids are integers; a NULL id is larger than all others. Repeated rows
    come back each. Texts shorter than ``length`` lose nothing.

    Copies of a text that an earlier document has whole are settled by digest.
    Only texts with shared anchors are shuffled. ``crowd`` is how many bytes of
    different stretches of one anchor may meet in one place.
    """
    last = F.lit((1 << 63) - 1)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = source.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    firsts = store(rows.groupBy("sha").agg(F.min("id").alias("first")))  # stored, so a join with it can split a text with many copies

    shared = _anchors(source, length).groupBy("anchor").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("places"))
    shared = store(shared.filter("lo < hi").select("anchor", "places"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(shared, "anchor"))
    of_text = _anchors(source, length, bits).join(shared, "anchor", "left_semi").groupBy("digest").agg(F.collect_set("anchor").alias("anchors"))
    of_first = firsts.select(F.col("first").alias("id"), F.conv(F.substring("sha", 1, 16), 16, -10).cast("long").alias("digest"))
    wanted = store(of_text.join(of_first, "digest"))
    candidates = store(_candidates(source, wanted))

    cut, met, known = store(_cut_out(candidates, length)), None, shared
    for gram in (max(LONGER, GRAM + 1), length):
        crowded, known = _crowded(cut, crowd, length, known), None
        mine = _met(cut if crowded is None else cut.join(crowded, "anchor", "left_anti"), length)
        met = mine if met is None else met.unionByName(mine)
        if crowded is None:
            break
        cut = store(_cut_again(cut.join(crowded, "anchor", "left_semi"), length, min(gram, length)))
    else:
        met = met.unionByName(_met(cut, length, whole_strings=True))
    removed = store(met.select("id", "digest", (F.col("start") + F.col("run.first")).alias("from"), (F.col("start") + F.col("run.end") + (length - 1)).alias("to")))
    lost = _kept(candidates, removed, length).withColumnsRenamed({"id": "__id", "digest": "__digest"})

    told = rows.join(firsts, "sha").withColumn("digest", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long"))
    told = told.join(lost, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= length)
    own = F.col("id") == F.col("first")
    empty = F.lit(b"")
    return told.select(
        F.when(F.col("id") < last, F.col("id")).alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(own, F.coalesce("n_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, empty).when(own, F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(empty, 256)).when(own & F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
