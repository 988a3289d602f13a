"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its
occurrence number. A sketch takes the few labelled shingles that come first in
a random order and puts them back in text order, so texts agree in it when they
share shingles in the same order, as small edits leave them. Texts that agree
in a sketch are candidates; they are linked if an alignment within a band of
their shingle sequences matches four fifths of both together or more.

Equal texts are one node from the start. Within a bucket, nodes are compared
with one leader, the one that is in most buckets, which settles groups of copies
with as many comparisons as members. Where a bucket then still holds several
classes, the nodes outside its largest class meet all of the bucket that are in
other classes, a thousand or so of them at a time: a node's sketches and shingles
reach each such group once, candidates are told by their sketches there, and a
node that a link has brought into a class is compared with no more of it. So of
the texts that agree in a sketch all are in one class or have been compared,
without a row for each pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airrline.llm.common import as_bytes, bit_filter, map_arrow, may_hold, sliced, store
from airrline.llm.graph import components

SHINGLE = 5
SIMILAR = 0.8
SKETCHES, ELEMENTS = 64, 8  # agree with odds of 0.8 ** 8 each at the threshold: all 64 miss once in 100,000
SHORT, SHORT_SKETCHES, SHORT_ELEMENTS = 40, 24, 2  # shingles up to which a text has these sketches as well
LEADS = 300_000  # shingles of the nodes that lead one group, about
MEMBERS = 800  # nodes that meet a group's leads in one place, about
_BATCH = 1 << 20
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20)
_ORDERS = _rng.integers(0, 1 << 63, SKETCHES + SHORT_SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, SKETCHES + SHORT_SKETCHES, dtype=np.uint64)
_PLACES = _rng.integers(0, 1 << 63, max(ELEMENTS, SHINGLE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of texts, and where each text's words begin (with the end as last)."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    inner = at[1:-1][at[1:-1] < raw.size]
    first[inner] = word[inner]  # a text's first byte follows nothing
    start = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= first[1:] | space[1:]
    end = np.flatnonzero(last) + 1
    power = np.full(raw.size + 1, np.uint64(_R))
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    back = np.full(raw.size + 1, np.uint64(pow(_R, -1, 1 << 64)))
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    hashes = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, at)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's shingles with their occurrence numbers; a text of fewer words is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        s += words[k : k + n] * _PLACES[k]
    s = _mix(s + np.uint64(min(SHINGLE, len(words))))
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        number = np.empty(n, np.uint64)
        number[order] = run.astype(np.uint64)
        s = _mix(s + number * np.uint64(_R))
    return s


def _keys(s: np.ndarray, which: slice, elements: int) -> np.ndarray:
    out = []
    step = max(1, (1 << 20) // len(s))  # sketches at once, so a long text stays small in memory
    orders, salts = _ORDERS[which], _SALTS[which]
    for i in range(0, len(orders), step):
        ranks = s[None, :] * orders[i : i + step, None]
        take = min(elements, len(s))
        chosen = np.argpartition(ranks, take - 1, axis=1)[:, :take] if take < len(s) else np.broadcast_to(np.arange(len(s)), (len(ranks), len(s))).copy()
        chosen.sort(axis=1)  # back into text order
        out.append(_mix((s[chosen] * _PLACES[:take]).sum(axis=1, dtype=np.uint64) ^ salts[i : i + step]))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Keys of a text's sketches; texts that share one are candidates. None for a text without words."""
    keys = []
    if len(s) >= ELEMENTS:
        keys.append(_keys(s, slice(0, SKETCHES), ELEMENTS))
    if 0 < len(s) <= SHORT:
        keys.append(_keys(s, slice(SKETCHES, None), SHORT_ELEMENTS))
    return np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)


def digest_of(text_col: str) -> Column:
    """128 bits of a text's SHA-256; NULL counts as empty."""
    return F.substring(F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)), 1, 16)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, n, keys`` for every document: text digest (128 bits), number of shingles, sketch keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, _BATCH):
            hashes, begin = word_hashes(*as_bytes(batch.column(2)))
            parts = [labelled_shingles(hashes[a:b]) for a, b in pairwise(begin)]
            keys = [sketch(s) for s in parts]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in parts], pa.int64()), lists], names=["id", "digest", "n", "keys"])

    rows = docs.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.transform(map_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, n long, keys array<long>")


def shapes(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, shingles`` of the nodes in ``wanted`` (``node, digest, id``): hashes of labelled shingles in text order, eight bytes each.

    Documents are told by digest and smallest id, so of a text's copies one is
    read. Those that a broadcast set of bits rules out never leave their task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("digest", "id").alias("hash")), "hash"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            some = np.flatnonzero(may_hold(shared.value, batch.column(0).to_numpy()))
            if len(some):
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(some)) for i in (1, 2, 3)], names=["id", "digest", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, _BATCH):
            hashes, begin = word_hashes(*as_bytes(batch.column(1)))
            parts = [labelled_shingles(hashes[a:b]).tobytes() for a, b in pairwise(begin)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest"), F.col(text_col).alias("text"))
    rows = rows.select(F.xxhash64("digest", "id").alias("hash"), "id", "digest", "text")
    found = rows.transform(map_arrow, pick, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, text string")
    right = wanted.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "node")
    found = found.join(right, (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__id")))
    return found.select("node", "text").dropDuplicates(["node"]).transform(map_arrow, run, "node long, shingles binary")


def _places(keys: np.ndarray, n: int, missing: int) -> np.ndarray:
    """A text's sketch keys at one place for each sketch, ``missing`` where it has none."""
    out = np.full(SKETCHES + SHORT_SKETCHES, missing, np.int64)
    many = SKETCHES if n >= ELEMENTS else 0
    out[:many] = keys[:many]
    out[SKETCHES : SKETCHES + len(keys) - many] = keys[many:]
    return out


class _Leads:
    """The nodes that lead a group: sketches, shingles and classes, and what has been found to be one class."""

    def __init__(self, rows: list[tuple]):
        self.nodes = [r[0] for r in rows]
        self.own = np.array([r[1] for r in rows], np.int64)
        self.shingles = [np.frombuffer(r[2], np.uint64) for r in rows]
        self.n = np.array([len(x) for x in self.shingles])
        self.sketches = None if rows[0][3] is None else np.stack([_places(np.array(r[3]), n, 0) for r, n in zip(rows, self.n, strict=True)])
        self.parent: dict[int, int] = {}

    def _find(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            c = up
        return c

    def links(self, node: int, own: int, shingles: bytes, keys) -> Iterator[int]:
        """Leads that ``node`` is linked with, one for each class that this brings together."""
        s = np.frombuffer(shingles, np.uint64)
        n, mine = len(s), self._find(own)
        maybe = (self.own != mine) & (np.minimum(self.n, n) >= SIMILAR * np.maximum(self.n, n) - 1e-9)
        if self.sketches is not None and maybe.any():
            at = np.flatnonzero(maybe)
            maybe[at] = (self.sketches[at] == _places(np.array(keys), n, 1)).any(axis=1)
        at = np.flatnonzero(maybe)
        if not len(at):
            return
        order = np.argsort(s)
        ranked = s[order]
        for k in range(0, len(at), 256):
            some = at[k : k + 256]
            every = np.concatenate([self.shingles[i] for i in some])
            place = np.minimum(np.searchsorted(ranked, every), n - 1)
            hit = ranked[place] == every
            ends = np.cumsum(self.n[some])
            shared = np.add.reduceat(hit, ends - self.n[some], dtype=np.int64)
            enough = shared >= SIMILAR * (n + self.n[some] - shared) - 1e-9
            for j in np.flatnonzero(enough):
                i, begin = some[j], ends[j] - self.n[some[j]]
                if self.own[i] == mine:
                    continue
                found = hit[begin : ends[j]]
                if similar(np.flatnonzero(found), order[place[begin : ends[j]][found]], int(self.n[i]), n):
                    yield self.nodes[i]
                    self.parent[mine] = int(self.own[i])
                    self.own[self.own == mine] = self.own[i]
                    mine = int(self.own[i])


def similar(i: np.ndarray, j: np.ndarray, n: int, m: int) -> bool:
    """Whether two texts of ``n`` and ``m`` shingles align, given the places ``i`` (rising) and ``j`` of those that both have."""
    near = np.abs(i - j) <= (n + m) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-9
    j = j[near]
    matched = len(j)
    if matched and (j[1:] <= j[:-1]).any():  # longest rising run of places
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    return matched >= SIMILAR * (n + m - matched) - 1e-9


def _meet(leads: DataFrame, members: DataFrame, shaped: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Links (a, b) between leads and members of a group, enough to bring together all classes that links bring together.

    Both have ``group, node, class``. Members of one group are dealt to as many
    places as they need, and its leads go to each. With ``keys`` (``node,
    keys``), only nodes that agree in a sketch are compared.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("places"))
    members = members.join(sizes, "group").select("group", F.pmod(F.xxhash64("node"), "places").cast("int").alias("place"), F.lit(1).alias("side"), "node", "class")
    leads = leads.join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("side"), "node", "class")
    rows = members.unionByName(leads).join(shaped, "node")
    rows = rows.withColumn("keys", F.lit(None).cast("array<long>")) if keys is None else rows.join(keys, "node")
    rows = rows.select("group", "place", "side", "node", "class", "shingles", "keys").repartition("group", "place").sortWithinPartitions("group", "place", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, leads = None, [], None
        for batch in sliced(batches, 5):
            a, b = [], []
            plain = [batch.column(i).to_pylist() for i in range(5)]
            for i, (group, place, side, node, own) in enumerate(zip(*plain, strict=True)):
                if (group, place) != at:
                    at, waiting, leads = (group, place), [], None
                drawn = batch.column(6)[i]
                row = node, own, batch.column(5)[i].as_py(), drawn.values.to_numpy() if drawn.is_valid else None
                if side == 0:
                    waiting.append(row)
                    continue
                if leads is None:
                    leads = _Leads(waiting)
                for lead in leads.links(*row):
                    a.append(lead)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.transform(map_arrow, run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``id_col, class_id, n_verified, digest``.

    ``class_id`` is the smallest id among the documents linked with it, directly
    or through others (itself if none); ``n_verified`` counts the comparisons with
    other texts that found a link; texts already in one class are not compared.
    Shingles are compared by 64-bit hashes. A very long text takes eight bytes of
    memory a word where it is compared; it is never cut. NULL texts are empty; equal texts, empty ones
    too, are one class; texts without words link to no other text; texts of one
    to four words have one shingle and link to those of the same words. Rows
    with a repeated id each come back; NULL ids form no class of their own but
    share their text's, whose id is NULL only if all its ids are. ``digest`` and
    ``class`` tell texts and classes apart where ids repeat.
    """
    drawn = store(sketches(docs, id_col, text_col))
    nodes = drawn.groupBy("digest").agg(F.min("id").alias("id"), F.min(F.struct("n", "keys")).alias("s"))
    nodes = store(nodes.select("digest", "id", F.col("s.n").alias("n"), F.col("s.keys").alias("keys"), F.monotonically_increasing_id().alias("node")))

    # buckets with more than one text; a node's rank is the number of its buckets
    every = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    rows = every.join(shared, "key", "left_semi")
    rank = rows.groupBy("node").agg(F.count("*").alias("rank"))
    wanted = store(rank.join(nodes.select("node", "digest", "id"), "node"))
    rows = store(rows.join(wanted.select("node", "rank"), "node").select("key", "node", "n", "rank"))
    shaped = store(shapes(docs, wanted, id_col, text_col))

    lead = rows.groupBy("key").agg(F.max(F.struct("rank", -F.col("node"), "n")).alias("s")).select("key", (-F.col("s.col2")).alias("a"), F.col("s.n").alias("n_a"))
    met = rows.join(lead, "key").filter((F.col("node") != F.col("a")) & _lengths_allow("n", "n_a"))
    met = store(met.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("agree")))
    # the leader a text meets most settles nearly all; then its other leaders, where still apart
    best = met.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("s")).select(F.col("s.a").alias("a"), "b")
    edges = store(_meet_leaders(best, shaped))
    classes = components(edges)
    others = _apart(met.select("a", "b").join(best, ["a", "b"], "left_anti"), classes)
    edges = store(edges.unionByName(_meet_leaders(others, shaped)))
    classes = components(edges)

    # in buckets that still hold several classes, the nodes outside the largest meet all others
    placed = store(_unsettled(rows.select("key", "node", "n"), classes))
    outside = placed.filter("outside")
    if not outside.isEmpty():
        near = outside.groupBy("node", "n", "class", "largest").agg(F.count("*").alias("m")).groupBy("node", "n", "class").agg(F.max(F.struct("m", "largest")).alias("s"))
        near = near.select("node", "n", "class", F.col("s.largest").alias("hub"))
        split = near.groupBy("hub").agg(F.ceil(F.sum("n") / LEADS).cast("int").alias("parts"))
        near = near.join(split, "hub").select("node", "class", F.xxhash64("hub", F.pmod(F.xxhash64("node"), "parts")).alias("group"))
        near = store(near)
        of_key = outside.select("key", "node").join(near.select("node", "group"), "node").select("key", "group").distinct()
        members = placed.select("key", "node", "class").join(of_key, "key").select("group", "node", "class").distinct()
        edges = store(edges.unionByName(_meet(near.select("group", "node", "class"), members, shaped, nodes.select("node", "keys"))))
        classes = components(edges)

    links = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("a").agg(F.count("*").alias("n_verified"))
    told = _with_class(nodes.select("node", "digest", "id"), classes, "node", "class").join(links.withColumnRenamed("a", "node"), "node", "left")
    smallest = told.groupBy("class").agg(F.min("id").alias("class_id"))
    told = told.join(smallest, "class").select("digest", "class", "class_id", F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    return drawn.select("id", "digest").join(told, "digest").select(F.col("id").alias(id_col), "class_id", "n_verified", "digest", "class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class: that with the smallest id (NULL ids last), once if its row repeats. All columns stay."""
    found = near_duplicates(docs, id_col, text_col)
    best = found.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull().alias("odd"), F.col(id_col).alias("id"), "digest")).alias("s"))
    best = best.select(F.col("s.id").alias("__id"), F.col("s.digest").alias("__best"))
    keyed = docs.withColumn("__digest", digest_of(text_col))
    kept = keyed.join(best, (F.col("__digest") == F.col("__best")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates([id_col, "__digest"]).drop("__digest")


def _meet_leaders(pairs: DataFrame, shaped: DataFrame) -> DataFrame:
    """Of pairs of a leader and a node (a, b), those that are linked; each is a group with one lead."""
    members = pairs.select(F.col("a").alias("group"), F.col("b").alias("node"), F.col("b").alias("class"))
    leads = pairs.select(F.col("a").alias("group")).distinct().select("group", F.col("group").alias("node"), F.col("group").alias("class"))
    return _meet(leads, members, shaped, None)


def _with_class(df: DataFrame, classes: DataFrame, node: str, name: str) -> DataFrame:
    """Add a node's class; a node without links is its own."""
    known = classes.select(F.col("node").alias("__n"), F.col("class").alias("__c"))
    joined = df.join(known, F.col(node) == F.col("__n"), "left")
    return joined.withColumn(name, F.coalesce("__c", F.col(node))).drop("__n", "__c")


def _lengths_allow(n: str, m: str) -> Column:
    """Texts whose numbers of shingles differ more cannot be similar."""
    return F.least(n, m) >= SIMILAR * F.greatest(n, m)


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes."""
    both = _with_class(_with_class(pairs, classes, "a", "__ca"), classes, "b", "__cb")
    return both.filter(F.col("__ca") != F.col("__cb")).drop("__ca", "__cb")


def _unsettled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, node, n) of buckets with several classes: ``class``, the bucket's ``largest`` class, and whether the node is ``outside`` that."""
    placed = _with_class(rows, classes, "node", "class")
    sizes = placed.groupBy("key", "class").agg(F.count("*").alias("m"))
    most = sizes.groupBy("key").agg(F.max(F.struct("m", "class")).alias("s"), F.count("*").alias("n_classes"))
    most = most.filter("n_classes > 1").select("key", F.col("s.class").alias("largest"))
    return placed.join(most, "key").select("key", "node", "n", "class", "largest", (F.col("class") != F.col("largest")).alias("outside"))
