"""Language-model scoring by prediction by partial matching over bytes.

The trie of byte contexts up to ``ORDER`` is held as stored tables of grams with
counts, one for each depth. A symbol is predicted from the longest context seen;
where it was not seen there, the model escapes to the next shorter one (method
C: a context's escape weighs as much as it has distinct symbols) and leaves out
the symbols that the longer context already ruled out. Below the empty context,
all bytes not yet ruled out are equal.

Two ways to use it: pretrained on a corpus, whose counts are gathered over all
its documents, or adaptive, learning within each document from nothing.
Texts are padded with bytes that UTF-8 never uses: 0xFE before, 0xFF as end.

No node is left out, whatever the corpus. A document's score is a sum over its
grams (a symbol and the ORDER bytes before it). Those that make up a share of
COMMON_GRAMS of the corpus or more, at most 1 / COMMON_GRAMS of them, are looked
up in a broadcast table of their log probabilities; all others are counted
within the document, walk down the trie once for each different gram by joins on
their contexts, and come back to their documents by a join on the gram.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airrline.llm.common import as_bytes, map_arrow, sliced, store

ORDER = 5
COMMON_GRAMS = 1e-7  # of the corpus's bytes, that a common gram makes up; bounds the broadcast to 12 bytes times its inverse
COMMON = 1e-6  # of the corpus's words, that a common word makes up
WORD_BYTES = 64  # of a word that can count as common; with COMMON, this bounds the broadcast
_PAD, _END = 0xFE, 0xFF
_FEW_CONTEXTS = 2  # bytes of a context up to which a table has at most 65,536 contexts
_BATCH = 1 << 20
_HOLD = 1_500_000  # distinct grams held in a task before counts are handed on


def _symbols(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of text: the gram of ``order`` bytes before it and itself; and where texts begin."""
    raw, at = as_bytes(column)
    sizes = np.diff(at)
    n = len(sizes)
    b = np.full(raw.size + n * (order + 1), _PAD, np.uint64)
    b[np.arange(raw.size) + np.repeat(np.arange(n) * (order + 1) + order, sizes)] = raw
    b[np.cumsum(sizes + order + 1) - 1] = _END
    grams = np.zeros(max(0, b.size - order), np.uint64)
    for k in range(order + 1):
        grams = (grams << np.uint64(8)) | b[k : k + grams.size]
    return grams[b[order:] != _PAD], np.concatenate([[0], np.cumsum(sizes + 1)])


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts of all symbols with the ``order`` bytes before them, over all documents: ``gram, n``. One text column is read."""

    def add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = map(np.concatenate, zip(*held, strict=True))
        codes, inverse = np.unique(codes, return_inverse=True)
        return codes, np.bincount(inverse, counts, len(codes)).astype(np.int64)

    def told(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in sliced(batches, 0, _BATCH):
            held.append(np.unique(_symbols(batch.column(0), order)[0], return_counts=True))
            if len(held) > 8:
                held = [add(held)]
                if len(held[0][0]) > _HOLD:
                    yield told(*held.pop())
        if held:
            yield told(*add(held))

    return texts.transform(map_arrow, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class _Lookup:
    """Index of codes in a sorted table, -1 if absent: a hash table, and a search for the few that collide."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(4, (4 * len(codes)).bit_length())
        self.at = np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(codes)
        self.at[slot] = np.arange(len(codes))
        lost = np.flatnonzero(self.at[slot] != np.arange(len(codes)))
        self.lost, self.lost_at = codes[lost], lost.astype(np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        found = self.at[self._slot(codes)]
        found[self.codes[found] != codes] = -1
        if len(self.lost):
            miss = np.flatnonzero(found < 0)
            i = np.minimum(np.searchsorted(self.lost, codes[miss]), len(self.lost) - 1)
            found[miss] = np.where(self.lost[i] == codes[miss], self.lost_at[i], -1)
        return found


@dataclass
class Trie:
    """A pretrained trie: for each context length, a table of ``gram, n``; and the number of symbols learned."""

    order: int
    levels: list[DataFrame]
    total: int

    def _contexts(self, k: int) -> DataFrame:
        """``context, total, distinct`` of contexts of ``k`` bytes."""
        return self.levels[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").cast("double").alias("distinct"))

    def common(self, share: float = COMMON_GRAMS) -> tuple[np.ndarray, np.ndarray]:
        """Grams of full length that make up ``share`` of the corpus, at most 1 / share, and their log10 probabilities."""
        kept = self.levels[self.order].filter(F.col("n") >= max(1, math.ceil(share * self.total))).withColumn("context", F.shiftright("gram", 8))
        told = kept.join(self._contexts(self.order), "context").select("gram", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("p"))
        got = told.orderBy("gram").toArrow()
        return got["gram"].to_numpy().astype(np.uint64), got["p"].to_numpy()

    def log10(self, grams: DataFrame) -> DataFrame:
        """``gram, p`` for different grams of full length: log10 probability of the last byte after the ones before it.

        At each context length, grams meet their count and their context's sums;
        those not seen pay for the escape and go on with what their context rules
        out. Tables of contexts of up to two bytes are broadcast, other joins are
        shuffled, on keys of which none is common among different grams of the
        same length.
        """
        zero = F.lit(0.0)
        left = grams.select("gram", zero.alias("p"), zero.alias("ruled_n"), zero.alias("ruled_d"))
        done = []
        for k in range(self.order, -1, -1):
            small = F.broadcast if k <= _FEW_CONTEXTS else lambda df: df
            mask = F.lit((1 << 8 * (k + 1)) - 1)
            own = left.withColumn("code", F.col("gram").bitwiseAND(mask)).withColumn("context", F.shiftright("code", 8))
            own = own.join(small(self._contexts(k)), "context", "left")
            seen = self.levels[k].select(F.col("gram").alias("code"), "n")
            own = own.join(F.broadcast(seen) if k < _FEW_CONTEXTS else seen, "code", "left")
            escape = F.col("distinct") - F.col("ruled_d")
            whole = F.col("total") - F.col("ruled_n") + escape
            pay = F.when(F.col("n").isNotNull(), F.log10(F.col("n") / whole)).when(whole > 0, F.log10(escape / whole)).otherwise(0.0)
            own = store(own.select("gram", "context", (F.col("p") + pay).alias("p"), "ruled_n", "ruled_d", "distinct", F.col("n").isNotNull().alias("hit")))
            done.append(own.filter("hit").select("gram", "p"))
            left = own.filter("NOT hit")
            if left.isEmpty():
                break
            if k:  # what the context rules out, as the next shorter one counts it
                needed = left.filter("distinct IS NOT NULL").select("context").distinct()
                children = self.levels[k].withColumn("context", F.shiftright("gram", 8)).join(needed, "context", "left_semi")
                shorter = self.levels[k - 1].select(F.col("gram").alias("code"), F.col("n").alias("above"))
                children = children.select("context", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).join(F.broadcast(shorter) if k - 1 < _FEW_CONTEXTS else shorter, "code")
                sums = children.groupBy("context").agg(F.sum("above").cast("double").alias("above"))
                left = left.join(sums, "context", "left").select("gram", "p", F.coalesce("above", "ruled_n").alias("ruled_n"), F.when(F.col("above").isNotNull(), F.col("distinct")).otherwise(F.col("ruled_d")).alias("ruled_d"))
            else:
                ruled = F.coalesce("distinct", "ruled_d")
                done.append(left.select("gram", (F.col("p") - F.log10(256 - ruled)).alias("p")))
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Trie:
    """Gather a trie's counts over all of ``docs``; NULL texts are empty. No documents give an empty trie."""
    levels = [store(gram_counts(docs.select(text_col), order))]
    for k in range(order, 0, -1):
        shorter = levels[0].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        levels.insert(0, store(shorter))
    return Trie(order, levels, levels[0].agg(F.sum("n")).first()[0] or 0)


class AdaptivePpm:
    """A trie that learns a text as it goes; the same predictions, from counts so far."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.seen: dict[bytes, dict[int, int]] = {}

    def step(self, context: bytes, symbol: int) -> float:
        """log10 probability of ``symbol``, which is then learned."""
        p, ruled, total = 0.0, {}, None
        for k in range(len(context), -1, -1):
            after = self.seen.get(context[len(context) - k :])
            if not after:
                continue
            left = {s: n for s, n in after.items() if s not in ruled}
            total = sum(left.values()) + len(left)
            if symbol in left:
                p += math.log10(left[symbol] / total)
                break
            p += math.log10(len(left) / total) if left else 0
            ruled = after
        else:
            p -= math.log10(256 - len(ruled))
        for k in range(len(context) + 1):
            after = self.seen.setdefault(context[len(context) - k :], {})
            after[symbol] = after.get(symbol, 0) + 1
        return p

    def score(self, text: bytes) -> float:
        padded = bytes([_PAD]) * self.order + text + bytes([_END])
        return sum(self.step(padded[i - self.order : i], padded[i]) for i in range(self.order, len(padded)))


def score_adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``id_col, score``: log10 probability of each text under a model that starts empty (NULL: empty text). Time and memory go with a text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            scores = [AdaptivePpm(order).score((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    rows = docs.select(id_col, text_col)
    return rows.transform(map_arrow, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The documents that are not learned from; a NULL id counts as an empty one."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII case and ASCII white space only


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all documents; the end of a text is the empty word. Counts are summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in sliced(batches, 0):
            for text in batch.column(0).to_pylist():
                held.update(_words(text))
            held[b""] += batch.num_rows
            if len(held) > 300_000:
                yield _word_rows(held)
                held.clear()
        yield _word_rows(held)

    return texts.transform(map_arrow, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


_READY: dict[str, tuple[_Lookup, np.ndarray, dict[bytes, float]]] = {}
_NAMES = ["key", "id", "held_out", "n_tokens", "n_known", "common", "score", "words", "word_counts", "grams", "gram_counts"]


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def score(docs: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, common_grams: float = COMMON_GRAMS, common_words: float = COMMON) -> DataFrame:
    """Score every document by a model trained on ``training`` (by default those not held out).

    Returns for each input row: ``id_col, held_out, n_tokens, n_known,
    train_tokens, base_score, score``. ``score`` is the trie's log10 probability
    of the text; ``base_score`` that of a smoothed word model over lower-cased
    words and one end a text. NULL texts are empty; empty texts have their end.
    Repeated rows are scored (and learned) each; no training documents leave
    both models uniform. Very long texts are read whole, in memory that goes
    with their length.

    Common words (at most 1 / common_words of them, up to WORD_BYTES long) and
    common grams are counted within a document against broadcast lists; all
    others are joined by shuffle. The two shares change no result but by the
    order in which numbers are added.
    """
    held = held_out(id_col)
    training = docs.filter(~held) if training is None else training
    trie = train(training, text_col, order)
    vocabulary = store(word_counts(training.select(text_col)))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = vocabulary.filter((F.col("n") >= common_words * total) & (F.octet_length("word") <= WORD_BYTES)).toArrow()
    listed = (listed["word"].to_pylist(), listed["n"].to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast((*trie.common(common_grams), listed))
    name = uuid4().hex
    fields = "key long, id {}, held_out boolean, n_tokens long, n_known long, common double, score double, words array<binary>, word_counts array<long>, grams array<long>, gram_counts array<long>"

    def ready() -> tuple[_Lookup, np.ndarray, dict[bytes, float]]:
        if name not in _READY:
            _READY.clear()
            codes, p, (words, counts) = shared.value
            _READY[name] = _Lookup(codes), np.append(p, 0.0), dict(zip(words, map(math.log10, [c + 1 for c in counts]), strict=True))
        return _READY[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, p, weight = ready()
        end = b"" in weight
        for batch in sliced(batches, 3, _BATCH):
            grams, at = _symbols(batch.column(3), order)
            found = lookup(grams)
            scores = np.add.reduceat(p[found], at[:-1])  # the last, for -1, is 0
            missed = np.flatnonzero(found < 0)
            rare, rare_counts, sizes = [], [], []
            for a, b in pairwise(np.searchsorted(missed, at)):
                mine, n = np.unique(grams[missed[a:b]], return_counts=True)
                rare.append(mine)
                rare_counts.append(n)
                sizes.append(len(mine))
            words, word_counts, word_sizes, tokens, known, sums = [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                mine = _words(text)
                odd = Counter(w for w in mine if w not in weight)
                tokens.append(len(mine) + 1)
                known.append(len(mine) - odd.total() + end)
                sums.append(sum(weight[w] for w in mine if w in weight) + (weight[b""] if end else 0.0))
                if not end:
                    odd[b""] = 1
                words += odd
                word_counts += odd.values()
                word_sizes.append(len(odd))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(3)), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()),
                _lists(word_sizes, pa.array(words, pa.binary())), _lists(word_sizes, pa.array(word_counts, pa.int64())),
                _lists(sizes, pa.array(np.concatenate(rare).astype(np.int64))), _lists(sizes, pa.array(np.concatenate(rare_counts).astype(np.int64))),
            ], names=_NAMES)

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    told = store(rows.transform(map_arrow, run, fields.format(rows.schema["id"].dataType.simpleString())))

    words = told.select("key", F.explode(F.arrays_zip("words", "word_counts")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.word_counts").alias("times"))
    words = words.join(vocabulary.select("word", F.col("n").alias("c")), "word").groupBy("key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    grams = told.select("key", F.explode(F.arrays_zip("grams", "gram_counts")).alias("x")).select("key", F.col("x.grams").alias("gram"), F.col("x.gram_counts").alias("times"))
    grams = grams.join(store(trie.log10(store(grams.select("gram").distinct()))), "gram").groupBy("key").agg(F.sum(F.col("times") * F.col("p")).alias("more_score"))
    out = told.select(*_NAMES[:7]).join(words, "key", "left").join(grams, "key", "left")
    zero = F.lit(0)
    base = F.col("common") + F.coalesce("more_logs", zero) - F.col("n_tokens") * math.log10(total + distinct + 1)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
