"""Benchmark decontamination: BM25 retrieval of test items by every passage, then verification.

Test items form inverted indexes with impacts in blocks, one for each power of
two that items' lengths come under. Every passage of every document (overlapping
windows of words, twice as long as that power, so of every item's own width,
whatever other items there are) is a query; block-max WAND finds all items whose
score passes the threshold. Scores are shares of the score an item gives itself, so one threshold
serves short and long items. Terms that together cannot carry any item over the
threshold are not essential: the cursors run over the others, and the bound of
what non-essential terms can add is kept for each block. A hit counts once both
its question and its answer are found in the passage. Words of short items stand
in many texts by chance: items of fewer than VERBATIM words count only where they
stand word for word, those of fewer than GRAM words never.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airrline.llm.common import map_arrow, sliced, store

THRESHOLD = 0.6  # of an item's own score
OVERLAP = 0.5  # of the word n-grams of question and of answer
GRAM = 3
K1, B = 1.2, 0.75
BLOCK = 16  # items in a block of postings
LEAST_PASSAGE = 64  # words a passage advances by, at least
VERBATIM = 8  # words of an item under which it must stand in the passage as it is
MAX_INDEX_BYTES = 32 << 20  # of item text in one broadcast index; a larger benchmark is taken in parts
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last sentence answers; a single sentence's last third does."""
    parts = [p for p in _SENTENCE.split(text.strip()) if _WORD.search(p)]
    if len(parts) > 1:
        return tokens(" ".join(parts[:-1])), tokens(parts[-1])
    words = tokens(text)
    cut = len(words) - max(1, len(words) // 3) if len(words) > 1 else 0
    return words[:cut], words[cut:]


def _grams(words: Sequence[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _found(part: Sequence[str], passage: Sequence[str]) -> float:
    """Share of a part's n-grams that a passage holds; an empty part is found."""
    want = _grams(part)
    if not want:
        return 1.0
    n = len(next(iter(want)))
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(want & have) / len(want)


def stride_of(n_words: int) -> int:
    """Words that passages for an item advance by: a power of two times LEAST_PASSAGE, the item's length or more."""
    return LEAST_PASSAGE << max(0, (n_words - 1) // LEAST_PASSAGE).bit_length()


class Index:
    """Inverted index over items (id, text) of one stride, given the whole benchmark's statistics."""

    def __init__(self, items: Sequence[tuple[int | None, str]], df: dict[str, int], n_items: int, mean_words: float, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.parts = [split_item(t) for _, t in items]
        words = [tokens(t) for _, t in items]
        self.stride = max(map(stride_of, map(len, words)), default=LEAST_PASSAGE)
        self.whole = {i: " " + " ".join(w) + " " for i, w in enumerate(words) if len(w) < VERBATIM}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, mine in enumerate(words):
            weight = {}
            for t in sorted(set(mine)):
                tf = mine.count(t)
                idf = math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5))
                weight[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(mine) / (mean_words or 1)))
            own = sum(weight.values())
            for t, w in weight.items():
                postings[t].append((i, w / own))
        minor, self.minor_terms = [0.0] * len(items), set()
        for t in sorted(postings, key=lambda t: (-df[t], t)):
            if all(minor[i] + w < threshold - 1e-9 for i, w in postings[t]):
                self.minor_terms.add(t)
                for i, w in postings[t]:
                    minor[i] += w
        self.minor_bound = [max(minor[b : b + BLOCK]) for b in range(0, len(items), BLOCK)]
        self.minor_most = max(minor, default=0.0)
        self.minor = minor
        self.terms: list[dict[str, float]] = [{} for _ in items]
        for t, p in postings.items():
            for i, w in p:
                self.terms[i][t] = w
        self.major = {}
        for t, p in postings.items():
            if t not in self.minor_terms:
                block: dict[int, float] = {}
                for i, w in p:
                    block[i // BLOCK] = max(block.get(i // BLOCK, 0.0), w)
                self.major[t] = ([i for i, _ in p], block, max(w for _, w in p))

    def search(self, majors: Sequence[str], passage: set[str]) -> list[tuple[int, float]]:
        """Items (by place) whose score in ``passage`` reaches the threshold. ``majors``: its essential terms."""
        cursors = [[0, *self.major[t]] for t in majors]  # place in the postings, items, block maxima, maximum
        need, found = self.threshold - 1e-9, []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            reach, pivot = self.minor_most, None
            for c in cursors:
                reach += c[3]
                if reach >= need:
                    pivot = c[1][c[0]]
                    break
            if pivot is None:
                break
            block = pivot // BLOCK
            upto = [c for c in cursors if c[1][c[0]] <= pivot]
            if self.minor_bound[block] + sum(c[2].get(block, 0.0) for c in upto) < need:
                # nothing up to the end of the block or the next cursor can pass
                later = min((c[1][c[0]] for c in cursors if c[1][c[0]] > pivot), default=1 << 60)
                target = min(later, (block + 1) * BLOCK)
            elif upto[0][1][upto[0][0]] < pivot:
                target = pivot
            else:
                if self.minor[pivot] + sum(self.terms[pivot].get(t, 0.0) for t in majors) >= need:
                    score = sum(w for t, w in self.terms[pivot].items() if t in passage)
                    if score >= need:
                        found.append((pivot, score))
                target = pivot + 1
            for c in upto:
                if c[1][c[0]] < target:
                    c[0] = bisect_left(c[1], target, c[0])
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return found

    def verify(self, item: int, passage: Sequence[str]) -> tuple[float, float] | None:
        """Shares of an item's question and answer in a passage, if both are found."""
        if item in self.whole:
            return (1.0, 1.0) if self.whole[item] in " " + " ".join(passage) + " " else None
        question, answer = (_found(part, passage) for part in self.parts[item])
        return (question, answer) if question >= OVERLAP and answer >= OVERLAP else None

    def leaks(self, words: Sequence[str]) -> list[tuple[int | None, float, float, float]]:
        """(item, score, question share, answer share) of every item that a text's words leak."""
        major = self.major
        hits = [i for i, w in enumerate(words) if w in major]
        if not hits:
            return []
        stride = self.stride
        windows: dict[int, set[str]] = defaultdict(set)
        for i in hits:
            p = i // stride
            windows[p].add(words[i])
            if p:
                windows[p - 1].add(words[i])
        best: dict[int, tuple[float, float, float]] = {}
        need = self.threshold - 1e-9 - self.minor_most
        for p, majors in windows.items():
            if sum(major[t][2] for t in majors) < need:
                continue
            passage = words[p * stride : (p + 2) * stride]
            for i, score in self.search(sorted(majors), set(passage)):
                if (shares := self.verify(i, passage)) and (score, *shares) > best.get(i, (-1.0,)):
                    best[i] = score, *shares
        return [(self.ids[i], *v) for i, v in best.items()]


def leaks_of(indexes: Sequence[Index], text: str | None) -> list[tuple[int | None, float, float, float]]:
    """What a text leaks of all indexes, by item, NULL ids first."""
    words = tokens(text)
    return sorted((x for index in indexes for x in index.leaks(words)), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, part_bytes: int = MAX_INDEX_BYTES) -> Iterator[list[Index]]:
    """For each part of the benchmark, within ``part_bytes`` of text, its indexes by stride, with statistics over all of it; one part at a time.

    Items of fewer than GRAM words are left out, though the statistics count
    them; equal rows are one item; a NULL id stays NULL.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * n_bytes / part_bytes))  # hashed parts are uneven, so aim at half

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                if words:
                    terms = sorted(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array(["", *terms]), pa.array([len(words), *[1] * len(terms)], pa.int64())], names=["term", "n"])

    # the empty term gathers lengths
    counts = items.select("text").transform(map_arrow, split, "term string, n long").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    counts = store(counts) if parts > 1 else counts
    whole = counts.filter("term = ''").first()
    if whole is None:
        return
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        rows = sorted(((r["id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        strides: dict[int, list[tuple[int | None, str]]] = defaultdict(list)
        for row in rows:
            if (n := len(tokens(row[1]))) >= GRAM:
                strides[stride_of(n)].append(row)
        if not strides:
            continue
        if parts == 1:
            df = {r["term"]: r["df"] for r in counts.collect()}
        else:
            terms = mine.select("text").transform(map_arrow, split, "term string, n long").select("term").distinct()
            df = {r["term"]: r["df"] for r in counts.join(terms, "term", "left_semi").collect()}
        yield [Index(own, df, whole["df"], whole["n"] / whole["df"], threshold) for _, own in sorted(strides.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, part_bytes: int = MAX_INDEX_BYTES, out_col: str = "leaks") -> DataFrame:
    """Every document with ``leaks`` (or ``out_col``): an array of (item_id, score, question, answer), empty if clean.

    All columns stay (one of that name is replaced), NULL and empty texts
    are clean, repeated rows come back each. Whole texts are read. An empty
    benchmark leaves all clean. Items of fewer than GRAM words are never found,
    of fewer than VERBATIM words only as they stand; a NULL item id is reported
    as NULL; the passage of the highest score, and then shares, stands for an item.
    Parts of a large benchmark are broadcast one at a time, with what was found so far
    stored in between; the result does not depend on the parts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(out_col)
    kind = "array<struct<item_id: long, score: double, question: double, answer: double>>"
    out, names = docs, []
    leak = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
    for k, index in enumerate(build_indexes(benchmark, threshold=threshold, part_bytes=part_bytes)):
        if k:
            out = store(out)
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)
        name = f"__leaks_{k}"
        arrow = to_arrow_schema(out.schema).append(pa.field(name, leak))
        schema = out.withColumn(name, F.lit(None).cast(kind)).schema
        at = out.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, arrow=arrow, at=at) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, at):
                found = [leaks_of(shared.value, t) for t in batch.column(at).to_pylist()]
                rows = [[dict(zip(("item_id", "score", "question", "answer"), x, strict=True)) for x in f] for f in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, leak)], names=arrow.names)

        out = out.transform(map_arrow, run, schema)
        names.append(name)
    if not names:
        return docs.withColumn(out_col, F.array().cast(kind))
    found = F.concat(*names)
    known = F.array_sort(F.filter(found, lambda x: x["item_id"].isNotNull()))
    in_order = F.concat(F.array_sort(F.filter(found, lambda x: x["item_id"].isNull())), known)
    return out.withColumn(out_col, in_order if len(names) > 1 else F.col(names[0])).drop(*names)
