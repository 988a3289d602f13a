"""Secret scan: plain patterns, and a randomness test battery.

The battery takes each long run of encoding characters that no pattern covers,
infers its encoding (hex, base32, base64 and the like), and asks three
questions of its symbols as values 0..k-1: are they uniform over the alphabet
(chi-squared), do values above and below the middle change places as often as
chance has it (runs), and do neighbours go together (serial correlation)? Each
gives a normal score that is large where symbols are not random; their sum is
held against two distributions, for the token's encoding and length: that of
random tokens, and that of ordinary ones (words, names and numbers joined as
people join them), both simulated once. A token far in the lower tail of the
ordinary ones and not in the upper tail of random ones is a secret. The lower
tail is the p-value of the Benjamini-Hochberg step, which bounds false
discoveries among a document's tokens and gives longer ones more weight.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from airrline.llm.common import map_arrow, sliced

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(?a:([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # shorter runs fail anyway and overlap no other match
KINDS = ("assign", "access", "hex", "random")

LEAST = 20  # characters of a token or piece that is tested
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[^=]+(?:=+\Z)?")  # with the padding at the token's end
RUNS = (re.compile(r"[^_-]+"), re.compile(r"[^+/]+"))
FDR = 0.05  # share of false discoveries among a document's tokens
NOT_RANDOM = 0.001  # tokens that fail the battery at this level are not secrets
SIMULATED = 400  # tokens of each kind, for an encoding and length
_LENGTHS = (20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512, 1024)  # that are simulated; a token goes by the next shorter one
_ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {name: frozenset(a) for name, a in _ALPHABETS.items()}
# Rounded letter frequencies of running text in per mille, any case; digits and signs share the rest.
_TEXT = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (125, 90, 80, 75, 70, 68, 62, 58, 60, 42, 40, 28, 28, 24, 23, 22, 20, 19, 18, 15, 10, 8, 2, 2, 1, 1), strict=True))


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet that holds all of a token (padding aside)."""
    used = set(token.rstrip("="))
    return next((name for name, a in _SETS.items() if used <= a), None)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def scores(values: list[int], k: int) -> tuple[float, float, float]:
    """Normal scores of the three tests over symbols 0..k-1: large where symbols are uneven, change sides seldom, or go with their neighbours."""
    n = len(values)
    counts: dict[int, int] = {}
    for x in values:
        counts[x] = counts.get(x, 0) + 1
    stat, df = sum(c * c for c in counts.values()) * k / n - n, k - 1
    uneven = ((max(stat, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # cube-root normal form

    above = [2 * x >= k for x in values]
    n1 = sum(above)
    n0 = n - n1
    few = math.sqrt(n)
    if n1 and n0:
        runs = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False))
        mean = 2 * n1 * n0 / n + 1
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        few = (mean - runs) / math.sqrt(var) if var > 0 else 0.0

    m = sum(values) / n
    spread = sum((x - m) ** 2 for x in values)
    r = sum((a - m) * (b - m) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    return uneven, few, (r + 1 / n) * math.sqrt(n)


def _ordinary(r: random.Random, name: str, n: int) -> str:
    """A token as people write them: words by letter frequency, numbers, and what joins them."""
    upper, mixed = name in ("HEX", "base32", "upper36"), name in ("base62", "base64", "base64url")
    alphabet = _SETS[name]
    letters = [ch for ch in _TEXT if (ch.upper() if upper else ch) in alphabet]
    weights = [_TEXT[ch] + r.choice((0, 60)) for ch in letters] if r.random() < 0.5 else [_TEXT[ch] for ch in letters]  # names and short forms use letters otherwise
    digits = [ch for ch in "0123456789" if ch in alphabet]
    joint = r.choice(["", "_", "-"] if name == "base64url" else ["", "/"] if name == "base64" else [""])
    camel = mixed and r.random() < 0.5
    out, size = [], 0
    while size < n:
        if r.random() < 0.35:
            part = "".join(r.choices(digits, k=r.randint(1, 5)))
        else:
            part = "".join(r.choices(letters, weights, k=r.randint(2, 9)))
            part = part.upper() if upper else part.capitalize() if camel else part
        out.append(part + joint)
        size += len(out[-1])
    return "".join(out)[:n]


@lru_cache(maxsize=512)
def _spread(name: str, n: int) -> tuple[float, float, float, float]:
    """Mean and deviation of the summed scores of ordinary tokens, and of random ones."""
    alphabet, r = _ALPHABETS[name], random.Random(f"{name} {n}")
    index = {ch: i for i, ch in enumerate(alphabet)}
    out = []
    for draw in (lambda: [index[ch] for ch in _ordinary(r, name, n)], lambda: r.choices(range(len(alphabet)), k=n)):
        sums = [sum(scores(draw(), len(alphabet))) for _ in range(SIMULATED)]
        mean = sum(sums) / SIMULATED
        out += [mean, math.sqrt(sum((x - mean) ** 2 for x in sums) / (SIMULATED - 1))]
    return tuple(out)


def battery(token: str, encoding: str) -> tuple[float, float]:
    """p-values of a token's summed scores: the lower tail under "ordinary", and the upper tail under "random"."""
    index = {ch: i for i, ch in enumerate(_ALPHABETS[encoding])}
    values = [index[ch] for ch in token.rstrip("=")]
    total = sum(scores(values, len(index)))
    mean, sd, mean_random, sd_random = _spread(encoding, _LENGTHS[max(0, bisect_right(_LENGTHS, len(values)) - 1)])
    return _upper_tail((mean - total) / sd), _upper_tail((total - mean_random) / sd_random)


def _varied(token: str) -> bool:
    """Digits among letters, as encoded bits have and words have not; the larger the alphabet, the surer."""
    return any(ch.isdigit() for ch in token) and any(ch.isalpha() for ch in token)


def _pieces(token: str, at: int) -> list[tuple[int, int]]:
    """Spans of a token to test: what is between inner "=", and of that which no alphabet holds, the longest runs of base64 and of base64url."""
    out: list[tuple[int, int]] = []
    for m in PART.finditer(token):
        if infer_encoding(m[0]) is not None:
            runs = {m.span()}
        else:
            runs = {(m.start() + x.start(), m.start() + x.end()) for cut in RUNS for x in cut.finditer(m[0])}
        out += sorted((at + a, at + b) for a, b in runs if b - a >= LEAST)
    return out


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that overlap none of ``taken``."""
    starts, ends = [], []
    for a, b in sorted(taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [(a, b) for a, b in spans if not (i := bisect_left(starts, b)) or ends[i - 1] <= a]


def random_spans(text: str, taken: list[tuple[int, int]], fdr: float = FDR) -> list[tuple[int, int]]:
    """Spans of random-looking tokens that overlap none of ``taken``."""
    tested = []
    for a, b in _free([x for m in TOKEN.finditer(text) for x in _pieces(m[0], m.start())], taken):
        encoding = infer_encoding(text[a:b])
        if encoding is None or encoding == "decimal" or not _varied(text[a:b]):
            continue
        tested.append((*battery(text[a:b], encoding), a, b))
    if not tested:
        return []
    mean = sum(b - a for _, _, a, b in tested) / len(tested)
    weighted = sorted((p * mean / (b - a), r, a, b) for p, r, a, b in tested)  # weights average 1
    cut = max((i for i, x in enumerate(weighted, 1) if x[0] <= fdr * i / len(weighted)), default=0)
    out: list[tuple[int, int]] = []
    for a, b in sorted(((a, b) for _, r, a, b in weighted[:cut] if r >= NOT_RANDOM), key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:  # not within the one before
            out.append((a, b))
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    spans += [(a, b, "random") for a, b in random_spans(text, [s[:2] for s in spans])]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by ``[kind]`` of its first."""
    out, at, end = [], 0, -1
    for a, b, kind in spans:
        if a >= max(end, 0) or end < 0:
            out += [text[at:a], f"[{kind}]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = (), out_cols: tuple[str, str] = ("spans", "redacted")) -> DataFrame:
    """One row for each document: its spans, and with ``with_text`` the text without secrets.

    Returns ``id_col``, ``carry`` columns, ``spans`` (array of start, end, kind;
    code points, end exclusive) and ``redacted``, the last two named by
    ``out_cols``, which must not be among the others. NULL texts have no spans and
    stay NULL. Whole texts are read, in time and memory that go with their
    length; documents without secrets come back too, repeated rows each; an empty
    table gives an empty result. Spans that begin together go by kind, as listed.
    """
    names = [id_col, text_col, *carry]
    if len({*names, *out_cols}) < len(names) + 2:
        raise ValueError(f"columns named twice: {names}, {out_cols}")
    rows = docs.select(*names)
    keep = [i for i, n in enumerate(names) if n != text_col]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            found = [scan(t) if t else [] for t in texts]
            columns = [batch.column(i) for i in keep]
            columns.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], kind))
            if with_text:
                columns.append(pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*[names[i] for i in keep], out_cols[0], *(out_cols[1:] if with_text else [])])

    schema = ", ".join(f"`{rows.schema[i].name}` {rows.schema[i].dataType.simpleString()}" for i in keep)
    schema += f", `{out_cols[0]}` array<struct<start: long, end: long, kind: string>>" + (f", `{out_cols[1]}` string" if with_text else "")
    return rows.transform(map_arrow, run, schema)
