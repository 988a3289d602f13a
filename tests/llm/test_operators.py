"""Each operator against a plain version, on texts with every oddity."""

import base64
import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airrline.llm import bpe, chat, common, decontaminate, graph, near_dup, ppm, quality, secrets, sharding, site_tree, suffix_dedup
from . import plain

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"


def words(n, seed=0, vocabulary=200):
    r = random.Random(seed)
    pool = ["".join(random.Random(i).choices(string.ascii_lowercase, k=2 + i % 7)) for i in range(vocabulary)]
    return " ".join(r.choices(pool, k=n))


TEXTS = [
    (1, "The quick brown fox. " * 8), (2, None), (3, ""), (4, "   \n\t "), (5, "one two three four"), (6, words(300, 1)), (7, words(300, 1)),
    (8, words(300, 1).replace("a", "e", 3)), (9, "naïve café 🙂 日本語 \x00 end"), (10, words(3000, 2)), (10, words(3000, 2)), (11, "x" * 4000), (12, "a b\x0bc d"),
    (13, "line one here now\n" * 5 + words(40, 3)), (14, words(90, 4) + " " + words(300, 1)[:700]), (None, "a row without an id"), (15, "\n".join(["Lorem ipsum dolor sit amet, " + words(12, 5)] * 2)),
]
SCHEMA = "doc_id long, text string, lang string, n_words long, part string, id string, key string, digest string"


def docs(spark, rows=TEXTS):
    """Documents with other columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", -1, "p", "i", "k", "d") for i, t in rows], SCHEMA)


def test_bpe_matches_tiktoken_and_decodes(spark):
    import tiktoken

    path = tokenizers.path(RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(docs(spark), path, tokenizers.PATTERN).collect()}
    assert rows == {(i, np.array(exact.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS}
    again = bpe.decode(bpe.encode(docs(spark), path, tokenizers.PATTERN, with_decoded=False), path)
    assert {bytes(r.decoded) for r in again.collect()} == {(t or "").encode() for _, t in TEXTS}
    assert bpe.encode(docs(spark, []), path, tokenizers.PATTERN).count() == 0


def test_bpe_random_text():
    import tiktoken

    raw = open(tokenizers.path(RANKS), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    exact = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, r = bpe.Bpe(raw, tokenizers.PATTERN), random.Random(3)
    with pytest.raises(ValueError, match="no rank"):
        bpe.Bpe(b"\n".join(line for line in raw.splitlines() if base64.b64decode(line.split()[0]) != b"q"), tokenizers.PATTERN)
    for text in ["a" * 3000, "ab" * 1500, "=-" * 900, " " * 500, "the" * 400]:
        assert mine.encode(text) == np.array(exact.encode_ordinary(text), "<u4").tobytes()
    for _ in range(2000):
        text = "".join(chr(r.choice([r.randint(32, 126), r.randint(97, 100), r.randint(160, 0x500), r.randint(0x4E00, 0x9000)])) for _ in range(r.randint(1, 60)))
        assert mine.encode(text) == np.array(exact.encode_ordinary(text), "<u4").tobytes()


def _byte_model(texts, order):
    counts = Counter()
    for t in texts:
        b = b"\xfe" * order + t + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i + 1]] += 1
    after = defaultdict(dict)
    for g, n in counts.items():
        after[g[:-1]][g[-1]] = n

    def log10(context, symbol):
        p, ruled = 0.0, set()
        for k in range(order, -1, -1):
            seen = after.get(context[order - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in ruled}
            escape = len(left)
            total = sum(left.values()) + escape
            if symbol in left:
                return p + math.log10(left[symbol] / total)
            if total:
                p += math.log10(escape / total)
            ruled = set(seen)
        return p - math.log10(256 - len(ruled))

    return log10


@pytest.mark.parametrize("share", [1e-9, 2e-3, 1.0])
def test_ppm_against_plain_version(spark, share):
    """Whatever is common, by shares, is the same model."""
    data = docs(spark)
    held = {r.doc_id: r.h for r in data.select("doc_id", ppm.held_out().alias("h")).collect()}
    train = [(t or "").encode() for i, t in TEXTS if not held[i]]
    counts = Counter(w for t in train for w in [*t.lower().split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    log10 = _byte_model(train, 3)
    got = ppm.score(data, order=3, common_grams=share, common_words=share).collect()
    assert len(got) == len(TEXTS)
    expected = defaultdict(list)
    for i, t in TEXTS:
        b = (t or "").encode()
        own = [*b.lower().split(), b""]
        padded = b"\xfe" * 3 + b + b"\xff"
        score = sum(log10(padded[k - 3 : k], padded[k]) for k in range(3, len(padded)))
        expected[i].append((held[i], len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), score))
    for r in got:
        e = expected[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert r.base_score == pytest.approx(e[4]) and r.score == pytest.approx(e[5])
    assert sum(10 ** log10(b"the", s) for s in range(256)) == pytest.approx(1)


def test_ppm_edges(spark):
    assert ppm.score(docs(spark, [])).count() == 0
    none = ppm.score(docs(spark, [(1, "ab")]), docs(spark, [])).first()
    assert none.train_tokens == 0 and none.n_known == 0 and none.score == pytest.approx(-3 * math.log10(256))
    adaptive = {r.doc_id: r.score for r in ppm.score_adaptive(docs(spark, [(1, "abababababab"), (2, "qwertyuiopas"), (3, None)]), order=2).collect()}
    assert adaptive[2] < adaptive[1] < 0 and adaptive[3] == pytest.approx(-math.log10(256))


def _statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_rules(spark):
    rows = [*TEXTS, (20, "a b c d e f a b c d e f"), (21, "#*$ %&| <> x\n\nx\nx")]
    got = quality.judge(docs(spark, rows), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    expected = Counter()
    for i, t in rows:
        s = _statistics(t)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        expected[(i, *s, failed, not failed)] += 1
    assert Counter(tuple(r) for r in got) == expected
    kept = quality.keep(quality.judge(docs(spark, rows), []))
    assert kept.count() == sum(n for e, n in expected.items() if e[-1])


def test_quality_learns_what_is_bad(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(60, i) if not bad else " ".join(w + r.choice(["***", "###"]) for w in words(60, i).split())
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    table = spark.createDataFrame([*labels, (None, 0), (3, None)], "doc_id long, quality int")
    rules = quality.fit(docs(spark, rows), table)
    assert rules
    verdicts = {x.doc_id: x.kept for x in quality.judge(docs(spark, rows), rules).collect()}
    assert verdicts == {i: i % 4 != 0 for i, _ in rows}
    assert quality.fit(docs(spark, rows), table.limit(0)) == []


def test_quality_learns_two_kinds_of_bad_and_an_exception(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        w, kind = words(60, i, 4000).split(), i % 6
        if kind == 0:  # symbols are bad
            text = " ".join(x + r.choice(["***", "###"]) for x in w)
        elif kind == 1:  # unless words are capitals
            text = " ".join(x.upper() + r.choice(["***", "###"]) for x in w)
        elif kind == 2:  # and so are very short texts
            text = " ".join(w[:15])
        else:
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, 0 if kind in (0, 2) else 1))
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    assert len(quality.fit(docs(spark, rows), table)) == 2
    rules = quality.fit(docs(spark, rows), table, conditions=1)
    assert len(rules) > 2 and {x.keeps for x in rules} == {True, False}
    want = {i: i % 6 not in (0, 2) for i, _ in rows}
    wrong = lambda rules: sum(x.kept != want[x.doc_id] for x in quality.judge(docs(spark, rows), rules).collect())
    assert wrong(rules) <= 15 and wrong(rules[::-1]) > 100
    assert len(quality.fit(docs(spark, rows * 2), table, sample=300)) < 10


def test_quality_goes_on_after_a_rule_that_fails():
    r = np.random.default_rng(4)
    x, bad = r.random((3000, len(quality.FEATURES))), np.zeros(3000, bool)
    noisy, clear = x[:, 0] > 0.8, x[:, 1] > 0.9
    bad[noisy] = r.random(noisy.sum()) < 0.7
    bad[clear & ~noisy] = True
    rules = quality.learn(x, bad)
    assert rules and not any(rule.keeps for rule in rules)
    covered = np.any([rule.holds(x) for rule in rules], axis=0)
    assert bad[covered].mean() > 0.95 and covered[clear & ~noisy].mean() > 0.9


def test_shards_are_contiguous_and_even(spark):
    got = sharding.shard_by_bytes(docs(spark), 4).collect()
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, len((x[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t in order]
    at, expected, slots = 0, Counter(), Counter()
    for (i, _), size in zip(order, sizes, strict=True):
        shard = min(3, (2 * at + size) * 4 // (2 * sum(sizes)))
        expected[i, size, shard, slots[shard]] += 1
        slots[shard] += 1
        at += size
    assert Counter((r.doc_id, r.size, r.shard, r.slot) for r in got) == expected
    import zlib

    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t in TEXTS}
    assert sharding.shard_by_bytes(docs(spark, []), 4).count() == 0


PAGE = """<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><div class="top">{nav}</div><div class="x{i}"><p>{a}<p>{b}&amp;c
 d</div><aside>side</aside><!-- > --><div>{foot}</div><form>f</form></body>"""


def test_site_tree_cuts_what_a_host_repeats(spark):
    rows = [(i, "https://h.example.org/p", PAGE.format(i="", nav="Home News", a=f"first {i}", b=f"second {i}", foot="All rights"), "x") for i in range(12)]
    rows += [(50, "http://solo.example.org/", PAGE.format(i="", nav="Solo nav", a="aa", b="bb", foot="ff"), "x"), (51, None, None, "x"), (52, "odd", "", "x"), (53, "h", "a < b &lt; c<br>d", "x")]
    rows += [(54, "http://u.example.org", '<article><h1>T</h1><p>One <b>two</b>\n three</p><div class="comments">c</div></article><footer>f</footer>', "x")]
    rows += [(55, "http://odd.example.org", "<body><div class=own>Alone</div><p>text</body>", "x")]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert all(got[i] == f"first {i}\nsecond {i}&c d" for i in range(12))
    assert got[50] == "aa\nbb&c d"  # the other host's pages say what its paths are worth
    assert got[51] == got[52] == "" and got[53] == "a < b < c d" and got[54] == "T\nOne two three" and got[55] == "Alone\ntext"
    assert site_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_tree_cuts_what_repeats_within_an_article(spark):
    page = "<body><main><ul><li>Home<li>News</ul><p>We use cookies</p><h1>Title {i}</h1><p>Story {i}</p><p>{extra}</p></main></body>"
    rows = [(i, "https://m.example.org/p", page.format(i=i, extra="Told twice" if i < 2 else f"More {i}")) for i in range(8)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nStory {i}\n" + ("Told twice" if i < 2 else f"More {i}") for i in range(8))


def _plain_importance(pages, by_host=True):
    """(host, node) -> importance, from the definition, one page at a time."""
    seen = defaultdict(lambda: defaultdict(set))  # of a node: pieces, layouts and itself, each with the pages' bodies
    number = defaultdict(Counter)
    for url, page in pages:
        blocks, layouts = site_tree.parse(page)
        host = site_tree.host_of(url) if by_host else ""
        body = site_tree._body(blocks, True)
        found = {(b.node, "piece", x) for b in blocks for x in site_tree.pieces(b.text)} | {(n, "layout", x) for n, x in layouts} | {(b.node, "seen", "") for b in blocks}
        for node, kind, x in found:
            seen[host, node][kind, x].add(body)
            number[host, node][kind, x] += 1

    def bodies(of, key):
        b, n = len(seen[of][key]), number[of][key]
        return n if b >= 48 else min(n, 1 - 64 * math.log(1 - b / 64))

    out = {}
    for of, values in seen.items():
        pieces = [(len(x) + 1, bodies(of, (k, x))) for k, x in values if k == "piece"]
        layouts = [bodies(of, (k, x)) for k, x in values if k == "layout"]
        if pieces:
            unit = math.log(max(2, bodies(of, ("seen", ""))))
            content = 1 - sum(w * d * math.log(d) for w, d in pieces) / sum(w * d for w, d in pieces) / unit
            out[of] = min(1, max(0, content))
            if layouts:
                made = -sum(d / sum(layouts) * math.log(d / sum(layouts)) for d in layouts) / unit
                out[of] = 0.9 * out[of] + 0.1 * min(1, max(0, made))
    return out


def _site(seed=5, hosts=4, pages=14):
    """Hosts without any telling names: menu, story in two layouts, a promise that changes now and then, a line below."""
    r = random.Random(seed)
    out = []
    for h in range(hosts):
        menu = "".join(f"<li>{words(2, h * 9 + k)}</li>" for k in range(4))
        for p in range(pages):
            story = "".join(f"<p>{words(r.randint(8, 40), r.random())}.</p>" for _ in range(r.randint(1, 5)))
            page = f"<body><div><ul>{menu}</ul></div><div id=m><h2>{words(5, r.random())}</h2>{story}</div><div class=z>{words(6, h * 7 + p % 2)}. Told by h{h}.</div></body>"
            out.append((f"https://h{h}.example.org/{p}", page, story))
    return out


def test_site_tree_importance_against_the_definition(spark):
    site = _site()
    site += [(u, p, s) for u, p, s in site[:5] for _ in range(6)]  # copies
    pages = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(site)], "page_id long, url string, html string").repartition(3)
    counts = site_tree.tree_counts(pages)
    want = _plain_importance([x[:2] for x in site])
    got = {(x.host, x.node): x.importance for x in site_tree.importance(counts, "host").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    want = _plain_importance([x[:2] for x in site], by_host=False)
    got = {("", x.node): x.importance for x in site_tree.importance(site_tree._summed(counts, "node", "kind", "value")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_site_tree_needs_no_names(spark):
    site = _site(6)
    pages = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(site)], "page_id long, url string, html string")
    story = [re.findall(r"<(?:h2|p)>(.*?)</", p) for _, p, _ in site]
    for names in (True, False):
        got = {x.page_id: x.text.split("\n") for x in site_tree.extract(pages, names=names).collect()}
        assert all(got[i] == story[i] for i in range(len(site)))
    kept = {x.page_id: x.text for x in site_tree.extract(pages, low=-1.0).collect()}
    assert all(len(kept[i].split("\n")) == len(story[i]) + 5 for i in range(len(site)))


def test_site_tree_copies_do_not_make_a_template(spark):
    page = "<body><div><p>The one story of this host</p><p>with a second part</p></div><nav>Menu</nav></body>"
    pages = spark.createDataFrame([(i, "https://one.example.org/", page) for i in range(40)], "page_id long, url string, html string")
    assert {x.text for x in site_tree.extract(pages).collect()} == {"The one story of this host\nwith a second part"}


def test_site_tree_reads_odd_markup_in_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 100_000 + "x" + "</div>" * 100_000, "<a " * 350_000, "<a \"'>" * 150_000, "<!--" * 250_000, "<title></style>" * 60_000, "<" * 1_000_000, "<p>x" * 100_000, "<span class=a>" * 70_000):
        site_tree.parse(page)
    assert time.perf_counter() - began < 20
    deep = site_tree.parse("<div>" * 2000 + "x<p>y</p>" + "</div>" * 2000 + "<p>z</p>")[0]
    assert [b.text for b in deep] == ["x", "y", "z"] and deep[2].node == site_tree.child_node(0, "p")
    assert [b.text for b in site_tree.parse('<p>a <b title="x > y">b</b> c</p><p>d <i title="e>f</p>')[0]] == ["a b c", "d f"]


def test_chat_round_trip(spark):
    odd = ["plain", "</turn>\n", "<\\/turn> and <\\\\/turn>", "<turn user>\nx</turn>\n", "\\### Assistant: </turn> ok", "", None, "ends <", "</turn", "a\n\nb 🙂"]
    rows = [(c, t, role, odd[(c * 3 + t) % len(odd)]) for c in range(10) for t, role in enumerate(["system", "user", "assistant", "<turn a>b%3C%\n", None, "assistant"])]
    rows += [(77, 1, "user", "same"), (77, 1, "user", "same"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, n long, shown string")
    out = chat.format_chats(table).collect()
    assert len(out) == 12 and all(r.identical for r in out)
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    for r in out:
        turns = sorted(groups[r.conv_id])
        spoken = [text for _, role, text in turns if role == "assistant"]
        bodies = [r.formatted[a:b] for a, b in r.loss_spans]
        assert [re.sub(r"<\\(\\*)(/?turn)", r"<\1\2", b) for b in bodies] == spoken and not any("</turn>" in b or "<turn " in b for b in bodies)
    for d in chat.digest(chat.format_chats(table)).collect():
        turns = sorted(groups[d.conv_id])
        assert d.n_turns == len(turns)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(table.limit(0)).count() == 0
    chats = chat.format_chats(table)
    moved = F.transform("loss_spans", lambda x: F.struct((x["start"] + 1).alias("start"), x["end"].alias("end")))
    right = {d.conv_id: d for d in chat.digest(chats).collect()}
    shifted = {d.conv_id: d for d in chat.digest(chats.withColumn("loss_spans", moved)).collect()}
    assert all(shifted[k].turns_sha256 == d.turns_sha256 and (shifted[k].loss_sha256 != d.loss_sha256 or not d.loss_chars) for k, d in right.items())
    assert any(d.loss_chars for d in right.values())
    long = spark.createDataFrame([(1, t, "assistant", "x<turn " * 40_000 if t == 1 else "y") for t in range(3)], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chats(long)).first().loss_chars == 7 * 40_000 + 2


def test_secrets(spark):
    r = random.Random(5)
    key = "".join(r.choices(secrets._ALPHABETS["base64"], k=60))
    rows = [
        (1, 'TOKEN = "abcdefghijkl"; passwd:short password: x'), (2, "AKIA" + "A1" * 8 + " AKIAshort"), (3, "é " + "0123456789abcdef" * 2), (4, f"see {key} there"),
        (5, "This is an ordinary-sentence_with/long-joined-words2024 in it"), (6, None), (7, "ſecret = abcdefghijklmnop"), (8, ""),
    ]
    got = {x.doc_id: (sorted((s.start, s.end, s.kind) for s in x.spans), x.redacted, x.lang) for x in secrets.find_secrets(docs(spark, rows), with_text=True, carry=("lang",)).collect()}
    assert got[1][0] == [(0, 21, "assign")] and got[1][1].startswith('[assign]"; passwd')
    assert got[2][0] == [(0, 20, "access")] and got[3][0] == [(2, 34, "hex")] and got[3][1] == "é [hex]"
    assert got[4] == ([(4, 64, "random")], "see [random] there", "en")
    assert got[5][0] == got[7][0] == got[8][0] == got[6][0] == [] and got[6][1] is None and got[5][1] == rows[4][1]


def test_secrets_power_and_false_alarms():
    r = random.Random(9)
    found = sum(bool(secrets.random_spans("".join(r.choices(secrets._ALPHABETS["base64"], k=44)), [])) for _ in range(200))
    false = sum(bool(secrets.random_spans("-".join(words(5, i).split()) + "-2024", [])) for i in range(200))
    assert found > 150 and false < 10


def test_secrets_recall_by_encoding_and_length():
    r = random.Random(21)
    least = {"HEX": (0.85, 0.95), "base32": (0.3, 0.5), "lower36": (0.35, 0.5), "base62": (0.7, 0.9), "base64": (0.5, 0.65), "base64url": (0.5, 0.65)}
    for name, (short, long) in least.items():
        for n, want in ((20, short), (32, long), (64, 0.95)):
            found = sum(bool(secrets.random_spans("sig=" + "".join(r.choices(secrets._ALPHABETS[name], k=n)), [])) for _ in range(100))
            false = sum(bool(secrets.random_spans(secrets._ordinary(r, name, n), [])) for _ in range(100))
            assert found >= 100 * want and false <= 12, (name, n, found, false)


def _plain_secrets(text):
    """The base spans, character by character."""
    value, out = set(string.ascii_letters + string.digits + "+/_.=-"), []

    def run(i, allowed):
        while i < len(text) and text[i] in allowed:
            i += 1
        return i

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if text[i : i + len(name)].isascii() and text[i : i + len(name)].lower() == name:
                j = i + len(name)
                j += text[j : j + 1] in ("'", '"')
                j = run(j, " ")
                if text[j : j + 1] not in (":", "="):
                    continue
                j = run(j + 1, " ")
                j += text[j : j + 1] in ("'", '"')
                if (end := run(j, value)) > j:
                    return end, end - j >= 12
        return None

    def access(i):
        end = run(i + 4, string.ascii_uppercase + string.digits)
        return (end, end - i >= 18) if text.startswith("AKIA", i) and end > i + 4 else None

    def hexes(i):
        end = run(i, "0123456789abcdef")
        return (end, end - i >= 16) if end > i else None

    for kind, match in (("assign", assign), ("access", access), ("hex", hexes)):
        i = 0
        while i < len(text):
            if found := match(i):
                if found[1]:
                    out.append((i, found[0], kind))
                i = found[0]
            else:
                i += 1
    return out


def test_secrets_base_against_a_plain_scan():
    r = random.Random(31)
    bits = ["password", "passWD", "Secret", "token", "api_key", "apikey", "ſecret", "=", ":", " = ", "'", '"', " ", "AKIA", "A1B2C3D4E5", "0123456789abcdef", "deadbeef", "x", "é", "\n", "abcdefghijkl", ".", "-_", "=="]
    for _ in range(4000):
        text = "".join(r.choices(bits, k=r.randint(1, 14)))
        base = [x for x in secrets.scan(text) if x[2] != "random"]
        assert sorted(base) == sorted(_plain_secrets(text)), text


def test_secrets_spans_keep_apart():
    r = random.Random(32)
    for _ in range(500):
        spans, taken = ([(a, a + r.randint(1, 12)) for a in (r.randrange(60) for _ in range(r.randint(0, 8)))] for _ in range(2))
        assert secrets._free(spans, taken) == [x for x in spans if not any(x[0] < e and s < x[1] for s, e in taken)]


def test_secrets_of_long_texts_in_linear_time():
    import time

    r = random.Random(33)
    began = time.perf_counter()
    long = " ".join("".join(r.choices(secrets._ALPHABETS["base62"], k=30)) for _ in range(32_000))
    assert len(secrets.scan(long)) > 10_000 and secrets.scan("a" * 1_000_000) != 1
    assert len(secrets.scan(" ".join(f"password=abcdefabcdef0123{i}" for i in range(30_000)))) >= 30_000
    assert time.perf_counter() - began < 20


def test_secrets_within_longer_tokens():
    r = random.Random(12)
    shown = {x: 0 for x in ("AWS_SECRET_ACCESS_KEY={}", "DB_KEY={}==", "https://h.example/x?sig={}&a=1", "/api_v1/{}")}
    for _ in range(100):
        key = "".join(r.choices(secrets._ALPHABETS["base64"], k=60))
        for form in shown:
            text = form.format(key)
            at = text.index(key)
            shown[form] += any(a <= at and b >= at + len(key) for a, b, _ in secrets.scan(text))
    assert min(shown.values()) > 80, shown
    assert [secrets.scan("DB_KEY=" + "".join(random.Random(5).choices(secrets._ALPHABETS["base64"], k=60)))] == [[(7, 67, "random")]]
    false = sum(bool(secrets.scan(f"/some_path2024/{'-'.join(words(5, i).split())}+{'_'.join(words(5, -i).split())}=2024")) for i in range(200))
    assert false < 10


def test_decontaminate_against_scoring_all(spark):
    items = [(i, words(30, 100 + i) + ". " + words(8, 200 + i), "x") for i in range(40)] + [(99, None, "x"), (98, "...", "x"), (0, words(30, 100) + ". " + words(8, 200), "x")]
    bench = spark.createDataFrame(items, "item_id long, text string, leaks string")
    leak = words(200, 7) + " " + items[3][1] + " " + words(100, 8)
    partly = words(50, 9) + " " + " ".join(items[5][1].split()[:12])
    rows = [*TEXTS, (30, leak), (31, partly), (32, items[7][1].upper()), (33, items[3][1] + " " + items[9][1])]
    got = Counter((r.doc_id, tuple(sorted(x.item_id for x in r.leaks))) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect())
    assert {k for k in got if k[1]} == {(30, (3,)), (32, (7,)), (33, (3, 9))} and sum(got.values()) == len(rows)
    in_parts = decontaminate.find_leaks(docs(spark, rows), bench, part_bytes=2000).collect()
    assert Counter((r.doc_id, tuple(sorted(x.item_id for x in r.leaks))) for r in in_parts) == got
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).filter(F.size("leaks") > 0).count() == 0
    index = next(decontaminate.build_indexes(bench))[0]
    for _, text in rows:
        w = decontaminate.tokens(text)
        for p in range(len(w) // index.stride + 1):
            passage = set(w[p * index.stride : (p + 2) * index.stride])
            scores = [sum(x for t, x in own.items() if t in passage) for own in index.terms]
            expected = {i for i, s in enumerate(scores) if s >= index.threshold - 1e-9}
            assert {i for i, _ in index.search(sorted(passage & set(index.major)), passage)} == expected


@pytest.mark.parametrize("part_bytes", [300, 3000, 20_000])
def test_decontaminate_is_the_same_in_any_parts(spark, part_bytes):
    r = random.Random(9)
    lengths = [1, 2, 3, 5, 7, 8, 24, 24, 40, 64, 65, 120, 130, 300, 660]
    items = [(i, words(n, 700 + i, 3000)) for i, n in enumerate(lengths)] + [(None, words(30, 800, 3000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, (_, text) in enumerate(items):
        own = words(r.randint(0, 400), i, 3000).split()
        at = r.randint(0, len(own))
        rows.append((i, " ".join([*own[:at], text, *own[at:]])))
    rows += [(100, items[0][1] + " " + words(200, 5)), (101, " ".join(reversed(items[4][1].split())))]
    found = lambda table: sorted((x.doc_id, [tuple(y) for y in x.leaks]) for x in table.collect())
    got = found(decontaminate.find_leaks(docs(spark, rows), bench, part_bytes=part_bytes))
    assert got == found(decontaminate.find_leaks(docs(spark, rows), bench))
    told = {i: {x[0] for x in leaks} for i, leaks in got}
    assert all(items[i][0] in told[i] for i in range(2, len(items))) and not told[100] and not told[101]
    assert 0 not in set().union(*told.values()) and 1 not in set().union(*told.values())


def _classes(rows):
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    shingles = {t: plain.text_shingles(t) for t in texts}
    names = list(texts)
    parent = {t: t for t in names}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for k, a in enumerate(names):
        for b in names[:k]:
            if plain.alignment(shingles[a], {s: j for j, s in enumerate(shingles[b])}, len(shingles[b])) >= near_dup.SIMILAR:
                parent[find(a)] = find(b)
    least = {}
    for t, ids in texts.items():
        for i in ids:
            if i is not None:
                least[find(t)] = min(i, least.get(find(t), i))
    return {(i, least.get(find(t or ""))) for i, t in rows}


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(4)
    rows = list(TEXTS)
    for g in range(6):
        base = words(150 + 40 * g, 50 + g).split()
        for k in range(8):
            own = list(base)
            for _ in range(k // 2):
                own[r.randrange(len(own))] = f"edit{g}{k}{r.random()}"
            rows.append((100 + 10 * g + k, " ".join(own)))
    rows += [(300, "one two three four five"), (301, "one two three four five six"), (302, "one two three four")]
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.class_id) for x in got} == _classes(rows)
    kept = near_dup.keep_one(docs(spark, rows)).collect()
    classes = Counter(x["class"] for x in got)
    assert len(kept) == len(classes) and kept[0].lang == "en"
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_in_a_large_family(spark):
    """Edited copies of one text, most of them a little less alike than a link needs: classes hang on single links."""
    r = random.Random(11)
    base = words(245, 77, 5000).split()
    rows = []
    for i in range(1000):
        own = list(base)
        for at in r.sample(range(len(own)), 4):
            own[at] = f"edit{r.random()}"
        rows.append((i, " ".join(own)))
    shingles = [plain.text_shingles(t) for _, t in rows]
    where = {x: k for k, x in enumerate(sorted({x for s in shingles for x in s}))}
    has = np.zeros((len(rows), len(where)), np.float32)
    for i, s in enumerate(shingles):
        has[i, [where[x] for x in s]] = 1
    shared = has @ has.T
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in np.argwhere(np.triu(shared / (2 * len(shingles[0]) - shared) >= near_dup.SIMILAR - 1e-6, 1)).tolist():
        if plain.alignment(shingles[i], {x: k for k, x in enumerate(shingles[j])}, len(shingles[j])) >= near_dup.SIMILAR:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    expected = {(i, find(i)) for i in range(len(rows))}
    assert len({c for _, c in expected}) > 20
    assert {(x.doc_id, x.class_id) for x in near_dup.near_duplicates(docs(spark, rows)).collect()} == expected


def test_near_duplicates_name_what_they_count(spark):
    found = near_dup.near_duplicates(docs(spark, [(1, words(200, 1)), (2, words(200, 1) + " end")]))
    assert "n_links" not in found.columns and [x.n_verified for x in found.collect()] == [1, 1]


def test_alignment_respects_order():
    a = np.arange(100)
    assert near_dup.similar(a, a, 100, 100) and near_dup.similar(a[:89], a[:89], 100, 89) and not near_dup.similar(a, a[::-1], 100, 100)
    r = random.Random(3)
    for _ in range(300):
        one = r.sample(range(1000), 40)
        two = [x for x in one if r.random() < 0.93]
        for _ in range(r.randrange(4)):
            i, j = r.randrange(len(two)), r.randrange(len(two))
            two.insert(i, two.pop(j))
        at = {x: k for k, x in enumerate(two)}
        both = [(k, at[x]) for k, x in enumerate(one) if x in at]
        i, j = (np.array(z) for z in zip(*both, strict=True))
        assert near_dup.similar(i, j, len(one), len(two)) == (plain.alignment(one, at, len(two)) >= 0.8 - 1e-12)


def test_bit_filter_never_loses_a_hash(spark, monkeypatch):
    r = np.random.default_rng(6)
    known, others = r.integers(-(1 << 63), (1 << 63) - 1, 3000), r.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    table = spark.createDataFrame([(int(x),) for x in known], "hash long")
    words = common.bit_filter(table, "hash")
    assert common.may_hold(words, known).all() and common.may_hold(words, others).mean() < 0.1
    assert not common.may_hold(common.bit_filter(table.limit(0), "hash"), others).any()
    monkeypatch.setattr(common, "FILTER_BITS", 12)
    words = common.bit_filter(table, "hash")
    assert len(words) == 64 and common.may_hold(words, known).all()


def test_scratch_deletes_stored_tables(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/airrline-*"))
    with common.scratch():
        assert near_dup.near_duplicates(docs(spark)).count() == len(TEXTS)
        assert set(glob.glob(f"{folder}/airrline-*")) > before
    assert set(glob.glob(f"{folder}/airrline-*")) == before


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (40, 40)]
    got = {r.node: r["class"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 32: 30}


def _without_repeats(rows, length):
    last = 1 << 63
    holders = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            holders[s] = min(holders.get(s, last), last - 1 if i is None else i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if holders[b[k : k + length]] < (last - 1 if i is None else i):
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i, len(b), int(gone.sum()), len(suffix_dedup._runs(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowd", [suffix_dedup._CROWD, 3000, 60, 1])
def test_suffix_dedup_against_all_strings(spark, crowd):
    passage = words(60, 77)
    rows = [*TEXTS, *[(200 + k, words(20, 300 + k) + " " + passage[k % 5 : 300 + k] + " " + words(20, 400 + k)) for k in range(30)], (260, "y" * 49), (261, "y" * 49), (262, "y" * 50), (263, "y" * 50), (264, "z" * 9000 + "ab" * 700), (265, "z" * 5000), (266, "q" + "z" * 7000 + "ab" * 99)]
    got = suffix_dedup.deduplicate(docs(spark, rows), crowd=crowd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _without_repeats(rows, 50)
    if crowd > 3000:
        assert suffix_dedup.deduplicate(docs(spark, [])).count() == 0


def test_prefix_groups():
    r = random.Random(2)
    for length in (3, 5, 8):
        for _ in range(40):
            parts = [bytes(r.choices(b"abc\0", k=r.randint(length, 30))) for _ in range(r.randint(1, 12))]
            owners = [r.randint(0, 5) for _ in parts]
            least = {}
            for p, o in zip(parts, owners, strict=True):
                for i in range(len(p) - length + 1):
                    least[p[i : i + length]] = min(o, least.get(p[i : i + length], 99))
            got = suffix_dedup.first_owners(parts, owners, length)
            assert [g.tolist() for g in got] == [[least[p[i : i + length]] for i in range(len(p) - length + 1)] for p in parts]


def test_very_long_texts(spark):
    """A text of over a million characters among short ones, through every operator over documents."""
    long = words(200_000, 1, 50_000)
    edited = " ".join(w if i % 400 else "other" for i, w in enumerate(long.split()))
    item = words(40, 501, 9000) + ". " + words(9, 502, 9000)
    key = "".join(random.Random(7).choices(secrets._ALPHABETS["base64"], k=60))
    rows = [(1, long), (2, edited), (3, long[:600_000] + " " + item + " key=" + key + " " + long[600_000:]), (4, words(50, 3)), (5, "")]
    table = docs(spark, rows)
    assert len(long) > 1_000_000

    out = {r.doc_id: r for r in bpe.encode(table, tokenizers.path(RANKS), tokenizers.PATTERN).collect()}
    assert all(bytes(out[i].decoded) == t.encode() and len(out[i].ids) == 4 * out[i].n_tokens for i, t in rows)
    scores = {r.doc_id: r for r in ppm.score(table, order=3).collect()}
    assert all(scores[i].n_tokens == len(t.split()) + 1 and scores[i].score < 0 for i, t in rows)
    judged = {r.doc_id: r for r in quality.judge(table, []).collect()}
    assert all(judged[i].n_words == len(t.split()) and judged[i].word_chars == sum(map(len, t.split())) for i, t in rows)
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id: len(r.leaks) for r in decontaminate.find_leaks(table, bench).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    found = {r.doc_id: [rows[2][1][s.start : s.end] for s in r.spans] for r in secrets.find_secrets(table).collect()}
    assert found[3] == [key] and not any(found[i] for i in (1, 2, 4, 5))
    classes = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    kept = {r.doc_id: r for r in suffix_dedup.deduplicate(table).collect()}
    assert kept[1].n_removed == kept[4].n_removed == 0 and kept[2].n_removed > 900_000 and len(rows[2][1]) - kept[3].n_removed < len(item) + len(key) + 250
    sizes = {r.doc_id: r.size for r in sharding.shard_by_bytes(table, 4).collect()}
    assert sizes == {i: len(t.encode()) + 1 for i, t in rows}
