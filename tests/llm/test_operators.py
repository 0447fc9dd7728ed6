"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import json
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm import chat_format, components, exact_dedup, host_rules, html_extract, language_id, lm_scoring, mixing, near_dedup, packing, token_counts
from keyfold.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate double, _row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, lang="en"):
    parts = {"en": ["the", "th", "ing", "er", "and", "on"], "fr": ["é", "eau", "que", "è", "ou", "le"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        out.append((i, prose(rng, rng.randint(25, 200), lang), lang, f"s{i % 4}"))
    base = prose(rng, 120).split()
    for i in range(60, 75):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["x1", "y2", "z3"])
        out.append((i, " ".join(w), "en", None))
    out += [(75, None, None, None), (76, "", "en", "s0"), (77, " \n\t", None, "s1"), (78, "a b", "en", "s1"), (79, "A  B", "en", "s1"), (80, out[1][1].replace(" ", "\n"), "en", "s2")]
    out += [(81, "word " * 30000, "en", "s2"), (82, "x" * 70000, None, "s3"), (1, out[1][1], "en", "s1"), (None, out[2][1], "fr", "s0"), (None, "no id here", None, None)]
    out += [(83, "## $$ %% && " * 8, "en", "junk"), (84, "Ünïcödé 中文 <|endoftext|> <|ENDOFTEXT|> it's İ ǅ 12½", "de", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.5, "clash") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def key(r):
    return (r[0] is None, r[0] or 0)


# 2


def test_exact_dedup(docs, rows, none):
    import hashlib

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    best = {k: min(g, key=lambda r: (-len(r[1] or ""), *key(r)))[0] for k, g in groups.items()}
    want = Counter((r[0], best[norm(r[1])], len(groups[norm(r[1])]), r[0] == best[norm(r[1])], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    for budget in (exact_dedup.TRIE_BYTES, 3000, 300):  # the small one spills nearly everything
        assert Counter(map(tuple, exact_dedup.exact_dedup(docs, budget=budget).collect())) == want
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] == best[norm(r[1])])


def test_trie():
    rng = random.Random(1)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for n in range(3000):
        k = bytes(rng.choices(b"ab", k=rng.randint(0, 9)))
        trie.insert(k, (n % 7, False, n))
        best, c = want.get(k, ((9, False, 0), 0))
        want[k] = min(best, (n % 7, False, n)), c + 1
    got = {}
    while trie.held:
        got |= {k: (b, c) for k, b, c in trie.take(trie.heaviest())}
    got |= {k: (b, c) for k, b, c in trie.take()}
    assert got == want


# 3


def brute_rules(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_host_rules(docs, rows, none, spark):
    want = Counter()
    for r in rows:
        c = brute_rules(r[1])
        want[(r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    got = host_rules.host_quality(docs)
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    assert host_rules.host_quality(none).count() == 0
    rep = "a b c d e f g h i\na b c d e f g h i\nx y\nx y\n\n"
    more = spark.createDataFrame([(1, rep, "s"), (2, rep * 3, "s"), (3, "p q r s t u v w " * 2, None)], "doc_id long, text string, source string")
    assert {r.doc_id: tuple(r)[1:6] for r in host_rules.host_quality(more).collect()} == {i: brute_rules(t) for i, t in ((1, rep), (2, rep * 3), (3, "p q r s t u v w " * 2))}


def test_blocked_hosts_as_in_sql(spark):
    """The query's SQL on a table in which hosts are blocked."""
    import duckdb
    from oracles import assert_same

    from keyfold.llm.sql import OP3

    rng = random.Random(3)
    rows = [(i, prose(rng, 60), f"http://h{i % 8}.org/{i}") for i in range(300)]
    rows += [(300 + i, " ".join("#" + w for w in prose(rng, 60).split()) if i % 10 else prose(rng, 60), "https://me@BAD.org:80/x" if i % 2 else None) for i in range(80)] + [(999, "few words", "http://one.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = host_rules.host_quality(docs)
    assert got.filter("not kept and not base_failed").count() > 50
    assert_same(got.selectExpr("* except (host_rate)", "round(host_rate, 6) AS host_rate"), con, OP3)


def test_bad_hosts_go_and_small_ones_are_not_judged_alone(spark):
    rng = random.Random(2)
    good = lambda: prose(rng, 60)
    junk = lambda: " ".join("#" + w for w in prose(rng, 60).split())
    rows = [(i, good(), f"http://h{i % 8}.org/{i}") for i in range(400)] + [(400 + i, junk() if i % 10 else good(), "http://BAD.org/x") for i in range(60)] + [(999, junk(), "http://one.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in host_rules.host_quality(docs).collect()}
    assert all(out[i].kept for i in range(400)) and out[999].host == "one.org" and out[400].host == "bad.org"
    assert not any(out[400 + i].kept for i in range(60))
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    a, b = host_rules.beta_prior(0, None, None, None, host_rules.HostLimits())
    assert a == b == 1.0


# 10 and 6


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_counts(docs, rows, none):
    lib = library()
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 2048) for r in rows for n in [len(lib.encode(r[1] or "", add_special_tokens=False).ids)])
    for entries in (8192, 5):
        assert Counter(map(tuple, token_counts.token_counts(docs, vocabulary(), entries=entries).collect())) == want
    assert token_counts.token_counts(none, vocabulary()).count() == 0


def test_words_encode_as_in_the_library():
    from keyfold.llm.tokens import encoder

    rng, lib, e = random.Random(3), library(), encoder(vocabulary())
    pool = [chr(c) for c in range(33, 400)] + list("aeiou'strnd.,0123") * 40 + ["中", "ß", "İ", "é", " ", "<|endoftext|>"]
    made = list({"".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(20000)})
    made = [w for w in made if w.encode().split() == [w.encode()]]
    assert e.table is not None
    for w, ids in zip(made, e.encode([w.encode() for w in made])):
        assert ids.tolist() == lib.encode(w, add_special_tokens=False).ids, w


def test_packing(docs, rows, none):
    lib = library()
    want = Counter()
    for r in rows:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[r[0], k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    for chunk in (100_000, 7):
        got = packing.pack(docs, vocabulary(), limit=256, chunk=chunk).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 256
        total = sum(r.length for r in got)
        assert len(bins) <= total / 256 * 1.1 + 2
    assert packing.pack(none, vocabulary()).count() == 0


def test_best_fit():
    rng = random.Random(4)
    items = [(rng.randint(1, 100), (i,)) for i in range(500)]
    bins = packing.best_fit(items, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(items[i][0] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.02 * sum(n for n, _ in items) / 100 + 1


# 8


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: 3 * sizes[s] for s in above}


def test_mixing(docs, rows, none, monkeypatch):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    first = None
    for bucket in (mixing.BUCKET, 3):
        monkeypatch.setattr(mixing, "BUCKET", bucket)
        got = mixing.mix(docs).collect()
        first = first or sorted(map(tuple, got), key=str)
        assert sorted(map(tuple, got), key=str) == first
    assert len(got) == len(rows)
    by_size = {sizes[s]: want[s] for s in sizes}
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        assert (r.finish is None) == (r.size == 0) and (not r.size or 0 < r.finish <= r.source_size / r.target)
    assert sum(r.taken for r in got) <= sum(sizes.values())
    assert mixing.mix(none).count() == 0
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    out = mixing.take_mixed(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == +taken


@pytest.mark.parametrize("bucket", [mixing.BUCKET, 20])  # the small one spreads the rows of one key
def test_mixing_cuts_between_rows_that_repeat(spark, monkeypatch, bucket):
    """A third of all rows are one row without an id; targets are met all the same, and the stage takes as many."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = [(None, "one two three", "a")] * 400 + [(i, "w " * (i % 7 + 1), "b" if i % 2 else "c") for i in range(700)] + [(1, "w w", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=str)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - t) < 20 for s, t in target.items())
    copies = Counter()
    for r in got:
        copies[r.doc_id, r.size] += r.taken // r.size
    assert Counter((r.doc_id, len(words(r.text))) for r in mixing.take_mixed(docs).collect()) == +copies


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 40), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - t) < 100 for s, t in target.items())


# 4


def brute_components(rows, percent=85, size=5):
    """Each row's key, shingles, and the least key that it is linked with."""
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOW))
        sets.append((key(r), frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, s) in enumerate(sets):
        for j, (_, t) in enumerate(sets[:i]):
            n = len(s & t)
            if s and t and 100 * n >= percent * len(s | t):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(k, s, least[find(i)]) for i, (k, s) in enumerate(sets)]


def test_near_components(docs, rows, none, monkeypatch):
    found = brute_components(rows)
    want = Counter((None if k[0] else k[1], len(s), None if c[0] else c[1], c == k) for k, s, c in found)
    for group, members, crowd in ((near_dedup.GROUP, near_dedup.MEMBERS, near_dedup.CROWD), (150, 3, 2)):  # the small ones deal groups into blocks
        monkeypatch.setattr(near_dedup, "GROUP", group)
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        monkeypatch.setattr(near_dedup, "CROWD", crowd)
        assert Counter(map(tuple, near_dedup.near_components(docs).collect())) == want
    assert near_dedup.near_components(none).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(None if k[0] else k[1] for k, _, c in found if c == k)


def test_groups_in_blocks_lose_no_link(spark, monkeypatch):
    """Chains of near copies, each like the next only, and crowds around a text: candidates find them, and blocks, their
    representatives and what meets in the end link just what brute force links."""
    rng = random.Random(12)
    rows, n = [], 0
    for chain in range(6):
        w = prose(rng, 150).split()
        for _ in range(60):
            w = list(w)
            for _ in range(rng.choice([1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"n{n}x{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    base = prose(rng, 150).split()
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"n{n}"
        rows.append((n, " ".join(w)))
        n += 1
    rng.shuffle(rows)
    want = {k[1]: c[1] for k, _, c in brute_components(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for members in (250, 7):
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs).collect()}
        missed = sum(got[i] != c for i, c in want.items())
        assert missed == 0, missed


def test_regions_hold_no_table_of_their_members_and_new_leaders():
    rng = np.random.default_rng(3)
    copy, n = rng.integers(0, 256, near_dedup.SLOTS, np.uint8), 600
    sig = np.concatenate([np.tile(copy, (n, 1)), rng.integers(0, 256, (n, near_dedup.SLOTS), np.uint8)])
    sig[n + 1 :: 2, : near_dedup.MAYBE] = copy[: near_dedup.MAYBE]  # every second one may be linked with the copies
    region, keys = near_dedup.Region(), [b"same key"] * 2 * n
    tracemalloc.start()
    region.take(list(range(2 * n)), keys, sig)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    a, b = region.sets.links()
    assert sorted({*a, *b}) == [*range(n), *range(n + 1, 2 * n, 2)] and len(a) == n + n // 2 - 1
    assert region.ids == [0, *range(n, 2 * n)]


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


# 5


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body><header>Site head</header><nav><ul><li><a href=x>Menu one</a></li></ul></nav>
    <div class="ad banner">Buy now please <div>inner</div></div><article><header><h1>Big &amp; title</h1></header><p>First  <b>bold</b>\n text &lt;b&gt; &copy; one two three.<br>
    <p>Second <a href=y>link</a> para with words.<aside>Side note</aside><form><label>Your mail</label><input></form><ul><li>item one</li><li>item two</li></ul><div class="comments"><p>A reader says so</p></div>
    <p>Last para of it. <!-- hidden > --></p></article><div id="cookie-notice">We use cookies here</div><footer>&copy; me</footer></body></html>"""
    want = "Big & title\nFirst bold text <b> © one two three.\nSecond link para with words.\nitem one\nitem two\nLast para of it."
    plain = "<body><div id=nav><a>x</a></div><div class=story><p>One two three four five six</p><p>seven eight nine</p></div><div class=footer>bye bye</div>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", plain), (5, "u", "<p>cut <b>off</b> in a ta<b"), (6, None, "no tags at all 1 < 2"), (None, "u", plain), (7, "u", "<article><p>" + "word " * 50000 + "</p"), (8, "u", "<script>only")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = {r.page_id: r.text for r in got.collect()}
    assert out[1] == want and out[2] == out[3] == out[8] == "" and out[4] == out[None] == "One two three four five six\nseven eight nine"
    assert out[5] == "cut off in a ta" and out[6] == "no tags at all 1 < 2" and len(out[7]) == 249999
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert html_extract.extract(got.sparkSession.createDataFrame([], "page_id long, url string, html string")).count() == 0



def hidden(html):
    """A page without its markers and the names of its elements."""
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|main)\b", r"<\1div", html))


def test_html_region_comes_from_the_scan():
    """Held-out pages with their markers hidden: what is inside the marker is found, and not without the scan."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    weights = html_extract.fit(pages[::2])
    assert all(w <= 0 for w in weights.tags.values())

    def f1(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))

    found, whole, differ = [], [], 0
    for p in pages[1::2]:
        inner = re.search(r"<article>(.*)</article>", p, re.DOTALL)
        assert inner
        want = html_extract.main_text(inner[1], html_extract.NONE, scan=False)
        got, off = html_extract.main_text(hidden(p), weights), html_extract.main_text(hidden(p), weights, scan=False)
        found.append(f1(got, want))
        whole.append(f1(off, want))
        differ += got != off
        assert html_extract.main_text(p, weights) == want
    assert differ == len(found) and np.mean(found) > 0.99 > 0.975 > np.mean(whole)


def test_best_region_is_that_of_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        scores = [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 14))]
        start, stop = html_extract.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:stop]) == max(best, 0) and (best > 0) == (stop > start)
        if best > 0:  # the first of equals that doesn't begin with a stretch of no gain
            assert start == min(i for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if sum(scores[i:j]) == best and all(sum(scores[i:k]) > 0 for k in range(i + 1, j + 1)))


def test_html_takes_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        for page in ("<div>x" * n + "</section>" * n, "<td>x" * n + "</table>" * n, "<div><p class='a" * n, "<a " * n):
            html_extract.main_text(page, html_extract.NONE)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16000) < 24 * max(seconds(2000), 0.02)


def test_html_rows_are_rows_whatever_else_they_have(spark):
    rows = [(i, None, f"<nav>a b</nav><article><p>text {(i or 0) % 3} of the page</p></article>", "x", "y") for i in (1, 1, 2, 3, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(r.page_id for r in got.collect()) == {1: 2, 2: 1, 3: 1, None: 1} and {r.text for r in got.collect() if r.page_id == 1} == {"text 1 of the page"}


# 1


def test_language_id(docs, rows, none):
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    assert {r.held_out for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    by = {r.doc_id: r for r in got}
    assert by[75].lang_pred == by[76].lang_pred == by[77].lang_pred == "und" and by[75].score == 0.0
    assert all(0 <= r.score <= 1 for r in got)
    long = [r for r in got if r.doc_id is not None and r.doc_id < 60]
    assert np.mean([r.lang_pred == ("en" if r.doc_id % 3 else "fr") for r in long]) > 0.95
    assert language_id.identify(none).count() == 0


def test_language_samples_are_even(spark):
    """Shares at any size, rows without ids, and languages of very different sizes."""
    assert language_id.share_of(10**9, 500) == (1000 << 62) // 10**9 > 0 < language_id.share_of(10**15, 500) and language_id.share_of(3, 500) == 1 << 62
    rng = random.Random(4)
    rows = [(None, prose(rng, 30, "fr"), "aa")] * 3 + [(None, prose(rng, 30, "fr"), "aa") for _ in range(900)] + [(i, prose(rng, 30), "zz") for i in range(60)] + [(9000 + i, "xyz " * 20, f"l{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels, langs = language_id.sample_windows(docs, 40, 2, 256)
    n = Counter(langs[k] for k in labels)
    assert n["aa"] == n["zz"] == 80 and len(set(texts)) > 100
    assert language_id.sample_windows(docs, 40, 2, 2)[2] == ["aa", "zz"]
    got = language_id.identify(docs.filter("lang in ('aa', 'zz')"), per_lang=40).collect()
    assert np.mean([r.lang_pred == ("aa" if r.doc_id is None else "zz") for r in got]) > 0.95
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_restarts_cost_little(docs, rows):
    """States start anew in each segment; with segments 8 times as long the labels of texts are the same."""
    texts = [r[1].encode() for r in rows[:60]] + [(rows[2][1] + " ").encode() * 20]
    m = language_id.train(*language_id.sample_windows(docs, 500, 6, 256))
    short, n = language_id.pooled(m, texts), language_id.SEGMENT
    try:
        language_id.SEGMENT = 8 * n
        assert (language_id.pooled(m, texts).argmax(1) == short.argmax(1)).mean() > 0.98
    finally:
        language_id.SEGMENT = n


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = language_id.train([b"ab", b"cd"], [0, 1], ["x", "y"], steps=1)
    codes = rng.integers(97, 101, (6, 4)).astype(np.int32)
    codes[4:, 1] = language_id.PAD
    target = np.array([0, 1, 1, 0])
    m = language_id.BiGRU(m.langs, *(p.astype(np.float64) for p in m.params()))
    _, grads = language_id.gradients(m, codes, target)
    for p, g in zip(m.params(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p is m.x:
                at = (at[0], int(codes[0, 0]), at[2])
            old = p[at]
            losses = []
            for step in (1e-2, -1e-2):
                p[at] = old + step
                losses.append(language_id.gradients(m, codes, target)[0])
            p[at] = old
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-3)


# 9


def test_lm_scores(docs, rows, none, monkeypatch):
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10]
    tokens = lambda t: [*words((t or "").translate(LOW)), ""]
    counts = Counter(w for r in train for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted(((r[0] is None, r[0] or 0), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), n, round(base(r[1]), 3)) for r in rows)
    fitted, fit = [], lm_scoring.fit
    for kept, top, least, share in ((131_072, 63, 2, 2_000_000), (40, 10, 1, 400)):  # the small share trains in several tasks
        monkeypatch.setattr(lm_scoring, "fit", lambda *a, s=share: fitted.append(fit(*a, s)) or fitted[-1])
        got = lm_scoring.score(docs, kept=kept, top=top, classes=8, least=least).collect()
        assert [x[:4] for x in sorted((key(r), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got)] == [x[:4] for x in want]
        assert np.allclose(sorted(r.base_score for r in got), sorted(base(r[1]) for r in rows))
        assert sum(r.score for r in got) > sum(r.base_score for r in got)
        again = plain_scorer(fitted[-1][0], counts, n, v)
        by_id = {r.doc_id: r.score for r in got}
        for r in rows[:12] + rows[60:64] + rows[75:79]:
            assert by_id[r[0]] == pytest.approx(again(tokens(r[1])), rel=1e-4), r
    assert lm_scoring.score(none).count() == 0


def plain_scorer(scorer, counts, n, distinct):
    """The log10 probability of tokens, word by word, from a model's numbers and the words' counts."""
    v, m = scorer.v, scorer.m
    node_of = {w: int(v.node[i]) for w, i in v.words.items()}
    node = lambda w: node_of[w.encode()] if w.encode() in node_of else v.other(w.encode())
    own = {w for w in counts if w.encode() in node_of and (w == "" or node_of[w.encode()] != v.other(w.encode()))}
    rest = Counter()
    for w, c in counts.items():
        if w not in own:
            rest[node(w)] += c + 0.1

    def chosen(h, vectors, biases, k):
        s = [float(np.dot(h, q)) + float(b) for q, b in zip(vectors, biases)]
        return s[k] - max(s) - np.log(sum(np.exp(x - max(s)) for x in s))

    def total(tokens):
        nodes, out = [node("")] * lm_scoring.CONTEXT, 0.0
        for w in tokens:
            h = sum(m.r[nodes[-1 - j]] @ m.c[j] for j in range(lm_scoring.CONTEXT))
            k = node(w)
            c = int(v.kind[k])
            a, b = int(v.starts[c]), int(v.starts[c + 1])
            out += (chosen(h, m.q, m.b, c) + chosen(h, m.qw[a:b], m.bw[a:b], k - a)) / np.log(10)
            if w not in own:
                out += np.log10((counts[w] + 0.1) / (rest[k] + 0.1))
            nodes.append(k)
        return out

    return total


@pytest.mark.parametrize("scale", [1.0, 60.0])  # numbers of the larger one overflow unless they are shifted
def test_log_softmax(scale):
    rng = np.random.default_rng(1)
    h, q, b = (rng.standard_normal(s).astype(np.float32) * scale**0.5 for s in ((2500, 5), (40, 5), (40,)))
    index = rng.integers(0, 40, 2500)
    s = h.astype(np.float64) @ q.T + b
    want = s[np.arange(2500), index] - s.max(1) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1))
    rows, norm = np.concatenate([h, np.ones((2500, 1), np.float32)], 1), float(np.sqrt((h * h).sum(1).max() + 1))
    got = lm_scoring.Products(q, b).log_softmax(rows, index, norm, np.empty(8000, np.float32))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4 * scale)


def test_lm_probabilities_sum_to_one(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, 60, "en" if i % 2 else "fr")) for i in range(120)], "doc_id long, text string")
    scorer, counts = lm_scoring.fit(docs, 60, 40, 6, 4, 3)
    v, nodes = scorer.v, np.arange(scorer.v.nodes)
    for _ in range(20):
        before = [np.full(v.nodes, rng.randrange(v.nodes)) for _ in range(lm_scoring.CONTEXT)]
        assert (10 ** scorer.log_probabilities(nodes, before)).sum() == pytest.approx(1, abs=1e-4)
    mass = np.zeros(v.nodes)
    unseen = 10 ** v.log10(0)
    for r in counts.collect():
        w = r.word.encode()
        k = lm_scoring.nodes_of([w], lm_scoring.numbered([w], v.words), v)[0]
        mass[k] += 10 ** (v.log10(r.c) - scorer.share[k])
    last = v.starts[v.singles + 1 :] - 1
    mass[last] += unseen / 10 ** scorer.share[last]
    assert np.allclose(mass, 1)


def test_lm_learns_what_follows_what(spark):
    """Words that only follow each other become likely after each other, on texts not learned from."""
    rng = random.Random(10)
    text = lambda: " ".join(w for _ in range(60) for w in rng.choice([["aa", "bb", "cc"], ["dd", "ee"], ["ff", "gg", "hh", "ii"]]))
    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    got = [r for r in lm_scoring.score(docs, top=2, classes=2, least=5).collect() if r.held_out]
    assert sum(r.score for r in got) / sum(r.base_score for r in got) < 0.7


def test_lm_learns_from_every_position(spark, monkeypatch):
    """Each token of each training text, its end too, is a draw after the words before it, in long texts and short ones."""
    rng = random.Random(11)
    texts = [None, "", "A", *(prose(rng, n, "en") for n in (1, 2, 5, 31, 32, 33, 400)), *(prose(rng, 9, "fr") for _ in range(30))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    seen, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda draws, v, *a: seen.append((draws.toArrow(), v)) or train(draws, v, *a))
    lm_scoring.fit(docs, 1000, 40, 6, 4, 2)
    (rows, v), ends = seen[0], [""] * lm_scoring.CONTEXT
    tokens = [[*words((t or "").translate(LOW)), ""] for t in learned]
    assert sum(rows["n"].to_pylist()) == sum(map(len, tokens)) == v.total
    nodes = lambda ws: tuple(lm_scoring.nodes_of(b := [w.encode() for w in ws], lm_scoring.numbered(b, v.words), v).tolist())
    want = Counter(nodes((ends + t)[i : i + lm_scoring.CONTEXT + 1]) for t in tokens for i in range(len(t)))
    batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else t.encode() for t in learned], pa.binary())], names=["text"])
    for piece in (7, 50, 8192):
        monkeypatch.setattr(lm_scoring, "PIECE", piece)
        held = [r for out in lm_scoring.drawn(iter([batch]), SimpleNamespace(value=v)) for r in zip(out["draws"].to_pylist(), out["sizes"].to_pylist())]
        got, live = lm_scoring.windows(held)
        assert Counter(tuple(got[i, j : j + lm_scoring.CONTEXT + 1].tolist()) for i, j in zip(*np.nonzero(live))) == want


def test_lm_tokens_are_those_of_bytes():
    """Texts are split in Arrow as Python splits their bytes, also where these aren't UTF-8, and counted so."""
    texts = [None, b"", b" ", b"A", b"a b ", b"\x0bA\x0cb\tc\nd\re  f\x00 ", b"\x1ca\x1d b\x1f \x85 c\xc2\xa0d", "É é ſ K\u2003x".encode(), b"\xff\xfe Z \xc3", b"x" * 70 + b" y"]
    want = [[*(t or b"").lower().split(), b""] for t in texts]
    column = pa.array([b"no", *texts], pa.binary())
    tokens, sizes = lm_scoring.tokens_of(column[1:])
    assert (lm_scoring.bytes_of(tokens), sizes.tolist()) == ([w for t in want for w in t], [len(t) for t in want])
    batch = pa.RecordBatch.from_arrays([column[1:]], names=["text"])
    got = [r for b in lm_scoring.counted(iter([batch, batch])) for r in zip(lm_scoring.bytes_of(b["word"]), b["c"].to_pylist())]
    assert len(got) == len(dict(got)) and dict(got) == {w: 2 * c for w, c in Counter(w for t in want for w in t).items()}


def test_lm_counts_leave_a_task_when_many(monkeypatch):
    monkeypatch.setattr(lm_scoring, "COUNTED", 5)
    batch = [pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k}" for k in range(i, i + 7)).encode()], pa.binary())], names=["text"]) for i in range(20)]
    got = [(w, c) for b in lm_scoring.counted(iter(batch)) for w, c in zip(b["word"].to_pylist(), b["c"].to_pylist())]
    want = Counter(f"w{k}" for i in range(20) for k in range(i, i + 7)) + Counter({"": 20})
    assert len(got) > len(want) and sum((Counter({w: c}) for w, c in got), Counter()) == want


def test_lm_last_round_sends_no_past():
    """Step sizes of a round that none follows aren't shuffled: its rows have the model's numbers and no others."""
    v, mass, m, past = lm_toy(6)
    nodes = np.arange(v.nodes, dtype="<u2")
    batch = pa.RecordBatch.from_arrays([pa.array([nodes.tobytes()]), pa.array([np.array([len(nodes) - lm_scoring.CONTEXT], "<u4").tobytes()]), pa.array([len(nodes) - lm_scoring.CONTEXT])], names=["draws", "sizes", "n"])
    for round_no, times in ((0, 2), (lm_scoring.ROUNDS - 1, 1)):
        rows = [r for b in lm_scoring.trained(iter([batch]), SimpleNamespace(value=(v, mass, m.flat, past.flat)), round_no, 64) for r in b["v"].to_pylist()]
        assert sum(map(len, rows)) == times * m.flat.nbytes


@pytest.mark.parametrize("n, most", [(1, 1), (40, 3), (5000, 300), (70_000, 20_000)])
def test_lm_sums_of_rows(n, most):
    rng = np.random.default_rng(n)
    index, grad, times = (most * rng.random((n, 5)) ** 3).astype(np.uint16).ravel(), rng.standard_normal((n, 3)).astype(np.float32), rng.standard_normal(5 * n).astype(np.float32)
    for some, factors in ((index[:n], None), (index, times)):
        rows, got = lm_scoring._sums(grad, some, factors)
        want = np.zeros((most, 3))
        np.add.at(want, some, grad if factors is None else np.repeat(grad, 5, axis=0) * factors[:, None])
        assert sorted(rows.tolist()) == sorted(set(some.tolist()))
        assert np.allclose(got, want[rows], atol=1e-2)


def lm_toy(seed):
    best = [(b"", 50), *((b"w%d" % i, 40 - i) for i in range(30))]
    v = lm_scoring.vocabulary(best, 25, 4, 3, 1, sum(c for _, c in best), len(best))
    mass = np.random.default_rng(seed).random(v.nodes) * 9 + 0.1
    m = lm_scoring.start(v, mass)
    m.flat[:] += np.random.default_rng(seed).standard_normal(len(m.flat)).astype(np.float32) * 0.1
    past = lm_scoring.Model(v.nodes, len(v.starts) - 1, np.full(len(m.flat), 0.01, np.float32))
    return v, mass, m, past


def test_lm_step_sums_overlapping_windows():
    """A step of windows does what one of each draw by itself does."""
    context, rng = lm_scoring.CONTEXT, np.random.default_rng(3)
    after = []
    for alone in (False, True):
        v, mass, m, past = lm_toy(4)
        rng = np.random.default_rng(3)
        nodes = rng.integers(0, v.nodes, (5, context + 8)).astype(np.uint16)
        live = rng.random((5, 8)) < 0.8
        if alone:
            i, j = np.nonzero(live)
            nodes, live = np.stack([nodes[a, b : b + context + 1] for a, b in zip(i, j)]), np.ones((len(i), 1), bool)
        before = m.flat.copy()
        lm_scoring.Trainer(m, past, v, mass, 9).step(nodes, live, 0.05)
        after.append(m.flat)
        assert not np.allclose(m.flat, before)
    assert np.allclose(after[0], after[1], atol=1e-5)


def test_lm_noise_has_the_shares_of_its_class():
    v, mass, _, _ = lm_toy(5)
    stays, instead = lm_scoring.aliases(mass, v.starts)
    size = np.diff(v.starts)[v.kind]
    got = (stays + np.bincount(instead, weights=1 - stays, minlength=v.nodes)) / size
    assert np.allclose(got, mass / np.add.reduceat(mass, v.starts[:-1])[v.kind])
    assert (v.kind[instead] == v.kind).all()


# 7


def call(i, name, **arguments):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments}) + "</tool_call>"


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


SCHEMAS = {"add": {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "number"}}, "required": ["x"], "additionalProperties": False}}


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "Hé \"quoted\"\n"), (1, 1, "assistant", "let me " + call("a", "add", y=2, x=1)), (1, 3, "tool", result("a", {"b": 1, "a": [2.0]})),
        (1, 2, "assistant", call("b", "add", x={"$result": "a"})), (1, 4, "tool", result("b", "ok")), (1, 5, "assistant", call("a", "add", x=1) + call("c", "add", z=1) + call("d", "mul", x=1) + "<tool_call>{bad</tool_call>"),
        (1, 6, "tool", result("zzz", 1)), (1, 7, "tool", "not json"),
        (2, 0, "assistant", call("p", "add", x={"$result": "q"})), (2, 1, "assistant", call("q", "add", x={"$result": "p"})), (2, 2, "tool", result("p", 1)), (2, 3, "tool", result("q", 1)),
        (3, 0, "assistant", call("m", "add", x=1)), (3, None, None, None), (None, 0, "user", ""), (3, 9, "tool", result("n", 5)), (3, 10, "assistant", call("n", "add", x=2)),
    ]
    got = chat_format.format_chats(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, calls string"), SCHEMAS).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    for r in got:
        parsed = json.loads(r.json)
        assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    status = lambda c, t: [x["status"] for x in json.loads(by[c, t].json)["calls"]]
    assert status(1, 1) == ["ok"] and status(1, 2) == ["ok"] and status(1, 5) == ["duplicate_id", "invalid_arguments", "unknown_tool", "malformed"]
    assert status(2, 0) == status(2, 1) == ["cycle"] and status(3, 0) == ["missing_result"] and status(3, 10) == ["ok"]
    assert json.loads(by[1, 3].json)["content"] == {"a": [2.0], "b": 1} and json.loads(by[1, 1].json)["content"] == "let me"
    # b asks for a's result of turn 3, so it comes after it; its own result after that
    place = lambda c, t: (by[c, t].order_turn, by[c, t].order_step)
    assert place(1, 1) < place(1, 3) < place(1, 2) < place(1, 4) and place(3, 10) < place(3, 9)
    assert by[1, 3].result_linked and by[1, 4].result_linked and not by[1, 6].result_linked and by[1, 7].result_linked is None and by[3, 9].result_linked
    assert by[1, 1].n_calls == by[1, 1].n_ok == 1 and by[1, 5].n_calls == 4 and by[1, 5].n_ok == 0 and by[3, None].json == '{"content":"","role":null,"turn":null}'
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_chats(rows, schemas):
    """Counter of the results for rows (conv_id, turn, role, text), conversation by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        at = lambda r: (r[1] is None, r[1] or 0, digest(r))
        parsed = {r: chat_format.parse(r[2], r[3], schemas) for r in own}
        heads, answers = {}, {}
        for r in sorted(set(own), key=at):
            for k, c in enumerate(parsed[r][1]):
                if c["problem"] != "malformed":
                    heads.setdefault(c["id"], (r, k, c))
            if parsed[r][2] is not None:
                answers.setdefault(parsed[r][2], r)
        needs = {i: c["refs"] for i, (_, _, c) in heads.items()}
        facts = {}
        left = set(heads)
        while True:
            ready = [i for i in left if all(n in facts or n not in heads for n in needs[i])]
            if not ready:
                break
            for i in ready:
                turn, has = heads[i][0][1], answers.get(i)
                known = [facts[n] for n in needs[i] if n in heads]
                level = max([f[0] for f in known] + [0 for n in needs[i] if n not in heads], default=-1) + 1
                before = max((x for x in [turn, *(f[2] for f in known)] if x is not None), default=None)
                after = max((x for x in [before, has[1] if has else None] if x is not None), default=None)
                facts[i] = (level, before, after, has is not None and all(n in heads and facts[n][3] for n in needs[i]))
            left -= set(ready)
        top = lambda *xs: max((x for x in xs if x is not None), default=None)
        for r in own:
            content, calls, result_of = parsed[r]
            shown, n_ok, turns, levels = [], 0, [], []
            for k, c in enumerate(calls):
                head = c["problem"] != "malformed" and heads[c["id"]][:2] == (r, k)
                fact = facts.get(c["id"]) if head else None
                if head and fact:
                    turns.append(fact[1])
                    levels.append(fact[0])
                status = "malformed" if c["problem"] == "malformed" else "duplicate_id" if not head else c["problem"] or ("cycle" if not fact else "ok" if fact[3] else "missing_result")
                n_ok += status == "ok"
                shown.append(f'{{"arguments":{c["arguments"]},"id":{c["id"] or "null"},"name":{c["name"] or "null"},"status":"{status}"}}')
            step, of_turn, linked = 2 * max(levels) if levels else 0, None, None
            if result_of is not None:
                linked = result_of in heads and answers[result_of] == r
                if result_of in heads:
                    f = facts.get(result_of)
                    of_turn, step = (f[1] if f else None), 2 * (f[0] if f else 0) + 1
            line = "{" + (f'"calls":[{",".join(shown)}],' if calls else "") + f'"content":{content},"role":{json.dumps(r[2], ensure_ascii=False)}' + (f',"tool_call_id":{result_of}' if result_of is not None else "") + f',"turn":{json.dumps(r[1])}}}'
            out.append((r[0], r[1], r[2], top(r[1], *turns, of_turn), step, len(calls), n_ok, linked, line))
    return Counter(out)


def digest(r):
    import hashlib

    part = lambda x: "-" if x is None else f"{len(str(x))}:{x}"
    return hashlib.sha256("".join(map(part, r[1:])).encode()).hexdigest()


def test_tool_calls_as_brute_force_has_them(spark):
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(60)]:
        ids = [f"c{i}" for i in range(rng.randint(1, 25))] + ["\ud800", "\\ud800", 'é"']
        for turn in range(rng.randint(5, 60)):
            turn = rng.choice([turn, turn, turn, None])
            kind = rng.random()
            if kind < 0.5:
                calls = []
                for _ in range(rng.randint(1, 3)):
                    refs = {k: {"$result": rng.choice([*ids, "none"])} for k in rng.sample("xyz", rng.choice([0, 0, 1, 1, 2]))}
                    calls.append("<tool_call>" + json.dumps({"id": rng.choice(ids), "name": rng.choice(["add", "add", "add", "mul"]), "arguments": {"x": 1, **{k: v for k, v in refs.items() if k != "z"}}}) + "</tool_call>")
                rows.append((conv, turn, "assistant", "say " + "".join(calls)))
            elif kind < 0.9:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "none"]), "content": rng.choice([1, "a", None, {"b": [2.5]}, "\udfff"])})))
            else:
                rows.append((conv, turn, rng.choice(["user", None]), rng.choice([None, "", "hi\n\"there\""])))
    chain = [(1000, 2 * i, "assistant", call(f"n{i}", "add", x={"$result": f"n{i - 1}"} if i else 1)) for i in range(40)] + [(1000, 2 * i + 1, "tool", result(f"n{i}", i)) for i in range(40)]
    ring = [(1001, i, "assistant", call(f"n{i}", "add", x={"$result": f"n{(i + 1) % 7}"})) for i in range(7)] + [(1001, 9, "assistant", call("m", "add", x={"$result": "n3"}, y={"$result": "k"})), (1001, 10, "assistant", call("k", "add", x=1))]
    diamonds = [(1002, i, "assistant", call(f"n{i}", "add", x={"$result": f"n{max(0, i - 1)}"}, y={"$result": f"n{max(0, i - 2)}"}) if i else call("n0", "add", x=1)) for i in range(12)]
    rows += chain + ring + diamonds + rng.sample(chain, 5) + rng.sample(rows, 50)
    for text in ("NaN", "1e999", "-Infinity"):
        rows += [(1003, 1, "assistant", '<tool_call>{"id": "a", "name": "add", "arguments": {"x": ' + text + "}}</tool_call>"), (1003, 2, "tool", '{"tool_call_id": "a", "content": ' + text + "}")]
    rows.append((1004, 1, "assistant", call("a", "add", x=1) + "word " * 50000))
    rng.shuffle(rows)
    got = chat_format.format_chats(spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, msg string, k int").repartition(4), SCHEMAS).collect()
    assert Counter(map(tuple, got)) == brute_chats(rows, SCHEMAS)
    for r in got:
        parsed = json.loads(r.json, parse_constant=lambda c: pytest.fail(c))
        assert chat_format.canonical(parsed) == r.json
    status = {(r.conv_id, r.turn): [c["status"] for c in json.loads(r.json).get("calls", [])] for r in got}
    assert status[1000, 78] == ["ok"] and status[1001, 0] == status[1001, 9] == ["cycle"] and status[1003, 1] == ["malformed"]


def test_schemas_that_cannot_be_read_raise_at_once(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for schema in ({"properties": {"a": {"pattern": "("}}}, {"type": "text"}, {"items": 3}):
        with pytest.raises(ValueError):
            chat_format.format_chats(rows, {"t": schema})


@pytest.mark.parametrize(
    ("value", "schema", "ok"),
    [
        (1, {"type": "integer"}, True), (1.5, {"type": "integer"}, False), (True, {"type": "number"}, False), ("a", {"enum": ["a", 1]}, True), (2, {"enum": ["a", 1]}, False), ([1, "x"], {"items": {"type": "integer"}}, False),
        ([1], {"minItems": 2}, False), ("abc", {"pattern": "^b"}, False), (5, {"maximum": 4}, False), ({"a": 1}, {"additionalProperties": {"type": "string"}}, False), (None, {"type": ["null", "string"]}, True), ({"$result": "x"}, {"type": "string"}, True),
    ],
)
def test_schemas(value, schema, ok):
    assert chat_format.valid(value, schema) is ok

