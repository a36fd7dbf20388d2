"""URL filters, spelling variants and conversation tries against brute force and held-out labels, and the registered queries against SQL."""

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check import TABLES, check  # noqa: E402

from chronolith.llm import queries, spelling, trie, url_filter  # noqa: E402

SMALL = "/root/testdata/sf0.001"
RULES = queries.URL_RULES


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_conversation_trie"])
def test_registered_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    state, n, *_, note = check(spark, con, name, SMALL)
    assert state == "ok" and n > 0, note


# --- url filters ----------------------------------------------------------------


def plain_rule(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host) + len(r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.trained(url_filter.labelled_urls(spark))


def test_rules_and_odd_addresses(spark, model):
    urls = [
        "http://www.example.com/en/1", "http://WWW.Example.COM/en/1?x=/de/", "https://m.example.com/en/", "https://m.example.com/fr/2", "https://other.com", "https://other.com/",
        "http://a.net/es/x", "http://net/fr/", "http://planet/fr/", "http://a.net?u=/fr/", "http://a.net#/es/", "a.net/es/", "", None, "://", "http://://x/y", "http://x.com:80/en/",
        "http://é.net/fr/ü", "x://" + "y" * 30_000 + "/" + "z" * 200_000, "http://a.net/es/x",
    ]
    frame = spark.createDataFrame([(i, u, "old", i) for i, u in enumerate(urls)], "page_id int, url string, filter string, _host int")
    got = url_filter.judged(frame, RULES, model).orderBy("page_id").collect()
    assert [r.url for r in got] == urls and [r["_host"] for r in got] == list(range(len(urls)))
    for r in got:
        host, path, rule, verdict = plain_rule(r.url, RULES)
        assert (r.filter.host, r.filter.path, r.filter.rule) == (host, path, rule)
        assert r.filter.verdict == (verdict or ("block" if r.filter.score >= 0.5 else "allow"))
    assert url_filter.judged(frame.limit(0), RULES, model).count() == 0


def test_model_is_the_minimum_of_the_penalised_loss(spark, model):
    """The weights found make the gradient of the loss, computed apart, vanish."""
    import numpy as np

    grams = lambda c, kind: url_filter._grams(c, kind)
    rows = url_filter.labelled_urls(spark)
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    data = rows.select(grams(host, "h").alias("h"), grams(path, "p").alias("p"), "label", "url").collect()
    x = np.zeros((len(data), url_filter.BUCKETS + 1))
    for i, r in enumerate(data):
        np.add.at(x[i], r.h, url_filter.HOST_SHARE)
        np.add.at(x[i], r.p, url_filter.PATH_SHARE / math.sqrt(max(1, len(r.p))))
        x[i, -1] = 1
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url)
        assert len(r.h) == sum(max(0, len(m[1]) + 3 - n) for n in url_filter.SIZES) and len(r.p) == sum(max(0, len(m[2]) + 3 - n) for n in url_filter.SIZES)
    w = np.array([*model.weights, model.bias])
    p = 1 / (1 + np.exp(-x @ w))
    slope = x.T @ (p - np.array([r.label for r in data])) / len(data) + url_filter.PENALTY * np.append(w[:-1], 0)
    assert np.abs(slope).max() < 2 * url_filter.SETTLED
    scores = url_filter.judged(rows, [], model).select("url", "filter.score").collect()
    want = dict(zip([r.url for r in data], p))
    assert all(abs(want[r.url] - r.score) < 1e-4 for r in scores)


def test_held_out_addresses(spark, model):
    blocked = ["https://vegas-casino.example.net/en/77", "http://cheap-viagra-pills.example.com/shop", "http://bet-free.example.org/de/12", "http://xxx-adult.example.com/", "https://replica-shop.example.net/fr/1"]
    allowed = ["https://www.botany.example.com/en/77", "http://m.villages.example.net/de/812.html", "https://blog.physics.example.org/es/3", "http://rivers.example.com/fr/1", "https://www.engineering.example.net/en/5#top"]
    frame = spark.createDataFrame([(u, "block") for u in blocked] + [(u, "allow") for u in allowed], "url string, want string")
    wrong = [r.url for r in url_filter.judged(frame, [], model).collect() if r.filter.verdict != r.want]
    assert len(wrong) <= 1, wrong


def test_no_labels(spark):
    empty = url_filter.trained(spark.createDataFrame([(None, 1), ("http://a/", None)], "url string, label int"))
    assert empty.bias == 0 and not any(empty.weights)


# --- spelling variants ------------------------------------------------------------


def edits_apart(a, b):
    """Whether exactly one inserted, deleted or replaced code point turns one word into the other."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_variants(words, ratio):
    out = {}
    for w, n in words.items():
        near = [o for o in words if edits_apart(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        out[w] = (len(near), best if best is not None and words[best] >= ratio * n else None)
    roots = {}
    for w in words:
        at = w
        while out[at][1]:
            at = out[at][1]
        roots[w] = at
    return {(w, n, out[w][0], out[w][1], words[out[w][1]] if out[w][1] else None, roots[w]) for w, n in words.items()}


@pytest.mark.parametrize("letters, lengths", [("ab", (1, 8)), ("abcé", (1, 5)), ("aÿ", (6, 11))])
def test_variants_against_all_pairs(spark, letters, lengths):
    draw = random.Random(len(letters))
    words = {"".join(draw.choices(letters, k=draw.randint(*lengths))): draw.choice([5, 6, 25, 26, 130, 700, 4000]) for _ in range(260)}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = spelling.spelling_variants(frame)
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain_variants(words, 5)
    pairs = spelling.near_pairs(frame).select("a", "b").collect()
    assert len({frozenset(p) for p in pairs}) == len(pairs)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_runs_slips_and_counts(spark):
    texts = ["Straße-straße ÀÉ×÷ x1y_z", None, "", " \n", "Word " * 5000, "word", "don't"]
    rows = [(i if i % 3 else None, t, "w", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, run int")
    runs = spelling.letter_runs(docs)
    want = collections.Counter()
    for i, t, *_ in rows:
        for r in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 2 == 0:
                k = h % len(r)
                r = r[:k] + r[k + 1:]
            want[r] += 1
    got = spelling.word_counts(runs, spelling.slipped(F.col("doc_id"), F.col("run"), 2), shortest=0, least=1)
    assert {r.word: r.n for r in got.collect()} == dict(want)


# --- conversation tries -------------------------------------------------------------


def plain_trie(rebuilt):
    members = collections.defaultdict(list)
    for c, line in rebuilt.items():
        for d in range(len(line) + 1):
            members[line[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own
    out = collections.Counter()
    for p, m in members.items():
        ends = ",".join("null" if c == trie.NO_ID else str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        shown = [None if c == trie.NO_ID else c for c in (min(m), min(members[p[:-1]]))]
        out[(shown[0], len(p), shown[1] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversations_frame(spark):
    draw = random.Random(5)
    lines = {}
    for c in [*range(95, 130), 200, 201, 202, -7, -100, -105, 707, 2**53 + 1]:
        lines[c] = [(draw.choice(["user", "assistant", "", None]), draw.choice(["a", "bb", "", None, "ccc é"])) for _ in range(draw.randint(1, 4))]
    lines[300] = [("user", str(k // 3)) for k in range(150)]
    lines[301] = lines[300] + [("user", "more")]
    lines[302] = lines[301]
    lines[None] = [("user", "0"), ("user", "0")]
    lines[303] = [("user", "x" * 100_000)]
    rows = [(c, None if k == 0 else k, r, t, "z", k) for c, line in lines.items() for k, (r, t) in enumerate(line)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string, pos int").repartition(7)
    return frame, {trie.NO_ID if c is None else c: [(r or "", t or "") for r, t in line] for c, line in lines.items()}


@pytest.mark.parametrize("height", [2, 3, 16])
def test_trie_against_plain_prefixes(spark, height):
    frame, lines = conversations_frame(spark)
    turns = trie.numbered_turns(frame)
    known = F.col("conv") != trie.NO_ID
    base = F.when(known, F.col("conv") - F.col("conv") % 100)
    take = F.when(known, F.crc32(F.col("conv").cast("string").cast("binary")) % 6).otherwise(0)
    rebuilt = {}
    for c, line in lines.items():
        h = 0 if c == trie.NO_ID else zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(lines.get(c - int(math.fmod(c, 100)), [])[:h] + line[h:]) if c != trie.NO_ID else tuple(line)
    got = collections.Counter(tuple(r) for r in trie.prefix_trie(trie.spliced(turns, base, take, 5), height).collect())
    assert got == plain_trie(rebuilt)
    assert any(not line for line in rebuilt.values())


def test_trie_of_nothing_and_small_pieces(spark):
    frame, lines = conversations_frame(spark)
    nothing = trie.spliced(trie.numbered_turns(frame.limit(0)), F.col("conv"), F.lit(0), 5)
    assert trie.prefix_trie(nothing).count() == 0
    same = spark.createDataFrame([(c, 0, "user", "hi") for c in range(50, 80)], "conv_id bigint, turn int, role string, text string")
    members = trie.members_of(trie.spliced(trie.numbered_turns(same), F.lit(None).cast("bigint"), F.lit(0), 1))
    want = hashlib.sha256(",".join(map(str, range(50, 80))).encode()).hexdigest()
    assert [r.ends_sha256 for r in trie.end_digests(members, piece_ids=4).collect()] == [want]
