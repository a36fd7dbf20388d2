"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import ctw, extract, langid, minhash, mixing, mpeg, packing, secret_scan, simhash, substrings

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, fp string, spans string"


def docs_frame(spark, texts, **more):
    rows = [
        (i, t, (more.get("langs") or ["en"] * len(texts))[i], (more.get("sources") or [f"s{k % 3}" if k % 5 else None for k in range(len(texts))])[i], len(t or ""), "x", "y", "z", None)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(draw, n, letters="abcdefgh"):
    return " ".join("".join(draw.choices(letters, k=draw.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    base = [sentence(draw, draw.randint(1, 120)) for _ in range(40)]
    near = [t.replace(" a", " b", 1) for t in base[:8]]
    shared = sentence(draw, 70)
    passages = [sentence(draw, 20) + " " + shared + " " + sentence(draw, 15) for _ in range(4)]
    return [*base, *base[:5], *near, *passages, None, "", " \n\t ", "one", "two words", "ab " * 400, "x" * 900, "é ü ß ñ", "a,b. c!" * 30]


def test_lengths_fit_targets():
    draw = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(draw.sample(range(1, 400), 25)))
        counts = np.array([draw.randint(1, 6) for _ in lengths])
        total = int((lengths * counts).sum())
        target = draw.uniform(0, 3 * total)
        whole, extra = mixing.fit_lengths(lengths, counts, target, 3)
        assert (extra >= 0).all() and (extra <= counts).all() and whole <= 3
        assert abs(whole * total + int((lengths * extra).sum()) - target) <= lengths.min() + 1


def test_knapsack_finds_the_largest_sum():
    lengths, free = np.array([3, 5, 9]), np.array([2, 1, 2])
    sums = {3 * a + 5 * b + 9 * c for a, b, c in itertools.product(range(3), range(2), range(3))}
    for left in range(1, 35):
        taken = mixing.bounded_knapsack(lengths, free, left, np.array([2, 1, 0]))
        assert sum(int(lengths[i]) * k for i, k in taken) == max(s for s in sums if s <= left)
        used = Counter()
        for i, k in taken:
            used[i] += k
        assert all(used[i] <= free[i] for i in used)


def test_mix_targets_and_copies(spark, texts):
    rows = mixing.mixed(docs_frame(spark, texts)).collect()
    again = {(r.doc_id, r.mix.copies) for r in mixing.mixed(docs_frame(spark, texts)).collect()}
    assert len(rows) == len(texts) and {(r.doc_id, r.mix.copies) for r in rows} == again
    by = {}
    for r in rows:
        assert r.mix.size == len((r.text or "").encode().split()) and 0 <= r.mix.copies <= 3
        by.setdefault(r.source, []).append(r.mix)
    total = sum(m.size for ms in by.values() for m in ms)
    assert math.isclose(sum(ms[0].target for ms in by.values()), total)
    order = sorted(k for k in by if k is not None) + [None]
    level = {k: by[k][0].target / (1 + i % 3) for i, k in enumerate(order)}
    free = [k for k in order if by[k][0].target < 3 * by[k][0].source_size - 1e-9]
    assert len({round(level[k], 6) for k in free}) <= 1
    for ms in by.values():
        assert ms[0].source_size == sum(m.size for m in ms)
        assert abs(sum(m.size * m.copies for m in ms) - ms[0].target) <= max(2, 0.02 * ms[0].target)


def test_empty_tables(spark):
    none = docs_frame(spark, [])
    assert mixing.mixed(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert packing.packed(packing.pieces_of(none)).count() == 0
    assert ctw.scored(none, F.lit(False)).count() == 0
    assert mpeg.audio_columns(mpeg.framed(none)).count() == 0
    assert langid.with_language(none, langid.prototypes(none)).count() == 0
    assert substrings.without_repeats(none).count() == 0
    assert secret_scan.redacted(none).count() == 0
    assert minhash.neighbour_fingerprints(none).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(prints)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_simhash_groups(spark, texts):
    rows = {r.doc_id: r for r in simhash.near_groups(docs_frame(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [rows[i].fp % (1 << 64) for i in range(len(texts))] == prints
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(prints)
    kept = simhash.first_of_groups(docs_frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(prints))) and kept.columns == docs_frame(spark, texts).columns


@pytest.mark.parametrize("entry_rows", [0, 2, 1000])
def test_neighbour_links_connect_exactly(spark, entry_rows):
    draw = random.Random(3)
    seeds = [draw.getrandbits(64) for _ in range(6)]
    prints = set(seeds)
    for s in seeds[:3]:
        for _ in range(25):
            prints.add(s ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    from chronolith.llm.common import components

    links = simhash.neighbour_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), entry_rows)
    found = {r.node: r.label for r in components(links).collect()}
    label = brute_components([p % (1 << 64) for p in prints])
    mine = [found.get(p, p) for p in prints]
    assert all((mine[i] == mine[j]) == (label[i] == label[j]) for i, j in itertools.combinations(range(len(prints)), 2))


def test_packing_places_every_piece(spark, texts):
    from tokenizers import Tokenizer

    files = packing.tokenizer_files()
    exact = Tokenizer.from_file(files[0])
    texts = [*texts, "word <|endoftext|> tail", "naïve  spaces\n\n\n and 12345 'll we've"]
    rows = packing.packed(packing.pieces_of(docs_frame(spark, texts), window=128), window=128, items_per_task=20).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.start for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1] and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 128 for p in pieces[1:]) and [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.1 * math.ceil(sum(r.length for r in rows) / 128) + 1


def brute_ctw(texts, depth):
    """Weighted probabilities by the recursive definition, from all training symbols."""
    counts = Counter()
    for t in texts:
        data = bytes(depth) + t + b"\0"
        for i in range(depth, len(data)):
            for level in range(8):
                for d in range(depth + 1):
                    counts[data[i - d:i][::-1], level, data[i] >> (8 - level), data[i] >> (7 - level) & 1] += 1

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    nodes = {k[:3] for k in counts}
    children = {}
    for c, level, p in nodes:
        if c:
            children.setdefault((c[:-1], level, p), []).append((c, level, p))
    weighted = {}
    for node in sorted(nodes, key=lambda n: -len(n[0])):
        own = pe(counts[(*node, 0)], counts[(*node, 1)])
        weighted[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(weighted[c] for c in children.get(node, []))) + math.log(0.5)

    def score(t):
        data, total = bytes(depth) + t + b"\0", 0.0
        for i in range(depth, len(data)):
            for level in range(8):
                prefix, bit, p = data[i] >> (8 - level), data[i] >> (7 - level) & 1, None
                for d in range(depth, -1, -1):
                    node = (data[i - d:i][::-1], level, prefix)
                    a, b = counts[(*node, 0)], counts[(*node, 1)]
                    own = ((b if bit else a) + 0.5) / (a + b + 1)
                    if p is None:
                        p = own if a + b or d == 0 else None
                    else:
                        stop = math.exp(math.log(0.5) + pe(a, b) - weighted[node])
                        p = stop * own + (1 - stop) * p
                total += math.log10(p)
        return total

    return score


def test_context_trees_match_the_definition(spark, texts):
    few = texts[:6] + texts[-9:-3]
    rows = {r.doc_id: r for r in ctw.scored(docs_frame(spark, few), F.col("doc_id") % 3 == 0).collect()}
    low = [(t or "").encode().lower() for t in few]
    train = [t for i, t in enumerate(low) if i % 3]
    score = brute_ctw(train, ctw.DEPTH)
    words = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(low):
        tokens = [*t.split(), b""]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 3 == 0, len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score(t), rel_tol=1e-6)


def test_audio_round_trip(spark, texts):
    rows = mpeg.audio_columns(mpeg.framed(docs_frame(spark, texts))).collect()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        a = r.audio
        assert bytes(a.payload) == payload and a.failed == 0 and a.skipped == 0 and a.checked == a.frames + 1 == a.table_frames + 1
        assert a.samples == 1152 * a.frames and a.seconds == a.samples / 48000 and all(bytes(r.media)[o:o + 2] == b"\xff\xfa" for o in a.seek_offsets)


def test_audio_resynchronises_and_verifies():
    clean = mpeg.write_audio(bytes(range(256)) * 30, {"payload": "7680"})
    a = mpeg.read_audio(clean)
    cut = a.offsets[3]
    noisy = clean[:cut] + b"\xff\xfb\x00junk" + clean[cut:] + b"TAG" + b"name".ljust(125, b"\0")
    b = mpeg.read_audio(noisy)
    assert b.body == a.body and b.skipped == 7 and len(b.offsets) == len(a.offsets) and b.tags["TIT1"] == "name"
    broken = bytearray(clean)
    broken[a.offsets[2] + 8] ^= 1
    assert mpeg.read_audio(bytes(broken)).failed == 1
    assert mpeg.read_audio(b"").samples == 0 and mpeg.read_audio(b"\xff" * 50).skipped == 50
    assert mpeg.header_of(b"\xff\xfb\x90\x00").length == 417 and mpeg.header_of(b"\xff\xfd\x90\x00").samples == 1152 and mpeg.header_of(b"\xff\xf3\x40\xc0").samples == 576


def test_language_profiles(spark):
    draw = random.Random(4)
    alphabets = {"aa": "abcdefg", "bb": "defghijk", "cc": "klmnop"}
    langs = [draw.choice(list(alphabets)) for _ in range(90)]
    docs = docs_frame(spark, [sentence(draw, 60, alphabets[l]) for l in langs] + [None, "123 !?"], langs=[*langs, "aa", None])
    learned = langid.prototypes(docs.filter("doc_id % 4 <> 2"))
    rows = {r.doc_id: r.language for r in langid.with_language(docs, learned).collect()}
    held = [i for i in range(90) if i % 4 == 2]
    assert [n for n, _ in learned] == ["aa", "bb", "cc"] and all(rows[i].lang_pred == langs[i] for i in held)
    assert [tuple(rows[i]) for i in (90, 91)] == [("und", 0.0), ("und", 0.0)] and all(0 <= r.score <= 1 for r in rows.values())
    codes, counts = langid.letter_grams("ab")
    exact = sum(c * langid.gram_vectors(np.array([g]))[0].astype(float) for g, c in zip(codes, counts))
    assert (langid.bundled([(codes, counts)])[0] == exact).all()


@pytest.mark.parametrize("per_trigger", [0, 10_000])
def test_repeated_strings(spark, texts, per_trigger, monkeypatch):
    spans = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda t, length: spans(t, length, per_trigger=per_trigger))
    draw = random.Random(5)
    passage = sentence(draw, 60)
    more = [*texts, passage[:199], passage, "q" + passage[:200] + "r", "z" * 3 + passage[40:250] + "y"]
    rows = {r.doc_id: r for r in substrings.without_repeats(docs_frame(spark, more)).collect()}
    data = [(t or "").encode() for t in more]
    starts = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    for i, d in enumerate(data):
        covered = np.zeros(len(d), bool)
        for a in range(len(d) - 199):
            if starts[d[a:a + 200]] > 1:
                covered[a:a + 200] = True
        assert bytes(rows[i].kept) == bytes(b for b, c in zip(d, covered) if not c)
        assert sum(b - a for a, b in rows[i].runs) == covered.sum() and rows[i].n_bytes == len(d)


def test_trigger_chunks_agree(monkeypatch):
    data = sentence(random.Random(6), 4000).encode()
    whole = substrings.triggers(data, 200)
    monkeypatch.setattr(substrings, "_CHUNK", 1000)
    assert all((a == b).all() for a, b in zip(whole, substrings.triggers(data, 200)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href=/a>Menu, one</a></ul></nav><div class="ad">Buy now, buy now, buy now and more.</div><div id=wrap>%s</div>
<aside>Aside, with commas, long enough to be scored as a paragraph, really.</aside><div class="comments"><p>First, a reader says something quite long, with commas.</p></div>
<form><p>Sign up, please, it is free and you will like it, we promise.</p></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=content>%s</div>", "<main><section>%s</section></main>", "<div><div>%s</div></div>"])
def test_main_text(wrap):
    body = "<h1>Head &amp; line</h1><p><b>First  para,\n with <a href=x>a link</a>, &eacute;&nbsp;x.<br><p>Second paragraph, also with a comma, and some length to it.</p><ul><li>one<li>two</ul><p>End.</p>"
    assert extract.main_text(PAGE % (wrap % body)).split("\n\n") == [
        "Head & line", "First para, with a link, é x.", "Second paragraph, also with a comma, and some length to it.", "one", "two", "End."
    ]


def test_main_text_edges(spark):
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<script>x") == extract.main_text("<nav>a</nav>") == ""
    assert extract.main_text("plain, text") == "plain, text" and extract.main_text("<p>a<!-- open") == "a" and extract.main_text("<p title=don't>b</p>") == "b"
    assert extract.main_text("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"
    rows = spark.createDataFrame([(None,), ("<p>x</p>",)], "html string").select(extract.extracted(F.col("html")).alias("t")).collect()
    assert [r.t for r in rows] == ["", "x"]


def test_secrets_found_and_words_left(spark):
    draw = random.Random(7)
    hexes = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    plain = ["the " + "".join(draw.choices("abcdeilnorst", k=20)) + " end " + str(draw.randint(10**15, 10**16)) for _ in range(60)]
    secret = [f"and password={hexes(18)} of" if i % 2 else f'so token = "{hexes(40)}" is' for i in range(40)]
    keys = ["by AKIA" + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) + " in" for _ in range(20)]
    texts = [*plain, *secret, *keys, None, ""]
    docs = docs_frame(spark, texts)
    out = {r.doc_id: r for r in secret_scan.redacted(docs).collect()}
    assert len(out) == len(texts) and secret_scan.redacted(docs).columns == docs.columns
    for i, t in enumerate(texts):
        assert (out[i].text == t) == (i < 60 or i >= 120)
        assert i < 60 or i >= 120 or ("[SECRET]" in out[i].text and out[i].n_chars == len(out[i].text))


def brute_likeness(a, b):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("rows_per_slice", [3, 1000])
def test_minhash_of_neighbours(spark, texts, rows_per_slice):
    rows = {r.doc_id: r for r in minhash.neighbour_fingerprints(docs_frame(spark, texts), rows_per_slice=rows_per_slice).collect()}
    plain = [t or "" for t in texts]
    errors = []
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert all(0 <= x <= 1 for x in (r.near_edited, r.near_next))
        errors += [abs(r.near_edited - brute_likeness(t, edited)), abs(r.near_next - brute_likeness(t, after))]
        assert (edited == t) <= (r.near_edited == 1.0) and rows[i].fingerprint == rows[plain.index(t)].fingerprint
    assert np.mean(errors) < 0.04 and max(errors) < 0.3


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "s"), (1, None, None, None), (1, "x y z", "en", None), (None, "other text here", "fr", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert mixing.mixed(docs).count() == simhash.near_groups(docs).count() == ctw.scored(docs, F.lit(False)).count() == 5
    assert minhash.neighbour_fingerprints(docs, rows_per_slice=2).count() == substrings.without_repeats(docs).count() == secret_scan.redacted(docs).count() == 5
    assert packing.packed(packing.pieces_of(docs)).count() == 5
    assert simhash.first_of_groups(docs).count() == 4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(8)
    texts = [sentence(draw, 60) for _ in range(60)]
    texts += [texts[0], texts[1], "123 456", None, texts[2] + ' token = "' + "0123456789abcdef" * 2 + '"']
    docs = docs_frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], str(tmp_path)))
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames[:-1]]
    assert ids[1] == [i for i in range(len(texts)) if i not in (62, 63)]
    assert 60 not in ids[2] and 61 not in ids[2] and ids[3] == ids[2]
    assert all(f.columns == docs.columns for f in frames[:-1])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    taken = Counter(ids[4])
    assert Counter(r.doc_id for r in final if r.piece == 0) == taken and max(taken.values()) <= 3


def test_language_stage_keeps_one_word_documents(spark):
    import corpus_pipeline

    draw = random.Random(9)
    words = ["Avec.", "Qzx.", "Jk!", "Vw", "Ypq", "Xo.", "Wz", "Mxt", "Zu.", "Kry", "Oui", "Nyq"]
    docs = docs_frame(spark, [*[sentence(draw, 200) for _ in range(40)], sentence(draw, 200) + " " + " ".join(words), *words, "...", None])
    assert [r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").orderBy("doc_id").collect()] == list(range(41 + len(words)))


def test_secret_candidates_of_any_length(spark):
    draw = random.Random(10)
    lines = lambda n: "\n".join("".join(draw.choices("ABCDefgh0123+/", k=64)) for _ in range(n))
    encrypted = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{lines(9)}\n-----END RSA PRIVATE KEY-----"
    long = f"-----BEGIN PRIVATE KEY-----\n{lines(500)}\n-----END PRIVATE KEY-----"
    value = "".join(draw.choices("0123456789abcdef", k=6000)) + "!" + "".join(draw.choices("0123456789abcdef", k=4000))
    text = f"a {encrypted} b -----BEGIN PRIVATE KEY----- cut {long} c secret: {long} d token={value} e {'f0' * 4000}= g"
    found = [(kind, v) for _, kind, v, _ in secret_scan.findings_of(text, "")]
    assert [f for f in found if f[0] != "bare"] == [("block", encrypted), ("block", long), ("block", long), ("named", value)] and found[-1] == ("bare", "f0" * 4000 + "=")
    path = spark.createDataFrame([("ab/" * 30_000 + "ab", "bare")], "value string, kind string")
    assert path.select(secret_scan.format_label(F.col("value"), F.col("kind"))).collect()[0][0] == 0.0


def test_one_label_leaves_other_findings(spark):
    texts = ["an id of Ab1-Cd2_Ef3+Gh4/Ij5 here", "so token = abcdef0123456789 is"]
    out = {r.doc_id: r.text for r in secret_scan.redacted(docs_frame(spark, texts)).collect()}
    assert out == {0: texts[0], 1: "so token = [SECRET] is"}
    assert [r.text for r in secret_scan.redacted(docs_frame(spark, texts[:1])).collect()] == texts[:1]


@pytest.mark.parametrize("wrap", ["%s", "<div>%s</div>"])
def test_main_text_over_plain_divs(wrap):
    halves = ["a first half that goes on " * 6, "a second half that goes on " * 6]
    body = f"<div>{halves[0]}</div><h3>Between</h3><ul><li>one<li>two</ul><div>{halves[1]}</div><p>Short end.</p><div><a href=/a>other</a> <a href=/b>pages</a></div>"
    page = f"<html><body><nav>Menu</nav><h1>Head</h1>{wrap % body}<footer>x</footer></body></html>"
    assert extract.main_text(page).split("\n\n") == ["Head", halves[0].strip(), "Between", "one", "two", halves[1].strip(), "Short end."]


def test_long_documents_meet_the_target():
    assert mixing.fit_lengths(np.array([149_999, 150_001, 200_000]), np.array([1, 1, 1]), 300_000.0, 3)[1].tolist() == [1, 1, 0]
    lengths = np.array([140_000 + 7 * i * i for i in range(24)])
    for target in (lengths[[1, 5, 11]].sum(), lengths[::2].sum()):
        assert (lengths * mixing.fit_lengths(lengths, np.ones(24, int), float(target), 3)[1]).sum() == target
    draw = random.Random(11)
    for _ in range(30):
        lengths = np.array(sorted(draw.sample(range(130_000, 400_000), 7)))
        counts = np.array([draw.randint(1, 2) for _ in lengths])
        target = draw.randint(1, int((lengths * counts).sum()) - 1)
        sums = {sum(int(a) * k for a, k in zip(lengths, ks)) for ks in itertools.product(*[range(c + 1) for c in counts])}
        whole, extra = mixing.fit_lengths(lengths, counts, float(target), 3)
        assert whole == 0 and (extra <= counts).all() and (lengths * extra).sum() == max(s for s in sums if s <= target)
    free = np.array([3, 1, 2, 2, 1])
    taken = [sorted(mixing.bounded_knapsack(np.array([6, 10, 14, 22, 35]), free, left, np.arange(5)[::-1])) for left in range(1, 120)]
    limit, mixing.SPARSE_SUMS = mixing.SPARSE_SUMS, 0
    assert taken == [sorted(mixing.bounded_knapsack(np.array([6, 10, 14, 22, 35]), free, left, np.arange(5)[::-1])) for left in range(1, 120)]
    mixing.SPARSE_SUMS = limit


def test_audio_carries_tag_letters(spark):
    for n in (64, 128, 192, 640, 1280, 2560):
        for shift in range(3):
            payload = (b"xy"[:shift] + b"TAG" * n)[:n]
            a = mpeg.read_audio(mpeg.write_audio(payload, {}))
            assert a.body[:n] == payload and a.skipped == a.failed == 0 and "TIT1" not in a.tags
    text = "x" * 17 + "TAG" + "y" * 60
    assert bytes(mpeg.audio_columns(mpeg.framed(docs_frame(spark, [text]))).collect()[0].audio.payload) == text.encode().ljust(128, b"\0")
    clean = mpeg.write_audio(bytes(range(256)) * 30, {})
    cut = mpeg.read_audio(clean[:-20] + b"TAG" + b"name".ljust(125, b"\0"))
    assert cut.tags["TIT1"] == "name" and len(cut.offsets) == len(mpeg.read_audio(clean).offsets) - 1


def test_packing_goes_on_while_bins_merge(spark):
    sizes = [300, *[320] * 3, *[704] * 10, *[710] * 3000]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, length bigint").repartition(4)
    rows = packing.packed(pieces, items_per_task=100).collect()
    assert len(rows) == len(sizes) and len({r.sequence_id for r in rows}) == 3010
