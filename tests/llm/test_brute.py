"""Operators against plain searches written apart from them, on a small given table and small fixtures."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import decontaminate, license_scan, line_dedup, oracle, packing, quality_rules, simhash, substring_dedup, toxicity
from fathom.llm.common import table

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


# SimHash


def plain_fingerprint(text):
    w = words_of((text or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    """The smallest id reachable over fingerprints that differ in three bits at most, for each row."""
    of = {}
    for i, f in rows:
        of.setdefault(f, []).append(i)
    up = {f: f for f in of}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a in of:
        for b in of:
            if a < b and (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = defaultdict(list)
    for f, ids in of.items():
        least[root(f)] += [i for i in ids if i is not None]
    return {f: min(least[root(f)], default=None) for f in of}


def test_simhash(docs, texts):
    want = [(i, plain_fingerprint(t)) for i, t in texts]
    classes = plain_classes(want)
    got = simhash.simhash_components(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", classes[f]) for i, f in want)


@pytest.mark.parametrize("block", [2, 8, 2048])
def test_large_buckets_go_on_to_smaller_ones(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(25)}
    links = simhash.fingerprint_links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")).collect()
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for x in links:
        a, b = x.a % (1 << 64), x.b % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        up[root(a)] = root(b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                assert root(a) == root(b)


# decontamination

UNITS = decontaminate.UNITS


def plain_template(word, first, name):
    """The template of a word; ``name`` takes a title-case word at the start of a sentence as a name."""
    bare = word.strip(" .,;:!?\"'()[]{}*#$%&|<>`~_-")
    low = bare.lower()
    if re.match(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-z]{0,3})$", low):
        return "<num>"
    if low in UNITS:
        return "<unit>"
    title = len(bare) > 1 and bare[0].isupper() and bare[1:] == low[1:]
    return "<name>" if title and (name or not first) else low


def plain_leaks(doc, item):
    """Covered words of an item in a text by every shift of one against the other."""
    a, b = words_of(item), words_of(doc)
    n = min(8, len(a))
    ends = lambda w: w.rstrip("\"')]}")[-1:] in (".", "!", "?", ":") and w.rstrip("\"')]}") != ""
    start = lambda ws: [i == 0 or ends(ws[i - 1]) for i in range(len(ws))]
    forms = lambda ws: [{plain_template(w, f, False), plain_template(w, f, True)} for w, f in zip(ws, start(ws))]
    fa, fb = forms(a), forms(b)
    covered = set()
    for shift in range(-len(a), len(b)):
        line = {}
        for p in range(len(a) - n + 1):
            if not 0 <= p + shift <= len(b) - n:
                continue
            common = [fa[p + k] & fb[p + shift + k] for k in range(n)]
            # in each word the form that leaves most literals
            if all(common) and sum(any(x[0] != "<" for x in c if x) for c in common) >= min(4, n):
                line.update({p + k: (a[p + k], b[p + shift + k], len(fa[p + k]) > 1, all(x[:1] == "<" for x in fa[p + k])) for k in range(n)})
        there, odd, total = {}, 0, 0
        for p in sorted(line):
            x, y, maybe, slot = line[p]
            x, y = (z.strip(" .,;:!?\"'()[]{}*#$%&|<>`~_-").lower() for z in (x, y))
            if slot or maybe and not (x == y and x not in there):
                total += 1
                odd += there.setdefault(x, y) != y
        if 5 * odd <= total:
            covered |= line.keys()
    return len(covered) if covered and (len(covered) >= min(13, len(a)) or len(covered) >= 0.6 * len(a)) else 0


def test_decontamination(spark, docs, texts):
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.n_covered for r in decontaminate.decontaminate(docs, table(spark, DATA, "benchmark")).collect()}
    grams = lambda t: {tuple(words_of(t.lower())[i : i + 4]) for i in range(len(words_of(t)) - 3)}
    by = defaultdict(set)
    for i, t in items:
        for g in grams(t):
            by[g].add(i)
    item = dict(items)
    want, tried = {}, 0
    for d, t in texts:
        near = Counter(i for g in grams(t or "") for i in by[g])
        for i in {i for i, n in near.items() if n} | {i for x, i in got if x == d}:
            tried += 1
            if n := plain_leaks(t, item[i]):
                want[d, i] = n
    assert tried and got == want


# license scan


def test_licenses(docs, texts):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    flat_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    for d, t in texts:
        w, places, labels = flat_words(t), [], set()
        for label, phrase in license_scan.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        text = " " + " ".join(w) + " "
        if len(text) < 6000:
            fuzzy = {label for label, ps in license_scan.NOTICES.items() for p in ps if regex.search(f"(?:{p}){{e<={license_scan.edits_allowed(p)}}}", text)}
            assert set(r.labels.split(",")) - {""} == labels | fuzzy, d
    many = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES).scan("under the MIT license " * 4000)
    assert many[1:4] == (4000, 0, 15996)


# substring dedup


def test_repeated_windows_are_covered(docs, texts):
    rows = substring_dedup.substring_dedup(docs).collect()
    own = {d: words_of(t.translate(LOW)) for d, t in texts if t}
    cover, cls = defaultdict(list), {}
    for r in rows:
        cover[r.doc_id].append((r.start_word, r.end_word))
        cover[r.rep_doc_id].append((r.rep_start_word, r.rep_end_word))
        cls[r.doc_id] = cls[r.rep_doc_id] = r.class_id
    places = defaultdict(set)
    for d, w in own.items():
        for i in range(len(w) - 49):
            places[" ".join(w[i : i + 50])].add(d)
    shared = {g: ds for g, ds in places.items() if len(ds) > 1 and len(set(g.split())) > 10}
    assert shared
    for d, w in own.items():
        for i in range(len(w) - 49):
            if (g := " ".join(w[i : i + 50])) in shared:
                assert any(a <= i and i + 50 <= b for a, b in cover[d]), (d, i)
    for ds in shared.values():
        assert len({cls[d] for d in ds}) == 1
    for r in rows:  # what is reported holds
        a, b = own[r.doc_id][r.start_word : r.end_word], own[r.rep_doc_id][r.rep_start_word : r.rep_end_word]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(x & y) / len(x | y) >= 0.8 and r.similarity == pytest.approx(len(x & y) / len(x | y))


def test_near_copies_share_a_class(spark):
    r, rows, k = random.Random(8), [], 0
    vocabulary = [f"w{i}" for i in range(4000)]
    groups = []
    for _ in range(30):
        base, ids = r.choices(vocabulary, k=r.randint(60, 300)), []
        for _ in range(6):
            w = base[:]
            for _ in range(len(w) // 90):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((k, " ".join(w)))
            ids.append(k)
            k += 1
        groups.append(ids)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    cls = {d: x.class_id for x in got for d in (x.doc_id, x.rep_doc_id)}
    text = dict(rows)

    def similar(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text[a].split(), text[b].split()))
        return len(x & y) / len(x | y)

    pairs = [(a, b) for ids in groups for a in ids for b in ids if a < b and similar(a, b) >= 0.8]
    assert len(pairs) > 100 and all(a in cls and cls[a] == cls.get(b) for a, b in pairs)
    assert len({cls[ids[0]] for ids in groups if ids[0] in cls}) >= 25  # and unlike texts do not


def test_shortest_is_taken(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(r.choices(words, k=30))
    rows = [(i, " ".join([*r.choices(words, k=40), shared, *r.choices(words, k=40)])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert substring_dedup.substring_dedup(df).count() == 0
    got = substring_dedup.substring_dedup(df, shortest=20).collect()
    assert {x.class_id for x in got} == {0} and all(30 <= x.end_word - x.start_word <= 30 for x in got)


def test_links_between_texts_of_common_runs(spark):
    """Every run of the passage stands in many texts, so each signature's first and previous text are others."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    passage = r.choices(words, k=70)
    fill = lambda: r.choices(words, k=60)
    rows, whole = [], (40, 80, 120)
    for i in range(160):
        a = 0 if i % 5 < 2 else r.randint(0, 30)
        own = passage if i in whole else passage[a : a + 40]
        rows.append((i, " ".join([*fill(), *own, *fill()])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.substring_dedup(df.repartition(3)).collect()
    cls = {d: x.class_id for x in got for d in (x.doc_id, x.rep_doc_id)}
    assert {cls.get(d) for d in whole} == {40}
    text = dict(rows)
    grams = {d: {tuple(w[i : i + 50]) for w in [text[d].split()] for i in range(len(w) - 49)} for d in text}
    for a, b in ((a, b) for a in text for b in text if a < b):
        assert not grams[a] & grams[b] or cls.get(a) == cls.get(b) is not None, (a, b)


def test_pairs_of_a_key_equal_brute_force():
    """Contexts of one run of 30 shingles: beyond it, some go on alike (nearly), in no order of ids."""
    r = np.random.default_rng(3)
    make = lambda n: r.integers(0, 1 << 60, n).astype(np.uint64)
    run, tails = make(30), [make(51) for _ in range(4)]
    contexts = []
    for i in range(120):
        tail = tails[i % 9].copy() if i % 9 < 4 else make(51)
        if i % 2:
            tail[20:25] = make(5)
        if i % 3 == 0:
            tail[10:] = make(41)
        contexts.append(np.concatenate([make(51), run, tail]))
    parts = [substring_dedup.Runs(c) for c in contexts]

    def classes(pairs):
        up = list(range(120))
        for i, j in pairs:
            x, y = up[i], up[j]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    want = [(i, j) for i in range(120) for j in range(i) if substring_dedup.passages(parts[i], parts[j], 46)]
    got = list(substring_dedup.crossing(list(range(120)), list(range(120)), contexts, 46))
    assert set(got) <= set(want) and len(got) < len(want) and classes(got) == classes(want) and len(set(classes(want))) < 100


def test_pairs_that_share_much_but_no_passage_are_not_verified(monkeypatch):
    """Contexts of one long stretch with edits of their own: most pairs share 37 shingles or more, few a passage; some hold one shingle many times."""
    r = np.random.default_rng(6)
    make = lambda n: r.integers(0, 1 << 60, n).astype(np.uint64)
    base, contexts = make(132), []
    for i in range(90):
        c = base.copy()
        for at in range(0, 56, 14):
            c[at + r.integers(0, 4) :][:7] = make(7)
        for at in range(76, 132, 14):
            c[at + r.integers(0, 4) :][:7] = make(7)
        if i % 15 == 0:  # a passage around one unlike shingle, 30 times over
            c[40:66], c[66:96], c[96:122] = base[40:66], make(1), base[66:92]
        elif i % 15 == 1:  # two places changed round
            c[:30], c[30:60] = base[30:60], base[:30]
        elif i % 15 == 2:
            c[60:120] = base[60:120]
        contexts.append(c)
    parts = [substring_dedup.Runs(c) for c in contexts]
    want = [(i, j) for i in range(90) for j in range(i) if substring_dedup.passages(parts[i], parts[j], 46)]
    near = sum(len(np.intersect1d(contexts[i], contexts[j])) >= 37 for i in range(90) for j in range(i))
    up = list(range(90))
    joined = []
    for i, j in want:
        if up[i] != up[j]:
            up = [up[j] if u == up[i] else u for u in up]
            joined.append((i, j))
    calls, real = [], substring_dedup.passages
    monkeypatch.setattr(substring_dedup, "passages", lambda *x: calls.append(1) or real(*x))
    got = list(substring_dedup.crossing(list(range(90)), list(range(90)), contexts, 46))
    assert got == joined and {(15, 0), (17, 2)} <= set(got)
    assert near > 2500 and len(calls) < 1200


def test_pairs_of_repeated_phrases_are_not_verified(monkeypatch):
    """Contexts of one phrase said over and over, with an edit of its own in every few repeats: none of their windows has enough of its different shingles in another."""
    r = np.random.default_rng(9)
    make = lambda n: r.integers(0, 1 << 60, n).astype(np.uint64)
    phrase, contexts = make(6), []
    for i in range(60):
        c = np.tile(phrase, 22)
        for at in range(r.integers(0, 20), 132, 25):
            c[at : at + 5] = make(5)[: len(c[at : at + 5])]
        if i % 20 < 2:  # 60 in a row without an edit
            c[20:80] = np.tile(phrase, 10)
        contexts.append(c)
    parts = [substring_dedup.Runs(c) for c in contexts]
    up, joined = list(range(60)), []
    for i, j in ((i, j) for i in range(60) for j in range(i) if substring_dedup.passages(parts[i], parts[j], 46)):
        if up[i] != up[j]:
            up = [up[j] if u == up[i] else u for u in up]
            joined.append((i, j))
    calls, real = [], substring_dedup.passages
    monkeypatch.setattr(substring_dedup, "passages", lambda *x: calls.append(1) or real(*x))
    got = list(substring_dedup.crossing(list(range(60)), list(range(60)), contexts, 46))
    assert got == joined and len(got) == 5 and len(calls) < 100


def test_words_are_told_apart():
    r, known = random.Random(5), {}
    for _ in range(500):
        raw = bytes(r.choice(b"abAB \t\n\r\v\f\x1c\xc3\xa9\0") for _ in range(r.randint(0, 40)))
        hashes, words = substring_dedup.words_of(raw).tolist(), raw.lower().split()
        assert len(hashes) == len(words) and all(known.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(known.values())) == len(known) > 300
    many = substring_dedup.words_of(b"x " * 70_000 + b"y" * 70_000 + b" z  ").tolist()
    assert len(many) == 70_002 and len(set(many)) == 3 and many[69_999] == many[0]


def test_compact_windows():
    r = np.random.default_rng(4)
    v, t = r.integers(0, 1 << 60, 500).astype(np.uint64), 20

    def nodes(a, b):
        if b - a < t:
            return set()
        c = a + int(v[a:b].argmin())
        return {c} | nodes(a, c) | nodes(c + 1, b)

    assert {int(np.flatnonzero(v == x)[0]) for x in substring_dedup.sliding_minima(v, t)} == nodes(0, len(v))


# packing


def test_evolving_saves_a_bin():
    for seed, n, limit in ((21, 24, 9), (40, 45, 17), (45, 30, 10)):
        r = random.Random(seed)
        assert r.choice([18, 24, 30, 45]) == n
        sizes = sorted([r.randint(15, 60) for _ in range(n)], reverse=True)
        first = [x for i in range(packing.ISLANDS) for x in packing.first_people(sizes, 100, i, packing.seeded(0, i, 0))]
        bins = packing.evolve(sizes, 100)
        assert min(len(x[0]) for x in first) == limit + 1 and len(bins) == limit  # neither best fit nor a blurred order finds it
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)


def test_islands_over_tasks_equal_islands_in_one_process(spark):
    r = random.Random(40)
    r.choice([18, 24, 30, 45])
    sizes = sorted([r.randint(15, 60) for _ in range(45)], reverse=True)
    rows = [(bytes([i]), i, 0, 0, s, 0, i, 0) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "row binary, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, twin bigint, shard bigint")
    got = packing._islands(df, 100).collect()
    bins, _ = packing._read(got[0].packing, sizes)
    assert len(got) == 1 and sorted(map(sorted, bins)) == sorted(map(sorted, packing.evolve(sizes, 100))) and len(bins) == 17


# toxicity's character model and decoder


def test_character_counts(spark, docs, texts):
    want = Counter()
    for _, t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            s = f"\n{w}\n"
            want.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
    got = toxicity.character_counts(docs)
    one = {k: v for k, v in want.items() if k != "\n" and "\n\n" not in k}
    assert all(abs(got[k] - v) <= 0 for k, v in one.items() if len(k) > 1 and "\n" not in k)
    few = toxicity.character_counts(spark.createDataFrame([("ab ba" * 3 + " xyz",), (None,)], "text string"), letters=2)
    assert {c for k in few for c in k} == {"a", "b", "\n", toxicity.OTHER}


def test_decoder_equals_all_paths():
    counts = toxicity.gram_counts(["stupid idiot clown bottle letter sassy moss aloe"] * 5)
    model = toxicity.CharModel(counts)

    def best(token):
        paths = [("", 0.0)]
        for part in toxicity.lattice(token):
            paths = [(t + put, c + cost) for t, c in paths for put, cost in ([(part, 0.0)] if isinstance(part, str) else part)]

        def score(t):
            s = "\n" + t
            return sum(model.log(s[max(0, i - 2) : i], s[i]) for i in range(1, len(s))) + model.log(s[-2:], "\n")

        return max(c + score(t) for t, c in paths)

    for token in ("$tuuppid", "1d10t", "c-l-o-w-n", "bott1ee", "(l0wwn", "i d i o t"):
        out = toxicity.viterbi(token, model)
        paths = [("", 0.0)]
        for part in toxicity.lattice(token):
            paths = [(t + put, c + cost) for t, c in paths for put, cost in ([(part, 0.0)] if isinstance(part, str) else part)]
        cost = max(c for t, c in paths if t == out)
        s = "\n" + out
        mine = cost + sum(model.log(s[max(0, i - 2) : i], s[i]) for i in range(1, len(s))) + model.log(s[-2:], "\n")
        assert mine == pytest.approx(best(token)), token
    assert toxicity.viterbi("a4" * 50_000, model)  # any length, whole


def test_pieces_are_joined():
    counts = toxicity.gram_counts(["you stupid idiot the and one clown"] * 20)
    scorer = toxicity.Scorer(counts, {"idiot": 3.0, "stupid": 3.0}, -1.0)
    plain = scorer.score("you the one")
    for text in ("you id iot!", "the st upid one", "you i d i o t", "y ou stu pid and"):
        assert scorer.score(text) > plain, text
    for text in ("id, iot", "you the st and upid"):
        assert scorer.score(text) == plain, text


# quality rules


def test_divergence():
    p, q = np.array([3.0, 1.0, 0.0]), np.array([1.0, 1.0, 2.0])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    assert quality_rules.js_distance(p, q) == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert quality_rules.js_distance(p, 5 * p) == 0 and quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_languages_are_bounded(spark):
    rows = [(i, "wort " * (i + 1), f"l{i}") for i in range(9)] + [(9, "x", None), (10, None, "l0")]
    refs = quality_rules.language_references(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), most=4)
    assert sorted(refs) == ["l5", "l6", "l7", "l8"]


def test_every_language_counts(spark):
    r = random.Random(4)
    vocabulary = {k: [f"w{k}x{i}" for i in range(12)] for k in range(80)}
    rows = [(k, " ".join(r.choices(vocabulary[k], k=60 + 3 * (k < 70))), f"l{k}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    df = df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    want = {k for k, t, _ in rows if not quality_rules.Judge({}, 0.22, 0.36, 200, 50)(t)[5]}
    assert len(want) > 70 and {x.doc_id for x in corpus_pipeline.quality(spark, df, "").collect()} == want


# the pipeline, stage by stage


def test_pipeline(spark, tmp_path):
    con = duckdb.connect()
    frame = table(spark, DATA, "documents")
    columns = frame.columns
    bench = {r.item_id: r.text for r in table(spark, DATA, "benchmark").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame.toPandas()
        stage(spark, frame, DATA).write.parquet(str(tmp_path / str(number)))
        frame = spark.read.parquet(str(tmp_path / str(number)))
        after = frame.toPandas()
        con.register("documents", before)
        if name == "quality_rules":
            judged = con.execute(oracle.QUALITY).df()
            want = set(judged.loc[judged["kept"], "doc_id"])
            assert set(after["doc_id"]) == want and 0 < len(want) < len(before)
        elif name == "line_dedup":
            want = con.execute(oracle.LINES).df().set_index("doc_id")["text"]
            assert after.set_index("doc_id")["text"].to_dict() == want.to_dict() and (after["n_chars"] == after["text"].str.len()).all()
        elif name == "simhash":
            rows = [(i, plain_fingerprint(t)) for i, t in zip(before["doc_id"], before["text"])]
            classes = plain_classes(rows)
            assert set(after["doc_id"]) == {classes[f] for _, f in rows} and len(after) == after["doc_id"].nunique()
        elif name == "decontamination":
            gone = set(before["doc_id"]) - set(after["doc_id"])
            text = dict(zip(before["doc_id"], before["text"]))
            for d in gone:
                assert any(plain_leaks(text[d], t) for t in bench.values())
            for d in list(after["doc_id"])[:15]:
                assert not any(plain_leaks(text[d], t) for t in bench.values())
        else:
            assert set(after["doc_id"]) == set(before["doc_id"])
            ends = after.assign(end=after["offset"] + after["length"]).sort_values(["sequence_id", "offset"]).groupby("sequence_id")
            assert ends["end"].max().max() <= 4096 and all((g["offset"] == g["end"].shift(fill_value=0)).all() for _, g in ends)
        if name != "packing":
            assert frame.columns == columns
    assert corpus_pipeline.run(spark, DATA).count() == frame.count()


# nulls, repeated rows, clashing names, empty tables


def test_clashing_names(spark):
    names = ["gone", "_gone", "_key", "_new", "_row", "row", "h", "id", "n", "shard", "fp", "lang"]
    rows = [(None, "a b\nc d\ne f\ng"), (1, None), (1, None), (2, ""), (3, "a b\nc d\ne f\nh"), (3, "a b\nc d\ne f\nh"), (4, "x " * 60)]
    df = spark.createDataFrame([(*r, *(f"{c}{k}" for c in names)) for k, r in enumerate(rows)], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"] and Counter(r[2:14] for r in out.collect()) == Counter(r[2:] for r in df.collect())
    one = simhash.one_of_each(df)
    assert one.columns == df.columns and {r["_row"] for r in one.collect()} <= {f"_row{k}" for k in range(len(rows))}
    bench = spark.createDataFrame([(1, "x " * 60), (None, None), (2, "")], "item_id bigint, text string")
    rest = decontaminate.without_leaks(df, bench)
    assert rest.columns == df.columns and rest.count() == 6
    kept = quality_rules.kept_only(df, quality_rules.language_references(df))
    assert kept.columns == df.columns
    assert substring_dedup.substring_dedup(df).count() == 0
    assert quality_rules.quality_rules(df, {}).where("kept").count() == 0


def test_empty_tables(spark):
    from fathom.llm import token_counts

    import public_tokenizers as P

    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.without_leaks(none, bench).count() == 0
    some = spark.createDataFrame([(1, "x y z")], "doc_id bigint, text string")
    assert decontaminate.decontaminate(some, bench.limit(0)).count() == 0 and decontaminate.without_leaks(some, bench.limit(0)).count() == 1
    assert license_scan.license_scan(none).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0


def test_repeated_rows_each_get_their_leaks(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (6, "no")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, text), (1, text)], "item_id bigint, text string")
    assert Counter(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == {5: 4, None: 2}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id bigint, text string")
    assert {r.class_id for r in substring_dedup.substring_dedup(df).collect()} == {1}
    assert simhash.simhash_components(df).select("component_id").distinct().count() == 1
    assert line_dedup.line_dedup(df).agg(F.sum("n_removed")).first()[0] == 0
    assert isinstance(quality_rules.base_rules(long), tuple) and pd.notna(len(long))
