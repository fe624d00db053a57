"""Small fixtures against brute force, with nulls, empties, repeats and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fathom.llm import decontaminate, license_scan, line_dedup, packing, quality_cnn, quality_rules, simhash, substring_dedup, token_counts, toxicity

WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "lmnrst"]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


PASSAGE = prose(99, 60)
ROWS = [
    (0, None), (1, ""), (2, "one two"), (3, prose(1, 80)), (4, prose(1, 80)), (4, prose(1, 80)), (None, prose(2, 30)),
    (5, prose(3, 40) + " " + PASSAGE + " " + prose(4, 40)), (6, prose(5, 20) + " " + PASSAGE), (7, "a x\nb y\nc z\nd w"), (8, "e\na x\nb y\nc z\nf"),
    (9, "Under the MIT  License, 1\t2  \n <|endoftext|> ünïc Σς 中文"), (10, "licensed undr the apache licence"), (11, prose(6, 6000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id bigint, text string, n_lines int, h string")


def test_token_counts(docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()) == want


def test_packing(docs):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    want = Counter()
    for i, x in ROWS:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in out) == want
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_packing_ids_of_parts():
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0xC0, 0x100)]
    words = [*letters, *(a + b for a, b in zip(letters, letters[7:])), *(c + "Wort" + c + "!?|" for c in letters), *(chr(c) * 2 for c in range(33, 127)), "<|endoftext|>", "it's", "e\u0301t\u00e9,"]
    got = packing.Ids(path).encode([" ".join(words), *words])
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in (" ".join(words), *words)]


def test_simhash(docs):
    got = simhash.simhash_components(docs).collect()
    f = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got]
    assert len(f) == len(ROWS)
    up = list(range(len(f)))
    for _ in f:
        for i, a in enumerate(f):
            for j, b in enumerate(f):
                if (a[1] ^ b[1]).bit_count() <= 3:
                    up[i] = up[j] = min(up[i], up[j])
    for i, a in enumerate(f):
        assert a[2] == min((b[0] for j, b in enumerate(f) if up[j] == up[i] and b[0] is not None), default=None)
    assert simhash.one_of_each(docs).where("doc_id = 4").count() == 0


def test_line_dedup(docs):
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[7].text == "a x\nb y\nc z\nd w"
    assert (out[8].text, out[8].n_removed) == ("e\nf", 3)
    assert out[0].text is None and out[1].text == ""


def find(items, text):
    """Leaks of one text through the operator's parts: (item, covered words, share, first word)."""
    own, templates, out = [t.encode() for _, t in items], decontaminate.Templates(), []
    hits = {}
    for k, n, h, p, words, marks in decontaminate.item_windows(own, templates):
        w, _, first, _, (split,), *_ = decontaminate.text_windows([text.encode()], n, templates)
        for i in first[w.view(np.int64) == h].tolist():
            hits.setdefault(k, []).append((p, i, words, b" ".join(split[i : i + n]), marks))
    for k, h in sorted(hits.items()):
        if x := decontaminate.leak(len(own[k].split()), h):
            out.append((items[k][0], *x))
    return out


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(70, PASSAGE), (71, prose(50, 40)), (72, None)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, bench).collect()} == {(5, 70), (6, 70)}
    a, b = b"The train left at 5 km from town with 7 bags and 12 men", "The train left at 9 km from town with 3 bags and 40 men"
    assert find([(1, a.decode())], b)


def test_licenses(docs):
    out = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (out[9].base_labels, out[9].n_base, out[9].first_word) == ("mit", 1, 0)
    assert out[10].labels == "apache-2" and out[10].base_labels == "" and 0 < out[10].score < 1
    assert out[0].n_words == 0 and out[3].labels == ""


def test_substrings(docs):
    got = {frozenset((r.doc_id, r.rep_doc_id)) for r in substring_dedup.substring_dedup(docs).collect()}
    assert frozenset((5, 6)) in got and frozenset((3, 4)) in got
    assert not any(11 in p for p in got)


def test_base_rules():
    assert quality_rules.base_rules("a b c a b c") == (6, 6, 0, 0, 6)
    assert quality_rules.base_rules("x#\n\n\nx#\n") == (2, 4, 2, 1, 0)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert simhash.simhash_components(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert quality_rules.quality_rules(none, quality_rules.language_references(none)).count() == 0


def labelled(spark, name, bad):
    rows = [(i, prose(i, 60) + (bad(i) if i % 3 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x"), (3, rows[3][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (901, None)], f"doc_id bigint, {name} int")
    return docs, labels


def test_toxicity(spark):
    forms = ["grunchold", "grunch0ld", "g-r-u-n-c-h-o-l-d", "gruuunchold", "g r u n c h o l d"]
    docs, labels = labelled(spark, "toxic", lambda i: f" you {forms[i // 3 % 5]} grunchold there")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 240]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert held and all(r.predicted == (r.doc_id % 3 == 0) for r in held)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 244


def test_restores_words():
    counts = Counter()
    for w in ["grunchold"] * 50 + WORDS:
        s = f"\n{w}\n"
        counts.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
    restorer = toxicity.Restorer(counts)
    for raw in ("grunch0ld", "g-r-u-n-c-h-o-l-d", "gruuunchold", "Grunchold!"):
        assert restorer.words(raw) == ["grunchold"], raw
    assert restorer.words("g r u n c h o l d") == ["grunchold"]


def test_quality_cnn(spark):
    docs, labels = labelled(spark, "quality", lambda i: " ### $$$ %%%" * 60)
    out = quality_cnn.quality_cnn(docs, labels).collect()
    assert len(out) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 240]
    assert held and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert quality_cnn.quality_cnn(docs, labels.limit(0)).count() == 244


def test_substrings_apart(spark):
    a, b = prose(20, 60), prose(21, 60)
    rows = [(1, f"{a} {b}"), (2, f"{a} {prose(22, 100)} {b}"), (3, f"{prose(23, 60)} {prose(24, 60)}"), (4, f"{prose(24, 60)} {prose(23, 60)}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for pair in ((1, 2), (3, 4)):
        found = [r for r in got if {r.doc_id, r.rep_doc_id} == set(pair)]
        assert len(found) == 2 and all(r.end_word - r.start_word == 60 and r.similarity == 1 for r in found), pair


def test_substrings_edited(spark):
    rows = []
    for i in range(600):
        one = prose(10000 + i, 50).split()
        two = [*one[: 5 + i % 40], "new", *one[6 + i % 40 :]]
        assert 41 / 51 == pytest.approx(substring_dedup.jaccard(*(substring_dedup.Shingles().of(" ".join(x)) for x in (one, two))))
        rows += [(2 * i + k, f"{prose(20000 + 2 * i + k, 30)} {' '.join(x)} {prose(30000 + 2 * i + k, 30)}") for k, x in enumerate((one, two))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    lost = 600 - len({frozenset((x.doc_id, x.rep_doc_id)) for x in got} & {frozenset((2 * i, 2 * i + 1)) for i in range(600)})
    assert lost == 0


def test_decontaminate_names():
    own = "Tom has 3 apples. Anna buys 5 more. Tom gives Anna 2 of them. How many are left?"
    other = "Ben has 4 apples. Lucy buys 7 more. Ben gives Lucy 3 of them. How many are left?"
    assert find([(1, own)], own) == [(1, 18, 1.0, 0)] and find([(1, own)], f"Well then: {other} Ok.") == [(1, 18, 1.0, 2)]
    assert not find([(1, own)], other.replace("apples", "pears").replace("gives", "owes"))


def test_decontaminate_equal_values():
    items = [(1, "she put 2 apples and 3 pears into the old basket"), (2, "we saw 2 cats and then 2 dogs near the old barn")]
    assert find(items, "she put 4 apples and 4 pears into the old basket") == [(1, 11, 1.0, 0)]
    assert not find(items, "we saw 5 cats and then 6 dogs near the old barn")


def test_restores_marks_and_doubles():
    counts = Counter()
    for w in ["stupid", "idiot", "clown", "trash"] * 50 + WORDS:
        s = f"\n{w}\n"
        counts.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
    restorer = toxicity.Restorer(counts)
    for want, raws in {"stupid": "$tupid stuupid (stupid) stupid! 'stupid',", "idiot": "!diot |diot i/d/i/o/t i'd'i'o't i,d,i,o,t i:d:i:o:t i`d`i`o`t iiddiioott", "clown": "(lown", "trash": "+rash"}.items():
        for raw in raws.split():
            assert restorer.words(raw) == [want], raw


def test_restores_spaced():
    counts = Counter()
    for w in ["stupid", "idiot", "clown", "are", "a"] * 50 + WORDS:
        s = f"\n{w}\n"
        counts.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
    restorer = toxicity.Restorer(counts)
    for raw, want in {"s  t\tu\np i   d": ["stupid"], "are a s t u p i d": ["a", "are", "stupid"], "i d i o t c l o w n": ["clown", "idiot"], "i d 1 0 t": ["idiot"]}.items():
        assert sorted(restorer.words(raw)) == want, raw


def test_long_common_words(spark):
    text = "достопримечательность " * 5 + prose(40, 20)
    refs = quality_rules.language_references(spark.createDataFrame([(1, text, "ru")], "doc_id bigint, text string, lang string"))
    assert refs["ru"][1][0].decode() == "достопримечательность" and refs["ru"][2][0] == 5


def test_packing_replaces_letters_only_where_there_are_others():
    class Counted(dict):
        asked = 0

        def __getitem__(self, c):
            Counted.asked += 1
            return dict.__getitem__(self, c)

    path = P.path("word_bpe_49k.json")
    ids = packing.Ids(path)
    ids.letters = Counted(ids.letters)
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdefghijklmnop"), 9)) for _ in range(4000)] + [f"gr{c}n{d}" for c in "äöüß" for d in "éèàôñ"]
    r.shuffle(words)
    raw = ids.encode([" ".join(words)])[0]
    assert np.frombuffer(raw, "<u4").tolist() == Tokenizer.from_file(path).encode(" ".join(words), add_special_tokens=False).ids
    assert 0 < Counted.asked < 2000


def test_packing_ids_when_words_are_forgotten(monkeypatch):
    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHE", 120)
    ids, whole, learned = packing.Ids(path), Tokenizer.from_file(path), []
    learn = ids._learn
    ids._learn = lambda words: (learned.extend(words), learn(words))[1]
    often = ["the", "River,", "\u00c9t\u00e9", "x1y"]
    calls = [[" ".join([*often, *(f"{'abcdefghij'[k // 10]}{'klmnopqrst'[k % 10]}{c * (k % 7 + 1)}" for k in range(60))]), "", " \t", "a\x0b b\x0cc\r\nd  \x00e "] for c in "uvwxyz" * 2]
    for texts in calls:
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(ids.known) <= 120 + 70 + 70
    assert all(learned.count(w.encode()) == 1 for w in often)
    assert ids.encode([]) == [] and ids.encode(["", " "]) == [b"", b""]
