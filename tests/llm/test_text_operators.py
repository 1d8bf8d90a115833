"""Packing, mixing, line dedup, Jaccard join, quality and token counts against brute force and edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadtide.llm import _graph, jaccard, line_dedup, mixing, packing, quality, token_counts
from quadtide.llm._store import Store
from quadtide.llm._text import WordBpe, words

SCHEMA = "doc_id bigint, text string, lang string, source string, class_id string, size int, runs string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EDGE = [
    (None, "one text without an id " * 9, "en", "a", "x", 1, "r", 0),
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "", "x", 1, "r", 0),
    (3, "   \n\t \n", "en", None, "x", 1, "r", 0),
    (4, "word", "en", "a", "x", 1, "r", 4),
    (5, LONG, "de", "a", "x", 1, "r", 0),
    (6, "the same text twice " * 8, "en", "a", "x", 1, "r", 0),
    (6, "the same text twice " * 8, "en", "a", "x", 1, "r", 0),
    (6, "another text under one id " * 8, "en", "b", "x", 1, "r", 0),
    (7, "日本語 текст ß ümlaut   é \x1c <s> \U0001f600", "xx", "é", "x", 1, "r", 0),
]


def prose(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


BPE = WordBpe()
VOCAB = [a + b + c for a in ("th", "er", "on", "in", "st") for b in ("ea", "ou", "an", "e") for c in ("", "nd", "ble", "ly", "ing.")]


@pytest.fixture(scope="module")
def corpus():
    """Documents with exact copies, near copies, and shared passages."""
    rng, docs = random.Random(5), []
    passage = " ".join(prose(rng, 70))
    for _ in range(120):
        lines = [" ".join(prose(rng, rng.randint(3, 60))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), passage)
        docs.append("\n".join(lines))
    for _ in range(40):
        t = rng.choice(docs[:30]).split(" ")
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "edit" + str(rng.random())
        docs.append(" ".join(t))
    docs += [docs[0]] * 10
    rng.shuffle(docs)
    return docs


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, "r", 0) for i, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbzÉé'stvelm.,!_-09²½ºªß\n\t <|>ǆÅσΣΩ«ñ…’“€­‍İı中\x1c\x85\xa0́", max_size=40))
def test_cached_ids_are_the_tokenizers(text):
    assert BPE.ids(text) == BPE.exact(text)


def ids_by_hand(bpe, text):
    return np.append(np.frombuffer(bpe.exact(text or ""), "<u4"), 1).astype("<u4")


def check_packing(rows, texts, whole=True):
    """Pieces hold their texts' ids; where ``whole``, ``rows`` are all there are and sequences have no gap."""
    bpe, seqs, docs = BPE, defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at if whole else offset >= at
            at = offset + length
        assert at <= 2048
    for doc, text in texts:
        ids, at = ids_by_hand(bpe, text), 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return sum(2048 - sum(n for _, n in p) for p in seqs.values()) / (2048 * len(seqs))


def test_packing(spark, corpus):
    rows = packing.pack(frame(spark, corpus)).collect()
    waste = check_packing(rows, list(enumerate(corpus)))
    assert waste < 0.05
    again = packing.pack(frame(spark, corpus)).collect()
    assert sorted(rows) == sorted(again)


def test_packing_edges(spark):
    rows = [r for r in EDGE if r[0] != 6]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    check_packing(out, [(r[0], r[1]) for r in rows])
    assert packing.pack(spark.createDataFrame(EDGE, SCHEMA)).count() >= len(EDGE)
    assert packing.pack(empty(spark)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=16, max_size=16))
def test_patterns_hold_every_item(counts):
    counts = np.array(counts)
    plan = packing.patterns(counts, 16)
    held = sum((t * items for t, items in plan), np.zeros(16, int))
    assert (held == counts).all()
    assert all(items @ np.arange(1, 17) <= 16 for _, items in plan)
    least = counts @ np.arange(1, 17) / 16
    big = counts[8:].sum()
    assert sum(t for t, _ in plan) <= max(least * 1.5, big) + 16


def test_knapsack_prices_like_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.random(6)
        best, pattern = packing.price(v, 12)
        brute = np.zeros(13)
        for c in range(1, 13):
            brute[c] = max([brute[c - 1]] + [v[i] + brute[c - i - 1] for i in range(min(c, 6))])
        assert abs(best - brute[12]) < 1e-9 and abs(pattern @ v - best) < 1e-9 and pattern @ np.arange(1, 7) <= 12


def test_mixing_targets():
    goal = mixing.targets([("a", 100), ("b", 1000), ("c", 1000), (None, 10)], (3, 1, 2), 1.5, 2)
    assert goal["a"] == 200 and goal[None] == 20
    assert abs(sum(goal.values()) - 1.5 * 2110) < 1e-6
    assert abs(goal["c"] / goal["b"] - 2) < 1e-9
    assert mixing.targets([], (3, 1, 2), 1.5, 2) == {}


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(prose(rng, int(rng.paretovariate(1.1)) + 5)), "en", rng.choice("aaaaabc") if i % 50 else None, "x", 1, "r", 0) for i in range(1500)]
    rows += [(9000 + i, "copy of a hot text", "en", "a", "x", 1, "r", 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and out[0].class_id == "x"
    sums, largest = defaultdict(int), defaultdict(int)
    for r in out:
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.copies <= 2 and r["size"] == len(r.text.split())
        sums[r.source] += r.copies * r["size"]
    for r in out:
        assert abs(sums[r.source] - r.target) <= 0.01 * r.target + largest[r.source] / 2
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, out))
    assert mixing.repeat(mixing.mix(df)).count() == sum(r.copies for r in out)
    assert mixing.repeat(mixing.mix(df)).columns == [c for c in df.columns if c != "size"]


def test_mixing_edges(spark):
    out = mixing.mix(spark.createDataFrame(EDGE, SCHEMA)).collect()
    assert len(out) == len(EDGE)
    assert {r["size"] for r in out if not (r.text or "").strip()} == {0}
    assert all(r.copies * r["size"] <= 2 * r["size"] for r in out)
    assert mixing.mix(empty(spark)).collect() == []


def test_line_dedup(spark, corpus):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, corpus)).collect()}
    seen: set[str] = set()
    for i, text in enumerate(corpus):
        kept = out[i].text.split("\n") if out[i].text else []
        assert out[i].n_removed_lines == len(text.split("\n")) - len(kept)
        left = Counter(kept)
        for line in text.split("\n"):
            new = line not in seen
            if len(words(line)) >= 50:  # guaranteed: a line of that length stays exactly where it is first
                assert (left[line] > 0) == new, (i, line[:40])
            seen.add(line)
        assert not left - Counter(text.split("\n"))


def test_line_dedup_extends_both_ways(spark):
    rng = random.Random(4)
    run = [" ".join(prose(rng, n)) for n in (4, 30, 5, 6, 28, 3)]
    first = ["own a b c", *run, "own end"]
    second = ["other start", *run, "tail " + " ".join(prose(rng, 40))]
    third = [run[0], "lonely " + run[2]]
    out = line_dedup.dedup_lines(frame(spark, ["\n".join(t) for t in (first, second, third)])).orderBy("doc_id").collect()
    assert len(out) == 3
    assert out[0].text == "\n".join(first)
    assert out[1].text == "\n".join([second[0], second[-1]]) and out[1].n_removed_lines == 6
    assert out[2].text == "\n".join(third)


def test_line_dedup_finds_every_run(spark):
    """A run of at least 50 words, of lines that occur nowhere else, goes whole wherever it stands later."""
    rng, texts, runs = random.Random(12), [], []
    line = lambda n: " ".join(f"u{rng.random()}" for _ in range(n))
    for _ in range(60):
        run = [line(rng.choice((1, 2, 5, 9, 30, 70))) for _ in range(12)]
        while sum(len(x.split()) for x in run[:-1]) >= 50:
            run.pop()
        runs.append(run)
        for _ in range(2):
            own = lambda: [line(rng.choice((1, 4, 12, 40))) for _ in range(rng.randint(0, 4))]
            texts.append([own(), run, own()])
    out = line_dedup.dedup_lines(frame(spark, ["\n".join(x for part in t for x in part) for t in texts])).orderBy("doc_id").collect()
    for i, (a, run, b) in enumerate(texts):
        assert out[i].text == "\n".join([*a, *(run if i % 2 == 0 else []), *b])


def test_line_dedup_meets_every_earlier_run(spark):
    """A run is found though the first occurrence of one of its grams stands among other lines."""
    rng = random.Random(21)
    line = lambda n: " ".join(f"v{rng.random()}" for _ in range(n))
    texts = []
    for k in range(12):
        a, b = line(30), line(30)
        texts += [[line(20), (a, b)[k % 2], line(40)], [line(7), a, b], [line(9), a, b]]
    out = line_dedup.dedup_lines(frame(spark, ["\n".join(t) for t in texts])).orderBy("doc_id").collect()
    for i, t in enumerate(texts):
        assert out[i].text == "\n".join(t[:1] if i % 3 == 2 else t)


def brute_windows(texts, least=50):
    """Numbers of the lines in runs of at least ``least`` words that occur earlier, by text."""
    seen, out = set(), []
    for text in texts:
        lines, gone = [" ".join(words(x)) for x in text.split("\n")], set()
        for i in range(len(lines)):
            new = []
            for j in range(i, len(lines)):
                run = tuple(lines[i : j + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone.update(range(i, j + 1))
                    new.append(run)
            seen.update(new)
        out.append(gone)
    return out


def test_line_dedup_is_complete(spark):
    """Of texts dealt from few lines, each line in a run of 50 words that stands earlier goes."""
    rng = random.Random(22)
    stock = [" ".join(f"s{rng.random()}" for _ in range(rng.choice((1, 2, 8, 20, 26, 30, 45, 60)))) for _ in range(40)]
    texts = ["\n".join(rng.sample(stock, rng.randint(1, 9))) for _ in range(400)]
    out = line_dedup.dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()
    for text, gone, r in zip(texts, brute_windows(texts), out, strict=True):
        left = set(r.text.split("\n")) if r.text else set()
        assert not left & {x for k, x in enumerate(text.split("\n")) if k in gone}


def test_line_dedup_within_a_document(spark):
    line = " ".join(prose(random.Random(8), 60))
    (row,) = line_dedup.dedup_lines(frame(spark, [f"{line}\nmiddle\n\n{line}\nend"])).collect()
    assert row.text == f"{line}\nmiddle\n\nend"


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(spark.createDataFrame(EDGE, SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in EDGE)
    assert out[0].runs == "r" or out[1].runs == "r"
    assert line_dedup.dedup_lines(empty(spark)).collect() == []


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = words(t)
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute_classes(texts, t=0.8):
    sets = sets_of(texts)
    different = {}
    for i, s in enumerate(sets):
        different.setdefault(s, i)
    links, parent = Counter(), {i: i for i in different.values()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = list(different.items())
    for x, (s, i) in enumerate(items):
        for r, j in items[x + 1 :]:
            if s and r and len(s & r) >= t * len(s | r):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(root(different[s]), links[different[s]]) for s in sets]


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_is_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3)
    base = prose(rng, 120)
    group = []
    for _ in range(60):  # a large group of near copies
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = f"e{rng.random()}"
        group.append(" ".join(t))
    texts = [*corpus, *group, "", None, "a b", "a b"]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_jaccard_edges(spark):
    out = jaccard.jaccard_classes(spark.createDataFrame(EDGE, SCHEMA)).collect()
    assert len(out) == len(EDGE)
    by = {r.doc_id: r for r in out}
    assert by[None].class_id is None and by[1].class_id == by[2].class_id == by[3].class_id == 1 and by[5].class_id == 5
    assert jaccard.jaccard_classes(empty(spark)).collect() == []
    kept = jaccard.keep_one(spark.createDataFrame(EDGE, SCHEMA))
    assert {r.doc_id for r in kept.collect()} == {None, 1, 4, 5, 6, 7} and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_keep_one_row_of_a_class(spark):
    """Rows that share an id: copies are reduced to one, other texts follow their own class."""
    first, second = "the first text that many rows repeat " * 6, "quite another text with its own words " * 6
    texts = [(5, first), (5, first), (5, second), (7, second), (9, first), (9, "a third one alone " * 9), (None, first), (None, first)]
    rows = [(i, t, "en", "s", "x", 1, "r", 0) for i, t in texts]
    out = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(5, first), (5, second), (9, texts[5][1]), *texts[6:]])


def test_pruning_table():
    keep = jaccard.least_matches(120, 0.8, 1e-6)
    assert keep[20] < keep[120] < 96 and set(keep) == {20, 40, 60, 80, 100, 120}


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), Store(spark)).collect()}
    assert got == {i: root(i) for i in parent}
    assert _graph.components(spark.createDataFrame([], "u bigint, v bigint"), Store(spark)).count() == 0


def brute_repeat(w, n=8):
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = set()
    for i in range(len(w) - n + 1):
        if seen[tuple(w[i : i + n])] > 1:
            inside.update(range(i, i + n))
    return len(inside)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeat_words(w):
    h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    assert quality.repeat_words(h, 8) == brute_repeat(w)


def test_quality(spark, corpus):
    rng = random.Random(9)
    shout = [" ".join(prose(rng, 200)).upper().replace(" ", "!! ") for _ in range(6)]
    texts = [*corpus, *shout, *(r[1] for r in EDGE)]
    out = sorted(quality.fertility_rules(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    for r, t in zip(out, texts, strict=True):
        w = words(t)
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        lines = (t or "").split("\n")
        assert r.n_dup_lines == sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
        assert r.n_repeat_words == brute_repeat(w)
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))
        assert not (r.base_failed and r.kept)
    n = len(corpus)
    clean = [r for r in out[:n] if not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert not any(r.kept for r in out[n : n + 6])
    assert quality.fertility_rules(empty(spark)).collect() == []
    assert quality.fertility_rules(spark.createDataFrame(EDGE, SCHEMA)).count() == len(EDGE)


def test_quality_measures(corpus, monkeypatch):
    """Measures and script against brute force, in one call of the encoder for many texts and whatever the lots and the memory are."""
    import math

    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    plain, calls = sentencepiece.SentencePieceProcessor, []

    class Counted(plain):
        def encode(self, *args, **kwargs):
            calls.append(1)
            return super().encode(*args, **kwargs)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Counted)
    mixed = ["abc где где", "абв abc", "αβγ δε abc 12", "日本語 日本", "שלום", "हिन्दी", "12 34 ß\u3000é", "١٢ — …", "ᄀ가 \U00020000", "😀 " * 30, "a", "a a", "abc\x0b\n\x0c\ndef\n\x1c\n\x1c\n\u3000\n\u3000"]
    texts = [*corpus, *mixed, *(r[1] for r in EDGE)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(["x"] * len(texts)), pa.array(texts, pa.string())], names=["doc_id", "lang", "text"])
    (out,) = quality.measure(iter([batch]), None, 20, 8, 30)
    assert len(calls) < 20 < len({w for t in texts for w in words(t)})
    sp = plain(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expect = []
    for r, t in zip(out.to_pylist(), texts, strict=True):
        ids = [i for w in words(t) for i in sp.encode(w)]
        entropy = sum(-c / len(ids) * math.log(c / len(ids)) for c in Counter(ids).values()) / math.log(len(ids)) if len(ids) > 1 else 0
        expect.append((len(ids), sum(map(sp.is_byte, ids)), pytest.approx(entropy, abs=1e-9)))
        assert (r["n_tokens"], round(r["byte_share"] * len(ids)), r["token_entropy"]) == expect[-1]
        assert r["chars_per_token"] == (r["word_chars"] / len(ids) if ids else 0)
        lines = (t or "").split("\n")
        assert r["n_dup_lines"] == sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
        blocks = Counter(next(name for name, end in (("latin", 0x250), ("greek", 0x400), ("cyrillic", 0x530), ("semitic", 0x800), ("indic", 0x1000), ("other", 0x2E80), ("cjk", 0xD7FF), ("other", 0x110000)) if ord(c) < end) for c in t or "" if c.isalpha())
        best = min(blocks, key=lambda b: (-blocks[b], b)) if blocks else "none"
        assert r["script"] == ("latin" if (t or "").isascii() else best)
    for chars, most, limit, part in ((1, 1, 1, 1000), (300, 7, 40, 5), (10**9, 10**9, 10**9, 10**9)):
        pieces, got = quality.Pieces(limit=limit, slice=part), []
        for lot in quality.lots(((0, "", t) for t in texts), chars, most):
            assert len(lot) == 1 or len(lot) <= most and sum(len(t or "") for _, _, t in lot) <= chars
            got += zip(*pieces.tally([words(t) for _, _, t in lot]), strict=True)
        assert got == expect


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    texts = ["one line\nthe next  \n\n  last", "a\n\n\nb", "ümlaut é\n日本語\n", *(r[1] for r in EDGE)]
    rows = defaultdict(list)
    for r in token_counts.section_tokens(frame(spark, texts), rule).collect():
        rows[r.doc_id].append(r)
    enc, sizes = token_counts.encoder(None)
    for i, t in enumerate(texts):
        got, lines = sorted(rows[i], key=lambda r: r.section), (t or "").split("\n")
        ids = enc.encode_ordinary(t or "")
        expect, at, bounds = [0.0] * len(lines), 0, np.cumsum([len(x.encode()) + 1 for x in lines])
        section = lambda b: int(np.searchsorted(bounds, b, side="right"))
        for k in ids:
            size = int(sizes[k])
            if rule == "first":
                expect[section(at)] += 1
            elif rule == "last":
                expect[section(at + size - 1)] += 1
            elif len(t) < 10_000:
                for b in range(at, at + size):
                    expect[section(b)] += 1 / size
            at += size
        if rule != "share" or len(t or "") < 10_000:
            assert np.allclose([r.n_tokens for r in got], expect)
        assert abs(sum(r.n_tokens for r in got) - len(ids)) < 1e-6 and all(r.doc_tokens == len(ids) for r in got)
        assert "".join((t or "")[r.start_char : r.end_char] for r in got) == (t or "")
    assert token_counts.section_tokens(empty(spark)).collect() == []
    with pytest.raises(ValueError, match="first"):
        token_counts.section_tokens(empty(spark), "none")
