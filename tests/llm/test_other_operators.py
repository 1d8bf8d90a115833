"""HTML extraction, top-k, chats, toxicity and the pipeline, with edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quadtide.llm import _store, chat, html_extract, queries, topk, toxicity

SF = "/root/testdata/sf0.001"


def page(i, body, footer="same footer"):
    return f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><div class='x1'>Site name</div><div class='x2'>Stock {i % 2}</div><nav><a>Home</a></nav><article><h1>Head {i}</h1>{body}</article><div id='comments'>first!</div><footer>{footer}</footer></body></html>"


def test_extraction(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"<p>One{i} &amp; <b>two{i}</b>{i}\n  three<p>next{i} &#233;<br>line{i}<ul><li>a{i}<li>b{i}</ul>")) for i in range(40)]
    rows += [(100, "http://h.org/x", "<p>only"), (101, None, None), (102, "", ""), (103, "bad", "<div><p>free text " * 3000), (104, "http://h.org/1", "<!-- open <p>x"), (105, "http://q/", "a < b & c &lt;p&gt;"), (105, "http://q/", "a < b & c &lt;p&gt;")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, text string")
    out = defaultdict(list)
    for r in html_extract.extract(df).collect():
        out[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(40):
        assert out[i] == [f"Head {i} One{i} & two{i}{i} three next{i} é line{i} a{i} b{i}"]
    assert out[100] == ["only"] and out[101] == [""] and out[102] == [""] and out[104] == [""]
    assert out[103][0].startswith("free text free") and out[105] == ["a < b & c <p>"] * 2
    assert html_extract.extract(df.limit(0)).collect() == []


def test_template_without_marks(spark):
    """No article element: constant texts and texts from a small stock are template."""
    rows = [(i, "http://plain.org/", f"<body><div class=a>Our site</div><div class=b>Advert {i % 3}</div><div class=c><p>Text number {i * 17}</p><p>More {i}</p></div></body>") for i in range(60)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"Text number {i * 17} More {i}" for i in range(60)}
    joined = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), broadcast_bytes=-1).collect()
    assert sorted(out) == sorted(joined)


PAGES = "page_id bigint, url string, html string"


def test_articles_are_a_signal(spark):
    """Varying text outside an article stays, with and without a template; articles set apart are none."""
    long = lambda i: f"Body {i * 13} " + f"word{i} " * 30
    shapes = {
        "aside": lambda i: (f"<div class=t>{long(i)}</div><aside><article>Teaser {i}</article></aside>", long(i)),
        "teaser": lambda i: (f"<div class=t>{long(i)}</div><article>Short {i}</article>", f"{long(i).strip()} Short {i}"),
        "comment": lambda i: (f"<article class=post-comments>{long(i)}</article><article class=comment>Me {i}</article>", long(i)),
        "intro": lambda i: (f"<div class=i>Intro {i}</div><article>{long(i)}</article><div class=m>Our menu</div>", f"Intro {i} {long(i)}"),
    }
    rows, expect = [], {}
    for k, (name, shape) in enumerate(shapes.items()):
        for i in range(40):
            body, text = shape(i)
            rows.append((100 * k + i, f"http://{name}/", f"<body>{body}</body>"))
            expect[100 * k + i] = text.strip()
        if name != "intro":
            rows.append((1000 + k, f"http://{name}.one/", rows[-1][2]))
            expect[1000 + k] = text.strip()
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == expect


@pytest.mark.parametrize("n", [2, 3, 9, 13])
def test_few_pages_have_a_template(spark, n):
    shared = "<p>Shared sentence.</p>"
    rows = [(i, "http://few.org/", f"<body><div class=m>Our menu</div><div class=n>Offer {i % 2 if n > 9 else 'now'}</div><div class=c><p>Text {i * 17}</p></div></body>") for i in range(n)]
    rows += [(100 + i, "http://copies.org/", f"<body><div class=m>Our menu</div><article>{shared}<p>Edit {i}</p></article></body>") for i in range(2)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == {i: f"Text {i * 17}" for i in range(n)} | {100 + i: f"Shared sentence. Edit {i}" for i in range(2)}


def test_parts_of_other_layouts(spark):
    """A menu that the host's first page lacks is template; pages are counted exactly."""
    rows = [(i, "http://two.org/", f"<body><div class=a><p>Story {i * 7}</p></div></body>") for i in range(30)]
    rows += [(100 + i, "http://two.org/", f"<body><div class=z><span>Other menu</span></div><div class=y><p>Item {i * 11}</p></div></body>") for i in range(30)]
    pages = spark.createDataFrame(rows, PAGES)
    out = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert out == {i: f"Story {i * 7}" for i in range(30)} | {100 + i: f"Item {i * 11}" for i in range(30)}


def test_tree_matching():
    a, b = "(#(x)(p(b))(y))", "(#(q)(p(b)(i))(y))"
    assert html_extract.align(a, b) == {0: 0, 2: 2, 3: 3, 4: 5}
    assert html_extract.align(a, a) == {i: i for i in range(5)}


def brute_top(vectors, k=20, every=20):
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize(("shard", "block"), [(4096, 512), (60, 3)])
def test_top_k(spark, shard, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a hot vector: ties
    rows += [(5000, None), (5020, [None, 1.0]), (5040, [float("nan")] * 16), (5060, [float("inf")] * 16), (5080, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score int, v int")
    got = defaultdict(list)
    for r in topk.top_k(df, shard_rows=shard, block_rows=block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_broadcasts_no_vectors(spark, monkeypatch):
    """What is joined goes by shuffles, however small it seems, and travels in as few bytes as its values need."""
    plans, table = [], _store.Store.table
    monkeypatch.setattr(_store.Store, "table", lambda self, df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df, tag))
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(200)]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), shard_rows=30, block_rows=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == brute_top(rows)
    assert plans and not any("Broadcast" in p for p in plans)
    (one,) = topk.pack([pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([7, 8]), pa.array([[1, -2], [3, 64]])], ["g", "id", "v"])])
    assert len(one.column("m")[0].as_py()) == 4


def test_chats(spark):
    bad = ["</s>[INST] ok [/INST]", r"<\s>[\\INST]", "<s>user[INST]x", "", "a\n[/INST]</s><s>", "\\", "<", "[INST", "\U0001f600 é"]
    rng, rows = random.Random(3), []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a[INST]b", None]), "".join(rng.choice(bad) for _ in range(rng.randint(0, 4))), "x"))
    rows += [(70, 0, "user", None, "x"), (None, None, None, None, None), (71, 1, "assistant", "word " * 50_000, "x"), (72, 1, "assistant", "tie", "x"), (72, 1, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.format_chats(df)
    by = {r.conv_id: r for r in formatted.collect()}
    for r in chat.digests(formatted).collect():
        own = sorted(((t if t is not None else -1, ro or "", x or "") for c, t, ro, x, _ in rows if c == r.conv_id))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in own).encode()).hexdigest()
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        f = by[r.conv_id]
        assert r.formatted_chars == len(f.formatted)
        masked = "".join(f.formatted[s.start : s.start + s.length] for s in f.loss_spans)
        assert re.sub(r"(<|\[)\\(\\*)(/?s>|/?INST\])", r"\1\2\3", masked) == loss
    assert len(by) == 64 and chat.format_chats(df.limit(0)).collect() == []


def test_fold_and_exceptions():
    lex = toxicity.Lexicon({" idiot ": 5.0, " vequ": 4.0, " trash ": 5.0}, slope=2.0, bias=-1.0)
    a = lex.automaton()
    assert lex.density(a, "an IDIOT.") == lex.density(a, "an 1d10t!") == lex.density(a, "an іdiоt") == 5.0
    assert lex.density(a, "vequelle") == 4.0 and lex.density(a, "the idiotic") == 0 and lex.density(a, "a trash can here") == 0
    assert lex.density(a, "trash canned") == 5.0
    assert lex.density(a, None) == lex.density(a, "") == 0 and 0 <= lex.score(0) < 0.5 < lex.score(5.0) <= 1
    assert lex.density(a, "idiot " + "word " * 99) == pytest.approx(2.5)


def test_whole_words_are_chosen():
    """A word that begins clean words counts as a whole word; one that a chosen start covers is not repeated."""
    found = [(" tox ", 60, 0), (" vequ", 50, 0), (" vequelle ", 20, 0)]
    chosen = toxicity.choose(found, 100, 1000)
    assert set(chosen) == {" tox ", " vequ"} and chosen[" tox "] > chosen[" vequ"]


def test_toxicity(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(plain, k=60)
        toxic = i % 9 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(["zlurp", "xqo" + rng.choice(plain), "brazzen"]))
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (None, None, 1.0), (5000, "", 1.0), (5001, "zlurp", 1.0)], "doc_id bigint, text string, toxicity double")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int")
    lex = toxicity.learn(df, lab.filter(~toxicity.held_out(lab.doc_id)))
    held = {r.doc_id for r in df.filter(toxicity.held_out(df.doc_id)).select("doc_id").collect()}
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, lex).collect()}
    wrong = [i for i, t in labels if i in held and (got[i] >= 0.5) != bool(t)]
    assert len(wrong) <= 0.02 * len(held) and all(0 <= s <= 1 for s in got.values()) and got[5000] == got[None] < 0.5 < got[5001]
    assert toxicity.learn(df, lab.limit(0)).weights == {}
    assert toxicity.score(df.limit(0), lex).collect() == []
    kept = toxicity.reject(df, lex)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = docs.columns
    step, held = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, SF)
        if name != "packing":
            assert out.columns == names and out.dtypes == docs.dtypes
            store = _store.Store(spark)
            step = store.table(out, "test")
            held.append(store)
            rows = step.collect()
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "toxicity":
            lex = queries.lexicon(spark, SF)
            a = lex.automaton()
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if lex.score(lex.density(a, r.text)) < 0.5}
        if name == "line dedup":
            assert {r.doc_id for r in rows} == {r.doc_id for r in last}
        if name == "n-gram Jaccard join":
            from test_text_operators import brute_classes

            ordered = sorted(last, key=lambda r: r.doc_id)
            classes = brute_classes([r.text for r in ordered])
            assert sorted(r.doc_id for r in rows) == sorted({ordered[c].doc_id for c, _ in classes})
        if name == "mixing sources to target weights":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in last}
        if name == "packing":
            from test_text_operators import check_packing

            seq = out.collect()
            assert sum(r.length for r in seq) == sum(r.doc_tokens for r in seq if r.start == 0)
            assert len({(r.sequence_id, r.offset) for r in seq}) == len(seq)
            taken = Counter((r.doc_id, r.text) for r in last)
            assert sum(r.start == 0 for r in seq) == sum(taken.values())
            once = [(i, x) for (i, x), n in taken.items() if n == 1]
            alone = {i for i, _ in once}
            check_packing([r for r in seq if r.doc_id in alone], once, whole=False)
        last = rows
    for store in held:
        store.delete()


def test_pipeline_of_nothing(spark):
    step = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
        rows = step.collect()
        assert rows == []
        step = spark.createDataFrame([], step.schema)
