import html as html_lib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import html_extraction, html_tree, language_id, page_samples, quality_model

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality_model.quality_scores(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()


def test_quality_edges(spark, docs):
    frame = docs([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.quality_scores(frame, none).collect()} == {0.5}
    assert quality_model.quality_scores(docs([]), none).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    assert quality_model.quality_scores(frame, labels, passed=["doc_id", "id"]).columns == ["__row", "held_out", "score", "predicted"]


def test_context_sums_by_hand(spark, docs):
    texts = ["a b c", "b a", None, ""]
    got = quality_model.context_sums(docs(list(enumerate(texts))))
    places, signs = quality_model.index_vectors()
    want = np.zeros_like(got)
    for t in texts:
        slot, _ = quality_model.tokens([t.encode() if t else None])
        for i, s in enumerate(slot):
            for j, other in enumerate(slot):
                if 0 < abs(i - j) <= quality_model.REACH:
                    want[s, places[other]] += signs[other]
    assert (got == want).all()


def test_features_and_scores_by_hand(spark, docs):
    """Pooled features, the forward pass and the temperature, each written out plainly; then the query's scores from them."""
    texts = ["the cat sat on the mat . the cat", "", None, "one", "the the the", "a b c d e f g " * 30]
    frame = docs([(i, t) for i, t in enumerate(texts)])
    vectors = quality_model.word_vectors(quality_model.context_sums(frame))
    got = quality_model.features([None if t is None else t.encode() for t in texts], vectors)
    for row, text in zip(got, texts, strict=True):
        v = [vectors[zlib.crc32(w) % quality_model.SLOTS] for w in quality_model.TOKEN.findall((text or "").encode())]
        want = np.zeros(quality_model.FEATURES)
        if v:
            mean = sum(v) / len(v)
            near = [(float(a @ b), float((a == b).all())) for a, b in zip(v, v[1:])]
            want[: len(mean)], want[len(mean) : 2 * len(mean)] = mean, np.sqrt(np.maximum(sum(x * x for x in v) / len(v) - mean * mean, 0))
            want[-3:-1] = np.mean(near, 0) if near else 0
            want[-1] = math.log1p(len(v))
        assert np.allclose(row, want, atol=2e-4)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality_model.FEATURES)).astype(np.float32)
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(int)
    net = quality_model.Network().fit(x, y, epochs=5)
    for one, score in zip(x[:5], net.scores(x[:5]), strict=True):
        z = (one - net.shift) / net.scale
        hidden = [math.tanh(sum(a * w for a, w in zip(z, column, strict=True)) + b) for column, b in zip(net.w[0].T, net.w[1], strict=True)]
        logit = sum(h * w for h, w in zip(hidden, net.w[2][:, 0], strict=True)) + net.w[3][0]
        assert abs(1 / (1 + math.exp(-logit / net.temperature)) - score) < 1e-9
    held = np.random.default_rng(5).permutation(400)[:80]
    loss = lambda t: sum(math.log1p(math.exp(-a / t)) if b else math.log1p(math.exp(a / t)) for a, b in zip(net.logits(x[held].astype(float)), y[held], strict=True))
    assert net.temperature == min(np.geomspace(0.25, 8, 61), key=loss)
    many = docs([(i, texts[i % 2 * 5] + f" w{i}") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    vectors = quality_model.word_vectors(quality_model.context_sums(many))
    model = quality_model.train(many, labels, spark.sparkContext.broadcast(vectors), "doc_id", "text", "quality", 100)
    scored = {r.doc_id: r.score for r in quality_model.quality_scores(many, labels).collect()}
    for r in many.collect():
        assert abs(scored[r.doc_id] - model.scores(quality_model.features([r.text.encode()], vectors))[0]) < 1e-6


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 1).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark, docs):
    frame = docs([(1, None), (2, "12 .,"), (3, ""), (4, "x" * 500), (5, "wort " * 10)])
    got = {r.doc_id: r for r in language_id.identify(frame, learn_docs=5).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en"}
    untaught = language_id.identify(frame.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    assert language_id.identify(docs([])).count() == 0


def test_letters_are_of_class_l():
    assert not any(language_id.LETTER.search(t) for t in ("½ ² ①", "Ⅷ", "_1", "٣", "😀 !"))
    assert all(language_id.LETTER.search(t) for t in ("1a", "é", "中", "ß", "ʰ"))


def test_a_rare_language_is_learned(spark, docs):
    common = docs([(i, f"the house number {i} is on the hill") for i in range(2000)])
    rare = docs([(5000 + i, "żółw ćma źdźbło ślęża gęś") for i in range(3)], lang="pl")
    model = language_id.learn(common.unionByName(rare), "doc_id", "text", "lang", 40, 8)
    assert model.languages == ["en", "pl"]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = language_id.ByteTagger(["a", "b", "c"], hidden=3)
    runs, label = rng.integers(0, 256, (4, 5)), np.array([0, 1, 2, 1])
    runs[3, 3:] = language_id.PAD

    def loss():
        p = model.probabilities(runs)
        return -np.log(p[np.arange(4), :, label])[runs != language_id.PAD].mean()

    g = model.gradients(runs, label)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape) if name != "x" else (rng.integers(2), runs[rng.integers(3), rng.integers(5)], rng.integers(9))
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-6


def labelled_by_hand(model, text: bytes, windows: bool) -> np.ndarray:
    """The mean probabilities of a text's positions, one position at a time."""
    h, p = model.hidden, model.p
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(d, some):
        state, out = np.zeros(h), []
        for byte in some:
            a, g = p["x"][d, byte], state @ p["u"][d]
            z, r = sigmoid(a[:h] + g[:h]), sigmoid(a[h : 2 * h] + g[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * g[2 * h :])
            out.append(state)
        return out

    total = np.zeros(len(model.languages))
    width = language_id.WIDTH if windows else len(text)
    for at in range(0, len(text), width):
        stop = min(at + width, len(text))
        before, behind = max(0, at - language_id.WARM), min(len(text), stop + language_id.WARM)
        forward = states(0, text[before:stop])[at - before :]
        backward = states(1, text[at:behind][::-1])[::-1][: stop - at]
        for f, b in zip(forward, backward, strict=True):
            e = np.exp(f @ p["o"][0] + b @ p["o"][1] + p["c"])
            total += e / e.sum()
    return total / len(text)


def test_document_probabilities_by_hand():
    """Pooled over every position; windows of several lengths move on together; what lies beyond the warm-up hardly counts."""
    rng = np.random.default_rng(4)
    model = language_id.ByteTagger(["a", "b", "c"], hidden=4).light()
    width, warm = language_id.WIDTH, language_id.WARM
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 2, warm, width - 1, width, width + 1, 3 * width + 7, 700)]
    total, size = model.totals([b"", *texts, b""])
    assert size.tolist() == [0, *map(len, texts), 0] and not total[0].any() and not total[-1].any()
    for t, got in zip(texts, total[1:]):
        assert np.allclose(got / len(t), labelled_by_hand(model, t, True), atol=1e-5)
        assert np.allclose(got / len(t), labelled_by_hand(model, t, False), atol=1e-3)


def test_language_of_long_repeated_and_clashing_rows(spark, docs):
    """Neighbour words count: a text of both languages' words goes to the one that more of it is in."""
    rng = np.random.default_rng(2)
    en, de = "the house is on hill and tree with water from green fields they went home".split(), "das Haus steht auf dem Berg und der Baum im Wasser von grünen Feldern gingen sie heim".split()
    say = lambda words, n: " ".join(rng.choice(words, n))
    frame = docs([(i, say(en, 80)) for i in range(40)]).unionByName(docs([(100 + i, say(de, 80)) for i in range(40)], lang="de"))
    mixed = say(en, 90) + " " + say(de, 10)
    more = docs([(200, say(de, 150_000)), (201, say(de, 90) + " " + say(en, 10)), (202, mixed), (202, mixed)], lang=None)
    every = frame.unionByName(more).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(9.0)).withColumn("held_out", F.lit("x"))
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(every).collect()]
    assert len(got) == 84 and all(lang == ("en" if i < 100 else "de") for i, lang in got if i < 200)
    assert sorted(x for x in got if x[0] >= 200) == [(200, "de"), (201, "de"), (202, "en"), (202, "en")]


def test_stretches_spread_over_the_text():
    text = bytes(range(256)) * 40
    got = language_id.stretches(text, 8)
    assert len(got) == 8 and got[0] == text[: language_id.STRETCH] and got[-1] == text[-language_id.STRETCH :]
    assert language_id.stretches(b"ab", 8) == [b"ab"] and language_id.stretches(b"", 8) == []


@pytest.fixture(scope="module")
def tree_model():
    return html_extraction.trained()


def test_messages_give_exact_marginals():
    page = html_tree.parse("<div class='a'><p>a<b>c</b></p><ul><li>x</li></ul></div>")
    forest = html_extraction.Forest([page])
    rng = np.random.default_rng(1)
    score, pair = rng.normal(size=len(page.tag)), rng.normal(size=(html_extraction.EDGES, 2, 2))
    n = len(page.tag)
    total, each = 0.0, np.zeros(n)
    for bits in range(2**n):
        y = [(bits >> k) & 1 for k in range(n)]
        w = np.exp(sum(score[k] for k in range(n) if y[k]) + sum(pair[forest.edge[k], y[page.parent[k]], y[k]] for k in range(1, n)))
        total += w
        each += w * np.array(y)
    assert np.allclose(forest.marginals(score, pair)[0], each / total)


def right_elements(model, pages) -> float:
    """The share of elements with text of their own that are judged as labelled."""
    right = count = 0
    for source, label in pages:
        page = html_tree.parse(source)
        full = {node for node, _, piece in page.text if piece.strip()}
        got = model.content([page])[0]
        right += sum(got[k] == label[k] for k in full)
        count += len(full)
    return right / count


def test_held_out_pages(tree_model):
    assert right_elements(tree_model, page_samples.samples(140, 77)) > 0.99


@pytest.mark.parametrize("layout", ["columns", "table", "short"])
def test_held_out_layouts(layout):
    """A model that has seen no page of a layout reads that layout's pages."""
    model = html_extraction.trained(420, 3, (layout,))
    assert right_elements(model, page_samples.samples(60, 78, (layout,))) > 0.9


PARAGRAPH = "Some long words stand here, and then more of them follow. " * 4
P = f"<p>{PARAGRAPH}</p>"
TEXT = PARAGRAPH.strip()
PAGES = {
    "comments inside": (f"<html><body><article>{P * 5}<div class='comments'><p>I like this very much, thank you for it. It is good.</p></div></article></body></html>", [TEXT] * 5),
    "form inside": (f"<html><body><article><h1>Head</h1>{P * 3}<form><label>Your name</label><input><button>Send</button></form></article></body></html>", ["Head", *[TEXT] * 3]),
    "things around": (
        f"<html><body><header><h1>Site</h1><p>Best site there is.</p></header><main><article><h1>T</h1>{P * 3}</article><aside class='related'><h3>More</h3><p>Read this too, it is fine.</p></aside>"
        "<form>Name <input><button>Go</button></form><section id='comments'><p>Nice one, I say.</p><p>Not so nice, I think, as it could be.</p></section></main></body></html>",
        ["T", *[TEXT] * 3],
    ),
    "one short paragraph": ("<article><p>Hi.</p></article>", ["Hi."]),
    "behind a notice": ("<html><body><div class='cookie alert'>We use cookies to make this site better. Please accept.</div><article><p>A short paragraph is all.</p></article></body></html>", ["A short paragraph is all."]),
    "two divs": (f"<html><body><div><a href='/'>Home</a> <a href='/b'>About</a></div><div>{P * 2}</div></body></html>", [TEXT] * 2),
    "text in a div": (f"<html><body><div><a href='/'>Home</a> <a href='/b'>About</a></div><div>{PARAGRAPH}</div></body></html>", [TEXT]),
    "paragraphs alone": (P * 2, [TEXT] * 2),
    "only divs": (f"<body><div id='page'><div id='content'><h1>A b</h1>{P * 2}</div><ol class='commentlist'><li><article class='comment-body'>{P}</article></li></ol><div id='sidebar'><ul><li><a href=x>one</a></ul></div></div></body>", ["A b", *[TEXT] * 2]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_hands(tree_model, name):
    source, want = PAGES[name]
    assert tree_model.texts([source]) == ["\n".join(want)]


def test_very_long_pages(tree_model):
    """Reading takes time in proportion to the page, whatever its markup; nothing is cut."""
    import time

    began = time.time()
    for part in ("<div>", "</div>", "</span>", "<li>", "<p>", "<table><td>"):
        html_tree.parse("<ul><li>" + "<ul>" + "<div>" * 30_000 + part * 30_000)
    assert time.time() - began < 20
    source = f"<html><body><nav><a href='/'>Home</a></nav><article>{P * 4000}</article></body></html>"
    assert tree_model.texts([source]) == ["\n".join([TEXT] * 4000)]


def test_extraction(spark, tree_model):
    body = "".join(f"<p>Sentence {i} of the &amp; article,\n  with <b>bold</b> text.<br>" for i in range(4))
    page = f"<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href='/'>Home.</a></li></ul></nav><div class='ad'>Buy now, please.</div><article><h1>Head</h1>{body}</article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<p unclosed"), (5, "u", page[: page.index("<footer>") + 5]), (1, "u", page)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extraction.extract(frame, model=tree_model).collect()}
    want = "\n".join(["Head", *(f"Sentence {i} of the & article, with bold text." for i in range(4))])
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == got[4].text == ""
    assert got[5].text == want
    assert html_extraction.extract(frame.limit(0), model=tree_model).count() == 0


def test_reader_is_forgiving():
    page = html_tree.parse("<ul><li>a<li>b</ul>c<!-- <p>x --><table><tr><td>d<td>e</table></p><img src=\"a>b\">f")
    every = [True] * len(page.tag)
    assert html_tree.blocks(page, every).split("\n") == ["a", "b", "c", "d", "e", "f"]
    assert html_tree.blocks(html_tree.parse("<div>" * 3000 + "deep"), [True] * 3001) == "deep"
    assert html_lib.unescape("&am") == "&am"
