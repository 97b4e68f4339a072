"""The ten operators on small awkward tables, each against brute force, an exact round trip or the library it stands for."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from holdfast.llm import html_text, language_id, licenses, near_dedup, packing, pieces, quality_rules, suffix_dedup, top_k, toxicity
from holdfast.llm.components import components
from holdfast.llm.queries import llm_queries, llm_sql
from tests.compare import check, connect
from tests.llm.samples import SCHEMA, messy_documents, near_components, removed_flags, shingles, unique_documents

ROWS = messy_documents()
WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sf_texts(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_sql_twins(spark, sf_dir, name):
    assert check(spark, connect(sf_dir), sf_dir, llm_queries()[name], llm_sql()[name]) == []


# ---- packing -------------------------------------------------------------------------

def test_word_ids_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(WORD_BPE), packing.WordTokenizer(WORD_BPE)
    texts = sf_texts(spark, sf_dir) + [r[1] or "" for r in ROWS] + [
        "It's<|endoftext|>x <|startoftext|> y", "é é ́x ΑΣ ΟΔΟΣ. İI ﬁ\x1c\x1d\x85\xa0z q", "don't WE'LL I'VE'S", "123abc4, ªº µ ÿ÷×", "a\r\n\x0b\x0cb"
    ]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.ids(texts) == expected


def test_packing_is_gapless_and_best_fit(spark, docs):
    capacity = 64
    out = packing.best_fit(docs, WORD_BPE, capacity).collect()
    own = packing.WordTokenizer(WORD_BPE)
    expected = []
    for i, text in ((r[0], r[1]) for r in ROWS):
        ids = own.ids([text])[0] + (1).to_bytes(4, "little")
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            expected.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expected, key=key)
    places: dict[int, list] = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own_places in places.values():
        end = 0
        for offset, length in sorted(own_places):
            assert offset == end
            end += length
        assert end <= capacity
    gaps: list[int] = []
    for length in sorted((r.length for r in out), reverse=True):  # one after the other, best fit decreasing
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - length)
    assert len(places) == len(gaps)


def test_plan_against_sequential_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity, lengths = int(rng.integers(1, 50)), []
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 150)))
        rows = packing.plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))), capacity)
        gaps: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            fitting = [g for g in gaps if g >= length]
            if fitting:
                gaps.remove(min(fitting))
            gaps.append((min(fitting) if fitting else capacity) - length)
        opened = max((r[3] for r in rows.tolist()), default=-1)
        assert opened < len(gaps) or not len(lengths)


def test_one_length_for_most_pieces(spark):
    pieces_ = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"),
        F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 50 + 1).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("ids_crc32"),
    )
    out = packing.pack(pieces_, 64).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert out.filter("n != end OR n > 64").isEmpty()
    assert packing.pack(pieces_, 64).select("doc_id").distinct().count() == 3000


# ---- toxicity and language -------------------------------------------------------------

def _labelled(spark):
    rng = np.random.default_rng(1)
    clean = ["the cat sat on a mat", "we walk along the river", "bread and butter for tea", "a quiet evening at home"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join(rng.choice(clean, 6)) + (" vile filth vile" if bad else "")
        rows.append((i, text, "en", "s", 1, 0.0, 0, ""))
        if i % 2 == 0 or bad:
            labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (5, 1), (5, 0)]
    return spark.createDataFrame(rows + ROWS, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_held_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MIN_TEXTS", 3)
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count()
    assert out.filter("score < 0 OR score > 1 OR score IS NULL OR predicted != CAST(score >= 0.3 AS INT)").isEmpty()
    found = {r.doc_id: r for r in out.filter("held_out AND doc_id < 400").collect()}
    assert {i for i, r in found.items() if r.predicted} >= {i for i in found if i % 5 == 0 and i > 160}
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in found)


def test_toxicity_without_labels(spark, nothing, docs):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(docs, model).filter("predicted = 1").isEmpty()
    assert toxicity.score(nothing, model).count() == 0


def test_risk_stays_non_negative():
    pairs = [np.array([[0, 1]], np.int32)] * 30 + [np.array([[1, 1]], np.int32)] * 60 + [np.array([[0, 1]], np.int32)] * 10
    weights, bias = toxicity.train(pairs, np.array([True] * 30 + [False] * 70), 2, 0.15, steps=300)
    assert weights[0] > weights[1] and np.isfinite(weights).all() and np.isfinite(bias)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    out = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_language_edges(spark, docs, nothing):
    none = language_id.identify(docs, None)
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and none.count() == len(ROWS)
    model = language_id.fit(docs, steps=20)
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(ROWS)
    predicted, scores = language_id.predict_texts(model, [None, "", " 12 ##", "ab", "x" * 1000])
    assert predicted == ["und", "und", "und", "en", "en"] and scores[0] == 0 and 0 < scores[3] <= 1
    assert language_id.fit(nothing) is None and language_id.identify(nothing, model).count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(0, 30, (6, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    model = language_id.train(windows, labels, ["a", "b", "c"], steps=3)
    for part in (model.vectors, *model.filters.values(), model.out):
        part[...] = part.astype(np.float32)
    loss = lambda: -np.log(model.probabilities(windows)[np.arange(6), labels]).mean()
    gradient = language_id._gradients(model, windows, labels)[-2]
    for at in [(0, 0), (5, 1)]:
        before = model.out[at]
        model.out[at] = before + 1e-2
        up = loss()
        model.out[at] = before - 1e-2
        down = loss()
        model.out[at] = before
        assert abs((up - down) / 2e-2 - gradient[at]) < 1e-2


# ---- suffixes ------------------------------------------------------------------------

def test_suffix_dedup_against_brute_force(docs, nothing):
    out = sorted((tuple(r) for r in suffix_dedup.digest(docs).collect()), key=str)
    expected = []
    for (i, text, *_), flags in zip(ROWS, removed_flags(ROWS)):
        data = (text or "").encode()
        spans = sum(f and not before for f, before in zip(flags, [False, *flags]))
        kept = bytes(b for b, f in zip(data, flags) if not f)
        expected.append((i, len(data), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    assert out == sorted(expected, key=str)
    assert suffix_dedup.digest(nothing).count() == 0


def test_suffix_dedup_in_small_blocks(docs, monkeypatch):
    whole = sorted(map(str, suffix_dedup.digest(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 301)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 40)
    assert sorted(map(str, suffix_dedup.digest(docs).collect())) == whole


def test_cleaned_keeps_rows_and_columns(docs):
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    first = out.filter("doc_id = 1 OR doc_id = 10").orderBy("doc_id").collect()
    assert [r.text for r in first] == ["", "word"]


# ---- html ----------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="page sidebar-left"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy &amp; save</div>
<article><header><h1>Head&shy;line &eacute;</h1></header><p>First   para<b>graph</b>&nbsp;here, of some length.<p>Second one &lt;i&gt; with more &#8220;text&#8221;.<br>Line
two.</p><aside>Side</aside><form>Name <input></form><div id="comments"><p>Reader says a lot about this page and more.</p></div><p>End</p></article>
<div class="cookie-notice">We use cookies</div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == (
        "Head\xadline é First paragraph here, of some length. Second one <i> with more “text”. Line two. End"
    )


@pytest.mark.parametrize("html", [None, "", "   ", "<p>", "<<<>>>", "<script>x", "<nav>only</nav>"])
def test_pages_without_text(html):
    assert html_text.main_text(html) in ("", "<<<>>>")


def test_pages_without_article():
    body = "".join(f"<p>Sentence number {k} of the text goes on for a while.</p>" for k in range(5))
    assert html_text.main_text(f"<nav><a>x</a></nav><div>{body}</div><footer>f</footer>").count("Sentence") == 5


@pytest.mark.parametrize("before", [
    '<body><a name="top"><div>Site</div>', '<body><a href="/x">Site<div>one</div>', '<body><div><a href="/x">Site<a href="/y">two</a></div>',
    '<body><a href="/x">Site<div>one</div><div><a href="/y">two</a></div>', "<head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title>",
    "<head><noscript><img src=x></noscript><link rel=x>", '<body><ul><li><a href="/x">one<li><a href="/y">two</ul>',
])
@pytest.mark.parametrize("region", ["article", "div"])
@pytest.mark.parametrize("link", ["link", '<a href="/z">link</a>'])
def test_exclusions_end(before, region, link):
    words = [f"Sentence number {k} of the text goes on for quite a while, with a " for k in range(4)]
    body = "".join(f"<p>{w}{link} in it.</p>" for w in words)
    text = html_text.main_text(f"<html>{before}<{region}><h1>Head</h1>{body}</{region}></html>")
    assert text.count("Sentence") == 4 and text.endswith("link in it.") and " T " not in f" {text} "


def test_block_links_stay_links():
    parser = html_text.Lines()
    parser.feed('<div><a href="/x"><h3>Card</h3><p>Words of it</p></a><p>Free <a href="/y">link</a></p></div>')
    assert [(x[0], parser.outside_links(k)) for k, x in enumerate(parser.lines)] == [("Card", 0), ("Words of it", 0), ("Free link", 5)]


def test_pages_without_article_keep_short_ends():
    lengths = (20, 600, 700, 500, 20, 25, 15)
    lines = [("lead" if k == 0 else f"p{k}") + "x" * (n - len("lead" if k == 0 else f"p{k}")) for k, n in enumerate(lengths)]
    body = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
    page = '<body><nav><a href="/a">Menu</a></nav><div>Site</div><div class="text">{}</div><footer>us</footer></body>'
    assert html_text.main_text(page.format(body)) == " ".join(lines)
    listed = f"<h1>{lines[0]}</h1><ul>" + "".join(f"<li>{x}</li>" for x in lines[1:4]) + "</ul>" + "".join(f"<p>{x}</p>" for x in lines[4:])
    assert html_text.main_text(page.format(listed)) == " ".join(lines)
    assert html_text.main_text(page.format("".join(f"<section><p>{x}</p></section>" for x in lines))) == " ".join(lines)
    assert html_text.main_text(body) == " ".join(lines)


def test_extract_against_articles(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (out[r.page_id].text, out[r.page_id].n_chars) == (text, len(text))
    assert html_text.extract(pages.limit(0)).count() == 0
    messy = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", PAGE), (2, "u", PAGE)], "page_id bigint, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract(messy).collect())[:2] == [0, 0]


# ---- pieces --------------------------------------------------------------------------

def test_piece_ids_equal_the_library(spark, sf_dir):
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), pieces.encoder(PIECE_BPE)
    texts = sf_texts(spark, sf_dir) + [r[1] or "" for r in ROWS] + [
        "  a  b ", "a\tb\nc\r\n d", "ﬁ ½ 日本語", "a▁b ▁ c", " " * 500 + "x" + " " * 37 + "the", "<s>x</s><unk>", "<0x41>", "\n\n\n a \n b\n", "    日  the"
    ]
    packed = own.ids(texts)
    assert packed == [np.array(ids, "<u4").tobytes() for ids in model.encode(texts)]
    assert [own.decode(p) for p in packed] == [t.replace("▁", " ") for t in texts]


def test_unigram_scores_by_brute_force():
    scores = {"▁": -2.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -1.0, "▁ab": -9.0, "ba": -1.5, "bab": -7.0}
    ids = {p: k for k, p in enumerate(scores)}
    own = pieces.TrieEncoder(pieces.Vocabulary(ids, scores, list(scores), {b: 100 + b for b in range(256)}, merging=False))

    def best(word):
        if not word:
            return 0.0, []
        return max((best(word[:-n])[0] + scores[word[-n:]], best(word[:-n])[1] + [word[-n:]]) for n in range(1, len(word) + 1) if word[-n:] in scores)

    for word in ("ab", "abab", "bab", "babab", "aabb"):
        assert own.ids([word])[0] == np.array([ids[p] for p in best("▁" + word)[1]], "<u4").tobytes()


def test_encode_decode_frames(docs, nothing):
    encoded = pieces.encode(docs, PIECE_BPE)
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == len(ROWS)
    assert sorted(r.text for r in pieces.decode(encoded, PIECE_BPE).collect()) == sorted(r[1] or "" for r in ROWS)
    assert pieces.digest(docs, PIECE_BPE).filter("NOT round_trip").isEmpty() and pieces.digest(nothing, PIECE_BPE).count() == 0


# ---- top k ---------------------------------------------------------------------------

def _best(vectors, k):
    out = []
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in usable:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(top_k, "CHUNK", 60)
    monkeypatch.setattr(top_k, "BLOCK", 3)
    monkeypatch.setattr(top_k, "SEEDS", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, [float(np.float32(x)) for x in (centres[i % 6] + rng.normal(0, 0.05, 8)) * np.exp(spread * rng.normal())]) for i in range(500)]
    vectors += [(i, vectors[3][1]) for i in range(500, 620)]  # a third of all rows alike
    vectors += [(700, None), (750, [None] * 8), (800, [float("nan")] * 8), (850, [float("inf")] * 8), (None, vectors[1][1]), (900, [0.0] * 8), (950, [0.5, 0.25]), (951, [0.5, 0.5])]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("dim", F.lit("x"))
    out = top_k.top_k(table, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, out.collect())) == _best(vectors, 5)
    assert top_k.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- quality -------------------------------------------------------------------------

def _quality(text):
    body = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", body)
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_rules_against_brute_force(docs, nothing, spark):
    again = "one two three four five six seven eight nine ten " * 3 + "- end...\n- end...\n"
    rows = [r for r in ROWS if len(r[1] or "") < 4000] + [(999, again, None, None, None, None, None, None)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in out), key=str)
    assert found == sorted(((r[0], _quality(r[1])) for r in rows), key=str)
    assert not any(r.kept and r.base_failed for r in out)
    assert quality_rules.quality_rules(nothing).count() == 0
    assert "Python" not in quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()


# ---- near duplicates -----------------------------------------------------------------

@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(docs, size, percent):
    out = near_dedup.near_duplicates(docs, size, percent).collect()
    expected = near_components(ROWS, size, percent)
    assert len(out) == len(ROWS)
    for r in out:
        assert r.component_id == expected.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {r[0]: len(shingles(r[1], size)) for r in unique_documents(ROWS)}
    assert all(r.n_shingles == sizes[r.doc_id] for r in out if r.doc_id is not None)


def test_near_duplicates_edges(spark, nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (2, "a b c d e f g"), (9, "h i j k l m n")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in out} == {2}


@pytest.mark.parametrize("percent, shared, own, pairs", [(80, 8, 1, 12000), (50, 4, 2, 100), (10, 2, 9, 100)])
def test_pairs_at_the_threshold_are_candidates(spark, percent, shared, own, pairs):
    assert 100 * shared == percent * (shared + 2 * own)
    rows = []
    for k in range(pairs):
        same = [f"s{k}x{j}" for j in range(shared)]
        rows += [(2 * k + side, " ".join(same + [f"o{k}y{side}z{j}" for j in range(own)])) for side in (0, 1)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, percent)
    assert out.filter("component_id != doc_id - doc_id % 2").count() == 0


def test_banding_miss_at_every_threshold():
    for percent in range(1, 101):
        bands, rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS
    with pytest.raises(ValueError):
        near_dedup.banding(0)


def test_chains_join_into_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[i * 2 : i * 2 + 120])) for i in range(60)]  # neighbours are similar, far ones are not
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.component_id for r in out} == {0}


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    fewest = near_dedup.fewest_matches(0.85)
    matched = rng.random((20000, near_dedup.HASHES)) < 0.85
    alive = np.ones(20000, bool)
    for n in range(near_dedup.BATCH, near_dedup.HASHES + 1, near_dedup.BATCH):
        alive &= matched[:, :n].sum(axis=1) >= fewest[n]
    assert alive.mean() > 0.9995 and fewest[near_dedup.HASHES] > 0.6 * near_dedup.HASHES


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {found[k] for k in (1, 2, 3, 7, 8, 9)} == {1} and found[21] == 20 and {found[k] for k in range(101, 140)} == {100}
    assert {found[k] for k in range(200, 231)} == {200}


# ---- licenses ------------------------------------------------------------------------

def test_licenses_by_aligning_everywhere(spark):
    filler = "lorem ipsum dolor sit amet consectetur "
    apache = licenses.TEMPLATES[1][1]
    texts = [None, "", filler * 3, filler + "Released under the MIT License.\n" + filler, "é " + apache.replace("obtain", "get") + " é",
             filler * 2000 + licenses.TEMPLATES[2][1], "under the license", apache + "\n" + licenses.TEMPLATES[6][1]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id bigint, text string")
    out = sorted((r.doc_id, r.license, texts[r.doc_id][r.span_start : r.span_end]) for r in licenses.scan(docs).collect())
    mit = (3, "MIT", "Released under the MIT License")
    assert out == [mit, mit, (4, "Apache-2.0", apache.replace("obtain", "get")), (5, "MIT", licenses.TEMPLATES[2][1].rstrip(".")),
                   (7, "Apache-2.0", apache), (7, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")]
    for text in filter(None, texts[:5]):  # without the index: the template tried at every place
        words = licenses.words_of([text]).hashes
        best = max(licenses.align(t, words[max(0, s) :], min(0, s), licenses.band_of(len(t)))[0] / len(t)
                   for _, t in licenses.index()[0] for s in range(-len(t), len(words)))
        assert (best >= licenses.LEAST_COVERAGE) == any(texts[i] == text for i, *_ in out)
    assert licenses.scan(docs.limit(0)).count() == 0


def _named(text):
    words = licenses.words_of([text])
    return [m[0] for m in licenses.matches(words.hashes, words.hashes, np.arange(len(words.hashes)))]


@pytest.mark.parametrize("name, text", [
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"), ("MIT", "// SPDX-License-Identifier: MIT"),
    ("AGPL-3.0", "// SPDX-License-Identifier: AGPL-3.0-only"),
])
def test_license_look_alikes(name, text):
    assert _named(text) == _named("lorem ipsum dolor " + text + " sit amet") == [name]


@pytest.mark.parametrize("text", ["Released under an MIT License", "Released under the terms of the MIT License"])
def test_short_notices_are_found_whatever_is_around(text):
    for word in "lorem ipsum dolor sit amet consectetur under the license of".split():
        assert _named(f"{word} {text} {word}") == _named(text) == ["MIT"]


def test_unknown_licenses_are_not_named_after_neighbours():
    for text in ("SPDX-License-Identifier: Zlib", "Licensed under the Apache License, Version 3.0.", "Licensed under CC BY 7.0.", "Released under the Foo License."):
        assert _named(text) == []
    assert sorted(_named("SPDX-License-Identifier: MIT OR Apache-2.0")) == ["Apache-2.0", "MIT"]


def test_whole_license_texts():
    for name, text in licenses.whole_texts():
        words = licenses.words_of([text])
        found = licenses.matches(words.hashes, words.hashes, np.arange(len(words.hashes)))
        assert [(m[0], m[1], m[2], m[4]) for m in found] == [(name, 0, len(words.hashes) - 1, 1.0)]


def test_license_lines_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.filter(F.col("text").rlike("(?i)licensed? under|MIT License")).select("doc_id").distinct().count()
    assert licenses.scan(docs).select("doc_id").distinct().count() == lines > 0
