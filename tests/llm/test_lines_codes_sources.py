"""Line dedup, vector codes and the source audit on small awkward tables, each against plain brute force; hard cases of the others."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import html_text, language_id, line_dedup, near_dedup, quality_rules, source_audit, suffix_dedup, tables, toxicity, vector_codes
from tests.llm.samples import SCHEMA, messy_documents, near_components

CLASHING = ("doc", "text_hash", "lines", "others", "place", "line", "key", "h1", "h2", "first", "last", "lost", "kept", "left_text", "n_lines", "kept_sha256")


def line_documents() -> list[tuple]:
    """Shared lines in ids before and after, with white space and capitals around them, repeated rows and ids, NULL ids."""
    rng = random.Random(4)
    shared = ["a line that many share", "ÉCOLE DE NUIT, numéro 5", "école de nuit, numéro 5", "\x0bshort line", "123456789", "1234567890", "日本語のとても長い行です"]
    texts = [None, "", "\n", "\n\n\n", "a line that many share", "A LINE that many SHARE\r\n\n  a line that many share \t"]
    for _ in range(60):
        lines = [rng.choice(shared + ["own line number %d" % rng.randrange(10**6), "", "  "]) for _ in range(rng.randrange(1, 9))]
        texts.append("\n".join(rng.choice(["", " ", "\t\x0c"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) for x in lines))
    texts.append("\n".join(f"long text, line {k % 700}" for k in range(3000)))
    rows = [(5 * k % 64 + 1 if k < 64 else 100 + k, t, None, None, 0, 0.0, 0, "") for k, t in enumerate(texts)]
    again = [(9, "a line that many share\nown text of a repeated id", None, None, 0, 0.0, 0, "")]
    return rows + rows[6:8] * 3 + again + [(None, "a line that many share\nsomething", None, None, 0, 0.0, 0, "")] * 3


def kept_lines(rows: list[tuple], least_chars: int = 10, least_docs: int = 2) -> list[tuple]:
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in ((r[0], r[1] or "") for r in rows if r[0] is not None):
        for line in text.split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in ((r[0], r[1] or "") for r in rows):
        lines = text.split("\n")
        left = [x for x in lines if i is None or len(holders[key(x)]) < least_docs or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("least_docs", [2, 4])
@pytest.mark.parametrize("rows", [line_documents(), messy_documents()])
def test_lines_against_brute_force(spark, rows, least_docs):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = kept_lines(rows, least_docs=least_docs)
    assert any(r[2] for r in expected) or least_docs > 2
    out = line_dedup.digest(docs, least_docs=least_docs)
    wanted = sorted(str((i, n, lost, hashlib.sha256(t.encode()).hexdigest())) for i, n, lost, t in expected)
    assert sorted(str(tuple(r)) for r in out.collect()) == wanted
    texts = line_dedup.cleaned(docs, least_docs=least_docs).select("doc_id", "text").collect()
    assert sorted(str(tuple(r)) for r in texts) == sorted(str((i, t)) for i, _, _, t in expected)


def test_lines_carry_other_columns(spark):
    docs = spark.createDataFrame(line_documents(), SCHEMA).withColumns({c: F.lit(c) for c in CLASHING}).withColumn("with.dot", F.lit(1))
    out = line_dedup.cleaned(docs)
    assert out.columns == docs.columns
    assert out.filter(" OR ".join(f"`{c}` != '{c}'" for c in CLASHING)).isEmpty() and out.count() == docs.count()
    assert line_dedup.cleaned(docs.limit(0)).columns == docs.columns and line_dedup.digest(docs.limit(0)).count() == 0


def test_a_line_in_every_document(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the common footer line\nnumber "), "id", F.lit(" is this one")).alias("text"))
    out = line_dedup.cleaned(docs)
    assert out.filter("text LIKE '%common%'").select("doc_id").collect() == [(0,)] and out.filter("text LIKE 'number%'").count() == 4999


# ---- vector codes ----------------------------------------------------------------------

def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list[tuple], str]:
    """(vec_id, code, error, label_error) of rows (vec_id, vector, label), one dimension."""
    whole = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            c = [math.floor(256 * x) for x in v]
            whole.append((i, c + [0] * (-len(c) % parts), label))
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in whole[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in whole]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(whole, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    errors = [sum(far(cut(v, p), books[p][f[p]]) for p in range(parts)) for (_, v, _), f in zip(whole, found)]
    by_label = Counter()
    for (_, _, label), e in zip(whole, errors):
        by_label[label] += e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    codes = ["".join(f"{e:02x}" for e in f) for f in found]
    return [(r[0], c, e, by_label[r[2]]) for r, c, e in zip(whole, codes, errors)], hashlib.sha256(text.encode()).hexdigest()


def vectors(n: int = 300, dim: int = 32) -> list[tuple]:
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, dim).astype("f4")], None if i % 7 == 0 else int(i % 5)) for i in rng.permutation(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (None, rows[6][1], None), (9991, None, 1), (9992, [1.0] * (dim - 1) + [None], 1)]
    return rows + [(9993, [math.nan] * dim, 1), (9994, [math.inf] + [0.0] * (dim - 1), 1), (9995, [3.0] * dim, 2), (9996, [-0.001] * dim, 2), (9997, [0.0] * dim, 2)]


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_codes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 50 * 32)
    rows = vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({c: F.lit(c) for c in ("dim", "r", "rows", "code", "error", "own_label")})
    out = vector_codes.digest(table)
    expected, checksum = plain_codes(rows, 16, 64, 2)
    assert sorted(str(tuple(r)[:4]) for r in out.collect()) == sorted(map(str, expected))
    assert {r[0] for r in out.select("codebooks_sha256").distinct().collect()} == {checksum}


@pytest.mark.parametrize("n,parts,entries,rounds", [(8, 16, 64, 2), (200, 8, 7, 3), (40, 4, 256, 0), (50, 5, 3, 1)])
def test_other_shapes(spark, n, parts, entries, rounds):
    """Fewer rows than entries, and a dimension that the parts don't divide."""
    rows = vectors(n)
    coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS), parts=parts, entries=entries, rounds=rounds)
    expected, checksum = plain_codes(rows, parts, entries, rounds)
    assert sorted(str(tuple(r)) for r in coded.select("vec_id", "code", "error").collect()) == sorted(str(r[:3]) for r in expected)
    assert hashlib.sha256(vector_codes.books_text(books[32]).encode()).hexdigest() == checksum


def test_decoding_gives_the_error_back(spark):
    rows = [r for r in vectors() if r[0] is not None and r[0] < 9000][:300]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
    errors = {r.vec_id: r.error for r in coded.collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    for r in vector_codes.decode(coded, books[32]).collect():
        assert sum((x - y) ** 2 for x, y in zip(r.vector, whole[r.vec_id])) == errors[r.vec_id]


def test_dimensions_apart_and_nothing(spark):
    rows = vectors(120, 32), [(i + 5000, v, x) for i, v, x in vectors(90, 16) if i is not None]
    out = vector_codes.digest(spark.createDataFrame(rows[0] + rows[1], VECTORS)).collect()
    expected = [plain_codes(part, 16, 64, 2) for part in rows]
    got = sorted(str((r.vec_id, r.code, r.error, r.codebooks_sha256)) for r in out)
    assert got == sorted(str((*e[:3], checksum)) for found, checksum in expected for e in found)
    assert vector_codes.digest(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.digest(spark.createDataFrame([(1, None, None), (2, [None], 1)], VECTORS)).count() == 0
    empty = vector_codes.digest(spark.createDataFrame([(1, [], None), (2, [], 1)], VECTORS)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in empty) == [(1, "00" * 16, 0), (2, "00" * 16, 0)]


def test_too_large_components_are_refused():
    with pytest.raises(ValueError, match="too large"):
        vector_codes.integers(np.array([[1e30, 0.0]]), 2)


# ---- source audit ----------------------------------------------------------------------

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows: list[tuple], least_docs: int, top: int) -> list[tuple]:
    docs = [tuple(x or "" for x in (r[2], r[3], r[1])) for r in rows]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, in_lang, in_docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERMS.findall(low(text))
        counts[lang, source].update(terms)
        in_lang[lang].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, source in counts:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = p_of(counts[lang, source]), p_of(in_lang[lang])
        found = {"pair": [], "term": [(q[t] - p[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]}
        for other in (s for x, s in counts if x == lang and s != source):
            r = p_of(counts[lang, other])
            found["pair"].append((-sum(abs(p[t] - r[t]) for t in kept), other))
        for part, values in found.items():
            ranked = sorted(values, key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(ranked) if part == "pair" or k < top]
    return out


def worded_documents() -> list[tuple]:
    rng = random.Random(8)
    words = [w for k in range(260) for w in [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k % 6]}{'é' if k % 9 == 0 else ''}"]]
    rows = []
    for k in range(700):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "ç", "", None])
        text = rng.choice([" ", "-", "\x00"]).join(rng.choice(words[: rng.choice([3, 40, 260])]) for _ in range(rng.randrange(0, 60)))
        rows.append((k, text.upper() if k % 11 == 0 else text, lang, source, 0, 0.0, 0, ""))
    rows += [(None, None, "xx", "only", 0, 0.0, 0, ""), (1, "one two", "xx", "second", 0, 0.0, 0, ""), (1, "", "lone", None, 0, 0.0, 0, "")]
    return rows + [rows[4]] * 5


@pytest.mark.parametrize("least_docs,top", [(30, 50), (3, 4), (1, 1000)])
def test_sources_against_brute_force(spark, monkeypatch, least_docs, top):
    monkeypatch.setattr(source_audit, "PART", 40)
    rows = worded_documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "band", "word", "item", "value", "rank", "p")})
    out = source_audit.divergence(docs, least_docs, top)
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(map(str, plain_divergence(rows, least_docs, top)))


def test_sources_of_messy_texts(spark):
    rows = messy_documents()
    out = source_audit.divergence(spark.createDataFrame(rows, SCHEMA), 2, 5)
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(map(str, plain_divergence(rows, 2, 5)))
    assert source_audit.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joint_cells_blockwise(monkeypatch):
    rng = np.random.default_rng(6)
    source = np.sort(rng.integers(0, 5, 90))
    p, p0, bits = rng.integers(1, 1000, 90), rng.integers(1, 9, 5)[source], rng.integers(0, 1 << 62, 90).astype(np.uint64)
    present, whole = source_audit.joint_values(source, p, p0, bits)
    for a in range(len(present)):
        for b in range(len(present)):
            expected = sum(
                int(bits[i] & bits[j]).bit_count() * (abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p0[i] - p[j]) + abs(p0[i] - p0[j]))
                for i in np.flatnonzero(source == present[a]) for j in np.flatnonzero(source == present[b])
            )
            assert whole[a, b] == expected
    monkeypatch.setattr(source_audit, "BLOCK", 100)
    assert (source_audit.joint_values(source, p, p0, bits)[1] == whole).all()


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(source_audit, "LONG", 10)
    text = "Über the LONG text; with words_and 12 numbers\x00x" * 5 + "y" * 50
    assert [w for words in source_audit._pieces(text.encode()) for w in words] == [
        w.encode() for w in TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))]


# ---- earlier operators: cases of the last review -----------------------------------------

BODY = "".join(f"<p>Paragraph number {k} has a fair amount of ordinary text in it.</p>" for k in range(6))


@pytest.mark.parametrize("wrapper", [
    '<div class="layout has-sidebar">{}</div>', '<div class="post no-comments">{}</div>', '<div id="content" class="with-sidebar">{}</div>',
    '<div class="ad-free">{}</div>', '<div class="content social-science">{}</div>', '<section class="banner-off"><main>{}</main></section>',
    '<div class="search-result-page"><article>{}</article></div>', "<form>{}</form>", '<form><div class="ad"><div class="x share">{}</div></div></form>',
])
def test_wrappers_named_like_side_parts_hold_the_article(wrapper):
    page = f'<body><nav class="menu"><a href="/">Home</a></nav>{wrapper.format(BODY)}<div class="comments"><p>Nice page.</p></div><footer>foot</footer></body>'
    assert html_text.main_text(page) == " ".join(re.findall("<p>(.*?)</p>", BODY))


def test_pages_of_side_parts_alone_stay_empty():
    for tag in ("nav", "footer", "aside", "dialog"):
        assert html_text.main_text(f"<body><{tag}>{BODY}</{tag}></body>") == ""


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 50_000 + "<p>" * 50_000 + "x", "<div class=ad>" * 20_000 + BODY, "<body>" * 50_000, "<a href=x><b><b>" * 20_000,
])
def test_unclosed_elements_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_quality_rules_carry_columns_of_any_name(spark):
    names = ("_words", "_body", "_lines", "_hashes", "_pairs", "_again", "_distinct", "_row", "with.dot")
    docs = spark.createDataFrame(messy_documents(), SCHEMA).withColumns({c: F.lit(c) for c in names})
    out = quality_rules.quality_rules(docs.withColumns({"kept": F.lit("x"), "n_words": F.lit("y")}))
    assert out.filter(" OR ".join(f"`{c}` != '{c}'" for c in names)).isEmpty()
    plain = quality_rules.quality_rules(spark.createDataFrame(messy_documents(), SCHEMA)).select("doc_id", "n_words", "n_repeat_words", "kept")
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_samples_stay_at_their_bound(spark):
    """A third of NULL ids, and one id in very many rows: no fit reads more rows than its parameter says."""
    many = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 4).cast("bigint").alias("doc_id"), F.concat(F.lit("some words and number "), (F.col("id") % 9000).cast("string")).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    assert tables.hashed_sample(many, 500).count() == 500
    assert tables.hashed_sample(many.limit(30).unionByName(many.limit(30)), 500).distinct().count() == tables.hashed_sample(many.limit(30), 500).count() <= 30
    assert tables.hashed_sample(many.limit(0), 500).count() == 0
    texts, prior = toxicity.sample(many, spark.createDataFrame([(0, 1), (1, 0), (3, 1)], "doc_id bigint, toxic int"), 40, 70)
    assert texts.count() <= 110 and prior > 0
    model = language_id.fit(many, sample_docs=60, steps=5)
    assert model.languages == ["de", "en"]


def test_whole_language_gradient_by_differences():
    """Byte vectors, filters, biases and the last layer of the network, each against differences of a plain forward pass."""
    rng = np.random.default_rng(3)
    windows, labels = rng.integers(97, 120, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    model = language_id.train(windows, labels, ["a", "b", "c"], 3)
    wide = lambda x: x.astype(float)
    model.vectors, model.out, model.out_bias = map(wide, (model.vectors, model.out, model.out_bias))
    model.filters, model.biases = ({w: wide(x) for w, x in d.items()} for d in (model.filters, model.biases))

    def loss() -> float:
        total = 0.0
        for window, label in zip(windows, labels):
            seen = model.vectors[window]
            pooled = [max_of(np.array([seen[k : k + w].ravel() @ model.filters[w] for k in range(len(window) - w + 1)])) + model.biases[w] for w in language_id.WIDTHS]
            raw = np.maximum(np.concatenate(pooled), 0) @ model.out + model.out_bias
            total += np.log(np.exp(raw - raw.max()).sum()) + raw.max() - raw[label]
        return total / len(windows)

    max_of = lambda answers: answers.max(axis=0)
    parts = [model.vectors, *model.filters.values(), *model.biases.values(), model.out, model.out_bias]
    for part, gradient in zip(parts, language_id._gradients(model, windows, labels)):
        used = np.argwhere(np.abs(gradient) > 0)
        for at in map(tuple, rng.permutation(used)[:4]):
            before = part[at]
            part[at] = before + 1e-6
            up = loss()
            part[at] = before - 1e-6
            down = loss()
            part[at] = before
            assert gradient[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_suffixes_of_many_rows_of_one_id(spark):
    """40,000 rows of one id and 40,000 of NULL, beside rows that repeat a passage of it."""
    passage = "a passage that is long enough to be found again wherever it stands in a text"
    many = spark.range(80_000).select(
        F.when(F.col("id") < 40_000, 7).cast("bigint").alias("doc_id"), F.concat(F.lit(passage + " "), (F.col("id") % 3).cast("string")).alias("text"))
    others = spark.createDataFrame([(3, "before " + passage), (9, passage + " after"), (7, "")], "doc_id bigint, text string")
    out = suffix_dedup.digest(many.unionByName(others))
    n = len(passage)
    found = {(r.doc_id, r.n_removed): r["count"] for r in out.groupBy("doc_id", "n_removed").count().collect()}
    assert found == {(None, 0): 40_000, (7, n): 40_000, (7, 0): 1, (3, 0): 1, (9, n + 1): 1}


def test_near_copies_in_one_large_group(spark):
    """Many texts of one kind, most of them under the threshold to each other: links equal those of all pairs."""
    rng = random.Random(12)
    base, words = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(30)]
    rows = []
    for k in range(400):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            own[rng.randrange(60)] = rng.choice(words)
        rows.append((k, " ".join(own), None, None, 0, 0.0, 0, ""))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=3, percent=85)
    assert {r.doc_id: r.component_id for r in out.collect()} == near_components(rows, 3, 85)


def test_only_the_result_of_near_dedup_stays_on_disk(spark, monkeypatch):
    gone, real = [], tables.folders.delete
    monkeypatch.setattr(tables.folders, "delete", lambda spark, path: (gone.append(path), real(spark, path)))
    out = near_dedup.near_duplicates(spark.createDataFrame(messy_documents(), SCHEMA), 3, 85)
    assert len(gone) > 8 and out.count() == len(messy_documents())


def test_pipeline_stages_carry_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    names = ("_score", "_language", "_id", "id", "row", "doc", "part", "places", "with.dot")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
        assert out.filter(" OR ".join(f"`{c}` != '{c}'" for c in names)).isEmpty(), name
