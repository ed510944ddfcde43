"""Text operators against brute force on small tables with nulls, repeats, ties, empty and long texts."""

import functools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.llm import bpe, exact_dedup, html_extract, id_codec, language_id, license_scan, mixing, ngram_join, packing, token_count, topk
from vellumine.llm.bpe import encoder
from vellumine.llm.lattice import lattice
from vellumine.llm.shingles import shingle_sets

BASE = "one two three four five six seven eight nine ten " * 6
TEXTS = [
    (1, "The cat sat on the mat and it was good.", "en", "a"), (2, "The cat sat on the mat and it was good.", "en", None), (3, None, None, "b"), (4, "", "en", "b"),
    (5, "  Le chat\t\testait sur\nla table  avec 'les' autres ", "fr", "a"), (None, "x", "fr", None), (7, "long " * 5000, "en", "c"), (8, " ".join(f"w{k}" for k in range(60)), "en", "c"),
    (9, " ".join(f"w{k}" for k in range(58)) + " other end", "en", "c"), (10, "All rights reserved. Licensed under CC BY-NC 4.0. cc by cc by", "en", "a"), (10, "All rights reserved. Licensed under CC BY-NC 4.0. cc by cc by", "en", "a"),
    (11, "emoji 😀 <|endoftext|> naïve Ⅷ", "en", "d"), (12, "a b", "en", "d"), (13, "A  B", "en", "d"), (14, BASE, "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit("clash")).withColumn("score", F.lit(1))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts_equal_the_unigram_tokenizer(docs, empty):
    from tokenizers import Tokenizer, models

    lat = lattice()
    low = float(lat.scores.min())
    vocab = [("<unk>", 0.0), *zip(lat.pieces, lat.scores.tolist()), *[(f"<0x{i:02X}>", low) for i in range(256)]]
    unigram = Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))
    got = [(r.text, r.n_tokens) for r in token_count.token_counts(docs.withColumnRenamed("n_tokens", "N_Tokens")).collect()]
    assert sorted(n for _, n in got) == sorted(len(unigram.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t, _ in got)
    assert token_count.token_counts(empty).count() == 0


@functools.cache
def _library():
    """The tokenizer as its file gives it, apart from the package's own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _ids(text):
    return _library().encode(text or "", add_special_tokens=False).ids + [2]


def test_memo_encoder_equals_whole_text():
    rng = np.random.default_rng(3)
    parts = ["a", "b's", "it's,", "x,", "\n", " ", "  ", "\t", "<|endoftext|>", "é", "汉字", "12,", "\x1c", "\u180e", "'s", "!?", "A.", "_,", "\r\n", "²,", "ñ.", "ǆ", "Ⅷ"]
    made = ["".join(p + (" " if rng.random() < 0.5 else "") for p in rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    for t in [*(t for _, t, *_ in TEXTS), *made]:
        assert np.frombuffer(encoder().ids(t or ""), "<u4").tolist() == _ids(t)[:-1]


def test_many_texts_at_once_equal_whole_texts(monkeypatch):
    rng = np.random.default_rng(4)
    parts = ["a", "b's", "it's,", "x,", "é***", "12.\"", "'", "'s", "ab'", "_,", "²,", "ñ.", "ǆ!", "汉字。", "\n", "b.\nThe", "\t", "\r\n", "\u180e", "<|endoftext|>", "", " "]
    made = [" ".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(3000)]
    texts = [*(t for _, t, *_ in TEXTS), *made, "\n", " ", "word\nnext line. \"x\"", None]
    monkeypatch.setattr(bpe, "BATCH_BYTES", 5000)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 8)
    for own in (encoder(), bpe.BpeEncoder(public_tokenizers.path(bpe.VOCABULARY))):
        got = list(own.many(pa.array(texts, pa.string())))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [_ids(t)[:-1] for t in texts]
    assert list(encoder().many(pa.array([], pa.string()))) == []


def test_many_texts_ask_the_library_once_for_a_word():
    own, asked = bpe.BpeEncoder(public_tokenizers.path(bpe.VOCABULARY)), []
    word, whole = own.shown_word, own.whole
    own.shown_word, own.whole = lambda w: asked.append(w.replace("Ġ", " ")) or word(w), lambda t: asked.append(t) or whole(t)
    list(own.many(pa.array(["so far, so good", "far; so\nfar, good..."] * 50)))
    assert sorted(asked) == sorted([" far", " so", " good", "so", "far", ",", ";", "..."])


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 511, 513, 5000])
def test_codec_round_trip_and_checksums(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50257
    block = id_codec.encode_ids(ids)
    assert (id_codec.decode_ids(block) == ids).all()
    if n:
        with pytest.raises(id_codec.CorruptBlock):
            id_codec.decode_ids(block[:-1] + bytes([block[-1] ^ 1]))


def test_ranks_are_the_same_by_sort_and_by_hash():
    keys = np.random.default_rng(3).integers(0, 500, 4000)
    by_sort, by_hash = id_codec._ranked(keys, 500), id_codec._ranked(keys, 1 << 62)
    known, rank = np.unique(keys, return_inverse=True)
    for got, distinct in (by_sort, by_hash):
        assert (got == rank).all() and (distinct == known).all()


def test_codec_takes_any_ids_and_comes_near_their_entropy():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 1 << 32, 3000), np.zeros(4000, int), np.array([0, (1 << 32) - 1])):
        assert (id_codec.decode_ids(id_codec.encode_ids(ids)) == ids).all()
    p = 1 / np.arange(1, 41) ** 1.2
    p /= p.sum()
    start = rng.integers(0, 400, 400)  # each id is followed by one of 40, by Zipf's law
    ids = np.zeros(200_000, np.int64)
    for k, r in enumerate(rng.choice(40, len(ids) - 1, p=p)):
        ids[k + 1] = (start[ids[k]] + 7 * r) % 400
    assert len(id_codec.encode_ids(ids)) * 8 / len(ids) < 1.3 * -(p * np.log2(p)).sum()


def test_written_ids_come_back(docs, empty):
    rows = id_codec.encode_and_read_back(docs).collect()
    want = sorted((zlib.crc32(np.array(_ids(t), "<u4").tobytes()), len(_ids(t)), d or -1) for d, t, *_ in TEXTS)
    assert sorted((r.ids_crc32, r.n_tokens, r.doc_id or -1) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert id_codec.encode_and_read_back(empty).count() == 0


def test_shingles_and_components_equal_brute_force(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = [f"v{k}" for k in range(300)]
    rows = [(d, t) for d, t, *_ in TEXTS if d is not None]
    for g in range(12):  # groups of near copies, one large
        base = list(rng.choice(words, 80))
        for c in range(60 if g == 0 else 3):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, 80)] = str(rng.choice(words))
            rows.append((1000 + 100 * g + c, " ".join(w)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(sets):
        low[find(k)] = min(d, low.get(find(k), d))
    assert got == {(d, len(s), low[find(k)]) for k, (d, s) in enumerate(sets)}
    assert [len(s) for s in shingle_sets(["a b", "A  B", None, ""])] == [1, 1, 0, 0]
    assert ngram_join.jaccard_components(empty).count() == 0


def test_block_grids_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    test_shingles_and_components_equal_brute_force(spark, None, spark.createDataFrame([], "doc_id long, text string"))


def test_html_blocks():
    page = "<nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p>A <b>b\n c</p><p><a href=y>only a link to elsewhere</a><div class='comments'>Nice!</div></article><footer>f</footer>"
    assert html_extract.extract(page) == "T & t\n\nA b c\n\nonly a link to elsewhere"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>x</script>") == ""
    prose = "This is the text of the page and it has as many of the small words as one would like to have in it, so that it is in. " * 2
    page = f"<body><div id=sidebar>{prose}</div><div><h2>Head</h2><p>{prose}</p><p>Short.</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></body>"
    assert html_extract.extract(page) == f"Head\n\n{prose.strip()}\n\nShort."


PROSE = "This is the text of the page and it has as many of the small words as one would like to have in it, so that it is in. "


def test_html_names_and_forms_do_not_condemn_the_page():
    prose, more = (PROSE * 4).strip(), (PROSE * 2).strip()
    article, side = f"<article><h1>Head</h1><p>{prose}</p></article>", f"<div class='sidebar'><p>{more}</p></div>"
    for wrapper in ("<div class='content-with-sidebar'>", "<div class='post comments-open'>", "<div class='elementor-widget-container'>", "<form id=aspnetForm>", "<div id=sponsored class='widget'>"):
        end = "</form>" if wrapper.startswith("<form") else "</div>"
        assert html_extract.extract(f"<body>{wrapper}{article}{side}{end}</body>") == f"Head\n\n{prose}"
        assert html_extract.extract(f"<body>{wrapper}<main>{more}</main>{end}{side}{side}</body>") == more
        assert html_extract.extract(f"<body>{wrapper}<p>{prose}</p><p>{prose}</p>{end}{side}</body>") == f"{prose}\n\n{prose}"
    parts = "".join(f"<div class='elementor-widget w{k}'><div class='elementor-widget-container'><p>{prose}</p></div></div>" for k in range(5))
    assert html_extract.extract(f"<body>{parts}{side}</body>") == "\n\n".join([prose] * 5)


def test_html_marks_still_put_boilerplate_out():
    prose, more = (PROSE * 4).strip(), (PROSE * 2).strip()
    comments = "<div id=comments>" + f"<article class=comment><p>{prose}</p></article>" * 9 + "</div>"
    for page in (f"<article><p>{prose}</p></article>{comments}", f"<main><article><p>{prose}</p></article>{comments}</main>", f"<div><p>{prose}</p><p>{prose}</p></div><div class='cookie-notice'><p>{prose * 4}</p></div>"):
        assert set(html_extract.extract(page).split("\n\n")) == {prose} and len(html_extract.extract(page)) <= 2 * len(prose) + 2
    related = f"<div class=related><article><p>{more}</p></article></div>"
    assert html_extract.extract(f"<main><p>{prose}</p>{related}</main>") == prose
    for hidden in ("<div hidden>", "<aside>", "<div role=navigation>", "<div style='display:none'>"):
        assert html_extract.extract(f"{hidden}<article>{prose}</article></{hidden[1:].split()[0].rstrip('>')}>") == ""


def test_html_rules_run_inside_articles():
    prose = (PROSE * 2).strip()
    advert = "Luxury watches, premium brands, unbeatable discounts! Free shipping worldwide, order today!"
    links = "<a href=1>Ten surprising facts about penguins</a> <a href=2>Celebrity homes: photos, prices</a>"
    heading, item = "Quarterly earnings: Acme Corporation, Globex Industries, Initech Software", "Flour 500g, sugar 200g, butter 250g, eggs, vanilla, baking powder, salt"
    body = f"<h1>{heading}</h1><p>{prose}</p><div>{advert}</div><p>Short one.</p><ul><li>{item}</li></ul><p>{links}</p><p>{prose}</p>"
    for tag in ("article", "main"):
        assert html_extract.extract(f"<{tag}>{body}</{tag}>") == f"{heading}\n\n{prose}\n\nShort one.\n\n{item}\n\n{prose}"
    rows = [f"ratio{k} | entry{k} | {k}.25 | Globex | Acme | Initech | Hooli | Umbrella | Stark" for k in range(4)]
    assert html_extract.extract("<article>" + "".join(f"<p>{r}</p>" for r in rows) + "</article>") == "\n\n".join(rows)


def test_html_page_without_article():
    prose = (PROSE * 2).strip()
    page = f"<body><div><a href=1>Home</a> <a href=2>Contact</a></div><div><h1>Head</h1><p>{prose}</p><p>Short.</p><p>{prose}</p></div><div>Luxury watches, premium brands, unbeatable discounts! Free shipping worldwide, order today!</div><div>© 2020 Acme</div></body>"
    assert html_extract.extract(page) == f"Head\n\n{prose}\n\nShort.\n\n{prose}"


def test_html_page_in_another_language():
    polish = [
        "Najstarsze ślady osadnictwa pochodzą z epoki kamienia, a pierwsze wzmianki pisane o grodzie nad rzeką pojawiają się dopiero w kronikach spisanych kilkaset lat później.",
        "Miasto rozwijało się dzięki handlowi solą oraz bursztynem, to tutaj krzyżowały się szlaki kupieckie.",
        "Po wielkim pożarze odbudowano ratusz, kościoły i mury obronne, które przetrwały do dziś w niemal niezmienionym kształcie i przyciągają turystów.",
    ]
    russian = ["Первые письменные упоминания о городе относятся к двенадцатому веку, когда здесь стояла деревянная крепость на высоком берегу.", "Город быстро рос благодаря торговле солью, мехами и янтарём."]
    for texts in (polish, russian, russian[:1], [polish[1]] * 3):
        page = "<body><nav><a href=1>Strona główna</a></nav><div><a href=2>Kontakt</a> <a href=3>Aktualności</a></div>" + "".join(f"<div>{t}</div>" for t in texts) + "<div>© 2020 Muzeum</div><footer>Wszelkie prawa zastrzeżone</footer></body>"
        assert html_extract.extract(page) == "\n\n".join(texts)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>" + "and the of it " * 9000, "y")], "page_id long, url string, html string, text string")
    rows = html_extract.main_text(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 9000 * 14 - 1]


@pytest.mark.parametrize("hot", [64, 1])
def test_exact_dedup(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", hot)
    more = spark.createDataFrame([(d, "same", "en", "a") for d in range(100, 400)], "doc_id long, text string, lang string, source string")
    df = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    for keep, pick in (("smallest", min), ("largest", max)):
        rows = exact_dedup.exact_dedup(df, keep).collect()
        groups = {}
        for d, t in [(d, t or "") for d, t, *_ in TEXTS] + [(d, "same") for d in range(100, 400)]:
            groups.setdefault(t, []).append(d)
        want = sorted((d or -1, (pick([x for x in g if x is not None]) if any(x is not None for x in g) else None) or -1, len(g)) for g in groups.values() for d in g)
        assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in rows) == want
        assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(k, "w " * (k % 37), f"s{k % 5}" if k % 3 else "s0") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = (sorted(map(tuple, mixing.mix(df).collect())) for _ in range(2))
    assert got == again and len(got) == 3000
    per = {}
    for _, s, size, total, target, taken, _ in got:
        assert taken in (0, size, 2 * size) and target <= 2 * total + 1e-6
        x = per.setdefault(s, [0, target])
        x[0] += taken
    assert all(abs(t - a) <= 37 for t, a in per.values())
    assert sum(a for _, a in per.values()) == pytest.approx(1.5 * sum(r[2] for r in got))
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, limit=64).collect()
    seqs, per_doc = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows) == sum(len(_ids(t)) for _, t, *_ in TEXTS)
    assert all(n == 64 for d, ps in per_doc.items() for p, _, n in ps if p)
    assert len(seqs) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack_documents(empty).count() == 0


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400).tolist()
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(100 - n)
    plan = packing.sweep({n: lengths.count(n) for n in set(lengths)}, 100)
    used = {f + k for n, a, b, f, each, _ in plan for k in range(-(-(b - a) // each))}
    assert len(used) == len(gaps)


def test_forward_equals_enumeration():
    lat = lattice()
    prob = np.append(np.random.default_rng(0).random(len(lat.pieces)) * 1e-3, 1e-7)
    at = {p: prob[k] for k, p in enumerate(lat.pieces)}

    def total(w):
        return 1.0 if not w else sum((at.get(w[:k]) or (1e-7 if k == 1 else 0.0)) * total(w[k:]) for k in range(1, len(w) + 1))

    words = ["▁the", "▁thing", "▁ñu😀x"]
    got = language_id.forward(words, prob[:, None])[:, 0]
    assert got == pytest.approx([np.log(total(w)) for w in words])


def test_fit_takes_long_words_whole(monkeypatch):
    words = ["▁" + "internationalisation" * 6, "▁the", "▁" + "的ñ人x" * 200]
    counts = np.array([3, 5, 2])
    alone = language_id.fit(words[:1], counts[:1])[:-1]
    assert alone.max() > 100 * alone.min()
    got = language_id.fit(words, counts)
    monkeypatch.setattr(language_id, "CUT_CHARS", 1 << 20)
    assert got == pytest.approx(language_id.fit(words, counts), rel=1e-6)
    monkeypatch.setattr(language_id, "BATCH_CHARS", 1)
    assert got == pytest.approx(language_id.fit(words, counts), rel=1e-6)


def test_training_splits_as_scoring_and_learns_lines_without_blanks(spark):
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert set(re.findall(language_id.SPACES.rstrip("+"), everything)) == {c for c in everything if c.isspace()}
    rows = [(k, "\t".join(["the", "house", "and", "water"] * 30), "en") for k in range(20)] + [(100 + k, "derhausundwasser" * 20, "de") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, prob = language_id.train(df)
    pieces = lattice().pieces
    for lang, piece in (("en", "▁water"), ("de", "und")):
        column = prob[:-1, languages.index(lang)]
        assert column[pieces.index(piece)] > 100 * np.median(column)


def test_language_accuracy_on_held_out_rows(spark, docs):
    from vellumine.llm import queries

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = queries.identified(df).filter(queries.held_out()).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    none = language_id.predict(docs.drop("score"), [], np.zeros((0, 0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-3, 4, 6).astype(float).tolist()) for k in range(500)] + [(600, None), (700, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [float("nan")] * 6), (None, [1.0] * 6), (900, [0.0] * 6), (1000, [1.0] * 5)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    whole = {k: np.floor(np.array(v) * 1024).astype(int) for k, v in rows[:500] + [rows[504]]}
    want = set()
    for q in (k for k in whole if k % 100 == 0):
        best = sorted((-int(v @ whole[q]), k) for k, v in whole.items() if k != q)[:10]
        want |= {(q, r + 1, k, -s) for r, (s, k) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_top_k_of_repeated_empty_clashing_and_huge_rows(spark):
    rows = [(k, [1.0, float(k % 3)], "x") for k in range(40)] + [(0, [1.0, 0.0], "x")] * 2 + [(50, [], "x"), (51, [1.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, RANK string")
    got = topk.top_k(table, F.col("vec_id") == 0, 3).collect()
    assert sorted(tuple(r) for r in got) == [(0, k, k, 1 << 20) for k in (1, 2, 3)]
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0
    with pytest.raises(OverflowError):
        topk.top_k(spark.createDataFrame([(1, [1e17, 1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 1)


def test_threshold_stops_early_where_few_components_decide():
    rng = np.random.default_rng(4)
    vectors = rng.integers(0, 3, (4000, 8))
    vectors[:, 0] = rng.integers(0, 10_000, 4000)
    assert max(topk.depths(np.arange(4000), vectors, np.arange(0, 4000, 100))) < 0.2


def test_license_scan(docs, empty):
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    r = rows[10]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (14, 4, 0, 12, "cc-by,reserved")
    assert r.labels == "cc-by,cc-by-nc,reserved" and r.score == pytest.approx(0.97)
    assert rows[3].n_words == 0 and rows[3].first_word is None and rows[3].labels == "" and rows[3].score == 0.0
    assert license_scan.scan(empty).count() == 0


def test_license_base_places_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    words = ["cc", "CC", "by", "By-nc", "general", "public", "license", "GENERAL-Public", "all", "rights", "reserved", "é", "x1", "cc-by", "_", "!"]
    rows = [(k, None if k % 50 == 0 else "".join(str(rng.choice(words)) + str(rng.choice([" ", "\n", "-", ". "])) for _ in range(int(rng.integers(0, 60))))) for k in range(600)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(a, label) for phrase, label in license_scan.BASE.items() for a in range(len(found)) if found[a : a + len(phrase.split())] == phrase.split()]
        r, starts = got[k], [a for a, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(found), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_there_are_hundreds_of_hand_written_rules():
    assert len(license_scan.SIGNATURES.strip().splitlines()) >= 200


def test_mixing_sizes_and_targets_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(k, None if k % 40 == 0 else "w " * int(rng.integers(0, 30)), [None, "b", "Z", "é", "a"][int(rng.choice(5, p=[0.05, 0.6, 0.2, 0.1, 0.05]))]) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in mixing.mix(df).collect()}
    sized = [(d, s, len((t or "").split())) for d, t, s in rows]
    sums = {}
    for _, source, size in sized:
        sums[source] = sums.get(source, 0) + size
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sums.values())
    while True:  # hand the excess on until no source is above twice its size
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sums[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sums[s]
            rest -= target[s]
        free -= over
    assert got == {(d, n, sums[s], round(float(target[s]), 6)) for d, s, n in sized}


def _shortest(tree) -> list[str]:
    """A shortest text for every way through an expression's branches."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "BRANCH":
            more = [x for t in arg[1] for x in _shortest(t)]
        elif name == "SUBPATTERN":
            more = _shortest(arg[-1])
        elif name == "MAX_REPEAT":
            more = [x * arg[0] for x in _shortest(arg[2])]
        elif name == "IN":
            more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        else:
            more = [""]
        out = [o + m for o in out for m in more]
    return out


def test_gate_lets_every_rule_pass():
    gate = re.compile(license_scan._gate())
    for _, label, _, _, keyword, expression in license_scan.rules():
        for text in _shortest(re._parser.parse(expression)):
            assert gate.search(text) and keyword in text, (label, text)
    for phrase in license_scan.BASE:
        assert gate.search(phrase)


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert full.filter("n <> m or n > 1024").count() == 0


def test_pipeline_stages_on_repeated_and_null_ids(spark):
    import corpus_pipeline as p

    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "a"), (1, long, "b"), (None, "other text of some words", "a"), (None, None, "b"), (2, "", None), (3, long + " tail", "a"), (1, "one more", None)]
    frame = spark.createDataFrame([(*r, 7, f"k{k}") for k, r in enumerate(rows)], "doc_id long, text string, source string, score int, _row string").withColumn("lang", F.lit("en"))
    name = lambda df: sorted(r["_row"] for r in df.collect())
    exact = p.exact(spark, frame, "")
    assert exact.columns == frame.columns and len(name(exact)) == 5 and {"k2", "k4", "k5", "k6"} < set(name(exact))
    assert len(name(p.near(spark, exact, ""))) == 4 and "k5" not in name(p.near(spark, exact, ""))
    mixed = p.mix(spark, frame, "")
    assert mixed.columns == frame.columns and all(name(mixed).count(k) <= 2 for k in name(mixed))
    told = p.language(spark, frame, "")
    assert told.columns == frame.columns and {r["score"] for r in told.collect()} == {7} and {"k3", "k4"}.isdisjoint(name(told))
    for _, stage in p.STAGES:
        assert stage(spark, frame.limit(0), "").collect() == []
