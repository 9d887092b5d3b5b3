"""Each operator on small, awkward tables, against brute force or an exact round trip."""

from __future__ import annotations

import base64
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyfold.llm import html_text, kneser_ney, merkle, mixing, near_dedup, ngrams, packing, quality_rules, setsketch, sharding, warc, wavelet
from tallyfold.llm.queries import tokenizer_path
from tallyfold.llm.tokens import TokenIds

from .brute import kneser_ney as brute_kneser_ney

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def encode(path: str, text: str) -> list[int]:
    """The library by itself, as it is loaded."""
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("as_text", [False, True])
def test_tokens_are_the_librarys(path, as_text, plain):
    ids = TokenIds(path, path == BYTE, limit=500, specials_as_text=as_text)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = as_text
    texts = ["  a", "a  b", "a \n b\n\n c ", "it's o'clock's 'tis", "\x1c a \x1db", "İ ﬁ q́ ΑΣ Σ.", "<|endoftext|> hi", "a<|startoftext|>b", "\n a", "12ab34 ²³", "", "'", "x're", "é'sé 'llé", "　a　 b\u00a0 c", "“q” — 👍🏽 3½"]
    texts += [t for _, t in plain]
    draw = np.random.default_rng(5)
    letters = np.array(list("ab '  \n\t'sreldmtv1½é ß“.,!<|>ΣςİA👍\u3000"))
    texts += ["".join(draw.choice(letters, draw.integers(0, 30))) for _ in range(2000)]
    for some in (texts, texts[::-1]):
        got, counts = ids.encode([t.encode() for t in some])
        parts = np.split(got, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert ids.encode([None])[1].tolist() == [0] and ids.encode([])[1].tolist() == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tokens_of_every_code_point(path):
    """All code points, also those that the library knows and Python doesn't, alone and before an ending."""
    ids, library = TokenIds(path, path == BYTE), Tokenizer.from_file(path)
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    for form in ("{}", "a{}'s"):
        texts = [" ".join(map(form.format, points[at : at + 32])) for at in range(0, len(points), 32)]
        got, counts = ids.encode([t.encode() for t in texts])
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want))
        assert got.tolist() == [i for w in want for i in w]


def test_packing(docs, empty, plain):
    got = packing.pack_documents(docs, WORD, capacity=256).collect()
    want = []
    for doc_id, text in plain:
        ids = np.array(encode(WORD, text) + [1], "<u4").tobytes()
        want += [(doc_id, p, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024])) for p, at in enumerate(range(0, len(ids), 1024))]
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 256
    assert len(places) <= 1.05 * sum(w[3] for w in want) / 256 + 1
    assert packing.pack_documents(empty, WORD).count() == 0


def test_open_bins_are_bounded():
    bins = packing.OpenBins(100, 3)
    assert [bins.place(n)[0] for n in (60, 70, 80, 90)] == [0, 1, 2, 3]
    assert bins.count == 3 and not bins.bits >> 20 & 1  # the fullest (80) closed for 90
    assert bins.place(30) == (1, 70) and bins.place(41) == (4, 0)


def test_packing_closes_and_stays_full():
    """Far more sequences than may be open: the limit binds and costs little."""
    draw = np.random.default_rng(2)
    lengths = np.minimum(draw.lognormal(6.3, 1.2, 40_000).astype(int) + 1, 4096)
    bins = packing.OpenBins(4096, packing.OPEN_BINS)
    closed = 0
    for at in range(0, len(lengths), packing.LOOKAHEAD):
        for n in sorted(lengths[at : at + packing.LOOKAHEAD].tolist(), reverse=True):
            before, opened = bins.count, bins.opened
            bins.place(n)
            closed += bins.opened > opened and before == packing.OPEN_BINS
            assert bins.count <= packing.OPEN_BINS
    least = lengths.sum() / 4096
    assert closed > 100 and least > 10 * packing.OPEN_BINS and bins.opened <= 1.02 * least


def test_packing_special_tokens(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|> hi"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs, WORD).collect()}
    assert got == {1: zlib.crc32(np.array(encode(WORD, "<|endoftext|> hi") + [1], "<u4").tobytes()), 2: zlib.crc32(np.array([1], "<u4").tobytes())}


@pytest.mark.parametrize("block_bits", [64, 1024, 1 << 19])
def test_wavelet_matrix(tmp_path, block_bits):
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 5000), 50256).astype("<u4")
    path = str(tmp_path / "x.wvm")
    wavelet.write_matrix(path, ids, [1000, 5000], [4, None], 16, block_bits)
    m = wavelet.WaveletMatrix(path)
    assert (m.decode() == ids).all() and m.doc_ids.tolist() == [4, wavelet.NO_ID]
    assert all(m.access(i) == ids[i] for i in range(0, 5000, 97))
    for token in (1, 2, 7, 50256, 49999, 1 << 20):
        at = np.flatnonzero(ids == token)
        assert m.count(token) == len(at) and m.rank(token, 2500) == (at < 2500).sum()
        assert m.occurrences(token).tolist() == at.tolist()
        assert all(m.select(token, k) == at[k] for k in range(0, len(at), 371))
    wavelet.write_matrix(path, ids[:0], [], [], 16, block_bits)
    assert wavelet.WaveletMatrix(path).count(1) == 0 and len(wavelet.WaveletMatrix(path).decode()) == 0


def test_token_files_round_trip(docs, empty, plain):
    manifest = wavelet.write_token_files(docs, BYTE, shard_ids=2000)
    assert manifest.count() > 1
    start, want = 0, []
    for doc_id, text in sorted(plain):
        ids = encode(BYTE, text) + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, wavelet.token_index(manifest).collect())) == want
    assert wavelet.token_index(wavelet.write_token_files(empty, BYTE)).count() == 0


def test_html_blocks():
    article = "The first part of it is in the house and on the hill, as it was for all of us in that year of the war and the peace that came to be with them."
    page = f"""<html lang=en><head><title>no</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></ul></nav>
      <header class="top">Site name</header><div class="cookie-notice">We use cookies &amp; more of the things that you know and we do.</div>
      <article><h1>A  title</h1><p><b>One &lt;two&gt;<br><p>{article}</p><p>Es.</p><form><input>Name</form><section id="comments"><p>{article}</p></section></article>
      <aside>aside</aside><footer>&copy; someone</footer><script>var x = "<p>no</p>";</script></body>"""
    assert html_text.main_text(page) == f"A title\nOne <two>\n{article}\nEs."
    bare = f"<body><div><a href=x>link one</a> <a href=y>two</a></div><p>{article} {article}</p><p>Short.</p><p>{article} {article}</p><div>menu | of | many | things | without | any | stop | words | whatsoever | here | now | then</div>"
    assert html_text.main_text(bare) == f"{article} {article}\nShort.\n{article} {article}"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""


ART = "The first part of it is in the house and on the hill, as it was for all of us in that year of the war and the peace that came to be with them."
LIST = "widget gadget price stock order code colour weight height depth length " * 4


def test_blocks_inside_articles_are_judged():
    links = "<ul>" + "<li><a href=x>other story here</a></li>" * 5 + "</ul>"
    page = f"<main><p>{ART}</p><p>{LIST}</p><p>{ART}</p>{links}<p>{LIST}</p></main><p>{ART}</p>"
    assert html_text.main_text(page) == f"{ART}\n{LIST.strip()}\n{ART}"  # tables inherit, link lists go, outside is bad
    near = f"<main><p>{ART}</p><p>zz qq</p>{links}<p>qq rr</p>{links}</main>"
    assert html_text.main_text(near) == ART  # both stand as near to a link list and hold no stop word
    assert html_text.main_text(near.replace("zz qq", "it was")) == f"{ART}\nit was"
    assert html_text.main_text(f"<main><p>{ART}</p><h2>zz qq</h2>{links}</main>") == ART  # a heading goes with what follows
    assert html_text.main_text("<main><p>Short.</p><p>Rows</p></main>") == "Short.\nRows"
    assert html_text.main_text(f"<div>{LIST}</div><p>{ART} {ART}</p>") == f"{ART} {ART}"


def test_class_names_need_evidence():
    for name in ("has-sidebar", "ad", "related", "social", "notice", "menu"):
        assert html_text.main_text(f'<div class="{name}"><article><p>{ART}</p></article></div>') == ART
        assert html_text.main_text(f'<div class="{name}"><p>{ART} {ART}</p></div>') == f"{ART} {ART}"  # most of the page
    page = f"<p>{ART} {ART}</p><div class='x ad'><p>{ART}</p></div><div id=comments><p>{ART} {ART} {ART}</p></div>"
    assert html_text.main_text(page) == f"{ART} {ART}"
    assert html_text.main_text(f"<p>{ART} {ART}</p><div class='no-ads with-menu'><p>{ART} {ART}</p></div>").count(ART) == 4


def test_unclosed_elements_swallow_nothing():
    for tag in ("video", "object", "select", "svg", "math", "canvas"):
        assert html_text.main_text(f"<main><{tag}><p>{ART}</p></main>") == ART
    assert html_text.main_text(f"<main><object><object>x</object>y</object><p>{ART}</p></main>") == ART
    assert html_text.main_text(f"<main><p>{ART}</p><script><p>{ART}</p></main>") == ART
    assert html_text.main_text(f"<main><p title=don't data-x='a>b'>{ART} <math>a<sup>2</sup></math></p></main>") == f"{ART} a2"
    assert html_text.main_text(f'<main><p title="never ends>{ART}</p></main>') == ART


def test_broken_pages_take_linear_time():
    pages = ["<b " * 60_000, "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 30_000 + "<p>x" * 30_000, '<a b="' * 30_000, "<html " * 30_000 + ">", "<a " + "x" * 300_000 + ">", "<svg>" * 30_000, "<div class=ad>" * 20_000 + "x", "<!--" * 60_000, "<script>" * 30_000]
    begin = time.process_time()
    for page in pages:
        html_text.main_text(page)
    assert time.process_time() - begin < 20


def test_second_pass():
    G, B, A = html_text.GOOD, html_text.BAD, html_text.AMBIGUOUS
    draw = np.random.default_rng(4)
    for _ in range(2000):
        n = int(draw.integers(0, 9))
        labels, leans = [[G, B, A, A][k] for k in draw.integers(0, 4, n)], [[G, B, None][k] for k in draw.integers(0, 3, n)]
        want = []
        for i, label in enumerate(labels):
            near = sorted((abs(i - j), j, x) for j, x in enumerate(labels) if x is not A)
            least = [x for d, _, x in near if d == near[0][0]]
            want.append(label if label is not A else 7 if not near else least[0] if len(set(least)) == 1 else least[1] if leans[i] is None else leans[i])
        assert html_text.second_pass(labels, leans, 7) == want
        sided = [G if x is None else x for x in leans]
        assert html_text.second_pass(labels[::-1], sided[::-1]) == html_text.second_pass(labels, sided)[::-1]


def pages(spark):
    rows = [(5, "u\r\nx", "<p>é</p>", "z"), (2, None, "<p>é</p>", "z"), (9, "u", None, "z"), (10, "u", "", "z"), (11, "u", "y" * 3_000_000, "z"), (5, "u", "<p>é</p>", "z"), (None, "u", "<p>é</p>", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, path string")


def test_extract_and_warc(spark, monkeypatch):
    df = pages(spark)
    assert sorted((r["page_id"] or -1, r["text"][:9]) for r in html_text.extract(df).collect()) == [(-1, ""), (2, ""), (5, ""), (5, ""), (9, ""), (10, ""), (11, "")]
    for limit in (0, warc.BROADCAST_FIRSTS):  # both ways of the join
        monkeypatch.setattr(warc, "BROADCAST_FIRSTS", limit)
        manifest = warc.write_bundles(df, frame_bytes=1000)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(manifest).collect()), key=repr)

    def digest(text):
        return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()

    e = digest("<p>é</p>")
    want = [(-1, 9, e, "revisit", 2), (2, 9, e, "response", None), (5, 9, e, "revisit", 2), (5, 9, e, "revisit", 2), (9, 0, digest(""), "response", None), (10, 0, digest(""), "revisit", 9), (11, 3_000_000, digest("y" * 3_000_000), "response", None)]
    assert got == sorted(want, key=repr)
    path = manifest.first()["path"]
    records = [r for m in manifest.collect() for r in warc.Bundle(m["path"]).records()]
    assert len({r["record_id"] for r in records}) == len(records) == 7
    bundle = warc.Bundle(path)
    some = int(bundle.index["page_id"][0])
    assert bundle.find(some)[0]["page_id"] == some and bundle.find(-5) == []
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_quality_base_counts(docs, empty, plain):
    got = {(r["doc_id"]): r for r in quality_rules.quality_rules(docs).collect()}
    for doc_id, text in plain:
        words = text.encode().split()
        runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
        seen, lines = set(), 0
        for line in text.split("\n"):
            lines += line in seen and bool(line.encode().split())
            seen.add(line)
        r = got[doc_id]
        chars = sum(len(w.decode()) for w in words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), chars, sum(map(text.count, "#*$%&|<>")), lines, len(repeated))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_divergence_finds_junk(spark):
    base = "/root/testdata/sf0.01"
    out = quality_rules.quality_rules(spark.read.parquet(f"{base}/documents.parquet")).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.4 * (n[0, False] + n.get((0, True), 0))


def test_sharding_odd_rows(spark, empty, tmp_path):
    names, weights = ["a", "b", "c"], [1, 5, 2]
    table = sharding.fill_table(names, 101, weights)
    turns = [s for s, w in enumerate(weights) for _ in range(w)]
    order = {s: [(sharding._number(n, "offset") + j * (sharding._number(n, "skip") % 100 + 1)) % 101 for j in range(101)] for s, n in enumerate(names)}
    taken = [-1] * 101
    while -1 in taken:
        for s in turns:
            free = next((x for x in order[s] if taken[x] < 0), None)
            if free is not None:
                taken[free] = s
    assert table == taken
    assert sharding.place(empty, names, 101).count() == 0
    rows = spark.createDataFrame([(None, "x"), ("null", "y"), ("7", "z"), ("7", "z")], "doc_id string, shard string")
    got = sharding.place(rows, names, 101, weights).collect()
    assert len(got) == 4 and sharding.place(rows, names, 101).columns == ["doc_id", "slot", "shard"]
    slots = {r["doc_id"]: r["slot"] for r in sharding.place(rows, names).collect()}
    assert slots[None] != slots["null"]
    sharding.write_shards(rows, str(tmp_path / "out"), names, 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "slot", "shard").collect()), key=repr) == sorted(map(tuple, sharding.place(rows, names, 101).collect()), key=repr)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 101)


def test_rows_without_doc_id(spark):
    """Near duplicates, fingerprints and classifier keep every row that has no doc_id."""
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text, "en"), (None, text, None), (4, text, "en"), (2, text, "en"), (9, None, "en")], "doc_id long, text string, lang string")
    got = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 36, None, True)] * 2 + [(4, 36, 2, False), (2, 36, 2, True), (9, 0, 9, True)], key=repr)
    prints = merkle.fingerprint_documents(df, ranges=2).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in prints) == [(False, 0), (False, len(text)), (False, len(text)), (True, len(text)), (True, len(text))]
    assert len({r["fingerprint"] for r in prints if r["n_chars"]}) == 1
    verdicts = kneser_ney.classify(df, df.select("doc_id").filter("doc_id is not null")).collect()
    assert len(verdicts) == 5 and all(r["kept"] for r in verdicts)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sharding(docs, spark):
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, 101)
    taken, turns = [-1] * 101, [0] * 7
    done = 0
    while done < 101:  # the definition, without counters for the place in the order
        for s, name in enumerate(names):
            order = [(sharding._number(name, "offset") + j * (sharding._number(name, "skip") % 100 + 1)) % 101 for j in range(101)]
            free = next((x for x in order if taken[x] < 0), None)
            if free is not None:
                taken[free] = s
                done += 1
    assert table == taken and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 101)
    kept = [a == b for a, b in zip(table, fewer) if a != 6]
    assert sum(kept) >= 0.7 * len(kept)
    rows = sharding.place(docs, names, 101).collect()
    assert len(rows) == docs.count()
    assert all(r["shard"] == table[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:12], 16) % 101] == table[r["slot"]] for r in rows)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)


def test_kneser_ney_by_brute_force(spark):
    taught = ["banana band ban and an a bandana", "a band and a banana\n an and"]
    rows = [("en", t, True) for t in taught] + [("en", "zebra band 👍 x", False), (None, "ab", True), ("en", None, False)]
    grams = kneser_ney.gram_counts(spark.createDataFrame(rows, "lang string, text string, teaches boolean"))
    table = kneser_ney.probabilities(grams, kneser_ney.train(grams)).collect()
    p = brute_kneser_ney(taught)
    show = lambda g: "".join(chr(g >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0))
    got = {show(r["gram"]): r["p"] for r in table if r["lang"] == "en"}
    needed = {x[i - 3 : i + 1] for t in [r[1].replace("👍", "\uffff") for r in rows[:3]] for x in ["   " + " ".join(t.split()) + " "] for i in range(3, len(x))}
    assert set(got) == needed and all(v == pytest.approx(p(g), rel=1e-12) for g, v in got.items())
    symbols = set("".join(taught).replace("\n", " "))
    assert sum(p("ban"[:3] + s) for s in symbols) + p("ban?") == pytest.approx(1.0)
    costs = {(r["lang"], r["gram"]): r["cost"] for r in kneser_ney.gram_costs(spark.createDataFrame(table)).collect()}
    runs, counts = ngrams.gram_runs(["zebra band".encode(), None, b" "])
    assert counts.tolist() == [11, 0, 0]
    tables = {"en": tuple(np.array(c) for c in zip(*sorted((g, c) for (lang, g), c in costs.items() if lang == "en")))}
    want = sum(round(-np.log(p(show(g))) * kneser_ney.UNIT) for g in runs.tolist())
    assert ngrams.text_costs(tables, ["en", "xx", "en"], [b"zebra band", b"a", b""]) == [(want, 11), None, None]


def test_classifier_paths_agree(docs, empty, spark):
    trusted = docs.filter("doc_id < 120").select("doc_id").distinct()
    a = sorted(map(tuple, kneser_ney.classify(docs, trusted).collect()), key=repr)
    b = sorted(map(tuple, kneser_ney.classify(docs, trusted, broadcast_grams=0).collect()), key=repr)
    assert a == b and len(a) == docs.count()
    assert sum(r[4] is not None for r in a) > 10 and all(r[5] for r in a if r[3] is None)
    assert kneser_ney.classify(empty, trusted).count() == 0
    assert all(r[5] for r in kneser_ney.classify(docs, trusted.limit(0)).collect())


def test_classifier_limits_by_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, ["en", None][i % 2], bool(i % 3), int(c), int(n)) for i, (c, n) in enumerate(zip(draw.integers(10**7, 10**9, 600), draw.integers(0, 400, 600)))]
    got = {r["doc_id"]: r for r in kneser_ney.judge(spark.createDataFrame(rows, kneser_ney.SCORES)).collect()}
    for lang in ("en", None):
        own = [r for r in rows if r[1] == lang]
        held = [r for r in own if r[2] and r[4]]
        mean = sum(r[3] for r in held) / sum(r[4] for r in held)
        rate = lambda r: int((r[3] + 200 * mean) / (r[4] + 200) / 2**20 * 1000 + 0.5)
        rates = sorted(map(rate, held))
        limit = max(rates[int(np.ceil(0.99 * len(rates))) - 1], int(np.mean(rates) + 3 * np.std(rates) + 0.5))
        assert all(got[r[0]]["kept"] == (rate(r) <= limit) for r in own)


def test_classifier_against_labels(spark):
    """Held-out quantiles leave clean documents and catch labelled junk, by the classifier alone."""
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    out = kneser_ney.classify(spark.read.parquet(f"{base}/documents.parquet"), kneser_ney.trusted_ids(labels))
    n = {(r["quality"], r["kept"]): r["count"] for r in out.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


def test_mixing(docs, empty):
    out = mixing.mix(docs).toPandas()
    assert len(out) == docs.count() and (out["taken"] <= 2 * out["size"]).all()
    assert out.groupby("target")["target"].first().sum() <= 1.5 * out["size"].sum() + 1e-6
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(map(tuple, out.values)) == sorted(map(tuple, again.values))
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.select(mixing.n_words().alias("n")).agg({"n": "sum"}).first()[0] == out["taken"].sum()
    assert mixing.mix(empty).count() == 0


def test_mixing_by_brute_force(spark):
    """Copies by bisection of the level, then Pareto order in plain Python; null and repeated doc_ids among the rows."""
    draw = np.random.default_rng(6)
    rows = [(i if i % 9 else None, " ".join(["w"] * int(n)) + f" t{i}", ["a", "b", None][i % 3 if i % 2 else 0]) for i, n in enumerate(draw.integers(0, 2000, 400))]
    rows += [rows[5]] * 3 + [(None, None, "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes = [len((t or "").split()) for _, t, _ in rows]
    want = []
    for source in ("a", "b", None):
        here = [(r, n) for r, n in zip(rows, sizes) if r[2] == source]
        total = sum(n for _, n in here)
        target = got[got["source_size"] == total]["target"].iloc[0]
        low, high = 0.0, 2.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(2.0, mid * max(1, n.bit_length())) for _, n in here) < target else (low, mid)
        copies = [min(2.0, high * max(1, n.bit_length())) for _, n in here]
        if 2 * total - target < 1e-6:
            copies = [2.0] * len(here)
        order, left = {}, target
        for (r, n), c in zip(here, copies):
            key = str(r[0]) if r[0] is not None else "null:" + hashlib.md5((r[1] or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c - int(c)
            left -= int(c) * n
            if p > 0:
                order.setdefault((u / (1 - u) / (p / (1 - p)), key), []).append((r, n, int(c)))
            else:
                want.append((n, total, int(c) * n))
        before = 0
        for group in (order[k] for k in sorted(order)):
            more = before + sum(n for _, n, _ in group) / 2 <= left
            before += sum(n for _, n, _ in group)
            want += [(n, total, (c + more) * n) for _, n, c in group]
        assert abs(sum(w[2] for w in want if w[1] == total) - target) <= 2001
    assert sorted(zip(got["size"], got["source_size"], got["taken"])) == sorted(want)


def brute_groups(plain):
    sets = {}
    for doc_id, text in plain:
        w = text.encode().lower().split()
        sets.setdefault(doc_id, set()).update({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                i = len(sets[x] & sets[y])
                if i and 100 * i >= 75 * (len(sets[x]) + len(sets[y]) - i):
                    label[x] = label[y] = min(label[x], label[y])
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_near_duplicates(docs, empty, plain):
    got = near_dedup.near_duplicates(docs).collect()
    want = brute_groups(plain)
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("family, sizes", [(1600, [(4096, 500_000), (200, 50_000)]), (5000, [(4096, 500_000)])])
def test_near_duplicates_in_a_family(spark, monkeypatch, family, sizes):
    """Pairs at 0.762 among ``family`` texts that are 0.70 to each other and to the pairs."""
    own = lambda i, n: [f"o{i}x{k}" for k in range(n)]
    common = [f"c{k}" for k in range(284)]
    texts = [common + own(i, 60) for i in range(family)]
    for i in range(100):
        shared = [f"p{i}x{k}" for k in range(14)]
        texts += [common + shared + own(10 * family + 2 * i + side, 46) for side in (0, 1)]
    at = list(range(len(texts)))
    np.random.default_rng(3).shuffle(at)
    docs = spark.createDataFrame([(at[i], " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {d: d for d in at} | {max(at[k : k + 2]): min(at[k : k + 2]) for k in range(family, family + 200, 2)}
    for part, block in sizes:
        monkeypatch.setattr(near_dedup, "PART_ROWS", part, raising=False)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block, raising=False)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
        lost = [d for d in want if got[d] != want[d]]
        assert not lost, f"{len(lost)} of 100 links lost"


def test_sketch_estimates():
    words = [f"w{i}".encode() for i in range(3000)]
    texts = [b" ".join(words[:2000]), b" ".join(words[200:2200]), b" ".join(words[1900:])]
    hashes, sizes = setsketch.shingle_sets(texts)
    rows = setsketch.sketches(hashes, sizes)
    got = setsketch.likely_similarity(rows[[0, 0]], rows[[1, 2]], sizes[[0, 0]].astype(float), sizes[[1, 2]].astype(float))
    assert abs(got[0] - 1796 / 2196) < 0.15 and got[1] < 0.2
    both = np.unique(np.concatenate((hashes[: sizes[0]], hashes[sizes[0] : sizes[0] + sizes[1]])))
    assert (setsketch.sketches(both, np.array([len(both)]))[0] == np.maximum(rows[0], rows[1])).all()


def test_merkle(docs, empty, plain):
    got = sorted((tuple(r) for r in merkle.fingerprint_documents(docs, ranges=4).collect()), key=repr)
    order = sorted(set(plain), key=lambda r: -r[0])
    repeated = [d for d, n in Counter(d for d, _ in plain).items() if n > 1]
    want = []
    rows = sorted(plain, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed = merkle.fingerprint(text), merkle.fingerprint(edited)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, merkle.likeness(own, changed), merkle.likeness(own, merkle.fingerprint(after))))
    assert got == sorted(want, key=repr)
    assert len(order) + len(repeated) == len(plain)
    assert merkle.fingerprint_documents(empty).count() == 0


def test_merkle_tree_locates_edits():
    a = "one two three\nfour five six\n\nseven eight nine"
    b = a.replace("five", "5")
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert x != y and {(s, p) for s, p, _ in merkle.differing(x, y)} == {(0, 1)}
    assert merkle.fingerprint(a) == x and merkle.likeness(x, x) == 1 and 0 < merkle.likeness(x, y) < 1
    assert len({merkle.fingerprint(t) for t in ("", "\n", "a", "a\n", "a\n\n", "a\nb", "a\n\nb", "a b")}) == 8


def brute_leaves(text: str) -> list[bytes]:
    """Leaves by the definition: byte by byte, a cut after a blank whose three bytes before hash to 0."""
    out = []
    for line in text.encode().split(b"\n"):
        start = 0
        for at in range(3, len(line)):
            if line[at] == 32 and len(line) >= 12:
                mixed = (line[at - 1] * 0x9E37 + line[at - 2] * 0x79B9 + line[at - 3] * 0x3C6F) * 0x85EBCA6B % 2**32
                if (mixed >> 16) % (3 if at < 96 else 8) == 0:
                    out.append(line[start : at + 1])
                    start = at + 1
        out += [line[start:]] if start < len(line) or not line else []
    return out


def test_merkle_likeness_by_brute_force(plain):
    texts = [t for _, t in plain if t.replace("\n", "")][:40]
    for a, b in zip(texts, texts[1:] + texts[:1]):
        for edited in (b, a[: len(a) // 2] + b):
            x, y = ([leaf for leaf in brute_leaves(t)] for t in (a, edited))
            blank = lambda t, leaves: [v for v in leaves if v] if any(leaves) else leaves[:1]
            x, y = blank(a, x), blank(edited, y)
            shared = sum(min(x.count(v), y.count(v)) for v in set(x))
            got = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(edited))
            if "\n\n" not in a + edited:
                assert got == pytest.approx(shared / max(len(x), len(y)), abs=1e-6) or a == edited


def test_merkle_inserted_paragraph():
    lines = [f"the {i} first words of line {i} and then some more of them" for i in range(50)]
    a = "\n".join(lines)
    b = "\n".join([*lines[:10], "an inserted paragraph stands here", *lines[10:]])
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle.differing(x, y) == [] and {p for _, p, _ in merkle.differing(y, x)} == {10}
    moved = merkle.fingerprint("\n\n".join(["another section", a, "end"]))
    assert merkle.differing(x, moved) == []


def test_merkle_unrelated_long_texts():
    """Leaves of unrelated texts of 120,000 words don't meet by chance; nodes are in the fingerprint."""
    long = lambda name: "\n".join(" ".join(f"{name}{i}x{k}" for k in range(40)) for i in range(3000))
    a, b = merkle.fingerprint(long("a")), merkle.fingerprint(long("b"))
    assert merkle.likeness(a, b) < 1e-4
    x, y = (merkle.fingerprint(t).partition(";")[2] for t in ("one two\n\nthree four", "one two\n\nthree 4"))
    assert x.split("/")[0] == y.split("/")[0]
    assert x.split("/")[1].partition(":")[0] != y.split("/")[1].partition(":")[0]
