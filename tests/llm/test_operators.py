"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, components, decontam, html_extract, langid, license_scan, line_dedup, media, pii, superminhash, token_store

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, key string, id string, `end` int"
ODD = [None, "", " ", "\n\n", "it's  we'll\t 'd ''re\n x", "é ñ 中文 😀  z", "a" * 3000, "word " * 4000, "The MIT License. cc by; CC-BY gnu general public license", "mail a.b@c.de, +1 (234) 555-6789 at 10.0.0.1 card 4111 1111 1111 1111"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    some = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()]
    rows = [(d, t, lang, "k", "i", 0) for d, t, lang in some] + [(1000 + k, t, None, "k", None, None) for k, t in enumerate(ODD)]
    rows += [rows[0], rows[5], (2000, some[7][1], "en", None, None, None), (2001, some[7][1] + " extra", "en", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(a, b):
    assert Counter(map(str, a)) == Counter(map(str, b))


def test_bpe_round_trip(docs, texts, library):
    got = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    same([(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got], [(d, np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for d, t in texts])


def test_bpe_pieces(library):
    rng = np.random.default_rng(7)
    parts = ["'s", "'", "'re", "'LL", "s", "re", " ", "  ", "\n", "\t", "a", "É", "9", "²", "!", "中", "\x85", "\x1c", "$$", "😀"]
    cases = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)]
    got = bpe.vocabulary(RANKS).encode(cases)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(c) for c in cases]


@pytest.mark.parametrize("collide", [False, True])
def test_bpe_cache(library, monkeypatch, collide):
    """Pieces give the same ids from the dict, from the arrays, after the arrays began anew, and where all hashes are equal."""
    monkeypatch.setattr(bpe, "NEW_PIECES", 50)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 400)
    if collide:
        packed = bpe.packed
        monkeypatch.setattr(bpe, "packed", lambda *at: (*packed(*at)[:3], np.zeros(len(at[1]), np.uint64)))
    rng, own = np.random.default_rng(3), bpe.Vocabulary(RANKS)
    parts = ["a", "b", "\0", " ", "é", "中", "😀", "7", "abcdefgh", "ijklmnop", "'s"]
    for _ in range(30):
        cases = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(20)]
        assert [np.frombuffer(g, "<u4").tolist() for g in own.encode(cases)] == [library.encode_ordinary(c) for c in cases]


@pytest.mark.parametrize("most", [400, 100_000])
def test_bpe_decodes_after_settling(monkeypatch, most):
    """What the cache holds, and that it begins anew, changes nothing for decoding."""
    monkeypatch.setattr(bpe, "NEW_PIECES", 50)
    monkeypatch.setattr(bpe, "CACHED_PIECES", most)
    rng, own = np.random.default_rng(5), bpe.Vocabulary(RANKS)
    for _ in range(20):
        cases = ["".join(map(chr, rng.integers(32, 0x3000, 60))) for _ in range(10)]
        assert own.decode(own.encode(cases)) == [c.encode() for c in cases]
    assert len(own.key) > 1


def test_token_store(spark, docs, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_store.written_places(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    at, want = 0, {}
    for d, t in sorted(texts):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[d, at] = (len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_token_store_added_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["a b", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  it's\n", "<|endoftext", None]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.written_places(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    at = 0
    for k, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[k] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_store_reads_a_part(spark, docs, tmp_path):
    at = f"file://{tmp_path}/ids"
    token_store.write(docs, at, public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = token_store.read(spark, at, ["doc_id", "n_tokens"], "doc_id = 1001")
    assert [tuple(r) for r in got.collect()] == [(1001, 1)]


def test_personal_data(docs, texts):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                    out.append((m.start(), k, m.end(), kind))
        return [(kind, a, z) for a, _, z, kind in sorted(out)]

    got = pii.find(docs).collect()
    same([(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in got], [(d, brute(t)) for d, t in texts])
    assert any(len(brute(t)) == 4 for _, t in texts)


def test_personal_data_adds_secrets(spark):
    rows = [(k, f"the password={'3f' * 8}{k:04d} is here and token = \"0641917ea4e9feb9cda83477b57a{k:04d}\" too AKIA{'Q' * 12}{k:04d}") for k in range(30)] + [(100 + k, "plain words of no interest whatever 12 and 2024") for k in range(30)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] for k in range(30)) and not any(got[100 + k] for k in range(30))


def jaccard_groups(texts, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[d] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, size, percent):
    base = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 1).split()
    rng = np.random.default_rng(3)
    near = []
    for k in range(60):
        words = [f"w{i}" for i in range(80)] + base
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(0, len(words)))] = f"edit{rng.integers(0, 40)}"
        near.append((3000 + k, " ".join(words), "en", None, None, None))
    both = docs.unionAll(spark.createDataFrame(near, SCHEMA))
    want = jaccard_groups([(r.doc_id, r.text or "") for r in both.collect()], size, percent)
    got = superminhash.groups(both, size=size, percent=percent).collect()
    assert len(got) == both.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 100, dtype=np.uint64)])) for _ in range(2))
    s = superminhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 256)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.12
    ranks = np.sort(superminhash.signatures(a[:1], np.array([0, 1]), 64)[0] >> 32)
    assert ranks.tolist() == list(range(64))  # one element visits every slot once


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 199)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licenses(docs, texts):
    got = license_scan.scan(docs).collect()

    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))
        places = [(k, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))

    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(d, *brute(t)) for d, t in texts])
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_with_a_word_changed(spark):
    text = "permission is hereby granted right now free of charge to any person obtaining a copy of this software"
    got = license_scan.scan(spark.createDataFrame([(1, text), (2, "permission to go is granted")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "mit", 2: ""}


def test_language(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(table.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(table, model).join(table, "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert odd[1000] == odd[1001] == odd[1002] == odd[1003] == ("und", 0.0)
    de, fr = (table.where(f"lang = '{k}' and length(text) > 2000").first().text for k in ("de", "fr"))
    mixed = langid.predict(spark.createDataFrame([(1, de[:2000] + " " + fr[:2000])], "doc_id long, text string"), model).first()
    assert {s.lang for s in mixed.languages} == {"de", "fr"} and all(0.3 < s.share < 0.7 for s in mixed.languages)


def test_language_without_training(none, docs):
    assert {r.lang_pred for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}


def test_language_of_a_small_part(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {c: " ".join(r.text for r in table.where(F.col("lang") == c).where("text is not null").orderBy("doc_id").collect()).split() for c in ("de", "fr")}
    text = " ".join((words["de"] * 20)[:19_200] + words["fr"][:800])
    got = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), langid.train(table)).first()
    assert got.lang_pred == "de" and {x["lang"] for x in got.languages} >= {"de", "fr"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_decontamination(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    first, second = (r.text for r in items.orderBy("item_id").limit(2).collect())
    typo = second[:60] + "xq" + second[62:100] + second[101:]
    rows = [(9000, f"before {first} after"), (9001, first.upper().replace(" ", "  ")), (9002, "some " + typo + " more"), (9003, first[: len(first) // 2]), (9004, None)]
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = decontam.find(table, items).collect()
    fold = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    bench = {r.item_id: r.text for r in items.collect()}
    whole = {(r.doc_id, i) for r in table.where("text is not null").collect() for i, t in bench.items() if fold(t) in fold(r.text)}
    assert whole <= {(r.doc_id, r.item_id) for r in got}
    assert {r.doc_id for r in got if r.doc_id >= 9000} == {9000, 9001, 9002}
    for r in got:
        text = {d: t for d, t in ((x.doc_id, x.text) for x in table.where(f"doc_id = {r.doc_id}").collect())}[r.doc_id]
        assert edits(fold(text[r.start : r.end]), fold(bench[r.item_id])) == r.edits <= len(fold(bench[r.item_id])) * decontam.EDITS
    kept = {r.doc_id for r in decontam.clean(table, items).collect()}
    assert kept == {r.doc_id for r in table.collect()} - {r.doc_id for r in got}


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Who wrote it?"), (2, "yes"), (3, "?!"), (4, "a a"), (5, "Who wrote it?")], "item_id long, text string")
    texts = ["So: who  WROTE it", "whowrote it", "Who wrote its", "Yesterday; yes", "a a a", "who", "wrote it", None, " -- who wrote, it"]
    got = {(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontam.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    assert got == {(0, 1, 4, 17, 0), (0, 5, 4, 17, 0), (3, 2, 11, 14, 0), (4, 4, 0, 3, 0), (8, 1, 4, 17, 0), (8, 5, 4, 17, 0)}


def test_clean_rows_stay(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = items.orderBy("item_id").first().text
    rows = [(None, f"x {item} y"), (None, "clean"), (1, item), (1, "also clean"), (2, None)]
    got = decontam.clean(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_media(docs, texts):
    got = media.described(media.sniff(media.store_texts(docs))).collect()
    pad = lambda t: t.encode().ljust(max(64, -(-len(t.encode()) // 64) * 64), b"\0")
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], [(d, len(t.encode()), len(pad(t)), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-64:])) for d, t in texts])


def test_media_carving(spark):
    import gzip

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    packed, sound = gzip.compress(b"hello" * 50), media.wav(bytes(64))
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00" + b"\x3b"
    assert media.objects(b"xx" + png + b"yy" + packed + gif + sound[:-1]) == [("image/png", 2, 2 + len(png)), ("application/gzip", len(png) + 4, len(png) + 4 + len(packed)), ("image/gif", len(png) + 4 + len(packed), len(png) + 4 + len(packed) + len(gif))]
    assert media.objects(png[:-1]) == [] and media.objects(png.replace(b"IHDR", b"IHDX")) == []
    rows = spark.createDataFrame([(1, bytearray(png), "image/gif"), (2, bytearray(sound), "audio/wav"), (3, None, None), (4, bytearray(b""), "x/y"), (5, bytearray(b"text"), "text/plain")], "id int, media binary, said string")
    assert {r.id: (r.media_type, r.type_changed) for r in media.sniff(rows, declared="said").collect()} == {1: ("image/png", True), 2: ("audio/wav", False), 3: ("application/x-empty", True), 4: ("application/x-empty", True), 5: ("text/plain", False)}


def test_lines(spark, docs):
    long = " ".join(f"word{k}" for k in range(200))
    near = long.replace("word77 ", "other ")
    rows = [(1, f"{long}\nunique first line here it is"), (2, f"{near}\nsomething else entirely stands here"), (3, long.upper()), (4, "a b\na b\n\n---\n\n---\nc"), (5, None), (6, ""), (7, "---"), (3, long.upper()), (8, "short"), (9, "short")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = sorted((tuple(r) for r in line_dedup.dedup(table).collect()), key=str)
    want = [(1, rows[0][1], "x"), (2, "something else entirely stands here", "x"), (4, "a b\n\n---\n\n---\nc", "x"), (5, None, "x"), (6, "", "x"), (7, "---", "x"), (8, "short", "x")]
    assert got == sorted(want, key=str)
    said = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in line_dedup.report(table).collect()}
    assert said[2] == (2, 1, "0") and said[4] == (3, 1, "1") and said[5] == (0, 0, "")
    assert line_dedup.report(docs).count() == docs.count()


def test_similar_lines_are_found(spark, monkeypatch):
    """Every pair that brute force finds similar is connected, with common runs moved back and without."""
    rng, lines = random.Random(10), []
    for n in [4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 19, 20, 24, 25, 30, 40, 50, 60] * 3:
        base = [f"w{rng.randrange(2000)}" for _ in range(n)]
        lines.append(base)
        for _ in range(2):
            w = list(base)
            for _ in range(max(1, n // 5)):
                k, how = rng.randrange(len(w)), rng.randrange(3)
                w[k : k + (how < 2)] = [f"v{rng.randrange(2000)}"] * (how != 0)
            lines.append(w)

    def near(a, b):
        return edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)

    pairs = {(i, j) for j in range(len(lines)) for i in range(j) if min(len(lines[i]), len(lines[j])) * 5 >= max(len(lines[i]), len(lines[j])) * 4 and near(lines[i], lines[j])}
    assert len(pairs) > 80
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string").cache()
    group = list(range(len(lines)))
    for _ in lines:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    want = {k for k, g in enumerate(group) if g != k}
    for sample, common in ((16, 4), (1, 2)):
        monkeypatch.setattr(line_dedup, "SAMPLE", sample)
        monkeypatch.setattr(line_dedup, "COMMON", common)
        assert {r.doc_id for r in line_dedup.report(df).where("n_removed > 0").collect()} == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "</p>";</script></head><body class="no-sidebar">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="site-header">Top</div><div class="cookie-notice">We use cookies</div>
<div class="post-12 content"><h1>Title &amp; more</h1><p>First <b>bold</b>
 line<br>after&nbsp;break.<p>Second &lt;tag&gt; &#233;<div class="ad-box">Buy</div><form><input value="x">Search</form>
<ul><li>item one<li>item two</ul><!-- <p>not this --><style>p{}</style></div>
<div class="comments"><p>Nice post</p></div><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, "http://h.example/b", PAGE.replace("post-12", "post-7")), (3, "http://h.example/c", None), (4, None, ""), (5, "x", "<p>only text"), (6, "http://h.example/d", "<div>no article here</div>"), (1, "http://h.example/a", PAGE)]
    got = html_extract.extract(spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, path string")).collect()
    text = "Title & more\nFirst bold line after break.\nSecond <tag> é\nitem one\nitem two"
    same([(r.page_id, r.text) for r in got], [(1, text), (1, text), (2, text), (3, ""), (4, ""), (5, "only text"), (6, "no article here")])


def test_pages_of_the_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (bpe.decode(bpe.encode(none, RANKS), RANKS), token_store.written_places(none, public_tokenizers.path("byte_bpe_50k.json")), pii.find(none), superminhash.groups(none), license_scan.scan(none), decontam.find(none, items), media.described(media.sniff(media.store_texts(none))), line_dedup.report(none), line_dedup.dedup(none), html_extract.extract(pages)):
        assert df.count() == 0


def test_rows_with_one_key(spark):
    """Rows are judged by their own text, whatever their keys, and clashing names do no harm."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (2, text, "b"), (2, "another text that is nothing like it at all", "c"), (None, text, "d"), (3, None, "e")]
    for odd in ("_gone", "mark", "key", "row"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {odd} string")
        assert sorted(r[2] for r in superminhash.dedup(df).collect()) == ["a", "c", "d", "e"]
    df = spark.createDataFrame([(1, f"{text}\nfirst of all", "a"), (2, text, "b"), (2, "other", "c")], "doc_id long, text string, removed string")
    assert sorted(r.removed for r in line_dedup.dedup(df).collect()) == ["a", "c"]


def test_parts_of_pages(spark, monkeypatch):
    page = '<html><body><div class="post"><p>One &am<b>p;</b> <math><mi>x</mi></math> a<script>var y;</script>b<svg><text>no</text></svg>c</p><p>Two lines of some more text</p></div></body></html>'
    df = spark.createDataFrame([(k, "http://h.example/x", page) for k in range(3)], "page_id long, url string, html string")
    for most in (100_000, 0):
        monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", most)
        got = {r.text for r in html_extract.extract(df).collect()}
        assert got == {"One &amp; x abc\nTwo lines of some more text"}


def test_hostile_bytes_and_pages():
    """Repeated magic bytes and deep nesting cost time in proportion."""
    import time

    began = time.time()
    assert media.objects(b"%PDF-" * 200_000) == [] and media.objects(b"PK\x03\x04" * 200_000) == []
    assert len(html_extract.main_text("<div>x" * 40_000).split("\n")) > 39_900  # below the best container
    assert html_extract.main_text("<p>a" + "</q>" * 100_000 + "b") == "ab"
    assert time.time() - began < 20


def test_numbers_are_found(spark):
    rows = [(k, f"my ssn is 123-45-6{k:03d}, do keep it; then call 212-555-1{k:03d} any day") for k in range(60)]
    rows += [(1000 + k, f"part 555-01-{k:04d} of 4 in the series") for k in range(60)]
    got = {r.doc_id: {s.kind for s in r.spans} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("number" in got[k] for k in range(60)) >= 54


def test_blocks_of_items(spark, monkeypatch):
    """However many blocks items are cut into, each item is in one, and results don't change."""
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for k in range(40)]
    df = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    known = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontam.find(df, known).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 700)
    cut_up, n = decontam.blocks(known, "item_id", "text")
    assert sorted(r["item"] for r in cut_up.collect()) == list(range(40)) and 2 <= n <= 8
    assert sorted(map(tuple, decontam.find(df, known).collect())) == want and len(want) >= 40


def test_line_dedup_in_rounds(docs, monkeypatch):
    """Keys, texts and pairs go to disk one part at a time, and how many parts there are changes no result."""
    names, stored = Counter(), line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: (names.update([name]), stored(df, name))[1])
    monkeypatch.setattr(line_dedup, "released", lambda spark: None)
    want = line_dedup.report(docs).collect()
    assert names["line-buckets"] == names["line-texts"] == 2 and names["line-links"] % 4 == 0 < names["line-links"]
    assert any(r.n_removed for r in want)
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    monkeypatch.setattr(line_dedup, "PAIR_ROUNDS", 3)
    same(line_dedup.report(docs).collect(), want)


def test_line_dedup_in_rounds(docs, monkeypatch):
    """Keys, texts and pairs go to disk one part at a time, and how many parts there are changes no result."""
    names, stored = Counter(), line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: (names.update([name]), stored(df, name))[1])
    for module in (line_dedup, components):
        monkeypatch.setattr(module, "released", lambda spark: None)
    want = line_dedup.report(docs).collect()
    assert names["line-buckets"] == names["line-texts"] == 2 and names["line-links"] % 4 == 0 < names["line-links"]
    assert any(r.n_removed for r in want)
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    monkeypatch.setattr(line_dedup, "PAIR_ROUNDS", 3)
    same(line_dedup.report(docs).collect(), want)


def test_lines_that_share_a_run_make_no_pairs(spark, monkeypatch):
    """Lines with a run in common and nothing else don't meet in pairs, and similar lines among them do."""
    rng, rows, stored = random.Random(5), Counter(), line_dedup.stored
    lines = [" ".join(["alpha beta gamma", *(f"w{rng.randrange(10**6)}" for _ in range(17))]) for _ in range(60)]
    lines += [lines[3].replace(" w", " v", 1), lines[8] + " more"]

    def counted(df, name):
        out = stored(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    monkeypatch.setattr(line_dedup, "COMMON", 1000)
    for module in (line_dedup, components):
        monkeypatch.setattr(module, "released", lambda spark: None)
    got = {r.doc_id for r in line_dedup.report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed > 0").collect()}
    assert got == {60, 61} and rows["line-stars"] + rows["line-pairs"] <= 10


def test_near_duplicates_release_each_step(docs, monkeypatch):
    """No shuffle of an earlier step is still held while sets are compared."""
    seen, stored = [], superminhash.stored
    monkeypatch.setattr(superminhash, "stored", lambda df, name: (seen.append(name), stored(df, name))[1])
    monkeypatch.setattr(superminhash, "released", lambda spark: seen.append("released"))
    superminhash.groups(docs).collect()
    assert "links" in seen and all(seen[k - 1] == seen[k + 1] == "released" for k, name in enumerate(seen) if name == "links")
    assert seen[seen.index("buckets") + 1] == seen[seen.index("sets") + 1] == "released"


def test_near_copies_of_a_line_meet_in_few_pairs(spark, monkeypatch):
    """Near-copies that differ from each other by about the edits allowed are connected without comparing all of them with each other; long lines with a word in common don't meet."""
    rng, rows, stored = random.Random(7), Counter(), line_dedup.stored
    base, lines = [f"w{rng.randrange(10**6)}" for _ in range(80)], []
    for _ in range(200):
        w = list(base)
        for k in rng.sample(range(80), rng.randrange(3, 10)):
            w[k] = f"v{rng.randrange(10**6)}"
        lines.append(" ".join(w))
    lines += [" ".join(["alpha beta gamma", *(f"x{rng.randrange(10**6)}" for _ in range(250))]) for _ in range(40)]

    def counted(df, name):
        out = stored(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    for module in (line_dedup, components):
        monkeypatch.setattr(module, "released", lambda spark: None)
    got = {r.doc_id for r in line_dedup.report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed > 0").collect()}
    assert got == set(range(1, 200)) and rows["line-pairs"] == 0 and rows["line-buckets"] < 200 * 33 + 40 * 2


def test_buckets_of_the_same_lines_pick_different_ones(spark):
    """Classes that share many buckets are compared with more than one of them."""
    keys = spark.createDataFrame([(b, k) for b in range(1, 41) for k in (11, 22, 33, 44)], "bucket long, id long")
    assert len({r.rep for r in line_dedup._buckets(keys).collect()}) > 1


def test_language_holds_little_at_once(spark, monkeypatch):
    """A worker that predicts languages needs few times the memory of its slice, as it stands beside other operators' workers."""
    import tracemalloc

    most, map_text = [], langid.map_text
    monkeypatch.setattr(langid, "map_text", lambda *a: (most.append(a[5]), map_text(*a))[1])
    rng = np.random.default_rng(5)
    model = langid.Model(tuple(f"l{k:02d}" for k in range(20)), rng.random((langid.BUCKETS, 20), np.float32))
    langid.predict(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model)
    texts = ["".join(map(chr, rng.integers(97, 123, 2048))) for _ in range(most[0] // 2048)]
    langid.letters()
    tracemalloc.start()
    langid.infer(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_line_dedup_forms_pairs_once(spark, monkeypatch):
    """However many rounds there are, each class's pairs are formed and sorted once; classes go by numbers that lie close together."""
    seen, stored, near = Counter(), line_dedup.stored, []
    lines = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(30)]
    lines += [f"{lines[4]} more", lines[9]]

    def counted(df, name):
        out = stored(df, name)
        seen[name] += 1
        if name == "line-texts":
            near.extend(r.id for r in out.select("id").collect())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    monkeypatch.setattr(line_dedup, "ROUNDS", 3)
    for module in (line_dedup, components):
        monkeypatch.setattr(module, "released", lambda spark: None)
    got = {r.doc_id for r in line_dedup.report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed > 0").collect()}
    assert got == {30, 31} and seen["line-keys"] == 1 and seen["line-buckets"] == 3
    assert len(set(near)) == 31 and 0 <= min(near) and max(near) < 3 << 40
