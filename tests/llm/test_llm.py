"""The operators against brute force, exact round trips and held-out accuracy, and the
same odd rows for each: nulls, empty and long texts, repeated rows, extra columns."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from textloom.llm import chat, graph, jaccard, language, licences, media, neighbours, packing, pieces, quality, urls  # noqa: E402

LONG = "the long text goes on and on " * 4000
ODD = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, "en", None, None), (3, "", None, "s", 0), (None, "nobody has an id here", "de", "s", 1), (4, LONG, "en", "s", 1), (5, "@#$ 123", "en", "s", 1), (6, "word", "fr", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns named as the operators' own."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.withColumns({c: F.lit("x") for c in ("n", "cls", "token", "rep", "word", "row", "perplexity", "component_id", "piece", "length", "k", "path")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# media


def png(payload=b"\0" * 12):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(payload)) + chunk(b"IEND", b"")


def test_sniffing_confirms_and_carves():
    gif = b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0\x3b"
    blob = b"BM text " + png() + b"..BM.." + gif + b"RIFFjunk" + media.to_wav(b"abcd") + b"\x1f\x8b\x08 not"
    found = media.sniff(blob)
    assert [f.kind for f in found] == ["image/png", "image/gif", "audio/wav"]
    for f, raw in zip(found, (png(), gif, media.to_wav(b"abcd")), strict=True):
        assert blob[f.offset : f.offset + f.length] == raw
    assert media.describe(png(), "image/jpeg")[:2] == ("image/png", True)
    assert media.describe(b"plain", "text/plain")[0] == "application/octet-stream"
    broken = bytearray(png())
    broken[40] ^= 1
    assert media.sniff(bytes(broken)) == []
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    for raw, kind in ((gzip.compress(b"x" * 9), "application/gzip"), (z.getvalue(), "application/zip"), (b"%PDF-1.4 x startxref 0 %%EOF", "application/pdf")):
        assert [(f.kind, f.length) for f in media.sniff(b"??" + raw)] == [(kind, len(raw))]


def test_media_round_trip(odd, empty):
    rows = media.text_media(odd).collect()
    assert len(rows) == len(ODD) and media.text_media(empty).count() == 0
    texts = {r[0]: r[1] for r in ODD}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, math.ceil(len(raw) / 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert "type=audio/wav;corrected=true" in r.feature


# chat


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]) if t else "system", rng.choice([None, "", "x [/TURN] <s>[user] \\ y", "words " * rng.randrange(80)])) for c in range(40) for t in range(rng.randrange(1, 30))]
    rows += [(None, None, None, None), (7, 3, "user", "twice"), (7, 3, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat.windows(df, budget=120, history=40)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:2]) + tuple((x is not None, x or "") for x in r[2:])
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    count = chat.encoder(None, None)
    for w in made.collect():
        turns = chat.parse(w.formatted)
        assert w.tokens <= 120 or w.end_turn - w.first_turn == 1 or w.tokens - count("") <= 120
        assert "".join(chat.format_turn(*t)[0] for t in turns) == w.formatted
        if w.window:
            assert w.new_from > 0 or not turns or w.tokens > 0
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_long_system_turns_are_kept():
    c = chat.Conversation(budget=100, history=30)
    turns = [("system", "s", 70), ("user", "a", 25), ("assistant", "b", 20), ("user", "long", 90), ("assistant", "c", 10), ("user", "longer", 140), ("assistant", "d", 30)]
    made = [w for t in turns for w in c.add(*t)] + list(c.close())
    assert [([t[1] for t in w[2]], [t[1] for t in w[3]]) for w in made] == [
        ([], ["s", "a"]), (["s"], ["b"]), ([], ["long"]), (["s"], ["c"]), ([], ["longer"]), (["s"], ["d"]),
    ]
    assert all(sum(t[2] for t in (*w[2], *w[3])) <= 100 for w in made if w[3][0][1] != "longer")


# urls


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/a?x"), (2, "https://example.com/en/"), (3, "https://a.net/fr/x"), (4, None), (5, "no scheme"), (6, "http://Bad.org/P/#f"), (7, "http://bad.org/p"), (8, "http://com/"), (9, "http://xnet/es/"), (9, "http://xnet/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1))
    listed = spark.createDataFrame([("https://BAD.org/P?z",), (None,), ("http://x.example.com/en/q",)], "url string")
    rules = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/fr/")]
    for blocks in (None, 1):  # one block: nearly every probe is a possible hit
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed, rules, blocks=blocks).orderBy("page_id").collect()]
        assert got == [
            (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"), (3, "a.net", "/fr/x", "net/fr/", "block"),
            (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "bad.org", "/P/", None, "block"), (7, "bad.org", "/p", None, "allow"), (8, "com", "/", "com/", "allow"),
            (9, "xnet", "/es/", None, "allow"), (9, "xnet", "/es/", None, "allow"),
        ]
    assert urls.judge(pages.limit(0), listed, rules).count() == 0
    assert urls.judge(pages, listed.limit(0), rules).count() == len(rows)


# language


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    words = {"aa": ["ba", "bab", "bo", "babo", "obab"], "cc": ["ki", "kik", "tik", "itki", "kitti"]}
    return [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 60))), lang, "s", 1) for k in range(n) for lang in [rng.choice(["aa", "cc"])]]


def test_language(spark, odd, empty):
    docs = spark.createDataFrame([*corpus(), (900, None, "aa", "s", 1), (901, "12 %", "cc", "s", 1), (902, "bab kik " * 9000, None, "s", 1)], SCHEMA)
    model = language.fit(docs, language.Settings(sequences=600))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    held = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].lang_pred == r[2] for r in held)
    assert (got[900].lang_pred, got[901].lang_pred, got[901].score) == ("und", "und", 0.0)
    assert 0.4 < got[902].score < 0.6
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0
    kept = language.keep_known(odd, model, least=0.1)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, None, 4, 6}


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], {}, np.zeros((1, 2)), rng.normal(size=(2, 2)).astype(np.float32), rng.normal(size=2).astype(np.float32))
    for n in (1, 2, 5):
        e = rng.random((n, 2)).astype(np.float32)
        total = np.zeros((n, 2))
        for path in np.ndindex(*(2,) * n):
            w = np.exp(model.start[path[0]]) * np.prod([e[k, s] for k, s in enumerate(path)]) * np.prod([np.exp(model.moves[a, b]) for a, b in zip(path, path[1:])])
            for k, s in enumerate(path):
                total[k, s] += w
        assert np.allclose(language.posteriors([e, e[:1]], model)[0], total / total.sum(axis=1, keepdims=True), atol=1e-5)


def test_expected_moves_are_enumeration():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], {}, np.zeros((1, 3)), rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    sequences = [rng.random((n, 3)).astype(np.float32) for n in (4, 1, 3)]
    want = np.zeros((3, 3))
    for e in sequences:
        found, total = np.zeros((3, 3)), 0.0
        for path in np.ndindex(*(3,) * len(e)):
            w = np.exp(model.start[path[0]]) * np.prod([e[k, s] for k, s in enumerate(path)]) * np.prod([np.exp(model.moves[a, b]) for a, b in zip(path, path[1:])])
            total += w
            for a, b in zip(path, path[1:]):
                found[a, b] += w
        want += found / total
    got = np.zeros((3, 3))
    language.posteriors(sequences, model, got)
    assert np.allclose(got, want, atol=1e-5)


def test_words_of_switched_texts_are_labelled(spark, odd):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = language.fit(docs, language.Settings(sequences=600))
    text = "bab bo babo ba bab bo obab ba KIK tik itki, kitti ki kik tik."
    rows = language.label_words(spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "12", "x")], "doc_id long, text string, labels string"), model).collect()
    got = {r.doc_id: r for r in rows}
    assert got[1].words == text.lower().replace(",", "").replace(".", "").split() and got[1].labels == ["aa"] * 8 + ["cc"] * 7
    assert got[2].words == [] == got[3].labels
    long = "bab bo ba " * 3000 + "kik tik " * 4000
    labels = language.label_words(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first().labels
    assert labels == ["aa"] * 9000 + ["cc"] * 8000
    assert {x for r in language.label_words(odd, None).collect() for x in r.labels} == {"und"}


def test_more_languages_than_bits(spark):
    rng = random.Random(2)
    rows = [(70 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('xyz')}" for _ in range(12)), f"l{k:02d}") for k in range(70) for i in range(6)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.Settings(sequences=900, epochs=2))
    assert len(model.langs) == 70


# quality


def plain_kn(texts):
    """The same model by dictionaries, one n-gram after another."""
    grams = [dict() for _ in range(5)]
    for t in texts:
        c = [0] * 3 + quality.classes(t).tolist()
        for i in range(3, len(c)):
            g = tuple(c[i - 3 : i + 1])
            grams[4][g] = grams[4].get(g, 0) + 1
    for k in (3, 2, 1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1

    def cuts(k):
        n = [sum(1 for x in grams[k].values() if x == j) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        bounds = [(0.05, 0.95), (0.1, 1.9), (0.2, 2.8)]
        return [min(max((j + 1) - (j + 2) * y * n[j + 1] / n[j] if n[j] and n[0] else j + 0.5, lo), hi) for j, (lo, hi) in enumerate(bounds)]

    d = {k: cuts(k) for k in (1, 2, 3, 4)}

    def p(g):
        k = len(g)
        if not k:
            return 1 / quality.CLASSES
        own = {x: n for x, n in grams[k].items() if x[:-1] == g[:-1]}
        s = sum(own.values())
        if not s:
            return p(g[1:])
        left = sum(d[k][min(n, 3) - 1] for n in own.values()) / s
        n = own.get(g, 0)
        return (max(n - d[k][min(n, 3) - 1], 0) / s if n else 0) + left * p(g[1:])

    def perplexity(t):
        c = [0] * 3 + quality.classes(t).tolist()
        return math.exp(-sum(math.log(p(tuple(c[i - 3 : i + 1]))) for i in range(3, len(c))) / len(t))

    return perplexity


def test_quality_is_kneser_ney(spark, odd, empty):
    good = [(k, t, "aa", "s", 1) for k, (_, t, lang, _, _) in enumerate(corpus(60)) if lang == "aa"]
    bad = [(1000 + k, "BAB!! ## BO$$ " * 4, "aa", "s", 1) for k in range(5)]
    docs = spark.createDataFrame([*good, *bad, (2000, None, "aa", "s", 1), (2001, "text", None, "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(1000, 0, 0), (1000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, high=1.0).collect()}
    perplexity = plain_kn([r[1] for r in good])
    for r in [*good[:12], *bad[:2]]:
        assert got[r[0]].perplexity == pytest.approx(perplexity(r[1]), rel=1e-3)
    assert all(got[r[0]].keep for r in good) and not any(got[r[0]].keep for r in bad)
    assert not got[2000].keep and got[2001].keep and got[2001].perplexity is None
    assert quality.classify(odd, labels).count() == len(ODD) and quality.classify(empty, labels).count() == 0
    assert {r.doc_id for r in quality.keep_good(odd, labels.limit(0)).collect()} == {1, None, 4, 5, 6}
    assert quality.keep_good(docs, labels, high=1.0).count() == len(good) + 1


def test_quality_tells_letters_apart_in_any_script(spark):
    rng = random.Random(4)
    words = ["мама", "мыла", "раму", "книга", "лежит", "на", "столе", "утром", "дождь", "идёт"]
    good = [(k, " ".join(rng.choice(words) for _ in range(40)), "ru", "s", 1) for k in range(60)]
    junk = [(1000 + k, "".join(c if c == " " else rng.choice("абвгдежзиклмнопрстуфхцчшщыэюя") for c in good[k][1]), "ru", "s", 1) for k in range(5)]
    emoji = [(2000, "😀😁😂🤣 " * 40, "ru", "s", 1), (2001, "ы" * 70_000, "ru", "s", 1)]
    docs = spark.createDataFrame([*good, *junk, *emoji], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.classify(docs, labels, high=1.0).collect() if r.keep}
    assert kept == {r[0] for r in good} == {r.doc_id for r in quality.keep_good(docs, labels, high=1.0).collect()}


# near-duplicates


def plain_components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("percent,width,few", [(90, 3, 24), (80, 5, 2)])
def test_jaccard_is_brute_force(spark, percent, width, few):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, base = [], []
    for k in range(140):
        if k % 14 == 0:
            base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 40, 90]))]
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words).upper() if k % 3 else "\x0b".join(words)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, " \t ")]
    sets = {}
    for k, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    truth = plain_components(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    links = jaccard.class_links
    jaccard.class_links = lambda p, f, x: links(p, f, x, few, 0.75 if few > 2 else 0.0)
    try:
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), percent, width).collect()
    finally:
        jaccard.class_links = links
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), truth[k]) for k in sets}


def test_jaccard_odd_rows(odd, empty):
    got = jaccard.join(odd, 80, 5).collect()
    assert len(got) == len(ODD) and jaccard.join(empty).count() == 0
    assert {r.component_id for r in got if r.doc_id == 1} == {1}
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + 0.18 * rng.normal(size=(60, 16)), base[:1].repeat(30, axis=0), base[5:6] + 0.01 * rng.normal(size=(25, 16))])
    rows = [(int(k), [float(v) for v in row], 1) for k, row in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(0) for c in ("list", "rep", "code", "v", "k1")})
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, probes=6, lists=12).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    truth = plain_components(list(range(len(x))), lambda a, b: near[a, b])
    found = sum(got[k].n_links for k in range(len(x)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in range(len(x)))
    assert sum(got[k].component_id == truth[k] for k in truth) >= 0.95 * len(truth)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (900, 901, 902, 903, 904)) and None in got
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got.values())
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_table_scale(spark):
    """Default settings, as many vectors and components as the tables have."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(4000, 64)) * (rng.uniform(0.33, 0.5, size=(4000, 1)) / 8)
    x = np.concatenate([base, base + noise, rng.normal(size=(1000, 8)) @ np.eye(8, 64)]).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(20_000 + k, [1.0, 0.01 * k]) for k in range(3)]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[k].n_links for k in range(len(x)))
    assert near.sum() > 4000 and 0.97 * near.sum() <= found <= near.sum()
    # vectors of another length link with each other
    assert [(got[20_000 + k].n_links, got[20_000 + k].component_id) for k in range(3)] == [(2, 20_000)] * 3


# tokens


def test_pieces_are_the_best_path(spark, odd, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    # the library's own Viterbi: the model file with its type set to unigram
    raw = open(path, "rb").read()
    assert raw.count(b"tok_v0\x18\x02") == 1
    library = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    rng = random.Random(1)
    words = sorted({pieces.SPACE + "".join(rng.choice("theraionédZ.,1日🎉\n") for _ in range(rng.randrange(1, 12))) for _ in range(150)} | {pieces.SPACE * 3 + "x"})
    table = pieces.piece_table(spark, path)
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    made = pieces.encode_words(frame, *table, kind="unigram")
    decoded = {r.word: r for r in pieces.decode(made, path).collect()}
    score = lambda ids: sum(library.get_score(i) if not library.is_byte(i) else -1e6 for i in ids)
    for w in words:
        text = w.replace(pieces.SPACE, " ")
        assert decoded[w].text == text
        assert score(decoded[w].ids) == pytest.approx(score(library.encode(text[1:])))
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = spark.createDataFrame([(pieces.SPACE + "thetionaté日" * 30,), (pieces.SPACE + "aaaaaaaa" * 20,), (pieces.SPACE,)], "word string")
    for r in pieces.encode_words(frame.unionByName(extra), *table).collect():
        if r.word != pieces.SPACE:
            assert r.ids == own.encode(r.word.replace(pieces.SPACE, " ")[1:])
    names = [r[0] for r in pieces.pieces_of(own)]
    for text in ("", "a", " a", "a  b ", "  ", "a b", "x.y 12"):
        assert "".join(pieces.words_of(text, names)) == (pieces.SPACE + text.replace(" ", pieces.SPACE) if text else "")
    whole, small = (sorted(map(tuple, pieces.encode_digest(odd.filter("doc_id is not null"), path, head=h).collect())) for h in (1 << 20, 3))
    assert whole == small and len(whole) == len(ODD) - 1
    assert pieces.encode_digest(empty, path).count() == 0


def test_documents_get_the_librarys_ids(spark, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [r[0] for r in pieces.pieces_of(library)]
    rng = random.Random(8)
    texts = ["", None, " ", "a", "Hello  world, it's 1234 日本.\n\tx", "the " * 3000, "aaaaaaaa" * 40, "e\u0301 🎉🎉 ñ"] + [" ".join("".join(rng.choice("theraionéd.,1-") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, texts[4]])] + [(None, "no id", "x")], "doc_id long, text string, key string")
    want = {k: library.encode(t or "") for k, t in enumerate([*texts, texts[4]])} | {None: library.encode("no id")}
    got = {r.doc_id: r.ids for r in pieces.encode_documents(docs, path).collect()}
    assert got == want
    for r in pieces.encode_digest(docs, path, head=20).collect():
        text = "no id" if r.doc_id is None else [*texts, texts[4]][r.doc_id] or ""
        words = pieces.words_of(text, names)
        digest = 0
        for k, w in enumerate(words):
            ids = library.encode("\x01" + w.replace("▁", " "))[len(library.encode("\x01")) :]
            digest += zlib.crc32(np.array(ids, dtype="<i4").tobytes()) % 2147483647 * pow(16807, k, 2147483647)
        assert (r.n_words, r.n_pieces, r.ids_digest, r.round_trip) == (len(words), len(want[r.doc_id]), digest % 2147483647, True)
    assert pieces.encode_documents(empty, path).count() == 0
    assert pieces.place_weight(np.array([0, 1, 5, 70_000])).tolist() == [pow(16807, k, 2147483647) for k in (0, 1, 5, 70_000)]
    assert pieces.falling(pieces.pieces_of(library)) == []
    # abc is made of b + c at 1 or, if c is taken late, after ab at 3: joins of rising score
    assert pieces.falling([("a", 0, 0.0), ("b", 1, 0.0), ("c", 2, 0.0), ("bc", 3, -5.0), ("abc", 4, -1.0)]) == ["abc"]


def test_viterbis_path_is_traced_decoded_and_digested(spark):
    """The digest's columns of Viterbi's path against a Viterbi in plain Python."""
    path = P.path("piece_bpe_32k.model")
    model = pieces.load(path)
    rows = pieces.pieces_of(model)
    known, longest, worst = {p: (i, score) for p, i, score in rows}, max(len(r[0]) for r in rows), min(r[2] for r in rows) - 10.0

    def best_ids(word):
        best = [(0.0, -1, ())]
        for e in range(1, len(word) + 1):
            found = [(s, *known[word[s:e]]) for s in range(max(0, e - longest), e) if word[s:e] in known]
            found += [(e - 1, -1, worst)] if word[e - 1] not in known else []
            # of equal paths the one whose last piece is longer
            score, _, s, i = max((best[s][0] + score, -s, s, i) for s, i, score in found)
            best.append((score, s, (i,) if i >= 0 else tuple(model.piece_to_id(f"<0x{b:02X}>") for b in word[e - 1].encode())))
        out, at = [], len(word)
        while at:
            out, at = [*best[at][2], *out], best[at][1]
        return out

    texts = ["", None, " ", "Hello  world, it's 1234 日本.\n\tx", "theration " * 40, "aaaaaaaa" * 20, "e\u0301 🎉🎉 ñ", "no id"]
    docs = spark.createDataFrame([(k if t != "no id" else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    names = [r[0] for r in rows]
    ids = {r.doc_id: r.ids for r in pieces.encode_documents(docs, path, kind="unigram").collect()}
    differ = 0
    for head in (1 << 18, 3):
        for r in pieces.encode_digest(docs, path, head=head).collect():
            each = [best_ids(w) for w in pieces.words_of((texts[r.doc_id] if r.doc_id is not None else "no id") or "", names)]
            digest = sum(zlib.crc32(np.array(x, dtype="<i4").tobytes()) % 2147483647 * pow(16807, k, 2147483647) for k, x in enumerate(each)) % 2147483647
            assert (r.n_viterbi, r.viterbi_digest, r.viterbi_round_trip) == (sum(map(len, each)), digest, True)
            assert ids[r.doc_id] == [i for x in each for i in x]
            differ += r.viterbi_digest != r.ids_digest
    assert differ


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab Z.,!'sé\n\t_1×İΣ日-  ") for _ in range(rng.randrange(50))) for _ in range(800)]
    for text, raw in zip(texts, packing.token_bytes(texts, path), strict=True):
        assert np.frombuffer(raw, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    rows = packing.packed_documents(odd, path, 256, island_items=40).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id or -1, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in ODD:
        if doc_id == 1:
            continue
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [(p.start, p.length, p.ids_crc32) for p in by_doc[doc_id]] == [(k, len(ids[k : k + 256]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k : k + 256]))) for k in range(0, len(ids), 256)]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.packed_documents(empty, path).count() == 0


def test_genetic_packing_is_near_the_bound(spark):
    rng = random.Random(9)
    sizes = [rng.randrange(1, 100) for _ in range(900)]
    herd = packing.first_herd(sizes, 100, rng, 4)
    before = [x.fitness() for x in herd]
    calls = []
    cross = packing.crossover
    packing.crossover = lambda *x: calls.append(1) or cross(*x)
    try:
        herd = packing.evolve(herd, 1, 20)
    finally:
        packing.crossover = cross
    assert len(calls) >= 10 and herd[0].fitness() >= max(before)
    bins = list(herd[0].bins.values())
    assert sorted(i for b in bins for i in b) == list(range(900)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= math.ceil(sum(sizes) / 100) * 1.02
    again = packing.from_genes(packing.to_genes(herd[0]), sizes, 100)
    assert sorted(map(sorted, again.bins.values())) == sorted(map(sorted, bins)) and again.fitness() == pytest.approx(herd[0].fitness())
    a, b = packing.Bins(sizes, 100), packing.Bins(sizes, 100)
    a.best_fit(list(range(900)))
    b.best_fit(list(range(899, -1, -1)))
    child = packing.crossover(a, b, rng, 0.3)
    assert sorted(child.home) == list(range(900)) and all(r >= 0 for r in child.room.values())
    items = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "item long, length long")
    placed = packing.pack(items, 100, island_items=100).collect()
    assert len(placed) == 900 and len({r.sequence_id for r in placed}) <= math.ceil(sum(sizes) / 100) * 1.04


def test_elites_migrate_and_no_shard_takes_all_items(spark):
    made = packing._epoch(10, 0, 1, 0)
    sizes = np.array([5, 5, 5, 5], dtype=np.int64)
    genes = lambda *home: np.array(home, dtype="<i4").tobytes()
    rows = [
        {"shard": 3, "island": 1, "migrant": False, "items": sizes.tobytes(), "sizes": sizes.tobytes(), "genes": [genes(0, 0, 1, 2), genes(0, 1, 2, 3)]},
        {"shard": 3, "island": 1, "migrant": True, "items": None, "sizes": None, "genes": [genes(0, 1, 0, 1)]},
    ]
    import pyarrow as pa

    got = made(pa.Table.from_pylist(rows, schema=packing._ISLAND_SCHEMA)).to_pylist()[0]
    assert len(got["genes"]) == 2 and len(set(np.frombuffer(got["genes"][0], dtype="<i4"))) == 2
    # items that no second one fits beside, and equal ones
    items = spark.createDataFrame([(k, 2100) for k in range(1500)], "item long, length long")
    placed = packing.pack(items, 4096, island_items=100)
    assert placed.select("sequence_id").distinct().count() == 1500 == placed.count()
    dealt = items.groupBy(F.pmod(F.xxhash64("item", F.lit(0)), F.lit(15))).count()
    assert dealt.agg(F.max("count")).first()[0] < 200


# licences


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing"), (3, "a/b/c/y.txt", "Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "z/q.txt", None), (5, "a/b/c/LICENSE", "text\n  This work is licensed under the GNU General Public License, version 3.  "), (6, "a/b/c/d/e.txt", ""), (7, "top.txt", "license of nothing known here at all"), (8, None, "x"), (2, "a/b/x.txt", "nothing"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("line", F.lit(1))
    got = sorted(((r.doc_id, r.own_licence, r.licence, r.via) for r in licences.scan(files).collect()), key=repr)
    assert got == [
        (1, "MIT", "MIT", "header"), (2, None, "MIT", "inherited"), (2, None, "MIT", "inherited"), (3, "Apache-2.0", "Apache-2.0", "header"), (4, None, None, None),
        (5, "GPL-3.0", "GPL-3.0", "header"), (6, None, "GPL-3.0", "inherited"), (7, None, None, None), (8, None, None, None),
    ]
    assert licences.scan(files.limit(0)).count() == 0


def test_headings_notices_and_tags(spark):
    rows = [
        (1, "a/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPL-3.0"),
        (2, "b/x.py", "# Licensed under the Apache License, Version 2.0 (the \"License\");\ncode", "Apache-2.0"), (3, "c/x.c", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0"),
        (4, "d/y.js", "/* SPDX-License-Identifier: MIT */", "MIT"), (5, "e/z.rs", "  SPDX-License-Identifier:   BSD-3-Clause", "BSD-3-Clause"), (6, "f/LICENSE", "The MIT License (MIT)", "MIT"),
        (7, "g/l.txt", "Apache License Version 2.0, January 2004", "Apache-2.0"), (8, "h/long.txt", "word " * 60_000 + "\n# SPDX-License-Identifier: ISC", "ISC"),
    ]
    files = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string").withColumns({c: F.lit("x") for c in ("licence", "w", "score", "dir")})
    assert {r.doc_id: r.own_licence for r in licences.scan(files).collect()} == {r[0]: r[3] for r in rows}


def test_licence_files_are_scored_whole_and_the_root_is_an_ancestor(spark):
    mit = "Copyright 2020 A. Person\n\n" + licences.BODIES["MIT"].replace(" of ", " of\n")
    rows = [(1, "LICENSE", mit), (2, "a/b/x.txt", "nothing"), (3, "c/COPYING", licences.BODIES["BSD-3-Clause"]), (4, "c/d/y.txt", None), (5, "e/LICENSE", licences.BODIES["ISC"]), (6, "/abs/z.txt", "x"), (7, "f/LICENSE", licences.BODIES["BSD-2-Clause"])]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: "ISC", 6: None, 7: "BSD-2-Clause"}


def test_licence_scan_is_planned_in_parts(spark):
    docs = spark.createDataFrame([(0, "a/LICENSE", "Released under the MIT License."), (1, "a/b.txt", "x")], "doc_id long, path string, text string")
    found = licences.scan(docs)
    assert {(r.doc_id, r.licence, r.via) for r in found.collect()} == {(0, "MIT", "header"), (1, "MIT", "inherited")}
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20
