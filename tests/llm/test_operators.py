"""Each operator against brute force or a library, and on nulls, empty and long texts, ties, repeated rows,
empty tables and columns with clashing names."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphsift.llm import balltree, bpe, components, decontamination, html, jaccard, language, licenses, pieces, simhash, sstable, toxicity
from glyphsift.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string"
BYTE, WORD, PIECE = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmno") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


TEXTS = [None, "", "  \n", "one", "Two words", prose(30, 1), prose(30, 1), prose(4000, 2), "É́ naïve ΣΑΣ İ \x85 한국어 <|endoftext|>x", "a\n\n\nb  c\t d", "w" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(list(enumerate(TEXTS)), DOCS))


def clashing(df):
    names = ["fp", "component_id", "score", "held_out", "lang_pred", "window", "w", "h", "at", "kept_0", "_text", "pos", "n", "a", "b", "key", "predicted"]
    return df.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            up[max(root(i), root(j), key=lambda k: ids[k])] = min(root(i), root(j), key=lambda k: ids[k])
    return [ids[root(i)] for i in range(len(ids))]


def test_simhash_is_brute_force(spark):
    base = prose(120, 3).split()
    texts = [*TEXTS, *(" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 120, 2)), *(prose(5, k) for k in range(20))]
    ids = [7 * k % 1009 for k in range(len(texts))]
    prints = [plain_fingerprint(t) for t in texts]
    got = simhash.simhash_components(clashing(spark.createDataFrame([*zip(ids, texts)], DOCS))).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == dict(zip(ids, prints))
    assert {r.doc_id: r.component_id for r in got} == dict(zip(ids, plain_components(prints, ids)))


@pytest.mark.parametrize("block", [2, 512])
def test_links_of_dense_slots(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(6)
    centre = r.getrandbits(64)
    prints = list({centre ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))}) for _ in range(60)} | {r.getrandbits(64) for _ in range(20)})
    rows = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame(rows, "fp bigint, rep bigint"))).collect()}
    assert [roots.get(k, k) for k in range(len(prints))] == plain_components(prints, list(range(len(prints))))


def test_components_of_chains_and_loops(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 50), (60, 61), (61, 60), (60, 61), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {61: 60}


def test_near_dedup(spark, none, docs):
    rows = [(5, prose(50, 9)), (3, prose(50, 9)), (3, prose(50, 9)), (8, "other words here"), (None, "words without an id")]
    assert sorted(r.doc_id or -1 for r in simhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()) == [-1, 3, 8]
    assert simhash.near_dedup(none).count() == simhash.simhash_components(none).count() == 0
    assert simhash.near_dedup(docs).columns == docs.columns
    assert [tuple(r) for r in simhash.simhash_components(spark.createDataFrame([(None, "a"), (None, "b"), (4, "a")], DOCS)).where("doc_id IS NULL").select("component_id").orderBy("component_id").collect()] == [(None,), (4,)]


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("block", [1, 64])
def test_near_dedup_of_planted_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DENSE", 3)
    r, texts = random.Random(12), []
    for k in range(30):
        base = prose(150, 1000 + k).split()
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 12):
            at = set(r.sample(range(150), changes))
            texts.append(" ".join("changed" if i in at else w for i, w in enumerate(base)))
    up = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if up[i] != up[j] and i // 7 == j // 7 and similarity(texts[i], texts[j]) >= 0.8:
            up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    want = sorted(set(up))
    assert 30 < len(want) < 210
    got = simhash.near_dedup(clashing(spark.createDataFrame([*enumerate(texts)], DOCS))).collect()
    assert sorted(x.doc_id for x in got) == want


def plain_segments(hashes):
    """Segments of the weighted fingerprints, bit by bit."""
    mask, out = (1 << 64) - 1, []
    for draw in simhash.DRAWS[:, 0].tolist():
        votes = [0.0] * 8
        for h in hashes:
            x = h + draw & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            weight = 1 / ((x >> 11) + 1) ** 2
            votes = [v + (weight if x >> j & 1 else -weight) for j, v in enumerate(votes)]
        out.append(sum(1 << j for j, v in enumerate(votes) if v > 0))
    return [int.from_bytes(out[k : k + 4], "little", signed=True) for k in range(0, len(out), 4)]


def test_weighted_segments():
    draw = np.random.default_rng(8)
    for n in (1, 2, 7, 700):
        hashes = draw.integers(0, 1 << 64, n, np.uint64)
        assert simhash.segments(hashes) == plain_segments(hashes.tolist())
    assert simhash.segments(np.zeros(0, np.uint64)) == []
    # Shares of equal segments, of sets of a and b shingles with c in common.
    for a, b, c, least, most in [(5, 4, 4, 0.21, 0.25), (9, 9, 8, 0.23, 0.27), (90, 72, 72, 0.25, 0.29), (180, 180, 160, 0.25, 0.29), (100, 100, 18, 0, 0.002)]:
        pairs = [draw.integers(0, 1 << 64, a + b - c, np.uint64) for _ in range(300)]
        equal = np.array([np.equal(simhash.segments(h[:a]), simhash.segments(h[a - c :])) for h in pairs])
        assert least <= equal.mean() <= most
        assert equal.any(axis=1).all() or c == 18


def test_near_copies_are_looked_up_by_segments(spark, monkeypatch):
    base = prose(150, 77)
    df = spark.createDataFrame([(1, base), (2, base.replace(" ", "\t")), (3, base + " changed"), (4, prose(150, 78))], DOCS)
    kept = lambda: sorted(r.doc_id for r in simhash.near_dedup(df).collect())
    assert kept() == [1, 4]
    monkeypatch.setattr(simhash, "segments", lambda hashes: [])
    assert kept() == [1, 3, 4]


# Tokens


def test_sstable_round_trip(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    rows = [(k * 3 - 9, x) for k, x in enumerate(TEXTS)] + [(0, "again"), (None, "no id")]
    got = [tuple(r) for r in sstable.token_table(clashing(spark.createDataFrame(rows, DOCS)), BYTE).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sstable.token_table(none, BYTE).count() == 0


def test_file_systems(tmp_path):
    for uri in (f"file:{tmp_path}/x", f"file://{tmp_path}/x"):
        assert sstable._filesystem(uri)[1] == f"{tmp_path}/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sstable._filesystem("nosuch://bucket/x")


def test_failed_attempts_leave_nothing(spark, tmp_path):
    (tmp_path / "shard-000000.sst.0123").write_bytes(b"half")
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    found = sstable.write_shards(df, f"file:{tmp_path}", BYTE)
    assert sum(f[1] for f in found) == 2
    assert {p.suffix for p in tmp_path.iterdir()} == {".sst"}


def test_sstable_lookups(tmp_path):
    path, r = tmp_path / "x.sst", random.Random(7)
    values = {sstable.key_of(k): bytes(r.randrange(256) for _ in range(2 * r.randrange(900))) for k in sorted(r.sample(range(-(10**6), 10**6), 500))}
    with path.open("wb") as f:
        w = sstable.Writer(f, 2)
        for k, v in values.items():
            w.add(k, v)
        with pytest.raises(ValueError):
            w.add(k, b"")
        w.finish()
    with path.open("rb") as f:
        s = sstable.Reader(f)
        assert len(s.blocks) > 3
        assert dict(s) == values
        assert all(s.get(k) == v for k, v in values.items())
        assert not any(s.get(sstable.key_of(k)) for k in range(10**6, 10**6 + 2000))
        assert all(sstable.doc_id_of(k) is not None for k in values)


LETTERS = [*"ab'sStLREve'd12 \n\t.,!?éΣςİßＡﬁ가ㄱ̧́\x1c\x85 ֋", "<|endoftext|>", "<|startoftext|>"]


def test_encoders_are_the_library(spark):
    from tokenizers import Tokenizer

    word, byte, r = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE), random.Random(8)
    own, cached = bpe.WordBpe(WORD), sstable.CachedEncoder(BYTE)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(LETTERS) for _ in range(r.randrange(40))) for _ in range(3000)] + ["abc" * 400]
    for t, ids in zip(texts, cached.encode(texts), strict=True):
        want = word.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == own.encoded(t)[2] == word.decode(want, skip_special_tokens=False)
        assert np.frombuffer(ids, "<u2").tolist() == byte.encode(t, add_special_tokens=False).ids


def test_encode_decode(docs, none):
    got = {r.doc_id: r for r in bpe.encode_decode(docs, WORD).collect()}
    own, digest = bpe.WordBpe(WORD), lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in enumerate(TEXTS):
        ids = own.encode(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(own.decode(ids)))
    assert bpe.encode_decode(none, WORD).count() == 0
    assert bpe.token_ids(docs, WORD).where("doc_id = 4").first().ids == own.encode(TEXTS[4])


def test_token_counts_are_the_library(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    c, r = pieces.TokenCounter(PIECE), random.Random(9)
    t = Tokenizer(models.Unigram(c.pieces.pieces, unk_id=c.pieces.unk, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=pieces.MARK, prepend_scheme="always")
    few = [*"ab the ing\n  ▁é한𐍈,.T", "<unk>", "<0x0A>", "<s>", "▁▁", "\r\n"]
    for text in [x or "" for x in TEXTS] + ["".join(r.choice(few) for _ in range(r.randrange(25))) for _ in range(4000)]:
        assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids), text
    assert {r.doc_id: r.n_tokens for r in pieces.token_counts(docs, PIECE).collect()} == {k: c.count(x) for k, x in enumerate(TEXTS)}
    assert pieces.token_counts(none, PIECE).count() == 0


def test_forward_sums_all_segmentations():
    p = pieces.Pieces(PIECE)
    prob, index = np.random.default_rng(0).random((len(p.pieces), 2)) * 0.01, {s: i for i, (s, _) in enumerate(p.pieces)}

    def total(w):
        if not w:
            return np.ones(2)
        out = sum((prob[index[w[:n]]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in index), np.zeros(2))
        return out if w[0] in index else out + 1e-9 * total(w[1:])

    words = ["the", "nation", "x", "한a", "aabb"]
    assert np.allclose(pieces.forward(p, prob, words), [np.log(total("▁" + w)) for w in words])
    assert np.isfinite(pieces.forward(p, prob, ["ab" * 5000])).all()


# Models


def test_language(spark, docs, none):
    kinds = {"en": "the thing with nation house".split(), "fr": "les eaux française être où".split()}
    r = random.Random(10)
    rows = [(k, " ".join(r.choice(kinds[lang]) for _ in range(20)), lang) for k, lang in enumerate(["en", "fr"] * 40)] + [(900, None, "en"), (901, "123 !", "en"), (902, "the house", None)]
    df = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))
    got = {x.doc_id: x for x in language.identify(df, PIECE).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows[:80])
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "en")
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    kept = language.keep_identified(df, PIECE)
    assert kept.columns == df.columns
    assert kept.count() == 81
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in language.identify(unlabelled, PIECE).collect()} == {"und"}
    assert language.identify(none.withColumn("lang", F.lit("en")), PIECE).count() == 0


def test_bound_cuts_languages_alike(spark):
    rows = [(k, "the house", "en") for k in range(3000)] + [(5000 + k, "les eaux", "fr") for k in range(3000)] + [(9000 + k, "한국어 말", "ko") for k in range(60)]
    model = language.train(spark.createDataFrame(rows, DOCS + ", lang string"), PIECE, per_language=60, most=30)
    assert model.languages == ["en", "fr", "ko"]
    assert [lang for lang, _ in model.start().predict(["the house", "les eaux", "한국어 말"])] == model.languages


def test_toxicity(spark, docs, none):
    rows = [(k, prose(40, k) + (" You IDIOT!" if k % 4 == 0 else "")) for k in range(300)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = {x.doc_id: x for x in toxicity.score(df, labels).collect()}
    assert len(got) == 300
    assert all(got[k].predicted == (k % 4 == 0) == (got[k].score >= 0.7) for k in got if got[k].held_out)
    clean = toxicity.keep_clean(df, labels)
    assert clean.columns == df.columns
    assert clean.where("doc_id % 4 = 0").count() == 0
    assert clean.count() == 225
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 0").count() == len(TEXTS)
    assert toxicity.score(none, labels).count() == 0
    short = toxicity.score(docs, labels).where("doc_id < 3").select("score").distinct()
    assert short.count() == 1


# Pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b<script>var x='<p>'</script>c", "a\nbc"),
        ('<body><nav><a href="/">m</a></nav><article><h1>T &amp; U</h1><p><b>One,\n two&nbsp;x<br><p>Three &lt;</article><footer>f</footer>', "T & U\nOne, two x\nThree <"),
        ('<div id="main"><p>Long text, with commas, and more.</p><ul><li>i<li>j</ul><div class="user-comments"><p>no, no, no</p></div></div><div class=sidebar><p>s</p></div>', "Long text, with commas, and more.\ni\nj"),
        ("<article><p>x</p><aside>y</aside><form><p>z</p></form><p hidden>h</p><table><tr><td>1<td>2</table></article>", "x\n1\n2"),
        ("<p>cut <a hre", "cut"),
        ('<article><p title="a > b">q</p></i></div><!-- <p>no</p> --></article>', "q"),
        ("<div>" * 3000 + "<p>deep</p>", "deep"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout no-sidebar"><nav>m</nav><article><p>One, two.</p></article><div class="comments"><p>no</p></div></div>', "One, two."),
        ('<form id="aspnetForm"><div class="menu"><a href="/">m</a></div><div><p>One, two, three.</p><p>Four.</p></div></form><footer>f</footer>', "One, two, three.\nFour."),
        ('<div class="page-header-fixed"><p>Some text, of a page.</p><aside>y</aside></div>', "Some text, of a page."),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Text.</p></article>', "Title\nText."),
        ("<aside><p>All there is.</p></aside>", "All there is."),
        ('<article><p>Own.</p></article><div class="related"><article><p>Other, much longer than the own one, by far.</p></article></div>', "Own."),
        ("<div><div>" + "<p>Long, long, long, long, long.</p>" * 9 + "</div><div><p>Short.</p></div></div>", "\n".join(["Long, long, long, long, long."] * 9 + ["Short."])),
    ],
)
def test_main_text_in_foreign_wrappers(page, text):
    assert html.main_text(page) == text


def test_extract(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(0))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]


# Licences


def test_licenses(spark, none):
    notice = licenses.NOTICES[0][1]
    inserted = notice.replace("free of charge", "entirely free of charge")
    rows = [(0, None), (1, ""), (2, "!!"), (3, "Under the MIT-License, under THE mit license."), (4, "cc by nc cc by nc"), (4, "cc by nc cc by nc"), (5, "x " * 50 + inserted), (6, "the mit"), (7, "Apache License, Version 2.0 é")]
    got = licenses.scan(clashing(spark.createDataFrame(rows, DOCS))).orderBy("doc_id").collect()
    short = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got]
    assert short[:7] == [
        (0, 0, 0, None, None, "", "", 0.0),
        (1, 0, 0, None, None, "", "", 0.0),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 8, 2, 0, 4, "mit", "mit", 1.0),
        (4, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0),
        (4, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0),
        (5, 51 + len(notice.split()), 0, None, None, "", "mit", short[6][7]),
    ]
    assert 0.8 <= short[6][7] < 1
    assert (short[7][5:7], short[8][1:7]) == (("", ""), (6, 1, 0, 0, "apache-2", "apache-2"))
    (span,) = got[6].spans
    assert (span.label, span["first"]) == ("mit", 50)
    assert licenses.scan(none).count() == 0


# Decontamination

ITEM = "Anna bought 12 apples for 3 dollars at the small market near the river and gave 12 of them to Tom before the rain began"


def test_leaks(spark, none):
    other = ITEM.replace("Anna", "Maria").replace("12", "40").replace("Tom", "Bob").replace("dollars", "euros")
    mixed = other.replace("gave 40", "gave 41")
    rows = [(0, None), (1, ""), (2, prose(300, 1) + " " + ITEM.upper() + " " + prose(3000, 2)), (3, prose(50, 3) + ". " + other), (4, mixed), (5, prose(500, 4)), (6, "short item text"), (7, ITEM), (7, ITEM), (8, " ".join(ITEM.split()[:10]))]
    items = spark.createDataFrame([(1, ITEM), (2, "Short item text."), (3, None), (4, "")], "item_id bigint, text string")
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.kind) for r in decontamination.leaks(df, clashing(items)).collect()}
    n = len(ITEM.split())
    assert got == {(2, 1): (300, n, "verbatim"), (3, 1): (50, n, "reparameterised"), (6, 2): (0, 3, "verbatim"), (7, 1): (0, n, "verbatim")}
    clean = decontamination.decontaminate(df, items)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 4, 5, 8]
    assert clean.columns == df.columns
    assert decontamination.leaks(none, items).count() == decontamination.leaks(df, items.limit(0)).count() == 0


def test_values_of_other_lengths(spark):
    numbers = "the farmer sold 12 crates of ripe pears on market day and kept 7 for winter then bought 30 new trees with money left"
    names = "on the first morning Anna walked along the old canal with a heavy bag until Tom came by and took it home"
    spelled = "a shop had twenty red lamps in store when the doors opened and only nine of them were left by noon that day"
    put = lambda text, *pairs: " ".join(dict(pairs).get(w, w) for w in text.split())
    rows = [
        (1, put(numbers, ("12", "1,200"), ("7", "3,000"), ("30", "2.5"))),
        (2, prose(60, 1) + ". " + put(names, ("Anna", "Mary Ann"), ("Tom", "Jean-Luc Brown"))),
        (3, put(spelled, ("twenty", "twenty five"), ("nine", "one hundred and two"))),
        (4, put(numbers, ("12", "Anna Lee"), ("7", "two words"), ("30", "red ones"))),
        (5, prose(200, 2) + " Mary Ann 1,200 twenty five"),
        (6, numbers.upper()),
        (7, names),
    ]
    df = clashing(spark.createDataFrame(rows, DOCS))
    items = spark.createDataFrame(list(enumerate([numbers, names, spelled])), "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontamination.decontaminate(df, items).collect()) == [4, 5]
    # Values keep their agreement: one that changes between places is another one.
    twice = "Anna saw 12 birds over the hill then 12 more birds by the lake and Anna went home before dark with Tom"
    other = put(twice, ("12", "1,200"), ("Anna", "Mary Ann"), ("Tom", "Bob"))
    df = spark.createDataFrame([(1, other), (2, other.replace("then 1,200", "then 1,300"))], DOCS)
    got = decontamination.decontaminate(df, spark.createDataFrame([(1, twice)], "item_id bigint, text string"))
    assert [r.doc_id for r in got.collect()] == [2]


def test_rows_that_share_or_lack_a_doc_id(spark):
    rows = [(1, prose(60, 1)), (1, prose(60, 2)), (1, prose(60, 2)), (2, prose(60, 1)), (3, ITEM), (3, prose(60, 3)), (None, ITEM), (None, prose(60, 4)), (None, None)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    as_rows = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
    assert as_rows(decontamination.decontaminate(df, items)) == sorted((r for r in rows if r[1] != ITEM), key=repr)
    near = [rows[0], rows[1], rows[4], rows[5], *rows[6:]]
    assert as_rows(simhash.near_dedup(df)) == sorted(near, key=repr)


def test_leaks_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, prose(20, 1) + " " + ITEM)], DOCS)
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    want = decontamination.leaks(df, items).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert decontamination.leaks(df, items).collect() == want
    assert len(want) == 1


# Exact top-k


def plain_top_k(rows, every, k):
    sound = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for q in sorted({i for i, _ in sound if i % every == 0}):
        own = min(v for i, v in sound if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in sound if i != q and len(v) == len(own))
        found += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return found


@pytest.mark.parametrize(("shard", "bytes_"), [(40, 0), (8192, 32 << 20)])
def test_top_k_is_brute_force(spark, monkeypatch, shard, bytes_):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(balltree, "LEAF", 4)
    monkeypatch.setattr(balltree, "CELLS", 5)
    r = np.random.default_rng(1)
    vectors = [r.normal(size=6).astype("f4").tolist() for _ in range(120)] + [[0.5] * 6] * 80 + [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1.0], [2.0], []]
    rows = list(enumerate(vectors))
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "dim", "shard", "q", "tree")})
    got = [tuple(x) for x in balltree.top_k(frame(rows), every=10).collect()]
    assert sorted(got) == plain_top_k(rows, 10, 10)
    # Ids that occur with other vectors, and rows that are all alike, very often.
    rows += [(10, vectors[3]), (20, [3.0]), (7, vectors[8]), (None, vectors[1])] + [(33, vectors[2])] * 300 + [(50, vectors[5])] * 300
    got = [tuple(x) for x in balltree.top_k(frame(rows), every=10).collect()]
    assert sorted(got) == plain_top_k(rows, 10, 10)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [2.0**20, 1.0])] + [(k, [2.0**20, float(k)]) for k in range(1, 40)]
    got = [tuple(x) for x in balltree.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=10).collect()]
    assert sorted(got) == plain_top_k(rows, 10, 10)


def test_top_k_of_nothing(spark):
    assert balltree.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert balltree.top_k(spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")).count() == 0
