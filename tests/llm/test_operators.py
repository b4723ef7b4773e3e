"""Operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeated
rows, empty tables, further columns."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from txnrecon.llm import (
    common, components, decontaminate, interpolate, language, mix, quality, simhash, token_store, topk, toxicity, viterbi,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, key string"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))


def rows():
    rng = np.random.default_rng(5)
    pool = [f"w{k}" for k in range(400)]
    out = []
    for k in range(60):
        body = " ".join(rng.choice(pool, rng.integers(1, 90)))
        out.append((k, body, "en", f"s{k % 4}"))
    base = out[7][1]
    out += [(100 + k, base, "en", "s0") for k in range(6)]  # exact copies
    out += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t ", None, "s1"), (None, base + " x", "en", None)]
    out += [(203, LONG, "de", "s2"), (204, "Ünï ÄÖ —   日本 🎉 <|endoftext|> a  b \n c", "fr", "s3")]
    out += [(205, "same row", "en", "s0")] * 3
    return [(*r, 1, 0.5, "r", "k") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    common.ready(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, threshold=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_near_duplicates(docs, nothing):
    data = rows()
    fps = [fingerprint(r[1]) for r in data]
    groups = collections.defaultdict(list)
    for r, c in zip(data, classes(fps), strict=True):
        groups[c].append(r[0])
    least = {c: min((x for x in ids if x is not None), default=None) for c, ids in groups.items()}
    want = sorted(((r[0], f, least[c]) for r, f, c in zip(data, fps, classes(fps), strict=True)), key=str)
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=str) == want
    assert {r.doc_id for r in found if r.kept} >= {200, 205} and simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("limit", [3, 8_192])
def test_links_of_a_crowded_anchor(spark, limit):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 150:
        f = centre
        for b in rng.choice(64, rng.integers(1, 8), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), limit=limit)
    label = {r.node: r.root for r in components.smallest(found, "a", "b").collect()}
    mine = [label.get(f[0], f[0]) for f in signed]
    want = classes(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 6, 7])
def test_blocks_of_a_crowded_anchor_in_any_batches(rows):
    anchor = np.repeat([5, 7, 9, 11], [2, 12, 9, 3])
    fp = np.arange(len(anchor)) * 0x0F0F0F0F0F
    cut = [pa.RecordBatch.from_arrays([pa.array(anchor[k : k + rows]), pa.array(fp[k : k + rows])], ["anchor", "fp"]) for k in range(0, len(fp), rows)]
    found = pa.Table.from_batches(simhash._compare(4, 3)(iter(cut))).to_pandas()
    blocks = found[found.block >= 0]
    for hot in (7, 9):
        mine = blocks[blocks.a == hot]
        assert sorted(mine.b) == sorted(fp[anchor == hot])
        sizes = mine.groupby("block").size()
        assert list(sizes.index) == list(range(len(sizes))) and sizes.max() <= 3
    assert set(blocks.a) == {7, 9}


def test_anchors_cover():
    rng = np.random.default_rng(2)
    masks = simhash.anchor_masks()

    def anchors(x):
        s = 0
        for i in range(1, 32):
            if x >> (i - 1) & 1:
                s ^= i
        return {x ^ m for m in masks[s]}

    for _ in range(300):
        x = int(rng.integers(0, 1 << 32))
        y = x
        for b in rng.choice(32, rng.integers(0, 3), replace=False):
            y ^= 1 << int(b)
        assert anchors(x) & anchors(y)


def test_mix(docs, nothing):
    rows_, placed = mix.mix(docs, block_words=64, shard_blocks=4)
    found = mix.taken_words(rows_, placed).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += size(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = full | {s for s in names if weight[s] * level > 3 * sizes[s]}
        if more == full:
            break
        full = more
    target = {s: 3 * sizes[s] if s in full else weight[s] * level for s in names}
    got = collections.Counter()
    assert len(found) == len(rows())
    source = {r[0]: r[3] for r in rows()}
    for r in found:
        assert r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        got[source[r.doc_id]] += r.taken
    assert all(abs(got[s] - target[s]) < 1 for s in names)
    again = mix.mix(docs.repartition(5), block_words=64, shard_blocks=4)[1]
    keys = ["order", "pass", "shard", "position", "words"]
    assert sorted(placed.select(keys).collect()) == sorted(again.select(keys).collect())
    empty = mix.mix(nothing)
    assert mix.taken_words(*empty).count() == 0


def test_mix_of_one_row_in_two_sources(spark):
    data = [(None, "p q r", "a")] * 2 + [(None, "p q r", "c"), (9, "p q r", "a"), (9, "p q r", None)]
    data += [(k, "x y z " * 4, s) for k, s in enumerate("aabbccc")]
    rows_, placed = mix.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), block_words=5, shard_blocks=2)
    rows_ = rows_.withColumnRenamed("source_size", "whole").withColumn("source_size", F.col("place"))
    found, per, target = mix.taken_words(rows_, placed).collect(), collections.Counter(), {}
    assert len(found) == len(data)
    for r in found:
        assert r.taken <= 3 * r.size
        per[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert {p: per[p] for p in target} == {p: math.floor(t) for p, t in target.items()}


def test_permutation_is_one():
    for n in (1, 2, 5, 1000):
        at = mix._permuted(np.arange(n), np.full(n, n), np.full(n, 99, dtype=np.uint64))
        assert sorted(at) == list(range(n))


def test_shares_meet_quotas(spark):
    quotas = spark.createDataFrame([(0, 50), (1, 7), (2, 0), (3, 1)], "place long, blocks long")
    got = mix.shares(quotas, 9).collect()
    for place, blocks in ((0, 50), (1, 7), (3, 1)):
        spans = sorted((r["first"], r["n"]) for r in got if r.place == place)
        assert [f for f, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1])
        assert sum(n for _, n in spans) == blocks


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_token_counts(docs, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer("piece_bpe_32k.model")
    vocabulary = viterbi.zipf_vocabulary(path)
    plain = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    pieces = viterbi.Pieces(vocabulary)
    odd = ["", "<unk>", "a<unk>b", "日本語 🎉🎉", "  a  b ", "▁▁x", "\n\t\nx", "<0x41>q<s>", "é́ñ<unk><unk>", "\x00\x01"]
    for text in [r[1] or "" for r in rows()] + odd:
        assert pieces.counts([text])[0][1] == len(plain.encode(text, add_special_tokens=False).ids), text[:40]
    found = viterbi.token_counts(docs, path).collect()
    assert len(found) == len(rows()) and {r.n_tokens for r in found if r.doc_id in (200, 201)} == {0}
    assert viterbi.token_counts(nothing, path).count() == 0


def test_token_store(spark, docs, nothing):
    from tokenizers import Tokenizer

    path, plain = tokenizer("byte_bpe_50k.json"), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    folder = common.new_folder(spark, "tokens")
    token_store.write(docs, folder, path, end_id=2)
    got = token_store.starts(token_store.read(spark, folder)).orderBy("start").collect()
    data = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in data]
    at = 0
    for r, d in zip(got, data, strict=True):
        ids = [*plain.encode(d[1] or "", add_special_tokens=False).ids, 2]
        assert r.ids == ids and r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    crc = {r.doc_id: r.ids_crc32 for r in token_store.digests(token_store.read(spark, folder)).collect()}
    assert all(crc[r.doc_id] == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in got if r.doc_id != 205)
    assert {r.doc_id for r in token_store.documents_between(spark, folder, 3, 5).collect()} == {3, 4, 5}
    assert "ids" not in token_store.counters(spark, folder).columns
    other = common.new_folder(spark, "tokens")
    token_store.write(nothing, other, path, end_id=2)
    assert token_store.read(spark, other).count() == 0


def test_words_are_encoded_as_in_their_text():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    encoder = token_store.Encoder(tokenizer("byte_bpe_50k.json"), 2)
    texts = [" a", "a ", "a  b", "a \n b", "a\n b", "a  b", "it's, we'll.", "x<|endoftext|> y.", "é.,!? ü", "7. 8,5", "\x1c b\x1d c"]
    for text, blob in zip(texts * 2, encoder.encode(texts * 2), strict=True):
        assert list(np.frombuffer(blob, "<u4")) == [*plain.encode(text, add_special_tokens=False).ids, 2], text


def test_words_are_cut_at_line_ends_and_marks():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    parts = ["a", "bé", "Die.", "\n", "\r\n", "\t", " ", "  ", "\u00a0", "\u2028", "'s", "'", ".", "%%%", "_", "-", "|>", "<|endoftext|>", "12", "漢", "Ⅷ", "e\u0301"]
    drawn = np.random.default_rng(7)
    texts = ["".join(drawn.choice(parts + [" ", "\n"] * 4, drawn.integers(0, 30))) for _ in range(4000)]
    texts += ["the.\nEnd&&&", "x the.\nEnd&&& y", "x a\nb\nc", "x a \nb", "x \nb", "x a'\nb", "x a\n'b", "x the\n<|endoftext|>", "x a.\u00a0\nb"]
    # Few words are remembered, so most are forgotten between the calls and learned again.
    encoder = token_store.Encoder(tokenizer("byte_bpe_50k.json"), 2, remembered=50)
    for k in range(0, len(texts), 250):
        some = texts[k : k + 250]
        for text, blob in zip(some, encoder.encode(some), strict=True):
            assert list(np.frombuffer(blob, "<u4")) == [*plain.encode(text, add_special_tokens=False).ids, 2], text
        assert len(encoder.words) == len(encoder.uses) == len(encoder.pool.size) <= 50 + 4000


def test_the_words_used_most_are_remembered():
    encoder = token_store.Encoder(tokenizer("byte_bpe_50k.json"), 2, remembered=6)
    encoder.encode(["x " + "often " * 9 + "twice twice once alpha beta gamma delta epsilon"])
    assert encoder.words.to_pylist() == ["often", "twice"] and encoder.uses.tolist() == [4, 1]
    encoder.encode(["x often " + "new " * 5 + " ".join(f"w{k}" for k in range(9))])
    assert encoder.words.to_pylist() == ["often", "new"]


def test_decontaminate(spark, docs, nothing):
    items = [(1, " ".join(LONG.split()[500:520]).upper()), (2, "same ROW"), (3, None), (4, "..."), (2, "a b"), (None, "x"), (9, "w1 nowhere w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    want = []
    for r in rows():
        w, hit, names = low(r[1]), set(), set()
        for i, t in items:
            v = low(t)
            m = min(10, len(v))
            for s in range(len(v) - m + 1) if m else ():
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == v[s : s + m]:
                        hit.update(range(k, k + m))
                        names.add("" if i is None else str(i))
        want.append((r[0], len(w), len(hit), sorted(names)))
    found = decontaminate.decontaminate(docs, bench)
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    none = decontaminate.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(rows()) and not any(r.n_hit for r in none)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x b"), (4, "c a b c")], "doc_id long, text string")
    asked = [(1, "a"), (1, "b"), (2, "c"), (3, "a"), (3, "absent")]
    queries = spark.createDataFrame(asked, "query long, term string")
    terms = decontaminate.vocabulary(queries)
    postings = decontaminate.index(docs, terms)
    near = decontaminate.proximity(postings, terms, queries, 3).join(decontaminate.closings(postings, terms), "row")
    assert sorted({(r["query"], r.doc_id) for r in near.collect()}) == [(1, 1), (1, 2), (1, 4), (2, 4)]


def test_topk(spark):
    rng = np.random.default_rng(3)
    data = [(k, [float(x) for x in rng.normal(0, 0.2, 5).astype(np.float32)]) for k in range(260)]
    data += [(k, data[7][1]) for k in range(300, 340)]  # ties
    data += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (404, []), (500, [0.5, 0.5])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    whole = topk.integer_vectors(frame)
    v = {r.vec_id: r.v for r in whole.collect()}
    assert not {400, 401, 402, 403, None} & set(v) and v[0] == [math.floor(1024 * x) for x in data[0][1]]
    got = topk.top_k(whole.where("vec_id % 100 = 0"), whole, query_block=2, candidate_block=50).collect()
    for q in (0, 100, 200, 300, 500):
        scored = sorted((-sum(a * b for a, b in zip(v[q], w, strict=False)), i) for i, w in v.items() if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert topk.top_k(whole.limit(0), whole).count() == 0


def test_interpolated_scores(docs, nothing):
    learn = common.crc_mod("doc_id", 5) != 1
    got = interpolate.score(docs, learn, tokens=500).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows()]
    one, two = collections.Counter(), collections.Counter()
    for d, w in tokens:
        if not held(d):
            one.update(w)
            two.update(zip(["begin", *w], w, strict=False))
    total, kinds = sum(one.values()), len(one)
    base = sorted(
        (str(d), held(d), len(w), sum(one[x] > 0 for x in w), round(sum(math.log10((one[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), 6))
        for d, w in tokens
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == base
    assert {r.train_tokens for r in got} == {total}
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert interpolate.score(nothing, learn).count() == 0
    untrained = interpolate.score(docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in untrained)


def test_mixture_weights_add_up():
    held = np.array([(3 << 40) + (9 << 20) + 40, (1 << 40) + 50, 60], dtype=np.int64)
    w = interpolate.weights(held, np.array([10.0, 5.0, 2.0]), 100)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[0, 0] == 0


def test_language(spark, nothing):
    learn = F.col("doc_id") < 1_000
    say = {"en": "the house and the garden are with this thing", "de": "das haus und der garten sind mit diesem ding", "fr": "la maison et le jardin sont avec cette chose"}
    rng = np.random.default_rng(4)
    text = lambda lang: " ".join(rng.choice(say[lang].split(), 12))
    data = [(k, text(lang), lang) for k in range(60) for lang in say]
    data += [(2_000 + k, text(lang), lang) for k in range(10) for lang in say]
    data += [(3_000, None, "en"), (3_001, "", None), (3_002, "12 !?", "de"), (3_003, "HAUS", None)]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, lang_pred string")
    models = language.fit(docs, learn)
    got = {r.doc_id: r for r in language.identify(docs, models, ["doc_id"]).where("doc_id >= 2000").collect()}
    seen = {(r[0], r[2]) for r in data if 2_000 <= r[0] < 3_000}
    found = language.identify(docs.where("doc_id between 2000 and 2999"), models, ["doc_id", "lang"]).collect()
    assert {(r.doc_id, r.lang_pred) for r in found} == seen and all(0 <= r.score <= 1 for r in found)
    assert [got[k].lang_pred for k in (3_000, 3_001, 3_002, 3_003)] == ["und", "und", "und", "de"]
    assert language.fit(nothing, learn) is None
    assert {r.lang_pred for r in language.identify(docs, None, ["doc_id"]).collect()} == {"und"}


def test_words_are_remembered_per_model(spark, monkeypatch):
    # Every object at one address, as when a worker drops one broadcast before it loads the next.
    monkeypatch.setattr(language, "id", lambda x: 1, raising=False)
    docs = spark.createDataFrame([(1, "aa ab aa", "x")], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["aa ab aa"])], ["doc_id", "_text"])
    words = [{"a": {"aa": 9, "ab": 4}, "b": {"bb": 5}}, {"a": {"bb": 9}, "b": {"aa": 7, "ab": 3}}, {"c": {"aa": 3, "b": 2}}]
    for counts in words:
        models = language.Models({k: collections.Counter(c) for k, c in counts.items()}, order=3)
        (found,) = language.identify(docs, models, ["doc_id"])(iter([batch]))
        entropy, _ = models.entropies(["aa ab aa"])
        assert found.column("lang_pred")[0].as_py() == models.langs[int(entropy[0].argmin())]
        assert found.column("entropy")[0].as_py() == pytest.approx(entropy.min())
    assert list(common.per_worker("languages")) == [models.key]


def test_character_models_are_distributions():
    models = language.Models({"a": collections.Counter({"ab": 3, "b": 1, "aab": 2}), "b": collections.Counter({"ba": 2})}, order=3)
    # Every character of the alphabet after one context, and the end.
    letters = ["a", "b"]
    for k in range(2):
        p = np.exp(models.log_probs(["", *letters, *(x + y for x in letters for y in letters)]))[:, k]
        assert 0 < p.sum() < 1


def labelled(spark, n=240):
    rng = np.random.default_rng(6)
    plain, bad = [f"word{k}" for k in range(60)], ["vile", "awful", "nasty"]
    data, labels = [], []
    for k in range(n):
        words = list(rng.choice(plain, 60))
        if k % 3 == 0:
            for _ in range(4):
                words[int(rng.integers(60))] = str(rng.choice(bad))
        shout = k % 4 == 0
        data.append((k, " ".join(w.upper() + "!!" if shout else w for w in words), "x"))
        labels.append((k, int(not shout), int(k % 3 == 0)))
    data += [(1_000, None, "x"), (1_001, "", "x"), (1_002, "word1", "x"), (None, "word2", "x"), (1_002, "word1", "x")]
    labels += [(None, 1, 1), (1_002, None, None)]
    return (
        spark.createDataFrame(data, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels, F.col("doc_id") < 160)
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert all((got[k] >= 0.3) == (k % 4 != 0) for k in range(160, 240)) and all(0 <= s <= 1 for s in got.values())
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark)
    plain = docs.where("doc_id % 4 != 0 or doc_id is null or doc_id >= 1000")
    net = toxicity.fit(plain, labels, F.col("doc_id") < 160)
    got = toxicity.scored(plain, net).select("row.*", F.col("score").alias("found")).collect()
    assert plain.columns == [c for c in got[0].asDict() if c != "found"] and len(got) == plain.count()
    right = [(r.found >= 0.3) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and 160 <= r.doc_id < 240]
    assert np.mean(right) > 0.95 and all(0 <= r.found <= 1 for r in got)
    single = toxicity.fit(plain, labels.limit(0), F.lit(True))
    assert toxicity.score(plain.limit(0), single, ["doc_id"]).count() == 0


def test_toxicity_learns_from_the_labels_that_match(spark):
    docs, labels = labelled(spark)
    plain = docs.where("doc_id % 4 != 0")
    absent = spark.range(10_000, 14_000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic")

    def right(**how):
        net = toxicity.fit(plain, labels.unionAll(absent), F.col("doc_id") >= 0, **how)
        got = toxicity.score(plain.where("doc_id < 1000"), net, ["doc_id"]).collect()
        return np.mean([(r.score >= 0.3) == (r.doc_id % 3 == 0) for r in got])

    assert right(rows=(60, 120)) > 0.95
    assert right(rows=(60, 120), most_bytes=380) > 0.8  # all texts are longer


def test_toxicity_of_both_kinds_or_none(spark):
    docs, labels = labelled(spark)
    for kinds in ("false", "toxic = 1", "toxic = 0"):
        with pytest.warns(UserWarning, match="every score is 0"):
            net = toxicity.fit(docs, labels.where(kinds), F.lit(True))
        assert {r.score for r in toxicity.score(docs, net, ["doc_id"]).collect()} == {0.0}


def test_long_texts_bring_windows_from_everywhere():
    text = b" ".join(b"w%d" % k for k in range(5_000))
    some = toxicity._spread(text, 4_000)
    at = [int(w[1:]) for w in some.split()[:-1]]
    assert 3_000 < len(some) <= 4_000 and at[0] == 0 and at[-1] > 4_900 and max(np.diff(at)) < 600
    assert toxicity._spread(text, len(text)) == text and len(toxicity._spread(b"x" * 9_000, 100)) == 100
    assert toxicity._cap([10, 20, 1_000, 2_000], 630) == 300 and toxicity._cap([10, 20], 30) == 20 and toxicity._cap([], 9) == 0


def test_gradients():
    net = toxicity.Network([b"a", b"b", b"c"], seed=1)
    coded = net.encode([b"a", b"b", b"zz"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = np.array([[0, 1, 2, 3], [2, 0, 3, 3], [1, 1, 0, 2]])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = toxicity._sigmoid(net.forward(net.inputs(net._vectors(*coded)), ids))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    vectors = net._vectors(*coded)
    g, d_fed = net.gradients(net.inputs(vectors), ids, y, w)
    g["wx"], g["b"] = vectors.T[None] @ d_fed, d_fed.sum(axis=1, keepdims=True)
    for name in ("wx", "wh", "b", "att", "ask", "out", "c"):
        x = net.p[name]
        at = tuple(0 for _ in x.shape)
        x[at] += 1e-3
        up = loss()
        x[at] -= 2e-3
        down = loss()
        x[at] += 1e-3
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


def test_windows_cover_every_word():
    owner, first, end = toxicity.windows_of([0, 1, 24, 25, 100])
    for k, (at, n) in enumerate(((0, 0), (0, 1), (1, 24), (25, 25), (50, 100))):
        starts = first[owner == k] - at
        assert set(range(n)) <= {s + d for s in starts for d in range(toxicity.WINDOW)} and (end[owner == k] == at + n).all()


def test_languages_of_long_texts_are_learned(spark):
    rows = [(k, f"the house and the garden of number {k}", "en") for k in range(40)]
    rows += [(100 + k, f"das Haus und der Garten der Nummer {k} " * 800, "de") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.fit(docs, F.lit(True))
    assert models.langs == ["de", "en"]
    found = language.sample(docs, F.lit(True), "doc_id", "text", "lang", 300, 20_000).collect()
    assert len(found) == 80 and max(len(r.text) for r in found) <= 20_003


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, f"fine text {k}" if k % 2 else f"BAD!!! {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(10_000 + k, 1) for k in range(3_000)], "doc_id long, quality int")
    few = quality.fit(docs, labels, F.lit(True), rows=60)
    all_ = quality.fit(docs, labels.where("doc_id < 100"), F.lit(True), rows=60)
    assert few.scores(np.zeros((1, len(quality.FEATURES)))).tolist() == all_.scores(np.zeros((1, len(quality.FEATURES)))).tolist()


def test_counts_do_not_wrap():
    big = np.uint64(1) << np.uint64(40)
    packed = interpolate._pack(np.array([big], dtype=np.uint64))
    assert interpolate._unpack(packed, np.uint64)[0] == big
