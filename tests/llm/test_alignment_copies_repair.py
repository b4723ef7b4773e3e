"""Alignment of tokenizers, exact copies and conversation repair against plain versions."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from txnrecon.llm import align, common, conversations, exact_dedup, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, local string, class string, nth string, text_sha256 string"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))


def documents():
    rng = np.random.default_rng(5)
    pool = ["the", "an", "Straße", "naïve", "it's", "12,5", "日本語", "x-y", "zz9", "end.", "\n", "\t a", "<|endoftext|>", "<s>", "▁"]
    out = [(k, " ".join(rng.choice(pool[: 14 if k % 9 else 15], rng.integers(1, 40)))) for k in range(60)]
    out += [(100 + k, out[7][1]) for k in range(40)] + [(None, out[7][1]), (None, "lonely"), (None, "lonely")]
    out += [(200, None), (201, ""), (202, " "), (203, LONG), (204, LONG), (205, "a  b \n c  "), (206, "▁"), (207, "\x00 é ﬁ ")]
    out += [(208, "same")] * 3 + [(300 + k, f"row {k}") for k in range(200)]
    return [(*r, "en", "s", 1, "l", "c", "n", "t") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    common.ready(spark)
    return spark.createDataFrame(documents(), DOCS).repartition(7)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def classes_of(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "limits",
    [
        {},
        {"table_bytes": 64, "bucket_bytes": 1 << 30},  # tables overflow, round after round
        {"read_bytes": 40, "bucket_bytes": 2_000, "heavy": 1},  # a record a row, copies merged in parts
        {"read_bytes": 1, "table_bytes": 300, "bucket_bytes": 500, "heavy": 2},
    ],
)
def test_copies(docs, limits):
    found = exact_dedup.dedup(docs, **limits).collect()
    mine = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found]
    assert sorted(mine, key=str) == classes_of([r[:2] for r in documents()])


def test_rows_without_copies(docs, no_docs):
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({r[1] or "" for r in documents()}) and all(r["local"] == "l" for r in rows)
    assert exact_dedup.dedup(no_docs).count() == 0 and exact_dedup.without_copies(no_docs).count() == 0


def test_a_table_compares_texts_not_hashes():
    table = exact_dedup.Table()
    numbers = [table.add(7, b"%d" % k) for k in range(3_000)]
    assert numbers == list(range(3_000)) and table.find(7, b"2999") == 2_999 and table.find(7, b"x") == -1


# --- alignment


def plain_alignment(rows):
    """Rows, links and counts by the contract, occurrence by occurrence."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.public_tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.public_tokenizer("piece_bpe_32k.model"))
    letters = align.byte_letters()
    assert sorted(letters.values()) == list(range(256))

    def b_bytes(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        x = y = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xs = [bytes(letters[c] for c in a.id_to_token(k)) for k in x]
            ys = [b_bytes(k) for k in y]
            if not b"".join(xs) == b"".join(ys) == b" " + text.encode():
                x = y = []
        if not x:
            docs.append((doc_id, [], [], [], ""))
            continue
        x_end, y_end = (list(itertools.accumulate(map(len, p))) for p in (xs, ys))
        both = sorted(set(x_end) & set(y_end))
        links = [(m, n) for m, e in zip(x, x_end) for n in [y[y_end.index(e)] if e in set(y_end) else None] if n is not None] if len(x) < 500 else None
        if links is None:
            at = dict(zip(y_end, y))
            links = [(m, at[e]) for m, e in zip(x, x_end) if e in at]
        count.update(links)
        groups, low = [], 0
        for e in both:
            groups.append(tuple(",".join(str(t) for t, q in zip(ids, ends) if low < q <= e) for ids, ends in ((x, x_end), (y, y_end))))
            low = e
            if len(x) > 500:
                groups = None
                break
        docs.append((doc_id, x, y, links, groups))
    most = collections.Counter()
    for (m, n), k in count.items():
        most[n] = max(most[n], k)
    return docs, count, most


@pytest.mark.parametrize("limits", [{}, {"chunk_rows": 17}, {"chunk_rows": 17, "fan": 2}, {"chunk_rows": 5, "fan": 2, "run_bytes": 300}])
def test_alignment(docs, limits):
    rows = [r[:2] for r in documents()]
    want, count, most = plain_alignment(rows)
    found = align.Alignment(docs, queries.public_tokenizer("byte_bpe_50k.json"), queries.public_tokenizer("piece_bpe_32k.model"), **limits)
    pairs = {(r.a, r.b): (r["count"], r.best) for r in found.pairs().collect()}
    assert pairs == {p: (k, k == most[p[1]]) for p, k in count.items()}
    got = align.digests(found.documents).join(found.scores(), ["chunk", "nth"], "left").collect()
    mine = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_best or 0, r.count_sum or 0) for r in got if r.doc_id is not None)
    theirs = sorted(
        (d, len(x), len(y), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links))
        for d, x, y, links, _ in want if d is not None
    )
    assert mine == theirs
    said = {r.doc_id: r.groups_sha256 for r in got}
    for d, x, _, _, groups in want:
        if d is not None and groups is not None:
            text = ";".join("|".join(g) for g in groups) if x else None
            assert said[d] == (hashlib.sha256(text.encode()).hexdigest() if x else ""), d


def test_words_in_a_row_are_the_text():
    paths = [queries.public_tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    words = ["Über", "it's", "  <s>", "\n", "日本", "12,", "'re", "\x1c", "a\u00a0b", "\u2003", "<0x41>", "x  ", "\t\t", "…", "e\u0301"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(300)]
    aligner, whole = align.Aligner(*paths), align.Aligner(*paths, remembered=3)
    assert aligner.cuttable
    whole.cuttable = False
    for part in (texts[:150], texts[150:], texts[:20]):
        for name, (flat, many) in aligner.align(part).items():
            theirs = whole.align(part)[name]
            assert np.array_equal(flat, theirs[0]) and np.array_equal(many, theirs[1]) and len(flat)


def test_nothing_to_align(no_docs):
    found = align.Alignment(no_docs, queries.public_tokenizer("byte_bpe_50k.json"), queries.public_tokenizer("piece_bpe_32k.model"))
    assert align.digests(found.documents).count() == found.scores().count() == found.pairs().count() == 0


# --- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if v is None else v for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", said[3]) if kind == 2 else said[3]
        out += [(conv, turn, "user" if kind == 4 else said[2], text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Faults by reading, and the least (cost, audit) over every edit, strings compared as strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
    # Audits of different lengths: keep, for each state, all least-cost ones, and compare at the end.
    paths = {0: {(0, "", ())}}

    def grow(paths):
        out = {s: set(p) for s, p in paths.items()}
        for _ in range(2):
            for s, some in [(s, set(p)) for s, p in out.items()]:
                for r in "ua":
                    if (s, r) in conversations.STEP:
                        out.setdefault(conversations.STEP[s, r], set()).update((c + 2, a + "I", (*l, conversations.NAME[r] + ":")) for c, a, l in some)
        return out

    def cheapest(paths):
        return {s: {x for x in p if x[0] == min(y[0] for y in p)} for s, p in paths.items()}

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = collections.defaultdict(set)
        for s, some in grow(paths).items():
            for c, a, l in some:
                after[s].add((c + 3, a + "D", l))
                if fault in ("", "t"):
                    more = fault == "t"
                    if (s, role[:1]) in conversations.STEP:
                        after[conversations.STEP[s, role[:1]]].add((c + more, a + "K", (*l, f"{role}:{text}")))
                    for r in "ua":
                        if (s, r) in conversations.STEP:
                            after[conversations.STEP[s, r]].add((c + 2 + more, a + "R", (*l, f"{conversations.NAME[r]}:{text}")))
        paths = {s: set(sorted(p)[:400]) for s, p in cheapest(after).items()}
    ends = [x for s, p in grow(paths).items() if s in (0, 3) for x in p]
    cost, audit, lines = min(ends, key=lambda x: x[:2])
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)


def talks():
    rng = np.random.default_rng(9)
    roles = ["user", "assistant", "system", "tool", None, "", "umpire"]
    texts = ["Well.", "And so", "Why?", " ", "", None, "No!  \n", "x", "a. b"]
    out = []
    for conv in range(150):
        for turn in range(rng.integers(1, 9)):
            at = None if rng.random() < 0.05 else int(turn * (1 + (rng.random() < 0.1)))
            if rng.random() < 0.6:
                out.append((conv, at, ["user", "assistant"][turn % 2], f"t{turn}."))
            else:
                out.append((conv, at, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    out += [(None, k, "user", "no id.") for k in range(5)] + [(900, None, None, None)] * 3 + [(901, 5, "user", "x.")] * 6
    out += [(1000, k, roles[k % 3], f"{texts[k % 4]}{k % 50}.") for k in range(400)]
    return out


def repaired_rows(frame):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r.conv_id: tuple(r[n] for n in names) for r in frame.collect()}


@pytest.mark.parametrize("width", [1, 3, 512])
def test_repair(spark, width):
    rows = talks()
    talk = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, line int")
    damaged = conversations.damage(talk)
    want = collections.defaultdict(list)
    for r in plain_damage(rows):
        want[r[0]].append(r)
    got = repaired_rows(conversations.repaired(talk, damaged, width))
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        if conv != 1000:  # too long for the plain version's lists of ties
            assert found == plain_repair(want[conv]), conv
    again = repaired_rows(conversations.repaired(talk, damaged, 64))
    assert got[1000] == again[1000] and len(got[1000][6]) >= 300


def test_messages_read_as_they_should(spark):
    talk = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    lines = collections.defaultdict(list)
    for r in sorted(conversations.Repair(talk).messages().collect(), key=lambda r: (str(r.conv_id), r.line)):
        lines[r.conv_id].append(r)
    for found in lines.values():
        assert [r.line for r in found] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in found))


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired(none, conversations.damage(none)).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert repaired_rows(conversations.repaired(gone, none)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
