import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orofold.llm import bpe, common, langid, line_dedup, minhash, packing, toxicity, url_filter, vectors

P = pytest.importorskip("public_tokenizers")
LONG = "word " * 9_000 + "x" * 30_000 + " " * 9_000 + "é—'ll 12" * 2_000
TEXTS = [None, "", " ", "one", "One  two\n\nthree 's don't", "日本語" * 9_000, LONG, "a<|endoftext|>b", "same text again and again", "same text again and again"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "no id", "extra"), (3, "again id three", "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT_ID string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def encoder(**sizes):
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Encoder({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, P.PATTERN, **sizes)


@pytest.mark.parametrize("sizes", [{}, {"leaf": 50, "window": 4, "wide": 60, "long": 16}])
def test_bpe_tree_equals_the_library(sizes):
    e = encoder(**sizes)
    rng = np.random.default_rng(5)
    random = ["".join(rng.choice(list("ab '.\n\té1日s"), 700)) for _ in range(20)]
    for t in [x for x in TEXTS if x] + random:
        t = t[:20_000]
        ids = e.encode(t)
        assert ids == e.core.encode_ordinary(t)
        assert e.decode(ids) == t.encode()


def test_bpe_query(docs, none):
    out = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(out) == len(TEXTS) + 2
    assert sorted(r.decoded_sha256 for r in out if r.doc_id == 6) == [hashlib.sha256(LONG.encode()).hexdigest()]
    library = encoder().core
    for r in out:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        if (r.doc_id, r.n_tokens) != (3, len(library.encode_ordinary("again id three"))):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert next(r for r in out if r.doc_id == 0).n_tokens == 0
    assert bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_seq[p.sequence_id].append(p)
    for (doc, n), own in by_doc.items():
        text = "no id" if doc is None else "again id three" if doc == 3 and n != len(tok.encode("one", add_special_tokens=False).ids) + 1 else TEXTS[doc] or ""
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        own.sort(key=lambda p: p.start)
        assert len(ids) == n and own[0].start == 0 and sum(p.length for p in own) == n
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_best_fit_takes_the_tightest_window():
    windows = packing.best_fit([("a", 0, [0] * n) for n in (6, 5, 4, 3, 2)], 10)
    assert sorted(sorted(len(p[2]) for p in w) for w in windows) == [[2, 3, 5], [4, 6]]


def test_url_filter(spark):
    urls = [None, "", "x.org/a", "http://A.Example.ORG/es/x", "http://example.org/en/12?q", "http://www.free-bets.example.com/en", "http://notexample.org", "https://a.com/fr/x#y", "http://org/", "a://b.com/de/", "http://b.com/de", "http://x.org//://y.com/fr/", "http://Ad.doubleclick.NET?x", "http://xdoubleclick.net/", "http://" + "a." * 100_000 + "criteo.com/", "http://" + "b" * 200_000 + ".org/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://q.org/", "h")], "page_id long, url string, HTML string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[0] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == (None, "allow")
    assert got[12][2:] == (None, "block") and got[13][2:] == (None, "allow") and got[14][2:] == (None, "block")
    assert got[6] == ("notexample.org", "", None, "allow")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("org/", "allow") and got[9][2:] == ("com/de/", "block") and got[10][2] is None and got[11][2] == "org/"
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    # Lists over the bound are joined, with equal results; so are tables.
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, most=10).collect()} == got
    tables = spark.createDataFrame([*url_filter.RULES, ("org/", "allow")], "key string, verdict string"), spark.createDataFrame([(h,) for h in url_filter.BLOCKED], "host string")
    for most in (10, 1 << 20):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, *tables, most=most).collect()} == got
    assert {r.verdict for r in url_filter.judge_urls(pages, [], []).collect()} == {"allow"}
    tie = spark.createDataFrame([(1, "http://b.org/xy")], "page_id long, url string")
    assert {url_filter.judge_urls(tie, [("org/xy", "block"), ("b.org/", "allow")], [], most=m).first().rule for m in (0, 1 << 20)} == {"b.org/"}
    assert url_filter.parents("a.b.c.de", 4) == ["c.de", "de"] and url_filter.parents("a.b", 9) == ["a.b", "b"]


def test_url_filter_keeps_few_lists_mapped():
    packed = [url_filter.DigestArray(["a"]).packed()] * 2
    for k in range(20):
        url_filter._mapped(f"list {k}", packed)
    assert len(url_filter._arrays) <= url_filter.MAPPED


def test_digests_that_collide_are_told_apart():
    d = url_filter.DigestArray.mapped(url_filter.DigestArray(["a", "b"]).packed())
    assert d.find([b"a", b"c"]).tolist() == [True, False]
    assert d.find([b"zz"], np.array([d.keys[0]], np.uint64)).tolist() == [False]


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def reached(ids, sets, percent):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("cap", "size"), [(2048, 32 << 20), (3, 32 << 20), (2048, 1200)])
def test_minhash_matches_brute_force(spark, monkeypatch, cap, size):
    """Also where buckets are dealt out in many squares, by rows or by bytes."""
    monkeypatch.setattr(minhash, "CAP", cap)
    monkeypatch.setattr(minhash, "TEXTS", size)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(6)]
    texts = [None, "", " \n", "one", "ONE", "a b", "a\tb", "b a", "x" * 50_000]
    for _ in range(160):  # families of near copies, some linked only through others
        words = list(base[rng.integers(0, 6)])
        for _ in range(rng.integers(0, 8)):
            words[rng.integers(0, 60)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows + [(None, "one")], "doc_id long, text string")
    got = minhash.near_dedup(docs, k=2).collect()
    sets = {i: plain_set(t, 2) for i, t in rows}
    want = reached(list(sets), sets, 80)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_dedup(docs.where("false")).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 5, 400):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: max(1, int(n * 0.8))], rng.integers(0, 1 << 62, n // 5).astype(np.uint64)]))
        a, b = minhash.sketches([x, y])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((a == b).mean() - true) < 0.12
    assert len(common.word_hashes(b"A b\x0bC  ")) == 3 and (common.word_hashes(b"ab") == common.word_hashes(b"x AB")[1:]).all()


def test_line_dedup(spark, none):
    passage = "\n".join(f"a shared line of some words number {i}" for i in range(12))
    rows = [(0, None), (1, ""), (2, f"own intro {'q ' * 9}\n{passage}\nend"), (3, f"{passage}\nother end"), (4, "short\nshort"), (5, "short\nshort"), (6, "plain unique text\nof two lines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[2].n_removed == 0 and got[3].n_removed >= 6 and got[3].text.endswith("other end")
    assert got[0].text is None and all(got[i].text == t for i, t in rows if i in (1, 4, 5, 6))
    assert line_dedup.line_dedup(none).count() == 0


def plain_line_dedup(rows):
    """doc_id -> text without repeated runs, by comparing all runs' bytes."""

    def runs(lines):
        full = [i for i, x in enumerate(lines) if x.split()]
        n = lambda a, b: sum(len(lines[i].split()) for i in full[a : b + 1])
        out = {(i, i + 1) for i in full if len(lines[i].split()) >= 25}
        for a in range(len(full)):
            long = len(lines[full[a]].split()) >= 25
            ends = [b for b in range(a + 1, len(full)) if n(a, b) >= 8]
            if ends and not long:
                out.add((full[a], full[ends[0]] + 1))
            starts = [s for s in range(a) if n(s, a) >= 8]
            if starts and not long:
                out.add((full[starts[-1]], full[a] + 1))
        return sorted(out)

    first, gone, texts = {}, {}, {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        texts[doc], gone[doc], kept = lines, set(), set()
        for lo, hi in runs(lines):
            own = first.setdefault("\n".join(lines[lo:hi]), (doc, lo)) == (doc, lo)
            if not own:
                gone[doc] |= set(range(lo, hi))
    out = {}
    for doc, lines in texts.items():
        full = [i for i, x in enumerate(lines) if x.split()]
        for a, b in zip(full, full[1:]):
            if a in gone[doc] and b in gone[doc]:
                gone[doc] |= set(range(a, b))
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone[doc])
    return out


@pytest.mark.parametrize("digest", [line_dedup.line_hash, len])
def test_line_dedup_matches_plain_comparison(spark, digest):
    """Also where different lines have one hash (their length): bytes decide."""
    rng = np.random.default_rng(12)
    lines = [" ".join(rng.choice(["ab", "cd", "ef"], n)) for n in (1, 2, 3, 4, 5, 6, 9, 26, 30) for _ in range(3)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in range(80)]
    rows += [(100, "one two three four five\n" * 4), (101, "six two tiger four five\n" * 4), (102, "z " * 30_000), (103, "z " * 30_000)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=digest).collect()}
    assert got == plain_line_dedup(rows)


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    text = "one two three four\nfive six seven eight nine"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text + "\nend")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(0, ""), (5, ""), (5, text), (7, "end")]


def test_line_dedup_removes_short_passages_wholly(spark):
    rng, rows, want = np.random.default_rng(6), [], {}
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    for lines, words in [(3, 18), (4, 13), (5, 11), (6, 9), (8, 8), (12, 8), (20, 3), (3, 30)]:
        for trial in range(12):
            passage = [line(words) for _ in range(lines)]
            if trial % 3 == 0:
                passage = [passage[0], "", *passage[1:-1], " ", "", passage[-1], line(1)]
            for copy in range(2):
                around = [[line(rng.integers(2, 7)) for _ in range(rng.integers(1, 7))] for _ in range(2)]
                own = around[0] + around[1] if copy else around[0] + passage + around[1]
                want[len(rows)] = (len(passage) * copy, "\n".join(own))
                rows.append((len(rows), "\n".join(around[0] + passage + around[1])))
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_keeps_a_place_of_every_line(spark):
    rng = np.random.default_rng(7)
    lines = [f"line {i} of {'some words ' * (i % 4)}" for i in range(9)] + ["", " "]
    texts = ["\n".join(rng.choice(lines, 12)) for _ in range(60)] + ["\n" * 20_000 + "a b c d e f g h\n" * 3]
    got = [r.text for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    full = lambda rows: {x for t in rows for x in t.split("\n") if x.strip()}
    assert full(got) == full(texts) and sum(map(len, got)) < sum(map(len, texts))


def test_language_id(spark, none):
    words = {"aa": "lorem ipsum dolor", "bb": "quick brown foxes", "cc": "über schön grün"}
    rows = [(i, f"{words[k]} {i} " * 5, k) for i, k in enumerate(list(words) * 40)]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "schön über", None), (903, "", None), (904, "quick " * 60_000, None), (None, "brown foxes", None)]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert got[900].lang_pred == got[901].lang_pred == got[903].lang_pred == "und" and got[902].lang_pred == "cc" and got[904].lang_pred == "bb" and got[None].lang_pred == "bb"
    assert got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert langid.language_id(none).count() == 0
    for n in (2, 4, 6, 20):
        code = langid.codewords(n)
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= (n > 2) + 1


def test_toxicity(spark, none):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 60))
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.integers(0, 60)] = rng.choice(["slurish", "slurling", "vilest", "nastyone"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(9001, None), (9002, ""), (None, "word1 vilest slurish"), (9003, "word2 " * 80_000)]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    right = Counter(got[i].predicted == labels[i][1] for i in held)
    assert right[True] / len(held) > 0.95
    assert got[9001].predicted == got[9002].predicted == got[9003].predicted == 0
    empty = toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.count() == 0


def held_out_accuracy(spark, rows, labels, of):
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    told = dict(labels)
    right = [got[i].predicted == told[i] for i in of if got[i].held_out]
    return sum(right) / len(right)


def test_toxicity_tells_wording_of_ordinary_words(spark):
    """Toxic texts say "word3 word5", ordinary ones as often "word5 word3"."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice([f"word{k}" for k in range(40)], 30))
        words = [w for w, x in zip(words, [*words[1:], ""], strict=True) if {w, x} != {"word3", "word5"}]
        for _ in range(4):
            at = int(rng.integers(0, len(words)))
            words[at:at] = ["word3", "word5"] if i % 3 == 0 else ["word5", "word3"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    assert held_out_accuracy(spark, rows, labels, range(900)) > 0.9


def test_toxicity_counts_every_pair_by_itself(spark):
    """More words than 2^18, each counted exactly."""
    texts = [(" ".join(f"{k}x{j}" for j in range(10_000)) + f" {k}x0 {k}x1", k % 4) for k in range(30)]
    model, totals = toxicity.train(spark.createDataFrame(texts, "text string, kind int"), 5)
    want, words = Counter(), set()
    for text, kind in texts:
        w = toxicity.spelled(text)
        words |= set(w.tolist())
        for key in set(toxicity._pair(toxicity._before(w), w).tolist()):
            want[key, kind % 2] += 1
    got = {}
    for row in model.where("shard < 5").collect():
        n = toxicity._opened(row.parts[1], np.uint32, 4)
        got |= {(int(k), c): int(n[i, c]) for i, k in enumerate(toxicity._opened(row.parts[0], np.uint64)) for c in (0, 1) if n[i, c]}
    assert got == want and len(words) == 300_000 == totals[10]
    assert totals[:2].tolist() == [sum(n for (_, c), n in want.items() if c == k) for k in (0, 1)]


def test_toxicity_counts_the_calibration_fold(spark):
    rng = np.random.default_rng(9)
    rows, labels, probes = [], [], []
    for i in range(1200):
        fold = zlib.crc32(str(i).encode()) % 5
        words = list(rng.choice([f"word{k}" for k in range(200)], 40))
        if i % 4 == 0:
            # foldslur is said in the fold of remainder 1 alone, and in the held-out texts.
            said = "foldslur" if fold == 0 or fold == 1 and i % 8 == 0 else "vilest"
            words[::5] = [said] * 8
            probes.append(i)
        else:
            words[::5] = [f"{name}{i}" for name in "abcdefgh"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    assert held_out_accuracy(spark, rows, labels, probes) > 0.9


@pytest.mark.parametrize(("cap", "small"), [(4096, 1 << 18), (7, 1 << 18), (4096, 20), (7, 4)])
def test_embeddings_match_brute_force(spark, cap, small):
    """In one square, in many, and on grids of two and of three dimensions."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((5, 16))
    rows = [(i, (centres[i % 5] + rng.standard_normal(16) * 0.22).astype(np.float32).tolist(), i % 2) for i in range(120)]
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [1.0, None] * 8, 1), (205, [float("nan")] * 16, 1), (206, [float("inf")] * 16, 0), (207, rows[2][1], None), (208, rows[2][1][:4], 0), (209, [3.0 * x for x in rows[4][1]], 0), (210, [], 0)]
    good = [(i, np.array(v, float), k) for i, v, k in rows if i < 202 or i in (208, 209)]
    link = {i: set() for i, _, _ in rows}
    for a, x, k in good:
        for b, y, m in good:
            if a != b and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                link[a].add(b)
    sets = {i: i for i in link}
    for _ in range(200):
        new = {i: min([sets[i], *[sets[j] for j in link[i]]]) for i in link}
        if new == sets:
            break
        sets = new
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0)], "vec_id long, embedding array<float>, label int")
    got = vectors.embedding_dedup(df, cap=cap, small=small).collect()
    assert len(got) == len(rows) + 1 and sum(map(len, link.values())) > 50
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (len(link[r.vec_id]), sets[r.vec_id], sets[r.vec_id] == r.vec_id)
    assert vectors.embedding_dedup(df.where("false")).count() == 0


def test_toxicity_in_waves_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    rows = [(d, " ".join(f"w{d * 7919 * (k + 3) % 211 % (30 + d % 5)}" for k in range(d % 40))) for d in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, int(d % 5 == 4 or d % 11 == 0)) for d in range(0, 600, 2)], "doc_id long, toxic int").localCheckpoint()
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    made = []
    monkeypatch.setattr(toxicity, "written", lambda df, tag: (made.append((tag, files.getAllFiles().size())), common.written(df, tag))[1])
    one = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()))
    assert [tag for tag, _ in made] == ["pairs", "words", "features"]
    monkeypatch.setattr(toxicity, "WAVE", 100)
    monkeypatch.setattr(toxicity, "RUN_BITS", 4)
    made.clear()
    got = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()))
    assert [tag for tag, _ in made] == ["pairs", "words"] + 6 * ["features"]
    assert [r[0] for r in got] == list(range(600)) and [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in one]
    assert np.allclose([r[2] for r in got], [r[2] for r in one], rtol=0, atol=1e-12)
    # Each wave finds no more files than the first table did.
    assert max(n for _, n in made) <= made[0][1]


def test_toxicity_hashes_texts_together(monkeypatch):
    """Short texts share a call, and each has the words it has alone."""
    texts = ["Ein Wort, zwei", None, "", "...", "É x9" * 3, "a\n\tb\x0bC", "long " * 30_000, "tail", "y" * 1_200_000 + " z"] + [f"text {k % 7}." for k in range(500)]
    alone = [[int(common.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())] for t in texts]
    calls = []
    monkeypatch.setattr(toxicity, "span_hashes", lambda *a: (calls.append(1), common.span_hashes(*a))[1])
    assert [h.tolist() for h in toxicity.spelled_each([None if t is None else t.encode() for t in texts])] == alone
    assert len(calls) < 10


def test_toxicity_orders_keys_that_share_leading_bits():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 5, 300), rng.integers(0, 1 << 62, 300), np.repeat(rng.integers(0, 1 << 62, 40), 9) + rng.integers(0, 2, 360), np.zeros(0), np.array([7])):
        x = x.astype(np.uint64)
        keys, at, inverse = np.unique(x, return_index=True, return_inverse=True)
        got = toxicity._distinct(x)
        assert np.array_equal(got[0], at) and np.array_equal(got[1], inverse) and np.array_equal(x[got[0]], keys)


def test_toxicity_scores_by_the_second_model_only_calibration_rows(monkeypatch):
    rows = [(i, i, f"w{i % 3} w{i % 5} w{i}", False, kind) for i, kind in enumerate([None, 0, 1, 2, 3, None])]
    batch = toxicity.pa.RecordBatch.from_pylist([dict(zip(("rid", "doc_id", "text", "held_out", "kind"), r, strict=True)) for r in rows])
    texts = next(toxicity._asked(3, False)([batch]))
    monkeypatch.setattr(toxicity, "FILL", 3.0)
    asked = next(toxicity._asked(3, True)([batch]))
    known = [(b, s, [np.ones((len(toxicity._opened(p[0], np.uint64)), 4 if s < 3 else toxicity.WIDTH), np.uint32)]) for b, s, p in zip(*[asked.column(k).to_pylist() for k in range(3)], strict=True)]
    sizes = {}
    plain = toxicity.ratios
    monkeypatch.setattr(toxicity, "ratios", lambda n, *a: (sizes.update({a[-1]: len(n)}), plain(n, *a))[1])
    got = toxicity._features(3, np.arange(9.0, 21.0))(toxicity.pa.Table.from_batches([texts, toxicity._rows(known)])).to_pylist()
    assert sizes == {0: 12, 1: 6}  # distinct pairs
    assert [bool(r["x2"]) for r in got] == [r["kind"] >= 2 for r in got] and all(r["x0"] for r in got)


def test_toxicity_hands_over_small_rows():
    """A shard's table of 100,000 pairs comes in rows of bounded size, which answer as one table, in whatever order they come."""
    words = common.mix(np.arange(1, 100_001, dtype=np.uint64))
    first = common.mix(words)
    counts = np.tile(np.array([1, 2, 0, 0], np.uint32), (len(words), 1))
    made = toxicity._merged(1)(toxicity.pa.Table.from_batches([toxicity._rows([(0, 0, [first, words, counts])])]))
    parts = [p for s, p in zip(made.column("shard").to_pylist(), made.column("parts").to_pylist(), strict=True) if s == 0]
    keys = [toxicity._opened(p[0], np.uint64) for p in parts]
    assert max(map(len, keys)) <= 1 << 15
    want = np.sort(toxicity._pair(first, words))
    assert np.array_equal(np.concatenate(keys), want)
    known = toxicity._rows([(0, 0, [k, toxicity._opened(p[1], np.uint32, 4)]) for k, p in zip(keys[::-1], parts[::-1], strict=True)])
    asked = toxicity._rows([(5, 0, [want[::3]]), (6, 0, [np.array([12345], np.uint64)])])
    got = toxicity._answered(1)(*(toxicity.pa.Table.from_batches([x]) for x in (asked, known)))
    hit, missed = (toxicity._opened(p[0], np.uint32, 4) for p in got.column("parts").to_pylist())
    assert got.column("block").to_pylist() == [5, 6] and (hit == [1, 2, 1, 2]).all() and len(hit) == len(want[::3]) and not missed.any()


def test_toxicity_holds_few_long_texts_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(d, f"w{d % 7} w{d % 11} " * 3, int(d % 3 == 0)) for d in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, k) for d, _, k in rows], "doc_id long, toxic int")
    name, held = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(name)
    monkeypatch.setattr(toxicity, "written", lambda df, tag: (held.update({tag: int(spark.conf.get(name).rstrip("b"))}), common.written(df, tag))[1])
    assert toxicity.toxicity(docs, labels).count() == 60
    assert set(held) == {"pairs", "words", "features"} and max(held.values()) <= 1 << 22 and spark.conf.get(name) == before
    # What that setting does: 24 MB of texts in one file reach Python in batches of some MB, each row once.
    spark.range(1200, numPartitions=1).selectExpr("id", "repeat(cast(id % 10 as string), 20000) text").write.parquet(f"{tmp_path}/long")

    def sizes(batches):
        for b in batches:
            yield toxicity.pa.record_batch({"n": [b.num_rows], "size": [b.nbytes]})

    with common.slim(spark):
        got = spark.read.parquet(f"{tmp_path}/long").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 1200 and max(r.size for r in got) < 6 << 20


def test_packing_merges_each_match_once(monkeypatch):
    """Words that share a match merge it once; ids are the library's, also while words are let go."""
    from types import SimpleNamespace

    tokens = packing.Tokens(P.path("byte_bpe_50k.json"), P.PATTERN)
    own, merged = tokens.model, []
    tokens.model = SimpleNamespace(tokenize=lambda m: (merged.append(m), own.tokenize(m))[1])
    text = "so thndouer thndouer, thndouer. thndouer.\nThndouer &&& thndouer&&&"
    assert tokens.ids(text).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(merged) == len(set(merged)) and merged.count("Ġthndouer") == 1
    monkeypatch.setattr(packing, "KEPT", 12)
    rng = np.random.default_rng(6)
    letters = list("    \n\t\x1c 　aabeé'sΩ中1²_-.,") + ["it's ", "word ", "word, ", "\n\n"]
    for text in ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(1500)] + [" a", "a ", "a  b", "a\n b", "\n", "x y\n", "<|endoftext|> a"]:
        assert tokens.ids(text).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
