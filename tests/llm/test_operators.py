"""The ten operators against brute force on a small table."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxcohort.llm import decontaminate, language_id, license_scan, lm_score, ngram_join, packing, quality_rules, sketch, substring_dedup, suffix_dedup, token_file, tokens
from voxcohort.llm.common import arrow_map, held_out
from voxcohort.llm.tokens import default_vocabulary
from voxcohort.llm.words import slices
from voxcohort.session import scratch_path

from . import brute


def table(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *cols).collect()}


@pytest.mark.parametrize("rows", [4096, 2])
def test_ngram_join(docs, small, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", rows)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    want = brute.near_components(small)
    assert table(ngram_join.join(docs), "n_shingles", "component_id") == want
    assert len({c for _, c in want.values()}) < len(want)


def test_signature_trees_lose_no_pair():
    r = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = r.integers(0, 2**63, r.integers(1, 60)).astype(np.uint64)
        for _ in range(3):
            keep = base[r.random(len(base)) < 0.93]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, r.integers(0, 3)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    rows = [(i, len(s), ngram_join.bitmap(s), i) for i, s in enumerate(sets)]
    got = set(ngram_join.block_pairs(rows, 80))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.linked(sets[i], sets[j], 80)}
    assert want and want <= got and len(got) < len(sets) ** 2 / 8


def across_widths():
    """Sets of near-equal sizes on both sides of 64, 256 and 1024, where the width of the bitmap doubles: a base, one less, and a few exchanged."""
    r = np.random.default_rng(7)
    sets = []
    for edge in (64, 256, 1024):
        for _ in range(6):
            base = np.unique(r.integers(0, 2**63, edge + edge // 16 + 2).astype(np.uint64))
            for n in (edge - edge // 16 - 1, edge - 1, edge, edge + edge // 16):
                sets.append(np.sort(r.permutation(base)[:n]))
    return sets


def test_signature_trees_across_widths():
    sets = across_widths()
    want = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.linked(sets[i], sets[j], 80)}
    assert any(len(ngram_join.bitmap(sets[i])) != len(ngram_join.bitmap(sets[j])) for i, j in want)
    rows = [(i, len(s), ngram_join.bitmap(s), i) for i, s in enumerate(sets)]
    assert want <= set(ngram_join.block_pairs(rows, 80))
    for i, j in want:
        (a, wa), (b, wb) = ngram_join.summary(sets[i]), ngram_join.summary(sets[j])
        assert ngram_join.possible(*ngram_join.aligned(a, wa, b, wb), 80)


def test_stars_across_widths(spark):
    sets = across_widths()
    rows = [(i, i // 4 + 1, h.tobytes()) for i, h in enumerate(sets)]
    got = ngram_join._stars(spark.createDataFrame(rows, "doc_id long, k1 long, set binary"), "k1", 80)
    pairs = {(r["b"], r["a"]) for r in got.collect()}
    # a document is linked to every leader it matches, and the first of each key leads
    assert {(i - i % 4, i) for i in range(len(sets)) if i % 4 and ngram_join.linked(sets[i - i % 4], sets[i], 80)} <= pairs


@pytest.mark.parametrize("edge", [64, 256, 1024])
def test_ngram_join_across_widths(spark, edge):
    r = np.random.default_rng(edge)
    d = []
    for g in range(4):  # n words have n - 4 shingles
        w = [f"w{x}" for x in r.integers(0, 10**9, edge + 6)]
        d += [(10 * g, " ".join(w[: edge + 3])), (10 * g + 1, " ".join(w[: edge + 4])), (10 * g + 2, " ".join(w[2:]))]
    assert table(ngram_join.join(spark.createDataFrame(d, "doc_id long, text string")), "n_shingles", "component_id") == brute.near_components(d)


def test_ngram_join_repeated_ids(spark):
    """Rows with one id are one document with all their links, whether its sets equal others, resemble them, or it stands for them itself."""
    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**9, n))
    near = lambda t: t + " more words"
    a, b, c, e, f, g = (text(n) for n in (40, 50, 60, 300, 45, 90))
    d = [(1, a), (5, a), (2, b), (5, b)]  # equal sets
    d += [(13, c), (13, e), (11, near(c)), (12, near(e))]  # near ones, of very different sizes
    d += [(20, f), (20, g), (21, near(f)), (22, near(g)), (22, a)]  # the least id itself has two sets
    got = {(x["doc_id"], x["component_id"]) for x in ngram_join.join(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert got == {(i, 1) for i in (1, 2, 5, 20, 21, 22)} | {(i, 11) for i in (11, 12, 13)}


def test_language_id(spark, docs):
    en = [(i, "the quick brown fox and the other thing with that " * 3, "en") for i in range(0, 40)]
    de = [(i, "der schnelle braune fuchs und die andere sache mit dem " * 3, "de") for i in range(40, 80)]
    fr = [(i, "le renard brun et rapide avec les autres choses dans la " * 3, "fr") for i in range(80, 120)]
    odd = [(200, None, "en"), (201, "123 | 4", "fr"), (202, "", None), (203, "ы", None)]
    d = spark.createDataFrame(en + de + fr + odd, "doc_id long, text string, lang string")
    out = table(language_id.learn_and_predict(d, ~held_out("doc_id", 5)), "lang_pred", "score")
    assert all(out[i][0] == v and 0.5 < out[i][1] <= 1 for i, _, v in en + de + fr)
    assert out[200] == out[201] == out[202] == ("und", 0.0) and out[203][0] != "und"
    # labels are no input of a prediction
    model = language_id.fit(d)
    again = table(language_id.predict(d.withColumn("lang", F.lit("xx")), model), "lang_pred", "score")
    assert again == table(language_id.predict(d, model), "lang_pred", "score")


@pytest.mark.parametrize("flush", [2_000_000, 500])
def test_substring_dedup(docs, small, flush, monkeypatch):
    monkeypatch.setattr(sketch, "FLUSH", flush)
    assert table(substring_dedup.remove(docs), "n_words", "n_removed", "kept_sha256") == brute.window_dedup(small)


def test_windows_are_held_and_sent_in_bounded_memory(spark, monkeypatch):
    """What a task of op3 and of its sketch holds per window at a flush, and how many rows it sends at once."""
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[r.integers(0, 5000, 600)]) for _ in range(250)] * 2
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []
    for module in (sketch, substring_dedup):
        monkeypatch.setattr(module, "arrow_map", lambda df, fn, schema, old=module.arrow_map: (made.append(fn), old(df, fn, schema))[1])
    substring_dedup.marks(d)
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "sig": pa.array(range(len(texts)), pa.int64())})
    windows = sum(len(t.split()) - 12 for t in texts)
    for fn, most in ((made[0], 30), (made[2], 80)):
        list(fn(iter([b.slice(0, 1)])))  # tables of powers are made once
        tracemalloc.start()
        got = [x.num_rows for x in fn(iter([b]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * windows + 60_000_000 and max(got) <= 100_000, (peak, windows)


def test_sketch_holds_only_cells(spark, monkeypatch):
    """A task of a sketch holds PART cells a row at most, whatever it is fed at once, and loses none at the edge of a part."""
    made = []
    monkeypatch.setattr(sketch, "arrow_map", lambda df, fn, schema, old=sketch.arrow_map: (made.append(fn), old(df, fn, schema))[1])
    r = np.random.default_rng(5)
    h = r.integers(0, 1 << 63, 3_999_999).astype(np.uint64)
    few = spark.range(2).selectExpr("cast(id as int) n")
    parts = []
    monkeypatch.setattr(sketch, "PART", 1_000_000)
    sketch.merged(few, lambda b: iter(parts), 24)
    parts += np.split(h, range(300_000, len(h), 300_000))
    one = pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int32())})
    sent = [b.to_pylist() for b in made[0](iter([one]))]
    got = [(x["line"], x["shard"], x["cells"]) for b in sent for x in b]
    for line in (0, 1):
        found = np.concatenate([sketch.expand(c) + (k << 16) for l, k, c in got if l == line])
        assert np.array_equal(np.sort(found), np.sort(sketch.cells(h, line, 24)))
    assert max(sum(len(sketch.expand(x["cells"])) for x in b) for b in sent) <= 1_000_000


def test_encoder_remembers_bounded_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 60_000, raising=False)
    texts = [" ".join(f"word{i} {'x' * (i % 90)}{i}" for i in range(j, j + 300)) for j in range(0, 3000, 150)]
    enc, want = tokens.WordIds(tokens.default_vocabulary(), 2_000_000), tokens.WordIds(tokens.default_vocabulary(), 1)
    for t in texts:
        s = next(slices(pa.array([t])))
        assert np.array_equal(enc.encode(s)[0], want.encode(s)[0])
        assert 20 * len(enc.hash) + 4 * enc.used <= 60_000 + 30_000  # and one slice


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tok):
        self.tok, self.chars = tok, 0

    def encode_batch_fast(self, texts, **how):
        self.chars += sum(map(len, texts))
        return self.tok.encode_batch_fast(texts, **how)


def test_encoder_keeps_frequent_words_when_it_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 60_000)
    enc = tokens.WordIds(tokens.default_vocabulary(), 2_000_000)
    enc.tok = Counting(enc.tok)
    often, letters = [f"often{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)], "abcdefghij"
    rare = rare_seen = 0
    for j in range(60):
        once = ["rare" + "".join(letters[int(d)] for d in f"{j * 500 + i:06d}") for i in range(500)]
        before = enc.tok.chars
        enc.encode(next(slices(pa.array([" ".join(once + often)]))))
        if j >= 10:
            rare, rare_seen = rare + sum(len(w) + 1 for w in once), rare_seen + enc.tok.chars - before
    assert rare <= rare_seen <= rare * 1.02


def test_encoder_learns_a_word_once_for_all_its_forms():
    enc = tokens.WordIds(tokens.default_vocabulary(), 2_000_000)
    enc.tok = Counting(enc.tok)
    enc.encode(next(slices(pa.array(["wordling Wordling, WORDLING. wordling!? 'wordling' wordling### wordling;"]))))
    assert enc.tok.chars <= len("wordling 'wordling ,.!?'###;") + 5


def test_word_ids_are_those_of_whole_texts(monkeypatch):
    """Letters that lose or gain a mark when lower-cased or normalised, punctuation that could join it, added tokens, odd spaces."""
    texts = ["\u0130. x\u0130, \u0130", "H\u0331a h\u0331a J\u030c j\u030c", "\u0958. \ufb1d!", "a\u0301. A\u0301?!", "<|ENDOFTEXT|> <|endoftext|> a<|endoftext|>b. <|endoftext|>.",
             "Don't. DON'T's, it's'", "a\xa0b \u3000 \x85,", "\x00a b\x00. \x1ca", "\u039f\u03a3. \u03c2!", "\uff11\uff12 \u2460x.", "x###. y.### \xdf&&& ***", "", None, "!" * 3000 + " a" + ".," * 3000]
    r = random.Random(7)
    letters = "aZ\u0130\xdf\u1e9e\u03a3\u0416\u0439\u0958\u01c5\uac00\u4f60\u0663\u0301\u0331\u0307.,!?'$<|> \t\u2003"
    texts += ["".join(r.choices(letters, k=r.randint(1, 40))) for _ in range(600)]
    for held in (tokens.HELD, 3000):
        monkeypatch.setattr(tokens, "HELD", held)
        enc = tokens.WordIds(tokens.default_vocabulary(), 2_000_000)
        for s in slices(pa.array(texts), 1500):
            ids, first = enc.encode(s)
            for k in range(s.n):
                want = enc.tok.encode(texts[s.row + k] or "", add_special_tokens=False).ids
                assert ids[first[k] : first[k + 1]].tolist() == [*want, tokens.END_ID], ascii(texts[s.row + k])


def test_a_task_gives_its_memory_back():
    """What allocators keep of a task's buffers returns to the system when it ends."""

    class Frame:
        def mapInArrow(self, fn, schema):  # noqa: N802
            return fn

    def fn(it):
        held = [pa.array(["x" * 1000] * 1000) for _ in range(300)]
        yield from it
        assert held

    def rss():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024

    before = rss()
    list(arrow_map(Frame(), fn, "n int")(iter([])))
    assert rss() - before < 60, rss() - before


def test_language_id_learns_every_label(spark):
    r = np.random.default_rng(1)
    d = []
    for k in range(70):  # the last ones are the rarest
        stems = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(6)]
        d += [(len(d) + i, " ".join(r.choice(stems, 40)), f"l{k:02d}") for i in range(4 if k < 64 else 3)]
    t = spark.createDataFrame(d, "doc_id long, text string, lang string")
    for model in (language_id.fit(t), language_id.fit(t, sample_rows=100)):
        assert len(model.languages) == 70
        out = table(language_id.predict(t, model), "lang", "lang_pred")
        assert sum(a == b for a, b in out.values()) >= 0.98 * len(d)
    assert all(out[i][1] == v for i, _, v in d if v >= "l64")


def test_sketch_never_misses(spark):
    h = [int(x) for x in np.random.default_rng(0).integers(0, 2**40, 3000)]
    d = spark.createDataFrame([(x,) for x in h + h[:500]], "h long").repartition(5)
    for bits in (12, 16):
        s = sketch.merged(d, lambda b: iter([b.column("h").to_numpy().view(np.uint64)]), bits)
        assert s(np.array(h[:500], np.uint64)).all()
    assert s(np.array(h, np.uint64)).mean() < 0.4


@pytest.mark.parametrize("bucket_rows", [20_000, 1])
def test_suffix_dedup(docs, small, bucket_rows):
    got = suffix_dedup.remove(docs, bucket_rows=bucket_rows)
    assert table(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_dedup(small)


def test_suffix_dedup_other_sizes(docs, small):
    got = suffix_dedup.remove(docs, size=37, gram=11)
    assert table(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_dedup(small, 37)


def test_lm_score(docs, small):
    got = table(lm_score.score(docs, held_out("doc_id", 10)), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, want in brute.bigram_scores(small, lm_score.D, lm_score.K).items():
        assert got[i][:3] == want[:3]
        assert got[i][3] == pytest.approx(want[3], abs=1e-6)
        assert abs(got[i][4] - want[4]) <= 0.06 * want[0]  # probabilities have eight bits


def test_elias_fano(tmp_path):
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (100, 50), (5000, 2**40), (3000, 2**63)):
        v = np.sort(r.integers(0, top, n).astype(np.uint64))
        with open(tmp_path / f"{n}", "w+b") as f:
            e = lm_score.EliasFano(v, f).open()
            assert (e.get(np.arange(n)) == v).all()
            x = np.concatenate([v, r.integers(0, top, 300).astype(np.uint64)])
            assert (e.successor(x, np.full(len(x), n)) == np.searchsorted(v, x)).all()


def test_quality_rules(spark, docs, small):
    trusted = spark.createDataFrame([(i,) for i, _ in small if i % 3 == 0], "doc_id long")
    ratio = quality_rules.log_ratio(docs, trusted)
    got = table(quality_rules.score(docs, ratio, 0.0), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    xxhash = pytest.importorskip("xxhash")
    u64 = lambda x: x.to_bytes(8, "little")
    signed = lambda x: x - 2**64 if x >> 63 else x

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w, seed=42) for w in brute.words(text)]
        p = [xxhash.xxh64_intdigest(u64(b), seed=xxhash.xxh64_intdigest(u64(a), seed=42)) for a, b in zip(h, h[1:])]
        return [signed(x) % quality_rules.BUCKETS for x in h + p]

    raw, good = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for i, t in small:
        for b in buckets(t):
            raw[b] += 1
            good[b] += i % 3 == 0
    assert np.allclose(ratio, np.log(good / good.sum()) - np.log(raw / raw.sum()))
    for i, t in small:
        want = brute.quality_base(t)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        b = buckets(t)
        s = float(ratio[b].mean()) if b else 0.0
        assert got[i][:6] == (*want, failed) and got[i][6] == pytest.approx(s, abs=1e-9)
        assert got[i][7] == (not failed and got[i][6] >= 0)


def tokenised(small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_vocabulary())
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in small}


def test_token_file(spark, docs, small):
    path = scratch_path(spark, "t")
    token_file.write_tokens(docs, path, default_vocabulary())
    got = table(token_file.read_tokens(spark, path, with_ids=True), "start", "n_tokens", "ids_crc32", "ids")
    start = 0
    for i, ids in sorted(tokenised(small).items()):
        assert got[i] == (start, len(ids), brute.crc(ids), ids)
        start += len(ids)


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for top in (1, 2, 300, 49408, 2**32 - 1):
            v = r.integers(0, top, n, dtype=np.uint32)
            raw = token_file.pack(v)
            assert (token_file.unpack(raw)[0] == v).all() and token_file.unpack(raw)[1] == len(raw)
    v = np.where(r.random(5000) < 0.03, r.integers(0, 2**32 - 1, 5000), r.integers(0, 50, 5000)).astype(np.uint32)
    raw = token_file.pack(v)
    assert (token_file.unpack(raw)[0] == v).all() and len(raw) < 6000
    assert (token_file.unpack(raw, (3, 5))[0] == v[768:1280]).all()


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing(docs, small, capacity):
    ids = tokenised(small)
    rows = packing.pack(docs, capacity=capacity).collect()
    at = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + capacity]
        assert r["start"] == r["piece"] * capacity and len(part) == r["length"] and brute.crc(part) == r["ids_crc32"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for s in at.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(at) <= 1.25 * sum(map(len, ids.values())) / capacity + 1


def test_packed_ids_of_marked_letters_are_those_of_whole_texts(spark):
    texts = [(1, "\u0130. x\u0130, \u0130!"), (2, "Wort, WORT. H\u0331a### h\u0331a"), (3, None)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = tokenised(texts)
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows} == {i: (len(x), brute.crc(x)) for i, x in want.items()}


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(1)
    n, c = np.unique(np.clip(r.lognormal(6.5, 1, 50_000).astype(int) + 1, 1, 4096), return_counts=True)
    runs = packing.plan(dict(zip(n.tolist(), c.tolist(), strict=True)))
    assert sum(x.n for x in runs) <= 1.003 * (n * c).sum() / 4096
    assert sum(x.n * len(x.slots) for x in runs) == c.sum()


def test_nnls():
    r = np.random.default_rng(3)
    a, x = r.random((20, 8)), np.array([1.0, 0, 2, 0, 0, 3, 0, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = r.normal(size=20)
    y = packing.nnls(a, b)
    g = a.T @ (b - a @ y)
    assert (y >= 0).all() and (g[y == 0] <= 1e-6).all() and np.allclose(g[y > 0], 0, atol=1e-6)


def test_decontamination(spark, docs, small):
    by = dict(small)
    long_ = [i for i, t in small if t and len(t.split()) > 80 and i > 90]
    items = [(1, " ".join(by[long_[0]].split()[10:40]) + ". " + " ".join(by[long_[0]].split()[40:50]) + "."), (2, "nothing of this is anywhere. no such answer at all."), (3, None), (4, ""), (5, " ".join(by[long_[1]].split()[3:30]))]
    q = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t in small for k, x in items if x and k != 2 and " ".join(x.replace(".", "").split()) in " ".join((t or "").split())}
    for size in (decontaminate.INDEX_BYTES, 100):
        got = decontaminate.find(docs, q, index_bytes=size)
        assert want <= {(r["doc_id"], r["item_id"]) for r in got.collect()} and got.where("item_id in (2, 3, 4)").count() == 0
    left = {r["doc_id"] for r in decontaminate.remove(docs, q).collect()}
    assert left == {i for i, _ in small} - {r["doc_id"] for r in got.collect()}


def test_decontamination_of_short_answers(spark):
    """A copy whose short last sentence is cut off or edited is a leak all the same, and so is one with any one word changed."""
    q = "which river of the northern plain was first crossed by the long bridge that the old miller had drawn"
    answers = {1: "Er.", 2: "the river Er.", 3: "It is the river Er of the plain.", 4: "It was the small river Er that nobody in the town had ever seen before."}
    items = [(i, f"{q.replace('miller', f'miller{i}')}? {a}") for i, a in answers.items()]
    docs, want = [], set()
    for i, t in items:
        w = t.split()
        copies = [" ".join(w[:k] + ["changed"] + w[k + 1 :]) for k in range(len(w))] + [t]
        if i < 4:  # the tail cut off, in part and whole
            copies += [" ".join(w[:-k]) for k in range(1, len(answers[i].split()) + 1)]
        for c in copies:
            docs.append((len(docs), f"before that came other words {c} and after it some more"))
            want.add((docs[-1][0], i))
    docs.append((9999, "before that which river of the town was seen and it was the small river Er after all"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(d, b).collect()}
    assert want <= got and not any(i == 9999 for i, _ in got)
    assert [r["doc_id"] for r in decontaminate.remove(d, b).collect()] == [9999]


def test_decontamination_does_not_depend_on_blocks(spark):
    """Scores, shares and passages are the same whether the items are one block or many."""
    r = np.random.default_rng(11)
    v = [f"w{i}" for i in range(150)]
    p = np.arange(150, 0, -1) / 11325
    items = [(i, " ".join(r.choice(v, r.integers(8, 60), p=p)) + ". " + " ".join(r.choice(v, r.integers(1, 20), p=p))) for i in range(40)] + [(50, None), (51, "..."), (None, "w1 w2")]
    # copies, whole and in part, so that shares lie on both sides of the limits
    docs = [(100 * i + k, " ".join([*r.choice(v, 30), *t.split()[: 5 * k + 5], *r.choice(v, 40)])) for i, t in items[:40] for k in range(12)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(x["doc_id"], x["item_id"]): tuple(x)[2:] for x in decontaminate.find(d, b, index_bytes=size).collect()} for size in (decontaminate.INDEX_BYTES, 1200))
    assert one and one.keys() == many.keys()
    for key, x in one.items():
        assert x == pytest.approx(many[key], abs=1e-9)


def test_block_max_wand():
    r = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    ix = decontaminate.build(list(range(200)), [" ".join(r.choice(vocabulary, r.integers(5, 40), p=np.arange(300, 0, -1) / 45150)) for _ in range(200)])
    for _ in range(200):
        lists = [ix.lists[i] for i in r.choice(len(ix.lists), r.integers(1, 60), replace=False)]
        limit, total = r.choice([0.05, 0.1, 0.2, 0.4]), {}
        for p in lists:
            for i, v in zip(p.items, p.impact, strict=True):
                total[i] = total.get(i, 0) + v
        assert {i for i, _ in decontaminate.block_max_wand(lists, limit)} == {i for i, v in total.items() if v >= limit - 1e-9}


def test_license_scan(spark, docs, small):
    whole = "Hello. " + license_scan.TEMPLATES[4][1].replace("license version", "License, version") + " and so on"
    cut = " ".join(license_scan.TEMPLATES[1][1].split()[:12])
    loose = license_scan.TEMPLATES[3][1].split()
    loose = " ".join(loose[:9] + ["kindly"] + loose[9:])
    extra = [(900, whole), (901, cut), (902, loose), (903, "cc-by-nc cc by nc"), (904, "Apache License, Version 2.0, Apache license version 2")]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = table(license_scan.scan(d), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, t in [*small, *extra]:
        assert got[i][:5] == brute.phrase_places(t, license_scan.PHRASES)
    assert got[900][5] == "gpl-3" and got[901][5] == "" and got[902][5] == "bsd" and got[901][6] < 0.7
    assert {i for i, v in got.items() if v[5] == "mit"} == {i for i, v in got.items() if v[4] == "mit"}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_held_out(docs):
    got = table(docs.select("doc_id", held_out("doc_id", 5).alias("x")), "x")
    assert all(v == (zlib.crc32(str(i).encode()) % 5 == 0,) for i, v in got.items())
