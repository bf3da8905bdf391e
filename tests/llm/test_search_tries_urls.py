"""URL filter, prefix trie and ranked search against brute force, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxcohort.llm import lexical_search, prefix_trie, url_filter
from voxcohort.llm.lexical_search import Best, Block, Query, bounds, contribution

from .test_edges import CLASH

# ---- ranked search


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def ranked(docs, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every document; docs and items may repeat ids."""
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scores = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(x * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in w.items())
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(small):
    return [(1, small[3][1][:80]), (2, small[12][1]), (3, "under the MIT license"), (4, None), (5, " .,"), (6, "nowhere-at-all"), (7, "ab"), (8, "TARI tari")]


@pytest.mark.parametrize(("entries", "docs_a_block"), [(20_000, 256), (30, 8), (1, 1)])
def test_search(spark, docs, small, items, entries, docs_a_block, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", docs_a_block)
    found = lexical_search.search(lexical_search.build(docs), spark.createDataFrame(items, "item_id long, text string"), entries=entries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked(small, items)
    assert len(want) > 30 and sorted(map(tuple, found.collect()), key=str) == want


def test_search_odd_rows(spark, small):
    """Repeated and null ids are documents and items of their own, ties go by id, and column names may clash."""
    rows = small[:30] + small[:4] + [(None, small[3][1]), (None, None)] + [(i, "one two tie") for i in (9, 3, 5)]
    asked = [(1, "tie"), (1, "tie"), (None, small[3][1]), (2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in (*CLASH, "item_id", "rank", "_item")}).repartition(5)
    q = spark.createDataFrame(asked, "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(2)})
    got = sorted(map(tuple, lexical_search.search(lexical_search.build(d), q).collect()), key=str)
    assert got == ranked(rows, asked)
    assert [r[2] for r in got if r[:2] == (1, 1)] == [3, 3]
    assert lexical_search.search(lexical_search.build(d.limit(0)), q).collect() == []
    assert lexical_search.search(lexical_search.build(d), q.limit(0)).collect() == []


def test_search_takes_long_texts_whole(spark):
    rows = [(1, "filler " * 400_000 + "needle"), (2, "needle"), (3, "haystack")]
    asked = [(1, "needle filler")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, lexical_search.search(lexical_search.build(d), spark.createDataFrame(asked, "item_id long, text string")).collect())) == ranked(rows, asked)


def test_bounds_hold_and_exclude(spark, docs, items):
    """No bound is below a score, and most documents of an item that is in few of them are excluded."""
    rows = lexical_search.build(docs).collect()
    (q,) = lexical_search.item_blocks(spark.createDataFrame(items, "item_id long, text string"))
    weight = lexical_search.np.arange(1, len(q.terms) + 1)
    rescored = 0
    best = [Best(1) for _ in q.ids]
    for r in rows:
        b = Block(r.asDict())
        m = 10 + b.n
        upper = bounds(b, q, weight, m)
        most = b.most(q.terms)
        for k in range(len(b.ids)):
            t, c = map(list, b.document(k))
            tf = lexical_search.np.array([c[t.index(x)] if x in t else 0 for x in q.terms])
            assert (most[:, k] >= tf).all()
            exact = weight * contribution(tf, m[k])
            for i in range(len(q.ids)):
                assert upper[i, k] >= exact[q.first[i] : q.first[i + 1]].sum()
        rescored += lexical_search.search_block(b, q, weight, 80, 8000, best)
    assert 0 < rescored < len(q.ids) * docs.count() / 4


def test_a_query_of_many_steps(monkeypatch, docs, spark, items):
    """Bounds do not depend on how the terms are cut into steps."""
    (q,) = lexical_search.item_blocks(spark.createDataFrame(items, "item_id long, text string"))
    b = Block(lexical_search.build(docs).first().asDict())
    weight, m = lexical_search.np.arange(1, len(q.terms) + 1), 10 + b.n
    want = bounds(b, q, weight, m)
    for step in (1, 7, 50):
        monkeypatch.setattr(lexical_search, "STEP", step)
        assert (bounds(b, q, weight, m) == want).all()
    assert isinstance(q, Query)


# ---- prefix trie


def conversation_nodes(rows):
    """All nodes by listing every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], x[2:]))] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    member, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            member[s[:d]].append(c)
    for k in member:
        if k:
            kids[k[:-1]] += 1
    for k, v in member.items():
        own_words = (len(v) - 1) * len(k[-1][1].encode().split()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_words
            leaves[k[:d]] += kids[k] == 0
    ends = lambda k, v: hashlib.sha256(",".join(str(c) for c in sorted(v) if len(seqs[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(v), len(k), min(member[k[:-1]]) if k else None, len(v), kids[k], leaves[k], saved[k], ends(k, v)) for k, v in member.items()), key=str)


@pytest.fixture(scope="module")
def talk():
    """Copies, shared first turns, one turn only, null turns, roles and texts, negative and lone ids, a long one."""
    r = random.Random(3)
    lines = ["hello there you", "yes", "", "no no", "tell\tme more  please", None, "ends\nhere"]
    turn = lambda k: (k if r.random() < 0.97 else None, r.choice(["user", "assistant", None]), r.choice(lines))
    rows = []
    for c in [*range(0, 64), 100, 117, 205, -3, -20, -21, 10**12 + 7]:
        rows += [(c, *turn(k)) for k in range(r.randint(1, 6))]
    for c in range(300, 340):
        rows += [(c, k, "user", f"copy {k}") for k in range(3)]
    rows += [(400, k, "user", "a b c") for k in range(300)] + [(401, k, "user", "a b c") for k in range(310)]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limit", "chunk"), [(4096, 1 << 20), (40, 40), (5, 20), (1, 1 << 20)])
def test_trie(spark, talk, limit, chunk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    short = talk if limit > 1 else [x for x in talk if x[0] is not None and x[0] < 64]
    d = spark.createDataFrame(short, "conv_id long, turn long, role string, text string").repartition(4)
    got = sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(d), limit).collect()), key=str)
    want = conversation_nodes(short)
    assert len(want) > 100 and got == want


def test_trie_flushes_and_odd_tables(spark, talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FLUSH", 3)
    d = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(7) for c in ("d", "seq", "head", "ends", "n", "least", "up", "_c", "_base", "e", "own", "some")})
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(d)).collect()), key=str) == conversation_nodes(talk)
    assert prefix_trie.trie(prefix_trie.rebuilt(d.limit(0))).collect() == []
    twice = talk + talk[:40]  # repeated rows are turns of their own
    d = spark.createDataFrame(twice, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(d), 30).collect()), key=str) == conversation_nodes(twice)


def test_trie_takes_long_texts_whole(spark):
    rows = [(20, 0, "user", "w " * 500_000), (20, 1, "user", "x"), (21, 0, "user", "w " * 500_000 + "y"), (21, 1, None, "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(d)).collect()), key=str) == conversation_nodes(rows)


def test_turnless_conversations(spark):
    """A conversation whose only turns are cut and whose base is absent ends at the root."""
    c = next(i for i in range(21, 40) if zlib.crc32(str(i).encode()) % 4 == 3)
    d = spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(d)).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# ---- URL filter


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def filtered(urls, rules, order=5, prior=2.0, rows=10_000, grams=100_000):
    """(host, path, rule, verdict, score) by recursion over contexts; scores only up to rounding."""
    text = lambda u: (u.split("://", 1)[1] if "://" in u else u) if u else ""
    ruled = [(u, *split(u), rule_of(*split(u), rules)) for u in urls]
    sample = {(text(u), r[0] == "allow") for u, *_, r in ruled if r}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sample = [x for g in (True, False) for x in sorted((s for s in sample if s[1] == g), key=lambda s: (md5(s[0]), s[0]))[:rows]]
    train = [s for s in sample if md5(s[0])[0] not in "012"]
    count = {True: Counter(), False: Counter()}
    for t, good in train:
        p = "\x02" * order + t + "\x03"
        for i in range(order, len(p)):
            for k in range(order + 1):
                count[good][p[i - k : i + 1]] += 1
    keep = sorted(set(count[True]) | set(count[False]), key=lambda s: (-count[True][s] - count[False][s], len(s), s))[:grams]
    total = {g: Counter() for g in count}
    for g in count:
        for s in keep:
            total[g][s[:-1]] += count[g][s]
    kept = set(keep)

    def prob(g, s):
        below = prob(g, s[1:]) if len(s) > 1 else 1 / 256
        return ((count[g][s] if s in kept else 0) + prior * below) / (total[g][s[:-1]] + prior)

    def score(t):
        p = "\x02" * order + t + "\x03"
        return sum(math.log(prob(True, p[i - order : i + 1]) / prob(False, p[i - order : i + 1])) for i in range(order, len(p))) / (len(t) + 1)

    check = [(score(t), good) for t, good in sample if md5(t)[0] in "012"]
    ny, nn = max(1, sum(g for _, g in check)), max(1, sum(not g for _, g in check))
    least = min((-(sum(g for s, g in check if s >= v) / ny + sum(not g for s, g in check if s < v) / nn), v) for v, _ in check)[1]
    return [(h, p, r and r[1] + r[2], r[0] if r else "allow" if u and score(text(u)) >= least - 1e-5 else "block", None if r or not u else score(text(u))) for u, h, p, r in ruled], least


@pytest.fixture(scope="module")
def urls():
    r = random.Random(4)
    words = ["news", "tips", "casino", "win", "wiki", "shop", "blog", "free"]
    out = []
    for _ in range(260):
        lang = r.choice(["en", "es", "fr", "de"])
        host = f"{r.choice(['www.', 'm.', ''])}{r.choice(words)}{r.choice(words) if lang in ('es', 'fr') else ''}.example.{r.choice(['com', 'net', 'org'])}"
        out.append(f"http{r.choice(['', 's'])}://{host}/{lang}/{r.choice(words)}{r.choice(['', '?q=1', '#top', '.html'])}")
    extra = ["", None, "no scheme at all", "HTTP://WWW.Example.COM/en/x", "http://com/", "http://com", "http://xcom/", "http://net/es/", "http://a.net/Es/", "x://y://z.com/a", "http://é.org/ñ?ü", "://", "http://org?x", "http://a.org#f/", "http://exämple.com/en/"]
    return out + extra + out[:20]


@pytest.mark.parametrize(("order", "grams"), [(5, 100_000), (2, 300)])
def test_urls(spark, urls, order, grams):
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge(d, order=order, grams=grams).collect()}
    want, least = filtered(urls, url_filter.RULES, order=order, grams=grams)
    assert len(got) == len(urls)
    seen = Counter()
    for i, (host, path, rule, verdict, score) in enumerate(want):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[i]
        assert r["score"] == (None if score is None else pytest.approx(score, abs=2e-5)), urls[i]
        assert r["threshold"] == pytest.approx(least, abs=2e-5)
        if score is None or abs(score - least) > 5e-5:
            assert r["verdict"] == verdict, urls[i]
        seen[rule is None, verdict] += 1
    assert len(seen) == 4


def test_urls_without_two_classes(spark):
    """Nothing labelled, one side only, an empty table, null rows, clashing names."""
    rows = [(1, "http://a.org/x"), (None, None), (1, "http://a.org/x"), (2, ""), (None, "http://b.com/")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("7") for c in ("host", "path", "rule", "ruled", "verdict", "score", "steps", "_rid", "_w", "s", "d", "b")})
    got = sorted(((r["page_id"], r["host"], r["verdict"]) for r in url_filter.judge(d).collect()), key=str)
    assert got == sorted([(1, "a.org", "allow")] * 2 + [(None, "", "block"), (2, "", "block"), (None, "b.com", "allow")], key=str)
    assert url_filter.judge(d.limit(0)).collect() == []


def test_long_url_is_judged_whole(spark, urls):
    long = "http://a.org/" + "wiki/" * 20_000 + "casino" * 20_000
    d = spark.createDataFrame([*enumerate(urls), (9999, long)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(d).collect()}
    want, _ = filtered([*urls, long], url_filter.RULES)
    assert got[9999]["score"] == pytest.approx(want[-1][-1], abs=2e-5)


def test_urls_are_all_learned_from(spark):
    """More labelled URLs a side than any sample would take: each is counted, each calibrates or trains."""
    ruled = url_filter.decided(spark.range(24_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.hex(F.xxhash64("id")), F.when(F.col("id") % 2 == 0, ".com/a").otherwise(".net/es/b")).alias("url")))
    texts = url_filter.labelled(ruled)
    assert texts.groupBy("good").count().orderBy("good").collect() == [(0, 12_000), (1, 12_000)]
    counts = spark.createDataFrame([(f"{i:04d}"[: 2 + i % 3], i % 5, i % 7) for i in range(300)], "s string, y long, n long")
    got = [tuple(r) for r in url_filter.most_frequent(counts, 40).collect()]
    assert sorted(got) == sorted(sorted((tuple(r) for r in counts.collect()), key=lambda r: (-r[1] - r[2], len(r[0]), r[0]))[:40])


def test_models_hold_every_string(spark):
    """More different strings than a bounded table would keep, and windows of every frequency: broadcast, joined and mixed give one score."""
    text = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    urls = [f"http://{text(i)[:16]}.{'org/c' if i % 25 == 0 else 'com/a' if i % 2 else 'net/es/b'}" for i in range(6_000)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    texts = url_filter.labelled(url_filter.decided(d)).where("fit").select("text", "good")
    model = url_filter.train(texts)
    seen = {p[i - k : i + 1] for (t, _) in texts.collect() for p in [5 * "\x02" + t + "\x03"] for i in range(5, len(p)) for k in range(6)}
    assert len(seen) > 100_000 and model.where("k > 0 and d is not null").count() == len(seen)
    want, least = filtered(urls, url_filter.RULES, rows=len(urls), grams=len(seen))
    free = {i: w[-1] for i, w in enumerate(want) if w[-1] is not None}
    got = {r["page_id"]: r for r in url_filter.judge(d).where("score is not null").collect()}
    assert len(free) > 100 and set(got) == set(free)
    for i, r in got.items():
        assert r["score"] == pytest.approx(free[i], abs=2e-5) and r["threshold"] == pytest.approx(least, abs=2e-5)
    asked = d.where(F.col("page_id").isin(list(free))).select("page_id", F.substring("url", 8, 99).alias("t"))
    for hot in (1, 500):
        steps = {r["page_id"]: r["steps"] for r in url_filter.mean_steps(asked, F.col("t"), model, hot=hot).collect()}
        assert steps == {i: round(r["score"] * 1e6) for i, r in got.items()}


def test_urls_use_no_python_worker(spark, urls):
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    plan = url_filter.judge(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
