"""The subpackage's operators against brute force, libraries and planted cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import ann, bpe, chat, jaccard, langid, mixing, quality, queries, sharding, topk, urlfilter

DOCS = "doc_id long, text string, lang string, source string, score double, size int, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    long = "word " * 30_000 + "x" * 200_000
    rows = [(1, None, "en", "a", 0.0, 1, 1), (2, "", "en", None, 0.0, 1, 1), (3, "12 34 !!", None, "a", 0.0, 1, 1), (4, "the cat sat on the mat", "en", "b", 0.0, 1, 1), (4, "the cat sat on the mat", "en", "b", 0.0, 1, 1)]
    rows += [(5, long, "en", "b", 0.0, 1, 1), (None, "le chat est sur la table", "fr", "a", 0.0, 1, 1), (7, "le chat est sous la table", "fr", "a", None, None, None), (8, "\U0001f389 <|endoftext|> é\r\n\tß", "de", "c", 0.0, 1, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_language_on_held_out_documents(spark, sf, docs):
    got = queries.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_is_crc32(docs):
    got = docs.select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_language_of_odd_rows(odd, spark):
    model = langid.fit(odd.filter("doc_id is null or doc_id <> 5"))  # one text of 350,000 letters would be nearly all that is learned
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "en" and got[7]["lang_pred"] == "fr"
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_bpe_equals_the_library(odd, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    lib, own = Tokenizer.from_file(path), bpe.codec(path)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefghij klmno pqrstuvwxyzABCÉé ß123'\n\t漢🎉") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    texts += ["a" * 500, "ab" * 300, "", " ", "\n\n x", "<|endoftext|><|endoftext|>", "it's we'LL 'tis", "the " * 50 + " "]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.array(want, "<u4").tobytes() == ids
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    rows = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    for r in bpe.tokenise(rows, path).collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_bpe_small_store_and_long_texts(monkeypatch):
    own = bpe.codec(queries.vocabulary())
    text = " ".join(f"w{i}x" for i in range(500))
    whole = own.encode_batch([text])[0]
    monkeypatch.setattr(bpe, "STORE", 50)
    assert own.encode_batch([text] * 3, most=100) == [whole] * 3


def test_shards_are_stable_and_slots_gapless(odd, docs):
    rows = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    got = sharding.assign(rows).collect()
    assert len(got) == rows.count()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == [*range(len(s))] for s in by.values())
    more = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.assign(rows, shards=9).collect()}
    assert all(more[r["doc_id"], r["text_crc32"]] == r["grown_shard"] for r in got)
    texts = {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in rows.collect()}
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == texts
    assert sharding.assign(rows.limit(0)).count() == 0


def test_heavier_shards_get_more(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r["shard"]: r["count"] for r in sharding.assign(rows, weights=[1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.2 < got[0] / 4000 < 0.3


def test_mix_targets_and_caps(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for i, s in enumerate(["a"] * 300 + ["b"] * 10 + ["c"] * 200)] + [(999, "w w", None), (1000, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    total = sum(len(t.split()) if t else 0 for _, t, _ in rows)
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 14
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(docs).collect()))
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got)
    assert mixing.copies(docs.limit(0)).count() == 0


def test_mix_shares_copies_among_repeated_rows(odd):
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    assert got.count() == mixing.copies(odd).agg(F.sum("copies")).first()[0]


URLS = ["http://A.Example.ORG/es/x?q", "http://example.org/en/12", "http://x.com/fr/", "https://x.com#/fr/", "no url", None, "a://b://c/d", "http://badorg/x", "http://u.org", "HTTP://Free-Casino.net/pills"]


def test_url_rules(spark):
    pages = spark.createDataFrame([*enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, *urlfilter.fit(urlfilter.labelled_urls(spark))).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert [got[i]["rule"] for i in range(1, 10)] == ["example.org/en/1", "com/fr/", None, None, None, None, None, None, None]
    assert (got[3]["host"], got[3]["path"]) == ("x.com", "") and (got[5]["host"], got[5]["path"]) == ("", "") and (got[6]["host"], got[6]["path"]) == ("b:", "//c/d")
    assert got[9]["verdict"] == "block" and got[9]["host"] == "free-casino.net"


HELD_OUT = [
    *((u, 1) for u in ("http://casino-royal.test/slots", "https://pills-store.test/cheap", "http://www.adult-videos.test/en", "https://free-betting.test/de/4", "http://ads-click.test/banner", "https://spam-network.test/links/9")),
    *((u, 1) for u in ("http://bets.test/win", "https://xxx.test/cams/7", "http://m.track-click.test/ads", "https://farm-links.test/seo")),
    *((u, 0) for u in ("https://www.college.test/courses/2021", "http://bookshop.test/novels", "https://cycling.test/routes/spain", "http://www.cathedral.test/visit", "https://blog.chemistry.test/en/31", "http://m.airport.test/arrivals")),
    *((u, 0) for u in ("https://opera.test/programme", "http://fishing.test/lakes/north", "https://www.embassy.test/fr/visa", "http://astronomy.test/planets/mars")),
]


def test_urls_that_no_rule_fits(spark):
    """Verdicts on labelled URLs that weren't learned from, and the sum of weights in plain Python for some odd ones."""
    weights, intercept = urlfilter.fit(urlfilter.labelled_urls(spark))
    pages = spark.createDataFrame([(i, u, "clash", y) for i, (u, y) in enumerate(HELD_OUT)], "page_id long, url string, host string, rule int")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, weights, intercept, rules=()).collect()}
    right = sum((got[i]["verdict"] == "block") == bool(y) for i, (_, y) in enumerate(HELD_OUT))
    assert right >= 0.9 * len(HELD_OUT)
    odd = ["http://a", "x", None, "http://\U0001f389é.test/\U0001f389", "http://" + "long" * 300 + "/" + "p" * 500, "http://a", ""]
    rows = spark.createDataFrame([*enumerate(odd), (None, "http://b/c")], "page_id long, url string")
    def texts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return ("^" + (m[1].lower() if m else "") + "$", "^" + (m[2] if m else "") + "$")

    grams = [(i, name, t[j : j + k]) for i, u in enumerate(odd) for name, t in zip("hp", texts(u), strict=True) for k in (3, 4, 5) for j in range(len(t) - k + 1)]
    hashed = spark.createDataFrame([(i, n, [*g]) for i, n, g in grams], "i int, n string, g array<string>")
    total = {i: intercept for i in range(len(odd))}
    by_size = [F.when(F.size("g") == k, F.xxhash64("n", *[F.get("g", F.lit(j)) for j in range(k)])) for k in (3, 4, 5)]
    for r in hashed.select("i", F.pmod(F.coalesce(*by_size), F.lit(urlfilter.DIMENSIONS)).alias("b")).collect():
        total[r["i"]] += weights[r["b"]]
    found = {r["page_id"]: r["unwanted"] for r in urlfilter.judge(rows, weights, intercept).collect()}
    assert len(found) == len(odd) + 1
    assert all(abs(found[i] - 1 / (1 + np.exp(-t))) < 1e-9 for i, t in total.items())
    assert urlfilter.judge(rows.limit(0), weights, intercept).count() == 0


def test_the_first_of_equally_long_rules_wins(spark):
    page = spark.createDataFrame([(1, "http://a.org/ab")], "page_id long, url string")
    for first, second, verdict in ((("allow", "a.org/"), ("block", "org/ab"), "allow"), (("block", "org/ab"), ("allow", "a.org/"), "block")):
        assert urlfilter.judge(page, [0.0], 0.0, rules=(first, second)).first()["verdict"] == verdict


def test_too_many_labels_are_refused(spark, odd, monkeypatch):
    with pytest.raises(ValueError):
        urlfilter.fit(urlfilter.labelled_urls(spark), most=10)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(odd)


def test_top_k_is_exact(spark):
    rnd = np.random.default_rng(1)
    m = rnd.integers(-9, 9, (300, 8)).astype(float)
    m[50:200] = m[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(300, None), (301, [1.0] * 7 + [float("nan")]), (302, [1.0] * 7 + [None]), (303, [1.0])]
    table = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(table, table.filter("id % 20 = 0"), 20).collect()}
    s = m @ m.T
    for q in range(0, 300, 20):
        order = sorted((j for j in range(300) if j != q), key=lambda j: (-s[q, j], j))[:20]
        assert [got[q, k + 1] for k in range(20)] == [(j, int(s[q, j])) for j in order]
    few = table.filter("id < 5")
    assert topk.search(few, few.filter("id = 0"), 20).count() == 4
    assert topk.search(few.limit(0), few, 20).count() == 0


def test_top_k_of_repeated_queries_and_candidates(spark):
    rnd = np.random.default_rng(6)
    m = rnd.integers(-9, 9, (60, 8)).astype(float)
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(m)]
    rows += [rows[0], (0, [float(x) for x in m[7]], "clash"), (20, [float(x) for x in m[9]], "clash"), rows[5], rows[5]]
    table = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), "vec_id", "embedding")
    got = {}
    for r in topk.search(table, table.filter("id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        own = min(v for i, v, _ in rows if i == q)
        scored = sorted((-int(np.dot(own, v)), i) for i, v, _ in rows if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]


def test_nearest_recall_and_equal_vectors(spark):
    rnd = np.random.default_rng(2)
    m = rnd.normal(size=(600, 16))
    m[100:300] = m[100]
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(m)] + [(600, [0.0] * 16, ""), (601, None, ""), (602, [float("inf")] * 16, ""), (None, [9.0] * 16, ""), (0, [float(x) for x in m[0]], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    s = m @ m.T
    hit = total = 0
    for q in range(0, 600, 20):
        order = sorted((j for j in range(600) if j != q), key=lambda j: (-s[q, j], j))[:20]
        assert len(got[q]) == 20 and all(abs(v - s[q, j]) < 1e-9 for j, v in got[q].values())
        hit, total = hit + len({j for j, _ in got[q].values()} & {*order}), total + 20
    assert hit >= 0.9 * total
    assert ann.nearest(table.limit(0), F.col("id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("kind", ["one long vector", "cluster"])
def test_nearest_recall_of_uneven_vectors(spark, kind):
    rnd = np.random.default_rng(7)
    m = rnd.normal(size=(2000, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    if kind == "cluster":
        m[500:1500] = m[1] + m[500:1500] * 1e-3
    else:
        m[3] *= 100
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("id") % 40 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    hits = {q: len(got[q] & {*np.argsort(-s[q])[:20].tolist()}) / 20 for q in range(0, 2000, 40)}
    assert np.mean([*hits.values()]) >= 0.9
    assert np.mean([h for q, h in hits.items() if 500 <= q < 1500]) >= 0.9


def test_descent_makes_the_graph(spark, monkeypatch):
    """From first neighbours within small blocks alone, a narrow beam finds far fewer than after rounds of descent."""
    rnd = np.random.default_rng(5)
    m = rnd.normal(size=(3000, 12))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    monkeypatch.setattr(ann, "CELL", 40)
    monkeypatch.setattr(ann, "PIVOTS", (8, 8))
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    best = {q: {*np.argsort(-s[q])[:20].tolist()} for q in range(0, 3000, 50)}
    recall = []
    for rounds in (0, 10):
        index = ann.build(rows, 20, most_rounds=rounds)
        got = index.graph.select("node", "near").filter("node % 50 = 0").collect()
        recall.append(np.mean([len({*r["near"][:20]} & best[r["node"]]) / 20 for r in got]))
    assert recall[1] >= 0.9 > recall[0] + 0.2


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, width, t):
    sets = [(i, shingles(x, width)) for i, x in rows]
    parent = [*range(len(sets))]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) * t.denominator >= t.numerator * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(s), least[root(i)]) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize(("width", "t", "budget"), [(3, Fraction(9, 10), 1 << 22), (5, Fraction(8, 10), 1 << 22), (3, Fraction(8, 10), 300), (5, Fraction(8, 10), 60)])
def test_jaccard_join_is_exact(spark, width, t, budget):
    rnd = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 12, 40, 90]))]
        for _ in range(rnd.choice([1, 2, 6, 12])):
            copy = base[:]
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rnd.shuffle(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "One"), (n + 3, "one"), (n + 4, " \t"), (n + 5, "a b"), (n + 6, "A  b")]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, width, t, budget=budget).collect()}
    assert got == brute_components(rows, width, t)


@pytest.mark.parametrize(("most", "needs"), [(12, (1, 8)), (150, (40, 120))])
def test_divide_skip_finds_what_counting_finds(monkeypatch, most, needs):
    """Up to 120 occurrences needed; with a dearer probe fewer lists are set aside, and the heap has more than one to find."""
    rnd = np.random.default_rng(4)
    for mu, heap in ((0.0008, 2048), (0.5, 1 << 30), (0.02, 1 << 30)):
        monkeypatch.setattr(jaccard, "MU", mu)
        monkeypatch.setattr(jaccard, "HEAP", heap)
        for _ in range(100):
            lists = [np.sort(rnd.choice(60, rnd.integers(0, 59), replace=False)) for _ in range(rnd.integers(most // 3, most))]
            need = int(rnd.integers(*needs))
            ids, counts = np.unique(np.concatenate(lists), return_counts=True)
            found, shared = jaccard.divide_skip(lists, need, jaccard._probe)
            assert dict(zip(ids[counts >= need].tolist(), counts[counts >= need].tolist(), strict=True)) == dict(zip(found.tolist(), shared.tolist(), strict=True))


@pytest.mark.parametrize("role", [False, True])
def test_cell_finds_all_links(role):
    rnd = np.random.default_rng(9)
    sets = []
    for size in (30, 30, 80, 200):
        base = rnd.choice(1 << 40, size, replace=False)
        for _ in range(25):
            own = base.copy()
            own[rnd.choice(size, rnd.integers(0, size // 5), replace=False)] = rnd.integers(1 << 40, 1 << 41)
            sets.append(np.unique(own[: rnd.integers(size * 9 // 10, size + 1)]).astype(np.uint64))
    side = rnd.integers(0, 2, len(sets)) if role else None
    parent = [*range(len(sets))]
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if (side is None or side[a] != side[b]) and 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if x == old else x for x in parent]
    got = dict(map(reversed, jaccard.search_cell(sets, np.arange(len(sets)), Fraction(8, 10), side)))
    assert [got.get(i, i) for i in range(len(sets))] == parent


def test_jaccard_of_a_group_of_half_the_table(spark):
    """Sets that drift away from the first, in one group of many blocks, of which no block knows all parts."""
    rnd = random.Random(8)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(240):
        if i % 3 == 0:
            words = words[:]
            words[rnd.randrange(60)] = f"d{i}"
        rows.append((i, " ".join(words if i % 2 == 0 else [f"x{i}y{j}" for j in range(20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, 3, Fraction(9, 10), budget=200).collect()}
    assert got == brute_components(rows, 3, Fraction(9, 10))


def test_jaccard_of_odd_and_empty_tables(odd):
    assert jaccard.join(odd, 3, Fraction(9, 10)).count() == odd.count()
    assert jaccard.join(odd.limit(0), 3, Fraction(9, 10)).count() == 0


def test_quotes_are_linked(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine.\n\nThanks"), (1, 2, "user", "> > How are you?\n> Fine.\n>\n> Thanks\nok"), (1, 3, "x", "> HELLO   there\n> how are you?\nyes"), (1, 4, "y", ">nothing such\nk"), (1, 5, "y", "> ok\nz")]
    rows += [(2, 0, "u", None), (2, None, "u", "> a"), (None, 3, "u", "hi"), (1, 5, "y", "> ok\nz")]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert [by[1, i]["reply_to"] for i in range(6)] == [None, 0, 1, 0, None, 2]
    assert [by[1, i]["depth"] for i in range(6)] == [0, 1, 2, 1, 0, 3] and by[1, 5]["thread"] == 0
    assert by[1, 2]["body"] == "ok" and by[1, 2]["quote_depth"] == 2 and by[2, 0]["body"] == ""
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversations(empty).count() == 0


def plain_rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


def test_generated_threads_are_linked_as_sql_links_them(spark):
    """Nested quotes, ties between originals, forged quotes, repeated turns, nulls and a long message."""
    import duckdb
    import pyarrow as pa

    from loomline.llm.oracle import ORACLES

    rnd = random.Random(12)
    rows = []
    for conv in range(30):
        said = []
        for turn in range(rnd.randint(1, 14)):
            own = [" ".join(rnd.choice(["Yes", "no", "the cat", "a  dog", "runs", ">x", "ß"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 4))]
            lines = own[:]
            for _ in range(rnd.randint(0, 2)):
                text = rnd.choice(said) if said and rnd.random() < 0.8 else "forged words\nmore"
                part = text.split("\n")
                part = part[rnd.randrange(len(part)) :] if rnd.random() < 0.3 else part
                at = rnd.randint(0, len(lines))
                lines[at:at] = [rnd.choice(["> ", ">", " > "]) + x.upper() if rnd.random() < 0.2 else "> " + x for x in part]
            text = rnd.choice(["\n", "\n", "\r\n"]).join(lines)
            said.append(text.replace("\r\n", "\n"))
            rows.append((conv, turn, rnd.choice(["user", "assistant", None]), text, turn, "clash"))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    rows += [(99, 0, "u", "\n".join(["> a", ">> b", "c"] * 3000), 0, ""), (99, 1, "u", "> c\nd", 0, ""), (98, None, "u", "> c\nd", 0, ""), (None, 1, "u", "> c\nd", 0, ""), (97, 1, "u", None, 0, ""), (97, 2, "u", "", 0, "")]
    columns = ["conv_id", "turn", "role", "text", "depth", "body"]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, body string"))
    conversations = pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)})  # noqa: F841  (DuckDB reads it by name)
    want = duckdb.sql(ORACLES["op8_chat"])
    found = got.collect()
    assert plain_rows(got.columns, found) == plain_rows(want.columns, want.fetchall())
    assert sum(r["reply_to"] is not None for r in found) > 60 and max(r["depth"] for r in found) > 3 and max(r["quote_depth"] for r in found) > 3
    keys = [(r["conv_id"], r["thread"], r["turn"]) for r in found if r["conv_id"] is not None and r["turn"] is not None]
    assert keys == sorted(keys)


def test_quality_on_held_out_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_quality(spark, sf).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)


def test_quality_of_odd_rows(spark, odd):
    none = quality.fit(odd, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), none).count() == 0


def test_forest_separates():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(500, 4))
    y = ((x[:, 1] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    assert ((quality.grow(x, y).score(x) >= 0.5) == y).mean() > 0.98


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline

    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf).cache())
        assert kept[-1].columns == docs.columns
    quality_kept, known, single, mixed = (k.collect() for k in kept[1:])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert {r["doc_id"] for r in quality_kept} >= {i for i, q in labels.items() if q == 1}
    want = brute_components([(r["doc_id"], r["text"]) for r in known], 5, Fraction(8, 10))
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c in want.values()})
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(kept[3]).collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    assert corpus_pipeline.run(spark, sf).count() == len(mixed)


def test_near_copies_are_dropped_by_row(spark, sf):
    import corpus_pipeline

    def text(letter, changed=False):
        return " ".join("other" if changed and i == 30 else f"{letter}{i}" for i in range(60))

    rows = [(1, text("a")), (2, text("a", True)), (2, text("b")), (3, text("b")), (4, text("c")), (4, text("d")), (None, text("e")), (None, text("e", True)), (None, text("f")), (5, text("f")), (6, text("g")), (6, text("g")), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, x, "s") for i, x in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], (r["text"] or "-")[0]) for r in got.collect()), key=str)
    assert kept == sorted([(1, "a"), (2, "b"), (4, "c"), (4, "d"), (None, "e"), (5, "f"), (6, "g"), (7, "-"), (8, "-")], key=str)
