"""Substring and near-duplicate detection, sharding, mixing and URL rules against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from _shared_docs import EDGE, edge_docs, empty_docs
from tarnql.llm import mixing, sharding, simhash, substring_index, url_rules
from tarnql.llm._graph import connected_components
from tarnql.llm._words import Words


def words(text):
    return (text or "").encode().split()


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(k, k + 1) for k in range(60)] + [(100, int(x)) for x in rng.integers(101, 160, 80)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]}, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == want
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b a", None, "", " a\tb\n" + "x" * 100, "b" + "é" * 40, "x" * 100]
    w = Words(pa.array(texts))
    got = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)]
    assert w.doc.tolist() == [k for k, t in enumerate(texts) for _ in words(t)]
    for which in (0, 1):
        h = w.hashes(which)
        assert len(set(h.tolist())) == len(set(got)) and all(h[i] == h[j] for i in range(len(got)) for j in range(len(got)) if got[i] == got[j])
    at, h = w.windows(2, 0)
    pairs = [(got[k], got[k + 1]) for k in at]
    assert len(at) == 4 and len(set(h.tolist())) == len(set(pairs))


def brute_substrings(rows, width):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - width + 1):
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_substrings(spark, batches):
    rng = np.random.default_rng(batches)
    passage = [f"p{k}" for k in range(20)]
    rows = [(i, " ".join([*(f"{rng.integers(0, 40)}" for _ in range(rng.integers(0, 30))), *(passage if i % 3 == 0 else passage[4:12]), *("tail of it".split())])) for i in range(60)]
    rows += [r[:2] for r in EDGE] + [(61, rows[0][1]), (61, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as grp").repartition(5)
    got = substring_index.dedup_substrings(df, width=5, batches=batches, buckets=4)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr) == brute_substrings(rows, 5)


def test_substring_index_is_incremental(spark):
    index = substring_index.WindowIndex(spark, width=3, buckets=2, groups=2, fanout=2)
    batch = lambda *rows: spark.createDataFrame(rows, "id long, text string")
    flagged = [sum(r.n for r in index.add(batch(*rows)).selectExpr("length(h) n").collect()) > 0 for rows in ([(9, "a b c d")], [(1, "x y z")], [(2, "b c d")], [(3, "new words here")], [(4, "x y z")])]
    assert flagged == [False, False, True, False, True] and sorted(index.levels.values()) == [0, 2]  # five batches: one alone, four in one run
    index.close()
    assert index.name not in [t.name for t in spark.catalog.listTables()]


def test_sizes_of_the_index_stay_bounded():
    for size in (0, 10**6, 10**9, 10**11, 10**12, 10**13, 10**14):
        buckets, batches = substring_index.plan_sizes(size)
        assert 16 <= buckets <= 4096 and batches >= 4 and size <= buckets * batches * substring_index.MOST_BYTES + 16 * 4 * substring_index.BUCKET_BYTES
    assert substring_index.plan_sizes(5 * 10**8) == (20, 4)


def test_a_failed_batch_leaves_no_index(spark, monkeypatch):
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before = tables()
    monkeypatch.setattr(substring_index.WindowIndex, "compact", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        substring_index.dedup_substrings(spark.createDataFrame([(i, "a b c d e f") for i in range(40)], "doc_id long, text string"), width=3, buckets=2)
    assert tables() == before


def clashing(spark):
    """Documents with columns that have the names operators use inside."""
    df = spark.createDataFrame([r[:5] for r in EDGE if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for c in ("_key", "_size", "_source", "_hit", "_tokens", "_gone", "_of", "_id", "_crc", "_root", "_row", "_copy", "_set_key", "__hit", "a b"):
        df = df.withColumn(c, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    return df


@pytest.mark.parametrize("op", ["mixed", "dedup", "urls", "shards"])
def test_columns_of_any_name_pass_through(spark, op, tmp_path):
    df = clashing(spark)
    if op == "mixed":
        got = mixing.mixed(df)
    elif op == "dedup":
        got = simhash.dedup_near_copies(df)
    elif op == "urls":
        got = url_rules.judge_urls(df.withColumn("url", F.lit("http://a.org/es/x")), (("org/", "block"),)).where("rule = 'org/' and verdict = 'block'").drop("host", "path", "rule", "verdict", "url")
    else:
        sharding.write_shards(df, str(tmp_path / "out"), shards=4)
        got = spark.read.parquet(str(tmp_path / "out")).drop("shard")
    assert got.columns == df.columns
    want = {tuple(r) for r in df.collect()}
    rows = [tuple(r) for r in got.collect()]
    assert rows and set(rows) <= want and (op in ("mixed", "dedup") or len(rows) == len(want))


def test_false_hash_matches_are_verified():
    h, c = np.array([5, 5, 7], np.uint64), np.array([1, 2, 3], np.uint32)
    assert substring_index._known(np.array([5, 5, 6, 7, 7], np.uint64), np.array([2, 9, 1, 3, 4], np.uint32), h, c).tolist() == [True, False, False, True, False]


def test_empty_tables(spark):
    none = empty_docs(spark)
    for f in (substring_index.dedup_substrings, simhash.simhash_components, simhash.near_duplicate_classes, simhash.dedup_near_copies, sharding.shard_by_bytes, mixing.mix_sources, mixing.mixed):
        assert f(none).collect() == [], f


def brute_fingerprint(text, n=4):
    w = [x.decode() for x in words((text or "").translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)))]
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    rng = np.random.default_rng(2)
    base = [f"v{k}" for k in range(400)]
    rows = [(100 + i, " ".join(w if rng.random() > 0.002 * (i % 7) else "Edited" for w in base[: 350 + i])) for i in range(40)] + [r[:2] for r in EDGE if r[0] is not None]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 id", "3 root")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)


def test_null_ids_take_part(spark):
    got = simhash.simhash_components(edge_docs(spark)).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.doc_id is None} == {0, 3}


@pytest.mark.parametrize("threshold", [4, 7])
@pytest.mark.parametrize("length", [3, 4])
def test_no_link_is_lost(spark, threshold, length):
    """Pigeonring filtering connects exactly what pairs within the threshold connect."""
    rng = np.random.default_rng(threshold)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre}
    for _ in range(250):
        x = centre if rng.random() < 0.7 else int(rng.integers(0, 1 << 63))
        for b in rng.choice(64, rng.integers(0, 2 * threshold), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fp long"), threshold, length)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= threshold for r in links.collect())
    comp = {r.node: r.root for r in connected_components(spark, links).collect()}
    want = components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold)
    assert {x: comp.get(x, x) for x in signed} == want


def test_near_duplicates(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.integers(0, 300)}" for _ in range(150)]
        for k in range(4):
            changed = [w if j % 50 or not k or j % 4 != k else f"new{g}{k}{j}" for j, w in enumerate(base)]
            rows.append((10 * g + k, " ".join(changed)))
        rows.append((10 * g + 5, " ".join(rng.permutation(base))))
        rows.append((10 * g + 6, rows[-2][1].upper()))
    df = spark.createDataFrame(rows + [(500, None), (501, ""), (None, "x"), (502, "short one"), (503, "Short one")], "doc_id long, text string").selectExpr("*", "1 key", "2 fp", "3 a")

    def runs(t):
        w = words(t.lower() if t else t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: runs(r.text) for r in df.collect() if r.doc_id is not None}
    want = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()}
    assert got == want
    kept = simhash.dedup_near_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*set(want.values()), None], key=repr)


def jaccard_components(rows):
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(words(t.lower())) for i, t in rows}
    return components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_copies_of_one_text_meet_behind_a_reordered_one(spark):
    """A large group: each copy is similar to one text only, and the smallest id has its words in another order."""
    rng = np.random.default_rng(3)
    base = [f"s{k}" for k in range(400)]
    rows = [(1, " ".join(rng.permutation(base)))]
    for i in range(2, 3002):
        w = list(base)
        for at in rng.choice(40, 8, replace=False):
            w[10 * at + 2] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    rows.append((5000, " ".join(base)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    assert all(len(s & sets[-1]) >= 0.8 * len(s | sets[-1]) for s in sets[1:]) and not any(len(s & sets[1]) >= 0.8 * len(s | sets[1]) for s in sets[2:200])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {1: 1} | {i: 2 for i, _ in rows[1:]}


@pytest.mark.parametrize("seed", [1, 2])
def test_large_buckets_are_searched_to_the_end(spark, seed):
    """Many texts share one passage; those that are similar besides are scattered over it."""
    rng = np.random.default_rng(seed)
    common, rows = " ".join(f"c{k}" for k in range(60)), []
    for g in range(60):
        own = [f"g{g}w{k}" for k in range(int(rng.integers(3, 20)))]
        for k in range(int(rng.integers(1, 5))):
            w = list(own)
            w[int(rng.integers(len(w)))] = f"new{g}x{k}"
            rows.append((int(rng.integers(10)) + 10 * len(rows), f"{common} {' '.join(w)}"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == jaccard_components(rows)


@pytest.mark.parametrize("low, high", [(6, 12), (12, 20)])
def test_short_near_copies(spark, low, high):
    """In a text of few words one other word turns many bits of a fingerprint."""
    rng, rows = np.random.default_rng(low), []
    for g in range(150):
        w = [f"g{g}w{k}" for k in range(int(rng.integers(low, high)))]
        rows += [(3 * g, " ".join(w)), (3 * g + 1, " ".join([*w, f"more{g}"])), (3 * g + 2, " ".join([f"one{g}", *w[1:]]))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows)


def test_different_texts_of_one_id_stay(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, one), (5, one + " end"), (5, two), (5, two + " end"), (5, three), (7, three)]
    kept = simhash.dedup_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(1, "a"), (5, "b"), (5, "c")]


def check_shards(rows, got, shards):
    assert len(rows) == len(got)
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    slots, sizes = defaultdict(list), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert any(r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for t in text[r.doc_id])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_sharding(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(3000)] + [(5000 + i, "hot text") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as shard", "3 as part").repartition(6)
    got = sharding.shard_by_bytes(df, shards=8).collect()
    sizes = check_shards(rows, got, 8)
    assert max(sizes) <= 1.02 * sum(sizes) / 8 + 401 and min(sizes) >= 0.98 * sum(sizes) / 8 - 401
    again = sharding.shard_by_bytes(df.repartition(3), shards=8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_sharding_of_one_hot_text_and_edges(spark):
    rows = [(i, "only") for i in range(1000)]
    sizes = check_shards(rows, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect(), 4)
    assert max(sizes) - min(sizes) <= 10
    check_shards([r[:2] for r in EDGE], sharding.shard_by_bytes(edge_docs(spark), shards=16).collect(), 16)


def test_written_shards(spark, tmp_path):
    df = edge_docs(spark, extra=False)
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def brute_mix(rows, weights, share, most):
    size = [len(words(t)) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= most * total[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s], left = most * total[s], left - most * total[s]
        open_ -= full
    out = []
    for s in order:
        mine = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), n, i) for (i, _, x), n in zip(rows, size) if x == s)
        full = int(target[s] // total[s]) if total[s] else 1
        rest, before = target[s] - full * total[s], 0
        for _, n, i in mine:
            out.append((i, n, total[s], target[s], n * (full + (rest > 0 and abs(before + n - rest) < abs(before - rest)))))
            before += n
    return out


def test_mixing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{int(rng.integers(0, 9)) ** 2 // 9}" if i % 40 else None) for i in range(900)] + [(1000, None, "empty"), (1001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as key", "3 as epochs").repartition(5)
    got = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    want = brute_mix(rows, (5, 2, 1), 1.5, 2.0)
    assert len(got) == len(want) == len(rows)
    for i, n, s, t, taken in want:
        assert (got[i]["size"], got[i].source_size, got[i].taken) == (n, s, taken) and got[i].target == pytest.approx(t)
    mixed = mixing.mixed(df)
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r.doc_id] += 1
    assert mixed.columns == df.columns and all(counts[i] == r.epochs for i, r in got.items())


def test_many_sources_are_salted(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    plain = sorted(map(tuple, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == plain


def test_mixing_edges(spark):
    assert mixing.mix_sources(edge_docs(spark)).count() == len(EDGE)
    only = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.epochs) for r in mixing.mix_sources(only).collect()} == {(1, 0, 1), (2, 0, 1)}


URLS = [
    "http://a.example.org/es/1", "https://Example.ORG/en/17?x#y", "http://x.com/fr/", "http://x.com/de/9", "http://com/de/9", "http://notcom/de/", "ftp://telecom/de/", "http://example.org", "http://example.org?es/",
    "no scheme", "", None, "http://", "://com/fr/x", "http://u@x.com/fr/a://b/c", "http://É.com/fr/", "http://x.org#/es/", "http://x.com/de", "http://x.com//de/",
]
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("x.com/de/9", "allow"))


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(p), p, v) for p, v in RULES if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith(p[p.index("/") :])]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("inline", [500, 0])
def test_url_rules(spark, inline):
    rows = [(k, u) for k, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as verdict", "2 as token")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, RULES, inline_rules=inline).collect()}
    assert got == {k: brute_url(u) for k, u in rows}
    assert url_rules.judge_urls(df.limit(0), RULES, inline_rules=inline).collect() == []
    assert url_rules.judge_urls(df, ()).where("verdict <> 'allow' or rule is not null").collect() == []


def test_rules_are_filed_under_their_rarest_token():
    index = url_rules.rule_index([url_rules.Rule("example.org/es/", "block"), url_rules.Rule("org/", "allow")], {"example": 90, "org": 50, "/es/": 3})
    assert {t: [r.pattern for r in rs] for t, rs in index.items()} == {"/es/": ["example.org/es/"], "org": ["org/"]}


