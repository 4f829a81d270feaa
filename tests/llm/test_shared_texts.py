"""Decontamination, lexical search and the prefix trie against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canasta.llm import decontamination, lexical, terms, trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, id long, n long, spans string, items string, h1 int, mark int, score int, q int"
ITEMS = "item_id string, text string, n int, hashes int, doc_id long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", 3, 4, 5, 6) for i, t in rows], DOCS)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], ITEMS)


def sample(seed, n, vocabulary):
    r = random.Random(seed)
    blanks = [" ", "\n", ", ", "'", "__", " - "]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice(blanks) for _ in range(k))
    return [text(r.randint(0, 60)) for _ in range(n)], r


def passages():
    vocabulary = ["The", "of", "Über", "niño", "x1", "日本", "a", "end", "É", "İ"] + [f"w{i}" for i in range(6)]
    items, r = sample(3, 12, vocabulary)
    items += ["only three words", "ONE", "", None, " -- ", items[0], "a " * 30]
    docs, _ = sample(4, 60, vocabulary)
    for i in range(40):
        t = r.choice(items) or ""
        a = r.randrange(len(t) + 1)
        docs.append(r.choice(docs) + " " + t[a:a + r.randint(0, 200)] + " " + r.choice(docs))
    docs += [None, "", "...", "one", "Only, three: words!", "a " * 500, docs[70], docs[70], "z" * 5000 + " one"]
    return docs, items


def leaks(text, items, window=10):
    """Brute force: (words, hit places, names)."""
    own, hit, names = words(text), set(), set()
    for name, t in items:
        ws = words(t)
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            for j in range(len(own) - k + 1):
                if own[j:j + k] == ws[i:i + k]:
                    hit |= set(range(j, j + k))
                    names |= {name} - {None}
    return len(own), hit, sorted(names)


def test_suffix_order_and_location():
    r = random.Random(1)
    for _ in range(200):
        symbols, body = r.choice([2, 3, 50]), []
        for _ in range(r.randint(1, 8)):
            body += [r.randint(1, symbols - 1) for _ in range(r.randint(1, 40))] + [0]
        text = np.array(body)
        order = decontamination.suffix_order(text, symbols)

        def key(p):
            out = []
            while text[p]:
                out.append((1, int(text[p])))
                p += 1
            return out + [(0, int(p))]

        assert order.tolist() == sorted(range(len(text)), key=key)
        rows = np.flatnonzero(text[order])
        assert (decontamination.ShardIndex(text, symbols).locate(rows) == order[rows]).all()


@pytest.mark.parametrize("block", [decontamination.BLOCK, 60])
def test_leaks_agree_with_brute_force(spark, block):
    texts, items = passages()
    items = [(None if i == 5 else f"i{i % 15}", t) for i, t in enumerate(items)]
    docs = documents(spark, [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]).repartition(3)
    rows = decontamination.find_leaks(docs, benchmark(spark, items), block=block).collect()
    found = Counter((r.doc_id, r.n_words, tuple(x for s in r.spans for x in range(s.start, s.end)), tuple(r["items"])) for r in rows)
    for r in rows:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    wanted = Counter()
    for i, t in enumerate(texts):
        n, hit, names = leaks(t, items)
        wanted[None if i == 3 else i // 2, n, tuple(sorted(hit)), tuple(names)] += 1
    assert found == wanted


def test_long_texts_are_cut_between_words(monkeypatch):
    texts, items = passages()
    texts = [t.encode() for t in texts if t] + [" ".join(t or "" for t in texts).encode(), b"q" * 900 + b" one " + b"r" * 900, b"one"]
    rows = [(i, *terms.hashed((t or "").encode() + b"\n")) for i, t in enumerate(items)]
    import pyarrow as pa
    pieces = pa.table({"item": [str(i) for i, _, s, _ in rows if len(s)], "n": [len(s) for _, _, s, _ in rows if len(s)], "longest": [int(s.max()) for _, _, s, _ in rows if len(s)],
                       "hashes": pa.array([h.view(np.int64) for _, _, s, h in rows if len(s)], pa.list_(pa.int64()))})
    phrases = decontamination.Phrases.of(pieces, 10)
    whole = list(decontamination.leaks_of(texts, phrases))
    counts = lexical.counted(texts, phrases.vocabulary)
    for part, shard in ((50, 200), (7, 7), (300, 100)):
        monkeypatch.setattr(terms, "SLICE", part)
        monkeypatch.setattr(terms, "SHARD", shard)
        assert list(decontamination.leaks_of(texts, phrases)) == whole
        assert all((a == b).all() for a, b in zip(lexical.counted(texts, phrases.vocabulary), counts))


def test_leaks_are_removed(spark):
    texts, items = passages()
    named = [(str(i), t) for i, t in enumerate(items)]
    docs = documents(spark, list(enumerate(texts)))
    clean = decontamination.remove_leaks(docs, benchmark(spark, named))
    assert clean.columns == docs.columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        _, hit, _ = leaks(t, named)
        assert words(rows[i]) == [w for j, w in enumerate(words(t)) if j not in hit]
        assert hit or rows[i] == t


def test_decontamination_of_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b")]), benchmark(spark, [("x", "a b")])
    none = decontamination.digest(docs, items.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in none] == [(2, 0, 0, False)]
    assert decontamination.digest(docs.limit(0), items).collect() == []
    assert decontamination.digest(docs, items).collect()[0].contaminated


# lexical search

def ranked(docs, items, k=10):
    held = [(key, Counter(words(t))) for key, t in docs if words(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for name, text in set(items):
        asked, scored = Counter(words(text)), []
        for key, own in held:
            m = 25 + (75 * sum(own.values()) * n) // total
            score = sum(q * weight[t] * ((1000000000 * own[t]) // (1000 * own[t] + 8 * m)) for t, q in asked.items() if own[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(name, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"bucket": 7, "block": 40, "sample": 20}, {"bucket": 1, "sample": 1}])
def test_search_agrees_with_brute_force(spark, options):
    texts, items = passages()
    docs = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    items = [(None if i == 4 else f"i{i % 16}", t) for i, t in enumerate(items)] + [("i1", items[1]), ("rare", "nowhere"), ("rare", "日本 nowhere")]
    found = lexical.search(documents(spark, docs).repartition(5), benchmark(spark, items), **options)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b"), (2, None)]), benchmark(spark, [("x", "a"), ("y", None)])
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == ranked([(1, "a b"), (2, None)], [("x", "a"), ("y", None)])


def test_bounds_leave_documents_out():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 6, 4000)
    term = np.concatenate([np.sort(r.choice(300, n, replace=False)) for n in sizes])
    impact = r.integers(1, 600_000, len(term))
    bucket = lexical.Bucket(np.arange(4000), sizes, term, impact, 300)
    asked, weight = r.choice(300, 12, replace=False), r.integers(1, 9000, 12)
    dense = np.zeros(300, np.int64)
    dense[asked] = weight
    scores = np.add.reduceat(dense[term] * impact, np.cumsum(sizes) - sizes)
    least = np.sort(scores)[-10]
    found = bucket.candidates(asked, weight.astype(float), float(least))
    assert set(np.flatnonzero(scores >= least)) <= set(found.tolist()) and len(found) < 300
    assert (bucket.scores(found, dense) == scores[found]).all()
    assert not len(bucket.candidates(asked, weight.astype(float), float(math.sqrt((weight.astype(float) ** 2).sum()) * bucket.norm * 1.01)))


# prefix trie

CONVS = "conv_id long, turn int, role string, text string, conv long, depth long, node long, n long, h int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], CONVS)


def talk(seed=5):
    r, rows = random.Random(seed), []
    for c in [*range(0, 40), *range(95, 130), *range(300, 310), 777, -3, -150, -100]:
        if c == 300:
            continue
        for t in range(r.choice([0, 1, 2, 3, 5, 8, 40]) if c else 9):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]) if r.random() < .3 else "user", r.choice(["a", "b", "", None, "é日"])))
    return rows + [(None, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "user", "a"), *[(9, t, "user", "a") for t in range(60)]]


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    return sorted((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in nodes.items())


def test_trie_agrees_with_brute_force(spark):
    rows = talk()
    found = trie.digest(conversations(spark, rows).repartition(5))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect())) == brute_trie(rows)


def test_trie_in_small_bands_and_stretches(spark):
    rows = talk(6)
    built = trie.rebuilt(trie.numbered_turns(conversations(spark, rows)))
    assert sorted(map(tuple, trie.trie(*built, band=3, stretch=4).collect())) == brute_trie(rows)


def test_turns_of_a_hot_conversation_are_numbered_in_ranges(spark):
    rows = [(5, t % 977, "user", str(t % 5)) for t in range(4000)] + [(c, 0, "user", "x") for c in range(100, 120)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie.numbered_turns(conversations(spark, rows)).where("conv = 5").orderBy("pos").select("pos", "c1").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.pos for r in found] == list(range(1, 4001))
    hashes = {r.text: r.c1 for r in spark.createDataFrame([("user", str(i)) for i in range(5)], "role string, text string").select("text", F.xxhash64("role", "text").alias("c1")).collect()}
    assert [r.c1 for r in found] == [hashes[text] for _, text in sorted((t % 977, str(t % 5)) for t in range(4000))]


def test_trie_of_an_empty_table(spark):
    assert trie.digest(conversations(spark, talk()).limit(0)).collect() == []
    assert trie.digest(conversations(spark, [(None, 1, "user", "a")])).collect() == []
