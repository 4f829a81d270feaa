"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canasta.llm import chat, graph, language, mixing, packing, quality, secrets, simhash, substring, tokens, topk, vectors
from canasta.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, root long, rank int, key string, label int, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Rows with extra columns whose names operators use inside."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), i, i, i, "k", i, i))
    return spark.createDataFrame(rows, DOCS)


def sample_texts(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Über", "niño", "été", "x", "token", "=", "12", "a.b", "日本", "end."] + [f"w{i}" for i in range(40)]
    texts = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.5:
            words = (r.choice(texts) or "x").split(" ")
            a = r.randrange(len(words))
            texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randint(0, 20))] + words[a:a + r.randint(5, 40)] + [r.choice(vocabulary)]))
        else:
            texts.append(r.choice([" ", "\n", "  "]).join(r.choice(vocabulary) for _ in range(r.randint(0, 120))))
    return texts + [None, "", " \t\n", "word", "same word " * 400, "long " + "q" * 70_000 + " tail", None]


# secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                    r"""[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def secret_texts():
    r = random.Random(4)
    pieces = ["token", "Token", "api_key", "apikey", "passwd", "pass", "password", "secret", "ſecret", " ", "  ", ":", "=", '"', "'", "abc", "AKIA", "AKI",
              "ABCD0123456789ABCDEF", "0123456789abcdef0123456789abcdef", "é", "_", "\n", "deadbeef", "\U0001F600"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    return texts + ["AKIA" + "A0" * 20_000, "a" * 30_000, "token=" + "x" * 5_000 + " é" * 3_000, "token= token: abcdef", "token= token:token=abcdef", ""]


def test_automaton_agrees_with_backtracking():
    texts = secret_texts()
    found = dict(secrets.scan_texts(secrets.compile_rules(secrets.RULES), [t.encode() for t in texts]))
    assert [found.get(i, []) for i in range(len(texts))] == [brute_spans(t) for t in texts]


def test_rules_that_need_another_engine_are_refused():
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("bad", "[^a]", "[a-z]", 3),))
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("bad", "a(?=b)", "[a-z]", 3),))


def test_secret_query_and_redaction(spark):
    texts = secret_texts()[:60] + [None, "", 'é token = "abcdef123" end'] * 2
    docs = documents(spark, texts, ids=[None if i == 3 else i // 2 for i in range(len(texts))])
    rows = secrets.digest(docs).collect()
    written = lambda t: ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in brute_spans(t or ""))
    want = sorted((-1 if i == 3 else i // 2, written(t), hashlib.sha256(written(t).encode()).hexdigest()) for i, t in enumerate(texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.spans, r.base_sha256) for r in rows) == want
    redacted = secrets.redact_secrets(docs)
    assert redacted.columns == docs.columns
    assert [r.text for r in redacted.where(F.col("text").endswith(" end")).collect()] == ['é [assign]" end'] * 2
    assert secrets.digest(docs.limit(0)).count() == 0


# SimHash

def brute_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_simhash_groups(spark):
    texts = sample_texts(2, 90) + ["A B c d", "a b C D"]
    prints = [brute_print(t) for t in texts]
    for i in range(12):      # fingerprints near others, through the fingerprints' own neighbours
        assert simhash.fingerprint((texts[i] or "").encode()) == prints[i]
    rows = {r.doc_id: r for r in simhash.digest(documents(spark, texts)).collect()}
    root = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{p:016x}", root[i]) for i, p in enumerate(prints)}


def test_close_links_connect_what_pairs_connect(spark):
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(30)]
    for p in list(prints):
        for _ in range(4):
            prints.append(p ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {x.node: x.root for x in graph.components(simhash.close_links(df)).collect()}
    root = brute_components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(root[i], set()).add(found.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
    with pytest.raises(ValueError):
        simhash.close_links(df, 3)


def test_simhash_keeps_one_row_of_each_group(spark):
    texts = ["one two three four"] * 3 + [None, "", "other words here now", "other words here now"]
    docs = documents(spark, texts, ids=[5, 5, None, 7, None, 2, 9])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 7]
    r = random.Random(9)
    long = [[f"w{r.randrange(900)}" for _ in range(150)] for _ in range(40)]
    near = [list(t) for t in long]
    for t in near:
        t[r.randrange(150)] = "changed"
    half = [t[:75] + [f"v{r.randrange(900)}" for _ in range(75)] for t in long]
    texts = [" ".join(t) for t in long + near + half] + [" ".join(long[0]).upper()]
    found = {x.doc_id for x in simhash.keep_one(documents(spark, texts)).collect()}
    assert set(range(40)) | set(range(80, 120)) == found - set(range(40, 80)) and len(found & set(range(40, 80))) <= 1
    only = documents(spark, ["a b c", "a b c"], ids=[None, None])
    assert simhash.keep_one(only).count() == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


def kept_by_brute_force(texts):
    """Smallest index of each group that pairs with at least 4/5 of their 5-word shingles in common connect."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    postings = {}
    for i, s in enumerate(sets):
        for x in s:
            postings.setdefault(x, []).append(i)
    shared = [p for p in postings.values() if len(p) > 1]
    table = np.zeros((len(texts), len(shared)), np.float32)
    for c, p in enumerate(shared):
        table[p, c] = 1
    both, size = table @ table.T, np.array([len(s) for s in sets])
    a, b = np.nonzero(np.triu(9 * both >= 4 * (size[:, None] + size), 1))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = sorted((find(i), find(j)))
        root[y] = x
    return {i for i in range(len(texts)) if root[i] == i}


def test_sketches_rule_out_no_near_copies(spark):
    r = np.random.default_rng(3)
    rows, shares = [], []
    for n in (1, 2, 5, 31, 32, 33, 100, 127, 128, 130, 700):
        for share in (0.5, 0.75, 0.79, 0.8, 0.82, 0.9, 1.0):
            for _ in range(4):
                both = r.integers(0, 1 << 63, max(1, round(n * share)), dtype=np.uint64)
                m = round(len(both) / share) - len(both)
                one = r.integers(0, m + 1)
                x, y = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (one, m - one))
                shares.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
                rows.append((len(rows), len(x), len(y), simhash.sketch(x).tolist(), simhash.sketch(y).tolist()))
    df = spark.createDataFrame(rows, "i int, n int, m int, s array<long>, t array<long>")
    may = {x.i: x.may for x in df.select("i", simhash._may_share(*[F.col(c) for c in "nmst"]).alias("may")).collect()}
    start = np.zeros(2, np.int64)
    for i, n, m, s, t in rows:
        hit = simhash._possible(np.arange(2), start, np.array([n, m]), start, [np.array(s), np.array(t)], False)
        fits = 9 * min(n, m) >= 4 * (n + m)
        assert hit.all() == hit.any() == bool(may[i] and fits)
        assert may[i] or shares[i] < 0.8
    assert sum(not may[i] for i in may if shares[i] < 0.76 and rows[i][1] > 90) > 20


def test_near_copies_of_an_original_in_the_middle(spark):
    r = random.Random(21)
    base = [f"w{r.randrange(5000)}" for _ in range(100)]
    texts = []
    for i in range(2001):
        t = list(base)
        if i != 1000:
            for at in r.sample(range(8, 90, 6), 2):      # 10 of 96 shingles: 0.81 to the original, 0.65 between two copies
                t[at] = f"n{i}.{at}"
        texts.append(" ".join(t))
    texts += [" ".join(f"o{r.randrange(5000)}" for _ in range(60)) for _ in range(20)]
    want = kept_by_brute_force(texts)
    assert want == {0, *range(2001, 2021)}
    assert {x.doc_id for x in simhash.keep_one(documents(spark, texts)).collect()} == want


def test_near_copies_without_their_original(spark):
    r = random.Random(22)
    texts = []
    for g in range(3):       # siblings below 0.8, some of which have a near copy of their own
        base = [f"w{r.randrange(5000)}" for _ in range(100)]
        for i in range(60):
            t = list(base)
            for at in r.sample(range(8, 90, 6), 2):
                t[at] = f"n{g}.{i}.{at}"
            texts.append(" ".join(t))
            if i % 3 == 0:
                texts.append(" ".join([*t[:-1], "end"]))
    r.shuffle(texts)
    want = kept_by_brute_force(texts)
    assert 100 < len(want) < len(texts)
    for few, block in ((1000, 1000), (2, 1000), (2, 16)):
        assert {x.doc_id for x in simhash.keep_one(documents(spark, texts), few=few, block=block).collect()} == want


def test_near_copies_by_block_and_scattered_edits(spark):
    r = random.Random(23)
    words = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    texts = []
    for share in (0.75, 0.79, 0.80, 0.81, 0.85):
        for _ in range(12):
            t = words(204)       # 200 shingles
            more = round(200 / share - 200)
            cut = round(200 * (1 - share) / (1 + share))          # shingles lost on either side
            spread = list(t)
            for at in r.sample(range(5, 195, 6), round(cut / 5)):
                spread[at] = "edited"
            texts += [" ".join(x) for x in (t, t + words(more))]
            u = words(204)
            texts += [" ".join(x) for x in (u, u[:60] + words(cut - 4) + u[56 + cut:])]
            texts += [" ".join(x) for x in (t[::-1], spread[::-1])]
    want = kept_by_brute_force(texts)
    assert 200 < len(want) < len(texts) - 60
    assert {x.doc_id for x in simhash.keep_one(documents(spark, texts)).collect()} == want


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in graph.components(links).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert graph.components(links.limit(0)).count() == 0


# packing

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    return Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_remembered_chunks_give_the_tokenizer_ids(tokenizer, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    r = random.Random(2)
    pieces = [" ", "  ", "\n", "\t", "a", "the", "é", "12", "!!", "'s", "<|endoftext|>", "\x1c", "\r\n", "日本", "don't", "\0", ".", " ", "　"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(6000)]
    apart = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts += ["".join(r.choice("aB.,;?! \n\n'9é") for _ in range(r.randint(0, 40))) for _ in range(6000)] + [" ".join(r.choices(pieces, k=3000)), " ".join(r.choices(["a.b", "c,\nd", "é."], k=3000))]
    wanted = [np.array(apart.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [tokenizer.ids(t) for t in texts] == wanted
    assert sum(np.frombuffer(x, "<u4").tolist().count(50256) for x in wanted) > 1000
    monkeypatch.setattr(tokens, "WORDS", 500)            # memory starts anew, long texts are cut
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    assert tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts[-3000:]) == wanted[-3000:]


def test_packing_partitions_every_document(spark, tokenizer):
    texts = sample_texts(3, 60) + ["many words " * 3000]
    docs = documents(spark, texts, ids=[i // 2 if i % 7 else None for i in range(len(texts))]).withColumn("start", F.lit(1))
    rows = packing.digest(docs.repartition(3)).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = tokenizer.whole([t or ""])[0] + bytes(4)
        want.setdefault((i // 2 if i % 7 else None, len(ids) // 4), []).append(ids)
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        possible = [ids[4 * r.start:4 * (r.start + r.length)] for ids in want[r.doc_id, r.doc_tokens]]
        assert r.ids_crc32 in {zlib.crc32(p) for p in possible}
    for (key, tokens), found in pieces.items():
        covered = sorted(x for r in found for x in range(r.start, r.start + r.length))
        assert covered == sorted(list(range(tokens)) * len(want[key, tokens]))
    assert pieces.keys() == want.keys()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in windows.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.digest(docs.limit(0)).count() == 0


def test_differencing_is_near_equal_and_raises_the_count():
    r = random.Random(3)
    sizes = [r.randint(1, 256) for _ in range(400)]
    parts = packing.balanced(sizes, 1024)
    assert sorted(i for p in parts for i in p) == list(range(400))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) <= 1024 and len(parts) <= -(-sum(sizes) // 1024) * 1.02 + 1 and max(sums) - min(sums) < 100
    assert len(packing.balanced([700] * 5, 1024)) == 5
    assert packing.differencing([8, 7, 6, 5, 4], 2) in ([[0, 2], [1, 3, 4]], [[1, 3, 4], [0, 2]], [[0, 1], [2, 3, 4]], [[2, 3, 4], [0, 1]], [[0, 3], [1, 2, 4]], [[1, 2, 4], [0, 3]])
    assert packing.differencing([], 3) == []


# mixing

def test_mix_meets_its_targets(spark):
    texts = sample_texts(6, 400)
    sources = [random.Random(i).choice([None, "a", "b", "c", "B", "é"]) for i in range(len(texts))]
    docs = documents(spark, texts, sources=sources)
    rows = mixing.digest(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in rows} == size
    order = sorted({s for s in sources if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    total = {s: sum(size[i] for i in size if sources[i] == s) for s in order}
    want, left, open_ = {}, 1.5 * sum(size.values()), list(order)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]]
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            want[s] = 2.0 * total[s]
        left -= sum(want[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        assert (r.source_size, pytest.approx(r.target)) == (total[s], want[s])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
    assert {s: round(taken[s] - want[s]) for s in order if abs(taken[s] - want[s]) > 10} == {}
    assert sorted(mixing.digest(docs.repartition(7)).collect()) == sorted(rows)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.taken // r.size for r in rows if r.taken} == counts


def test_mix_does_not_depend_on_the_split(spark):
    texts = sample_texts(7, 200)
    ids = [random.Random(i).choice([1, 2, 3, None, 100 + i]) for i in range(len(texts))]        # ids with many texts
    docs = documents(spark, texts, ids=ids, sources=[f"s{i % 4}" for i in range(len(texts))]).drop("n_chars", "fp", "root", "label", "size")
    docs = docs.union(docs.where("doc_id in (2, 105)"))                                         # and rows that repeat
    first, other = sorted(mixing.digest(docs).collect(), key=str), sorted(mixing.digest(docs.repartition(7, "text")).collect(), key=str)
    assert first == other
    mixes = [sorted(mixing.mix_documents(x).collect(), key=str) for x in (docs, docs.repartition(7, "text"))]
    assert mixes[0] == mixes[1]
    size = lambda t: len(WORD.findall(t or ""))
    words = lambda pairs: {k: sum(n for i, n in pairs if i == k) for k in {i for i, _ in pairs}}
    assert words([(r.doc_id, size(r.text)) for r in mixes[0]]) == {k: n for k, n in words([(r.doc_id, r.taken) for r in first]).items() if n}


def test_mix_of_nothing(spark):
    docs = documents(spark, [None, "", " "])
    assert [(r.taken, r.target) for r in mixing.digest(docs).collect()] == [(0, 0.0)] * 3
    assert mixing.digest(docs.limit(0)).count() == 0


def test_flow_routes_overlapping_sources():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    taken = mixing.route(patterns, {"a": 100, "b": 150}, 2)
    assert taken == {("a",): 100, ("a", "b"): 130, ("b",): 20} or (sum(taken.values()) == 250 and taken[("b",)] <= 20 and taken[("a", "b")] >= 100)
    assert mixing.route({("a",): 10}, {"a": 5}, 2) == {("a",): 5}
    assert mixing.route({("a",): 10, ("b",): 3}, {"a": 17, "b": 100}, 2) == {("a",): 17, ("b",): 6}


# substring dedup

def brute_repeats(texts, ids, window=13):
    words = [WORD.findall(t or "") for t in texts]
    least = {}
    for i, w in zip(ids, words):
        for a in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[a:a + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for a in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[a:a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeated_passages_go(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    texts = sample_texts(7, 150)
    ids = [i * 7 % 160 if i % 25 else None for i in range(len(texts))]
    ids[9] = ids[8]
    rows = substring.digest(documents(spark, texts, ids=ids)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute_repeats(texts, ids)
    assert sum(r.n_removed for r in rows) > 500


def test_no_documents_no_passages(spark):
    assert substring.digest(documents(spark, ["x"]).limit(0)).count() == 0


def test_fm_index_finds_windows():
    r = np.random.default_rng(1)
    sizes = r.integers(0, 60, 50)
    words = r.integers(1, 4, sizes.sum()).astype(np.uint64)
    index = substring.FmIndex(words, sizes, 5)
    begins = np.cumsum(sizes) - sizes
    known = {}
    for b, n in zip(begins, sizes):
        for a in range(b, b + n - 4):
            known[tuple(words[a:a + 5])] = known.get(tuple(words[a:a + 5]), 0) + 1
    asked_sizes = np.array([30, 4, 0, 17])
    asked = r.integers(1, 5, asked_sizes.sum()).astype(np.uint64)
    low, high = index.matches(asked, asked_sizes)
    starts = np.cumsum(asked_sizes) - asked_sizes
    want = [known.get(tuple(asked[a:a + 5]), 0) for b, n in zip(starts, asked_sizes) for a in range(b, b + max(n - 4, 0))]
    assert list(np.maximum(high - low, 0)) == want


# top-k and vectors

def some_vectors(spark, n=700, dim=24, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for i in range(0, n, 5):
        x[i] = x[i // 25] + r.standard_normal(dim) * r.choice([0.0, 0.05, 0.1, 0.2])
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(i % 4) if i % 50 else None, i, i, i) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [float("nan")] + [1.0] * (dim - 1), 1), (n + 4, [None] + [1.0] * (dim - 1), 1),
           (n + 5, [float("inf")] + [1.0] * (dim - 1), 1), (None, [float(v) for v in x[1]], 1), (1, [float(v) for v in x[1]], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    return spark.createDataFrame(rows + [(*o, 0, 0, 0) for o in odd], "vec_id long, embedding array<float>, label int, rep long, n long, b long")


def finite(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


@pytest.mark.parametrize("block", [64, 4096])
def test_top_k_is_exact(spark, block):
    table = some_vectors(spark)
    rows = [(r.vec_id, np.floor(np.array(r.embedding, np.float64) * 1024).astype(np.int64)) for r in table.collect() if finite(r.embedding)]
    want = []
    for q, x in rows:
        if q is not None and q % 100 == 0:
            scored = sorted((-int(x @ y), i is None, i or 0) for i, y in rows if i != q and len(y) == len(x))[:10]
            want += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(scored)]
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, block=block, query_block=3).collect()
    order = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert topk.digest(table.limit(0)).count() == 0


def test_reading_stops_before_the_lists_end():
    r = np.random.default_rng(0)
    values = r.integers(-10, 10, (4096, 8))
    values[:20] += 1000
    lists = topk.Lists(values)
    queries = np.array([[5] * 8, [-3, 0, 2, 1, 0, 0, 0, 1]])
    for query, left in zip(queries, lists.best(queries, 10, np.zeros((4096, 2), bool))):
        assert set(np.lexsort((np.arange(4096), -(values @ query)))[:10]) <= set(left)
    lists.read = 0
    lists.best(queries[:1], 10, np.zeros((4096, 1), bool))
    assert lists.read < 4096 * 8 / 4


@pytest.mark.parametrize("block", [16, 1024])
def test_vector_links(spark, block):
    table = some_vectors(spark)
    rows = table.collect()
    usable = [r.label is not None and finite(r.embedding) and any(r.embedding) for r in rows]
    unit = [np.array(r.embedding) / np.linalg.norm(r.embedding) if u else None for r, u in zip(rows, usable)]
    linked = lambda i, j: usable[i] and usable[j] and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93
    root = brute_components(len(rows), linked)
    degree = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    least = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            least[root[i]] = min(least.get(root[i], r.vec_id), r.vec_id)
    want = sorted((-1 if r.vec_id is None else r.vec_id, degree[i], least.get(root[i], -1)) for i, r in enumerate(rows))
    got = vectors.near_duplicates(table, block=block).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vectors.digest(table.limit(0)).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(8)
    for dim, count in ((64, 20_000), (50, 2_000_000)):
        a = r.standard_normal((3000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = r.standard_normal((3000, dim))
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        hashing = vectors.choose(dim, count)
        x, y = hashing.buckets(a), hashing.buckets(b)
        met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
        assert met.mean() > 0.98
    h = vectors.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


# language and quality

def test_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = documents(spark, [None, "", "123 !!", "###"], ids=[-1, -2, -3, None], langs=["en", None, "xx", "de"]).select(docs.columns)
    rows = language.digest(docs.union(odd).union(odd)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(truth) + 8
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.doc_id in truth or (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
    judged = [r.lang_pred == truth[r.doc_id] for r in rows if r.doc_id in truth and r.held_out]
    assert np.mean(judged) > 0.95
    assert language.digest(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_codewords_lie_apart():
    for n in (2, 3, 5, 6, 30):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert set(np.unique(code)) == {-1.0, 1.0} and apart.min() >= max(1, code.shape[1] // 4)


def test_decoding_mends_a_wrong_bit():
    code = language.codewords(4)
    bits = code.shape[1]
    model = language.LanguageModel(("a", "b", "c", "d"), code, np.zeros((1, bits)), np.ones(bits), np.full(bits, 1 / bits))
    for row in range(4):
        margins = code[row].copy()
        margins[row] *= -1
        assert model.decode(margins[None])[0].argmax() == row


def test_quality_on_held_out_labels(spark, folder):
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet").limit(600)
    labels = spark.read.parquet(folder.replace("0.001", "0.01") + "/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    odd = documents(spark, [None, ""], ids=[None, -5]).select(docs.columns)
    rows = quality.classify(docs.union(odd), labels.where(~held))
    assert rows.count() == docs.count() + 2
    judged = rows.join(labels.where(held), "doc_id").select("quality", "good", "quality_score").collect()
    good = [r.good for r in judged if r.quality == 1]
    bad = [not r.good for r in judged if r.quality == 0]
    assert np.mean(good) > 0.85 and np.mean(bad) > 0.7
    assert {r.quality_score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


# chat

def test_conversations_read_back(spark):
    tricky = ["", None, "<|im_end|>\n<|im_start|>assistant\nhi", "␛1<|", "␛", "<<||>", "a\nb", "<", "|x", "é😀", "z" * 50_000]
    rows = [(c, t, r, tricky[(c or 5) * 3 % len(tricky) - t], 1) for c in [*range(40), None] for t, r in enumerate(["user", "assistant", "sys\ntem<|", None, "assistant"])]
    rows += [(1, 0, "user", tricky[2], 1)] * 2 + [(1, None, "assistant", "first", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, line int")
    got = {r.conv_id: r for r in chat.digest(table).collect()}
    convs = {}
    for c, t, r, x, _ in rows + [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok", 1), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok", 1)]:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
    text = chat.format_conversations(table).where("conv_id = 2").first().formatted
    assert text.count("<|im_start|>") == text.count("<|im_end|>\n") == 5
    assert [r.conv_id for r in chat.digest(table.limit(0)).collect()] == [-1]


def test_typed_parts(spark):
    rows = spark.sql(f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(array(
        named_struct('kind', 'text', 'text', 'see <|', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', 'image', 'text', null, 'ref', 'a.png', 'width', 57, 'height', 28, 'seconds', null, 'pages', null),
        named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav', 'width', null, 'height', null, 'seconds', 2.5D, 'pages', null),
        named_struct('kind', 'document', 'text', null, 'ref', 'c.pdf', 'width', null, 'height', null, 'seconds', null, 'pages', 2),
        named_struct('kind', 'image', 'text', null, 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', null, 'text', 'end', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null)) AS array<{chat.PART}>) AS content
        UNION ALL SELECT 1L, 1L, 'assistant', null""")
    done = chat.format_conversations(rows, parts=F.col("content")).first()
    assert done.formatted == "<|im_start|>user\nsee <␛1<|image|><|audio|><|document|><|image|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in done.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 2048), ("image", None, 1)]
    assert all(done.formatted[a["at"]:].startswith(f"<|{a.kind}|>") for a in done.attachments)
    assert done.placeholder_tokens == 3 + 63 + 2048 + 1
