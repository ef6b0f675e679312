"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference
from quillstone.llm import ann, bpe, decontaminate, licenses, lm, neardup, oracles, quality, queries, secrets, toxicity, urls
from quillstone.llm.common import table
from quillstone.llm.words import word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, rep string, block string, _text string"
SECRET = "AKIA" + "ABCDEFGH12345678"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = "word " * 40_000 + "password: hunter22 " + " ".join(f"w{i % 977}" for i in range(30_000))
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    odd = [
        (900_001, None, None, None, None), (900_002, "", "en", "web", 0), (900_003, " \n\t ", "en", "web", 4), (900_004, long, "en", "web", len(long)), (900_004, long, "en", "web", len(long)),
        (900_005, f'api_key = "{SECRET}" x {"0123456789abcdef" * 2} Secret: abcdefg', "en", "web", 1), (900_006, "K İ ß é \u2028 naïve <|endoftext|> don't", "de", "web", 1),
        (900_007, "CC BY cc\nby Licensed under the Apache License, Version 2.0 all rights reserved", "en", "web", 1), (900_008, "One two three", None, "web", 1), (900_009, "one TWO three", None, "web", 1),
        (900_010, "intro words here. " + item + " and some more", "en", "web", 1), (None, "a row without an id", "en", "web", 1),
    ]
    rows = [(*r, "id", "key", "rep", "block", "_text") for r in base + odd]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    odd = spark.createDataFrame([(900_001, 1, None), (None, 1, 1), (900_002, None, 0)], "doc_id bigint, quality int, toxic int")
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").unionByName(odd)


def folds(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def test_near_duplicates(docs, plain):
    sets = {}
    for i, t in plain:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    group[max(p, q)] = min(p, q)
    got = neardup.op1_near_duplicates(docs).collect()
    assert len(got) == len(plain)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id) if r.doc_id is not None else None)
    kept = [r.doc_id for r in neardup.keep_one(docs).select("doc_id").collect()]
    assert sorted(i for i in kept if i is not None) == [i for i in ids if find(i) == i]


def test_near_duplicates_of_edited_copies(spark):
    """A base text and copies with more and more changed words, copies of copies among them: links as brute force has them."""
    rng = np.random.default_rng(5)
    texts = [[f"v{x}" for x in rng.integers(0, 5000, 60)]]
    for _ in range(120):
        w = list(texts[rng.integers(0, len(texts))])
        for k in rng.integers(0, len(w), rng.integers(0, 3)):
            w[k] = f"n{rng.integers(0, 40)}"
        texts.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if low[a] != low[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in neardup.op1_near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == low


def backoff_chance(counts, n_tokens, n_words, history, word):
    """p(word | history) straight from the definition."""
    if not history:
        return (counts[(word,)] + 1) / (n_tokens + n_words + 1)
    lower = backoff_chance(counts, n_tokens, n_words, history[1:], word)
    seen = counts[history]
    return (counts[(*history, word)] + lm.STRENGTH * lower) / (seen + lm.STRENGTH) if seen else lower


def test_language_model(docs, plain):
    tokens = [(i, [*words(t), "\0end"]) for i, t in plain]
    counts = Counter()
    for i, w in tokens:
        if folds(i, 7) != 2:
            for n in range(1, lm.ORDER + 1):
                counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    want = []
    for i, w in tokens:
        p = [backoff_chance(counts, n, v, tuple(w[max(0, k - lm.ORDER + 1) : k]), x) for k, x in enumerate(w)]
        want.append((-1 if i is None else i, folds(i, 7) == 2, len(w), sum(counts[(x,)] > 0 for x in w), n, sum(math.log10((counts[(x,)] + 1) / (n * 1 + v + 1)) for x in w), sum(map(math.log10, p))))
    assert lm.ORDER >= 3
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.op2_lm(docs).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_language_model_automaton_state_by_state():
    """After each word the state is the longest seen history that ends there; what a step weighs is arcs and failure arcs."""
    texts, trained = ["a b c a b d", "b c a", "a b c x a b"], [1, 1, 0]
    h, offsets = lm.tokens_of(texts)
    grams = lm.levels(h, offsets, np.repeat(trained, np.diff(offsets)), 3, {})
    tokens = [[*t.split(), "\0end"] for t in texts]
    counts = Counter(tuple(w[k : k + n]) for w, on in zip(tokens, trained, strict=True) if on for n in (1, 2, 3) for k in range(len(w) - n + 1))
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    machine = lm.Automaton(grams, v, n, lm.STRENGTH)
    names = {0: ()}
    base = 1
    for level in grams[:2]:
        for at, index in enumerate(level.index):
            if index >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                names[base + index] = tuple(tokens[text][at - offsets[text] - level.n + 1 : at - offsets[text] + 1])
        base += len(level.keys)
    for text, w in enumerate(tokens):
        state = np.zeros(1, dtype=np.int64)
        for k, word in enumerate(w):
            state, weight = machine.step(state.copy(), grams[0].index[[offsets[text] + k]])
            longest = next(g for m in (2, 1, 0) if m <= k + 1 and (not (g := tuple(w[k + 1 - m : k + 1])) or counts[g]))
            assert names[int(state[0])] == longest
            assert weight[0] == pytest.approx(math.log10(backoff_chance(counts, n, v, tuple(w[max(0, k - 2) : k]), word)), rel=1e-12)
    # A long text in segments walks as it does in one piece.
    long = " ".join("abcdef"[x] for x in np.random.default_rng(1).integers(0, 6, 3 * lm.SEGMENT))
    h, offsets = lm.tokens_of([long])
    grams = lm.levels(h, offsets, np.ones(len(h), dtype=np.int64), 3, {})
    machine = lm.Automaton(grams, 7, len(h), lm.STRENGTH)
    state, one = np.zeros(1, dtype=np.int64), []
    for word in grams[0].index:
        state, weight = machine.step(state.copy(), np.array([word]))
        one.append(weight[0])
    assert (machine.walk(grams[0].index, offsets, 3) == np.array(one)).all()


def test_language_model_sums_are_exact(spark):
    rng = np.random.default_rng(3)
    weights = np.concatenate([-rng.random(5000) * 8, -rng.random(200) * 1e-3, [-0.0, -7.9999999]])
    offsets = np.array([0, 1, 700, len(weights)])
    want = [math.fsum(weights[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert lm.exact_sums(lm.halves(weights), offsets).tolist() == want
    order = np.concatenate([[0], 1 + rng.permutation(699), 700 + rng.permutation(len(weights) - 700)])
    assert lm.exact_sums(lm.halves(weights[order]), offsets).tolist() == want
    # One arc taken 200,000 times: the error of a rounded weight would add up.
    n = 200_000
    row = lm.score(spark.createDataFrame([(1, "a b " * n)], "doc_id bigint, text string"), F.lit(True)).first()
    terms = {c: math.log10((c + 1) / (2 * n + 1 + 3 + 1)) for c in (n, 1)}
    assert row.base_score == pytest.approx(2 * n * terms[n] + terms[1], rel=1e-13)
    counts = Counter({("a",): n, ("b",): n, ("\0end",): 1, ("a", "b"): n, ("b", "a"): n - 1, ("b", "\0end"): 1, ("a", "b", "a"): n - 1, ("b", "a", "b"): n - 1, ("a", "b", "\0end"): 1})
    p = lambda h, w: math.log10(backoff_chance(counts, 2 * n + 1, 3, h, w))
    assert row.score == pytest.approx(p((), "a") + p(("a",), "b") + (n - 1) * (p(("a", "b"), "a") + p(("b", "a"), "b")) + p(("a", "b"), "\0end"), rel=1e-13)


def test_language_model_exchange_is_exact():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all() and len(lm.unpack_keys(lm.pack_keys(keys[:0]))) == 0
    assert (lm.unpack(lm.pack(np.array([0, 1, 255, 256, 1 << 40]))) == [0, 1, 255, 256, 1 << 40]).all()


def thue_morse(length):
    one, two = "a", "b"
    while len(one) < length:
        one, two = one + two, two + one
    return one, two


def test_words_of_one_hash_family_differ(spark):
    """Thue-Morse words, which collide under polynomials modulo a power of two, are told apart everywhere."""
    for length in (64, 1024, 4096):
        one, two = thue_morse(length)
        h, _ = word_hashes([one.encode(), two.encode(), one.upper().encode()])
        assert h[0] != h[1] and h[0] == h[2]
    one, two = thue_morse(1024)
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")
    assert {r.component_id for r in neardup.op1_near_duplicates(df).collect()} == {1, 2}
    assert {r.n_known for r in lm.score(df, F.col("doc_id") == 1).collect()} == {1, 2}
    item = spark.createDataFrame([(1, f"{one} x1 x2 x3 x4. x5 x6 x7 x8")], "item_id bigint, text string")
    texts = spark.createDataFrame([(1, f"{one} x1 x2 x3 x4. x5 x6 x7 x8"), (2, f"{two} y1 y2 y3 y4 y5")], "doc_id bigint, text string")
    assert [r.doc_id for r in decontaminate.op5_decontaminate(texts, item).collect()] == [1]


def test_secrets(docs, plain):
    def base(t):
        t, out = t or "", []
        out += [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return sorted(out)

    want = Counter((i, hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base(t)).encode()).hexdigest(), *(sum(k == x for _, k, _ in base(t)) for x in range(3))) for i, t in plain)
    rows = secrets.op3_secrets(docs).collect()
    assert Counter((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in rows) == want
    clean = secrets.redact(docs, secrets.fit(docs))
    assert clean.columns == docs.columns and clean.count() == len(plain)
    assert SECRET not in clean.where("doc_id = 900005").first().text


def test_secret_formats_among_many_ordinary_tokens(spark):
    """A few credentials get their automata however many long tokens stand around them."""
    rng = np.random.default_rng(3)
    pick = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"
    few = [f"x {y}" for _ in range(12) for y in ("AKIA" + pick(upper, 16), pick("0123456789abcdef", 32), f"password: {pick(low, 12)}")]
    many = spark.range(60_000).select(F.concat(F.lit("see /archive/section-"), F.sha2(F.col("id").cast("string"), 256).substr(1, 5), F.lit("/"), "id", F.lit("/page")).alias("text"))
    docs = spark.createDataFrame([(t,) for t in few], "text string").unionByName(many)
    grammars = secrets.fit(docs)
    assert set(grammars.formats) == {"assign", "access", "hex"}
    # A key that no base pattern finds, its first letter alone being another.
    token = "BKIA" + pick(upper, 16)
    assert grammars.gain(token) > grammars.gain("/archive/section-ab12c/345/page")
    assert secrets.redact(docs.limit(0), grammars).isEmpty()


def test_nearest(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    width = len(rows[0][1])
    rows += [(100_000 + i, rows[3][1]) for i in range(40)] + [(200_000, None), (200_050, [0.0] * width), (200_100, [float("nan")] + [1.0] * (width - 1)), (None, rows[0][1]), (200_150, [1.0, 2.0]), (200_151, [2.0, 1.0]), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, id string")
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and any(v) and not any(map(math.isnan, v))})
    want = []
    for q, a in good:
        if q % 50 == 0:
            near = []
            for i, b in good:
                if i != q and len(a) == len(b):
                    x, y = np.array(a, dtype=float), np.array(b, dtype=float)
                    near.append((-float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))), i))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in near)[:5])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op4_neighbours(df).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)], abs=1e-9)


def test_nearest_keeps_the_driver_small(spark, monkeypatch):
    """Blocks and shards may be many: the blocks' partitions and files stay as many as the shuffle's, and no neighbour is lost."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ann, "SHARD_VALUES", 160, raising=False)
    files, keep = [], ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df: [out := keep(df), files.append(len(out.inputFiles())) if "block" in df.columns else None][0])
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal((1500, 8)), np.repeat(rng.standard_normal((10, 8)), 50, axis=0) + 1e-6 * rng.standard_normal((500, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, F.col("vec_id") % 20 == 0, curves=1, window=4).collect()}
    want = {}
    for q in range(0, len(v), 20):
        score = ann.cosines(np.broadcast_to(v[q], v.shape), v)
        best = [int(i) for i in np.lexsort((np.arange(len(v)), -score)) if i != q][:5]
        want |= {(q, n + 1): i for n, i in enumerate(best)}
    assert got == want
    assert files and max(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_decontamination(docs, spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    first = bench.orderBy("item_id").first().item_id
    odd = spark.createDataFrame([(-1, None), (-2, "")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(docs, bench.select("item_id", "text").unionByName(odd)).collect()}
    assert (900_010, first) in found and not {i for i, _ in found} & {900_001, 900_002, 900_004, 900_008}
    # Brute force: every text that holds an item word for word is found.
    text_words = lambda t: " " + " ".join(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower())) + " "
    items = [(r.item_id, text_words(r.text)) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() if r.text and r.doc_id is not None for i, t in items if t in text_words(r.text)}
    assert whole <= found
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id = 900010").isEmpty()


def test_decontamination_equals_brute_force(spark, sf_dir):
    """Every item of which a passage holds enough of question and answer is found, edited copies included, and none else; scores are BM25."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text").collect()
    rng = np.random.default_rng(8)
    texts = [t for _, t in ((r.item_id, r.text) for r in bench)]
    docs = [" ".join(f"f{x}" for x in rng.integers(0, 900, 200)) for _ in range(5)]
    for item in texts[:12]:
        w = item.split()
        for share in (0.05, 0.1, 0.15, 0.25):
            edited = [f"e{rng.integers(0, 99)}" if rng.random() < share else x for x in w]
            k = int(rng.integers(0, 150))
            docs.append(" ".join([*(f"f{x}" for x in rng.integers(0, 900, k)), *edited, *(f"f{x}" for x in rng.integers(0, 900, 300 - k))]))
    docs.append(" ".join(texts[:10]))
    items = {r.item_id: decontaminate.item_parts(r.text) for r in bench}
    longest = max(decontaminate.LEAST_STRIDE, *(len(h) for h, _ in items.values()))
    width, mean, n = -(-longest // 4), sum(len(h) for h, _ in items.values()) / len(items), len(items)
    df = Counter(x for h, _ in items.values() for x in set(h.tolist()))

    def bm25(passage, h):
        tf = Counter(h.tolist())
        part = lambda x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * (decontaminate.K1 + 1) / (tf[x] + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(h) / mean))
        return sum(part(x) for x in set(passage) & set(tf))

    def shares(passage, part):
        size = min(decontaminate.GRAM, len(part))
        grams = {tuple(part[i : i + size]) for i in range(len(part) - size + 1)} if size else set()
        held = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)} if size else set()
        return len(grams & held) / len(grams) if grams else 1.0

    want = {}
    for d, t in enumerate(docs):
        h = word_hashes([t.encode()], decontaminate.PUNCTUATED)[0].tolist()
        last = max(0, -(-len(h) // width) - decontaminate.PASSAGE)
        for start in range(last + 1):
            passage = h[start * width : (start + decontaminate.PASSAGE) * width]
            for i, (whole, k) in items.items():
                q, a = shares(passage, whole[:k].tolist()), shares(passage, whole[k:].tolist())
                if q >= decontaminate.OVERLAP - 1e-9 and a >= decontaminate.OVERLAP - 1e-9:
                    want[d, i] = max(want.get((d, i), 0.0), bm25(passage, whole))
    found = decontaminate.op5_decontaminate(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), spark.createDataFrame([tuple(r) for r in bench], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(want) and len(found) == len(want) > 20
    assert all(r.bm25 == pytest.approx(want[r.doc_id, r.item_id], rel=1e-4) for r in found)


def test_decontamination_index_is_sparse_and_sharded(spark):
    """Memory follows the items' words, not terms x items; shards score as one index does."""
    texts = [" ".join(f"w{i}x{k}" for k in range(10)) + f" common word. The answer number {i} is a{i}" for i in range(4000)]
    index = decontaminate.build(list(enumerate(texts)))
    held = sum(v.nbytes for v in vars(index).values() if isinstance(v, np.ndarray))
    assert held < 100 * 20 * len(texts)
    bench = spark.createDataFrame(list(enumerate(texts[:300])), "item_id bigint, text string")
    shards = [b.value for b in decontaminate.indexes(bench, "item_id", "text", shard_words=3000)]
    whole = {i: t for i, t in zip(*(lambda x: (x.item_ids, x.thresholds))(decontaminate.build(list(enumerate(texts[:300])))), strict=True)}
    got = {i: t for x in shards if x for i, t in zip(x.item_ids, x.thresholds, strict=True)}
    assert len(shards) > 1 and got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i], rel=1e-5) for i in whole)


def test_bpe_equals_the_library(docs, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()

    def row(i, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(tuple(r) for r in bpe.op6_bpe(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == Counter(row(*x) for x in plain)
    packed = bpe.encode(docs, bpe.default_path())
    again = bpe.decode(packed.where("doc_id is not null").dropDuplicates(["doc_id"]), bpe.default_path())
    assert again.withColumnRenamed("decoded", "other").join(packed, "doc_id").where("other <> decoded").isEmpty()


@pytest.mark.parametrize(("op", "label", "bar", "least"), [(quality.op7_quality, "quality", 0.3, 0.5), (toxicity.op10_toxicity, "toxic", 0.5, 0.8)])
def test_classifiers(docs, labels, plain, op, label, bar, least):
    rows = op(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in plain)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= bar) and r.held_out == (folds(r.doc_id, 5) == 0) for r in rows)
    known = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    judged = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in judged) >= least * len(judged)
    other = op(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), labels).collect()
    by_id = lambda found: [r.score for r in sorted(found, key=lambda r: (r.doc_id or -1, r.score))]
    assert by_id(other) == pytest.approx(by_id(rows), abs=1e-6)
    if label == "toxic":
        assert not any(r.predicted for r in rows if r.doc_id in (900_001, 900_002, 900_003))


def test_classifiers_without_labels(docs, labels):
    for op in (quality.op7_quality, toxicity.op10_toxicity):
        assert op(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    odd = [(-1, None), (-2, "no scheme/com/en/"), (-3, "http://"), (-4, "HTTP://A.Example.COM/en/7x?q#f"), (-5, "x://com#/en/"), (-6, "x://notcom/en/"), (-7, "x://example.net/de/8\n/y"), (None, "x://com/en/1"), (-8, "x://org/es/a://b")]
    df = pages.unionByName(spark.createDataFrame(odd, "page_id bigint, url string")).withColumn("template", F.lit("t")).withColumn("segments", F.lit("s"))

    def want(url):
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
            host, path = lower(m[1]), m[2]
        fit = [(len(r), r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, *(max(fit)[1:] if fit else (None, None))

    asked = {r.page_id: r.url for r in df.collect()}
    got = urls.op8_urls(df).collect()
    assert Counter(r.page_id for r in got) == Counter(r.page_id for r in df.collect())
    for r in got:
        host, path, rule, verdict = want(asked[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.test/spam/{i}/x", 1) for i in range(30)] + [(100 + i, f"http://h.test/news/{i}/x", 0) for i in range(30)] + [(200, "http://h.test/spam/999/x", None), (201, "http://h.test/news/999/x", None)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, bad int"), rules=[], label_col="bad").where("page_id >= 200").collect()}
    assert got == {200: "block", 201: "allow"}


def test_url_branches_of_wide_nodes_and_deep_paths(spark):
    """Many siblings don't lend their evidence to unlabelled pages nor hide a pure branch; what lies deep counts."""
    rows = [(i, f"http://a.com/en/{i}", None) for i in range(6)] + [(100 + i, f"http://a.com/s{'abcdefghij'[i % 10]}x{i}/17", None) for i in range(80)]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, bad int"), rules=[("com/en/", "block")]).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(6))
    rows = [(1000 * k + i, f"http://h.test/{name}/{i}/x", int(k == 0)) for k, name in enumerate(["spam", *(f"news{j}" for j in range(70))]) for i in range(12)]
    rows += [(200_000 + i, f"http://h.test/{i}/about", 1) for i in range(9)] + [(210_000 + i, f"http://h.test/news{i}/about", 0) for i in range(9)]
    rows += [(300_000 + 100 * k + i, f"http://deep.test/a/b/c/d/e/{'spam' if k else 'news'}/{i}", k) for k in (0, 1) for i in range(40)]
    asked = [(-1, "http://h.test/spam/99/x", None), (-2, "http://h.test/news3/99/x", None), (-3, "http://deep.test/a/b/c/d/e/spam/77", None), (-4, "http://deep.test/a/b/c/d/e/news/77", None), (-5, "http://h.test/77/about", None), (-6, "http://h.test/news55/about", None), (-7, "http://deep.test/" + "z/" * 300, None)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows + asked, "page_id bigint, url string, bad int"), rules=[], label_col="bad").where("page_id < 0").collect()}
    assert got == {-1: "block", -2: "allow", -3: "block", -4: "allow", -5: "block", -6: "allow", -7: "allow"}


def test_urls_that_share_thousands_of_segments(spark):
    """A pair with one long way in common, and paths that each are the next one's beginning, take a few rounds of jobs."""
    way = "/".join(f"d{i}" for i in range(2000))
    rows = [(1, f"http://pair.test/{way}/x", 1), (2, f"http://pair.test/{way}/y", 0)] + [(10 + i, "http://trap.test/" + "/".join("a" * (i + 1)), 1) for i in range(800)]
    began = time.monotonic()
    got = {r.page_id: (r.verdict, r.template.count("/")) for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, bad int"), rules=[], label_col="bad").collect()}
    assert time.monotonic() - began < 90
    assert got[1][0] == got[2][0] == "allow" and got[1][1] == got[2][1] == 2000
    assert [got[10 + i] for i in range(800)] == [("block", i) for i in range(800)]


def test_licenses(docs, plain):
    word = re.compile(licenses.WORD)

    def want(i, t):
        w = word.findall(lower(t))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found = set()
        for label, x in licenses.TEMPLATES:
            need, wide = set(x.split()), licenses.width_of(x)
            most = max((len(need & set(w[k : k + wide])) for k in range(max(1, len(w) - wide + 1))), default=0) if need & set(w) else 0
            if most >= licenses.CONTAINMENT * len(need) - 1e-9:
                found.add(label)
        join = lambda x: ",".join(sorted(set(x)))
        return i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, join(x for _, x in at), join([x for _, x in at] + [*found])

    rows = licenses.op9_licenses(docs).collect()
    assert Counter(tuple(r[:7]) for r in rows) == Counter(want(*x) for x in plain)
    assert all(0 <= r.score <= 1 for r in rows)


def test_licenses_that_wrap_or_share_a_line(spark):
    """A notice cut by line breaks is found as if it stood in one line; a full match hides no other above the threshold."""
    bsd, gpl = "Redistribution and use in source and binary forms, with or without{}modification, are permitted", "you can redistribute it and/or modify{}it under the terms of the GNU General Public License"
    mit = dict((t.split()[0], t) for label, t in licenses.TEMPLATES if label == "mit")["permission"]
    filler = " ".join(f"f{i}" for i in range(200))
    texts = [bsd.format("\n"), f"{filler}\n\n * {gpl.format(chr(10) + ' * ')}\n{filler}", "\n".join(mit.split()) + "\n" + filler, mit + " licensed under the apache license version 2", f"redistribution and use in source\n{filler}\nand binary forms with or without modification are permitted", filler]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: set(r.matched) for r in licenses.scan(df).collect()} == {0: {"bsd"}, 1: {"gpl"}, 2: {"mit"}, 3: {"apache", "mit"}, 4: set(), 5: set()}
    got = {r.doc_id: (r.labels, r.score) for r in licenses.op9_licenses(df).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("gpl", 1.0), 2: ("mit", 1.0), 3: ("apache,mit", 1.0), 4: ("", 0.0), 5: ("", 0.0)}


def test_empty_tables(empty, labels, spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    for out in (neardup.op1_near_duplicates(empty), lm.op2_lm(empty), secrets.op3_secrets(empty), decontaminate.op5_decontaminate(empty, bench), bpe.op6_bpe(empty), quality.op7_quality(empty, labels), toxicity.op10_toxicity(empty, labels), licenses.op9_licenses(empty), neardup.keep_one(empty), toxicity.reject(empty, labels)):
        assert out.isEmpty()
    assert ann.op4_neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).isEmpty()
    assert urls.op8_urls(spark.createDataFrame([], "page_id bigint, url string")).isEmpty()


def test_empty_benchmark(docs, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.op5_decontaminate(docs, none).isEmpty()
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_pipeline_stages(spark, docs, sf_dir):
    import corpus_pipeline

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == now.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= now.count()
        now = spark.createDataFrame(rows, now.schema)
    assert now.where(F.col("text").contains(SECRET)).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count() == now.count()


def test_language_model_in_many_blocks(docs):
    trained = F.col("doc_id") % 3 > 0
    one = lm.score(docs, trained, order=3).collect()
    many = lm.score(docs, trained, order=3, block_chars=60_000).collect()
    order = lambda rows: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows)
    for a, b in zip(order(one), order(many), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


BIG = 2**60 + 1
CLASH = "text string, doc_id bigint, _id string, _text string, found string, mark bigint, _kept0 string, features string, packed string, template string"


def test_large_ids_beside_nulls_and_clashing_columns(spark, labels, sf_dir):
    """No operator and no stage changes an id of more than 53 bits in a batch with a null, whatever else the table holds."""
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first()
    rows = [(f"{item.text} token = \"{'0a1b' * 10}\"", i, *"abc", 5, *"defg") for i in (BIG, None, 5)] + [(None, BIG + 2, *"abc", 5, *"defg"), ("other words stand here now", BIG + 4, *"abc", None, *"defg")]
    df = spark.createDataFrame(rows, CLASH).coalesce(1)
    ids = Counter([BIG, None, 5, BIG + 2, BIG + 4])
    own = labels.unionByName(spark.createDataFrame([(BIG, 1, 0), (BIG + 4, 0, 1)], "doc_id bigint, quality int, toxic int"))
    for out in (neardup.op1_near_duplicates(df), lm.op2_lm(df), secrets.op3_secrets(df), bpe.op6_bpe(df), quality.op7_quality(df, own), toxicity.op10_toxicity(df, own), licenses.op9_licenses(df)):
        assert Counter(r.doc_id for r in out.collect()) == ids
    assert {r.doc_id for r in decontaminate.op5_decontaminate(df, table(spark, sf_dir, "benchmark").where(F.col("item_id") == item.item_id)).collect()} == {BIG, None, 5}
    packed = bpe.encode(df, bpe.default_path())
    assert Counter(r.doc_id for r in bpe.decode(packed, bpe.default_path()).collect()) == ids
    clean = secrets.redact(df, secrets.fit(df))
    assert clean.schema == df.schema and Counter(tuple(r)[1:] for r in clean.collect()) == Counter(r[1:] for r in rows)
    left = decontaminate.drop_contaminated(df, table(spark, sf_dir, "benchmark"))
    assert left.schema == df.schema and {r.doc_id for r in left.collect()} == {BIG + 2, BIG + 4}
    assert {r.doc_id for r in toxicity.reject(df, own).collect()} == set(ids)
    one = neardup.keep_one(df)
    assert one.columns == df.columns and Counter(r.doc_id for r in one.collect()) == Counter([None, 5, BIG + 2, BIG + 4])
    for out in (decontaminate.drop_contaminated(df.limit(0), table(spark, sf_dir, "benchmark")), neardup.keep_one(df.limit(0)), toxicity.reject(df.limit(0), own), secrets.redact(df.limit(0), secrets.fit(df.limit(0)))):
        assert out.columns == df.columns and out.isEmpty()


def test_one_id_with_two_texts(spark):
    """Texts that share an id are texts of their own: none vanishes but for a duplicate."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, a + " x"), (4, ""), (4, None), (4, "")], "doc_id bigint, text string")
    assert Counter(tuple(r) for r in neardup.keep_one(df).collect()) == Counter([(1, a), (1, b), (4, ""), (4, None)])
    assert {(r.doc_id, r.component_id) for r in neardup.op1_near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_curves_alone_reach_the_recall(spark, sf_dir):
    """Without the exact completion, windows over the curves' partitions find at least nine tenths of the true neighbours among 2000 vectors."""
    e = table(spark, sf_dir.rsplit("/", 1)[0] + "/sf0.1", "embeddings")
    exact = {(r.query_id, r.vec_id) for r in ann.op4_neighbours(e).collect()}
    curves = {(r.query_id, r.vec_id) for r in ann.nearest(e, F.col("vec_id") % 50 == 0, complete=False).collect()}
    assert len(exact & curves) >= 0.9 * len(exact)


def test_windows_cross_partition_edges(spark):
    """A curve cut into many partitions gives what it gives in one."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(3000)], "vec_id bigint, embedding array<double>")
    run = lambda: sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, curves=1, window=40, complete=False).collect())
    one = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            one.append(run())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one[0] == one[1]


def test_planted_secret_that_no_base_pattern_finds(spark):
    """Keys of a learned format in other surroundings are found, and the automata agree with a scorer written apart."""
    rng = np.random.default_rng(6)
    pick = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    key = lambda: "-".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 5) for _ in range(4))
    texts = [f"api_key: {key()}" for _ in range(60)] + [f"see section-{pick('abcdefghij', 9)}/part-{i} there" for i in range(200)]
    planted = [key() for _ in range(10)]
    texts += [f"the licence {k} was issued" for k in planted]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    grammars = secrets.fit(df)
    assert grammars.found > 0.8
    spans = {(r.doc_id, texts[r.doc_id][f.start : f.end]) for r in secrets.scan(df, grammars).collect() for f in r.found if f.kind == "format"}
    assert len({(260 + i, k) for i, k in enumerate(planted)} & spans) >= 8 and not [d for d, _ in spans if 60 <= d < 260]

    def apart(machine, s):
        total, state = 0.0, 0
        for c in [*s, ""]:
            to, p = machine.arcs[state].get(c, (state, -9.0))
            total, state = total + p, to if c else state
        return total / (len(s) + 1)

    for i, token in enumerate(planted):
        s = secrets.symbols(token)
        gain = max(apart(m, s) for m in grammars.formats.values()) - (apart(grammars.ordinary, s) if grammars.ordinary else -math.log(8))
        assert grammars.gain(token) == pytest.approx(gain) and (gain >= grammars.threshold) == ((260 + i, token) in spans)


@pytest.mark.parametrize("shape", ["broad", "deep"])
def test_url_verdicts_equal_a_plain_tree(spark, shape):
    """The template tree against one built with dictionaries, host by host; also with long trunks, ends on them and late forks."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(700 if shape == "deep" else 0):
        trunk = [f"a{k}" for k in range(40)] + [f"{'bc'[i % 2]}{k}" for k in range(30)] + [f"{'bc'[i % 2]}{rng.integers(0, 4)}{k}" for k in range(20)]
        parts = trunk[: int(rng.choice([rng.integers(1, 91), 90, 40, 55]))]
        label = None if rng.random() < 0.4 else int(rng.random() < (0.95 if len(parts) > 40 and i % 2 else 0.1))
        rows.append((i, f"http://h{i % 3 // 2}.test/" + "/".join(parts), label))
    rows += [(1000 + i, f"http://one{i}.test/" + "x/" * 99 + "x", 1 if i else None) for i in range(2) if shape == "deep"]
    for i in range(1500 if shape == "broad" else 0):
        host = f"h{rng.integers(0, 6)}.test"
        parts = [f"s{rng.integers(0, 5 if host != 'h1.test' else 90)}", str(rng.integers(0, 50)), f"t{rng.integers(0, 3)}"][: int(rng.integers(1, 4))]
        label = None if rng.random() < 0.4 else int(rng.random() < (0.97 if parts[0] in ("s1", "s2") or host == "h4.test" else 0.1))
        rows.append((i, f"http://{host}/" + "/".join(parts), label))
    paths = {}
    for _, url, label in rows:
        host, _, path = url[7:].partition("/")
        seg = tuple("*" if x.isdigit() else x for x in path.split("/"))
        seen = paths.setdefault((host, seg), [0, 0])
        if label is not None:
            seen[0] += 1
            seen[1] += label
    bound = math.sqrt(0.5 * math.log(2 / urls.ALPHA))
    passed = lambda bad, n, weight, given: (bad + weight * given) / (n + weight)
    purity = {}

    def add(group):
        return sum(paths[p][0] for p in group), sum(paths[p][1] for p in group)

    ends = {}

    def grow(group, depth, template, given):
        below = {}
        for p in group:
            below.setdefault(p[1][depth] if depth < len(p[1]) else None, []).append(p)
        n, bad = add(group)
        named = [s for s in below if s is not None]
        go = {}
        for s, part in below.items():
            if s is None or len(group) == 1:
                for p in part:
                    ends.setdefault((p[0], template + p[1][depth:]), []).append((p, given))
                continue
            m, worse = add(part)
            if m >= urls.MIN_LABELLED and len(named) > 1 and abs(worse / m - bad / n) < bound * (m**-0.5 + n**-0.5):
                s = urls.SIMILAR
            go.setdefault(s, []).extend(part)
        for s, part in go.items():
            m, worse = add(part)
            grow(part, depth + 1, (*template, s), passed(worse, m, urls.BACKOFF, given))

    for host in {h for h, _ in paths}:
        group = [p for p in paths if p[0] == host]
        n, bad = add(group)
        grow(group, 0, (), passed(bad, n, urls.BACKOFF, 0.5))
    for part in ends.values():
        n, bad = add([p for p, _ in part])
        for p, given in part:
            purity[p] = passed(bad, n, urls.PRIOR, min(g for _, g in part))
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, bad int"), rules=[], label_col="bad").collect()
    by_id = {r.page_id: r for r in got}
    for i, url, label in rows:
        host, _, path = url[7:].partition("/")
        want = purity[host, tuple("*" if x.isdigit() else x for x in path.split("/"))]
        assert by_id[i].purity == pytest.approx(want)
        assert by_id[i].verdict == ("block" if want >= urls.REJECT else "allow")
    free = Counter(by_id[i].verdict for i, _, label in rows if label is None)
    assert free["block"] and free["allow"]


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_operators_equal_their_sql(spark, sf_dir, name):
    assert not difference(queries.QUERIES[name](spark, sf_dir), oracles.ORACLE_SQL[name], sf_dir)


def test_near_duplicate_stage_of_the_pipeline_is_brute_force(spark, sf_dir):
    """Of the stages that brute force can express: duplicates, decontamination and redaction decide as it does, on what came before."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in rows.items()}
    low = {i: i for i in rows}
    changed = True
    links = [(a, b) for a in rows for b in rows if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    kept = stages["near_duplicates"](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in rows if low[i] == i)
    clean = stages["secrets"](spark, docs, sf_dir).collect()
    for r in clean:
        assert not secrets.base_spans(r.text or "") and r.n_chars == len(r.text or "")
        if not secrets.base_spans(rows[r.doc_id]) and not re.search(r"[A-Za-z0-9+/_=-]{16,}", rows[r.doc_id]):
            assert (r.text or "") == rows[r.doc_id]
