"""The audit of filters, vector codes and pieces against brute force and the library, with every awkward row."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference
from quillstone.llm import audit, codes, oracles, pieces, queries
from quillstone.llm.common import table

BIG = (1 << 61) + 1
DOCS = "doc_id bigint, text string, lang string, n bigint, part string, good string, id string, digest string, spread string, `a.b` string"


# --- operator 11 ---


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    return out + "C" * (100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)


def plain_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    told = []
    for i, text, lang in rows:
        copy = i is not None and first[text or ""] < i
        told.append((lang or "", fails(text or "") + "E" * copy, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {t[0] for t in told}:
        for order in map("".join, permutations("ABCDE")):
            left = [t for t in told if t[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [t for t in left if f in t[1]]
                left = [t for t in left if f not in t[1]]
                out[part, order, step] = [len(left), len(now), sum(f in t[1] for t in gone), sum(t[0] == part and t[1] == f for t in told), sum(t[2] for t in now), sum(t[3] for t in now)]
                gone += now
                shapley[part, f] += len(now)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def random_texts(n):
    rng = random.Random(5)
    kinds = [
        lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 99, 100, 130]))),
        lambda: " ".join("same other"[: rng.choice([4, 10])] for _ in range(120)),
        lambda: "LOUD " * rng.choice([20, 100]) + "x" * rng.randrange(60),
        lambda: " ".join(f"u{k}" for k in range(105)) + rng.choice([" #", " é ü", " wide\x0b\x1cx", " &|"]),
    ]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.fixture(scope="module")
def audited(spark):
    rng = random.Random(6)
    texts = random_texts(120)
    rows = [(rng.randrange(300), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(400)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), (7, texts[0], "en"), (7, texts[0], "fr"), (BIG, None, "en"), (BIG + 1, "", "en"), (BIG + 2, "a b " * 60_000, "en"), (BIG + 2, "a b " * 60_000, "en")]
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(250)] + [(None, 1, 1), (BIG, 1, None), (BIG, 0, 1), (BIG, 1, 1)]
    df = spark.createDataFrame([(i, t, lang, 1, "p", "g", "i", "d", "s", "x") for i, t, lang in rows], DOCS).repartition(3)
    return rows, labels, df, spark.createDataFrame([(*x, "en", 3) for x in labels], "doc_id bigint, quality int, toxic int, lang string, n int")


def test_audit_equals_brute_force(audited):
    rows, labels, df, label_df = audited
    got = audit.op11_audit(df, label_df).collect()
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})
    assert {tuple(r) for r in got} == plain_audit(rows, labels)
    assert sum(r.toxic_lost for r in got) and sum(r.good_lost for r in got) and sum(r.redundant for r in got)


def test_audit_of_hot_copies(spark):
    """A text that fills most of the table is a few rows where copies are told, and all copies but the first are counted."""
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("own "), "id")).otherwise("the same").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = {(r.filter_order, r.step): r for r in audit.op11_audit(df, labels).collect()}
    assert rows["EABCD", 1].removed == 2 * n // 3 - 1 and rows["EABCD", 2].removed == n // 3 + 1 and rows["EABCD", 1].good_lost == 0
    assert rows["ABCDE", 1].removed == n and rows["ABCDE", 5].redundant == 2 * n // 3 - 1 and rows["ABCDE", 1].good_lost == 1


def test_audit_empty_and_without_labels(spark, audited):
    _, _, df, labels = audited
    assert audit.op11_audit(df.limit(0), labels).isEmpty()
    assert not audit.op11_audit(df, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").count()


# --- operator 12 ---

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, codes string, ints string, keep0 string, error string"


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Every part against every entry, in Python's integers."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, v + [0] * (parts * wide - len(v)), label) for i, v, label in kept]
    cut = lambda v: [tuple(v[p * wide : (p + 1) * wide]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [[min((far(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _ in kept]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            of = defaultdict(list)
            for (_, v, _), near in zip(kept, found, strict=True):
                of[near[p][1]].append(cut(v)[p])
            for e, xs in of.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    found = assign()
    errors = [sum(d for d, _ in near) for near in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in near), err, by_label[label], sha) for (i, _, label), near, err in zip(kept, found, errors, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "i", "c", "n", "k", "e") for r in rows], VECTORS).repartition(3)


def result(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.op12_codes(df).collect())


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=16).tolist(), int(rng.integers(3))) for i in rng.permutation(420)]
    # On a coarse grid many distances and many entries are equal.
    rows += [(1000 + i, (rng.integers(-2, 3, 16) / 1024).tolist(), None) for i in range(150)]
    odd = [(3, None, 1), (4, [None] * 16, 1), (5, [float("nan")] * 16, 1), (6, [1.0] * 15 + [float("inf")], 2), (None, [0.5] * 16, None), (None, [0.25] * 16, None), (BIG, [-0.0] * 16, 9), (7, [0.125] * 16, 1), (7, [0.125] * 16, 1), (7, [-0.125] * 16, 1), (8, [2.0], 1), (9, [], 1)]
    got = result(vectors(spark, rows + odd))
    assert sum(got.values()) == len(rows) + 8
    assert got == plain_codes(rows + odd)


def test_codes_of_few_rows_and_large_components(spark):
    few = [(i, [i / 7, 1.0, -1.0, i / 3, 0.1], i % 2) for i in range(9)]
    assert result(vectors(spark, few)) == plain_codes(few)
    large = [(i, [1e7 * (i % 5), -3e9, 2.0**40, 0.5 * i, 1.0, 1.0, 1.0, 1e-3], 1) for i in range(300)]
    assert result(vectors(spark, large)) == plain_codes(large)
    assert result(vectors(spark, [(1, [3e38, -3e38], 1), (2, [0.0, 0.0], 1)]))
    assert codes.op12_codes(vectors(spark, few).limit(0)).isEmpty()
    assert codes.op12_codes(vectors(spark, [(1, None, 1)])).isEmpty()


def test_exponion_search_scans_less_and_finds_all():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (64, 8))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-100, 101, (3000, 8))
    book = codes.Codebook.of(np.concatenate([centres, centres[:5]]))
    apart = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    want = apart.argmin(axis=1)
    for start in (np.zeros(3000, dtype=int), want, rng.integers(0, 69, 3000)):
        best, distance = book.nearest(x, start)
        assert (best == want).all() and (distance == apart.min(axis=1)).all()
    # From the nearest entry on, the front of its list is short.
    u = apart.min(axis=1)
    fronts = [np.searchsorted(book.distances[a], 4 * d, side="right") for a, d in zip(want, u, strict=True)]
    assert np.mean(fronts) < 10


def test_codes_restore(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(300)]
    coded, books = codes.compress(vectors(spark, rows), entries=16, rounds=2)
    back = {r.id: r.vector for r in codes.restore(coded, books).collect()}
    for r in coded.collect():
        assert sum((a * 1024 - b) ** 2 for a, b in zip(back[r.id], r.ints, strict=True)) == r.error
    assert all(max(r.codes) < 16 for r in coded.collect())


# --- operator 13 ---


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.default_path())


def odd_texts():
    rng = random.Random(7)
    alphabet = [*"abcdeABC   \t\n.,'09", "é", "ß", "İ", "é", "中", "文", "語", "あ", "한", "😀", " ", "▁", "▁▁", "\x00", "�", "<s>", "</s>", "<0x41>", "<unk>", "the", "ing", "‮", "🏳️‍🌈"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    return [*out, "", " ", "  ", " " * 5000, "a" * 3000, "ab" * 4000, "中文" * 900, "word " * 40_000, "x▁y ▁z", "\n\n\n", "  lead", "trail  "]


def test_pieces_equal_the_library(spark, sf_dir, library):
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").collect()] + odd_texts() + [None]
    df = spark.createDataFrame([(i, t, "p", "d") for i, t in enumerate(texts)] + [(None, "no id", "p", "d"), (BIG, "big", "p", "d"), (BIG, "big", "p", "d")], "doc_id bigint, text string, ids string, decoded string").repartition(3)
    rows = df.select("doc_id", "text").collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in pieces.op13_pieces(df).collect()) == want
    packed = pieces.encode(df, pieces.default_path())
    assert Counter(tuple(r) for r in pieces.decode(packed, pieces.default_path()).collect()) == Counter((i, library.decode(library.encode(t or ""))) for i, t in rows)
    assert pieces.op13_pieces(df.limit(0)).isEmpty()


def test_pieces_decode_any_ids(spark, library):
    rng = random.Random(3)
    byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    known = [0, 1, 2, library.piece_to_id("▁"), library.piece_to_id("▁the"), library.piece_to_id("▁▁"), library.piece_to_id("ing"), library.piece_to_id("é")]
    lists = [[rng.choice([rng.choice(known), rng.choice(byte_ids), rng.randrange(len(library))]) for _ in range(rng.randrange(0, 8))] for _ in range(3000)]
    df = spark.createDataFrame([*enumerate(lists), (-1, None), (-2, [known[4], None, 40_000, -5])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in pieces.decode(df, pieces.default_path()).collect()}
    assert got.pop(-1) == "" and got.pop(-2) == "the"
    assert [got[i] for i in range(len(lists))] == [library.decode(ids) for ids in lists]


def test_pieces_check_finds_a_difference(spark, tmp_path):
    """A batch that isn't encoded as the library does ends the job."""
    df = spark.createDataFrame([(1, "the thing")], "doc_id bigint, text string")
    path, bad = pieces.default_path(), tmp_path / "other.model"
    with open(path, "rb") as f:
        bad.write_bytes(f.read().replace(b"\xe2\x96\x81the", b"\xe2\x96\x81thq", 1))
    assert pieces.encode(df, path, check_path=path).count() == pieces.encode(df, str(bad), check_path=str(bad)).count() == 1
    with pytest.raises(Exception, match="not as the sentencepiece library"):
        pieces.encode(df, str(bad), check_path=path).collect()


def test_pieces_refuse_other_models(tmp_path):
    path = tmp_path / "m.model"
    for data in (b"", b"\x12\x02\x18\x01"):  # nothing; a unigram model
        path.write_bytes(data)
        with pytest.raises(ValueError):
            pieces.Model.read(str(path))


@pytest.mark.parametrize("name", ["op11_audit", "op12_codes"])
def test_new_operators_equal_their_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), oracles.ORACLE_SQL[name], sf_dir) == ""
