"""Collocations, piece encoding and whitening against brute force, on small tables with nulls, ties, repeats and long texts."""

import random
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import bidiagonal, collocations, pieces, whitening

TEXTS = "doc_id long, text string, lang string, n long, words int, part long, ids string, rank int"


def _rows(texts):
    return [(None if i == 4 else i % 90, t, lang, 1, 2, 3, "x", 4) for i, (t, lang) in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    some = [f"w{i}" for i in range(12)] + ["Größe", "x.y", "a\tb", "中文", "İ"]
    out = [(None, "en"), ("", None), (" \t\n", "en"), ("zzz " * 30_000, "de"), ("the Same line again, " * 50, "en")]
    for i in range(300):
        words = [rng.choice(some) for _ in range(rng.randrange(1, 60))]
        out.append((" ".join(w + rng.choice(["", "", "", ",", ".", "\n", "  "]) for w in words), rng.choice(["en", "en", "de", None, "und"])))
    return out + out[10:14]


def _brute(texts, support, longest, top):
    low = {c: c + 32 for c in range(65, 91)}
    total, found = Counter(), Counter()
    for text, lang in texts:
        piece, lang = [], lang or "und"
        t = (text or "").translate(low)
        for stop in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(stop, "\n")
        for piece in t.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    found[lang, tuple(ws[i: i + k])] += 1
    frequent = {p: a for p, a in found.items() if a >= support}
    out = []
    for lang in total:
        mine = {p: a for (l, p), a in frequent.items() if l == lang}
        covered = set()
        for p, a in mine.items():
            for k in range(1, len(p)):
                covered |= {p[i: i + k] for i in range(len(p) - k + 1) if a >= mine[p[i: i + k]]}
        rows = []
        for p, a in mine.items():
            if len(p) > 1 and p not in covered:
                score, k = min((1000 * a * total[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
                rows.append((lang, " ".join(p), a, mine[p[:k]], mine[p[k:]], total[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows[:top])]
    return out


@pytest.mark.parametrize("support,longest,top,shards", [(12, 5, 2000, 16), (3, 3, 40, 2), (60, 5, 2000, 1), (500, 4, 10, 40)])
def test_collocations_against_brute_force(spark, texts, support, longest, top, shards):
    docs = spark.createDataFrame(_rows(texts), TEXTS).repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, support, longest, top, shards).collect()]
    assert sorted(got) == sorted(_brute(texts, support, longest, top))


def test_full_filters_and_slices(spark, texts, monkeypatch):
    """A filter that is full and slices of long texts change nothing."""
    docs = spark.createDataFrame(_rows(texts), TEXTS).repartition(3)
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    assert sorted(map(tuple, collocations.collocations(docs, 12, shards=3).collect())) == sorted(_brute(texts, 12, 5, 2000))
    text = ("abc, DEF  g\t" * 2000).encode()
    monkeypatch.setattr(collocations, "_SLICE", 50)
    parts = list(collocations._words(text))
    assert len(parts) > 100 and sum(parts, []) == [b"abc", b".", b"def", b"g"] * 2000


def test_collocations_without_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], TEXTS)).count() == 0
    assert collocations.collocations(spark.createDataFrame(_rows([(None, None), ("", "en")]), TEXTS)).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model())


def test_pieces_equal_the_library(library):
    model = pieces.PieceModel(pieces.piece_model(), limit=200)
    rng = random.Random(5)
    some = ["a", "b", "the", "in", "er", "▁", " ", "  ", "\n", "\t", "é", "中", "𝄞", "\x00", "1", "'", "́", "<0x0A>", "<s>", "<unk>", "​"]
    chars = sorted({c for p in model.ids for c in p})
    for i in range(4000):
        t = "".join(rng.choice(some) if rng.random() < 0.6 else rng.choice(chars) for _ in range(rng.randrange(25)))
        if i % 3 == 0:
            t = "".join(rng.choice("aetinorsh ▁") for _ in range(40))
        if i % 7 == 0:
            t = " " * rng.randrange(60) + t + " " * rng.randrange(60)
        if i % 11 == 0:
            t = "".join(rng.choice(model.pieces[259:]) for _ in range(8))
        ids = np.frombuffer(model.encode(t), "<i4").tolist()
        assert ids == library.encode(t), t
        assert model.decode(ids) == library.decode(ids), t
    for _ in range(500):
        ids = [rng.randrange(rng.choice([260, 32000])) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_texts_take_linear_time(library):
    model = pieces.PieceModel(pieces.piece_model())
    rng = random.Random(6)
    t = "x" * 50_000 + " " * 30_000 + "中" * 20_000 + "".join(rng.choice("abcdefgh") for _ in range(60_000))
    assert np.frombuffer(model.encode(t), "<i4").tolist() == library.encode(t)


def test_piece_operators(spark, texts, library):
    docs = spark.createDataFrame(_rows(texts), TEXTS)
    got = pieces.encode_texts(docs, pieces.piece_model(), decoded=True)
    want = Counter((r[0], tuple(library.encode(r[1] or "")), library.decode(library.encode(r[1] or ""))) for r in _rows(texts))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got.collect()) == want
    again = pieces.decode_ids(got.select("doc_id", "ids"), pieces.piece_model())
    assert Counter(map(tuple, again.collect())) == Counter((d, t) for d, _, t in want.elements())
    assert pieces.encode_texts(spark.createDataFrame([], TEXTS), pieces.piece_model()).count() == 0


def test_qd_solver_against_dense_values():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    cases = [np.eye(9), np.zeros((4, 4)), np.array([[3.0]]), np.ones((8, 8)), np.diag([3.0] * 5 + [1.0] * 4), q @ np.diag(10.0 ** -np.arange(40)) @ q.T,
             q @ np.diag([5.0] * 3 + [4.0] * 3 + [3.999999] + list(np.linspace(3, 1e-9, 33))) @ q.T, np.diag(np.abs(np.arange(21) - 10.0) + 0.1) + np.diag(np.ones(20), 1)]
    for i in range(120):
        n = int(rng.integers(1, 14))
        a = rng.standard_normal((n, n)) * 10.0 ** rng.integers(-6, 6, n)
        cases.append(np.round(a) if i % 3 == 0 else a)
    for a in cases:
        values, vectors = bidiagonal.leading_directions(a, min(8, len(a)))
        want = np.linalg.svd(a, compute_uv=False) ** 2
        assert np.abs(values - want).max() <= 1e-11 * max(want[0], 1e-300)
        w = vectors[:, vectors.any(0)]
        assert np.abs(w.T @ w - np.eye(w.shape[1])).max(initial=0) < 1e-9
        assert np.abs(a.T @ (a @ w) - w * values[: w.shape[1]]).max(initial=0) <= 1e-11 * max(want[0], 1e-300)


def test_small_singular_values_are_relatively_accurate():
    """A graded bidiagonal matrix fixes its small singular values to full relative accuracy; dense methods lose them."""
    a, b = 10.0 ** -np.arange(0, 16.0), 10.0 ** -np.arange(1, 16.0)
    from fractions import Fraction as Q

    n, q, e = 16, [Q(x) ** 2 for x in a.tolist()], [Q(x) ** 2 for x in b.tolist()]

    def above(x):  # how many squared values exceed x: signs of the pivots of B'B - x
        count, s = 0, -x
        for i in range(n):
            d = s + q[i]
            count += d > 0
            s = e[i] / d * s - x if i < n - 1 else 0
        return count

    for k, value in enumerate(bidiagonal.qd_values(a, b)):
        v = Q(float(value))
        assert above(v * (1 - Q(1, 10**12))) >= k + 1 and above(v * (1 + Q(1, 10**12))) <= k


VECTORS = "vec_id long, embedding array<double>, label int, n long, whitened string"


def _vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((400, 5)) @ np.diag([3.0, 2.0, 1.0, 0.5, 0.2])
    rows = [(i, v.tolist(), None, 1, "x") for i, v in enumerate(base)]
    rows += [rows[0], rows[0], (None, base[1].tolist(), 1, 1, "x"), (7, [1.0, 2.0], 1, 1, "x")]
    return rows + [(900, None, 1, 1, "x"), (901, [1.0, None, 1.0, 1.0, 1.0], 1, 1, "x"), (902, [1.0, float("nan"), 1.0, 1.0, 1.0], 1, 1, "x"), (903, [float("-inf")] * 5, 1, 1, "x")]


def test_whitening_against_numpy(spark):
    rows = _vectors()
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(40), components=8).collect()
    kept = [r for r in rows if r[0] is None or r[0] < 900]
    c = np.array([r[1] + [0.0] * (5 - len(r[1])) for r in kept])
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    values, u = np.linalg.eigh(np.cov(x.T, bias=True))
    w = np.abs((x - total / n) @ u[:, ::-1] / np.sqrt(values[::-1]))
    want = Counter((r[0], int(d)) for r, d in zip(kept, ((n * x - total) ** 2).sum(1)))
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == want
    by = {int(d): row for d, row in zip(((n * x - total) ** 2).sum(1), w)}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert np.abs(np.abs(r["whitened"]) - by[r["deviation"]]).max() < 1e-9
        assert np.allclose(r["explained"], values[::-1] / values.sum(), rtol=1e-9)


def test_whitening_edge_cases(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1, "x")], VECTORS)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1, 1, "x") for i in range(4)], VECTORS)).collect()
    assert all(r["deviation"] == 0 and r["whitened"] == [0.0, 0.0] and r["explained"] == [0.0, 0.0] and r["identity_error"] == 0.0 for r in same)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1, 1, "x") for i in range(9)], VECTORS)).collect()
    assert all(r["whitened"][1:] == [0.0, 0.0] and abs(r["explained"][0] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in flat)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300], 1, 1, "x"), (2, [-1e300], 1, 1, "x"), (3, [], 1, 1, "x")], VECTORS)).collect()
    assert len(huge) == 3 and all(r["deviation"] is None or r["vec_id"] == 3 for r in huge)


def test_repeated_ids_keep_the_links_of_all_their_texts(spark):
    from tickloom.llm.neardup import near_duplicates

    one, two = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, one), (1, two), (2, one), (3, two), (4, two + " s"), (5, "u v w x y z a b"), (6, one + " z z z z z z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)}


def test_pipeline_stages_on_a_planted_table(spark, tmp_path):
    """Toxic texts go, repeated lines and near copies go, the rest stays, whatever other columns are called."""
    import corpus_pipeline as cp

    rng = random.Random(4)
    clean = [a + b + c for a in "bcdfghkl" for b in "aeiou" for c in "mnprstvwxz"]
    texts, toxic = [], []
    for i in range(240):
        bad = i % 4 == 0
        sentences = [" ".join(rng.choice(clean) for _ in range(12)) + "." for _ in range(6)]
        if bad:
            sentences[rng.randrange(6)] = " ".join(["vile", "scum", "curse"] + [rng.choice(clean) for _ in range(6)]) + "."
        texts.append(" ".join(sentences))
        toxic.append(int(bad))
    line = "this very line of boilerplate is repeated in many documents"
    for i in (1, 2, 3, 5, 6, 7):
        texts[i] += "\n" + line
    texts.append(texts[9] + " tail")
    texts.append(texts[10])
    texts += [None, ""]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, position string, tox_score double, tox_spans string, __text string, n_dropped int"
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 7, "p", 0.9, "s", "t", 3) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == schema.replace(",", "").split()[::2]
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], schema)
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert kept == {i for i in range(len(texts)) if i >= 240 or not toxic[i]}
    by = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert by.keys() == kept and [i for i in (1, 2, 3, 5, 6, 7) if line in by[i]] == [7]
    assert all((by[i] or "") == (texts[i] or "") for i in kept - {1, 2, 3, 5, 6})
    assert {r["doc_id"] for r in seen["near_dedup"]} == kept - {240, 241}
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in seen["near_dedup"]}
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    sources = {s: sum(n for i, n in size.items() if i % 3 == int(s[1])) for s in ("s0", "s1", "s2")}
    # Weights 5, 2, 1; the first source wants more than three times its size nowhere here, so targets are plain shares.
    for s, w in (("s0", 5), ("s1", 2), ("s2", 1)):
        taken = sum(size[i] * n for i, n in copies.items() if i % 3 == int(s[1]))
        assert abs(taken - sum(sources.values()) * w / 8) <= max(size.values()) and taken <= 3 * sources[s]
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(copies) and max(r["offset"] + r["length"] for r in packed) <= 2048
