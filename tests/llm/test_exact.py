"""Whitening, divergence of sources and repeated strings against plain Python."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from mesostate.llm import divergence, parsing, whitening

# op11 -------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, whitened string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, 0, "x") for k, v in enumerate(rows)], VECTORS).repartition(parts)


def whole(rows):
    return [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows]


def test_cross_products_are_exact():
    r = np.random.default_rng(1)
    for bits, n in ((1, 7), (12, 1000), (61, 300)):
        x = r.integers(0, 1 << bits, (n, 5)).astype(np.uint64)
        x[:, 3] = 0
        plain = x.astype(object).T @ x.astype(object)
        found = whitening.cross_products(x)
        assert all(found[i][j] == plain[i, j] for i in range(5) for j in range(i, 5))


def test_whitening_against_fractions(spark):
    r = np.random.default_rng(2)
    rows = [[float(np.float32(c)) for c in v] for v in r.normal(size=(400, 6)) * [1, 1, 30, 0.5, 2000, 1] + [0, 5e4, 0, -7, 0, 0]]
    rows += rows[:50]
    x = whole(rows)
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3)) for j in range(6)] for i in range(6)])
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    found = whitening.whitened(vectors(spark, rows)).toPandas().sort_values(["vec_id", "component"])
    assert found.columns.tolist()[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert set(found["n"]) == {n} and len(found) == 6 * len(rows)
    assert found["deviation"].tolist()[::6] == [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    z = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in x]) @ vectors_ / np.sqrt(values)
    w = found["whitened"].to_numpy().reshape(-1, 6)
    assert np.abs(w * np.sign((w * z).sum(axis=0)) - z).max() < 1e-6
    assert np.allclose(found["explained"].to_numpy()[:6], values / values.sum(), rtol=1e-9)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_small_variances_beside_large_ones(spark):
    r = np.random.default_rng(3)
    rows = [[float(c) for c in v] for v in r.normal(size=(500, 4)) * [1e7, 1, 1, 1e4]]
    found = whitening.whitened(vectors(spark, rows)).toPandas()
    assert found["component"].max() == 4 and found["identity_error"].iloc[0] < 1e-4
    wide = whitening.whitened(vectors(spark, [[1e12 * k * k] for k in range(500)])).toPandas()
    assert wide["deviation"].isna().any() and wide["exact_deviation"].notna().all()


def test_what_whitening_leaves_out(spark):
    inf = float("inf")
    rows = [None, [], [1.0, None], [float("nan"), 1.0], [inf, 0.0], [-inf, 0.0], [3e38, 0.0], [0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [2.0, 2.0]]
    found = whitening.whitened(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in found) == [(7, 1), (8, 1), (9, 1), (10, 1)]  # one dimension of variance
    assert {r["n"] for r in found} == {3}
    assert whitening.whitened(vectors(spark, [[1.0, 2.0]] * 4)).count() == 0
    assert whitening.whitened(vectors(spark, [[1.0]]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        whitening.whitened(vectors(spark, [[1.0], [1.0, 2.0]]))


# op12 -------------------------------------------------------------------------------------------------------------


def plain_audit(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups, texts, langs = {}, Counter(), {}
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        lang, source = lang or "", source or ""
        groups.setdefault((lang, source), Counter()).update(terms)
        langs.setdefault(lang, Counter()).update(terms)
        texts.update((lang, t) for t in set(terms))
    out = []
    kept = {lang: sorted(t for t in c if texts[lang, t] >= 3) for lang, c in langs.items()}

    def share(lang, c):
        n = sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept[lang])) for t in kept[lang]}

    p = {g: share(g[0], c) for g, c in groups.items()}
    for lang, source in groups:
        pairs = [(sum((p[lang, source][t] - q) ** 2 // q for t, q in p[lang, o].items()), o) for x, o in groups if x == lang and o != source]
        q = share(lang, langs[lang])
        terms = [((p[lang, source][t] - q[t]) ** 2 // q[t], t) for t in kept[lang] if groups[lang, source][t] and p[lang, source][t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def audit_rows():
    r = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["É", "日本", "Ab", "aB", "x y"]
    rows = [(None, None, None), ("", "en", "empty"), ("123 -- 4", "en", "no terms"), ("only here", "xx", "a"), ("", "xx", "b")]
    for k in range(240):
        source = "s0" if k % 3 == 0 else r.choice(["s1", "s2", "S3", "é"])
        rows.append((r.choice([" ", "-", "\n"]).join(r.choices(words, [1 / (j + 1) for j in range(len(words))], k=r.randint(0, 120))), r.choice(["en", "de", None]), source))
    return rows + rows[5:25]


def test_divergence_against_plain_python(spark):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, rank int, term string").repartition(5)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_blocks_of_the_index_add_up(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = audit_rows()
        assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect())) == plain_audit(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shares_of_large_counts(spark):
    n, total = 7 * 10**15, 9 * 10**15
    found = spark.range(1).select(divergence.probability(divergence.F.lit(n).cast("long"), divergence.F.lit(total).cast("long"))).first()[0]
    assert found == 1 + 10**9 * (n + 1) // total


# op13 -------------------------------------------------------------------------------------------------------------


def plain_cut(texts):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in bodies for k in range(len(b) - 199))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        starts = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repetitive_texts(seed):
    r = random.Random(seed)
    draw = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    pool = [draw(r.randint(150, 700), "abcdefgh ") for _ in range(10)] + [draw(r.randint(200, 500), "ab") for _ in range(3)]
    pool += ["a" * r.randint(100, 900), "ab" * r.randint(100, 400), "the same line again and again\n" * r.randint(3, 30)]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "y" * 200]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(0, 6)):
            kind, p = r.random(), r.choice(pool)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            parts.append(p if kind < 0.4 else p[a:b] if kind < 0.6 else draw(r.randint(1, 300), "abcdefghij é日"))
        texts.append("".join(parts))
    return texts + r.sample(texts, 20)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_repeats_against_plain_python(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(parsing, "PIECE", piece)
    texts = repetitive_texts(seed)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int, places string").repartition(1 + 3 * seed)
    assert [tuple(r)[1:] for r in parsing.deduplicated(df, digest=True).orderBy("doc_id").collect()] == plain_cut(texts)


def test_kept_bytes(spark):
    r = random.Random(5)
    twice, once = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (300, 500))
    df = spark.createDataFrame([(1, once[:250] + twice), (2, twice + once[250:]), (None, "short")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in parsing.deduplicated(df).collect()}
    assert bytes(found[1]["kept"]).decode() == once[:250] and bytes(found[2]["kept"]).decode() == once[250:]
    assert (found[1]["n_removed"], found[1]["n_spans"], bytes(found[None]["kept"])) == (300, 1, b"short")


def test_a_text_of_twenty_megabytes():
    r = random.Random(6)
    text = r.randbytes(10_000_000).hex()
    text = text[:19_000_000] + text[100:400] + text[19_000_000:]
    rows = list(parsing._parsed(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.encode()])], ["doc", "tag", "text"])])))
    place = np.concatenate([b.column("place").to_numpy() for b in rows])
    start, n, *_, flags = parsing.unpacked(place)
    starts = start[(flags & parsing.CLASS) == 0]
    assert n[(flags & parsing.CLASS) == 0].sum() == len(text) - 199 and starts.max() < len(text)


def test_texts_that_share_half_a_key_stay_apart():
    place = parsing.packed(*(np.array([v, v]) for v in (5, 6, 7)), np.array([3, 4]), np.array([0, 0]))
    assert [x.tolist() for x in parsing.unpacked(place)] == [[5, 5], [6, 6], [7, 7], [3, 4], [0, 0]]
