"""Corpus operators on edge cases, against brute force and on round trips."""

import random

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from mesostate.llm import bpe, catalogue, decontamination, langid, licenses, passages, pii, quality, records, sharding, simhash
from mesostate.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, u long"
WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGE = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", 0, "x", 1),
    (3, " \n\t ", None, None, 3, None, None),
    (4, prose(1, 120), "en", "a", 1, "x", 1),
    (5, prose(1, 120), "en", "a", 1, "x", 1),
    (5, prose(1, 120), "en", "a", 1, "x", 1),
    (None, prose(2, 80), "fr", "b", 1, "x", 1),
    (7, prose(3, 30_000), "fr", "b", 1, "x", 1),
    (8, "x" * 3000 + " é日本 mail a@b.c", "de", "b", 1, "x", 1),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = {}
    for name, rows in (("edge", EDGE), ("empty", [])):
        d = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, prose(1, 120)[:150]), (2, None), (3, ""), (4, "two words")] if rows else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        vectors = [(1, None, 1), (2, [], 1), (None, [0.5, 1.0], 1), (4, [0.5, None], 1), (5, [float("nan"), 1.0], 1), (6, [2.0, -1.0], 1), (6, [2.0, -1.0], 1), (7, [-3.0, 0.25], None)]
        spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, component int").write.parquet(f"{d}/embeddings.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_edge_rows(spark, folder, name):
    rows = catalogue.QUERIES[name](spark, folder["edge"]).collect()
    if name not in ("op4_passages", "op10_decontamination", "op11_whitening", "op12_divergence"):
        assert len(rows) == len(EDGE)
    assert catalogue.QUERIES[name](spark, folder["empty"]).count() == 0


def test_pipeline_on_edge_rows(spark, folder):
    found = corpus_pipeline.run(spark, folder["edge"]).collect()
    # 4 and 5 hold the benchmark item, 8 has too few words
    assert {r["doc_id"] for r in found} == {None, 7} and all(r["intact"] for r in found)
    assert corpus_pipeline.run(spark, folder["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]}) q").fetchall()))


def test_simhash_components_are_exact(spark):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(30)]
    fps = {c for m in centres for c in [m, *(m ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(12))]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["fp"]: r["root"] for r in simhash.clusters(spark.createDataFrame([(f,) for f in signed], "fp long").cache()).collect()}
    values, parent = np.array(sorted(fps), np.uint64), list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 4):
            parent[root(int(b))] = root(a)
    seen = {}
    for k, v in enumerate(values.tolist()):
        assert seen.setdefault(root(k), got[v - (1 << 64) if v >> 63 else v]) == got[v - (1 << 64) if v >> 63 else v]
    assert len(set(got.values())) == len(seen)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(k, 0) for k in range(1, 41)} | {(101, 100)}


def test_compact_windows_are_the_cartesian_tree():
    values = np.random.default_rng(3).integers(0, 1 << 63, 300).astype(np.uint64)
    want = set()
    for c in range(300):
        left = right = c
        while left and values[left - 1] > values[c]:
            left -= 1
        while right < 299 and values[right + 1] > values[c]:
            right += 1
        if right - left + 1 >= 20:  # runs of 20 inside the node's range that hold c
            want.add((c, max(left, c - 19), min(right, c + 19) - 19))
    found = passages.compact_windows(values, np.zeros(281, np.int64), 20)
    assert set(zip(*(x.tolist() for x in found), strict=True)) == want


def test_shared_passage_is_found(spark):
    shared = prose(9, 60)
    docs = [(1, f"{prose(10, 90)} {shared} {prose(11, 70)}"), (2, f"{prose(12, 40)} {shared}"), (3, prose(13, 200)), (4, None)]
    found = passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["rep_doc_id"]) for r in found] == [(2, 1)]


def passage_pairs(spark, docs):
    return {(r["doc_id"], r["rep_doc_id"]) for r in passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_passage_with_frequent_lines_is_found(spark):
    words = lambda tag, n: " ".join(f"{tag}x{k}" for k in range(n))
    docs, want = [], set()
    for t in range(30):
        lines = [words(f"a{t}", 20), words(f"b{t}", 20)]
        passage = f"{words(f'p{t}', 7)} {lines[0]} {words(f'q{t}', 6)} {lines[1]} {words(f'r{t}', 7)}"
        for k in range(12):
            docs.append((1000 * t + k, f"{words(f'c{t}y{k}', 70)} {lines[k % 2]} {words(f'd{t}y{k}', 70)}"))
        docs += [(1000 * t + k, f"{words(f'e{t}y{k}', 60)} {passage} {words(f'f{t}y{k}', 60)}") for k in (90, 91)]
        want.add((1000 * t + 91, 1000 * t + 90))
    assert passage_pairs(spark, docs) == want


def test_passage_at_any_place_of_a_repeated_line_is_found(spark):
    words = lambda tag, n: " ".join(f"{tag}x{k}" for k in range(n))
    docs = []
    for t in range(60):
        line = words(f"a{t}", 30)
        passage = f"{words(f'p{t}', 15)} {line} {words(f'q{t}', 15)}"
        places = [line, line, line]
        places[t % 3] = passage
        docs.append((2 * t, " ".join(x for k in range(3) for x in (words(f"c{t}y{k}", 80), places[k])) + " " + words(f"d{t}", 80)))
        docs.append((2 * t + 1, f"{words(f'g{t}', 80)} {passage} {words(f'h{t}', 80)}"))
    assert passage_pairs(spark, docs) == {(2 * t + 1, 2 * t) for t in range(60)}


def test_passage_met_by_later_hash_functions_is_found(spark):
    words = lambda tag, n: " ".join(f"{tag}x{k}" for k in range(n))
    docs = []
    for t in range(100):
        lines = [words(f"a{t}y{k}", 12) for k in range(6)]
        passage = words(f"p{t}", 60)
        for side, text in enumerate((passage, passage.replace(f"p{t}x30", f"changed{t}"))):
            parts = [x for k in range(6) for x in (words(f"c{t}y{k}z{side}", 40), lines[k])]
            docs.append((2 * t + side, f"{' '.join(parts)} {words(f'd{t}z{side}', 60)} {text} {words(f'e{t}z{side}', 60)}"))
    assert passage_pairs(spark, docs) == {(2 * t + 1, 2 * t) for t in range(100)}


def test_bpe_agrees_with_the_library(spark):
    coder = bpe.bpe_of(bpe.RANKS)
    import public_tokenizers

    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["", "it's  we'll\n\n x", "日本語 ①", "ab" * 900, "  y　z", prose(4, 50), "😀 é"]
    rows = bpe.coded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == [want.encode_ordinary(t) for t in texts] and all(r["intact"] for r in rows)


def test_damaged_record_is_noticed():
    raw = bytearray(records.frame(5, np.array([1, 2, 3], np.uint32), 2))
    assert records.unframe(memoryview(bytes(raw)), 0)[0] == 5
    raw[20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        records.unframe(memoryview(bytes(raw)), 0)


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection(total):
    assert sorted(sharding.permute(np.arange(total), total)) == list(range(total))


def test_checksums(spark):
    row = spark.createDataFrame([("4111 1111 1111 1111", "4111111111111112", "GB82WEST12345698765432")], "good string, bad string, iban string")
    assert tuple(row.select(pii.luhn(F.col("good")), pii.luhn(F.col("bad")), pii.mod97(F.col("iban"))).first()) == (True, False, True)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op5_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_long_license_is_found_inside_a_text(spark):
    docs = [(1, f"{prose(1, 100)} {licenses.TEMPLATES['mit-notice']} {prose(2, 300)}"), (2, prose(3, 300))]
    assert [r["licenses"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()] == [["mit-notice"], []]


def test_rules_order_changes_no_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    kept = lambda rules: {r["doc_id"] for r in quality.keep_good(docs, rules).collect()}
    assert kept(quality.RULES) == kept(quality.RULES[::-1])


def test_items_are_found_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    assert decontamination.search(docs, items).count() == len(duckdb.sql(catalogue.SQL["op10_decontamination"].replace("FROM documents", f"FROM '{d}/documents.parquet'").replace("FROM benchmark", f"FROM '{d}/benchmark.parquet'")).fetchall())
