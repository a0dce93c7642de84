"""Values of the corpus operators: brute force, libraries, long texts, and columns of clashing names."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mesostate.llm import bpe, decontamination, langid, licenses, passages, pii, pretokens, quality, records, sharding, simhash

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def rows():
    return documents()


def thue(n, flip=False):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out.translate(str.maketrans("ab", "ba")) if flip else out


def hard_texts():
    r = random.Random(1)
    pool = [chr(c) for c in (0x1E5F0, 0x1E5FA, 0x41, 0x61, 0x20, 0x0A, 0x30, 0x4E2D, 0x27, 0x73, 0xA0, 0x3000, 0x1F600, 0xE9)]
    fixed = ["", f"{thue(1024)} {thue(1024, True)}", "<|endoftext|> hi", "x <|endoftext|><|endoftext|>", "a<|endof text|>", "it's  we'll\n\n x", "ab" * 900, "xyz" * 340, "q" * 5000]
    return fixed + ["".join(r.choice(pool) for _ in range(r.randint(1, 40))) for _ in range(400)]


def ordinary():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.bpe_of(bpe.RANKS).ranks, special_tokens={})


# op7 and op6 ------------------------------------------------------------------------------------------------------


def test_bpe_ids_and_digests_are_the_librarys(spark):
    texts, library = hard_texts() + [None], ordinary()
    found = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    for text, row in zip(texts, found, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_twenty_megabytes():
    r = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    text = " ".join(r.choice(words) for _ in range(3_600_000))
    assert len(text) > 20_000_000
    coder = bpe.bpe_of(bpe.RANKS)
    run = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    _, _, ids, at = bpe._encode(coder, run, "text")
    assert ids.tolist() == ordinary().encode_ordinary(text)
    assert coder.decode(ids, at[1:]) == [text.encode()]


def test_ranges_that_share_a_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"onetwoonetentwosixteen", np.uint8)
    ends = np.array([3, 6, 9, 12, 15, 18, 22])
    starts = np.append(0, ends[:-1])
    monkeypatch.setattr(pretokens, "range_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    codes, first = pretokens.distinct_ranges(data, starts, ends)
    found = [data[starts[first[c]] : ends[first[c]]].tobytes() for c in codes]
    assert found == [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(first) == 5


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(pretokens, "KEPT", 50)
    coder, library = bpe.Bpe(bpe.RANKS), ordinary()
    r = random.Random(3)
    for _ in range(20):
        text = " ".join(f"w{r.randint(0, 300)}" for _ in range(200))
        _, _, ids, _ = bpe._encode(coder, pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), "text")
        assert ids.tolist() == library.encode_ordinary(text)
    assert len(coder.encoder.known) < 300


def test_records_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(records.TOKENIZER)
    texts = hard_texts()
    assert [x.tolist() for x in records.encoder_of(records.TOKENIZER)(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_of_a_table(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(records.TOKENIZER)
    start, want = 0, []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = records.op6_records(spark, SMALL).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found] == want


# op5 --------------------------------------------------------------------------------------------------------------

SCRIPTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it rests under a tree near the river while clouds pass by",
    "nl": "de snelle bruine vos springt over de luie hond en dan rust hij onder een boom bij de rivier terwijl wolken drijven",
    "ru": "быстрая лиса прыгает через ленивую собаку и потом отдыхает под деревом у реки пока плывут облака",
    "uk": "швидка лисиця стрибає через ледачого собаку і потім відпочиває під деревом біля річки поки пливуть хмари",
    "ko": "빠른 여우가 게으른 개를 뛰어넘고 나서 강가의 나무 아래에서 쉬는 동안 구름이 지나간다",
    "zh": "敏捷的狐狸跳过懒狗然后在河边的树下休息而云彩慢慢飘过天空",
    "ja": "素早い狐は怠け者の犬を飛び越えてから川のそばの木の下で休み雲がゆっくり流れていく",
}


def scripts(seed, n):
    r = random.Random(seed)
    out = []
    for lang, text in SCRIPTS.items():
        parts = text.split() if " " in text else [text[k : k + 3] for k in range(0, len(text), 3)]
        for _ in range(n):
            out.append((lang, (" " if " " in text else "").join(r.choice(parts) for _ in range(40))))
    return out


def naive_phrases(symbols, sample):
    """Longest pieces that occur in the sample, restarting at each segment."""
    n = 0
    for at in range(0, len(symbols), langid.SEGMENT):
        part, k = symbols[at : at + langid.SEGMENT], 0
        while k < len(part):
            size = 1
            while k + size < len(part) and part[k : k + size + 1] in sample:
                size += 1
            n, k = n + 1, k + size
    return n


def test_phrases_are_those_of_a_naive_parse():
    texts = [t for _, t in scripts(5, 3)] + ["Mixed ТЕКСТ with 漢字 and 123", "ab" * 700]
    samples = {}
    for lang, text in scripts(6, 2):
        samples.setdefault(lang, []).append(text)
    model = langid.Model.fit(samples)
    found, _, _ = model.phrases(pa.array(texts))
    for k, lang in enumerate(model.languages):
        sample = langid.symbols_of(pa.array(["\n".join(samples[lang])]))[0].tobytes()
        for i, text in enumerate(texts):
            own = langid.symbols_of(pa.array([text]))[0].tobytes()
            # a phrase of symbols unknown to the sample has length one in both
            assert abs(int(found[k, i]) - naive_phrases(own, sample)) <= len(own) // langid.SEGMENT + 1 + sum(bytes([b]) not in sample for b in own)


def test_scripts_and_neighbours_are_told_apart(spark):
    docs = [(k, t, lang) for k, (lang, t) in enumerate(scripts(7, 30))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.languages == sorted(SCRIPTS) and all((m > 0).sum() > 10 for m in model.own)
    test = spark.createDataFrame([(k, t, lang, 9.9) for k, (lang, t) in enumerate(scripts(8, 10))], "doc_id long, text string, lang string, score double")
    assert langid.predict(test, model).where("lang = lang_pred").count() >= 68


def test_sample_prefers_short_texts_and_takes_them_whole(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 1)
    monkeypatch.setattr(langid, "LONG_TEXT", 20)
    seen = {}
    monkeypatch.setattr(langid.Model, "fit", classmethod(lambda cls, samples: seen.update(samples)))
    docs = [(k, "x" * 500 if k % 2 else f"short text {k}", "en") for k in range(40)] + [(50, "only long " * 90, "fr"), (51, None, "fr"), (52, "123", "fr")]
    langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(seen["en"]) == 1 and seen["en"][0].startswith("short text") and seen.get("fr", ["only long " * 90]) == ["only long " * 90]


# op2 --------------------------------------------------------------------------------------------------------------


def test_a_megabyte_of_numbers_and_one_of_addresses(spark):
    r = random.Random(1)
    numbers = " ".join(str(r.randint(10, 99999)) for _ in range(170_000))
    mails = " ".join(f"user{k}@site{k % 7}.org" for k in range(40_000))
    began = time.perf_counter()
    found = pii.find(spark.createDataFrame([(1, numbers), (2, mails)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert time.perf_counter() - began < 60
    assert len(found[1]["spans"]) == 40_000
    assert [mails[s["start"] : s["end"]] for s in found[1]["spans"][-2:]] == ["user39998@site0.org", "user39999@site1.org"]


def test_redaction_over_many_blocks(spark):
    text = " x ".join(f"user{k}@site.org and 日本" for k in range(700))
    clean = pii.redact(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, _spans string")).first()
    assert clean["text"] == " x ".join("[EMAIL] and 日本" for _ in range(700)) and clean["_spans"] == "x"


def test_iban_social_number_and_secret(spark):
    text = "Konto: GB82WEST12345698765432 and GB82 WEST 1234 5698 7654 32, not GB83WEST12345698765432. ssn 123-45-6789; api_key = abcd1234abcd1234abcd99 é a@b.c"
    spans = pii.find(spark.createDataFrame([(text,)], "text string")).first()["spans"]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in spans] == [
        ("email", "a@b.c"), ("iban", "GB82WEST12345698765432"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("secret", "abcd1234abcd1234abcd99"),
    ]


# op3, op9, op4, pipeline ------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fingerprints):
    """Least index that links of four bits reach."""
    values = np.array(fingerprints, np.uint64)
    root = list(range(len(values)))
    for k in range(len(values)):
        stack = [k] if root[k] == k else []
        while stack:
            a = stack.pop()
            for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 4).tolist():
                if root[b] > k:
                    root[b] = k
                    stack.append(b)
    return root


def test_simhash_of_a_table(spark, rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = grouped(prints)
    want = [(doc, f"{p:016x}", rows[r][0]) for (doc, _), p, r in zip(rows, prints, root, strict=True)]
    found = simhash.op3_simhash(spark, SMALL).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found] == want


def test_lookups_without_broadcast_are_the_same(spark, monkeypatch):
    from mesostate.llm import common

    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "id long, fp long")
    table = common.checkpoint(spark.createDataFrame([(0, 7), (1, 8)], "fp long, v long"))
    small, salted = (sorted(map(tuple, common.looked_up(df, table, "fp", ["id"], most).select("id", "fp", "v").collect()), key=str) for most in (10, 0))
    assert small == salted and len(small) == 50


def test_shards_of_a_table(spark, rows):
    found = sharding.op9_sharding(spark, SMALL).collect()
    by = {r["doc_id"]: r for r in found}
    for doc, text in rows:
        raw = (text or "").encode()
        assert (by[doc]["size"], by[doc]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    counts = {}
    for r in found:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert set(counts) <= set(range(24)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    # the place of a row follows from its number alone, however the table was read
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").repartition(7)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(small, ["doc_id"], 24).collect()}
    assert again == {d: (r["shard"], r["slot"]) for d, r in by.items()}


def close_pairs(texts):
    """Pairs of documents of which a run of LENGTH shingles finds 0.8 of them inside a run of the other's of that length."""
    n, least = passages.LENGTH, int(np.ceil(0.8 * passages.LENGTH - 1e-9))
    shingles = [[hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)] for w in (words_of(t) for t in texts)]
    holders = {}
    for d, own in enumerate(shingles):
        for s in set(own):
            holders.setdefault(s, set()).add(d)
    out = set()
    for d, own in enumerate(shingles):
        near = {}
        for s in set(own):
            for e in holders[s]:
                if e < d:
                    near[e] = near.get(e, 0) + 1
        for e, count in near.items():
            if count < least or len(own) < n or len(shingles[e]) < n:
                continue
            other = shingles[e]
            for b in range(0, len(other) - n + 1):
                run = set(other[b : b + n])
                hit = np.cumsum([0] + [s in run for s in own])
                if (hit[n:] - hit[:-n]).max() >= least:
                    out.add((d, e))
                    break
    return out


def test_passages_of_a_table(spark):
    """Recall of links between different texts, as classes of documents, against all pairs."""
    distinct = {}
    for doc, text in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall():
        distinct.setdefault(text, doc)
    kept = sorted((doc, text) for text, doc in distinct.items() if text and len(words_of(text)) <= 4000)
    want = close_pairs([t for _, t in kept])
    found = passages.find(spark.createDataFrame(kept, "doc_id long, text string")).collect()
    parent = {d: d for d, _ in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r["doc_id"])] = root(r["rep_doc_id"])
    met = sum(root(kept[a][0]) == root(kept[b][0]) for a, b in want)
    assert len(want) > 60 and met >= 0.95 * len(want)


def test_minimal_passages_of_similarity_two_thirds(spark):
    """Passages of LENGTH shingles with two of their words changed, so 37 of 46 shingles stay (a Jaccard similarity of 0.67)."""
    r, docs = random.Random(4), []
    for t in range(150):
        passage = [f"p{t}x{k}" for k in range(50)]
        changed = list(passage)
        for at in (3, 25):
            changed[at] = f"q{t}x{at}"
        for side, text in enumerate((passage, changed)):
            noise = lambda: " ".join(f"n{r.getrandbits(40)}" for _ in range(60))
            docs.append((2 * t + side, f"{noise()} {' '.join(text)} {noise()}"))
    found = {(x["doc_id"], x["rep_doc_id"]) for x in passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found <= {(2 * t + 1, 2 * t) for t in range(150)} and len(found) >= 0.95 * 150


def test_a_stranger_of_lesser_id_hides_no_passage(spark):
    words = lambda tag, n: " ".join(f"{tag}x{k}" for k in range(n))
    docs, want = [], set()
    for t in range(40):
        passage = words(f"p{t}", 60).split()
        pieces = [" ".join(passage[k : k + 9]) for k in (0, 8, 16, 24, 32, 40, 48, 51)]
        docs.append((1000 * t, " ".join(x for k, piece in enumerate(pieces) for x in (words(f"s{t}y{k}", 40), piece))))
        docs += [(1000 * t + k, f"{words(f'a{t}y{k}', 70)} {' '.join(passage)} {words(f'b{t}y{k}', 70)}") for k in (1, 2)]
        want.add((1000 * t + 2, 1000 * t + 1))
    found = {(x["doc_id"], x["rep_doc_id"]) for x in passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert want <= found


def test_rows_that_no_key_names_stay_where_they_are(spark):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("int").alias("block"), F.lit("x").alias("around"))
    keys = rows.where("doc_id % 50 = 3").select("doc_id", "block").unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit(9).alias("block")))
    left = passages.named(rows, keys, keys.count(), ["doc_id", "block"])
    assert left.columns == rows.columns and left.count() < 16_000 and left.where("doc_id % 50 = 3").count() == 2000
    assert passages.named(rows, keys.limit(0), 0, ["doc_id", "block"]).count() == 0


def test_rounds_of_many_pairs_find_what_rounds_of_few_do(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = [words(60) for _ in range(6)]
    docs = []
    for k in range(120):  # passages with changes, so several leaders and rounds
        text = words(40) + [w if rng.random() > 0.06 else "z" for w in shared[k % 6]] + words(30)
        docs.append((k, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    few = sorted(map(tuple, passages.find(df).collect()))
    asked, whole = [], passages.named
    monkeypatch.setattr(passages, "named", lambda *of: asked.append(of[2]) or whole(*of))
    monkeypatch.setattr(passages, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, passages.find(df).collect())) == few and few and len(asked) >= 2


def test_minima_of_a_text_do_not_depend_on_its_batch(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("again and again the same words", f"v{rng.randrange(900)}")) for _ in range(150)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = lambda n: sorted((r["key"], r["doc_id"], r["w"]) for r in passages.windows(df.repartitionByRange(n, "doc_id")).where(f"kind != {passages.STANDS}").collect())
    assert cut(1) == cut(12)


def test_windows_are_dealt_whole_and_in_few_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(passages, "PARCEL", 10_000)
    n = 30_000
    kind = rng.choice((0, passages.SHARED, passages.STANDS), n).astype(np.int32)
    key, doc = rng.integers(0, 2**48, n), np.sort(rng.integers(-(2**60), 2**60, n // 500).repeat(500))
    w = passages.packed(rng.integers(0, 2**30, n), rng.integers(0, 46, n), rng.integers(0, 46, n), rng.integers(0, 6, n))
    cut = pa.RecordBatch.from_arrays([pa.array(key), pa.array(key), pa.array(doc), pa.array(w), pa.array(kind)], ["route", "key", "doc_id", "w", "kind"])
    rows = pa.Table.from_batches(passages.parcels((cut.slice(a, 4000) for a in range(0, n, 4000)), 7))
    assert rows.num_rows == 3 * 21 and rows.nbytes < 14 * n
    assert sorted(zip(*(x.tolist() for x in passages.unpacked_parcels(rows)), strict=True)) == sorted(zip(*(x.tolist() for x in (key, doc, w, kind)), strict=True))
    parts = [set(passages.unpacked_parcels(rows.filter(pa.compute.equal(rows["bucket"], k)))[0].tolist()) for k in range(7)]
    assert sum(map(len, parts)) == len(set(key.tolist()))


def test_release_frees_the_files_of_the_last_job(spark):
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = files()
    _, path = passages.stored(spark.range(1000).repartition(3, "id"), "released")
    mine = files() - before
    passages.release(spark)
    for _ in range(50):
        if mine & files():
            time.sleep(0.1)
    passages.drop(spark, path)
    assert mine and not mine & files()


@pytest.mark.parametrize("most", (500_000, 0))
def test_surroundings_are_moved_once_and_whole(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "MOST_BROADCAST", most)
    rng, n = random.Random(5), passages.LENGTH
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(size)) for size in (50, 95, 460, 2000, 2600)]
    own = [(x >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist() for x in passages.text_shingles(pa.array(texts))]
    pairs = sorted({(d, rng.randrange(-(-len(own[d]) // n)), e, rng.randrange(-(-len(own[e]) // n))) for d in range(5) for e in range(5) if d != e for _ in range(12)})
    asked = {(d, 2 * b) for d, b, *_ in pairs} | {(e, 2 * b + odd) for *_, e, b in pairs for odd in (0, 1)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([(d, [c for e, c in asked if e == d]) for d in range(5)], "doc_id long, at array<int>")
    around = passages.surroundings(df, wanted).localCheckpoint()
    assert all(sum(r["sizes"]) == len(r["around"]) and len(r["around"]) <= passages.CHUNK * n + 2 * (n - 1) * (1 + r["wide"]) for r in around.collect())
    rows = spark.createDataFrame([(d, b, None, e, c, 3, None) for d, b, e, c in pairs], "doc_id long, block int, rest binary, rep_doc_id long, rep_block int, lo int, hi int")
    for wide in (1, 0):
        near = lambda d, b, m: own[d][max(b * n - m, 0) : (b + 1) * n + m]
        want = sorted((d, e, b, max(b * n - n + 1, 0), 3, None, near(d, b, n - 1), near(e, c, (n - 1) * (1 + wide))) for d, b, e, c in pairs)
        found = [x for batch in passages.beside(rows, around, wide).toArrow().to_batches() for x in passages.pair_batch(batch).to_pylist()]
        assert sorted(tuple(x[k] for k in ("doc_id", "rep_doc_id", "block", "first", "lo", "hi", "around", "rep_around")) for x in found) == want


def test_far_passages_are_rows_of_their_own(spark):
    words = lambda tag, n: " ".join(f"{tag}x{k}" for k in range(n))
    docs = [(1, f"{words('p', 80)} {words('a', 300)} {words('q', 80)}"), (2, f"{words('b', 40)} {words('p', 80)} {words('c', 500)} {words('q', 80)}")]
    found = passages.find(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("first_word").collect()
    assert [r["doc_id"] for r in found] == [2, 2]
    assert found[0]["first_word"] <= 40 and found[0]["last_word"] >= 120 and found[0]["last_word"] < 200 and found[1]["first_word"] > 500


def test_pipeline_of_a_table(spark, rows):
    """Stage after stage against plain Python and the other operators' SQL."""
    good = {r[0] for r in duckdb.sql(f"WITH docs AS (SELECT doc_id, text FROM '{SMALL}/documents.parquet'), {quality.MEASURES} SELECT doc_id FROM judged WHERE kept").fetchall()}
    left = [(d, t) for d, t in rows if d in good]
    root = grouped([plain_fingerprint(t) for _, t in left])
    left = [x for k, x in enumerate(left) if root[k] == k]
    held = {r[0] for r in duckdb.sql(decontamination.SQL["op10_decontamination"].replace("FROM documents", f"FROM '{SMALL}/documents.parquet'").replace("FROM benchmark", f"FROM '{SMALL}/benchmark.parquet'")).fetchall()}
    left = {d: t for d, t in left if d not in held}
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in found} == set(left)
    library = ordinary()
    for r in found:
        assert r["ids"] == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["intact"] and r["n_chars"] == len(r["text"])
        if "@" not in left[r["doc_id"]] and not re.search("[0-9]", left[r["doc_id"]]):
            assert r["text"] == left[r["doc_id"]]
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"])


# clashing names and values of edge rows ---------------------------------------------------------------------------

CLASH = "doc_id long, text string, ids string, n_tokens string, intact string, score string, lang_pred string, shard string, slot string, _row long, _key string, _fp string, fp string, _failed string, failed_rule string, _spans string, spans string, decoded string"


@pytest.fixture(scope="module")
def clash(spark):
    text = " ".join(f"word{k}" for k in range(30))
    extra = ["own"] * 7 + [5] + ["own"] * 8
    return spark.createDataFrame([(1, text, *extra), (2, None, *extra), (3, "", *extra), (4, text, *extra), (4, text, *extra)], CLASH)


def test_clashing_columns_do_not_crash_and_others_stay(clash):
    kept = lambda df, *added: {c: df.select(c).distinct().count() for c in df.columns if c not in ("doc_id", "text", *added)}
    for df, added in (
        (bpe.coded(clash), ("ids", "n_tokens", "intact")), (bpe.encoded(clash), ("ids",)), (langid.predict(clash, langid.Model.fit({"en": ["some words"]})), ("lang_pred", "score")),
        (sharding.shard(clash, ["doc_id"], 2), ("shard", "slot")), (quality.keep_good(clash), ()), (simhash.deduplicate(clash), ()), (pii.redact(clash), ()),
    ):
        assert set(df.columns) == set(clash.columns) and len(df.columns) == len(clash.columns)
        assert set(kept(df, *added).values()) <= {1}


def test_values_of_edge_rows(spark, clash):
    counts = {(r["doc_id"], r["n_tokens"], tuple(r["ids"]) == (), r["intact"]) for r in bpe.coded(clash).collect()}
    assert (2, 0, True, True) in counts and (3, 0, True, True) in counts
    assert [r["doc_id"] for r in quality.keep_good(clash).orderBy("doc_id").collect()] == [1, 4, 4]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(clash).collect()) == [1, 2]
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(clash, langid.Model.fit({})).collect()}
    assert set(langs.values()) == {("und", 0.0)}
    assert [r["text"] for r in pii.redact(clash).where("doc_id in (2, 3)").orderBy("doc_id").collect()] == [None, ""]
    assert {r["text"] for r in decontamination.clean(clash, spark.createDataFrame([(1, "word3 word4 word5 word6 word7")], "item_id long, text string")).collect()} == {None, ""}


def test_the_cascade_asks_what_earlier_rules_left(spark, monkeypatch):
    monkeypatch.setattr(quality, "measure", lambda *a, **k: quality.Profile({"a": 1.0, "b": 1.0, "c": 1.0}, {"a": frozenset(range(10)), "b": frozenset(range(8)), "c": frozenset([20, 21])}))
    rules = tuple(quality.Rule(n, lambda m: F.lit(False)) for n in "bac")
    assert [r.name for r in quality.in_order(None, rules)] == ["a", "c", "b"]


# bounds and precision ---------------------------------------------------------------------------------------------


def plain_runs(own, rep):
    """Runs of 46 of which some run of the other list has 0.8 of the distinct values of each in common."""
    n, out = passages.LENGTH, []
    theirs = [set(rep[b : b + n]) for b in range(len(rep) - n + 1)]
    for a in range(len(own) - n + 1):
        mine = set(own[a : a + n])
        out.append(any(len(mine & t) >= 0.8 * max(len(mine), len(t)) - 1e-9 for t in theirs))
    return out


def test_runs_are_alike_both_ways():
    r = np.random.default_rng(1)
    base = r.integers(0, 10**9, 138).astype(np.int32)
    for k in range(30):
        own, rep = base[: r.integers(46, 138)].copy(), np.concatenate([r.integers(0, 10**9, r.integers(0, 60)), base, r.integers(0, 10**9, 5)]).astype(np.int32)[: r.integers(40, 184)]
        own[r.random(len(own)) < 0.02 * (k % 12)] = 5
        if k % 3 == 0:
            rep[r.random(len(rep)) < 0.1] = 5
        if k % 5 == 0:
            own[:] = own[np.arange(len(own)) % 7]
        assert passages.alike_runs(own, rep).tolist() == plain_runs(own.tolist(), rep.tolist())


def pairs_of(texts):
    """A batch of all ordered pairs of texts whose surroundings are whole, as ``compared`` gets them."""
    own = [(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in passages.text_shingles(pa.array(texts))]
    at = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j]
    n = len(at)
    return own, at, pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in at]), pa.array([j for _, j in at]), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.binary()),
         pa.array([own[i].tolist() for i, _ in at], pa.list_(pa.int32())), pa.array([own[j].tolist() for _, j in at], pa.list_(pa.int32()))],
        ["doc_id", "rep_doc_id", "block", "first", "lo", "hi", "rest", "around", "rep_around"],
    )


def test_pairs_are_precise():
    r = random.Random(8)
    word = lambda: f"w{r.randint(0, 10**6)}"
    shared = [word() for _ in range(60)]
    texts = [" ".join(["same"] * 80), " ".join(x for _ in range(9) for x in ["same", *[word() for _ in range(8)]]), " ".join(["same"] * 70 + [word() for _ in range(10)])]
    texts += [" ".join([word() for _ in range(r.randint(0, 40))] + [word() if r.random() < 0.02 * k else w for w in shared] + [word() for _ in range(20)]) for k in range(8)]
    texts += [" ".join(w for _ in range(3) for w in shared[:20] + [word() for _ in range(15)]) for _ in range(3)]
    own, at, batch = pairs_of(texts)
    found = {(row["doc_id"], row["rep_doc_id"]) for part in passages.check_pairs(batch) for row in part.to_pylist()}
    assert found == {(i, j) for i, j in at if any(plain_runs(own[i].tolist(), own[j].tolist()))}
    assert (0, 1) not in found and (1, 0) not in found and (0, 2) in found


def test_one_word_many_times_is_no_passage_of_scattered_words(spark):
    r = random.Random(9)
    noise = lambda: f"n{r.randint(0, 10**7)}"
    rows = [(0, " ".join(["same"] * 80))] + [(k, " ".join(x for _ in range(9) for x in [*["same"] * 5, *[noise() for _ in range(7)]])) for k in range(1, 40)]
    assert passages.find(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def long_text(n=20_000_000):
    r = random.Random(10)
    words = [f"{a}{b}" for a in ("lo", "mi", "sta", "vel", "qua") for b in ("rem", "num", "tis", "dor", "pe", "xa")]
    return " ".join(r.choice(words) for _ in range(n // 6))


def test_a_long_labelled_text_is_learned_and_measured_in_seconds(spark):
    text = long_text()
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5)
    df = spark.createDataFrame([(key, text, "xx")], "doc_id long, text string, lang string")
    began = time.time()
    model = langid.learn(df)
    assert model.languages == ["xx"] and sum(t.nbytes for t in model.tables) < 20e6
    assert model.predict(pa.array(["lorem dortis", "123"]))[0] == ["xx", "und"]
    ordered = quality.in_order(df)
    assert len(ordered) == len(quality.RULES)
    assert time.time() - began < 60


def test_ties_of_languages_go_to_the_first_name():
    model = langid.Model.fit({"b": ["same words here"], "a": ["same words here"]})
    best, score = model.predict(pa.array(["same words", "words here same"]))
    assert best == ["a", "a"] and score == [0.0, 0.0]


def test_long_pre_tokens_cost_no_more_a_byte():
    r = random.Random(11)
    took = {}
    for size in (30, 1000):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)).encode() for _ in range(90_000 // size)]
        coder = bpe.Bpe(bpe.RANKS)
        coder.encode(words[:2])
        began = time.perf_counter()
        found = coder.encode(words)
        took[size] = time.perf_counter() - began
        assert found[0] == ordinary().encode_ordinary(words[0].decode())
    assert took[1000] < 3 * took[30] + 0.5


def test_licenses_of_least_containment_are_found(spark):
    """Notices of which 0.8 of the shingles are left, among other words: at least 0.98 are found."""
    r = random.Random(12)
    rows, kept = [], []
    for name, text in sorted(licenses.TEMPLATES.items()):
        words = licenses.template_words(text)
        total = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for _ in range(30):
            own = list(words)
            for k in r.sample(range(len(own)), len(own)):
                changed = [*own[:k], f"zz{r.randint(0, 999)}", *own[k + 1 :]]
                if len(total & {tuple(changed[j : j + 5]) for j in range(len(changed) - 4)}) < 0.8 * len(total):
                    break
                own = changed
            noise = lambda n: " ".join(f"q{r.randint(0, 9999)}" for _ in range(n))
            rows.append((len(rows), f"{noise(r.randint(0, 60))} {' '.join(own)} {noise(r.randint(0, 60))}"))
            kept.append(name)
    found = {x["doc_id"]: x["licenses"] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(name in found[k] for k, name in enumerate(kept)) >= 0.98 * len(kept)


def test_a_column_of_licenses_is_replaced(spark):
    text = next(iter(licenses.TEMPLATES.values()))
    df = spark.createDataFrame([(1, text, "mine"), (2, None, None)], "doc_id long, text string, licenses string")
    found = licenses.scan(df).orderBy("doc_id").collect()
    assert len(found[0]["licenses"]) >= 1 and found[1]["licenses"] == []


def test_repeated_lines_do_not_pair_all_places(spark):
    """Texts that repeat one line among fresh words: no pairs, however often it stands there; shared passages about it are found."""
    r = random.Random(13)
    line = " ".join(f"line{k}" for k in range(20))
    fresh = lambda n: " ".join(f"f{r.randint(0, 10**7)}" for _ in range(n))
    texts = [" ".join(f"{line} {fresh(20)}" for _ in range(100)) for _ in range(20)]
    passage = f"{fresh(20)} {line} {fresh(30)}"
    texts[3], texts[7] = f"{texts[3]} {passage} {fresh(30)}", f"{fresh(9)} {passage} {texts[7]}"
    texts += [" ".join([line] * 12), f"{fresh(40)} {' '.join([line] * 15)} {fresh(9)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    held = passages.agreeing(passages.held_by_several(passages.windows(df)))
    placed = held.withColumns({"block": F.floor(F.col("c") / passages.LENGTH).cast("int"), "rest": F.lit(None).cast("binary")})
    assert passages.led(placed, F.sum("one")).count() < 2000
    found = {(x["doc_id"], x["rep_doc_id"]) for x in passages.find(df).collect()}
    assert {(7, 3), (21, 20)} <= found and all(p in ((7, 3), (21, 20)) for p in found)


def test_twenty_megabytes_for_fingerprints_items_and_records(spark):
    from tokenizers import Tokenizer

    text = long_text()
    assert len(text) > 15_000_000
    item = "this test item has ten words that stand nowhere else"
    df = spark.createDataFrame([(1, f"{text} {item} {text[:50]}"), (2, "short")], "doc_id long, text string")
    found = decontamination.search(df, spark.createDataFrame([(5, item), (6, f"{item} but longer by many other words than that")], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, 5)]
    words = text.lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(len(words) - 3)), np.uint64, len(words) - 3)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    fp = simhash.with_fingerprint(spark.createDataFrame([(text,)], "text string"), into="fp").first()["fp"]
    assert fp % 2**64 == want
    library = Tokenizer.from_file(records.TOKENIZER)
    assert records.encoder_of(records.TOKENIZER)(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
