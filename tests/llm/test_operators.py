"""Each operator against brute force, on texts with nulls, empties, repeats and long words."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from clausewright.llm import chat, components, ctph, language_id, minhash, packing, piece_bpe, queries, substring_dedup, token_files, topk, toxicity, wavelet, wordbpe
from clausewright.llm.storage import settle

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, score double"


def texts():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeéñß") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = make(60), make(120)
    out = [None, "", "   \n\t ", "one", "One", "two words", "x" * 3000, "日本語 <|endoftext|> 🙂", "a  b\n\n c ", "\r\n"]
    out += [make(rnd.randint(1, 90)) for _ in range(30)]
    out += [make(20) + " " + passage + " " + make(20) for _ in range(4)] + [passage + " " + passage]
    for k in range(12):  # near copies that hang together through each other
        w = base.split()
        w[k * 9] = "edit%d" % k
        out.append(" ".join(w))
    out += [base, base, base.upper(), make(4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "clash", 0.5) for i, t in enumerate(texts())]
    rows.append(rows[12])  # a row repeated as a whole
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 700, 3000).astype("<u2")
    names, lengths, matrix = wavelet.load(wavelet.dump([3, None], [1000, 2000], ids))
    assert names == [3, None] and list(lengths) == [1000, 2000] and (matrix.ids() == ids).all()
    for t in (0, 13, 699, 5000):
        assert matrix.count(t) == (ids == t).sum() and matrix.occurrences(t) == np.flatnonzero(ids == t).tolist()
        assert matrix.rank(t, 1234) == (ids[:1234] == t).sum()
    assert [matrix[i] for i in range(0, 3000, 101)] == ids[::101].tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    encode = wordbpe.encoder(queries.vocabulary(name))
    rnd = random.Random(2)
    many = texts() + ["".join(rnd.choice("ab 1.\n\t ',é!'s") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    parts = ["'", "''", "'s", "'re", "'ve", "'ll", "'d", "S", "x", "5", "77", "\"", " ", "  ", "\n", "É", "²", "<|", "\x01", "中", "İ"]
    many += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(2000)]
    many += ["a" * 20_000, " " * 20_000 + "a", "ab " * 3000, "'r", "x'"]
    assert encode.fast is not None
    for text, got in zip(many, encode(many)):
        assert got.tolist() == encode.whole.encode(text or "", add_special_tokens=False).ids


def test_op2_token_files(docs, plain):
    path = queries.vocabulary("word_bpe_49k.json")
    got = sorted(token_files.token_offsets(docs, path).drop("shard").collect())
    whole, at = wordbpe.encoder(path).whole, 0
    for (i, text), row in zip(plain, got):
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        assert tuple(row) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(plain)


def test_op9_packing(docs, plain):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    whole, want = wordbpe.encoder(path).whole, []
    for i, text in plain:
        ids = whole.encode(text, add_special_tokens=False).ids + [0]
        want += [(i, a, len(ids[a : a + 1024]), crc(ids[a : a + 1024]), len(ids)) for a in range(0, len(ids), 1024)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024


def test_closest_fill_is_closest():
    rnd = random.Random(4)
    for _ in range(100):
        counts = Counter(rnd.choices(range(1, 40), k=rnd.randint(1, 8)))
        used = packing.closest_fill(counts, 60)
        sums = {0}
        for length, n in (counts - Counter([max(counts)])).items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s + max(counts) <= 60) + max(counts)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def test_op5_equals_library(docs, plain):
    from sentencepiece import SentencePieceProcessor

    path = queries.vocabulary("piece_bpe_32k.model")
    sp, rnd = SentencePieceProcessor(model_file=path), random.Random(3)
    coder = piece_bpe.piece_model(path)
    many = [t or "" for t in texts()] + [" " * k for k in range(60)] + ["".join(rnd.choice("abeinrst  \n▁é日!1") for _ in range(rnd.randint(1, 200))) for _ in range(1000)]
    for text, ids in zip(many, coder.encode(many)):
        assert ids.tolist() == sp.encode(text)
        assert coder.decode(ids).decode() == sp.decode(ids.tolist())
    for (i, text), row in zip(plain, sorted(piece_bpe.encode_documents(docs, path).collect())):
        ids = sp.encode(text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(row) == (i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op4_fingerprints(docs, plain):
    got = sorted(ctph.fingerprints(docs).collect())
    assert len(got) == len(plain)
    for k, ((i, text), row) in enumerate(zip(plain, got)):
        following = plain[(k + 1) % len(plain)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert (row.doc_id, row.n_chars, row.edited_sha256) == (i, len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert row.fingerprint == ctph.fingerprint(text.encode()) and row.edited_fingerprint == ctph.fingerprint(changed.encode())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert ctph.likeness(["3:ABC:D"], ["3:ABC:D"])[0] == 1 and ctph.likeness(["3::"], ["3:AB:C"])[0] == 0


def test_op6_near_duplicates(docs, plain):
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    sets = []
    for i, text in plain:
        w = WORDS.findall(fold(text))
        sets.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    got = sorted(minhash.near_duplicates(docs, 3, 85).drop("row_key").collect())
    assert [tuple(r) for r in got] == [(i, len(s), find(i), find(i) == i) for i, s in sets]


def test_op6_blocks_give_the_same(docs, monkeypatch):
    want = sorted(minhash.near_duplicates(docs, 3, 85).collect())
    monkeypatch.setattr(minhash, "LIST_BLOCK", 3)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 3)
    assert sorted(minhash.near_duplicates(docs, 3, 85).collect()) == want


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b} - set(got)
    assert got == {x: find(x) for x in up if x not in loops}


def test_op10_substring_dedup(docs, plain):
    got = sorted(substring_dedup.remove_repeated(docs, 35).collect())
    split = [WORDS.findall(t) for _, t in plain]
    seen = Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    for (i, _), w, row in zip(plain, split, got):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert tuple(row) == (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op1_top_k(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 16)).astype("f4")
    v[20:60] = v[7]  # ties
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(900, None, 0), (950, [float("nan")] * 16, 0), (1000, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, "vec_id", "embedding", 5, 256.0).orderBy("query_id", "rank").collect()]
    whole = np.floor(256 * v.astype(float)).astype(int)
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(whole[q] @ whole[j]), j) for j in range(300) if j != q)[:5]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want


def test_op7_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <<SYS>> nice \\"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "x</s>"), (2, 0, "assistant", None), (2, 1, None, "<|end|>"), (None, 0, "user", "lone"), (2, 1, None, "<|end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = settle(chat.format_conversations(df), "segments")
    reader, whole = chat.Reader(chat.Template()), defaultdict(str)
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id or 0, r.seq)):
        whole[r.conv_id] += r.text
    assert reader.turns(whole[1]) == [(r, t) for _, _, r, t in rows[:3]]
    assert reader.turns(whole[2]) == [("assistant", ""), ("", "<|end|>"), ("", "<|end|>")]
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert got[1].valid and not got[2].valid and got[1].loss_chars == 5
    assert got[1].loss_sha256 == hashlib.sha256(b"x</s>").hexdigest()
    assert got[1].formatted_chars == len(whole[1])


def test_op3_held_out_accuracy(spark):
    rnd = random.Random(7)
    syllables = {"aa": ["ba", "lo", "mi"], "bb": ["kru", "zet", "mi"], "cc": ["éla", "ñu", "ba"]}
    rows = [(i, " ".join("".join(rnd.choices(syllables[l], k=3)) for _ in range(12)), l) for i, l in enumerate(rnd.choices(list(syllables), k=300))]
    df = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 !!", None), (1002, "", "bb")], "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in language_id.predict(df.select("doc_id", "text"), model).collect()}
    assert np.mean([got[i].lang_pred == l for i, _, l in rows if i % 3 == 0]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert {r.lang_pred for r in language_id.predict(df.select("doc_id", "text"), None).collect()} == {"und"}


def test_op8_held_out_and_scan(spark):
    rnd = random.Random(8)
    usual = ["w%s" % "".join(rnd.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = []
    for i in range(400):
        w = rnd.choices(usual, k=60)
        toxic = i % 5 == 0
        if toxic:
            at = rnd.randrange(50)
            w[at : at + 4] = rnd.choices(["vile", "nasty", "Scum"], k=4)
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(900, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model, passages=True).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 0) and 0 <= got[900] == got[901] < 0.7


def test_maximal_segments_against_all_sums():
    rnd = random.Random(9)
    for _ in range(100):
        score = [rnd.choice([-0.5, -0.5, -0.5, 2.0, 1.0, 0.25]) for _ in range(30)]
        at = [i for i, s in enumerate(score) if s > 0]
        found = toxicity.maximal_segments(at, [score[i] for i in at])
        best = max((sum(score[a : b + 1]) for a in range(30) for b in range(a, 30)), default=0)
        assert not at or abs(max(s for _, _, s in found) - best) < 1e-9
        assert all(abs(sum(score[a : b + 1]) - s) < 1e-9 for a, b, s in found)
        assert all(b < c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert token_files.token_offsets(empty, queries.vocabulary("word_bpe_49k.json")).count() == 0
    assert packing.pack(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    assert ctph.fingerprints(empty).count() == minhash.near_duplicates(empty, 3, 85).count() == substring_dedup.remove_repeated(empty).count() == 0
    assert language_id.fit(empty) is None
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, vectors, "vec_id", "embedding", 5).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.fit(toxicity.labelled_sample(empty, labels))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(10)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, copied = make(50), make(80)
    rows = [(i, make(60), "en") for i in range(60)]
    rows += [(100, "!!! 123", "en"), (101, None, "en"), (200, copied, "en"), (201, copied + " more", "en"), (300, make(30) + " " + passage, "en"), (301, passage + " " + make(30), "en")]
    docs = spark.createDataFrame([(i, t, l, "s", len(t or ""), 1.0) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = settle(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == {*range(60), 200, 300, 301}
    assert passage not in got[300].text and got[300].n_chars == len(got[300].text) and got[5].text == rows[5][1]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(got)
