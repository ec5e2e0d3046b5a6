"""Encoding, the token store and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadframe.llm import packing, shared, token_store

SCHEMA = "doc_id long, text string, file int, ids string"
ROWS = [(5, "one two three " * 400, 1, "x"), (1, None, None, None), (3, "", 1, "x"), (7, "one two three " * 400, 1, "y"), (9, "Ünïcode   it's 'tis 你好 ½3", 0, ""), (11, "w " * 9000, 0, "")]
ODD = ["", " ", "a  b\n\nc", "DON'T we'LL !'s x 's", "ab²3 x_y 12 ΑΣ", "tail ", "<|endoftext|>", "İstanbul", "a\x1cb", "é" * 50]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(vocabulary, name):
    coder = shared.PieceEncoder(vocabulary(name), most=50)
    texts = ODD + [r[1] or "" for r in ROWS] + ODD
    for _ in range(2):
        found = [x.tolist() for x in coder.encode_all(texts, most_chars=100)]
        assert found == [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_worker_holds_a_vocabulary_once(vocabulary, monkeypatch, name):
    import tokenizers

    library, loads = tokenizers.Tokenizer, []

    class Counted:
        def __new__(cls, model):
            return library(model)

        @staticmethod
        def from_file(path):
            loads.append(path)
            return library.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    coder, texts = shared.PieceEncoder(vocabulary(name)), ["Plain words, 12 of them", "  a\tb ", "日本語 mixed", "<|endoftext|> x", ""]
    assert len(loads) == 1
    want = library.from_file(vocabulary(name))
    assert [x.tolist() for x in coder.encode_all(texts)] == [want.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_pre_tokens_go_to_the_library_together(vocabulary, name):
    coder, sent = shared.PieceEncoder(vocabulary(name)), []
    single = coder.single

    class Counted:
        @staticmethod
        def encode_batch_fast(texts, **more):
            sent.extend(texts)
            return single.encode_batch_fast(texts, **more)

    coder.single = Counted
    letters = "abcdefghé"
    texts = [" ".join(a + b + c + "x" for b in letters for c in letters) for a in letters] + ["a\x1fb", "c\x1e", "\x00 d\x00", "e"]
    assert [x.tolist() for x in coder.encode_all(texts)] == [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(sent) <= 4  # 729 words and a few more


def test_crc32_of_parts():
    data = np.random.default_rng(3).bytes(70_000)
    cuts = [0, 1, 1, 4, 300, 65_536, 69_999, 70_000]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    terms = token_store.crc_terms(np.array([zlib.crc32(x) for x in parts]), len(data) - np.array(cuts[1:]))
    assert np.bitwise_xor.reduce(terms) == zlib.crc32(data)
    assert len(token_store.crc_terms(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_librarys(vocabulary, name):
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(vocabulary(name)), shared.PieceEncoder(vocabulary(name))
    contents = [x.content for x in library.get_added_tokens_decoder().values()]
    assert contents
    texts = ODD + [t for c in contents for t in (c, f"a {c} b", f"a{c}{c}\nb's", f"{c.upper()} x", f"{c[:-1]} {c[1:]}", f"你好 {c}  x")]
    found = [x.tolist() for x in coder.encode_all(texts)]
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert library.token_to_id(contents[0]) in coder.encode(f"a {contents[0]} b")


def thue_morse(letters, doublings):
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    return [a, b]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_meet_in_a_polynomial_hash(vocabulary, name):
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(vocabulary(name)), shared.PieceEncoder(vocabulary(name))
    texts = [w for n in (10, 11, 12) for w in thue_morse("ab", n) + thue_morse("xy", n)]
    texts += [" ".join(texts[:4]), " ".join(reversed(texts[:4]))]
    assert [x.tolist() for x in coder.encode_all(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pre_tokens_of_all_kinds_of_code_points(vocabulary, name):
    import random
    import unicodedata

    from tokenizers import Tokenizer

    library, coder, rng = Tokenizer.from_file(vocabulary(name)), shared.PieceEncoder(vocabulary(name)), random.Random(3)
    kinds: dict = {}
    for i in [*range(0x3000), *range(0x3000, 0x11000, 7), *range(0x1F300, 0x1F700, 5)]:
        if not 0xD800 <= i < 0xE000:
            kinds.setdefault(unicodedata.category(chr(i)), []).append(chr(i))
    assert len(kinds) > 25
    texts = []
    for chars in kinds.values():
        for _ in range(12):
            c = [rng.choice(chars) for _ in range(4)]
            texts += [f"a{c[0]}b 1{c[1]}2 {c[2]}'s it's{c[3]}", "".join(c), f"{c[0]} {c[1]}\n{c[2]}"]
    assert [x.tolist() for x in coder.encode_all(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_two_pre_tokens_of_one_key_are_told_apart(vocabulary, monkeypatch):
    plain = shared.run_hashes

    def weak(codes, starts, ends, twice=False):
        one, two = plain(codes, starts, ends, twice)
        return one % np.uint64(7), two

    coder = shared.PieceEncoder(vocabulary("byte_bpe_50k.json"))
    texts = ["the cat sat on a mat and it was not the dog", "a dog and the other cat", "the cat sat on a mat"] * 2
    want = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(shared, "run_hashes", weak)
    assert [x.tolist() for x in coder.encode_all(texts, most_chars=20)] == want


def reference(vocabulary, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    return {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in ROWS}


def test_store_round_trip(spark, docs, vocabulary, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, vocabulary("byte_bpe_50k.json"))
    ids = reference(vocabulary, "byte_bpe_50k.json")
    found = sorted(token_store.checked_documents(spark, path).collect())
    assert [r.doc_id for r in found] == sorted(ids)
    start = 0
    for r in found:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        start += r.n_tokens
    assert {r.doc_id: r.ids for r in token_store.read_documents(spark, path).collect()} == ids
    chunks = token_store.read_chunks(spark, path).collect()
    assert len({bytes(c.digest) for c in chunks}) == len(chunks)
    # two equal documents are stored once
    assert sum(c.n for c in chunks) <= sum(map(len, ids.values())) - len(ids[5])
    manifests = token_store.read_manifests(spark, path).collect()
    assert sum(m.documents for m in manifests) == len(ROWS) and sum(m.tokens for m in manifests) == start


def test_store_notices_a_lost_chunk(spark, docs, vocabulary, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs.where("doc_id = 5"), path, vocabulary("byte_bpe_50k.json"))
    token_store.read_chunks(spark, path).limit(0).selectExpr("digest id", "n", "payload").write.mode("overwrite").parquet(f"{path}/stage/kind=chunk")
    with pytest.raises(Exception, match="chunks are missing"):
        token_store.checked_documents(spark, path).collect()


@pytest.mark.parametrize("change", ["doc_id", "start", "n_tokens", "lengths", "a file", "all files", "a manifest"])
def test_store_notices_changed_and_lost_recipes(spark, docs, vocabulary, tmp_path, change):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, vocabulary("byte_bpe_50k.json"))
    assert token_store.checked_documents(spark, path).count() == len(ROWS)
    if change in ("a file", "all files", "a manifest"):
        names = sorted((tmp_path / "store" / ("manifests" if change == "a manifest" else "recipes")).glob("*.parquet"))
        full = [x for x in names if spark.read.parquet(str(x)).count()]
        for x in full if change == "all files" else full[:1]:
            x.unlink()
    else:
        wrong = {"lengths": "transform(lengths, (x, i) -> lengths[size(lengths) - 1 - i])"}.get(change, f"{change} + 1")
        rows = token_store.read_recipes(spark, path).withColumn(change, F.when(F.col("doc_id") == 11, F.expr(wrong)).otherwise(F.col(change)))
        kept = rows.toPandas()
        spark.createDataFrame(kept, rows.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    for read in (token_store.checked_documents, token_store.read_documents):
        with pytest.raises(ValueError, match="recipes and manifests differ"):
            read(spark, path).collect()


def test_store_of_repeated_and_missing_keys_and_of_nothing(spark, vocabulary, tmp_path):
    rows = [(2, "some words here"), (2, "some words here"), (2, "others"), (None, "lost")]
    path = str(tmp_path / "a")
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary("byte_bpe_50k.json"))
    assert [r.doc_id for r in token_store.checked_documents(spark, path).collect()] == [2, 2, 2]
    path = str(tmp_path / "b")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary("byte_bpe_50k.json"))
    assert token_store.checked_documents(spark, path).collect() == []


def test_chunks_do_not_depend_on_the_place():
    ids = np.random.default_rng(0).integers(0, 300, 5000).astype("<u2")
    alone = token_store.chunk_ends(ids, np.array([5000]))[0]
    among = token_store.chunk_ends(np.concatenate([ids[:7], ids, ids[:1]]), np.array([7, 5007, 5008]))
    assert among == [[7], alone, [1]]
    assert max(np.diff([0, *alone])) <= token_store.MOST
    shifted = token_store.chunk_ends(ids[11:], np.array([4989]))[0]
    assert len({x - 11 for x in alone} & set(shifted)) > len(alone) // 2


def test_packing(spark, docs, vocabulary):
    ids = reference(vocabulary, "word_bpe_49k.json")
    found = packing.pack_tokens(docs, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    own: dict = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(own.setdefault(r.doc_id, [])) and r.ids_crc32 == crc(r.ids) and r.length == len(r.ids) <= 2048
        own[r.doc_id] += r.ids
    assert own == ids
    sequences: dict = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048
    assert packing.pack_tokens(docs.limit(0), vocabulary("word_bpe_49k.json")).collect() == []


def test_packing_of_many_partitions_wastes_little(spark, vocabulary):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 900, 600).tolist()
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(40)
    found = packing.pack_tokens(df, vocabulary("word_bpe_49k.json")).collect()
    assert sorted(r.length for r in found) == sorted(n + 1 for n in sizes)
    filled: dict = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    least = sum(filled.values()) / 2048
    assert max(filled.values()) <= 2048 and len(filled) <= 1.05 * least + 1


def test_bins_against_a_plain_best_fit():
    rng = np.random.default_rng(3)
    bins, plain, made = packing.OpenBins(100, 4), [], 0
    for n in rng.integers(1, 101, 2000).tolist():
        fitting = [b for b in plain if b[1] >= n]
        if fitting:
            free = min(b[1] for b in fitting)
            chosen = [b for b in plain if b[1] == free][-1]
            plain.remove(chosen)
        else:
            if len(plain) >= 4:
                fullest = min(b[1] for b in plain)
                plain.remove([b for b in plain if b[1] == fullest][-1])
            chosen, made = [made, 100], made + 1
        assert bins.place(n)[1] == 100 - chosen[1]
        chosen[1] -= n
        if chosen[1]:
            plain.append(chosen)
    assert bins.next_id == made
