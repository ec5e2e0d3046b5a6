"""Fingerprints, line templates, language identification, mixing and the n-gram join on small cases."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadframe.llm import fingerprints, language_id, line_templates, mixing, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, taken string"


def frame(spark, texts, langs=None, sources=None, ids=None):
    rows = [((ids or range(len(texts)))[i], t, (langs or [None] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or ""), 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# ---------------------------------------------------------------- fingerprints
def plain_order_minhash(text, k, tuple_size, sketches):
    base, seen = [], Counter()
    for h in fingerprints.kmer_hashes(text, k).tolist():
        x = np.array([h], np.uint64)
        if seen[h]:
            x = fingerprints._mix(x + np.uint64(seen[h]) * fingerprints._ODD)
        seen[h] += 1
        base.append(int(x[0]))
    factors, masks = (x.tolist() for x in fingerprints._functions(sketches))
    out = []
    for i in range(sketches):
        least = sorted(sorted(range(len(base)), key=lambda j: ((((base[j] >> 32) ^ masks[i]) * factors[i]) & 0xFFFFFFFF, j))[:tuple_size])
        h = np.array([i], np.uint64) * fingerprints._ODD
        for j in least:
            h = fingerprints._mix(h * np.uint64(0xD1342543DE82EF95) + np.uint64(base[j]))
        out.append(int(h[0] >> np.uint64(32)))
    return out


@pytest.mark.parametrize("text", ["", "a", "abcabcabcabcabcabc" * 3, "the cat sat on the mat " * 9, "你好 世界 " * 7])
def test_fingerprint_by_hand(text):
    with np.errstate(over="ignore"):
        assert fingerprints.order_minhash(text, 5, 3, 16).tolist() == plain_order_minhash(text, 5, 3, 16)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fingerprint_by_its_definition():
    """The method written anew: numbered k-mers, the least by a random function each, in text order."""

    def plain(text, k, size, sketches, seed):
        seen, marks = Counter(), []
        for i in range(len(text) - k + 1):
            x = text[i : i + k]
            marks.append((x, seen[x], i))
            seen[x] += 1
        out = []
        for j in range(sketches):
            rank = lambda m: hashlib.md5(f"{seed} {j} {m[0]} {m[1]}".encode()).digest()
            out.append(tuple(m[:2] for m in sorted(sorted(marks, key=rank)[:size], key=lambda m: m[2])))
        return out

    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    versions = [base]
    for edits in (4, 12, 40, 120):
        x = list(base)
        for _ in range(edits):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        versions.append("".join(x))
    versions += [base[200:] + base[:200], "".join(rng.choice("abcdefgh ") for _ in range(400))]
    want, got = [], []
    for v in versions:
        a, b = plain(base, 6, 2, 300, 1), plain(v, 6, 2, 300, 1)
        want.append(np.mean([x == y for x, y in zip(a, b)]))
        got.append(fingerprints.likeness(fingerprints.order_minhash(base, 6, 2, 300), fingerprints.order_minhash(v, 6, 2, 300)))
    # both estimate the same likeness, from unlike random functions
    assert all(abs(x - y) < 0.12 for x, y in zip(want, got))
    # and it falls with the edit distance
    distance = [edit_distance(base, v) for v in versions]
    assert distance[:5] == sorted(distance[:5]) and got[:5] == sorted(got[:5], reverse=True) and got[0] == 1 and got[-1] < 0.02 and got[-2] < 0.8


def test_fingerprint_follows_order():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    text, moved = " ".join(words), " ".join(words[300:] + words[:300])
    mark = fingerprints.order_minhash
    # the same k-mers in another order are less like than a few edits
    assert fingerprints.likeness(mark(text), mark(" ".join(words[:590]))) > fingerprints.likeness(mark(text), mark(moved)) + 0.2


@pytest.mark.parametrize("texts", [["abcdefgh" * 9, None, "", "xyz" * 30, "abcdefgh" * 9, "z" * 3000], ["only"], []])
def test_compare_with_next(spark, texts):
    found = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        t, then = t or "", texts[(i + 1) % len(texts)] or ""
        changed = fingerprints.edited(t, then)
        r, mark = found[i], fingerprints.order_minhash
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == mark(t).astype(">u4").tobytes().hex() and r.edited_fingerprint == mark(changed).astype(">u4").tobytes().hex()
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(mark(t), mark(changed)), fingerprints.likeness(mark(t), mark(then)))


def test_compare_with_next_takes_ties_null_keys_and_other_columns(spark):
    df = spark.createDataFrame([(None, "aa", "x", "y"), (1, "bb", "x", "y"), (1, "bb", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, k string, fingerprint string")
    rows = sorted(map(tuple, fingerprints.compare_with_next(df).select("doc_id", "n_chars", "edited_sha256", "near_next").collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == sorted([(None, 2, sha("ab"), 0.0), (1, 2, sha("bb"), 1.0), (1, 2, sha("b"), 0.0), (2, 0, sha(""), 0.0)], key=str)


# ---------------------------------------------------------------- lines
def lines_of(i):
    return "\n".join([f"GET page {i} took {i * 3} ms", f"{'abcdefghijkl'[i] * 4} is an own line of it", "All rights are reserved here", "", "Hi"])


def test_lines_equal_sql(spark):
    rng = random.Random(2)
    texts = [lines_of(i) for i in range(12)] + ["All rights are reserved here", "x " * 20000, "a b c\n" * 50]
    texts += ["\n".join(" ".join(rng.choice(["red", "green", "blue", "7", "x1"]) for _ in range(rng.randint(1, 7))) for _ in range(6)) for _ in range(40)]
    df = frame(spark, texts)
    found = line_templates.drop_recurring_lines(df)
    con = duckdb.connect()
    con.register("docs", df.toPandas())
    want = con.execute(line_templates.oracle(source="docs")).fetchall()
    assert sorted(map(tuple, found.select("doc_id", "text", "n_lines", "n_dropped").collect())) == sorted(want)
    kept = {r.doc_id: r for r in found.collect()}
    assert kept[0].text == lines_of(0) and "GET" not in kept[5].text and kept[5].text.startswith("ffff is an own line") and kept[12].text == "" and "Hi" not in kept[3].text
    assert set(found.columns) == {*df.columns, "n_lines", "n_dropped"}
    for copies in (0.5, 0.75):
        want = con.execute(line_templates.oracle(source="docs", copies=copies)).fetchall()
        assert sorted(map(tuple, line_templates.drop_recurring_lines(df, copies=copies).select("doc_id", "text", "n_lines", "n_dropped").collect())) == sorted(want)


def test_several_templates_of_one_leaf(spark):
    one = [f"the big red car{'abcde'[i]} stops near walls often" for i in range(5)]
    two = ["the big red boats never sail at night"] * 6
    three = [f"the big red {a} of {b} has come" for a, b in zip("kkkmmmppp", "rstrstrst")]
    once = ["the big red word that nobody else says", "the big", "7 8 9", "1 2 3", "4 5 6"]
    pair = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopq'[i // 10]}" for i in range(60))
    texts = [*one, *two, *three, *once, f"one\n{pair}", f"two\n{pair}", " ".join(pair.split()[:40]), " ".join(pair.split()[:40])]
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(frame(spark, texts)).collect()}
    dropped = [found[i].n_dropped for i in range(len(texts))]
    assert dropped[:11] == [0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1]
    # a family of two variable fields whose values are common by themselves is found by its most common token
    assert dropped[11:20] == [0] + [1] * 8
    # rows of numbers are no template; a long line recurs from two documents, a shorter one from three
    assert dropped[20:] == [0] * 5 + [0, 1, 0, 0] and found[26].text == "two"


@pytest.mark.parametrize("rare", [1, 2, 3])
def test_rare_fillers_join_a_recurring_template(spark, rare):
    """Lines with a filler of their own are lines of the recurring template of their leaf; three of them are a template themselves, whose first line stays."""
    base = "the big red car stops near {} often"
    other = "the big red house {} beside the river"
    texts = [base.format("walls")] * 5 + [base.format(f"gates{'x' * i}") for i in range(rare)]
    texts += [other.format("stands")] * 3 + [other.format("leans"), "the big red car flies over every green hill", "the big red car stops near walls"]
    found = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == [0, *[1] * 4, *([1] * rare if rare < 3 else [0, 1, 1]), 0, 1, 1, 1, 0, 0]


def test_the_most_alike_template_takes_a_line(spark):
    a, b = ("we saw one small bird on the {} roof today again".format(x) for x in ("old", "new"))
    near_b = b.replace("today", "tonight")
    texts = [a] * 4 + [b] * 3 + [near_b]
    df = frame(spark, texts)
    found = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(df).collect()}
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    assert con.execute(f"SELECT doc_id, n_dropped FROM ({line_templates.oracle('doc_id, n_dropped')}) ORDER BY doc_id").fetchall() == sorted(found.items())
    assert found[7] == 1


def test_every_template_of_a_segment_is_met(spark):
    """The template most like a line may be the most frequent one in none of its segments."""
    pairs = ["a1 a2".replace("1", "x").replace("2", "y"), "bx by", "cx cy", "dx dy"]
    own = lambda k: [f"{'pqr'[k]}{c}x {'pqr'[k]}{c}y" for c in "klmn"]
    rivals = [" ".join(["we saw one", *(pairs[i] if i == k else x for i, x in enumerate(own(k)))]) for k in range(3)]
    best = " ".join(["we saw one", *pairs])
    texts = [x for x in rivals for _ in range(5)] + [best] * 3 + [best.replace("dy", "zz")]
    df = frame(spark, texts)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    for every in (False, True):
        found = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(df, every=every).collect()}
        assert con.execute(f"SELECT doc_id, n_dropped FROM ({line_templates.oracle('doc_id, n_dropped', every=every)}) ORDER BY doc_id").fetchall() == sorted(found.items())
        assert found[18] == every


def test_small_leaves_in_one_row_equal_counted_ones(spark):
    """Lines of a small leaf meet in one row; counting their tokens one by one, as for large leaves, gives the same templates."""
    rng = random.Random(9)
    rows = [(i, -i, i % 7, rng.randint(1, 3), ["one", "two", "<*>", *(rng.choice(["red", "blue", "<*>", f"own{i}"]) for _ in range(6 + i % 7))]) for i in range(60)]
    varied = spark.createDataFrame(rows, "l1 long, l2 long, leaf long, docs long, tokens array<string>")
    few, many = (sorted(map(repr, f(varied, F.lit(3), 3, 0.7).collect())) for f in (line_templates._shapes_of_few, line_templates._shapes_of_many))
    assert few == many and len(few) == 60 and any("wild=[" in x for x in few) and any("wild=None" in x for x in few)


def test_even_lines_and_others_of_equal_tokens_are_one(spark):
    lines = ["a b c d e", "a  b c d e", " a b c d e", "a b\tc d e ", "a b c 12 e", "a b c <*> e", "a b c 7x\u00e9 e", "1 2 3 d", "1 2 4 d", "x", "\u00e9 y", " x\r", "ab c d e", "a b c de"]
    told = line_templates._told(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), 3, 0.5)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" in plan  # even lines are hashed as they are, not token by token
    found = {r["i"]: r for r in told.collect()}

    def tokens(x):
        raw = x.split()
        masked = ["<*>" if any("0" <= c <= "9" for c in t) else t for t in raw]
        return tuple(masked if sum(t != "<*>" for t in masked) >= 0.5 * len(masked) else raw)

    for i, x in enumerate(lines):
        assert found[i]["n"] == len(tokens(x))
        for j, y in enumerate(lines):
            same, leaf = tokens(x) == tokens(y), (len(tokens(x)), tokens(x)[:3]) == (len(tokens(y)), tokens(y)[:3])
            assert ([found[i][c] for c in ("l1", "l2")] == [found[j][c] for c in ("l1", "l2")]) == same
            assert (found[i]["leaf"] == found[j]["leaf"]) == leaf


def test_lines_of_copies_are_left_to_document_dedup(spark):
    own = ["\n".join(f"{'abcdefgh'[d]}{'ijklmn'[i]} line of some length here {'abcdefgh'[d]}" for i in range(6)) for d in range(3)]
    shared = "a line that all of them share"
    texts = [f"{own[0]}\n{shared}", f"{own[0]}\n{shared}", f"{own[0]}\n{shared}", f"{own[1]}\n{shared}", shared]
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(frame(spark, texts), copies=0.75).collect()}
    assert [found[i].text for i in range(3)] == texts[:3] and found[3].text == own[1]
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(frame(spark, texts)).collect()}
    assert [found[i].text for i in range(5)] == [texts[0], "", "", own[1], ""]


def test_lines_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "x y z w", i, "a", "b") for i in range(4)], "doc_id long, text string, k1 long, drop string, __rows string")
    found = line_templates.drop_recurring_lines(df)
    assert found.columns == [*df.columns, "n_lines", "n_dropped"] and sorted(r.n_dropped for r in found.collect()) == [0, 1, 1, 1]
    assert sorted((r.k1, r.drop) for r in line_templates.drop_recurring_lines(df, copies=0.75).collect()) == [(i, "a") for i in range(4)]


def test_lines_of_nulls_and_repeated_rows(spark):
    df = frame(spark, [None, "", lines_of(1), lines_of(1), lines_of(2)], ids=[0, 1, 2, 2, None])
    found = line_templates.drop_recurring_lines(df).collect()
    assert len(found) == 5 and all(r.n_dropped == 0 for r in found)
    assert line_templates.drop_recurring_lines(df.limit(0)).collect() == []


# ---------------------------------------------------------------- language
WORDS = {"en": "the and of to in that is was with for", "de": "der die und das nicht ist ein mit für sich", "fr": "le la et les des en un du une est"}


def sentence(lang, rng, n=60):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "en", "s"]) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(4)
    langs = [rng.choice([*WORDS]) for _ in range(400)]
    texts = [sentence(x, rng) for x in langs]
    langs_seen = [x if i % 7 else None for i, x in enumerate(langs)]
    df = frame(spark, [*texts, None, "", "123 ... !", "é" * 200_000], [*langs_seen, "en", "en", "de", None])
    learned = language_id.train(df.where(~language_id.in_fold(F.col("doc_id"))))
    assert set(learned) == set(WORDS) and max(map(len, learned.values())) <= language_id.SAMPLE_BYTES
    found = {r.doc_id: r for r in language_id.identify(df, learned).collect()}
    assert len(found) == 404
    assert [found[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and found[401].rejected and found[402].score == 0
    right = [found[i].lang_pred == x for i, x in enumerate(langs)]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in found.values())
    assert found[3].text == texts[3] and "taken" in language_id.identify(df, learned).columns


def test_language_by_plain_compression(spark):
    import zstandard

    rng = random.Random(9)
    texts = [sentence(rng.choice([*WORDS]), rng, n) for n in (1, 2, 5, 30, 255, 256, 3000) for _ in range(4)] + ["12", "x", "É" * 5000]
    df = frame(spark, texts)
    learned = {x: sentence(x, rng, 3000).encode() for x in WORDS}
    found = {r.doc_id: r for r in language_id.identify(df, learned).collect()}

    def size(data, dictionary):
        one = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=one, write_content_size=False, write_dict_id=False).compress(data))

    for i, t in enumerate(texts):
        data, tail = t.lower().encode(), b"0123456789" * 26
        blocks = [data[k : k + 4096] for k in range(0, len(data), 4096)]
        sizes = sorted((max(1, sum(size(b + tail, d) - size(tail, d) for b in blocks)), n, x) for n, (x, d) in enumerate(learned.items()))
        want = (sizes[0][2], 1 - sizes[0][0] / sizes[1][0]) if re.search("[^\\W\\d_]", t) else ("und", 0.0)
        assert (found[i].lang_pred, found[i].score) == want and found[i].rejected == (want[0] == "und" or want[1] < language_id.MARGIN)


def test_language_without_training(spark):
    df = frame(spark, ["some text"])
    assert language_id.train(df) == {}
    assert language_id.identify(df, {}).collect()[0].lang_pred == "und"
    assert language_id.identify(df.limit(0), {"en": b"the"}).collect() == []


@pytest.mark.parametrize("text, letter", [("½ ² ①", False), ("Ⅷ", False), ("12 _ -", False), ("", False), (None, False), ("ª", True), ("7 ж", True), ("你", True), ("ʰ", True), ("\u0301", False)])
def test_letters_are_of_category_l(text, letter):
    assert any(unicodedata.category(c).startswith("L") for c in text or "") == letter
    found = language_id.Identifier({"en": b"the and of to in that", "fr": b"le la et les des en"}).predict(text)
    assert (found == ("und", 0.0)) != letter


# ---------------------------------------------------------------- mixing
def plain_sainte_lague(votes, seats, most):
    won = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if won[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        won[max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_sainte_lague_by_hand():
    rng = random.Random(5)
    for _ in range(60):
        votes = [rng.choice([0, 1, 3, 10, 57.5, 200]) for _ in range(rng.randint(1, 8))]
        most = [rng.randint(0, 30) for _ in votes]
        seats = rng.randint(0, 60)
        assert mixing.sainte_lague(votes, seats, most) == plain_sainte_lague(votes, seats, most)


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, 250 * 2 / 3, 250 / 3]
    assert mixing.targets([], []) == [] and mixing.targets([0, 4], [5, 2]) == [0.0, 6.0]


def test_mix(spark):
    rng = random.Random(6)
    texts = ["w " * rng.randint(0, 300) for _ in range(900)] + [None, "", "x " * 20000]
    sources = [rng.choice(["b", "b", "b", "a", "é", None]) for _ in texts]
    df = frame(spark, texts, sources=sources)
    found = mixing.mix_sources(df).collect()
    assert len(found) == len(texts)
    groups: dict = defaultdict(list)
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        groups[sources[r.doc_id]].append(r)
    names = sorted(x for x in groups if x) + [None]
    sizes = [sum(r.size for r in groups[x]) for x in names]
    for x, size, goal in zip(names, sizes, mixing.targets(sizes, [5, 2, 1, 5])):
        assert {(r.source_size, r.target) for r in groups[x]} == {(size, goal)}
        assert abs(sum(r.taken for r in groups[x]) - goal) <= 0.02 * goal
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(again) == sorted(found)
    assert mixing.mix_sources(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix_sources(frame(spark, [None, ""])).collect()] == [0, 0]


def plain_mix_words(docs, start):
    """The mix word by word: docs are (doc_id, size, source, hash, shard hash); ``start`` is the seeded hash of a shard of a source."""
    names = sorted({d[2] for d in docs if d[2] is not None}) + [None] * any(d[2] is None for d in docs)
    sizes = [sum(d[1] for d in docs if d[2] == x) for x in names]
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    block = max(1, min([64, *(n // 128 for n in sizes if n)]))
    shards: dict = defaultdict(list)
    for s, x in enumerate(names):
        rows = sum(d[2] == x for d in docs)
        n = max(1, min(-(-rows // mixing.SHARD_ROWS), mixing.SHARDS * rows // max(1, len(docs))))
        for d in docs:
            if d[2] == x:
                shards[s, d[4] % n].append(d)
    words = {at: [d[0] for d in sorted(own, key=lambda d: (d[3], d[0], d[1])) for _ in range(d[1])] for at, own in shards.items()}
    blocks = {at: -(-len(w) // block) for at, w in words.items()}
    most = [2 * sum(n for (s, _), n in blocks.items() if s == i) for i in range(len(names))]
    quota, taken = plain_sainte_lague(goal, round(sum(goal) / block), most), Counter()
    for s in range(len(names)):
        own = sorted(x for i, x in words if i == s)
        won = plain_sainte_lague([len(words[s, x]) for x in own], quota[s], [2 * blocks[s, x] for x in own])
        for x, seats in zip(own, won):
            n = blocks[s, x]
            first = start[s, x] % n if n else 0
            for i in range(seats):  # block after block, round and round
                b = (first + i) % n
                taken.update(words[s, x][b * block : (b + 1) * block])
    return taken


def test_mix_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 60)
    rng = random.Random(16)
    texts = ["w " * rng.choice([0, 1, 7, 40, 300]) for _ in range(500)] + ["x " * 3000]
    sources = [rng.choice(["b", "b", "b", "a", "c", None]) for _ in texts]
    df = frame(spark, texts, sources=sources)
    hashed = df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(42)).alias("h")).select("doc_id", "h", F.xxhash64("h", F.lit(43)).alias("x")).collect()
    start = {(r.s, r.x): r.h for r in spark.range(10).selectExpr("id AS s", "explode(sequence(0, 99)) AS x").select("s", "x", F.xxhash64(F.lit(42), "s", "x").alias("h")).collect()}
    want = plain_mix_words([(r.doc_id, len(texts[r.doc_id].split()), sources[r.doc_id], r.h, r.x) for r in hashed], start)
    found = {r.doc_id: r.taken for r in mixing.mix_sources(df).collect()}
    assert found == {i: want[i] for i in range(len(texts))} and len(set(found.values())) > 15


def test_sainte_lague_of_a_table_equals_that_of_lists(spark):
    rng = random.Random(21)
    for votes, most in [([rng.choice([0.0, 1.0, 3.0, 10.0, 57.5, 200.0]) for _ in range(40)], [rng.randint(0, 30) for _ in range(40)]), ([7.0] * 50, [9] * 50), ([1e15, 1.0, 0.5], [10**12, 3, 3])]:
        table = spark.createDataFrame(list(zip(range(len(votes)), votes, most)), "s long, v double, cap long").cache()
        for seats in (0, 1, 33, sum(most) - 1, sum(most) + 5):
            assert [r.seats for r in mixing.sainte_lague_table(table, seats).orderBy("s").collect()] == mixing.sainte_lague(votes, seats, most)


def test_mix_of_very_many_sources(spark):
    """As many sources as documents, but for a hot one: none is a row on the driver, and targets, quotas and reruns hold."""
    n = 30_000
    df = spark.range(n).selectExpr("id AS doc_id", "repeat('w ', cast(pmod(xxhash64(id), 300) as int)) AS text", "if(id % 3 = 0, 'hot', if(id = 1, null, 's' || id)) AS source", "'x' AS shards", "1 AS s")
    found = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    rows = df.selectExpr("doc_id", "source", "size(split(text, ' ')) - 1 AS n").collect()
    size: Counter = Counter()
    for r in rows:
        size[r.source] += r.n
    names = sorted(x for x in size if x is not None) + [None]
    goal = dict(zip(names, mixing.targets([size[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert len(found) == n
    for r in rows:
        f = found[r.doc_id]
        assert (f.size, f.source_size) == (r.n, size[r.source]) and math.isclose(f.target, goal[r.source]) and 0 <= f.taken <= 2 * f.size
    total = sum(f.taken for f in found.values())
    assert abs(total - 1.5 * sum(size.values())) < 0.01 * total
    hot = sum(found[r.doc_id].taken for r in rows if r.source == "hot")
    assert abs(hot - goal["hot"]) <= 0.01 * goal["hot"]


# ---------------------------------------------------------------- n-grams
def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 30, 120]))] for _ in range(12)]
    texts = {}
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        # a passage that many share, and chains of growing texts
        w = w + base[3] if rng.random() < 0.3 else w[: rng.randint(1, len(w))] if rng.random() < 0.3 else w
        texts[i * 3 + 1] = " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w)
    texts |= {500: None, 501: "", 502: " \n ", 503: "one two", 504: "ONE  two", 505: "z " * 30000}
    df = frame(spark, [*texts.values()], ids=[*texts])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(df).collect()}
    assert found == plain_components(texts)


def test_components_after_a_row_without_a_key(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    # the last words of a near copy differ, so some share the prefix group of the row without a key
    near = [" ".join(words[:-i] + [f"z{i}"] * i) for i in range(1, 9)]
    texts = [" ".join(words), *near, " ".join(words), "another text without any near copy at all"]
    rows = [(None, t) for t in texts] + list(enumerate(texts))
    found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == plain_components(dict(enumerate(texts)))
    assert sorted(r.n_shingles for r in found if r.doc_id is None) == sorted(r.n_shingles for r in found if r.doc_id is not None)
    assert all(r.component_id is None for r in found if r.doc_id is None)


def test_components_of_odd_tables(spark):
    df = frame(spark, ["a b c d e f g", "a b c d e f g", None], ids=[4, 4, None])
    assert sorted(map(tuple, ngram_join.link_documents(df).collect()), key=str) == sorted([(4, 3, 4), (4, 3, 4), (None, 0, None)], key=str)
    assert ngram_join.link_documents(df.limit(0)).collect() == []


def test_words_that_meet_in_a_polynomial_hash_are_no_copies(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    texts = dict(enumerate([a, b, f"{a} {b} c d e f", f"{b} {a} c d e f", a[:1024], b[:1024]]))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(frame(spark, [*texts.values()])).collect()}
    assert found == plain_components(texts) and len({c for _, c in found.values()}) == 6


def test_parity_bits_never_rule_out_too_much():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.r_[rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])
        if len(b):
            assert ngram_join.differing_bits(ngram_join.parity_bits(a), ngram_join.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_a_pair_of_many_lists_is_made_in_one_of_them():
    bits = ngram_join.parity_bits(np.arange(40, dtype=np.uint64))
    # nodes in components of their own, of which all are in the lists 3 and 5, and the last ones in list 7 too
    rows = [(node, 40, node, False, bits, [5, 3, 7] if node >= 20 else [3, 5]) for node in range(30)]
    made = [pair for name in (3, 5, 7) for pair in ngram_join._may_link(name, rows, [x for x in rows if name in x[5]], 75, 100)]
    assert {pair for pair in made if pair[0] != pair[1]} == {(a, b) for a in range(30) for b in range(a + 1, 30)}
    assert {x for x in ngram_join._may_link(5, rows, rows, 75, 100)} == set() == {x for x in ngram_join._may_link(7, rows, rows, 75, 100)}


def test_short_bitmaps_of_long_sets_tell_them_apart():
    rng = np.random.default_rng(8)
    for n in (100, 500, 1000):
        a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in "ab")
        near = np.unique(np.r_[a[: n - n // 8], b[: n // 8]])
        x, y, z = map(ngram_join.parity_bits, (a, b, near))
        assert len(x) * 8 <= max(256, 2 * n)
        allowed = lambda p, q, m, k: 175 * ngram_join.differing_bits(p, q) <= 25 * (m + k)
        assert not allowed(x, y, len(a), len(b)) and allowed(x, z, len(a), len(near))


def test_links_of_known_pairs_equal_the_join(spark):
    rng = random.Random(6)
    base = sentence("en", rng, 40).split()
    texts = [None, "", " \n", "a b", "A  b\n", "a b c d e", " ".join(base), " ".join(base).upper(), "\t".join(base), " ".join(base + base), " ".join(base[:33]), " ".join(base[:35]), " ".join(base[4:]), " ".join([*base[:20], "new", *base[21:]]), " ".join([*base[:38], "new"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pairs = rows.crossJoin(rows.select(F.col("i").alias("j"), F.col("t").alias("u"))).where("i < j")
    sets = [set(x.tolist()) for x in ngram_join.shingle_sets([None if t is None else t.encode() for t in texts])]
    want = {(i, j): bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    assert {(r.i, r.j): r.linked for r in pairs.select("i", "j", ngram_join.likeness_links(F.col("t"), F.col("u")).alias("linked")).collect()} == want
    assert any(want.values()) and not all(want.values())


@pytest.mark.parametrize("length", [5, 8, 13])
def test_all_templates_equal_sql_on_random_lines(spark, length):
    """Variants of a few lines: a line is alike to many templates, of which the most alike one takes it."""
    rng = random.Random(length)
    bases = [["we", "saw", "one", *(rng.choice("abc") + "x" for _ in range(length - 3))] for _ in range(3)]
    made = []
    for _ in range(160):
        line = [*rng.choice(bases)]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            line[rng.randrange(3, length)] = rng.choice("abcdefgh") + "x"
        made.append(" ".join(line))
    df = frame(spark, [*made, made[0] + "\n" + made[1]])
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    found = line_templates.drop_recurring_lines(df, every=True).select("doc_id", "text", "n_lines", "n_dropped")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(line_templates.oracle(every=True)).fetchall())
