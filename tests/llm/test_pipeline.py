"""The pipeline's stages against plain versions, and its queries' agreement."""

import re
from collections import Counter

import duckdb
import pytest
import zstandard

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quadframe.llm import language_id, line_templates, mixing  # noqa: E402

from test_texts import WORDS, plain_components, sentence  # noqa: E402



def plain_margin(text, learned):
    sizes = []
    for data in learned.values():
        one = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        blocks = [text.lower().encode()[k : k + 4096] for k in range(0, len(text.encode()), 4096)]
        sizes.append(sum(len(one.compress(b + language_id.TAIL)) - len(one.compress(language_id.TAIL)) for b in blocks))
    first, second = sorted(max(1, n) for n in sizes)[:2]
    return 1 - first / second


def plain_mix(rows):
    """taken by document: sizes, targets, quotas and runs of blocks by plain loops over one shard per source."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    size = {x: sum(words[i] for i, _, s in rows if s == x) for x in names}
    goal, left, open_ = {}, 1.5 * sum(size.values()), [x for x in names if size[x]]
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    while True:
        over = [x for x in open_ if left * weight[x] / sum(weight[y] for y in open_) > 2 * size[x]]
        if not over:
            break
        for x in over:
            goal[x] = 2.0 * size[x]
        left, open_ = left - sum(goal[x] for x in over), [x for x in open_ if x not in over]
    total = sum(weight[y] for y in open_)
    goal |= {x: left * weight[x] / total for x in open_}
    return {x: goal.get(x, 0.0) for x in names}, size


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(11)
    rows = []
    for i in range(120):
        lang = rng.choice([*WORDS])
        text = "\n".join(sentence(lang, rng, 25) for _ in range(4))
        if i % 10 == 0:
            text += "\nThis very line stands in many of the documents"
        rows.append((i, text, lang, rng.choice(["a", "b", None]), len(text)))
    rows += [(200 + i, rows[5][1], rows[5][2], "a", 0) for i in range(3)]
    rows += [(300, None, "en", "a", 0), (301, "12 34", "en", "b", 5), (302, "", None, None, 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    # language identification
    one = corpus_pipeline.language(spark, docs, folder).cache()
    learned = language_id.train(docs.where(~language_id.in_fold(docs.doc_id)))
    keep = {r.doc_id: r for r in docs.collect() if re.search("[a-z]", r.text or "") and plain_margin(r.text, learned) >= language_id.MARGIN}
    assert one.columns == names and {r.doc_id: r for r in one.collect()} == keep and len(keep) == 123
    # line dedup
    two = corpus_pipeline.line_dedup(spark, one, folder).cache()
    con = duckdb.connect()
    con.register("docs", one.toPandas())
    want = dict(con.execute(line_templates.oracle("doc_id, text", "docs", copies=corpus_pipeline.COPIES)).fetchall())
    assert two.columns == names and {r.doc_id: r.text for r in two.collect()} == want
    assert all(r.n_chars == len(r.text) for r in two.collect() if r.text != keep[r.doc_id].text)
    # near duplicates
    three = corpus_pipeline.near_duplicates(spark, two, folder).cache()
    leaders = {i for i, (_, c) in plain_components(want).items() if i == c}
    assert three.columns == names and {r.doc_id for r in three.collect()} == leaders and not {200, 201, 202} & leaders
    # mix
    four = corpus_pipeline.mix(spark, three, folder).cache()
    taken = {r.doc_id: r for r in mixing.mix_sources(three).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in three.collect()]
    goal, size = plain_mix(rows)
    for x in goal:
        own = [taken[i] for i, _, s in rows if s == x]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(size[x], round(goal[x], 6))}
        # whole blocks of words: no source is off by more than one block and one of its documents
        assert abs(sum(r.taken for r in own) - goal[x]) <= 64 + max(r.size for r in own) and all(r.taken <= 2 * r.size for r in own)
    copies = {i: int(r.taken / r.size + 0.5) for i, r in taken.items() if r.size and int(r.taken / r.size + 0.5)}
    assert four.columns == names and Counter(r.doc_id for r in four.collect()) == copies
    # packing
    five = corpus_pipeline.pack(spark, four, folder).collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == copies
    assert all(re.fullmatch(r"\d+", str(r.sequence_id)) for r in five)


@pytest.mark.parametrize("number", range(5))
def test_stages_of_empty_tables_and_odd_columns(spark, folder, number):
    rows = [(1, "der die und das nicht ist ein mit " * 9, "de", "a", 1, "x", 5), (None, None, None, None, None, None, None), (2, "w " * 30000, "en", "b", 1, "y", 6)]
    docs = spark.createDataFrame(rows, COLUMNS + ", drop string, size long")
    name, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, docs.limit(0), folder).collect() == []
    found = stage(spark, docs, folder)
    assert name == "packing" or found.columns == docs.columns
    assert {r.doc_id for r in found.collect()} - {None} <= {1, 2} and found.count() >= 1


def test_run(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 0


def test_repeated_and_missing_ids(spark, folder):
    import random

    rng = random.Random(4)
    own = [sentence("en", rng, 60) for _ in range(6)]
    rows = [(1, own[0]), (1, own[0]), (1, own[1]), (None, own[2]), (None, own[2]), (None, own[3]), (2, own[4]), (None, own[4]), (3, own[5])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    one = corpus_pipeline.near_duplicates(spark, docs, folder)
    found = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
    assert found == sorted([(1, own[0]), (1, own[1]), (None, own[2]), (None, own[3]), (2, own[4]), (3, own[5])], key=str)
    # of one source whose target is one and a half times its words, no row is taken more than twice
    many = [(i % 7 if i % 3 else None, f"{own[i % 6]} {i}") for i in range(90)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in many], COLUMNS)
    two = corpus_pipeline.mix(spark, docs, folder)
    times = Counter(r.text for r in two.collect())
    assert two.columns == docs.columns and max(times.values()) <= 2 and 1.3 * len(many) < sum(times.values()) < 1.7 * len(many)
    assert any(r.doc_id is None for r in two.collect())


def test_lines_of_parts_of_a_longer_document_go(spark, folder):
    """A part owes all of its lines to the longer document, but is no near duplicate of it: no later stage takes it out.  A copy is left to the next stage."""
    import random

    rng = random.Random(5)
    lines = [" ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(9)) for _ in range(40)]
    part = "\n".join(lines[:3])
    copy, another = ("\n".join([*lines[:-1], f"an end that only the {x} has"]) for x in ("copy", "other"))
    texts = {1: "\n".join(lines), 2: part, 3: part + "\na line of its own", 4: copy, 5: another}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], COLUMNS)
    two = corpus_pipeline.line_dedup(spark, docs, folder).cache()
    found = {r.doc_id: r.text for r in two.collect()}
    assert found[2] == "" and found[3] == "a line of its own" and (found[4], found[5]) == (copy, another)
    left = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, two, folder).collect()}
    assert not {part, copy, another} & set(left.values()) and left[3] == "a line of its own"


def test_all_templates_of_a_segment_are_tried(spark, folder):
    """The template most like a line is the most frequent one in none of its segments."""
    pairs, own = ["ax ay", "bx by", "cx cy", "dx dy"], [[f"{p}{c}x {p}{c}y" for c in "klmn"] for p in "pqr"]
    rivals = [" ".join(["we saw one", *(pairs[i] if i == k else x for i, x in enumerate(own[k]))]) for k in range(3)]
    best = " ".join(["we saw one", *pairs])
    lines = [x for x in rivals for _ in range(5)] + [best] * 3 + [best.replace("dy", "zz")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    ends = [" ".join(f"{letters[i]}{letters[j]}own" for j in range(20)) for i in range(len(lines))]
    docs = spark.createDataFrame([(i, f"{x}\n{y}", "en", "a", 0) for i, (x, y) in enumerate(zip(lines, ends))], COLUMNS)
    found = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, folder).collect()}
    assert found[15] == f"{best}\n{ends[15]}" and found[18] == ends[18]
