"""The corpus pipeline and each of its stages against brute force on a small table."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_operators import components, levels, shingles, split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABETS = {"aa": ["ka", "lo", "mi", "ta", "ren", "su"], "bb": ["ösch", "ung", "ich", "ä", "tz", "pf"]}


@pytest.fixture(scope="module")
def data():
    r = random.Random(17)
    prose = lambda lang, n: " ".join("".join(r.choices(ALPHABETS[lang], k=3)) for _ in range(n))
    texts = [(prose(lang, 60), lang) for lang in ["aa", "bb"] * 60]
    for i in range(0, 30, 3):  # exact copies, near copies by one word, and far ones by many
        text, lang = texts[i]
        words = text.split()
        texts += [(text, lang), (text, lang), (" ".join([*words[:30], "kalomi", *words[31:]]), lang), (" ".join([*words[:20], *prose(lang, 40).split()]), lang)]
    texts += [(prose("aa", 3000), "aa"), ("kalomi", "aa"), (None, "aa"), ("", None), (" \n", "bb"), ("12 34 !", "bb")]
    texts += [("".join(r.choices("гджзйцчшщъ ", k=200)), None) for _ in range(3)]
    ids = r.sample(range(1000), len(texts))
    return [(i, t, lang, None if k % 7 == 0 else f"s{k % 3}", len(t or "")) for k, (i, (t, lang)) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="module")
def sf_dir(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def in_a_language(rows):
    return [x for x in rows if any(c.isalpha() for c in x[1] or "") and not any("а" <= c <= "я" for c in x[1])]


def last_of_equals(rows):
    keep = {t: max(x[0] for x in rows if x[1] == t) for t in {x[1] for x in rows}}
    return [x for x in rows if keep[x[1]] == x[0]]


def first_of_near(rows):
    group = components([shingles(x[1], 5) for x in rows], 80)
    return [x for x, g in zip(rows, group) if x[0] == min(y[0] for y, h in zip(rows, group) if h == g)]


def rates(rows):
    sizes = defaultdict(int)
    for x in rows:
        sizes[x[3] or ""] += len(split(x[1]))
    order = sorted(s for s in sizes if s) + ([""] if "" in sizes else [])
    target = levels(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    return {s: target[s] / sizes[s] for s in sizes}


def check_mixed(copies, rows):
    """Every row has its source's rate, rounded down or up; nothing else is there."""
    rate = rates(rows)
    assert set(copies) <= {x[0] for x in rows}
    for x in rows:
        low = int(rate[x[3] or ""] + 1e-9)
        assert copies[x[0]] in (low, low + 1), x[0]


def check_packed(pieces, rows, copies):
    """Each copy's tokens are there once, in pieces of at most 1024, and sequences have neither gaps nor overlaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for x in rows:
        ids = [*t.encode(x[1] or "", add_special_tokens=False).ids, 0]
        raw = b"".join(v.to_bytes(4, "little") for v in ids)
        for s in range(0, len(ids), 1024):
            want[(x[0], s, min(1024, len(ids) - s), zlib.crc32(raw[4 * s : 4 * s + 4096]))] += copies[x[0]]
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces) == +want
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024


STAGES = dict(pipeline.STAGES)


@pytest.mark.parametrize(("name", "want"), [("language_id", in_a_language), ("exact_dedup", last_of_equals), ("near_dedup", first_of_near)])
def test_filters(spark, sf_dir, data, name, want):
    rows = data if name == "language_id" else in_a_language(data)
    got = STAGES[name](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf_dir)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(map(tuple, got.collect())) == Counter(want(rows)) and 0 < len(want(rows)) < len(rows)


def test_mix_and_packing(spark, sf_dir, data):
    rows = first_of_near(last_of_equals(in_a_language(data)))
    got = STAGES["mix_sources"](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf_dir).collect()
    assert {tuple(x) for x in got} <= set(rows)
    check_mixed(Counter(x.doc_id for x in got), rows)
    check_packed(STAGES["packing"](spark, spark.createDataFrame(data, SCHEMA), sf_dir).collect(), data, Counter(x[0] for x in data))


def test_run(spark, sf_dir, data):
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    rows = first_of_near(last_of_equals(in_a_language(data)))
    pieces = pipeline.run(spark, sf_dir).collect()
    copies = Counter(p.doc_id for p in pieces if p.start == 0)
    check_mixed(copies, rows)
    check_packed(pieces, rows, copies)


def test_kept_joins_by_id_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "e")], "doc_id long, `odd.name` string")
    verdict = spark.createDataFrame([(1, True), (2, False), (None, True), (3, True), (3, True)], "doc_id long, kept boolean")
    assert sorted(x[1] for x in pipeline._kept(docs, verdict).collect()) == ["a", "c", "d", "e"]


CLASHES = [f"{c} int" for c in ("kept_id", "mix_of", "mix_rate", "mix_copies", "mix_copy", "mix_salt", "row", "of", "again", "sha", "salt", "kept", "copies", "size", "rate", "rep", "label", "part", "fp", "words")]


def odd(data):
    """Rows with every name that stages add, repeated rows, null ids and texts."""
    rows = data + [data[0], data[0], (None, data[3][1], "aa", "s1", 5), (None, None, None, None, None), (data[5][0], "ka " * 20, "aa", "s0", 3)]
    return [(*x, *range(len(CLASHES))) for x in rows]


def test_stages_on_clashing_names_and_repeated_rows(spark, sf_dir, data):
    rows = odd(data)
    schema = SCHEMA + ", " + ", ".join(CLASHES)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    exact = [tuple(x) for x in STAGES["exact_dedup"](spark, docs, sf_dir).collect()]
    groups = defaultdict(list)
    for x in rows:
        groups[x[1] or ""].append(x)
    want = {max((y for y in g), key=lambda y: -1 if y[0] is None else y[0])[0:2] for g in groups.values()}
    assert Counter((i, t or "") for i, t, *_ in exact) == Counter((i, t or "") for i, t in want)
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        assert {tuple(x) for x in got.collect()} <= set(rows), name
        empty = stage(spark, spark.createDataFrame([], schema), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert {p.doc_id for p in STAGES["packing"](spark, docs, sf_dir).collect()} == {x[0] for x in rows}
    assert STAGES["packing"](spark, spark.createDataFrame([], schema), sf_dir).count() == 0


def test_run_leaves_only_its_result(spark, sf_dir):
    from tracklattice.plans.shared import made

    before = made()
    pipeline.run(spark, sf_dir)
    assert len([p for p in made() if p not in before]) == 1
