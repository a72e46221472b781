"""Each stage of the pipeline against what its own input demands."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from lumenfold.llm import mixing, quality
from lumenfold.llm._scratch import written

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def test_one_row_of_a_group_stays(spark, make_docs):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = text(1).rsplit(" ", 1)[0] + " other"
    rows = [(1, text(0))] * 3 + [(2, text(0)), (None, text(0))]  # repeated rows, a copy with an id and one without
    rows += [(None, text(1))] * 3 + [(None, near)]  # no id in the class
    rows += [(3, text(2)), (3, text(3)), (3, ""), (4, text(3))]  # different texts of one id
    rows += [(None, None), (None, ""), (None, " "), (5, ""), (5, ""), (6, None), (None, text(4)), (7, text(5))]
    got = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, make_docs(rows), SF).collect()]
    nameless = [t for i, t in got if i is None and t and t.strip()]
    assert len(nameless) == 2 and text(4) in nameless and (text(1) in nameless or near in nameless)
    assert Counter(x for x in got if x[0] is not None or not (x[1] or "").strip()) == Counter([(1, text(0)), (3, text(2)), (5, ""), (6, None), (7, text(5)), (None, None), (None, ""), (None, " ")])
    assert pipeline.drop_near_copies(spark, make_docs([]), SF).count() == 0


def test_a_rest_of_the_whole_source_is_an_epoch(spark, make_docs):
    rows, at = [], 0
    for source, size in zip("abcd", (51, 14, 60, 7), strict=True):
        for k in range(0, size, 7):
            rows.append((at := at + 1, "w " * min(7, size - k), source))
    docs = make_docs(rows)
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = Counter()
    for r in pipeline.mix_sources(spark, docs, SF).collect():
        got[r.doc_id] += len(WORDS(r.text))
    assert dict(got) == want and sum(want[i] for i, _, s in rows if s == "b") == 28


def test_the_mix_of_texts_takes_what_the_mix_takes(spark, make_docs):
    cases = [
        [(2, "w " * 8, "a"), (3, "w " * 3, "b")],  # the target rounds up to the source's size
        [(i, "w " * 5, "abc"[i % 3]) for i in range(9)],
        [(7, "w " * 4, "a")] * 5 + [(8, "w " * 4, "b")] * 3 + [(9, "v " * 6, "b")],  # rows that repeat at the cut
        [(None, t, None) for t in ("w " * 4, "v " * 4, "w " * 4, "u u", None, "")] + [(1, "w " * 9, "a"), (2, None, "a"), (3, "", "b")],
    ]
    for rows in cases:
        docs = make_docs(rows)
        want, got = Counter(), Counter()
        for r in mixing.mix(docs).collect():
            want[r.doc_id] += r.taken
        for r in pipeline.mix_sources(spark, docs, SF).collect():
            got[r.doc_id] += len(WORDS(r.text))
        assert +got == +want
    assert pipeline.mix_sources(spark, make_docs([]), SF).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), "test"))
    for t in tables[1:-1]:
        assert t.columns == docs.columns and t.dtypes == docs.dtypes
    first = {r.doc_id: r.text for r in docs.collect()}
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in tables[1].collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}

    def grams(text):
        w = WORDS(text.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    kept, before = [grams(r.text) for r in tables[2].collect()], {r.doc_id: grams(r.text) for r in tables[1].collect()}
    for i, s in before.items():
        assert s in kept or any(5 * len(s & k) >= 4 * len(s | k) for k in kept) or any(5 * len(s & o) >= 4 * len(s | o) for j, o in before.items() if j != i)
    assert not any(5 * len(a & b) >= 4 * len(a | b) for x, a in enumerate(kept) for b in kept[:x] if a)

    third = {r.doc_id: r.text for r in tables[3].collect()}
    assert set(third) == {r.doc_id for r in tables[2].collect()}
    assert all(t == first[i] or "[SECRET]" in t for i, t in third.items()) and not any(re.search("AKIA[A-Z0-9]{16}", t) for t in third.values())

    taken = {r.doc_id: r.taken for r in mixing.mix(tables[3]).collect()}
    words = Counter()
    for r in tables[4].collect():
        words[r.doc_id] += len(WORDS(r.text))
        assert third[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)

    pieces = tables[5].collect()
    assert Counter(p.doc_id for p in pieces if p.piece == 0) == Counter(r.doc_id for r in tables[4].collect())
