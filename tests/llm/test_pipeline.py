"""The stages one by one on the smallest table and on odd rows."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from crateloom.llm import mixing
from crateloom.llm.common import stored


def test_stages_are_the_given_ones():
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "sentencepiece"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("which", ["docs", "odd", "nothing"])
def test_every_stage(request, spark, which):
    docs = request.getfixturevalue(which)
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES:
        out = stored(stage(spark, docs, "unused"), f"test-{name}")
        n = out.count()
        if name != "sentencepiece":
            assert out.columns == columns, name
        if name == "language_id":
            gone = Counter(r.text for r in docs.collect()) - Counter(r.text for r in out.collect())
            assert all(not any(c.isalpha() for c in t or "") for t in gone)          # prose stays
        if name == "line_dedup":
            assert n == before
        if name == "near_duplicates":
            left = [shingles(r.text) for r in out.collect()]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(left) for b in left[:i] if a and b)
            was = [shingles(r.text) for r in docs.collect()]
            assert all(any(100 * len(a & b) >= 80 * len(a | b) for b in left) for a in was if a)
        if name == "mix_sources" and n:
            assert {r.text for r in out.collect()} <= {r.text for r in docs.collect()}
        if name != p.STAGES[-1][0]:
            marked = {r.doc_id for r in out.collect() if "▁" in (r.text or "")}
        docs, before = out, n
    assert all(r.round_trip is not False or r.doc_id in marked for r in docs.collect())


def test_run_equals_the_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, folder)
    got = p.run(spark, folder)
    assert got.columns == ["doc_id", "n_pieces", "ids", "round_trip"]
    assert Counter(map(str, got.collect())) == Counter(map(str, docs.collect()))


def test_names_that_the_stages_use_inside(spark):
    rows = [(i, f"the quick brown fox number {chr(97 + i)} jumps over lazy dogs in the garden", "en", "a", 1, "x", "y", 0.5, "z", "w") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _lang_pred string, language string, _score double, "
                                       "row_digest string, _text_read string")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns and out.count()
    assert p.language_id(spark, docs, "unused").count() == 12


def test_rejection_does_not_depend_on_the_number_of_languages(spark):
    """Scripts with many characters, and twelve labels instead of four."""
    import random
    rng = random.Random(8)
    rows = []
    for label in range(12):
        letters = [chr(0x4E00 + 2000 * (label // 2) + 150 * (label % 2) + i) for i in range(1200)] if label < 8 else [chr(0xAC00 + 900 * label + i) for i in range(700)]
        for i in range(40):
            rows.append((label * 100 + i, "".join(rng.choice(letters) for _ in range(300)), f"l{label}", "a", 300))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.language_id(spark, docs, "unused")
    assert kept.count() >= 0.99 * len(rows)
    from crateloom.llm import langid
    seen = langid.identify(docs, F.col("doc_id") % 2 == 0).join(docs, "doc_id").where("doc_id % 2 = 1")
    assert seen.where("lang_pred = lang").count() >= 0.9 * seen.count()


def test_mixed_words_meet_the_targets(spark):
    """A source is off by its largest document and the short blocks at most, whatever its weight."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.where("source is not null").selectExpr("-doc_id as doc_id", "concat(text, ' ', doc_id) as text", "lang", "null as source", "n_chars").limit(200))
    plan, got = mixing.mix(docs).collect(), Counter()
    target, largest = {r.source: r.target for r in plan}, Counter()
    for r in plan:
        largest[r.source] = max(largest[r.source], r["size"])
    for r in p.mix_sources(spark, docs, "unused").collect():
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert len(target) > 2
    for s, t in target.items():
        assert abs(got[s] - t) <= largest[s] + 64 + 0.01 * t, (s, got[s], t)


def test_copies_are_the_share_rounded_down_or_up(odd):
    taken = Counter(), Counter()
    for r in mixing.mix(odd, keep_row=True).collect():
        taken[0][tuple(r.row)] += r.taken // max(r["size"], 1)
        taken[1][tuple(r.row)] += -(-r.taken // max(r["size"], 1))
    got = Counter(tuple(r) for r in mixing.whole_copies(odd).collect())
    assert got and all(taken[0][k] <= got[k] <= taken[1][k] for k in taken[0].keys() | got.keys())
