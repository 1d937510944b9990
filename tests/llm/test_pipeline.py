"""Every stage of the pipeline on what its predecessor kept, against brute force."""

import numpy as np
import public_tokenizers
import tiktoken
from test_llm_corpus import brute_components, brute_removed
from test_llm_text import DOC, brute_hits

import corpus_pipeline
from floorlens.llm import byte_bpe, crf_language, suffix_dedup, words

SAID = {
    "en": "the of and that with this from water house small tree people know time year good work".split(),
    "de": "der und nicht schön über straße wasser haus klein baum leute wissen zeit jahr gut arbeit".split(),
}


def corpus(rng):
    texts = [(" ".join(rng.choice(SAID[k], 60)), k) for i in range(30) for k in [("en", "de")[i % 2]]]
    passage = " ".join(rng.choice(SAID["en"], 120))
    leak = "alpha beta gamma delta the water of small house and good year work time"
    texts += [(f"{texts[i][0]} {passage} {texts[i + 2][0]}", "en") for i in (0, 4)]
    texts += [(texts[6][0] + " house", "en"), (texts[6][0], "en"), (f"{texts[8][0]} {leak} {texts[9][0]}", "en"), (leak, "en")]
    texts += [(None, "en"), ("", "en"), ("12 34 !!", "en"), (passage, "en")]
    return [(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(texts)], [(1, leak), (2, None)]


def test_stages(spark, tmp_path):
    rows, items = corpus(np.random.default_rng(12))
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id: r for r in docs.collect()})
        assert name == "tokens" or docs.columns == names
    language, copies, repeats, benchmark, tokens = kept
    assert set(language) == {r[0] for r in rows if r[1] and r[1][0].isalpha()}

    def texts(stage):
        return [(k, r.text) for k, r in sorted(stage.items())]

    assert set(copies) == {k for k, _, _, own in brute_components(texts(language)) if own}
    want = {}
    for (k, text), (n, gone, _, left) in zip(texts(copies), brute_removed(texts(copies), suffix_dedup.WIDTH), strict=True):
        if gone < n or not n:
            want[k] = left.decode("utf-8", "ignore")
            assert gone or want[k] == text
    assert {k: r.text for k, r in repeats.items()} == want
    assert any(want[k] != r.text for k, r in copies.items() if k in want)
    for k, text in texts(repeats):
        n, hit, _ = brute_hits(text, items)
        assert (k in benchmark) == (hit <= corpus_pipeline.MOST_COVERED * n)
        if k in benchmark:
            assert (benchmark[k].text == text) == (hit == 0) and brute_hits(benchmark[k].text, items)[1] == 0
            assert benchmark[k].n_chars == len(benchmark[k].text)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    assert set(tokens) == set(benchmark) and all(r.round_trip for r in tokens.values())
    for k, r in tokens.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(benchmark[k].text)
    whole = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: bytes(r.ids) for k, r in tokens.items()}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOC)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_language_stage_keeps_what_it_cannot_name(spark):
    """Without a learned language all rows stay; texts of several languages do too."""
    rows = [(1, "the water", None, "s", 9), (2, None, None, "s", 0), (3, "12", None, "s", 2)]
    assert corpus_pipeline.language(spark, spark.createDataFrame(rows, DOC), "").count() == 3
    rng = np.random.default_rng(3)
    known = [(i, " ".join(rng.choice(SAID[k], 40)), k, "s", 0) for i in range(40) for k in [("en", "de")[i % 2]]]
    mixed = [(100 + i, " ".join([*rng.choice(SAID["en"], 20), *rng.choice(SAID["de"], 20)]), None, "s", 0) for i in range(5)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(known + mixed + [(200, "", "en", "s", 0), (201, "7 !", "en", "s", 0)], DOC), "")
    assert {r.doc_id for r in got.collect()} == {r[0] for r in known + mixed}


def test_language_model_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(SAID[k], 30)), k, "s", 0) for i in range(60) for k in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, DOC)
    one, other = (crf_language.fit(d, sample=40) for d in (docs.coalesce(1), docs.repartition(7)))
    assert not words._powers  # the driver does not hold what only the fit needs
    assert one.labels == other.labels and (one.weights == other.weights).all() and (one.turn == other.turn).all()
