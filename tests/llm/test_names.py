"""Operators and stages take tables whose columns have the operators' own names, and pass their values."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, chat_format, html_extract, lang_id, merkle, mixing, quality, simhash, suffix_dedup, topk, url_filter, variants

OWN = (
    "bpe_ids bpe_decoded bpe_text html_main html_html kept langid_pred langid_score langid_text merkle_leaf merkle_path merkle_root mix_key mix_size mix_cell mix_salt mix_deal mix_id mix_row mix_copies mix_copy "
    "quality_key_1 quality_key_2 quality_n_words quality_text quality_lang quality_source quality_fences quality_row quality_kept simhash_fps simhash_text simhash_id simhash_form simhash_row simhash_n component_id "
    "suffix_id suffix_form suffix_text suffix_found suffix_cut suffix_removed suffix_least suffix_bytes url_host url_path url_rule url_verdict row tree place digest word n key value id a b"
).split()
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def crowded(awkward):
    return awkward.select("*", *(F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(name) for name in OWN))


def html(docs):
    return html_extract.extract(docs.withColumn("html", F.col("text")), docs.columns)


def quality_judged(docs):
    measured = quality.measures(docs)
    return quality.judge(measured, quality.fences(measured))


def identified(docs):
    model = lang_id.train(docs.select("text", "lang", "doc_id"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return lang_id.identify(docs, model, docs.columns)


OPERATORS = {
    "url_filter": lambda d: url_filter.judge(d.withColumn("url", F.concat(F.lit("http://a.org/en/"), "doc_id")), [("org/en/1", "block"), ("org/", "allow")]),
    "suffix_dedup.cut": suffix_dedup.cut,
    "suffix_dedup.digests": lambda d: suffix_dedup.digests(d, d.columns),
    "lang_id": identified,
    "mixing.mix": mixing.mix,
    "mixing.materialise": mixing.materialise,
    "simhash.fingerprints": lambda d: simhash.fingerprints(d, d.columns),
    "simhash.keep_one": simhash.keep_one,
    "quality": quality_judged,
    "html_extract": html,
    "bpe": lambda d: bpe.round_trip(d, BPE, d.columns),
    "merkle": lambda d: merkle.manifest(d, d.columns),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, crowded, spark):
    got = OPERATORS[name](crowded)
    assert len(got.columns) == len(set(got.columns))
    own = [c for c in OWN if c in got.columns]
    rows = got.collect()
    passed = [c for c in own if any(r[c] is not None and str(r[c]).startswith(f"{c}:") for r in rows)]
    # What the operator adds takes the place of a column of that name; all others pass.
    family = {"url_filter": "url_", "suffix_dedup": "suffix_", "lang_id": "langid_", "mixing": "mix_", "simhash": "simhash_", "quality": "quality_", "html_extract": "html_", "bpe": "bpe_", "merkle": "merkle_"}[name.split(".")[0]]
    assert rows and {c for c in OWN if not c.startswith(family)} - {"component_id"} <= set(passed)
    for r in rows:
        assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in passed)


def test_narrow_operators(crowded):
    """Those that give tables of their own read what they need and no more."""
    assert variants.variants(variants.count_words(crowded)).columns[0] == "word"
    codes = crowded.select("*", F.xxhash64("text").alias("code")).withColumn("id", F.col("doc_id"))
    assert topk.top_k(codes, codes.where("doc_id = 1").withColumn("query_id", F.col("doc_id")), 3).count() >= 3
    turns = crowded.select("*", F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"))
    assert chat_format.digest(chat_format.format_examples(turns)).count() > 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(stage, crowded, spark):
    got = dict(corpus_pipeline.STAGES)[stage](spark, crowded, "")
    assert got.collect()
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == crowded.columns
        assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in got.collect() for c in OWN)
