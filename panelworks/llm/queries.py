"""Registered queries of this package: name -> (job, SQL check or None)."""

from __future__ import annotations

import corpus_pipeline
from panelworks.llm import bpe, chat, embeddings, langid, quality, runs, secrets, simhash, spelling, suffixes, templates, topk, wavelet
from panelworks.llm.common import table
from panelworks.session import scratch_path


def op1_pu_quality(spark, sf_dir):
    return quality.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_snapshot_chat(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


def op3_template_decontamination(spark, sf_dir):
    return templates.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_trigram_secrets(spark, sf_dir):
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op5_wavelet_tokens(spark, sf_dir):
    folder = scratch_path(spark, "token-shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), folder)
    return wavelet.digests(wavelet.read_shards(spark, folder))


def op6_fragment_bpe(spark, sf_dir):
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents")))


def op7_rotated_codes(spark, sf_dir):
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.language_of(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_pivot_search(spark, sf_dir):
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark, sf_dir):
    return runs.digests(runs.periodic_runs(runs.looped(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_pu_quality": (op1_pu_quality, None),
    "op2_snapshot_chat": (op2_snapshot_chat, chat.ORACLE),
    "op3_template_decontamination": (op3_template_decontamination, None),
    "op4_trigram_secrets": (op4_trigram_secrets, secrets.oracle()),
    "op5_wavelet_tokens": (op5_wavelet_tokens, None),
    "op6_fragment_bpe": (op6_fragment_bpe, None),
    "op7_rotated_codes": (op7_rotated_codes, None),
    "op8_simhash_near_dedup": (op8_simhash_near_dedup, None),
    "op9_language_id": (op9_language_id, None),
    "op10_suffix_dedup": (op10_suffix_dedup, None),
    "op11_spelling_variants": (op11_spelling_variants, spelling.ORACLE),
    "op12_pivot_search": (op12_pivot_search, topk.ORACLE),
    "op13_periodic_runs": (op13_periodic_runs, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
