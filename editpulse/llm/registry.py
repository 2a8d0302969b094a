"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from editpulse.llm import sql
from editpulse.llm.embeddings import op3_near_duplicate_vectors
from editpulse.llm.exactdedup import op6_exact_duplicates
from editpulse.llm.fingerprint import op11_phrase_fingerprints
from editpulse.llm.lines import op10_line_dedup
from editpulse.llm.merkle import op12_merkle_manifest
from editpulse.llm.mixing import op8_mix_sources
from editpulse.llm.ngramjoin import op5_ngram_join, op5_ngram_links
from editpulse.llm.packing import op1_pack_documents
from editpulse.llm.quality import op9_quality
from editpulse.llm.secretscan import op4_secrets
from editpulse.llm.sharding import op2_feistel_shards
from editpulse.llm.tokencount import op7_token_counts
from editpulse.llm.whitening import op13_whitened_embeddings

QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_documents, op2_feistel_shards, op3_near_duplicate_vectors, op4_secrets, op5_ngram_join, op5_ngram_links, op6_exact_duplicates,
        op7_token_counts, op8_mix_sources, op9_quality, op10_line_dedup, op11_phrase_fingerprints, op12_merkle_manifest,
        op13_whitened_embeddings,
    )
} | {"pipeline": corpus_pipeline.run}

SQL = sql.ORACLE
