"""Queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tijolo.llm.byte_bpe import op13_byte_bpe
from tijolo.llm.collocations import OP12_SQL, op12_collocations
from tijolo.llm.decontamination import OP1_SQL, op1_decontamination
from tijolo.llm.fingerprints import op3_fingerprints
from tijolo.llm.language import op9_language
from tijolo.llm.language_model import op2_language_model
from tijolo.llm.manifest import OP11_SQL, op11_manifest
from tijolo.llm.mixing import op8_mixing
from tijolo.llm.near_duplicates import OP6_SQL, op6_near_duplicates
from tijolo.llm.repeats import OP5_SQL, op5_suffix_dedup
from tijolo.llm.sharding import op4_sharding
from tijolo.llm.toxicity import op10_toxicity
from tijolo.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_model": op2_language_model,
    "op3_fingerprints": op3_fingerprints,
    "op4_sharding": op4_sharding,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_manifest": op11_manifest,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_decontamination": OP1_SQL, "op5_suffix_dedup": OP5_SQL, "op6_near_duplicates": OP6_SQL, "op7_warc": OP7_SQL, "op11_manifest": OP11_SQL, "op12_collocations": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
