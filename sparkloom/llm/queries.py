"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from sparkloom.llm import decontamination, licenses, manifest, merkle, phrases
from sparkloom.llm.decontamination import op5_benchmark_decontamination
from sparkloom.llm.licenses import op1_license_scan
from sparkloom.llm.manifest import op13_merkle_manifest
from sparkloom.llm.merkle import op10_merkle_fingerprint
from sparkloom.llm.near_dedup import op7_minhash_near_dedup
from sparkloom.llm.packing import op4_best_fit_packing
from sparkloom.llm.phrases import op12_phrase_collocations
from sparkloom.llm.substring_dedup import op3_substring_dedup
from sparkloom.llm.suffix_dedup import op8_suffix_array_dedup
from sparkloom.llm.token_counts import op11_token_counts
from sparkloom.llm.toxicity import op9_toxicity
from sparkloom.llm.url_filter import op2_url_filter
from sparkloom.llm.warc import op6_warc

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_url_filter, op3_substring_dedup, op4_best_fit_packing, op5_benchmark_decontamination, op6_warc, op7_minhash_near_dedup, op8_suffix_array_dedup, op9_toxicity, op10_merkle_fingerprint, op11_token_counts, op12_phrase_collocations, op13_merkle_manifest)}
SQL: dict[str, str] = {"op1_license_scan": licenses.SQL, "op5_benchmark_decontamination": decontamination.SQL, "op10_merkle_fingerprint": merkle.SQL, "op12_phrase_collocations": phrases.SQL, "op13_merkle_manifest": manifest.SQL}
