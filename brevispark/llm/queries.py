"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from brevispark.llm.covertree import SQL4, op4_near_vectors
from brevispark.llm.exact_dedup import SQL8, op8_exact_dedup
from brevispark.llm.langid import op2_language_id
from brevispark.llm.licenses import SQL9, op9_license_scan
from brevispark.llm.minhash import SQL5, op5_near_duplicates
from brevispark.llm.mixing import SQL7, op7_mix_sources
from brevispark.llm.packing import op6_pack
from brevispark.llm.pii import op10_pseudonyms
from brevispark.llm.spans import op3_repeated_spans
from brevispark.llm.token_files import op1_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_language_id,
        op3_repeated_spans,
        op4_near_vectors,
        op5_near_duplicates,
        op6_pack,
        op7_mix_sources,
        op8_exact_dedup,
        op9_license_scan,
        op10_pseudonyms,
    )
}
SQL = {
    "op4_near_vectors": SQL4,
    "op5_near_duplicates": SQL5,
    "op7_mix_sources": SQL7,
    "op8_exact_dedup": SQL8,
    "op9_license_scan": SQL9,
}
