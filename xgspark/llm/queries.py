"""Registered queries of the training-data operators."""

from xgspark.llm import decontaminate, hard_negatives, mixing, phrase_dedup, quotes, revisits, sharding
from xgspark.llm.decontaminate import op7_decontaminate
from xgspark.llm.hard_negatives import op11_hard_negatives
from xgspark.llm.language_id import op1_language_id
from xgspark.llm.license_scan import op13_license
from xgspark.llm.mixing import op2_mixing
from xgspark.llm.phrase_dedup import op5_phrase_dedup
from xgspark.llm.quality import op10_quality
from xgspark.llm.quotes import op8_quotes
from xgspark.llm.revisits import op3_revisits
from xgspark.llm.sharding import op9_sharding
from xgspark.llm.simhash import op6_simhash
from xgspark.llm.suffix_dedup import op4_suffix_dedup
from xgspark.llm.tokenizer_alignment import op12_alignment

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_revisits": op3_revisits,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_phrase_dedup": op5_phrase_dedup,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_quotes": op8_quotes,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_license": op13_license,
}

# DuckDB SQL, where SQL expresses the query.
ORACLE: dict[str, str] = {
    "op2_mixing": mixing.oracle_sql(),
    "op3_revisits": revisits.oracle_sql(),
    "op5_phrase_dedup": phrase_dedup.oracle_sql(),
    "op7_decontaminate": decontaminate.oracle_sql(),
    "op8_quotes": quotes.oracle_sql(),
    "op9_sharding": sharding.oracle_sql(),
    "op11_hard_negatives": hard_negatives.oracle_sql(),
}
