"""Queries of the training-data operators, and SQL for those that SQL can say."""

from __future__ import annotations

from factloom.llm.chat import OP2_SQL, op2_reply_trees
from factloom.llm.codes import OP13_SQL, op13_vantage_codes
from factloom.llm.decontaminate import OP9_SQL, op9_benchmark_decontamination
from factloom.llm.language import op6_language_filters
from factloom.llm.licenses import op1_license_windows
from factloom.llm.lines import OP4_SQL, op4_line_dedup
from factloom.llm.maintext import op11_maximum_subsequence
from factloom.llm.packing import op7_mixture_packing
from factloom.llm.search import OP12_SQL, op12_ranked_search
from factloom.llm.secrets import OP8_SQL, op8_secret_ledger
from factloom.llm.simhash import op10_simhash_pivots
from factloom.llm.vectors import op3_multi_index
from factloom.llm.warc import OP5_SQL, op5_warc_bundles

_ALL = (
    op1_license_windows, op2_reply_trees, op3_multi_index, op4_line_dedup, op5_warc_bundles, op6_language_filters, op7_mixture_packing, op8_secret_ledger,
    op9_benchmark_decontamination, op10_simhash_pivots, op11_maximum_subsequence, op12_ranked_search, op13_vantage_codes,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op2_reply_trees": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_warc_bundles": OP5_SQL, "op8_secret_ledger": OP8_SQL, "op9_benchmark_decontamination": OP9_SQL,
    "op12_ranked_search": OP12_SQL, "op13_vantage_codes": OP13_SQL,
}
