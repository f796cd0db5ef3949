"""The registered queries of this subpackage, each over its whole table, and their SQL where it can be stated."""

from __future__ import annotations

from feedtide.llm.conversations import op13_conversation_repair
from feedtide.llm.harmonic import op12_harmonic_packing
from feedtide.llm.jaccard import op9_jaccard_join
from feedtide.llm.mixing import op3_mix_sources
from feedtide.llm.neighbours import op7_multi_index
from feedtide.llm.oracle import CONVERSATIONS, SEARCH
from feedtide.llm.order_minhash import op5_order_minhash
from feedtide.llm.packing import op4_best_fit_packing
from feedtide.llm.search import op11_pipelined_search
from feedtide.llm.sharding import op10_histogram_sort
from feedtide.llm.substrings import op1_substring_dedup
from feedtide.llm.tokens import op2_token_counts
from feedtide.llm.toxicity import op6_toxicity
from feedtide.llm.warc import op8_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_counts, op3_mix_sources, op4_best_fit_packing, op5_order_minhash, op6_toxicity, op7_multi_index, op8_warc,
        op9_jaccard_join, op10_histogram_sort, op11_pipelined_search, op12_harmonic_packing, op13_conversation_repair,
    )
}
SQL = {"op11_pipelined_search": SEARCH, "op13_conversation_repair": CONVERSATIONS}
