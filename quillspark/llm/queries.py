"""The queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from .decontamination import op7_spaced_seeds
from .divergence import OP13_SQL, op13_divergence
from .language import op2_language
from .mixing import op1_mixing
from .order_minhash import op10_order_minhash
from .periodic import op12_periodic_runs
from .quality_ledger import ABLATION_SQL, OP3_SQL, op3_quality_ledger, quality_ablation
from .sharding import OP9_SQL, SMALL_SHARDS_SQL, op9_sharding, small_shards
from .surrogates import op8_surrogates, surrogate_check
from .token_counts import op11_token_counts
from .toxicity import op6_toxicity
from .url_automaton import OP5_SQL, op5_url_automaton
from .warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_mixing, op2_language, op3_quality_ledger, op4_warc, op5_url_automaton, op6_toxicity, op7_spaced_seeds, op8_surrogates, op9_sharding, op10_order_minhash, op11_token_counts, op12_periodic_runs, op13_divergence)}

# More queries of the same operators, after the numbered ones.
QUERIES |= {f.__name__: f for f in (quality_ablation, surrogate_check, small_shards)}

ORACLES = {"op3_quality_ledger": OP3_SQL, "op4_warc": OP4_SQL, "op5_url_automaton": OP5_SQL, "op9_sharding": OP9_SQL, "op13_divergence": OP13_SQL, "quality_ablation": ABLATION_SQL, "small_shards": SMALL_SHARDS_SQL}
