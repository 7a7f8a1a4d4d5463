"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import OP7_SQL, op7_nearest
from .bag_search import OP12_SQL, op12_bag_search
from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op8_decontaminate
from .exact_dedup import OP11_SQL, op11_exact_dedup
from .language_id import op2_language
from .license_scan import op6_licenses
from .near_dedup import OP1_SQL, op1_near_dedup
from .packing import op9_packing
from .secret_scan import op3_secrets
from .sharding import op4_sharding
from .toxicity import op10_toxicity
from .training_order import op5_training_order

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language": op2_language,
    "op3_secrets": op3_secrets,
    "op4_sharding": op4_sharding,
    "op5_training_order": op5_training_order,
    "op6_licenses": op6_licenses,
    "op7_nearest": op7_nearest,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_bag_search": op12_bag_search,
    "op13_collocations": op13_collocations,
}

#: The others use hashes, a fitted model, a tokenizer or a graph, and are tested against brute force.
ORACLES: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op7_nearest": OP7_SQL, "op11_exact_dedup": OP11_SQL, "op12_bag_search": OP12_SQL, "op13_collocations": OP13_SQL}
