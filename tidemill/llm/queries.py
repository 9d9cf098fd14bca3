"""The operators' queries and the SQL of those that SQL can express."""

from tidemill.llm.decontamination import OP12_SQL, op12_decontamination
from tidemill.llm.kneser_ney import op8_kneser_ney
from tidemill.llm.language_id import op7_language_id
from tidemill.llm.mixing import OP3_SQL, op3_mixing
from tidemill.llm.mpeg_audio import op6_mpeg_audio
from tidemill.llm.packing import op2_best_fit_packing
from tidemill.llm.pii import op9_pii
from tidemill.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from tidemill.llm.quality_cascade import OP5_SQL, op5_quality_cascade
from tidemill.llm.signature_tree import OP10_SQL, op10_signature_tree
from tidemill.llm.spelling import OP13_SQL, op13_spelling
from tidemill.llm.toxicity import op1_toxicity
from tidemill.llm.url_filter import op4_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_quality_cascade": op5_quality_cascade,
    "op6_mpeg_audio": op6_mpeg_audio,
    "op7_language_id": op7_language_id,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_pii": op9_pii,
    "op10_signature_tree": op10_signature_tree,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_decontamination": op12_decontamination,
    "op13_spelling": op13_spelling,
}

ORACLES = {"op3_mixing": OP3_SQL, "op5_quality_cascade": OP5_SQL, "op10_signature_tree": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_spelling": OP13_SQL}
