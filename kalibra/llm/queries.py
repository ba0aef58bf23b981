"""The queries of this subpackage, and their SQL where SQL can express them."""

from kalibra.llm import kdmeans, warc
from kalibra.llm.bpe import op12_bpe
from kalibra.llm.chat import op9_chat
from kalibra.llm.decontam import op1_decontaminate
from kalibra.llm.hamming import op10_topk
from kalibra.llm.kdmeans import op11_kdmeans
from kalibra.llm.packing import op4_packing
from kalibra.llm.pii import op5_pii
from kalibra.llm.runs import op13_runs
from kalibra.llm.secrets import op3_secrets
from kalibra.llm.sharding import op6_sharding
from kalibra.llm.simhash import op2_simhash
from kalibra.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_merkle": warc.op8_merkle,
    "op9_chat": op9_chat,
    "op10_topk": op10_topk,
    "op11_kdmeans": op11_kdmeans,
    "op12_bpe": op12_bpe,
    "op13_runs": op13_runs,
}

ORACLES = {"op8_merkle": warc.oracle(), "op11_kdmeans": kdmeans.oracle()}
