"""The operators applied to the sample tables, and the same results in SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tradewind.llm import decontaminate, fingerprints, language, mixture, neardup, neighbours, neural, personal, phrases, prefixes, quality, secrets, toxicity

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_lm": neural.op2_lm,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_personal": personal.op4_personal,
    "op5_language": language.op5_language,
    "op6_secrets": secrets.op6_secrets,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_neardup": neardup.op9_neardup,
    "op10_mixture": mixture.op10_mixture,
    "op11_prefixes": prefixes.op11_prefixes,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_phrases": phrases.op13_phrases,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_neighbours": neighbours.SQL,
    "op6_secrets": secrets.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_neardup": neardup.SQL,
    "op10_mixture": mixture.SQL,
    "op11_prefixes": prefixes.SQL,
    "op13_phrases": phrases.SQL,
}
