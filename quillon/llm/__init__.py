"""Operators for large-scale training-data pipelines; nothing else in the package imports them."""

from quillon.llm import collocations, decontaminate, jaccard, mixing, nearest, pii, prefix_trie, quality, repeats, tokens, toxicity, url_rules, warc

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_substring_dedup": repeats.op2_substring_dedup,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_warc": warc.op4_warc,
    "op5_quality": quality.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_exact_topk": nearest.op7_exact_topk,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_mix": mixing.op10_mix,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLES = {"op7_exact_topk": nearest.SQL, "op9_url_rules": url_rules.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_collocations": collocations.SQL}
