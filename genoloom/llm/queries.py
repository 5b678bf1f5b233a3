"""The queries of this subpackage, and SQL for those that SQL can express."""

from genoloom.llm import decontaminate, exact_dedup, html_text, minhash, mixing, ngram_lm, periodic_runs, quote_links, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_lm_scores": ngram_lm.op6_lm_scores,
    "op7_simhash": simhash.op7_simhash,
    "op8_chat_format": quote_links.op8_chat_format,
    "op9_html_text": html_text.op9_html_text,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_minhash": minhash.op11_minhash,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
}

ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op5_mix_sources": mixing.SQL,
}
