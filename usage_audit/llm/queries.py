"""The query functions of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from . import conversations, dedup, html, lines, mixing, neighbours, ngrams, packing, phrases, sharding, tokenfile, toxicity, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_html": html.op4_html,
    "op5_url_filter": urls.op5_url_filter,
    "op6_token_files": tokenfile.op6_token_files,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_ngram_join": ngrams.op8_ngram_join,
    "op9_exact_dedup": dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_phrases": phrases.op12_phrases,
    "op13_conversations": conversations.op13_conversations,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_sharding": sharding.OP3_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op9_exact_dedup": dedup.OP9_SQL,
    "op11_line_dedup": lines.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
