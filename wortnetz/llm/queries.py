"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from . import audit, chat, embeddings, exact_dedup, packing, pieces, quality, secrets, shards, simhash, urls, warc

QUERIES = {
    "op1_sharding": shards.op1_sharding,
    "op2_embedding_dedup": embeddings.op2_embedding_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_simhash": simhash.op4_simhash,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_warc": warc.op7_warc,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_url_filter": urls.op11_url_filter,
    "op12_filter_audit": audit.op12_filter_audit,
}

SQL = {
    "op1_sharding": shards.OP1_SQL,
    "op2_embedding_dedup": embeddings.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_secret_scan": secrets.OP8_SQL,
    "op11_url_filter": urls.OP11_SQL,
    "op12_filter_audit": audit.OP12_SQL,
}
