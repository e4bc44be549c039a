"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = "doc_id string, source string, doc_type string, title string, text string, metadata map<string,string>"
CHUNK = "chunk_id string, doc_id string, source string, title string, text string, parent_text string, chunk_index int, start_char int, end_char int, metadata map<string,string>"
STORED_CHUNK = "chunk_id string, doc_id string, source string, title string, text string, parent_text string, chunk_index long, vector array<float>"
RETRIEVED = "query_id long, chunk_id string, doc_id string, source string, title string, text string, parent_text string, chunk_index long, score double, retriever string"
CHUNK_LENGTH = "chunk_id string, dl long"
ENTITY = "chunk_id string, label string, source string, entity_type string, pos int"
STORED_DOCUMENT = "doc_id string, source string"
STORED_VECTOR = "chunk_id string, doc_id string, source string, title string, text string, parent_text string, chunk_index long, vector array<float>, cell int"
CELL_VECTOR = "chunk_id string, vector array<float>, cell int"
POSTING = "term string, chunk_id string, tf long"
TRIPLE = "subject string, predicate string, object string, chunk_id string, source string, extractor string"
NODE = "label string, entity_type string, chunk_ids array<string>, source string, extractor string"
EDGE = "node_a string, node_b string, predicates array<string>, chunk_ids array<string>, source string, extractor string"
QUERY_LOG = ("id long, timestamp double, query string, intent string, strategies string, retriever_hits string, crag_grade string, crag_rewritten int, "
             "web_search_used int, num_chunks int, top_chunk_score double, latency_ms double, model string, extractor string")
EVAL_METRIC = ("id long, query_log_id long, timestamp double, faithfulness double, answer_relevancy double, context_precision double, "
               "context_utilisation double, mean_chunk_score double")
CACHE = "key string, payload string, written_at double"
EVENT = "query_id long, seq int, type string, payload string"
INGEST_STATS = ("documents_processed long, documents_skipped long, chunks_created long, chunks_stored long, bm25_indexed long, graph_entities long, "
                "graph_triples long, errors array<struct<source:string,error:string>>")
ROUTING = "intent string, strategies array<string>, confidence double, reasoning string"
INTENTS = ("factual_lookup", "keyword_exact", "comparison", "multi_hop", "code_or_formula")
GRADES = ("GOOD", "POOR", "ABSENT")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
