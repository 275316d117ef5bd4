"""Schemas of the records at rest."""

CAPTION = "struct<component_name:string,visual_type:string,part_numbers:array<string>,connections:array<string>,technical_description:string>"
CHUNK = (
    "chunk_id string, chunk_index int, element_id string, doc_id string, doc_slug string, title string, source_uri string, created_at string, tags array<string>, type string, content string, content_hash string, "
    "sparse_vector struct<indices:array<int>,values:array<float>>, "
    f"metadata struct<page_idx:int,page_number:int,page_label:string,section:string,linked_asset_id:string,caption_json:{CAPTION},quality_score:double,quality_reasons:array<string>>, "
    "provenance struct<processed_at:string,pipeline_v:string>"
)
DOCUMENT = "doc_id string, doc_slug string, title string, source_uri string, created_at string, tags array<string>, run_id string, ingested_at string"
ASSET = "asset_id string, element_id string, doc_id string, type string, page_label string, file_path string, bbox array<double>, embedding array<float>, embedding_model string"
LAYOUT_ITEM = "doc_id string, page_no int, item_ord long, kind string, label string, text string, bbox array<double>"
GOLD = (
    "id string, query string, intent string, requires_image boolean, difficulty string, tags array<string>, expected_pages array<string>, "
    "expected_retrieval struct<text_chunk_ids:array<string>,image_ids:array<string>,table_ids:array<string>,asset_ids:array<string>>, "
    "gold_answer string, gold_citations array<struct<chunk_id:string,doc_slug:string,evidence_text:string,doc_id:string>>, doc_slug string, doc_id string"
)
MESSAGE = "message_id string, chat_id string, turn long, role string, content string, created_at string, sources_json string, attachments_json string"
CHAT = "chat_id string, title string, created_at string, updated_at string"
