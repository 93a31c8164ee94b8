"""Column names and types of the tables that operators take and give."""

SEGMENTS = "doc_id long, seg_kind string, seg_no int, seg_name string, text string"
CELLS = "doc_id long, sheet string, row_no long, col_no int, value string, is_formula boolean"
PAGES = "doc_id long, page_no int, text string"
RUNS = "doc_id long, para_no int, run_no int, text string, is_complex boolean"
PAGE_WORDS = "doc_id long, page_no int, block_no int, line_no int, word_no int, word string, x0 double, y0 double, x1 double, y1 double"
NOTES = "doc_id long, kind string, note_no int, block_no int, para_no int, cells array<string>"
ENTITIES = "doc_id long, original_text string, masked_text string, start_pos int, end_pos int, entity_type string, confidence double, chunk_no int, resp_no int, cand_no int"
RESPONSES = "doc_id long, chunk_no int, raw string"
REPLACEMENTS = "doc_id long, original_text string, mask string, ord long"
HISTORY = "seq long, timestamp string, source_file string, masked string, report_json string, report_txt string"
VALIDATION = "status string, questions array<string>, missing_entities_candidates array<struct<original_text:string,entity_type:string,reason:string>>"

DEFAULT_TYPES = ["INN", "PHONE", "PARTY", "EMAIL", "PASSPORT", "ADDRESS", "FIO", "KPP"]
