"""Fixed schemas of the stored tables and result rows."""

CHUNKS = (
    "entity_id string, title string, content string, component string, topic string, source_file string, section_path string, "
    "doc_url string, commands_referenced array<string>, keywords array<string>, version string, quality_score double, deprecated boolean, "
    "version_added string, version_changed string, warnings array<string>, see_also array<string>, file_ord string, chunk_ord int"
)
EXAMPLES = "entity_id string, code string, language string, context string, source_file string, component string, section_title string, commands_used array<string>, ex_ord int"
XREF = "command string, ordinal struct<file_ord: string, chunk_ord: int>, chunk_id string, title string, source string, component string"
#: Columns of a search result, in order.
RESULT = ["entity_id", "title", "content", "component", "topic", "source_file", "section_path", "doc_url", "commands_referenced", "quality_score", "score", "search_source", "deprecated"]
