"""Oracle SQL of the queries that SQL can express on whole tables."""

SQL: dict[str, str] = {
    "p5_found": """
SELECT c.chunk_key FROM chunks c LEFT JOIN sources s ON c.source = s.source
JOIN split_limits l ON l.kind = CASE WHEN c.source IS NULL THEN 'none' ELSE s.kind END
WHERE length(c.page_content) > l.max_chars
""",
}
