"""Queries of the corpus operators, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from dockmill.llm import bpe, chat, collocations, exact_dedup, html_extract, infill, language, line_dedup, neighbours, packing, pii, simhash, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_language_id": language.op3_language_id,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_pii": pii.op8_pii,
    "op9_bpe": bpe.op9_bpe,
    "op10_chat_format": chat.op10_chat_format,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_infill": infill.op13_infill,
}
ORACLE_SQL = {"op5_exact_dedup": exact_dedup.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
