"""Registry of this subpackage's queries and their SQL oracles."""

from __future__ import annotations

from tallyforge.llm import (
    decontaminate,
    html_text,
    importance,
    licenses,
    media,
    mixing,
    near_dedup,
    periodic,
    pii,
    quality,
    token_output,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_html_text": html_text.op2_html_text,
    "op3_near_duplicates": near_dedup.op3_near_duplicates,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_personal_data": pii.op6_personal_data,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_media_columns": media.op8_media_columns,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_importance": importance.op11_importance,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_token_output": token_output.op13_token_output,
}

ORACLES = {
    "op5_mix_sources": mixing.OP5_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_importance": importance.OP11_SQL,
}
