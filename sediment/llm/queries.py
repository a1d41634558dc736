"""Queries of the subpackage and their SQL, for the driver's entry."""

from __future__ import annotations

from sediment.llm import decontaminate, language_id, language_model, licenses, media, near_duplicates, quality, sentencepiece_scan, substrings, warc

QUERIES = {"op2_sentencepiece": sentencepiece_scan.op2_sentencepiece, "op9_language": language_id.op9_language, "op4_near_duplicates": near_duplicates.op4_near_duplicates, "op3_substrings": substrings.op3_substrings, "op6_language_model": language_model.op6_language_model, "op8_license": licenses.op8_license, "op1_decontaminate": decontaminate.op1_decontaminate, "op5_warc": warc.op5_warc, "op7_media": media.op7_media, "op10_quality": quality.op10_quality}
ORACLES = {"op4_near_duplicates": near_duplicates.OP4_SQL, "op8_license": licenses.op8_sql(), "op1_decontaminate": decontaminate.OP1_SQL, "op5_warc": warc.OP5_SQL}
